"""Bloom filters of hashes, one for each bucket of a keyed table, so that most unseen hashes need no look at the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators import store

#: Bits of one bitmap of Spark's; bits that each hash sets.
BITS, PROBES = 32_768, 4


def places(hash_col: str, slots: int) -> Column:
    """The bits of a hash, as array<struct<slot, bit>>, among `slots` bitmaps."""
    at = [F.pmod(F.xxhash64(hash_col, F.lit(i)), F.lit(slots * BITS)) for i in range(PROBES)]
    return F.array(*(F.struct((p / BITS).cast("int").alias("slot"), (p % BITS).cast("int").alias("bit")) for p in at))


def create(spark, path: str, buckets: int) -> None:
    store.write_table(spark.createDataFrame([], "part int, slot int, bits binary"), path, ["part", "slot"], buckets)


def _rows(hashes: DataFrame, hash_col: str, parts: int, slots: int) -> DataFrame:
    part = F.pmod(F.xxhash64(hash_col), F.lit(parts)).cast("int").alias("part")
    return hashes.select(hash_col, part, F.explode(places(hash_col, slots)).alias("_p")).select(hash_col, "part", "_p.slot", "_p.bit")


def add(hashes: DataFrame, hash_col: str, path: str, parts: int, slots: int, batch: int | None = None) -> dict:
    """Set the bits of hashes; adding one again changes nothing."""
    rows = _rows(hashes, hash_col, parts, slots)
    new = rows.groupBy("part", "slot").agg(F.bitmap_construct_agg(F.col("bit").cast("long")).alias("bits"))
    both = lambda old, more: old.unionByName(more).groupBy("part", "slot").agg(F.bitmap_or_agg("bits").alias("bits"))
    return store.merge_table(new, path, both, "filter", batch)


def may_hold(hashes: DataFrame, hash_col: str, path: str, parts: int, slots: int) -> DataFrame:
    """The hashes all of whose bits are set: all that were added, and few others."""
    rows = _rows(hashes.select(hash_col).distinct(), hash_col, parts, slots)
    bitmaps, _ = store.read_buckets_of(rows, path)
    met = rows.join(bitmaps.hint("merge"), ["part", "slot"])
    byte = F.conv(F.hex(F.substr("bits", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = met.where(F.getbit(byte, F.col("bit") % 8) == 1)
    return hit.groupBy(hash_col).agg(F.count("*").alias("_n")).where(F.col("_n") == PROBES).select(hash_col)
