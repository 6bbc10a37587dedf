"""SimHash near-duplicates: tiled exact comparison of fingerprints."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import BLANKS, lookup_join, stored
from attesta.llm.components import components

SHINGLE_WORDS, RADIUS, SEED = 3, 2, 42
#: Fingerprints of one tile at most; bits of one of the segments whose population counts name a tile.
TILE, SEGMENT = 2048, 16

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def simhash(text: str, words, width: int) -> int:
    from xxhash import xxh64_intdigest

    found = words(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not found:
        return 0
    shingles = [" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]
    total, counts = len(shingles), np.zeros(64, dtype=np.int64)
    for at in range(0, total, 65536):
        part = np.array([xxh64_intdigest(s, SEED) for s in shingles[at : at + 65536]], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > total, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(width: int, keep: list[str]):
    pattern = rf"[^{BLANKS}]+".encode().decode("unicode_escape")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(pattern).findall
        for batch in batches:
            prints = [simhash(t or "", words, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64()), *(batch.column(c) for c in keep)], ["doc_id", "bits", *keep])

    return run


def fingerprints(docs: DataFrame, width: int = SHINGLE_WORDS, keep: list[str] = []) -> DataFrame:
    """(doc_id, bits, keep): the 64-bit SimHash of every whole text over its shingles of `width` lower-cased words."""
    kept = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select("doc_id", "text", *keep).mapInArrow(_fingerprints(width, keep), f"doc_id long, bits long{kept}")


def _segment_counts(bits: str, segment: int):
    """Population count of each segment of the fingerprint, as one array."""
    mask = (1 << segment) - 1
    return F.array(*(F.bit_count(F.shiftrightunsigned(F.col(bits), s).bitwiseAND(F.lit(mask))).cast("int") for s in range(0, 64, segment)))


def _near_offsets(segments: int, radius: int) -> list[list[int]]:
    """Differences of segment counts whose absolute values sum to the radius at most, one of each pair d, -d."""
    found = [[]]
    for _ in range(segments):
        found = [[*d, x] for d in found for x in range(-radius, radius + 1) if sum(map(abs, d)) + abs(x) <= radius]
    return [d for d in found if d >= [-x for x in d]]


def _spanning(a: np.ndarray, b: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """The links of (a, b) that join what is not yet joined in `parent`."""

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            out.append((x, y))
    return out


def _compare(radius: int):
    """mapInArrow function: pairs of tiles to links between their fingerprints that keep the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for left, right in zip(batch.column("left_bits"), batch.column("right_bits")):
                x, y = (side.values.to_numpy().view(np.uint64) for side in (left, right))
                parent: dict[int, int] = {}
                for at in range(0, len(x), 256):  # 256 rows of the pair of tiles at once
                    i, j = np.nonzero(np.bitwise_count(x[at : at + 256, None] ^ y[None, :]) <= radius)
                    a, b = x[at + i].view(np.int64), y[j].view(np.int64)
                    links += _spanning(a[a != b], b[a != b], parent)
            a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def near_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `bits` (stored, unique) at most `radius` bits apart.

    Fingerprints lie in tiles by the population counts of their segments; a pair of tiles is skipped
    if the counts differ by more than the radius in sum, as no bits can then be near. All other pairs of tiles are compared
    exactly. Of the links of one pair of tiles, only as many come back as keep its components: none is
    lost between components. Tiles of one name hold at most about TILE fingerprints each.
    """
    segments = 64 // SEGMENT
    cells = prints.select("bits", _segment_counts("bits", SEGMENT).alias("counts"))
    sizes = cells.groupBy("counts").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    sizes = stored(sizes, "tile-sizes")
    dealt = cells.join(sizes.hint("merge"), "counts").withColumn("part", F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int"))
    tiles = stored(dealt.groupBy("counts", "part").agg(F.collect_list("bits").alias("tile"), F.first("parts").alias("parts")), "tiles")
    offsets = F.array(*(F.array(*map(F.lit, d)) for d in _near_offsets(segments, radius)))
    near = tiles.select(F.col("counts").alias("own"), F.col("part").alias("own_part"), F.col("tile").alias("left_bits"), F.explode(offsets).alias("d"))
    near = near.withColumn("counts", F.zip_with("own", "d", lambda x, y: x + y)).drop("d")
    pairs = near.join(tiles.hint("merge"), "counts").where((F.col("own") != F.col("counts")) | (F.col("own_part") <= F.col("part")))
    pairs = pairs.select("left_bits", F.col("tile").alias("right_bits")).hint("rebalance")
    return pairs.mapInArrow(_compare(radius), "a long, b long")


def _grouped(prints: DataFrame, radius: int) -> DataFrame:
    """(bits, least_id, component) of each distinct fingerprint; the component is named by one of its fingerprints."""
    distinct = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    joined = stored(components(near_links(distinct, radius)), "components")
    named = distinct.join(joined.hint("merge"), F.col("bits") == F.col("node"), "left").select("bits", "least_id", F.coalesce("component", "bits").alias("component"))
    return stored(named, "named")


def other_rows(docs: DataFrame, row: str, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(row): of each component of documents the rows but one, which is the least by (doc_id, row), null doc_ids last.

    row: a column of docs whose values are unique and not null. Components are those of `near_duplicates`; rows of equal or
    no doc_ids are told apart.
    """
    prints = stored(fingerprints(docs, width, [row]), "fingerprints")
    named = _grouped(prints, radius).select("bits", "component")
    placed = stored(prints.join(named.hint("merge"), "bits").select("component", "doc_id", row), "placed-rows")
    best = placed.groupBy(F.col("component").alias("c")).agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"))
    best = stored(best.where("n > 1").select("c", F.col("first")[row].alias("first")), "first-rows")
    return lookup_join(placed, best, F.col("component") == F.col("c")).where(F.col(row) != F.col("first")).select(row)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, bits, component_id) of every document; component_id is the least doc_id that links reach.

    Fingerprints link at `radius` or fewer differing bits; components are those of all documents' links.
    A null or empty text and one without words have fingerprint 0 and link like others; shorter texts than `width` words are one
    shingle; equal rows have equal results, one each; null doc_ids are linked, but never name a component
    unless all its ids are null; an empty table gives no rows; other columns are not read.
    """
    prints = stored(fingerprints(docs, width), "fingerprints")
    named = _grouped(prints, radius)
    least = stored(named.groupBy("component").agg(F.min("least_id").alias("component_id")), "least-ids")
    named = stored(named.join(least.hint("merge"), "component").select("bits", "component_id"), "fingerprint-components")
    return prints.join(named.hint("merge"), "bits").select("doc_id", "bits", "component_id")


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
