"""Mixing sources to target weights by cube-method balanced sampling."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import WORD, lookup_join, numbered, stored

#: Units of one flight; a block of the next round gathers the few units that each of FAN blocks leaves.
BLOCK_ROWS, FAN = 2048, 512
_SURE = 1e-9


def word_count(text: Column) -> Column:
    """Runs of characters that are not ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def target_sizes(sources: DataFrame) -> DataFrame:
    """From (source, source_size, docs), stored: add place (by code point, null last), weight and target.

    Sources weigh 1, 2, 3, repeating, and share the total; a target stops at MAX_REPEATS times its source's
    size, and the excess goes to the others by weight until none is above. The driver sees only sums.
    """
    placed = stored(numbered(sources, [F.col("source").asc_nulls_last()], "place"), "mix-sources")
    placed = placed.withColumn("weight", (F.col("place") % 3 + 1).cast("double"))
    most = F.lit(float(MAX_REPEATS)) * F.col("source_size")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, held = 0.0, -1
    while True:
        over = F.lit(level) * F.col("weight") >= most
        n, fixed, free = placed.agg(F.count_if(over), F.sum(F.when(over, most)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == held or not free:
            break
        held = n
        level = (total - (fixed or 0.0)) / free
    target = F.least(F.lit(level) * F.col("weight"), most) if free else most
    return placed.withColumn("target", target.cast("double"))


#: No source is taken more often than so many times.
MAX_REPEATS = 3


def _direction(x: np.ndarray) -> np.ndarray | None:
    """A vector with first entry 1 that keeps the sums of (1, x): the others answer for the first as evenly as
    they can. None if they can't."""
    a, rest = x[0], x[1:]
    mean = rest.mean()
    spread = rest - mean
    var = float(spread @ spread)
    if var > _SURE * (1.0 + mean * mean):
        return np.concatenate(([1.0], -1.0 / len(rest) - (a - mean) / var * spread))
    return np.concatenate(([1.0], np.full(len(rest), -1.0 / len(rest)))) if abs(a - mean) <= _SURE * (1.0 + mean) else None


def flight(size: np.ndarray, p: np.ndarray, draws: np.ndarray, land: bool) -> np.ndarray:
    """Flight phase of the cube method for the balancing variables (1, size); sizes in descending order.

    The probabilities of all undecided units move along a direction that keeps both totals, chosen for the
    largest one, until a unit is at 0 or 1, with odds that keep each unit's expectation. So large units are
    decided while there are many others to answer for them, and at most two small ones stay undecided.
    land: those are decided as well, along the direction that keeps the size total alone, the last by a draw.
    """
    p, x, d = p.astype(float).copy(), size.astype(float), iter(draws.tolist())

    def move(units: np.ndarray, u: np.ndarray) -> None:
        q = p[units]
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf))
            back = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf))
        up, down = room.min(), back.min()
        forward = next(d) * (up + down) < down
        q = q + (up if forward else -down) * u
        q[np.argmin(room if forward else back)] = np.round(q[np.argmin(room if forward else back)])
        p[units] = np.where(q < _SURE, 0.0, np.where(q > 1 - _SURE, 1.0, q))

    def undecided(among: np.ndarray) -> np.ndarray:
        return among[(p[among] > 0) & (p[among] < 1)]

    held, aside = undecided(np.arange(len(p))), []
    while len(held) > 2:
        u = _direction(x[held])
        if u is None:  # the others are all of one size, another one: no direction for the first
            aside.append(held[0])
            held = held[1:]
        else:
            move(held, u)
            held = undecided(held)
    if land:
        held = np.array([*aside, *held], dtype=int)
        while len(held) > 1:
            pair = held[:2]
            a, b = x[pair]
            move(pair, np.array([b, -a]) / max(a, b) if b > 0 else np.array([1.0, 0.0]) if a > 0 else np.array([1.0, -1.0]))
            held = undecided(held)
        for i in held:
            p[i] = 1.0 if next(d) < p[i] else 0.0
    return p


def _fly(land: bool):
    def run(group: pa.Table) -> pa.Table:
        size, luck = group.column("size").to_numpy(), group.column("luck").to_numpy()
        order = np.lexsort((luck, -size))
        draws = np.random.default_rng(int(np.bitwise_xor.reduce(luck).view(np.uint64))).random(len(size) + 4)
        p = flight(size[order], group.column("p").to_numpy()[order], draws, land)
        group = group.take(pa.array(order))
        return group.set_column(group.column_names.index("p"), "p", pa.array(p))

    return run


def balanced_sample(units: DataFrame, stratum: str, counts: DataFrame, seed: int = 0) -> DataFrame:
    """Cube-method sample of units (doc_id, size, p, and `stratum`, a long), each stratum by itself.

    counts: (stratum, docs), stored. Adds `chosen` (0 or 1) with expectation p; within a stratum the number of
    chosen units and their sizes keep the totals of p and p * size, but for the last unit or two. Units whose p
    is 0 or 1 stay. Blocks of about BLOCK_ROWS units fly at once; each leaves two or three units at most, which meet
    in the blocks of the next round, until a stratum is one block, where the landing is. All draws are hashes
    of the units, so that reruns agree; more than BLOCK_ROWS units of one id and size are dealt to blocks by their places in the table.
    """
    blocks = counts.select(F.col(stratum).alias("_s"), F.greatest(F.lit(1), F.ceil(F.col("docs") / BLOCK_ROWS)).cast("long").alias("_blocks"))
    most = blocks.agg(F.max("_blocks")).first()[0] or 1
    luck = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    units = lookup_join(units, blocks, F.col(stratum) == F.col("_s")).drop("_s").withColumn("luck", luck)
    # rows equal in id and size, those without either above all, would be one block, however many: they are dealt by their number
    hot = stored(units.groupBy(stratum, "luck").agg(F.count("*").alias("_same")).where(F.col("_same") > BLOCK_ROWS), "mix-equal-rows")
    hot = hot.select(F.col(stratum).alias("_s"), F.col("luck").alias("_l"), F.col("_same"))
    units = lookup_join(units, hot, (F.col(stratum) == F.col("_s")) & (F.col("luck") == F.col("_l")), "left").drop("_s", "_l")
    dealt = F.when(F.col("_same").isNull(), F.col("luck")).otherwise(F.xxhash64("luck", F.monotonically_increasing_id()))
    units = units.withColumn("luck", dealt).withColumn("block", F.pmod("luck", F.col("_blocks"))).drop("_blocks", "_same")
    columns = units.columns
    decided, level = None, 0
    while True:
        land = most == 1
        flown = units.groupBy(stratum, "block").applyInArrow(_fly(land), units.schema).select(*columns)
        flown = stored(flown, f"mix-flight{level}")
        done = flown if land else flown.where((F.col("p") <= 0) | (F.col("p") >= 1))
        decided = done if decided is None else decided.unionByName(done)
        if land:
            break
        units = flown.where((F.col("p") > 0) & (F.col("p") < 1)).withColumn("block", F.floor(F.col("block") / FAN).cast("long"))
        most, level = math.ceil(most / FAN), level + 1
    return decided.withColumn("chosen", F.col("p").cast("int")).drop("p", "luck", "block")


def mix(docs: DataFrame, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """How often each document is taken so that the sources' sizes come to their targets.

    A source with target t and size s is taken floor(t/s) times as a whole; the fraction left is the inclusion
    probability of a cube-method sample. Returns a row for each row of docs: doc_id, source, size (words),
    source_size, weight, target, copies (0 to 3), taken (copies * size), and the (small) columns to keep.
    Null texts and texts without words have size 0 and take 0 words; a null source is a source, the last one; equal rows are separate
    units; a null doc_id is allowed; an empty table gives no rows; other columns are not read.
    """
    sized = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *(keep or [])), "mix-sizes")
    sources = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "mix-totals")
    targets = stored(target_sizes(sources), "mix-targets")
    rate = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)), F.lit(float(MAX_REPEATS)))
    rates = targets.select(F.col("source").alias("_source"), "place", "weight", "source_size", "target", rate.alias("rate"))
    units = lookup_join(sized, rates, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    whole = F.floor(F.col("rate") + _SURE)
    units = units.withColumn("whole", whole.cast("long")).withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - whole)).drop("rate")
    sampled = balanced_sample(units, "place", targets.select("place", "docs"), seed)
    copies = F.col("whole") + F.col("chosen")
    return sampled.select("doc_id", "source", "size", "source_size", "weight", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(keep or []))


def op1_cube_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
