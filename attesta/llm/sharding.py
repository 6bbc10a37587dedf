"""Sharding by a hierarchical weighted hash tree (DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import numbered


@dataclass(frozen=True)
class Leaf:
    """One shard: where it stands and its weight (over 0)."""

    region: str
    rack: str
    shard: int
    weight: float = 1.0


def balanced_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> list[Leaf]:
    """Shards 0 to shards-1 of equal weight, filling racks and regions in order."""
    out = []
    for s in range(shards):
        rack = s // per_rack
        region = rack // racks_per_region
        out.append(Leaf(f"region{region}", f"region{region}/rack{rack % racks_per_region}", s))
    return out


def grown_tree(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own: no weight inside an old region changes, so rows
    move only into the new one."""
    new = max(leaf.shard for leaf in tree) + 1
    return [*tree, Leaf(f"region-of-{new}", f"region-of-{new}/rack0", new, weight)]


def _draw(key: Column, node: str, weight: float) -> Column:
    """Exponential draw of rate `weight` for this key and node: the least of several falls on each node with
    probability proportional to its weight, and a node's draw never depends on the others."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11)
    uniform = (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(float(weight))


def _winner(key: Column, nodes: dict, value: str) -> Column:
    draws = [F.struct(_draw(key, str(n), w).alias("draw"), F.lit(n).alias(value)) for n, w in sorted(nodes.items(), key=lambda x: str(x[0]))]
    return (F.array_min(F.array(*draws)) if len(draws) > 1 else draws[0])[value]


def _pick(chosen: Column, options: dict[str, Column]) -> Column:
    out = None
    for name, column in options.items():
        out = F.when(chosen == name, column) if out is None else out.when(chosen == name, column)
    return out


def hash_tree(df: DataFrame, key: Column, tree: list[Leaf], prefix: str = "") -> DataFrame:
    """Add region, rack and shard: at each level the node with the least weighted draw among its siblings.

    A node's weight is the sum of its leaves' weights, so a change of one weight moves rows only between the
    subtrees on the path to it. A null key is a key like any other. Columns of those names are replaced.
    """
    if not tree or any(leaf.weight <= 0 for leaf in tree):
        raise ValueError("the tree needs at least one leaf, and weights over 0")
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    leaves: dict[str, dict[int, float]] = {}
    for leaf in tree:
        regions[leaf.region] = regions.get(leaf.region, 0.0) + leaf.weight
        inside = racks.setdefault(leaf.region, {})
        inside[leaf.rack] = inside.get(leaf.rack, 0.0) + leaf.weight
        leaves.setdefault(leaf.rack, {})[leaf.shard] = leaf.weight
    region, rack, shard = f"{prefix}region", f"{prefix}rack", f"{prefix}shard"
    df = df.withColumn(region, _winner(key, regions, "node"))
    df = df.withColumn(rack, _pick(F.col(region), {r: _winner(key, inside, "node") for r, inside in racks.items()}))
    return df.withColumn(shard, _pick(F.col(rack), {r: _winner(key, inside, "node") for r, inside in leaves.items()}).cast("int"))


def shard_documents(docs: DataFrame, tree: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """Deal documents (doc_id, text) into the tree's shards by doc_id alone.

    Returns one row for each row of docs: doc_id, size (UTF-8 bytes plus 1), text_crc32, region, rack, shard,
    slot (place in its shard, gapless from 0, by doc_id) and, with a grown tree, grown_shard.
    Null and empty texts have size 1 and CRC 0; a null doc_id is dealt like any other key; equal doc_ids share
    a shard and get consecutive slots, whatever their texts; an empty table gives no rows; other columns of
    docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = hash_tree(rows, F.col("doc_id"), tree)
    if grown:
        rows = hash_tree(rows, F.col("doc_id"), grown, "grown_").drop("grown_region", "grown_rack")
    order = [F.col(c) for c in ("shard", "doc_id", "text_crc32", "size")]
    return numbered(rows, order, "slot", group="shard")


def op5_hash_tree_sharding(spark, sf_dir: str) -> DataFrame:
    tree = balanced_tree(16)
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tree, grown_tree(tree))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
