"""Connected components of a link table, by joins and aggregations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import dropped, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (node, component) for every node of the links, the component named by its
    least node.

    Alternates the two star contractions (large star: neighbours above a node move to the least node known to
    it; small star: neighbours below do) until nothing changes; the rounds grow with the logarithm of the
    number of nodes. The least neighbour of each node is a map-side-combined minimum, and the join back is a
    sort-merge join, whose skewed partitions AQE splits, so a node with very many links is no hot task. Each
    round's links are a table in the shared folder, which goes when the next round's is there.
    Nulls take part in no link; loops and repeated links change nothing; no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = stored(edges.where("u <> v").distinct(), "links")
    while True:
        # large star: u > v in every row; each neighbour above a node goes to the least of the node and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m")), "least")
        large = edges.join(least.hint("merge"), F.col("v") == F.col("_u")).select("u", F.col("m").alias("v"))
        large = stored(large.distinct(), "large-star")
        dropped(edges, least)
        # small star: each node and its neighbours below go to the least of those
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), "m"), "least")
        small = large.join(least.hint("merge"), F.col("u") == F.col("_u"))
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        small = stored(small.where("u <> v").distinct(), "small-star")
        dropped(large, least)
        # done when the links are stars: each non-root has one link, to a root
        roots_that_have_parents = small.select(F.col("v").alias("u")).distinct().join(small.select("u").distinct().hint("merge"), "u", "left_semi").limit(1).count()
        doubled = small.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        edges = small
        if not roots_that_have_parents and not doubled:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
