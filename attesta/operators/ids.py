"""Surrogate ids for new entities, and what is registered under them."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import joins, store, tables

#: Rows of one partition of Spark's numbering.
_ROW_BITS = 33


def allocate_ids(rows: DataFrame, order: list[str], after: int = 0, name: str = "entity_id") -> DataFrame:
    """Rows with a long id each: gapless from after + 1 in the order of columns whose values no two rows share.

    The order alone decides, so that a run on the same rows gives the same ids however they are spread. One exchange by ranges; only a count
    for each range is gathered, and where a range begins comes from their sums.
    """
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged, _ = store.written(ranged, "ranged")
    part = F.shiftright("_at", _ROW_BITS)
    counts = sorted((r.part, r.n) for r in ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # a row for each range
    starts = [(p, after + 1 + s) for (p, _), s in zip(counts, accumulate((n for _, n in counts), initial=0))]
    offsets = spark.createDataFrame(starts, "_part long, _start long")
    # as many rows as there are ranges
    joined = ranged.join(F.broadcast(offsets), part == F.col("_part"))
    number = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + F.col("_start")
    return joined.select(*rows.columns, number.alias(name))


def resolve_or_create(names: DataFrame, entities: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, entity_id, canonical_name) of every distinct trimmed name that isn't blank, and the entities with a new one for each name that is no
    entity's name, active keyword or alias.

    New ids follow the largest one in the order of names. Names are resolved against the table as it is, so that one call's names don't
    depend on one another.
    """
    asked = names.select(F.trim("name").alias("name")).where("name <> ''").distinct()
    found, _ = store.written(joins.resolve_entities(asked, entities, keywords).select("name", "entity_id"), "resolved")
    last = entities.agg(F.max("entity_id")).first()[0] or 0
    new = allocate_ids(found.where("entity_id is null").select("name"), ["name"], last)
    new, _ = store.written(new.select("entity_id", "name", F.array().cast("array<string>").alias("aliases")), "new-entities")
    everyone = entities.unionByName(new, allowMissingColumns=True)
    known = found.where("entity_id is not null").join(entities.select("entity_id", F.col("name").alias("canonical_name")).hint("merge"), "entity_id")
    named = known.select("name", "entity_id", "canonical_name").unionByName(new.select("name", "entity_id", F.col("name").alias("canonical_name")))
    return named, everyone


def register_names(entities: DataFrame, keywords: DataFrame, aliases: DataFrame) -> DataFrame:
    """Register aliases (canonical_name, alias) by name: an unknown canonical name becomes an entity, and its alias is the new
    entity's in the same call. Rows with a blank name or alias go; aliases are the entity's sorted ones, without its name."""
    rows = aliases.select(F.trim("canonical_name").alias("name"), F.trim("alias").alias("alias")).where("name <> '' and alias <> ''")
    named, everyone = resolve_or_create(rows, entities, keywords)
    return tables.register_aliases(everyone, rows.join(named.hint("merge"), "name").select("entity_id", "alias"))


def add_media(media: DataFrame, incoming: DataFrame, entities: DataFrame, keywords: DataFrame, deleted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Media with new files under their entities' canonical names, and the entities: a file of an unknown name makes one."""
    named, everyone = resolve_or_create(incoming.select(F.col("entity_name").alias("name")), entities, keywords)
    return tables.media_append(media, incoming.withColumn("entity_name", F.trim("entity_name")), named.select("name", "canonical_name"), deleted), everyone
