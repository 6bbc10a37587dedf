"""Reviews to be labelled: what a labeller gets of each, in batches, with claims that other runs respect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators import store
from attesta.operators.ids import allocate_ids

#: Reviews of one call of the labeller and of the one for dimensions; characters of a content, and of a title for each of
#: them; the least relevance of a review that gets dimensions; the lines of a message.
LABEL_BATCH, DIMENSION_BATCH, CONTENT, LABEL_TITLE, DIMENSION_TITLE, RELEVANT = 40, 30, 600, 100, 80, 0.6
LABEL_LINES = ("目標組織：", "來源平台：", "標題：", "內容：")
DIMENSION_LINES = ("組織：", "平台：", "標題：", "內容：")


def _message(lines: tuple[str, ...], title: int) -> Column:
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    values = (text("entity"), text("platform"), F.substring(text("parent_title"), 1, title), F.substring(text("content"), 1, CONTENT))
    return F.concat_ws("\n", *(F.concat(F.lit(line), v) for line, v in zip(lines, values)))


def to_label(reviews: DataFrame, everything: bool = False, entity: str | None = None) -> DataFrame:
    """(entity, review_id, message) of the reviews (review_id, entity, platform, parent_title, content, analyzed_at) that have no labels yet, or of
    all; of one entity if given."""
    rows = reviews if everything else reviews.where("analyzed_at is null")
    rows = rows.where(F.col("entity") == entity) if entity is not None else rows
    return rows.select("entity", "review_id", _message(LABEL_LINES, LABEL_TITLE).alias("message"))


def to_tag(reviews: DataFrame, everything: bool = False, entity: str | None = None) -> DataFrame:
    """(entity, review_id, message) of the relevant reviews of type review that have no dimensions yet (dimensions_classified_at), or of all."""
    rows = reviews.where((F.col("relevance_score") >= RELEVANT) & (F.col("content_type") == "review"))
    rows = rows if everything else rows.where("dimensions_classified_at is null")
    rows = rows.where(F.col("entity") == entity) if entity is not None else rows
    return rows.select("entity", "review_id", _message(DIMENSION_LINES, DIMENSION_TITLE).alias("message"))


def batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Rows in batches of `size` in the given order (unique): adds batch and place in it, both from 0. Dealt by allocate_ids, without a
    window over all rows, and the same on each run over the same rows; only the last batch is smaller."""
    numbered = allocate_ids(rows, order, -1, "_number")
    return numbered.withColumns({"batch": F.floor(F.col("_number") / size), "place": (F.col("_number") % size).cast("int")}).drop("_number")


def claim(rows: DataFrame, path: str, run_id: str, as_of: str, hours: int = 6, limit: int | None = None, buckets: int = 64) -> DataFrame:
    """The rows (review_id, ...) that this run may work on: those that no other run has claimed, which it claims for `hours` from as_of.

    Claims are a store by review_id at path. A run that asks again gets its own rows again; a claim that has run out is free. limit: rows that
    a run has at most, the first by review_id.
    """
    spark = rows.sparkSession
    if not store.exists(spark, path):
        store.write_table(spark.createDataFrame([], "review_id long, run_id string, until timestamp_ntz"), path, ["review_id"], buckets)
    at = F.lit(as_of).cast("timestamp_ntz")
    taken = store.read_table(spark, path).where((F.col("until") > at) & (F.col("run_id") != run_id)).select("review_id")
    free = rows.join(taken.hint("merge"), "review_id", "left_anti")
    free, folder = store.written(free.orderBy("review_id").limit(limit) if limit is not None else free, "claimed")
    store.merge_table(free.select("review_id", F.lit(run_id).alias("run_id"), (at + F.make_dt_interval(hours=F.lit(hours))).alias("until")), path)
    return free


def release(path: str, labelled: DataFrame) -> None:
    """Forget the claims of reviews (review_id) that have their labels now."""
    store.merge_table(labelled.select("review_id", F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("timestamp_ntz").alias("until")), path, lambda old, new: old.join(new.select("review_id").hint("merge"), "review_id", "left_anti"))
