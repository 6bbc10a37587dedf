"""Stream forms of the ingest, upsert and rating operators. History is in keyed tables, not in state; each batch is applied once, however
often it is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attesta.operators import keyfilter, store
from attesta.operators.tables import first_reviews, upsert_sources

#: Buckets of a keyed table; bitmaps of the Bloom filter of each bucket (32,768 bits each; ten bits a hash give about one in a hundred wrong).
BUCKETS, SLOTS = 64, 4


def _started(df: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- reviews ------------------------------------------------------------------------------------------------------------------------


def ingest_batch(batch: DataFrame, batch_id: int, path: str, buckets: int = BUCKETS, slots: int = SLOTS) -> dict:
    """Insert the batch's reviews whose content hash no earlier batch had, as path/reviews/batch_id=<batch_id>.

    path/index holds all hashes by bucket with the batch that brought them, path/filter a Bloom filter for each bucket. Only hashes that the
    filter may hold are looked up, in their buckets of the index; reviews themselves are never read again. A batch that is sent
    again writes its own folder again and finds itself unseen. Returns inserted, maybe (hashes looked up) and buckets (of the index, read).
    """
    spark = batch.sparkSession
    index, bloom = f"{path}/index", f"{path}/filter"
    if not store.exists(spark, index):
        store.write_table(spark.createDataFrame([], "content_hash string, batch_id long"), index, ["content_hash"], buckets)
    if not store.exists(spark, bloom):
        keyfilter.create(spark, bloom, buckets)
    new, folder = store.written(first_reviews(batch), "reviews")
    maybe, maybe_folder = store.written(keyfilter.may_hold(new, "content_hash", bloom, buckets, slots), "maybe-seen")
    looked_up, read = maybe.count(), []
    fresh = new
    if looked_up:
        known, read = store.read_buckets_of(maybe, index)
        seen = known.where(F.col("batch_id") < batch_id).select("content_hash").join(maybe.hint("merge"), "content_hash", "left_semi")
        fresh = new.join(seen.hint("merge"), "content_hash", "left_anti")
    target = f"{path}/reviews/batch_id={batch_id}"
    fresh.select(new.columns).write.mode("overwrite").parquet(target)
    fresh = spark.read.schema(new.schema).parquet(target)
    # the first batch of a hash stays its batch
    earliest = lambda old, more: old.unionByName(more).groupBy("content_hash").agg(F.min("batch_id").alias("batch_id"))
    keyfilter.add(fresh, "content_hash", bloom, buckets, slots, batch_id)
    store.merge_table(fresh.select("content_hash", F.lit(batch_id).cast("long").alias("batch_id")), index, earliest, "reviews", batch_id)
    for f in (folder, maybe_folder):
        store.drop_folder(spark, f)
    return {"inserted": fresh.count(), "maybe": looked_up, "buckets": read}


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/reviews").parquet(f"{path}/reviews")


def stream_ingest_reviews(reviews: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, slots: int = SLOTS) -> StreamingQuery:
    """Insert reviews whose content hash the table at path does not have, batch by batch (see ingest_batch)."""
    return _started(reviews, lambda batch, batch_id: ingest_batch(batch, batch_id, path, buckets, slots), checkpoint)


# -- sources ------------------------------------------------------------------------------------------------------------------------


def upsert_batch(batch: DataFrame, batch_id: int, path: str, keep_if_empty: list[str], keep_if_null: list[str], buckets: int = BUCKETS) -> dict:
    """Merge a batch of sources into the table by url at path: only the buckets of its urls are read and written."""
    spark = batch.sparkSession
    columns = ["url", *keep_if_empty, *keep_if_null]
    rows = batch.withColumn("url", F.trim("url")).where("url <> ''").select(*columns, F.col("ord").cast("long").alias("ord"))
    if not store.exists(spark, path):
        store.write_table(upsert_sources(rows.limit(0), rows.limit(0), keep_if_empty, keep_if_null), path, ["url"], buckets)
    merge = lambda old, new: upsert_sources(old.withColumn("ord", F.lit(-1).cast("long")), new, keep_if_empty, keep_if_null)
    return store.merge_table(rows, path, merge, "sources", batch_id)


def stream_upsert_sources(sources: DataFrame, path: str, checkpoint: str, keep_if_empty: list[str], keep_if_null: list[str], buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the table by url at path up to date with a stream of sources (see upsert_batch); store.read_table reads it."""
    return _started(sources, lambda batch, batch_id: upsert_batch(batch, batch_id, path, keep_if_empty, keep_if_null, buckets), checkpoint)


# -- ratings ------------------------------------------------------------------------------------------------------------------------


def running_ratings(events: DataFrame) -> DataFrame:
    """The latest valid score of each user for each review, kept up to date (update mode)."""
    return events.where(F.col("score").between(1, 5)).groupBy("review_id", "user_id").agg(F.max_by("score", F.struct("ts", "event_id")).alias("score"))


def _last(rows: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("score", "ts", "event_id"), F.struct("ts", "event_id")).alias("b")
    return rows.groupBy("review_id", "user_id").agg(best).select("review_id", "user_id", "b.score", "b.ts", "b.event_id")


def rating_batch(batch: DataFrame, batch_id: int, path: str, buckets: int = BUCKETS) -> None:
    """Bring a batch of rating events (review_id, user_id, score, ts, event_id) into path/latest and path/summary.

    path/latest has the last valid score of each user for each review, path/summary the sum and number of scores of each review. A score that
    changes is a difference (new less old) in both, so that other reviews are not read. Differences are written before either
    table is changed, and each table takes a batch once: after a crash anywhere the batch can be sent again.
    """
    spark = batch.sparkSession
    latest, summary, deltas = f"{path}/latest", f"{path}/summary", f"{path}/deltas/batch={batch_id}"
    if not store.exists(spark, latest):
        store.write_table(_last(batch).limit(0), latest, ["review_id", "user_id"], buckets)
    if not store.exists(spark, summary):
        store.write_table(spark.createDataFrame([], "review_id long, score_sum long, ratings long"), summary, ["review_id"], buckets)
    new = _last(batch.where(F.col("score").between(1, 5)))
    if store.applied(spark, latest, "ratings") < batch_id:
        old = store.read_buckets_of(new, latest)[0].select("review_id", "user_id", F.col("score").alias("_score"), F.struct("ts", "event_id").alias("_at"))
        met = new.join(old.hint("merge"), ["review_id", "user_id"], "left").where(F.col("_at").isNull() | (F.struct("ts", "event_id") > F.col("_at")))
        more = F.sum(F.col("score") - F.coalesce("_score", F.lit(0))).cast("long").alias("score_sum")
        met.groupBy("review_id").agg(more, F.count_if(F.col("_at").isNull()).alias("ratings")).write.mode("overwrite").parquet(deltas)
        store.merge_table(new, latest, lambda old, more: _last(old.unionByName(more)), "ratings", batch_id)
    if store.applied(spark, summary, "ratings") < batch_id:
        changes = spark.read.schema("review_id long, score_sum long, ratings long").parquet(deltas)
        add = lambda old, more: old.unionByName(more).groupBy("review_id").agg(F.sum("score_sum").alias("score_sum"), F.sum("ratings").alias("ratings"))
        store.merge_table(changes, summary, add, "ratings", batch_id)
    store.drop_folder(spark, deltas)


def read_rating_summary(spark: SparkSession, path: str) -> DataFrame:
    """(review_id, average, ratings) as the batches so far leave it."""
    rows = store.read_table(spark, f"{path}/summary")
    return rows.select("review_id", (F.col("score_sum") / F.col("ratings")).alias("average"), "ratings")


def stream_ratings(events: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Keep latest scores and summaries by review up to date with a stream of rating events (see rating_batch)."""
    return _started(events, lambda batch, batch_id: rating_batch(batch, batch_id, path, buckets), checkpoint)
