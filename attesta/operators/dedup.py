"""Unions and keep-first deduplication."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.text import host_of, strip
from attesta.operators.store import drop_folder, written


def union_results(*parts: DataFrame) -> DataFrame:
    """Concatenate providers' results in the given order: adds provider_pos; columns may differ."""
    out = None
    for i, part in enumerate(parts):
        part = part.withColumn("provider_pos", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def in_order(df: DataFrame) -> DataFrame:
    """A union's rows with `ord` by provider, then by each provider's own order (below 2**40)."""
    return df.withColumn("ord", F.shiftleft(F.col("provider_pos").cast("long"), 40) + F.col("ord").cast("long"))


def dedup_by_url(df: DataFrame, key: str = "query_key") -> DataFrame:
    """The first row (by ord) of each url of a query."""
    first = F.row_number().over(Window.partitionBy(key, "url").orderBy("ord"))
    return df.withColumn("_first", first).where("_first = 1").drop("_first")


#: Rows of one query and host, undecided after PARALLEL rounds, up to which one task decides them in order.
LOCAL_ROWS, PARALLEL = 500_000, 2

def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow function: rows sorted by (_key, _host, _ord) to those kept by the sequential loop. What is kept of one host alone is held."""
    at, urls, signs = None, set(), set()
    for batch in batches:
        key, host, u1, u2, s1, s2 = (batch.column(c).to_pylist() for c in ("_key", "_host", "_u1", "_u2", "_s1", "_s2"))
        keep = []
        for i, here in enumerate(zip(key, host)):
            if here != at:
                at, urls, signs = here, set(), set()
            url, sign = (u1[i], u2[i]), (s1[i], s2[i])
            if url not in urls and sign not in signs:
                urls.add(url)
                signs.add(sign)
                keep.append(i)
        yield batch.select(["_key", "_ord"]).take(pa.array(keep, pa.int64()))


def kept_ids(df: DataFrame, key: str = "query_key", title_chars: int = 80, local_rows: int = LOCAL_ROWS, rounds: list[int] | None = None) -> DataFrame:
    """(_key, _ord) of the rows that keep-first deduplication on url and on host with title keeps; see dedup_results.

    First come rounds over all rows: a row that is first among the undecided ones in both of its groups is kept, and its group mates are
    dropped; rounds are minima, combined on the map side, and joins of hashed keys alone, so that a hot url or title is no hot
    task. Both keys hold the host, so that no row drops one of another host: after PARALLEL rounds the few that are left of each
    query and host, up to local_rows (counted), are decided in their order by one task, however long their chains; hosts
    with more left go on in rounds until they are within that. rounds: gets the rows left after each round, for tests.
    """
    spark = df.sparkSession
    url, title = strip(F.coalesce("url", F.lit(""))), F.lower(strip(F.coalesce("title", F.lit(""))))
    todo = df.select(F.col(key).alias("_key"), F.col("ord").alias("_ord"), url.alias("_url"), F.substring(title, 1, title_chars).alias("_t")).where("_url <> ''")
    # rows without a title have a signature of their own
    host = host_of(F.col("_url"))
    sig = F.when(F.col("_t") == "", F.concat(F.lit("#"), F.col("_ord").cast("string"))).otherwise(F.concat_ws("|", host, F.col("_t")))
    todo = todo.select("_key", F.xxhash64(host).alias("_host"), "_ord", F.xxhash64("_url").alias("_u1"), F.xxhash64("_url", F.lit(1)).alias("_u2"), F.xxhash64(sig).alias("_s1"), F.xxhash64(sig, F.lit(1)).alias("_s2"))
    todo, folder = written(todo, "dedup-keys")
    by_url, by_sig, kept, done = ["_key", "_u1", "_u2"], ["_key", "_s1", "_s2"], None, 0
    while True:
        first_url, first_sig = (todo.groupBy(*k).agg(F.min("_ord").alias(name)) for k, name in ((by_url, "_first"), (by_sig, "_first2")))
        new = todo.join(first_url.hint("merge"), by_url).where("_ord = _first").join(first_sig.hint("merge"), by_sig).where("_ord = _first2")
        new, _ = written(new.select(todo.columns), "dedup-kept")
        ids = new.select("_key", "_ord")
        kept = ids if kept is None else kept.unionByName(ids)
        left = todo.join(new.select(*by_url).hint("merge"), by_url, "left_anti").join(new.select(*by_sig).hint("merge"), by_sig, "left_anti")
        todo, folder, before = *written(left.select(todo.columns), "dedup-left"), folder
        drop_folder(spark, before)
        done += 1
        if rounds is not None:
            rounds.append(todo.count())
        if todo.isEmpty():
            return kept
        if done < PARALLEL:
            continue
        sizes = todo.groupBy("_key", "_host").agg(F.count("*").alias("_n"))
        sized, sized_folder = written(todo.join(sizes.hint("merge"), ["_key", "_host"]), "dedup-sized")
        here = sized.where(F.col("_n") <= local_rows).repartition("_key", "_host").sortWithinPartitions("_key", "_host", "_ord")
        solved, _ = written(here.mapInArrow(_in_order, ids.schema), "dedup-kept")
        kept = kept.unionByName(solved)
        todo, folder, before = *written(sized.where(F.col("_n") > local_rows).select(todo.columns), "dedup-left"), folder
        for f in (before, sized_folder):
            drop_folder(spark, f)
        if todo.isEmpty():
            return kept


def dedup_results(df: DataFrame, key: str = "query_key", title_chars: int = 80, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Keep-first deduplication on two keys at once: the url, and the host with the start of the title.

    A row is dropped if an earlier kept row (by ord, unique within a query) of the query has its url or, if its title isn't blank, its host
    and title; dropped rows drop no others. Rows without a url go. Rows are joined to what kept_ids keeps once.
    """
    ids = kept_ids(df, key, title_chars, local_rows)
    return df.join(ids.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("ord") == F.col("_ord")), "left_semi")
