"""Exact top-k inner-product search by MaxScore over shards of integer vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import stored

#: Vectors of a shard and queries of a block, about; exact integer sums are made in doubles below 2**53.
SHARD_ROWS, QUERY_ROWS, EXACT = 4096, 512, float(1 << 53)


def integer_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the vectors that have no null and no non-finite component."""
    x = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = F.col(embedding).isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where(fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of one block as doubles if sums of products are then exact, else as Python integers."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    out = np.zeros((len(column), width), dtype=np.int64)
    for i in range(len(column)):
        out[i, : at[i + 1] - at[i]] = flat[at[i] : at[i + 1]]
    return out


def max_score(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int, k: int, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows of a shard for one query (ties to the smaller id): their places and scores.

    A component of the query is a term, its posting the column of the shard, its score bound the most that it can
    add: max(q * high, q * low). Terms are taken from the largest bound range down. Postings of
    essential terms are traversed whole; once k rows' lower bounds pass what the terms left can still give to
    others, those terms are non-essential: they are probed only for rows that still compete.
    """
    most, least = np.maximum(q * high, q * low), np.minimum(q * high, q * low)
    order = np.argsort(least - most, kind="stable")
    order = order[most[order] != least[order]]
    fixed = (np.where(most == least, most, 0)).sum()
    rest_most, rest_least = most[order][::-1].cumsum()[::-1], least[order][::-1].cumsum()[::-1]
    rows = np.flatnonzero(ids != own)
    score = np.full(len(rows), fixed)
    step = max(1, len(order) // 8)
    for at in range(0, len(order), step):
        terms = order[at : at + step]
        score = score + x[np.ix_(rows, terms)] @ q[terms]
        after = at + len(terms)
        if after < len(order) and len(rows) > k:
            threshold = np.partition(score, len(score) - k)[-k] + rest_least[after]
            keep = score + rest_most[after] >= threshold  # equal scores may win by their ids
            if not keep.all():
                rows, score = rows[keep], score[keep]
    best = np.lexsort((ids[rows], -score))[:k]
    return rows[best], score[best]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_q, out_v, out_s = [], [], []
            for i in range(batch.num_rows):
                ids, xs = batch.column("ids")[i].values.to_numpy(), batch.column("xs")[i].values
                qids, qs = batch.column("query_ids")[i].values.to_numpy(), batch.column("queries")[i].values
                width = max([1, *(int(n) for side in (xs, qs) for n in [np.max(side.value_lengths().to_numpy(zero_copy_only=False))])])
                x, q = _matrix(xs, width), _matrix(qs, width)
                size = float(np.abs(x.astype(float)).max()) * float(np.abs(q.astype(float)).max()) * width
                x, q = (x.astype(float), q.astype(float)) if size < EXACT else (x.astype(object), q.astype(object))
                if size >= EXACT:  # too large for doubles: every row, in Python's integers
                    for j, qid in enumerate(qids):
                        scores = x @ q[j]
                        best = sorted((-s, v) for s, v in zip(scores, ids.tolist()) if v != qid)[:k]
                        out_q += [qid] * len(best)
                        out_v += [v for _, v in best]
                        out_s += [max(-(1 << 63), min((1 << 63) - 1, -s)) for s, _ in best]
                    continue
                high, low = x.max(axis=0), x.min(axis=0)
                for j, qid in enumerate(qids):
                    rows, scores = max_score(x, ids, q[j], qid, k, high, low)
                    out_q += [qid] * len(rows)
                    out_v += ids[rows].tolist()
                    out_s += scores.astype(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (out_q, out_v, out_s)], ["query_id", "vec_id", "score"])

    return run


def _blocks(vectors: DataFrame, rows: int, ids: str, xs: str, block: str) -> tuple[DataFrame, int]:
    n = max(1, -(-vectors.count() // rows))
    dealt = vectors.withColumn(block, F.pmod(F.xxhash64("vec_id", "x"), F.lit(n)).cast("long"))
    return stored(dealt.groupBy(block).agg(F.collect_list("vec_id").alias(ids), F.collect_list("x").alias(xs)), block), n


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """The k highest inner products of each query vector with all other vectors, exactly.

    vectors: (vec_id, x) as of integer_vectors. Vectors lie in shards of about SHARD_ROWS, queries in blocks of
    about QUERY_ROWS; each shard meets each block of queries once, MaxScore keeps k rows for each query and
    shard, and the shards' lists are merged. Returns query_id, rank (from 1), vec_id, score; ties go to
    the smaller vec_id; fewer than k rows if there are fewer candidates. Rows with a query's id are not its
    candidates; a vec_id that comes twice is searched twice as a candidate and as a query only by its distinct vectors. Vectors that
    are null, or hold nulls or non-finite components, take no part; shorter ones count as filled with zeros;
    scores beyond a long stop at its ends; an empty table gives no rows; other columns are not read.
    """
    vectors = stored(vectors, "vectors")
    shards, n = _blocks(vectors, SHARD_ROWS, "ids", "xs", "shard")
    blocks, _ = _blocks(vectors.where(is_query).distinct(), QUERY_ROWS, "query_ids", "queries", "block")
    # each block of queries goes to each shard: an equi-join of rows that are whole blocks, in which vectors move once
    sent = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
    met = sent.join(shards.hint("shuffle_hash"), "shard").select("ids", "xs", "query_ids", "queries")
    found = stored(met.mapInArrow(_search(k), "query_id long, vec_id long, score long"), "shard-lists")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_maxscore(spark, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, F.col("vec_id") % 50 == 0, 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), parts AS (
  SELECT vec_id, unnest(x) AS c, generate_subscripts(x, 1) AS d FROM v
), scores AS (
  SELECT q.vec_id AS query_id, p.vec_id AS vec_id, CAST(sum(q.c * p.c) AS BIGINT) AS score
  FROM parts q JOIN parts p ON q.d = p.d AND q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
