"""Language-model scoring: corpus counts, a recurrent model trained over shards, whole-document likelihoods."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import gru
from attesta.llm.common import stored
from attesta.llm.toxicity import fold_of

#: Words whose counts tasks hold, at most; words of others are looked up by a join. Distinct words of a task's partial counts.
HEAD_WORDS, PARTIAL_WORDS = 100_000, 200_000
#: Tokens of one shard of training, about; documents that are scored at once.
SHARD_TOKENS, SCORED_AT_ONCE = 1_000_000, 10_000
#: The end of a text is the word that no text holds; its id is 0.
END_WORD = b""


def tokens(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space; the end is not among them."""
    return (text or "").encode("utf-8", "replace").lower().split()


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out():
        rows = pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], ["token", "n"])
        found.clear()
        return rows

    found: Counter[bytes] = Counter()
    for batch in batches:
        for text in batch.column("text"):
            found.update(tokens(text.as_py()))
            found[b""] += 1
            if len(found) > PARTIAL_WORDS:
                yield out()
    yield out()


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over all whole texts, an end for each; stored."""
    partial = docs.select("text").mapInArrow(_counter, "token string, n long")
    return stored(partial.groupBy("token").agg(F.sum("n").alias("n")), "token-counts")


def _head(counts: DataFrame) -> dict[bytes, int]:
    """The most frequent words, at most HEAD_WORDS: all with a count over some number."""
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    total, least = 0, None
    for r in by_count.limit(HEAD_WORDS).toLocalIterator():
        total += r.words
        if total > HEAD_WORDS:
            break
        least = r.n
    if least is None:
        return {}
    rows = sorted(counts.where(F.col("n") >= least).toLocalIterator(), key=lambda r: (-r.n, r.token))
    return {r.token.encode(): r.n for r in rows}  # frequent words lie side by side in a task's memory


class Vocabulary:
    """Ids of the recurrent model and counts of words. Held are the words of the model and of head; any other has its open class alone,
    so that a task's memory doesn't grow with its words and none of them is learnt anew."""

    def __init__(self, words: list[bytes], head: dict[bytes, int]):
        held = list(dict.fromkeys([*words, *head]))
        self.slots = {w: k for k, w in enumerate(held)}
        opened = [gru.WORDS + b for b in gru.buckets_of(held[len(words) :])]
        self.model_ids = np.array([*range(len(words)), *opened], dtype=np.int32)
        counts = np.array([*(head.get(w, 0) for w in held), 0])  # the last one is for words that are not held, which are looked up later
        self.counted, self.logs = counts > 0, np.log10(counts + 1.0)

    def sequence(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Slots (-1: not held) and model ids of the words of a text, and those of its words that are not held."""
        slots = np.fromiter(map(self.slots.get, found, repeat(-1)), dtype=np.int64, count=len(found))
        ids, places = self.model_ids[slots], np.flatnonzero(slots < 0)
        others = [found[i] for i in places.tolist()]
        ids[places] = gru.WORDS + np.array(gru.buckets_of(others), dtype=np.int32)
        return slots, ids, others


def _train(model: gru.Gru, words: list[bytes], passes: int):
    def run(group: pa.Table) -> pa.Table:
        vocabulary = Vocabulary(words, {})
        order = np.argsort(group.column("luck").to_numpy(), kind="stable")
        texts, end = group.column("text"), np.zeros(1, dtype=np.int32)
        pieces = [end]
        for i in order.tolist():
            pieces += [vocabulary.sequence(tokens(texts[i].as_py()))[1], end]
        stream = np.concatenate(pieces)
        trained = gru.train(model, stream, passes)
        return pa.table({"n": pa.array([len(stream)], pa.int64()), "weights": pa.array([trained.flat().astype(float)], pa.list_(pa.float64()))})

    return run


def train_model(docs: DataFrame, words: list[bytes], class_counts: np.ndarray, total: int, rounds: int = 2) -> gru.Gru:
    """Train on shards of all docs and average the shards' weights, by their tokens, after each round.

    The first round is one shard alone, so that the others start from one place; each further round is all shards.
    Shards are dealt by hash and about SHARD_TOKENS long, whatever the corpus; only averages reach the driver.
    """
    model = gru.Gru.start(class_counts)
    shards = max(1, math.ceil(total / SHARD_TOKENS))
    luck = F.xxhash64("doc_id", F.lit(3))
    drawn = docs.select("doc_id", "text", luck.alias("luck"))
    drawn = stored(drawn.select("text", "luck", F.pmod("luck", F.lit(shards)).alias("shard")), "training-texts")
    for r in range(rounds):
        part = drawn.where("shard = 0") if r == 0 else drawn
        trained = part.groupBy("shard").applyInArrow(_train(model, words, 2 if r == 0 else 1), "n long, weights array<double>")
        each = stored(trained, f"weights{r}").select("n", F.posexplode("weights").alias("at", "v"))
        mean = each.groupBy("at").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")).toPandas()
        if len(mean):
            values = np.zeros(len(mean))
            values[mean["at"].to_numpy()] = mean["v"].to_numpy()
            model = model.with_flat(values)
    return model


def _score(model: gru.Gru, words: list[bytes], head: dict[bytes, int], open_logs: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words, head)
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_AT_ONCE):
                yield part(vocabulary, batch.slice(at, SCORED_AT_ONCE))

    def part(vocabulary: Vocabulary, batch: pa.RecordBatch) -> pa.RecordBatch:
        ends = head.get(END_WORD, 0)
        sequences, n, known, logs, fixed = [], [], [], [], []
        offsets, rare, times = [0], [], []  # the words that are looked up, by document
        for text in batch.column("text"):
            found = tokens(text.as_py())
            slots, ids, others = vocabulary.sequence(found)
            sequences.append(np.append(ids, np.int32(0)))
            logs_of, opened = vocabulary.logs[slots], ids >= gru.WORDS
            n.append(len(found) + 1)
            known.append(int(np.count_nonzero(vocabulary.counted[slots])) + int(ends > 0))
            logs.append(float(logs_of.sum()) + math.log10(ends + 1))
            # an open word has (count + 1) of its class's share; what counts are looked up comes later
            fixed.append(float(logs_of[opened].sum() - open_logs[ids[opened] - gru.WORDS].sum()))
            often = Counter(others)
            rare += [w.decode("utf-8", "replace") for w in often]
            times += often.values()
            offsets.append(len(rare))
        scores = gru.score_sequences(model, sequences) / math.log(10) + np.array(fixed)
        looked_up = pa.StructArray.from_arrays([pa.array(rare, pa.string()), pa.array(times, pa.int64())], ["token", "times"])
        rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), looked_up)
        columns = [batch.column("uid"), batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()), pa.array(scores, pa.float64()), rest]
        return pa.RecordBatch.from_arrays(columns, ["uid", "doc_id", "n_tokens", "known", "logs", "model", "rest"])

    return run


def score_documents(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Score whole texts of docs (doc_id, text) with what training (same columns) holds.

    Returns a row for each row of docs: doc_id, n_tokens (words and the end), n_known (tokens that training
    holds), train_tokens, base_score (unigrams with one added) and score (log10 probability of the text by the recurrent model,
    words outside its vocabulary by their counts in an open class). Counts cover all of training; those of words
    outside the HEAD_WORDS most frequent ones are joined, not held.
    Null and empty texts are their end alone; equal rows have equal scores; null doc_ids stay; without training
    rows all counts are 0; an empty table gives no rows; other columns are not read.
    """
    counts = token_counts(training)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = _head(counts)
    frequent = sorted((w for w in head if w), key=lambda w: (-head[w], w))[: gru.WORDS - 1]
    words = [b"", *frequent]
    listed = counts.sparkSession.createDataFrame([(w.decode(),) for w in words], "token string")
    outside = counts.join(F.broadcast(listed), "token", "left_anti")  # at most WORDS rows are broadcast
    bucket = (F.crc32(F.substring(F.col("token").cast("binary"), 1, 2)) % gru.BUCKETS).alias("bucket")
    open_n, open_v = np.zeros(gru.BUCKETS), np.zeros(gru.BUCKETS)
    for r in outside.groupBy(bucket).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        open_n[r.bucket], open_v[r.bucket] = r.n, r.v
    class_counts = np.zeros(gru.INPUTS)
    class_counts[: len(words)] = [head.get(w, 0) for w in words]
    class_counts[gru.WORDS :] = open_n
    model = train_model(training, words, class_counts, int(total))

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    schema = "uid long, doc_id long, n_tokens long, known long, logs double, model double, rest array<struct<token:string,times:long>>"
    scored = stored(rows.mapInArrow(_score(model, words, head, np.log10(open_n + open_v + 1)), schema), "lm-scores")
    rest = scored.select("uid", F.explode("rest").alias("r")).select("uid", "r.token", "r.times")
    found = rest.join(counts.hint("merge"), "token", "left").select("uid", F.col("times"), F.coalesce("n", F.lit(0)).alias("n"))
    sums = found.groupBy("uid").agg(F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"))
    sums = stored(sums, "looked-up")
    out = scored.drop("rest").join(sums.hint("merge"), "uid", "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("model") + F.coalesce("more_logs", F.lit(0.0))).alias("score"),
    )


def op7_recurrent_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = fold_of(F.col("doc_id"), 7) == 2
    scored = score_documents(docs, docs.where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
