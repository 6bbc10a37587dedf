"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posteriors."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import lookup_join, stored

#: Common English insults, the seed lexicon.
SEED_WORDS = frozenset(
    """
    idiot idiots moron morons stupid dumb imbecile fool clown trash garbage scum filth vermin pathetic worthless
    useless disgusting loser losers hate ugly shut kill die jerk bastard bitch shit crap damn hell
    """.split()
)

#: Toxic documents that a mined term is in, at least, as a number and as a share; how much oftener it is in toxic ones. The share
#: bounds the number of terms, whatever the corpus: documents hold few hundred terms each.
MIN_DOCS, MIN_SHARE, MIN_LIFT = 5, 0.001, 8.0
#: Lexicons that the mined terms are dealt to, by their first letters.
LEXICONS = 8
#: Labelled rows that the classifier is fitted on, about (drawn by a hash of doc_id).
FIT_ROWS = 20_000
#: Texts of a batch that are strings at once.
TEXTS_AT_ONCE = 256
#: Rows of a batch of whole documents that goes to a worker.
WORKER_ROWS = 1000
#: Rows of labels that a join may broadcast (two small values each).
LABEL_ROWS = 1_000_000
#: How often a label is taken to be wrong, at least.
LABEL_NOISE = 0.02
#: Rounds in which the label model may choose other dependences of voters.
SETTLED = 10
THRESHOLD = 0.7
#: Words that a Python worker remembers.
MEMO_WORDS = 150_000

_LETTERS = re.compile(r"[^\W\d_]+")
_PREFIXES = (4, 6)
_ADDRESSED = re.compile(r"\b(?:you|your|he|she|they)\b\W+(?:\w+\W+){0,3}?(?:" + "|".join(sorted(SEED_WORDS)) + r")\b")
_MASKED = re.compile(r"\b[a-z]+[*@#$!]{1,4}[a-z]+\b")
_SHOUTED = re.compile(r"!{3,}")

VOTERS = [*(f"lexicon{k}" for k in range(LEXICONS)), "several", "dense", "seed", "addressed", "masked_or_shouted"]


def terms_of(word: str) -> list[str]:
    """A word counts as itself and as its beginnings, which are marked."""
    return [word, *(word[:n] + "~" for n in _PREFIXES if len(word) >= n)]


def _term_column() -> Column:
    """The distinct terms of a text, natively: what terms_of makes of its words."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), 0))  # what _LETTERS finds
    made = F.transform(words, lambda w: F.array(w, *(F.when(F.length(w) >= n, F.concat(F.substring(w, 1, n), F.lit("~"))) for n in _PREFIXES)))
    return F.array_distinct(F.filter(F.flatten(made), lambda t: t.isNotNull()))


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def mined_terms(labelled: DataFrame) -> list[str]:
    """Terms far more frequent in toxic than in clean documents of (text, toxic), sorted."""
    sums = labelled.agg(F.sum("toxic"), F.count("*")).first()
    toxic, clean = float(sums[0] or 0), float(sums[1] - (sums[0] or 0))
    rows = labelled.select("toxic", F.explode(_term_column()).alias("term")).groupBy("term").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    lift = (F.col("t") + 0.5) / (toxic + 1.0) / ((F.col("n") - F.col("t") + 0.5) / (clean + 1.0))
    kept = rows.where(F.col("t") >= max(MIN_DOCS, MIN_SHARE * toxic)).where(lift >= MIN_LIFT)
    return sorted(r.term for r in kept.select("term").collect())


def _seeded(texts: DataFrame) -> DataFrame:
    """(text, toxic) by the seed lexicon alone."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{Nl}\p{No}]+"), 0)
    return texts.select("text", F.arrays_overlap(words, F.array(*map(F.lit, sorted(SEED_WORDS)))).cast("int").alias("toxic"))


class Featurizer:
    """The classifier's features of a text, which are the places of its mined terms and, after those, of the voters that fire; and the
    voters' pattern, a bit for each."""

    def __init__(self, terms: list[str]):
        self.place = {t: i for i, t in enumerate(terms)}
        self.lexicon = [zlib.crc32(t[:4].encode()) % LEXICONS for t in terms]
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> tuple[list[int], int]:
        low = text.lower()
        words = set(_LETTERS.findall(low))
        found: set[int] = set()
        hits, memo = 0, self.memo
        for w in words:
            places = memo.get(w)
            if places is None:
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                places = memo[w] = tuple(self.place[t] for t in terms_of(w) if t in self.place)
            if places:
                hits += 1
                found.update(places)
        pattern = 0
        for i in found:
            pattern |= 1 << self.lexicon[i]
        seed = not SEED_WORDS.isdisjoint(words)
        flags = (hits >= 3, hits >= 1 and hits >= 0.01 * len(words), seed, seed and bool(_ADDRESSED.search(low)), bool(_SHOUTED.search(low) or _MASKED.search(low)))
        for k, flag in enumerate(flags):
            pattern |= int(flag) << (LEXICONS + k)
        voters = [len(self.lexicon) + k for k in range(len(VOTERS)) if pattern >> k & 1]
        return sorted(found) + voters, pattern


@dataclass
class LabelModel:
    """A joint model of the label and all votes: P(label) times P(voter fires | label, its parent's vote), the parents being a forest."""

    parents: np.ndarray  # of each voter another one, or -1
    tables: np.ndarray  # voters x label x parent's vote
    rates: np.ndarray  # voters x label: P(voter fires | label), its accuracy
    prior: float  # share of toxic documents

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        above = fired[:, self.parents] & (self.parents >= 0)
        told = []
        for label in (0, 1):
            p = np.where(above, self.tables[:, label, 1], self.tables[:, label, 0])
            told.append(np.log(np.where(fired, p, 1 - p)).sum(axis=1))
        odds = np.log(self.prior / (1 - self.prior)) + told[1] - told[0]
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def _dependences(weights: list[np.ndarray], fired: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters given the label, in nats; weights: of each row as label 0 and as label 1."""
    total = sum(w.sum() for w in weights)
    out = np.zeros((fired.shape[1],) * 2)
    votes = {0: ~fired, 1: fired}
    for w in weights:
        if w.sum() <= 0:
            continue
        share = {a: (w @ votes[a]) / w.sum() for a in votes}
        for a in votes:
            for b in votes:
                both = (votes[a] * w[:, None]).T @ votes[b] / w.sum()
                alone = np.outer(share[a], share[b])
                ratio = np.divide(both, alone, out=np.ones_like(both), where=(both > 0) & (alone > 0))
                out += w.sum() / total * both * np.log(ratio)
    return out


def _forest(strength: np.ndarray, least: float) -> np.ndarray:
    """The parents of a spanning forest of greatest strength, without links weaker than `least`."""
    n = len(strength)
    parents, best, of = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1)
    left = set(range(n))
    while left:
        v = max(left, key=lambda i: (best[i], -i))
        left.remove(v)
        parents[v] = of[v] if best[v] >= least else -1
        for i in left:
            if strength[v, i] > best[i]:
                best[i], of[i] = strength[v, i], v
    return parents


def fit_label_model(fired: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 50) -> LabelModel:
    """EM over vote patterns: rows of fired (bool by voter) stand for counts documents; labels are 0, 1, or -1 if unknown.

    Known labels are kept, the others are what the model says. In each round the accuracies of all voters and the correlations of
    those that depend on each other, given the label, are estimated together: the forest of dependences of greatest likelihood (by
    conditional mutual information, of links that pay for their two parameters) and its tables. It stays as it is after SETTLED rounds.
    """
    voters = fired.shape[1]
    known = labels >= 0
    prior = float(np.clip(np.average(labels[known], weights=counts[known]), 0.001, 0.5)) if counts[known].sum() else 0.05
    rates, parents = np.tile([0.02, 0.3], (voters, 1)), np.full(voters, -1)
    model = LabelModel(parents, np.repeat(rates[:, :, None], 2, axis=2), rates, prior)
    for k in range(rounds):
        p = np.where(known, labels, model.posterior(fired))
        weights = [counts * (1 - p), counts * p]
        if k < SETTLED:
            total = max(2.0, counts.sum())
            parents = _forest(_dependences(weights, fired), np.log(total) / total)
        rates = np.stack([(w @ fired + 0.5) / (w.sum() + 1.0) for w in weights], axis=1)
        above = fired[:, parents] & (parents >= 0)
        tables = np.empty((voters, 2, 2))
        for label, w in enumerate(weights):
            for vote, there in enumerate((~above, above)):
                there = there * w[:, None]
                tables[:, label, vote] = ((there * fired).sum(axis=0) + rates[:, label]) / (there.sum(axis=0) + 1.0)
        new = LabelModel(parents, tables, rates, float(np.clip(weights[1].sum() / max(1.0, counts.sum()), 0.001, 0.5)))
        done = np.abs(new.rates - model.rates).max() < 1e-6 and k >= SETTLED
        model = new
        if done:
            break
    return model


@dataclass
class ToxicityModel:
    terms: list[str]
    coefficients: np.ndarray
    intercept: float
    label_model: LabelModel

    def score(self, places: list[int]) -> float:
        odds = self.intercept + float(self.coefficients[places].sum()) if places else self.intercept
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_linear(features: list[list[int]], target: np.ndarray, terms: int, rounds: int = 1500, rate: float = 0.5, ridge: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression of soft targets on which terms there are, by full-batch gradient steps (Adagrad)."""
    lengths = np.array([len(f) for f in features], dtype=np.int64)
    rows, columns = np.repeat(np.arange(len(features)), lengths), np.array([i for f in features for i in f], dtype=np.int64)
    w, b, gw, gb = np.zeros(terms), 0.0, np.full(terms, 1e-8), 1e-8
    n = max(1, len(features))
    for _ in range(rounds):
        odds = b + np.bincount(rows, weights=w[columns], minlength=n)[: len(features)]
        error = 1 / (1 + np.exp(-np.clip(odds, -40, 40))) - target
        dw = np.bincount(columns, weights=error[rows], minlength=terms) / n + ridge * w
        db = error.mean() if len(features) else 0.0
        gw, gb = gw + dw * dw, gb + db * db
        w, b = w - rate * dw / np.sqrt(gw), b - rate * db / np.sqrt(gb)
    return w, float(b)


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    """The texts of a batch, of which TEXTS_AT_ONCE are strings at a time: what a worker once took it keeps."""
    for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
        for text in batch.column("text").slice(at, TEXTS_AT_ONCE).to_pylist():
            yield text or ""
    pa.default_memory_pool().release_unused()


def _featurize(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(terms)
        for batch in batches:
            places, patterns, offsets = array("i"), array("i"), array("i", [0])
            for text in _texts(batch):
                found, pattern = features(text)
                places.extend(found)
                patterns.append(pattern)
                offsets.append(len(places))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(patterns, pa.int32())], ["doc_id", "places", "pattern"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from documents (doc_id, text) and labels (doc_id, toxic): pass only rows that may be learnt from.

    Lexicons are mined from all labelled documents; the label model sees the votes on all documents, as
    counts of their patterns (at most 2 ** voters of them), and the labels there are; the classifier is
    fitted to posteriors, on about FIT_ROWS labelled documents, whose label is one more voter that errs now and then; where there are no
    labels, on as many others, which have the label model's posterior alone. The driver gets terms, pattern counts and those
    rows' features, all of bounded size. Labels without a doc_id or toxic are no labels; of several for one doc_id the highest
    counts. Without labels the lexicons are mined by the seed words. Null texts are empty; an empty table gives a model without terms.
    """
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    labels = stored(labels.groupBy(F.col("doc_id").alias("_labelled")).agg((F.max("toxic") > 0).cast("int").alias("toxic")), "labels")
    texts = docs.select("doc_id", "text")
    marked = lookup_join(texts, labels, F.col("doc_id") == F.col("_labelled"), rows=LABEL_ROWS).select("text", "toxic")
    terms = mined_terms(marked if not labels.isEmpty() else _seeded(texts))
    votes = texts.mapInArrow(_featurize(terms), "doc_id long, places array<int>, pattern int")
    votes = lookup_join(votes, labels, F.col("doc_id") == F.col("_labelled"), "left", rows=LABEL_ROWS)
    votes = stored(votes.select("doc_id", "places", "pattern", F.coalesce("toxic", F.lit(-1)).alias("label")), "votes", WORKER_ROWS)
    patterns = votes.groupBy("pattern", "label").agg(F.count("*").alias("n")).toPandas()
    bits = np.array([[p >> k & 1 for k in range(len(VOTERS))] for p in patterns["pattern"]], dtype=bool).reshape(-1, len(VOTERS))
    model = fit_label_model(bits, patterns["n"].to_numpy(float), patterns["label"].to_numpy(int))

    # rows without an id are drawn by what they say
    luck = F.pmod(F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(17))).otherwise(F.xxhash64("places", F.lit(17))), F.lit(1_000_000))
    labelled = float(patterns.loc[patterns["label"] >= 0, "n"].sum())
    share = min(1.0, FIT_ROWS / max(1.0, labelled or float(patterns["n"].sum())))
    drawn = votes.where("label >= 0") if labelled else votes
    # a hash that very many rows share (copies without an id) can't bring more than twice the bound
    rows = drawn.where(luck < int(share * 1_000_000)).select("places", "pattern", "label").limit(2 * FIT_ROWS).collect()
    known = np.array([r.label for r in rows])
    fired = np.array([[r.pattern >> k & 1 for k in range(len(VOTERS))] for r in rows], dtype=bool).reshape(-1, len(VOTERS))
    target = model.posterior(fired)
    # what the forest leaves of correlations makes posteriors too sure: all voters together count no more than a label
    target = np.where(known >= 0, np.clip(target, LABEL_NOISE, 1 - LABEL_NOISE), np.clip(target, 1e-6, 1 - 1e-6))
    odds = np.log(target / (1 - target)) + np.where(known == 1, 1, np.where(known == 0, -1, 0)) * np.log((1 - LABEL_NOISE) / LABEL_NOISE)
    w, b = fit_linear([list(r.places) for r in rows], 1 / (1 + np.exp(-odds)), len(terms) + len(VOTERS))
    return ToxicityModel(terms, w, b, model)


def _score(model: ToxicityModel, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(model.terms)
        for batch in batches:
            scores = [model.score(features(text)[0]) for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    return run


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in column `name` (which replaces one of that name); all rows and other columns stay.

    Only the text counts. Null and empty texts get the score of a text without any term; an empty table gives no rows.
    """
    docs = docs.drop(name)
    return docs.mapInArrow(_score(model, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op2_weak_supervision(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = fold_of(F.col("doc_id"), 3) == 1
    model = fit(docs.where(~held_out), labels.where(~held_out).select("doc_id", "toxic"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
