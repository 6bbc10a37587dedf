"""Document fingerprints by consistent weighted sampling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import BLANKS, numbered, stored

#: Samples of a fingerprint; the standard error of a likeness is at most 1 / (2 * sqrt(SAMPLES)).
SAMPLES = 32

_NO_ID = -(1 << 63)


def terms_of(text: Column) -> Column:
    """Words in lower case, repeats included; a text without words has one empty term."""
    words = F.filter(F.split(F.lower(text), rf"[{BLANKS}]+"), lambda w: w != "")
    return F.when(F.size(words) == 0, F.array(F.lit(""))).otherwise(words)


def _uniform(bits: Column, shift: int, width: int) -> Column:
    """In (0, 1), from `width` bits of a hash."""
    mask = F.lit((1 << width) - 1)
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(mask).cast("double") + F.lit(0.5)) / F.lit(float(1 << width))


def weighted_sample(term: Column, log_weight: Column, j: int) -> Column:
    """A long whose minimum over a document's terms is its j-th sample.

    r and c are Gamma(2, 1) and b uniform, all hashes of (term, j). t = floor(ln w / r + b) makes the term's
    quantised weight y = exp(r * (t - b)), and the term with the least a = c / (y * exp(r)) is drawn: two
    documents draw the same (term, t) with probability the generalised Jaccard similarity of their weights.
    The high bits are ln a, in steps of 2**-32, the low bits tell (term, t).
    """
    h1, h2 = F.xxhash64(term, F.lit(2 * j)), F.xxhash64(term, F.lit(2 * j + 1))
    r = -F.log(_uniform(h1, 43, 21) * _uniform(h1, 22, 21))
    b = _uniform(h1, 0, 22)
    log_c = F.log(-F.log(_uniform(h2, 32, 32) * _uniform(h2, 0, 32)))
    t = F.floor(log_weight / r + b)
    log_a = log_c - r * (t - b) - r
    high = F.shiftleft(((log_a + F.lit(128.0)) * F.lit(float(1 << 31))).cast("long"), 24)
    return high + h2.bitwiseXOR(t).bitwiseAND(F.lit((1 << 24) - 1))


def signatures(terms: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(keys, a_term, signature): one of the terms, and the signature, an array<long>, of each key.

    terms: (keys, term), a row for each occurrence, term a long hash. If the rows of a key are in one
    partition already, neither aggregation shuffles.
    """
    counted = terms.groupBy(*keys, "term").agg(F.count("*").alias("n"))
    counted = counted.select(*keys, "term", F.log(F.col("n").cast("double")).alias("log_n"))
    drawn = counted.groupBy(*keys).agg(F.max("term").alias("a_term"), *(F.min(weighted_sample(F.col("term"), F.col("log_n"), j)).alias(f"s{j}") for j in range(samples)))
    return drawn.select(*keys, "a_term", F.array(*(f"s{j}" for j in range(samples))).alias("signature"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples: the estimate of the generalised Jaccard similarity."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def as_string(signature: Column) -> Column:
    """Eight hex digits for each sample."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(F.xxhash64(x).bitwiseAND(F.lit((1 << 32) - 1))), 8, "0"))), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by keys without nulls: the id, and a hash of text and missing id that tells rows of one id apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text, F.col("doc_id").isNull()).alias("mark"), F.col("doc_id").isNull().alias("no_id"), text.alias("text"))


def fingerprint_with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprint each whole text and its edited text: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many (or all) of the
    next document's, in descending order of doc_id (null last, equal ids by a hash of their texts); the first follows the
    last. Terms are lower-cased words weighted by how often they occur. A null text is empty; texts without words are alike (1.0)
    and like no other. Rows equal in doc_id and text are one document, whose result comes once for each of them. Very long texts are taken whole. A document alone is
    its own next. An empty table gives no rows; other columns are not read.
    """
    keyed = _keyed(docs)
    ids = keyed.groupBy("id", "no_id", "mark").agg(F.max(F.char_length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    ids = stored(numbered(ids, [F.col("no_id"), F.col("id").desc(), F.col("mark")], "place"), "places")
    n = ids.count()
    after = ids.select(F.pmod(F.col("place") - 1, F.lit(max(1, n))).alias("place"), F.col("id").alias("next_id"), F.col("mark").alias("next_mark"))
    order = stored(ids.join(after.hint("merge"), "place"), "order")  # each document with its next

    # texts are shuffled once, by key; the donated parts go to the documents before them
    window = Window.partitionBy("id", "mark").orderBy("no_id")
    texts = keyed.withColumn("_copy", F.row_number().over(window)).where("_copy = 1").drop("_copy", "no_id")
    gives = order.select(F.col("next_id").alias("id"), F.col("next_mark").alias("mark"), F.col("id").alias("to_id"), F.col("mark").alias("to_mark"), F.floor(F.col("n_chars") / 2).cast("int").alias("chars"), "n_chars")
    donated = texts.join(gives.hint("merge"), ["id", "mark"])
    donated = donated.select(F.col("to_id").alias("id"), F.col("to_mark").alias("mark"), F.expr("substring(text, 1, chars)").alias("donor"), "chars", "n_chars")
    both = texts.join(donated.hint("merge"), ["id", "mark"])
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars as int) - chars)"), F.col("donor"))
    both = both.withColumn("edited", edited).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))

    # version 0 is the text, 1 the edited one; 2 to 5 carry the digest through the aggregations as four longs,
    # so that their keys are longs alone and many fit in memory
    digest = [F.struct(F.lit(2 + i).alias("version"), F.substring("edited_sha256", 16 * i + 1, 16).alias("text")) for i in range(4)]
    versions = F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("text")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("text")), *digest)
    keys = ["id", "mark", "version"]
    rows = both.select("id", "mark", F.explode(versions).alias("v")).select("id", "mark", "v.version", F.explode(terms_of(F.col("v.text"))).alias("word"))
    term = F.when(F.col("version") < 2, F.xxhash64("word")).otherwise(F.conv("word", 16, -10).cast("long"))
    signed = signatures(rows.select(*keys, term.alias("term")), keys, samples)
    of = lambda v, c: F.max(F.when(F.col("version") == v, F.col(c)))
    pieces = F.concat(*(F.lpad(F.lower(F.hex(of(2 + i, "a_term"))), 16, "0") for i in range(4)))
    signed = signed.groupBy("id", "mark").agg(of(0, "signature").alias("signature"), of(1, "signature").alias("edited_signature"), pieces.alias("edited_sha256"))
    signed = stored(signed, "signatures")

    following = signed.select(F.col("id").alias("next_id"), F.col("mark").alias("next_mark"), F.col("signature").alias("next_signature"))
    out = signed.join(order.select("id", "mark", "no_id", "n_chars", "copies", "next_id", "next_mark").hint("merge"), ["id", "mark"]).join(following.hint("merge"), ["next_id", "next_mark"])
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_string(F.col("signature")).alias("fingerprint"),
        as_string(F.col("edited_signature")).alias("edited_fingerprint"),
        likeness(F.col("signature"), F.col("edited_signature")).alias("near_edited"),
        likeness(F.col("signature"), F.col("next_signature")).alias("near_next"),
    )


def op3_weighted_sampling(spark, sf_dir: str) -> DataFrame:
    return fingerprint_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
