import importlib.util

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import search
from attesta.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_max_score_is_exact(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_ROWS", 60)
    monkeypatch.setattr(search, "QUERY_ROWS", 7)
    draw = np.random.default_rng(0)
    vectors = draw.normal(0, 1, (300, 16))
    vectors[40:60] = vectors[39]  # equal scores
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vectors)]
    rows += [(1000, None, 0), (1001, [1.0, None], 0), (1002, [float("nan")] * 16, 0), (1003, [float("inf")] * 16, 0), (1050, [0.5, 0.5], 0), (None, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int").repartition(4)
    got = {}
    for r in search.top_k(search.integer_vectors(df), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {i: np.floor(256 * v).astype(int) for i, v in enumerate(vectors)} | {1050: np.array([128, 128] + [0] * 14)}
    assert set(got) == {i for i in ints if i % 10 == 0}
    for q, found in got.items():
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        assert sorted(found) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)]


def test_huge_components_and_few_vectors(spark):
    rows = [(0, [1e12, -1e12]), (1, [1e12, 1e12]), (2, [-1e12, 1e12])]
    out = search.top_k(search.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id) for r in out] == [1, 2] and out[1].score == -(1 << 63)
    assert search.top_k(search.integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")), F.lit(True)).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, SMALL).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n, columns, ids = docs.count(), docs.columns, {r.doc_id for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        if name != "packing":
            assert out.columns == columns
            docs = corpus_pipeline.stored(out, "test")
            kept = {r.doc_id for r in docs.collect()}
            assert kept <= ids
            if name == "toxicity":
                clean = [i for i, y in labels.items() if y == 0]
                assert len(set(clean) & kept) >= 0.97 * len(clean) and docs.count() < n
            if name == "line_dedup":
                assert kept == ids
            ids = kept
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == ids


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")
def test_one_row_of_each_group_of_copies_stays(spark):
    import corpus_pipeline

    text = {k: " ".join(f"{k}{i}" for i in range(30)) for k in "abcd"}
    rows = [(1, text["a"])] * 3 + [(None, text["a"]), (None, text["b"]), (None, text["b"]), (2, text["c"]), (3, text["c"]), (3, text["d"])]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SMALL)
    assert out.columns == ["doc_id", "text"]
    assert sorted(map(tuple, out.collect()), key=lambda r: r[1]) == [(1, text["a"]), (None, text["b"]), (2, text["c"]), (3, text["d"])]


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline was removed")
def test_stages_take_odd_tables(spark):
    """Nulls, repeated rows, very long and empty texts, clashing columns, and no rows at all, through every stage."""
    import corpus_pipeline

    # names that the operators use within, or might
    clash = "removed n_lines score copies size component_id sequence_id _row _gone _taken _copies _copy _score _toxicity _id _mark _removed _id2 _carried row gone taken copy bits p luck block whole rate place weight h1 line".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash)
    odd = [(1, "one text\nof two lines"), (1, "one text\nof two lines"), (2, None), (None, None), (3, ""), (None, "no id here at all"), (4, "a long text " * 20_000), (5, "x" * 100_000), (6, "ünïcode 中文 text, of one line")]
    docs = spark.createDataFrame([(i, t, None, "s" if k % 2 else None, None, *(f"{c}{i}" for c in clash)) for k, (i, t) in enumerate(odd)], schema).repartition(3)
    for table, n in ((docs, len(odd)), (docs.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, SMALL)
            if name == "packing":
                assert out.where("piece = 0").count() == table.count()
                continue
            assert out.columns == table.columns
            out = corpus_pipeline.stored(out, "odd-test")
            found = [(r.doc_id, r.text) for r in out.collect()]
            assert len(found) <= 3 * n and all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in clash)
            if name in ("toxicity", "line_dedup"):
                assert len(found) == n
            if name == "simhash_near_dedup":
                assert sorted(r[0] or 0 for r in found).count(1) <= 1
            table = out
