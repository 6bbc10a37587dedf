"""Every query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

import attesta.table_queries  # noqa: F401  registers its queries
from attesta.bindings import TABLES
from attesta.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    return con


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    return repr(float(x)) if hasattr(x, "__float__") and not isinstance(x, str) else str(x)


def rows(df):
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    found = QUERIES[name](spark, DIR).toPandas()
    assert len(found) > 0 or name == "official_gallery"
    keys = [c for c in ("query_key", "ord", "entity") if c in found.columns]
    assert not keys or not found.duplicated(keys).any()


def test_dedup_results_is_the_sequential_loop(spark):
    from attesta.bindings import view

    want, urls, signs = set(), {}, {}
    for r in sorted(view(spark, DIR, "v_results").collect(), key=lambda r: r.ord):
        title = (r.title or "").strip(" \t\n\r\x0b\x0c\u3000\xa0").lower()[:80]
        sign = (r.url.split("/")[2].lower(), title) if title else ("#", r.ord)
        if r.url not in urls.setdefault(r.query_key, set()) and sign not in signs.setdefault(r.query_key, set()):
            want.add((r.query_key, r.ord))
            urls[r.query_key].add(r.url)
            signs[r.query_key].add(sign)
    assert {(r.query_key, r.ord) for r in QUERIES["dedup_results"](spark, DIR).collect()} == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
