"""The search and analysis plans: many queries at once, each by its own terms, and the rules for single results."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import classify as C
from attesta.operators import dedup, joins, metrics, rank, tables
from attesta.plans import analysis, search

HOSTS = ["news.example", "www.ptt.cc", "shop.gov.tw", "blog.example", "www.dcard.tw", "newebpay.com"]


@pytest.fixture(scope="module")
def results(spark):
    draw = random.Random(3)
    rows = []
    for q, name in enumerate(("alpha", "beta", "gamma")):
        for i in range(40):
            words = [draw.choice(["alpha", "beta", "gamma", "評價", "公告", "募資", "note", "story", "2018", "質疑"]) for _ in range(8)]
            rows.append((q, i, f"https://{draw.choice(HOSTS)}/p/{draw.randrange(30)}", f"{draw.choice(['alpha', 'beta', 'gamma'])} {i % 7}", " ".join(words) + " and more of it", "src", name, [name], ["評價"] if q else ["募資"], q == 0))
    return spark.createDataFrame(rows, "query_key int, ord int, url string, title string, content string, source string, name string, names array<string>, asked array<string>, heated boolean")


def test_many_queries_are_ranked_as_each_alone(results):
    """A table of three entities ranks like three runs of one entity."""
    own = search.SearchTerms(entity=F.col("names"), relaxed=F.col("names"), question=F.col("asked"))
    columns = ["query_key", "ord", "source_type", "bucket", "s1", "s2", "s3", "rank", "place"]
    together = {tuple(r) for r in search.finalize_results(results, own, 20, F.col("heated")).select(columns).collect()}
    alone = set()
    for q, (name, asked) in enumerate((("alpha", "募資"), ("beta", "評價"), ("gamma", "評價"))):
        terms = search.SearchTerms(entity=(name,), relaxed=(name,), question=(asked,))
        alone |= {tuple(r) for r in search.finalize_results(results.where(F.col("query_key") == q), terms, 20, q == 0).select(columns).collect()}
    assert together == alone and len({r[0] for r in together}) == 3
    funnel = {r.query_key: r for r in search.search_funnel(results, own).collect()}
    assert all(r.raw == 40 and r.final <= r.deduplicated for r in funnel.values())


def test_deduplication_is_the_sequential_loop(results):
    want = set()
    for q in range(3):
        urls, signs = set(), set()
        for r in sorted(results.where(F.col("query_key") == q).collect(), key=lambda r: r.ord):
            sign = (r.url.split("/")[2].lower(), r.title.strip().lower()[:80])
            if r.url not in urls and sign not in signs:
                want.add((q, r.ord))
                urls.add(r.url)
                signs.add(sign)
    assert {(r.query_key, r.ord) for r in dedup.dedup_results(results).collect()} == want


def test_low_signal_markers(spark):
    rows = [("https://a.example/1", "t", "please create ad here"), ("https://www.youtube.com/watch", "t", "skip navigation"), ("https://a.example/2", "userSpaceOnUse", "x"), ("https://a.example/3", "t", "a clean text of some length"), ("", "t", "x")]
    df = search.with_hay(spark.createDataFrame(rows, "url string, title string, content string"))
    assert [r.low for r in df.select(search.low_signal(search.SearchTerms()).alias("low")).collect()] == [True, True, True, False, True]


def test_content_falls_back_to_the_snippet(spark):
    df = spark.createDataFrame([(1, 0, "https://a.example/1", "t", "", "alpha 評價 text", "s", "other")], "query_key int, ord int, url string, title string, content string, snippet string, source string, source_type string")
    row = search.rank_results(df, search.SearchTerms(entity=("alpha",))).first()
    assert row.s1 == 12 + 1 and row.s3 == len("alpha 評價 text")


def test_own_pages_are_official_if_they_name_the_entity(spark):
    df = spark.createDataFrame([("https://donate.newebpay.com/x", "Alpha page"), ("https://donate.newebpay.com/y", "other")], "url string, title string")
    kind = C.source_type_by_host(F.col("url"), F.lit("s"), F.lit(None).cast("string"), F.col("title"), ("alpha",))
    assert [r.k for r in df.select(kind.alias("k")).collect()] == ["official", "other"]


def test_fallback_cards_are_diversified_to_ten(spark):
    rows = [(0, i, 30 - i, 1, 1, False, f"u{i}", "facebook" if i < 15 else f"p{i}", "general") for i in range(25)]
    df = spark.createDataFrame(rows, "query_key int, ord int, relevance int, credibility int, first_hand int, noise boolean, url string, platform string, claim_type string")
    out = rank.diversify_cards(rank.rank_cards(df, 100), 100).orderBy("place").collect()
    assert len(out) == 10 and [r.platform for r in out[:2]] == ["facebook"] * 2 and sum(r.platform == "facebook" for r in out) < 10


def test_summary_texts(spark):
    rows = [(1, 1, "a good long title", "s", "supporting", "strong", 80, 80, "forum"), (1, 2, "a good long title", "s", "supporting", "strong", 80, 80, "forum"), (1, 3, "x", "site", "neutral", "weak", 50, 20, "news")]
    cards = spark.createDataFrame(rows, "query_key int, rank int, title string, source string, stance string, strength string, relevance int, first_hand int, source_type string")
    row = analysis.balanced_summary(cards, question=F.lit("Q")).first()
    assert row.verdict == "mostly_supported" and "「Q」" in row.verdict_text
    assert row.supporting_points == ["a good long title(第一手描述)"] and row.uncertain_points == ["site 來源整理(新聞轉述)"]
    assert row.opposing_points == [analysis.NO_POINTS[False]["opposing"]] and len(row.follow_up) == 3
    focused = analysis.balanced_summary(cards, question=F.lit("Q"), focus=True).first()
    assert focused.verdict_text != row.verdict_text and focused.follow_up != row.follow_up


def test_joins_do_not_double_rows(spark):
    results = spark.createDataFrame([(1, "u", ""), (2, "w", "t")], "ord int, url string, title string")
    sources = spark.createDataFrame([(" u", "a"), ("u", "b"), ("", "c")], "url string, title string")
    assert {(r.ord, r.title) for r in joins.hydrate(results, sources, ["title"]).collect()} == {(1, "b"), (2, "t")}
    found = spark.createDataFrame([(1, "u", "t", "s", "c")], "ord int, url string, title string, snippet string, content string")
    crawled = spark.createDataFrame([("u", "title one", "x" * 30), ("u", "title two", "x" * 40)], "url string, title string, content string")
    assert [(r.title, len(r.content), r.enriched) for r in joins.merge_enrichment(found, crawled).collect()] == [("title two", 40, True)]


def test_keywords_and_due_entities(spark):
    entities = spark.createDataFrame([(1, "Alpha", ["bad"]), (2, "Beta", [])], "entity_id long, name string, aliases array<string>")
    keywords = spark.createDataFrame([(1, "al", "seed", 90, True), (1, "bad", "alias", 70, True), (2, "bad", "alias", 70, True)], "entity_id long, keyword string, keyword_type string, weight int, is_active boolean")
    assert {(r.entity_id, r.keyword) for r in tables.prune_keywords(entities, keywords, ["bad"]).collect()} == {(1, "al"), (2, "bad")}
    new, synced = tables.expand_keywords(entities, keywords, F.array("name", F.lower("name"), F.lit("al")))
    assert {(r.entity_id, r.keyword, r.weight) for r in new.collect() if r.weight == 70 and r.keyword != "bad"} == {(1, "alpha", 70), (2, "beta", 70), (2, "al", 70)}
    assert {r.entity_id: r.aliases for r in synced.collect()} == {1: ["al", "alpha", "bad"], 2: ["al", "beta"]}
    watch = spark.sql("SELECT * FROM VALUES (1L, 'b', 'zoo', true, 1, NULL), (2L, 'a', 'shop', true, 2, TIMESTAMP_NTZ '2020-01-01'), (3L, 'c', 'zoo', true, 1, TIMESTAMP_NTZ '2999-01-01'), (4L, 'd', 'zoo', false, 1, NULL) AS t(entity_id, name, entity_type, is_active, priority, next_crawl_at)")
    assert [r.entity_id for r in joins.due_entities(watch, "2024-01-01", ["zoo"], 5).collect()] == [1]
    only = spark.createDataFrame([(2,), (2,), (3,)], "entity_id long")
    assert [r.entity_id for r in joins.due_entities(watch, "2024-01-01", ["zoo"], 5, only).collect()] == [2]


def test_profile_counts_without_expansion(spark):
    queries = spark.createDataFrame([(1, 1, 10), (1, 2, 50), (2, 3, None)], "entity_id int, query_id int, confidence int")
    cards = spark.createDataFrame([(1, 7, 20), (1, 7, 40), (1, 8, None)], "query_id int, source_id int, credibility int")
    out = {r.entity_id: tuple(r)[1:] for r in metrics.entity_profile(queries, cards).collect()}
    assert out == {1: (2, 2, 20, 30), 2: (1, 0, 0, 0)}


def test_domain_in_focus_is_strict(spark):
    rows = [(1, 0, "https://a.example/1", "alpha 動物福利 救援", "alpha 動物福利 收容 救援 and more text", "s"), (1, 1, "https://b.example/2", "alpha 評價 of it", "alpha 評價 and some more text here", "s"), (1, 2, "https://c.example/3", "alpha 與動物無關", "alpha 動物 收容 與動物無關 text", "s"), (2, 3, "https://d.example/4", "beta page title", "beta 評價 and more of the text", "s")]
    df = spark.createDataFrame([(*r, r[0] == 1, ["alpha"]) for r in rows], "query_key int, ord int, url string, title string, content string, source string, strict boolean, names array<string>")
    terms = search.SearchTerms(entity=F.col("names"), relaxed=F.col("names"))
    out = search.finalize_results(df, terms, 10, focus=F.col("strict")).collect()
    assert {(r.query_key, r.ord) for r in out} == {(1, 0), (2, 3)}
    none = search.finalize_results(df.where("ord = 1"), terms, 10, focus=True)
    assert none.count() == 0 and search.finalize_results(df.where("ord = 1"), terms, 10).count() == 1
