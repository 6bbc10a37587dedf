"""Operators on small hand-made cases and against sequential models."""

import random
import time

import pytest
from pyspark.sql import functions as F

from attesta.functions import classify as C
from attesta.functions import names, text
from attesta.operators import dedup, joins, metrics, rank, tables
from attesta.plans import analysis, freshness, search
from attesta.sources import payloads


def test_dedup_keeps_rows_whose_rival_was_dropped(spark):
    rows = [(0, 0, "http://h/u1", "s"), (0, 1, "http://h/u2", "s"), (0, 2, "http://h/u2", "t")]
    out = dedup.dedup_results(spark.createDataFrame(rows, "query_key int, ord int, url string, title string"))
    assert sorted(r.ord for r in out.collect()) == [0, 2]


def sequential_dedup(rows):
    urls, signs, kept = set(), set(), []
    for _, ord_, url, title in sorted(rows):
        sign = (url.split("/")[2], title.strip().lower()[:80])
        if not url or url in urls or sign[1] and sign in signs:
            continue
        urls.add(url)
        signs.add(sign)
        kept.append(ord_)
    return kept


@pytest.mark.parametrize("seed", range(3))
def test_dedup_equals_the_sequential_loop(spark, seed):
    draw = random.Random(seed)
    rows = [(0, i, f"http://h{draw.randrange(3)}/{draw.randrange(12)}", draw.choice(["", "a", "b", "c", "d", "A "])) for i in range(60)]
    out = dedup.dedup_results(spark.createDataFrame(rows, "query_key int, ord int, url string, title string"))
    assert sorted(r.ord for r in out.collect()) == sequential_dedup(rows)


def test_public_credibility_of_one_review(spark):
    reviews = spark.createDataFrame([(1, "e", "supporting", "review")], "review_id long, entity string, stance string, content_type string")
    ratings = spark.createDataFrame([(1, 9, 5)], "review_id long, user_id long, score int")
    assert metrics.public_credibility(reviews, ratings).first().score == 51.2


def test_review_filter(spark):
    rows = [(1, "p", 0.95, "self_post"), (2, "p", 0.9, "review"), (3, "p", None, None)]
    df = spark.createDataFrame(rows, "review_id long, platform string, relevance_score double, content_type string")
    ids = lambda **k: sorted(r.review_id for r in df.where(metrics.review_filter(**k)).collect())
    assert ids() == [2] and ids(include_unanalyzed=True) == [2, 3] and ids(min_relevance=None) == [2] and ids(only_reviews=False) == [1, 2]


def test_snapshot_versions(spark):
    rows = [(1, "m", "v1", 1, 1), (1, "m", "v2", 2, 2), (1, "m", "v1", 3, 3)]
    df = spark.createDataFrame(rows, "entity_id long, search_mode string, body string, created_at long, query_id long")
    out = {r.version: r for r in tables.snapshot_history(df, ["body"]).collect()}
    assert len(out) == 2 and out[1].is_latest and out[1].generated_at == 3 and not out[2].is_latest


def test_upsert_keeps_old_when_new_is_empty(spark):
    old = spark.createDataFrame([("u", "t", "news", "2020", 0)], "url string, title string, source_type string, published_at string, ord long")
    new = spark.createDataFrame([("u", "", "other", None, 1), ("w", "x", "", "2021", 2)], old.schema)
    out = {r.url: r for r in tables.upsert_sources(old, new, ["title", "source_type"], ["published_at"]).collect()}
    assert (out["u"].title, out["u"].source_type, out["u"].published_at) == ("t", "other", "2020")
    # a missing source_type counts as other
    assert out["w"].source_type == "other" and out["w"].published_at == "2021"


def test_credibility_rounds_half_to_even(spark):
    score = C.credibility_score(F.lit("other"), F.lit(36), F.lit(25), F.lit("unknown"), F.lit("low"))
    assert spark.range(1).select(score.alias("s")).first().s == 40


def test_controversial_results_are_diversified(spark):
    rows = [(0, i, f"u{i}", b) for i, b in enumerate(["official"] * 5 + ["fundraising", "news", "forum"], 1)]
    df = spark.createDataFrame(rows, "query_key int, rank int, url string, bucket string")
    out = rank.diversify_results(df, F.lit(True)).orderBy("place").collect()
    first = [r.bucket for r in out[:5]]
    assert len(out) == 8 and first.count("official") <= 2 and "fundraising" in first and "news" in first


def test_cards_keep_two_of_each_platform(spark):
    rows = [(0, i, f"u{i}", p, "general") for i, p in enumerate(["facebook"] * 4 + ["dcard"] * 2 + ["news"] * 2, 1)]
    df = spark.createDataFrame(rows, "query_key int, rank int, url string, platform string, claim_type string")
    kept = [r.platform for r in rank.diversify_cards(df, 6).collect()]
    assert sorted(kept) == ["dcard"] * 2 + ["facebook"] * 2 + ["news"] * 2


def test_low_relevance_cards_are_a_fallback(spark):
    rows = [(q, i, rel, 1, 1, False) for q, rels in ((0, [50, 30]), (1, [30, 20])) for i, rel in enumerate(rels)]
    df = spark.createDataFrame(rows, "query_key int, ord int, relevance int, credibility int, first_hand int, noise boolean")
    kept = sorted((r.query_key, r.relevance) for r in rank.rank_cards(df).collect())
    assert kept == [(0, 50), (1, 20), (1, 30)]


def test_clean_content(spark):
    raw = "<div>協會說明已經改善收容環境，並且公開稽查結果。</div><svg fill='x'>a</svg> data:image/png;base64,AAAA"
    df = spark.createDataFrame([(raw,), (None,), ("",), ("short",)], "t string")
    out = [r.c for r in df.select(text.clean_content(F.col("t")).alias("c")).collect()]
    assert out == ["協會說明已經改善收容環境,並且公開稽查結果。", None, "", ""]  # NFKC makes the comma narrow


def test_excerpt_takes_the_best_two_sentences(spark):
    df = spark.createDataFrame([("甲", "募資", "無關的句子。 甲 有募資爭議！ 其他說明文字。")], "e string, q string, t string")
    out = df.select(text.excerpt(F.col("e"), F.col("q"), F.col("t"), ("募資",)).alias("x")).first().x
    assert out.startswith("甲 有募資爭議！")


def test_search_variants(spark):
    df = spark.createDataFrame([("快樂狗園",), (" 甲 ",)], "n string")
    assert [r.v for r in df.select(names.search_variants(F.col("n")).alias("v")).collect()] == [["快樂狗園", "快樂", "快樂寵物樂園", "快樂樂園"], ["甲"]]


def test_resolution_order(spark):
    e = spark.createDataFrame([(2, "a", ["x"]), (1, "b", ["a", "x"])], "entity_id long, name string, aliases array<string>")
    k = spark.createDataFrame([(1, "k", True), (2, "off", False)], "entity_id long, keyword string, is_active boolean")
    n = spark.createDataFrame([("a",), ("k",), ("x",), ("off",)], "name string")
    assert {r.name: r.entity_id for r in joins.resolve_entities(n, e, k).collect()} == {"a": 2, "k": 1, "x": 1, "off": None}


def test_blocked_matching_equals_broadcast(spark):
    posts = spark.createDataFrame([(1, "abcdef"), (2, "xabx"), (3, "zz"), (4, "")], "post_id long, content string")
    needles = spark.createDataFrame([("e", "abc"), ("e", "ab"), ("f", "z"), ("g", "none")], "entity string, needle string")
    got = [sorted((r.entity, r.post_id) for r in joins.match_corpus(posts, needles, 10, few=few).collect()) for few in (100, 0)]
    assert got[0] == got[1] == [("e", 1), ("e", 2), ("f", 3)]


def test_low_signal_rules(spark):
    t = search.SearchTerms(entity=("acme",))
    rows = [("https://facebook.com/login", "x", "some long enough text"), ("https://facebook.com/acme/posts/1/2", "acme", "acme said this at length"), ("", "t", "text"), ("https://news.example/a", "No results found", "x")]
    df = search.with_hay(spark.createDataFrame(rows, "url string, title string, content string"))
    assert [r.s for r in df.select(search.low_signal(t).alias("s")).collect()] == [True, False, True, True]


def test_relevance_falls_back_to_all(spark):
    t = search.SearchTerms(entity=("acme",), question=("why",))
    rows = [(0, "acme why", ""), (0, "other", ""), (1, "other", "")]
    df = spark.createDataFrame(rows, "query_key int, title string, content string").withColumn("url", F.lit("http://x/1"))
    assert sorted((r.query_key, r.title) for r in search.keep_relevant(search.with_hay(df), t).collect()) == [(0, "acme why"), (1, "other")]


def test_balanced_summary_verdict(spark):
    rows = [
        (0, 1, "t1", "site", "opposing", "strong", 70, 60, "official"), (0, 2, "a long title", "site", "neutral", "weak", 50, 40, "news"),
        (0, 3, None, None, "neutral", "weak", 50, 40, "news"), (0, 4, "a long title", "other", "neutral", "weak", 50, 40, "news"),
    ]
    df = spark.createDataFrame(rows, "query_key int, rank int, title string, source string, stance string, strength string, relevance int, first_hand int, source_type string")
    out = analysis.balanced_summary(df).first()
    # points are cleaned as summaries are: brackets become plain; a short title gives way to the source, and repeated points go
    official, news = (r.o for r in df.select("rank", C.origin_label(F.col("source_type"), F.col("first_hand")).alias("o")).orderBy("rank").limit(2).collect())
    assert (out.verdict, out.confidence, out.opposing_points) == ("mostly_opposed", 36, [f"site 來源整理({official})"])
    assert out.uncertain_points == [f"a long title({news})", f"來源整理({news})"] and len(out.supporting_points) == 1


def test_cache_decision_codes(spark):
    req = spark.createDataFrame([(i, "m") for i in range(4)], "entity_id long, search_mode string")
    cached = spark.createDataFrame([(1, 9), (2, 9), (3, 9)], "entity_id long, cached_sources long")
    snaps = spark.createDataFrame([(2, "m", "2020-01-01 00:00:00", 1, 5), (3, "m", "2020-01-03 23:00:00", 2, 5)], "entity_id long, search_mode string, at string, query_id long, source_count long")
    snaps = snaps.withColumn("created_at", F.col("at").cast("timestamp_ntz")).drop("at")
    out = freshness.cache_decision(req, cached, snaps, "2020-01-04 00:00:00", max_age_hours=24)
    assert [r.reason for r in out.orderBy("entity_id").collect()] == ["insufficient_cached_sources", "missing_snapshot", "stale_snapshot", "fresh_snapshot"]


def test_mark_refresh(spark):
    w = spark.sql("SELECT 1L entity_id, 24 refresh_interval_hours, timestamp_ntz'2020-01-01' next_crawl_at, 'e' last_error_message UNION ALL SELECT 2L, 24, timestamp_ntz'2020-01-01', NULL")
    o = spark.createDataFrame([(1, True, None), (2, False, "x" * 600)], "entity_id long, ok boolean, message string")
    out = {r.entity_id: r for r in tables.mark_refresh(w, o, "2020-02-01 00:00:00").collect()}
    assert str(out[1].next_crawl_at) == "2020-02-02 00:00:00" and out[1].last_error_message is None
    assert str(out[2].next_crawl_at) == "2020-02-01 01:00:00" and len(out[2].last_error_message) == 500


def test_relabel_junk_is_idempotent(spark):
    df = spark.createDataFrame([(1, "123,456", 0.9, "supporting", "review"), (2, "a real review", 0.9, "supporting", "review")], "review_id long, content string, relevance_score double, stance string, content_type string")
    once = tables.relabel_junk(df)
    assert sorted(once.collect()) == sorted(tables.relabel_junk(once).collect())
    assert once.where("review_id = 1").first().content_type == "unrelated"


def test_suggestions_equal_a_loop_over_names_and_aliases(spark):
    draw = random.Random(7)
    word = lambda n: "".join(draw.choice("aAbB é") for _ in range(n))
    entities = [(f"{word(6)}{i}", [word(draw.randrange(0, 7)) for _ in range(draw.randrange(3))] or None, draw.choice([None, 1, 2, 30])) for i in range(300)]
    entities.append(("plain", ["", None], 5))
    needles = [word(n).strip() for n in (1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 6)] + ["", "  ", None, " PLAIN ", "29", "1", "zz", "zzzz"]
    want = set()
    for n in {x for x in needles if x and x.strip()}:
        low, found = n.strip().lower(), []
        for name, aliases, reviews in entities:
            labels = [x.lower() for x in [name, *(aliases or [])] if x is not None]
            if any(low in x for x in labels):
                found.append((not any(x.startswith(low) for x in labels), -(reviews or 0), name))
        want |= {(n, name, -reviews, i) for i, (_, reviews, name) in enumerate(sorted(found)[:10], 1)}
    df = spark.createDataFrame(entities, "name string, aliases array<string>, reviews long")
    got = rank.suggest_entities(spark.createDataFrame([(n,) for n in needles], "needle string"), df)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_long_chains_end_in_few_rounds(spark):
    """Rows that alternate in url and title: each could only be decided after the one before it."""
    rows = [(0, i, f"http://h/u{(i + 1) // 2}", f"t{i // 2}") for i in range(2000)] + [(1, i, f"http://h{i % 3}/{i % 7}", f"t{i % 5}") for i in range(60)]
    df, rounds = spark.createDataFrame(rows, "query_key int, ord int, url string, title string"), []
    kept = {(r._key, r._ord) for r in dedup.kept_ids(df, rounds=rounds).collect()}
    want, urls, signs = set(), set(), set()
    for key, i, url, title in rows:
        u, s = (key, url), (key, url.split("/")[2], title)
        if u not in urls and s not in signs:
            want.add((key, i))
            urls.add(u)
            signs.add(s)
    assert kept == want and len(rounds) <= 20
    # hosts with more rows than one task takes go on in rounds
    short = df.where("query_key = 1 or ord < 60")
    few = {(r._key, r._ord) for r in dedup.kept_ids(short, local_rows=40).collect()}
    assert few == {x for x in want if x[0] == 1 or x[1] < 60}


def test_no_keyword_is_dropped(spark):
    html = "".join(f'<div class="r-ent"><div class="title"><a href="/a{i}">Title k{i:05d}</a></div><div class="date"> 1/02</div></div>' for i in range(0, 10_500, 500))
    keywords = spark.createDataFrame([(f"K{i:05d}", "e") for i in range(10_500)], "keyword string, entity string")
    got = payloads.forum_listing(spark.createDataFrame([("b", html)], "board string, html string"), keywords, 2024).collect()
    assert {r.keyword for r in got} == {f"K{i:05d}" for i in range(0, 10_500, 500)}


def test_cached_sources_grow_with_cards_and_read_texts_once(spark):
    """Each of 400 sources holds the term of each of 400 requests, which have one card each; odd terms and sources are met as in a loop."""
    n = 400
    requests = spark.createDataFrame([(i, i, None if i % 2 else "a", ["Said", None, ""], ["" if i % 5 == 0 else f"site{i % 3}  HTTP", None], [] if i % 7 else ["zz", "body"]) for i in range(n)], "query_key long, entity_id long, search_mode string, terms array<string>, exact_terms array<string>, question_terms array<string>")
    queries = spark.createDataFrame([(i, i, "b" if i % 4 == 0 else "a") for i in range(n)], "query_id long, entity_id long, search_mode string")
    cards = spark.createDataFrame([(i, i, 5, 6) for i in range(n)], "query_id long, source_id long, relevance long, credibility long")
    source = lambda i: (i, f" http://h/{i}" if i % 11 else "  ", "" if i % 3 else None, "said " + ("body" if i % 2 else "rest") if i % 13 else None, f"Site{i % 4}", 1, None)
    sources = spark.createDataFrame([source(i) for i in range(n)], "source_id long, url string, title string, content string, site_name string, updated_at long, published_at long")
    made = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = made()
    out = joins.cached_sources(requests, queries, cards, sources, 4)
    got = {(r.query_key, r.source_id, r.rank) for r in out.select("query_key", "source_id", "rank").collect()}
    time.sleep(1)
    want = set()
    for i, (_, url, title, content, site, *_rest) in enumerate(map(source, range(n))):
        said = " ".join([title or "", content or "", site, url]).lower()
        if "said" in (content or "") and url.strip() and (i % 2 or i % 4) and (i % 5 == 0 or f"site{i % 3}  http" in said) and (i % 7 or "body" in said):
            want.add((i, i, 1))
    assert got == want and len(want) > 20
    assert made() - before < 400_000  # 160,000 pairs of requests and sources take more


def test_cleaning_skips_no_rule_that_matches(spark):
    """Rules that are skipped where a text lacks what they need give what all rules in order give, on texts made of what rules look for."""
    draw = random.Random(11)
    bits = ["<svg a>x</svg>", "%3C%20%41b", "data:a/b;base64,QUJD", "{a:b}", "function (x) {y}", "var k =", "<b>", "[t](u)", "http://h/p", "%41%42%43", "M10 20.5,3-4 77 8", "\u200b", "\u202e", "\ufeff", "�", "��", "[|", "••", "▪\ufe0e", "==--", "  ", "\t", "\n", "\n\n\n", "\r", "\u2028", "\u0085", " -_:/", "ab…", "word", "Ünï", "$", "⭐", "5%", "\u3000", "𝕏", "☂"]
    rows = [("".join(draw.choice(bits) for _ in range(draw.randrange(9))),) for _ in range(4000)] + [(None,), ("",), *((b,) for b in bits)]
    df = spark.createDataFrame(rows, "c string")
    plain = F.col("c")
    for i, (pattern, put) in enumerate(text.CONTENT_RULES):
        plain = F.regexp_replace(plain, r"\p{C}|[^\P{S}⭐☆%]" if i == 18 else pattern, put)
    pairs = df.select("c", text.without_markup(F.col("c")).alias("got"), plain.alias("want"))
    assert pairs.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_cards_clean_a_text_once(spark):
    """The lines of a text are trimmed once for all that reads them, however often cards name the cleaned text."""
    df = spark.createDataFrame([(1, 1, "http://h/1", "title", "some text. more text.", "s", None, "2024-01-01")], "query_key long, ord long, url string, title string, content string, source string, source_type string, published_date string")
    made = analysis.evidence_cards(df, F.lit("x"), F.lit("y"), "2024-02-01").select("excerpt", "summary")._jdf.queryExecution().optimizedPlan().toString()
    assert made.count("array_sort(") == 2  # one for each excerpt


def test_suggestions_meet_only_names_that_hold_the_needle(spark):
    """400 names and 400 needles share each gram of three characters: each needle meets its own name, and one that is longer than a piece is tested."""
    code = lambda i: "".join("xy"[i >> k & 1] for k in range(9))
    names = [f"{code(i)}-{'long ' * 3}{i:03d}" for i in range(400)]
    df = spark.createDataFrame([(n, None, i) for i, n in enumerate(names)], "name string, aliases array<string>, reviews long")
    asked = [n[:9].upper() for n in names] + [names[7], names[7] + "z"]
    out = rank.suggest_entities(spark.createDataFrame([(n,) for n in asked], "needle string"), df)
    assert {(r.needle, r.name, r.rank) for r in out.collect()} == {(n[:9].upper(), n, 1) for n in names} | {(names[7], names[7], 1)}
    # no table of the best names of each piece, asked for or not, and no join of the names with themselves
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
