"""Payloads, registries and small lists that no query covers, on hand-made cases."""

import json

from pyspark.sql import functions as F

from attesta.functions import classify as C
from attesta.functions import names, text
from attesta.operators import rank, tables
from attesta.plans import analysis
from attesta.sources import payloads as P


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_forum_article(spark):
    html = '<div id="main-content" class="x"><div class="article-metaline">author</div>The text &amp; more.<div class="article-metaline-right">board</div><div class="push">a push</div> End' + "x" * 900
    got = one(spark, html, P.forum_article_text)
    assert got.startswith("The text & more.") and "push" not in got and "author" not in got and len(got) == 700
    assert one(spark, "<p>no main part</p>", P.forum_article_text) == ""


def test_articles_are_checked_again_by_their_text(spark):
    html = "".join(f'<div class="r-ent"><div class="title"><a href="/a{i}">About Acme {i}</a></div><div class="date"> 1/02</div></div>' for i in range(4))
    keywords = spark.createDataFrame([("acme", "e"), ("other name", "e")], "keyword string, entity string")
    contents = spark.createDataFrame([("/a0", "ACME is here"), ("/a1", "nothing of it"), ("/a2", ""), ("/a1", None)], "path string, content string")
    got = P.forum_listing(spark.createDataFrame([("b", html)], "board string, html string"), keywords, 2024, contents=contents)
    assert sorted((r.path, r.content) for r in got.collect() if r.content) == [("/a0", "ACME is here")]
    assert sorted(r.path for r in got.collect()) == ["/a0", "/a2", "/a3"]


def test_board_posts(spark):
    posts = [{"id": "7", "title": "T", "excerpt": "short", "content": "", "forumName": "pets", "createdAt": "2024-03-05T10:00:00.000Z"}, {"title": None, "content": "c" * 800}]
    rows = P.board_posts_json(spark.createDataFrame([(1, json.dumps(posts)), (2, "broken")], "query_key int, json string")).collect()
    assert [(r.url, r.title, r.content, r.source, r.source_type, r.published_date) for r in rows[:1]] == [("https://www.dcard.tw/f/pets/p/7", "[Dcard/pets] T", "short", "Dcard pets", "forum", "2024-03-05")]
    assert len(rows[1].content) == 700 and rows[1].url == "" and len(rows) == 2


def test_page_posts(spark):
    rows = [("Acme", "u", "we met ACME today " + "x" * 80), ("Acme", "u", "nobody")]
    got = P.page_posts(spark.createDataFrame(rows, "entity string, user string, text string")).collect()
    assert [r.title for r in got] == [("[Facebook/u] " + rows[0][2][:60] + "...")]


def test_results_to_reviews(spark):
    rows = [(1, 0, " u1 ", "t", "c", "s"), (1, 1, "u1", "later", "c", "s"), (1, 2, "", "t", "c", "s"), (1, 3, "u2", "", "", "s"), (1, 4, "u3", "only title", None, None), (1, 5, "u4", "t", "c", "s")]
    df = spark.createDataFrame([(*r, "2024-01-01", "") for r in rows], "query_key int, ord int, url string, title string, content string, source string, published_date string, snippet string")
    got = {r.ord: (r.content, r.author, r.parent_title) for r in P.results_to_reviews(df, 2).collect()}
    assert got == {0: ("t\nc", "s", "[新聞/s]"), 4: ("only title", "", "[新聞]")}


def test_registry_and_groups(spark, tmp_path):
    (tmp_path / "r.csv").write_text("name,aliases,page_url,phone,city\n N ,a/b、N, https://www.facebook.com/p/?x=1,12,\nM,,https://x.org/,,Here\n,z,,,\n", encoding="utf-8")
    got = P.read_registry(spark, str(tmp_path / "r.csv"), {"phone": "電話", "city": "地點"})
    assert sorted(r.name for r in got["entities"].collect()) == ["M", "N"]
    assert sorted((r.name, r.keyword, r.weight) for r in got["keywords"].collect()) == [("N", "a", 70), ("N", "b", 70)]
    assert {r.name: r.intro for r in got["intros"].collect()} == {"N": "電話：12", "M": "地點：Here"}
    assert [(r.name, r.page_url) for r in got["pages"].collect()] == [("N", "https://www.facebook.com/p")]
    assert {(r.priority, r.refresh_interval_hours) for r in got["watchlist"].collect()} == {(3, 720)}
    (tmp_path / "g.json").write_text(json.dumps({"note": "n", "groups": [{"url": "https://f/1", "name": "a"}, {"name": "no url"}, {"url": " "}]}))
    assert [r.url for r in P.read_groups_json(spark, str(tmp_path / "g.json")).collect()] == ["https://f/1"]


def test_share_images_and_intro_urls(spark):
    page = lambda html: one(spark, html, lambda h: P.og_image(F.lit("https://x.org/a/b"), h))
    assert page('<meta content="/i.png?a=1&amp;b=2" property="og:image">') == "https://x.org/i.png?a=1&b=2"
    assert page("<meta name='twitter:image' content='j.png'>") == "https://x.org/a/j.png"
    assert page("<meta name='twitter:image' content='j.png'><meta property='og:image' content='//y.org/k.png'>") == "https://y.org/k.png"
    assert not page("<p>none</p>")
    got = one(spark, "see https://x.org/p. and https://www.facebook.com/q, then https://fb.me", P.intro_urls)
    assert (got.page_url, got.site_url) == ("https://www.facebook.com/q", "https://x.org/p")
    assert tuple(one(spark, "nothing", P.intro_urls)) == (None, None)


def test_lists_of_media_suggestions_and_dimensions(spark):
    media = spark.createDataFrame([(i, "e" if i < 5 else None) for i in range(7)], "id long, entity_name string")
    assert sorted((r.id, r.total) for r in rank.list_media(media, 2, 1).collect()) == [(2, 5), (3, 5), (5, 2)]
    rows = [(1, "m", i, 70 + i % 2, i != 3) for i in range(5)]
    got = rank.list_suggestions(spark.createDataFrame(rows, "entity_id long, search_mode string, id long, confidence int, is_active boolean"), 3)
    assert [r.id for r in got.orderBy("rank").collect()] == [1, 0, 2]
    tagged = spark.sql("SELECT 1 AS id, array(named_struct('dim', 'a'), named_struct('dim', 'b')) AS tags UNION ALL SELECT 2, array() UNION ALL SELECT 3, NULL")
    assert [r.id for r in rank.by_dimension(tagged, "b").collect()] == [1]


def test_runs_are_logged(spark, tmp_path):
    path = str(tmp_path / "log")
    for status in ("success", "failed"):
        tables.log_run(spark.createDataFrame([("p", "e", status, 7, None)], "pipeline string, entity string, status string, rows_written int, error string"), path)
    assert sorted((r.status, r.rows_written) for r in spark.read.parquet(path).collect()) == [("failed", 0), ("success", 7)]


def test_analysis_funnel(spark):
    rows = [(1, True, 90, "t", "s" * 100, "u")] + [(1, False, r, "t", "s" * 100, "u") for r in (80, 50, 39)] + [(2, False, 10, "t", "s" * 100, "u")] * 12
    df = spark.createDataFrame(rows, "query_key int, noise boolean, relevance int, title string, snippet string, url string")
    got = {r.query_key: (r.input, r.noise, r.low_relevance, r.final) for r in analysis.analysis_funnel(df).collect()}
    assert got == {1: (4, 1, 1, 2), 2: (12, 0, 12, 10)}


def test_query_buckets_and_texts(spark):
    rules = {"fundraising": ("募資",), "news": ("新聞",), "reported": ("報導",), "forum": ("ptt",)}
    bucket = lambda q, **k: one(spark, q, lambda c: C.query_bucket(c, rules, **k))
    assert [bucket(q) for q in ("x 募資 新聞", "x 報導", "x PTT", "x")] == ["fundraising", "news", "forum", "general"]
    assert bucket("x 動保 新聞", domain=("動保",)) == "domain"
    assert one(spark, "a line\r\n\r\n\r\n\r\n  - b…  \n", text.clean_summary_text).startswith("a line")
    assert one(spark, "1234 ab", lambda c: text.is_readable(c)) is False and one(spark, "abc 1", lambda c: text.is_readable(c)) is True
    assert one(spark, "<script>x</script><b>a &amp; *b*</b>", text.normalize_html_text) == "a & b"


def test_names_of_searches(spark):
    got = spark.createDataFrame([("快樂狗園", "募資透明嗎", ['site:ptt.cc "快樂" a', "x y"])], "n string, q string, e array<string>")
    row = got.select(names.exact_terms(F.col("n")).alias("x"), names.analysis_variants(F.col("n")).alias("v"), names.cached_terms(F.col("n"), F.col("q"), F.col("e")).alias("t"), names.search_variants(F.col("n")).alias("s")).first()
    assert row.x == ["快樂狗園", "快樂"] and row.v == ["快樂狗園", "快樂寵物樂園", "快樂樂園", "快樂園區"]
    assert row.t == ["快樂狗園", "快樂", "募資", "透明", "ptt.cc"] and row.s == ["快樂狗園", "快樂", "快樂寵物樂園", "快樂樂園"]


def test_titles_give_way_to_sources_and_hosts(spark):
    rows = [(1, 0, "https://h.example/1", "a.example", "long enough text of a page", "site"), (1, 1, "https://h.example/2", "", "long enough text of a page", "b.example"), (1, 2, "https://h.example/3", "A fine title", "long enough text of a page", "site")]
    df = spark.createDataFrame([(*r, None, "2024-01-01") for r in rows], "query_key int, ord int, url string, title string, content string, source string, source_type string, published_date string")
    cards = analysis.evidence_cards(df, F.lit("x"), F.lit("y"), "2024-02-01")
    assert {r.ord: r.title for r in cards.collect()} == {0: "site 來源紀錄", 1: "h.example 來源紀錄", 2: "A fine title"}
