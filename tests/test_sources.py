"""Payload normalisers on small payloads."""

import base64

from pyspark.sql import functions as F

from attesta.sources import payloads as P
from attesta.streaming import streams


def test_feed(spark):
    xml = "<rss><channel><item><title>A</title><link>http://a</link><description>&lt;b&gt;x&lt;/b&gt; y</description><source>S</source><pubDate>Mon, 05 Jan 2024 10:00:00 GMT</pubDate></item><item><title>no link</title></item></channel></rss>"
    out = P.feed_items(spark.createDataFrame([(1, xml)], "query_key int, xml string"), 5).collect()
    assert [(r.url, r.content, r.source, r.published_date) for r in out] == [("http://a", "x y", "S", "2024-01-05")]


def test_serp_json(spark):
    rows = [(1, '{"organic_results":[{"link":" http://a ","title":"T","snippet":"s"},{"title":"no url"}]}'), (2, "broken")]
    out = P.serp_json(spark.createDataFrame(rows, "query_key int, json string"), "organic").collect()
    assert [(r.query_key, r.url, r.title, r.content, r.published_date) for r in out] == [(1, "http://a", "T", "s", None)]


def test_serp_html(spark):
    html = '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.org%2Fp&r=1">T &amp; U</a><a class="result__snippet">snip</a></div><div class="result"><a class="result__a" href="">none</a></div>'
    out = P.serp_html(spark.createDataFrame([(1, html)], "query_key int, html string")).collect()
    assert [(r.url, r.title, r.content, r.source) for r in out] == [("https://x.org/p", "T & U", "snip", "x.org")]


def test_unwrap_link(spark):
    code = base64.urlsafe_b64encode(b"\x08\x13\x22\x14https://x.org/a\xd2\x01\x00").decode().rstrip("=")
    df = spark.createDataFrame([(f"https://news.google.com/rss/articles/{code}?oc=5",), ("https://x.org/articles/abc",)], "u string")
    assert [r.v for r in df.select(P.unwrap_link(F.col("u")).alias("v")).collect()] == ["https://x.org/a", "https://x.org/articles/abc"]


def test_forum_pushes(spark):
    html = '<span class="article-meta-value">Sat Jan  8 17:42:51 2022</span><div class="push"><span class="hl push-tag">推 </span><span class="f3 push-userid">bob</span><span class="f3 push-content">: good</span><span class="push-ipdatetime"> 01/09 17:45</span></div><div class="push"><span class="push-tag">→ </span><span class="push-content">: </span></div>'
    out = P.forum_pushes(spark.createDataFrame([(1, "u", "b", "t", html)], "article_id int, url string, board string, title string, html string"), 2000).collect()
    assert [(r.content, r.author, r.sentiment, r.published_at) for r in out] == [("good", "bob", "推", "2022-01-09")]


def test_thread_posts(spark):
    body = "too early to count\nsome_name\n12\nthis is a real post here\n登入 line is dropped\nother.name\nanother post that is long"
    out = P.thread_posts(spark.createDataFrame([(1, "u", body)], "page_id int, url string, text string")).orderBy("pos").collect()
    assert [(r.author, r.content) for r in out] == [("some_name", "this is a real post here"), ("other.name", "another post that is long")]


def test_place_reviews(spark):
    js = '{"reviews":[{"user":{"name":"A"},"rating":"4.6","snippet":"fine"},{"rating":"bad","snippet":""}]}'
    out = P.place_reviews(spark.createDataFrame([(1, js)], "place_id int, json string")).orderBy("pos").collect()
    assert [(r.author, r.rating, r.content) for r in out] == [("A", 5, "fine"), ("匿名用戶", 0, "匿名用戶 給予 0 星評價。")]


def test_actor_items(spark):
    rows = [(1, '{"message":"hello","user":{"name":"N"},"likes":3,"time":"t"}'), (2, '{"text":"  "}')]
    out = P.actor_items(spark.createDataFrame(rows, "item_id int, json string"), "facebook_posts").collect()
    assert [(r.content, r.author, r.likes, r.published_at) for r in out] == [("hello", "N", 3, "t")]


def test_page_metadata_and_gallery(spark):
    html = "<title> A  b </title><meta property='og:image' content='/i.png'><img src='logo.png'><img src='c/d.jpg' alt='x'><p>long enough text for a description</p>"
    pages = P.page_metadata(spark.createDataFrame([(1, "https://x.org/p/q", html)], "page_id int, url string, html string"))
    row = pages.first()
    assert row.title == "A b" and row.images == ["https://x.org/i.png", "https://x.org/p/c/d.jpg"] and row.description.endswith("long enough text for a description")
    out = P.official_gallery(pages.withColumn("entity", F.lit("e")).withColumn("ord", F.lit(0))).first()
    assert out.headline == "A b" and len(out.images) == 2


def test_page_map(spark):
    out = P.page_map(spark.createDataFrame([("E1|u1,u2;http://d",)], "text string")).collect()
    assert sorted((r.key, r.url) for r in out) == [("_default", "http://d"), ("e1", "u1"), ("e1", "u2")]


def test_alias_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿canonical_name,alias\nN,a\nN,\n", encoding="utf-8")
    assert [(r.canonical_name, r.alias) for r in P.read_alias_csv(spark, str(tmp_path / "a.csv")).collect()] == [("N", "a")]


def test_stream_ingest(spark, tmp_path):
    schema = "review_id long, entity string, platform string, author string, content string"
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for rows in ([(1, "e", "p", "a", "x"), (2, "e", "p", "a", "x")], [(3, "e", "p", "a", "x"), (4, "e", "p", "a", "y")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        streams.stream_ingest_reviews(spark.readStream.schema(schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.review_id for r in streams.read_reviews(spark, out).collect()) == [1, 4]


def test_running_ratings(spark, tmp_path):
    spark.createDataFrame([(1, 1, 7, 3, 1), (2, 1, 7, 5, 2), (3, 1, 8, 9, 1)], "event_id long, review_id long, user_id long, score int, ts long").write.parquet(str(tmp_path / "ev"))
    events = spark.readStream.schema("event_id long, review_id long, user_id long, score int, ts long").parquet(str(tmp_path / "ev"))
    streams.running_ratings(events).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r.review_id, r.user_id, r.score) for r in spark.table("running").collect()] == [(1, 7, 5)]


def test_forum_post_clean(spark):
    df = spark.createDataFrame([("a line that is long enough\n12 引言\nfooter mark here",), ("short",)], "t string")
    assert [r.c for r in df.select(P.forum_post_clean(F.col("t"), ("footer",)).alias("c")).collect()] == ["a line that is long enough", None]


def test_pages_of_entities(spark):
    pages = P.page_map(spark.createDataFrame([("E1|u1,u2;al|u3;http://d",)], "text string"))
    entities = spark.createDataFrame([(1, "e1", ["AL"]), (2, "x", ["y", "AL"]), (3, "z", None)], "entity_id long, name string, aliases array<string>")
    assert {(r.entity_id, r.url) for r in P.pages_of(entities, pages).collect()} == {(1, "u1"), (1, "u2"), (2, "u3"), (3, "http://d")}


def test_snippets_authors_and_summaries(spark):
    df = spark.createDataFrame([("short", "s"), ("a long enough title", ""), ("t", "a snippet of twenty characters")], "t string, s string")
    assert [r.c for r in df.select(P.forum_snippet(F.col("t"), F.col("s")).alias("c")).collect()] == [None, "a long enough title", "t\na snippet of twenty characters"]
    df = spark.createDataFrame([("[Google Maps 評論] 王 — ⭐⭐",), ("no",)], "t string")
    assert [r.c for r in df.select(P.review_author(F.col("t")).alias("c")).collect()] == ["王", None]
    js = '{"place_info": {"title": "P", "address": "A", "rating": 4.5, "reviews": 12}}'
    rows = P.place_summaries(spark.createDataFrame([(1, "n", js), (2, "n", "{}")], "place_id int, name string, json string")).collect()
    assert [(r.place_id, r.title) for r in rows] == [(1, "[Google Maps] P — 評分 4.5/5 (12 則評論)")]


def test_wrapped_links(spark):
    import base64

    code = lambda url: base64.urlsafe_b64encode(b'\x08\x13"' + bytes([len(url)]) + url + b"\xd2\x01\x00").decode().rstrip("=")
    links = ["https://news.google.com/rss/articles/" + code(b"https://a.example/x?y=1"), "https://news.google.com/articles/" + code(b"https://a.example/\xff\xfe"), "https://b.example/articles/abc"]
    out = [r.u for r in spark.createDataFrame([(x,) for x in links], "l string").select(P.unwrap_link(F.col("l")).alias("u")).collect()]
    assert out == ["https://a.example/x?y=1", links[1], links[2]]
