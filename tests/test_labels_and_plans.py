"""Label validation, refresh runs and the smaller ranking operators."""

from pyspark.sql import functions as F

from attesta.functions import labels, names, templates
from attesta.operators import queue, joins, rank, tables
from attesta.plans import freshness, refresh, search


def only(spark, text, column):
    return spark.createDataFrame([(text,)], "raw string").select(column(F.col("raw")).alias("x")).first().x


def test_review_labels(spark):
    fine = only(spark, '{"relevance_score": 1.7, "stance": "Supporting", "short_summary": "' + "s" * 100 + '", "content_type": "odd"}', labels.review_labels)
    assert (fine.relevance_score, fine.stance, len(fine.short_summary), fine.content_type) == (1.0, "supporting", 80, "review")
    for broken in ("nonsense", None):
        assert tuple(only(spark, broken, labels.review_labels)) == (0.0, "unclear", "", "unrelated")


def test_dimension_tags(spark):
    raw = '{"tags":[{"dim":"environment","stance":"odd","excerpt":"e"},{"dim":"unknown"},{"dim":"transparency","stance":"OPPOSING"}]}'
    assert [tuple(t) for t in only(spark, raw, labels.dimension_tags)] == [("environment", "neutral", "e"), ("transparency", "opposing", "")]
    assert only(spark, "broken", labels.dimension_tags) == []


def test_summary(spark):
    raw = 'x ```json\n{"verdict":"目前無證據","confidence":"150","opposing_points":["a point","","b","c","d"]}\n```'
    out = only(spark, raw, lambda c: labels.summary(c, F.lit(40), F.lit("v"), F.lit("composed")))
    # the first three items, cleaned; blank and short ones go
    assert (out.verdict, out.confidence, out.opposing_points) == ("composed", 100, ["a point"])
    items = '{"verdict":"fine","supporting_points":["  a line \\n\\n - another one: ","the same","the same","a fourth one"],"uncertain_points":[null,"a  line  of  text"]}'
    out = only(spark, items, lambda c: labels.summary(c, F.lit(40), F.lit("v"), F.lit("composed")))
    assert (out.supporting_points, out.uncertain_points) == (["a line\nanother one", "the same"], ["a line of text"])
    out = only(spark, "broken", lambda c: labels.summary(c, F.lit(40), F.lit("v"), F.lit("composed")))
    assert (out.verdict, out.confidence) == ("v", 40)


def test_candidates(spark):
    raw = '{"verified":true,"canonical_name":" N ","aliases":["N","m"],"evidence_urls":["http://x"],"cover_image_url":"data:x"}'
    out = only(spark, raw, labels.accepted_candidate)
    assert (out.accepted, out.canonical_name, out.aliases, out.cover_image_url) == (True, "N", ["m"], "")
    assert only(spark, '{"verified":true,"canonical_name":"N"}', labels.accepted_candidate).reason == "no_evidence_urls"
    assert only(spark, '{"verified":false}', labels.accepted_candidate).reason == "model_rejected"


def test_names(spark):
    df = spark.createDataFrame([("社團法人台灣愛心協會",)], "n string")
    row = df.select(names.expand_aliases(F.col("n")).alias("a"), names.forum_keywords(F.lit("甲乙 丙"), ("狗園",)).alias("k"), names.relaxed_tokens(F.lit("快樂狗園")).alias("r")).first()
    assert "台灣愛心協會" in row.a and "臺灣愛心協會" in row.a and "台灣愛心" in row.a
    assert row.k == ["甲乙 丙", "甲乙", "甲乙 丙狗園"] and row.r[0] == "快樂狗園" and "快樂" in row.r
    urls = spark.createDataFrame([("https://facebook.com/a/",), ("https://x.org/",)], "u string")
    assert [r.v for r in urls.select(names.strip_social_url(F.col("u")).alias("v")).collect()] == ["https://facebook.com/a", ""]


def test_templates_and_plan(spark):
    t = templates.question_templates(spark, ["zoo", "other"])
    assert t.where("entity_type = 'zoo' and search_mode = 'general'").count() == 6 and t.where("entity_type = 'other'").count() == 8
    due = spark.createDataFrame([(1, "zoo")], "entity_id long, entity_type string")
    assert freshness.refresh_plan(due, t, ["general"], 2).count() == 2
    assert templates.with_questions(due, t).count() == 12


def test_refresh_counts_failures(spark):
    plan = spark.createDataFrame([(0, 1, "general", "acme?"), (1, 2, "general", "none?")], "query_key long, entity_id long, search_mode string, question string")
    rows = [(0, i, f"http://site{i}.org/p/{i}", f"acme story {i}", "acme did something that is long enough to keep", "s", None) for i in range(3)]
    results = spark.createDataFrame(rows, "query_key long, ord long, url string, title string, content string, source string, published_date string")
    out = refresh.refresh_due(plan, results, search.SearchTerms(entity=("acme",), question=("story",)), F.lit("acme"), "2024-01-01")
    assert {r.entity_id: (r.success, r.failed) for r in out["counts"].collect()} == {1: (1, 0), 2: (0, 1)}
    assert out["cards"].count() == 3


def test_ingest_by_platform(spark):
    schema = "review_id long, entity string, author string, content string"
    a, b = spark.createDataFrame([(1, "e", "x", "same"), (2, "e", "x", "same ")], schema), spark.createDataFrame([(3, "e", "x", "same")], schema)
    new, totals = refresh.ingest_pipelines(spark.createDataFrame([], "content_hash string"), {"ptt": a, "maps": b})
    assert sorted((r.platform, r.review_id) for r in new.collect()) == [("maps", 3), ("ptt", 1)]
    assert {(r.platform, r.entity): r.rows_written for r in totals.collect()}[(None, None)] == 2


def test_maintenance(spark):
    reviews = spark.createDataFrame([(1, "e", "123", None, None, None), (2, "e", "a real one", None, None, None), (3, "e", "left alone", None, None, None)], "review_id long, entity string, content string, relevance_score double, stance string, content_type string")
    answers = spark.createDataFrame([(2, '{"relevance_score":0.8,"stance":"opposing","content_type":"review"}')], "review_id long, raw string")
    out = refresh.maintain_reviews(reviews, answers)
    assert {r.review_id: r.content_type for r in out["reviews"].collect()} == {1: "unrelated", 2: "review", 3: None}
    assert [(r.review_id, r.batch, r.place) for r in out["to_label"].collect()] == [(3, 0, 0)]
    assert [(r.review_id, r.message) for r in out["to_tag"].collect()] == [(2, "組織：e\n平台：\n標題：\n內容：a real one")]
    tags = spark.createDataFrame([(2, '{"tags":[{"dim":"transparency","stance":"bad","excerpt":"x"},{"dim":"none"}]}'), (3, "broken")], "review_id long, raw string")
    done = refresh.maintain_reviews(out["reviews"], answers, tags, "2024-01-01")
    rows = {r.review_id: r for r in done["reviews"].collect()}
    assert [tuple(t) for t in rows[2].tags] == [("transparency", "neutral", "x")] and rows[3].tags == [] and rows[1].tags is None
    assert str(rows[2].dimensions_classified_at) == "2024-01-01 00:00:00" and done["to_tag"].count() == 0


def test_claims_are_respected(spark, tmp_path):
    path, rows = str(tmp_path / "claims"), spark.createDataFrame([(i, f"m{i}") for i in range(20)], "review_id long, message string")
    mine = lambda run, at, **k: sorted(r.review_id for r in queue.claim(rows, path, run, at, 6, buckets=4, **k).collect())
    assert mine("a", "2024-01-01 00:00:00", limit=5) == [0, 1, 2, 3, 4]
    assert mine("b", "2024-01-01 01:00:00", limit=5) == [5, 6, 7, 8, 9]
    assert mine("a", "2024-01-01 02:00:00", limit=5) == [0, 1, 2, 3, 4]  # its own again
    queue.release(path, rows.where("review_id < 3"))
    assert mine("c", "2024-01-01 03:00:00") == [0, 1, 2, *range(10, 20)]
    assert mine("d", "2024-01-02 00:00:00") == list(range(20))  # claims have run out
    dealt = queue.batches(rows, ["review_id"], 6).collect()
    assert sorted((r.review_id, r.batch, r.place) for r in dealt) == [(i, i // 6, i % 6) for i in range(20)]


def test_tabs_and_targets(spark):
    rows = [(0, 1, "official", "supporting", None, "2020"), (0, 2, "news", "opposing", "2021", None)]
    cards = spark.createDataFrame(rows, "query_key int, rank int, source_type string, stance string, published_at string, extracted_at string")
    assert [r["rank"] for r in rank.evidence_tab(cards, "latest").orderBy("tab_place").collect()] == [2, 1]
    assert rank.evidence_tab(cards, "news").count() == 1
    results = spark.createDataFrame([(0, 1, "http://a.org", "x" * 1300, "news"), (0, 2, "http://a.org/2", "x", "news"), (0, 3, "http://b.org", "x", "news")], "query_key int, ord int, url string, content string, source_type string")
    assert [r.ord for r in rank.crawl_targets(results, ["a.org"], 5).collect()] == [2]


def test_tables(spark):
    e = spark.createDataFrame([(1, "n", ["b", "bad"])], "entity_id long, name string, aliases array<string>")
    assert tables.prune_aliases(e, ["bad"]).first().aliases == ["b"]
    w = spark.createDataFrame([(1,)], "entity_id long")
    assert [r.entity_id for r in tables.enroll_watchlist(w, spark.createDataFrame([(1,), (2,)], "entity_id long")).collect()] == [2]
    ev = spark.createDataFrame([(1, 1, 1, "like", "add", 1), (2, 1, 1, "like", "remove", 2), (3, 1, 2, "like", "add", 1), (4, 1, 2, "odd", "add", 1)], "event_id long, review_id long, user_id long, reaction string, action string, ts long")
    assert [(r.user_id, r.reaction) for r in tables.reactions(ev).collect()] == [(2, "like")]
    p = spark.createDataFrame([(1, "", "i", "c", ["g"])], "entity_id long, headline string, intro string, cover string, gallery array<string>")
    n = spark.createDataFrame([(1, "h", "new", "new", []), (2, "x", "", "y", ["z"])], p.schema)
    out = {r.entity_id: tuple(r)[1:] for r in tables.upsert_profiles(p, n).collect()}
    assert out == {1: ("h", "i", "c", ["g"]), 2: ("x", "", "y", ["z"])}
    assert {r.entity_id: (r.cover, r.gallery) for r in tables.upsert_profiles(p, n, True).collect()}[1] == ("new", [])
    assert {r.entity_id: (r.cover, r.gallery) for r in tables.upsert_profiles(p, n.withColumn("gallery", F.array(F.lit("q")))).collect()}[1] == ("new", ["q"])


def test_hydration_and_enrichment(spark):
    r = spark.createDataFrame([(" http://a ", "", "s", "c")], "url string, title string, snippet string, content string")
    s = spark.createDataFrame([("http://a", "known", "z")], "url string, title string, snippet string")
    assert joins.hydrate(r, s, ["title", "snippet"]).first().title == "known"
    c = spark.createDataFrame([("http://a", "new title", "x" * 30)], "url string, title string, content string")
    out = joins.merge_enrichment(r, c).first()
    assert (out.title, out.snippet, out.enriched) == ("new title", "x" * 30, True)


def test_entity_page(spark):
    e = spark.createDataFrame([(1, "n", "zoo"), (2, "m", "odd")], "entity_id long, name string, entity_type string")
    p = spark.createDataFrame([(1, "h", " ", None, ["u"])], "entity_id long, headline string, intro string, cover string, gallery array<string>")
    c = spark.createDataFrame([(1, i, f"c{i}") for i in range(7)], "entity_id long, comment_id long, comment string")
    m = spark.createDataFrame([("n", 1, "f1"), ("n", 2, "f2")], "entity_name string, id long, url string")
    out = {r.entity_id: r for r in joins.entity_page(e, p, c, m, {"zoo": "a zoo"}).collect()}
    assert (out[1].cover, out[1].gallery, out[1].intro, out[1].comment_count) == ("u", [], "a zoo", 7)
    assert out[1].recent_comments == ["c6", "c5", "c4", "c3", "c2"] and out[1].recent_media == ["f2", "f1"] and out[2].comment_count == 0


def test_card_texts(spark):
    from attesta.functions import classify as C

    card = spark.createDataFrame([("supporting", "news", "weak", 32, 50, 60, "recent", "low")], "stance string, source_type string, strength string, first_hand int, relevance int, credibility int, recency string, duplicate_risk string")
    row = card.select(C.notes().alias("n"), C.card_summary(F.lit("")).alias("s"), C.question_focus(F.lit("最近的募資")).alias("q"), C.review_tone(F.lit(3), F.lit(1)).alias("t"), C.platform_label(F.lit("PTT"), F.lit("")).alias("p")).first()
    assert "32/100" in row.n and "新聞轉述" in row.n and row.s == "新聞整理，這則內容偏向支持疑慮。" and tuple(row.q) == (True, False, True) and (row.t, row.p) == ("negative", "ptt")


def test_maintained_tables(spark):
    t = spark.createDataFrame([("u", "s", "news", "t", "long content", "a", None)], "url string, site_name string, source_type string, title string, content string, author string, published_at string")
    c = spark.createDataFrame([("u", "S", "forum", "T", "snip", "2020", 1), ("w", "S", "forum", "T", "snip", None, 2)], "url string, source string, source_type string, title string, snippet string, published_at string, ord long")
    out = {r.url: r for r in tables.upsert_evidence_sources(t, c).collect()}
    assert tuple(out["u"]) == ("u", "S", "forum", "T", "snip", "a", "2020") and out["w"].author is None
    e = spark.createDataFrame([("n", ["al"])], "name string, aliases array<string>")
    assert [r.name for r in tables.create_entities(e, spark.createDataFrame([("n",), ("al",), (" new ",), ("",)], "name string")).collect()] == ["new"]
    old = spark.createDataFrame([(1, 7, "x"), (2, 8, "y")], "comment_id long, user_id long, comment string")
    gone = spark.createDataFrame([(1, 7), (2, 7)], "comment_id long, user_id long")
    assert sorted(r.comment_id for r in tables.append_comments(old, spark.createDataFrame([(3, 7, " z "), (4, 7, " ")], old.schema), gone).collect()) == [2, 3]
    m = spark.createDataFrame([(1, "n", "c")], "id long, entity_name string, caption string")
    new = spark.createDataFrame([(2, "al", "c2", "said")], "id long, entity_name string, caption string, comment string")
    names_ = spark.createDataFrame([("al", "n")], "name string, canonical_name string")
    assert sorted(tuple(r) for r in tables.media_append(m, new, names_, spark.createDataFrame([(1,)], "id long")).collect()) == [(2, "n", "said")]


def test_seeds(spark):
    watch = spark.createDataFrame([(1, False, 3, 24, "general", "x")], "entity_id long, is_active boolean, priority int, refresh_interval_hours int, default_mode string, note string")
    seeds = spark.createDataFrame([(1, 1, 168, "animal_law"), (2, 2, 12, "general")], "entity_id long, priority int, refresh_interval_hours int, default_mode string")
    assert {tuple(r) for r in tables.seed_watchlist(watch, seeds).collect()} == {(1, False, 1, 168, "animal_law", "x"), (2, True, 2, 12, "general", None)}
    entities = spark.createDataFrame([(1, "Alpha", ["al", "Alpha", " "])], "entity_id long, name string, aliases array<string>")
    words = spark.createDataFrame([(1, "al"), (1, "beta")], "entity_id long, keyword string")
    assert {(r.keyword, r.weight) for r in tables.seed_keywords(entities, words).collect()} == {("Alpha", 100), ("al", 80), ("beta", 80)}


def test_snapshots_of_recent_questions_age_sooner(spark):
    asked = spark.createDataFrame([(1, "m", "最近有沒有新聞"), (2, "m", "評價如何")], "entity_id long, search_mode string, question string")
    found = spark.createDataFrame([(1, 9), (2, 9)], "entity_id long, cached_sources long")
    shots = spark.sql("SELECT * FROM VALUES (1L, 'm', 1L, TIMESTAMP_NTZ '2024-01-01 00:00:00', 9L), (2L, 'm', 2L, TIMESTAMP_NTZ '2024-01-01 00:00:00', 9L) AS t(entity_id, search_mode, query_id, created_at, source_count)")
    out = freshness.cache_decision(asked, found, shots, "2024-01-02 12:00:00", max_age_hours=freshness.max_age(F.col("question")))
    assert {r.entity_id: r.reason for r in out.collect()} == {1: "stale_snapshot", 2: "fresh_snapshot"}
