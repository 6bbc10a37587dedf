"""Registered queries over tables that are written, merged and read again: stores by key, streams, ids, runs and work queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import names
from attesta.operators import ids, queue, store, tables
from attesta.plans import refresh, search
from attesta.queries import AS_OF, query
from attesta.sources import payloads
from attesta.streaming import streams

#: Buckets of the tables that the queries write: few, as the given tables are small.
BUCKETS = 16


def _folder(df, name: str) -> str:
    return store.new_folder(df.sparkSession, name)


_SOURCE_ROWS = """,,
x AS (SELECT CASE WHEN ord % 7 = 0 THEN concat(' ', url) WHEN ord % 29 = 0 THEN '' ELSE concat(url, '/', CAST(ord % 2 AS STRING)) END AS u, CASE WHEN ord % 3 = 0 THEN '' ELSE title END AS title, CASE WHEN ord % 5 = 0 THEN NULL ELSE source END AS s,
  CASE ord % 4 WHEN 0 THEN 'other' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE lang END AS t, CASE WHEN ord % 2 = 0 THEN NULL ELSE CAST(ord AS STRING) END AS published_at, ord % 3 AS b, ord FROM v_results),
y AS (SELECT trim(u) AS url, regexp_extract(trim(u), '^https://([^/]*)', 1) AS domain, title, published_at, b, ord, coalesce(nullif(s, ''), regexp_extract(trim(u), '^https://([^/]*)', 1)) AS site_name, coalesce(nullif(t, ''), 'other') AS source_type FROM x WHERE trim(u) <> '')"""


def _source_rows(v):
    o = F.col("ord")
    return v("v_results").select(
        F.when(o % 7 == 0, F.concat(F.lit(" "), "url")).when(o % 29 == 0, "").otherwise(F.concat("url", F.lit("/"), (o % 2).cast("string"))).alias("url"),
        F.when(o % 3 == 0, "").otherwise(F.col("title")).alias("title"), F.when(o % 5 != 0, F.col("source")).alias("site_name"),
        F.when(o % 4 == 0, "other").when(o % 4 == 1, "").when(o % 4 == 3, F.col("lang")).alias("source_type"), F.when(o % 2 == 1, o.cast("string")).alias("published_at"), "ord",
    )


@query(
    _SOURCE_ROWS
    + """
SELECT url, domain, arg_max(title, (b, ord)) FILTER (coalesce(title, '') <> '') AS title, arg_max(site_name, (b, ord)) FILTER (site_name <> '') AS site_name,
  arg_max(source_type, (b, ord)) AS source_type, arg_max(published_at, (b, ord)) FILTER (published_at IS NOT NULL) AS published_at FROM y GROUP BY url, domain""",
    "v_results",
)
def replayed_stream(v, t):
    """Sources upserted in three batches, two of which are sent again."""
    rows = _source_rows(v)
    path = _folder(rows, "replayed-stream")
    for i in (0, 1, 0, 1, 2):
        streams.upsert_batch(rows.where(F.col("ord") % 3 == i), i, path, ["title", "site_name", "source_type"], ["published_at"], BUCKETS)
    return store.read_table(rows.sparkSession, path)


@query(
    _SOURCE_ROWS
    + """, z AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY b = 2 DESC, ord DESC) AS k FROM y WHERE b < 2 OR ord % 50 = 2)
SELECT url, title, site_name, source_type, published_at, ord FROM z WHERE k = 1""",
    "v_results",
)
def merge_sources(v, t):
    """A table by url, into which a few newer rows are merged in place of those of their urls."""
    r = _source_rows(v).withColumn("url", F.trim("url")).where("url <> ''")
    host = F.regexp_extract("url", "^https://([^/]*)", 1)
    r = r.withColumns({"site_name": F.coalesce(F.nullif("site_name", F.lit("")), host), "source_type": F.coalesce(F.nullif("source_type", F.lit("")), F.lit("other"))})
    once = lambda df: df.groupBy("url").agg(F.max_by(F.struct(*(c for c in r.columns if c != "url")), "ord").alias("b")).select("url", "b.*")
    path = _folder(r, "merge-sources")
    store.write_table(once(r.where("ord % 3 < 2")), path, ["url"], BUCKETS)
    store.merge_table(once(r.where("ord % 3 = 2 and ord % 50 = 2")), path)
    return store.read_table(r.sparkSession, path)


@query(
    """,,
x AS (SELECT review_id, entity, platform, CAST(review_id % 7 AS STRING) AS author, trim(content) AS content, review_id % 3 AS b FROM v_reviews),
h AS (SELECT *, md5(concat_ws(':', entity, platform, author, substring(content, 1, 200))) AS content_hash FROM x WHERE content <> ''),
f AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY b, review_id) AS k FROM h)
SELECT review_id, entity, platform, author, content_hash, CAST(b AS INT) AS batch_id FROM f WHERE k = 1""",
    "v_reviews",
)
def streamed_reviews(v, t):
    """Reviews ingested in three batches against an index of hashes behind Bloom filters; one batch is sent again."""
    r = v("v_reviews").select("review_id", "entity", "platform", (F.col("review_id") % 7).cast("string").alias("author"), "content")
    path = _folder(r, "streamed-reviews")
    for i in (0, 1, 1, 2):
        streams.ingest_batch(r.where(F.col("review_id") % 3 == i), i, path, BUCKETS)
    return streams.read_reviews(r.sparkSession, path).select("review_id", "entity", "platform", "author", "content_hash", F.col("batch_id").cast("int").alias("batch_id"))


@query(
    """,,
r AS (SELECT review_id, user_id, score FROM (SELECT *, row_number() OVER (PARTITION BY review_id, user_id ORDER BY ts DESC, event_id DESC) AS k FROM v_rating_events WHERE score BETWEEN 1 AND 5) WHERE k = 1)
SELECT review_id, CAST(sum(score) AS DOUBLE) / count(*) AS average, count(*) AS ratings FROM r GROUP BY review_id""",
    "v_rating_events",
)
def streamed_ratings(v, t):
    """Summaries of ratings kept by differences over four batches; one is sent again."""
    e = v("v_rating_events")
    path = _folder(e, "streamed-ratings")
    for i in (0, 1, 2, 2, 3):
        streams.rating_batch(e.where(F.col("event_id") % 4 == i), i, path, BUCKETS)
    return streams.read_rating_summary(e.sparkSession, path)


@query(
    """,,
h AS (SELECT entity_id, search_mode, sha256(CAST(to_json({'question': question, 'part': CAST(confidence % 10 AS STRING)}) AS VARCHAR)) AS snapshot_hash, created_at, query_id FROM v_queries),
g AS (SELECT entity_id, search_mode, snapshot_hash, min((created_at, query_id)) AS a, max((created_at, query_id)) AS z, max(created_at) AS generated_at FROM h GROUP BY 1, 2, 3)
SELECT entity_id, search_mode, snapshot_hash, CAST(row_number() OVER (PARTITION BY entity_id, search_mode ORDER BY a) AS INT) AS version, generated_at,
  row_number() OVER (PARTITION BY entity_id, search_mode ORDER BY z DESC) = 1 AS is_latest FROM g""",
    "v_queries",
)
def stored_snapshots(v, t):
    """Versions from three parts of the events, one after the other against what is stored."""
    q = v("v_queries").withColumn("part", (F.col("confidence") % 10).cast("string"))
    path = _folder(q, "stored-snapshots")
    for i in (2, 0, 0, 1):
        tables.save_snapshots(q.where(F.col("query_id") % 3 == i), path, ["question", "part"], None, BUCKETS)
    rows = store.read_table(q.sparkSession, path)
    return rows.select("entity_id", "search_mode", "snapshot_hash", "version", F.col("last.created_at").alias("generated_at"), "is_latest")


@query(
    """,,
e AS (SELECT entity_id, name, concat('al', CAST(entity_id AS STRING)) AS own FROM v_watchlist WHERE entity_id % 2 = 0),
n AS (SELECT DISTINCT w.name, CASE WHEN o.query_id % 4 = 0 THEN concat(' ', w.name) WHEN o.query_id % 4 = 1 THEN concat('al', CAST(w.entity_id AS STRING)) ELSE w.name END AS asked, concat(o.question, '/', CAST(o.query_id % 3 AS STRING)) AS alias
  FROM v_queries o JOIN v_watchlist w ON w.entity_id = o.entity_id),
k AS (SELECT DISTINCT trim(asked) AS label FROM n), m AS (SELECT max(entity_id) AS top FROM e),
d AS (SELECT label, coalesce(e1.entity_id, e2.entity_id) AS old FROM k LEFT JOIN e e1 ON e1.name = k.label LEFT JOIN e e2 ON e2.own = k.label),
i AS (SELECT label, CASE WHEN old IS NULL THEN top + row_number() OVER (PARTITION BY old IS NULL ORDER BY label) ELSE old END AS entity_id, old IS NULL AS fresh FROM d, m),
a AS (SELECT DISTINCT i.entity_id, n.alias FROM n JOIN i ON i.label = trim(n.asked) UNION SELECT entity_id, own FROM e),
p AS (SELECT entity_id, name FROM e UNION ALL SELECT entity_id, label FROM i WHERE fresh)
SELECT p.entity_id, p.name, coalesce(string_agg(a.alias, '|' ORDER BY a.alias) FILTER (a.alias <> p.name), '') AS aliases FROM p LEFT JOIN a ON a.entity_id = p.entity_id GROUP BY 1, 2""",
    "v_watchlist",
    "v_queries",
)
def register_names(v, t):
    """Aliases registered by names, half of which become new entities with the ids after the largest one."""
    w = v("v_watchlist")
    e = w.where("entity_id % 2 = 0").select("entity_id", "name", F.array(F.concat(F.lit("al"), F.col("entity_id").cast("string"))).alias("aliases"))
    q = v("v_queries").join(w.select("entity_id", "name").hint("merge"), "entity_id")
    asked = F.when(F.col("query_id") % 4 == 0, F.concat(F.lit(" "), "name")).when(F.col("query_id") % 4 == 1, F.concat(F.lit("al"), F.col("entity_id").cast("string"))).otherwise(F.col("name"))
    rows = q.select(asked.alias("canonical_name"), F.concat("question", F.lit("/"), (F.col("query_id") % 3).cast("string")).alias("alias")).distinct()
    none = w.sparkSession.createDataFrame([], "entity_id long, keyword string, is_active boolean")
    return ids.register_names(e, none, rows).select("entity_id", "name", F.array_join("aliases", "|").alias("aliases"))


_TO_LABEL = """,,
n AS (SELECT review_id, entity, platform, substring(content, 1, 90) AS parent_title, content, row_number() OVER (ORDER BY entity, review_id) - 1 AS k FROM v_reviews WHERE relevance_score IS NULL),
g AS (SELECT review_id, entity, platform, substring(content, 1, 90) AS parent_title, content, row_number() OVER (ORDER BY review_id) - 1 AS k FROM v_reviews WHERE relevance_score >= 0.6 AND content_type = 'review')
SELECT 'label' AS kind, review_id, CAST(floor(k / 40) AS BIGINT) AS batch, CAST(k % 40 AS INT) AS place, concat('目標組織：', entity, chr(10), '來源平台：', platform, chr(10), '標題：', substring(parent_title, 1, 100), chr(10), '內容：', substring(content, 1, 600)) AS message FROM n
UNION ALL SELECT 'dimension', review_id, CAST(floor(k / 30) AS BIGINT), CAST(k % 30 AS INT), concat('組織：', entity, chr(10), '平台：', platform, chr(10), '標題：', substring(parent_title, 1, 80), chr(10), '內容：', substring(content, 1, 600)) FROM g"""


@query(_TO_LABEL, "v_reviews")
def label_batches(v, t):
    """Every review that has no labels in one batch of 40 messages, every relevant one in one of 30 for its dimensions."""
    r = v("v_reviews").withColumns({"parent_title": F.substring("content", 1, 90), "analyzed_at": F.col("relevance_score"), "dimensions_classified_at": F.lit(None).cast("string")})
    parts = [("label", queue.to_label(r), ["entity", "review_id"], queue.LABEL_BATCH), ("dimension", queue.to_tag(r), ["review_id"], queue.DIMENSION_BATCH)]
    made = [queue.batches(rows, order, size).select(F.lit(kind).alias("kind"), "review_id", "batch", "place", "message") for kind, rows, order, size in parts]
    return made[0].unionByName(made[1])


@query(
    """,,
n AS (SELECT review_id FROM v_reviews WHERE relevance_score IS NULL),
a AS (SELECT review_id FROM n ORDER BY review_id LIMIT 200), b AS (SELECT review_id FROM n WHERE review_id NOT IN (SELECT review_id FROM a) ORDER BY review_id LIMIT 100)
SELECT review_id, 'first' AS run_id FROM a UNION ALL SELECT review_id, 'second' FROM b UNION ALL SELECT review_id, 'third' FROM n WHERE review_id NOT IN (SELECT review_id FROM a UNION SELECT review_id FROM b)""",
    "v_reviews",
)
def claimed_reviews(v, t):
    """What three runs may label: the second and third get what those before have not claimed."""
    r = queue.to_label(v("v_reviews").withColumns({"parent_title": F.lit(""), "analyzed_at": F.col("relevance_score")}))
    path, out = _folder(r, "claims"), None
    for run_id, limit in (("first", 200), ("second", 100), ("first", 200), ("third", None)):
        queue.claim(r, path, run_id, AS_OF, 6, limit, BUCKETS)
    out = store.read_table(r.sparkSession, path)
    return out.select("review_id", "run_id")


_REFRESH = f""",,
w AS (SELECT entity_id, name, CASE entity_id % 3 WHEN 0 THEN 'zoo' WHEN 1 THEN 'shelter' ELSE 'shop' END AS entity_type, CASE WHEN entity_id % 5 = 4 THEN 'weird' ELSE 'general' END AS default_mode, entity_id % 4 <> 3 AS is_active, priority,
  CASE WHEN entity_id % 7 = 0 THEN TIMESTAMP '2999-01-01' END AS next_crawl_at FROM v_watchlist),
d AS (SELECT * FROM w WHERE is_active AND (next_crawl_at IS NULL OR next_crawl_at <= TIMESTAMP '{AS_OF}') AND entity_type IN ('zoo', 'shelter') ORDER BY priority, name LIMIT 400),
p AS (SELECT d.entity_id, x.pos FROM d, (SELECT unnest([0, 1]) AS pos) x WHERE d.default_mode = 'general'),
f AS (SELECT DISTINCT 1 + CAST(floor(doc_id / 10) AS BIGINT) AS entity_id, doc_id % 3 AS pos FROM documents WHERE doc_id % 37 > 9),
c AS (SELECT p.entity_id, count(f.pos) AS answered, count(*) - count(f.pos) AS unanswered FROM p LEFT JOIN f ON f.entity_id = p.entity_id AND f.pos = p.pos GROUP BY 1)
SELECT d.entity_id, CASE WHEN d.default_mode <> 'general' THEN 'skipped' WHEN c.unanswered > 0 THEN 'failed' ELSE 'success' END AS status, coalesce(c.answered, 0) AS answered, coalesce(c.unanswered, 0) AS unanswered,
  (d.default_mode <> 'general')::INT AS invalid_modes FROM d LEFT JOIN c ON c.entity_id = d.entity_id"""


@query(_REFRESH, "v_watchlist")
def refresh_run(v, t):
    """Outcomes of one run over what is due: questions asked, answered from documents, and published with cards, snapshots and suggestions."""
    i = F.col("entity_id")
    w = v("v_watchlist").select(
        "entity_id", "name", F.when(i % 3 == 0, "zoo").when(i % 3 == 1, "shelter").otherwise("shop").alias("entity_type"), F.when(i % 5 == 4, "weird").otherwise("general").alias("default_mode"), (i % 4 != 3).alias("is_active"),
        "priority", F.lit(24).alias("refresh_interval_hours"), F.when(i % 7 == 0, F.lit("2999-01-01").cast("timestamp_ntz")).alias("next_crawl_at"), F.lit(None).cast("string").alias("last_error_message"),
    )
    spark = w.sparkSession
    templates = spark.createDataFrame([(kind, "general", p, f"question {p}") for kind in ("zoo", "shelter") for p in range(3)], "entity_type string, search_mode string, pos int, question string")
    k = F.col("doc_id")
    results = t("documents").where(k % 37 > 9).select(
        (1 + F.floor(k / 10)).alias("entity_id"), F.lit("general").alias("search_mode"), (k % 3).cast("int").alias("pos"), k.alias("ord"), F.concat(F.lit("https://n.example/"), k.cast("string")).alias("url"),
        F.concat(F.lit("A title of page "), k.cast("string")).alias("title"), F.concat(F.lit("long enough text: "), F.substring("text", 1, 2000)).alias("content"), "source", F.lit("1998-01-01").alias("published_date"),
    )
    asked = v("v_queries").select("entity_id", F.lit("general").alias("search_mode"), "query_id", "question")
    terms = search.SearchTerms(entity=("the",), login=(), no_results=())
    done = refresh.run_refresh(_folder(w, "refresh"), "run", w, templates, asked, results, terms, AS_OF, ["zoo", "shelter"], due_limit=400)
    return done["outcomes"].select("entity_id", "status", "answered", "unanswered", "invalid_modes")


@query(
    """,,
e AS (SELECT name, CASE entity_id % 4 WHEN 0 THEN concat(name, '協會') WHEN 1 THEN concat(' ', name, '狗園') WHEN 2 THEN concat(name, '樂園') ELSE name END AS n, CASE WHEN entity_id % 2 = 0 THEN '募資 透明' ELSE 'x' END AS q FROM v_watchlist)
SELECT name, array_to_string(CASE WHEN ends_with(n, '協會') OR ends_with(n, '狗園') OR ends_with(n, '樂園') THEN [trim(n), substring(trim(n), 1, length(trim(n)) - 2)] ELSE [n] END, '|') AS exact,
  array_to_string(CASE WHEN ends_with(n, '狗園') THEN [lower(trim(n)), lower(name || '寵物樂園'), lower(name || '樂園'), lower(name || '園區')] WHEN ends_with(n, '樂園') THEN [lower(n), lower(name || '狗園'), lower(name || '寵物樂園')] ELSE [lower(n)] END, '|') AS variants,
  array_to_string(list_concat(list_concat(CASE WHEN ends_with(n, '協會') OR ends_with(n, '狗園') OR ends_with(n, '樂園') THEN [trim(n), substring(trim(n), 1, length(trim(n)) - 2)] ELSE [n] END, CASE WHEN q = 'x' THEN [] ELSE ['募資', '透明'] END),
    ['page', 'a.example', 'two words'[1:3], 'words']), '|') AS terms FROM e""",
    "v_watchlist",
)
def name_terms(v, t):
    i = F.col("entity_id")
    e = v("v_watchlist").withColumn("n", F.when(i % 4 == 0, F.concat("name", F.lit("協會"))).when(i % 4 == 1, F.concat(F.lit(" "), "name", F.lit("狗園"))).when(i % 4 == 2, F.concat("name", F.lit("樂園"))).otherwise(F.col("name")))
    q = F.when(i % 2 == 0, "募資 透明").otherwise("x")
    asked = F.array(F.lit("page site:a.example y"), F.lit('"two words"'))
    lists = {"exact": names.exact_terms(F.col("n")), "variants": names.analysis_variants(F.col("n")), "terms": names.cached_terms(F.col("n"), q, asked)}
    return e.select("name", *(F.array_join(c, "|").alias(k) for k, c in lists.items()))


@query(
    r"""SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]+name="description"[^>]*content="([^"]{20,})"', 1), ''), '') AS description, len(regexp_extract_all(html, '(?i)<img\b')) > 0 AS has_image FROM
 (SELECT page_id, concat('<meta name="description" content="about page ', CAST(page_id AS STRING), ' in one sentence">', CASE WHEN page_id % 3 = 0 THEN '<img src="/i/1.png">' ELSE '' END, html) AS html FROM pages)"""
)
def page_descriptions(v, t):
    """Descriptions from meta tags, and whether a page shows an image, over pages that are given both."""
    i = F.col("page_id").cast("string")
    html = F.concat(F.lit('<meta name="description" content="about page '), i, F.lit(' in one sentence">'), F.when(F.col("page_id") % 3 == 0, '<img src="/i/1.png">').otherwise(""), F.col("html"))
    found = payloads.page_metadata(t("pages").withColumn("html", html), normalize=False)
    return found.select("page_id", "description", (F.size("images") > 0).alias("has_image"))
