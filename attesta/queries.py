"""The registered queries over the driver's tables, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.bindings import table, view
from attesta.bindings import with_views as W
from attesta.functions import classify as C
from attesta.functions import names
from attesta.operators import dedup, joins, metrics, rank, tables
from attesta.plans import analysis, freshness, search
from attesta.sources import payloads

AS_OF = "1998-08-02 00:00:00"
QUERIES, ORACLES = {}, {}


def query(sql: str | None = None, *views: str):
    """Register a function of (v, t): v(name) gives a bound view, t(name) a table."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda n: view(spark, sf_dir, n), lambda n: table(spark, sf_dir, n))
        if sql:
            ORACLES[f.__name__] = W(sql, *views) if views else sql
        return f

    return add


LATEST_RATINGS = """,,
r AS (SELECT review_id, user_id, score FROM (SELECT *, row_number() OVER (PARTITION BY review_id, user_id ORDER BY ts DESC, event_id DESC) AS k
  FROM v_rating_events WHERE score BETWEEN 1 AND 5) WHERE k = 1)"""


@query(
    LATEST_RATINGS
    + """, a AS (SELECT v.entity, v.stance, r.s / r.n AS avg_score, r.n FROM v_reviews v
    JOIN (SELECT review_id, CAST(sum(score) AS DOUBLE) AS s, count(*) AS n FROM r GROUP BY review_id) r ON r.review_id = v.review_id
    WHERE v.content_type IS NULL OR v.content_type = 'review'),
e AS (SELECT entity, count(*) AS reviews_rated, CAST(sum(n) AS BIGINT) AS total_ratings,
  coalesce(sum(avg_score) FILTER (stance = 'supporting'), 0) AS sw, coalesce(sum(avg_score) FILTER (stance = 'opposing'), 0) AS ow,
  coalesce(sum(avg_score * 0.5) FILTER (stance = 'neutral'), 0) AS nw FROM a GROUP BY entity),
f AS (SELECT *, CASE WHEN sw + ow + nw > 0 THEN round(((sw + nw * 0.5) / (sw + ow + nw) * 100 * reviews_rated + 50 * greatest(0, 5 - reviews_rated) * 10)
  / (reviews_rated + greatest(0, 5 - reviews_rated) * 10), 1) END AS score FROM e)
SELECT entity, reviews_rated, total_ratings, round(sw, 2) AS supporting_weight, round(ow, 2) AS opposing_weight, round(nw, 2) AS neutral_weight, score,
  CASE WHEN score >= 75 THEN 'high' WHEN score >= 55 THEN 'mid' WHEN score >= 35 THEN 'low' WHEN score IS NOT NULL THEN 'critical' END AS band FROM f""",
    "v_reviews",
    "v_rating_events",
)
def public_credibility(v, t):
    return metrics.public_credibility(v("v_reviews"), metrics.latest_ratings(v("v_rating_events")))


@query(LATEST_RATINGS + "\nSELECT review_id, CAST(sum(score) AS DOUBLE) / count(*) AS average, count(*) AS ratings, max(CASE WHEN user_id = 7 THEN score END) AS my_score FROM r GROUP BY review_id", "v_rating_events")
def rating_summary(v, t):
    return metrics.rating_summary(metrics.latest_ratings(v("v_rating_events")), 7)


@query(
    """SELECT q.entity_id, count(DISTINCT q.query_id) AS total_queries, count(DISTINCT c.source_id) AS total_sources,
  CAST(coalesce(round(avg(q.confidence)), 0) AS BIGINT) AS average_confidence, CAST(coalesce(round(avg(c.credibility)), 0) AS BIGINT) AS average_credibility
FROM v_queries q LEFT JOIN v_cards c ON c.query_id = q.query_id GROUP BY q.entity_id""",
    "v_queries",
    "v_cards",
)
def entity_profile(v, t):
    return metrics.entity_profile(v("v_queries"), v("v_cards"))


@query(
    """SELECT q.entity_id, s.source_type, count(*) AS n FROM v_cards c JOIN v_sources s ON s.source_id = c.source_id JOIN v_queries q ON q.query_id = c.query_id
GROUP BY q.entity_id, s.source_type""",
    "v_queries",
    "v_cards",
    "v_sources",
)
def source_breakdown(v, t):
    return metrics.source_breakdown(v("v_queries"), v("v_cards"), v("v_sources"))


@query(
    """,,
p AS (SELECT q.entity_id, count(DISTINCT q.query_id) AS q, count(DISTINCT c.source_id) AS s FROM v_queries q LEFT JOIN v_cards c ON c.query_id = q.query_id GROUP BY 1)
SELECT w.entity_id, w.name, coalesce(p.q, 0) AS total_queries, coalesce(p.s, 0) AS total_sources FROM v_watchlist w LEFT JOIN p ON p.entity_id = w.entity_id
 WHERE contains(lower(concat(w.name, ' ', w.entity_type, ' x', CAST(w.entity_id % 10 AS STRING))), 'ing x') ORDER BY 3 DESC, w.last_at DESC NULLS LAST, w.name LIMIT 50""",
    "v_watchlist",
    "v_queries",
    "v_cards",
)
def entity_list(v, t):
    """Entities whose name or aliases hold the text, over the gap between two aliases too."""
    e = v("v_watchlist").withColumn("aliases", F.array("entity_type", F.concat(F.lit("x"), (F.col("entity_id") % 10).cast("string"))))
    return metrics.entity_list(e, v("v_queries"), v("v_cards"), 50, " ING x ")


@query(
    """SELECT entity_id, query_id, question, confidence, rank FROM (SELECT entity_id, query_id, question, coalesce(confidence, 0) AS confidence,
 CAST(row_number() OVER (PARTITION BY entity_id ORDER BY created_at DESC, query_id DESC) AS INT) AS rank FROM v_queries) WHERE rank <= 5""",
    "v_queries",
)
def recent_queries(v, t):
    return rank.recent_queries(v("v_queries")).select("entity_id", "query_id", "question", "confidence", "rank")


@query(
    """SELECT entity_id, search_mode, query_id, created_at, confidence FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, search_mode
 ORDER BY created_at DESC, query_id DESC) AS k FROM v_queries) WHERE k = 1""",
    "v_queries",
)
def latest_snapshot(v, t):
    return rank.latest_snapshot(v("v_queries")).select("entity_id", "search_mode", "query_id", "created_at", "confidence")


@query(
    f""",,
f AS (SELECT entity_id, lower(trim(question)) AS question, search_mode, max(query_id) AS query_id FROM v_queries
  WHERE created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 8760 HOUR AND created_at <= TIMESTAMP '{AS_OF}' AND query_id % 5 <> 0 GROUP BY 1, 2, 3),
a AS (SELECT DISTINCT entity_id, lower(trim(question)) AS question, search_mode FROM v_queries)
SELECT a.entity_id, a.question, a.search_mode, f.query_id FROM a LEFT JOIN f ON f.entity_id = a.entity_id AND f.question = a.question AND f.search_mode = a.search_mode""",
    "v_queries",
)
def exact_cache_hit(v, t):
    """Every fifth query has no summary yet."""
    q = v("v_queries")
    return rank.exact_cache_hit(q, q, q.where("query_id % 5 <> 0"), AS_OF, 8760)


@query(
    f""",,
c AS (SELECT q.entity_id, count(DISTINCT c.source_id) AS n FROM v_queries q JOIN v_cards c ON c.query_id = q.query_id GROUP BY 1),
s AS (SELECT * FROM (SELECT entity_id, search_mode, created_at, source_count, row_number() OVER (PARTITION BY entity_id, search_mode ORDER BY created_at DESC, query_id DESC) AS k
  FROM (SELECT q.*, (SELECT count(*) FROM v_cards x WHERE x.query_id = q.query_id) AS source_count FROM v_queries q)) WHERE k = 1),
m AS (SELECT entity_id, unnest(['F', 'O', 'P']) AS search_mode FROM v_watchlist)
SELECT m.entity_id, m.search_mode, CASE WHEN coalesce(c.n, 0) < 4 THEN 'insufficient_cached_sources' WHEN s.source_count IS NULL THEN 'missing_snapshot'
  WHEN s.source_count < 4 THEN 'insufficient_snapshot_sources' WHEN s.created_at IS NULL THEN 'snapshot_age_unknown'
  WHEN date_diff('second', s.created_at, TIMESTAMP '{AS_OF}') / 3600.0 > 8760 THEN 'stale_snapshot' ELSE 'fresh_snapshot' END AS reason
FROM m LEFT JOIN c ON c.entity_id = m.entity_id LEFT JOIN s ON s.entity_id = m.entity_id AND s.search_mode = m.search_mode""",
    "v_queries",
    "v_cards",
    "v_watchlist",
)
def cache_decision(v, t):
    queries, cards = v("v_queries"), v("v_cards")
    cached = queries.join(cards, "query_id").groupBy("entity_id").agg(F.countDistinct("source_id").alias("cached_sources"))
    counted = queries.join(cards.groupBy("query_id").agg(F.count("*").alias("source_count")), "query_id", "left").fillna(0, ["source_count"])
    requests = v("v_watchlist").select("entity_id", F.explode(F.array(*map(F.lit, "FOP"))).alias("search_mode"))
    return freshness.cache_decision(requests, cached.hint("merge"), counted, AS_OF, max_age_hours=8760)


@query(
    f"""SELECT entity_id, name, priority FROM v_watchlist WHERE entity_type IN ('BUILDING', 'MACHINERY')
 AND (last_at IS NULL OR CAST(last_at AS DATE) + 90 <= DATE '{AS_OF[:10]}') ORDER BY priority, name LIMIT 200""",
    "v_watchlist",
)
def due_watchlist(v, t):
    return joins.due_watchlist(v("v_watchlist"), AS_OF[:10], 90, ["BUILDING", "MACHINERY"], 200)


@query("SELECT platform, count(*) AS n FROM v_reviews WHERE relevance_score >= 0.6 AND content_type = 'review' GROUP BY platform", "v_reviews")
def review_stats(v, t):
    return metrics.review_stats(v("v_reviews"))


@query(
    """,,
d AS (SELECT *, CASE WHEN review_id % 3 <> 0 THEN concat('2024-0', CAST(1 + review_id % 9 AS STRING), '-01') END AS published_at FROM v_reviews)
SELECT entity, review_id, relevance_score, published_at, rank FROM (SELECT entity, review_id, relevance_score, published_at, CAST(row_number() OVER (PARTITION BY entity
 ORDER BY CASE WHEN relevance_score IS NULL THEN 0.5 ELSE relevance_score END DESC, published_at DESC NULLS LAST, review_id DESC) AS INT) AS rank FROM d) WHERE rank BETWEEN 11 AND 30""",
    "v_reviews",
)
def list_reviews(v, t):
    at = F.when(F.col("review_id") % 3 != 0, F.concat(F.lit("2024-0"), (1 + F.col("review_id") % 9).cast("string"), F.lit("-01")))
    return rank.list_reviews(v("v_reviews").withColumn("published_at", at), 20, 10).select("entity", "review_id", "relevance_score", "published_at", "rank")


@query(
    """SELECT CASE WHEN relevance_score >= 0.6 THEN 'relevant' WHEN relevance_score >= 0.3 THEN 'borderline' ELSE 'noise' END AS tier, stance, content_type,
 count(*) AS n FROM v_reviews WHERE relevance_score IS NOT NULL GROUP BY 1, 2, 3""",
    "v_reviews",
)
def label_stats(v, t):
    return metrics.label_stats(v("v_reviews"))


@query(
    r"""SELECT platform, count(*) AS n FROM v_reviews WHERE length(trim(content)) < 6 OR regexp_matches(trim(content), '^[\d,]+$')
 OR regexp_matches(trim(content), '^[^\p{L}\p{Nl}\p{No}_]+$') OR content IS NULL GROUP BY platform""",
    "v_reviews",
)
def junk_reviews(v, t):
    return v("v_reviews").where(C.is_junk(F.col("content"))).groupBy("platform").agg(F.count("*").alias("n"))


@query(
    """SELECT entity_name, count(*) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes, count(*) FILTER (media_type = 'image') AS images,
 count(*) FILTER (media_type = 'video') AS videos FROM v_media GROUP BY entity_name""",
    "v_media",
)
def media_stats(v, t):
    return metrics.media_stats(v("v_media"))


@query(
    """SELECT review_id, comment_no, CASE WHEN is_anonymous THEN 'anonymous' ELSE CASE user_role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Helper' ELSE 'user' END END AS shown_name,
 comment FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY comment_no) AS k FROM v_comments) WHERE k <= 50""",
    "v_comments",
)
def review_comments(v, t):
    comments = v("v_comments")
    users = comments.sparkSession.createDataFrame([("user", "User"), ("assistant", "Helper"), ("system", "")], "user_role string, display_name string")
    return joins.review_comments(comments, users, 50)


_BLANK = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(12288), chr(160))"


def _greedy(rows: str) -> str:
    """SQL: keep-first over rows (query_key, ord, url, title), one row of each query at a time, as the table `u` (query_key, ord)."""
    return f""",
x AS (SELECT query_key, ord, trim(url) AS url, lower(trim(coalesce(title, ''), {_BLANK})) AS t, row_number() OVER (PARTITION BY query_key ORDER BY ord) AS i FROM {rows} WHERE trim(coalesce(url, '')) <> ''),
y AS (SELECT *, CASE WHEN t <> '' THEN concat(lower(regexp_extract(url, '^[a-zA-Z]+://([^/]*)', 1)), '|', substring(t, 1, 80)) END AS sig FROM x),
g AS (SELECT DISTINCT query_key, CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS sigs, CAST([] AS BIGINT[]) AS ords FROM y
  UNION ALL SELECT g.query_key, g.i + 1, CASE WHEN z.ok THEN list_append(g.urls, z.url) ELSE g.urls END, CASE WHEN z.ok AND z.sig IS NOT NULL THEN list_append(g.sigs, z.sig) ELSE g.sigs END, CASE WHEN z.ok THEN list_append(g.ords, z.ord) ELSE g.ords END
  FROM g JOIN (SELECT g2.query_key AS q, g2.i AS j, y.url, y.sig, y.ord, NOT list_contains(g2.urls, y.url) AND (y.sig IS NULL OR NOT list_contains(g2.sigs, y.sig)) AS ok FROM g AS g2 JOIN y ON y.query_key = g2.query_key AND y.i = g2.i + 1) z ON z.q = g.query_key AND z.j = g.i),
u AS (SELECT query_key, unnest(ords) AS ord FROM g WHERE i = (SELECT max(i) FROM y WHERE y.query_key = g.query_key))"""


@query(",," + _greedy("v_results").lstrip(",") + "\nSELECT r.query_key, r.ord, r.url, r.title FROM v_results r JOIN u ON u.query_key = r.query_key AND u.ord = r.ord", "v_results")
def dedup_results(v, t):
    return dedup.dedup_results(v("v_results")).select("query_key", "ord", "url", "title")


@query(
    """,,
x AS (SELECT review_id, entity, platform, CAST(review_id % 7 AS STRING) AS author, trim(content) AS content FROM v_reviews),
h AS (SELECT *, md5(concat_ws(':', entity, platform, author, substring(content, 1, 200))) AS content_hash FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY review_id) AS k FROM h WHERE content <> '' AND review_id % 2 = 1)
SELECT review_id, entity, platform, author, content_hash FROM f WHERE k = 1 AND content_hash NOT IN (SELECT content_hash FROM h WHERE review_id % 2 = 0 AND content <> '')""",
    "v_reviews",
)
def ingest_reviews(v, t):
    rows = v("v_reviews").select("review_id", "entity", "platform", (F.col("review_id") % 7).cast("string").alias("author"), F.trim("content").alias("content"))
    old = rows.where("review_id % 2 = 0 and content <> ''").withColumn("content_hash", tables.review_hash())
    return tables.ingest_reviews(old, rows.where("review_id % 2 = 1")).select("review_id", "entity", "platform", "author", "content_hash")


@query(
    """,,
x AS (SELECT CASE WHEN ord % 7 = 0 AND ord % 2 = 1 THEN concat(' ', url) ELSE url END AS u, CASE WHEN ord % 3 = 0 THEN '' ELSE title END AS title, CASE WHEN ord % 5 = 0 THEN NULL ELSE source END AS s,
  CASE ord % 4 WHEN 0 THEN 'other' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE lang END AS t, CASE WHEN ord % 2 = 0 THEN NULL ELSE CAST(ord AS STRING) END AS published_at, ord % 2 AS b, ord FROM v_results),
y AS (SELECT CASE WHEN b = 1 THEN trim(u) ELSE u END AS url, regexp_extract(u, '^ ?https://([^/]*)', 1) AS domain, title, published_at, b, ord,
  CASE WHEN b = 1 THEN coalesce(nullif(s, ''), regexp_extract(u, '^ ?https://([^/]*)', 1)) ELSE s END AS site_name, CASE WHEN b = 1 THEN coalesce(nullif(t, ''), 'other') ELSE t END AS source_type FROM x)
SELECT url, domain, arg_max(title, (b, ord)) FILTER (coalesce(title, '') <> '') AS title, arg_max(site_name, (b, ord)) FILTER (coalesce(site_name, '') <> '') AS site_name,
  arg_max(source_type, (b, ord)) FILTER (coalesce(source_type, '') <> '') AS source_type, arg_max(published_at, (b, ord)) FILTER (published_at IS NOT NULL) AS published_at FROM y GROUP BY url, domain""",
    "v_results",
)
def upsert_sources(v, t):
    o = F.col("ord")
    rows = v("v_results").select(
        F.when((o % 7 == 0) & (o % 2 == 1), F.concat(F.lit(" "), "url")).otherwise(F.col("url")).alias("url"),
        F.when(o % 3 == 0, "").otherwise(F.col("title")).alias("title"),
        F.when(o % 5 != 0, F.col("source")).alias("site_name"),
        F.when(o % 4 == 0, "other").when(o % 4 == 1, "").when(o % 4 == 3, F.col("lang")).alias("source_type"),
        F.when(o % 2 == 1, o.cast("string")).alias("published_at"),
        "ord",
    )
    return tables.upsert_sources(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1"), ["title", "site_name", "source_type"], ["published_at"])


@query(
    """,,
h AS (SELECT entity_id, search_mode, sha256(CAST(to_json({'question': question, 'part': CAST(confidence % 10 AS STRING)}) AS VARCHAR)) AS snapshot_hash, created_at, query_id FROM v_queries),
g AS (SELECT entity_id, search_mode, snapshot_hash, min((created_at, query_id)) AS a, max((created_at, query_id)) AS z, max(created_at) AS generated_at FROM h GROUP BY 1, 2, 3)
SELECT entity_id, search_mode, snapshot_hash, CAST(row_number() OVER (PARTITION BY entity_id, search_mode ORDER BY a) AS INT) AS version, generated_at,
  row_number() OVER (PARTITION BY entity_id, search_mode ORDER BY z DESC) = 1 AS is_latest FROM g""",
    "v_queries",
)
def snapshot_history(v, t):
    return tables.snapshot_history(v("v_queries").withColumn("part", (F.col("confidence") % 10).cast("string")), ["question", "part"])


@query(
    """,,
p AS (SELECT DISTINCT entity_id, search_mode FROM v_queries),
b AS (SELECT entity_id, search_mode, concat(search_mode, ' overview ', CAST(i AS STRING)) AS question, 82 AS confidence, i AS pos FROM p CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)),
r AS (SELECT * FROM (SELECT entity_id, search_mode, question, 75 AS confidence, row_number() OVER (PARTITION BY entity_id, search_mode ORDER BY query_id DESC) AS pos FROM v_queries) WHERE pos <= 4),
u AS (SELECT * FROM b UNION ALL SELECT * FROM r UNION ALL SELECT entity_id, search_mode, f, 72, i FROM p CROSS JOIN (SELECT unnest(['latest news', '1-URGENT']) AS f, unnest([0, 1]) AS i)),
o AS (SELECT entity_id, search_mode, question, min((-confidence, pos)) AS k, max(confidence) AS confidence FROM u GROUP BY 1, 2, 3)
SELECT * FROM (SELECT entity_id, search_mode, question, confidence, CAST(row_number() OVER (PARTITION BY entity_id, search_mode ORDER BY k, question) AS INT) AS place FROM o) WHERE place <= 8""",
    "v_queries",
)
def refresh_suggestions(v, t):
    q = v("v_queries")
    templates = q.select("entity_id", "search_mode").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(2))))
    templates = templates.withColumn("question", F.concat("search_mode", F.lit(" overview "), F.col("pos").cast("string")))
    return tables.refresh_suggestions(templates, q, ["latest news", "1-URGENT"])


def _entities(v):
    e = v("v_entities").withColumn("entity_id", F.substring("name", 4, 9).cast("long"))
    return e.withColumn("aliases", F.array(F.concat(F.lit("source "), F.col("entity_id").cast("string")), F.when(F.col("entity_id") % 4 == 0, "src1").otherwise(F.lit("s0"))))


@query(
    """,,
e AS (SELECT CAST(substring(name, 4) AS BIGINT) AS entity_id, name FROM v_entities),
l AS (SELECT name AS label, 1 AS rule, entity_id FROM e UNION ALL SELECT concat('kw', CAST(entity_id % 3 AS STRING)), 2, entity_id FROM e WHERE entity_id % 2 = 0
  UNION ALL SELECT concat('source ', CAST(entity_id AS STRING)), 3, entity_id FROM e UNION ALL SELECT CASE WHEN entity_id % 4 = 0 THEN 'src1' ELSE 's0' END, 3, entity_id FROM e),
n AS (SELECT name FROM e UNION SELECT unnest(['kw0', 'kw1', 'kw2', 'source 3', 's0', 'nobody'])),
b AS (SELECT label, min((rule, entity_id)) AS m FROM l GROUP BY label)
SELECT n.name, b.m[2] AS entity_id, CAST(b.m[1] AS INT) AS rule FROM n LEFT JOIN b ON b.label = n.name""",
    "v_entities",
)
def resolve_entities(v, t):
    e = _entities(v)
    keywords = e.where("entity_id % 2 = 0").select("entity_id", F.concat(F.lit("kw"), (F.col("entity_id") % 3).cast("string")).alias("keyword"), F.lit(True).alias("is_active"))
    asked = e.sparkSession.createDataFrame([(x,) for x in ("kw0", "kw1", "kw2", "source 3", "s0", "nobody")], "name string")
    return joins.resolve_entities(e.select("name").unionByName(asked), e, keywords)


@query(
    """,,
e AS (SELECT CAST(substring(name, 4) AS BIGINT) AS entity_id, name FROM v_entities),
a AS (SELECT entity_id, concat('source ', CAST(entity_id AS STRING)) AS alias FROM e UNION SELECT entity_id, CASE WHEN entity_id % 4 = 0 THEN 'src1' ELSE 's0' END FROM e
  UNION SELECT CAST(substring(source, 4) AS BIGINT), concat(source, '-', lang) FROM documents UNION SELECT entity_id, name FROM e)
SELECT e.entity_id, e.name, array_to_string(list_sort(list(a.alias)), '|') AS aliases FROM e JOIN a ON a.entity_id = e.entity_id WHERE a.alias <> e.name GROUP BY 1, 2""",
    "v_entities",
)
def register_aliases(v, t):
    new = t("documents").select(F.substring("source", 4, 9).cast("long").alias("entity_id"), F.concat("source", F.lit("-"), "lang").alias("alias")).distinct()
    e = _entities(v)
    out = tables.register_aliases(e, new.unionByName(e.select("entity_id", F.col("name").alias("alias"))))
    return out.select("entity_id", "name", F.array_join("aliases", "|").alias("aliases"))


@query(
    """,,
e AS (SELECT w.name, [concat('Kd ', CAST(w.entity_id % 97 AS STRING)), concat(w.entity_type, '-', CAST(w.entity_id AS STRING))] AS aliases, count(q.query_id) AS reviews
  FROM v_watchlist w LEFT JOIN v_queries q ON q.entity_id = w.entity_id GROUP BY w.name, w.entity_id, w.entity_type),
x AS (SELECT DISTINCT substring(name, 12 + length(name) % 3, 1 + CAST(substring(name, 18, 1) AS INT) % 6) AS needle FROM e UNION SELECT DISTINCT lower(substring(aliases[2], 3, 5)) FROM e
  UNION SELECT aliases[1] FROM e UNION SELECT unnest(['', '  ', 'Cust', 'zz#', ' kD ', 'omer#0000001'])),
m AS (SELECT x.needle, e.name, e.reviews, bool_or(starts_with(lower(l), lower(trim(x.needle)))) AS starts FROM x, e, (SELECT name AS n, unnest(list_prepend(name, aliases)) AS l FROM e) k
  WHERE k.n = e.name AND trim(x.needle) <> '' AND contains(lower(l), lower(trim(x.needle))) GROUP BY 1, 2, 3)
SELECT needle, name, reviews, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY needle ORDER BY starts DESC, reviews DESC, name) AS INT) AS rank FROM m) WHERE rank <= 10""",
    "v_watchlist",
    "v_queries",
)
def suggest_entities(v, t):
    counted = v("v_queries").groupBy("entity_id").agg(F.count("*").alias("reviews"))
    e = v("v_watchlist").join(counted.hint("merge"), "entity_id", "left").withColumn("aliases", F.array(F.concat(F.lit("Kd "), (F.col("entity_id") % 97).cast("string")), F.concat_ws("-", "entity_type", F.col("entity_id").cast("string"))))
    e = e.select("name", "aliases", F.coalesce("reviews", F.lit(0)).alias("reviews"))
    asked = e.select(F.expr("substring(name, 12 + length(name) % 3, 1 + CAST(substring(name, 18, 1) AS INT) % 6)").alias("needle"))
    asked = asked.unionByName(e.select(F.lower(F.substring(F.get("aliases", 1), 3, 5)).alias("needle"))).unionByName(e.select(F.get("aliases", 0).alias("needle")))
    few = e.sparkSession.createDataFrame([("",), ("  ",), ("Cust",), ("zz#",), (" kD ",), ("omer#0000001",)], "needle string")
    return rank.suggest_entities(asked.unionByName(few).distinct(), e).select("needle", "name", "reviews", "rank")


@query(
    r""",,
c AS (SELECT entity_id, name, regexp_replace(trim(name), '^(?:Customer#|000)+', '') AS core FROM v_watchlist),
s AS (SELECT *, CASE WHEN core LIKE '%00' AND length(core) >= 4 THEN left(core, length(core) - 2) WHEN core LIKE '%1' AND length(core) >= 3 THEN left(core, length(core) - 1) ELSE core END AS short FROM c),
m AS (SELECT entity_id, name, unnest([core, short, replace(name, '0', 'O'), replace(core, '0', 'O'), replace(short, '0', 'O')]) AS alias FROM s)
SELECT DISTINCT entity_id, alias FROM m WHERE length(alias) >= 3 AND alias <> name AND alias NOT IN ('100')""",
    "v_watchlist",
)
def expand_aliases(v, t):
    made = names.expand_aliases(F.col("name"), ("Customer#", "000"), ("00", "1"), ("100",), 3, ("0", "O"))
    return v("v_watchlist").select("entity_id", F.explode(made).alias("alias"))


@query(
    """,,
r AS (SELECT query_key, ord, concat('https://h/', CAST(CAST(floor(ord / 2) AS BIGINT) AS STRING)) AS url, CASE WHEN ord % 2 = 0 THEN '' ELSE title END AS title, CASE WHEN ord % 3 = 0 THEN NULL ELSE lang END AS lang FROM v_results),
s AS (SELECT concat('https://h/', CAST(ord AS STRING)) AS url, title, lang FROM v_results)
SELECT r.query_key, r.ord, r.url, coalesce(nullif(r.title, ''), s.title, r.title) AS title, coalesce(nullif(r.lang, ''), s.lang, r.lang) AS lang FROM r LEFT JOIN s ON s.url = r.url""",
    "v_results",
)
def hydrate(v, t):
    base = v("v_results")
    url = lambda c: F.concat(F.lit("https://h/"), c.cast("string")).alias("url")
    r = base.select("query_key", "ord", url(F.floor(F.col("ord") / 2)), F.when(F.col("ord") % 2 == 0, "").otherwise(F.col("title")).alias("title"), F.when(F.col("ord") % 3 != 0, F.col("lang")).alias("lang"))
    s = base.select(url(F.col("ord")), "title", "lang")
    return joins.hydrate(r, s, ["title", "lang"])


@query(
    """,,
l AS (SELECT query_key, 25 * query_key + 2 * (ord % 12) AS k FROM v_results),
m AS (SELECT query_key, concat(' https://h', CAST(k % 5 AS STRING), '.example/p/', CAST(k AS STRING)) AS url FROM l)
SELECT query_key, ord, url FROM v_results c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.query_key = c.query_key AND trim(m.url) = trim(c.url))""",
    "v_results",
)
def anti_by_url(v, t):
    r = v("v_results").select("query_key", "ord", "url")
    k = 25 * F.col("query_key") + 2 * (F.col("ord") % 12)
    live = r.select("query_key", F.concat(F.lit(" https://h"), (k % 5).cast("string"), F.lit(".example/p/"), k.cast("string")).alias("url"))
    return joins.anti_by_url(r, live)


@query(
    """,,
s AS (SELECT s.source_id, s.site_name, substring(d.text, 1, 60) AS title, d.text AS content, concat('https://s', CAST(s.source_id % 9 AS STRING), '.example/', CAST(s.source_id % 40 AS STRING)) AS url,
  s.source_id % 4 AS updated_at, CASE WHEN s.source_id % 3 = 0 THEN NULL ELSE s.source_id % 5 END AS published_at FROM v_sources s LEFT JOIN documents d ON d.doc_id = s.source_id),
r AS (SELECT DISTINCT entity_id * 2 + m AS query_key, entity_id, CASE WHEN m = 0 THEN CASE WHEN entity_id % 2 = 0 THEN 'O' ELSE 'F' END END AS search_mode, ['S' || CAST(entity_id % 9 AS STRING) || '.example', 'ER ' || chr(CAST(97 + entity_id % 26 AS INT))] AS terms,
  ['#00000' || CAST(entity_id % 10 AS STRING), 'er d', 'Example/' || CAST(entity_id % 7 AS STRING)] AS exact_terms, CASE WHEN entity_id % 3 = 0 THEN [] ELSE ['the', 'die'] END AS question_terms FROM v_queries, (SELECT unnest([0, 1]) AS m)),
g AS (SELECT r.query_key, c.source_id, max(c.relevance) AS relevance, max(c.credibility) AS credibility, max(q.query_id) AS latest_query_id FROM r JOIN v_queries q ON q.entity_id = r.entity_id AND (r.search_mode IS NULL OR q.search_mode = r.search_mode)
  JOIN v_cards c ON c.query_id = q.query_id JOIN s ON s.source_id = c.source_id
  WHERE len(list_filter(r.terms, lambda x: contains(lower(s.title), lower(x)) OR contains(lower(s.content), lower(x)) OR contains(lower(s.url), lower(x)))) > 0 GROUP BY 1, 2),
o AS (SELECT g.*, s.url, s.site_name, lower(concat(coalesce(s.title, ''), ' ', coalesce(s.content, ''), ' ', coalesce(s.site_name, ''), ' ', s.url)) AS said,
  row_number() OVER (PARTITION BY query_key ORDER BY relevance DESC, credibility DESC, latest_query_id DESC, updated_at DESC NULLS LAST, published_at DESC NULLS LAST, g.source_id) AS k FROM g JOIN s ON s.source_id = g.source_id),
f AS (SELECT o.*, row_number() OVER (PARTITION BY o.query_key, o.url ORDER BY k) AS copy FROM o JOIN r ON r.query_key = o.query_key WHERE k <= 12 AND len(list_filter(r.exact_terms, lambda x: contains(o.said, lower(x)))) > 0
  AND (len(r.question_terms) = 0 OR len(list_filter(r.question_terms, lambda x: contains(o.said, lower(x)))) > 0))
SELECT query_key, source_id, url, relevance, credibility, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_key ORDER BY k) AS INT) AS rank FROM f WHERE copy = 1) WHERE rank <= 4""",
    "v_queries",
    "v_cards",
    "v_sources",
)
def cached_sources(v, t):
    i, text = F.col("source_id"), lambda c: c.cast("string")
    known = v("v_sources")
    docs = t("documents").select(F.col("doc_id").alias("source_id"), "text").join(joins.lookup(known.select("source_id")), "source_id", "left_semi")
    s = known.join(docs.hint("merge"), "source_id", "left").select(
        "source_id", "site_name", F.substring("text", 1, 60).alias("title"), F.col("text").alias("content"), F.concat(F.lit("https://s"), text(i % 9), F.lit(".example/"), text(i % 40)).alias("url"),
        (i % 4).alias("updated_at"), F.when(i % 3 != 0, i % 5).alias("published_at"),
    )
    e, strings = F.col("entity_id"), lambda *cs: F.array(*(c if not isinstance(c, str) else F.lit(c) for c in cs)).cast("array<string>")
    r = v("v_queries").select("entity_id").distinct().select("entity_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("m"))
    r = r.select(
        (e * 2 + F.col("m")).alias("query_key"), "entity_id", F.when(F.col("m") == 0, F.when(e % 2 == 0, "O").otherwise("F")).alias("search_mode"),
        strings(F.concat(F.lit("S"), text(e % 9), F.lit(".example")), F.concat(F.lit("ER "), F.char((97 + e % 26)))).alias("terms"),
        strings(F.concat(F.lit("#00000"), text(e % 10)), "er d", F.concat(F.lit("Example/"), text(e % 7))).alias("exact_terms"),
        F.when(e % 3 == 0, strings()).otherwise(strings("the", "die")).alias("question_terms"),
    )
    return joins.cached_sources(r, v("v_queries"), v("v_cards"), s, 4).select("query_key", "source_id", "url", "relevance", "credibility", "rank")


NEEDLES = [("a", "tion the"), ("a", "erha"), ("b", "ung der"), ("c", "eaux"), ("d", "que la"), ("e", "Apache"), ("f", "zz")]


@query(
    f"""SELECT entity, post_id, rank FROM (SELECT entity, post_id, CAST(row_number() OVER (PARTITION BY entity ORDER BY post_id) AS INT) AS rank FROM
 (SELECT DISTINCT n.entity, d.doc_id AS post_id FROM documents d JOIN (VALUES {", ".join(str(n) for n in NEEDLES)}) n(entity, needle) ON contains(d.text, n.needle))) WHERE rank <= 100""",
)
def match_corpus(v, t):
    docs = t("documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("content"))
    return joins.match_corpus(docs, docs.sparkSession.createDataFrame(NEEDLES, "entity string, needle string"), 100)


@query(
    f"""SELECT entity, post_id, rank FROM (SELECT entity, post_id, CAST(row_number() OVER (PARTITION BY entity ORDER BY post_id) AS INT) AS rank FROM
 (SELECT DISTINCT n.entity, d.doc_id AS post_id FROM documents d JOIN (VALUES {", ".join(str(n) for n in NEEDLES)}) n(entity, needle) ON contains(d.text, n.needle))) WHERE rank <= 100""",
)
def match_corpus_blocked(v, t):
    docs = t("documents").select(F.col("doc_id").alias("post_id"), F.col("text").alias("content"))
    return joins.match_corpus(docs, docs.sparkSession.createDataFrame(NEEDLES, "entity string, needle string"), 100, few=0)


GENERIC, FOCUS = ["{base} news", "{base} review", "site:forum {base}"], ["{base} news", "{base} claim"]


@query(
    """,,
e AS (SELECT o_custkey AS query_key, concat('entity ', CAST(o_custkey AS STRING)) AS a, concat('e', CAST(o_custkey % 10 AS STRING)) AS b FROM (SELECT DISTINCT o_custkey FROM orders)),
q AS (SELECT query_key, 0 AS p, concat(a, ' news') AS query FROM e UNION ALL SELECT query_key, 1, concat(a, ' claim') FROM e UNION ALL SELECT query_key, 3, concat(b, ' news') FROM e
  UNION ALL SELECT query_key, 4, concat(a, ' review') FROM e UNION ALL SELECT query_key, 5, concat(b, ' review') FROM e
  UNION ALL SELECT query_key, 6, concat('site:forum ', a) FROM e UNION ALL SELECT query_key, 7, concat('site:forum ', b) FROM e)
SELECT query_key, CAST(row_number() OVER (PARTITION BY query_key ORDER BY p) - 1 AS INT) AS ord, query FROM q""",
    "v_entities",
)
def expand_queries(v, t):
    return joins.expand_queries(_query_entities(t), FOCUS, GENERIC)


def _query_entities(t):
    e = t("orders").select(F.col("o_custkey").alias("query_key")).distinct()
    return e.withColumn("variants", F.array(F.concat(F.lit("entity "), F.col("query_key").cast("string")), F.concat(F.lit("e"), (F.col("query_key") % 10).cast("string"))))


@query(
    """,,
x AS (SELECT o_custkey AS query_key, o_orderkey AS ord, o_orderpriority AS bucket FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY query_key, bucket ORDER BY ord) AS k, CASE bucket WHEN '2-HIGH' THEN 2 WHEN '1-URGENT' THEN 1 ELSE 0 END AS quota,
  CASE bucket WHEN '2-HIGH' THEN 0 ELSE 1 END AS qpos, CASE bucket WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 ELSE 99 END AS bpos FROM x)
SELECT query_key, ord, bucket, CAST(row_number() OVER (PARTITION BY query_key ORDER BY CASE WHEN k <= quota THEN 0 ELSE 1 END,
  CASE WHEN k <= quota THEN 0 WHEN bpos = 99 THEN 1000000000 ELSE k - quota END, CASE WHEN k <= quota THEN qpos ELSE bpos END, CASE WHEN k <= quota THEN k ELSE 0 END, ord) AS INT) AS place FROM k""",
    "v_entities",
)
def order_queries(v, t):
    rows = t("orders").select(F.col("o_custkey").alias("query_key"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("bucket"))
    return rank.order_queries(rows, {"2-HIGH": 2, "1-URGENT": 1}, ["3-MEDIUM", "1-URGENT", "2-HIGH"])


TERMS = search.SearchTerms(entity=("src1", "the"), relaxed=("th",), question=("tion", "ing"), review=("and", "der", "que"), evidence=("of", "die", "les"), rank_review=("and", "der", "que"), rank_history=("er", "en"), authority=("h1.example",), social=("h2.example",), trusted=("h3.example",))
_HAY = "lower(concat_ws(' ', title, content, source, url))"
_N = lambda terms: " + ".join(f"contains(hay, '{x}')::INT" for x in terms)
_RANKED = f""",,
h AS (SELECT *, {_HAY} AS hay, CASE WHEN ord % 7 < 4 THEN ['official', 'news', 'forum', 'social'][CAST(ord % 7 AS INT) + 1] ELSE 'other' END AS bucket FROM v_results),
s AS (SELECT query_key, ord, url, bucket, 12 * (contains(hay, 'src1') OR contains(hay, 'the'))::INT + 3 * ({_N(TERMS.question)}) + {_N(TERMS.evidence)} + {_N(TERMS.rank_review)}
  + 3 * ({_N(TERMS.authority)}) + CASE WHEN contains(lower(url), 'h1.example') THEN 8 ELSE 0 END AS s1,
  {_N(TERMS.question)} + {_N(TERMS.evidence)} + {_N(TERMS.authority)} + {_N(TERMS.rank_history)} AS s2, least(length(trim(lower(content))), 500) AS s3 FROM h),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_key ORDER BY s1 DESC, s2 DESC, s3 DESC, ord) AS INT) AS rank FROM s)"""


def _ranked(v):
    kind = F.when(F.col("ord") % 7 < 4, F.get(F.array(*map(F.lit, ("official", "news", "forum", "social"))), (F.col("ord") % 7).cast("int"))).otherwise("other")
    return search.rank_results(v("v_results").withColumn("source_type", kind), TERMS)


@query(_RANKED + "\nSELECT query_key, ord, CAST(s1 AS INT) AS s1, CAST(s2 AS INT) AS s2, CAST(s3 AS INT) AS s3, rank FROM r", "v_results")
def rank_results(v, t):
    return _ranked(v).select("query_key", "ord", "s1", "s2", "s3", "rank")


@query(
    _RANKED
    + """, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_key, url ORDER BY rank) AS c FROM r) WHERE c = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY query_key, bucket ORDER BY rank) <= 2 AS first, CASE bucket WHEN 'official' THEN 0 WHEN 'news' THEN 1 WHEN 'forum' THEN 2 WHEN 'social' THEN 3 ELSE 5 END AS pos FROM o)
SELECT query_key, ord, bucket, CAST(row_number() OVER (PARTITION BY query_key ORDER BY CASE WHEN first THEN 0 ELSE 1 END, CASE WHEN first THEN pos ELSE 0 END, rank) AS INT) AS place FROM q""",
    "v_results",
)
def diversify_results(v, t):
    return rank.diversify_results(_ranked(v), F.lit(False)).select("query_key", "ord", "bucket", "place")


_CARDS = """,,
c AS (SELECT o.entity_id AS query_key, (c.query_id * 10 + c.card_no) * 100000 + c.source_id AS ord, c.source_id, c.relevance, c.credibility, CAST(c.card_no * 10 AS INT) AS first_hand, c.card_no = 7 AS noise, c.stance
  FROM v_cards c JOIN v_queries o ON o.query_id = c.query_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_key ORDER BY relevance DESC, credibility DESC, first_hand DESC, ord) AS INT) AS rank, max((relevance >= 40)::INT) OVER (PARTITION BY query_key) AS good FROM c WHERE NOT noise),
f AS (SELECT * FROM k WHERE CASE WHEN good = 1 THEN relevance >= 40 ELSE rank <= 20 END AND rank <= 20)"""


def _cards(v):
    c = v("v_cards").join(v("v_queries").select("query_id", F.col("entity_id").alias("query_key")), "query_id")
    return c.select("query_key", ((F.col("query_id") * 10 + F.col("card_no")) * 100_000 + F.col("source_id")).alias("ord"), "source_id", "relevance", "credibility", (F.col("card_no") * 10).cast("int").alias("first_hand"), (F.col("card_no") == 7).alias("noise"), "stance", "strength")


@query(_CARDS + "\nSELECT query_key, ord, relevance, credibility, first_hand, rank, good = 0 AS fallback FROM f", "v_queries", "v_cards")
def rank_cards(v, t):
    return rank.rank_cards(_cards(v), 20).select("query_key", "ord", "relevance", "credibility", "first_hand", "rank", "fallback")


@query(
    _CARDS
    + """, n AS (SELECT *, concat('p', CAST(source_id % 4 AS STRING)) AS platform, CAST(source_id AS STRING) AS url, count(*) OVER (PARTITION BY query_key) AS n FROM f),
m AS (SELECT *, min(rank) OVER (PARTITION BY query_key, platform) AS fst, row_number() OVER (PARTITION BY query_key, platform ORDER BY rank) <= 2 AS first FROM n),
p AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY CASE WHEN first THEN 0 ELSE 1 END, CASE WHEN first THEN CASE WHEN n <= 2 THEN rank ELSE fst END ELSE 0 END, rank) AS pl FROM m),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_key, url ORDER BY pl) AS c FROM p) WHERE c = 1 OR n <= 2)
SELECT query_key, ord, platform, place FROM (SELECT query_key, ord, platform, good, CAST(row_number() OVER (PARTITION BY query_key ORDER BY pl) AS INT) AS place FROM o) WHERE place <= CASE WHEN good = 1 THEN 12 ELSE 10 END""",
    "v_queries",
    "v_cards",
)
def diversify_cards(v, t):
    cards = rank.rank_cards(_cards(v), 20).withColumn("platform", F.concat(F.lit("p"), (F.col("source_id") % 4).cast("string")))
    cards = cards.withColumn("url", F.col("source_id").cast("string")).withColumn("claim_type", F.lit("general_reputation"))
    return rank.diversify_cards(cards, 12).select("query_key", "ord", "platform", "place")


@query(
    """,,
c AS (SELECT entity AS k, review_id, CASE WHEN stance IN ('supporting', 'opposing') THEN stance ELSE 'neutral' END AS stance FROM v_reviews),
n AS (SELECT *, row_number() OVER (PARTITION BY k, stance ORDER BY review_id) AS i FROM c),
o AS (SELECT *, CASE WHEN stance = 'supporting' AND i <= 2 THEN 0 WHEN stance = 'opposing' AND i <= 2 THEN 1 WHEN stance = 'supporting' THEN 3 WHEN stance = 'opposing' THEN 4 ELSE 2 END AS turn FROM n)
SELECT * FROM (SELECT k AS entity, review_id, stance, CAST(row_number() OVER (PARTITION BY k ORDER BY turn, i) AS INT) AS slot FROM o) WHERE slot <= 5""",
    "v_reviews",
)
def balanced_excerpts(v, t):
    stance = F.when(F.col("stance").isin("supporting", "opposing"), F.col("stance")).otherwise("neutral")
    return rank.balanced_excerpts(v("v_reviews").select("entity", "review_id", stance.alias("stance")), ["entity"], ["review_id"], 5)


CARD_TERMS = C.Terms(negative=("er", "ein", "que "), positive=("tion", "ung", "las "), first_hand=("andnt",), reported=("with",), hard=("ingth", "chen"), history=("of",), question=("the", "die", "les"), noise=("zzz",))
_CARD_SQL = """,,
r AS (SELECT query_key, ord, url, title AS t0, CASE WHEN ord % 19 = 0 OR content = '' THEN '目前沒有可用的摘要內容。' ELSE content END AS x, source, CASE CAST(ord % 4 AS INT) WHEN 0 THEN 'official' WHEN 1 THEN 'news' WHEN 2 THEN 'forum' ELSE 'other' END AS source_type,
  CASE CAST(ord % 3 AS INT) WHEN 0 THEN '2024-01-15' WHEN 1 THEN '2019-05-05' END AS published FROM v_results),
t AS (SELECT *, CASE WHEN trim(t0) <> '' AND NOT regexp_full_match(lower(trim(t0)), '(?:https?://)?[a-z0-9-]+(?:\\.[a-z0-9-]+)+(?:/\\S*)?') THEN t0 ELSE concat(source, ' 來源紀錄') END AS title FROM r),
h AS (SELECT *, concat(title, ' ', x) AS said, lower(concat(title, ' ', x)) AS hay FROM t),
f AS (SELECT *, CASE WHEN source_type = 'official' THEN 58 WHEN contains(said, 'andnt') THEN CASE WHEN source_type = 'forum' THEN 82 ELSE 68 END
    WHEN source_type = 'news' THEN CASE WHEN contains(said, 'with') THEN 32 ELSE 38 END WHEN source_type = 'forum' THEN 48 ELSE 36 END AS first_hand,
  contains(said, 'er')::INT + contains(said, 'ein')::INT + contains(said, 'que ')::INT AS neg, contains(said, 'tion')::INT + contains(said, 'ung')::INT + contains(said, 'las ')::INT AS pos,
  contains(said, 'ingth') OR contains(said, 'chen') AS hard,
  CASE WHEN contains(hay, 'th') THEN least(100, greatest(0, 70 + CASE WHEN contains(lower(title), 'th') THEN 15 ELSE 0 END + least(15, 5 * (contains(hay, 'the')::INT + contains(hay, 'die')::INT))))
    ELSE least(15, 3 * (contains(hay, 'the')::INT + contains(hay, 'die')::INT)) END AS relevance FROM h),
g AS (SELECT *, source_type = 'news' AND contains(said, 'with') AND NOT hard AND first_hand < 45 AS hearsay,
  CASE WHEN published IS NULL THEN 'unknown' WHEN DATE '2024-12-31' - CAST(published AS DATE) <= 365 THEN 'recent' ELSE 'dated' END AS recency FROM f),
k AS (SELECT *, CASE WHEN neg > pos THEN CASE WHEN hearsay THEN 'unclear' ELSE 'supporting' END WHEN pos > neg THEN CASE WHEN hearsay THEN 'neutral' ELSE 'opposing' END WHEN neg = 0 THEN 'neutral' ELSE 'unclear' END AS stance,
  CASE WHEN neg = pos OR hearsay THEN 'weak' WHEN hard AND first_hand >= 60 THEN 'strong' WHEN hard OR first_hand >= 50 THEN 'medium' ELSE 'weak' END AS strength,
  greatest(0, least(100, CASE source_type WHEN 'official' THEN 78 WHEN 'news' THEN 68 WHEN 'forum' THEN 48 ELSE 36 END + CASE recency WHEN 'recent' THEN 8 WHEN 'unknown' THEN -4 ELSE 0 END
    + CAST(round_even(first_hand * CAST(0.12 AS DOUBLE), 0) AS INT) + CAST(round_even(relevance * CAST(0.18 AS DOUBLE), 0) AS INT))) AS credibility FROM g)"""


def _evidence(v):
    r = v("v_results").withColumn("content", F.when(F.col("ord") % 19 == 0, "").otherwise(F.col("content")))
    kind = F.get(F.array(*map(F.lit, ("official", "news", "forum", "other"))), (F.col("ord") % 4).cast("int"))
    r = r.withColumn("source_type", kind).withColumn("published_date", F.when(F.col("ord") % 3 == 0, "2024-01-15").when(F.col("ord") % 3 == 1, "2019-05-05"))
    return analysis.evidence_cards(r, F.lit("th"), F.lit("the die"), "2024-12-31", CARD_TERMS, clean=False)


@query(_CARD_SQL + "\nSELECT query_key, ord, title, source_type, stance, strength, CAST(first_hand AS INT) AS first_hand, CAST(relevance AS INT) AS relevance, CAST(credibility AS INT) AS credibility, recency, substring(x, 1, 700) AS snippet FROM k", "v_results")
def evidence_cards(v, t):
    return _evidence(v).select("query_key", "ord", "title", "source_type", "stance", "strength", "first_hand", "relevance", "credibility", "recency", "snippet")


@query(
    _CARD_SQL
    + """, z AS (SELECT query_key, stance = 'supporting' AND strength IN ('medium', 'strong') AND relevance >= 60 AND (first_hand >= 55 OR source_type = 'official') AS s,
  stance = 'opposing' AND strength IN ('medium', 'strong') AND relevance >= 55 AS o, relevance, ord, concat(source, ' 來源整理(',
  CASE WHEN source_type = 'official' THEN '官方說明' WHEN first_hand >= 75 THEN '第一手描述' WHEN source_type = 'news' THEN '新聞轉述' WHEN source_type = 'forum' AND first_hand >= 55 THEN '社群第一手貼文'
    WHEN source_type = 'forum' THEN '社群討論' ELSE '整理資料' END, ')') AS point, CASE WHEN length(title) < 6 THEN '' ELSE title END AS named FROM k),
w AS (SELECT *, CASE WHEN s THEN 's' WHEN o THEN 'o' ELSE 'u' END AS side FROM z),
i AS (SELECT *, row_number() OVER (PARTITION BY query_key, side ORDER BY relevance DESC, ord) AS k, CASE WHEN named = '' THEN point ELSE concat(named, substring(point, instr(point, '('))) END AS p FROM w),
j AS (SELECT query_key, side, p, min(k) AS k FROM i WHERE k <= 3 GROUP BY 1, 2, 3),
l AS (SELECT query_key, string_agg(p, '|' ORDER BY k) FILTER (side = 's') AS sp, string_agg(p, '|' ORDER BY k) FILTER (side = 'o') AS op, string_agg(p, '|' ORDER BY k) FILTER (side = 'u') AS up FROM j GROUP BY 1),
x2 AS (SELECT query_key, count(*) AS cards, count(*) FILTER (s) AS supporting, count(*) FILTER (o) AS opposing FROM z GROUP BY 1),
y AS (SELECT x2.*, coalesce(l.sp, '目前沒有足夠直接證據可列為主要疑慮。') AS supporting_points, coalesce(l.op, '尚未找到足夠明確的反駁或改善來源。') AS opposing_points,
  coalesce(l.up, '現有來源多為轉述、片段描述或細節不足，仍需補查。') AS uncertain_points FROM x2 JOIN l ON l.query_key = x2.query_key)
SELECT supporting_points, opposing_points, uncertain_points, CASE WHEN supporting > opposing THEN '目前公開資料有部分內容支持「the die」成立,但仍需人工複核原文與時間序。'
  WHEN opposing > supporting THEN '目前找到較多反駁、改善或官方說明資訊;直接支持「the die」的證據相對較少。' WHEN supporting > 0 THEN '目前公開資料正反並存,對「the die」仍需結合原文脈絡判讀。'
  ELSE '目前可用公開資料不足,對「the die」暫時無法下定論。' END AS verdict_text, query_key, cards, supporting, opposing, least(80, 22 + 2 * cards + 8 * supporting + 6 * opposing) AS confidence,
  CASE WHEN supporting > opposing THEN 'mostly_supported' WHEN opposing > supporting THEN 'mostly_opposed' WHEN supporting > 0 THEN 'mixed' ELSE 'insufficient' END AS verdict FROM y""",
    "v_results",
)
def balanced_summary(v, t):
    cards = rank.ranked(_evidence(v), ["query_key"], [F.desc("relevance"), F.col("ord")])
    found = analysis.balanced_summary(cards, question=F.lit("the die"), terms=CARD_TERMS)
    points = (F.array_join(f"{s}_points", "|").alias(f"{s}_points") for s in ("supporting", "opposing", "uncertain"))
    return found.select("query_key", "cards", "supporting", "opposing", "confidence", "verdict", "verdict_text", *points)


def _holds(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x.replace(chr(39), chr(39) * 2)}')" for x in terms) + ")"


# three providers of results, known sources for every other url, crawled pages for every third; every fifth query has its domain in focus
_ROWS = """,,
s0 AS (SELECT query_key, (ord % 3) * 1099511627776 + ord AS ord, ord % 3 AS provider_pos, CASE WHEN ord % 11 = 0 THEN '' ELSE url END AS url, CASE WHEN ord % 3 = 0 THEN title ELSE substring(content, 1, 24) END AS title,
  CASE WHEN ord % 4 = 1 THEN '' WHEN ord % 13 = 0 THEN 'No results found' WHEN ord % 17 = 0 THEN concat('動物 src1 虐待 ', content) ELSE content END AS content, source, ['official', 'news', 'forum', 'social'][CAST(ord % 4 AS INT) + 1] AS source_type, query_key % 5 = 0 AS strict FROM v_results),
k0 AS (SELECT url, concat('src1 known ', max(lang), ' text of ', url) AS content FROM v_results WHERE ord % 4 < 2 GROUP BY url),
c0 AS (SELECT url, 'src1 crawled title' AS title, concat('crawled page, long enough to count, ', url) AS content FROM v_results WHERE CAST(floor(ord / 2) AS BIGINT) % 3 = 0 GROUP BY url)"""
_STEPS = f"""{_ROWS}{_greedy("s0")},
h0 AS (SELECT s.*, u.ord IS NOT NULL AS uniq, coalesce(c.title, s.title) AS title2, coalesce(c.content, nullif(s.content, ''), k.content, s.content) AS content2 FROM s0 s LEFT JOIN u ON u.query_key = s.query_key AND u.ord = s.ord LEFT JOIN k0 k ON k.url = trim(s.url) LEFT JOIN c0 c ON c.url = trim(s.url)),
h1 AS (SELECT *, lower(content2) AS txt, lower(concat_ws(' ', title2, content2, source, url)) AS hay, concat_ws(' ', lower(title2), lower(content2)) AS said FROM h0),
h2 AS (SELECT *, uniq AND NOT (trim(url) = '' OR {_holds("said", TERMS.login)} OR {_holds("said", TERMS.no_results)} OR {_holds("said", ("文章列表", "精華區", "search?q=thread", "latest all comments", "paint0_linear", "paint1_ra", "userspaceonuse", "stop-color", "fill'url(%23"))}) AS clear,
  {_holds("hay", TERMS.entity)} AS named, {_holds("hay", TERMS.relaxed)} AS rel, {_holds("hay", TERMS.question)} AS asked, {_holds("lower(url)", TERMS.trusted)} AS trusted,
  length(trim(txt)) >= 20 AND NOT {_holds("hay", TERMS.empty)} AS meant, length(trim(txt)) >= 20 OR length(trim(lower(title2))) >= 8 AS some_text, length(trim(lower(title2))) >= 8 AS titled,
  {" + ".join(f"contains(hay, '{x}')::INT" for x in search.L.DOMAIN)} AS dom, {_holds("hay", search.L.DOMAIN_STRONG)} AS strong, {_holds("hay", search.L.DOMAIN_NEGATED)} AS negated, {" + ".join(f"contains(hay, '{x}')::INT" for x in search.L.DOMAIN_EXCLUDED)} AS off FROM h1),
h3 AS (SELECT *, clear AND CASE WHEN strict THEN NOT negated AND NOT (off >= 2 AND dom < 2 AND NOT strong) AND (named OR rel) AND some_text AND ((trusted AND strong) OR dom >= 2 OR (strong AND asked))
  ELSE (named AND (({_holds("lower(url)", TERMS.social)} AND meant) OR asked OR {_holds("hay", TERMS.review)} OR (({_holds("hay", TERMS.evidence)} OR trusted) AND (meant OR titled)))) OR (trusted AND rel AND asked AND (meant OR titled)) END AS ok FROM h2),
h4 AS (SELECT *, CASE WHEN NOT uniq THEN 'duplicate' WHEN NOT clear THEN 'low_signal' WHEN ok OR (NOT strict AND NOT bool_or(ok) OVER (PARTITION BY query_key)) THEN 'kept' ELSE 'irrelevant' END AS step FROM h3),
s1 AS (SELECT *, source_type AS bucket, 12 * named::INT + 3 * ({_N(TERMS.question)}) + {_N(TERMS.evidence)} + {_N(TERMS.rank_review)} + 3 * ({_N(TERMS.authority)}) + CASE WHEN contains(lower(url), 'h1.example') THEN 8 ELSE 0 END
  + CASE WHEN strict THEN dom + 3 * ({" + ".join(f"contains(hay, '{x}')::INT" for x in search.L.DOMAIN_STRONG)}) ELSE 0 END AS a1,
  {_N(TERMS.question)} + {_N(TERMS.evidence)} + {_N(TERMS.authority)} + {_N(TERMS.rank_history)} + CASE WHEN strict THEN dom + 3 * ({" + ".join(f"contains(hay, '{x}')::INT" for x in search.L.DOMAIN_STRONG)}) ELSE 0 END AS a2, least(length(trim(txt)), 500) AS a3 FROM h4 WHERE step = 'kept'),
r1 AS (SELECT *, row_number() OVER (PARTITION BY query_key ORDER BY a1 DESC, a2 DESC, a3 DESC, ord) AS rank, count(*) OVER (PARTITION BY query_key) AS n FROM s1),
r2 AS (SELECT *, row_number() OVER (PARTITION BY query_key, bucket ORDER BY rank) <= 2 AND n > 3 AS first, CASE bucket WHEN 'official' THEN 0 WHEN 'news' THEN 1 WHEN 'forum' THEN 2 WHEN 'social' THEN 3 ELSE 5 END AS pos FROM r1),
r3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_key ORDER BY CASE WHEN first THEN 0 ELSE 1 END, CASE WHEN first THEN pos ELSE 0 END, rank) AS INT) AS place FROM r2)"""


def _searched(v):
    parts = []
    o = F.col("ord")
    for i in range(3):
        r = v("v_results").where(o % 3 == i)
        title = F.col("title") if i == 0 else F.substring("content", 1, 24)
        text = F.when(o % 4 == 1, "").when(o % 13 == 0, "No results found").when(o % 17 == 0, F.concat(F.lit("動物 src1 虐待 "), "content")).otherwise(F.col("content"))
        kind = F.get(F.array(*map(F.lit, ("official", "news", "forum", "social"))), (o % 4).cast("int"))
        parts.append(r.select("query_key", "ord", F.when(o % 11 == 0, "").otherwise(F.col("url")).alias("url"), title.alias("title"), text.alias("content"), "source", kind.alias("source_type")))
    rows = dedup.in_order(dedup.union_results(*parts)).withColumn("strict", F.col("query_key") % 5 == 0)
    base = v("v_results")
    known = base.where("ord % 4 < 2").groupBy("url").agg(F.max("lang").alias("_l")).select("url", F.concat(F.lit("src1 known "), "_l", F.lit(" text of "), "url").alias("content"))
    crawled = base.where(F.floor(o / 2) % 3 == 0).select("url").distinct().select("url", F.lit("src1 crawled title").alias("title"), F.concat(F.lit("crawled page, long enough to count, "), "url").alias("content"))
    return search.run_search(rows, TERMS, 10, focus=F.col("strict"), sources=known, crawled=crawled, by=("provider_pos",))


@query(
    _STEPS
    + """, f AS (SELECT query_key, provider_pos, count(*) AS prioritized, count(*) FILTER (place <= 10) AS final FROM r3 GROUP BY 1, 2)
SELECT h.query_key, CAST(h.provider_pos AS INT) AS provider_pos, count(*) AS raw, count(*) FILTER (h.step <> 'duplicate') AS deduplicated, count(*) FILTER (h.step = 'low_signal') AS low_signal, count(*) FILTER (h.step = 'irrelevant') AS irrelevant,
  coalesce(any_value(f.prioritized), 0) AS prioritized, coalesce(any_value(f.final), 0) AS final FROM h4 h LEFT JOIN f ON f.query_key = h.query_key AND f.provider_pos = h.provider_pos GROUP BY 1, 2""",
    "v_results",
)
def search_funnel(v, t):
    """Counts of each query and provider after each step, known sources and crawled pages included, with and without the domain in focus."""
    return _searched(v)[1]


@query(_STEPS + "\nSELECT query_key, ord, url, title2 AS title, source_type, bucket, CAST(a1 AS INT) AS s1, CAST(a2 AS INT) AS s2, CAST(a3 AS INT) AS s3, place FROM r3 WHERE place <= 10", "v_results")
def finalized_results(v, t):
    return _searched(v)[0].select("query_key", "ord", "url", "title", "source_type", "bucket", "s1", "s2", "s3", "place")


@query()
def cleaned_cards(v, t):
    """Cards with full cleaning (NFKC) of the texts; the rule for vector graphics leftovers is off for Latin text."""
    r = v("v_results").withColumn("source_type", F.lit(None).cast("string")).withColumn("published_date", F.lit("2024-01-15"))
    cards = analysis.evidence_cards(r, F.lit("th"), F.lit("the"), "2024-12-31", CARD_TERMS, strict=False)
    return cards.select("query_key", "ord", "title", "snippet", "excerpt", "stance", "relevance", "credibility", "platform")


DIMS = metrics.DIMENSIONS
_DIM_SQL = """,,
d AS (SELECT i, dim FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['staff_attitude', 'transparency', 'environment', 'animal_care', 'communication', 'adoption_process']) AS dim)),
g AS (SELECT r.entity, d.dim, r.stance, r.review_id, CASE WHEN d.i = r.review_id % 6 THEN 0 ELSE 1 END AS pos, substring(r.content, 1, 20) AS excerpt, CASE WHEN r.stance IN ('supporting', 'opposing') THEN r.stance ELSE 'neutral' END AS side
  FROM v_reviews r JOIN d ON d.i IN (r.review_id % 6, (r.review_id + 2) % 6) WHERE r.relevance_score >= 0.6 AND r.content_type = 'review'),
e AS (SELECT DISTINCT entity FROM v_reviews),
n AS (SELECT *, row_number() OVER (PARTITION BY entity, dim, side ORDER BY review_id, pos) AS k FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY entity, dim ORDER BY CASE WHEN side = 'supporting' AND k <= 2 THEN 0 WHEN side = 'opposing' AND k <= 2 THEN 1 WHEN side = 'supporting' THEN 3 WHEN side = 'opposing' THEN 4 ELSE 2 END, k) AS slot FROM n),
x AS (SELECT entity, dim, string_agg(excerpt, '|' ORDER BY slot) AS excerpts FROM o WHERE slot <= 5 GROUP BY 1, 2)
SELECT e.entity, d.dim, count(g.dim) AS mentions, count(*) FILTER (g.stance = 'supporting') AS supporting, count(*) FILTER (g.stance = 'opposing') AS opposing,
  count(g.dim) - count(*) FILTER (g.stance IN ('supporting', 'opposing')) AS neutral, coalesce(any_value(x.excerpts), '') AS excerpts FROM e CROSS JOIN d LEFT JOIN g ON g.entity = e.entity AND g.dim = d.dim LEFT JOIN x ON x.entity = e.entity AND x.dim = d.dim GROUP BY 1, 2"""


def _tagged(v):
    dims = F.array(*map(F.lit, DIMS))
    tag = lambda i: F.struct(F.get(dims, (i % 6).cast("int")).alias("dim"), F.col("stance").alias("stance"), F.substring("content", 1, 20).alias("excerpt"))
    return v("v_reviews").withColumn("tags", F.array(tag(F.col("review_id")), tag(F.col("review_id") + 2)))


@query(_DIM_SQL, "v_reviews")
def dimension_overview(v, t):
    return metrics.dimension_overview(_tagged(v)).withColumn("excerpts", F.array_join("excerpts", "|"))


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS raw_title,
 len(regexp_extract_all(html, '(?is)<a\b[^>]*href="([^"]*)"', 1)) AS links, 0 AS images FROM pages"""
)
def page_metadata(v, t):
    return payloads.page_metadata(t("pages"), normalize=False).select("page_id", F.col("title").alias("raw_title"), F.size("links").alias("links"), F.size("images").alias("images"))


@query()
def official_gallery(v, t):
    pages = payloads.page_metadata(t("pages")).withColumn("entity", F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).withColumn("ord", F.col("page_id"))
    return payloads.official_gallery(pages)


@query(
    """,,
c AS (SELECT q.entity_id, c.relevance, c.card_no * 10 AS first_hand, c.strength = 'O' AS recent FROM v_cards c JOIN v_queries q ON q.query_id = c.query_id)
SELECT entity_id, CAST(round(avg(relevance)) AS BIGINT) AS relevance, CAST(round(avg(first_hand)) AS BIGINT) AS first_hand, CAST(round(100 * count(*) FILTER (recent) / count(*)) AS BIGINT) AS recent FROM c GROUP BY 1""",
    "v_queries",
    "v_cards",
)
def metric_bars(v, t):
    cards = _cards(v).withColumn("recency", F.when(F.col("strength") == "O", "recent").otherwise("dated"))
    return metrics.metric_bars(cards.withColumnRenamed("query_key", "entity_id"), "entity_id")


@query(
    """,,
c AS (SELECT q.entity_id, CASE c.stance WHEN 'R' THEN 'opposing' WHEN 'A' THEN 'supporting' ELSE 'neutral' END AS stance FROM v_cards c JOIN v_queries q ON q.query_id = c.query_id),
p AS (SELECT entity_id, CAST(round(100 * count(*) FILTER (stance = 'supporting') / count(*)) AS BIGINT) AS supporting, CAST(round(100 * count(*) FILTER (stance = 'opposing') / count(*)) AS BIGINT) AS opposing FROM c GROUP BY 1)
SELECT *, greatest(0, 100 - supporting - opposing) AS neutral FROM p""",
    "v_queries",
    "v_cards",
)
def stance_bar(v, t):
    stance = F.when(F.col("stance") == "R", "opposing").when(F.col("stance") == "A", "supporting").otherwise("neutral")
    return metrics.stance_bar(_cards(v).withColumn("stance", stance).withColumnRenamed("query_key", "entity_id"), "entity_id")


@query(
    """,,
m AS (SELECT query_id, CAST(sum(credibility) AS DOUBLE) / count(*) AS c FROM v_cards GROUP BY 1),
s AS (SELECT q.query_id, least(100, greatest(0, CAST(round(CAST(0.55 AS DOUBLE) * coalesce(m.c, CAST(q.confidence AS DOUBLE)) + CAST(0.45 AS DOUBLE) * q.confidence) AS INT))) AS overall FROM v_queries q LEFT JOIN m ON m.query_id = q.query_id)
SELECT query_id, overall, round(overall / 20, 1) AS five_point, CASE WHEN overall >= 88 THEN 'excellent' WHEN overall >= 74 THEN 'good' WHEN overall >= 60 THEN 'fair' ELSE 'weak' END AS label FROM s""",
    "v_queries",
    "v_cards",
)
def overall_score(v, t):
    return metrics.overall_score(v("v_queries"), v("v_cards"))


@query(
    """SELECT platform, count(*) AS n FROM (SELECT unnest([CASE WHEN contains(lower(text), 'ig') THEN 'instagram' END, CASE WHEN contains(lower(text), 'apache') THEN 'apache' END,
 CASE WHEN contains(lower(text), 'the ') THEN 'english' END]) AS platform FROM documents) WHERE platform IS NOT NULL GROUP BY platform"""
)
def platform_counts(v, t):
    return metrics.platform_counts(t("documents").select("text"), {"instagram": "ig", "apache": "apache", "english": "the "})


@query(
    """SELECT l_shipmode_ AS platform, entity, CAST(sum(n) AS BIGINT) AS rows_written, CAST(count(*) FILTER (n = 0) AS BIGINT) AS failed FROM
 (SELECT l_returnflag AS l_shipmode_, CAST(l_suppkey % 10 AS STRING) AS entity, CAST(l_quantity AS BIGINT) % 5 AS n FROM lineitem) GROUP BY ROLLUP (l_shipmode_, entity)"""
)
def run_totals(v, t):
    runs = t("lineitem").select(F.col("l_returnflag").alias("platform"), (F.col("l_suppkey") % 10).cast("string").alias("entity"), (F.col("l_quantity").cast("long") % 5).alias("rows_written"))
    return metrics.run_totals(runs.withColumn("status", F.when(F.col("rows_written") == 0, "failed").otherwise("ok")))


@query(
    """SELECT c.query_id, c.source_id, c.card_no, c.relevance, c.stance, s.site_name, s.source_type,
 CAST(row_number() OVER (PARTITION BY c.query_id ORDER BY c.relevance DESC, c.card_no, c.source_id, c.stance) AS INT) AS rank FROM v_cards c JOIN v_sources s ON s.source_id = c.source_id""",
    "v_cards",
    "v_sources",
)
def query_cards(v, t):
    return rank.query_cards(v("v_cards"), v("v_sources"), ("card_no", "source_id", "stance")).select("query_id", "source_id", "card_no", "relevance", "stance", "site_name", "source_type", "rank")


@query(
    f"""SELECT entity_id, name, coalesce(priority, 3) AS priority, last_at + INTERVAL 2160 HOUR AS next_crawl_at FROM v_watchlist WHERE entity_id % 3 <> 0
 AND (last_at IS NULL OR last_at + INTERVAL 2160 HOUR <= TIMESTAMP '{AS_OF}') AND lower(entity_type) IN ('building', 'machinery') ORDER BY priority, name LIMIT 200""",
    "v_watchlist",
)
def due_entities(v, t):
    watched = v("v_watchlist").withColumn("is_active", F.col("entity_id") % 3 != 0).withColumn("next_crawl_at", F.col("last_at") + F.make_dt_interval(hours=F.lit(2160)))
    return joins.due_entities(watched, AS_OF, ["building", "machinery"], 200)


_TAGGED = """,,
d AS (SELECT i, dim FROM (SELECT unnest([0, 1, 2, 3, 4, 5]) AS i, unnest(['staff_attitude', 'transparency', 'environment', 'animal_care', 'communication', 'adoption_process']) AS dim))"""


@query(
    _TAGGED
    + """
SELECT d.dim, CASE WHEN r.stance IN ('supporting', 'opposing') THEN r.stance ELSE 'neutral' END AS stance, count(*) AS n
FROM v_reviews r JOIN d ON d.i IN (r.review_id % 6, (r.review_id + 2) % 6) GROUP BY 1, 2""",
    "v_reviews",
)
def dimension_stances(v, t):
    return metrics.dimension_stances(_tagged(v))


_TYPED = """,,
c AS (SELECT query_id, source_id, CASE stance WHEN 'R' THEN 'opposing' WHEN 'A' THEN 'supporting' ELSE 'neutral' END AS stance,
  CASE source_id % 6 WHEN 0 THEN 'official' WHEN 1 THEN 'news' WHEN 2 THEN 'forum' WHEN 3 THEN 'social' WHEN 4 THEN 'blog' END AS source_type FROM v_cards)"""


def _typed(v):
    n = F.col("source_id") % 6
    kind = F.when(n == 0, "official").when(n == 1, "news").when(n == 2, "forum").when(n == 3, "social").when(n == 4, "blog")
    stance = F.when(F.col("stance") == "R", "opposing").when(F.col("stance") == "A", "supporting").otherwise("neutral")
    return v("v_cards").withColumns({"source_type": kind, "stance": stance})


@query(_TYPED + "\nSELECT query_id, CASE WHEN source_type IS NULL OR source_type = 'blog' THEN 'other' ELSE source_type END AS source_type, count(*) AS n FROM c GROUP BY 1, 2", "v_cards")
def source_type_counts(v, t):
    return metrics.source_type_counts(_typed(v), "query_id")


@query(
    _TYPED
    + """
SELECT query_id, count(*) AS "all", count(*) AS latest, count(*) FILTER (stance = 'supporting') AS supporting, count(*) FILTER (stance = 'opposing') AS opposing, count(*) FILTER (source_type = 'official') AS official,
  count(*) FILTER (source_type = 'news') AS news, count(*) FILTER (source_type = 'forum') AS forum, count(*) FILTER (source_type = 'social') AS social FROM c GROUP BY 1""",
    "v_cards",
)
def tab_counts(v, t):
    return metrics.tab_counts(_typed(v), "query_id")


@query(
    """,,
e AS (SELECT entity_id, name FROM v_watchlist), old AS (SELECT entity_id, concat('c', CAST(entity_id AS STRING)) AS keyword FROM e WHERE entity_id % 2 = 0),
m AS (SELECT DISTINCT entity_id, keyword FROM (SELECT entity_id, name, unnest([name, concat('c', CAST(entity_id AS STRING)), replace(name, '#', ' '), replace(name, '0', '')]) AS keyword FROM e) WHERE keyword <> name)
SELECT entity_id, keyword, 'alias' AS keyword_type, 70 AS weight, true AS is_active FROM m WHERE (entity_id, keyword) NOT IN (SELECT entity_id, keyword FROM old)
UNION ALL SELECT entity_id, keyword, 'seed', 90, true FROM old""",
    "v_watchlist",
)
def expand_keywords(v, t):
    e = v("v_watchlist").select("entity_id", "name").withColumn("aliases", F.array().cast("array<string>"))
    short = F.concat(F.lit("c"), F.col("entity_id").cast("string"))
    old = e.where("entity_id % 2 = 0").select("entity_id", short.alias("keyword"), F.lit("seed").alias("keyword_type"), F.lit(90).alias("weight"), F.lit(True).alias("is_active"))
    variants = F.array("name", short, F.replace("name", F.lit("#"), F.lit(" ")), F.replace("name", F.lit("0"), F.lit("")))
    return tables.expand_keywords(e, old, variants)[0]


@query(
    """,,
x AS (SELECT query_key, ord, lower(concat_ws(' ', title, content, source, url)) AS hay, lower(source) AS a, lower(lang) AS b FROM v_results),
s AS (SELECT query_key, ord, 12 * contains(hay, a)::INT + 3 * (contains(hay, b)::INT + CASE WHEN a <> b THEN contains(hay, a)::INT ELSE 0 END) AS s1 FROM x)
SELECT query_key, ord, CAST(s1 AS INT) AS s1, CAST(row_number() OVER (PARTITION BY query_key ORDER BY s1 DESC, ord) AS INT) AS rank FROM s""",
    "v_results",
)
def rank_by_own_terms(v, t):
    """Each row is scored by terms of its own: an entity and question for each row."""
    own = lambda *c: F.array(*(F.lower(F.coalesce(F.col(x), F.lit("\0"))) for x in c))
    none = ("\0",)
    terms = search.SearchTerms(entity=own("source"), question=own("lang", "source"), evidence=none, rank_review=none, rank_history=none, authority=none)
    ranked = search.rank_results(v("v_results").withColumn("source_type", F.lit("other")), terms)
    again = rank.ranked(ranked.select("query_key", "ord", "s1"), ["query_key"], [F.desc("s1"), F.col("ord")])
    return again
