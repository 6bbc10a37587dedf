"""The star-schema tables as the library's relations, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_entities": """SELECT DISTINCT source AS name, CASE WHEN source IN ('src0','src1','src2','src3','src4') THEN 'zoo' ELSE 'organization' END AS entity_type FROM {documents}""",
    "v_results": """SELECT CAST(floor(doc_id / 50) AS BIGINT) AS query_key, doc_id AS ord,
        concat('https://h', CAST(CAST(floor(doc_id / 2) AS BIGINT) % 5 AS STRING), '.example/p/', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING)) AS url,
        substring(text, 1, 3) AS title, text AS content, source, lang FROM {documents}""",
    "v_reviews": """SELECT d.doc_id AS review_id, d.source AS entity, d.lang AS platform, d.text AS content,
        CAST(CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 0.9 ELSE 0.4 END AS DOUBLE) AS relevance_score,
        CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'opposing' WHEN l.quality = 1 THEN 'supporting' ELSE 'neutral' END AS stance,
        CASE WHEN l.doc_id IS NULL THEN NULL ELSE 'review' END AS content_type
        FROM {documents} d LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "v_rating_events": """SELECT event_id, user_id, CAST(event_id % (SELECT max(doc_id) + 1 FROM {documents}) AS BIGINT) AS review_id, CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS INT) AS score, ts FROM {events}""",
    "v_queries": """SELECT o_orderkey AS query_id, o_custkey AS entity_id, o_orderpriority AS question, o_orderstatus AS search_mode, o_orderdate AS created_at,
        CAST(floor(o_totalprice) AS BIGINT) % 101 AS confidence FROM {orders}""",
    "v_cards": """SELECT l_orderkey AS query_id, l_suppkey AS source_id, l_linenumber AS card_no, CAST(l_quantity AS INT) AS relevance,
        CAST(floor(l_extendedprice) AS BIGINT) % 101 AS credibility, l_returnflag AS stance, l_linestatus AS strength FROM {lineitem}""",
    "v_sources": """SELECT s_suppkey AS source_id, s_name AS site_name, n.n_name AS source_type FROM {supplier} s JOIN {nation} n ON n.n_nationkey = s.s_nationkey""",
    "v_watchlist": """SELECT c_custkey AS entity_id, c_name AS name, c_mktsegment AS entity_type, c_nationkey AS priority, o.last_at
        FROM {customer} c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_at FROM {orders} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey""",
    "v_media": """SELECT p_partkey AS id, p_brand AS entity_name, CASE WHEN p_size % 4 = 0 THEN 'video' ELSE 'image' END AS media_type,
        CAST(floor(p_retailprice) AS BIGINT) AS file_size FROM {part}""",
    "v_comments": """SELECT conv_id AS review_id, turn AS comment_no, role AS user_role, text AS comment, turn % 3 = 0 AS is_anonymous FROM {conversations}""",
}

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of VIEWS over the tables in sf_dir."""
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def with_views(body: str, *names: str) -> str:
    """DuckDB SQL: body with the named views as common table expressions before it."""
    plain = {t: t for t in TABLES}
    views = ",\n".join(f"{n} AS ({VIEWS[n].format(**plain)})" for n in names)
    return f"WITH RECURSIVE {views}{',' if body.lstrip().startswith(',,') else ''}\n{body.lstrip().removeprefix(',,')}"
