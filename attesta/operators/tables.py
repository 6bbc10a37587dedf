"""Keyed upserts, version history and maintenance. Each operator returns the new rows; store.merge_table writes them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.classify import is_junk
from attesta.functions.text import host_of
from attesta.operators import store
from attesta.operators.rank import ranked, top


def log_run(runs: DataFrame, path: str) -> None:
    """Append (pipeline, entity, status, rows_written, error); a failed run has written nothing."""
    runs.withColumn("rows_written", F.when(F.col("status") == "failed", 0).otherwise(F.col("rows_written"))).write.mode("append").parquet(path)


def review_hash() -> Column:
    return F.md5(F.concat_ws(":", "entity", "platform", "author", F.substring("content", 1, 200)).cast("binary"))


def first_reviews(incoming: DataFrame) -> DataFrame:
    """Reviews with trimmed content that isn't blank and their content_hash: the first (by review_id) of each hash."""
    new = incoming.withColumn("content", F.trim("content")).where("content <> ''").withColumn("content_hash", review_hash())
    first = F.min_by(F.struct(*(c for c in new.columns if c != "content_hash")), "review_id").alias("r")
    return new.groupBy("content_hash").agg(first).select("r.*", "content_hash").select(*incoming.columns, "content_hash")


def ingest_reviews(table: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows to insert: trimmed, not blank, the first (by review_id) of each content hash, unless the table has it.

    Rows with a hash are never updated. table needs content_hash only.
    """
    return first_reviews(incoming).join(table.select("content_hash").distinct(), "content_hash", "left_anti").select(*incoming.columns, "content_hash")


def upsert_sources(table: DataFrame, incoming: DataFrame, keep_if_empty: list[str], keep_if_null: list[str], seq: str = "ord") -> DataFrame:
    """Sources by url, field by field: the last value that isn't empty (or null), by seq; the old table comes first. Adds domain.

    Of incoming rows the url is trimmed, and rows without one go; a missing source_type counts as "other" and so overwrites what
    was there; a missing site_name is the url's domain.
    """
    columns = ["url", *keep_if_empty, *keep_if_null]
    incoming = incoming.withColumn("url", F.trim("url")).where("url <> ''")
    or_else = {"source_type": F.lit("other"), "site_name": host_of(F.col("url"))}
    incoming = incoming.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), value) for c, value in or_else.items() if c in columns})
    rows = table.select(*columns, F.lit(0).alias("_batch"), F.col(seq).alias("_seq")).unionByName(incoming.select(*columns, F.lit(1).alias("_batch"), F.col(seq).alias("_seq")))
    at = F.struct("_batch", "_seq")
    last = lambda c, there: F.max_by(c, F.when(there, at)).alias(c)
    out = rows.groupBy("url").agg(*(last(c, F.coalesce(F.col(c), F.lit("")) != "") for c in keep_if_empty), *(last(c, F.col(c).isNotNull()) for c in keep_if_null))
    return out.withColumn("domain", host_of(F.col("url")))


SNAPSHOT_KEY = ["entity_id", "search_mode"]


def snapshot_versions(events: DataFrame, body: list[str]) -> DataFrame:
    """(entity_id, search_mode, snapshot_hash, first, last) of each distinct body; first and last are (created_at, query_id)."""
    digest = F.sha2(F.to_json(F.struct(*body), {"ignoreNullFields": "false"}).cast("binary"), 256)
    at = F.struct("created_at", "query_id")
    return events.withColumn("snapshot_hash", digest).groupBy(*SNAPSHOT_KEY, "snapshot_hash").agg(F.min(at).alias("first"), F.max(at).alias("last"))


def number_versions(versions: DataFrame) -> DataFrame:
    """Versions with their number (by first appearance) and is_latest (by last appearance) within each (entity_id, search_mode)."""
    numbered = ranked(ranked(versions, SNAPSHOT_KEY, [F.col("first")], "version"), SNAPSHOT_KEY, [F.desc("last")], "_newest")
    return numbered.withColumn("is_latest", F.col("_newest") == 1).drop("_newest")


def snapshot_history(events: DataFrame, body: list[str]) -> DataFrame:
    """Versions of each (entity_id, search_mode): one for each distinct body, refreshed when it comes again.

    Adds version (by first appearance) and is_latest (by last appearance).
    """
    numbered = number_versions(snapshot_versions(events, body))
    return numbered.select(*SNAPSHOT_KEY, "snapshot_hash", "version", F.col("last.created_at").alias("generated_at"), "is_latest")


def merge_snapshots(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored versions (as number_versions gives them) with new ones (as snapshot_versions gives them): only the (entity_id, search_mode) that have
    new ones are numbered again. Any split of the events into parts, in any order, ends in the versions of one pass."""
    plain = [*SNAPSHOT_KEY, "snapshot_hash", "first", "last"]
    changed = new.select(*SNAPSHOT_KEY).distinct()
    same = stored.join(changed.hint("merge"), SNAPSHOT_KEY, "left_anti")
    rows = stored.join(changed.hint("merge"), SNAPSHOT_KEY, "left_semi").select(*plain).unionByName(new.select(*plain))
    return same.unionByName(number_versions(rows.groupBy(*plain[:3]).agg(F.min("first").alias("first"), F.max("last").alias("last"))).select(stored.columns))


def save_snapshots(events: DataFrame, path: str, body: list[str], batch: int | None = None, buckets: int = 64) -> dict:
    """Bring events into the stored versions at path (a store of buckets by entity_id and search_mode): only the buckets that have events are
    read and written. A batch that is sent again changes nothing."""
    new = snapshot_versions(events, body)
    if not store.exists(events.sparkSession, path):
        store.write_table(number_versions(new.limit(0)), path, SNAPSHOT_KEY, buckets)
    return store.merge_table(new, path, merge_snapshots, "snapshots", batch)


def refresh_suggestions(templates: DataFrame, questions: DataFrame, follow_up: list[str] | dict[str, list[str]], most: int = 8) -> DataFrame:
    """Suggested questions of each (entity_id, search_mode): templates (82), the questions of its last four queries by id (75), follow-ups
    (72; of all modes, or by mode); trimmed, first of equal texts, blank ones go, at most `most`."""
    key = ["entity_id", "search_mode"]
    question = F.trim("question").alias("question")
    recent = top(questions, key, [F.desc("query_id")], 4, "pos").where("trim(question) <> ''").select(*key, question, F.lit(75).alias("confidence"), "pos")
    base = templates.select(*key, question, F.lit(82).alias("confidence"), "pos")
    pairs = templates.select(*key).distinct()
    texts = lambda items: F.array(*map(F.lit, items)).cast("array<string>")
    if isinstance(follow_up, dict):
        open_questions = F.coalesce(*(F.when(F.col("search_mode") == mode, texts(items)) for mode, items in follow_up.items()), texts([]))
    else:
        open_questions = texts(follow_up)
    more = pairs.select(*key, F.posexplode(open_questions).alias("pos", "question")).select(*key, "question", F.lit(72).alias("confidence"), "pos")
    union = base.unionByName(recent).unionByName(more)
    once = union.groupBy(*key, "question").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "pos")).alias("b"))
    return top(once, key, [F.col("b"), F.col("question")], most, "place").select(*key, "question", (-F.col("b.c")).alias("confidence"), "place")


def register_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Add aliases (entity_id, alias) to entities (entity_id, name, aliases): not the name, once each, sorted."""
    new = aliases.where("alias is not null and trim(alias) <> ''").groupBy("entity_id").agg(F.collect_set(F.trim("alias")).alias("more"))
    joined = entities.join(new, "entity_id", "left")
    both = F.array_distinct(F.concat("aliases", F.coalesce("more", F.array().cast("array<string>"))))
    return joined.withColumn("aliases", F.array_sort(F.filter(both, lambda a: a != F.col("name")))).drop("more")


def prune_aliases(entities: DataFrame, blocked: list[str]) -> DataFrame:
    return entities.withColumn("aliases", F.array_except("aliases", F.array(*map(F.lit, blocked)).cast("array<string>")))


def prune_keywords(entities: DataFrame, keywords: DataFrame, blocked: list[str]) -> DataFrame:
    """Keywords (entity_id, keyword, ...) without the blocked ones of entities that have them as an alias."""
    bad = entities.select("entity_id", F.explode("aliases").alias("keyword")).where(F.col("keyword").isin(*blocked)).distinct()
    return keywords.join(bad.hint("merge"), ["entity_id", "keyword"], "left_anti")


def expand_keywords(entities: DataFrame, keywords: DataFrame, variants: Column) -> tuple[DataFrame, DataFrame]:
    """Keywords (entity_id, keyword, keyword_type, weight, is_active) with each entity's name variants that it doesn't have, as aliases of
    weight 70; and entities with all variants among their aliases, sorted."""
    made = F.array_except(variants, F.array("name"))
    new = entities.select("entity_id", F.explode(F.array_distinct(made)).alias("keyword")).join(keywords.select("entity_id", "keyword").hint("merge"), ["entity_id", "keyword"], "left_anti")
    new = new.withColumns({"keyword_type": F.lit("alias"), "weight": F.lit(ALIAS_WEIGHT), "is_active": F.lit(True)})
    synced = entities.withColumn("aliases", F.array_sort(F.array_distinct(F.concat(F.coalesce("aliases", F.array().cast("array<string>")), made))))
    return keywords.unionByName(new), synced


def upsert_profiles(profiles: DataFrame, incoming: DataFrame, replace_gallery: bool = False) -> DataFrame:
    """Profiles (entity_id, headline, intro, cover, gallery): blank headlines and intros are filled; cover and gallery are replaced where the
    incoming gallery has items, or all if flagged. New entities come in as they are."""
    fields = ("headline", "intro", "cover", "gallery")
    new = incoming.select("entity_id", F.lit(True).alias("_new"), *(F.col(c).alias(f"_{c}") for c in fields))
    joined = profiles.select("entity_id", F.lit(True).alias("_old"), *fields).join(new, "entity_id", "full")
    fill = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.trim(f"_{c}"), F.col(c)).alias(c)
    swap = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.size(F.coalesce("_gallery", F.array().cast("array<string>"))) > 0) | F.lit(replace_gallery))
    return joined.select("entity_id", fill("headline"), fill("intro"), *(F.when(swap, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in ("cover", "gallery")))


def seed_watchlist(watchlist: DataFrame, seeds: DataFrame) -> DataFrame:
    """Watched entities with the seeds' (entity_id, priority, refresh_interval_hours, default_mode) in place of their own; new ones are
    active."""
    fields = ("priority", "refresh_interval_hours", "default_mode")
    new = seeds.select("entity_id", *(F.col(c).alias(f"_{c}") for c in fields))
    joined = watchlist.join(new.hint("merge"), "entity_id", "full")
    return joined.select("entity_id", F.coalesce("is_active", F.lit(True)).alias("is_active"), *(F.coalesce(f"_{c}", c).alias(c) for c in fields), *(c for c in watchlist.columns if c not in ("entity_id", "is_active", *fields)))


#: Weights of an entity's keywords: its name, the aliases of a seed, other aliases.
CANONICAL_WEIGHT, SEED_WEIGHT, ALIAS_WEIGHT = 100, 80, 70


def seed_keywords(entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """Keywords of entities (entity_id, name, aliases) and their seeds (entity_id, keyword), each once with its greatest weight."""
    of = lambda kind, weight: (F.lit(kind).alias("keyword_type"), F.lit(weight).alias("weight"))
    rows = entities.select("entity_id", F.trim("name").alias("keyword"), *of("canonical", CANONICAL_WEIGHT))
    rows = rows.unionByName(seeds.select("entity_id", F.trim("keyword").alias("keyword"), *of("alias", SEED_WEIGHT)))
    rows = rows.unionByName(entities.select("entity_id", F.explode("aliases").alias("keyword")).select("entity_id", F.trim("keyword").alias("keyword"), *of("alias", ALIAS_WEIGHT)))
    best = rows.where("keyword <> ''").groupBy("entity_id", "keyword").agg(F.max_by("keyword_type", "weight").alias("keyword_type"), F.max("weight").alias("weight"))
    return best.withColumn("is_active", F.lit(True))


def enroll_watchlist(watchlist: DataFrame, entities: DataFrame, hours: int = 168) -> DataFrame:
    """Rows for entities that aren't watched yet."""
    return entities.join(watchlist.select("entity_id"), "entity_id", "left_anti").select("entity_id", F.lit(True).alias("is_active"), F.lit(3).alias("priority"), F.lit(hours).alias("refresh_interval_hours"))


def mark_refresh(watchlist: DataFrame, outcomes: DataFrame, as_of: str, retry_minutes: int = 60) -> DataFrame:
    """After a run (entity_id, ok, message): clear the error and wait an interval, or keep it and retry soon."""
    at = F.lit(as_of).cast("timestamp_ntz")
    joined = watchlist.join(outcomes, "entity_id", "left")
    later = F.when(F.col("ok"), at + F.make_dt_interval(hours=F.col("refresh_interval_hours"))).when(~F.col("ok"), at + F.make_dt_interval(mins=F.lit(retry_minutes)))
    out = joined.withColumn("next_crawl_at", F.coalesce(later, F.col("next_crawl_at")))
    out = out.withColumn("last_error_message", F.when(F.col("ok"), F.lit(None)).when(~F.col("ok"), F.substring("message", 1, 500)).otherwise(F.col("last_error_message")))
    return out.drop("ok", "message")


REACTIONS = ("like", "helpful", "disagree")


def reactions(events: DataFrame, allowed=REACTIONS) -> DataFrame:
    """Reactions that stand: the last of add and remove for each (review_id, user_id, reaction)."""
    last = events.where(F.col("reaction").isin(*allowed)).groupBy("review_id", "user_id", "reaction").agg(F.max_by("action", F.struct("ts", "event_id")).alias("action"))
    return last.where("action = 'add'").drop("action")


def relabel_junk(reviews: DataFrame) -> DataFrame:
    """Junk becomes unrelated with relevance 0; a second run changes nothing."""
    junk = is_junk(F.col("content")) & (F.coalesce("content_type", F.lit("")) != "unrelated")
    out = reviews.withColumn("_junk", junk).withColumn("relevance_score", F.when(F.col("_junk"), 0.0).otherwise(F.col("relevance_score")))
    out = out.withColumn("stance", F.when(F.col("_junk"), "unclear").otherwise(F.col("stance")))
    return out.withColumn("content_type", F.when(F.col("_junk"), "unrelated").otherwise(F.col("content_type"))).drop("_junk")


def apply_labels(reviews: DataFrame, labels: DataFrame) -> DataFrame:
    """Write labels (review_id and some of the reviews' columns) onto reviews; other reviews stay."""
    fields = [c for c in labels.columns if c != "review_id"]
    new = labels.select("review_id", *(F.col(c).alias(f"_{c}") for c in fields))
    return reviews.join(new, "review_id", "left").withColumns({c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in fields}).select(reviews.columns)


def upsert_evidence_sources(table: DataFrame, cards: DataFrame) -> DataFrame:
    """Sources by url from cards: site, type, title and content (the snippet, 700 characters) are overwritten, dates only
    filled, the author stays. New urls are added."""
    fields = ["site_name", "source_type", "title", "content"]
    new = cards.groupBy("url").agg(F.max_by(F.struct("source", "source_type", "title", F.substring("snippet", 1, 700).alias("content"), "published_at"), "ord").alias("n"))
    new = new.select("url", F.col("n.source").alias("_site_name"), *(F.col(f"n.{c}").alias(f"_{c}") for c in ("source_type", "title", "content", "published_at")))
    joined = table.join(new, "url", "full")
    return joined.select("url", *(F.coalesce(f"_{c}", c).alias(c) for c in fields), "author", F.coalesce("published_at", "_published_at").alias("published_at"))


def create_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (name) that neither a name nor an alias of an entity equals."""
    known = entities.select("name").unionByName(entities.select(F.explode("aliases").alias("name"))).distinct()
    return names.select(F.trim("name").alias("name")).where("name <> ''").distinct().join(known.hint("merge"), "name", "left_anti")


def append_comments(comments: DataFrame, incoming: DataFrame, removals: DataFrame | None = None) -> DataFrame:
    """Comments with new ones that aren't blank, trimmed; without those that their own writer removes (comment_id, user_id)."""
    new = incoming.withColumn("comment", F.trim("comment")).where("comment <> ''")
    out = comments.unionByName(new, allowMissingColumns=True)
    return out.join(removals.select("comment_id", "user_id"), ["comment_id", "user_id"], "left_anti") if removals is not None else out


def media_append(media: DataFrame, incoming: DataFrame, canonical: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Media with new files under their entity's canonical name (name, canonical_name); the comment is the caption if there is one."""
    named = incoming.join(canonical, incoming["entity_name"] == canonical["name"], "left").drop("name")
    named = named.withColumn("entity_name", F.coalesce("canonical_name", "entity_name")).drop("canonical_name")
    named = named.withColumn("caption", F.coalesce(F.nullif(F.trim("comment"), F.lit("")), F.col("caption"))).drop("comment")
    out = media.unionByName(named, allowMissingColumns=True)
    return out.join(deleted.select("id"), "id", "left_anti") if deleted is not None else out
