"""Joins: entity resolution, hydration, containment, expansion, watchlists, comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.operators.rank import LOOKUP_BYTES, _fits, containing, top
from attesta.operators.store import written


def resolve_entities(names: DataFrame, entities: DataFrame, keywords: DataFrame) -> DataFrame:
    """(name, entity_id) for each name: by exact name, then active keyword, then alias; the least id wins.

    entities: entity_id, name, aliases array<string>; keywords: entity_id, keyword, is_active.
    """
    exact = entities.select("entity_id", F.col("name").alias("label"), F.lit(1).alias("rule"))
    word = keywords.where("is_active").select("entity_id", F.col("keyword").alias("label"), F.lit(2).alias("rule"))
    alias = entities.select("entity_id", F.explode("aliases").alias("label"), F.lit(3).alias("rule"))
    best = exact.unionByName(word).unionByName(alias).groupBy("label").agg(F.min(F.struct("rule", "entity_id")).alias("b"))
    found = best.select(F.col("label").alias("name"), F.col("b.entity_id").alias("entity_id"), F.col("b.rule").alias("rule"))
    return names.select("name").distinct().join(found.hint("merge"), "name", "left")


def hydrate(results: DataFrame, sources: DataFrame, fields: list[str]) -> DataFrame:
    """Fill missing (null or empty) fields of results from the source with the same trimmed url; of several sources of one
    url the greatest value of each field counts, so that no result is doubled."""
    known = sources.where("trim(url) <> ''").groupBy(F.trim("url").alias("_url")).agg(*(F.max(f).alias(f"_{f}") for f in fields))
    joined = results.join(known, F.trim(results["url"]) == F.col("_url"), "left")
    filled = {f: F.coalesce(F.nullif(F.col(f), F.lit("")), F.col(f"_{f}"), F.col(f)) for f in fields}
    return joined.withColumns(filled).select(results.columns)


def merge_enrichment(results: DataFrame, crawled: DataFrame) -> DataFrame:
    """Take a crawled title of four characters or more and a content of twenty or more; snippet is its first 700. Of several
    crawls of one url the one with the longest content counts."""
    best = F.max_by(F.struct("title", "content"), F.struct(F.length(F.coalesce("content", F.lit(""))), F.coalesce("content", F.lit("")), F.coalesce("title", F.lit("")))).alias("b")
    new = crawled.groupBy(F.trim("url").alias("_url")).agg(best).select("_url", F.col("b.title").alias("_title"), F.col("b.content").alias("_content"))
    joined = results.join(new, F.trim(results["url"]) == F.col("_url"), "left")
    title, body = F.length("_title") >= 4, F.length("_content") >= 20
    out = joined.withColumn("title", F.when(title, F.col("_title")).otherwise(F.col("title")))
    out = out.withColumn("snippet", F.when(body, F.substring("_content", 1, 700)).otherwise(F.col("snippet")))
    out = out.withColumn("content", F.when(body, F.col("_content")).otherwise(F.col("content")))
    return out.withColumn("enriched", F.coalesce(title | body, F.lit(False))).select(*results.columns, "enriched")


def anti_by_url(cached: DataFrame, live: DataFrame) -> DataFrame:
    """Cached rows whose trimmed url no live row of the query has."""
    urls = live.select("query_key", F.trim("url").alias("_url")).distinct()
    return cached.join(urls, (cached["query_key"] == urls["query_key"]) & (F.trim(cached["url"]) == urls["_url"]), "left_anti")


def lookup(rows: DataFrame, most: int = 1_000_000, most_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """A stored lookup table with a join hint: broadcast if its rows and bytes, which are counted, are within the bounds, else sort-merge."""
    return F.broadcast(rows) if _fits(rows, most, most_bytes) else rows.hint("merge")


def term_hits(sources: DataFrame, terms: DataFrame, text: Column, key: str = "source_id", gram: int = 3, few: int = 200) -> DataFrame:
    """(key, terms): the distinct terms that the (lower-case) text of the sources of each key holds, in any case. Each term is looked up once, however
    many queries ask for it: by `containing`, an index of first grams with an exact test. Sources without any have no row."""
    wanted = terms.select("term").where("term <> ''").distinct()
    met = containing(sources.select(key, text.alias("_said")), F.col("_said"), wanted.withColumn("_low", F.lower("term")), F.col("_low"), gram, few)
    return met.groupBy(key).agg(F.collect_set("term").alias("terms"))


def cached_sources(requests: DataFrame, queries: DataFrame, cards: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """Sources behind the cards of each request's entity, found by the request's own terms.

    requests: query_key, entity_id, search_mode (null: any), terms, exact_terms, question_terms (arrays of strings); queries: query_id,
    entity_id, search_mode; cards: query_id, source_id, relevance, credibility; sources: source_id, url, title, content, site_name,
    updated_at, published_at.

    First the best 3 * limit sources that hold one of the terms in title, content or url: by their best relevance and credibility, their last
    query, then the latest update and publication. Of those the first `limit` that name the entity (an exact term) and, if there are question
    terms, one of them, in title, content, site or url; of one url only the first counts. Titles and contents are not in the result.

    Texts are read once, for the terms that each source holds; requests meet the cards of their own entity alone, and terms are compared there, so
    that the work grows with the cards, not with requests times sources.
    """
    key = ["query_key"]
    src, _ = written(sources.withColumn("_row", F.monotonically_increasing_id()), "asked-sources")
    listed = lambda *cs: reduce(DataFrame.unionByName, (requests.select(F.explode(c).alias("term")) for c in cs))
    # a character that no text holds keeps a term from reaching over two fields
    held, _ = written(term_hits(src, listed("terms"), F.lower(F.concat_ws("\u0000", "title", "content", "url"))).withColumnRenamed("terms", "_held"), "held-terms")
    said = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("title", "content", "site_name", "url"))))
    names = term_hits(src, listed("exact_terms", "question_terms"), said, "_row").withColumnRenamed("terms", "_names")
    src = src.select("_row", "source_id", F.trim("url").alias("url"), "site_name", "updated_at", "published_at")
    named, _ = written(src.select("_row", "url", "site_name").where("url <> ''").join(names.hint("merge"), "_row", "left"), "named-sources")
    dated, _ = written(src.select("_row", "source_id", "updated_at", "published_at"), "dated-sources")
    used = cards.select("query_id", "source_id", "relevance", "credibility").join(queries.select("query_id", "entity_id", F.col("search_mode").alias("_mode")).hint("merge"), "query_id")
    met = used.join(requests.select(*key, "entity_id", "search_mode", "terms").hint("merge"), "entity_id").where(F.col("search_mode").isNull() | (F.col("_mode") == F.col("search_mode")))
    met = met.select(*key, "source_id", "query_id", "relevance", "credibility", "terms").join(lookup(held), "source_id").where(F.arrays_overlap("terms", "_held"))
    best = met.groupBy(*key, "source_id").agg(F.max("relevance").alias("relevance"), F.max("credibility").alias("credibility"), F.max("query_id").alias("latest_query_id"))
    best = best.join(lookup(dated), "source_id")
    order = [F.desc("relevance"), F.desc("credibility"), F.desc("latest_query_id"), F.col("updated_at").desc_nulls_last(), F.col("published_at").desc_nulls_last(), F.col("source_id")]
    first = top(best, key, order, 3 * max(1, limit), "_over")
    rows = first.join(requests.select(*key, "exact_terms", "question_terms").hint("merge"), "query_key").join(lookup(named), "_row")
    # an empty term is in every text; a source that holds none of the terms is met by that alone
    empty = lambda c: F.coalesce(F.array_contains(c, ""), F.lit(False))
    some = lambda c: empty(c) | F.coalesce(F.arrays_overlap(c, "_names"), F.lit(False))
    rows = rows.where(some("exact_terms") & ((F.size(F.coalesce("question_terms", F.array())) == 0) | some("question_terms")))
    once = top(rows.drop("_row", "_names", "exact_terms", "question_terms"), [*key, "url"], [F.col("_over")], 1, "_copy").drop("_copy")
    return top(once, key, [F.col("_over")], limit).drop("_over")


#: Up to so many needles are broadcast and tested one by one; more are blocked by grams.
FEW_NEEDLES = 200


def match_corpus(corpus: DataFrame, needles: DataFrame, per_entity: int, gram: int = 3, few: int = FEW_NEEDLES) -> DataFrame:
    """Posts (post_id, content) that contain an entity's needle (entity, needle), at most per_entity by post_id.

    How posts meet needles is said in `containing`.
    """
    needles = needles.where(F.length("needle") > 0).select("entity", "needle").distinct()
    met = containing(corpus.select("post_id", "content"), F.col("content"), needles, F.col("needle"), gram, few)
    return top(met.select("entity", "post_id").distinct(), ["entity"], [F.col("post_id")], per_entity)


def expand_queries(entities: DataFrame, focus: list[str], generic: list[str]) -> DataFrame:
    """Search queries of each entity (query_key, name, variants): focus templates with the first variant, then each generic
    template with all variants; trimmed, first of equals stays. Templates hold {base}."""
    template = lambda items: F.array(*map(F.lit, items)).cast("array<string>")
    fill = lambda t, v: F.trim(F.replace(t, F.lit("{base}"), v))
    first = F.transform(template(focus), lambda t: fill(t, F.get("variants", 0)))
    rest = F.flatten(F.transform(template(generic), lambda t: F.transform("variants", lambda v: fill(t, v))))
    made = F.array_distinct(F.filter(F.concat(first, rest), lambda q: q != ""))
    return entities.select("query_key", F.posexplode(made).alias("ord", "query"))


def due_watchlist(watchlist: DataFrame, as_of: str, interval_days: int, types: list[str], limit: int) -> DataFrame:
    """Watched entities of the given types whose next crawl is due, by priority, then name."""
    due = F.col("last_at").isNull() | (F.date_add(F.to_date("last_at"), interval_days) <= F.lit(as_of).cast("date"))
    return watchlist.where(F.col("entity_type").isin(*types) & due).orderBy("priority", "name").limit(limit).select("entity_id", "name", "priority")


def review_comments(comments: DataFrame, users: DataFrame, limit: int = 50) -> DataFrame:
    """Comments of each review, oldest first; who is anonymous shows no name."""
    joined = comments.join(users, "user_role", "left")
    name = F.when(F.col("is_anonymous"), "anonymous").otherwise(F.coalesce(F.nullif(F.col("display_name"), F.lit("")), F.lit("user")))
    shown = joined.withColumn("shown_name", name)
    return top(shown, ["review_id"], [F.col("comment_no")], max(1, min(200, limit))).select("review_id", "comment_no", "shown_name", "comment")


def entity_page(entities: DataFrame, profiles: DataFrame, comments: DataFrame, media: DataFrame, default_copy: dict[str, str], recent: int = 5) -> DataFrame:
    """One row for each entity (entity_id, name, entity_type): profile with a default intro by type, gallery, comments, media.

    The cover is the gallery's first item if there is none; a gallery of the cover alone is empty.
    """
    profile = profiles.select("entity_id", "headline", "intro", "cover", "gallery")
    page = entities.join(profile, "entity_id", "left")
    gallery = F.coalesce("gallery", F.array().cast("array<string>"))
    cover = F.coalesce(F.nullif(F.col("cover"), F.lit("")), F.get(gallery, 0))
    copy = F.coalesce(*(F.when(F.col("entity_type") == k, F.lit(text)) for k, text in default_copy.items()), F.lit(""))
    page = page.withColumns({"intro": F.coalesce(F.nullif(F.trim("intro"), F.lit("")), copy), "gallery": F.when((F.size(gallery) == 1) & (F.get(gallery, 0) == cover), F.array().cast("array<string>")).otherwise(gallery), "cover": cover})
    said = top(comments, ["entity_id"], [F.desc("comment_id")], recent, "_k")
    newest = said.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "comment"))), lambda x: x["comment"]).alias("recent_comments"))
    files = top(media, ["entity_name"], [F.desc("id")], recent, "_k").groupBy("entity_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "url"))), lambda x: x["url"]).alias("recent_media"))
    counts = comments.groupBy("entity_id").agg(F.count("*").alias("comment_count"))
    page = page.join(counts, "entity_id", "left").join(newest, "entity_id", "left").join(files, page["name"] == files["entity_name"], "left").drop("entity_name")
    return page.fillna(0, ["comment_count"])


def due_entities(watchlist: DataFrame, as_of: str, types: list[str], limit: int, only: DataFrame | None = None) -> DataFrame:
    """Active watched entities whose next_crawl_at has come or is missing, by priority, then name.

    only: (entity_id) of entities asked for by name, such as resolve_entities gives; then their type doesn't matter.
    """
    due = F.col("is_active") & (F.col("next_crawl_at").isNull() | (F.col("next_crawl_at") <= F.lit(as_of).cast("timestamp_ntz")))
    rows = watchlist.where(due)
    kind = F.lower(F.coalesce("entity_type", F.lit("organization")))
    rows = rows.join(only.select("entity_id").distinct(), "entity_id", "left_semi") if only is not None else rows.where(kind.isin(*types) if types else F.lit(True))
    return rows.orderBy("priority", "name").limit(max(1, limit)).select("entity_id", "name", F.coalesce("priority", F.lit(3)).alias("priority"), "next_crawl_at")
