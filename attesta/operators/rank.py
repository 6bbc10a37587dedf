"""Ranking, diversified top-k and latest-row operators, as windows over each query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, key: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def top(df: DataFrame, key: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first n rows of each key; Spark limits each map task's groups before the shuffle."""
    return ranked(df, key, order, name).where(F.col(name) <= n)


def latest(df: DataFrame, key: list[str], at: list[str]) -> DataFrame:
    """The row of each key with the greatest `at` columns: a map-side-combined aggregate, no sort."""
    rest = [c for c in df.columns if c not in key]
    out = df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("_row"))
    return out.select(*key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def page(df: DataFrame, key: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return top(df, key, order, offset + limit).where(F.col("rank") > offset)


def by_quota(df: DataFrame, key: list[str], rank: str, bucket: str, quota: Column, bucket_pos: Column, counts: Column | None = None, place: str = "place") -> DataFrame:
    """Diversify: first each bucket's best rows up to its quota, in bucket order, then all others by rank.

    counts: which rows may use the quota (all by default). Adds `place` from 1. All windows share the key, so there is one shuffle.
    """
    counts = F.lit(True) if counts is None else counts
    within = Window.partitionBy(*key, bucket).orderBy(F.when(counts, 0).otherwise(1), rank)
    first = counts & (F.row_number().over(within) <= quota)
    df = df.withColumn("_phase", F.when(first, 0).otherwise(1)).withColumn("_pos", F.when(F.col("_phase") == 0, bucket_pos).otherwise(F.lit(0)))
    order = Window.partitionBy(*key).orderBy("_phase", "_pos", rank)
    return df.withColumn(place, F.row_number().over(order)).drop("_phase", "_pos")


#: Result buckets in order, with their quotas: for questions about controversy or money, and for others.
RESULT_QUOTAS = {
    True: {"news": 2, "forum": 2, "fundraising": 2, "social": 1, "official": 1, "other": 1},
    False: {"official": 2, "news": 2, "forum": 2, "social": 2, "fundraising": 1, "other": 2},
}


def _table(of: Column, values: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, value in reversed(values.items()):
        out = F.when(of == name, value).otherwise(out)
    return out


def diversify_results(df: DataFrame, controversial: Column) -> DataFrame:
    """Diversify ranked results (query_key, rank, url, bucket) by the quotas of their query's kind.

    Queries of at most three rows stay as they are; rows without a url go otherwise. Only the first row of a url counts.
    """
    key = ["query_key"]
    whole = Window.partitionBy(*key)
    df = df.withColumn("_n", F.count("*").over(whole))
    few = df.where("_n <= 3").withColumn("place", F.row_number().over(whole.orderBy("rank")))
    many = df.where(F.col("_n").__gt__(3) & (F.coalesce("url", F.lit("")) != ""))
    once = many.withColumn("_copy", F.row_number().over(Window.partitionBy(*key, "url").orderBy("rank"))).where("_copy = 1").drop("_copy")
    position = {k: {b: i for i, b in enumerate(q)} for k, q in RESULT_QUOTAS.items()}
    quota = F.when(controversial, _table(F.col("bucket"), RESULT_QUOTAS[True], 1)).otherwise(_table(F.col("bucket"), RESULT_QUOTAS[False], 1))
    place = F.when(controversial, _table(F.col("bucket"), position[True], 9)).otherwise(_table(F.col("bucket"), position[False], 9))
    return by_quota(once, key, "rank", "bucket", quota, place).unionByName(few).drop("_n")


#: Platforms of cards in order, and their quotas, if any card of the query is about fundraising.
CARD_ORDER = ("news", "ptt", "dcard", "forum", "fundraising", "google", "facebook", "instagram", "threads", "official", "other")
CARD_QUOTAS = {"official": 1, "news": 2, "ptt": 2, "dcard": 2, "forum": 2, "fundraising": 2, "other": 2}


def diversify_cards(df: DataFrame, limit: int) -> DataFrame:
    """Diversify ranked cards (query_key, rank, url, platform, claim_type) to at most `limit` per query.

    Platforms take two cards each in the order of their first card; if any card is about fundraising, a fixed
    order and quotas hold. The quota is dealt before copies of a url go. Queries of at most two cards stay. Of queries whose cards
    are marked `fallback`, at most 10 are kept.
    """
    key = ["query_key"]
    whole = Window.partitionBy(*key)
    df = df.withColumn("_n", F.count("*").over(whole)).withColumn("_money", F.max(F.col("claim_type") == "fundraising").over(whole))
    df = df.withColumn("_first", F.min("rank").over(Window.partitionBy(*key, "platform")))
    quota = F.when(F.col("_money"), _table(F.col("platform"), CARD_QUOTAS, 1)).otherwise(F.lit(2))
    order = F.when(F.col("_money"), _table(F.col("platform"), {p: i for i, p in enumerate(CARD_ORDER)}, 99) * 1_000_000 + F.col("_first")).otherwise(F.col("_first"))
    placed = by_quota(df, key, "rank", "platform", F.when(F.col("_n") <= 2, F.lit(2)).otherwise(quota), F.when(F.col("_n") <= 2, F.col("rank")).otherwise(order), place="_place")
    copies = F.row_number().over(Window.partitionBy(*key, "url").orderBy("_place"))
    most = F.when(F.col("fallback"), min(limit, 10)).otherwise(limit) if "fallback" in df.columns else F.lit(limit)
    once = placed.withColumn("_copy", copies).where((F.col("_copy") == 1) | (F.col("_n") <= 2))
    return ranked(once, key, [F.col("_place")], "place").where(F.col("place") <= most).drop("_n", "_money", "_first", "_place", "_copy")


def rank_cards(df: DataFrame, limit: int = 100, least: int = 40) -> DataFrame:
    """Cards (query_key, ord, relevance, credibility, first_hand, noise) in order, without noise.

    Cards below the least relevance go, unless a query has no other: then the best min(limit, 20) stay, marked `fallback`,
    of which diversify_cards keeps min(limit, 10).
    """
    order = [F.desc("relevance"), F.desc("credibility"), F.desc("first_hand"), F.col("ord")]
    # the most relevant card comes first, so that a query's first cards tell whether it has one that is good
    clean = top(df.where(~F.col("noise")), ["query_key"], order, limit)
    good = F.max(F.col("relevance") >= least).over(Window.partitionBy("query_key"))
    keep = F.when(F.col("_good"), F.col("relevance") >= least).otherwise(F.col("rank") <= min(limit, 20))
    return clean.withColumn("_good", F.coalesce(good, F.lit(False))).where(keep).withColumn("fallback", ~F.col("_good")).drop("_good")


def balanced_excerpts(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """At most n rows of each key: half supporting, half opposing, then neutral, then what is left of the
    first two. Adds `slot`, their order."""
    half = max(1, n // 2)
    df = ranked(df, [*key, "stance"], [F.col(c) for c in order], "_k")
    supporting, opposing = F.col("stance") == "supporting", F.col("stance") == "opposing"
    turn = F.when(supporting & (F.col("_k") <= half), 0).when(opposing & (F.col("_k") <= half), 1)
    turn = turn.when(supporting, 3).when(opposing, 4).otherwise(2)
    df = df.where(F.col("_k") <= n + half).withColumn("_turn", turn)
    return top(df, key, [F.col("_turn"), F.col("_k")], n, "slot").drop("_k", "_turn")


def order_queries(df: DataFrame, quotas: dict[str, int], order: list[str]) -> DataFrame:
    """Order expanded queries (query_key, ord, bucket): quotas of some buckets first, then one of each bucket in turn."""
    df = ranked(df, ["query_key", "bucket"], [F.col("ord")], "_k")
    quota = _table(F.col("bucket"), quotas, 0)
    first = F.col("_k") <= quota
    position = F.when(first, _table(F.col("bucket"), {b: i for i, b in enumerate(quotas)}, 99)).otherwise(_table(F.col("bucket"), {b: i for i, b in enumerate(order)}, 99))
    lap = F.when(first, F.lit(0)).when(_table(F.col("bucket"), {b: 0 for b in order}, 1) == 1, F.lit(1 << 30)).otherwise(F.col("_k") - quota)
    df = df.withColumn("_phase", F.when(first, 0).otherwise(1)).withColumn("_lap", lap).withColumn("_pos", position)
    return ranked(df, ["query_key"], [F.col("_phase"), F.col("_lap"), F.col("_pos"), F.when(first, F.col("_k")).otherwise(0), F.col("ord")], "place").drop("_k", "_phase", "_lap", "_pos")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return latest(snapshots, ["entity_id", "search_mode"], ["created_at", "query_id"])


def recent_queries(queries: DataFrame, k: int = 5) -> DataFrame:
    return top(queries.withColumn("confidence", F.coalesce("confidence", F.lit(0))), ["entity_id"], [F.desc("created_at"), F.desc("query_id")], k)


def list_reviews(reviews: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of each entity's reviews: by relevance (0.5 if it is missing), the newest first, those without a date last, then by id."""
    order = [F.coalesce("relevance_score", F.lit(0.5)).desc(), F.col("published_at").desc_nulls_last(), F.desc("review_id")]
    return page(reviews, ["entity"], order, max(1, limit), max(0, offset))


#: Bytes of needles (as JSON) up to which they are broadcast: to be tested one by one, and for a join on their grams.
FEW_BYTES, LOOKUP_BYTES = 1 << 20, 64 << 20


def _fits(rows: DataFrame, most: int, most_bytes: int) -> bool:
    """Whether there are at most so many rows, and bytes in them."""
    n, size = rows.limit(most + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n <= most and (size or 0) <= most_bytes


def containing(rows: DataFrame, text: Column, needles: DataFrame, needle: Column, gram: int = 3, few: int = 1000, lookup: int = 500_000) -> DataFrame:
    """Join rows with the needles that their text contains, each pair once.

    Few needles (counted, and their bytes) are broadcast. Beyond that an equi-join on the needle's first gram stands before the test, so that a
    text only meets needles that start somewhere in it; up to `lookup` needles (counted, and their bytes) are on each executor for it, so
    that the grams are not shuffled. An empty needle is in every text, null is in none.
    """
    if _fits(needles, few, FEW_BYTES):
        return rows.join(F.broadcast(needles), F.contains(text, needle))
    wanted = needles.withColumn("_first", F.substring(needle, 1, gram)).where("_first is not null")
    lengths = [r.n for r in wanted.select(F.length("_first").alias("n")).distinct().collect()]  # at most gram + 1 of them
    grams = F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1) if n else F.array(F.lit("")) for n in lengths)))
    side = F.broadcast(wanted) if _fits(wanted, lookup, LOOKUP_BYTES) else wanted.hint("merge")
    met = rows.withColumn("_gram", F.explode(grams)).join(side, F.col("_gram") == F.col("_first"))
    return met.where(F.contains(text, needle)).drop("_gram", "_first")


def suggestion_index(entities: DataFrame, gram: int = 3, most: int = 50) -> dict[str, DataFrame]:
    """Tables to suggest entities (name, aliases, reviews) from, so that a needle needs no look at all names:

    best: for each string of up to `gram` characters in a name or alias the first `most` entities; grams: the names that hold each string of
    `gram` characters; sizes: how many those are; labels: the names with what is compared. All in lower case; names are unique.
    """
    labels = F.transform(F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull()), F.lower)
    rows = entities.where(F.col("name").isNotNull()).select("name", F.coalesce("reviews", F.lit(0)).cast("long").alias("reviews"), labels.alias("labels"))
    cut = lambda n: F.flatten(F.transform("labels", lambda x: F.regexp_extract_all(x, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1)))
    pieces = rows.select("name", "reviews", "labels", F.explode(F.array_distinct(F.concat(*(cut(n) for n in range(1, gram + 1))))).alias("piece"))
    starts = F.exists("labels", lambda x: F.startswith(x, F.col("piece")))
    best = top(pieces.select("piece", "name", "reviews", starts.alias("starts")), ["piece"], [F.desc("starts"), F.desc("reviews"), F.col("name")], most)
    grams = pieces.where(F.char_length("piece") == gram).select("piece", "name")
    return {"best": best, "grams": grams, "sizes": grams.groupBy("piece").agg(F.count("*").alias("n")), "labels": rows}


def suggest_from(index: dict[str, DataFrame], needles: DataFrame, limit: int = 10, gram: int = 3) -> DataFrame:
    """Entities one of whose names (the name or an alias) contains the needle: first those with a name that starts with it, then by reviews, then
    name; from the tables of suggestion_index. A blank needle has none. Needles of up to `gram` characters read their list of best
    entities; longer ones the names that hold their rarest gram, each of which is tested."""
    asked = needles.select("needle", F.lower(F.trim("needle")).alias("_n")).where("_n <> ''").distinct()
    limit = max(1, min(50, limit))
    short = asked.where(F.char_length("_n") <= gram).join(index["best"].hint("merge"), F.col("_n") == F.col("piece")).where(F.col("rank") <= limit)
    parts = asked.where(F.char_length("_n") > gram).withColumn("piece", F.explode(F.array_distinct(F.regexp_extract_all("_n", F.lit(rf"(?s)(?=(.{{{gram}}}))"), 1))))
    # a gram that no name holds has no size: then no name holds the needle
    sized = parts.join(index["sizes"].hint("merge"), "piece", "left").groupBy("needle", "_n").agg(F.min_by("piece", F.coalesce("n", F.lit(0))).alias("piece"))
    met = sized.join(index["grams"].hint("merge"), "piece").join(index["labels"].hint("merge"), "name").where(F.exists("labels", lambda x: F.contains(x, F.col("_n"))))
    met = met.withColumn("starts", F.exists("labels", lambda x: F.startswith(x, F.col("_n"))))
    long = top(met, ["needle"], [F.desc("starts"), F.desc("reviews"), F.col("name")], limit)
    columns = ["needle", "name", "reviews", "rank"]
    return short.select(columns).unionByName(long.select(columns))


def suggest_entities(needles: DataFrame, entities: DataFrame, limit: int = 10, gram: int = 12, lookup: int = 500_000) -> DataFrame:
    """What suggest_from gives, for one call, without an index: the strings of each name and alias that are as long as some needle (or as `gram`
    characters, for longer ones, which are tested) meet the needles, so that a name only meets needles that it holds. Up to `lookup` needles
    (counted, and their bytes) are on each executor for it."""
    asked = needles.select("needle", F.lower(F.trim("needle")).alias("_n")).where("_n <> ''").distinct().withColumn("piece", F.substring("_n", 1, gram))
    lengths = [r.n for r in asked.select(F.char_length("piece").alias("n")).distinct().collect()]  # at most gram of them
    labels = F.transform(F.filter(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull()), F.lower)
    rows = entities.where(F.col("name").isNotNull()).select("name", F.coalesce("reviews", F.lit(0)).cast("long").alias("reviews"), labels.alias("labels"))
    cut = lambda n: F.flatten(F.transform("labels", lambda x: F.regexp_extract_all(x, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1)))
    pieces = F.array_distinct(F.concat(F.array().cast("array<string>"), *map(cut, sorted(lengths))))
    side = F.broadcast(asked) if _fits(asked, lookup, LOOKUP_BYTES) else asked.hint("merge")
    met = rows.withColumn("piece", F.explode(pieces)).join(side, "piece").where((F.char_length("_n") <= gram) | F.exists("labels", lambda x: F.contains(x, F.col("_n"))))
    met = met.select("needle", "name", "reviews", F.exists("labels", lambda x: F.startswith(x, F.col("_n"))).alias("starts"))
    return top(met, ["needle"], [F.desc("starts"), F.desc("reviews"), F.col("name")], max(1, min(50, limit))).select("needle", "name", "reviews", "rank")


def exact_cache_hit(requests: DataFrame, queries: DataFrame, summaries: DataFrame, as_of: str, ttl_hours: int) -> DataFrame:
    """The last query (by id) with a summary (query_id) of the same entity, normalised question and mode that is no older than ttl_hours at as_of."""
    norm = lambda c: F.lower(F.trim(c))
    at = F.lit(as_of).cast("timestamp_ntz")
    fresh = queries.where((F.col("created_at") >= at - F.make_dt_interval(hours=F.lit(max(1, ttl_hours)))) & (F.col("created_at") <= at))
    fresh = fresh.join(summaries.select("query_id").hint("merge"), "query_id", "left_semi")
    newest = fresh.groupBy("entity_id", norm("question").alias("question"), "search_mode").agg(F.max("query_id").alias("query_id"))
    asked = requests.select("entity_id", norm("question").alias("question"), "search_mode").distinct()
    return asked.join(newest, ["entity_id", "question", "search_mode"], "left").select("entity_id", "question", "search_mode", "query_id")


def list_media(media: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of each entity's media, newest first, with how many there are. An entity of very many files is no hot task: they are counted
    by an aggregate, and a page is the first rows."""
    shown = page(media, ["entity_name"], [F.desc("id")], limit, offset)
    totals = media.groupBy(F.col("entity_name").alias("_name")).agg(F.count("*").alias("total"))
    return shown.join(totals.hint("merge"), F.col("entity_name").eqNullSafe(F.col("_name"))).drop("_name")


def list_suggestions(suggestions: DataFrame, limit: int = 8) -> DataFrame:
    return top(suggestions.where("is_active"), ["entity_id", "search_mode"], [F.desc("confidence"), F.col("id")], limit)


#: Tabs of evidence: which cards each shows. The latest tab shows all, newest first.
EVIDENCE_TABS = {
    "all": lambda: F.lit(True),
    "latest": lambda: F.lit(True),
    "supporting": lambda: F.col("stance") == "supporting",
    "opposing": lambda: F.col("stance") == "opposing",
    "official": lambda: F.col("source_type") == "official",
    "news": lambda: F.col("source_type") == "news",
    "forum": lambda: F.col("source_type") == "forum",
    "social": lambda: F.col("source_type") == "social",
}


def evidence_tab(cards: DataFrame, tab: str) -> DataFrame:
    """The cards of a tab with their place in each query: by rank, or newest first in the latest tab."""
    newest = [F.coalesce("published_at", "extracted_at", F.lit("")).desc(), F.col("rank")]
    return ranked(cards.where(EVIDENCE_TABS[tab]()), ["query_key"], newest if tab == "latest" else [F.col("rank")], "tab_place")


def by_dimension(reviews: DataFrame, dimension: str) -> DataFrame:
    return reviews.where(F.exists("tags", lambda t: t["dim"] == dimension))


def crawl_targets(results: DataFrame, hosts: list[str], limit: int) -> DataFrame:
    """Results worth a full crawl: a supported host, and not an official or news text of 1,200 characters; the first of each query."""
    long = (F.length("content") >= 1200) & F.col("source_type").isin("official", "news")
    wanted = results.where(F.exists(F.array(*map(F.lit, hosts)), lambda h: F.contains(F.lower("url"), h)) & ~F.coalesce(long, F.lit(False)))
    return top(wanted, ["query_key"], [F.col("ord")], limit)


def needs_enrichment() -> Column:
    """Short of text, title, source or date."""
    there = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return ~((F.length(F.coalesce("content", F.lit(""))) >= 140) & there("title") & there("source") & there("published_date"))


def query_cards(cards: DataFrame, sources: DataFrame, ids: tuple[str, ...] = ("card_no",)) -> DataFrame:
    """The cards of each query with their sources, by relevance, then by the columns of their id. Cards without a source go."""
    joined = cards.join(sources.withColumn("source_type", F.coalesce("source_type", F.lit("other"))), "source_id")
    return ranked(joined, ["query_id"], [F.desc("relevance"), *map(F.col, ids)])
