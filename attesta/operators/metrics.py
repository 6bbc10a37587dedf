"""Aggregates over reviews, ratings, queries and evidence cards, for all entities in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def review_filter(min_relevance: float | None = 0.6, include_unanalyzed: bool = False, only_reviews: bool = True) -> Column:
    """Reviews shown by default: relevant enough and of type review. A missing relevance passes only with
    include_unanalyzed; without min_relevance only the type is tested."""
    relevant = F.lit(True) if min_relevance is None else F.coalesce(F.col("relevance_score") >= min_relevance, F.lit(include_unanalyzed))
    typed = F.coalesce(F.col("content_type") == "review", F.lit(include_unanalyzed)) if only_reviews else F.lit(True)
    return relevant & typed


def latest_ratings(events: DataFrame) -> DataFrame:
    """The last valid score (1 to 5) of each user for each review: (review_id, user_id, score)."""
    last = F.max_by("score", F.struct("ts", "event_id")).alias("score")
    return events.where(F.col("score").between(1, 5)).groupBy("review_id", "user_id").agg(last)


def rated_reviews(reviews: DataFrame, ratings: DataFrame) -> DataFrame:
    """Reviews that have ratings, with their sum and number. Ratings are aggregated before the join."""
    sums = ratings.groupBy("review_id").agg(F.sum("score").alias("score_sum"), F.count("*").alias("raters"))
    typed = reviews.where(F.col("content_type").isNull() | (F.col("content_type") == "review"))
    return typed.join(sums, "review_id").withColumn("avg_score", F.col("score_sum") / F.col("raters"))


def score_band(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 55, "mid").when(score >= 35, "low").when(score.isNotNull(), "critical")


def public_credibility(reviews: DataFrame, ratings: DataFrame) -> DataFrame:
    """Credibility of each entity from users' ratings of its reviews, drawn to 50 if there are few."""
    weight = F.when(F.lower("stance").isin("supporting", "opposing"), F.col("avg_score")).when(F.lower("stance") == "neutral", F.col("avg_score") * 0.5)
    weighed = rated_reviews(reviews, ratings).withColumn("weight", weight)
    of = lambda s: F.coalesce(F.sum(F.when(F.lower("stance") == s, F.col("weight"))), F.lit(0.0)).alias(f"{s}_weight")
    sums = weighed.groupBy("entity").agg(F.count("*").alias("reviews_rated"), F.sum("raters").alias("total_ratings"), of("supporting"), of("opposing"), of("neutral"))
    total = F.col("supporting_weight") + F.col("opposing_weight") + F.col("neutral_weight")
    raw = (F.col("supporting_weight") + F.col("neutral_weight") * 0.5) / total * 100
    prior = F.greatest(F.lit(0), 5 - F.col("reviews_rated")) * 10
    score = F.when(total > 0, F.round((raw * F.col("reviews_rated") + 50 * prior) / (F.col("reviews_rated") + prior), 1))
    rounded = [F.round(f"{s}_weight", 2).alias(f"{s}_weight") for s in ("supporting", "opposing", "neutral")]
    return sums.select("entity", "reviews_rated", "total_ratings", *rounded, score.alias("score"), score_band(score).alias("band"))


def rating_summary(ratings: DataFrame, user_id: int) -> DataFrame:
    """Average and number of ratings of each review, and this user's own."""
    own = F.max(F.when(F.col("user_id") == user_id, F.col("score"))).alias("my_score")
    return ratings.groupBy("review_id").agg((F.sum("score") / F.count("*")).alias("average"), F.count("*").alias("ratings"), own)


def entity_profile(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """Queries (one row for each query_id) and distinct sources, and rounded means. A query's confidence counts once for each of its
    cards, or once without any. Cards are aggregated before they meet their queries; only sources are made distinct."""
    sums = cards.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("credibility").alias("c"), F.count("credibility").alias("cn"))
    rows = queries.select("entity_id", "query_id", "confidence").join(sums, "query_id", "left").withColumn("w", F.greatest(F.lit(1), F.coalesce("n", F.lit(0))))
    mean = lambda total, n, name: F.coalesce(F.round(F.try_divide(F.sum(total), F.sum(n))), F.lit(0.0)).cast("long").alias(name)
    counted = rows.groupBy("entity_id").agg(F.count("*").alias("total_queries"), mean(F.col("confidence") * F.col("w"), F.when(F.col("confidence").isNotNull(), F.col("w")), "average_confidence"), mean("c", "cn", "average_credibility"))
    met = cards.select("query_id", "source_id").distinct().join(queries.select("query_id", "entity_id"), "query_id")
    used = met.where("source_id is not null").select("entity_id", "source_id").distinct().groupBy("entity_id").agg(F.count("*").alias("total_sources"))
    return counted.join(used, "entity_id", "left").select("entity_id", "total_queries", F.coalesce("total_sources", F.lit(0)).alias("total_sources"), "average_confidence", "average_credibility")


def source_breakdown(queries: DataFrame, cards: DataFrame, sources: DataFrame) -> DataFrame:
    """Cards of each entity by source type."""
    rows = cards.select("query_id", "source_id").join(queries.select("query_id", "entity_id"), "query_id").join(sources.select("source_id", "source_type"), "source_id")
    return rows.groupBy("entity_id", "source_type").agg(F.count("*").alias("n"))


def entity_list(entities: DataFrame, queries: DataFrame, cards: DataFrame, limit: int, needle: str | None = None) -> DataFrame:
    """The entities with most queries: ties by last update, then name. needle: only those whose name and aliases, a space between each,
    contain it in lower case."""
    counts = entity_profile(queries.withColumn("confidence", F.lit(0)), cards.withColumn("credibility", F.lit(0)))
    out = entities.join(counts.select("entity_id", "total_queries", "total_sources"), "entity_id", "left").fillna(0, ["total_queries", "total_sources"])
    if needle and needle.strip():
        said = F.concat_ws(" ", "name", *(["aliases"] if "aliases" in entities.columns else []))
        out = out.where(F.contains(F.lower(said), F.lit(needle.strip().lower())))
    return out.orderBy(F.desc("total_queries"), F.col("last_at").desc_nulls_last(), "name").limit(limit).select("entity_id", "name", "total_queries", "total_sources")


def review_stats(reviews: DataFrame, **rules) -> DataFrame:
    return reviews.where(review_filter(**rules)).groupBy("platform").agg(F.count("*").alias("n"))


def media_stats(media: DataFrame) -> DataFrame:
    return media.groupBy("entity_name").agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
        F.count_if(F.col("media_type") == "image").alias("images"),
        F.count_if(F.col("media_type") == "video").alias("videos"),
    )


def relevance_tier(score: Column) -> Column:
    return F.when(score >= 0.6, "relevant").when(score >= 0.3, "borderline").otherwise("noise")


def label_stats(reviews: DataFrame) -> DataFrame:
    """Labelled reviews by tier, stance and type."""
    labelled = reviews.where(F.col("relevance_score").isNotNull())
    return labelled.groupBy(relevance_tier(F.col("relevance_score")).alias("tier"), "stance", "content_type").agg(F.count("*").alias("n"))


#: The dimensions of reviews.
DIMENSIONS = ("staff_attitude", "transparency", "environment", "animal_care", "communication", "adoption_process")


def dimension_overview(reviews: DataFrame, dimensions=DIMENSIONS, excerpts: int = 5) -> DataFrame:
    """Mentions and stances of each dimension of each entity, and balanced excerpts.

    reviews: entity, review_id, relevance_score, content_type, tags array<struct<dim,stance,excerpt>>. All
    dimensions come out for every entity that has reviews, with zeros.
    """
    relevant = reviews.where((F.col("relevance_score") >= 0.6) & (F.col("content_type") == "review"))
    tags = relevant.select("entity", "review_id", F.posexplode("tags").alias("pos", "t")).where(F.col("t.dim").isin(*dimensions))
    stance = F.when(F.col("t.stance").isin("supporting", "opposing"), F.col("t.stance")).otherwise("neutral")
    tags = tags.select("entity", "review_id", "pos", F.col("t.dim").alias("dim"), stance.alias("stance"), F.substring(F.coalesce(F.col("t.excerpt"), F.lit("")), 1, 200).alias("excerpt"))
    of = lambda s: F.count_if(F.col("stance") == s).alias(s)
    counts = tags.groupBy("entity", "dim").agg(F.count("*").alias("mentions"), of("supporting"), of("opposing"), of("neutral"))
    from attesta.operators.rank import balanced_excerpts

    picked = balanced_excerpts(tags, ["entity", "dim"], ["review_id", "pos"], excerpts)
    texts = picked.groupBy("entity", "dim").agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "excerpt"))), lambda x: x["excerpt"]).alias("excerpts"))
    grid = reviews.select("entity").distinct().withColumn("dim", F.explode(F.array(*map(F.lit, dimensions))))
    out = grid.join(counts.hint("merge"), ["entity", "dim"], "left").join(texts.hint("merge"), ["entity", "dim"], "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("mentions", "supporting", "opposing", "neutral")]
    return out.select("entity", "dim", *zero, F.coalesce("excerpts", F.array().cast("array<string>")).alias("excerpts"))


def metric_bars(cards: DataFrame, key: str) -> DataFrame:
    """Rounded mean relevance and first-hand score and the share of recent cards, in percent."""
    share = 100 * F.count_if(F.col("recency") == "recent") / F.count("*")
    return cards.groupBy(key).agg(F.round(F.avg("relevance")).cast("long").alias("relevance"), F.round(F.avg("first_hand")).cast("long").alias("first_hand"), F.round(share).cast("long").alias("recent"))


def stance_bar(cards: DataFrame, key: str) -> DataFrame:
    """Percent supporting and opposing; what is left is neutral."""
    percent = lambda s: F.round(100 * F.count_if(F.col("stance") == s) / F.count("*")).cast("long").alias(s)
    out = cards.groupBy(key).agg(percent("supporting"), percent("opposing"))
    return out.withColumn("neutral", F.greatest(F.lit(0), 100 - F.col("supporting") - F.col("opposing")))


def overall_score(queries: DataFrame, cards: DataFrame) -> DataFrame:
    """0.55 of mean credibility (or the confidence without cards) and 0.45 of the confidence, 0 to 100; and out of five."""
    means = cards.groupBy("query_id").agg((F.sum("credibility") / F.count("*")).alias("credibility"))
    rows = queries.join(means, "query_id", "left")
    blend = 0.55 * F.coalesce("credibility", F.col("confidence").cast("double")) + 0.45 * F.col("confidence")
    score = F.least(F.lit(100), F.greatest(F.lit(0), F.round(blend).cast("int")))
    label = F.when(score >= 88, "excellent").when(score >= 74, "good").when(score >= 60, "fair").otherwise("weak")
    return rows.select("query_id", score.alias("overall"), F.round(score / 20, 1).alias("five_point"), label.alias("label"))


def platform_counts(cards: DataFrame, platforms: dict[str, str]) -> DataFrame:
    """Cards by overlapping platform: each platform counts every card whose text contains its mark."""
    hits = F.array(*(F.when(F.contains(F.lower("text"), F.lit(mark)), F.lit(name)) for name, mark in platforms.items()))
    return cards.select(F.explode(F.array_compact(hits)).alias("platform")).groupBy("platform").agg(F.count("*").alias("n"))


def run_totals(runs: DataFrame) -> DataFrame:
    """Rows written by platform and entity, with subtotals (nulls) for each platform and for all."""
    return runs.rollup("platform", "entity").agg(F.sum("rows_written").alias("rows_written"), F.count_if(F.col("status") == "failed").alias("failed"))


def dimension_stances(reviews: DataFrame, dimensions=DIMENSIONS) -> DataFrame:
    """Tags of all reviews by dimension and stance; stances other than supporting and opposing are neutral."""
    tags = reviews.select(F.explode("tags").alias("t")).where(F.col("t.dim").isin(*dimensions))
    stance = F.when(F.col("t.stance").isin("supporting", "opposing"), F.col("t.stance")).otherwise("neutral")
    return tags.groupBy(F.col("t.dim").alias("dim"), stance.alias("stance")).agg(F.count("*").alias("n"))


def source_type_counts(cards: DataFrame, key: str) -> DataFrame:
    """Cards by source type, unknown ones as other; types without cards have no row."""
    known = F.when(F.col("source_type").isin("official", "news", "forum", "social"), F.col("source_type")).otherwise("other")
    return cards.groupBy(key, known.alias("source_type")).agg(F.count("*").alias("n"))


def tab_counts(cards: DataFrame, key: str) -> DataFrame:
    """How many cards each evidence tab shows."""
    from attesta.operators.rank import EVIDENCE_TABS

    return cards.groupBy(key).agg(*(F.count_if(test()).alias(tab) for tab, test in EVIDENCE_TABS.items()))
