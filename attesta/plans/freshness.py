"""Is what is stored fresh enough to answer from, and what is to be refreshed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.classify import question_focus
from attesta.operators.rank import latest_snapshot


def bounded(value: int, default: int, most: int) -> int:
    """Limits below 1 fall back to the default; then the cap holds."""
    return min(value if value >= 1 else default, most)


def max_age(question: Column, hours: int = 72, recent_hours: int = 24) -> Column:
    """Hours that a snapshot is fresh: fewer for questions about what is recent."""
    return F.when(question_focus(question)["recency"], recent_hours).otherwise(hours)


def cache_decision(requests: DataFrame, cached: DataFrame, snapshots: DataFrame, as_of: str, least_sources: int = 4, max_age_hours: int | Column = 72) -> DataFrame:
    """A reason code for each request (entity_id, search_mode); max_age_hours may differ by request (max_age makes it).

    cached: (entity_id, cached_sources); snapshots: rows with created_at, query_id and source_count.
    """
    newest = latest_snapshot(snapshots).select("entity_id", "search_mode", F.col("created_at").alias("generated_at"), "source_count")
    rows = requests.join(cached.hint("merge"), "entity_id", "left").join(newest.hint("merge"), ["entity_id", "search_mode"], "left")
    age = F.timestamp_diff("SECOND", F.col("generated_at"), F.lit(as_of).cast("timestamp_ntz")) / 3600
    reason = (
        F.when(F.coalesce("cached_sources", F.lit(0)) < least_sources, "insufficient_cached_sources")
        .when(F.col("source_count").isNull(), "missing_snapshot")
        .when(F.col("source_count") < least_sources, "insufficient_snapshot_sources")
        .when(F.col("generated_at").isNull(), "snapshot_age_unknown")
        .when(age > max_age_hours, "stale_snapshot")
        .otherwise("fresh_snapshot")
    )
    return rows.select("entity_id", "search_mode", reason.alias("reason"))


def refresh_plan(due: DataFrame, templates: DataFrame, modes: list[str], per_mode: int = 2) -> DataFrame:
    """Questions to ask anew: the first per_mode of each valid mode for each due entity (templates: entity_type, search_mode, pos, question)."""
    asked = templates.where(F.col("search_mode").isin(*modes) & (F.col("pos") < per_mode))
    return due.join(asked, "entity_type").select("entity_id", "search_mode", "pos", "question")
