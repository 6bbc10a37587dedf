"""Batch runs over the watchlist: refresh what is due, ingest by platform, maintain reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import labels
from attesta.operators import ids, joins, metrics, queue, runs, tables
from attesta.operators.dedup import union_results
from attesta.plans import analysis, search


def refresh_due(plan: DataFrame, results: DataFrame, terms: search.SearchTerms, entity: Column, as_of: str, limit: int = 100) -> dict[str, DataFrame]:
    """Answer the questions of a refresh plan (query_key, entity_id, search_mode, question) from results of all of them at once.

    The plan's other columns may hold each query's terms, which `terms` then names as columns.

    A query without results is a failed one, not an error of the job. Gives cards, summaries, outcomes and counts by entity.
    """
    asked = results.join(plan.select("query_key", *(c for c in plan.columns if c not in results.columns)), "query_key")
    final = search.finalize_results(asked, terms, limit)
    cards, summaries = analysis.analyze_results(final, entity, F.col("question"), as_of, limit)
    done = plan.join(summaries.select("query_key", "cards", "confidence", "verdict").hint("merge"), "query_key", "left").withColumn("ok", F.col("cards").isNotNull())
    outcomes = done.groupBy("entity_id").agg(F.bool_or("ok").alias("ok"), F.when(~F.bool_or("ok"), F.lit("no results")).alias("message"))
    counts = done.groupBy("entity_id").agg(F.count_if("ok").alias("success"), F.count_if(~F.col("ok")).alias("failed"))
    return {"cards": cards, "summaries": done, "outcomes": outcomes, "counts": counts}


#: Modes that can be asked for, and the question that a summary leaves open, by mode.
MODES = ("general", "animal_law")
FOLLOW_UP = {"animal_law": "目前有哪些與動物福利相關的部分仍待進一步查核？", "general": "目前哪些部分已有公開資料，哪些仍待進一步查核？"}


def plan_refresh(due: DataFrame, templates: DataFrame, modes: list[str] | None = None, valid: tuple[str, ...] = MODES, per_mode: int = 2) -> tuple[DataFrame, DataFrame]:
    """Questions of due entities (entity_id, entity_type, default_mode, ...), and how many valid and invalid modes each has.

    modes: asked for in place of each entity's default; repeated and invalid ones go. templates: entity_type, search_mode, pos, question.
    """
    asked = F.array_distinct(F.array(*map(F.lit, modes)) if modes else F.array("default_mode"))
    good = F.filter(asked, lambda m: F.coalesce(m.isin(*valid), F.lit(False)))
    counted = due.withColumns({"_good": good, "invalid_modes": F.size(asked) - F.size(good)})
    # entities times their few modes; templates are as few as types and modes are, but the size of either isn't known here
    pairs = counted.select("entity_id", "entity_type", F.posexplode("_good").alias("mode_pos", "search_mode"))
    first = templates.where(F.col("pos") < max(1, per_mode)).select("entity_type", "search_mode", "pos", "question")
    plan = pairs.join(first.hint("merge"), ["entity_type", "search_mode"]).select("entity_id", "search_mode", "mode_pos", "pos", "question")
    return plan, counted.select("entity_id", F.size("_good").alias("valid_modes"), "invalid_modes")


def _snapshot_events(summaries: DataFrame, cards: DataFrame) -> DataFrame:
    """One event for each answered query: its summary, a digest of its cards in their order (at most a page for each query), their number."""
    said = F.struct("place", *(F.col(c) for c in ("url", "title", "snippet", "stance", "strength", "claim_type", "relevance", "credibility", "recency")))
    digest = F.sha2(F.to_json(F.array_sort(F.collect_list(said))).cast("binary"), 256).alias("cards_digest")
    return summaries.join(cards.groupBy("query_key").agg(digest).hint("merge"), "query_key")


SNAPSHOT_BODY = ["search_mode", "verdict_text", "confidence", "supporting_points", "opposing_points", "uncertain_points", "follow_up", "cards_digest"]


def run_refresh(
    path: str, run_id: str, watchlist: DataFrame, templates: DataFrame, queries: DataFrame, results: DataFrame, terms: search.SearchTerms,
    as_of: str, types: list[str], due_limit: int = 5, modes: list[str] | None = None, valid: tuple[str, ...] = MODES, per_mode: int = 2, limit: int = 100,
) -> dict[str, DataFrame]:
    """Refresh all due entities in one run, whose tables are published together at path (runs.publish) under run_id.

    watchlist: entity_id, name, entity_type, default_mode and what due_entities and mark_refresh need; templates: entity_type, search_mode,
    pos, question; queries: entity_id, search_mode, query_id, question, those asked so far; results: entity_id, search_mode, pos, ord and a
    result's columns, found for the questions of the plan.

    Tables: queries (asked now; ids follow the largest one), cards, summaries and outcomes are added to those of earlier runs; results,
    made_cards (before ranking), snapshots, suggestions and watchlist take their place. A question without results has failed, as a row, not as an error of the job; an entity has
    succeeded if all of its questions have answers, failed if one has none, and is skipped if none of its modes is valid. A run that is
    killed anywhere and started again ends as one that wasn't.
    """
    spark = watchlist.sparkSession
    due = joins.due_entities(watchlist, as_of, types, due_limit).select("entity_id").join(watchlist.select("entity_id", "name", "entity_type", "default_mode").hint("merge"), "entity_id")
    plan, modes_of = plan_refresh(due, templates, modes, valid, per_mode)
    at = F.lit(as_of).cast("timestamp_ntz").alias("created_at")

    def asked(done: dict) -> DataFrame:
        last = queries.agg(F.max("query_id")).first()[0] or 0
        earlier = runs.current(spark, path)
        if "queries" in earlier["places"]:
            last = max(last, runs.read(spark, path, "queries").agg(F.max("query_id")).first()[0] or 0)
        return ids.allocate_ids(plan, ["entity_id", "mode_pos", "pos"], last, "query_id").select("query_id", "entity_id", "search_mode", "pos", "question", at)

    def final(done: dict) -> DataFrame:
        named = done["queries"].join(watchlist.select("entity_id", F.col("name").alias("_name")).hint("merge"), "entity_id")
        found = results.join(named.withColumnRenamed("query_id", "query_key").hint("merge"), ["entity_id", "search_mode", "pos"])
        return search.finalize_results(found.withColumn("focus", F.col("search_mode") != valid[0]), terms, limit, focus=F.col("focus"))

    def made_cards(done: dict) -> DataFrame:
        return analysis.evidence_cards(done["results"], F.col("_name"), F.col("question"), as_of)

    def cards(done: dict) -> DataFrame:
        return analysis.diversify_cards(analysis.rank_cards(done["made_cards"], limit), limit)

    def summaries(done: dict) -> DataFrame:
        told = done["queries"].withColumnRenamed("query_id", "query_key")
        rows = done["cards"].withColumn("rank", F.col("place")).join(told.select("query_key", "search_mode", "question").hint("merge"), "query_key")
        made = analysis.balanced_summary(rows, question=F.col("question"), focus=F.col("search_mode") != valid[0])
        return told.drop("pos").join(made.hint("merge"), "query_key")

    def snapshots(done: dict) -> DataFrame:
        events = _snapshot_events(done["summaries"], done["cards"]).withColumnRenamed("query_key", "query_id")
        new = tables.snapshot_versions(events, SNAPSHOT_BODY)
        stored = runs.read(spark, path, "snapshots") if "snapshots" in runs.current(spark, path)["places"] else tables.number_versions(new.limit(0))
        return tables.merge_snapshots(stored, new)

    def suggestions(done: dict) -> DataFrame:
        pairs = done["summaries"].select("entity_id", "search_mode").distinct()
        kinds = watchlist.select("entity_id", "entity_type")
        base = pairs.join(kinds.hint("merge"), "entity_id").join(templates.hint("merge"), ["entity_type", "search_mode"]).select("entity_id", "search_mode", "pos", "question")
        history = queries.select("entity_id", "search_mode", "query_id", "question").unionByName(done["queries"].select("entity_id", "search_mode", "query_id", "question"))
        if "queries" in runs.current(spark, path)["places"]:
            history = history.unionByName(runs.read(spark, path, "queries").select(history.columns)).distinct()
        now = tables.refresh_suggestions(base, history.join(pairs.hint("merge"), ["entity_id", "search_mode"], "left_semi"), {m: [FOLLOW_UP[m]] for m in valid if m in FOLLOW_UP})
        if "suggestions" not in runs.current(spark, path)["places"]:
            return now
        return runs.read(spark, path, "suggestions").join(pairs.hint("merge"), ["entity_id", "search_mode"], "left_anti").unionByName(now)

    def outcomes(done: dict) -> DataFrame:
        answered = done["summaries"].select(F.col("query_key").alias("query_id"), F.lit(True).alias("_ok"))
        each = done["queries"].join(answered.hint("merge"), "query_id", "left").groupBy("entity_id").agg(F.count("_ok").alias("answered"), F.count_if(F.col("_ok").isNull()).alias("unanswered"))
        rows = modes_of.join(each.hint("merge"), "entity_id", "left").fillna(0, ["answered", "unanswered"])
        status = F.when(F.col("valid_modes") == 0, "skipped").when((F.col("unanswered") > 0) | (F.col("answered") == 0), "failed").otherwise("success")
        message = F.when(status == "skipped", "no_valid_mode").when(status == "failed", "no results")
        return rows.select(F.lit(run_id).alias("run_id"), "entity_id", status.alias("status"), message.alias("message"), "answered", "unanswered", "invalid_modes")

    def watched(done: dict) -> DataFrame:
        told = done["outcomes"].where("status <> 'skipped'").select("entity_id", (F.col("status") == "success").alias("ok"), "message")
        return tables.mark_refresh(watchlist, told, as_of)

    made = {"queries": asked, "results": final, "made_cards": made_cards, "cards": cards, "summaries": summaries, "snapshots": snapshots, "suggestions": suggestions, "outcomes": outcomes, "watchlist": watched}
    return runs.publish(spark, path, run_id, made, appended=("queries", "cards", "summaries", "outcomes"))


def refresh_totals(outcomes: DataFrame) -> DataFrame:
    """(run_id, processed, succeeded, failed, skipped, invalid_modes) of each run."""
    of = lambda s, name: F.count_if(F.col("status") == s).alias(name)
    return outcomes.groupBy("run_id").agg(F.count("*").alias("processed"), of("success", "succeeded"), of("failed", "failed"), of("skipped", "skipped"), F.sum("invalid_modes").alias("invalid_modes"))


def ingest_pipelines(table: DataFrame, by_platform: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Insert the reviews (review_id, entity, author, content) of all platforms in one go; and rows written by platform and entity."""
    parts = [df.select("review_id", "entity", F.lit(platform).alias("platform"), "author", "content") for platform, df in by_platform.items()]
    new = tables.ingest_reviews(table, union_results(*parts).drop("provider_pos"))
    runs = new.groupBy("platform", "entity").agg(F.count("*").alias("rows_written")).withColumn("status", F.lit("success"))
    return new, metrics.run_totals(runs)


def maintain_reviews(reviews: DataFrame, answers: DataFrame, tag_answers: DataFrame | None = None, as_of: str | None = None) -> dict[str, DataFrame]:
    """Relabel junk, write labels and dimension tags (review_id, raw JSON of each) onto reviews, and list what is still to be labelled and tagged.

    reviews: review_id, entity, platform, parent_title, content, relevance_score, stance, content_type, and analyzed_at, tags,
    dimensions_classified_at, which are added if they aren't there. Gives reviews, to_label and to_tag (batches of messages), and stats.
    """
    at = F.lit(as_of).cast("timestamp_ntz") if as_of else F.current_timestamp().cast("timestamp_ntz")
    missing = {"platform": "string", "parent_title": "string", "analyzed_at": "timestamp_ntz", "dimensions_classified_at": "timestamp_ntz", "tags": "array<struct<dim:string,stance:string,excerpt:string>>"}
    clean = tables.relabel_junk(reviews.withColumns({c: F.lit(None).cast(t) for c, t in missing.items() if c not in reviews.columns}))
    made = answers.select("review_id", labels.review_labels(F.col("raw")).alias("l")).select("review_id", "l.relevance_score", "l.stance", "l.content_type", at.alias("analyzed_at"))
    labelled = tables.apply_labels(clean, made)
    if tag_answers is not None:
        tagged = tag_answers.select("review_id", labels.dimension_tags(F.col("raw")).alias("tags"), at.alias("dimensions_classified_at"))
        labelled = tables.apply_labels(labelled, tagged)
    # what was found to be junk needs no labeller
    open_rows = labelled.where("not (analyzed_at is null and coalesce(content_type, '') = 'unrelated')")
    to_label = queue.batches(queue.to_label(open_rows), ["entity", "review_id"], queue.LABEL_BATCH)
    to_tag = queue.batches(queue.to_tag(labelled), ["review_id"], queue.DIMENSION_BATCH)
    return {"reviews": labelled, "to_label": to_label, "to_tag": to_tag, "stats": metrics.label_stats(labelled)}
