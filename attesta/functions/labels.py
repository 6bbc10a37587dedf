"""Validation of labels and summaries that a model has written as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import clean_summary_text
from attesta.operators.metrics import DIMENSIONS

CONTENT_TYPES = ("review", "self_post", "announcement", "news", "unrelated")


def _said(c: Column, otherwise: str = "") -> Column:
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(otherwise))


def review_labels(raw: Column) -> Column:
    """Struct of relevance_score (0 to 1), stance, short_summary and content_type; broken JSON is unrelated."""
    j = F.from_json(raw, "relevance_score double, stance string, short_summary string, content_type string, broken string", {"columnNameOfCorruptRecord": "broken"})
    kind = F.lower(_said(j["content_type"], "review"))
    fine = j.isNotNull() & j["broken"].isNull()
    return F.struct(
        F.when(fine, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(j["relevance_score"], F.lit(0.0))))).otherwise(0.0).alias("relevance_score"),
        F.when(fine, F.lower(_said(j["stance"], "unclear"))).otherwise("unclear").alias("stance"),
        F.when(fine, F.substring(_said(j["short_summary"]), 1, 80)).otherwise("").alias("short_summary"),
        F.when(fine, F.when(kind.isin(*CONTENT_TYPES), kind).otherwise("review")).otherwise("unrelated").alias("content_type"),
    )


def dimension_tags(raw: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """Array of (dim, stance, excerpt): unknown dimensions go, unknown stances are neutral; broken JSON gives none."""
    tags = F.coalesce(F.from_json(raw, "tags array<struct<dim:string,stance:string,excerpt:string>>")["tags"], F.array().cast("array<struct<dim:string,stance:string,excerpt:string>>"))

    def tidy(t):
        stance = F.lower(_said(t["stance"]))
        return F.struct(_said(t["dim"]).alias("dim"), F.when(stance.isin("supporting", "opposing"), stance).otherwise("neutral").alias("stance"), F.substring(_said(t["excerpt"]), 1, 120).alias("excerpt"))

    return F.filter(F.transform(F.filter(tags, lambda t: t.isNotNull()), tidy), lambda t: t["dim"].isin(*dimensions))


#: Words by which a verdict says that there is nothing.
NOTHING_FOUND = ("沒有", "無足夠", "目前無")


def summary(raw: Column, confidence: Column, verdict: Column, composed: Column) -> Column:
    """Struct of verdict, confidence and up to three cleaned points of each kind, from JSON that may stand in a fence.

    Without a usable value the given confidence and verdict stand. A verdict that finds nothing although there are opposing points gives way to
    the composed one.
    """
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", F.trim(fenced)).otherwise(F.trim(raw))
    kinds = ("supporting_points", "opposing_points", "uncertain_points", "suggested_follow_up")
    j = F.from_json(body, "verdict string, confidence string, " + ", ".join(f"{k} array<string>" for k in kinds))
    none = F.array().cast("array<string>")
    # the first three items, cleaned as summaries are; what cleaning leaves nothing of goes, and so do short and repeated points
    cleaned = {k: F.transform(F.slice(F.filter(F.coalesce(j[k], none), lambda x: x.isNotNull()), 1, 3), lambda x: clean_summary_text(x, normalize=False)) for k in kinds}
    points = {k: F.array_distinct(F.filter(cleaned[k], lambda x: F.length(x) >= 6)) for k in kinds}
    said = clean_summary_text(_said(j["verdict"]), normalize=False)
    nothing = (F.size(points["opposing_points"]) > 0) & F.exists(F.array(*map(F.lit, NOTHING_FOUND)), lambda w: F.contains(said, w))
    sure = F.least(F.lit(100), F.greatest(F.lit(0), F.coalesce(j["confidence"].try_cast("int"), confidence)))
    return F.struct(F.when(said == "", verdict).when(nothing, composed).otherwise(said).alias("verdict"), sure.alias("confidence"), *(points[k].alias(k) for k in kinds))


def accepted_candidate(raw: Column) -> Column:
    """Struct of a verified candidate: accepted, reason, canonical_name, aliases, evidence_urls, cover_image_url."""
    j = F.from_json(raw, "verified boolean, reason string, canonical_name string, aliases array<string>, evidence_urls array<string>, cover_image_url string")
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.trim), lambda x: x.isNotNull() & (x != ""))
    name, urls = _said(j["canonical_name"]), tidy(j["evidence_urls"])
    reason = F.when(~F.coalesce(j["verified"], F.lit(False)), _said(j["reason"], "model_rejected")).when(name == "", "missing_canonical_name").when(F.size(urls) == 0, "no_evidence_urls").otherwise("")
    cover = F.when(F.rlike(_said(j["cover_image_url"]), F.lit("^https?://")), _said(j["cover_image_url"])).otherwise("")
    return F.struct((reason == "").alias("accepted"), reason.alias("reason"), name.alias("canonical_name"), F.filter(tidy(j["aliases"]), lambda a: a != name).alias("aliases"), urls.alias("evidence_urls"), cover.alias("cover_image_url"))
