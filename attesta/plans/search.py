"""From raw results to ranked evidence: filters, ranking, the finalising chain and its funnel."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import lexicon as L
from attesta.functions.classify import result_bucket, source_type_by_host
from attesta.functions.lexicon import Terms, any_of, hits
from attesta.functions.text import host_of
from attesta.operators import joins
from attesta.operators.dedup import kept_ids as dedup_ids
from attesta.operators.rank import diversify_results, ranked, top
from attesta.operators.store import written


@dataclass(frozen=True)
class SearchTerms:
    """What to look for. Each list may be a column of arrays instead, so that results of many entities and questions
    are filtered and ranked at once, each by its own terms."""

    entity: Terms = ()
    relaxed: Terms = ()
    question: Terms = ()
    review: tuple = L.REVIEW
    evidence: tuple = L.EVIDENCE
    rank_review: tuple = L.RANK_REVIEW
    rank_history: tuple = L.RANK_HISTORY
    authority: tuple = L.AUTHORITATIVE_HOSTS
    social: tuple = L.SOCIAL_HOSTS
    trusted: tuple = L.TRUSTED_HOSTS
    login: tuple = L.LOGIN_PAGE
    no_results: tuple = L.NO_RESULTS
    empty: tuple = L.NO_SUMMARY


def _low(c: str) -> Column:
    return F.lower(F.coalesce(F.col(c), F.lit("")))


def with_hay(df: DataFrame) -> DataFrame:
    """Add _hay (all a result says, in lower case) and _text once, for all tests after it."""
    text = F.coalesce(F.nullif(_low("content"), F.lit("")), _low("snippet")) if "snippet" in df.columns else _low("content")
    parts = [text if c == "content" else _low(c) for c in ("title", "content", "source", "url", "matched_query") if c in df.columns]
    return df.withColumn("_text", text).withColumn("_hay", F.concat_ws(" ", *parts))


def low_signal(t: SearchTerms) -> Column:
    """Login walls, empty result pages, list pages, bare profiles and home pages of social sites."""
    url, host = _low("url"), host_of(F.col("url"))
    path = F.regexp_replace(F.regexp_extract(url, r"^[a-z][\w+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    said = F.concat_ws(" ", _low("title"), F.col("_text"))
    social = any_of(host, ("facebook.com", "instagram.com", "threads.net"))
    named = any_of(F.concat_ws(" ", said, url), t.entity)
    meaningful = (F.length(F.trim("_text")) >= 10) & ~any_of(F.col("_text"), t.empty)
    profile = (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) <= 1) & ~any_of(path, ("posts", "p/", "reel", "videos", "photos"))
    at = lambda site: F.contains(host, F.lit(site))
    return (
        (F.trim(url) == "")
        | any_of(said, t.login)
        | any_of(said, t.no_results)
        | (any_of(url, ("pttweb.cc", "/search?q=thread", "/bbs/")) & ~at("ptt.cc"))
        | any_of(said, ("文章列表", "精華區", "search?q=thread", "latest all comments"))
        | (at("facebook.com") & path.isin("", "login", "pages", "watch", "groups"))
        | (at("instagram.com") & path.isin("", "accounts", "explore", "direct"))
        | (at("threads.net") & ~named & path.isin("", "login"))
        | (social & ~named & any_of(said, ("privacy", "meta", "sign up", "log in", "login")))
        | any_of(said, ("paint0_linear", "paint1_ra", "userspaceonuse", "stop-color", "fill'url(%23"))
        | (at("youtube.com") & any_of(said, ("error 403", "that’s an error", "skip navigation")))
        | (social & (profile | ~meaningful))
        | (at("facebook.com") & ~any_of(path, ("posts", "permalink", "share")))
    )


def relevant(t: SearchTerms) -> Column:
    hay, url = F.col("_hay"), _low("url")
    named, relaxed, asked = any_of(hay, t.entity), any_of(hay, t.relaxed), any_of(hay, t.question)
    trusted = any_of(url, t.trusted)
    meaningful = (F.length(F.trim("_text")) >= 20) & ~any_of(hay, t.empty)
    usable = meaningful | (F.length(F.trim(_low("title"))) >= 8)
    return (named & ((any_of(url, t.social) & meaningful) | asked | any_of(hay, t.review) | ((any_of(hay, t.evidence) | trusted) & usable))) | (trusted & relaxed & asked & usable)


def _flag(value: bool | Column) -> Column:
    return F.coalesce(value, F.lit(False)) if isinstance(value, Column) else F.lit(value)


def mark_relevant(df: DataFrame, t: SearchTerms, focus: bool | Column = False, among: Column | None = None) -> DataFrame:
    """Add _pass: whether a row is relevant; all rows of a query none of whose rows is. With the domain in focus (for all rows or by row) only
    rows that match it. among: the rows that count; others don't pass."""
    # which queries have a relevant row is an aggregate, combined on the map side, so that a query of very many rows is no hot task
    among = F.lit(True) if among is None else among
    marked = df.withColumns({"_focus": _flag(focus), "_ok": among & F.when(_flag(focus), focus_match(t)).otherwise(relevant(t))})
    some = marked.where("_ok").select(F.col("query_key").alias("_key")).distinct()
    found = marked.join(some.hint("merge"), F.col("query_key").eqNullSafe(F.col("_key")), "left")
    return found.withColumn("_pass", F.col("_ok") | (F.col("_key").isNull() & ~F.col("_focus") & among)).drop("_ok", "_focus", "_key")


def keep_relevant(df: DataFrame, t: SearchTerms, focus: bool | Column = False) -> DataFrame:
    """Relevant rows, as mark_relevant says."""
    return mark_relevant(df, t, focus).where("_pass").drop("_pass")


def focus_match(t: SearchTerms, domain: tuple = L.DOMAIN, strong: tuple = L.DOMAIN_STRONG, excluded: tuple = L.DOMAIN_EXCLUDED, negated: tuple = L.DOMAIN_NEGATED) -> Column:
    """Strict filter for one domain: no negation, no off-topic page, the entity named, and enough of the domain's terms."""
    hay = F.col("_hay")
    n, hit = hits(hay, domain), any_of(hay, strong)
    usable = (F.length(F.trim("_text")) >= 20) | (F.length(F.trim(_low("title"))) >= 8)
    off = any_of(hay, negated) | ((hits(hay, excluded) >= 2) & (n < 2) & ~hit)
    found = (any_of(_low("url"), t.trusted) & hit) | (n >= 2) | (hit & any_of(hay, t.question))
    return ~off & (any_of(hay, t.entity) | any_of(hay, t.relaxed)) & found & usable


#: Points for the kind of site.
_SITE_POINTS = ((5, ("ptt.cc",)), (4, ("google.com/maps", "maps.google", "dcard.tw")), (2, ("facebook.com", "instagram.com", "threads.net")))


#: The order of a query's results.
_BEST_FIRST = ("s1", "s2", "s3")


def score_results(df: DataFrame, t: SearchTerms, controversial: bool | Column = False, focus: bool | Column = False) -> DataFrame:
    """Three scores of each result (query_key, ord, ...), by which results are ranked. Adds s1, s2, s3 and bucket.

    controversial, focus: whether the question is about controversy or money, and whether the domain is in focus, so that its terms count
    one more and its strong terms three more; each for all rows or by row.
    """
    hay, url = F.col("_hay"), _low("url")
    df = with_hay(df).withColumn("bucket", result_bucket(F.col("url"), F.col("source_type")))
    site = F.when(any_of(_low("source"), ("news", "新聞")), 1).otherwise(0)
    for points, marks in reversed(_SITE_POINTS):
        site = F.when(any_of(url, marks), points).otherwise(site)
    site = F.when(any_of(url, t.authority), 8).otherwise(site)
    asked, evidence, authority, past = hits(hay, t.question), hits(hay, t.evidence), hits(hay, t.authority), hits(hay, t.rank_history)
    heated = F.when(F.col("bucket").isin("news", "forum", "fundraising"), 6).when(F.col("bucket") == "official", -5).otherwise(0) + 2 * past
    boost = F.when(_flag(controversial), heated).otherwise(0)
    near = F.when(_flag(focus), hits(hay, L.DOMAIN) + 3 * hits(hay, L.DOMAIN_STRONG)).otherwise(0)
    s1 = 12 * any_of(hay, t.entity).cast("int") + 3 * asked + evidence + hits(hay, t.rank_review) + 3 * authority + site + boost + near
    df = df.withColumn("s1", s1).withColumn("s2", asked + evidence + authority + past + near).withColumn("s3", F.least(F.length(F.trim("_text")), F.lit(500)))
    return df.drop("_hay", "_text")


def _order() -> list[Column]:
    return [*map(F.desc, _BEST_FIRST), F.col("ord")]


def rank_results(df: DataFrame, t: SearchTerms, controversial: bool | Column = False, focus: bool | Column = False) -> DataFrame:
    """Rank results by score_results, ties by ord. Adds s1, s2, s3, bucket and rank."""
    return ranked(score_results(df, t, controversial, focus), ["query_key"], _order())


#: What becomes of a result: dropped by one of the steps, or still there to be ranked.
STEPS = ("duplicate", "low_signal", "irrelevant", "kept")


def search_steps(df: DataFrame, t: SearchTerms, focus: bool | Column = False, sources: DataFrame | None = None, crawled: DataFrame | None = None) -> DataFrame:
    """All rows of df with the `step` that each ends in: deduplicated, filled from known sources, typed, enriched by crawled pages, then
    filtered. Dropped rows stay, so that whatever a row carries (its provider, say) can be counted at every step.

    sources: known sources by url (joins.hydrate); crawled: pages by url (joins.merge_enrichment).
    """
    ids = dedup_ids(df).withColumn("_unique", F.lit(True))
    rows = df.join(ids.hint("merge"), F.col("query_key").eqNullSafe(F.col("_key")) & (F.col("ord") == F.col("_ord")), "left").drop("_key", "_ord")
    if sources is not None:
        fields = [c for c in ("source", "source_type", "author", "published_date", "fetched_at", "title", "content") if c in rows.columns and c in sources.columns]
        rows = joins.hydrate(rows, sources, fields)
    preset = F.col("source_type") if "source_type" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("source_type", source_type_by_host(F.col("url"), F.col("source"), preset, F.col("title"), t.entity))
    if crawled is not None:
        rows = joins.merge_enrichment(rows if "snippet" in rows.columns else rows.withColumn("snippet", F.lit(None).cast("string")), crawled)
    unique = F.coalesce("_unique", F.lit(False))
    rows = with_hay(rows).withColumn("_clear", unique & ~low_signal(t))
    rows = mark_relevant(rows, t, focus, F.col("_clear"))
    step = F.when(~unique, STEPS[0]).when(~F.col("_clear"), STEPS[1]).when(~F.col("_pass"), STEPS[2]).otherwise(STEPS[3])
    return rows.withColumn("step", step).drop("_unique", "_clear", "_pass", "_hay", "_text")


def place_results(steps: DataFrame, t: SearchTerms, limit: int, controversial: bool | Column = False, focus: bool | Column = False) -> DataFrame:
    """The first `limit` rows of each query that search_steps keeps, ranked (among those that can come in) and diversified.

    A row that has `limit` better ones in its bucket can't be among the first `limit` places, as buckets keep their order. So only those many of
    each bucket are ranked together: Spark limits them before the shuffle, and a query of very many results is no hot task.
    """
    scored = score_results(steps.where(F.col("step") == STEPS[3]).drop("step"), t, controversial, focus)
    within = top(scored, ["query_key", "bucket"], _order(), max(limit, 4), "_within").drop("_within")
    return diversify_results(ranked(within, ["query_key"], _order()), _flag(controversial)).where(F.col("place") <= limit)


def finalize_results(df: DataFrame, t: SearchTerms, limit: int = 100, controversial: bool | Column = False, focus: bool | Column = False, sources: DataFrame | None = None, crawled: DataFrame | None = None) -> DataFrame:
    """Deduplicate, hydrate, type, enrich, filter, rank, diversify; the first `limit` of each query by place. Works on all queries of df at
    once, each by its own terms if t holds columns of df."""
    return place_results(search_steps(df, t, focus, sources, crawled), t, limit, controversial, focus)


def funnel(steps: DataFrame, final: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each query (and of each value of `by`, such as provider_pos) after each step: raw, deduplicated, low_signal and irrelevant
    (dropped), prioritized, final. Counts the rows of search_steps and place_results themselves; no filter is applied again. All rows that are
    kept have a place, as their urls are distinct."""
    key = ["query_key", *by]
    of = lambda s: F.count_if(F.col("step") == s)
    counts = steps.groupBy(*key).agg(F.count("*").alias("raw"), (F.count("*") - of(STEPS[0])).alias("deduplicated"), of(STEPS[1]).alias("low_signal"), of(STEPS[2]).alias("irrelevant"), of(STEPS[3]).alias("prioritized"))
    last = final.groupBy(*(F.col(k).alias(f"_{k}") for k in key)).agg(F.count("*").alias("final"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return counts.join(last.hint("merge"), same, "left").drop(*(f"_{k}" for k in key)).fillna(0, ["final"])


def run_search(df: DataFrame, t: SearchTerms, limit: int = 100, controversial: bool | Column = False, focus: bool | Column = False, sources: DataFrame | None = None, crawled: DataFrame | None = None, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The final results and the funnel of all queries, from one pass: steps are written to the shared folder and read by both."""
    steps, _ = written(search_steps(df, t, focus, sources, crawled), "search-steps")
    final, _ = written(place_results(steps, t, limit, controversial, focus), "final-results")
    return final, funnel(steps, final, by)


def search_funnel(df: DataFrame, t: SearchTerms, limit: int = 100, **kwargs) -> DataFrame:
    return run_search(df, t, limit, **kwargs)[1]
