"""From results to evidence cards and balanced summaries."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import classify as C
from attesta.functions.text import clean_summary_text, excerpt, normalized, once, or_discarded, site_of, without_markup
from attesta.operators.rank import diversify_cards, rank_cards, ranked
from attesta.operators.store import written

# What stands for a missing text, the words of a question that an excerpt looks for, and the sentences of summaries, first
# for questions in general, then for those about the domain in focus.
NO_TEXT, NO_EXCERPT = "目前沒有可用的摘要內容。", "目前沒有可用的相關段落。"
EXCERPT_WORDS = ("評價", "爭議", "動物", "福利", "募資", "透明", "照護", "救援", "評論")
VERDICTS = {
    False: {
        "mostly_supported": "目前公開資料有部分內容支持「%s」成立，但仍需人工複核原文與時間序。",
        "mostly_opposed": "目前找到較多反駁、改善或官方說明資訊；直接支持「%s」的證據相對較少。",
        "mixed": "目前公開資料正反並存，對「%s」仍需結合原文脈絡判讀。",
        "insufficient": "目前可用公開資料不足，對「%s」暫時無法下定論。",
    },
    True: {
        "mostly_supported": "依目前公開資料可能涉及「%s」相關的動物福利疑慮，但仍需主管機關或完整證據進一步認定。",
        "mostly_opposed": "依目前公開資料，已看到部分改善或反駁資訊；「%s」是否成立，仍需主管機關或完整證據進一步認定。",
        "mixed": "依目前公開資料可能與「%s」有關，但正反資訊並存，仍需主管機關或完整證據進一步認定。",
        "insufficient": "依目前公開資料，暫無足夠直接證據確認是否涉及「%s」。",
    },
}
NO_POINTS = {
    False: {"supporting": "目前沒有足夠直接證據可列為主要疑慮。", "opposing": "尚未找到足夠明確的反駁或改善來源。", "uncertain": "現有來源多為轉述、片段描述或細節不足，仍需補查。"},
    True: {"supporting": "目前沒有足夠直接的動物福利證據可列為主要疑慮。", "opposing": "目前未見足夠明確的改善、正式說明或裁罰結論。", "uncertain": "依目前公開資料，仍需補查動物照護、稽查或裁罰等更直接證據。"},
}
FOLLOW_UP = {
    False: ("補抓更近期的新聞與官方聲明", "區分第一手描述與轉述內容", "人工確認關鍵指控是否有具體時間、地點、金額或影像佐證"),
    True: ("補查主管機關稽查、裁罰與改善資料", "人工確認是否有具體時間、地點、動物數量或影像佐證", "區分第一手照護紀錄、新聞轉述與社群討論"),
}


def or_else(c: Column, missing: str) -> Column:
    """The text, or what stands for a missing or empty one."""
    return once(c, lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit(missing)))


def evidence_cards(results: DataFrame, entity: Column, question: Column, as_of: str, terms: C.Terms = C.Terms(), clean: bool = True, strict: bool = True, variants: Column | None = None) -> DataFrame:
    """One card for each result (query_key, ord, url, title, content, source, source_type, published_date; raw_content or snippet stand
    in for a missing content).

    variants: other names of the entity (arrays of strings). Scores build on one another, each in one projection; clean=False takes texts
    as they are (already cleaned).
    """
    stand_ins = [F.nullif(F.col(c), F.lit("")) for c in ("content", "raw_content", "snippet") if c in results.columns]
    results = results.withColumn("content", F.coalesce(*stand_ins, F.col("content"))).withColumn("_variants", variants if variants is not None else F.array(F.lower(F.trim(entity))))
    if clean:  # the one Python step, before the expressions over arrays
        results = results.withColumns({c: normalized(F.col(c)) for c in ("title", "content")})
        results = results.withColumn("content", without_markup(F.col("content"), strict))  # once, for its several uses
    text = or_else(or_discarded(F.col("content")) if clean else F.col("content"), NO_TEXT)
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), site_of(F.col("url")))
    raw_title = F.coalesce(F.col("title"), F.lit(""))
    title = clean_summary_text(raw_title, normalize=False) if clean else raw_title
    fine = lambda c: (c != "") & ~C.is_noise_text(c, terms)
    cleaned = or_discarded(without_markup(raw_title, strict)) if clean else raw_title
    given = F.coalesce("source", F.lit(""))
    named = F.when(fine(title), F.substring(title, 1, 120)).when(fine(cleaned), F.substring(cleaned, 1, 120))
    named = named.otherwise(F.concat(F.when(fine(given), given).otherwise(site_of(F.col("url"))), F.lit(" 來源紀錄")))
    df = results.select("query_key", "ord", "url", named.alias("title"), source.alias("source"), text.alias("text"), C.source_type_by_source(F.col("url"), F.col("source"), F.col("source_type")).alias("source_type"), "published_date", entity.alias("_entity"), question.alias("_question"), raw_title.alias("_raw_title"), "_variants")
    said = F.concat_ws(" ", "title", "text")
    df = df.withColumn("first_hand", C.first_hand_score(said, F.col("source_type"), terms))
    df = df.withColumn("relevance", C.relevance_score(F.col("_entity"), F.col("_question"), F.col("title"), F.col("text"), terms, F.col("_variants")))
    df = df.withColumns({"_s": C.stance_strength(said, F.col("source_type"), F.col("first_hand"), terms), "recency": C.recency_label(F.col("published_date"), F.lit(as_of).cast("date")), "duplicate_risk": C.duplicate_risk(F.col("url"), F.col("_raw_title"))})
    df = df.withColumn("credibility", C.credibility_score(F.col("source_type"), F.col("first_hand"), F.col("relevance"), F.col("recency"), F.col("duplicate_risk")))
    df = df.withColumn("_read", clean_summary_text(F.col("text"), normalize=False) if clean else F.col("text"))  # once, for both excerpts
    best = lambda e, q: or_else(excerpt(e, q, F.col("_read"), EXCERPT_WORDS), NO_EXCERPT)
    df = df.withColumns({"stance": F.col("_s.stance"), "strength": F.col("_s.strength"), "excerpt": best(F.col("_entity"), F.col("_question")), "_best": best(F.lit(""), F.lit(""))})
    return df.select(
        "query_key", "ord", "url", "title", "source", "source_type", F.substring("text", 1, 700).alias("snippet"),
        "excerpt", "stance", "strength", C.card_summary(F.col("_best")).alias("summary"), C.notes().alias("notes"),
        C.claim_type(F.col("_question"), F.col("text")).alias("claim_type"), "first_hand", "relevance", "credibility", "recency", "duplicate_risk",
        C.is_noise_card(F.col("title"), F.substring("text", 1, 700), F.col("url"), F.col("source"), F.col("relevance"), terms).alias("noise"),
        C.platform_bucket(F.col("source"), F.col("url"), F.col("source_type")).alias("platform"), C.origin_label(F.col("source_type"), F.col("first_hand")).alias("origin"),
    )


def _plain(text: str) -> str:
    """A fixed sentence as cleaning leaves it: full-width punctuation becomes plain."""
    return unicodedata.normalize("NFKC", text)


def _by_focus(focus: Column, values: dict[bool, str]) -> Column:
    return F.when(focus, F.lit(values[True])).otherwise(F.lit(values[False]))


def balanced_summary(cards: DataFrame, points: int = 3, question: Column | None = None, focus: bool | Column = False, terms: C.Terms = C.Terms()) -> DataFrame:
    """Of each query's cards (by rank): counts, confidence, verdict and its sentence, the first points of each side and what to follow up.

    A point is the card's title, or its source if the title is short or noise, and where it comes from; points of under six
    characters and repeated ones go; a side without any says so; a missing title or source is an empty one. question: the text that the verdict is about, of the same value in
    all cards of a query; focus: whether it is about the domain in focus. Titles are taken as cleaned.
    """
    supporting = (F.col("stance") == "supporting") & F.col("strength").isin("medium", "strong") & (F.col("relevance") >= 60) & ((F.col("first_hand") >= 55) | (F.col("source_type") == "official"))
    opposing = (F.col("stance") == "opposing") & F.col("strength").isin("medium", "strong") & (F.col("relevance") >= 55)
    side = F.when(supporting, "supporting").when(opposing, "opposing").otherwise("uncertain")
    flag = focus if isinstance(focus, Column) else F.lit(focus)
    cards = cards.withColumns({"side": side, "_asked": question if question is not None else F.lit(""), "_focus": flag})
    placed = ranked(cards, ["query_key", "side"], [F.col("rank")], "_k")
    poor = F.coalesce((F.length("title") < 6) | C.is_noise_text(F.col("title"), terms), F.lit(True))
    source = F.trim(F.concat_ws(" ", "source", F.lit("來源整理")))
    title = F.when(poor, source).otherwise(F.col("title"))
    point = F.concat(title, F.lit("("), C.origin_label(F.col("source_type"), F.col("first_hand")), F.lit(")"))

    def side_points(s: str) -> Column:
        first = F.array_sort(F.collect_list(F.when((F.col("side") == s) & (F.col("_k") <= points), F.struct("_k", point.alias("p")))))
        return F.array_distinct(F.filter(F.transform(first, lambda x: x["p"]), lambda p: F.length(p) >= 6)).alias(s + "_points")

    sums = placed.groupBy("query_key").agg(
        F.count("*").alias("cards"), F.count_if(F.col("side") == "supporting").alias("supporting"), F.count_if(F.col("side") == "opposing").alias("opposing"),
        F.max("_asked").alias("_asked"), F.max("_focus").alias("_focus"), *map(side_points, ("supporting", "opposing", "uncertain")),
    )
    s, o = F.col("supporting"), F.col("opposing")
    verdict = F.when(s > o, "mostly_supported").when(o > s, "mostly_opposed").when(s > 0, "mixed").otherwise("insufficient")
    sums = sums.withColumn("confidence", F.least(F.lit(80), 22 + 2 * F.col("cards") + 8 * s + 6 * o)).withColumn("verdict", verdict)
    text = F.coalesce(*(F.when(F.col("verdict") == code, _by_focus(F.col("_focus"), {f: _plain(VERDICTS[f][code]) for f in VERDICTS})) for code in VERDICTS[False]))
    left = lambda name: F.when(F.size(f"{name}_points") > 0, F.col(f"{name}_points")).otherwise(F.array(_by_focus(F.col("_focus"), {f: NO_POINTS[f][name] for f in NO_POINTS})))
    follow = F.when(F.col("_focus"), F.array(*(F.lit(_plain(x)) for x in FOLLOW_UP[True]))).otherwise(F.array(*(F.lit(_plain(x)) for x in FOLLOW_UP[False])))
    sums = sums.withColumns({f"{name}_points": left(name) for name in ("supporting", "opposing", "uncertain")})
    return sums.withColumns({"verdict_text": F.replace(text, F.lit("%s"), F.col("_asked")), "follow_up": follow}).drop("_asked", "_focus")


def analyze_results(results: DataFrame, entity: Column, question: Column, as_of: str, limit: int = 100, **kwargs) -> tuple[DataFrame, DataFrame]:
    """Cards of each query, ranked and diversified, and the summaries. Cards are written to the shared folder before they are ranked: else the
    test for noise, with all the cleaning that it stands on, would be pushed below and done over for each of its terms."""
    made, _ = written(evidence_cards(results, entity, question, as_of, **kwargs), "cards")
    cards = diversify_cards(rank_cards(made, limit), limit)
    return cards, balanced_summary(cards.withColumn("rank", F.col("place")))


def analysis_funnel(cards: DataFrame, least: int = 40, limit: int = 100) -> DataFrame:
    """Cards of each query: all, noise, of low relevance, gray, final."""
    clean = ~F.col("noise")
    good = clean & (F.col("relevance") >= least)
    sums = cards.groupBy("query_key").agg(F.count("*").alias("input"), F.count_if("noise").alias("noise"), F.count_if(clean & ~good).alias("low_relevance"), F.count_if(good & C.gray_candidate(F.col("title"), F.col("snippet"), F.col("url"))).alias("gray"), F.count_if(good).alias("_good"), F.count_if(clean).alias("_clean"))
    final = F.when(F.col("_good") > 0, F.least("_good", F.lit(limit))).otherwise(F.least("_clean", F.lit(min(limit, 10))))
    return sums.withColumn("final", final).drop("_good", "_clean")
