"""Classification and scoring of results and cards, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import lexicon as L
from attesta.functions.lexicon import any_of, hits
from attesta.functions.text import host_of


@dataclass(frozen=True)
class Terms:
    """The lists that scoring looks for."""

    negative: tuple = L.NEGATIVE
    positive: tuple = L.POSITIVE
    first_hand: tuple = L.FIRST_HAND
    reported: tuple = L.REPORTED
    hard: tuple = L.HARD_EVIDENCE
    history: tuple = L.HISTORY
    question: tuple = L.QUESTION_WORDS
    noise: tuple = L.NOISE


def _first(of: Column, rules: dict[str, tuple[str, ...]], default: str | Column) -> Column:
    """The first name any of whose marks the text contains."""
    out = default if isinstance(default, Column) else F.lit(default)
    for name, marks in reversed(rules.items()):
        out = F.when(any_of(of, marks), F.lit(name)).otherwise(out)
    return out


#: Marks of hosts (for search results) and of source names (for cards). The two differ on purpose.
HOST_TYPES = {"official": ("gov.tw", ".gov", "official"), "social": ("facebook.com", "instagram.com", "threads.net", "youtube.com", "tiktok.com"), "forum": ("ptt.cc", "dcard.tw", "mobile01.com", "disp.cc")}
HOST_NEWS = ("news", "ettoday", "yahoo", "udn", "cna", "ltn", "tvbs", "storm")
SOURCE_TYPES = {
    "official": (".gov", ".edu", ".org.tw", "official"),
    "news": ("news", "ettoday", "yahoo", "ltn", "udn", "cna", "newslens", "chinatimes", "cts", "tvbs", "storm"),
    "forum": ("ptt", "dcard", "mobile01", "forum", "disp"),
    "social": ("facebook", "instagram", "threads.net", "x.com", "twitter", "youtube", "tiktok", "line.me"),
}
PLATFORMS = {"fundraising": ("flyingv", "newebpay"), "google": ("google", "maps"), "facebook": ("facebook", "fb.com"), "instagram": ("instagram",), "threads": ("threads",), "dcard": ("dcard",), "ptt": ("ptt",)}


def source_type_by_host(url: Column, source: Column, preset: Column, title: Column | None = None, entity: L.Terms = ()) -> Column:
    """The type of a result by its host. A page of OWN_PAGES is official if its host or title names the entity."""
    host = host_of(url)
    named = F.concat_ws(" ", host, F.lower(F.coalesce(source, F.lit(""))))
    own = any_of(host, L.OWN_PAGES) & any_of(F.concat_ws(" ", host, F.lower(F.coalesce(title if title is not None else F.lit(""), F.lit("")))), entity)
    found = _first(host, HOST_TYPES, F.when(any_of(named, HOST_NEWS), "news").when(own, "official").otherwise("other"))
    return F.when(preset.isin("official", "news", "forum", "social"), preset).otherwise(found)


def source_type_by_source(url: Column, source: Column, preset: Column) -> Column:
    name = F.lower(F.coalesce(F.nullif(source, F.lit("")), host_of(url)))
    return F.when(preset.isin("official", "news", "forum", "social", "other"), preset).otherwise(_first(name, SOURCE_TYPES, "other"))


def result_bucket(url: Column, source_type: Column) -> Column:
    known = F.when(source_type.isin("official", "news", "forum", "social"), source_type).otherwise("other")
    return _first(F.lower(F.coalesce(url, F.lit(""))), {"fundraising": ("flyingv.cc",), "official": ("donate.newebpay.com",)}, known)


def platform_bucket(source: Column, url: Column, source_type: Column) -> Column:
    return _first(F.lower(F.concat_ws(" ", source, url)), PLATFORMS, source_type)


def query_bucket(query: Column, rules: dict[str, tuple[str, ...]], domain: tuple[str, ...] = ()) -> Column:
    """Bucket of an expanded query: the first rule that it meets, else general. With terms of a domain in focus those are a rule
    after the first."""
    first, *others = rules.items()
    found = _first(F.lower(query), dict([first, ("domain", domain), *others]), "general")
    return F.when(found == "reported", "news").otherwise(found)


#: Buckets of expanded queries, in order.
QUERY_RULES = {
    "news": ("site:news",),
    "official": ("site:sasw.mohw.gov.tw", "site:donate.newebpay.com", "site:bobo.care"),
    "fundraising": ("site:flyingv.cc", "公益勸募", "勸募許可", "財務透明", "捐款", "善款", "募資"),
    "controversy": ("爭議", "質疑", "道歉", "澄清", "聲明"),
    "reported": ("新聞", "報導"),
    "community": ("site:facebook.com", "site:instagram.com", "site:threads.net", "site:ptt.cc/bbs", "site:dcard.tw", "ptt", "dcard", "facebook", "instagram", "threads"),
    "reviews": ("評論", "評價", "心得", "口碑", "推薦", "不推", "好評", "負評"),
}


def claim_type(question: Column, text: Column) -> Column:
    rules = {"fraud": ("詐騙",), "refund": ("退款",), "fundraising": ("募資", "透明"), "animal_welfare": ("動物", "環境", "福利")}
    return _first(F.concat_ws(" ", question, text), rules, "general_reputation")


def first_hand_score(text: Column, source_type: Column, terms: Terms = Terms()) -> Column:
    peer = source_type.isin("forum", "social")
    return (
        F.when(source_type == "official", 58)
        .when(any_of(text, terms.first_hand), F.when(peer, 82).otherwise(68))
        .when(source_type == "news", F.when(any_of(text, terms.reported), 32).otherwise(38))
        .when(peer, 48)
        .otherwise(36)
    )


def stance_strength(text: Column, source_type: Column, first_hand: Column, terms: Terms = Terms()) -> Column:
    """Struct of stance and strength, from the distinct negative and positive terms that a text has."""
    negative, positive, hard = hits(text, terms.negative), hits(text, terms.positive), any_of(text, terms.hard)
    hearsay = (source_type == "news") & any_of(text, terms.reported) & ~hard & (first_hand < 45)
    strength = F.when(hearsay, "weak").when(hard & (first_hand >= 60), "strong").when(hard | (first_hand >= 50), "medium").otherwise("weak")
    pair = lambda s, k: F.struct(F.lit(s).alias("stance") if isinstance(s, str) else s.alias("stance"), (F.lit(k) if isinstance(k, str) else k).alias("strength"))
    return (
        F.when(negative > positive, pair(F.when(hearsay, "unclear").otherwise("supporting"), strength))
        .when(positive > negative, pair(F.when(hearsay, "neutral").otherwise("opposing"), strength))
        .when(negative == 0, pair("neutral", "weak"))
        .otherwise(pair("unclear", "weak"))
    )


def clamp(score: Column, low: int = 0, high: int = 100) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), score))


def relevance_score(entity: Column, question: Column, title: Column, text: Column, terms: Terms = Terms(), variants: Column | None = None) -> Column:
    """0 to 100: does the text name the entity (or a variant of its name), does the title, does it share the
    question's words."""
    hay = F.lower(F.concat_ws(" ", title, text))
    name = F.lower(F.trim(entity))
    named, in_title = F.contains(hay, name), F.contains(F.lower(title), name)
    other = variants if variants is not None else F.array(name)
    partial = F.exists(other, lambda v: F.contains(hay, F.lower(v)))
    full = named | F.exists(other, lambda v: F.contains(F.lower(title), F.lower(v)))
    asked = F.filter(F.array(*map(F.lit, terms.question)).cast("array<string>"), lambda w: F.contains(question, w))
    shared = F.size(F.filter(asked, lambda w: F.contains(hay, F.lower(w))))
    focus = any_of(F.lower(question), ("募資", "捐款", "善款", "財務", "透明", "爭議", "質疑", "道歉", "聲明"))
    reported = any_of(hay, ("flyingv", "ptt.cc")) | any_of(title, ("新聞", "報導"))
    page = any_of(hay, ("官方募資頁", "faq", "checkout")) & ~any_of(hay, ("爭議", "道歉"))
    past = F.least(F.lit(12), 3 * hits(hay, terms.history)) + F.when(reported, 8).otherwise(0) - F.when(page, 8).otherwise(0)
    score = 15 + F.when(partial, 25).otherwise(0) + F.when(full, 30).otherwise(0) + F.when(in_title, 15).otherwise(0) + F.least(F.lit(15), 5 * shared) + F.when(focus, past).otherwise(0)
    score = score - F.when(any_of(hay, ("search?", "prequalify", "credit card")), 35).otherwise(0)
    return F.when(full | partial, clamp(score)).otherwise(clamp(F.least(F.lit(15), 3 * shared)))


def recency_label(published: Column, as_of: Column) -> Column:
    """recent up to a year before as_of (and after it), dated before that, unknown without a date."""
    day = F.to_date(F.coalesce(F.try_to_timestamp(F.split(published, "T")[0], F.lit("yyyy-MM-dd")), F.try_to_timestamp(published)))
    return F.when(day.isNull(), "unknown").when(F.datediff(as_of, day) <= 365, "recent").otherwise("dated")


def duplicate_risk(url: Column, title: Column) -> Column:
    return _first(F.lower(F.concat_ws(" ", url, title)), {"high": ("yahoo.com", "msn.com", "line.today"), "medium": ("news", "rss", "xml")}, "low")


def _value(of: Column, values: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[of], F.lit(0))


def credibility_score(source_type: Column, first_hand: Column, relevance: Column, recency: Column, risk: Column) -> Column:
    base = _value(source_type, {"official": 78, "news": 68, "forum": 48, "social": 42, "other": 36})
    bonus = _value(recency, {"recent": 8, "unknown": -4}) + _value(risk, {"medium": -6, "high": -12})
    return clamp(base + bonus + F.bround(first_hand * F.lit(0.12)).cast("int") + F.bround(relevance * F.lit(0.18)).cast("int"))


def is_noise_text(text: Column, terms: Terms = Terms()) -> Column:
    low = F.lower(F.trim(text))
    domain = F.rlike(low, F.lit(r"^(?:https?://)?[a-z0-9-]+(?:\.[a-z0-9-]+)+(?:/\S*)?$"))
    return (low == "") | domain | any_of(low, terms.noise)


def is_noise_card(title: Column, snippet: Column, url: Column, source: Column, relevance: Column, terms: Terms = Terms()) -> Column:
    whole = F.lower(F.concat_ws(" ", title, snippet, url, source))
    return any_of(whole, terms.noise) | (is_noise_text(title, terms) & (relevance < 70))


def gray_candidate(title: Column, snippet: Column, url: Column) -> Column:
    """Two points of suspicion: a list page's words (2), its url, a short snippet, a noisy title."""
    whole, low = F.lower(F.concat_ws(" ", title, snippet, url)), F.lower(url)
    points = F.when(any_of(whole, L.GRAY_TEXT), 2).otherwise(0) + any_of(low, L.GRAY_URL).cast("int") + (F.length(snippet) < 90).cast("int") + is_noise_text(title).cast("int")
    return points >= 2


#: Titles of embedded cards, and previews of social links that were cut.
EMBED_TITLES = ("• Instagram", "Instagram 相片與影片", "• Threads", "• Facebook", "Facebook 貼文")
CUT_PREVIEW = r"(?i)^(https?://|www\.)?(instagram\.com|facebook\.com|youtube\.com|youtu\.be|fb\.com|threads\.net|t\.co)[/\w@.\-]*[….]+$"


def is_junk(content: Column) -> Column:
    """Blank, under six characters, digits only, a cut preview or an embed title, or without any letter."""
    text = F.trim(F.coalesce(content, F.lit("")))
    embedded = any_of(text, EMBED_TITLES) | F.rlike(text, F.lit(CUT_PREVIEW))
    return (F.length(text) < 6) | embedded | F.rlike(text, F.lit(r"^[\d,]+$")) | F.rlike(text, F.lit(r"^[^\p{L}\p{Nl}\p{No}_]+$"))


def origin_label(source_type: Column, first_hand: Column) -> Column:
    peer = source_type.isin("forum", "social")
    return (
        F.when(source_type == "official", "官方說明")
        .when(first_hand >= 75, "第一手描述")
        .when(source_type == "news", "新聞轉述")
        .when(peer & (first_hand >= 55), "社群第一手貼文")
        .when(peer, "社群討論")
        .otherwise("整理資料")
    )


def review_tone(supporting: Column, opposing: Column) -> Column:
    """Of counts of supporting and opposing cards: which way they lean by more than one."""
    return F.when(supporting > opposing + 1, "negative").when(opposing > supporting + 1, "positive").otherwise("mixed")


#: Labels of platforms in order; the first whose mark the text has.
PLATFORM_LABELS = {"dcard": ("dcard",), "ptt": ("ptt",), "threads": ("threads",), "instagram": ("instagram",), "facebook": ("facebook", "fb.com"), "google": ("google", "maps")}


def platform_label(source: Column, url: Column) -> Column:
    return _first(F.lower(F.concat_ws(" ", source, url)), PLATFORM_LABELS, "other")


def question_focus(question: Column) -> Column:
    """Struct of flags: is the question about money, about a controversy, about what is recent."""
    low = F.lower(question)
    return F.struct(any_of(low, L.FUNDRAISING).alias("fundraising"), any_of(low, L.CONTROVERSY).alias("controversy"), any_of(low, L.RECENCY).alias("recency"))


def _label(of: Column, values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))[of]


# Phrases of the notes and summaries of cards.
STANCE_NOTES = {"supporting": "這則來源內容較支持使用者提出的疑慮。", "opposing": "這則來源內容較偏向反駁疑慮，或提到改善與回應。", "neutral": "這則來源主要提供背景資訊，沒有明確站在某一邊。", "unclear": "這則來源立場不夠清楚，建議人工再讀原文確認。"}
STANCE_SUMMARIES = {"supporting": "這則內容偏向支持疑慮", "opposing": "這則內容偏向反駁疑慮", "neutral": "這則內容主要提供背景資訊", "unclear": "這則內容的立場不明確"}
SOURCE_LABELS = {"official": "官方說明", "news": "新聞整理", "forum": "論壇討論", "social": "社群貼文", "other": "公開來源"}
STRENGTH_LABELS, RECENCY_LABELS = {"weak": "弱", "medium": "中", "strong": "強"}, {"recent": "近期", "dated": "較舊", "unknown": "時間未知"}
RISK_LABELS = {"low": "低", "medium": "中", "high": "高"}


def notes() -> Column:
    """What a reader should know of a card, from its columns."""
    return F.format_string(
        "%s 此來源屬於%s，證據強度為%s，第一手程度為 %d/100，相關性 %d/100，可信度 %d/100，時間判讀為%s，重複轉載風險為%s。",
        _label(F.col("stance"), STANCE_NOTES), origin_label(F.col("source_type"), F.col("first_hand")), _label(F.col("strength"), STRENGTH_LABELS), "first_hand", "relevance", "credibility",
        _label(F.col("recency"), RECENCY_LABELS), _label(F.col("duplicate_risk"), RISK_LABELS),
    )


def card_summary(excerpt: Column) -> Column:
    lead = F.concat(_label(F.col("source_type"), SOURCE_LABELS), F.lit("，"), _label(F.col("stance"), STANCE_SUMMARIES))
    return F.when(excerpt == "", F.concat(lead, F.lit("。"))).otherwise(F.concat(lead, F.lit("："), excerpt))
