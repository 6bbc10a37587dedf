"""Entity names: variants, tokens and aliases, as Column expressions over arrays."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions.text import strip

#: Name endings that stand for each other, and what a name may be extended by.
VARIANT_ENDINGS = {"狗園": ("", "寵物樂園", "樂園", "園區"), "樂園": ("", "狗園", "寵物樂園")}
#: Legal and city beginnings, and endings, that an alias may lack; names too general for an alias.
PREFIXES = (
    "社團法人", "財團法人", "中華民國", "國立", "私立",
    "臺北市", "台北市", "新北市", "桃園市", "臺中市", "台中市", "臺南市", "台南市", "高雄市", "基隆市", "新竹市", "新竹縣",
    "苗栗縣", "彰化縣", "南投縣", "雲林縣", "嘉義市", "嘉義縣", "屏東縣", "宜蘭縣", "花蓮縣", "臺東縣", "台東縣", "澎湖縣",
    "金門縣", "連江縣",
)
TRAILING = ("推廣協會", "研究協會", "關懷協會", "動物保護協會", "流浪動物協會", "護生協會", "愛護協會", "福利基金會", "生命基金會", "協會", "基金會", "志工隊", "志工團")
TOO_GENERAL = ("關懷", "保護", "動物", "流浪", "動保", "生命", "愛護", "護生", "基金會", "協會", "志工", "中心", "社團", "研究", "推廣", "照護", "臺灣", "台灣", "中華民國")
#: Endings whose roots also count as naming the entity.
ROOT_ENDINGS = ("狗園", "樂園", "園區", "協會", "流浪狗園", "流浪毛小孩生命照護協會")
#: Words of a question that known sources are searched for.
QUESTION_WORDS = ("募資", "捐款", "善款", "財務", "透明", "爭議", "質疑", "道歉", "聲明", "報導", "新聞")


def ordered_unique(values: Column, least: int = 1) -> Column:
    """Trimmed values of at least so many characters, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(values, strip), lambda v: v.isNotNull() & (F.length(v) >= least)))


def search_variants(name: Column, endings: dict[str, tuple[str, ...]] = VARIANT_ENDINGS, most: int = 4) -> Column:
    base = strip(name)
    parts = [F.array(base)]
    for ending, others in endings.items():
        root = strip(F.regexp_replace(base, re.escape(ending) + "$", ""))
        made = F.array(*(F.concat(root, F.lit(o)) for o in others))
        parts.append(F.when(F.endswith(base, F.lit(ending)), made).otherwise(F.array().cast("array<string>")))
    return F.slice(ordered_unique(F.concat(*parts)), 1, most)


def analysis_variants(name: Column, endings: dict[str, tuple[str, ...]] = VARIANT_ENDINGS) -> Column:
    """Variants that cards are compared with: in lower case, without bare roots, all of them."""
    longer = {ending: tuple(o for o in others if o) for ending, others in endings.items()}
    return ordered_unique(F.transform(search_variants(name, longer, 1 << 30), F.lower))


def exact_terms(name: Column, endings: tuple[str, ...] = ROOT_ENDINGS) -> Column:
    """The name, and the name without each ending that it has, if two characters or more are left."""
    base = strip(name)
    roots = [F.when(F.endswith(base, F.lit(e)), strip(F.regexp_replace(base, re.escape(e) + "$", ""))) for e in endings]
    return F.concat(F.array(base), F.filter(F.array(*roots), lambda r: r.isNotNull() & (F.length(r) >= 2)))


def question_terms(question: Column, words: tuple[str, ...] = QUESTION_WORDS) -> Column:
    """The words that a question is known by, in the order of the list."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce(question, F.lit("")), w))


def entity_tokens(name: Column, **kwargs) -> Column:
    """Variants and the words of the name, in lower case, of two characters or more."""
    words = F.split(F.lower(name), r"[\s　]+")
    return ordered_unique(F.concat(F.transform(search_variants(name, **kwargs), F.lower), words), 2)


def expand_aliases(name: Column, prefixes=PREFIXES, trailing=TRAILING, blocked=TOO_GENERAL, least: int = 4, swap: tuple[str, str] = ("台", "臺")) -> Column:
    """Aliases: without beginnings (as often as they come), also without the first listed ending that fits,
    each with both spellings of a character; not the name itself, none too short or too general."""
    either = "|".join(map(re.escape, prefixes))
    core = strip(F.regexp_replace(strip(name), f"^(?:{either})+", ""))
    ending = F.coalesce(*(F.when(F.endswith(core, F.lit(t)) & (F.length(core) - len(t) >= 2), F.lit(t)) for t in trailing), F.lit(""))
    short = F.substring(core, F.lit(1), F.length(core) - F.length(ending))
    made = F.array(strip(name), core, short)
    made = F.concat(made, F.transform(made, lambda v: F.replace(v, F.lit(swap[0]), F.lit(swap[1]))), F.transform(made, lambda v: F.replace(v, F.lit(swap[1]), F.lit(swap[0]))))
    kept = ordered_unique(F.transform(made, lambda v: F.regexp_replace(v, r"^[·、， 。．.]+|[·、， 。．.]+$", "")), least)
    return F.filter(kept, lambda v: (v != strip(name)) & ~v.isin(*blocked))


def cached_terms(name: Column, question: Column, queries: Column, most: int = 12, words: tuple[str, ...] = QUESTION_WORDS) -> Column:
    """Search terms: the name, its exact terms, the words that the question is known by, and the pieces of the first six queries without
    "site:" and quotes; of two characters or more, each once, the first twelve."""
    bare = lambda q: F.replace(F.replace(q, F.lit("site:"), F.lit(" ")), F.lit('"'), F.lit(" "))
    pieces = F.flatten(F.transform(F.slice(F.coalesce(queries, F.array().cast("array<string>")), 1, 6), lambda q: F.split(bare(q), r"[\s\x{3000}\x{A0}]+")))
    return F.slice(ordered_unique(F.concat(F.array(name), exact_terms(name), question_terms(question, words), pieces), 2), 1, most)


def relaxed_tokens(name: Column, endings: tuple[str, ...] = ROOT_ENDINGS) -> Column:
    """Variants in lower case, each also without an ending."""
    variants = F.transform(search_variants(name), F.lower)
    def rooted(ending: str) -> Column:
        those = F.filter(variants, lambda v: F.endswith(v, F.lit(ending)))
        return F.transform(those, lambda v: strip(F.regexp_replace(v, re.escape(ending) + "$", "")))

    roots = [rooted(e) for e in endings]
    return ordered_unique(F.concat(variants, *roots), 2)


def forum_keywords(name: Column, suffixes: tuple[str, ...], most: int = 6) -> Column:
    """The name, its words of two characters or more, and the name with each suffix that it lacks."""
    base = strip(name)
    words = F.filter(F.split(base, r"[\s　]+"), lambda w: F.length(w) >= 2)
    longer = F.filter(F.array(*(F.when(~F.contains(base, F.lit(s)), F.concat(base, F.lit(s))) for s in suffixes)).cast("array<string>"), lambda v: v.isNotNull())
    return F.slice(ordered_unique(F.concat(F.array(base), words, longer)), 1, most)


def strip_social_url(url: Column) -> Column:
    """A page of one social site without the slash at its end; "" for any other url."""
    tidy = F.trim(url)
    return F.when(F.rlike(tidy, F.lit(r"(?i)^https?://[^/]*(facebook\.com|fb\.)")), F.regexp_replace(tidy, "/+$", "")).otherwise("")
