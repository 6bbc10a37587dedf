"""Text cleaning as Column expressions."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Unicode white space that trimming removes besides the ASCII kind.
_WIDE = "\\s\\u3000\\u00A0"

#: Fixed value: what stands for a text of which nothing is left.
FALLBACK_SUMMARY = "現有來源多為片段描述，仍需補查。"


def once(value: Column, use) -> Column:
    """use(value), where use may name the value many times: it is made once for each row."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{_WIDE}]+|[{_WIDE}]+$", "")


def host_of(url: Column) -> Column:
    """Host and port of an absolute url, in lower case; else ""."""
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1))


def site_of(url: Column, unknown: str = "未知來源") -> Column:
    return F.when(F.contains(url, F.lit("://")), F.element_at(F.split(url, "/"), 3)).otherwise(F.lit(unknown))


@F.pandas_udf(T.StringType())
def normalized(text: pd.Series) -> pd.Series:
    """Character references decoded, then NFKC: the one step that Spark has no function for."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", html.unescape(t)))


def letters(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}぀-ヿ]+", "")


def is_readable(c: Column) -> Column:
    """Letters are over 0.3 of the text."""
    return F.coalesce(F.length(letters(c)) > 0.3 * F.length(c), F.lit(False)) & (F.length(c) > 0)


#: What is removed from crawled text, in order, and what stands in its place.
CONTENT_RULES = [
    (r"(?is)<svg.*?</svg>", ""),
    (r"%3[CEce][^%\s]{0,20}(%[0-9A-Fa-f]{2})+[^%\s]*", ""),
    (r"data:[a-zA-Z/+]+;base64,[A-Za-z0-9+/=]+", ""),
    (r"\{[^}]*:[^}]*\}", ""),
    (r"(function\s*\([^)]*\)\s*\{[^}]*\}|var\s+\w+\s*=)", ""),
    (r"<[^>]{1,500}>", " "),
    (r"\[[^\]]+\]\([^)]+\)", " "),
    (r"https?://\S+", " "),
    (r"(%[0-9A-Fa-f]{2}){3,}", ""),
    (r"(?i)(fill|stroke|opacity|d|url\(#)[^'\";\s)]{3,}", ""),
    (r"[MmCcSsLlHhVvZzAaQqTt][0-9][0-9.,\s-]{8,}", ""),
    (r"[​-‏‪-‮﻿]", ""),
    (r"�+", ""),
    (r"[\[\]{}<>|`~^]+", " "),
    (r"[˙•◆■□▪︎]{2,}", " "),
    (r"[=_*#@+\-]{4,}", " "),
    (r"\s{2,}", " "),
    (r"^\s+|\s+$", ""),
    (r"[\p{C}[^\P{S}⭐☆%]]+", ""),
    (r"[一-龥A-Za-z0-9]{1,3}[�…]+$", ""),
    (r"\s{2,}", " "),
    (r"^[ \-_:/]+|[ \-_:/]+$", ""),
]
#: Strings of which a text must hold one for a pattern to match, as far as there are such: most texts need no pass of most rules.
_UNSEEN = r"[​-‏‪-‮﻿]"
_UNSEEN_CHARS = (*map(chr, range(0x200B, 0x2010)), *map(chr, range(0x202A, 0x202F)), "\ufeff")
NEEDED = {
    r"(?is)<svg.*?</svg>": ("<",),
    r"%3[CEce][^%\s]{0,20}(%[0-9A-Fa-f]{2})+[^%\s]*": ("%3",),
    r"data:[a-zA-Z/+]+;base64,[A-Za-z0-9+/=]+": ("data:",),
    r"\{[^}]*:[^}]*\}": ("{",),
    r"(function\s*\([^)]*\)\s*\{[^}]*\}|var\s+\w+\s*=)": ("function", "var"),
    r"<[^>]{1,500}>": ("<",),
    r"\[[^\]]+\]\([^)]+\)": ("](",),
    r"https?://\S+": ("://",),
    r"(%[0-9A-Fa-f]{2}){3,}": ("%",),
    _UNSEEN: _UNSEEN_CHARS,
    r"�+": ("�",),
    _UNSEEN + r"|�+": (*_UNSEEN_CHARS, "�"),
    r"[˙•◆■□▪︎]{2,}": tuple("˙•◆■□▪\ufe0e"),
    r"[一-龥A-Za-z0-9]{1,3}[�…]+$": ("�", "…"),
    r"\r": ("\r",),
    r"\n{3,}": ("\n\n\n",),
    r"[ \t]{2,}": ("  ", "\t"),
}


#: Patterns that match at the ends of a text alone, with what its first or last character then is: one of theirs, or, as $ stands before a last
#: line break too, one of those.
_BREAKS = r"\n\r\u0085\u2028\u2029"
AT_ENDS = {r"^\s+|\s+$": rf"[\s{_BREAKS}]", r"^[ \-_:/]+|[ \-_:/]+$": rf"[ \-_:/{_BREAKS}]"}


def replaced(c: Column, pattern: str, put: str) -> Column:
    """regexp_replace, of texts that hold what the pattern needs."""
    if pattern in AT_ENDS:
        return once(c, lambda x: F.when(F.rlike(F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1))), F.lit(AT_ENDS[pattern])), F.regexp_replace(x, pattern, put)).otherwise(x))
    if pattern not in NEEDED:
        return F.regexp_replace(c, pattern, put)
    return once(c, lambda x: F.when(reduce(Column.__or__, (F.contains(x, F.lit(n)) for n in NEEDED[pattern])), F.regexp_replace(x, pattern, put)).otherwise(x))


#: The rule for leftovers of vector graphics; it also takes Latin words apart, so that it can be left out.
_SVG_ATTRIBUTES = 9


def without_markup(c: Column, strict: bool = True) -> Column:
    """Normalized text without markup, scripts, links and symbols: all CONTENT_RULES in order."""
    for i, (pattern, put) in enumerate(CONTENT_RULES):
        if strict or i != _SVG_ATTRIBUTES:
            c = replaced(c, pattern, put)
    return c


def or_discarded(c: Column) -> Column:
    """Cleaned text, or "" if it is too short or hardly readable."""
    return once(c, lambda x: F.when((F.length(x) < 15) | ~is_readable(x), F.lit("")).otherwise(x))


def clean_content(c: Column, strict: bool = True) -> Column:
    """Crawled text cleaned, in one expression; null and "" stay."""
    return F.when(c.isNull() | (c == ""), c).otherwise(or_discarded(without_markup(normalized(c), strict)))


def clean_summary_text(c: Column, normalize: bool = True) -> Column:
    """Lines trimmed, blank and broken ones dropped; a fixed sentence if nothing is left; "" for no text."""
    out = normalized(c) if normalize else c
    for pattern, put in ((r"[​-‏‪-‮﻿]|�+", ""), (r"[˙•◆■□▪︎]{2,}", " "), (r"\r", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")):
        out = replaced(out, pattern, put)
    lines = F.transform(F.split(out, "\n"), lambda x: replaced(x, r"^[ \-_:/]+|[ \-_:/]+$", ""))
    broken = lambda x: (F.contains(x, F.lit("…")) | F.contains(x, F.lit("�"))) & F.rlike(x, F.lit(r"[一-龥A-Za-z0-9]{1,3}[�…]+$"))
    kept = F.filter(lines, lambda x: (x != "") & ~broken(x))
    text = once(strip(F.array_join(kept, "\n")), lambda t: F.when(t == "", F.lit(FALLBACK_SUMMARY)).otherwise(t))
    return F.when(c.isNull() | (c == ""), F.lit("")).otherwise(text)


def normalize_html_text(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = normalized(F.regexp_replace(out, r"<[^>]+>", " "))
    return strip(F.regexp_replace(F.regexp_replace(out, r"[*_`#>\[\]]+", " "), r"\s+", " "))


def excerpt(entity: Column, question: Column, text: Column, markers: tuple[str, ...] = (), chars: int = 180) -> Column:
    """The two best sentences: by keyword hits, then naming the entity, then length; text order among equals."""
    parts = F.split(F.regexp_replace(text, r"([。！？!?])\s+", "$1\n"), "\n+")
    sentences = F.array_distinct(F.filter(F.transform(parts, strip), lambda s: s != ""))
    words = F.concat(F.array(strip(entity)), F.filter(F.array(*map(F.lit, markers)).cast("array<string>"), lambda m: F.contains(question, m)))

    def scored(s, i):
        hits = F.size(F.filter(words, lambda w: (w != "") & F.contains(s, w)))
        return F.struct((-4 * hits).alias("h"), (-F.contains(s, strip(entity)).cast("int")).alias("e"), (-F.least(F.length(s), F.lit(220))).alias("n"), i.alias("i"), s.alias("s"))

    def joined(best):
        first, second = F.get(best, 0)["s"], F.get(best, 1)["s"]
        return F.when((F.length(first) >= 150) | second.isNull(), first).otherwise(F.concat_ws(" ", first, second))

    two = once(F.array_sort(F.transform(sentences, scored)), joined)
    return F.substring(F.coalesce(two, F.lit("")), 1, chars)
