"""Main text of HTML pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Function words of the languages of the corpus, by which running text is told from lists.
STOP_WORDS = frozenset(
    """
    the of and to in is was for that it on as with be by at this from are or an a not have he she they we you which
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass
    de la le et les des en un une du que est pour qui dans par sur pas plus au ce il ne se sont avec
    el los las y del en que se por con para una su al lo como más o pero sus es no
    """.split()
)

#: Fixed values of HTML: tags that end a block; containers that are never main text; raw-text elements.
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body canvas center dd details dialog dir div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th
    thead tr ul
    """.split()
)
CHROME_TAGS = frozenset("nav footer aside menu dialog button select textarea".split())
RAW_TAGS = frozenset("script style noscript template svg math iframe object head title textarea".split())
CHROME_WORDS = frozenset(
    """
    ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb
    breadcrumbs sidebar footer header masthead topbar toolbar cookie cookies consent notice notices alert gdpr popup modal overlay
    newsletter subscribe subscription signup login comment comments commentlist disqus reply replies respond related
    recommended share sharing social widget pagination pager copyright legal disclaimer skip
    """.split()
)
#: Names that condemn a container whatever it holds, and words that turn a name into one of something else.
ALWAYS_CHROME = frozenset("comment comments commentlist disqus reply replies respond cookie cookies consent gdpr popup modal".split())
LINKING_WORDS = frozenset("has have with without no non free of is".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())

_OPENING = re.compile(r"<(?:(!--)|(!\[CDATA\[)|([!?])|(/?)([a-zA-Z][^\s/>]*))")
#: In a tag: its end, or a value with the quote that begins it.
_IN_TAG = re.compile(r">|=\s*(?:([\"'])|[^\s>]*)")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
#: Letters of scripts that are written without the stop words above, and marks that end their sentences.
_OTHER_SCRIPT = re.compile(r"[\u0370-\u1FFF\u3040-\u9FFF\uA000-\uD7FF\U00020000-\U0003FFFF]")
_SENTENCE_END = re.compile(r"[.!?;。！？；।؟۔]")


@dataclass
class Rules:
    """Thresholds of the block rules."""

    short: int = 70  # characters below which a block is ambiguous
    long: int = 200  # characters from which a block with many stop words is good
    stop_low: float = 0.15
    stop_high: float = 0.25
    link_most: float = 0.33


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    chrome: bool  # in a container that is never main text
    article: bool  # in article or main
    heading: bool
    suspect: int = -1  # the innermost container around it whose name is one of menus, notices and the like
    label: str = ""


def _is_chrome(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether a container is never main text, and whether its name makes it a suspect."""
    if tag in CHROME_TAGS or tag == "header" and not in_article:
        return True, False
    suspect = tag == "form"
    for name, a, b, c in _ATTR.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in CHROME_ROLES:
            return True, False
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            for token in value.split():
                words = _NAME.findall(token)
                if not CHROME_WORDS.isdisjoint(words) and LINKING_WORDS.isdisjoint(words):
                    if not ALWAYS_CHROME.isdisjoint(words):
                        return True, False
                    suspect = True
    return False, suspect


def tags_of(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag; name "" for comments and declarations. In linear time: what has no end is
    looked for once.

    A quote opens a value only after an equals sign; a "<" that no ">" follows is text.
    """
    at, last = 0, {c: page.rfind(c) for c in ">\"'"}
    while (m := _OPENING.search(page, at)) and m.start() < last[">"]:
        start, end = m.start(), m.end()
        if m[1] or m[2]:
            end = page.find("-->" if m[1] else "]]>", end)
            at = len(page) if end < 0 else end + 3
            yield start, at, "", False, ""
            continue
        if not m[3]:
            while (x := _IN_TAG.search(page, end)) and x[0] != ">":
                end = x.end()
                if x[1] and last[x[1]] >= end:
                    end = page.find(x[1], end) + 1
            if x is None:  # the last ">" is inside a value
                at = m.end()
                last[">"] = start
                continue
            end = x.start()
        else:
            end = page.find(">", end)
        at = end + 1
        yield start, at, (m[5] or "").lower(), bool(m[4]), page[m.end() : end] if m[5] else ""


def blocks_of(page: str) -> tuple[list[Block], list[int]]:
    """Split a page into its blocks, in order, and the container around each suspect one (-1: none). Unclosed tags end with
    their container."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # open containers: tag, chrome, article, suspect
    around: list[int] = []
    pieces: list[str] = []
    linked, in_link, heading = 0, 0, False
    chrome, article, suspect = False, False, -1
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
        pieces.clear()
        if text:
            out.append(Block(text, min(linked, len(text)), chrome, article, heading, suspect))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            pieces.append(raw)
            if in_link:
                linked += len(raw.strip())

    def push(tag: str, attributes: str, in_article: bool) -> None:
        nonlocal chrome, article, suspect
        condemned, named = _is_chrome(tag, attributes, article)
        chrome, article = chrome or condemned, in_article
        if named:
            around.append(suspect)
            suspect = len(around) - 1
        stack.append((tag, chrome, article, suspect))
        opened[tag] += 1

    def pop(depth: int) -> None:
        nonlocal chrome, article, suspect
        opened.subtract(x[0] for x in stack[depth:])
        del stack[depth:]
        chrome, article, suspect = stack[-1][1:] if stack else (False, False, -1)

    at = 0
    for start, end, tag, closing, attributes in tags_of(page):
        if start < at:  # in what a raw element holds
            continue
        add(page[at:start])
        at = end
        if not tag:
            continue
        whole = attributes.endswith("/")
        if tag in RAW_TAGS and tag != "textarea" and not closing:
            if not whole and tag not in unclosed:
                found = re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|(?=<body[\s>])", re.I).search(page, at)
                if found:
                    at = found.end()
                elif tag in ("script", "style", "svg", "iframe"):
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag == "br":
            pieces.append(" ")
        if tag not in BLOCK_TAGS and tag not in CHROME_TAGS:
            # inline containers may be marked as notices and the like
            if not closing and tag not in VOID_TAGS and not whole and attributes and any(_is_chrome(tag, attributes, article)):
                close()
                push(tag, attributes, article)
            elif closing and stack and stack[-1][0] == tag:
                close()
                pop(len(stack) - 1)
            continue
        close()
        in_link = 0
        if tag in HEADINGS:
            heading = not closing
        elif tag in ("p", "hr"):
            heading = False
            if not (not closing and attributes and any(_is_chrome(tag, attributes, article))):
                if closing and stack and stack[-1][0] == tag:
                    pop(len(stack) - 1)
                continue
        if closing:
            if opened[tag] > 0:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag not in VOID_TAGS:
            push(tag, attributes, article or tag in ("article", "main"))
    add(page[at:])
    close()
    return out, around


def stop_share(text: str) -> float:
    """Share of stop words. A text mainly in scripts that have none here counts as running text if it has the end of a sentence for about
    each 150 letters."""
    other = len(_OTHER_SCRIPT.findall(text))
    if 2 * other > len(text) - text.count(" "):
        return 0.3 if 150 * len(_SENTENCE_END.findall(text)) >= other else 0.0
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / max(1, len(words))


def _acquit(blocks: list[Block], around: list[int], shares: list[float], rules: Rules) -> None:
    """Condemn the suspect containers: their blocks are chrome. One that holds most of the page's text and of its running text, more than a
    long block of it and more than three times that of the good blocks outside all suspects, is acquitted: there its name means
    something else."""
    inside, total, outside = [0.0] * len(around), 0.0, 0.0
    letters, everything = [0] * len(around), 0
    for b, share in zip(blocks, shares):
        if b.chrome or b.links > rules.link_most * len(b.text):
            continue
        weight = share * len(b.text)
        total += weight
        everything += len(b.text)
        if b.suspect < 0 and share >= rules.stop_low and (b.article or len(b.text) > rules.long):
            outside += weight
        i = b.suspect
        while i >= 0:
            inside[i] += weight
            letters[i] += len(b.text)
            i = around[i]
    guilty = []
    for i, parent in enumerate(around):  # parents come first
        guilty.append(parent >= 0 and guilty[parent] or not (inside[i] > max(0.5 * total, 3 * outside) and letters[i] > max(0.5 * everything, 1.5 * rules.long)))
    for b in blocks:
        b.chrome = b.chrome or b.suspect >= 0 and guilty[b.suspect]


def classify(blocks: list[Block], around: list[int], rules: Rules = Rules()) -> list[bool]:
    """Two passes: each block by its own densities to good, bad, near or short; then near and short ones, and
    headings, by their nearest decided neighbours."""
    shares = [stop_share(b.text) for b in blocks]
    _acquit(blocks, around, shares, rules)
    for b, stops in zip(blocks, shares):
        if b.chrome or b.links > rules.link_most * len(b.text):
            b.label = "bad"
        elif b.heading:
            b.label = "short"
        elif len(b.text) < rules.short:
            b.label = "short" if b.links == 0 else "bad" if not b.article else "short"
        elif stops >= rules.stop_high:
            b.label = "good" if len(b.text) > rules.long or b.article else "near"
        elif stops >= rules.stop_low:
            b.label = "good" if b.article else "near"
        else:
            b.label = "near" if b.article else "bad"
    first = [b.label for b in blocks]
    if "good" not in first:  # a page of middling paragraphs alone: the best there are decide
        first = ["good" if label == "near" else label for label in first]
    keep = [label == "good" for label in first]

    def decided(step: int) -> list[tuple[str, bool]]:
        """For each block the label of the nearest decided block on one side within the same kind of container, and
        whether there is one."""
        out, last = [("", False)] * len(blocks), {}
        for i in range(len(blocks))[::step]:
            side = blocks[i].article
            out[i] = (last[side], True) if side in last else ("", False)
            if first[i] in ("good", "bad") and not blocks[i].chrome:
                last[side] = first[i]
        return out

    before, after = decided(1), decided(-1)
    for i, b in enumerate(blocks):
        if first[i] in ("good", "bad"):
            continue
        sides = [label for label, there in (before[i], after[i]) if there]
        if b.heading:  # a heading goes with what it heads
            keep[i] = after[i][0] == "good" if after[i][1] else b.article
        elif not sides:
            keep[i] = b.article
        elif "good" in sides and "bad" in sides:
            keep[i] = first[i] == "near" or b.article
        else:
            keep[i] = sides[0] == "good"
    return keep


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    if not page:
        return ""
    blocks, around = blocks_of(page)
    return "\n".join(b.text for b, kept in zip(blocks, classify(blocks, around, rules)) if kept)


def _extract(rules: Rules, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(t, rules) for t in batch.column(column).to_pylist()]
            others = [c for c in batch.schema.names if c != column]
            arrays = [batch.column(c) for c in others] + [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, [*others, "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(page_id, url, text, n_chars) of each page (page_id, url, html), one row each.

    text: the kept blocks in page order, joined by one newline; inside a block white space is one space, and
    character references are decoded. Null, empty and text-less pages give "" and 0; equal rows are each
    extracted; null ids and urls stay; an empty table gives no rows; other columns of pages are not read.
    """
    from pyspark.sql import types as T

    kept = pages.select("page_id", "url", "html")
    schema = T.StructType([*(f for f in kept.schema if f.name != "html"), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return kept.mapInArrow(_extract(rules, "html"), schema)


def op6_html_blocks(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
