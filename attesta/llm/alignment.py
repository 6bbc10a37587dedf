"""Cross-tokenizer alignment: byte ranges of two tokenizers' tokens merged in lockstep over all documents of a batch."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import lookup_join, stored

#: Characters that are merged at once, and words of one call of the tokenizers; words whose ids a Python worker keeps at most; tokens
#: after which a document goes on as another lane.
BATCH_CHARS, CALL_WORDS, MEMO_WORDS, LANE = 1_500_000, 2_000, 600_000, 256
#: Rows of the table of linked pairs (24 bytes each) up to which it is broadcast.
PAIR_ROWS = 1_500_000

def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones are themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: How byte-level vocabularies of this kind cut texts, for words of Latin letters (fixed values).
_CUTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A part three times over: pairs of equal rank overlap there, and two encoders may begin at other ends.
_THRICE = re.compile(r"(.+?)\1\1", re.DOTALL)
#: B's ids among A's in one list.
B_BIT = 1 << 31


def _ranked(a: str, a_bytes: list[bytes]):
    """An encoder of the same merges by rank, or None where an id isn't its merge's rank."""
    import tiktoken

    with open(a, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    letters, ranks = byte_alphabet(), {}
    for x, y in (m.split(" ") if isinstance(m, str) else m for m in merges):
        if not letters.keys() >= set(x + y):
            return None
        ranks[bytes(map(letters.__getitem__, x + y))] = 256 + len(ranks)
    ranks |= {x: i for i, x in enumerate(a_bytes[:256])}
    if len(ranks) != 256 + len(merges) or any(i >= len(a_bytes) or a_bytes[i] != x for x, i in ranks.items()):
        return None
    return tiktoken.Encoding("ranked", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={})


class TokenPair:
    """Ids of both tokenizers by document, whose bytes are those of a space and the text; None where either tokenizer's aren't.

    A document's ids are 32-bit numbers, little-endian, those of B with B_BIT set; each side's are in order, A and B in turn by word.
    No token of either crosses from a word to a single space after it, so that ids are kept by word. Where that can't be told (a
    space at an end or beside other white space, a word whose bytes a tokenizer changes, vocabularies of other kinds), texts are encoded
    whole. Words are kept in two generations: those that no text needed while the younger one filled up are forgotten.

    Words of Latin letters without a part three times over are encoded by merge ranks, which gives A's ids in less time: a token's bytes
    alone lead to the one merge that makes it, whatever stands around them, but where equal merges overlap.
    """

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        letters, vocabulary = byte_alphabet(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, token)) if letters.keys() >= set(token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.a_bytes, self.b_bytes))
        self.a_spaced = np.array([x[:1] == b" " for x in self.a_bytes])
        self.by_word = not any(re.search("[^▁]▁", p) for p in pieces) and self.a.normalizer is None and "use_regex=True" in str(self.a.pre_tokenizer)
        self.ranked = _ranked(a, self.a_bytes) if self.by_word else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.whole: set[str] = set()  # words whose texts are encoded whole

    def _ids(self, text: str, ranked: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        a = self.ranked.encode_ordinary(" " + text) if ranked else self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b, want = self.b.encode(text), (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != want or b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        return np.array(a, "<u4"), np.array(b, "<u4") | np.uint32(B_BIT)

    def _whole(self, text: str) -> bytes | None:
        both = self._ids(text)
        return None if both is None else b"".join(ids.tobytes() for ids in both)

    def _learn(self, words: list[str], ranked: bool) -> None:
        """Many words in one call, told apart by the places where they end; by halves if a place doesn't fit."""
        both = self._ids(" ".join(words), ranked)
        if both is not None:
            ends, parts = np.cumsum([len(w.encode()) + 1 for w in words]), []
            for ids, sizes in zip(both, (self.a_sizes, self.b_sizes)):
                reached = np.cumsum(sizes[ids & np.uint32(B_BIT - 1)])
                at = np.searchsorted(reached, ends)
                if (reached[at] != ends).any():
                    break
                data, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
                parts.append([data[x:y] for x, y in zip(cuts, cuts[1:])])
            if len(parts) == 2:
                self.young.update(zip(words, map(bytes.__add__, *parts)))
                return
        if len(words) == 1:
            self._set_apart(words[0])
        else:
            self._learn(words[: len(words) // 2], ranked)
            self._learn(words[len(words) // 2 :], ranked)

    def _set_apart(self, word: str) -> None:
        self.whole.add(word)
        self.young[word] = b""

    def _need(self, words: set[str]) -> None:
        """Make the ids of words known in the younger generation."""
        if len(self.young) + len(words) > MEMO_WORDS // 2:
            self.young, self.old = {}, self.young
            self.whole = {w for w in self.whole if w in self.old}
        young, old, new = self.young, self.old, ([], [])
        for w in words - young.keys():
            if w in old:
                young[w] = old[w]
            elif not w or w != w.strip() or "\u180e" in w:
                self._set_apart(w)
            else:
                new[self.ranked is not None and max(w) < "\u0250" and not _THRICE.search(w)].append(w)
        for ranked, part in enumerate(new):
            for at in range(0, len(part), CALL_WORDS):
                self._learn(part[at : at + CALL_WORDS], bool(ranked))

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """The ids of each text; None for an empty text too."""
        split = [t.split(" ") if t and self.by_word else [] for t in texts]
        self._need(set().union(*split))
        ids, out = self.young.__getitem__, []
        for text, words in zip(texts, split):
            if words and self.whole.isdisjoint(words):
                out.append(b"".join(map(ids, words)))
            else:
                out.append(self._whole(text) if text else None)
        return out


@lru_cache(maxsize=1)
def token_pair(a: str, b: str) -> TokenPair:
    """Kept by a worker for its next tasks, with the words that it knows."""
    return TokenPair(a, b)


def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_starts: np.ndarray, b_starts: np.ndarray, spaced: np.ndarray, width: int = LANE) -> tuple[np.ndarray, ...]:
    """Where merging begins: (first A token, first B token, A token to stop before). Each document is a lane; one of more than `width`
    tokens goes on as further lanes at spaces where both sides end a token."""
    starts = np.flatnonzero(spaced)
    if len(starts):
        wanted = np.searchsorted(starts, np.arange(width, len(a_ends), width))
        at = np.unique(starts[wanted[wanted < len(starts)]])
        at = at[at > 0]
        j = np.searchsorted(b_ends, a_ends[at - 1])
        fits = b_ends[j] == a_ends[at - 1]
        a_starts, b_starts = np.concatenate([a_starts, at[fits]]), np.concatenate([b_starts, j[fits] + 1])
    first_a, once = np.unique(a_starts, return_index=True)
    return first_a, b_starts[once], np.append(first_a[1:], len(a_ends))


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, first_a: np.ndarray, first_b: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
    """Merge all lanes at once: the links (A place, B place) and the cuts (places of the A and B token that end together).

    The state is a pointer into the A tokens and one into the B tokens for each lane. Each step links the tokens pointed at; the one that
    ends first is left, or both if they end together, which is a cut. Lanes that are through are taken out of the state.
    """
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    a, b = first_a.astype(np.int32), first_b.astype(np.int32)
    while len(a):
        links_a.append(a)
        links_b.append(b)
        end_a, end_b = a_ends[a], b_ends[b]
        on_a, on_b = end_a <= end_b, end_b <= end_a
        cut = np.flatnonzero(on_a & on_b)
        cuts_a.append(a[cut])
        cuts_b.append(b[cut])
        a, b = a + on_a, b + on_b
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    none = np.zeros(0, np.int32)
    return tuple(np.concatenate([none, *x]) for x in (links_a, links_b, cuts_a, cuts_b))


def _digits(most: int) -> tuple[np.ndarray, np.ndarray]:
    """The decimal digits of the numbers below `most` as the bytes of a 64-bit number, the first one lowest, and their counts."""
    if most > 10**7:
        raise ValueError("ids of more than seven digits")
    text = np.arange(most).astype("S8")
    return text.view("<u8"), np.char.str_len(text).astype(np.uint64)


def group_texts(a_ids, b_ids, cuts_a, cuts_b, a_starts, b_starts, digits) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of `a1,a2|b1;a3|b2,b3;` of all documents one after the other, and where each document's begin."""
    table, counts = digits
    cuts_a, cuts_b = np.sort(cuts_a), np.sort(cuts_b)  # both sides' rise together
    a_group, b_group = np.zeros(len(a_ids), np.int32), np.zeros(len(b_ids), np.int32)
    a_group[cuts_a[:-1] + 1] = b_group[cuts_b[:-1] + 1] = 1
    a_place = np.arange(len(a_ids)) + np.concatenate([[0], cuts_b + 1])[np.cumsum(a_group)]
    b_place = np.arange(len(b_ids)) + (cuts_a + 1)[np.cumsum(b_group)]
    ids, marks = np.empty(len(a_ids) + len(b_ids), np.int32), np.full(len(a_ids) + len(b_ids), ord(","), np.uint64)
    ids[a_place], ids[b_place] = a_ids, b_ids
    marks[a_place[cuts_a]], marks[b_place[cuts_b]] = ord("|"), ord(";")
    size = counts[ids]
    flat = (table[ids] | (marks << (size << np.uint64(3)))).view(np.uint8)  # the mark is the byte after the digits; other bytes are zero
    reached = np.concatenate([[0], np.cumsum(size + np.uint64(1)).astype(np.int64)])
    return flat[flat != 0], reached[a_starts + b_starts]


LINKS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair: long, times: int>>"


def _sides(encoded: list[bytes], sizes: list[np.ndarray]):
    """Of both sides of a batch of documents the flat ids, their ends in bytes and the documents' starts."""
    flat, ends = np.frombuffer(b"".join(encoded), "<u4"), np.cumsum([len(e) // 4 for e in encoded])
    of_b = flat >= B_BIT
    for side, size in enumerate(sizes):
        there = of_b if side else ~of_b
        ids = (flat[there] & np.uint32(B_BIT - 1)).astype(np.int64)
        yield ids, np.cumsum(size[ids]), np.concatenate([[0], np.cumsum(there)[ends - 1]])


def aligned(pair: TokenPair, encoded: list[bytes], digits) -> list[np.ndarray | list[str]]:
    """n_a, n_b, n_groups, n_links and groups_sha256 of each document; all distinct pairs, their times, and where each document's begin."""
    (a_ids, a_ends, a_at), (b_ids, b_ends, b_at) = _sides(encoded, [pair.a_sizes, pair.b_sizes])
    link_a, link_b, cuts_a, cuts_b = lockstep(a_ends, b_ends, *lanes(a_ends, b_ends, a_at[:-1], b_at[:-1], pair.a_spaced[a_ids]))
    n, of_a, wide_b = len(encoded), np.repeat(np.arange(len(encoded)), np.diff(a_at)), len(pair.b_bytes)
    doc, codes = of_a[link_a], a_ids[link_a] * wide_b + b_ids[link_b]
    most = len(pair.a_bytes) * wide_b
    keys = np.sort(doc * most + codes)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times, keys = np.diff(np.append(first, len(keys))), keys[first]
    at = np.searchsorted(keys, np.arange(n + 1) * most)
    codes = keys % most
    n_links, n_groups = np.bincount(doc, minlength=n), np.bincount(of_a[cuts_a], minlength=n)
    flat, text_at = group_texts(a_ids, b_ids, cuts_a, cuts_b, a_at, b_at, digits)
    text = memoryview(flat.tobytes())
    hashes = [hashlib.sha256(text[x : y - 1]).hexdigest() for x, y in zip(text_at.tolist(), text_at[1:].tolist())]
    return [np.diff(a_at), np.diff(b_at), n_groups, n_links, hashes, codes, times, at]


def _align(a: str, b: str):
    """mapInArrow function: rows of (doc_id, text) to LINKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        pair = token_pair(a, b)
        digits = _digits(max(len(pair.a_bytes), len(pair.b_bytes)))
        kind = pa.struct([("pair", pa.int64()), ("times", pa.int32())])
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            done = np.cumsum([len(t) for t in texts]) // BATCH_CHARS
            cuts = [0, *(np.flatnonzero(np.diff(done)) + 1).tolist(), len(texts)]
            for first, last in zip(cuts, cuts[1:]):
                encoded = pair.encode(texts[first:last])
                there = [i for i, e in enumerate(encoded) if e is not None]
                counts, hashes = np.zeros((4, last - first), np.int64), np.full(last - first, "", dtype=object)
                offsets, pairs, times = np.zeros(last - first + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if there:
                    *numbers, found, pairs, times, at = aligned(pair, [encoded[i] for i in there], digits)
                    counts[:, there], hashes[there] = numbers, found
                    size = np.zeros(last - first, np.int64)
                    size[there] = np.diff(at)
                    offsets = np.concatenate([[0], np.cumsum(size)])
                rows = pa.StructArray.from_arrays([pa.array(pairs), pa.array(times.astype(np.int32))], fields=list(kind))
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows)
                columns = [batch.column("doc_id").slice(first, last - first), *(pa.array(c) for c in counts), pa.array(hashes.tolist(), pa.string()), lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return run


def align(docs: DataFrame, a: str, b: str, pair_rows: int = PAIR_ROWS) -> DataFrame:
    """Align both tokenizers' tokens of every whole text of docs (doc_id, text).

    a: a byte-level vocabulary (tokenizers), which gets a space and the text; b: a sentencepiece model, which adds that space itself.
    Returns doc_id, n_a, n_b, n_groups (byte ranges between places where both end a token), n_links (pairs of tokens
    whose bytes overlap), n_best (links whose pair of ids is the one, or one of those, that its A id is linked by in most documents),
    count_sum (over links, the documents that hold their pair linked) and groups_sha256 (of `a1,a2|b1;a3|b2,b3`).

    Pairs are counted by documents over the whole corpus: each document gives its distinct pairs once, which Spark combines on the map
    side. The counts go back to the documents by a join, broadcast up to `pair_rows` pairs (their number is counted first) and
    sort-merge beyond.

    Texts that are null or empty, or whose tokens' bytes differ from a space and the text, have zeros and an empty string; such a
    document counts nowhere. Very long texts are merged whole, in several lanes; repeated rows count each; null doc_ids are kept; an empty
    table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_align(a, b), LINKS)
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "alignments")
    from sentencepiece import SentencePieceProcessor

    wide_b = SentencePieceProcessor(model_file=b).get_piece_size()
    pairs = stored(rows.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    pairs = pairs.withColumn("a", F.expr(f"pair div {wide_b}"))
    best = pairs.groupBy("a").agg(F.max("n").alias("most"))
    known = stored(pairs.join(best.hint("merge"), "a").select(F.col("pair").alias("known"), "n", (F.col("n") == F.col("most")).alias("best")), "known-pairs")
    each = lookup_join(rows.select("row", F.inline("pairs")), known, F.col("pair") == F.col("known"), rows=pair_rows)
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs").join(sums.hint("merge"), "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), a, b)
