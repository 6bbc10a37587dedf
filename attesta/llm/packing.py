"""Best-fit packing of token sequences with a segment tree over remaining capacities."""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import stored

#: Tokens of a sequence; id after each document; tokens that one task packs at once; blocks that meet in the next round, and
#: sequences that each of them sends there.
SEQUENCE, END_ID, BLOCK_TOKENS, FAN, SENT_ON = 4096, 1, 8_000_000, 32, 64
#: Pieces that one task packs at once, however short they are.
BLOCK_PIECES = 500_000
#: Words whose ids a Python worker keeps at most; words and texts of one call.
MEMO_WORDS, CALL_WORDS, CALL_TEXTS = 400_000, 2_000, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: ASCII marks after a word that are no apostrophe: a run of them is a token run of its own.
_MARKS = ".,;:!?%$&*#|()[]{}<>=+-_/\\\"@^~`"


def _stays_letters(run: str) -> bool:
    """Letters that are letters alone once the tokenizer has normalised them. A capital I with a dot, for one, is then an i and a
    combining dot, which is no letter and goes with the marks after it."""
    return run.isalpha() and (run.isascii() or unicodedata.normalize("NFC", run).lower().isalpha())


_TURNED = "".join(c for c in map(chr, range(0x80, 0x20000)) if c.isalpha() and not _stays_letters(c))
#: A single mark between a letter and white space or the end: it is a token run of its own.
_MARK_APART = re.compile(rf"([.,;:!?])(?<=[^\W\d_].)(?<![{_TURNED}].)(?=[ \n]|\Z)")


class WordIds:
    """Ids of white-space-free words, as little-endian bytes, exactly as the tokenizer gives them in a text.

    No token crosses ASCII white space, so that ids are kept by word. For the tokenizer, letters and the marks after them are
    runs of their own, so they are learnt apart. Runs of letters are encoded many at once and told apart by their last
    tokens, which end a word in the vocabulary; all else goes through the tokenizer word by word.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.bpe = Tokenizer.from_file(tokenizer)
        vocabulary = self.bpe.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.words: dict[bytes, bytes] = {}

    @staticmethod
    def split(text: str) -> list[bytes]:
        """Words, whose ids in order are the text's."""
        return _MARK_APART.sub(r" \1", text).encode("utf-8", "replace").split()

    def _encode(self, words: list[str]) -> None:
        for i in range(0, len(words), CALL_WORDS):
            part = words[i : i + CALL_WORDS]
            for w, e in zip(part, self.bpe.encode_batch(part, add_special_tokens=False)):
                self.words[w.encode("utf-8", "replace")] = np.array(e.ids, "<u4").tobytes()

    def _encode_letters(self, runs: list[str]) -> None:
        for i in range(0, len(runs), CALL_WORDS):
            part = runs[i : i + CALL_WORDS]
            joined = " ".join(part)
            ids = np.array(self.bpe.encode(joined, add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(ids):
                data, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                self.words.update(zip(joined.encode().split(b" "), (data[x:y] for x, y in zip(at, at[1:]))))
            else:
                self._encode(part)

    def learn(self, words: set[bytes]) -> None:
        """Make the ids of words known."""
        known = self.words
        new = [w for w in words if w not in known]
        if len(known) + len(new) > MEMO_WORDS:
            known.clear()
            new = list(words)  # all words of these texts must be there
        letters: set[str] = set()
        others: set[str] = set()
        parts = []
        for word in new:
            w = word.decode("utf-8", "replace")
            if _stays_letters(w):
                letters.add(w)
                continue
            run = w.rstrip(_MARKS)
            if run != w and _stays_letters(run):
                marks = w[len(run) :]
                parts.append((word, run.encode(), marks.encode()))
                letters.add(run)
                others.add(marks)
            else:
                others.add(w)
        self._encode_letters([w for w in letters if w.encode() not in known])
        self._encode([w for w in others if w.encode("utf-8", "replace") not in known])
        for word, run, marks in parts:
            known[word] = known[run] + known[marks]


@lru_cache(maxsize=1)
def word_ids(tokenizer: str) -> WordIds:
    """Kept by a worker for its next tasks, with the words that it knows."""
    return WordIds(tokenizer)


def _pieces(tokenizer: str, sequence: int, end_id: int):
    """mapInArrow function: rows of (doc_id, text) to their pieces."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = word_ids(tokenizer)
        for batch in batches:
            texts, rows = batch.column("text"), []
            for first in range(0, len(texts), CALL_TEXTS):
                found = [ids.split(t.as_py() or "") for t in texts[first : first + CALL_TEXTS]]
                ids.learn(set().union(*found))
                for i, words in enumerate(found, first):
                    data = b"".join(map(ids.words.__getitem__, words)) + end
                    for k, at in enumerate(range(0, len(data), 4 * sequence)):
                        part = data[at : at + 4 * sequence]
                        rows.append((i, k, at // 4, len(part) // 4, zlib.crc32(part)))
            i, k, start, length, crc = (np.array(rows, dtype=np.int64).reshape(-1, 5)).T
            columns = [batch.column("doc_id").take(pa.array(i)), pa.array(k, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most `sequence` tokens of every whole text, its end id included."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, sequence, end_id), PIECES)


class OpenBins:
    """Open bins by remaining capacity: a segment tree over capacities 0 to `capacity` finds the least one that
    has a bin and is at least a given length, in logarithmic time."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.base)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        i = self.base + room
        while i and not self.any[i]:
            self.any[i] = 1
            i >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest open bin that holds `length`, removed: (its room, its id)."""
        i = self.base + length
        if not self.any[i]:
            while i > 1 and (i & 1 or not self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.base
        bin_id = self.bins[room].pop()
        if not self.bins[room]:
            self.any[i] = 0
            while i > 1 and not self.any[i ^ 1]:
                i >>= 1
                self.any[i] = 0
        return room, bin_id


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit of lengths in the given (decreasing) order: bin and offset of each, and the bins' loads."""
    open_bins, loads, bins, offsets = OpenBins(capacity), [], [], []
    for n in lengths:
        found = open_bins.take(n)
        if found is None:
            room, b = capacity, len(loads)
            loads.append(0)
        else:
            room, b = found
        bins.append(b)
        offsets.append(loads[b])
        loads[b] += n
        if room > n:
            open_bins.put(room - n, b)
    return bins, offsets, loads


def _pack(capacity: int, level: int, most_sent: int):
    def run(group: pa.Table) -> pa.Table:
        length = group.column("length").to_numpy()
        order = np.lexsort((group.column("key").to_numpy(), -length))
        group, block = group.take(pa.array(order)), group.column("block")[0].as_py()
        bins, offsets, loads = best_fit(length[order].tolist(), capacity)
        bins = np.array(bins, dtype=np.int64)
        group = group.append_column("sequence_id", pa.array((level << 58) + (block << 24) + bins))
        group = group.append_column("offset", pa.array(np.array(offsets, dtype=np.int64)))
        loads = np.array(loads, dtype=np.int64)
        emptiest = np.argsort(loads, kind="stable")[:SENT_ON]
        sent = np.zeros(len(loads), dtype=bool)
        few = np.cumsum(np.bincount(bins, minlength=len(loads))[emptiest]) <= most_sent
        sent[emptiest] = few & (loads[emptiest] < capacity)
        return group.append_column("sent_on", pa.array(sent[bins]))

    return run


def pack(pieces: DataFrame, capacity: int = SEQUENCE, fan: int = FAN, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Best-fit-decreasing packing of pieces (doc_id, piece, length, and ids_crc32, stored) into sequences.

    Adds sequence_id and offset. Blocks of about block_tokens tokens, or BLOCK_PIECES pieces, dealt by a hash that repeated rows don't
    share, are packed at once, each best fit
    decreasing: what is left open in a block is what no piece of it fits into. The pieces of each block's SENT_ON
    emptiest open sequences (of as many as hold BLOCK_PIECES / fan pieces) meet those of `fan` other blocks in the next round, until one
    block is left; all other sequences are settled. So no task holds more than a block, or fan * SENT_ON sequences, whatever the lengths.
    Nulls but in length are kept; repeated rows are packed each for itself; no pieces give no rows.
    """
    total, rows = pieces.agg(F.sum("length"), F.count("*")).first()
    blocks, level, decided, columns = max(1, math.ceil((total or 0) / block_tokens), math.ceil(rows / BLOCK_PIECES)), 0, None, pieces.columns
    todo = pieces.withColumn("key", F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()))
    todo = todo.withColumn("block", F.pmod("key", F.lit(blocks)).cast("long"))
    while True:
        schema = todo.select("*", *(F.lit(0).cast("long").alias(c) for c in ("sequence_id", "offset")), F.lit(False).alias("sent_on")).schema
        packed = stored(todo.groupBy("block").applyInArrow(_pack(capacity, level, BLOCK_PIECES // fan), schema), f"packed{level}")
        done = packed if blocks == 1 else packed.where("not sent_on")
        done = done.select(*columns, "sequence_id", "offset")
        decided = done if decided is None else decided.unionByName(done)
        if blocks == 1:
            return decided
        todo = packed.where("sent_on").select(*columns, "key", F.floor(F.col("block") / fan).cast("long").alias("block"))
        blocks, level = math.ceil(blocks / fan), level + 1


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Tokenize documents (doc_id, text) and pack them: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Each document is its ids and end_id; longer ones than `sequence` are cut into pieces of that many ids.
    A null or empty text is its end_id alone; equal rows are packed each for itself; null doc_ids are allowed;
    an empty table gives no rows; other columns of docs are not read. Every token is in one sequence.
    """
    return pack(stored(token_pieces(docs, tokenizer, sequence, end_id), "pieces"), sequence)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
