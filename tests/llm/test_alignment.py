import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from attesta.llm import alignment

A, B = path("byte_bpe_50k.json"), path("piece_bpe_32k.model")
STRANGE = [
    "two  spaces and   three", " leads", "trails ", "line\nbreak \n and\ttab\r\n", "<|endoftext|> in <s> text </s><unk>", "▁ own mark", "naïve café ßüñ",
    "a b   c　d", "你好 \U0001f600\U0001f468‍\U0001f469‍\U0001f467", "aaaaaaaaaaaaa ======== -------- ........ 1111111111 hahahahaha", "don't we'll I'VE it's 3.5%", "\x00\x01 zero", "é combining",
    "x" * 5000, "ẞﬁ ligature …", "word next \x85 z\x1c y", "  ", "\n", "0 00 000 0000", "᠎ mark ᠎",
]


@pytest.fixture(scope="module")
def sides():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_alphabet()
    return a, b, letters


def tokens(text, sides):
    """Ids and bytes of both sides, straight from the libraries."""
    a, b, letters = sides
    e = a.encode(" " + text, add_special_tokens=False)
    ids = b.encode(text)
    pieces = [b.id_to_piece(i) for i in ids]
    return e.ids, [bytes(letters[c] for c in t) for t in e.tokens], ids, [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids, pieces)]


def by_hand(texts, sides):
    """Brute force: all pairs of overlapping ranges, groups from common ends, counts of documents."""
    rows, held = [], defaultdict(int)
    for text in texts:
        a, a_bytes, b, b_bytes = tokens(text, sides) if text else ([], [], [], [])
        if not text or b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        links, j = [], 0
        for i, end in enumerate(ends[0]):
            start = ends[0][i - 1] if i else 0
            j = next(k for k in range(j, len(b)) if ends[1][k] > start)
            k = j
            while k < len(b) and (ends[1][k - 1] if k else 0) < end:
                links.append((a[i], b[k]))
                k += 1
        common, groups, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for end in common:
            stop = [s.index(end) + 1 for s in ends]
            groups.append(",".join(map(str, a[at[0] : stop[0]])) + "|" + ",".join(map(str, b[at[1] : stop[1]])))
            at = stop
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        for pair in set(links):
            held[pair] += 1
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(held[p] == best[p[0]] for p in r[3]), sum(held[p] for p in r[3]), r[4]) for r in rows]


@pytest.mark.parametrize("pair_rows", [alignment.PAIR_ROWS, 0])
def test_equals_brute_force(spark, docs, sides, pair_rows):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(STRANGE)] + [(1001, STRANGE[0])]
    wide = spark.createDataFrame([(i, t, "clash", 1, "clash") for i, t in rows], "doc_id long, text string, pairs string, row int, n string").repartition(4)
    want = by_hand([t for _, t in rows], sides)
    got = alignment.align(wide, A, B, pair_rows)
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()) == Counter((i, *w) for (i, _), w in zip(rows, want))
    assert any(w[0] == 0 and t for w, (_, t) in zip(want, rows)) and dict(got.dtypes)["n_best"] == "bigint"


def test_words_are_encoded_as_in_whole_texts(sides):
    """Random words of several alphabets, and words with parts three times over: ids by word equal those of whole texts."""
    draw, pair = random.Random(3), alignment.TokenPair(A, B)
    assert pair.by_word and pair.ranked is not None
    letters = ["abcdefghijklmnopqrstuvwxyz", "etaoinshrdlu'.,;-", "ABCxyz0123456789", "äöüßéèñçabc", "ab", "=-_*#.", "абвг你好\U0001f600z"]
    texts = []
    for _ in range(600):
        words = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 14))) for alphabet in draw.choices(letters, k=40)]
        texts.append(" ".join(words))
    for text, ids in zip(texts, pair.encode(texts)):
        a, _, b, _ = tokens(text, sides)
        flat = np.frombuffer(ids, "<u4")
        assert flat[flat < alignment.B_BIT].tolist() == a and (flat[flat >= alignment.B_BIT] - alignment.B_BIT).tolist() == b


def test_generations_of_words(sides, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_WORDS", 40)
    pair = alignment.TokenPair(A, B)
    for k in range(30):
        text = "the same words again " + " ".join(f"w{k}x{i}" for i in range(12)) + (" ▁x" if k % 3 else "")
        ids = pair.encode([text])[0]
        if k % 3:
            assert ids is None
        else:
            flat = np.frombuffer(ids, "<u4")
            assert flat[flat < alignment.B_BIT].tolist() == tokens(text, sides)[0]
    assert len(pair.young) + len(pair.old) < 80


def test_lanes_change_nothing():
    draw = np.random.default_rng(0)
    ends = np.cumsum(draw.integers(1, 6, 4000))
    a = np.unique(np.append(draw.choice(ends, 2500), ends[-1]))
    b = np.unique(np.append(draw.choice(ends, 2500), ends[-1]))
    both, none = np.intersect1d(a, b), np.zeros(1, np.int64)
    spaced = np.zeros(len(a), bool)
    spaced[draw.choice(len(a), 800)] = True
    one = alignment.lockstep(a, b, none, none, np.array([len(a)]))
    many = alignment.lanes(a, b, none, none, spaced, 16)
    assert len(many[0]) > 20
    for x, y in zip(one, alignment.lockstep(a, b, *many)):
        assert np.array_equal(np.sort(x), np.sort(y))
    assert np.array_equal(a[one[2]], both) and len(one[0]) == len(a) + len(b) - len(both)


def test_empty_table_and_texts_without_tokens(spark, empty):
    assert alignment.align(empty, A, B).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None), (2, ""), (None, "▁")], "doc_id long, text string"), A, B).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "")} and len(got) == 3
