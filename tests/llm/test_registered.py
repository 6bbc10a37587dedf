"""The registered queries themselves, over whole small tables, held against plain Python; odd tables for the operators behind them."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import fingerprint, html, language_model, lines, mixing, packing, sharding, simhash, toxicity
from attesta.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def run(spark, name):
    return QUERIES[name](spark, SMALL).collect()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


def size_of(text):
    return len((text or "").encode().split())


def test_op1_takes_near_the_targets(spark, documents):
    rows = run(spark, "op1_cube_mixing")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in rows:
        assert r.size == size_of(documents[r.doc_id].text) and 0 <= r.taken <= 3 * r.size
        source = documents[r.doc_id].source
        sizes[source] += r.size
        taken[source] += r.taken
        targets[source] = r.target
    assert all(r.source_size == sizes[documents[r.doc_id].source] for r in rows)
    assert all(abs(taken[s] - targets[s]) <= 0.1 * targets[s] + 2000 for s in targets)


def test_op2_scores_held_out_documents_by_what_others_teach(spark):
    larger = "/root/testdata/sf0.01"  # the smallest table holds too few toxic documents to learn from
    rows = QUERIES["op2_weak_supervision"](spark, larger).collect()
    ids = [r.doc_id for r in spark.read.parquet(f"{larger}/documents.parquet").select("doc_id").collect()]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(ids)
    assert all(r.held_out == (crc(r.doc_id) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    assert sum(p == y for p, y in judged) >= 0.95 * len(judged)


def test_op3_edits_and_fingerprints(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op3_weighted_sampling")}
    ids = sorted(documents, reverse=True)
    assert sorted(rows) == sorted(documents)
    prints = defaultdict(set)
    for i, k in enumerate(ids):
        text, after = documents[k].text or "", documents[ids[(i + 1) % len(ids)]].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[k]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[text].add(r.fingerprint)
        prints[edited].add(r.edited_fingerprint)
    assert all(len(p) == 1 for p in prints.values())


def test_op4_packs_every_id(spark, documents):
    bpe, rows = Tokenizer.from_file(BPE), run(spark, "op4_best_fit_packing")
    by_doc, loads, places = defaultdict(dict), Counter(), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id][r.piece] = r
        loads[r.sequence_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert max(loads.values()) <= 4096 and len(loads) <= sum(loads.values()) / 4096 + 2
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
    for k, d in documents.items():
        ids = [*bpe.encode(d.text or "", add_special_tokens=False).ids, 1]
        parts = [ids[i : i + 4096] for i in range(0, len(ids), 4096)]
        assert len(by_doc[k]) == len(parts)
        for i, part in enumerate(parts):
            r = by_doc[k][i]
            assert (r.start, r.length, r.ids_crc32) == (4096 * i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))


def test_op5_slots_and_growth(spark, documents):
    rows, slots = run(spark, "op5_hash_tree_sharding"), defaultdict(list)
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    for r in rows:
        data = (documents[r.doc_id].text or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data) and r.law == "key"
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op6_gives_every_page(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = run(spark, "op6_html_blocks")
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text) and "<p" not in r.text
        assert all(line == " ".join(line.split()) and line for line in r.text.split("\n") if r.text)


def test_op7_counts_and_folds(spark, documents):
    rows = run(spark, "op7_recurrent_lm")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    words = {k: (d.text or "").encode().lower().split() for k, d in documents.items()}
    total = sum(len(w) + 1 for k, w in words.items() if crc(k) % 7 != 2)
    assert all(r.held_out == (crc(r.doc_id) % 7 == 2) and r.train_tokens == total and r.n_tokens == len(words[r.doc_id]) + 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op9_keeps_the_first_of_equal_lines(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op9_fuzzy_lines")}
    assert sorted(rows) == sorted(documents)
    seen = Counter()
    for k, r in rows.items():
        text = documents[k].text
        found = (text or "").split("\n") if text is not None else []
        assert r.n_lines == len(found) and r.n_removed == len(r.removed)
        kept = [x for i, x in enumerate(found) if i not in set(r.removed)]
        assert (r.text or "") == "\n".join(kept)
        seen.update({x.lower().strip() for x in kept if x.strip()})
    assert max(seen.values()) == 1


def test_op10_links_by_brute_force(spark, documents):
    rows = {r.doc_id: r for r in run(spark, "op10_simhash")}
    assert sorted(rows) == sorted(documents)
    ids = sorted(documents)
    bits = np.array([int(rows[k].fingerprint, 16) for k in ids], dtype=np.uint64)
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2)):
        a, b = sorted((root(i), root(j)))
        parent[b] = a
    assert all(rows[k].component_id == ids[root(i)] for i, k in enumerate(ids))


def test_ids_of_words_are_the_tokenizers():
    """Letters that normalisation turns into more than letters, marks, digits, combining marks and emoji, in any order."""
    bpe, words, draw = Tokenizer.from_file(BPE), packing.WordIds(BPE), random.Random(5)
    letters = "abcXYZéÉİıßΣσ中文한글कक़क़́̇.,;:!?'\"-_ \n\t0129😀ﬁǅ" + packing._TURNED[:20]
    for _ in range(4000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(1, 40)))
        found = words.split(text)
        words.learn(set(found))
        got = np.frombuffer(b"".join(words.words[w] for w in found), "<u4").tolist()
        assert got == bpe.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("bounds", [(2100, 4000), (500, 1500), (1, 600)])
def test_only_few_sequences_of_a_block_are_sent_on(spark, monkeypatch, bounds):
    """Whatever the lengths, later rounds hold a bounded number of sequences of each block, and little room is lost."""
    monkeypatch.setattr(packing, "SENT_ON", 4)
    sizes, kept = {}, packing.stored

    def counted(df, name):
        sizes[name] = df = kept(df, name)
        return df

    monkeypatch.setattr(packing, "stored", counted)
    draw = random.Random(1)
    rows = [(i, 0, draw.randrange(*bounds), i) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, ids_crc32 long")
    out = packing.pack(pieces, 4096, fan=4, block_tokens=400_000).collect()
    loads = Counter()
    for r in out:
        loads[r.sequence_id] += r.length
    alone = len(packing.best_fit(sorted((r[2] for r in rows), reverse=True), 4096)[2])
    blocks = sum(r[2] for r in rows) / 400_000 + 1
    assert len(out) == 3000 and max(loads.values()) <= 4096 and len(loads) <= 1.03 * alone + blocks
    for name, df in sizes.items():
        if name != "packed0":
            most = df.groupBy("block").agg(F.countDistinct("sequence_id").alias("n")).agg(F.max("n")).first()[0]
            assert most <= 4 * 4


GOOD = "<h1>Title of it</h1>" + "<p>The cat is on the mat and the dog is in the house with all of the people that are from the town, as it has been for years.</p>" * 4


@pytest.mark.parametrize("name", ["has-sidebar", "content with-sidebar", "post-with-comments", "notice-of-award", "ad-free", "page social"])
def test_a_name_alone_condemns_no_article(name):
    assert html.main_text(f"<body><div class='{name}'>{GOOD}</div></body>") == html.main_text(f"<body><div>{GOOD}</div></body>") != ""
    aside = "<div class=sidebar><p>All of the other news that you have not read is to be had here, for the asking.</p></div>"
    assert "other news" not in html.main_text(f"<body><div class='{name}'>{GOOD}{aside}</div></body>")


def test_pages_in_forms_and_other_scripts():
    assert "The cat" in html.main_text(f"<body><form action=x>{GOOD}</form></body>")
    text = "这是一个关于城市发展的故事。我们在那里住了很多年，并且看到了许多变化。" * 4
    assert text in html.main_text(f"<body><div class=menu>首页 新闻</div><div><p>{text}</p><p>{text}</p></div></body>")
    assert html.main_text(f"<body>{GOOD}<div class=comments>{GOOD}{GOOD}</div></body>").count("Title") == 1


def test_broken_tags_take_linear_time_and_no_text():
    assert html.main_text(f"<p data-x=it's>{GOOD}</p>").startswith("Title")
    assert "a < b" in html.main_text(f"{GOOD}<p>It is so that a < b for all of the numbers that are in the list of them, as has been said before.</p>")
    for part in ('<a "b', '<a x="b', "<title>", "<div>", "<", "<!--", "</p>"):
        html.main_text(part * 50_000)


ODD_ROWS = [(1, "same text\nof two lines"), (1, "same text\nof two lines"), (2, None), (2, ""), (None, "no id"), (None, None), (3, "wörd " * 30_000), (4, "x" * 200_000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "c") for r in ODD_ROWS], "doc_id long, text string, size string").repartition(3)


def test_odd_tables(spark, odd):
    """Repeated rows, nulls, empty and very long texts, and a column of a clashing name: a row each, equal rows alike."""
    model = toxicity.fit(odd, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    for out in (toxicity.score(odd, model), simhash.near_duplicates(odd), language_model.score_documents(odd, odd), lines.dedup_lines(odd), fingerprint.fingerprint_with_edits(odd)):
        assert out.count() == len(ODD_ROWS)
    packed = packing.pack_documents(odd, BPE).collect()
    assert sum(r.piece == 0 for r in packed) == len(ODD_ROWS)
    mixed = mixing.mix(odd.withColumn("source", F.lit("s")))
    assert mixed.count() == len(ODD_ROWS)
    sharded = sharding.shard_documents(odd, sharding.balanced_tree(4))
    assert sharded.count() == len(ODD_ROWS)


def test_empty_tables(spark, odd):
    none, pages = odd.limit(0), spark.createDataFrame([], "page_id long, url string, html string")
    assert packing.pack_documents(none, BPE).count() == 0 and html.extract_pages(pages).count() == 0
    model = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model.terms == [] and toxicity.score(none, model).count() == 0


def test_op5_walks_the_tree_by_hand(spark, documents):
    """The tree recomputed: at each level the node with the least weighted draw from a hash of (doc_id, node)."""
    import math
    import struct

    from xxhash import xxh64_intdigest

    def draw(doc_id, node, weight):
        seed = 42 if doc_id is None else xxh64_intdigest(struct.pack("<q", doc_id), 42)
        return -math.log(((xxh64_intdigest(str(node).encode(), seed) >> 11) + 0.5) / (1 << 53)) / weight

    def walk(doc_id, tree):
        levels = [lambda leaf: leaf.region, lambda leaf: leaf.rack, lambda leaf: leaf.shard]
        for of in levels:
            weights = Counter()
            for leaf in tree:
                weights[of(leaf)] += leaf.weight
            best = min(weights, key=lambda n: (draw(doc_id, n, weights[n]), n))
            tree = [leaf for leaf in tree if of(leaf) == best]
        return tree[0].shard

    tree = sharding.balanced_tree(16)
    for r in run(spark, "op5_hash_tree_sharding"):
        assert (r.shard, r.grown_shard) == (walk(r.doc_id, tree), walk(r.doc_id, sharding.grown_tree(tree)))
    weighted = [sharding.Leaf("a", "a/0", 0, 3.0), sharding.Leaf("a", "a/1", 1, 0.5), sharding.Leaf("b", "b/0", 2, 1.5), sharding.Leaf("b", "b/0", 3, 2.0)]
    some = spark.createDataFrame([(i, "") for i in [None, -5, *range(300)]], "doc_id long, text string")
    assert all(r.shard == walk(r.doc_id, weighted) for r in sharding.shard_documents(some, weighted).collect())


def test_op7_scores_by_a_plain_forward_pass():
    """A document's score by loops over its words, in doubles, against the batched one in float32."""
    from attesta.llm import gru

    random_ = np.random.default_rng(4)
    m = gru.Gru.start(random_.integers(1, 100, gru.INPUTS).astype(float))
    m = m.with_flat(m.flat() + random_.normal(0, 0.3, m.flat().size).astype(np.float32))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    size, classes = gru.HIDDEN, gru.WORDS // gru.CLASS_WORDS

    def by_hand(ids):
        h, last, total = np.zeros(size), 0, 0.0
        x, u, c, w = (v.astype(float) for v in (m.x, m.u, m.c, m.w))
        for word in ids:
            gx, a = x[last], h @ u
            z, r = sigmoid(gx[:size] + a[:size]), sigmoid(gx[size : 2 * size] + a[size : 2 * size])
            n = np.tanh(gx[2 * size :] + r * a[2 * size :])
            h = (1 - z) * n + z * h
            p = np.exp(h @ c + m.cb)
            own = word // gru.CLASS_WORDS if word < gru.WORDS else classes + word - gru.WORDS
            total += np.log(p[own] / p.sum())
            if word < gru.WORDS:
                q = np.exp(w[own] @ h + m.wb[own])
                total += np.log(q[word % gru.CLASS_WORDS] / q.sum())
            last = word
        return total

    texts = [random_.integers(0, gru.INPUTS, n).astype(np.int32) for n in (1, 2, 63, 64, 65, 300)]
    assert np.allclose(gru.score_sequences(m, texts), [by_hand(t) for t in texts], rtol=1e-4)


def test_op11_whitens_every_vector(spark):
    rows = run(spark, "op11_embedding_whitening")
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    x = np.array([[np.floor(64 * float(c)) + 1_000_000 for c in v.embedding] for v in vectors])
    n, away = len(x), x - x.mean(axis=0)
    e, q = np.linalg.eigh(away.T @ away / n)
    e, q = e[::-1][:32], q[:, ::-1][:, :32]
    want = {(v.vec_id, c + 1): abs(w) for v, row in zip(vectors, away @ q / np.sqrt(e)) for c, w in enumerate(row)}
    sums = [int(s) for s in x.sum(axis=0)]
    exact = {v.vec_id: sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for v, row in zip(vectors, x)}
    assert len(rows) == 32 * n and {r.n for r in rows} == {n}
    assert all(r.deviation == exact[r.vec_id] and abs(abs(r.whitened) - want[r.vec_id, r.component]) < 1e-6 and r.identity_error < 1e-4 for r in rows)
    assert all(abs(r.explained - e[r.component - 1] / (away * away).sum() * n) < 1e-6 for r in rows)


def test_op12_has_a_row_for_each_document(spark, documents):
    from sentencepiece import SentencePieceProcessor

    a, b = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    rows = {r.doc_id: r for r in run(spark, "op12_token_alignment")}
    assert rows.keys() == documents.keys()
    for i, d in documents.items():
        ids = [b.id_to_piece(x) for x in b.encode(d.text or "")]
        r = rows[i]
        if d.text and "".join(p for p in ids).replace("▁", " ") == " " + d.text:  # no byte pieces: bytes agree
            assert (r.n_a, r.n_b) == (len(a.encode(" " + d.text, add_special_tokens=False).ids), len(ids))
        assert r.n_groups <= min(r.n_a, r.n_b) and max(r.n_a, r.n_b) <= r.n_links <= r.n_a + r.n_b and r.n_best <= r.n_links <= max(r.count_sum, r.n_links)


def test_op13_reads_back_what_the_tokenizer_gives(spark, documents):
    bpe, start = Tokenizer.from_file(BPE), 0
    rows = {r.doc_id: r for r in run(spark, "op13_token_files")}
    for i in sorted(documents):
        ids = np.array([*bpe.encode(documents[i].text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i].start, rows[i].n_tokens, rows[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
