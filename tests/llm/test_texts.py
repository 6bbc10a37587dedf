import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from attesta.llm import fingerprint, gru, html, language_model, packing, toxicity

BPE = public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, texts):
    bpe = Tokenizer.from_file(BPE)
    rows = packing.pack_documents(docs, BPE, sequence=256).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc) == docs.count()
    for doc_id, pieces in by_doc.items():
        text = "no id" if doc_id is None else texts[doc_id // 3]
        ids = bpe.encode(text or "", add_special_tokens=False).ids + [1]
        pieces.sort(key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), 256))
        for r in pieces:
            part = np.array(ids[r.start : r.start + 256], "<u4").tobytes()
            assert r.length == len(part) // 4 and r.ids_crc32 == zlib.crc32(part)
    loads = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == loads.get(r.sequence_id, 0)
        loads[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in rows)
    assert max(loads.values()) <= 256 and len(loads) <= math.ceil(total / 256) + 1


def test_packing_over_blocks(docs):
    pieces = packing.stored(packing.token_pieces(docs, BPE, 256), "pieces")
    rows = packing.pack(pieces, 256, fan=2, block_tokens=2000).collect()
    loads = Counter()
    for r in rows:
        loads[r.sequence_id] += r.length
    assert len(rows) == pieces.count() and len(loads) <= math.ceil(sum(loads.values()) / 256) + 1


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, loads = packing.best_fit([6, 5, 4, 3, 2], 10)
    assert (bins, offsets, loads) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 8], [10, 10])
    draw = np.random.default_rng(0)
    lengths = sorted(draw.integers(1, 100, 500).tolist(), reverse=True)
    rooms, want = [], []
    for n in lengths:
        fits = [(room, i) for i, room in enumerate(rooms) if room >= n]
        i = min(fits)[1] if fits else len(rooms)
        rooms[i:] = rooms[i:] or [100]
        rooms[i] -= n
        want.append(n)
    assert len(packing.best_fit(lengths, 100)[2]) == len(rooms)


def test_words_are_encoded_as_the_tokenizer_does(texts):
    odd = ["a. b, c! d!! e., f.g h.\nx. 3. é. .", "don't IT'S x<|endoftext|>y İstanbul ΣΑΣ ﬁ ½ 3.5% é 日本語, _f_ --- a'", "ẞ Ǆ \U0001f600!! a\x1cb"]
    bpe, words = Tokenizer.from_file(BPE), packing.WordIds(BPE)
    for t in [t for t in texts if t] + odd:
        parts = words.split(t)
        words.learn(set(parts))
        assert b"".join(words.words[w] for w in parts) == np.array(bpe.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_fingerprints(docs, texts):
    rows = {(r.doc_id, r.n_chars): r for r in fingerprint.fingerprint_with_edits(docs.where("doc_id is not null"), samples=64).collect()}
    ids = [i * 3 for i in range(len(texts))][::-1]
    words = lambda t: Counter(w for w in re.split("[ \t-\r]+", t.lower()) if w) or Counter([""])
    errors = []
    for k, i in enumerate(ids):
        text, after = texts[i // 3] or "", texts[ids[(k + 1) % len(ids)] // 3] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[(i, len(text))]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = words(text), words(other)
            want = sum((a & b).values()) / sum((a | b).values())
            errors.append(got - want)
            assert abs(got - want) < 0.3
    assert len(rows) == len(texts) and abs(np.mean(errors)) < 0.02
    same = [r.fingerprint for r in rows.values() if texts[r.doc_id // 3] == "same text here"]
    assert len(set(same)) == 1 and len(same) == 2


def test_fingerprints_of_nothing(empty):
    assert fingerprint.fingerprint_with_edits(empty).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a></header><nav><ul><li><a href="/a">a</a></li></ul></nav>
<div class="cookie-notice">We use cookies and the like on this site.</div><article><h1>Head &amp; line</h1><p>The first of the paragraphs is about the state of things in the world, and it is long enough.
<br>Next   line.<p>Short.</p><script>var x = "<p>no</p>";</script><form><input><p>Search the site</p></form></article>
<aside>Related: the other things</aside><div id="comments"><p>I think that the article is wrong and you are all fools, said the reader.</p></div><footer>&copy; x</footer></body>"""


def test_html_keeps_the_article():
    assert html.main_text(PAGE) == "Head & line\nThe first of the paragraphs is about the state of things in the world, and it is long enough. Next line.\nShort."
    assert [html.main_text(t) for t in (None, "", "<p></p>", "<")] == ["", "", "", ""] or html.main_text("<") in ("", "<")


def test_html_without_article_goes_by_densities():
    body = "<p>The cat is on the mat and the dog is in the house with all of the people that are from the town, as it has been for years.</p>" * 2
    page = f"<body><div><a href=1>One</a> <a href=2>Two</a></div><h2>About</h2>{body}<p>Yes.</p>{body}<ul><li><a href=3>More</a></li></ul></body>"
    kept = html.main_text(page).split("\n")
    assert kept[0] == "About" and "Yes." in kept and not any(x.startswith(("One", "More")) for x in kept) and len(kept) == 6


def test_html_rows(spark):
    rows = [(1, "u", PAGE, "clash"), (None, None, None, "x"), (1, "u", PAGE, "clash")]
    out = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 3 and all(r.n_chars == len(r.text) for r in out)


def test_label_model_finds_good_voters():
    draw = np.random.default_rng(0)
    y = draw.random(4000) < 0.2
    rates = [(0.02, 0.8), (0.02, 0.8), (0.3, 0.3), (0.1, 0.6)]
    fired = np.stack([np.where(y, draw.random(4000) < t, draw.random(4000) < c) for c, t in rates], axis=1)
    fired = np.concatenate((fired, fired[:, :1]), axis=1)  # a voter that copies another
    known = np.where(draw.random(4000) < 0.3, y.astype(int), -1)
    model = toxicity.fit_label_model(fired, np.ones(4000), known)
    assert ((model.posterior(fired) > 0.5) == y).mean() > 0.93
    assert model.parents[4] == 0 or model.parents[0] == 4  # the copy depends on its like and adds nothing
    assert model.parents[2] == -1 and 2 not in model.parents
    single = toxicity.fit_label_model(fired[:, :4], np.ones(4000), known)
    assert np.abs(model.posterior(fired) - single.posterior(fired[:, :4])).max() < 0.02
    assert abs(model.rates[2, 0] - model.rates[2, 1]) < 0.1


def test_label_model_is_a_joint_distribution():
    """Its posterior is Bayes' rule over what it says of each label, and it finds correlations that differ by label."""
    draw = np.random.default_rng(4)
    n = 20_000
    y = draw.random(n) < 0.3
    a = draw.random(n) < np.where(y, 0.7, 0.1)
    b = draw.random(n) < np.where(y, np.where(a, 0.5, 0.5), np.where(a, 0.9, 0.05))  # depend on each other in clean rows alone
    c = draw.random(n) < np.where(y, 0.6, 0.2)
    fired = np.stack([a, b, c], axis=1)
    model = toxicity.fit_label_model(fired, np.ones(n), np.where(draw.random(n) < 0.5, y.astype(int), -1))
    assert model.parents[1] == 0 or model.parents[0] == 1
    assert (model.parents >= 0).sum() == 1
    child, parent = (1, 0) if model.parents[1] == 0 else (0, 1)
    for label in (0, 1):
        for vote in (False, True):
            chosen = (y == bool(label)) & (fired[:, parent] == vote)
            assert abs(model.tables[child, label, int(vote)] - fired[chosen, child].mean()) < 0.05
    every = np.array([[k >> v & 1 for v in range(3)] for k in range(8)], dtype=bool)
    joint = np.ones((8, 2))
    for k, row in enumerate(every):
        for label in (0, 1):
            for v in range(3):
                p = model.tables[v, label, int(model.parents[v] >= 0 and row[model.parents[v]])]
                joint[k, label] *= p if row[v] else 1 - p
    assert np.allclose(joint.sum(axis=0), 1)
    odds = joint[:, 1] * model.prior, joint[:, 0] * (1 - model.prior)
    assert np.allclose(model.posterior(every), odds[0] / (odds[0] + odds[1]))
    for k, row in enumerate(every):
        chosen = (fired == row).all(axis=1)
        assert chosen.sum() < 300 or abs(model.posterior(every)[k] - y[chosen].mean()) < 0.06


def test_toxicity(spark):
    draw = np.random.default_rng(1)
    stems = ["blorg", "zanch"]
    rows, labels = [], []
    for i in range(600):
        words = [f"w{draw.integers(0, 200)}x" for _ in range(30)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[draw.integers(0, 30)] = draw.choice(stems) + draw.choice(["a", "e", "o"])
        rows.append((i, " ".join(words), 9.0))
        labels.append((i, int(bad)))
    rows += [(None, "no id", 1.0), (1000, None, 1.0), (1001, "", 1.0), (1002, "", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(4)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    held_out = toxicity.fold_of(F.col("doc_id"), 3) == 1
    model = toxicity.fit(docs.where(~held_out), marks.where(~held_out))
    out = [(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()]
    assert len(out) == len(rows) and all(0 <= s <= 1 for _, s in out)
    for i, s in out:
        if i is not None and i < 600:
            assert (s >= 0.7) == (i % 6 == 0)
        else:
            assert s < 0.5
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs, marks.limit(0)).terms == []


def test_gradients():
    draw = np.random.default_rng(1)
    m = gru.Gru.start(draw.integers(1, 100, gru.INPUTS).astype(float))
    for k in m.NAMES:
        setattr(m, k, getattr(m, k).astype(np.float64))
    ids, targets, h = draw.integers(0, gru.INPUTS, (5, 3)), draw.integers(0, gru.INPUTS, (5, 3)), draw.normal(0, 1, (3, gru.HIDDEN))
    g = gru.gradients(m, h, ids, targets)[0]
    for k in m.NAMES:
        a, at = getattr(m, k), np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        a[at] += 1e-5
        up = gru.gradients(m, h, ids, targets)[2]
        a[at] -= 2e-5
        down = gru.gradients(m, h, ids, targets)[2]
        a[at] += 1e-5
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6


def test_scores_do_not_depend_on_windows():
    draw = np.random.default_rng(2)
    m = gru.Gru.start(draw.integers(1, 100, gru.INPUTS).astype(float))
    seqs = [draw.integers(0, gru.INPUTS, n).astype(np.int32) for n in (1, 7, 200, 64, 65)]
    a, b = gru.score_sequences(m, seqs), gru.score_sequences(m, seqs, cells=10, window=5, most=2)
    assert np.allclose(a, b, rtol=1e-4)
    outputs = np.arange(gru.INPUTS)
    assert abs(np.exp(m.log_probs(np.tile(draw.normal(0, 1, gru.HIDDEN).astype(np.float32), (gru.INPUTS, 1)), outputs)).sum() - 1) < 1e-4


def test_language_model(docs, texts):
    with_ids = docs.where("doc_id is not null")
    training = with_ids.where("doc_id % 7 <> 2")
    words = {i * 3: (t or "").encode().lower().split() + [b""] for i, t in enumerate(texts)}
    counts = Counter(w for i, ws in words.items() if i % 7 != 2 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    rows = language_model.score_documents(with_ids, training).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ws = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        base = sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_rare_words_are_looked_up_by_a_join(docs, monkeypatch):
    with_ids = docs.where("doc_id is not null")
    want = {r.doc_id: (r.n_known, r.base_score) for r in language_model.score_documents(with_ids, with_ids).collect()}
    monkeypatch.setattr(language_model, "HEAD_WORDS", 50)
    got = {r.doc_id: (r.n_known, r.base_score) for r in language_model.score_documents(with_ids, with_ids).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-6 for k in got)


def test_language_model_of_nothing(empty):
    assert language_model.score_documents(empty, empty).count() == 0


def test_language_model_learns_from_all_documents(docs, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 4000)
    tables = {}
    monkeypatch.setattr(language_model, "stored", lambda df, name, stored=language_model.stored: tables.setdefault(name, stored(df, name)))
    training = docs.where("doc_id is not null")
    total = sum(len(language_model.tokens(r.text)) + 1 for r in training.collect())
    language_model.train_model(training, [b"", b"a"], np.ones(gru.INPUTS), total)
    trained = tables["weights1"].select("n").distinct().count(), tables["training-texts"].count()
    assert trained[0] > 1 and trained[1] == training.count()


def test_blocks_hold_no_more_than_their_bound_of_equal_rows(spark, monkeypatch):
    """Repeated rows without an id are dealt to several blocks, and so are very many short pieces."""
    monkeypatch.setattr(packing, "BLOCK_PIECES", 10_000)
    pieces = spark.range(100_000).selectExpr("CAST(NULL AS LONG) AS doc_id", "0 AS piece", "0L AS start", "3L AS length", "7L AS ids_crc32")
    real = packing._pack

    def pack(*args):
        run = real(*args)

        def counted(group):
            if group.num_rows > 11_500:
                raise AssertionError(f"a block of {group.num_rows} pieces")
            return run(group)

        return counted

    monkeypatch.setattr(packing, "_pack", pack)
    out = packing.pack(packing.stored(pieces, "equal"), 4096)
    loads = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.countDistinct("offset").alias("d")).collect()
    assert sum(r.k for r in loads) == 100_000 and all(r.n <= 4096 and r.d == r.k for r in loads) and len(loads) <= 80


def test_words_that_are_not_held_are_not_learnt():
    vocabulary = language_model.Vocabulary([b"", b"the"], {b"the": 5, b"held": 2})
    slots, ids, others = vocabulary.sequence([b"held", b"new1", b"the", b"new2", b"new1"])
    assert others == [b"new1", b"new2", b"new1"] and len(vocabulary.slots) == 3
    assert ids.tolist() == [gru.WORDS + b if b >= 0 else 1 for b in (*gru.buckets_of([b"held", b"new1"]), -1, *gru.buckets_of([b"new2", b"new1"]))]
    assert vocabulary.counted[slots].tolist() == [True, False, True, False, False]
    assert np.allclose(vocabulary.logs[slots], np.log10([3, 1, 6, 1, 1]))


def test_large_logits_stay_finite():
    draw = np.random.default_rng(4)
    m = gru.Gru.start(draw.integers(1, 100, gru.INPUTS).astype(float))
    h = draw.normal(0, 1, gru.HIDDEN).astype(np.float32)
    assert m.small_logits(h)
    m.c, m.w = m.c * np.float32(900), m.w * np.float32(900)
    assert not m.small_logits(h)
    found = m.log_probs(np.tile(h, (gru.INPUTS, 1)), np.arange(gru.INPUTS))
    assert np.isfinite(found).all() and abs(np.exp(found.astype(float)).sum() - 1) < 1e-4
    g, _, loss = gru.gradients(m, np.tile(h, (4, 1)), np.zeros((3, 4), int), draw.integers(0, gru.INPUTS, (3, 4)))
    assert np.isfinite(loss) and all(np.isfinite(v).all() for v in g.values())


def test_logits_of_a_window_are_multiplied_by_nothing(monkeypatch):
    draw = np.random.default_rng(6)
    m = gru.Gru.start(draw.integers(1, 100, gru.INPUTS).astype(float))
    ids, targets = draw.integers(0, gru.INPUTS, (2, 6, 4))
    kept = []

    def loss(logits, at, *others, found=gru._softmax_loss):
        out = found(logits, at, *others)
        kept.append((logits.copy(), at, out))
        return out

    monkeypatch.setattr(gru, "_softmax_loss", loss)
    g, _, mean = gru.gradients(m, np.zeros((4, gru.HIDDEN), dtype=np.float32), ids, targets)
    for logits, at, (_, total) in kept:  # rows are softmaxes less their picks, times their totals
        assert np.allclose(logits.sum(axis=1), 0, atol=1e-3 * total.max()) and (logits[np.arange(len(at)), at] < 0).all()
    assert np.isclose(g["cb"].sum(), 0, atol=1e-5) and mean > 0 and g["w"].shape == m.w.shape and g["wb"].shape == m.wb.shape


def test_texts_are_few_strings_at_once(monkeypatch):
    monkeypatch.setattr(toxicity, "TEXTS_AT_ONCE", 2)
    texts = ["a stupid idiot", None, "", "you idiot", "fine words"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts, pa.string())], ["doc_id", "text"])
    assert list(toxicity._texts(batch)) == [t or "" for t in texts]
    got = next(toxicity._featurize(["idiot", "fine"])(iter([batch])))
    want = [toxicity.Featurizer(["idiot", "fine"])(t or "") for t in texts]
    assert got.column("places").to_pylist() == [list(f) for f, _ in want] and got.column("pattern").to_pylist() == [p for _, p in want]
