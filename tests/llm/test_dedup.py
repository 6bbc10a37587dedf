import os
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from attesta.llm import common, components, lines, simhash


class Sets:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def test_components(spark):
    draw = np.random.default_rng(3)
    pairs = draw.integers(0, 400, (260, 2)).tolist() + [[1000 + i, 1001 + i] for i in range(40)] + [[5000, 5001 + i] for i in range(50)] + [[7, 7]]
    want = Sets()
    for a, b in pairs:
        want.join(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*pairs, [None, 3]], "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want.root(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, texts):
    want, sets = {i * 3: brute_simhash(t) for i, t in enumerate(texts)}, Sets()
    for a in want:
        for b in want:
            if a < b and (want[a] ^ want[b]).bit_count() <= 2:
                sets.join(a, b)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert r.bits % (1 << 64) == want[r.doc_id] and r.component_id == sets.root(r.doc_id)


def test_simhash_of_nothing(empty):
    assert simhash.near_duplicates(empty).count() == 0


def brute_lines(texts):
    """Removed places by id, from exact Jaccard similarities of all pairs of distinct lines."""
    where, sets = defaultdict(list), Sets()
    for i, t in enumerate(texts):
        for at, line in enumerate((t or "").split("\n")):
            norm = re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")
            if norm:
                where[norm].append((i * 3, at))
    shingles = {n: {n[k : k + 5] for k in range(len(n) - 4)} or {n} for n in where}
    names = sorted(where)
    for k, a in enumerate(names):
        for b in names[k + 1 :]:
            same = len(shingles[a] & shingles[b])
            if same >= 0.8 * (len(shingles[a]) + len(shingles[b]) - same):
                sets.join(a, b)
    groups = defaultdict(list)
    for n in names:
        groups[sets.root(n)] += where[n]
    gone = defaultdict(set)
    for places in groups.values():
        for i, at in sorted(places)[1:]:
            gone[i].add(at)
    return gone


def test_fuzzy_lines(docs, texts):
    want = brute_lines(texts)
    rows = lines.dedup_lines(docs.where("doc_id is not null")).collect()
    assert len(rows) == len(texts)
    wrong = missed = found = 0
    for r in rows:
        got, text = set(r.removed), texts[r.doc_id // 3]
        assert r.lang == "en" and r.size == "clash"
        wrong, missed, found = wrong + len(got - want[r.doc_id]), missed + len(want[r.doc_id] - got), found + len(got)
        assert r.text == (None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in got))
    assert wrong <= 0.02 * found and missed <= 0.05 * (found + missed) and found > 20  # banding may miss pairs near the bound


def test_lines_of_nothing(empty):
    assert lines.dedup_lines(empty).count() == 0


def test_a_group_of_near_copies_is_one_component(spark):
    base = " ".join(f"word{i}" for i in range(60))
    rows = [(i, base + f" tail{i}") for i in range(40)] + [(100 + i, f"{base[:60]} other{i} " + " ".join(f"u{i}v{j}" for j in range(40))) for i in range(10)]
    out = {r.doc_id: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].text == rows[0][1] and all(out[i].text == "" for i in range(1, 40))
    assert all(out[100 + i].text == rows[40 + i][1] for i in range(10))


def test_tiles_lose_no_link(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(-(1 << 62), 1 << 62, 60)
    prints = sorted({int(x) for x in base} | {int(x ^ (1 << int(draw.integers(0, 62))) ^ (1 << int(draw.integers(0, 62)))) for x in base})
    df = spark.createDataFrame([(x,) for x in prints], "bits long")
    got = Sets()
    for r in simhash.near_links(df).collect():
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 2
        got.join(r.a, r.b)
    for a in prints:
        for b in prints:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2:
                assert got.root(a) == got.root(b)
    assert df.select(F.count("*")).first()[0] == len(prints)


def jaccard(a, b):
    x, y = ({t[k : k + 5] for k in range(len(t) - 4)} or {t} for t in (a, b))
    return len(x & y) / len(x | y)


def edited(draw, line, letters):
    chars = list(line)
    while jaccard("".join(chars), line) > 0.87:
        chars[draw.randrange(len(chars))] = draw.choice(letters)
    return "".join(chars)


def test_recall_of_pairs_just_above_the_bound(spark):
    draw = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = [
        lambda: " ".join("".join(draw.choice(letters) for _ in range(draw.randrange(2, 9))) for _ in range(25)),
        lambda: "".join(draw.choice(letters) for _ in range(120)),
        lambda: "".join(chr(0x4E00 + draw.randrange(5000)) for _ in range(90)),
    ]
    pairs = []
    while len(pairs) < 900:
        line = kinds[len(pairs) % 3]()
        copy = edited(draw, line, letters)
        if 0.8 <= jaccard(line, copy) < 0.9:
            pairs.append((line, copy))
    rows = [(2 * i + k, pair[k]) for i, pair in enumerate(pairs) for k in (0, 1)]
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert all(out[2 * i] == pair[0] for i, pair in enumerate(pairs))
    assert sum(out[2 * i + 1] == "" for i in range(len(pairs))) >= 0.985 * len(pairs)


def test_lines_that_begin_alike_are_not_all_compared(spark, monkeypatch):
    draw = random.Random(5)
    urls = ["https://www.example.com/shop/" + "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30)) for _ in range(400)]
    copies = ["h" + u[2:] for u in urls[:50]]  # differ within the first characters
    compared = []

    def counted(pairs, texts, verified=lines._verified):
        compared.append(pairs.count())
        return verified(pairs, texts)

    monkeypatch.setattr(lines, "_verified", counted)
    rows = list(enumerate(urls + copies))
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == u for i, u in enumerate(urls)) and sum(out[400 + i] == "" for i in range(50)) >= 49
    assert sum(compared) <= 4 * len(rows)


def test_mixed_members_meet_exactly(spark):
    draw = random.Random(8)
    words = ["".join(draw.choice("abcdef") for _ in range(5)) for _ in range(40)]
    texts = [" ".join(draw.choice(words) for _ in range(12)) for _ in range(30)]
    for t in list(texts):
        for at in (0, 25, 50):
            texts.append(t[:at] + "xy" + t[at + 2 :])
    texts += ["abc", "abcde", "ünïcode ß line of some length", "ünïcode ß line of some lengt"]
    rows = [(i, t) for i, t in enumerate(sorted(set(texts)))]
    members = spark.createDataFrame([(i, i) for i, _ in rows], "line_id long, component long")
    got = {(r.a, r.b) for r in lines._across(members, spark.createDataFrame(rows, "line_id long, line string")).collect()}
    want = {(a, b) for a, x in rows for b, y in rows if a < b and jaccard(x, y) >= 0.8}
    assert want <= got and want


def test_lines_less_alike_than_the_bound_are_few_pairs(spark, monkeypatch):
    draw = random.Random(9)
    base = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(16)]
    rows = []
    for i in range(300):  # any two are about 0.6 to 0.75 alike
        words = list(base)
        words[draw.randrange(16)] = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14))
        rows.append((i, " ".join(words)))
    rows += [(300 + i, rows[i][1] + "xy") for i in range(20)]
    tables = {}
    monkeypatch.setattr(lines, "stored", lambda df, name, stored=lines.stored: tables.setdefault(name, []).append(stored(df, name)) or tables[name][-1])
    counts = []
    monkeypatch.setattr(lines, "_verified", lambda pairs, texts, verified=lines._verified: counts.append(pairs.count()) or verified(pairs, texts))
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[300 + i] == "" for i in range(20)) >= 19
    assert counts[-1] <= 10 * len(rows)
    assert not any(t.inputFiles() and os.path.exists(t.inputFiles()[0].removeprefix("file:")) for t in (*tables["lines"], *tables["compared-lines"], *tables["candidate-lines"]))


def test_signatures_agree_as_counted_one_by_one(spark):
    draw = random.Random(4)
    pairs = [([draw.randrange(256) for _ in range(28)], draw.randrange(29)) for _ in range(300)]
    pairs += [([at] * 28, same) for at in (0, 127, 128, 255) for same in (14, 15, 28)]
    rows = []
    for i, (x, same) in enumerate(pairs):
        y = [v if k < same else draw.choice([v ^ 1, v ^ 128, v ^ 255, (v + 1) % 256]) for k, v in enumerate(x)]
        packed = [tuple(int.from_bytes(bytes(v[7 * w : 7 * w + 7])) for w in range(4)) for v in (x, y)]
        rows.append((i, *packed))
    sketch = "struct<s0:long,s1:long,s2:long,s3:long>"
    got = {r.i: r.likely for r in spark.createDataFrame(rows, f"i long, x {sketch}, y {sketch}").select("i", lines._agreeing().alias("likely")).collect()}
    assert got == {i: same >= lines.AGREEING for i, (_, same) in enumerate(pairs)}


def test_buckets_in_which_few_signatures_agree_meet_pair_by_pair(spark, monkeypatch):
    draw = random.Random(5)
    urls = ["https://www.example.com/shop/" + "".join(draw.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(30)) for _ in range(400)]
    copies = [u[:-1] + "_" for u in urls[:50]]
    across = []
    monkeypatch.setattr(lines, "_across", lambda members, texts, find=lines._across: across.append(members.count()) or find(members, texts))
    rows = list(enumerate(urls + copies))
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == u for i, u in enumerate(urls)) and sum(out[400 + i] == "" for i in range(50)) >= 49
    assert across == [0]


def test_shuffle_files_go_with_the_query_that_made_them(spark):
    local = spark.conf.get("spark.local.dir")
    files = lambda: {os.path.join(d, f) for d, _, found in os.walk(local) for f in found if f.startswith("shuffle_")}
    before, set_before = files(), spark.conf.get(common.SHUFFLES_GO, None)
    table = common.stored(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    assert table.count() == 100 and not {f for f in files() - before if os.path.getsize(f) > 1000}
    assert spark.conf.get(common.SHUFFLES_GO, None) == set_before


def test_batches_of_a_stored_table_are_as_small_as_asked(spark):
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches)
    before = spark.conf.get(common.BATCH_ROWS)
    rows = [r.n for r in common.stored(spark.range(0, 1000, 1, 2).mapInArrow(sizes, "n long"), "sizes", batch_rows=70).collect()]
    assert sum(rows) == 1000 and max(rows) == 70 and spark.conf.get(common.BATCH_ROWS) == before


def test_lines_little_alike_share_few_bands(spark, monkeypatch):
    draw = random.Random(12)
    rows = []
    for i in range(2 * 600):  # pairs: of the odd ones each value differs from that before with probability 0.2, of all others nearly all
        values = [v if i % 2 and draw.random() < 0.8 else draw.randrange(256) for v in (values if i % 2 else [0] * 28)]
        rows.append((i, *(int.from_bytes(bytes(values[w::4][::-1])) for w in range(4))))
    few = spark.createDataFrame(rows, "line_id long, s0 long, s1 long, s2 long, s3 long").select("line_id", F.struct("s0", "s1", "s2", "s3").alias("sketch"))
    for lines_there, keys, least in ((1000, 14, 0.96), (lines.MANY_LINES, 28, 0.97)):
        got = {r.line_id: set(r.k) for r in few.select("line_id", lines._band_keys(lines_there).alias("k")).collect()}
        assert all(len(k) == keys for k in got.values())
        assert sum(bool(got[i] & got[i + 1]) for i in range(0, 1200, 2)) >= least * 600
        assert sum(len(got[i] & got[i + 3]) for i in range(0, 1196, 2)) == 0
    draw = random.Random(12)
    syllables = ["en", "er", "ch", "ein", "ung", "keit", "sch", "ver", "ge", "be", "auf", "lich", "heit", "zu", "und", "die", "der", "das", "ist", "st"]
    texts = [" ".join("".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4))) for _ in range(60)) for _ in range(500)]
    members = []
    monkeypatch.setattr(lines, "stored", lambda df, name, stored=lines.stored: members.append((name, stored(df, name))) or members[-1][1])
    found = lines._lines(lines._keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    monkeypatch.setattr(lines, "dropped", lambda *tables: None)
    assert lines.line_links(found, lines.distinct_lines(found)).count() == 0
    assert next(t.count() for name, t in members if name == "bucket-members") <= 150  # 241 with seven bands of four values


def test_tables_with_texts_are_packed(spark):
    for table, codec in ((common.stored(spark.createDataFrame([("some text",)], "text string"), "texts"), "ZSTD"), (common.stored(spark.range(9), "ids"), "SNAPPY")):
        files = [f.removeprefix("file:") for f in table.inputFiles()]
        assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files if pq.ParquetFile(f).metadata.num_row_groups} == {codec}
