import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import mixing, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_filled(sizes):
    """Targets by the contract's words: shares by weight, capped at three times, the excess shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), {}, set(order)
    while free:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * sizes[s]}
        if not over:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    return target


def test_mix(docs, texts):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    size = {i * 3: len(WORD.findall(t or "")) for i, t in enumerate(texts)} | {None: 2}
    sums = defaultdict(int)
    for r in rows:
        assert r.size == size[r.doc_id] and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        sums[r.source] += r.size
    want, taken, most = water_filled(sums), Counter(), Counter()
    for r in rows:
        assert r.source_size == sums[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sums:
        # documents are whole: one that is a large part of its source's target is in or out
        bound = max(60, 0.02 * want[s], most[s] if most[s] > 0.1 * want[s] else 0)
        assert abs(taken[s] - want[s]) <= bound
    again = {(r.doc_id, r.size): r.copies for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r.doc_id, r.size): r.copies for r in rows}


def test_mix_of_nothing(empty):
    assert mixing.mix(empty).count() == 0


def test_flight_keeps_totals_and_expectations():
    rng = np.random.default_rng(0)
    size = np.sort(rng.integers(0, 5000, 300))[::-1]
    p = np.full(300, 0.37)
    out = mixing.flight(size, p, rng.random(400), land=False)
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3
    assert ((out > 0) & (out < 1)).sum() <= 3
    small = np.array([9, 5, 5, 2, 0])
    mean = np.mean([mixing.flight(small, np.full(5, 0.4), rng.random(20), land=True) for _ in range(4000)], axis=0)
    assert np.abs(mean - 0.4).max() < 0.03


def test_shards(docs, texts):
    tree = sharding.balanced_tree(16)
    rows = sharding.shard_documents(docs, tree, sharding.grown_tree(tree)).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        t = "no id" if r.doc_id is None else texts[r.doc_id // 3]
        data = (t or "").encode()
        assert r.size == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_movement_stays_in_changed_subtrees(spark):
    ids = spark.range(20000).select(F.col("id").alias("k"))
    tree = sharding.balanced_tree(8)
    more = [leaf if leaf.shard != 0 else sharding.Leaf(leaf.region, leaf.rack, 0, 2.0) for leaf in tree]
    out = sharding.hash_tree(sharding.hash_tree(ids, F.col("k"), tree), F.col("k"), more, "new_")
    moved = out.where("shard <> new_shard")
    assert moved.where("new_rack <> 'region0/rack0' and rack <> 'region0/rack0' and region <> 'region0' and new_region <> 'region0'").count() == 0
    share = out.where("new_shard = 0").count() / 20000
    assert abs(share - 2 / 9) < 0.02


def test_shards_of_nothing(empty):
    assert sharding.shard_documents(empty, sharding.balanced_tree(4)).count() == 0


def test_equal_rows_are_many_blocks(spark, monkeypatch):
    """Rows without an id and of one size are no single group, and no range of one partition."""
    def noted(land, fly=mixing._fly):
        run = fly(land)

        def noting(group):
            if group.num_rows > 3 * 64:
                raise ValueError("a block of too many units")
            return run(group)

        return noting

    monkeypatch.setattr(mixing, "BLOCK_ROWS", 64)
    monkeypatch.setattr(mixing, "_fly", noted)
    rows = [(None, "two words", "a")] * 2000 + [(i, "w " * (i % 9), "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    for source in "ab":
        of = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 3 * 9
    from attesta.llm.common import numbered

    same = numbered(docs.select("source").where("source = 'a'"), [F.col("source")], "at")
    assert sorted(r["at"] for r in same.collect()) == list(range(2000))
    ranges = same.groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in ranges) < 2000
