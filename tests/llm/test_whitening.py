import math
from fractions import Fraction

import numpy as np
import pytest

from attesta.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, w int, deviation string"
EXTRA = (1, "clash", "clash", 2, "clash")


def table(spark, rows):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA).repartition(3)


def by_hand(vectors, width, components):
    """Brute force: exact sums, then eigenvectors in doubles of the exact covariance."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for v in vectors]
    n, sums = len(x), [sum(r[j] for r in x) for j in range(width)]
    away = [[n * a - s for a, s in zip(r, sums)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in away), n**3)) for j in range(width)] for i in range(width)])
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    w = (np.array([[float(Fraction(a, n)) for a in r] for r in away]) @ q) / np.sqrt(e)
    return [sum(a * a for a in r) for r in away], w, e / np.trace(v)


def test_equals_brute_force_and_leaves_odd_vectors_out(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(400, 40)) @ rng.normal(size=(40, 40)) * 3).astype(np.float32).tolist()
    vectors[7], vectors[8] = vectors[7][:30], vectors[9]
    ids = [None if i in (3, 4) else i // 2 for i in range(400)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 38), (902, [float("nan")] * 40), (903, [float("-inf")] + [0.0] * 39)]
    got = whitening.whiten(table(spark, [*zip(ids, vectors), *odd])).collect()
    deviation, w, explained = by_hand(vectors, 40, 32)
    assert len(got) == 400 * 32 and {r.n for r in got} == {400} and {r.vec_id for r in got} == set(ids)
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.deviation), [[] for _ in range(33)])[r.component].append(r)
    sign = np.array([np.sign(w[0, c]) * np.sign(rows[ids[0], deviation[0]][c + 1][0].whitened) for c in range(32)])
    for i, vec_id in enumerate(ids):
        for c in range(32):
            assert any(math.isclose(r.whitened, w[i, c] * sign[c], rel_tol=1e-8, abs_tol=1e-9) for r in rows[vec_id, deviation[i]][c + 1])
            assert math.isclose(rows[vec_id, deviation[i]][c + 1][0].explained, explained[c], rel_tol=1e-9)
    error = np.abs(w.T @ w / 400 - np.eye(32)).max()
    assert {r.identity_error < 1e-9 for r in got} == {True} and len({r.identity_error for r in got}) == 1 and error < 1e-9


def test_components_without_variance_and_small_tables(spark):
    rows = [(i, [0.1 * i, 5.0, -0.3 * i]) for i in range(50)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 150 and {r.component for r in got if r.whitened is None} == {3} and all(r.identity_error < 1e-9 for r in got)
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, 0.0), (2, 1, 0, None, None, 0.0)]
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(table(spark, [(1, [0.0])]).limit(0)).count() == 0


def test_very_large_entries_stop_at_the_bound(spark):
    rows = [(i, [float(i), 3e38 if i == 3 else 1.5 * (i % 7)]) for i in range(20)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert len(got) == 40 and all(r.identity_error < 1e-4 for r in got) and max(r.deviation for r in got) == (1 << 63) - 1


@pytest.mark.parametrize("values", [[5.0] * 10 + [5 + 1e-11 * k for k in range(20)] + [0.5 + 0.01 * k for k in range(10)], [3.0] * 20, [5 + 1e-7 * k for k in range(30)], [2.0**-k for k in range(30)], [1.0, 0, 0]])
def test_clustered_values_are_told_apart(values):
    wide = np.longdouble
    d, rng = len(values), np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(wide)
    for _ in range(3):
        q = q + q @ (np.eye(d, dtype=wide) - q.T @ q) / 2
    e = np.sort(np.array(values, dtype=wide))[::-1]
    v = (q * e) @ q.T
    got, x = whitening.refined_eigen((v + v.T) / 2)
    assert np.abs(got - e).max() < 1e-16 * e[0] and np.abs(v @ x - x * got).max() < 1e-16 * e[0] and np.abs(x.T @ x - np.eye(d)).max() < 1e-17
    for gap_from in np.flatnonzero(np.diff(-e) > 1e-8 * e[0]):  # values that stand apart: subspaces up to there agree
        part = slice(0, gap_from + 1)
        assert np.abs(x[:, part] @ x[:, part].T - q[:, part] @ q[:, part].T).max() < 1e-8
