"""Whitening of embeddings: exact distributed covariance, eigenvectors refined from float32 by Ogita-Aishima iterations."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import stored

#: An entry c becomes floor(SCALE * c) + OFFSET; components that are returned at most.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Entries stop at this size, and deviations at the end of a long; sums of products below EXACT are whole numbers in doubles.
LARGEST, LONG, EXACT = 1 << 50, (1 << 63) - 1, 1 << 53
#: Rounds of refinement at most; each doubles the digits that are right.
ROUNDS = 24


def finite_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, c): vectors as doubles, without those that are null or hold null or non-finite entries."""
    c = F.transform(F.col(embedding), lambda v: v.cast("double"))
    fine = F.col(embedding).isNotNull() & ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), c.alias("c"))


def _integers(column: pa.Array, width: int) -> np.ndarray:
    """Rows of x, as longs; entries beyond a shorter vector's end count as 0."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.clip(np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)), -LARGEST, LARGEST).astype(np.int64)
    out = np.full((len(column), width), OFFSET, dtype=np.int64)
    inside = np.arange(width)[None, :] < sizes[:, None]
    out[inside] = flat + OFFSET
    return out


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _gram(y: np.ndarray) -> np.ndarray:
    """y^T y of integers, exactly, in Python's integers: by doubles or longs as far as their sums are exact."""
    most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if most < EXACT:
        d = y.astype(float)
        return (d.T @ d).astype(np.int64).astype(object)
    if most < LONG:
        return (y.T @ y).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each place of this task's vectors: the sum of its entries x and their count; at place -1 the vectors."""
    sums, counts, n = np.zeros(0, dtype=object), np.zeros(0, dtype=np.int64), 0
    for batch in batches:
        column = batch.column("c")
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        n, width = n + len(column), max(len(sums), int(sizes.max(initial=0)))
        x = _integers(column, width)
        sums, counts = (np.concatenate([a, np.zeros(width - len(a), dtype=a.dtype)]) for a in (sums, counts))
        here = (np.arange(width)[None, :] < sizes[:, None]).sum(axis=0)
        wide = x if not len(x) or int(np.abs(x).max(initial=0)) * len(x) < LONG else x.astype(object)
        sums = sums + wide.sum(axis=0).astype(object) - (len(x) - here).astype(object) * OFFSET
        counts = counts + here
    places = [-1, *range(len(sums))]
    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), _decimals([0, *sums]), pa.array([n, *counts.tolist()], pa.int64())], ["i", "s", "n"])


def _products(width: int, centre: list[int]):
    """mapInArrow function: the upper triangle of this task's sum of products of x - centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, middle = np.zeros((width, width), dtype=object), np.array(centre, dtype=np.int64)
        for batch in batches:
            total = total + _gram(_integers(batch.column("c"), width) - middle)
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(total[i, j])], ["i", "j", "s"])

    return run


def _long_double(value: int, by: int) -> np.longdouble:
    """value / by, to the precision of a long double."""
    whole, rest = divmod(value, by)
    wide = lambda v: np.longdouble(float(v)) + np.longdouble(float(v - int(float(v))))
    return wide(whole) + wide(rest) / wide(by)


def covariance(rows: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Count, sums by dimension and covariance (divisor n, long doubles) of x over rows of finite_vectors.

    All sums are of whole numbers and exact: products are made of x less the mean rounded to a whole number, and what the
    rounding leaves is taken off at the end. Tasks give d sums and d * (d + 1) / 2 products each, which Spark adds up; the driver gets
    only those totals.
    """
    found = {r.i: (int(r.s), r.n) for r in rows.mapInArrow(_sums, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").cast("decimal(38,0)").alias("s"), F.sum("n").alias("n")).collect()}
    n = found.pop(-1, (0, 0))[1]
    width = max(found, default=-1) + 1
    sums = [found[i][0] + (n - found[i][1]) * OFFSET for i in range(width)]
    if not n or not width:
        return n, sums, np.zeros((width, width), np.longdouble)
    centre = [(2 * s + n) // (2 * n) for s in sums]
    products = rows.mapInArrow(_products(width, centre), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").cast("decimal(38,0)").alias("s")).collect()
    left, v = [s - n * c for s, c in zip(sums, centre)], np.zeros((width, width), np.longdouble)
    for r in products:
        v[r.i, r.j] = v[r.j, r.i] = _long_double(n * int(r.s) - left[r.i] * left[r.j], n * n)
    return n, sums, v


def _rotate_clusters(values: np.ndarray, s: np.ndarray, r: np.ndarray, x: np.ndarray, near: np.longdouble, noise: np.longdouble) -> tuple[np.ndarray, bool]:
    """Sub-solves: eigenvectors whose (falling) values lie within `near` of the next span one subspace, in which the small matrix less
    its mean value is solved again. Its entries are as small as the cluster is narrow, so that doubles tell apart what they can't in the
    whole matrix."""
    cuts = np.flatnonzero(values[:-1] - values[1:] > near) + 1
    out, turned = x.copy(), False
    for first, last in zip([0, *cuts], [*cuts, len(values)]):
        if last - first < 2:
            continue
        part = slice(first, last)
        mean = values[part].mean()
        small = s[part, part] - mean * np.eye(last - first, dtype=np.longdouble) + mean * r[part, part]
        if np.abs(small - np.diag(np.diag(small))).max() <= noise:
            continue
        size = np.abs(small).max()
        turn = np.linalg.eigh(((small + small.T) / (2 * size)).astype(float))[1][:, ::-1]
        out[:, part], turned = x[:, part] @ turn.astype(np.longdouble), True
    return out, turned


def refined_eigen(v: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix of long doubles.

    Starts with eigenvectors in float32. Each round measures how far they are from orthonormal (R = I - X^T X) and from diagonalising
    (S = X^T V X), sub-solves the clusters of values that this error can't tell apart, and adds X E, where
    E = (S + value_j R) / (value_j - value_i), or R / 2 within a cluster and where S is no more than rounding: matrix products alone, in long doubles, which
    double the digits that are right. Values that are equal leave any basis of their subspace.
    """
    d = len(v)
    most = np.abs(v).max(initial=0)
    if not most:
        return np.zeros(d, np.longdouble), np.eye(d, dtype=np.longdouble)
    scale = np.longdouble(2.0) ** int(np.frexp(most)[1])
    a, one = v / scale, np.eye(d, dtype=np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    norm = np.sqrt((a * a).sum())
    noise = 4 * np.sqrt(np.longdouble(d)) * np.finfo(np.longdouble).eps * norm  # of an entry of S
    for k in range(rounds):
        for turned in (False, True):  # measured again after clusters were turned
            r, s = one - x.T @ x, x.T @ a @ x
            values = np.diag(s) / (1 - np.diag(r))
            order = np.argsort(-values, kind="stable")
            r, s, x, values = r[np.ix_(order, order)], s[np.ix_(order, order)], x[:, order], values[order]
            near = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + norm * np.sqrt((r * r).sum()))
            if turned:
                break
            x, again = _rotate_clusters(values, s, r, x, near, noise)
            if not again:
                break
        gap = values[None, :] - values[:, None]
        push = s + values[None, :] * r
        apart = (np.abs(gap) > near) & (np.abs(push) > noise)
        e = np.where(apart, push / np.where(apart, gap, 1), r / 2)
        x = x + x @ e
        if k and np.abs(e).max() < 2.0**-56:
            break
    x = x / np.sqrt((x * x).sum(axis=0))
    values = ((a @ x) * x).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return values[order] * scale, x[:, order]


def _whiten(n: int, sums: list[int], axes: np.ndarray, sizes: np.ndarray):
    """mapInArrow function: (vec_id, c) to exact deviations and coordinates on the components; null where a component has no variance."""
    width, usable = len(sums), sizes > 0
    by = np.where(usable, sizes, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column("c"), width)
            fits = n * max(int(np.abs(x).max(initial=0)), max(map(abs, sums), default=0) // max(1, n) + 1) < LONG // 2
            away = n * x - np.array(sums, dtype=np.int64) if fits else n * x.astype(object) - np.array(sums, dtype=object)
            most = max((abs(int(v)) for v in (away.max(initial=0), away.min(initial=0))), default=0)
            wide = away if most * most * max(1, width) < LONG else away.astype(object)
            deviation = [min(int(v), LONG) for v in (wide * wide).sum(axis=1)] if width else [0] * len(x)
            whitened = ((away / n).astype(float) @ axes) / by
            flat = pa.array(whitened.ravel(), pa.float64(), mask=np.tile(~usable, len(x)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(sizes), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviation, pa.int64()), lists], ["vec_id", "deviation", "w"])

    return run


def _moments(count: int):
    """mapInArrow function: sums (at j = -1) and sums of products of this task's coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(count), np.zeros((count, count))
        for batch in batches:
            w = batch.column("w").flatten().fill_null(0.0).to_numpy().reshape(-1, count)
            sums, products = sums + w.sum(axis=0), products + w.T @ w
        i, j = np.triu_indices(count)
        columns = [np.concatenate([np.arange(count), i]), np.concatenate([np.full(count, -1), j]), np.concatenate([sums, products[i, j]])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64()))], ["i", "j", "s"])

    return run


def identity_error(whitened: DataFrame, n: int, usable: np.ndarray) -> float:
    """The largest entry of (covariance of the coordinates - identity) in size, over all rows; coordinates are centred already, so that
    the products of their sums, which are taken off, are next to nothing."""
    count = len(usable)
    if not usable.any():
        return 0.0
    means, products = np.zeros(count), np.zeros((count, count))
    for r in whitened.select("w").mapInArrow(_moments(count), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        if r.j < 0:
            means[r.i] = r.s / n
        else:
            products[r.i, r.j] = products[r.j, r.i] = r.s / n
    error = products - np.outer(means, means) - np.eye(count)
    return float(np.abs(error[np.ix_(usable, usable)]).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Coordinates of every vector on the first components of its covariance, each with variance 1.

    Entries c become x = floor(64 * c) + 1000000. Returns vec_id, component (from 1), n, deviation (sum over dimensions of
    (n * x - S)^2, exact), whitened ((x - S / n) on the component, over the root of its eigenvalue), explained (eigenvalue over the
    trace) and identity_error (of the whole table). Signs are such that the entry of a component that is largest in size is positive.

    Vectors that are null or hold null or non-finite entries take no part; shorter ones count as filled with zeros; null and
    repeated vec_ids are kept, repeated rows count each; an empty table gives no rows; other columns are not read. A component without
    variance has a null `whitened` and is not in identity_error; if no dimension varies, explained is null. Entries beyond 2**50 (64 * c) and
    deviations beyond a long stop there. The driver holds matrices of d by d, whatever the rows.
    """
    spark = vectors.sparkSession
    rows = finite_vectors(vectors, vec_id, embedding)
    n, sums, v = covariance(rows)
    width = len(sums)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], schema)
    values, axes = refined_eigen(v)
    values, axes = values[:components], axes[:, :components]
    trace = np.trace(v)
    usable = values > width * 2.0**-50 * max(values[0], 0)
    sizes = np.where(usable, np.sqrt(np.where(usable, values, 0)), 0).astype(float)
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    whitened = stored(rows.mapInArrow(_whiten(n, sums, axes.astype(float), sizes), "vec_id long, deviation long, w array<double>"), "whitened")
    error = identity_error(whitened, n, usable)
    shares = F.array(*(F.lit(float(e / trace) if trace > 0 else None).cast("double") for e in values))
    out = whitened.select("vec_id", "deviation", F.posexplode("w").alias("_at", "whitened"))
    return out.select(
        "vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("_at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
