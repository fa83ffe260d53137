"""Embedding whitening: a distributed exact covariance, and eigenvectors in mixed precision.

Entries become whole numbers, so sums and products are exact: tasks sum blocks whose products fit 53 bits with
matrix products, others with whole numbers of any size, and Spark adds them as decimals.  The eigenvectors start as
those of the float32 covariance and are corrected by Ogita-Aishima iterations, whose matrix products are computed in
twice the working precision.  Vectors of clustered eigenvalues, which that correction can't part, come from a
sub-solve of the covariance shifted and projected to their space, in which the cluster's gaps are large.

The driver holds matrices of dims x dims only.

Results for odd input: vectors that are null, empty, or hold null or non-finite entries take no part, nor do those
whose length is not the table's most frequent one (ties: the larger).  Null and repeated ids are rows like others.
Entries beyond 2^30 in size count as 2^30.  Components whose eigenvalue is 0 in double precision (fewer different
vectors than dimensions, a constant table) have no whitened values and are left out; an empty table gives no rows.
A deviation that no long holds is the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SCALE, SHIFT, MOST = 1024, 100_000, 2.0**30
ROWS = 4096


# ---- sums and products of whole numbers, exact


def fitting(vectors: DataFrame, vec_col: str) -> tuple[DataFrame, int]:
    """The rows that take part, and their number of dimensions (0: there are none)."""
    v = F.col(vec_col)
    odd: Column = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(v.isNotNull() & (F.size(v) > 0) & ~odd)
    first = rows.groupBy(F.size(v).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    return (rows.where(F.size(v) == first["dims"]), first["dims"]) if first else (rows, 0)


def matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, x) of blocks of rows; x = floor(1024 c) + 100000."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            c = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
            yield part.column("id"), np.floor(SCALE * np.clip(c, -MOST, MOST)).astype(np.int64) + SHIFT


def products(y: np.ndarray) -> np.ndarray:
    """y'y of whole numbers, exact: float64 where every sum fits its 53 bits."""
    top = int(np.abs(y).max(initial=0))
    if top * top * len(y) < 2**53:
        return (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64).astype(object)
    wide = y.astype(object)
    return wide.T @ wide


def summed(rows: DataFrame, dims: int, shift: np.ndarray | None = None) -> dict[tuple[int, int], int]:
    """Without ``shift`` (-1, -1): n and (-1, j): sum of x_j; with it (i, j): sum of (x - shift)_i (x - shift)_j, and (-1, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, first, second = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        for _, x in matrices(batches, dims):
            y = x if shift is None else x - shift
            n, first = n + len(y), first + y.sum(axis=0).astype(object)
            if shift is not None:
                second = second + products(y)
        if n:
            left, right = np.triu_indices(dims) if shift is not None else (np.zeros(0, int), np.zeros(0, int))
            values = [n, *first, *second[left, right]]
            yield {"i": np.concatenate([[-1], [-1] * dims, left]), "j": np.concatenate([[-1], np.arange(dims), right]), "s": [str(v) for v in values]}

    parts = arrow_map(rows, run, "i int, j int, s string")
    total = parts.groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    return {(r["i"], r["j"]): int(r["s"]) for r in total.collect()}


# ---- eigenvectors


def sliced(a: np.ndarray, bits: int) -> list[np.ndarray]:
    """``a`` as a sum of matrices whose rows' entries are multiples of a common unit, ``bits`` bits each."""
    out = []
    for _ in range(-(-110 // bits)):
        top = np.abs(a).max(axis=1, keepdims=True)
        if not top.any():
            break
        unit = np.ldexp(1.0, np.frexp(top)[1].astype(int) - bits)
        part = np.rint(a / unit) * unit
        out.append(part)
        a = a - part
    return out or [a]


def product(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The product of two matrices given as sums (high, low), as (high, low) in twice the working precision.

    Slices are so narrow that their float64 products are exact; they are added with the error of each sum kept.
    """
    bits = (53 - int(np.ceil(np.log2(max(2, a[0].shape[1]))))) // 2 - 1
    left = [s for x in a for s in sliced(x, bits)]
    right = [s.T for x in b for s in sliced(x.T, bits)]
    terms = [x @ y for x in left for y in right]
    high, low = np.zeros_like(terms[0]), np.zeros_like(terms[0])
    for t in sorted(terms, key=lambda t: -np.abs(t).max()):
        s = high + t
        back = s - high
        low += (high - (s - back)) + (t - back)
        high = s
    s = high + low
    return [s, low - (s - high)]


def less(a: list[np.ndarray], b: np.ndarray) -> np.ndarray:
    """(high, low) minus ``b``, rounded once."""
    d = a[0] - b
    back = d - a[0]
    return d + ((a[0] - (d - back)) - (b + back) + a[1])


def refined(v: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One correction of approximate eigenvectors x of v: (values, vectors, which neighbours were too close to part)."""
    one = np.eye(len(x))
    r = -less(product([x.T], [x]), one)
    s = product([x.T], product(v, [x]))
    values = (np.diag(s[0]) + np.diag(s[1])) / (1 - np.diag(r))
    off = s[0] - np.diag(np.diag(s[0]))
    gap = values[None, :] - values[:, None]
    close = 2 * (np.linalg.norm(off, 2) + np.abs(values).max() * np.linalg.norm(r, 2))
    far = np.abs(gap) > max(close, 0.0)
    e = np.where(far, (off + values[None, :] * r) / np.where(far, gap, 1.0), r / 2)
    np.fill_diagonal(e, np.diag(r) / 2)
    return values, x + x @ e, ~far


def clusters(values: np.ndarray, scale: float, width: float) -> list[np.ndarray]:
    """Runs of eigenvalues (falling) with gaps of at most ``width`` of the largest."""
    begins = np.flatnonzero(np.append(True, -np.diff(values) > width * scale))
    return [np.arange(a, b) for a, b in zip(begins, [*begins[1:], len(values)])]


def eigen(v: list[np.ndarray], rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors of a symmetric matrix given as a sum (high, low)."""
    scale = np.abs(v[0]).max()
    if not scale > 0:
        return np.zeros(len(v[0])), np.eye(len(v[0]))
    scale = float(2.0 ** np.floor(np.log2(scale)))  # a power of 2, so that dividing is exact
    v = [part / scale for part in v]
    x = np.linalg.eigh(v[0].astype(np.float32))[1].astype(np.float64)[:, ::-1]
    before = np.inf
    for step in range(rounds):
        values, better, _ = refined(v, x)
        order = np.argsort(-values, kind="stable")
        values, better = values[order], better[:, order]
        for group in clusters(values, np.abs(values).max(), 2e-6 if step == 0 else 1e-9):
            if len(group) < 2:
                continue
            # v - shift, projected: products in twice the precision, then the cluster's own small problem
            q = better[:, group]
            shift = float(values[group].mean())
            inner = less(product([q.T], product(v, [q])), shift * product([q.T], [q])[0])
            turn = np.linalg.eigh((inner + inner.T) / 2)[1][:, ::-1]
            better[:, group] = q @ turn
        change = np.abs(better - x[:, order] * np.sign((better * x[:, order]).sum(axis=0))).max()
        x = better
        if change < 4e-16 or (change < 1e-12 and change >= before):
            break
        before = change
    values = refined(v, x)[0]
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.linalg.norm(x[:, order], axis=0)
    return values[order] * scale, x * np.where(x[np.abs(x).argmax(axis=0), np.arange(len(x))] < 0, -1.0, 1.0)


# ---- the operator


@dataclass
class Whitening:
    """Of x: rows, exact sums less n times ``shift``, ``shift``, all eigenvalues and the components kept, as columns."""

    n: int
    rest: np.ndarray
    shift: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.shift) - np.array([float(Fraction(int(r), self.n)) for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components / np.sqrt(self.values[: self.components.shape[1]])

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n x - S)^2, exact; the largest long where it is more."""
        y = x - self.shift
        rough = ((self.n * y.astype(np.float64) - self.rest.astype(np.float64)) ** 2).sum(axis=1)
        small = rough < 2.0**62
        out = np.full(len(x), 2**63 - 1, np.int64)
        d = self.n * y[small] - self.rest.astype(np.int64)
        out[small] = (d * d).sum(axis=1)
        for k in np.flatnonzero(~small & (rough < 2.0**64)):
            out[k] = min(2**63 - 1, sum((self.n * int(a) - int(b)) ** 2 for a, b in zip(y[k], self.rest)))
        return out


def fit(rows: DataFrame, dims: int, most: int) -> Whitening | None:
    sums = summed(rows, dims)
    if not sums:
        return None
    n = sums[-1, -1]
    shift = np.array([sums[-1, j] // n for j in range(dims)], np.int64)
    around = summed(rows, dims, shift)
    rest = np.array([around[-1, j] for j in range(dims)], object)
    high, low = np.zeros((dims, dims)), np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            exact = Fraction(n * around[i, j] - rest[i] * rest[j], n * n)
            high[i, j] = high[j, i] = float(exact)
            low[i, j] = low[j, i] = float(exact - Fraction(high[i, j]))
    values, vectors = eigen([high, low])
    rank = int((values > dims * np.finfo(float).eps * max(values.max(), 0.0)).sum()) if values.max() > 0 else 0
    return Whitening(n, rest, shift, values, vectors[:, : min(most, rank)], float(np.trace(high)))


def identity_error(rows: DataFrame, dims: int, model: Whitening) -> float:
    """Largest entry of the covariance of the rows' whitened values minus the identity, measured on all rows."""
    k = model.components.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        first, second = np.zeros(k), np.zeros((k, k))
        for _, x in matrices(batches, dims):
            w = model.whitened(x)
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield {"i": np.concatenate([[-1] * k, np.repeat(np.arange(k), k)]), "j": np.concatenate([np.arange(k), np.tile(np.arange(k), k)]), "s": np.concatenate([first, second.ravel()])}

    found = {(r["i"], r["j"]): r["s"] / model.n for r in arrow_map(rows, run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    return max(abs(found[i, j] - found[-1, i] * found[-1, j] - (i == j)) for i in range(k) for j in range(k))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 8) -> DataFrame:
    """``vectors(id, vector)`` → a row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dims = fitting(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "v")
    model = fit(rows, dims, most) if dims else None
    if model is None or not model.components.shape[1]:
        return vectors.sparkSession.createDataFrame([], schema)
    k, error = model.components.shape[1], identity_error(rows, dims, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, x in matrices(batches, dims):
            size = len(x) * k
            yield {
                "vec_id": ids.take(pa.array(np.repeat(np.arange(len(x)), k))), "component": np.tile(np.arange(1, k + 1), len(x)), "n": np.full(size, model.n), "deviation": np.repeat(model.deviation(x), k),
                "whitened": model.whitened(x).ravel(), "explained": np.tile(model.values[:k] / model.trace, len(x)), "identity_error": np.full(size, error),
            }

    return arrow_map(rows, run, schema)
