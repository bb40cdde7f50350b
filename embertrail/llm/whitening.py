"""Embedding whitening by polarisation: covariances from the variances of dimensions and of sums of two dimensions, in exact integers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, spans

#: An entry c becomes floor(SCALE * c) + SHIFT; components returned at most.
SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Share of the trace from which a component has variance to speak of.
LEAST_SHARE = 1e-13
#: Exact sums travel as limbs of 32 bits, the last one signed, so that Spark adds them as longs.
LIMBS = [f"a{k}" for k in range(6)]

_SUMS = f"dim int, i int, j int, n long, {', '.join(f'{a} long' for a in LIMBS)}"


def _limbs(value: int) -> list[int]:
    return [value >> 32 * k & 0xFFFFFFFF for k in range(len(LIMBS) - 1)] + [value >> 32 * (len(LIMBS) - 1)]


def _value(row) -> int:
    return sum(row[a] << 32 * k for k, a in enumerate(LIMBS))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, long matrix) for the rows of each length in column x."""
    column = batch.column("x")
    flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
    size = np.diff(ends)
    order = np.argsort(size, kind="stable")
    for start, end in zip(*spans(size[order])):
        rows = order[start:end]
        if size[rows[0]]:
            yield rows, flat[ends[rows][:, None] + np.arange(size[rows[0]])]


def _centred(x: np.ndarray, mean: list[int]) -> np.ndarray:
    """x less the whole part of the mean, as longs where they hold it, else as Python integers."""
    m = np.array(mean, object)
    if max(int(np.abs(x).max()), int(np.abs(x).min()), *(abs(v) for v in mean)) >= 1 << 61:
        return x.astype(object) - m
    return x - m.astype(np.int64)


def _sum_rows(sums: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    rows = []
    for dim, (n, acc) in sums.items():
        for i in range(len(acc)):
            for j in range(i, dim) if acc.ndim == 2 else (i,):
                rows.append((dim, i, j, n, *_limbs(int(acc[i, j] if acc.ndim == 2 else acc[i]))))
    kinds = [("dim", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), *((a, pa.int64()) for a in LIMBS)]
    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(zip(*rows), kinds)] if rows else [pa.nulls(0, t) for _, t in kinds], [k for k, _ in kinds])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By length of vector, exact sums of each dimension: one row a task and dimension."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for _, x in _matrices(batch):
            n, acc = sums.get(x.shape[1], (0, np.zeros(x.shape[1], object)))
            high, low = x >> 32, x & 0xFFFFFFFF  # no sum of a batch leaves a long
            sums[x.shape[1]] = n + len(x), acc + high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)
    yield from _sum_rows(sums)


def _squares(z: np.ndarray) -> np.ndarray:
    """Exact sums over the rows of z of (z_i + z_j) ** 2, for i = j of z_i ** 2, upper triangle, as Python integers."""
    d = z.shape[1]
    out = np.zeros((d, d), object)
    bound = 0 if z.dtype == object else 4 * int(np.abs(z).max()) ** 2
    at_once = (1 << 62) // max(bound, 1)
    if z.dtype != object and at_once < 64:
        z = z.astype(object)
    step = len(z) if z.dtype == object else min(at_once, 8192)
    for k in range(0, len(z), step):
        part = z[k : k + step]
        for i in range(d):
            pair = part[:, i + 1 :] + part[:, i : i + 1]
            out[i, i + 1 :] += (pair * pair).sum(axis=0).astype(object)
            out[i, i] += int((part[:, i] * part[:, i]).sum())
    return out


def _variances(means: dict[int, list[int]]):
    """By length of vector, exact sums of squared centred values for each dimension and each sum of two: one row a task and pair."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                n, acc = sums.get(x.shape[1], (0, 0))
                sums[x.shape[1]] = n + len(x), acc + _squares(_centred(x, means[x.shape[1]]))
        yield from _sum_rows(sums)

    return task


class Basis:
    """What whitens the vectors of one length: n, the sums S, and the components with their eigenvalues.

    With m the whole part of the mean S / n and r = S - n m, the squares come as q[i, j], sums of (z_i + z_j) ** 2 and for
    i = j of z_i ** 2, of z = x - m. From them follow exactly the squares of n x - S = n z - r, and from these the covariances:
    2 cov(i, j) = var(i + j) - var(i) - var(j). One rounding each is left when an integer is divided into a double.
    """

    def __init__(self, n: int, total: list[int], squares: dict[tuple[int, int], int], most: int) -> None:
        d = len(total)
        self.n, self.total, self.mean = n, total, [s // n for s in total]
        self.rest = [s - n * m for s, m in zip(total, self.mean)]
        r = self.rest
        # sum (n v - c) ** 2 with sum v = c is n (n sum v ** 2 - c ** 2): v is z_i or z_i + z_j, c is r_i or r_i + r_j
        var = {(i, j): n * (n * q - (r[i] if i == j else r[i] + r[j]) ** 2) for (i, j), q in squares.items()}
        v = np.empty((d, d))
        for (i, j), a in var.items():
            v[i, j] = v[j, i] = a / n**3 if i == j else (a - var[i, i] - var[j, j]) / (2 * n**3)
        self.covariance = v
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:most]
        trace = sum(var[i, i] for i in range(d)) / n**3
        self.values, self.vectors = np.maximum(values[order], 0), vectors[:, order]
        self.explained = self.values / trace if trace else np.zeros(len(order))
        self.live = self.explained > LEAST_SHARE
        self.scaled = self.vectors / np.sqrt(np.where(self.live, self.values, 1.0))
        self.identity_error: float | None = None

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (_centred(x, self.mean).astype(np.float64) - np.array([r / self.n for r in self.rest])) @ self.scaled

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of (n x - S) ** 2; None beyond a long."""
        z = _centred(x, self.mean)
        if z.dtype != object and x.shape[1] * (self.n * (int(np.abs(z).max()) + 1)) ** 2 < 1 << 62:
            y = self.n * z - np.array(self.rest, np.int64)
        else:
            y = self.n * z.astype(object) - np.array(self.rest, object)
        return [int(v) if v < 1 << 63 else None for v in (y * y).sum(axis=1).tolist()]


def _products(bases: dict[int, Basis]):
    """By length, sums of whitened values and of their products over the rows of a task."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                w = bases[x.shape[1]].whitened(x)
                w = np.c_[w, np.ones(len(w))]
                sums[x.shape[1]] = sums.get(x.shape[1], 0) + w.T @ w
        rows = [(d, i, j, float(s[i, j])) for d, s in sums.items() for i in range(len(s)) for j in range(len(s))]
        kinds = pa.int32(), pa.int32(), pa.int32(), pa.float64()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["dim", "i", "j", "v"])

    return task


def _rows_out(bases: dict[int, Basis]):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id")
            for rows, x in _matrices(batch):
                b = bases[x.shape[1]]
                w, k = b.whitened(x), len(b.values)
                dead = np.tile(~b.live, len(x))
                cols = [
                    ids.take(pa.array(np.repeat(rows, k))),
                    np.tile(np.arange(1, k + 1, dtype=np.int32), len(x)),
                    np.full(k * len(x), b.n),
                    pa.array(b.deviation(x), pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k))),
                    pa.array(w.ravel(), pa.float64(), mask=dead),
                    np.tile(b.explained, len(x)),
                    pa.array([b.identity_error] * (k * len(x)), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return task


def fitted(fit: DataFrame, most: int = COMPONENTS) -> dict[int, Basis]:
    """The basis for each length of vector in `fit` (x array<long>, saved, each vector once).

    Tasks emit one row for each dimension, then for each pair, and Spark adds them; for d dimensions the driver gets d sums and
    d (d + 1) / 2 squares, however many rows there are. So d is bounded by what eigh can take in one process.
    """
    totals: dict[int, dict[int, int]] = {}
    count: dict[int, int] = {}
    add = [F.sum(c).alias(c) for c in ("n", *LIMBS)]
    for row in fit.mapInArrow(_totals, _SUMS).groupBy("dim", "i", "j").agg(*add).collect():
        totals.setdefault(row["dim"], {})[row["i"]] = _value(row)
        count[row["dim"]] = row["n"]
    sums = {d: [t[i] for i in range(d)] for d, t in totals.items()}
    means = {d: [s // count[d] for s in t] for d, t in sums.items()}
    squares: dict[int, dict[tuple[int, int], int]] = {d: {} for d in sums}
    for row in fit.mapInArrow(_variances(means), _SUMS).groupBy("dim", "i", "j").agg(*add).collect():
        squares[row["dim"]][row["i"], row["j"]] = _value(row)
    bases = {d: Basis(count[d], sums[d], squares[d], most) for d in sums}
    found = {d: np.zeros((len(b.values) + 1,) * 2) for d, b in bases.items()}
    for row in fit.mapInArrow(_products(bases), "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).collect():
        found[row["dim"]][row["i"], row["j"]] = row["v"]
    for d, b in bases.items():
        k, mean = len(b.values), found[d][:-1, -1] / b.n
        gap = np.abs(found[d][:k, :k] / b.n - np.outer(mean, mean) - np.eye(k))[np.ix_(b.live, b.live)]
        b.identity_error = float(gap.max()) if gap.size else None
    return bases


def whitened_embeddings(df: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """For each row of `df` (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null or holds a null or non-finite entry go; an empty vector has no components. Entries are
    taken as doubles and become whole numbers, those beyond a long the nearest long. The fit list holds each vector once,
    so copies don't weigh more, but every row gets its rows of output; rows that repeat a vec_id, or have none, too.
    Vectors of each length are a list of their own. Components are numbered by falling eigenvalue; ties are in eigh's
    order. A component without variance (a share of the trace of LEAST_SHARE or less, all of them where the list has one
    vector) has a null whitened value and stays out of identity_error, which is null if none is left. A deviation beyond
    a long is null. An empty table gives no rows. Other columns are not read.
    """
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(F.least(F.greatest(c * SCALE, F.lit(-9.2e18)), F.lit(9.2e18))) + SHIFT)
    odd = F.exists(F.col("embedding").cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.filter(F.col("embedding").isNotNull() & ~odd).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    fit = saved(rows.select("x").distinct())
    return rows.mapInArrow(_rows_out(fitted(fit, most)), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
