"""Operator 12: whitening by eigenvectors of a distributed covariance, refined to double precision.

Entries become integers, so the sums behind mean and covariance are exact in any order: rows are
centred on the nearest whole numbers to the mean before they are multiplied, and what remains of
the mean, below one half per dimension, is taken off as an exact fraction.  Eigenvectors of the
covariance in float32 are the start; Ogita and Aishima's iteration corrects them by matrix products
in extended precision ("Iterative refinement for symmetric eigenvalue decomposition", parts I and
II).  Eigenvalues too close for the iteration are told apart by a sub-solve: the matrix, shifted by
their mean and projected on their vectors, is small, so its own eigenvectors are found accurately.

What the driver holds has the size of the covariance: the square of the dimension.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from resurvey.llm.base import only, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Entries beyond this size (64 times the value) cannot take part in exact sums; their rows are dropped.
LARGEST = float(1 << 40)
# Numbers below this bound are multiplied by the float library: sums of 2^13 products stay exact.
SMALL, ROWS_AT_ONCE = 1 << 20, 1 << 13
# Sums are sent as two longs: multiples of 2^62 and the rest.
HALF = 62
# An eigenvalue below this share of the largest is zero: its component cannot be scaled.
ZERO_SHARE = 1e-14
SWEEPS = 40
# Sweeps without a smaller error after which they end; a cluster that comes apart may raise it once.
PATIENCE = 3
Wide = np.longdouble


def quantized(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """id, x: whole numbers floor(64 * entry) + 1000000 of rows whose entries are all finite."""
    v = F.col(vector)

    def unfit(c: Column) -> Column:
        wide = c.cast("double") * SCALE
        return wide.isNull() | F.isnan(wide) | (F.abs(wide) > LARGEST)

    x = F.transform(v, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))
    kept = only(rows, key, vector).where(v.isNotNull() & ~F.exists(v, unfit) & (F.size(v) > 0))
    return kept.select(F.col(f"`{key}`").alias("id"), x.alias("x"))


def matrix_of(column: pa.Array, d: int) -> np.ndarray:
    """The lists of a column, all of length ``d``, as a matrix of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def gram(z: np.ndarray) -> np.ndarray:
    """Exact sum of the outer products of the rows, as Python integers or longs."""
    if not len(z) or np.abs(z).max() < SMALL:
        f = z.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    wide = z.astype(object)
    return wide.T @ wide


def _halves(values: Iterable[int]) -> tuple[list[int], list[int]]:
    values = [int(v) for v in values]
    return [v >> HALF for v in values], [v & ((1 << HALF) - 1) for v in values]


def _summed(df: DataFrame, size: int) -> list[int]:
    """Totals of rows (cell, hi, lo), one per cell, as exact integers; ``size`` rows at most."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).cast("string").alias(c)
    total = [0] * size
    for r in df.groupBy("cell").agg(wide("hi"), wide("lo")).collect():
        total[r["cell"]] = (int(r["hi"]) << HALF) + int(r["lo"])
    return total


def sums_of(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of fit rows and the exact sums of their entries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        n, total = 0, np.zeros(d, object)
        for batch in batches:
            x = matrix_of(batch.column(0), d)
            n += len(x)
            # in two parts, so that no sum of a batch leaves the range of a long
            total = total + ((x >> 20).sum(0).astype(object) << 20) + (x & ((1 << 20) - 1)).sum(0).astype(object)
        hi, lo = _halves([*total, n])
        yield pa.record_batch([pa.array(np.arange(d + 1, dtype=np.int32)), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["cell", "hi", "lo"])

    *total, n = _summed(fit.select("x").mapInArrow(run, "cell int, hi long, lo long"), d + 1)
    return n, total


def products_of(fit: DataFrame, middle: np.ndarray) -> list[int]:
    """Exact sums of products of the entries, less ``middle``; upper triangle, row by row."""
    d = len(middle)
    upper = np.triu_indices(d)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(len(upper[0]), object)
        for batch in batches:
            z = matrix_of(batch.column(0), d) - middle
            for start in range(0, len(z), ROWS_AT_ONCE):
                total = total + gram(z[start : start + ROWS_AT_ONCE])[upper].astype(object)
        hi, lo = _halves(total)
        yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["cell", "hi", "lo"])

    return _summed(fit.select("x").mapInArrow(run, "cell int, hi long, lo long"), len(upper[0]))


def _wide(value: int) -> np.longdouble:
    """An integer of any size in extended precision."""
    out, sign, value = Wide(0), -1 if value < 0 else 1, abs(value)
    shift = max(0, value.bit_length() - 96)
    value >>= shift
    for part in (value >> 64, (value >> 32) & 0xFFFFFFFF, value & 0xFFFFFFFF):
        out = out * Wide(4294967296.0) + Wide(part)
    return sign * np.ldexp(out, shift)


def covariance(n: int, rest: list[int], products: list[int]) -> np.ndarray:
    """Covariance (divisor n) from sums of rows that are centred but for ``rest`` / n; exact, then rounded once."""
    d = len(rest)
    out = np.zeros((d, d), Wide)
    square = _wide(n * n)
    for i, j, p in zip(*np.triu_indices(d), products, strict=True):
        out[i, j] = out[j, i] = _wide(n * p - rest[i] * rest[j]) / square
    return out


def _clusters(values: np.ndarray, close: float) -> list[np.ndarray]:
    """Sets of places whose values, in order, differ by at most ``close`` from one to the next."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order]) > close) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix in extended precision."""
    d = len(a)
    size = np.abs(a).max() if d else Wide(0)
    if size == 0:
        return np.zeros(d, Wide), np.eye(d, dtype=Wide)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(Wide)
    one = np.eye(d, dtype=Wide)
    spread = np.sqrt((a * a).sum())
    best, last, idle = None, np.inf, 0
    for _ in range(SWEEPS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # else its rounding, over a small gap, costs orthogonality
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        error = float(np.sqrt((off * off).sum()) + np.sqrt((r * r).sum()))
        if error < last:
            best, last, idle = (values, x.copy()), error, 0
        else:
            idle += 1
        if idle > PATIENCE:  # what is left is rounding
            break
        close = 2 * (np.sqrt((off * off).sum()) + spread * np.sqrt((r * r).sum()))
        close = max(close, 64 * np.finfo(Wide).eps * spread)  # nearer ones differ by rounding only
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= close
        step = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, Wide(1), gap))
        x = x + x @ step
        for at in _clusters(values, float(close)):
            own = x[:, at]
            shift = values[at].mean()
            inner = own.T @ (a @ own - shift * own)
            scale = np.abs(inner).max()
            if scale > 0:
                turn = np.linalg.eigh(((inner + inner.T) / (2 * scale)).astype(np.float64))[1].astype(Wide)
                turn = turn @ (3 * np.eye(len(at), dtype=Wide) - turn.T @ turn) / 2  # orthogonal beyond double precision
                x[:, at] = own @ turn
    values, x = best
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(0))
    return values[order] * size, x


@dataclass
class Whitener:
    """``n`` fit rows with sums ``total``; ``projection`` has a column per component, scaled."""

    n: int
    total: list[int]
    middle: np.ndarray
    offset: np.ndarray  # the mean less ``middle``
    projection: np.ndarray
    explained: np.ndarray

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) - self.offset) @ self.projection

    def deviations(self, x: np.ndarray) -> list[int]:
        """Exact sums over the dimensions of (n * x - total) squared."""
        z = x - self.middle
        rest = [t - self.n * int(m) for t, m in zip(self.total, self.middle, strict=True)]
        largest, d = int(np.abs(z).max(initial=0)), max(1, len(rest))
        most = max([largest, *map(abs, rest)])
        # where longs may not hold the sums, Python's integers do
        z = z if largest * most * d < 1 << 62 else z.astype(object)
        square, cross = (z * z).sum(1), (z * np.array(rest, z.dtype)).sum(1)
        tail = sum(r * r for r in rest)
        return [self.n * (self.n * int(a) - 2 * int(b)) + tail for a, b in zip(square, cross, strict=True)]


def fit_whitener(fit: DataFrame, components: int) -> Whitener | None:
    """From the distinct rows (x), all of one length; None where no component has a spread."""
    first = fit.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    n, total = sums_of(fit, d)
    middle = np.array([(2 * t + n) // (2 * n) for t in total], np.int64)
    rest = [t - n * int(m) for t, m in zip(total, middle, strict=True)]
    cov = covariance(n, rest, products_of(fit, middle))
    values, vectors = eigen(cov)
    whole = np.trace(cov)
    k = int((values[:components] > ZERO_SHARE * values[0]).sum()) if whole > 0 else 0
    if not k:
        return None
    vectors = vectors[:, :k]
    # of the two signs, the one whose largest entry is positive
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1, 1)
    offset = np.array([_wide(r) / _wide(n) for r in rest], Wide).astype(np.float64)
    return Whitener(n, total, middle, offset, (vectors / np.sqrt(values[:k])).astype(np.float64), (values[:k] / whole).astype(np.float64))


def identity_error(fit: DataFrame, whitener: Whitener) -> float:
    """Largest absolute entry of (covariance of the whitened fit rows) - identity."""
    d, k = len(whitener.middle), len(whitener.explained)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        square, total = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = whitener.whiten(matrix_of(batch.column(0), d))
            square += w.T @ w
            total += w.sum(0)
        cells = np.concatenate((square.ravel(), total))
        yield pa.record_batch([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "v"])

    found = fit.select("x").mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    cells = np.zeros(k * k + k)
    cells[[r["cell"] for r in found]] = [r["v"] for r in found]
    mean = cells[k * k :] / whitener.n
    return float(np.abs(cells[: k * k].reshape(k, k) / whitener.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per row of ``rows`` and component: ``key``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries become whole numbers x = floor(64 * entry) + 1000000.  Each distinct vector x counts
    once in mean, covariance and eigenvectors; ``n`` is their number.  ``deviation`` (decimal) is the
    exact sum of (n * x - sums)^2; ``whitened`` is x less the mean on the component's unit
    eigenvector, over the root of its eigenvalue; ``explained`` is the eigenvalue's share of the
    trace; ``identity_error`` is one value, see above.

    Left out are rows whose vector is NULL, empty, or holds a NULL, a non-finite entry or one
    beyond 2^34, and rows whose vector has another length than most distinct vectors have (the
    shorter length on a tie).  Components without spread are not returned, so there are fewer of
    them than asked for where the rank is lower, and none for one distinct vector or an empty
    table.  Repeated rows and NULL keys keep their rows; equal eigenvalues have any orthogonal
    vectors of their space; other columns are not read.
    """
    kind = rows.schema[key].dataType.simpleString()
    out = f"id {kind}, component int, n long, deviation string, whitened double, explained double"
    x = quantized(rows, key, vector)
    fit = written(x.select("x").distinct(), "whiten-fit")
    lengths = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = lengths[0]["d"] if lengths else 0
    fit = fit.where(F.size("x") == d)
    whitener = fit_whitener(fit, components) if lengths else None
    error = identity_error(fit, whitener) if whitener else 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            if whitener is None or not len(batch):
                continue
            m = matrix_of(batch.column(1), d)
            w = whitener.whiten(m)
            k = w.shape[1]
            row = np.repeat(np.arange(len(m)), k)
            deviation = pa.array([str(v) for v in whitener.deviations(m)])
            yield pa.record_batch(
                [
                    batch.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(m))),
                    pa.array(np.full(len(row), whitener.n, np.int64)), deviation.take(pa.array(row)), pa.array(w.ravel()),
                    pa.array(np.tile(whitener.explained, len(m))),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained"],
            )

    found = x.where(F.size("x") == d).mapInArrow(run, out)
    return found.select(
        F.col("id").alias(key), "component", "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained",
        F.lit(error).alias("identity_error"),
    )
