"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers x. The scatter of the distinct vectors is summed exactly: vectors are first
centred at the whole number next to their mean, products of those small numbers are summed by matrix
products that cannot round, and what the rest of the mean takes away is subtracted in whole numbers. So
the covariance is the true one, rounded once, whatever the order in which tasks end.

The scatter of d dimensions (d x d numbers, the model) is factored on the driver: pivoted Cholesky gives
a triangle L with L L' the scatter, one-sided Jacobi rotates the columns of L until they are orthogonal.
Their squared norms are then the eigenvalues and the normalised columns the components. All rows are
read, centred, projected and scaled in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalgrid.session import cut_lineage

SCALE, OFFSET, LARGEST = 64, 1_000_000, float(1 << 40)
_EXACT = 1 << 53


@dataclass(frozen=True)
class Whitening:
    """``total`` / ``n`` is the mean; column i of ``components`` has the variance ``variances[i]``."""

    n: int
    total: np.ndarray
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of whole-number vectors."""
        return (self.residual(x).astype(np.float64) / self.n) @ (self.components / np.sqrt(self.variances))

    def residual(self, x: np.ndarray) -> np.ndarray:
        """n * x - total, in whole numbers of whatever size they need."""
        reach = max(abs(int(v)) for v in (*x.max(axis=0), *x.min(axis=0))) if len(x) else 0
        if self.n * reach + max(abs(int(t)) for t in self.total) < 1 << 62:
            return self.n * x - self.total.astype(np.int64)
        return self.n * x.astype(object) - self.total

    def deviation(self, x: np.ndarray) -> list[int] | np.ndarray:
        """Sum of the squares of the residual, exact."""
        r = self.residual(x)
        largest = int(np.abs(r).max()) if r.size else 0
        if largest * largest * x.shape[1] < 1 << 62:
            return (r * r).sum(axis=1)
        r = r.astype(object)
        return (r * r).sum(axis=1)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L, rows in the order of ``a``, with L L' = a; as many columns as ``a`` has rank, the largest pivot first."""
    d = len(a)
    factor, rest = np.zeros((d, d)), a.diagonal().astype(np.float64)
    least = rest.max(initial=0.0) * d * np.finfo(np.float64).eps
    todo = np.ones(d, dtype=bool)
    for k in range(d):
        p = int(np.where(todo, rest, -np.inf).argmax())
        if not (todo[p] and rest[p] > least):
            return factor[:, :k]
        column = np.where(todo, a[:, p] - factor[:, :k] @ factor[p, :k], 0.0)
        factor[:, k] = column / np.sqrt(column[p])
        rest = rest - factor[:, k] ** 2
        todo[p] = False
    return factor


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of L L', falling, and its unit eigenvectors: the columns of L rotated pairwise until orthogonal.

    A sweep meets every pair of columns once; the pairs of one step share no column and turn together.
    """
    work = factor.copy()
    r = work.shape[1]
    seats = np.arange(r + r % 2)
    tight = np.finfo(np.float64).eps * max(1, np.sqrt(len(factor)))
    for _ in range(sweeps if r > 1 else 0):
        worst = 0.0
        for _ in range(len(seats) - 1):
            left, right = seats[: len(seats) // 2], seats[::-1][: len(seats) // 2]
            real = (left < r) & (right < r)
            i, j = left[real], right[real]
            x, y = work[:, i], work[:, j]
            xx, yy, xy = (x * x).sum(axis=0), (y * y).sum(axis=0), (x * y).sum(axis=0)
            size = np.sqrt(xx * yy)
            turn = np.abs(xy) > tight * size
            worst = max(worst, float((np.abs(xy) / np.where(size > 0, size, 1.0)).max(initial=0.0)))
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                zeta = (yy - xx) / (2.0 * xy)
                tangent = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            tangent = np.where(turn, tangent, 0.0)
            cosine = 1.0 / np.hypot(1.0, tangent)
            work[:, i], work[:, j] = cosine * (x - tangent * y), cosine * (tangent * x + y)
            seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]
        if worst <= tight:
            break
    norms = np.sqrt((work * work).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, work[:, order] / norms[order]


def whole_numbers(vector: Column) -> Column:
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * SCALE) + OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    """Neither NULL nor empty, every entry there, finite and within ``LARGEST`` / 64."""
    number = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST / SCALE))
    return F.coalesce((F.size(vector) > 0) & number, F.lit(False))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _halves(values: np.ndarray) -> list[pa.Array]:
    """Whole numbers as high * 2**32 + low: sums of either fit, whatever the sum itself needs."""
    flat = values.ravel().astype(object) if values.dtype == object else values.ravel()
    return [pa.array([int(v) >> 32 for v in flat], type=pa.int64()), pa.array([int(v) & 0xFFFFFFFF for v in flat], type=pa.int64())]


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y of whole numbers without rounding: blocks of rows whose sums a double holds, else Python numbers."""
    largest = int(np.abs(y).max()) if y.size else 0
    rows = _EXACT // max(1, largest * largest)
    if not rows:
        y = y.astype(object)
        return y.T @ y
    total = np.zeros((y.shape[1], y.shape[1]), dtype=object if len(y) > rows * 512 else np.int64)
    for at in range(0, len(y), rows):
        part = y[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def _summed(fit: DataFrame, entries: int, of: str, part) -> list[int]:
    """Sums of whole numbers over all rows: ``part`` turns a batch's matrix into ``entries`` of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = part(batch.column(0)).astype(object)
            held = new if held is None else held + new
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(entries), type=pa.int32()), *_halves(held)], names=["at", "high", "low"])

    sums = fit.select(of).mapInArrow(run, "at int, high long, low long").groupBy("at").agg(
        F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum("low").alias("low"))
    out = [0] * entries
    for row in sums.collect():
        out[row["at"]] = int(row["high"]) * (1 << 32) + row["low"]
    return out


def fit_whitening(fit: DataFrame, d: int, components: int, of: str = "x") -> Whitening | None:
    """The whitening of the rows of ``fit`` (arrays of ``d`` whole numbers), or None without rows."""
    counted = _summed(fit, d + 1, of, lambda c: np.r_[_matrix(c, d).astype(object).sum(axis=0), len(c)])
    *total, n = counted
    if not n:
        return None
    centre = [int(t) // n for t in total]
    base = np.array(centre, dtype=np.int64)
    products = np.array(_summed(fit, d * d, of, lambda c: exact_products(_matrix(c, d) - base)), dtype=object).reshape(d, d)
    left = np.array([t - n * c for t, c in zip(total, centre, strict=True)], dtype=object)  # n * (mean - centre)
    scatter = n * products - np.outer(left, left)  # n times the centred scatter, exact
    covariance = np.array([[float(Fraction(int(v), n * n)) for v in row] for row in scatter])
    trace = float(Fraction(int(sum(scatter.diagonal())), n * n))
    variances, axes = one_sided_jacobi(pivoted_cholesky(covariance))
    return Whitening(n, np.array(total, dtype=object), axes[:, :components], variances[:components], trace)


def identity_error(fit: DataFrame, model: Whitening, d: int, of: str = "x") -> float:
    """Largest entry, as an amount, of the covariance of the whitened rows less the identity."""
    k = len(model.variances)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = np.zeros((k, k))
        for batch in batches:
            part = model.project(_matrix(batch.column(0), d))
            z += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), type=pa.int32()), pa.array(z.ravel())], names=["at", "z"])

    sums = {r["at"]: r["z"] for r in fit.select(of).mapInArrow(run, "at int, z double").groupBy("at").agg(F.sum("z").alias("z")).collect()}
    return max(abs(sums.get(i, 0.0) / model.n - (1.0 if i // k == i % k else 0.0)) for i in range(k * k))


def whiten(df: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = 16) -> DataFrame:
    """``keep`` columns of each row with a usable vector, and for each component (numbered from 1) n,
    deviation (decimal), whitened, explained and identity_error.

    NULL or empty vectors, and those with entries that are NULL, not finite or beyond 2**34, take no
    part; nor do vectors of another length than most (of equally many, the longer). Equal vectors count once in the fit and are all
    whitened. Components without variance are left out, so a table of one distinct vector, or an empty
    table, gives no rows. A kept column called like a result gives way to it.
    """
    results = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    kept = F.struct(*[c for c in keep if c not in results]).alias("kept")
    rows = df.select(kept, F.col(vector).alias("v")).where(usable(F.col("v"))).select("kept", whole_numbers(F.col("v")).alias("x"))
    schema = T.StructType([*rows.schema["kept"].dataType.fields] + [T.StructField(n, t) for n, t in zip(results, (
        T.IntegerType(), T.LongType(), T.DecimalType(38, 0), T.DoubleType(), T.DoubleType(), T.DoubleType()), strict=True)])
    usual = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if usual is None:
        return df.sparkSession.createDataFrame([], schema)
    d = usual["d"]
    rows = rows.where(F.size("x") == d)
    fit = cut_lineage(rows.select("x").distinct())
    model = fit_whitening(fit, d, components)
    error = identity_error(fit, model, d)
    k = len(model.variances)
    explained = model.variances / model.trace if model.trace else model.variances
    names = rows.schema["kept"].dataType.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            n = len(x)
            at = pa.array(np.repeat(np.arange(n), k))
            deviation = pa.array([int(v) for v in model.deviation(x)], type=pa.decimal128(38, 0)).take(at)
            yield pa.RecordBatch.from_arrays(
                [c.take(at) for c in batch.column(0).flatten()] + [
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n, dtype=np.int64)), deviation,
                    pa.array(model.project(x).ravel()), pa.array(np.tile(explained, n)), pa.array(np.full(n * k, error))],
                names=[*names, *results])

    return rows.mapInArrow(run, schema)
