"""Embedding whitening: covariance by tasks, eigenvectors by tridiagonal bisection, projection by broadcast.

1. One pass gives the exact number of vectors and sums per dimension.  A second one centres the vectors on the mean and gives
   each task's centred products; they are added up in two levels of groups, one group a matrix row.
2. The covariance (dimensions squared; its size does not depend on the rows) is made tridiagonal by Householder reflections.
   Sturm counts bisect for its leading eigenvalues; inverse iteration gives their vectors, reorthogonalised within clusters.
3. The components go to all tasks, which project their rows; the error of the result is measured on the projected rows.

Entries become long x = floor(SCALE * c) + SHIFT, so that sums and deviations are exact integers.

Cases: vectors that are null or have null or non-finite entries, or an x beyond 62 bits, are dropped; so are vectors of
another length than the most common one (ties: the longer).  A null id stays null, repeated rows stay, other columns are
ignored, whatever their names.  Components whose eigenvalue is zero up to rounding are not returned: equal vectors, a single
one, empty vectors or an empty table give no rows.  Tied eigenvalues: any orthonormal vectors of their space, the same for
all rows.  The sign makes the entry of largest size positive.  A deviation beyond 38 digits is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyscope.llm.common import small_batches, stage

SCALE, SHIFT = 1024, 100000  # fixed values of the contract
COMPONENTS = 8
LOW = 32  # sums are carried as high and low parts of this many bits
CLUSTER = 1e-3  # eigenvalues closer than this share of the matrix norm are reorthogonalised
EPS = np.finfo(np.float64).eps


# --- the eigenproblem of one symmetric matrix


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """(diagonal, off-diagonal, reflectors) of a symmetric matrix, by Householder reflections."""
    a, reflectors = np.array(matrix, np.float64), []
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        if not np.any(x[1:]):
            reflectors.append(None)
            continue
        alpha = -math.copysign(float(np.linalg.norm(x)), x[0])
        x[0] -= alpha
        u = x / np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ u
        q = p - u * (u @ p)
        a[k + 1 :, k + 1 :] -= 2 * (np.outer(u, q) + np.outer(q, u))
        a[k + 1, k] = alpha
        reflectors.append(u)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def below(diagonal: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie under each of the values `at`: negative terms of the Sturm sequence."""
    least = np.finfo(np.float64).tiny * max(1.0, float((off * off).max(initial=0.0)))
    q = diagonal[0] - at
    count = np.zeros(len(at), np.int64)
    for i in range(len(diagonal)):
        if i:
            q = diagonal[i] - at - off[i - 1] ** 2 / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, by bisection to the last bits."""
    radius = np.r_[0.0, np.abs(off)] + np.r_[np.abs(off), 0.0]
    width = float((np.abs(diagonal) + radius).max()) * (1 + 4 * EPS)
    lo, hi = np.full(k, -width), np.full(k, width)
    wanted = len(diagonal) - np.arange(k)  # more than this many below x: the eigenvalue is below x
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if np.all((mid <= lo) | (mid >= hi) | (hi - lo <= EPS * EPS * width)):
            break
        under = below(diagonal, off, mid) >= wanted
        lo, hi = np.where(under, lo, mid), np.where(under, mid, hi)
    return 0.5 * (lo + hi)


class Shifted:
    """T - value * I as triangular factors with row exchanges; `solve` divides by it."""

    def __init__(self, diagonal: np.ndarray, off: np.ndarray, value: float, norm: float):
        d, u, v = (diagonal - value).tolist(), [*off.tolist(), 0.0], [0.0] * len(diagonal)
        sub, self.swaps, self.factors = off.tolist(), [], []
        for i in range(len(d) - 1):
            swap = abs(sub[i]) > abs(d[i])
            if swap:  # row i and the one below change places
                d[i], u[i], v[i], here = sub[i], d[i + 1], u[i + 1], (d[i], u[i])
                factor = here[0] / d[i]
                d[i + 1], u[i + 1] = here[1] - factor * u[i], -factor * v[i]
            else:
                factor = sub[i] / d[i] if d[i] else 0.0
                d[i + 1] -= factor * u[i]
            self.swaps.append(swap)
            self.factors.append(factor)
        least = EPS * norm or EPS
        self.d, self.u, self.v = [x if abs(x) > least else math.copysign(least, x) for x in d], u, v

    def solve(self, right: np.ndarray) -> np.ndarray:
        y, n = right.tolist(), len(right)
        for i in range(n - 1):
            if self.swaps[i]:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= self.factors[i] * y[i]
        for i in range(n - 1, -1, -1):
            s = y[i]
            if i + 1 < n:
                s -= self.u[i] * y[i + 1]
            if i + 2 < n:
                s -= self.v[i] * y[i + 2]
            y[i] = s / self.d[i]
        return np.array(y)


def inverse_iteration(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of the tridiagonal matrix for falling eigenvalues."""
    n = len(diagonal)
    norm = float(np.abs(diagonal).max() + 2 * np.abs(off).max(initial=0.0))
    rng, out, first = np.random.default_rng(0), np.zeros((n, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            first = j
        # Equal eigenvalues get shifts a few last bits apart, else their factors are the same.
        factors = Shifted(diagonal, off, float(value) - (j - first) * 4 * EPS * norm, norm)
        y = rng.standard_normal(n)
        for _ in range(6):
            y = factors.solve(y / np.abs(y).max())
            for _ in range(2):
                y -= out[:, first:j] @ (out[:, first:j].T @ y)
            y /= np.linalg.norm(y)
        out[:, j] = y
    return out


def eigenpairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values falling, unit vectors as columns): the up to k leading pairs whose value is above rounding."""
    n, size = len(matrix), float(np.abs(matrix).max(initial=0.0))
    if not n or not size:
        return np.zeros(0), np.zeros((n, 0))
    diagonal, off, reflectors = tridiagonal(matrix / size)
    values = leading(diagonal, off, min(k, n))
    values = values[values > 4 * n * EPS * max(values[0], 0.0)]
    vectors = inverse_iteration(diagonal, off, values)
    for i in range(len(reflectors) - 1, -1, -1):
        if reflectors[i] is not None:
            u = reflectors[i]
            vectors[i + 1 :] -= 2 * np.outer(u, u @ vectors[i + 1 :])
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return values * size, vectors * np.sign(largest)


# --- over the rows


@dataclass
class Fit:
    """What the vectors of the fit list give: their number, sums, residual mean and covariance."""

    n: int
    sums: list[int]
    covariance: np.ndarray

    @property
    def whole(self) -> np.ndarray:
        """The means, rounded down."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """sums - n * whole, from 0 up to n."""
        return np.array([s % self.n for s in self.sums], np.int64)


def entries(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per length of the vectors in a batch: (their places, x as a matrix of longs), without vectors that are dropped."""
    vectors = vectors.cast(pa.list_(vectors.type.value_type)) if not pa.types.is_list(vectors.type) else vectors
    flat = vectors.flatten()
    c = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    bad = ~np.isfinite(c)
    x = np.floor(np.where(bad, 0.0, c) * SCALE)
    bad |= np.abs(x) >= 2.0**62
    x = np.where(bad, 0.0, x).astype(np.int64) + SHIFT
    sizes = np.array(vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False), np.int64)
    starts = np.r_[0, np.cumsum(np.maximum(sizes, 0))]
    faults = np.r_[0, np.cumsum(bad)]
    good = (sizes >= 0) & (faults[starts[1:]] == faults[starts[:-1]])
    for length in np.unique(sizes[good]):
        at = np.flatnonzero(good & (sizes == length))
        yield at, x[starts[at][:, None] + np.arange(length)[None, :]]


def sums_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[int, list] = {}
    for b in batches:
        for _, x in entries(b.column(0)):
            now = seen.setdefault(x.shape[1], [0, 0, 0])
            now[0] += len(x)
            now[1] = now[1] + (x >> LOW).sum(axis=0)
            now[2] = now[2] + (x & ((1 << LOW) - 1)).sum(axis=0)
    if seen:
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.int32()), pa.array([v[0] for v in seen.values()], pa.int64()),
             *[pa.array([v[i].tolist() for v in seen.values()], longs) for i in (1, 2)]], names=["length", "n", "high", "low"])


def products_of_task(fit: Fit):
    """The task's centred products: row i of the upper triangle, once per task."""
    d, whole, share = len(fit.sums), fit.whole, fit.rest / fit.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, some = np.zeros((d, d)), False
        for b in batches:
            for _, x in entries(b.column(0)):
                if x.shape[1] == d:
                    y = (x - whole) - share
                    total += y.T @ y
                    some = True
        if some:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(d), pa.int32()), pa.array([task] * d, pa.int32()), pa.array([total[i, i:] for i in range(d)], pa.list_(pa.float64()))],
                names=["i", "task", "products"])

    return run


def added(parts: DataFrame, *by: str) -> DataFrame:
    """The arrays of each group added up entry by entry."""

    def add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        arrays = rows.column("products").combine_chunks()
        total = arrays.flatten().to_numpy(zero_copy_only=False).reshape(len(arrays), -1).sum(axis=0)
        return pa.Table.from_arrays([*[pa.array([k.as_py()], pa.int32()) for k in key], pa.array([total], pa.list_(pa.float64()))], names=[*by, "products"])

    return parts.groupBy(*by).applyInArrow(add, ", ".join(f"{c} int" for c in by) + ", products array<double>")


def fitted(vectors: DataFrame) -> Fit | None:
    """vectors: one column of arrays.  None if no vector remains."""
    parts = stage(vectors.mapInArrow(sums_of_task, "length int, n long, high array<long>, low array<long>"), "vector-sums")
    top = parts.groupBy("length").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if top is None or not top["length"]:
        return None
    d, n = top["length"], top["n"]
    both = parts.filter(F.col("length") == d).select(F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    both = both.groupBy("i").agg(F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
    sums = [(r["high"] << LOW) + r["low"] for r in sorted(both.collect(), key=lambda r: r["i"])]
    fit = Fit(n, sums, np.zeros((d, d)))
    tasks = vectors.mapInArrow(products_of_task(fit), "i int, task int, products array<double>")
    tasks = stage(tasks, "vector-products")
    fan = math.isqrt(tasks.agg(F.countDistinct("task")).first()[0]) + 1  # each level of adding has about the root of the number of tasks in a group
    once = added(tasks.select("i", (F.col("task") % fan).alias("part"), "products"), "i", "part").drop("part")
    for r in added(once, "i").collect():
        fit.covariance[r["i"], r["i"] :] = fit.covariance[r["i"] :, r["i"]] = np.array(r["products"]) / n
    return fit


def projected_rows(fit: Fit, project: np.ndarray, keep: T.StructType):
    """Per row of the fit list: its id, exact deviation and whitened entries."""
    d, n, whole, rest = len(fit.sums), fit.n, fit.whole, fit.rest
    share, squares = rest / n, sum(int(r) ** 2 for r in rest)
    id_type = pa.int64() if keep["id"].dataType == T.LongType() else None

    def deviations(y: np.ndarray) -> list[int | None]:
        # n * x - S = n * y - rest, and y is small
        most = int(np.abs(y).max(initial=0))
        safe = most * most * d < 2**62 and most * n * d < 2**62
        wide = y if safe else y.astype(object)
        a, b = (wide * wide).sum(axis=1).tolist(), (wide @ (rest if safe else rest.astype(object))).tolist()
        out = [n * n * s - 2 * n * t + squares for s, t in zip(a, b)]
        return [v if v < 10**38 else None for v in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in entries(b.column(1)):
                if x.shape[1] == d:
                    y = x - whole
                    w = (y - share) @ project
                    ids = b.column(0).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [ids if id_type is None else ids.cast(id_type), pa.array(deviations(y), pa.decimal128(38, 0)), pa.array(list(w), pa.list_(pa.float64()))],
                        names=["id", "deviation", "whitened"])

    return run


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of `whitened` minus the identity, measured on the rows."""
    w = [F.col("whitened")[i] for i in range(k)]
    mean = rows.agg(*[(F.sum(c) / n).alias(f"m{i}") for i, c in enumerate(w)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = rows.agg(*[(F.sum((w[i] - F.lit(mean[i])) * (w[j] - F.lit(mean[j]))) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(cov[x] - (i == j)) for x, (i, j) in enumerate(pairs))


OUT = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(df: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: the id (under its name), component, n, deviation, whitened, explained, identity_error."""
    spark: SparkSession = df.sparkSession
    small_batches(spark)
    inner = df.schema[vector_column].dataType.elementType
    vector = F.col(vector_column) if inner in (T.FloatType(), T.DoubleType()) else F.col(vector_column).cast("array<double>")
    both = df.select(F.col(id_column).alias("id"), vector.alias("vector"))
    fit = fitted(both.select("vector"))
    values, vectors = (np.zeros(0), None) if fit is None else eigenpairs(fit.covariance, components)
    if not len(values):
        return df.select(F.col(id_column)).limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in OUT.split(", "))])
    keep = T.StructType([T.StructField("id", df.schema[id_column].dataType), T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    rows = stage(both.mapInArrow(projected_rows(fit, vectors / np.sqrt(values), keep), keep), "whitened")
    error = identity_error(rows, fit.n, len(values))
    shares = F.array(*[F.lit(float(v)) for v in values / np.trace(fit.covariance)])
    long = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "value"))
    return long.select(
        F.col("id").alias(id_column), (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation",
        F.col("value").alias("whitened"), shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
