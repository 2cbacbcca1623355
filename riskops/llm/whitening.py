"""Embedding whitening by spectrum slicing.

Entries become integers on a fixed grid, so sums and the scatter about the rounded mean are exact
and do not depend on how rows are dealt to tasks; tasks send one row for each dimension (or pair of
dimensions), which Spark adds up. The d x d covariance is the only thing that comes to the driver. There, the
inertia of LDL' factors of the shifted covariance (Bunch and Kaufman's pivots) counts the eigenvalues
below a shift. Halving by counts isolates each leading eigenvalue; Rayleigh quotient iteration from inside
its interval converges cubically, and two counts beside the result certify its number. Eigenvalues
that lie closer than ``CLUSTER`` are sliced as one group: their vectors come from iteration
on a block, orthogonalised against those before.

Defined cases: vectors that are null, hold null or non-finite entries, or entries whose grid value exceeds
2**40, take no part; of vectors of several lengths only those of the most frequent length do (ties: the longest).
Empty vectors, an empty table and a single row, which have no variance, give no rows, like components whose
eigenvalue is not above rounding (they cannot be scaled to 1). Repeated rows count as often as they
stand; null ids stay; other columns are ignored. ``deviation`` beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

#: Steps of the grid to 1, and its offset.
GRID, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Eigenvalues closer than this part of the largest are one group; below DEAD times the dimension they count as zero.
CLUSTER, DEAD = 1e-11, 2.0**-50
#: Largest grid value; rows of a batch that are multiplied at once.
MOST, BLOCK_ROWS = 2**40, 4096
BUNCH = (1 + 17**0.5) / 8


def factor(a: np.ndarray) -> tuple[list[tuple], int]:
    """LDL' of the symmetric ``a`` with pivots of one or two rows: the steps, and the number of negative eigenvalues."""
    a, n = a.copy(), len(a)
    steps, k, below = [], 0, 0
    scale = np.abs(a).max() if n else 0.0
    tiny = np.finfo(float).eps ** 2 * scale or np.finfo(float).tiny
    while k < n:
        size, swap = 1, k
        col = np.abs(a[k + 1 :, k])
        if len(col) and (most := col.max()) > tiny and abs(a[k, k]) < BUNCH * most:
            r = k + 1 + int(col.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            wide = row.max()
            if abs(a[k, k]) * wide >= BUNCH * most**2:
                pass
            elif abs(a[r, r]) >= BUNCH * wide:
                swap = r
            else:
                size, swap = 2, r
        at = k + size - 1
        if swap != at:
            a[[at, swap]] = a[[swap, at]]
            a[:, [at, swap]] = a[:, [swap, at]]
        d = a[k : k + size, k : k + size].copy()
        if size == 1:
            d[0, 0] = d[0, 0] if abs(d[0, 0]) > tiny else tiny  # an eigenvalue at the shift itself counts as above it
            below += d[0, 0] < 0
        else:
            below += 1  # such a block has one eigenvalue of each sign
        low = a[k + size :, k : k + size] @ np.linalg.inv(d)
        update = low @ a[k + size :, k : k + size].T
        a[k + size :, k + size :] -= (update + update.T) / 2  # symmetric to the last bit
        steps.append((k, size, swap, d, low))
        k += size
    return steps, below


def solve(steps: list[tuple], b: np.ndarray) -> np.ndarray:
    """The solution of the factored system."""
    x = b.astype(float).copy()
    for k, size, swap, _, low in steps:
        at = k + size - 1
        x[[at, swap]] = x[[swap, at]]
        x[k + size :] -= low @ x[k : k + size]
    for k, size, _, d, _ in steps:
        x[k : k + size] = np.linalg.solve(d, x[k : k + size])
    for k, size, swap, _, low in reversed(steps):
        x[k : k + size] -= low.T @ x[k + size :]
        at = k + size - 1
        x[[at, swap]] = x[[swap, at]]
    return x


class Spectrum:
    """The leading eigenpairs of a symmetric positive semi-definite matrix."""

    def __init__(self, v: np.ndarray):
        self.v, self.n = v, len(v)
        self.top = float(np.abs(v).sum(axis=1).max()) if len(v) else 0.0  # no eigenvalue is larger
        self.counts: dict[float, int] = {self.top * (1 + 1e-9): 0}

    def above(self, shift: float) -> int:
        """How many eigenvalues exceed ``shift``, by the inertia of V - shift I."""
        if shift not in self.counts:
            self.counts[shift] = self.n - factor(self.v - shift * np.eye(self.n))[1]
        return self.counts[shift]

    def slice(self, number: int, low: float) -> tuple[float, float, int]:
        """(a, b, how many): an interval whose eigenvalues are the ``number``-th largest and, if it cannot be isolated, its close neighbours.

        ``low`` is a shift with at least ``number`` eigenvalues above.
        """
        a = max((s for s, c in self.counts.items() if c >= number), default=low)
        b = min(s for s, c in self.counts.items() if c < number)
        while b - a > CLUSTER * self.top:
            if self.above(a) - self.above(b) == 1:
                break
            mid = (a + b) / 2
            if self.above(mid) >= number:
                a = mid
            else:
                b = mid
        return a, b, self.above(a) - self.above(b)

    def alone(self, number: int, a: float, b: float, known: np.ndarray) -> tuple[float, np.ndarray]:
        """The one eigenpair with its value in (a, b), by Rayleigh quotient iteration.

        If the quotient leaves the interval, a count halves the interval and the iteration starts from its middle.
        """
        while True:
            x = np.cos(np.arange(1, self.n + 1) * (number + 0.5))  # any start that is not orthogonal to the vector
            shift, best = (a + b) / 2, np.inf
            for k in range(24):
                x = x - known.T @ (known @ x)
                x = solve(factor(self.v - shift * np.eye(self.n))[0], x / np.linalg.norm(x))
                x /= np.linalg.norm(x)
                value = float(x @ self.v @ x)
                rest = float(np.linalg.norm(self.v @ x - value * x))
                if rest >= best / 2 and best < 1e-13 * self.top:
                    break
                best = min(best, rest)
                if k >= 2:  # the first steps hold the shift, which draws the vector to the interval
                    shift = value
            if a <= value <= b and best <= 1e-12 * self.top and self.certified(number, value):
                return value, x
            mid = (a + b) / 2
            if not a < mid < b:
                raise ArithmeticError("an eigenvalue could not be isolated")
            if self.above(mid) >= number:
                a = mid
            else:
                b = mid

    def certified(self, number: int, value: float) -> bool:
        """Counts just beside ``value`` say that it is the ``number``-th largest."""
        gap = CLUSTER / 4 * self.top
        return self.above(value - gap) >= number > self.above(value + gap)

    def group(self, number: int, many: int, a: float, b: float, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``many`` eigenpairs that counts cannot part, by inverse iteration on a block."""
        x = np.cos(np.outer(np.arange(1, self.n + 1), np.arange(number, number + many) + 0.5))
        steps = factor(self.v - ((a + b) / 2 + CLUSTER / 7 * self.top) * np.eye(self.n))[0]
        for _ in range(8):
            x = x - known.T @ (known @ x)
            x = np.linalg.qr(solve(steps, np.linalg.qr(x)[0]))[0]
        x = np.linalg.qr(x - known.T @ (known @ x))[0]
        values, turn = np.linalg.eigh(x.T @ self.v @ x)  # many x many: an order within the group
        return values[::-1], (x @ turn[:, ::-1]).T

    def leading(self, many: int) -> tuple[np.ndarray, np.ndarray]:
        """The largest eigenvalues above rounding, at most ``many``, and their unit vectors as rows."""
        values, vectors = np.zeros(0), np.zeros((0, self.n))
        dead = DEAD * self.n * self.top
        if not self.top:
            return values, vectors
        many = min(many, self.above(dead))
        while len(values) < many:
            number = len(values) + 1
            a, b, held = self.slice(number, dead)
            if held == 1:
                value, x = self.alone(number, a, b, vectors)
                x = x - vectors.T @ (vectors @ x)
                values, vectors = np.append(values, value), np.vstack([vectors, x / np.linalg.norm(x)])
            else:
                v, x = self.group(number, held, a, b, vectors)
                values, vectors = np.append(values, v), np.vstack([vectors, x])
        return values[:many], vectors[:many]


def grid(vector: str, step: int = GRID, offset: int = OFFSET) -> Column:
    """The entries as whole numbers, or null where a vector takes no part."""
    v = F.col(vector)
    whole = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) <= MOST // step, F.lit(False)))  # false for NaN and infinities also
    return F.when(whole, F.transform(v, lambda c: (F.floor(c.cast("double") * step) + offset).cast("long")))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def scatter(rows: DataFrame, mean: np.ndarray) -> list[list[int]]:
    """Exact sums of products of ``x`` - ``mean`` (whole numbers), d x d Python integers."""
    d = len(mean)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = np.zeros((d, d), object), np.zeros((d, d), np.int64)
        held = 0
        for b in batches:
            x = matrix(b.column("x"), d) - mean
            for at in range(0, len(x), BLOCK_ROWS):
                y = x[at : at + BLOCK_ROWS]
                most = int(np.abs(y).max(initial=0))
                if most**2 * BLOCK_ROWS < 2**53:  # products add up exactly in doubles
                    f = y.astype(float)
                    low += (f.T @ f).astype(np.int64)
                    held += most**2 * len(y)
                else:
                    o = y.astype(object)
                    high += o.T @ o
                if held > 2**61:
                    high, low, held = high + low.astype(object), np.zeros((d, d), np.int64), 0
        high = high + low.astype(object)
        if np.any(high):
            at = [(i, j) for i in range(d) for j in range(i + 1)]
            i, j = (np.array(c, np.int32) for c in zip(*at))
            # two parts of a sum: s = big * 2**40 + little
            s = [int(high[p]) for p in at]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array([v >> 40 for v in s], pa.int64()), pa.array([v & (2**40 - 1) for v in s], pa.int64())], ["i", "j", "big", "little"])

    sums = rows.select("x").mapInArrow(part, "i int, j int, big long, little long")
    sums = sums.groupBy("i", "j").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("big", "little")))
    out = [[0] * d for _ in range(d)]
    for r in sums.collect():  # d * (d + 1) / 2 rows
        out[r.i][r.j] = out[r.j][r.i] = (int(r.big) << 40) + int(r.little)
    return out


@dataclass
class Whitening:
    """A fitted whitening: number of fitted rows, sums by dimension, leading eigenpairs, trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """From ``rows`` with column x (whole numbers, of one length)."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"), len(b.column("x")[0]))
                total, n = x.sum(axis=0) + (0 if total is None else total), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.astype(np.int64)), pa.array(np.full(len(total), n))], ["i", "s", "n"])

    total = rows.select("x").mapInArrow(part, "i int, s long, n long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    found = sorted(total.collect())  # one row a dimension
    if not found:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums = int(found[0].n), [int(r.s) for r in found]
    mean = [s // n for s in sums]
    off = [Fraction(s, n) - m for s, m in zip(sums, mean)]  # in [0, 1)
    products = scatter(rows, np.array(mean, np.int64))
    v = np.array([[float(Fraction(products[i][j], n) - off[i] * off[j]) for j in range(len(sums))] for i in range(len(sums))])
    values, vectors = Spectrum(v).leading(components)
    return Whitening(n, sums, values, vectors, float(np.trace(v)))


def project(rows: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, deviation, and ``whitened`` as an array over the components."""
    d = len(w.sums)
    mean = np.array([s // w.n for s in w.sums], np.int64)
    rest = np.array([s % w.n for s in w.sums], np.int64)
    scale = (w.vectors / np.sqrt(w.values)[:, None]).T

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = matrix(b.column("x"), d) - mean
            white = (y - rest / w.n) @ scale
            most = max(int(np.abs(y).max(initial=0)) + 1, 1) * w.n
            if most**2 * d < 2**63:
                z = y * w.n - rest
                deviation = pa.array((z * z).sum(axis=1))
            else:
                z = (y.astype(object) * w.n - rest.astype(object)) ** 2
                deviation = pa.array([int(s) if s < 2**63 else None for s in z.sum(axis=1)], pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * len(w.values)), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), deviation, lists], ["vec_id", "deviation", "white"])

    schema = T.StructType([rows.schema["vec_id"], T.StructField("deviation", T.LongType()), T.StructField("white", T.ArrayType(T.DoubleType()))])
    return rows.select("vec_id", "x").mapInArrow(part, schema)


def identity_error(white: DataFrame, many: int) -> float:
    """Largest absolute entry of the covariance (divisor n, centred first) of ``white`` minus the identity."""
    entry = [F.col("white")[k] for k in range(many)]
    mean = white.agg(*(F.avg(e).alias(f"m{k}") for k, e in enumerate(entry))).first()
    at = [(i, j) for i in range(many) for j in range(i + 1)]
    sums = white.agg(*(F.avg((entry[i] - mean[i]) * (entry[j] - mean[j])).alias(f"c{k}") for k, (i, j) in enumerate(at))).first()
    return max(abs(s - (i == j)) for s, (i, j) in zip(sums, at))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, step: int = GRID, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    names = [embeddings.schema["vec_id"]]
    rows = embeddings.select("vec_id", grid("embedding", step, offset).alias("x")).where(F.size("x") > 0)
    lengths = sorted((r["count"], r.d) for r in rows.groupBy(F.size("x").alias("d")).count().collect())  # as many rows as there are lengths
    rows = rows.where(F.size("x") == (lengths[-1][1] if lengths else 0))
    w = fit(rows, components)
    many = len(w.values)
    if not many:
        schema = T.StructType([*names, *T._parse_datatype_string(FIELDS).fields])
        return embeddings.sparkSession.createDataFrame([], schema)
    white = written(project(rows, w), "whitened")
    error = identity_error(white, many)
    shares = F.array(*(F.lit(float(e / w.trace)) for e in w.values))
    out = white.select("vec_id", "deviation", F.posexplode("white").alias("k", "whitened"))
    return out.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("k")].alias("explained"), F.lit(error).alias("identity_error"),
    )


FIELDS = "component int, n long, deviation long, whitened double, explained double, identity_error double"
