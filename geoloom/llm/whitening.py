"""Embedding whitening: Welford updates inside tasks, merged by the parallel update formula, then a symmetric QR eigen-solve.

Each task runs over its vectors and keeps their number, exact sums, mean and scatter matrix; a vector changes the scatter by the
rank-one product of its distances from the mean before and after it. States of tasks are merged FAN at a time until few enough
are left for the driver. Their size depends on the dimension alone. The eigenvectors of the covariance come from a Householder
tridiagonal form and implicit QR steps; a second pass measures how far the whitened vectors' covariance is from the identity.

Cases: rows whose vector is null, empty, or holds a null, a NaN or an infinity are dropped, as are those whose length is not the
most frequent one (the larger of two); a null vec_id stays null; repeated rows are each returned, but the fit sees each distinct
vector once; directions without spread are not components, so fewer than `components` may come; one distinct vector, or an
empty table, gives no rows; other columns are not looked at. Entries beyond what a long holds after scaling raise an error, as
does a deviation beyond it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.llm.common import materialize
from geoloom.llm.vectors import matrices, vector_rows
from geoloom.session import discard

#: States that one task merges, and that the driver merges at most.
FAN = 32
STATE = "part long, n long, sums array<decimal(38,0)>, mean array<double>, scatter array<double>"
LEAST_LONG, MOST_LONG = -(2.0**63), 2.0**63


class State:
    """Number, exact sums, mean and scatter of the vectors so far. Whole numbers' sums are exact at any size."""

    def __init__(self, n: int, sums: list[int], mean: np.ndarray, scatter: np.ndarray):
        self.n, self.sums, self.mean, self.scatter = n, sums, mean, scatter

    @classmethod
    def empty(cls, d: int) -> State:
        return cls(0, [0] * d, np.zeros(d), np.zeros((d, d)))

    def add(self, x: np.ndarray) -> None:
        """Welford's update for each row of x in turn.

        The k-th row adds (x - mean before)(x - mean after)^T; the running means of a block come from one cumulative sum and
        the block's rank-one terms from one matrix product.
        """
        if not len(x):
            return
        if np.issubdtype(x.dtype, np.integer):
            self.sums = [a + b for a, b in zip(self.sums, exact_sums(x), strict=True)]
        x = x.astype(float)
        steps = np.arange(1, len(x) + 1)[:, None]
        after = self.mean + np.cumsum(x - self.mean, axis=0) / (self.n + steps)
        before = np.vstack([self.mean, after[:-1]])
        self.scatter += (x - before).T @ (x - after)
        self.mean, self.n = after[-1], self.n + len(x)

    def merge(self, other: State) -> None:
        """The parallel update: scatters add up, and the distance of the means adds one rank-one term."""
        if not other.n:
            return
        n, gap = self.n + other.n, other.mean - self.mean
        self.scatter = self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n)
        self.mean = self.mean + gap * (other.n / n)
        self.n, self.sums = n, [a + b for a, b in zip(self.sums, other.sums, strict=True)]

    def covariance(self) -> np.ndarray:
        return (self.scatter + self.scatter.T) / (2 * max(self.n, 1))

    def batch(self, part: int) -> pa.RecordBatch:
        numbers = lambda a: pa.array([a.ravel().tolist()], pa.list_(pa.float64()))
        sums = pa.array([[Decimal(s) for s in self.sums]], pa.list_(pa.decimal128(38, 0)))
        return pa.RecordBatch.from_arrays([pa.array([part]), pa.array([self.n]), sums, numbers(self.mean), numbers(self.scatter)], names=["part", "n", "sums", "mean", "scatter"])


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of whole numbers as Python numbers: low and high halves are summed apart, so nothing wraps."""
    low, high = (x & 0xFFFFFFFF).sum(0), (x >> 32).sum(0)
    return [int(a) + (int(b) << 32) for a, b in zip(low, high, strict=True)]


def states_of(batches: Iterator[pa.RecordBatch]) -> Iterator[State]:
    for batch in batches:
        for n, sums, mean, scatter in zip(*(batch.column(c).to_pylist() for c in ("n", "sums", "mean", "scatter")), strict=True):
            yield State(n, [int(s) for s in sums], np.array(mean, float), np.array(scatter, float).reshape(len(mean), len(mean)))


def merged(states: DataFrame, d: int) -> State:
    """All states as one: tasks merge FAN at a time until FAN or fewer are left for the driver."""
    states = materialize(states, "moments")
    while states.count() > FAN:

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, State] = {}
            for batch in batches:
                for part, state in zip(batch.column("part").to_pylist(), states_of([batch]), strict=True):
                    out.setdefault(part // FAN, State.empty(d)).merge(state)
            for part, state in out.items():
                yield state.batch(part)

        near = states.repartition(F.expr(f"part div {FAN}")).mapInArrow(merge, STATE)
        states, old = materialize(near, "moments"), states
        discard(old)
    out = State.empty(d)
    for state in states_of([states.orderBy("part").toArrow().combine_chunks()]):  # FAN rows at most
        out.merge(state)
    discard(states)
    return out


def moments(vectors: DataFrame, d: int, numbers) -> State:
    """State of the vectors (written as bytes); numbers: bytes column -> matrix of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = State.empty(d)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                state.add(numbers(batch.column("x").slice(at, 2048)))
        if state.n:
            yield state.batch(TaskContext.get().partitionId())

    return merged(vectors.mapInArrow(run, STATE), d)


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Middle, side and Q with a = Q T Q^T, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.linalg.norm(x)
        if size == 0:
            continue
        v = x.copy()
        v[0] += math.copysign(size, x[0])
        v /= np.linalg.norm(v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def symmetric_qr(a: np.ndarray, most_steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix: implicit QR steps with Wilkinson's shift."""
    n = len(a)
    d, e, q = tridiagonal(a)
    columns = q.T.copy()  # rows are eigenvectors to be: a rotation touches two rows
    high, steps = n - 1, 0
    while high > 0:
        small = np.abs(e[:high]) <= np.finfo(float).eps * (np.abs(d[:high]) + np.abs(d[1 : high + 1]))
        e[:high][small] = 0.0
        if e[high - 1] == 0:
            high, steps = high - 1, 0
            continue
        zeros = np.flatnonzero(e[:high] == 0)
        low = int(zeros[-1]) + 1 if len(zeros) else 0
        steps += 1
        if steps > most_steps:
            raise RuntimeError("the eigenvalues did not settle")
        half = (d[high - 1] - d[high]) / 2
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k] = c * c * dk + 2 * c * s * ek + s * s * dn
            d[k + 1] = s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < high - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            columns[[k, k + 1]] = c * columns[k] + s * columns[k + 1], c * columns[k + 1] - s * columns[k]
    order = np.argsort(-d, kind="stable")
    vectors = columns[order]
    return d[order], (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T


def scaled(v: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row is finite, and floor(scale * entry) of those rows as whole numbers."""
    v = v.astype(float)
    ok = np.isfinite(v).all(1)
    x = np.floor(v[ok] * scale)
    if x.size and (x.min() < LEAST_LONG or x.max() >= MOST_LONG):
        raise OverflowError("a scaled entry does not fit in a long")
    return ok, x.astype(np.int64)


def packed(x: np.ndarray) -> pa.Array:
    """Each row as bytes, in the narrowest of 2, 4 and 8 bytes an entry that holds all of the row: equal rows, equal bytes."""
    top = np.maximum(x.max(1), -1 - x.min(1)) if len(x) else np.empty(0)
    return pa.array([r.astype("<i2" if t < 1 << 15 else "<i4" if t < 1 << 31 else "<i8").tobytes() for r, t in zip(x, top, strict=True)], pa.binary())


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    rows = [np.frombuffer(b, {2: "<i2", 4: "<i4", 8: "<i8"}[len(b) // d]) for b in column.to_pylist()]
    return np.array(rows, np.int64).reshape(len(rows), d)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over dimensions of (n * x - S)^2, exact."""
    top = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums), default=0)
    if top * top * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    out = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    if max(out, default=0) >= 1 << 63:
        raise OverflowError("a deviation does not fit in a long")
    return out


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 4, scale: float = 256.0) -> DataFrame:
    """A row for each vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark = table.sparkSession
    rows, d = vector_rows(table, id_col, vec_col)
    if not d:
        return spark.createDataFrame([], SCHEMA)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, v in matrices(batches, d):
            yield pa.RecordBatch.from_arrays([packed(scaled(v, scale)[1])], names=["x"])

    fit = materialize(rows.select("v").mapInArrow(pack, "x binary").distinct(), "vectors")
    whole = moments(fit, d, lambda column: unpacked(column, d))
    if whole.n < 2:
        discard(fit)
        return spark.createDataFrame([], SCHEMA)
    values, vectors = symmetric_qr(whole.covariance())
    kept = int((values[:components] > d * np.finfo(float).eps * max(values[0], 0)).sum())
    n, sums, total = whole.n, whole.sums, float(np.trace(whole.covariance()))
    middle = np.array([s / n for s in sums])
    lift = vectors[:, :kept] / np.sqrt(values[:kept])
    if not kept:
        discard(fit)
        return spark.createDataFrame([], SCHEMA)
    spread = moments(fit, kept, lambda column: (unpacked(column, d) - middle) @ lift).covariance()
    error = float(np.abs(spread - np.eye(kept)).max())
    discard(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, v in matrices(batches, d):
            ok, x = scaled(v, scale)
            ids, m = piece.column("vec_id").take(pa.array(np.repeat(np.flatnonzero(ok), kept))), len(x)
            whitened = (x - middle) @ lift
            columns = [
                ids, pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)), pa.array(np.full(m * kept, n)),
                pa.array(np.repeat(np.array(deviations(x, n, sums), np.int64), kept)), pa.array(whitened.ravel()),
                pa.array(np.tile(values[:kept] / total, m)), pa.array(np.full(m * kept, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
