"""Whitening of embeddings (operator 12): a distributed centred scatter, diagonalised by cyclic Jacobi rotations.

The scatter is summed in tasks and meets by matrix row; the driver holds one matrix of the vectors' dimension and
broadcasts the whitening matrix.  Jacobi rotations keep small eigenvalues accurate relative to their own size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import discard, materialize, require

#: Numbers of vectors that one numpy step takes, by their entries.
STEP_ENTRIES = 1 << 18
_SUMS = "length int, kind int, i int, part array<double>"


def grid_vector(vector: Column, scale: float = 256.0) -> Column:
    """``floor(scale * c)`` of each entry as a long, null for vectors that are null, empty or hold an entry that is
    null, not finite or too large for a long."""
    scaled = F.transform(vector, lambda c: c.cast("double") * scale)
    bad = F.exists(scaled, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**63))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(scaled, lambda c: F.floor(c)))


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix.

    A sweep rotates every pair of rows and columns once; pairs that share no index are rotated together, so a sweep
    is as many steps as there are rows.  It is over when every off-diagonal entry is negligible beside the diagonal
    entries of its row and column, which keeps small eigenvalues accurate.
    """
    a, d = np.array(matrix, dtype=np.float64), len(matrix)
    vectors, even = np.eye(d), d + d % 2
    seats = np.arange(even)
    for _ in range(sweeps):
        rotated = False
        for _ in range(even - 1):
            p, q = np.minimum(seats[: even // 2], seats[even // 2 :][::-1]), np.maximum(seats[: even // 2], seats[even // 2 :][::-1])
            seats = np.concatenate((seats[:1], seats[-1:], seats[1:-1]))  # the first seat stays, the others move on
            p, q = p[q < d], q[q < d]
            off, diagonal = a[p, q], np.sqrt(np.abs(a[p, p] * a[q, q]))
            turn = np.abs(off) > np.finfo(float).eps * diagonal
            turn &= np.abs(off) > np.finfo(float).tiny
            if not turn.any():
                continue
            rotated = True
            p, q, off = p[turn], q[turn], off[turn]
            tau = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(tau >= 0, 1.0, -1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.hypot(1.0, t)
            s = t * c
            shift = t * off
            below, above = a[p, p] - shift, a[q, q] + shift
            rows_p, rows_q = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            cols_p, cols_q = a[:, p].copy(), a[:, q].copy()
            a[:, p], a[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            a[p, p], a[q, q], a[p, q], a[q, p] = below, above, 0.0, 0.0
            cols_p, cols_q = vectors[:, p].copy(), vectors[:, q].copy()
            vectors[:, p], vectors[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
        if not rotated:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]


@dataclass
class Whitening:
    """What is known of the vectors of one length: their number, sums, mean, and the leading components."""

    n: int
    sums: list[int]
    mean: np.ndarray
    values: np.ndarray
    axes: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ (self.axes / np.sqrt(self.values))


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a column by their length, in steps of bounded size: length, places, one row a vector."""
    lengths = np.diff(np.asarray(column.offsets))
    flat, starts = np.asarray(column.values), np.asarray(column.offsets)[:-1]
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        most = max(1, STEP_ENTRIES // int(d))
        for k in range(0, len(at), most):
            some = at[k : k + most]
            yield int(d), some, flat[starts[some][:, None] + np.arange(d)]


def _sum_tables(fit: DataFrame, of: Callable[[int, np.ndarray], list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """By length, the sums over all vectors of some matrices that ``of`` makes of a step's.

    Each task sums its own; the rows of these sums meet by length, matrix and row, so no task holds the parts of a
    whole matrix.  One matrix of each kind and length reaches the driver."""

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for d, _, x in _by_length(batch.column("x")):
                new = of(d, x)
                held[d] = [a + b for a, b in zip(held[d], new)] if d in held else new
        for d, tables in held.items():
            for kind, table in enumerate(tables):
                yield pa.RecordBatch.from_pydict({"length": pa.array([d] * len(table), pa.int32()), "kind": pa.array([kind] * len(table), pa.int32()), "i": pa.array(range(len(table)), pa.int32()), "part": pa.array(list(table), pa.list_(pa.float64()))})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("length", "kind", "i")])
            for key, row in zip(keys, batch.column("part")):
                row = np.asarray(row.values)
                held[key] = held[key] + row if key in held else row
        for (d, kind, i), row in held.items():
            yield pa.RecordBatch.from_pydict({"length": pa.array([d], pa.int32()), "kind": pa.array([kind], pa.int32()), "i": pa.array([i], pa.int32()), "part": pa.array([row], pa.list_(pa.float64()))})

    out: dict[int, dict[int, dict[int, list[float]]]] = {}
    for r in fit.select("x").mapInArrow(sum_up, _SUMS).repartition("length", "kind", "i").mapInArrow(meet, _SUMS).collect():
        out.setdefault(r.length, {}).setdefault(r.kind, {})[r.i] = r.part
    return {d: [np.array([rows[i] for i in sorted(rows)]) for _, rows in sorted(kinds.items())] for d, kinds in out.items()}


def fit_whitening(vectors: DataFrame, components: int) -> dict[int, Whitening]:
    """By length, the whitening of distinct vectors (``x``: an array of longs, each row another)."""
    totals = vectors.groupBy(F.size("x").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in totals.collect()}
    # entries are summed in two halves of 32 bits, so that sums are exact whatever their size
    halves = vectors.select(F.size("x").alias("length"), F.posexplode("x").alias("i", "c")).groupBy("length", "i")
    low = F.sum(F.col("c").bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)"))
    sums: dict[int, dict[int, int]] = {}
    for r in halves.agg(low.alias("low"), F.sum(F.shiftright("c", 32).cast("decimal(38,0)")).alias("high")).collect():
        sums.setdefault(r.length, {})[r.i] = (int(r.high) << 32) + int(r.low)
    exact = {d: [s[i] for i in range(d)] for d, s in sums.items()}
    # Python divides whole numbers of any size to the nearest double
    means = {d: np.array([v / counts[d] for v in s]) for d, s in exact.items()}
    scatter = _sum_tables(vectors, lambda d, x: [(lambda y: y.T @ y)(x - means[d])])
    out = {}
    for d, (total,) in scatter.items():
        covariance = (total + total.T) / (2 * counts[d])
        values, axes = jacobi(covariance)
        trace = float(np.trace(covariance))
        some = [k for k in range(min(components, d)) if values[k] > 1e-12 * trace]
        out[d] = Whitening(counts[d], exact[d], means[d], values[some], axes[:, some], trace)
    # the covariance of what the fitted components give, over the same vectors
    ready = {d: w for d, w in out.items() if len(w.values)}
    moments = _sum_tables(vectors, lambda d, x: [(lambda z: z.T @ z)(ready[d].project(x)), ready[d].project(x).sum(axis=0)[None]] if d in ready else [np.zeros((1, 1))] * 2)
    for d, w in ready.items():
        second, first = moments[d]
        mean = first[0] / w.n
        w.identity_error = float(np.abs(second / w.n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return out


def _deviation(x: np.ndarray, w: Whitening) -> list[int]:
    """The sum over dimensions of ``(n * x - S) ** 2``, exactly."""
    most = w.n * int(np.abs(x).max(initial=0)) + max(map(abs, w.sums), default=0)
    if most * most * x.shape[1] < 2**63:
        y = w.n * x - np.array(w.sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    return [sum((w.n * int(c) - s) ** 2 for c, s in zip(row, w.sums)) for row in x]


def whiten(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = 4, scale: float = 256.0) -> DataFrame:
    """``<key>, component, n, deviation, whitened, explained, identity_error`` for each row and leading component.

    Vectors become whole numbers ``floor(scale * c)``; each distinct one counts once in the fit.  Rows whose vector
    is null, empty, or holds an entry that is null, not finite or too large for a long are left out.  Vectors of each
    length are whitened among themselves, and ``n`` is the number of distinct ones of that length.  Components whose
    eigenvalue is zero (up to rounding) have no whitened value and are left out, so a table of one distinct vector
    gives no rows, like an empty one.  Repeated rows are each returned; null keys are kept; other columns, whatever
    their names, play no part.  ``deviation`` is a decimal, which is null beyond 38 digits.
    """
    require(vectors, vector, key)
    rows = vectors.select(F.col(key).alias("key"), grid_vector(F.col(vector), scale).alias("x")).where("x is not null")
    fit = materialize(rows.select("x").distinct(), "whitening-fit")
    fitted = fit_whitening(fit, components)
    discard(fit)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _by_length(batch.column("x")):
                w = fitted.get(d)
                k = len(w.values) if w else 0
                if not k:
                    continue
                z = w.project(x)
                deviations = [v if abs(v) < 10**38 else None for v in _deviation(x, w)]
                whole = lambda v, t=pa.float64(): pa.array(np.tile(v, len(at)), t)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").take(pa.array(np.repeat(at, k))), whole(np.arange(1, k + 1), pa.int32()), whole([w.n] * k, pa.int64()),
                        pa.array(deviations, pa.decimal128(38, 0)).take(pa.array(np.repeat(np.arange(len(at)), k))), pa.array(z.ravel()),
                        whole(w.values / w.trace), whole([w.identity_error] * k),
                    ],
                    names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    out = rows.mapInArrow(run, f"key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    return out.withColumnRenamed("key", key)
