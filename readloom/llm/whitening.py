"""Whitening of embeddings by cyclic Jacobi rotations.

Entries become whole numbers x = floor(64 c) + 1,000,000. One scan gives the number of vectors and exact sums by dimension, a second
one the scatter of the centred vectors: tasks multiply what they read and send one small matrix each, whose rows are added up
where they meet. The driver gets one matrix, as large as the vectors are long, squared, and turns it by symmetric Jacobi rotations until no
entry beside the diagonal matters against its own two diagonal entries; that keeps small eigenvalues accurate, too. The whitening matrix
is broadcast; its size hangs on the length of the vectors alone. A third scan measures the covariance of what comes out.

Vectors that are null, or hold null or non-finite entries, or entries whose x would not fit 62 bits, take no part. Vectors of different
lengths are whitened apart, each length by its own fit list; empty vectors have no components and no rows. Repeated rows and ids
count as they stand, null ids too; equal vectors get equal values. Components without variance (within rounding) have explained 0 and
whitened 0, and are no part of identity_error. An empty table gives no rows; further columns may have any name. A deviation beyond 64 bits
is null. The scans read the input anew each time, so it should be a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE, SHIFT = 64, 1_000_000
#: Components that are returned at most.
COMPONENTS = 32
#: Sweeps of the rotations; a handful is usual.
SWEEPS = 60
EPS = np.finfo(np.float64).eps
#: Rows of one batch of the result.
ROWS = 65536
#: Entries of a block of vectors that is multiplied at once.
BLOCK = 1 << 19


def whole(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the rows that take part, their x as whole numbers), for each length of the vectors of an Arrow list column."""
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pa.compute.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(lengths) - lengths
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for at in range(0, len(rows), step := max(1, BLOCK // max(1, int(dim)))) if dim else ():
            part = rows[at : at + step]
            with np.errstate(invalid="ignore", over="ignore"):
                m = np.floor(SCALE * values[starts[part][:, None] + np.arange(dim)])
                good = (np.abs(m) < 2.0**61).all(1)  # null and non-finite entries are not
            yield part[good], m[good].astype(np.int64) + SHIFT


def rotated(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix: sweeps of rotations over all pairs of dimensions, half
    of the dimensions at a time, each pair set to zero."""
    a, d = np.array(v, np.float64), len(v)
    q, ring = np.eye(d), list(range(d + d % 2))
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(ring) - 1):
            pairs = [(min(x, y), max(x, y)) for x, y in zip(ring[: len(ring) // 2], ring[::-1]) if max(x, y) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            p, r = np.array(pairs, np.int64).reshape(-1, 2).T
            off, first, second = a[p, r], a[p, p], a[r, r]
            live = np.abs(off) > EPS * np.sqrt(np.abs(first * second))
            if not live.any():
                continue
            turned = True
            p, r, off, first, second = p[live], r[live], off[live], first[live], second[live]
            with np.errstate(over="ignore"):
                tau = (second - first) / (2 * off)
                t = np.where(tau < 0, -1.0, 1.0) / (np.abs(tau) + np.hypot(1.0, tau))
            c = 1 / np.sqrt(1 + t * t)
            s = t * c
            a[p], a[r] = c[:, None] * a[p] - s[:, None] * a[r], s[:, None] * a[p] + c[:, None] * a[r]
            a[:, p], a[:, r] = c * a[:, p] - s * a[:, r], s * a[:, p] + c * a[:, r]
            q[:, p], q[:, r] = c * q[:, p] - s * q[:, r], s * q[:, p] + c * q[:, r]
            a[p, p], a[r, r], a[p, r], a[r, p] = first - t * off, second + t * off, 0.0, 0.0
        if not turned:
            break
    else:
        raise RuntimeError(f"the rotations did not settle in {SWEEPS} sweeps")
    order = np.argsort(-np.diag(a), kind="stable")
    q = q[:, order]
    q = q * np.where(q[np.abs(q).argmax(0), np.arange(d)] < 0, -1.0, 1.0) if d else q
    return np.diag(a)[order], q


class Centre:
    """Number and sums of the vectors of one length, and vectors centred by them."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def times_n(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: in 64 bits where that is certain, else in Python's numbers."""
        fits = float(np.abs(x).max(initial=0)) * self.n < 2.0**61 and max(map(abs, self.sums)) < 1 << 61
        return x * self.n - np.array(self.sums, np.int64) if fits else x.astype(object) * self.n - np.array(self.sums, object)

    def around(self, x: np.ndarray) -> np.ndarray:
        return self.times_n(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        z = self.times_n(x)
        if z.dtype != object and float(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 2.0**62:
            return pa.array((z * z).sum(1))
        return pa.array([s if s < 1 << 63 else None for s in (sum(int(e) ** 2 for e in row) for row in z)], pa.int64())


def _added(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the matrices of all tasks, by vector length. parts: (dim, line, values), a row for each line of each task's matrix. Lines
    meet by their number and are added one after the other, so no task holds more than its lines; the driver gets one matrix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for dim, line, values in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                x = values.values.to_numpy()
                sums[dim, line] = sums[dim, line] + x if (dim, line) in sums else x.copy()
        for (dim, line), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim]), pa.array([line]), pa.array([x], pa.list_(pa.float64()))], ["dim", "line", "values"])

    out: dict[int, dict[int, np.ndarray]] = {}
    for r in parts.repartition("dim", "line").mapInArrow(add, "dim long, line long, values array<double>").collect():
        out.setdefault(r.dim, {})[r.line] = np.array(r["values"])
    return {dim: np.array([lines[i] for i in sorted(lines)]) for dim, lines in out.items()}


def _scatter(vectors: DataFrame, turn) -> dict[int, np.ndarray]:
    """Sum of y y' over the y = turn(dim, x) of all vectors, and the sum of y as one more line."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in whole(b.column(0)):
                y = turn(x)
                m = total.setdefault(x.shape[1], np.zeros((y.shape[1] + 1, y.shape[1])))
                m[:-1] += y.T @ y
                m[-1] += y.sum(0)
        for dim, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), dim)), pa.array(np.arange(len(m))), pa.array(list(m), pa.list_(pa.float64()))], ["dim", "line", "values"])

    return _added(vectors.mapInArrow(scan, "dim long, line long, values array<double>"))


def sums(vectors: DataFrame) -> dict[int, Centre]:
    """Number and exact sums of the vectors of each length. Sums go in two halves, so that they stay within 64 bits."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for _, x in whole(b.column(0)):
                n, high, low = total.get(x.shape[1], (0, 0, 0))
                total[x.shape[1]] = [n + len(x), high + (x >> 31).sum(0), low + (x & 0x7FFFFFFF).sum(0)]
        for dim, (n, high, low) in total.items():
            columns = [np.full(dim, dim), np.arange(dim), np.full(dim, n), high, low]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["dim", "line", "n", "high", "low"])

    parts = vectors.mapInArrow(scan, "dim long, line long, n long, high long, low long")
    found: dict[int, dict[int, tuple]] = {}
    for r in parts.groupBy("dim", "line").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).collect():  # as many as a vector is long
        if r.n:
            found.setdefault(r.dim, {})[r.line] = (r.n, (r.high << 31) + r.low)
    return {dim: Centre(lines[0][0], [lines[i][1] for i in range(dim)]) for dim, lines in found.items()}


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) of every vector that takes part and each of its first
    `most` components; see the top of this file for nulls, lengths, ties, repeats and empty tables."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias(id_col), F.col(vector_col).alias("__vector"))
    alone = rows.select("__vector")
    centres = sums(alone)
    spread = spark.sparkContext.broadcast(centres)
    found = _scatter(alone, lambda x: spread.value[x.shape[1]].around(x))
    fits: dict[int, tuple] = {}
    for dim, m in found.items():
        n = centres[dim].n
        mean = m[-1] / n  # of centred vectors: what rounding left
        e, q = rotated(m[:-1] / n - np.outer(mean, mean))
        width, real = min(most, dim), e > dim * EPS * max(e[0], 0.0)
        scaled = np.where(real[:width], q[:, :width] / np.sqrt(np.where(real[:width], e[:width], 1.0)), 0.0)
        fits[dim] = (scaled, np.where(real[:width], e[:width] / max(e.sum(), np.finfo(float).tiny), 0.0), real[:width])
    matrices = spark.sparkContext.broadcast({dim: f[0] for dim, f in fits.items()})
    errors = {}
    for dim, m in _scatter(alone, lambda x: spread.value[x.shape[1]].around(x) @ matrices.value[x.shape[1]]).items():
        n, real = centres[dim].n, fits[dim][2]
        cov = m[:-1] / n - np.outer(m[-1] / n, m[-1] / n)
        errors[dim] = float(np.abs((cov - np.eye(len(cov)))[np.ix_(real, real)]).max(initial=0.0))
    explained = {dim: f[1] for dim, f in fits.items()}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, x in whole(b.column(1)):
                centre, matrix, share = spread.value[x.shape[1]], matrices.value[x.shape[1]], explained[x.shape[1]]
                width = matrix.shape[1]
                for at in range(0, len(x), step := max(1, ROWS // width)):
                    part = x[at : at + step]
                    each = pa.array(np.repeat(np.arange(len(part)), width))
                    ids, off = b.column(0).take(pa.array(places[at : at + step])).take(each), centre.deviations(part).take(each)
                    size = len(each)
                    columns = [ids, pa.array(np.tile(np.arange(1, width + 1, dtype=np.int32), len(part))), pa.array(np.full(size, centre.n)), off]
                    columns += [pa.array((centre.around(part) @ matrix).ravel()), pa.array(np.tile(share, len(part))), pa.array(np.full(size, errors[x.shape[1]]))]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(scan, f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whiten() of all embeddings, 32 components; see there for nulls, ties and the rest."""
    return whiten(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
