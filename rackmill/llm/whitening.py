"""PCA whitening of vectors from a two-pass covariance.

An entry c becomes the whole number x = floor(SCALE * c) + SHIFT. The first pass sums x exactly, each entry split into a high and a
low half, so the mean is the exact quotient S / n. The second pass centres the rows and sums their outer products, one matrix
product (NumPy GEMM) per batch; each task gives one partial matrix, and treeAggregate merges them in levels, so the driver and each
merging task hold a few matrices of dimension x dimension, whatever the number of rows. LAPACK's symmetric
eigensolver gives the components; the centred rows are projected with the broadcast (dimension x components) matrix. A third pass measures
how far the whitened rows' covariance is from the identity.

A row remains if its vector is not null and all entries are numbers and finite. All vectors should have one
length: of several lengths the most frequent one stays, of equally frequent ones the longest, and rows of other lengths are dropped; a vector without entries is never fitted.

Defined results: repeated rows each count and get rows of their own; null ids are kept. Components without variance (eigenvalue at most
FLAT of the largest) are left out, since nothing can be divided by them, so vectors that are all equal give no
rows. Entries of more than 2^53 / SCALE are taken as that bound. A deviation that doesn't fit a long is null. Other columns are ignored. Of an empty table nothing comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import tidy

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Eigenvalues of at most so much of the largest are none.
FLAT = 1e-12
#: Entries of a batch in memory at once.
ENTRIES = 1 << 20
_BOUND = float(1 << 53)


@dataclass(frozen=True)
class Model:
    """What the passes found: n vectors with exact sums, eigenvalues in falling order and their unit vectors (columns), and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0


# ---- rows ----


def whole(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the rows that remain, the length of each, and all their entries as whole numbers, one after another."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    off = np.asarray(vectors.offsets).astype(np.int64)
    flat = vectors.values.slice(off[0], off[-1] - off[0])
    entry = flat.to_numpy(zero_copy_only=False).astype(np.float64) if len(flat) else np.zeros(0)  # a null entry becomes NaN
    off, size = off - off[0], np.diff(off)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entry))])
    rows = np.flatnonzero((bad[off[1:]] == bad[off[:-1]]) & (size > 0) & ~np.asarray(vectors.is_null()))
    at = np.repeat(off[rows] - np.concatenate([[0], np.cumsum(size[rows])[:-1]]), size[rows]) + np.arange(size[rows].sum()) if len(rows) else np.zeros(0, np.int64)
    return rows, size[rows], np.floor(np.clip(SCALE * entry[at], -_BOUND, _BOUND)).astype(np.int64) + SHIFT


def batches_of(batch: pa.RecordBatch, column: str, dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the batch's rows with `dimension` entries, and their whole numbers as a matrix, about ENTRIES at once."""
    step = max(1, ENTRIES // dimension)
    for i in range(0, batch.num_rows, step):
        rows, size, x = whole(batch.column(column).slice(i, step))
        fits = size == dimension
        yield rows[fits] + i, x[np.repeat(fits, size)].reshape(-1, dimension)


def centred(x: np.ndarray, n: int, sums: np.ndarray, whole_mean: np.ndarray) -> np.ndarray:
    """x - S / n, unrounded but for the last division. sums: S - n * whole_mean, below n, so that differences of large numbers are whole ones."""
    return (x - whole_mean) - sums / n


# ---- partial results, one per task, and their merging ----


def _tree(parts: DataFrame, merge, zero):
    """treeAggregate over the one row of each task."""
    return parts.rdd.treeAggregate(zero, merge, merge, depth=3)


def _first_pass(vector: str):
    """For each length the number of vectors, and the sums of the high and the low halves of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            step = 1 << 14
            for i in range(0, batch.num_rows, step):
                _, size, x = whole(batch.column(vector).slice(i, step))
                for d in np.unique(size).tolist():
                    own = x[np.repeat(size == d, size)].reshape(-1, d)
                    high, low = own >> 32, own & 0xFFFFFFFF
                    n, total = found.get(d, (0, np.zeros(d, object)))
                    found[d] = n + len(own), total + (high.sum(0).astype(object) << 32) + low.sum(0).astype(object)
        for d, (n, total) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([n], pa.int64()), pa.array([[str(v) for v in total]], pa.list_(pa.string()))], names=["d", "n", "total"])

    return tidy(run)


def _add_sums(a, b):
    """Sums by length: {length: (n, totals)}. b may be a row of a task."""
    if isinstance(b, dict):
        items = b.items()
    else:
        items = [(b.d, (b.n, [int(v) for v in b.total]))]
    out = dict(a)
    for d, (n, total) in items:
        old = out.get(d)
        out[d] = (n, total) if old is None else (old[0] + n, [x + y for x, y in zip(old[1], total, strict=True)])
    return out


def _second_pass(vector: str, n: int, sums: np.ndarray, whole_mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(sums)
        total = np.zeros((d, d))
        for batch in batches:
            for _, x in batches_of(batch, vector, d):
                c = centred(x, n, sums, whole_mean)
                total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

    return tidy(run)


def _add_matrices(a, b):
    if not isinstance(b, np.ndarray):
        b = np.frombuffer(b.total, np.float64).reshape(a.shape)
    return a + b


def _third_pass(vector: str, n: int, sums: np.ndarray, whole_mean: np.ndarray, projection: np.ndarray):
    """Number, mean and centred products of a task's whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, k = projection.shape
        out = (0, np.zeros(k), np.zeros((k, k)))
        for batch in batches:
            for _, x in batches_of(batch, vector, d):
                if len(x):
                    w = centred(x, n, sums, whole_mean) @ projection
                    mean = w.mean(0)
                    out = merged(out, (len(w), mean, (w - mean).T @ (w - mean)))
        yield pa.RecordBatch.from_arrays([pa.array([out[0]], pa.int64()), pa.array([out[1].tobytes()], pa.binary()), pa.array([out[2].tobytes()], pa.binary())], names=["n", "mean", "total"])

    return tidy(run)


def merged(a: tuple, b: tuple) -> tuple:
    """(n, mean, centred products) of the rows of both."""
    n = a[0] + b[0]
    if not n or not b[0]:
        return a
    shift = b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def _add_moments(a, b):
    if not isinstance(b[1], np.ndarray):
        k = len(a[1])
        b = (b.n, np.frombuffer(b.mean, np.float64), np.frombuffer(b.total, np.float64).reshape(k, k))
    return merged(a, b)


# ---- the operator ----


def _shifted(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The whole part of the mean, and the sums that are left of it."""
    mean = [s // model.n for s in model.sums]
    return np.array([s - model.n * m for s, m in zip(model.sums, mean, strict=True)], np.float64), np.array(mean, np.int64)


def _projection(model: Model) -> np.ndarray:
    return model.vectors / np.sqrt(model.values)


def fit(vectors: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of all vectors that remain; None if there are none."""
    d = vectors.select(F.col(vector_col).cast("array<double>").alias("v"))
    sums = _tree(d.mapInArrow(_first_pass("v"), "d long, n long, total array<string>"), _add_sums, {})
    if not sums:
        return None
    dimension = max(sums, key=lambda k: (sums[k][0], k))
    n, total = sums[dimension]
    model = Model(n, total, np.zeros(0), np.zeros((dimension, 0)), 0.0)
    rest, mean = _shifted(model)
    outer = _tree(d.mapInArrow(_second_pass("v", n, rest, mean), "total binary"), _add_matrices, np.zeros((dimension, dimension)))
    covariance = (outer + outer.T) / (2 * n)
    values, columns = np.linalg.eigh(covariance)
    values, columns = values[::-1], columns[:, ::-1]
    k = min(components, int((values > max(values[0], 0) * FLAT).sum()) if values[0] > 0 else 0)
    columns = columns[:, :k] * np.where(columns[np.abs(columns[:, :k]).argmax(0), np.arange(k)] < 0, -1.0, 1.0)  # the largest entry is positive
    model = Model(n, total, values[:k], columns, float(np.trace(covariance)))
    if not k:
        return model
    start = (0, np.zeros(k), np.zeros((k, k)))
    found = _tree(d.mapInArrow(_third_pass("v", n, rest, mean, _projection(model)), "n long, mean binary, total binary"), _add_moments, start)
    return Model(n, total, values[:k], columns, model.trace, float(np.abs(found[2] / n - np.eye(k)).max()))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """The exact sum over dimensions of (n * x - S)^2 for each row; None if it doesn't fit a long."""
    mean = [s // n for s in sums]
    diff, rest = x - np.array(mean, np.int64), np.array([s - n * m for s, m in zip(sums, mean, strict=True)], np.int64)
    most = float(n) * (np.abs(diff).max(initial=0) + 1.0)
    if most * most * len(sums) < 2.0**62:
        own = n * diff - rest
        return (own * own).sum(1).tolist()
    out = []
    for row in diff.tolist():
        v = sum((n * a - b) ** 2 for a, b in zip(row, rest.tolist(), strict=True))
        out.append(v if v < 2**63 else None)
    return out


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whitened(model, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        (rest, mean), projection = _shifted(m), _projection(m)
        d, k = projection.shape
        explained = (m.values / m.trace).tolist()
        for batch in batches:
            for rows, x in batches_of(batch, "v", d):
                if not len(rows):
                    continue
                w = centred(x, m.n, rest, mean) @ projection
                ids = batch.column("vec_id").take(pa.array(np.repeat(rows, k)))
                dev = [v for v in deviations(x, m.n, m.sums) for _ in range(k)]
                count = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [ids.cast(id_type), pa.array(list(range(1, k + 1)) * count, pa.int32()), pa.array([m.n] * (k * count), pa.int64()), pa.array(dev, pa.int64()), pa.array(w.ravel()), pa.array(explained * count, pa.float64()), pa.array([m.identity_error] * (k * count), pa.float64())],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return tidy(run)


def transform(vectors: DataFrame, model: Model | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each remaining row and component."""
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    if model is None or not len(model.values):
        return d.filter(F.lit(False)).selectExpr("vec_id", *(f"cast(null as {x.split()[1]}) as {x.split()[0]}" for x in _OUT.split(", ")))
    return d.mapInArrow(_whitened(d.sparkSession.sparkContext.broadcast(model), pa.int64()), f"vec_id long, {_OUT}")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The same, fitted on the vectors themselves."""
    return transform(vectors, fit(vectors, vector_col, components), id_col, vector_col)
