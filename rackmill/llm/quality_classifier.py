"""Document quality by random-indexing word vectors and a two-layer network.

Word vectors. Words are hashed into BUCKETS; each bucket has a sparse random index vector (two entries of
+1 or -1 among DIMS), and its context vector is the sum of the index vectors of the words up to REACH
places before and after, over all occurrences in all documents. The sums are whole numbers, so they
are the same in any order. Context vectors are centred and scaled to length one; the vector of a
bucket is context and index vector side by side.

A document's input is the mean of its words' vectors, their root mean square and the logarithm of its
number of words. The network (one hidden layer of rectified units, one output) is trained in numpy
on the driver, from at most SAMPLE labelled documents: those with the smallest hash of their id. A fifth of
these is held back: one half of it chooses the stopping epoch, the other the temperature and the shift that calibrate the probability
(training gives both labels more even weights than they have).

Learning uses no document whose crc32(id as text) mod HELD is 0, and no other column than text; word vectors are
unlabelled statistics of all texts.

Defined results: null, empty and word-less texts are scored from an input of zeros. Without labels of both kinds
every score is the share of label 1 (0.5 without any). Repeated rows each get a row; other columns stay or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free
from .words import U, mix, parts, tidy, word_hashes

BUCKETS, DIMS, REACH = 1 << 14, 32, 2
SAMPLE = 12_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 0.01, 1e-4
HELD = 5
THRESHOLD = 0.3
_DIMS = [f"v{k}" for k in range(DIMS)]


def index_vectors(buckets: int = BUCKETS, dims: int = DIMS) -> np.ndarray:
    """Two of the dims, +1 or -1, from a hash of the bucket."""
    h = mix(np.arange(1, buckets + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    out = np.zeros((buckets, dims), np.float32)
    rows = np.arange(buckets)
    first = (h % U(dims)).astype(int)
    second = (first + 1 + ((h >> U(20)) % U(dims - 1)).astype(int)) % dims
    out[rows, first] = np.where(h >> U(62) & U(1), 1, -1)
    out[rows, second] = np.where(h >> U(61) & U(1), 1, -1)
    return out


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    h, at = word_hashes(texts, lower=False)
    return (h % U(BUCKETS)).astype(np.int64), at


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    where = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :2]
    sign = np.take_along_axis(index, where, 1)
    total = np.zeros(BUCKETS * DIMS)
    for batch in batches:
        for part in parts(batch.column(0)):
            b, at = _buckets(part)
            doc = np.repeat(np.arange(len(part)), np.diff(at))
            for d in range(1, REACH + 1):
                if len(b) <= d:
                    continue
                same = doc[:-d] == doc[d:]
                left, right = b[:-d][same], b[d:][same]
                for k in range(2):
                    for word, near in ((left, right), (right, left)):
                        total += np.bincount(word * DIMS + where[near, k], sign[near, k], BUCKETS * DIMS)
    rows = total.reshape(BUCKETS, DIMS)
    some = np.flatnonzero(np.abs(rows).sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(rows[some, k]) for k in range(DIMS))], names=["bucket", *_DIMS])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS rows, whatever the corpus."""
    schema = "bucket int, " + ", ".join(f"{n} double" for n in _DIMS)
    found = docs.select(text_col).mapInArrow(tidy(_contexts), schema).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in _DIMS)).toArrow()
    context = np.zeros((BUCKETS, DIMS))
    if found.num_rows:
        context[found.column(0).to_numpy()] = np.stack([found.column(k + 1).to_numpy() for k in range(DIMS)], 1)
    length = np.linalg.norm(context, axis=1, keepdims=True)
    unit = context / np.maximum(length, 1e-9)
    mean = (unit * np.sqrt(length)).sum(0) / max(1e-9, np.sqrt(length).sum())
    unit = np.where(length > 0, unit - mean, 0)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    return np.concatenate([unit, index_vectors() / np.sqrt(2)], 1).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row for each text: mean, root mean square, log of the number of words."""
    out = np.zeros((len(texts), 2 * vectors.shape[1] + 1), np.float32)
    b, at = _buckets(texts)
    d = vectors.shape[1]
    n = np.diff(at)
    step = 1 << 17  # words whose vectors are in memory at once
    for i in np.flatnonzero(n):
        total, square = np.zeros(d), np.zeros(d)
        for k in range(at[i], at[i + 1], step):
            v = vectors[b[k : min(k + step, at[i + 1])]]
            total += v.sum(0)
            square += np.einsum("ij,ij->j", v, v)
        out[i, :d], out[i, d : 2 * d], out[i, -1] = total / n[i], np.sqrt(square / n[i]), np.log1p(n[i])
    return out


class Network:
    """Two layers, a temperature and a shift; numpy only."""

    def __init__(self, share: float = 0.5):
        self.share, self.layers, self.temperature, self.shift = share, None, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        self.share = float(y.mean()) if len(y) else 0.5
        if len(y) < 10 or y.min() == y.max():
            return self
        rng = np.random.default_rng(7)
        order = rng.permutation(len(y))
        stop, calibrate, train = order[: len(y) // 10], order[len(y) // 10 : len(y) // 5], order[len(y) // 5 :]
        self.mean, self.std = x[train].mean(0), x[train].std(0) + 1e-3
        z = ((x - self.mean) / self.std).clip(-8, 8)
        d = x.shape[1]
        w = [rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(2 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v, best, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], (np.inf, w), 0
        weight = np.where(y == 1, 0.5 / max(self.share, 1e-3), 0.5 / max(1 - self.share, 1e-3)) ** 0.5
        for _ in range(EPOCHS):
            rng.shuffle(train)
            for k in range(0, len(train), 128):
                own = train[k : k + 128]
                h = z[own] @ w[0] + w[1]
                a = np.maximum(h, 0)
                p = 1 / (1 + np.exp(-(a @ w[2] + w[3])))
                g = (p - y[own]) * weight[own] / len(own)
                gh = np.outer(g, w[2]) * (h > 0)
                grads = [z[own].T @ gh + DECAY * w[0], gh.sum(0), a.T @ g + DECAY * w[2], np.array([g.sum()])]
                step += 1
                for i, gr in enumerate(grads):
                    m[i] = 0.9 * m[i] + 0.1 * gr
                    v[i] = 0.999 * v[i] + 0.001 * gr * gr
                    w[i] = w[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            loss = _loss(self._logit(z[stop], w), y[stop])
            if loss < best[0]:
                best = (loss, [a.copy() for a in w])
        self.layers = best[1]
        logit, y = self._logit(z[calibrate], self.layers), y[calibrate]
        pairs = [(t, b) for t in np.geomspace(0.25, 8, 60) for b in np.linspace(-2, 2, 41)]
        self.temperature, self.shift = min(pairs, key=lambda x: _loss(logit / x[0] + x[1], y)) if len(y) else (1.0, 0.0)
        return self

    @staticmethod
    def _logit(z: np.ndarray, w: list[np.ndarray]) -> np.ndarray:
        return np.maximum(z @ w[0] + w[1], 0) @ w[2] + w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.share)
        z = ((x - self.mean) / self.std).clip(-8, 8)
        return 1 / (1 + np.exp(-np.clip(self._logit(z, self.layers) / self.temperature + self.shift, -30, 30)))


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -logit, logit))))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(HELD)) == 0


class Model:
    def __init__(self, vectors: np.ndarray, network: Network):
        self.vectors, self.network = vectors, network

    def __call__(self, texts: pa.Array) -> np.ndarray:
        return np.concatenate([self.network(pooled(p, self.vectors)) for p in parts(texts)]) if len(texts) else np.zeros(0)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Word vectors from all docs; the network from the labelled ones that aren't held out. labels: doc_id, quality."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    vectors = spark.sparkContext.broadcast(word_vectors(d, "text"))
    y = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("y")).filter("y in (0, 1)")
    y = y.filter(F.col("_id").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in parts(batch.column(2)):
                x = pooled(part, vectors.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), pa.array([r.tobytes() for r in x], pa.binary())], names=["_id", "y", "x"])
                at += len(part)

    chosen = d.join(F.broadcast(y), "_id").select("_id", "y", "text").mapInArrow(tidy(pool), "_id long, y int, x binary")
    # a document whose id repeats in docs counts once, so the rows are at most `sample`
    got = chosen.groupBy("_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).toArrow().sort_by("_id")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(got.num_rows, -1).astype(float) if got.num_rows else np.zeros((0, 1))
    return Model(vectors.value, Network().fit(x, got.column("y").to_numpy().astype(float)))


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the calibrated probability of label 1."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(known.value(batch), pa.float64())

    return docs.withColumn(out, F.arrow_udf(tidy(score), "double")(F.col(text_col)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = scored(d, train(d, labels), "text", "raw").withColumn("score", F.round("raw", 9))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs predicted good, with docs' own columns."""
    out = free(docs, "_quality")
    return scored(docs, train(docs, labels, id_col, text_col), text_col, out).filter(F.round(out, 9) >= threshold).select(docs.columns)
