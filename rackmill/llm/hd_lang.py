"""Language identification with hyperdimensional profiles.

Every letter symbol has a random vector of DIMS entries +1 or -1; a trigram's vector binds (multiplies) the
vectors of its letters, permuted by two, one and no places; a text's vector bundles (adds) those
of its trigrams, and a language's prototype bundles all its training texts, each scaled to the same
weight. The prediction is the prototype with the largest cosine, after the mean of the prototypes has been
taken from the prototypes (what all languages share tells nothing).

Symbols: a to z, one for the space between words, and OTHERS for all other letters, by a hash of the
lower-case letter; everything that is no letter separates words.

As bundling is addition, a language's prototype is the product of its trigram weights with the trigram
vectors; the weights are gathered from all training texts in one distributed sum. Learning uses text and
lang only, of documents whose crc32(id as text) mod 4 is not 2.

Defined results: null texts and texts without a letter are `und` with score 0, and so is everything if there is
nothing to learn from; rows with a null lang teach nothing. Of equal cosines the first language by name wins.
The score is (1 + cosine) / 2. Repeated rows each get a row; other columns stay or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import parts, raw, tidy

OTHERS = 37
SYMBOLS = 27 + OTHERS
DIMS = 1024
FOLD, HELD = 4, 2


def _symbols() -> np.ndarray:
    """The symbol of each code point below 0x10000; further ones by letters_of()."""
    out = np.zeros(1 << 16, np.uint8)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()[0]
            out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) * 2654435761 % 2**32 * OTHERS // 2**32
    return out


_table: list[np.ndarray] = []


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all characters of all rows, with runs of separators shortened to one and one around each row; the n + 1 row offsets."""
    if not _table:
        _table.append(_symbols())
    data, off = raw(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = (data & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(first)])[off]
    sym = _table[0][np.where(points < 1 << 16, points, 0)]
    for k in np.flatnonzero(points >= 1 << 16):
        ch = chr(points[k])
        if ch.isalpha():
            sym[k] = 27 + ord(ch.lower()[0]) * 2654435761 % 2**32 * OTHERS // 2**32
    # a separator before and after each row
    rows = np.arange(len(texts))
    wide = np.zeros(len(sym) + 2 * len(texts), np.uint8)
    wide[np.arange(len(sym)) + 2 * np.repeat(rows, np.diff(at)) + 1] = sym
    starts = at + 2 * np.arange(len(texts) + 1)
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != 0) | (wide[:-1] != 0)
    keep[starts[:-1]] = True
    return wide[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def trigrams(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each row its distinct trigrams and how often each occurs; None for a row without letters."""
    s, at = symbols(texts)
    code = (s[:-2].astype(np.int32) * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:] if len(s) > 2 else np.zeros(0, np.int32)
    out: list[tuple[np.ndarray, np.ndarray] | None] = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        own = code[a : max(a, b - 2)]
        own = own[own > 0]
        out.append(np.unique(own, return_counts=True) if len(own) else None)
    return out


_vectors: dict[int, np.ndarray] = {}


def vectors(codes: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """The trigrams' vectors, bound from permuted letter vectors."""
    if dims not in _vectors:
        _vectors[dims] = np.random.default_rng(20_260_101).integers(0, 2, (SYMBOLS, dims)).astype(np.int8) * 2 - 1
    letters = _vectors[dims]
    a, b, c = codes // (SYMBOLS * SYMBOLS), codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]


def bundle(codes: np.ndarray, weights: np.ndarray, dims: int = DIMS, step: int = 8192) -> np.ndarray:
    total = np.zeros(dims, np.float64)
    for k in range(0, len(codes), step):
        total += weights[k : k + step].astype(np.float32) @ vectors(codes[k : k + step], dims).astype(np.float32)
    return total


class Profiles:
    def __init__(self, weights: dict[str, tuple[np.ndarray, np.ndarray]], dims: int = DIMS):
        self.langs, self.dims = sorted(weights), dims
        p = np.stack([bundle(*weights[k], dims) for k in self.langs]) if weights else np.zeros((0, dims))
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        if len(p) > 1:
            p -= p.mean(0)
            p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
        self.prototypes = p
        self.table: np.ndarray | None = None

    def prepare(self) -> None:
        """Each trigram vector's product with each prototype, and the pieces of vectors() that the norm needs."""
        every = np.arange(SYMBOLS**3)
        self.table = np.concatenate([vectors(every[k : k + 16384], self.dims).astype(np.float32) @ self.prototypes.T.astype(np.float32) for k in range(0, len(every), 16384)])

    def __call__(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        if self.table is None and self.langs:
            self.prepare()
        out, score, i = ["und"] * len(texts), np.zeros(len(texts)), 0
        for part in parts(texts):
            for own in trigrams(part):
                if own is not None and self.langs:
                    codes, n = own
                    dots = n.astype(np.float64) @ self.table[codes]
                    best = int(dots.argmax())
                    norm = float(np.linalg.norm(bundle(codes, n, self.dims)))
                    out[i], score[i] = self.langs[best], 0.5 + 0.5 * dots[best] / norm if norm else 0.5
                i += 1
        return out, np.clip(np.round(score, 9), 0, 1)


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, code, weight: a text's trigram shares times 2**20, as whole numbers, summed over the task's texts."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        i = 0
        for part in parts(batch.column(1)):
            langs = batch.column(0).slice(i, len(part)).to_pylist()
            for lang, own in zip(langs, trigrams(part), strict=True):
                if own is not None:
                    if lang not in total:
                        total[lang] = np.zeros(SYMBOLS**3, np.int64)
                    total[lang][own[0]] += (own[1] * 2**20) // own[1].sum()
            i += len(part)
        while len(total) > 16:  # languages held at once; further ones are handed on and summed later
            yield _weights(*total.popitem())
    for lang, w in total.items():
        yield _weights(lang, w)


def _weights(lang: str, w: np.ndarray) -> pa.RecordBatch:
    codes = np.flatnonzero(w)
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(w[codes])], names=["lang", "code", "weight"])


def fold(col):
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(FOLD)) == HELD


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes of all languages; gathered: at most SYMBOLS**3 whole numbers a language."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~fold(F.col(id_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    summed = rows.mapInArrow(tidy(_learned), "lang string, code int, weight long").groupBy("lang", "code").agg(F.sum("weight").alias("weight")).toArrow().sort_by([("lang", "ascending"), ("code", "ascending")])
    langs = np.array(summed.column("lang").to_pylist(), object)
    codes, weights = summed.column("code").to_numpy(), summed.column("weight").to_numpy().astype(float)
    return Profiles({k: (codes[langs == k], weights[langs == k]) for k in sorted(set(langs.tolist()))})


def identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", out: str = "_lang") -> DataFrame:
    """docs with a struct of lang_pred and score."""
    known = docs.sparkSession.sparkContext.broadcast(profiles)

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            lang, score = known.value(batch)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

    return docs.withColumn(out, F.arrow_udf(tidy(predict), "lang_pred string, score double")(F.col(text_col)))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs."""
    profiles = learn(docs, id_col, text_col, lang_col)
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return identified(d, profiles, "text").select("doc_id", fold(F.col("doc_id")).alias("held_out"), "_lang.lang_pred", "_lang.score")
