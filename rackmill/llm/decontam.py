"""Benchmark decontamination by spaced-seed hashing.

Tokens are runs of letters and digits (ASCII, lower-cased, and every byte of a further character), so
case, punctuation and white space don't matter. A seed is a fixed mask over SPAN neighbouring tokens;
positions with 0 are ignored, so a hit survives a substituted token there. Test items and documents
are hashed at every position with every mask; documents join the items on (mask, hash). Items of which COVER
is fewer than LEAST tokens have the masks of SHORT_MASKS as well.

Around each hit the document is aligned with the item token by token, without gaps. On this diagonal the
best stretch is taken: the longest that begins and ends with equal tokens and whose substitutions are
at most SUBSTITUTED of its tokens. The document is contaminated if a stretch has at least LEAST tokens, or covers at least
COVER of an item of which that is fewer.

The index of the items (hashes and tokens) is built on the driver in blocks of at most BLOCK_TOKENS tokens, so what is
broadcast at once is bounded; with more than one each is a pass over the documents, after which it is let go. Texts are then known by their md5.

Defined results: null and empty texts are clean; null and empty items, and items of fewer than SHORTEST
tokens, match nothing. Equal items are all named. Repeated rows each get a row; other columns stay or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, materialize
from .words import U, hashes, mix, parts, raw, tidy

#: Six or seven of eleven positions each. In every stretch of LEAST tokens or more with at most SUBSTITUTED of them substituted a mask fits somewhere.
MASKS = ("11111100000", "00000111111", "11100111000", "00011100111", "11001100110", "10110011001", "11010010110", "11101000111")
SPAN = 11
#: The same for stretches of SHORTEST tokens or more.
SHORT_MASKS = ("1111", "11011", "10111", "11101")
_EVERY = MASKS + SHORT_MASKS
LEAST, COVER, SUBSTITUTED, SHORTEST = 13, 0.8, 0.2, 4
_COST = round((1 - SUBSTITUTED) / SUBSTITUTED)  # equal tokens that one substitution needs
BLOCK_TOKENS = 2_000_000
#: Seed hits in memory at once.
PAIRS = 1 << 20
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_MULT = np.array([pow(0xD6E8FEB86659FD93, k + 1, 2**64) for k in range(SPAN)], U)
_FILTER_BITS = 22


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all rows, and the n + 1 offsets of the rows in them."""
    data, off = raw(texts)
    if not len(data):
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    inside = _WORD[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts = np.flatnonzero(first)
    return hashes(data, starts, np.flatnonzero(last) + 1), np.searchsorted(starts, off)


def seeds(t: np.ndarray, mask: int) -> np.ndarray:
    """The hash at every position at which the mask fits in."""
    n = len(t) - len(_EVERY[mask]) + 1
    if n <= 0:
        return np.zeros(0, U)
    total = np.full(n, (mask + 1) * 0x9E3779B97F4A7C15 % 2**64, U)
    for k, c in enumerate(_EVERY[mask]):
        if c == "1":
            total += t[k : k + n] * _MULT[k]
    return mix(total)


def _is_short(n: int | np.ndarray) -> bool | np.ndarray:
    """Whether COVER of an item of n tokens is fewer than LEAST."""
    return COVER * n < LEAST


class Index:
    """Items (id, text): seed hashes with the places they stand at, and all tokens."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, every, hs, places, firsts = [], [], [], [], []
        texts = pa.array([t for _, t in items], pa.string())
        flat, at = tokens(texts) if items else (np.zeros(0, U), np.zeros(1, np.int64))
        self.starts = [0]
        for (item, _), a, b in zip(items, at[:-1], at[1:], strict=True):
            own = flat[a:b]
            if len(own) < SHORTEST:
                continue
            base = self.starts[-1]
            for m in range(len(_EVERY) if _is_short(len(own)) else len(MASKS)):
                h = seeds(own, m)
                hs.append(h)
                places.append(base + np.arange(len(h)))
                firsts.append(_begins(h))
            self.ids.append(item)
            every.append(own)
            self.starts.append(base + len(own))
        self.tokens = np.concatenate(every) if every else np.zeros(0, U)
        h, p = (np.concatenate(hs), np.concatenate(places)) if hs else (np.zeros(0, U), np.zeros(0, np.int64))
        order = np.argsort(h, kind="stable")
        self.hashes, self.places = h[order], p[order]
        first = np.concatenate(firsts)[order] if firsts else np.zeros(0, bool)
        self.first_hashes, self.first_places = self.hashes[first], self.places[first]
        self.starts = np.array(self.starts)
        self.short = bool(_is_short(np.diff(self.starts)).any())
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.hashes >> U(64 - _FILTER_BITS)).astype(np.int64)] = True

    def hits(self, t: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places in the texts and places in the items with a common seed, at most about PAIRS at once. Of a run of equal seeds in a text and one in an item,
        pairs with the first place of either run are enough, since every diagonal begins at one of them."""
        if not len(self.hashes):
            return
        for m in range(len(_EVERY) if self.short else len(MASKS)):
            h = seeds(t, m)
            begins = _begins(h)
            begins[ends[ends < len(h)]] = True
            known = self.filter[(h >> U(64 - _FILTER_BITS)).astype(np.int64)]
            for which, hs, places in ((known & begins, self.hashes, self.places), (known & ~begins, self.first_hashes, self.first_places)):
                at = np.flatnonzero(which)
                lo, hi = np.searchsorted(hs, h[at], "left"), np.searchsorted(hs, h[at], "right")
                at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
                total, i = np.cumsum(n), 0
                while i < len(at):
                    k = max(i + 1, int(np.searchsorted(total, total[i] - n[i] + PAIRS, "right")))
                    c = n[i:k]
                    yield np.repeat(at[i:k], c), places[np.repeat(lo[i:k], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
                    i = k

    def overlaps(self, texts: pa.Array) -> list[dict[int, int]]:
        """For each text the items it holds, by number, with the tokens of the best stretch."""
        t, at = tokens(texts)
        out: list[dict[int, int]] = [{} for _ in range(len(texts))]
        # one alignment for each text, item and diagonal; the three as one number
        items, span = len(self.ids) + 1, len(t) + len(self.tokens) + 1
        if len(texts) > 1 and len(texts) * items * span >= 2**63:
            half = len(texts) // 2
            return self.overlaps(texts[:half]) + self.overlaps(texts[half:])
        found = [np.zeros(0, np.int64)]
        for p, q in self.hits(t, at):
            doc, item = np.searchsorted(at, p, "right") - 1, np.searchsorted(self.starts, q, "right") - 1
            found.append(np.unique((doc * items + item) * span + (p - q + len(self.tokens))))
            if sum(map(len, found)) > 4 * PAIRS:
                found = [np.unique(np.concatenate(found))]
        for key in np.unique(np.concatenate(found)).tolist():
            pair, shift = divmod(key, span)
            (d, i), shift = divmod(pair, items), shift - len(self.tokens)
            a, b = self.starts[i], self.starts[i + 1]
            if out[d].get(i) == b - a:
                continue
            lo, hi = max(a, at[d] - shift), min(b, at[d + 1] - shift)
            if hi - lo < SHORTEST:
                continue
            n = best_stretch(t[lo + shift : hi + shift] == self.tokens[lo:hi])
            if n >= LEAST or n >= COVER * (b - a) and n >= SHORTEST and _is_short(b - a):
                out[d][i] = max(n, out[d].get(i, 0))
        return out


def _begins(h: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before."""
    out = np.ones(len(h), bool)
    out[1:] = h[1:] != h[:-1]
    return out


def best_stretch(same: np.ndarray) -> int:
    """Length of the longest stretch that begins and ends with an equal token and has at most SUBSTITUTED others: an equal token earns 1, another costs _COST."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0
    score = np.concatenate([[0], np.cumsum(np.where(same, 1, -_COST))])
    low = np.minimum.accumulate(score[at])
    # for each end the first begin whose score isn't above the end's
    first = at[np.searchsorted(-low, -score[at + 1])]
    return int((at + 1 - first).max())


def blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", most: int = BLOCK_TOKENS) -> Iterator[Index]:
    """Indexes over all items, each of a bounded size. An item of more than `most` bytes has a block of its own."""
    rows = items.filter(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text")).orderBy("item", "text")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r.text) // 2 + 1  # at least its tokens
        if block and size + n > most:
            yield Index(block)
            block, size = [], 0
        block.append((r.item, r.text))
        size += n
    if block:
        yield Index(block)


def _finder(known):
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = known.value.ids
        for batch in batches:
            found = [x for part in parts(batch) for x in known.value.overlaps(part)]
            lists = pa.array([sorted({ids[i] for i in x if ids[i] is not None}) for x in found], pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([lists, pa.array([max(x.values(), default=0) for x in found], pa.int32())], names=["items", "longest"])

    return F.arrow_udf(tidy(find), "items array<long>, longest int")


def matched(docs: DataFrame, items: DataFrame, text_col: str = "text", out: str | None = None, item_id: str = "item_id", item_text: str = "text", most: int = BLOCK_TOKENS) -> DataFrame:
    """docs with a struct, named `out`, else _found, of items (array of ids, ascending) and longest (tokens of the longest stretch). A column of that name goes.

    One block is one pass. Of several, each writes the answers of the texts it meets, by the texts' md5, and is let go before the next one is sent;
    the answers are merged and joined back, so the plan is as long for many blocks as for two."""
    out = out or "_found"
    docs = docs.drop(out)
    spark = docs.sparkSession
    known = blocks(items, item_id, item_text, most)
    first, second = next(known, None), next(known, None)
    nothing = F.struct(F.array().cast("array<long>").alias("items"), F.lit(0).cast("int").alias("longest"))
    if first is None:
        return docs.withColumn(out, nothing)
    if second is None:
        return docs.withColumn(out, _finder(spark.sparkContext.broadcast(first))(F.col(text_col)))
    paths: list[str] = []
    texts = docs.select(F.md5(text_col).alias("key"), F.col(text_col).alias("text"))
    waiting = [first, second]
    del first, second
    while waiting:
        index = waiting.pop(0)
        sent = spark.sparkContext.broadcast(index)
        answers = texts.select("key", _finder(sent)(F.col("text")).alias("f")).filter("f.longest > 0")
        # equal texts have equal answers
        answers = materialize(answers.groupBy("key").agg(F.first("f.items").alias("items"), F.max("f.longest").alias("longest")), "hits", paths)
        sent.destroy()
        waiting = waiting or [x for x in (next(known, None),) if x is not None]
    merged = spark.read.schema(answers.schema).parquet(*paths).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))
    key, own = free(docs, "_key"), free(docs, "_own")
    found = merged.select(F.col("key").alias(own), F.struct("items", "longest").alias(out))
    joined = docs.withColumn(key, F.md5(text_col)).join(found, F.col(key) == F.col(own), "left")
    return joined.withColumn(out, F.coalesce(F.col(out), nothing)).drop(key, own)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, item_ids and longest (tokens of the longest overlap) for each row of docs."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = matched(d, items)
    return found.select("doc_id", (F.col("_found.longest") > 0).alias("contaminated"), F.col("_found.items").alias("item_ids"), F.col("_found.longest").alias("longest"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs without an overlap, with docs' own columns."""
    out = free(docs, "_found")
    return matched(docs, items, text_col, out).filter(F.col(f"{out}.longest") == 0).select(docs.columns)


__all__ = ["Index", "best_stretch", "blocks", "clean", "decontaminate", "matched"]
