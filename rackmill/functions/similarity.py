"""Vector, hash and string similarities.

Vectors and hashes are Columns; fuzzy string ratios have no built-in counterpart and are Arrow UDFs over
Python's difflib or an LCS, which callers apply to distinct pairs only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision; null if lengths differ."""
    d = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), d)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax(x: Column) -> Column:
    """Of logits; what sums to one already stays."""
    d = x.cast("array<double>")
    total = F.aggregate(d, F.lit(0.0), lambda s, v: s + v)
    top = F.array_max(d)
    e = F.transform(d, lambda v: F.exp(v - top))
    z = F.aggregate(F.transform(d, lambda v: F.exp(v - top)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.abs(total - 1) <= 1e-3, d).otherwise(F.transform(e, lambda v: v / z))


def argmax(p: Column, names: Column) -> Column:
    """The name of the first largest entry."""
    return F.get(names, (F.array_position(p, F.array_max(p)) - 1).cast("int"))


def hash_similarity(a: Column, b: Column, bits: int = 32) -> Column:
    """1 - Hamming distance / bits, at least 0."""
    return F.greatest(F.lit(0.0), 1 - F.bit_count(a.bitwiseXOR(b)) / bits)


def best_hash_similarity(a: Column, variants: Column, bits: int = 32) -> Column:
    """Against the nearest of some variants (rotations)."""
    return F.greatest(F.lit(0.0), 1 - F.array_min(F.transform(variants, lambda v: F.bit_count(v.bitwiseXOR(a)))) / bits)


def group_score(orb_good: Column, ssim: Column, hist: Column, phash: Column) -> Column:
    """Weighted: matched key points (30 are enough), structure, histogram (correlation brought to 0..1), hash."""
    return 0.5 * F.least(orb_good / 30, F.lit(1.0)) + 0.25 * ssim + 0.15 * (hist + 1) / 2 + 0.10 * phash


def hybrid_score(edge: Column, feature: Column, repeats: Column) -> Column:
    """Rack match: edge similarity, cosine brought to 0..1, less for each time the vendor came before."""
    return 0.55 * F.least(F.greatest(edge, F.lit(0.0)), F.lit(1.0)) + 0.45 * (feature + 1) / 2 - 0.05 * repeats


# ---- strings --------------------------------------------------------------------------------------


def _ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    rest = full = (1 << len(a)) - 1
    for c in b:
        hit = rest & at.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return len(a) - rest.bit_count()


def _indel(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * _lcs(a, b) / n


def _partial(a: str, b: str) -> float:
    """The shorter string against the best window of its length in the longer one."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    return max(_indel(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))


def _token_sort(a: str, b: str) -> float:
    return _indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    both = " ".join(sorted(x & y))
    one, two = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
    if both and (not x - y or not y - x):
        return 100.0
    return max(_indel(both, one), _indel(both, two), _indel(one, two)) if both else _indel(one, two)


def _compact(s: str) -> str:
    return re.sub(r"[^a-zA-Z0-9\\s]", "", s).lower()


def _fuzzy(a: str, b: str) -> float:
    a, b = _compact(a), _compact(b)
    return max(_partial(a, b), _token_set(a, b), _token_sort(a, b))


def _udf(f):
    @F.arrow_udf("double")
    def apply(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([None if x is None or y is None else f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return apply


def sequence_ratio(a: Column, b: Column) -> Column:
    """0..1, of matching blocks."""
    return _udf(_ratio)(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    """0..100: 200 LCS / (len a + len b)."""
    return _udf(_indel)(a, b)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    """0..100: the best of partial, token-set and token-sort ratio of the compacted strings."""
    return _udf(_fuzzy)(a, b)


class _Aliases:
    """Aliases with their words and their counts of characters, for an upper bound of the sequence ratio: 2 * common characters / all characters."""

    def __init__(self, aliases: list[str]):
        self.aliases, self.words = aliases, [set(a.split()) for a in aliases]
        self.letters = {c: k for k, c in enumerate(sorted(set("".join(aliases))))}
        self.counts = np.array([self._count(a) for a in aliases], np.int32).reshape(len(aliases), len(self.letters))
        self.sizes = np.array([len(a) for a in aliases])
        self.by_word: dict[str, list[int]] = {}
        for k, words in enumerate(self.words):
            for w in words:
                self.by_word.setdefault(w, []).append(k)

    def _count(self, text: str) -> np.ndarray:
        at = [self.letters[c] for c in text if c in self.letters]
        return np.bincount(np.array(at, np.int64), minlength=len(self.letters))

    def best(self, text: str, least: float, fuzzy: bool) -> tuple[float, int] | None:
        """The largest score and the first alias that has it; None below `least`. Aliases whose bound stays below the best score so far are not compared."""
        if not text or not self.aliases:
            return None
        base = np.array([1.0 if a in text else 0.0 for a in self.aliases])
        words = set(text.split())
        for k in {k for w in words for k in self.by_word.get(w, ())}:
            base[k] += 0.6 * (len(words & self.words[k]) / len(self.words[k]))
        if not fuzzy:
            k = int(base.argmax())
            return (float(base[k]), k) if base[k] >= least else None
        most = base + np.minimum(self._count(text), self.counts).sum(1) / (len(text) + self.sizes) + 1e-9
        score, found = -1.0, -1
        for k in np.argsort(-most, kind="stable").tolist():
            if most[k] < max(score, least):
                break
            s = float(base[k]) + 0.5 * _ratio(text, self.aliases[k])
            if s > score or s == score and k < found:
                score, found = s, k
        return (score, found) if score >= least else None


def best_alias(aliases, least: float, fuzzy: bool = True):
    """A function of two text columns, alternatives of each other: struct of score and alias (its number) of the better one, the first of equals; null below `least`. aliases: a broadcast list."""

    @F.arrow_udf("score double, alias int")
    def apply(first: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known, memo = _Aliases(aliases.value), {}

        def judged(text: str | None):
            if text not in memo:
                if len(memo) >= 1 << 16:
                    memo.clear()
                memo[text] = known.best(text or "", least, fuzzy)
            return memo[text]

        for a, b in first:
            out = []
            for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
                p, q = judged(x), judged(y) if y else None
                best = q if q and (not p or q[0] > p[0]) else p
                out.append(best and {"score": best[0], "alias": best[1]})
            yield pa.array(out, pa.struct([("score", pa.float64()), ("alias", pa.int32())]))

    return apply


def alias_score(part: Column, alias: Column) -> Column:
    """1 if the part holds the alias, plus 0.6 of the share of the alias' tokens that the part has, plus 0.5 of the sequence ratio; 0 if either is empty."""
    p, a = F.lower(part), F.lower(alias)
    x, y = F.array_distinct(F.split(p, r"\s+")), F.array_distinct(F.split(a, r"\s+"))
    shared = F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(y), F.lit(1)).cast("double"))
    total = F.when(p.contains(a), 1.0).otherwise(0.0) + 0.6 * shared + 0.5 * sequence_ratio(p, a)
    return F.when((p == "") | (a == ""), 0.0).otherwise(total)


def image_name_score(name: Column, wanted: Column) -> Column:
    """2 if the name holds what is wanted, plus 0.6 of the share of the wanted tokens that the name has, plus 0.5 of the sequence ratio."""

    def plain(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s\-+]+", " "), r"\s+", " "))

    n, w = plain(name), plain(wanted)
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")) for c in (n, w))
    shared = F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.greatest(F.size(y), F.lit(1)).cast("double"))
    return F.when((w != "") & n.contains(w), 2.0).otherwise(0.0) + 0.6 * shared + 0.5 * sequence_ratio(n, w)
