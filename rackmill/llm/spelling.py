"""Spelling variants by two-dimensional range reporting with wavelet trees.

Words of one length are points (place in forward order, place in order of the reversed words). Words that differ
from a word of L code points by a replacement at position i are those of the same length whose prefix of i code points and
whose suffix of L - 1 - i are the word's: an interval in either order, so a rectangle of points. With one code point more at gap
i they are, among the words of length L + 1, those with its prefix of i and its suffix of L - i; the word that has one less sees the
same pair from the other side. A wavelet tree over the reverse places in forward order reports the points of a rectangle, all rectangles
of a part at once. A replacement has one position; of the gaps that give the same longer word only the first of a run of equal letters counts.

Two words with an edit in the back half share the front half, and the other way round: words are dealt out by (length
class, half, side), so that every pair meets in one group and in one position of it, and no task sees all words. A group of more than GROUP words is
dealt over several parts as points, and asked in each of them: no rectangle is lost, and a part is bounded.

Words are runs of A-Z, a-z and U+00C0 to U+00FF, lower-cased for A-Z only, so one byte of Latin-1 is a code point and byte order is code-point order.

Defined results: null and empty texts have no words; repeated rows and equal texts under other ids count again. A null id is
written as the empty text before the colon. A word may be as long as its text. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, small
from .words import tidy

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
NOISE, LEAST_LENGTH, LEAST_COUNT, TIMES = 97, 5, 3, 2
#: Points of a group in one part, and rows dealt to one task on average.
GROUP, TASK_ROWS = 1 << 15, 1 << 17
#: Rectangles asked at once.
ASKED = 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


# ---- words ----


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = NOISE, length: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word and n (long): runs of all texts, of which every `noise`-th (by the checksum of id and run) has lost a code point; at least `length` code points and `count` occurrences."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate(text_col, _UPPER, _LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.filter(F.length("run") >= length)  # what is deleted only shortens
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % noise == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return runs.withColumn("h", h).select(word.alias("word")).filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count)


# ---- the tree ----


class WaveletTree:
    """The numbers 0 to n - 1 in some order, kept as one bit vector per binary digit, high digits first: on each level those with a 0 come before those with a 1, in the order of the level above."""

    def __init__(self, places: np.ndarray):
        self.n = len(places)
        self.levels = max(1, int(self.n - 1).bit_length())
        self.zeros: list[np.ndarray] = []  # before each place of a level
        for k in reversed(range(self.levels)):
            bit = (places >> k) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(1 - bit)]).astype(np.int64))
            places = np.concatenate([places[bit == 0], places[bit == 1]])

    def report(self, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the rectangle, value) of all points at places a to b - 1 with values low to high - 1, for each rectangle of the four arrays."""
        which, value = np.arange(len(a)), np.zeros(len(a), np.int64)
        for level, zeros in enumerate(self.zeros):
            half = 1 << (self.levels - 1 - level)
            a0, b0 = zeros[a], zeros[b]
            a1, b1 = zeros[-1] + a - a0, zeros[-1] + b - b0
            # a child stands for the values from its first one on, `half` of them
            left = (b0 > a0) & (low[which] < value + half) & (high[which] > value)
            right = (b1 > a1) & (low[which] < value + 2 * half) & (high[which] > value + half)
            a, b = np.concatenate([a0[left], a1[right]]), np.concatenate([b0[left], b1[right]])
            which, value = np.concatenate([which[left], which[right]]), np.concatenate([value[left], value[right] + half])
        return which, value  # a leaf is one point


# ---- one part ----


def _common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row has in common with the one before; 0 for the first, and one more 0 at the end."""
    out = np.zeros(len(rows) + 1, np.int64)
    step = max(1, (1 << 24) // max(1, rows.shape[1]))
    for i in range(1, len(rows), step):
        j = min(len(rows), i + step)
        other = rows[i:j] != rows[i - 1 : j - 1]
        out[i:j] = np.where(other.any(1), other.argmax(1), rows.shape[1])
    return out


class _Order:
    """Words of two lengths, padded to the longer one, in byte order; for a word and a number of leading letters the interval of words with those letters."""

    def __init__(self, rows: np.ndarray):
        self.order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
        self.place = np.empty(len(rows), np.int64)
        self.place[self.order] = np.arange(len(rows))
        self.common = _common(rows[self.order])

    def shared(self) -> np.ndarray:
        """The longest prefix of each word that another has."""
        return np.maximum(self.common[:-1], self.common[1:])[self.place]

    def intervals(self, who: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.empty(len(who), np.int64), np.empty(len(who), np.int64)
        for d in np.unique(depth):
            starts = np.flatnonzero(self.common[:-1] < d)
            if not len(starts) or starts[0]:
                starts = np.concatenate([[0], starts])
            ends = np.concatenate([starts[1:], [len(self.place)]])
            own = np.flatnonzero(depth == d)
            at = np.searchsorted(starts, self.place[who[own]], "right") - 1
            a[own], b[own] = starts[at], ends[at]
        return a, b


def _matrix(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def near_pairs(words: list[bytes], point: np.ndarray, asked: np.ndarray, length: int, front: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (asking, reported) of numbers of words that differ by one code point, which is in the back half if `front` half is what the words were dealt by, else in the front half.
    words: of `length` or one more; the longer ones are points only. point, asked: which may be reported and which ask."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    short = sizes == length
    cut, width = length // 2, length + 1
    ahead = _Order(_matrix(words, width))
    behind = _Order(_matrix([w[::-1] for w in words], width))
    prefix, suffix = ahead.shared(), behind.shared()
    for longer in (0, 1):
        points = np.flatnonzero(point & (short if not longer else ~short))
        who = np.flatnonzero(asked & short)
        if not len(points) or not len(who):
            continue
        points = points[np.argsort(ahead.place[points])]  # in forward order
        rank = np.empty(len(points), np.int64)
        back = np.argsort(behind.place[points])
        rank[back] = np.arange(len(points))
        tree = WaveletTree(rank)
        before = [np.concatenate([[0], np.cumsum(np.bincount(o.place[points], minlength=len(words)))]) for o in (ahead, behind)]
        by_rank = points[back]
        # a position's prefix and suffix must both be shared with some word
        most = length - 1 + longer  # positions 0 to `most`
        lo, hi = np.maximum(most - suffix[who], cut if front else 0), np.minimum(prefix[who], most if front else cut - 1)
        n = np.maximum(hi - lo + 1, 0)
        total, i = np.cumsum(n), 0
        while i < len(who):
            j = max(i + 1, int(np.searchsorted(total, total[i] - n[i] + ASKED, "right")))
            m = n[i:j]
            w = np.repeat(who[i:j], m)
            at = np.repeat(lo[i:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            i = j
            if not len(w):
                continue
            a, b = (before[0][x] for x in ahead.intervals(w, at))
            low, high = (before[1][x] for x in behind.intervals(w, most - at))
            some = (a < b) & (low < high)
            w, at = w[some], at[some]
            q, value = tree.report(a[some], b[some], low[some], high[some])
            x, w, at = by_rank[value], w[q], at[q]
            if longer:  # only the first gap of a run of equal letters
                first = np.fromiter((p == 0 or words[k][p] != words[k][p - 1] for k, p in zip(x.tolist(), at.tolist(), strict=True)), bool, len(x))
            else:
                first = x != w
            yield w[first], x[first]


class _Best:
    """For each word how many near words there are, and the first of those with the largest count."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.words, self.counts = words, counts
        order = sorted(range(len(words)), key=words.__getitem__)
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        self.near = np.zeros(len(words), np.int64)
        self.best = np.full(len(words), -1, np.int64)

    def add(self, word: np.ndarray, other: np.ndarray) -> None:
        self.near += np.bincount(word, minlength=len(self.near))
        # the best one comes last for each word
        order = np.lexsort((-self.rank[other], self.counts[other], word))
        word, other = word[order], other[order]
        last = np.append(word[1:] != word[:-1], True) if len(word) else np.zeros(0, bool)
        word, other = word[last], other[last]
        old = self.best[word]
        better = (old < 0) | (self.counts[other] > self.counts[old]) | ((self.counts[other] == self.counts[old]) & (self.rank[other] < self.rank[old]))
        self.best[word[better]] = other[better]


def _part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task's groups: word, n, length (class), front, key (number of the group and its part), point, asked."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows).combine_chunks()
    del rows
    sorted_by = t.sort_by([("length", "ascending"), ("front", "ascending"), ("key", "ascending")])
    length, front, key = (sorted_by.column(c).to_numpy() for c in ("length", "front", "key"))
    new = np.flatnonzero((length[1:] != length[:-1]) | (front[1:] != front[:-1]) | (key[1:] != key[:-1])) + 1
    bounds = np.concatenate([[0], new, [len(key)]])
    # groups of one class are judged together, up to a number of words: intervals of prefixes keep those of different halves apart
    i = 0
    while i + 1 < len(bounds):
        j = i + 1
        a = bounds[i]
        while j + 1 < len(bounds) and length[bounds[j]] == length[a] and front[bounds[j]] == front[a] and bounds[j + 1] - a <= 4 * GROUP:
            j += 1
        b, i = bounds[j], j
        part = sorted_by.slice(a, b - a)
        yield from _judged(part, int(length[a]), bool(front[a]))


def _judged(part: pa.Table, length: int, front: bool) -> Iterator[pa.RecordBatch]:
    words = [w.encode("latin-1") for w in part.column("word").to_pylist()]
    point, asked = (part.column(c).to_numpy() for c in ("point", "asked"))
    best = _Best(words, part.column("n").to_numpy())
    # a split group's parts must not see each other's points, nor a word twice
    key = part.column("key").to_numpy()
    salts = part.column("salt").to_numpy()
    for s in np.unique(salts):
        own = np.flatnonzero(salts == s) if salts.any() else np.arange(len(words))
        if s:  # parts of split groups one by one
            for k in np.unique(key[own]):
                _pairs_of(words, point, asked, own[key[own] == k], length, front, best)
        else:
            _pairs_of(words, point, asked, own, length, front, best)
    some = np.flatnonzero(best.near)
    taken = best.best[some]
    for i in range(0, len(some), 1 << 15):
        who, form = some[i : i + (1 << 15)], taken[i : i + (1 << 15)]
        columns = [pa.array([words[k].decode("latin-1") for k in who.tolist()], pa.string()), pa.array(best.near[who], pa.int64()), pa.array([words[k].decode("latin-1") for k in form.tolist()], pa.string()), pa.array(best.counts[form], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "near", "near_n"])


def _pairs_of(words: list[bytes], point: np.ndarray, asked: np.ndarray, own: np.ndarray, length: int, front: bool, best: _Best) -> None:
    if len(own) < 2:
        return
    for w, x in near_pairs([words[k] for k in own.tolist()], point[own], asked[own], length, front):
        w, x = own[w], own[x]
        longer = np.fromiter((len(words[k]) > length for k in x.tolist()), bool, len(x))
        best.add(w, x)
        best.add(x[longer], w[longer])  # the longer word doesn't ask


_FOUND = "word string, n_near long, near string, near_n long"


def near_words(known: DataFrame, group: int = GROUP, task_rows: int = TASK_ROWS) -> DataFrame:
    """word, n_near, near (of the near words the one with the largest n, of equal ones the first by code point) and near_n for the words of known (word, n) that have near words."""
    known = known.select("word", "n", F.length("word").alias("size"))
    one = []
    for longer in (0, 1):  # of its own length it asks and is reported; as the longer word of a pair it is reported
        size = F.col("size") - longer
        cut = F.expr(f"(size - {longer}) div 2")
        for front in (True, False):
            half = F.substring("word", F.lit(1), cut.cast("int")) if front else F.substring("word", (cut + 1 + longer).cast("int"), F.col("size"))
            one.append(F.struct(size.cast("int").alias("length"), F.lit(front).alias("front"), F.xxhash64(size, F.lit(front), half).alias("key"), F.lit(not longer).alias("asked")))
    rows = known.select("word", "n", F.explode(F.array(*one)).alias("x")).select("word", "n", "x.*")
    sizes = rows.groupBy("key").agg(F.count("*").alias("rows"))
    large = sizes.filter(F.col("rows") > group).select("key", F.ceil(F.col("rows") / group).cast("int").alias("parts"))
    large = materialize(large, "groups")  # at most one row for each `group` words
    rows = rows.join(small(large), "key", "left")
    own = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int")
    # a part has its own points; those that ask do so in all parts
    salt = F.when(F.col("parts").isNull(), F.array(F.lit(0))).when(F.col("asked"), F.sequence(F.lit(1), F.col("parts"))).otherwise(F.array(own + 1))
    rows = rows.select("word", "n", "length", "front", "key", "asked", own.alias("own"), F.explode(salt).alias("salt"))
    rows = rows.select("word", "n", "length", "front", "key", "salt", ((F.col("salt") == 0) | (F.col("salt") == F.col("own") + 1)).alias("point"), "asked")
    total = rows.count()
    parts = max(1, -(-total // task_rows), int(known.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = rows.repartition(parts, "key", "salt").mapInArrow(tidy(_part), _FOUND)
    first = F.struct((-F.col("near_n")).alias("a"), F.col("near").alias("b"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(first).alias("f")).select("word", "n_near", F.col("f.b").alias("near"), (-F.col("f.a")).alias("near_n"))


def variants(known: DataFrame, times: int = TIMES) -> DataFrame:
    """word, n, n_near, form, form_n and root for all rows of known (word, n). Counts at least double from a word to its form, so a chain is short; each round doubles the steps followed."""
    spark, made = known.sparkSession, []
    near = near_words(known).withColumnRenamed("word", "_word")
    far = F.col("near_n") >= times * F.col("n")
    all_words = known.join(near, F.col("word") == F.col("_word"), "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("near")).alias("form"), F.when(far, F.col("near_n")).alias("form_n"))
    all_words = materialize(all_words, "forms")
    steps = all_words.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        on = steps.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = steps.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved"))
        old, made = made, []
        steps = materialize(moved, "roots", made)
        drop(spark, old)
        if not steps.filter("moved").limit(1).count():
            break
    roots = steps.select(F.col("word").alias("_word"), "root")
    return all_words.join(roots, F.col("word") == F.col("_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same for the words of docs."""
    return variants(materialize(words(docs, id_col, text_col), "words"))


__all__ = ["WaveletTree", "near_pairs", "near_words", "spelling_variants", "variants", "words"]
