"""Order-dependent operators: groups pass by in sorted batches.

Groups are images, jobs or classes of an image set, of any size. Leaders, vendor counts, representatives and rows keep a small
state between batches and emit each row at once. The box operators hold the numbers of one group (48 bytes a box and what the
kernel adds) and compare a box only with those of its own and the eight cells around.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed(rows: DataFrame, key: Sequence[str], columns: Sequence[str], begin: Callable[[], Any], schema: str, order: Sequence[str]) -> DataFrame:
    """A state from begin for each key: add takes the columns of its next rows as arrays in the given total order, end follows the last;
    both return the output columns behind the key.

    One exchange on the key and one sort; many small groups cost no frame each, and of a group that goes on in the next batch
    only the state is carried over.
    """
    names = [x.strip().split(" ")[0].strip("`") for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, now = None, []
        for pdf in batches:
            if not len(pdf):
                continue
            arrays, keys, out = [pdf[c].to_numpy() for c in columns], [pdf[k].to_numpy() for k in key], [[] for _ in names]
            cuts = _cuts(pdf, key)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                own = [v[a : a + 1] for v in keys]
                if state is None or a or not _same(own, now):
                    if state is not None:
                        _put(out, now, state.end())
                    state, now = begin(), own
                _put(out, now, state.add(*(x[a:b] for x in arrays)))
            if out[0]:
                yield _frame(out, names)
        if state is not None:
            out = [[] for _ in names]
            _put(out, now, state.end())
            if out[0]:
                yield _frame(out, names)

    every = list(dict.fromkeys([*key, *order, *columns]))
    return rows.select(*every).repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, schema)


def _cuts(pdf: pd.DataFrame, key: Sequence[str]) -> list[int]:
    """Where groups begin, and the end."""
    new = np.zeros(len(pdf), bool)
    for k in key:
        v, null = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        new[1:] |= (null[1:] != null[:-1]) | (~null[1:] & ~null[:-1] & (v[1:] != v[:-1]))
    return [0, *np.flatnonzero(new).tolist(), len(pdf)]


def _same(a: list[np.ndarray], b: list[np.ndarray]) -> bool:
    return all(x[0] == y[0] or pd.isna(x[0]) and pd.isna(y[0]) for x, y in zip(a, b, strict=True))


def _put(out: list[list], key: list[np.ndarray], got: Sequence | None) -> None:
    if got is None or not len(got[0]):
        return
    for o, v in zip(out, [*(np.repeat(k, len(got[0])) for k in key), *got], strict=True):
        o.append(np.asarray(v))


def _frame(out: list[list], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: np.concatenate(v) for n, v in zip(names, out, strict=True)})


# What each score of a pair of crops weighs.
CROP_WEIGHTS = {"orb": 0.50, "ssim": 0.25, "hist": 0.15, "phash": 0.10}


class _Whole:
    """A state that holds a group's columns and gives them to the kernel at its end."""

    def __init__(self, kernel: Callable[..., list[np.ndarray]]):
        self.kernel, self.parts = kernel, []

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append([c.copy() for c in columns])

    def end(self) -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        self.parts = []
        return self.kernel(*columns)


def _stack(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    return np.stack([x1, y1, x2, y2], 1).astype(float)


def _ious(b: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    o = b[at]
    w = np.minimum(o[:, 2], b[k, 2]) - np.maximum(o[:, 0], b[k, 0])
    h = np.minimum(o[:, 3], b[k, 3]) - np.maximum(o[:, 1], b[k, 1])
    both = np.maximum(w, 0) * np.maximum(h, 0)
    area = np.maximum(o[:, 2] - o[:, 0], 0) * np.maximum(o[:, 3] - o[:, 1], 0)
    own = np.maximum(b[k, 2] - b[k, 0], 0) * np.maximum(b[k, 3] - b[k, 1], 0)
    return both / (area + own - both + 1e-9)


def _near(b: np.ndarray, all_of_them: bool = False) -> Callable[[int], np.ndarray]:
    """Indices of all boxes that may overlap the k-th: cells are as large as the largest box, so these begin in its own or the eight around."""
    if all_of_them or len(b) < 64 or not np.isfinite(b).all():
        every = np.arange(len(b))
        return lambda k: every
    low, size = b[:, :2].min(0), (b[:, 2:] - b[:, :2]).max(0)
    span = b[:, :2].max(0) - low
    size = np.maximum(np.where(size > 0, size, 1.0) * 1.000001, span / 2**20)
    at = ((b[:, :2] - low) // size).astype(np.int64) + 1
    wide = int(at[:, 1].max()) + 2
    cell = at[:, 0] * wide + at[:, 1]
    order = np.argsort(cell, kind="stable")
    ranked = cell[order]

    def near(k: int) -> np.ndarray:
        columns = cell[k] + wide * np.array([-1, 0, 1])
        return np.concatenate([order[x:y] for x, y in zip(np.searchsorted(ranked, columns - 1, "left"), np.searchsorted(ranked, columns + 1, "right"), strict=True)])

    return near


def soft_nms_kernel(boxes: np.ndarray, scores: np.ndarray, sigma: float = 0.5, floor: float = 0.001) -> tuple[list[int], list[float]]:
    """Kept indices in order, and the decayed score each had when it was taken."""
    now, keep, decayed = scores.astype(float).copy(), [], []
    if not len(now):
        return keep, decayed
    near, live, first = _near(boxes), now >= floor, now.copy()
    # scores only fall: the next one is the first of the two queues whose score is still what it was queued with
    order, place, later = np.argsort(-first, kind="stable"), 0, []
    k = int(now.argmax())
    while k >= 0 and not now[k] < floor:
        keep.append(k)
        decayed.append(float(now[k]))
        live[k] = False
        at = near(k)
        at = at[live[at]]
        overlap = _ious(boxes, k, at)
        at, overlap = at[overlap > 0], overlap[overlap > 0]
        now[at] *= np.exp(-(overlap**2) / sigma)
        live[at] = now[at] >= floor
        k = -1
        while k < 0:
            while place < len(order) and not live[order[place]]:
                place += 1
            if place < len(order) and (not later or (-first[order[place]], order[place]) < later[0]):
                score, i = -first[order[place]], int(order[place])
                place += 1
            elif later:
                score, i = heapq.heappop(later)
            else:
                break
            if live[i] and now[i] == -score:
                k = i
            elif live[i]:
                heapq.heappush(later, (-float(now[i]), i))
    return keep, decayed


def soft_nms(boxes: DataFrame, key: Sequence[str] = ("image", "class")) -> DataFrame:
    """Rows det_id, keep_order, score (the original one), decayed. boxes: key, det_id, score, x1, y1, x2, y2."""

    def kernel(ids, score, *box) -> list[np.ndarray]:
        keep, decayed = soft_nms_kernel(_stack(*box), score.astype(float))
        return [ids[keep], score[keep], np.arange(len(keep)), np.round(decayed, 6)]

    return streamed(boxes, key, ["det_id", "score", "x1", "y1", "x2", "y2"], lambda: _Whole(kernel), _key_schema(boxes, key) + ", det_id long, score double, keep_order int, decayed double", ["det_id"])


def _key_schema(rows: DataFrame, key: Sequence[str]) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key)


def fuse_kernel(boxes: np.ndarray, scores: np.ndarray, least: float = 0.3) -> list[tuple[np.ndarray, float, list[int]]]:
    """Seeds by score; each takes all unused boxes that overlap the seed itself; box by weighted mean, score of the seed."""
    order, used, out, near = np.argsort(-scores, kind="stable"), np.zeros(len(scores), bool), [], _near(boxes, least <= 0)
    for k in order:
        if used[k]:
            continue
        at = near(k)
        at = at[~used[at]]
        own = np.union1d(at[_ious(boxes, k, at) >= least], [k]).astype(np.int64)
        used[own] = True
        w = scores[own] / max(scores[own].sum(), 1e-12)
        out.append(((boxes[own] * w[:, None]).sum(0), float(scores[k]), own.tolist()))
    return out


def box_fusion(boxes: DataFrame, key: Sequence[str] = ("image", "class")) -> DataFrame:
    """A row for each fused box, with the number of its members."""

    def kernel(score, *box) -> list[np.ndarray]:
        found = fuse_kernel(_stack(*box), score.astype(float))
        b = np.round(np.stack([x for x, _, _ in found]), 6)
        return [np.arange(len(found)), *b.T, np.array([x for _, x, _ in found]), np.array([len(m) for _, _, m in found])]

    return streamed(boxes, key, ["score", "x1", "y1", "x2", "y2"], lambda: _Whole(kernel), _key_schema(boxes, key) + ", fused_id int, x1 double, y1 double, x2 double, y2 double, score double, members int", ["det_id"])


def suppress_kernel(b: np.ndarray, most: float = 0.3) -> list[int]:
    area = np.maximum((b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]), 1e-9)
    live, keep, near = np.ones(len(b), bool), [], _near(b, most < 0)
    for k in np.argsort(b[:, 3], kind="stable")[::-1]:
        if not live[k]:
            continue
        keep.append(int(k))
        live[k] = False
        at = near(k)
        at = at[live[at]]
        w = np.maximum(0, np.minimum(b[at, 2], b[k, 2]) - np.maximum(b[at, 0], b[k, 0]))
        h = np.maximum(0, np.minimum(b[at, 3], b[k, 3]) - np.maximum(b[at, 1], b[k, 1]))
        live[at] = w * h / area[at] <= most
    return keep


def suppress_overlaps(boxes: DataFrame, key: Sequence[str] = ("image",), most: float = 0.3) -> DataFrame:
    """Boxes from the lowest edge up; each kept one drops those of which it covers more than the share."""

    def kernel(ids, *box) -> list[np.ndarray]:
        keep = suppress_kernel(_stack(*box), most)
        return [ids[keep], np.arange(len(keep))]

    return streamed(boxes, key, ["det_id", "x1", "y1", "x2", "y2"], lambda: _Whole(kernel), _key_schema(boxes, key) + ", det_id long, keep_order int", ["det_id"])


class _Rows:
    """Values ascend, so a row whose median is too far stays so, and only the last row can still grow."""

    def __init__(self, tolerance: float):
        self.tolerance, self.row, self.own = tolerance, -1, array("d")

    def add(self, ids: np.ndarray, ys: np.ndarray) -> list[np.ndarray]:
        out = np.empty(len(ys), np.int64)
        for i, y in enumerate(ys.tolist()):
            r = self.own
            if not r or not abs((r[len(r) // 2] + r[(len(r) - 1) // 2]) / 2 - y) < self.tolerance:
                self.row += 1
                self.own = array("d")
            self.own.append(y)
            out[i] = self.row
        return [ids, out]

    def end(self) -> None:
        return None


def rows_kernel(ys: Sequence[float], tolerance: float = 15.0) -> list[int]:
    """For values in ascending order the number of the first row whose median is nearer than the tolerance; else a new row."""
    return _Rows(tolerance).add(np.arange(len(ys)), np.array(ys, float))[1].tolist()


def row_cluster(points: DataFrame, key: Sequence[str] = ("image",), tolerance: float = 15.0) -> DataFrame:
    """points: key, point_id, y. Gives row_no for each point."""
    return streamed(points, key, ["point_id", "y"], lambda: _Rows(tolerance), _key_schema(points, key) + ", point_id long, row_no int", ["y", "point_id"])


class _Leaders:
    def __init__(self, least: float, bits: int = 32):
        self.least, self.bits, self.n, self.leaders = least, bits, 0, np.zeros(16, np.uint64)

    def add(self, ids: np.ndarray, hashes: np.ndarray) -> list[np.ndarray]:
        out = np.empty(len(hashes), np.int64)
        for i, h in enumerate(hashes.astype(np.int64, casting="safe").view(np.uint64)):
            scores = np.maximum(0.0, 1 - np.bitwise_count(self.leaders[: self.n] ^ h) / self.bits)
            k = int(scores.argmax()) if self.n else 0
            if not self.n or scores[k] < self.least:
                if self.n == len(self.leaders):
                    self.leaders = np.concatenate([self.leaders, np.zeros(self.n, np.uint64)])
                self.leaders[self.n] = h
                k = self.n
                self.n += 1
            out[i] = k
        return [ids, out]

    def end(self) -> None:
        return None


def leader_kernel(hashes: Sequence[int], least: float, bits: int = 32) -> list[int]:
    """Each hash joins the best group whose first member is similar enough, the first of equals; else it leads a new one."""
    return _Leaders(least, bits).add(np.arange(len(hashes)), np.array(hashes, np.int64))[1].tolist()


def leader_cluster(crops: DataFrame, key: Sequence[str] = ("class",), least: float = 0.5) -> DataFrame:
    """crops: key, crop_id, phash. Gives group_no by order of crop_id."""
    return streamed(crops, key, ["crop_id", "phash"], lambda: _Leaders(least), _key_schema(crops, key) + ", crop_id long, group_no int", ["crop_id"])


class _Composite:
    """Pairs by their later crop; groups are known by the first members alone."""

    def __init__(self, least: float, representatives: int, weights: Sequence[float]):
        self.least, self.representatives, self.weights, self.group, self.sizes = least, representatives, weights, {}, []
        self.crop, self.near = None, {}

    def add(self, crops: np.ndarray, others: np.ndarray, *scores: np.ndarray) -> list[list[int]]:
        rows: list[tuple[int, int]] = []
        for x, r, *s in zip(crops.tolist(), others.tolist(), *(c.tolist() for c in scores), strict=True):
            if x != self.crop:
                rows += self._settle()
                self.crop, self.near = x, {}
            k = self.group.get(r) if r != x else None
            if k is not None:
                self.near[k] = [max(p) for p in zip(self.near.get(k, s), s, strict=True)]
        return [[x for x, _ in rows], [k for _, k in rows]]

    def _settle(self) -> list[tuple[int, int]]:
        if self.crop is None:
            return []
        best, k = 0.0, 0
        for own, parts in self.near.items():
            total = sum(w * p for w, p in zip(self.weights, parts, strict=True))
            if total > best or total == best and own < k:
                best, k = total, own
        if not self.sizes or best < self.least:
            k = len(self.sizes)
            self.sizes.append(0)
        if self.sizes[k] < self.representatives:
            self.group[self.crop] = k
        self.sizes[k] += 1
        return [(self.crop, k)]

    def end(self) -> list[list[int]]:
        rows = self._settle()
        return [[x for x, _ in rows], [k for _, k in rows]]


def composite_cluster(pairs: DataFrame, key: Sequence[str] = ("class",), least: float = 0.8, representatives: int = 3, weights: Mapping[str, float] = {"score": 1.0}) -> DataFrame:
    """Leader clustering over pair scores. pairs: key, a, b, the score columns that `weights` names, and a row (a, a) for each crop.

    A group is compared by its first `representatives` members: of each score the best over them, then the weighted sum of these
    bests. Null and NaN scores count as 0; of equal sums the first group wins.
    """
    late, early = F.greatest("a", "b").alias("crop_id"), F.least("a", "b").alias("other")
    alone = F.struct(F.least("a", "b").alias("crop_id"), F.least("a", "b").alias("other"), *(F.lit(0.0).alias(c) for c in weights))
    own = F.struct(late, early, *(F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in weights))
    both = pairs.select(*key, F.explode(F.when(F.col("a") == F.col("b"), F.array(own)).otherwise(F.array(own, alone))).alias("p")).select(*key, "p.*")
    return streamed(both, key, ["crop_id", "other", *weights], lambda: _Composite(least, representatives, list(weights.values())), _key_schema(pairs, key) + ", crop_id long, group_no int", ["crop_id", "other"])


class _Penalised:
    def __init__(self, least: float, penalty: float):
        self.least, self.penalty, self.seen = least, penalty, {}
        self.image, self.best = None, None

    def add(self, images: np.ndarray, vendors: np.ndarray, refs: np.ndarray, edge: np.ndarray, feature: np.ndarray) -> list[list]:
        rows: list[tuple] = []
        plain = 0.55 * np.clip(edge.astype(float), 0, 1) + 0.45 * (feature.astype(float) + 1) / 2
        cuts = [0, *(np.flatnonzero(images[1:] != images[:-1]) + 1).tolist(), len(images)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if images[a] != self.image:
                rows += self._settle()
                self.image, self.best = images[a], None
            score = plain[a:b] - self.penalty * np.array([self.seen.get(v, 0) for v in vendors[a:b]])
            k = int(score.argmax())
            held = math.inf if self.best and math.isnan(self.best[0]) else self.best[0] if self.best else -math.inf
            if self.best is None or score[k] > held or math.isnan(score[k]) and held < math.inf:
                self.best = (float(score[k]), refs[a + k], vendors[a + k])
        return _columns(rows)

    def _settle(self) -> list[tuple]:
        if self.image is None or pd.isna(self.image) or not self.best[0] >= self.least:
            return []
        score, ref, v = self.best
        self.seen[v] = self.seen.get(v, 0) + 1
        return [(self.image, ref, v, round(score, 6))]

    def end(self) -> list[list]:
        return _columns(self._settle())


def _columns(rows: list[tuple]) -> list[np.ndarray]:
    """Columns of image, ref, vendor and score."""
    image, ref, vendor, score = zip(*rows, strict=True) if rows else ((),) * 4
    return [np.array(image, object), np.array(ref, object), np.array(vendor, object), np.array(score, float)]


def penalised_match(candidates: DataFrame, least: float = 0.25, penalty: float = 0.05) -> DataFrame:
    """Images of a job in order of file name; each takes its best candidate, less a penalty for every earlier match of the vendor.
    candidates: job, image, ord, vendor, ref, edge, feature."""
    schema = _key_schema(candidates, ["job", "image"]) + ", ref string, vendor string, score double"
    return streamed(candidates, ["job"], ["image", "vendor", "ref", "edge", "feature"], lambda: _Penalised(least, penalty), schema, ["image", "ord"])
