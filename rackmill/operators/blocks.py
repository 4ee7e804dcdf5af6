"""All pairs within a key, in blocks: no pair becomes a row before it is known to count.

Either side of a key is dealt by its ids into blocks of about ROWS rows, and each pair of blocks is one small group, whatever the size of the key.
Within it NumPy looks at all pairs, a tile at a time. Products are bounded by a matrix product first; what may count is added up again entry by entry in
order, as similarity.dot does, so that scores, thresholds and ties are those of the Column functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of a block, pairs of a task, pairs that are added up in one piece, and rows of either side of a tile.
ROWS, TASK, PIECE, TILE, WIDTH = 8192, 1 << 27, 1 << 14, 256, 2048


def block_join(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, kernel: Callable[[pa.Table, pa.Table], Sequence], schema: str) -> DataFrame:
    """kernel's columns for each pair of blocks of a key that both sides have; rows of one id stay in one block. Null keys join nothing."""
    n = left.groupBy(key).agg(F.count("*").alias("_ls")).join(right.groupBy(key).agg(F.count("*").alias("_rs")), key).withColumns({"_ln": F.ceil(F.col("_ls") / ROWS), "_rn": F.ceil(F.col("_rs") / ROWS)})
    work = n.agg(F.sum(F.col("_ln") * F.col("_rn")).alias("groups"), F.sum(F.col("_ls").cast("double") * F.col("_rs")).alias("pairs")).first()
    # rows are few for their work, so tasks are counted by pairs
    tasks = max(1, min(work.groups or 0, max(left.sparkSession.sparkContext.defaultParallelism, math.ceil((work.pairs or 0) / TASK))))
    sides, arrow = (left.columns, right.columns), to_arrow_schema(StructType.fromDDL(schema))

    def dealt(side: DataFrame, by: str, first: bool) -> DataFrame:
        own, other = ("_ln", "_rn") if first else ("_rn", "_ln")
        d = side.join(n, key).withColumns({"_block": F.pmod(F.xxhash64(by), F.col(own)), "_against": F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))})
        pair = ("_block", "_against") if first else ("_against", "_block")
        return d.select(*side.columns, F.lit(first).alias("_first"), *(F.col(c).alias(name) for c, name in zip(pair, ("_l", "_r"), strict=True)))

    def run(t: pa.Table) -> pa.Table:
        a, b = t.filter(t["_first"]).select(sides[0]), t.filter(pc.invert(t["_first"])).select(sides[1])
        columns = kernel(a, b) if a.num_rows and b.num_rows else []
        return pa.table(list(columns), names=arrow.names).cast(arrow) if columns else arrow.empty_table()

    both = dealt(left, left_id, True).unionByName(dealt(right, right_id, False), allowMissingColumns=True)
    return both.repartition(tasks, key, "_l", "_r").groupBy(key, "_l", "_r").applyInArrow(run, schema)


class Vectors:
    """A column of arrays as a matrix with a row for each entry's place, their sizes, and which are null or hold a null."""

    def __init__(self, column: pa.ChunkedArray, head: int | None = None):
        c = pa.concat_arrays(column.chunks)
        size = pc.fill_null(pc.list_value_length(c), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, self.null = c.flatten(), size < 0
        of = np.repeat(np.arange(len(size)), np.maximum(size, 0))
        at = np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
        values, lost = flat.to_numpy(zero_copy_only=False).astype(float), flat.is_null().to_numpy(zero_copy_only=False)
        if head is not None:
            kept = at < head
            of, at, values, lost, size = of[kept], at[kept], values[kept], lost[kept], np.minimum(size, head)
        self.null[of[lost]] = True
        self.size, self.m = size, np.zeros((max(int(size.max(initial=0)), 0), len(size)))
        self.m[at, of] = values

    def usual(self, size: int, norms: np.ndarray, cosine: bool) -> np.ndarray:
        """Rows whose products a matrix product gives with a small error."""
        zero = ~self.m.any(0) & (not cosine)
        return ~self.null & (self.size == size) & ((norms > 1e-100) | zero) & (norms < 1e100)

    def norms(self) -> np.ndarray:
        """Lengths, added up in order."""
        total = np.zeros(len(self.size))
        with np.errstate(all="ignore"):
            for row in self.m:
                total += row * row
            return np.sqrt(total)


def products(q: Vectors, r: Vectors, i: np.ndarray, j: np.ndarray, cosine: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs their dot products, or cosines, and which are null."""
    total, null = np.zeros(len(i)), q.null[i] | r.null[j] | (q.size[i] != r.size[j])
    with np.errstate(all="ignore"):
        for at in range(0, len(i), PIECE):
            part, a, b = total[at : at + PIECE], i[at : at + PIECE], j[at : at + PIECE]
            for x, y in zip(q.m, r.m):  # noqa: B905 sizes differ only where the product is null
                part += x[a] * y[b]
        if cosine:
            under = q.norms()[i] * r.norms()[j]
            null |= under == 0
            total = total / under
    return total, null


def candidates(q: Vectors, r: Vectors, cosine: bool, floor: Callable[[np.ndarray, np.ndarray], np.ndarray], left_out: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs that may reach the floor of their row, for some rows of q at a time. floor: of a tile of products and of their errors the least product that may
    count, for each row. What a matrix product can't bound is always a candidate. left_out: pairs that raise no floor (they may be candidates)."""
    qn, rn, sizes = q.norms(), r.norms(), r.size[~r.null]
    size = int(np.bincount(sizes).argmax()) if len(sizes) else 0
    qs, rs = np.flatnonzero(q.usual(size, qn, cosine)), np.flatnonzero(r.usual(size, rn, cosine))
    odd_q, odd_r = np.setdiff1d(np.arange(len(qn)), qs), np.setdiff1d(np.arange(len(rn)), rs)
    a, b = q.m[:size, qs].T / (qn[qs, None] if cosine else 1.0), r.m[:size, rs] / (rn[rs] if cosine else 1.0)
    error = 8 * (size + 8) * 2.0**-52 * (np.ones(len(qs)) if cosine else qn[qs] * rn[rs].max(initial=0.0))
    place = np.full(len(rn), -1)
    place[rs] = np.arange(len(rs))
    out_i, out_j = (left_out[0], place[left_out[1]]) if left_out is not None else (np.zeros(0, np.int64),) * 2
    for at in range(0, len(qs), TILE):
        rows, e, least = qs[at : at + TILE], error[at : at + TILE], None
        found_i, found_j = [np.repeat(rows, len(odd_r))], [np.tile(odd_r, len(rows))]
        here = np.isin(out_i, rows) & (out_j >= 0)
        i, j = np.searchsorted(rows, out_i[here]), out_j[here]
        for start in range(0, len(rs), WIDTH):
            tile = a[at : at + TILE] @ b[:, start : start + WIDTH]
            own = (j >= start) & (j < start + WIDTH)
            tile[i[own], j[own] - start] = -np.inf
            now = floor(tile, e)
            least = now if least is None else np.maximum(least, now)
            x, y = np.nonzero(tile >= least[:, None])
            found_i.append(rows[x])
            found_j.append(rs[y + start])
        yield np.concatenate(found_i), np.concatenate(found_j)
    for k in odd_q:
        yield np.full(len(rn), k), np.arange(len(rn))


def best(q: Vectors, r: Vectors, k: int, cosine: bool = False, left_out: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, score, null: for each row of q the k best of r, NaN before all numbers, null last, of equals the first of r. left_out: pairs (i, j) that don't take part."""
    codes = None if left_out is None else np.sort(left_out[0] * len(r.size) + left_out[1])

    def floor(tile: np.ndarray, error: np.ndarray) -> np.ndarray:
        if tile.shape[1] < k:
            return np.full(len(tile), -np.inf)
        return (tile.max(1) if k == 1 else np.partition(tile, -k, axis=1)[:, -k]) - 2 * error

    for i, j in candidates(q, r, cosine, floor, left_out):
        if codes is not None and len(codes):
            own = i * len(r.size) + j
            kept = codes[np.minimum(np.searchsorted(codes, own), len(codes) - 1)] != own
            i, j = i[kept], j[kept]
        score, null = products(q, r, i, j, cosine)
        rank = np.where(null, 2, np.where(np.isnan(score), 0, 1))
        order = np.lexsort((j, -np.where(rank == 1, score, 0.0), rank, i))
        own = i[order]
        begin = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        nth = np.arange(len(own)) - np.repeat(begin, np.diff(np.append(begin, len(own))))
        took = order[nth < k]
        yield i[took], j[took], score[took], null[took]


def alike(rows: DataFrame, key: str, id_: str, vector: str, least: float) -> DataFrame:
    """key, a, b, score: all pairs a < b of a key with a dot product of at least `least` (NaN counts as more). Ids are unique."""

    def near(x: pa.Table, y: pa.Table) -> list:
        q, r, a, b = Vectors(x["x"]), Vectors(y["y"]), x["a"], y["b"]
        first, second = a.to_numpy(), b.to_numpy()

        def parts() -> Iterator[tuple[np.ndarray, ...]]:
            for i, j in candidates(q, r, False, lambda tile, error: np.full(len(tile), least) - error):
                kept = first[i] < second[j]
                i, j = i[kept], j[kept]
                score, null = products(q, r, i, j)
                kept = ~null & ~(score < least)
                yield i[kept], j[kept], score[kept]

        i, j, score = stacked(parts(), 3)
        return [x[key].take(pa.array(i)), a.take(pa.array(i)), b.take(pa.array(j)), pa.array(score.astype(float))]

    kind = lambda c: rows.schema[c].dataType.simpleString()
    left, right = rows.select(key, F.col(id_).alias("a"), F.col(vector).alias("x")), rows.select(key, F.col(id_).alias("b"), F.col(vector).alias("y"))
    return block_join(left, right, key, "a", "b", near, f"`{key}` {kind(key)}, a {kind(id_)}, b {kind(id_)}, score double")


def near_bits(left: DataFrame, right: DataFrame, key: str, most: int, kind: str, ids: tuple[str, str]) -> DataFrame:
    """key, a, b, distance: all pairs of a key whose hashes differ in at most `most` bits, of equal pairs the least. left: key, a, h; right: key, b, v. kind, ids: types of the key and the ids."""

    def near(x: pa.Table, y: pa.Table) -> list:
        h, v = x["h"].to_numpy().view(np.uint64), y["v"].to_numpy().view(np.uint64)
        a, b = (pc.index_in(c, c.unique()).to_numpy().astype(np.int64) for c in (x["a"], y["b"]))
        found = []
        for at in range(0, len(h), TILE):
            for start in range(0, len(v), WIDTH):
                distance = np.bitwise_count(h[at : at + TILE, None] ^ v[None, start : start + WIDTH])
                i, j = np.nonzero(distance <= most)
                found.append((i + at, j + start, distance[i, j].astype(np.int64)))
        i, j, distance = stacked(iter(found), 3)
        order = np.lexsort((distance, b[j], a[i]))
        p, q = a[i][order], b[j][order]
        first = order[np.concatenate([[True], (p[1:] != p[:-1]) | (q[1:] != q[:-1])])] if len(order) else order
        return [x[key].take(pa.array(i[first])), x["a"].take(pa.array(i[first])), y["b"].take(pa.array(j[first])), pa.array(distance[first], pa.int32())]

    return block_join(left, right, key, "a", "b", near, f"`{key}` {kind}, a {ids[0]}, b {ids[1]}, distance int")


def equal_ids(a: pa.ChunkedArray, b: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of equal values that aren't null."""
    known = b.unique().drop_null()
    x, y = (pc.fill_null(pc.index_in(c.cast(b.type), known), -1).to_numpy().astype(np.int64) for c in (a, b))
    order = np.argsort(y, kind="stable")
    begin, end = (np.searchsorted(y[order], np.maximum(x, 0), side) for side in ("left", "right"))
    n = np.where(x < 0, 0, end - begin)
    i = np.repeat(np.arange(len(x)), n)
    return i, order[np.repeat(begin - np.cumsum(n) + n, n) + np.arange(len(i))]


def in_order(t: pa.Table, column: str) -> pa.Table:
    return t.take(pc.sort_indices(t[column], null_placement="at_start"))


def stacked(parts: Iterator[tuple[np.ndarray, ...]], width: int) -> list[np.ndarray]:
    """Columns of all parts."""
    every = list(parts)
    return [np.concatenate([p[k] for p in every]) if every else np.zeros(0, np.int64) for k in range(width)]
