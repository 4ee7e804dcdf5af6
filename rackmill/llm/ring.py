"""Shards by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring is the range of a 64-bit hash of a row's key, in CELLS equal cells. Each shard has VNODES
virtual nodes on it, at cells given by the hash of (shard, replica). A key belongs to the first
virtual node at or after its cell; keys that overflow a full shard continue clockwise to the next virtual
node whose shard has room. Loads are bounded by the row count: shard i takes
floor(N / shards) rows, the first N mod shards one more, so in the end counts are at most one apart (law `rows`).

What has to be decided is decided on the histogram of the ring, at most CELLS numbers whatever
the input: the plan lists for each cell which of its rows, by rank, go to which shard and which slots they
get. Rows find their rank within their cell by a window over (cell), after equal rows have been
counted, so that a hot key, or many copies of a row, are no hot task; the text itself is never shuffled.

Defined results: a null text has 0 bytes and the crc32 of the empty text; null ids are keys like
any other; repeated rows each get a slot of their own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1 << 14
VNODES = 64
OVERHEAD = 16


def ring(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes in ring order; of those in one cell, the order is by hash. A shard's nodes don't depend on the number of shards."""
    nodes = []
    for s in range(shards):
        for r in range(vnodes):
            h = int.from_bytes(hashlib.sha256(f"{s}/{r}".encode()).digest()[:8], "big")
            nodes.append((h * cells >> 64, h, s))
    return [(c, s) for c, _, s in sorted(nodes)]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def plan(counts: dict[int, int], shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, rank after the last, shard, first slot) for all rows of a ring histogram.

    First each shard keeps what belongs to its virtual nodes, in ring order, as far as it has room; what
    overflows then continues clockwise, in ring order from where it was turned away.
    """
    nodes = ring(shards, vnodes, cells)
    room = capacities(sum(counts.values()), shards)
    used = [0] * shards
    out: list[tuple[int, int, int, int, int]] = []
    turned: list[tuple[int, int, int, int]] = []  # cell, ranks, and the node it was turned away from

    def take(cell: int, lo: int, hi: int, node: int) -> int:
        s = nodes[node % len(nodes)][1]
        n = min(hi - lo, room[s])
        if n:
            out.append((cell, lo, lo + n, s, used[s]))
            room[s] -= n
            used[s] += n
        return lo + n

    node = 0
    for cell in sorted(counts):
        while node < len(nodes) and nodes[node][0] < cell:
            node += 1
        lo = take(cell, 0, counts[cell], node)
        if lo < counts[cell]:
            turned.append((cell, lo, counts[cell], node))
    for cell, lo, hi, at in turned:
        step = at
        while lo < hi:
            step += 1
            lo = take(cell, lo, hi, step)
    return out


def cell_of(key: Column, cells: int = CELLS) -> Column:
    """The leading bits of a 64-bit hash."""
    return F.shiftrightunsigned(key, 64 - (cells - 1).bit_length()).cast("int")


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for each row of docs."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "size", "text_crc32")).withColumn("cell", cell_of(F.col("h")))
    counts = {r.cell: r.n for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most CELLS rows
    pieces = plan(counts, shards, vnodes)
    # a constant of the plan: at most CELLS cells, and a further piece for each full shard that a cell meets
    listed = ";".join(f"{c},{a},{b},{s},{t}" for c, a, b, s, t in pieces)
    part = F.split("piece", ",")
    names = ("cell", "a", "b", "shard", "base")
    table = spark.range(1).select(F.explode(F.split(F.lit(listed), ";")).alias("piece")).filter("piece <> ''")
    table = table.select(*(part[k].cast("int" if n in ("cell", "shard") else "long").alias(n) for k, n in enumerate(names)))
    same = rows.groupBy("cell", "h", "doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    order = Window.partitionBy("cell").orderBy("h", "doc_id", "size", "text_crc32")
    ranked = same.withColumn("before", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("copies"))
    # the ranks of equal rows that fall into a piece
    joined = ranked.join(F.broadcast(table), "cell").withColumns({"lo": F.greatest("before", "a"), "hi": F.least(F.col("before") + F.col("copies"), F.col("b"))}).filter("lo < hi")
    placed = joined.withColumn("rank", F.explode(F.sequence("lo", F.col("hi") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("base") + F.col("rank") - F.col("a")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
