"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions only.

Sources by code point, null last, weigh 1, 2, 3, 1, 2, 3, ... and share the number of all words. A target stops at
MOST times its source's size; what is above is shared again by weight among the others, until none is above.

The mix is cut into blocks of equally many words. Sainte-Laguë's method gives them to the sources by highest
quotients target / (2 k + 1), no source more than MOST times its words; the lowest quotient that still gets a block is
searched for by counting, and only the last LISTED quotients are listed. Of a source's blocks a shard of the mix gets those whose quotients fall into its part
of the sequence: an integer quota for each source and shard.

A source's documents stand in the order of a seeded hash, as one stream of words. The source is taken whole as
often as its quotas ask for; of the full blocks of the stream the remaining ones are selected at even steps from a seeded start, and the rest is taken from
its last, partial block. How much of a document that is follows from the words before it in the stream, which are sums over hash
buckets and then over one bucket: a hot source is no hot task, and texts are never shuffled.

A block has BLOCK words, in a mix of fewer than BLOCKS such blocks as many fewer: then rounding by a block is less than 1 / BLOCKS of the mix.
A source takes its target to within about two blocks.

Defined results: null, empty and word-less texts have size 0 and take 0 words. A null source is a source, the last in order; a
source without words has target 0. Null ids are ids like any other, repeated rows each get a row and their own place
in the stream. Other columns are ignored. Of an empty table nothing comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MOST = 3
WEIGHTS = (1, 2, 3)
BLOCK, BLOCKS = 32, 1 << 16
SHARDS = 16
SEED = 12
#: Hexadecimal digits of the hash that name a bucket of a source's stream.
_DIGITS = 3
#: Quotients tried at once, and those that are listed and sorted once so few are left to choose from.
_TRIES, LISTED = 63, 1 << 16
_WIDE = "decimal(18,0)"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def block_words(words: int, block: int = BLOCK, blocks: int = BLOCKS) -> int:
    return max(1, min(block, words // blocks))


def ranked(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with rank, from 0 by code point with null last, and weight. One small row per source; they are sorted in parts."""
    ordered = sources.orderBy(F.col("source").asc_nulls_last()).select("source", "source_size", F.monotonically_increasing_id().alias("at"))
    ordered = materialize(ordered, "sources")
    part = F.shiftright("at", 33)
    firsts, total = [], 0
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row per partition of the sort
        firsts += [F.lit(r.part), F.lit(total)]
        total += r["count"]
    first = F.element_at(F.create_map(*firsts), part) if firsts else F.lit(0)
    rank = (first + F.col("at") - F.shiftleft(part, 33)).cast("long")
    return ordered.select("source", "source_size", rank.alias("rank")).withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS)).cast("int")))


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources (source_size, weight) with target. Each round is one sum over the sources; a source that is above once stays so."""
    first = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    words, weight = first.words, first.weight

    def above() -> Column:
        return F.col("weight").cast(_WIDE) * F.lit(words).cast(_WIDE) > F.col("source_size").cast(_WIDE) * F.lit(most * weight).cast(_WIDE)

    while weight:
        got = sources.filter(above()).agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
        now = first.words - most * got.words, first.weight - got.weight
        if now == (words, weight):
            break
        words, weight = now
    share = (F.col("weight").cast(_WIDE) * F.lit(words).cast(_WIDE)).cast("double") / F.lit(float(max(weight, 1)))
    return sources.withColumn("target", F.when(above() | F.lit(not weight), (F.col("source_size") * most).cast("double")).otherwise(share))


def _seats(quotient: Column, block: int, most: int) -> Column:
    """How many of a source's quotients target / (2 k + 1) are at least `quotient`, and blocks that it can give."""
    room = F.ceil(F.col("source_size") * most / F.lit(block)).cast("long")
    return F.least(room, F.floor((F.col("target") / quotient + 1) / 2).cast("long"))


def apportion(sources: DataFrame, blocks: int, block: int, most: int = MOST) -> DataFrame:
    """sources (source_size, target, rank) with seats: `blocks` blocks by highest quotients, of equal ones those of the first sources."""
    top = sources.agg(F.max("target").alias("t"), F.sum(F.when(F.col("target") > 0, F.ceil(F.col("source_size") * most / F.lit(block)))).alias("room")).first()
    if not top.t or not blocks:
        return sources.withColumn("seats", F.lit(0).cast("long"))
    blocks = min(blocks, int(top.room))

    def count(tries: list[float]) -> list[int]:
        each = sources.select(F.posexplode(F.array(*map(F.lit, tries))).alias("k", "q"), "source_size", "target")
        return [r.n for r in each.groupBy("k").agg(F.sum(_seats(F.col("q"), block, most)).alias("n")).orderBy("k").collect()]  # one row per try

    low, high, above = top.t / (2 * blocks), top.t * 1.5, 0  # `above` blocks go for quotients of at least `high`
    while count([low])[0] < blocks:
        low /= 16
    while True:
        step = (high / low) ** (1 / (_TRIES + 1))
        tries = sorted({low, *(low * step**k for k in range(1, _TRIES + 1)), high})
        got = count(tries)
        k = max(i for i, n in enumerate(got) if n >= blocks)
        if got[k] == blocks:
            return sources.withColumn("seats", _seats(F.lit(tries[k]), block, most))
        done = got[k] - got[k + 1] <= LISTED or tries[k + 1] <= tries[k] * (1 + 1e-15)
        low, high, above = tries[k], tries[k + 1], got[k + 1]
        if done:
            break
    both = sources.withColumn("seats", _seats(F.lit(high), block, most)).withColumn("until", _seats(F.lit(low), block, most))
    listed = both.filter("until > seats").select("rank", F.explode(F.sequence("seats", F.col("until") - 1)).alias("k"), "target")
    last = listed.orderBy((F.col("target") / (2 * F.col("k") + 1)).desc(), "rank").limit(blocks - above).groupBy(F.col("rank").alias("_rank")).agg(F.count("*").alias("_more"))
    out = both.join(last, F.col("rank") == F.col("_rank"), "left")
    return out.withColumn("seats", F.col("seats") + F.coalesce("_more", F.lit(0))).drop("until", "_rank", "_more")


def quotas(sources: DataFrame, shards: int = SHARDS) -> DataFrame:
    """source, shard and quota (blocks) of sources (source, seats). The k-th of a source's quotients stands at (2 k + 1) / (2 seats) of the sequence; a shard has an equal part of that."""
    until = lambda k: F.floor((2 * F.col("seats") * k + shards) / F.lit(2 * shards))
    return sources.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).withColumn("quota", (until(F.col("shard") + 1) - until(F.col("shard"))).cast("long"))


def _taken(at: Column, block: int, most: int) -> Column:
    """Words taken of the first `at` words of a source's stream. Columns: source_size, quota, start (seeded)."""
    size, wide = F.col("source_size"), lambda c: c.cast("decimal(19,0)")
    drawn = F.least(F.col("quota") * block, size * most)
    whole = F.floor(drawn / F.greatest(size, F.lit(1)))
    rest = drawn - whole * size
    full = F.floor(size / F.lit(block))
    picked = F.least(full, F.floor(rest / F.lit(block)))
    tail = F.least(rest - picked * block, size - full * block)
    # of the first b full blocks these many are selected
    before = lambda b: F.floor((wide(b) * wide(picked) + wide(F.col("start"))) / wide(F.greatest(full, F.lit(1)))).cast("long")
    b = F.floor(at / F.lit(block))
    inside = before(b) * block + (at - b * block) * (before(b + 1) - before(b))
    return whole * at + F.when(at >= full * block, picked * block + F.least(at - full * block, tail)).otherwise(inside)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS, seed: int = SEED, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """For each row of docs doc_id, source, size, source_size, target and taken; and the quotas of sources and shards, in blocks."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")))
    rows = rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")).withColumn("h", key).withColumn("bucket", F.substring("h", 1, _DIGITS))
    rows = materialize(rows, "mix-rows")
    buckets = materialize(rows.groupBy("source", "bucket").agg(F.sum(F.col("size") * F.col("copies")).alias("words")), "mix-buckets")

    sources = materialize(targets(ranked(buckets.groupBy("source").agg(F.sum("words").alias("source_size"))), most), "mix-sources")
    words = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    block = block_words(words)
    sources = apportion(sources, -(-words // block), block, most)
    shared = materialize(quotas(sources, shards).select("source", "source_size", "target", "shard", "quota"), "mix-quotas")

    full = F.greatest(F.floor(F.col("source_size") / F.lit(block)), F.lit(1))
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")))
    start = F.pmod(F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"), full).alias("start")
    per = shared.groupBy("source", "source_size", "target").agg(F.sum("quota").alias("quota")).select(F.col("source").alias("_source"), "source_size", "target", "quota", start)
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = buckets.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), before.alias("first"))
    firsts = firsts.join(per.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")

    own = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(own), F.lit(0)))
    placed = placed.join(firsts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("at", F.col("first") + F.col("before") + F.col("copy") * F.col("size"))
    taken = _taken(F.col("at") + F.col("size"), block, most) - _taken(F.col("at"), block, most)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken")), shared.select("source", "shard", "quota")
