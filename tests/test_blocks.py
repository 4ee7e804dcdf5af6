"""All pairs in blocks against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from rackmill.functions import similarity as sim
from rackmill.operators import blocks, match

VECTORS = "v int, g string, x array<double>"


@pytest.fixture
def small_blocks(monkeypatch):
    """Several blocks to a key and several tiles to a block."""
    for name, n in (("ROWS", 16), ("TILE", 4), ("WIDTH", 5), ("PIECE", 7)):
        monkeypatch.setattr(blocks, name, n)


def vectors(rng, n):
    """With ties, copies, other sizes, nulls, NaN and infinities."""
    rows = [(k, rng.choice("ab"), [float(rng.randint(-2, 2)) for _ in range(4)]) for k in range(n)]
    odd = [None, [], [1.0, None, 1.0, 1.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 0.0, 1.0], [0.0] * 4, [1.0, 2.0], [1e200] * 4]
    return rows + [(n + k, "a", x) for k, x in enumerate(odd)] + [(n + 20, None, [1.0] * 4)]


def ranked(d, key, order, k):
    return match.top_k(d, key, order, k).drop("rank")


def test_two_stage_is_the_join(spark, small_blocks):
    e = spark.createDataFrame(vectors(random.Random(1), 70), VECTORS)
    q, r = e.select(F.col("v").alias("q_id"), "g", F.col("x").alias("q_feat")), e.select(F.col("v").alias("r_id"), "g", F.col("x").alias("r_feat"))
    head = lambda c: F.slice(c, 1, 2)
    pairs = q.join(r, "g").filter("q_id <> r_id").withColumns({"cheap": sim.dot(head("q_feat"), head("r_feat")), "score": sim.dot(F.col("q_feat"), F.col("r_feat"))})
    want = ranked(ranked(pairs, ["q_id"], [F.desc("cheap"), F.asc("r_id")], 3), ["q_id"], [F.desc("score"), F.asc("r_id")], 1)
    columns = ["q_id", "r_id", "cheap", "score"]
    assert sorted(map(str, match.two_stage(q, r, "g", 2, 3, others=True).select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_two_stage_makes_no_row_for_each_pair(spark):
    """A row for each of the best of a block, not 2,000 for each query."""
    e = spark.range(2000).select("id", F.lit(1).alias("g"), F.array((F.col("id") % 97).cast("double"), (F.col("id") % 89).cast("double")).alias("x"))
    q, r = e.select(F.col("id").alias("q_id"), "g", F.col("x").alias("q_feat")), e.select(F.col("id").alias("r_id"), "g", F.col("x").alias("r_feat"))
    plan = match.two_stage(q, r, "g", 1)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "q_feat" not in plan.split("FlatMapGroupsInArrow")[0]


def test_cascade_is_the_join(spark, small_blocks):
    """Kinds of references are filtered without the query's own row; a query without a vendor goes through all."""
    rng = random.Random(2)
    rows = [(v, g and f"Vendor {g.upper()}", x, rng.choice((8, 12, 48)), rng.choice((None, 1, 2)), rng.choice(("LEFT", "RIGHT"))) for v, g, x in vectors(rng, 60)]
    base = spark.createDataFrame(rows, "image int, vendor string, embedding array<double>, ports int, num_rows int, arrangement string").withColumn("filename", F.format_string("f%03d", "image"))
    asks = base.withColumns({"num_ports": F.get(F.array(F.lit(None), F.lit(0), F.lit(10), F.lit(48), F.lit(30)), F.col("image") % 5), "arrangement": F.when(F.col("image") % 4 > 0, F.col("arrangement")), "vendor": F.when(F.col("image") % 6 > 0, F.col("vendor"))})
    q = asks.select("image", F.col("filename").alias("own"), "embedding", "vendor", "num_ports", "num_rows", "arrangement")
    r = base.select("vendor", "filename", "embedding", "num_rows", "arrangement", "ports")
    a, b = q.toDF("image", "own", "x", "q_vendor", "q_ports", "q_rows", "q_arr"), r.toDF("vendor", "filename", "y", "num_rows", "arrangement", "ports")
    pairs = a.join(b, (F.col("q_vendor").isNull() | (F.col("q_vendor") == F.col("vendor"))) & (F.col("own") != F.col("filename")))
    flags = [(F.coalesce("q_ports", F.lit(0)) == 0) | F.array_contains(match._nearest(F.col("q_ports")), F.col("ports")), (F.coalesce("q_rows", F.lit(0)) == 0) | (F.col("q_rows") == F.col("num_rows")), F.col("q_arr").isNull() | (F.col("q_arr") == F.col("arrangement"))]
    left = match.cascade(pairs, ["image"], flags).withColumn("similarity", sim.cosine(F.col("x"), F.col("y")))
    want = ranked(left, ["image"], [F.desc("similarity"), F.asc("filename")], 1).select("image", "vendor", "filename", F.round("similarity", 6).alias("similarity"))
    assert sorted(map(str, match.match_models(q, r, "own").collect())) == sorted(map(str, want.collect()))


def test_alike_is_the_join(spark, small_blocks):
    e = spark.createDataFrame(vectors(random.Random(3), 60), VECTORS)
    x, y = e.select("g", F.col("v").alias("a"), "x"), e.select("g", F.col("v").alias("b"), F.col("x").alias("y"))
    want = x.join(y, "g").filter("a < b").withColumn("score", sim.dot(F.col("x"), F.col("y"))).filter("score >= 3").select("g", "a", "b", "score")
    assert sorted(map(str, blocks.alike(e, "g", "v", "x", 3.0).collect())) == sorted(map(str, want.collect()))


def test_near_hashes_meet_in_blocks(spark, small_blocks):
    """Short bands, in which most pairs meet, and long ones; both without a join of rows on them."""
    rng = random.Random(4)
    rows = [(k % 2, k, rng.getrandbits(32)) for k in range(150)]
    d = spark.createDataFrame(rows, "g int, i int, h long")
    for most in (9, 2):
        near = match.near_hashes(d.select("g", F.col("i").alias("a"), F.col("h").alias("hash")), d.select("g", F.col("i").alias("b"), F.array("h").alias("variants")), "g", most, bits=32)
        assert "FlatMapGroupsInArrow" in near._jdf.queryExecution().executedPlan().toString()
        assert {(r.a, r.b) for r in near.collect()} == {(a, b) for g, a, h in rows for k, b, v in rows if g == k and (h ^ v).bit_count() <= most}
