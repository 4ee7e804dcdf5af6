"""Streams against the same over all rows, files in any letter case, pruning by vendor, near hashes against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from rackmill.operators import jobs, match
from rackmill.sources import readers, sinks
from rackmill.streaming import feed


def run(stream, spark, tmp_path, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture
def events(spark, sf, tmp_path):
    """Events in order of time, in four files, so that none is late."""
    e = spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").limit(2000)
    rows = [tuple(r) for r in e.select("event_id", "ts", "user_id", "event_type", "value").collect()]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    every = spark.createDataFrame(rows, schema)
    for k in range(4):
        spark.createDataFrame(rows[500 * k : 500 * (k + 1)] + rows[500 * k : 500 * k + 3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return every, feed.read(spark, f"{tmp_path}/in", schema, 1), len(rows)


def test_duplicates_go(spark, events, tmp_path):
    every, stream, n = events
    got = run(feed.deduplicated(stream, ["event_id"], "100 days"), spark, tmp_path, "once", "append")
    assert got.count() == n and {r.event_id for r in got.collect()} == {r.event_id for r in every.collect()}


def test_latest_status_of_a_stream(spark, events, tmp_path):
    every, stream, _ = events
    got = {(r.user_id, r.status, r.at) for r in run(feed.latest_status(stream), spark, tmp_path, "latest", "complete").collect()}
    assert got == {(r.user_id, r.status, r["at"]) for r in feed.latest_status(every).collect()}


def test_sessions_of_a_stream(spark, events, tmp_path):
    """Sessions that the watermark has passed, each as over all rows."""
    every, stream, n = events
    got = {(r.user_id, r.start): (r.end, r.n) for r in run(feed.sessions(stream), spark, tmp_path, "visits", "append").collect()}
    starts = {}
    for r in sorted(every.collect(), key=lambda r: (r.user_id, r.ts)):
        own = starts.setdefault(r.user_id, [])
        if own and (r.ts - own[-1][1]).total_seconds() < 1800:
            own[-1][1] = r.ts
        else:
            own.append([r.ts, r.ts])
    assert got
    for (user, start), (end, count) in got.items():
        mine = [s for s in starts[user] if s[0] == start]
        assert mine and (end - mine[0][1]).total_seconds() == 1800 and count >= 1


def test_extensions_in_any_case(spark, tmp_path):
    for name in ("a.JPG", "b.Jpeg", "c.pNg", "d.txt", "e.TIF", "f.jpgx", "sub/g.WebP"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    names = lambda df: {r.path.rsplit("/", 1)[1] for r in df.select("path").collect()}
    assert names(readers.files(spark, str(tmp_path))) == {"a.JPG", "b.Jpeg", "c.pNg", "e.TIF", "g.WebP"}
    (tmp_path / "v.MoV").write_bytes(b"x")
    assert names(readers.first_video(spark, str(tmp_path))) == {"v.MoV"}


def test_vectors_of_one_vendor_read_one_folder(spark, tmp_path):
    rows = [(f"V {k % 5}", f"p{k}", [float(k)]) for k in range(50)]
    sinks.vectors(spark.createDataFrame(rows, "vendor string, path string, embedding array<double>"), f"{tmp_path}/v")
    one = readers.vectors(spark, f"{tmp_path}/v").filter("vendor = 'v3'")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(vendor" in plan and one.count() == 10
    # by a join, the folders are pruned when the other side is known
    asked = spark.createDataFrame([("v1", "x"), ("v1", "y")], "vendor string, q string").filter("q = 'x'")
    joined = readers.vectors(spark, f"{tmp_path}/v").join(F.broadcast(asked), "vendor")
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 10
    listing = spark.createDataFrame([("p7",), ("zz",)], "path string")
    assert readers.still_valid(readers.vectors(spark, f"{tmp_path}/v"), listing) and not readers.still_valid(readers.vectors(spark, f"{tmp_path}/v"), listing.filter("path = 'zz'"))


@pytest.mark.parametrize(("bits", "most"), [(64, 12), (32, 5), (64, 0), (16, 15)])
def test_near_hashes_are_the_loop(spark, bits, most):
    rng = random.Random(bits + most)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    base = [rng.getrandbits(bits) for _ in range(8)]
    close = lambda h: h ^ sum(1 << b for b in rng.sample(range(bits), rng.randint(0, min(most + 3, bits))))
    left = [(k % 3, k, signed(close(rng.choice(base)))) for k in range(60)] + [(1, 900, None), (None, 901, 5)]
    right = [(k % 3, k, [signed(close(rng.choice(base))) for _ in range(rng.randint(0, 4))] + ([None] if k % 7 == 0 else [])) for k in range(60)] + [(1, 902, None)]
    got = [(r.key, r.a, r.b, r.distance) for r in match.near_hashes(spark.createDataFrame(left, "key int, a int, hash long"), spark.createDataFrame(right, "key int, b int, variants array<long>"), "key", most, bits).collect()]
    want = set()
    for k, a, h in left:
        for j, b, vs in right:
            d = [((h ^ v) & ((1 << 64) - 1)).bit_count() for v in vs or [] if v is not None and h is not None]
            if k == j and k is not None and d and min(d) <= most:
                want.add((k, a, b, min(d)))
    assert len(got) == len(set(got)) and set(got) == want


def test_input_folders(spark):
    files = ["job_1/output/rack/a.png", "job_1/input/x.txt", "job_1/output/b.png", "job_2/q/z.JPG", "job_2/a/b/c.bmp", "job_3/input/deep/a.png", "job_3/images/b.png", "job_4/readme.md", "job_5/top.png"]
    inv = jobs.output_inventory(spark.createDataFrame([(f"/x/{f}",) for f in files], "path string"))
    got = {(r.job_id, r.folder, r.relative) for r in jobs.input_images(inv).collect()}
    assert got == {("job_1", "output/rack", "output/rack/a.png"), ("job_2", "a/b", "q/z.JPG"), ("job_2", "a/b", "a/b/c.bmp"), ("job_3", "images", "images/b.png"), ("job_5", "", "top.png")}
