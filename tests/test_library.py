"""Golden rows, properties and SQL twins of the audit operators."""

import difflib
import glob
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rackmill.functions import geometry as g
from rackmill.functions import similarity as sim
from rackmill.functions import text as tx
from rackmill.operators import cluster, documents, jobs, match, spatial
from rackmill.plans import QUERIES, SQL
from rackmill.sources import readers, sinks
from rackmill.streaming import feed

BOX = "struct<x1:int,y1:int,x2:int,y2:int>"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def values(spark, rows, column, schema="s string"):
    d = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, {schema}")
    return [r.x for r in d.select("k", column.alias("x")).orderBy("k").collect()]


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if str(df[k].dtype).startswith("float"):
            df[k] = df[k].map(lambda x: "" if pd.isna(x) else f"{x:.5f}".rstrip("0").rstrip("."))
        else:
            df[k] = df[k].map(lambda x: "" if x is None or (not isinstance(x, (list, np.ndarray)) and pd.isna(x)) else str(x))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    a, b = QUERIES[name](spark, sf).toPandas(), c.sql(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    a, b = tidy(a), tidy(b)
    assert len(a) == len(b) and (a.values == b.values).all()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_containment(spark):
    want = {(10, 10, 30, 30): "Valid", (-3, 10, 17, 30): "Valid", (-4, 10, 16, 30): "Port not contained", (10, 75, 30, 95): "Valid", (10, 76, 30, 96): "Port not contained", (200, 10, 220, 30): "Invalid Parent", (100, 10, 120, 30): "Invalid Parent", (10, 10, 10, 30): "Invalid Parent"}
    parent = g.box(F.lit(0), F.lit(0), F.lit(100), F.lit(100))
    assert values(spark, list(want), g.containment(F.col("s"), parent), f"s {BOX}") == list(want.values())


def test_iou(spark):
    base = g.box(F.lit(0), F.lit(0), F.lit(10), F.lit(10))
    got = values(spark, [(0, 0, 10, 10), (5, 0, 15, 10), (6, 0, 16, 10), (10, 0, 20, 10), (0, 0, 0, 0)], g.iou(base, F.col("s")), f"s {BOX}")
    assert got == pytest.approx([1, 1 / 3, 0.25, 0, 0])


def test_scalar_functions(spark):
    names = ["WS-C2960-24TT", "GS1900-48", "GS24", "DGS1210", "DGS-1210-28", "CRS328-24P-4S+RM", "XS1930"]
    assert values(spark, names, tx.port_count(F.col("s"))) == [24, 48, 24, 10, 28, 24, 30]
    assert values(spark, [0, 10, 18, 26, 30, 38, 100], g.nearest_ports(F.col("s")), "s int") == [[8, 12, 16], [8, 12, 16], [16, 20, 12], [24, 28, 20], [28, 24, 20], [28, 48, 24], [48, 28, 24]]
    assert values(spark, [1, 2, 3, 4, 11, 12, 13, 21, 42, 111], tx.ordinal(F.col("s")), "s int") == "1st 2nd 3rd 4th 11th 12th 13th 21st 42nd 111th".split()
    assert values(spark, ['Great Lakes s\\x 19"'], tx.compact(F.col("s"))) == ["greatlakess\\x19"]
    assert values(spark, ["usb_a 2b"], tx.title(F.col("s"))) == ["Usb_A 2B"]
    tokens = ["Black", "Whi", "Gr", "Y", "ow", "Reddish", "Teal"]
    assert values(spark, [f"RJ45_{t}" for t in tokens], tx.colours(F.col("s"))) == [["Black"], ["White"], ["Green"], ["Grey"], ["Yellow"], ["Red"], ["Teal"]]
    assert values(spark, [0.75, 0.7499, 0.4, 0.3999], g.confidence_band(F.col("s")), "s double") == ["high", "medium", "medium", "low"]
    assert values(spark, [0, 12, 13, 16, 17, 40], sim.hash_similarity(F.lit(0).cast("long"), F.shiftright(F.lit(-1).cast("long"), 0).bitwiseAND(F.expr("shiftleft(1L, s) - 1"))), "s int") == pytest.approx([1, 0.625, 0.59375, 0.5, 0.46875, 0])
    assert values(spark, ["job_0_ab", "nothing"], tx.job_time(F.col("s")))[1] is None
    stop = tx.placeholder(F.col("s"), ["not detected"], ["model", "vendor"])
    assert values(spark, ["Not Detected", "Model name", "ABC DEF", "Cisco systems x", None], stop) == [None, None, None, "Cisco systems x", None]
    assert values(spark, ["a (b), c\nd;", None], tx.parts(F.col("s"))) == [["a (b)", "c", "d", "a"], []]
    assert values(spark, ["One two. Three four."], tx.bullets(F.col("s"))) == ["- One two.\n- Three four."]


def test_html(spark):
    html = ["<p>short</p>", '<img src="x">', "<table><tr><th>Header long</th></tr></table>", "<table><tr><th>H</th></tr><tr><td>data</td></tr></table>", "x" * 31, None]
    assert values(spark, html, tx.html_meaningful(F.col("s"))) == [False, True, False, True, True, False]
    keyed = "<table><tr><td>A</td><td>1</td></tr><tr><td>B</td><td> <b>2</b> </td></tr><tr><td>a</td><td>3</td></tr></table>"
    assert values(spark, [keyed], tx.html_keyed(F.col("s"))) == [{"a": "3", "b": "2"}]


def test_tiles(spark):
    t = one(spark, g.tiles(F.lit(250), F.lit(100), (100, 100), 0.2))
    assert [tuple(b) for b in t] == [(0, 0, 100, 100), (80, 0, 180, 100), (0, 0, 100, 100), (80, 0, 180, 100), (150, 0, 250, 100), (150, 0, 250, 100)]
    assert len(one(spark, g.tiles(F.lit(1920), F.lit(1080), (1200, 1200), 0.15))) == 4


def test_string_ratios(spark):
    d = spark.createDataFrame([("rj 45 black", "rj 45"), ("wsc2960x24ts", "wsc2960x24tsl"), ("dgs1210", "dgs1510"), ("", ""), (None, "x")], "a string, b string")
    got = [tuple(r) for r in d.select(sim.sequence_ratio(F.col("a"), F.col("b")), sim.indel_ratio(F.col("a"), F.col("b"))).collect()]
    assert got[0][0] == pytest.approx(0.625) and got[1][1] == pytest.approx(96.0) and got[2][1] == pytest.approx(85.7142857) and got[4] == (None, None)
    assert sim._token_set("a b c", "c a") == 100 and sim._partial("abc", "xxabcxx") == 100


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
def test_lcs_is_the_table_method(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for k in range(len(b)):
            t[i + 1][k + 1] = t[i][k] + 1 if a[i] == b[k] else max(t[i][k + 1], t[i + 1][k])
    assert sim._lcs(a, b) == t[-1][-1]


def test_soft_nms_and_fusion():
    b, s = np.array([[0, 0, 10, 10], [1, 0, 11, 10], [50, 50, 60, 60]], float), np.array([0.9, 0.8, 0.3])
    keep, decayed = cluster.soft_nms_kernel(b, s)
    assert keep == [0, 2, 1] and decayed[2] == pytest.approx(0.209719, abs=1e-6)
    box, score, members = cluster.fuse_kernel(b, s)[0]
    assert box == pytest.approx([0.470588, 0, 10.470588, 10], abs=1e-6) and score == 0.9 and members == [0, 1]


boxes = st.lists(st.tuples(st.integers(0, 50), st.integers(0, 50), st.integers(1, 40), st.integers(1, 40), st.integers(1, 99)), min_size=1, max_size=15)


@given(boxes)
@settings(max_examples=60)
def test_box_kernels(rows):
    b = np.array([[x, y, x + w, y + h] for x, y, w, h, _ in rows], float)
    s = np.array([r[4] / 100 for r in rows])
    keep, _ = cluster.soft_nms_kernel(b, s)
    assert keep and len(set(keep)) == len(keep) and s[keep[0]] == s.max()
    fused = cluster.fuse_kernel(b, s)
    assert sorted(i for _, _, m in fused for i in m) == list(range(len(rows)))
    for box, _, m in fused:
        assert (box[:2] >= b[m, :2].min(0) - 1e-9).all() and (box[2:] <= b[m, 2:].max(0) + 1e-9).all()


def test_rows_and_leaders():
    assert cluster.rows_kernel([0, 14, 20, 21, 36, 60]) == [0, 0, 0, 0, 1, 2]
    assert cluster.rows_kernel([0, 15]) == [0, 1] and cluster.rows_kernel([0, 14.9]) == [0, 0]
    assert cluster.leader_kernel([0, (1 << 16) - 1, (1 << 17) - 1], 0.5) == [0, 0, 1]


def test_overlap_join_is_the_nested_loop(spark):
    rng = random.Random(6)
    make = lambda n: [(rng.randint(0, 2), k, ((x := rng.randint(-300, 900)), (y := rng.randint(-300, 900)), x + rng.randint(0, 700), y + rng.randint(0, 300))) for k in range(n)]
    a, b = make(60), make(60)
    left = spark.createDataFrame(a, f"image int, a int, box {BOX}")
    right = spark.createDataFrame(b, f"image int, b int, other {BOX}")
    got = sorted((r.image, r.a, r.b) for r in spatial.overlap_join(left, right).collect())
    want = sorted((i, k, m) for i, k, p in a for j, m, q in b if i == j and min(p[2], q[2]) > max(p[0], q[0]) and min(p[3], q[3]) > max(p[1], q[1]))
    assert got == want


def test_compat_assignment_repeats_ports(spark):
    ports = spark.createDataFrame([(1, 1, (10, 10, 30, 30))], f"image int, port_id int, box {BOX}")
    devices = spark.createDataFrame([(1, 1, "rack", 1, (0, 0, 500, 500)), (1, 2, "patch_panel", 2, (0, 0, 100, 100)), (1, 3, "switch", 3, (0, 0, 100, 100))], f"image int, dev_id int, kind string, ordinal int, box {BOX}")
    got = [(r.pass_no, r.validation, r.parent_id) for r in spatial.assign_parents(ports, devices, compat=True).orderBy("pass_no").collect()]
    assert got == [(1, "Orphaned Port", None), (2, "Valid", 2), (3, "Valid", 3)]
    assert spatial.assign_parents(ports, devices).first().parent_id == 3


def test_cascade_never_empties(spark):
    d = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (2, 3, 0), (2, 4, None)], "q int, r int, f int")
    got = sorted((r.q, r.r) for r in match.cascade(d, ["q"], [F.col("f") == 1, F.col("r") > 100]).collect())
    assert got == [(1, 2), (2, 3), (2, 4)]


def test_dedup_ties_and_nulls(spark):
    d = spark.createDataFrame([(3, " Ab "), (1, "aB"), (2, None), (4, "")], "k int, s string")
    assert sorted(r.k for r in match.keyed_distinct(d, ["s"], "k").collect()) == [1, 2]
    again = match.keyed_distinct(match.keyed_distinct(d, ["s"], "k"), ["s"], "k")
    assert sorted(r.k for r in again.collect()) == [1, 2]


def test_votes_and_vendors(spark):
    parts = spark.createDataFrame([(1, "Cisco systems"), (1, "Cisc0"), (1, "Netgear"), (2, "qqq zzz")], "image int, part string")
    aliases = spark.createDataFrame([(0, "Cisco", "cisco"), (1, "Netgear", "netgear")], "ord int, vendor string, alias string")
    got = {r.image: r.vendor for r in match.vendor_vote(parts, aliases).collect()}
    assert got[1] == "Cisco"
    fragments = spark.createDataFrame([(1, 1, "xx netgear"), (1, 0, "ciscx"), (2, 0, "cisko")], "image int, band int, text string")
    vendors = spark.createDataFrame([(0, "Cisco"), (1, "Netgear")], "ord int, vendor string")
    assert {r.image: r.vendor for r in match.early_vendor(fragments, vendors).collect()} == {1: "Netgear", 2: "Cisco"}


def test_sections_and_pairs(spark):
    text = "Rack Detection Report\nx\nOCR Vendor & Model Detection\nVendor: A\nModel: B\nempty port identification and location\nz\nConnected Port Classification\nPatch Panel Classification Results\nCable Classification Report\nRACK DETECTION REPORT\ny"
    d = spark.createDataFrame([("a", text)], "doc string, text string")
    got = {r.section: r.text.strip() for r in documents.sections(d).collect()}
    assert got["rack_details"] == "RACK DETECTION REPORT\ny" and got["switch_details"] == "OCR Vendor & Model Detection\nVendor: A\nModel: B"
    assert got["empty_ports"] == "empty port identification and location\nz" and got["connected_ports"] == "Connected Port Classification" and len(got) == 6
    pairs = documents.line_pairs(documents.lines(d)).collect()
    assert [(p.first, p.second) for p in pairs] == [("A", "B")]


def test_json_leaves(spark):
    d = spark.createDataFrame([("a", '{"x": ["p", {"y": "q"}], "n": 1}'), ("b", "{broken")], "doc string, json string")
    assert [r.leaf for r in documents.json_leaves(d).orderBy("path").collect()] == ["p", "q"] or {r.leaf for r in documents.json_leaves(d).collect()} == {"p", "q"}


def test_audit_document(spark, tmp_path):
    units = spark.createDataFrame([("j", 2, "switch", "V", None, None), ("j", 10, "patch_panel", None, None, None)], "job string, unit_no int, device_type string, vendor string, model string, description string")
    con = spark.createDataFrame([("j", 10, 1, "rj45", "d", None, "c", "N/A", "n/a"), ("j", 10, 2, "lc", "d", None, "c", "x", "n/a")], "job string, unit_no int, ord int, port string, port_description string, other_port string, cable string, cable_description string, usage string")
    emp = spark.createDataFrame([("j", 2, 1, "QSFP cage", "q")], "job string, unit_no int, ord int, type string, description string")
    u = documents.audit_document(units, con, emp).first().units
    assert [x.unit_id for x in u] == ["unit2", "unit10"] and u[0].empty_ports[0].port_id == "port_1" and u[0].empty_ports[0].port.type == "QSFP" and u[1].connected_ports[0].port_id == "port_2" and len(u[1].connected_ports) == 1
    assert [x.unit_id for x in documents.audit_document(units, con, emp, compat=True).first().units] == ["unit10", "unit2"]
    sinks.json_lines(documents.audit_document(units, con, emp), str(tmp_path / "j"))
    assert '"model"' not in open(glob.glob(str(tmp_path / "j" / "part*"))[0]).read()


def test_jobs(spark):
    folders = spark.createDataFrame([("job_abcdefgh1",), ("abcdefgh1-x",), ("abcdefgh1-y",)], "name string")
    wanted = spark.createDataFrame([("abcdefgh1",), ("nope",)], "job_id string")
    assert [(r.job_id, r.name) for r in jobs.resolve_folder(folders, wanted).collect()] == [("abcdefgh1", "job_abcdefgh1")]
    assert values(spark, ["/a/x", "/a/../b", "/c"], jobs.allowed_path(F.col("s"), ["/a"])) == [True, False, False]


def test_sources(spark, tmp_path):
    for n in ("a.JPG", "b.png", "c.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert readers.files(spark, str(tmp_path)).count() == 2
    (tmp_path / "d.csv").write_text("Model Name,Descr\nA/B,x\n")
    d = readers.first_readable(spark, [str(tmp_path / "none.csv"), str(tmp_path / "d.csv")])
    assert [tuple(r) for r in readers.discovered(d, [("model", "model"), ("description", "desc")]).collect()] == [("A/B", "x")]
    a = spark.createDataFrame([("Cisco, cisco inc ,,CSCO",)], "value string")
    assert {r.alias for r in readers.aliases(a).collect()} == {"Cisco", "cisco inc", "CSCO"}
    v = spark.createDataFrame([("A-1", [1.0]), ("b", [2.0])], "vendor string, embedding array<double>")
    sinks.vectors(v, str(tmp_path / "v"))
    assert readers.vectors(spark, str(tmp_path / "v")).filter("vendor = 'a1'").count() == 1


def test_stream_equals_batch(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "events.parquet").write_bytes(open(f"{sf}/events.parquet", "rb").read())
    s = feed.throughput(feed.read(spark, str(tmp_path / "in"), schema))
    q = s.writeStream.outputMode("complete").format("memory").queryName("throughput").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.start, r.event_type): r.n for r in spark.table("throughput").collect()}
    batch = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 hour"), "event_type").count()
    assert got == {(r.window.start, r.event_type): r["count"] for r in batch.collect()}


def test_rack_type_and_ensemble(spark):
    names = ["network rack", "wall mounted", "open rack"]
    p = F.array(F.lit(0.2), F.lit(0.7), F.lit(0.1))
    assert one(spark, g.rack_type(F.lit(10), F.lit(30), p, names)) == "network rack" and one(spark, g.rack_type(F.lit(30), F.lit(10), p, names)) == "wall mounted"
    d = spark.createDataFrame([("i", "m1", ["a", "b"], [0.4, 0.6]), ("i", "m2", ["a", "b"], [0.6, 0.4])], "image string, model string, class_names array<string>, probs array<double>")
    assert match.ensemble(d).first()["class"] == "b"
    assert math.isclose(sum(one(spark, sim.softmax(F.array(F.lit(1.0), F.lit(3.0))))), 1)


@pytest.fixture(scope="module")
def crowd(spark):
    """60,000 rows of one group."""
    i = F.col("id")
    return spark.range(60_000).select(F.lit(1).alias("image"), F.lit("c").alias("class"), i.alias("det_id"), (i * 31 % 1000 / 1000.0).alias("score"), *(c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), (i * 37 % 960, i * 53 % 560, i * 37 % 960 + 200, i * 53 % 560 + 90), strict=True)))


def test_box_operators_take_crowded_images(crowd):
    p = crowd.toPandas()
    b, s = p[["x1", "y1", "x2", "y2"]].to_numpy(float), p["score"].to_numpy()
    got = cluster.soft_nms(crowd).orderBy("keep_order").toPandas()
    assert got["det_id"].tolist() == cluster.soft_nms_kernel(b, s)[0]
    assert cluster.suppress_overlaps(crowd).orderBy("keep_order").toPandas()["det_id"].tolist() == cluster.suppress_kernel(b)
    fused = cluster.box_fusion(crowd).toPandas()
    assert fused["members"].sum() == len(p) and sorted(fused["score"]) == sorted(x for _, x, _ in cluster.fuse_kernel(b, s))


def test_leaders_and_rows_take_crowded_groups(crowd):
    n = 60_000
    points = crowd.select("image", F.col("det_id").alias("point_id"), (F.col("det_id") % 40).cast("double").alias("y"))
    got = cluster.row_cluster(points).orderBy("point_id").toPandas()["row_no"].to_numpy()
    want = cluster.rows_kernel(sorted(k % 40 for k in range(n)))
    assert len(got) == n and sorted(got) == sorted(want) and [got[k] for k in range(40)] == want[:: n // 40]
    crops = crowd.select("class", F.col("det_id").alias("crop_id"), (F.col("det_id") * 2654435761 % 4294967296).alias("phash"))
    groups = cluster.leader_cluster(crops, ["class"], 0.6).orderBy("crop_id").toPandas()["group_no"].tolist()
    assert groups == cluster.leader_kernel([k * 2654435761 % 4294967296 for k in range(n)], 0.6)


def test_matches_of_crowded_jobs(spark, crowd):
    """Against the rule itself, with images that straddle batches."""
    i = F.col("det_id")
    rows = crowd.select(F.lit("j").alias("job"), F.format_string("img%06d", (i / 7).cast("int")).alias("image"), (i % 7).alias("ord"), F.format_string("v%d", i * 31 % 9973 % 600).alias("vendor"), F.format_string("r%d", i).alias("ref"), (i * 17 % 100 / 100.0).alias("edge"), (i * 29 % 37 / 37.0).alias("feature"))
    seen, want = {}, {}
    for image, own in rows.toPandas().sort_values(["image", "ord"]).groupby("image"):
        scores = [0.55 * r.edge + 0.45 * (r.feature + 1) / 2 - 0.05 * seen.get(r.vendor, 0) for r in own.itertuples()]
        k = int(np.argmax(scores))
        score, v = scores[k], own["vendor"].iloc[k]
        if score >= 0.25:
            want[image] = score
            seen[v] = seen.get(v, 0) + 1
    got = cluster.penalised_match(rows).toPandas()
    assert dict(zip(got["image"], got["score"], strict=True)) == pytest.approx(want, abs=1e-6)


def test_composite_clusters_of_crowded_classes(spark):
    """30,000 crops, each a near copy of the first of its hundred; the pairs name the two in either order."""
    e = spark.range(30_000).select(F.lit("c").alias("class"), F.col("id"), (F.col("id") - F.col("id") % 100).alias("lead"))
    near = e.filter("id <> lead").select("class", F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(F.col("lead")).alias("a"), F.when(F.col("id") % 2 == 0, F.col("lead")).otherwise(F.col("id")).alias("b"), F.lit(0.9).alias("score"))
    pairs = near.unionByName(e.select("class", F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score")))
    got = cluster.composite_cluster(pairs).orderBy("crop_id").toPandas()
    assert got["crop_id"].tolist() == list(range(30_000)) and got["group_no"].tolist() == [k // 100 for k in range(30_000)]


@given(boxes, st.integers(1, 6))
@settings(max_examples=40)
def test_box_kernels_are_the_nested_loop(rows, scale):
    """Many copies of the boxes side by side, so that cells come in, against all pairs."""
    b = np.array([[x * scale + 90 * j, y * scale, x * scale + w + 90 * j, y * scale + h] for j in range(12) for x, y, w, h, _ in rows], float)
    s = np.array([r[4] / 100 for _ in range(12) for r in rows])
    iou = lambda k: cluster._ious(b, k, np.arange(len(b)))
    live, now, keep = np.ones(len(b), bool), s.copy(), []
    while live.any() and np.where(live, now, -1).max() >= 0.001:
        k = int(np.where(live, now, -1).argmax())
        keep.append(k)
        live[k] = False
        now = np.where(live, now * np.exp(-(iou(k) ** 2) / 0.5), now)
    assert cluster.soft_nms_kernel(b, s)[0] == keep
    used, members = np.zeros(len(b), bool), []
    for k in np.argsort(-s, kind="stable"):
        if not used[k]:
            own = ~used & (iou(k) >= 0.3)
            used |= own
            members.append(np.flatnonzero(own).tolist())
    assert [m for _, _, m in cluster.fuse_kernel(b, s)] == members


def test_folders_by_prefix(spark):
    names = ["abc-x", "abc-y", "job_abcdefgh1_2", "job_abcdefgh1_1", "job_", "q", "job_zz9", "zz1", "other"]
    ids = ["abc", "abcdefgh1", "q", "zz", "zz9", "nope", "job_zz", "abc-y-longer"]
    got = jobs.resolve_folder(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(i,) for i in ids], "job_id string")).collect()

    def want(i):
        found = [i] if i in names else [f"job_{i}"] if f"job_{i}" in names else [n for n in names if n.startswith((i, f"job_{i}"))]
        return max(found, default=None)

    assert {r.job_id: r.name for r in got} == {i: want(i) for i in ids if want(i)} and len(got) == 6


def test_json_leaves_of_deep_and_many_nodes(spark):
    deep = '{"a":[' * 60 + '"end"' + "]}" * 60
    wide = spark.range(11).select(F.concat(F.lit("w"), F.col("id")).alias("doc"), F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('"x"'), 100_000), ","), F.lit("]")).alias("json"))
    d = wide.unionByName(spark.createDataFrame([("deep", deep), ("top", '"t"'), ("none", None), ("mixed", '{"b": "2", "a": ["1", null, 3, {}, []]}')], "doc string, json string"))
    got = {r.doc: (r.n, r.first) for r in documents.json_leaves(d).groupBy("doc").agg(F.count("*").alias("n"), F.min(F.struct("path", "leaf")).alias("first")).collect()}
    assert set(got) == {*(f"w{k}" for k in range(11)), "deep", "top", "mixed"} and sum(n for n, _ in got.values()) == 1_100_004
    assert list(got["deep"][1].path) == [0] * 120 and got["deep"][1].leaf == "end" and got["top"][1].path == [] and got["mixed"][1].leaf == "1"


def test_first_image_is_directly_below_a_folder(spark):
    paths = ["/o/job_1/output/units/u1/switch/a.jpg", "/o/job_1/output/units/b.webp", "/o/job_2/switch/c.bmp", "/o/job_2/cable/d.JPEG", "/o/job_3/rack/x/e.png", "/o/job_4/output/rack/g.png", "/o/job_4/output/rack/f.png"]
    inventory = jobs.output_inventory(spark.createDataFrame([(p,) for p in paths], "path string"))
    got = {r.job_id: r.image for r in jobs.first_image(inventory).collect()}
    assert got == {"job_1": "output/units/b.webp", "job_2": "cable/d.JPEG", "job_4": "output/rack/f.png"}


def test_colours_and_name_scores(spark):
    assert values(spark, ["rj45_red RJ_45_infrared RJ-45-Gray RJ45_blues"], tx.colours(F.col("s"))) == [["Infrared", "Gray", "Blue"]]
    pairs = [("cisco systems switch", "cisco systems"), ("net gear", "netgear"), ("d-link.12", "d-link"), ("", "x"), ("x", "")]
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", sim.alias_score(F.col("a"), F.col("b")).alias("s"), sim.image_name_score(F.col("a"), F.col("b")).alias("t")).collect()
    for r in d:
        a, b = r.a.replace(".", " "), r.b

        def score(x, y, hold):
            return (hold if y and y in x else 0) + 0.6 * len(set(x.split()) & set(y.split())) / max(1, len(set(y.split()))) + 0.5 * difflib.SequenceMatcher(None, x, y).ratio()

        assert r.t == pytest.approx(score(a, b, 2)) and r.s == pytest.approx(score(r.a, r.b, 1) if r.a and r.b else 0)


def test_composite_groups_take_the_best_of_each_score(spark):
    """Crops 0 and 1 share a group; crop 2 is near 0 by one score and near 1 by the other, so only the bests together reach the limit."""
    rows = [(0, 0, 1.0, 1.0), (1, 1, 1.0, 1.0), (2, 2, 1.0, 1.0), (0, 1, 0.9, 0.9), (2, 0, 1.0, 0.2), (1, 2, 0.2, 1.0), (3, 3, 1.0, 1.0), (3, 0, float("nan"), 1.0), (3, 1, None, 1.0)]
    pairs = spark.createDataFrame([("c", *r) for r in rows], "class string, a long, b long, u double, v double")
    got = cluster.composite_cluster(pairs, weights={"u": 0.5, "v": 0.5}).orderBy("crop_id").collect()
    assert [r.group_no for r in got] == [0, 0, 0, 1]
    assert abs(sum(cluster.CROP_WEIGHTS.values()) - 1) < 1e-9
    assert cluster.composite_cluster(pairs.limit(0), weights={"u": 1.0}).count() == 0


def test_current_job_falls_back_twice(spark):
    sessions = spark.createDataFrame([("u", "job_9"), ("v", "job_0"), ("w", None)], "user_id string, job_id string")
    known = spark.createDataFrame([("job_9", "x", 1), ("job_1", "v", 1), ("job_2", "v", 2)], "job_id string, user_id string, created_at int")
    folders = spark.createDataFrame([("job_a", 1, True), ("job_b", 2, True), ("tmp", 3, True)], "name string, mtime int, has_output boolean")
    found = lambda f: sorted((r.user_id, r.job_id, r.found_in) for r in jobs.current_job(sessions, known, f).collect())
    assert found(folders) == [("u", "job_9", "session"), ("v", "job_2", "table"), ("w", "job_b", "folder")]
    assert found(folders.withColumn("has_output", F.lit(False)))[2] == found(folders.limit(0))[2] == ("w", None, None)


def test_port_rows_need_cells(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    html = "<table>" + row(*"abcdefg") + row(1, "RJ45", "copper", "net", "p1", "d") + row(1, 2, 3, 4, 5) + row(1, "x", "N/A", "n/a", 5, 6, 7) + row("a QSFP28 port") + row() + "</table>"
    docs = spark.createDataFrame([(1, html), (2, None), (3, "")], "doc int, html string")
    got = documents.connected_rows(docs).collect()
    assert [(r.doc, r.ord, r.cable, r.port, r.other_port) for r in got] == [(1, 1, "RJ45", "p1", "")]
    assert [(r.ord, r.type) for r in documents.empty_rows(docs, compat=True).orderBy("ord").collect()] == [(1, "Ethernet"), (2, "Ethernet"), (3, "Ethernet"), (4, "SFP")]


def test_vendor_hits_count_parts_once(spark):
    parts = spark.createDataFrame([("i", "Cisco cisco systems"), ("i", "CISCO"), ("i", None), ("j", "dell or cisco"), ("j", "")], "image string, part string")
    aliases = spark.createDataFrame([("Cisco", "cisco"), ("Cisco", "cisco systems"), ("Dell", "dell"), ("No", " ")], "vendor string, alias string")
    got = sorted(map(tuple, match.vendor_hits(parts, aliases).collect()))
    assert got == [("i", "Cisco", 2), ("j", "Cisco", 1), ("j", "Dell", 1)]
