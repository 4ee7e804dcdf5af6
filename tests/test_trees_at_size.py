"""What keeps the queries over documents from growing faster than their input."""

import glob
import json
import os
import random
import tracemalloc

import pyarrow as pa

from rackmill.operators import hierarchy, match, tree
from rackmill.plans import queries, trees

NODES = "doc int, node_id string, preorder int, segmented string"


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_walked_once(spark):
    docs = spark.createDataFrame([(1, json.dumps({"id": "d", "type": "switch", "items": [{"segmented_image": "a/p.png", "bbox": [0, 0, 5, 5]}]}))], "doc int, json string")
    out = tree.resolved(tree.walk(docs))
    assert "ArrowEvalPython" not in plan(out)
    assert [(r.port_id, r.resolved, r.rule) for r in out.collect()] == [("p.png", "d", "first_device")]


def test_ports_find_their_devices_without_an_exchange(spark):
    """Nodes are stored as their documents were dealt; only those of documents without a device are dealt again, for their boxes."""
    docs = [(k, json.dumps({"id": f"d{k}", "type": "switch", "items": [{"segmented_image": "a/p.png"}]})) for k in range(40)]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = tree.resolved(tree.walk(spark.createDataFrame(docs, "doc long, json string").repartition(3, "doc")), 3)
        lines = plan(out).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    at = next(k for k, x in enumerate(lines) if x.endswith("Union"))
    bar = lines[at].index("Union")
    first = [x for x in lines[at + 1 :] if x[bar : bar + 1] == ":"]
    assert any("FileScan" in x for x in first) and not any("Exchange" in x or "Join" in x for x in first)
    files = glob.glob(spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + f"/rackmill/{spark.sparkContext.applicationId}/nodes-*")
    assert len(glob.glob(max(files, key=os.path.getmtime) + "/*.parquet")) <= 3
    assert sorted(r.resolved for r in out.collect()) == sorted(f"d{k}" for k in range(40))


def test_both_ways_to_a_parent_agree(spark):
    r = random.Random(4)

    def thing(depth):
        v = {}
        if r.random() < 0.6:
            v["id"] = r.choice(["a", "b", "c", "switch_1", "panel", "e"])
        if r.random() < 0.4:
            v["type"] = r.choice(["switch", "thing", "port", ""])
        if r.random() < 0.2:
            v["parent_type"] = r.choice(["rack", "x"])
        if r.random() < 0.6:
            v[r.choice(["segmented_image", "segmented_filename"])] = r.choice(["x/p1.png", "y\\p1.png", "p2.png", "x/", "q/p3.png", "p4.png"])
        if r.random() < 0.5:
            v["parent_id"] = r.choice(["a", "b", "c", "switch_1", "none", ""])
        if r.random() < 0.7:
            v["bbox"] = [x := r.randint(0, 90), y := r.randint(0, 90), x + r.randint(0, 300), y + r.randint(0, 300)]
        if depth < 4 and r.random() < 0.25:
            v["ports"] = r.choice([[], {}, [thing(depth + 2)], {"connected": [thing(depth + 2), thing(depth + 2)], "empty": [thing(depth + 2)]}])
        if depth < 3:
            v["items"] = [thing(depth + 1) for _ in range(r.randint(0, 3))]
        return v

    docs = [(k if k else None, json.dumps(thing(0))) for k in range(400)]
    nodes = tree.walk(spark.createDataFrame(docs, "doc long, json string")).persist()
    told = [x.doc for x in hierarchy.first_device(tree.kinds(nodes)).filter("first_device is not null").collect()]
    want = [tuple(x) for x in tree._resolved_by_joins(nodes).collect()]
    got = [tuple(x) for x in tree._resolved_in_place(nodes).collect()]
    assert {x[3] for x in got} == {"parent_id", "port_list", "first_device"} and {x[3] for x in want} >= {"box", None}
    assert sorted(map(repr, got)) == sorted(repr(x) for x in want if x[0] is not None and x[0] in told)
    assert sorted(map(repr, (tuple(x) for x in tree.resolved(nodes).collect()))) == sorted(map(repr, want))
    nodes.unpersist()


def test_walk_holds_few_documents_as_objects():
    texts = pa.array([json.dumps({"units": [{"id": f"d{k}", "bbox": [0, 0, k, k]} for k in range(50)]})] * 1500)
    tracemalloc.start()
    out = tree._walk(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1500 and len(out[1499]) == 51 and peak < 25e6
    assert len(tree._walk(pa.array([], pa.string()))) == 0


def test_many_pictures_meet_few_names(spark, monkeypatch):
    monkeypatch.setattr(match, "DIMENSION_ROWS", 3)
    nodes = spark.createDataFrame([(1, f"n{k}", k, f"x/pic_{k}.png") for k in range(8)] + [(1, "none", 9, None)], NODES)
    files = spark.createDataFrame([("pic_4.PNG",), ("_5.png",), ("zz.gif",)], "name string")
    out = hierarchy.file_match(files, nodes)
    assert "CartesianProduct" not in plan(out)
    assert {r.name: r.node_id for r in out.collect()} == {"pic_4.PNG": "n4", "_5.png": "n5", "zz.gif": None}


def test_only_lists_of_devices_become_rows(spark, sf, monkeypatch):
    seen = []
    parents = hierarchy.parents
    monkeypatch.setattr(hierarchy, "parents", lambda p, n, holds: (seen.append(holds), parents(p, n, holds))[1])
    queries.parent_resolution_lists(spark, sf)
    ids = {int(r.dev_id) for r in seen[0].select("dev_id").distinct().collect()}
    assert ids and all(k % 60 == 0 for k in ids)


def test_boxes_are_asked_where_no_device_is(spark):
    box = "struct<x1:int,y1:int,x2:int,y2:int>"
    nodes = spark.createDataFrame([(1, "s", 0, "switch", (0, 0, 50, 50), False), (2, "t", 0, "thing", (0, 0, 50, 50), False)], f"doc int, node_id string, preorder int, type string, box {box}, has_ports boolean")
    ports = spark.createDataFrame([(d, d, None, (5, 5, 9, 9)) for d in (1, 2)], f"doc int, port_id int, parent_id string, box {box}")
    got = hierarchy.parents(ports, nodes, spark.createDataFrame([], "doc int, dev_id string, port_id int")).collect()
    assert {(r.doc, r.resolved, r.rule) for r in got} == {(1, "s", "first_device"), (2, "t", "box")}


def test_nodes_leave_python_a_few_documents_at_a_time(spark):
    texts = [json.dumps({"units": [{"id": f"d{k}", "bbox": [0, 0, k, k]} for k in range(3)]}), None, "{", "[]"] * 50
    parts = list(tree._walked(iter([pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["doc", "json"])])))
    assert len(parts) == 4 and max(p.num_rows for p in parts) <= 64 and sum(p.num_rows for p in parts) == 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, json string")
    out = tree.device_pictures(tree.walk(docs))
    assert "Generate" not in plan(out) and out.count() == 0 and tree.walk(docs).count() == 200


def test_connected_ports_are_grouped_as_numbers(spark, sf):
    tree_ = queries.connected_rows(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation" in x and "l_orderkey" in x for x in tree_) == 1


def test_empty_ports_are_grouped_as_numbers(spark, sf):
    tree_ = queries.empty_rows(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("Relation" in x and "l_orderkey" in x for x in tree_) == 1


def test_empty_ports_meet_their_orders_without_a_join(spark, sf):
    """One exchange, before the aggregation, so that no task sorts a split of the lines, and none arrays of lines for a join."""
    tree_ = queries.empty_rows(spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [k for k, x in enumerate(tree_) if "Exchange" in x]
    assert len(exchanges) == 1 and not any("Join" in x for x in tree_)
    assert max(k for k, x in enumerate(tree_) if "Aggregate" in x) < exchanges[0]


def test_reports_of_odd_orders(spark, tmp_path):
    """Orders without lines, lines without an order and null keys give no report; an order that is there twice gives two."""
    lines = [(1, 2, 5, 7, "R", "O"), (1, 1, 6, 7, "A", "F"), (2, 1, 5, 7, None, "F"), (None, 1, 5, 7, "R", "F"), (9, 1, 5, 7, "R", "F")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "1-URGENT"), (2, None), (2, "5-LOW"), (3, "5-LOW"), (None, "5-LOW")], "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in queries.empty_rows(spark, str(tmp_path)).select("doc", "ord", "type").collect())
    assert got == [(1, 1, "Ethernet"), (1, 2, "SFP"), (2, 1, "Ethernet"), (2, 1, "Ethernet")]


def test_lines_of_documents_are_grouped_behind_their_exchange(spark, sf):
    """So that no task sorts, and spills, a whole split of the lines."""
    lines = plan(trees._documents(spark, sf)).splitlines()
    scan = next(k for k, x in enumerate(lines) if "FileScan" in x and "l_orderkey" in x)
    exchange = max(k for k in range(scan) if "Exchange hashpartitioning(l_orderkey" in lines[k])
    assert not any("Aggregate" in x for x in lines[exchange:scan])
