"""Reports written, merged and read back; detection documents as node tables."""

import html as html_module
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from rackmill.functions import text as tx
from rackmill.operators import documents, reports, tree
from rackmill.sources import sinks

UNIT = """<html><body><div class='device-badge'> {badge} </div>
<div class="device-info">{info}</div>
{sections}</body></html>"""
SECTION = '<div class="section"><h2 class="section-title">{title}</h2><table><tr><th>a</th></tr>{rows}</table></div>'


def row(*cells):
    return "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"


def info(*rows):
    return "<table><tr><th>Switch</th><th>Predicted Vendor</th><th>Switch Model</th><th>Description</th></tr>" + "".join(row(*r) for r in rows) + "</table>"


def audits(spark, files, descriptions=None):
    df = spark.createDataFrame(files, "job string, name string, html string")
    return {r.job: json.loads(r.json) for r in reports.audit(df, "2024-05-06", descriptions).collect()}


def test_audit_of_awkward_reports(spark):
    ports = SECTION.format(title="✅ Connected", rows=row("<img>", "RJ_45", "copper", "net", "p &amp; q", "d") + row(*"12345") + row("", "x", "N/A", "n/a", 1, 2, 3) + row("", "lc", "fibre", "up", "SFP1", "slot", "far"))
    empty = SECTION.format(title="Empty ports", rows=row("<img src='QSFP.png'>", "QSFP28") + row("", "sfp SFP") + row("SFP+") + "<tr></tr>" + row("", "rj45"))
    files = [
        ("j", "unit10_report.html", UNIT.format(badge="Switch", info=info(("", "Cisco", "WS-1", "a  good\nswitch")), sections=empty + ports)),
        ("j", "unit2_report.html", UNIT.format(badge="Patch Panel", info=info(("", "Cisco", "unknown", "N/A")) + "with mpo trunks", sections=ports)),
        ("j", "unit3_report.html", UNIT.format(badge="Switch", info=info(("", "", "", "")) + "<p>Vendor: Juniper Networks, Inc</p><p>Model: ex 4300 series</p>", sections="")),
        ("j", "unit4_report.html", "<p>nothing known</p>"),
        ("j", "unit5_report.html", None),
        ("j", "rack_report.html", "<div class='device-info'>Type: Wall rack\nVendor: Rittal</div>"),
        ("j", "other.html", "<p>unit6_report.html</p>"),
        ("k", "rack_report.html", "<table><tr><th>Type</th><th>Vendor</th></tr><tr><td>Open frame | x</td><td>APC</td></tr></table>"),
        ("l", "unit1_report.html", UNIT.format(badge="switch", info=info(("", "HP", "J1-x", "from the report")), sections="")),
        ("m", "notes.txt", "x"),
    ]
    dim = spark.createDataFrame([(0, "hp", "j1 X", "from the\nlist"), (1, "cisco", "none such", "?")], "ord int, vendor string, model string, description string")
    got = audits(spark, files, dim)
    assert got.keys() == {"j", "k", "l"}
    j = got["j"]
    assert (j["type"], j["vendor"], j["report_generated"]) == ("wall_mounted", "Rittal", "2024-05-06") and got["k"]["type"] == "openframe" and got["k"]["vendor"] in ("x", "APC")
    assert got["k"]["units"] == [] and "network devices" in got["k"]["summary"]
    assert [u["unit_id"] for u in j["units"]] == ["unit2", "unit3", "unit4", "unit5", "unit10"]
    two, three, four, five, ten = j["units"]
    assert (two["device_type"], two["model"]) == ("patch panel", "MPO") and "vendor" not in two
    assert (three["vendor"], three["model"]) == ("Juniper Networks", "ex 4300 series")
    assert four["device_type"] == five["device_type"] == "unknown" and "vendor" not in four and four["connected_ports"] == []
    assert (ten["vendor"], ten["model"], ten["description"]) == ("Cisco", "WS-1", "a good switch")
    assert [p["port_id"] for p in two["connected_ports"]] == ["port_1", "port_2"] and two["connected_ports"][0]["port"] == "p & q" and two["connected_ports"][1]["other_port"] == "far"
    assert [(p["port_id"], p["type"]) for p in ten["empty_ports"]] == [("port_5", "QSFP28"), ("port_6", "SFP"), ("port_7", "SFP"), ("port_8", "Ethernet")]
    assert [p["port_id"] for p in ten["connected_ports"]] == ["port_3", "port_4"]
    assert got["l"]["units"][0]["description"] == "from the list"
    assert audits(spark, [("x", None, None)]) == {}


def test_layouts_have_as_many_cells_as_headers(spark):
    for name, layout in reports.LAYOUTS.items():
        fields = {f for _, _, fs in layout.columns for f in fs.split(" ")}
        schema = ", ".join(f"{f} {'array<string>' if f == 'summary' else 'double' if f == 'confidence' else 'string'}" for f in sorted(fields))
        value = lambda f: ["<x>"] if f == "summary" else 0.5 if f == "confidence" else "<&>"
        rows = [tuple(value(f) for f in sorted(fields)), tuple(None for _ in fields)]
        df = spark.createDataFrame(rows, schema).withColumns({"job": F.lit(1), "k": F.monotonically_increasing_id()})
        out = reports.report(df, layout, "job", ["k"]).first().html
        heads, *body = re.findall("<tr>(.*?)</tr>", out)
        assert heads.count("<th>") == len(layout.columns) and [b.count("<td>") for b in body] == [len(layout.columns)] * 2, name
        assert "<x>" not in out and "<&>" not in out and layout.title in out


@pytest.mark.parametrize(("body", "want"), [
    ('<img src="a/b.png">', '<img src="file:///j/R/a/b.png">'), ("<img src='http://x/y'>", "<img src='http://x/y'>"), ('<a href="/x">', '<a href="/x">'), ('<a href="Data:x">', '<a href="Data:x">'),
    ('<i style="background:URL(a.png)">', '<i style="background:url(file:///j/R/a.png)">'), ("url('b.png') url(\"http://c\")", "url('file:///j/R/b.png') url(\"http://c\")"),
    ('<img srcset="a.png 1x,b.png   2x, , https://c 3x">', '<img srcset="file:///j/R/a.png 1x, file:///j/R/b.png 2x, https://c 3x">'), ('<img src="a.png" srcset="b.png">', '<img src="file:///j/R/a.png" srcset="file:///j/R/b.png">'),
    ("no addresses", "no addresses"), ("", ""), ('src="$1\\1.png"', 'src="file:///j/R/$1\\1.png"'),
])
def test_addresses_below_a_folder(spark, body, want):
    df = spark.createDataFrame([(body, "/j/R/")], "b string, f string")
    assert df.select(tx.rebased(F.col("b"), F.col("f")).alias("x")).first().x == want


def test_merge_leaves_out_what_says_nothing(spark):
    rows = [("j", "rack.html", "/r", "<body><p>more than thirty characters of text in it</p></body>"), ("j", "a no-images.html", "/r", "<img>"), ("j", "b.html", "/r", None), ("j", "c.html", "/r", "<table></table>" + "x" * 50), ("j", "d.html", "/r", "<svg/><b>" + "y" * 40), ("k", "e.html", "/r", "")]
    got = {r.job: r.html for r in reports.merged(spark.createDataFrame(rows, "job string, name string, folder string, html string")).collect()}
    assert got.keys() == {"j"} and re.findall("<small>(.*?)</small>", got["j"]) == ["rack.html", "d.html"]
    names = ["Patch-Panel x", "ports results", "PORTS_RESULTS", "empty port", "panel", "connected", "Connected-Port", None, "rack switch"]
    got = [r.c for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").select("k", tx.category(F.col("n")).alias("c")).orderBy("k").collect()]
    assert got == ["patchpanel", "empty_port", "empty_port", "empty_port", None, None, "connected_port", None, "rack"]


def test_unescape_is_the_inverse(spark):
    texts = ["a < b & c > \"d\" 'e'", "&amp;lt;", "plain", ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", tx.html_escape(F.col("t")).alias("e"), tx.html_unescape(tx.html_escape(F.col("t"))).alias("u")).orderBy("k").collect()
    assert [r.u for r in got] == texts and [r.e for r in got] == [html_module.escape(t) for t in texts]


def test_a_text_file_is_replaced_whole(spark, tmp_path):
    path = f"{tmp_path}/out/merged.html"
    sinks.replaced_text(spark, f"file://{path}", "first")
    sinks.replaced_text(spark, f"file://{path}", "second é")
    assert open(path, encoding="utf-8").read() == "second é"
    assert [f for f in os.listdir(f"{tmp_path}/out") if not f.endswith(".crc")] == ["merged.html"]
    # a crash between write and rename leaves the old file
    broken = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext
    with pytest.raises(AttributeError):
        sinks.replaced_text(spark, f"file://{path}", None)
    assert broken is not None and open(path, encoding="utf-8").read() == "second é"


def test_summary_without_facts(spark):
    schema = "doc int, rack_type string, rack_vendor string, units array<struct<unit_no:int,kind:string>>, switches array<struct<vendor:string,model:string>>, port_texts array<string>, panel_texts array<string>, leaves array<string>, full_text string"
    full = (2, "WALL", "", [(3, "Switch"), (1, "Empty")], [("HPE", "m"), (None, None), ("HPE", "m"), ("Cisco", None)], ["an LC port", None, "QSFP28"], ["NEMA 5-15"], ["optical", "structured", None], "RJ45_Red")
    df = spark.createDataFrame([(1, *(None,) * 8), full], schema)
    got = {r.doc: r.text for r in documents.summary(df).collect()}
    assert got[1].count("**") == 12 and "6 units" in got[1] and "No switch vendor" in got[1] and "None" not in got[1]
    assert "type wall," in got[2] and "3 units" in got[2] and "Layout: 1: Empty, 3: Switch." in got[2] and "by Cisco, HPE." in got[2] and "fiber optic cables" in got[2] and "NEMA" in got[2] and "Red" in got[2] and "LC connectors serve" in got[2]
    old = {r.doc: r.text for r in documents.summary(df, compat=True).collect()}
    assert "6 units" in old[2] and "LC connectors" not in old[2] and "NEMA" not in old[2] and "Layout" not in old[2]
    assert documents.summary(df.limit(0)).count() == 0
    pairs = df.select("doc", documents.switch_pairs(F.col("switches")).alias("p")).orderBy("doc").collect()
    assert pairs[0].p is None and [tuple(x) for x in pairs[1].p] == [("HPE", "m"), ("", ""), ("Cisco", "")]


def test_walk_keeps_the_order_of_the_text(spark):
    doc = {"z": {"id": "rack1", "bbox": [0, 0, 9.5, 9], "units": [{"id": 7, "segmented_image": "a\\b.png", "ports": []}, [{"segmented_filename": "", "segmented_image": "x/y.JPG", "bbox": [1, 2, 3]}]]}, "a": {"type": ["no"], "ports": {"connected": [{"segmented_filename": "q/p1.jpg"}, 5, "s"], "note": "x"}}}
    rows = [(1, json.dumps(doc)), (2, None), (3, "{not json"), (4, "[]"), (5, "[" * 100_000), (6, '"text"'), (7, '{"id": NaN}')]
    got = [r for r in tree.walk(spark.createDataFrame(rows, "doc int, json string")).orderBy("doc", "preorder").collect()]
    one = [r for r in got if r.doc == 1]
    assert [(r.preorder, r.parent, r.depth, r.node_id, r.segmented) for r in one] == [(0, None, 0, None, None), (1, 0, 1, "rack1", None), (2, 1, 2, None, "a\\b.png"), (3, 1, 2, None, "x/y.JPG"), (4, 0, 1, None, None), (5, 4, 2, None, None), (6, 5, 3, None, "q/p1.jpg")]
    assert one[1].box.x2 == 9 and one[3].box is None and [r.has_ports for r in one] == [False, False, False, False, True, False, False] and one[4].port_files == ["p1.jpg"]
    assert {r.doc for r in got} == {1, 7}


def test_the_audit_reads_each_report_once(spark):
    df = spark.createDataFrame([("j", "unit1_report.html", "<p>")], "job string, name string, html string")
    plan = reports.audit(df, "d")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("section-title" in x for x in plan.splitlines()) == 1


def test_reports_of_one_unit_share_its_ports(spark):
    ports = lambda *names: '<div class="section"><h2 class="section-title">Empty Ports</h2><table><tr><td>h</td></tr>' + "".join(f"<tr><td>i</td><td>{n}</td></tr>" for n in names) + "</table></div>"
    rows = [("j", "unit2_report.html", '<div class="device-badge">Router</div>' + ports("SFP")), ("j", "unit2_b_report.html", '<div class="device-badge">Switch</div>' + ports("x", "QSFP")), ("j", "unit10_report.html", ports("x"))]
    got = json.loads(reports.audit(spark.createDataFrame(rows, "job string, name string, html string").repartition(3), "d").first().json)["units"]
    assert [(u["unit_id"], u["device_type"], [p["port_id"] for p in u["empty_ports"]]) for u in got] == [("unit2", "router", ["port_1", "port_2", "port_3"]), ("unit2", "switch", ["port_1", "port_2", "port_3"]), ("unit10", "unknown", ["port_4"])]
    assert sorted(p["type"] for p in got[0]["empty_ports"]) == ["Ethernet", "QSFP28", "SFP"] and got[1]["empty_ports"] == got[0]["empty_ports"]


@pytest.mark.parametrize("cell", ["plain", " a\t\n b ", "a\x0bb", "a\fb", "a  b", "<b>x</b> <i> y</i>", "&lt;b&gt; &amp;lt;&nbsp;&nbsp;z", "", "<br>"])
def test_cells_are_read_as_by_patterns(spark, cell):
    df = spark.createDataFrame([(f"<tr><td>{cell}</td></tr>",)], "h string")
    text = re.sub(r"(?s)<[^>]*>", "", cell)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = text.replace(a, b)
    assert df.select(tx.html_rows(F.col("h")).alias("r")).first().r == [[re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")]]
