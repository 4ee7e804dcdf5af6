"""Queries over reports: the six layouts, the merge, the audit document read back from HTML, the summary. Devices are orders, ports their lines, jobs customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, reports
from .queries import Query, table

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as job", "o_orderkey as unit_no", "case o_orderkey % 3 when 0 then 'Switch' when 1 then 'Patch Panel' else 'Router' end as device_type", "concat('img_', o_orderkey, '.png') as image",
        "case o_orderkey % 5 when 0 then 'Cisco Systems' when 1 then 'Not Detected' when 2 then 'Juniper & Co' when 3 then 'VENDOR' else 'D-Link' end as vendor",
        "case o_orderkey % 4 when 0 then 'WS-C2960' when 1 then 'unknown' when 2 then 'EX2300-24T' else 'Switch Model' end as model",
        "case o_orderkey % 7 when 0 then '24 port switch' when 1 then 'N/A' when 2 then 'LC UPC fibre panel' else 'Managed  unit with RJ-45 jacks' end as description", "'seen' as ocr_text", "o_orderkey % 100 / 100.0D as confidence",
    )


def _ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return l.selectExpr(
        "o_custkey as job", "l_orderkey as unit_no", "struct(l_linenumber, l_partkey, l_suppkey) as ord", "l_linenumber % 2 = 1 as connected", "concat('p_', l_partkey, '.png') as image", "concat('c', l_returnflag) as cable",
        "case when l_returnflag = 'R' then 'N/A' else l_returnflag end as cable_description", "case when l_returnflag = 'R' or l_linestatus = 'O' then 'n/a' else 'net' end as usage", "l_partkey as port", "concat('s', l_suppkey, ' & co') as port_description",
        "l_linenumber as other_port", "case l_partkey % 4 when 0 then 'sfp_SFP' when 1 then 'QSFP28' when 2 then 'rj45' else 'SFP' end as port_class", "concat('<', l_suppkey, '>') as description",
    )


def _racks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").filter("c_custkey % 5 > 0").selectExpr(
        "c_custkey as job", "'r.png' as image", "case c_custkey % 4 when 0 then 'Enclosed' when 1 then 'open frame' when 2 then 'wall mount' else 'odd' end as rack_type",
        "case c_custkey % 3 when 0 then 'APC' when 1 then 'Not Detected' else 'Great Lakes' end as vendor", "cast(null as string) as annotated", "array('a', 'b & c') as summary", "'' as ocr_text",
    )


def _hashed(df: DataFrame, key: str = "job") -> DataFrame:
    return df.select(key, F.md5("html").alias("html_md5"))


@query
def layout_rack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(reports.report(_racks(spark, sf_dir), reports.LAYOUTS["rack"], "job", ["image"]))


@query
def layout_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(reports.report(_units(spark, sf_dir), reports.LAYOUTS["switch"], "job", ["unit_no"]))


@query
def layout_patch_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(reports.report(_units(spark, sf_dir), reports.LAYOUTS["patch_panel"], "job", ["unit_no"]))


@query
def layout_connected_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(reports.report(_ports(spark, sf_dir), reports.LAYOUTS["connected_port"], "unit_no", ["ord"]), "unit_no")


@query
def layout_empty_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(reports.report(_ports(spark, sf_dir), reports.LAYOUTS["empty_port"], "unit_no", ["ord"]), "unit_no")


@query
def layout_cable(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _ports(spark, sf_dir).selectExpr("unit_no", "ord", "image", "port_class as model", "cable as cable_type", "usage", "cast(null as string) as features", "description")
    return _hashed(reports.report(p, reports.LAYOUTS["cable"], "unit_no", ["ord"]), "unit_no")


@query
def audit_from_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reports as HTML, and from the HTML alone the audit document of each job."""
    p = _ports(spark, sf_dir)
    u = reports.unit_report(_units(spark, sf_dir), p.filter("connected"), p.filter("not connected"))
    r = reports.report(_racks(spark, sf_dir), reports.LAYOUTS["rack"], "job", ["image"]).select("job", F.lit("rack_report.html").alias("name"), "html")
    return reports.audit(u.unionByName(r), "2024-01-01").select("job", F.md5("json").alias("json_md5"))


@query
def merged_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page as a report of one of eight kinds, some without a body, without rows or without pictures, with addresses of all sorts; eight to a job."""
    names = ("rack.html", "2_Switch.html", "Patch panel.html", "Cable.html", "4_ports-results.html", "connected port.html", "x_no images.html", "other.html")
    kind = F.col("page_id") % 8
    own = F.expr(r"""case page_id % 8
        when 0 then concat('<html><BODY class="a"><img src="a/', page_id, '.png"><a href=\'http://h/x\'></a></BODY></html>')
        when 1 then '<p>x</p><table><tr><th>a long header</th></tr></table>'
        when 2 then concat('<body><img srcset="s.png 1x,  /t.png 2x , ', page_id, '.png"></body>')
        when 3 then concat('<body><div style="background:url(b.png)">url(\'c.png\') and more than thirty characters ', page_id, '</div></body>')
        when 4 then concat('<table><tr><td>h</td></tr><tr><td><a href="data:x">four ', page_id, '</a></td></tr></table>')
        when 5 then '<body><svg></svg><p>twenty characters and a few more of them</p></body>'
        when 6 then '<img src="x.png">'
        else '<body>short</body>' end""")
    p = table(spark, sf_dir, "pages").select(F.expr("page_id div 8").alias("job"), F.concat(F.expr("page_id div 8 % 3").cast("string"), F.get(F.array(*map(F.lit, names)), kind.cast("int"))).alias("name"), F.concat(F.lit("/jobs/"), F.expr("page_id div 8").cast("string"), F.lit("/Results")).alias("folder"), own.alias("html"))
    return _hashed(reports.merged(p))


@query
def seven_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of every customer's orders."""
    o = table(spark, sf_dir, "orders")
    said = "case o_orderkey % 7 when 0 then 'LC duplex' when 1 then 'QSFP28 cage' when 2 then 'keystone jack' when 3 then 'usb hub' when 4 then 'cat6 patch' else 'blank' end"
    units = o.selectExpr("o_custkey", "cast(o_orderkey % 20 + 1 as int) as unit_no", "case o_orderkey % 3 when 0 then 'Patch Panel' when 1 then 'Switch' else 'Empty' end as kind").groupBy("o_custkey", "unit_no").agg(F.max("kind").alias("kind"))
    units = units.groupBy("o_custkey").agg(F.collect_list(F.struct("unit_no", "kind")).alias("units"))
    of = o.groupBy(F.col("o_custkey").alias("k")).agg(
        F.collect_list(F.expr("struct(case o_orderkey % 4 when 0 then 'Cisco' when 1 then 'HPE' end as vendor, case when o_orderkey % 50 = 0 then concat('M', o_orderkey % 10) end as model)")).alias("switches"),
        F.collect_list(F.expr(f"case when o_orderkey % 9 < 3 then {said} else 'plain port' end")).alias("port_texts"),
        F.collect_list(F.expr("case when o_orderkey % 11 = 0 then 'with nema 5-15' else 'panel' end")).alias("panel_texts"),
        F.collect_list(F.expr(said)).alias("leaves"),
        F.array_join(F.array_sort(F.collect_list(F.expr("case o_orderkey % 6 when 0 then 'RJ_45_Black' when 1 then 'RJ-45-Blu' else 'none' end"))), " ").alias("full_text"),
    )
    c = table(spark, sf_dir, "customer").selectExpr("c_custkey as doc", "case c_custkey % 3 when 0 then 'Openframe' when 1 then 'ENCLOSED' end as rack_type", "case when c_custkey % 2 = 0 then 'APC' end as rack_vendor")
    audit = c.join(units, F.col("doc") == F.col("o_custkey"), "left").join(of, F.col("doc") == F.col("k"), "left")
    return documents.summary(audit).select("doc", F.md5("text").alias("text_md5"))


# ---- the same as SQL ------------------------------------------------------------------------------


def _esc(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _layout(source: str, key: str, order: str, title: str, heads: tuple[str, ...], cells: tuple[str, ...]) -> str:
    row = "'<tr>' || " + " || ".join(f"'<td>' || {c} || '</td>'" for c in cells) + " || '</tr>'"
    head = "".join(f"<th>{h}</th>" for h in heads)
    return f"""with {source} select {key}, md5('<html><body><h2>{title}</h2><table>' || chr(10) || '<tr>{head}</tr>' || chr(10) || string_agg({row}, chr(10) order by {order}, {row}) || chr(10) || '</table></body></html>') as html_md5 from s group by {key}"""


_U = """u as (select o_custkey as job, o_orderkey as k, case o_orderkey % 3 when 0 then 'switch' when 1 then 'patch panel' else 'router' end as device,
  case o_orderkey % 5 when 0 then 'Cisco Systems' when 1 then 'Not Detected' when 2 then 'Juniper & Co' when 3 then 'VENDOR' else 'D-Link' end as vendor,
  case o_orderkey % 4 when 0 then 'WS-C2960' when 1 then 'unknown' when 2 then 'EX2300-24T' else 'Switch Model' end as model,
  case o_orderkey % 7 when 0 then '24 port switch' when 1 then 'N/A' when 2 then 'LC UPC fibre panel' else 'Managed  unit with RJ-45 jacks' end as description from orders)"""
_P = """p as (select o_custkey as job, l_orderkey as k, l_linenumber as n, l_partkey as part, l_suppkey as supp, l_returnflag as flag, l_linestatus as line from lineitem join orders on o_orderkey = l_orderkey)"""
_LABEL = "case part % 4 when 1 then 'Qsfp28' when 2 then 'RJ45' else 'SFP' end"
_CLASS = "case part % 4 when 0 then 'sfp_SFP' when 1 then 'QSFP28' when 2 then 'rj45' else 'SFP' end"
_IMG = "'<img src=\"p_' || part || '.png\">'"
_USAGE = "case when flag = 'R' or line = 'O' then 'n/a' else 'net' end"
_CABLE = "case when flag = 'R' then 'N/A' else flag end"

SQL = {
    "layout_rack": _layout("s as (select c_custkey as job, * from customer where c_custkey % 5 > 0)", "job", "1", "Rack Analysis Report", ("Rack", "Rack Type &amp; Vendor", "Annotated", "Summary", "Detected OCR"),
        ("'<img src=\"r.png\">'", "'<b>' || case c_custkey % 4 when 0 then 'ENCLOSED' when 1 then 'OPEN FRAME' when 2 then 'WALL MOUNT' else 'ODD' end || '</b><br>' || case c_custkey % 3 when 0 then 'APC' when 1 then 'Not Detected' else 'Great Lakes' end", "''", "'<ul><li>a</li><li>b &amp; c</li></ul>'", "''")),
    "layout_switch": _layout(f"{_U}, s as (select * from u)", "job", "k", "Switch Analysis Report", ("Switch", "Predicted Vendor", "Switch Model", "Description", "Detected OCR"), ("'<img src=\"img_' || k || '.png\">'", _esc("vendor"), "model", "description", "'seen'")),
    "layout_patch_panel": _layout(f"{_U}, s as (select * from u)", "job", "k", "Patch Panel Analysis Report", ("Patch Panel", "Predicted Model", "Description", "Similarity"),
        ("'<img src=\"img_' || k || '.png\">'", "model", "description", "case when k % 100 >= 75 then 'high' when k % 100 >= 40 then 'medium' else 'low' end")),
    "layout_connected_port": _layout(f"{_P}, s as (select k as unit_no, * from p)", "unit_no", "n, part, supp", "Connected Port Analysis Report", ("Image", "Cable", "Description", "Usage", "Port", "Port Desc", "Other Port"),
        (_IMG, "'c' || flag", _CABLE, _USAGE, "part", "'s' || supp || ' &amp; co'", "n")),
    "layout_empty_port": _layout(f"{_P}, s as (select k as unit_no, * from p)", "unit_no", "n, part, supp", "Empty Port Analysis Report", ("Port", "Predicted Port", "Expected Cable", "Description"), (_IMG, _CLASS, _LABEL, "'&lt;' || supp || '&gt;'")),
    "layout_cable": _layout(f"{_P}, s as (select k as unit_no, * from p)", "unit_no", "n, part, supp", "Cable Analysis Report", ("Cable", "Predicted Model", "Cable Type", "Usage", "Key Features", "Description"), (_IMG, _CLASS, "'c' || flag", _USAGE, "''", "'&lt;' || supp || '&gt;'")),
    "audit_from_reports": f"""with {_U}, {_P},
  told as (select job, k, device, case when device <> 'patch panel' and k % 5 in (0, 2, 4) then vendor end as vendor,
    case when k % 4 in (0, 2) then model when device = 'switch' and k % 5 = 4 then 'D-Link' when device = 'patch panel' then case when k % 7 = 0 then '24_port' when k % 7 = 2 then 'LC_UPC' when k % 7 > 2 then 'RJ_45' end end as model,
    case when k % 7 <> 1 then replace(description, '  ', ' ') when device = 'switch' and k % 5 in (1, 3, 4) and k % 4 = 2 then 'EX2300-24T' end as description from u),
  q as (select *, row_number() over (partition by job order by k, n % 2 = 0, n, part, supp, flag, {_USAGE}) as no from p where n % 2 = 0 or flag <> 'R'),
  j as (select job, k, n % 2 = 1 as connected, no, '{{"port_id":"port_' || no || '",' || case when n % 2 = 1 then '"port":"' || part || '","port_description":"s' || supp || ' & co","other_port":"' || n || '","cable":"c' || flag || '","cable_description":"' || {_CABLE} || '","usage":"' || {_USAGE} || '"}}'
    when part % 4 = 1 then '"type":"QSFP28","description":"Quad Small Form-factor Pluggable 28 connector supporting 100 Gbps high-speed data transmission over fiber optic cables."}}'
    when part % 4 = 2 then '"type":"Ethernet","description":"Eight-pin Ethernet connector used for wired LANs, supporting speeds from 10 Mbps to 10 Gbps depending on cable type."}}'
    else '"type":"SFP","description":"Small Form-factor Pluggable transceiver used for high-speed fiber optic connections in telecommunications and data center networks."}}' end as text from q),
  lists as (select k, coalesce(string_agg(text, ',' order by no) filter (connected), '') as c, coalesce(string_agg(text, ',' order by no) filter (not connected), '') as e from j group by k),
  units as (select job, string_agg('{{"unit_id":"unit' || t.k || '","device_type":"' || device || '"' || coalesce(',"vendor":"' || vendor || '"', '') || coalesce(',"model":"' || model || '"', '') || coalesce(',"description":"' || description || '"', '')
    || ',"connected_ports":[' || coalesce(c, '') || '],"empty_ports":[' || coalesce(e, '') || ']}}', ',' order by t.k) as units, string_agg(concat_ws(' ', vendor, device), ', ' order by t.k) as devices from told t left join lists l on l.k = t.k group by job),
  racks as (select c_custkey as job, case c_custkey % 4 when 0 then 'enclosed' when 1 then 'openframe' when 2 then 'wall_mounted' else 'Network Rack' end as type, case c_custkey % 3 when 0 then 'APC' when 1 then 'Generic / Unknown' else 'Great Lakes' end as vendor from customer where c_custkey % 5 > 0)
  select coalesce(u.job, r.job) as job, md5('{{"type":"' || coalesce(type, 'Network Rack') || '","vendor":"' || coalesce(vendor, 'Generic / Unknown') || '","report_generated":"2024-01-01","summary":"Rack analysis detected a populated network rack containing '
    || coalesce(devices, 'network devices') || '.","units":[' || coalesce(units, '') || ']}}') as json_md5 from units u full join racks r on r.job = u.job""",
    "merged_reports": r"""with r as (select page_id // 8 as job, page_id, page_id % 8 as kind, 'file:///jobs/' || (page_id // 8) || '/Results/' as base, (page_id // 8 % 3)::varchar as lead from pages where page_id % 8 in (0, 2, 3, 4, 5)),
  b as (select *, ['Rack', null, 'Patchpanel', 'Cable', 'Empty Port', 'Connected Port'][kind + 1] as title, lead || ['rack.html', null, 'Patch panel.html', 'Cable.html', '4_ports-results.html', 'connected port.html'][kind + 1] as name, [0, null, 2, 3, 4, 5][kind + 1] as rank,
    case kind when 0 then '<img src="' || base || 'a/' || page_id || '.png"><a href=''http://h/x''></a>' when 2 then '<img srcset="' || base || 's.png 1x, /t.png 2x, ' || base || page_id || '.png">'
      when 3 then '<div style="background:url(' || base || 'b.png)">url(''' || base || 'c.png'') and more than thirty characters ' || page_id || '</div>' when 4 then '<table><tr><td>h</td></tr><tr><td><a href="data:x">four ' || page_id || '</a></td></tr></table>'
      else '<svg></svg><p>twenty characters and a few more of them</p>' end as body from r)
  select job, md5('<html><body><table>' || chr(10) || string_agg('<tr><td><strong>' || title || '</strong><br/><small>' || name || '</small></td><td>' || body || '</td></tr>', chr(10) order by rank, lower(name), name) || chr(10) || '</table></body></html>') as html_md5 from b group by job""",
    "seven_sections": r"""with o as (select o_custkey as c, o_orderkey as k from orders),
  lay as (select c, string_agg(unit || ': ' || kind, ', ' order by unit) as layout, max(unit) as n from (select c, k % 20 + 1 as unit, max(case k % 3 when 0 then 'Patch Panel' when 1 then 'Switch' else 'Empty' end) as kind from o group by all) group by c),
  f as (select c, bool_or(k % 9 < 3 and k % 7 = 0) as lc, bool_or(k % 9 < 3 and k % 7 = 1) as qsfp, bool_or(k % 11 = 0) as nema, bool_or(k % 4 = 0) as cisco, bool_or(k % 4 = 1) as hpe, bool_or(k % 50 = 0) as models, bool_or(k % 6 = 0) as black, bool_or(k % 6 = 1) as blue,
    bool_or(k % 7 = 4) as copper, bool_or(k % 7 = 0) as fiber, bool_or(k % 7 = 2) as rj, bool_or(k % 7 = 1) as sfp, bool_or(k % 7 = 3) as usb from o group by c),
  x as (select c_custkey as doc, case c_custkey % 3 when 0 then 'openframe' when 1 then 'enclosed' end as t, case when c_custkey % 2 = 0 then 'APC' end as v, layout, coalesce(n, 6) as n, coalesce(lc, false) as lc, coalesce(qsfp, false) as qsfp, coalesce(nema, false) as nema, coalesce(models, false) as models,
    nullif(concat_ws(', ', case when cisco then 'Cisco' end, case when hpe then 'HPE' end), '') as vendors, nullif(concat_ws(', ', case when blue then 'Blue' end, case when black then 'Black' end), '') as colours,
    nullif(concat_ws(', ', case when copper then 'Ethernet copper cables' end, case when fiber then 'fiber optic cables' end), '') as cables,
    nullif(concat_ws(', ', case when fiber then 'LC Fiber' end, case when rj then 'RJ-45 / Keystone' end, case when sfp then 'SFP / QSFP' end, case when usb then 'USB' end), '') as ports
    from customer left join lay on lay.c = c_custkey left join f on f.c = c_custkey)
  select doc, md5(concat_ws(chr(10),
    '- The audit covers a rack' || case when t is null then '' else ' of type ' || t || coalesce(' by ' || v, '') || ',' end || ' with its panels, switches and cabling.', '- Units are allocated in order and terminated alike.',
    '- Ethernet runs over RJ-45' || case when lc then ', and fiber links end in LC connectors.' else '.' end, case when qsfp then '- Fast interfaces leave room for more bandwidth.' else '- The layout leaves room for additions.' end, '',
    '**Rack Overview**', case when t is not null then '- Form factor ' || t || coalesce(', by ' || v, '') || '.' else '- By ' || v || '.' end, '- The rack has ' || n || ' units.', coalesce('- Layout: ' || layout || '.', '- Its units are panels, switches and empty slots.'), '',
    '**Patch Panels**', '- RJ-45 is the standard termination.', '- Ports are coloured by use.', case when nema then '- Power outlets such as NEMA 5-15 are on the panels.' end, '',
    '**Switches**', coalesce('- Switches by ' || vendors || '.', '- No switch vendor could be read.'), case when models then '- The models of some units are known.' end, '',
    '**Ports**', case when lc then '- LC connectors serve the fiber segments.' end, '- RJ-45 serves Ethernet.', case when qsfp then '- QSFP interfaces are there for more bandwidth.' end, '',
    '**Cabling**', '- Twisted pair in ' || colours || '.', coalesce('- Cables: ' || cables || '.', '- Cables are twisted pair, and fiber where it applies.'), '- Port kinds: ' || ports || '.', '', '**Capacity**', '- Free interfaces and units allow for more links and devices.')) as text_md5 from x""",
}
