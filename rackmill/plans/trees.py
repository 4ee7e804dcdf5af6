"""Queries over detection documents: nested JSON made of orders (devices) and their lines (ports), one document for each customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, tree
from .queries import Query, table

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _joined(text: str, order: Column) -> Column:
    """Texts of a group with commas between, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), ",")


#: Orders whose documents one task makes, about.
_ORDERS = 1 << 16


def _parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions to deal documents over: one a core, more where orders are many."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "orders").count() // _ORDERS))


def _documents(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """Of every three devices one has port lists by state, one a single list, and one holds its ports without a list; boxes, pictures and parent ids are there or not."""
    # numbers are dealt and grouped, texts made of them afterwards
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_partkey")).alias("lines"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_custkey", "o_orderkey", "lines").repartition(*([parts] if parts else []), "o_custkey")
    ports = F.expr("""array_sort(transform(lines, l -> struct(concat('{"segmented_filename":"out/p_', o_orderkey, '_', l.l_linenumber, '_', l.l_partkey, '.jpg"',
        case when l.l_partkey % 6 = 0 then ',"parent_id":"nowhere"' when l.l_partkey % 3 = 0 then concat(',"parent_id":"dev_', o_orderkey, '"') else '' end,
        case when l.l_partkey % 2 = 0 then concat(',"bbox":[', l.l_partkey * 7 % 940, ',', l.l_partkey * 3 % 540, ',', l.l_partkey * 7 % 940 + 12, ',', l.l_partkey * 3 % 540 + 10, ']') else '' end, '}') as text, l.l_linenumber % 2 = 1 as odd)))""")
    lists = orders.withColumn("ports", ports).withColumns({"every": F.expr("array_join(ports.text, ',')"), "odd": F.expr("array_join(filter(ports, p -> p.odd).text, ',')"), "even": F.expr("array_join(filter(ports, p -> not p.odd).text, ',')")})
    device = F.expr("""concat('{"id":"dev_', o_orderkey, '","type":"', case o_orderkey % 4 when 0 then 'switch' when 1 then 'patch_panel' else 'thing' end, '"',
        case when o_orderkey % 5 > 0 then concat(',"segmented_image":"seg/dev_', o_orderkey, '.png"') else '' end,
        ',"bbox":[', o_orderkey * 17 % 500, ',', o_orderkey * 29 % 300, ',', o_orderkey * 17 % 500 + 400, ',', o_orderkey * 29 % 300 + 200, ']',
        case when every is null then '' when o_orderkey % 3 = 0 then concat(',"ports":{"connected":[', odd, '],"empty":[', even, ']}') when o_orderkey % 3 = 1 then concat(',"ports":[', every, ']') else concat(',"items":[', every, ']') end, '}')""")
    devices = lists.select("o_custkey", "o_orderkey", device.alias("text"))
    docs = devices.groupBy(F.col("o_custkey").alias("doc")).agg(_joined("text", F.col("o_orderkey")).alias("units"))
    return docs.select("doc", F.concat(F.lit('{"job":'), "doc", F.lit(',"frame":{"id":"frame_'), "doc", F.lit('","bbox":[0,0,960,560],"units":['), "units", F.lit("]}}")).alias("json"))


@query
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tree.walk(_documents(spark, sf_dir))
    return n.select("doc", "preorder", "parent", "depth", "node_id", "type", "parent_id", "segmented", F.col("box.x1").alias("x1"), F.col("box.y2").alias("y2"), "has_ports", F.size("port_files").alias("n_files"))


@query
def tree_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _parts(spark, sf_dir)
    return tree.resolved(tree.walk(_documents(spark, sf_dir, parts)), parts)


@query
def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of every tenth order's first lines, and one that no document has, with the node that shows them."""
    l = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.expr("concat('jobs/x/p_', l_orderkey, '_', l_linenumber, '_', l_partkey, '.JPG')").alias("name")).distinct()
    return hierarchy.file_match(l.unionByName(spark.range(1).select(F.lit("none.gif").alias("name"))), tree.walk(_documents(spark, sf_dir)))


@query
def device_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.device_pictures(tree.walk(_documents(spark, sf_dir)))


_DOCS = """port as (select l_orderkey, l_linenumber % 2 = 1 as odd, '{"segmented_filename":"out/p_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '.jpg"'
    || case when l_partkey % 6 = 0 then ',"parent_id":"nowhere"' when l_partkey % 3 = 0 then ',"parent_id":"dev_' || l_orderkey || '"' else '' end
    || case when l_partkey % 2 = 0 then ',"bbox":[' || (l_partkey * 7 % 940) || ',' || (l_partkey * 3 % 540) || ',' || (l_partkey * 7 % 940 + 12) || ',' || (l_partkey * 3 % 540 + 10) || ']' else '' end || '}' as text from lineitem),
  lists as (select l_orderkey, string_agg(text, ',' order by text) as every, coalesce(string_agg(text, ',' order by text) filter (odd), '') as odd, coalesce(string_agg(text, ',' order by text) filter (not odd), '') as even from port group by 1),
  device as (select o_custkey as doc, o_orderkey, '{"id":"dev_' || o_orderkey || '","type":"' || case o_orderkey % 4 when 0 then 'switch' when 1 then 'patch_panel' else 'thing' end || '"'
    || case when o_orderkey % 5 > 0 then ',"segmented_image":"seg/dev_' || o_orderkey || '.png"' else '' end
    || ',"bbox":[' || (o_orderkey * 17 % 500) || ',' || (o_orderkey * 29 % 300) || ',' || (o_orderkey * 17 % 500 + 400) || ',' || (o_orderkey * 29 % 300 + 200) || ']'
    || case when every is null then '' when o_orderkey % 3 = 0 then ',"ports":{"connected":[' || odd || '],"empty":[' || even || ']}' when o_orderkey % 3 = 1 then ',"ports":[' || every || ']' else ',"items":[' || every || ']' end || '}' as text
    from orders left join lists on l_orderkey = o_orderkey),
  docs as materialized (select doc, '{"job":' || doc || ',"frame":{"id":"frame_' || doc || '","bbox":[0,0,960,560],"units":[' || string_agg(text, ',' order by o_orderkey) || ']}}' as json from device group by doc),
  every as materialized (select doc, j.id, j.parent, j.type as kind, j.value::json as v from docs, json_tree(docs.json) j where j.type in ('OBJECT', 'ARRAY')),
  up as (select doc, id as start, parent as above, 0 as n from every where kind = 'OBJECT' union all select u.doc, u.start, e.parent, n + (e.kind = 'OBJECT')::int from up u join every e on e.doc = u.doc and e.id = u.above),
  depths as (select doc, start, max(n) as depth from up group by all),
  around as (select doc, start, max(above) as parent from up join (select doc as d, id from every where kind = 'OBJECT') o on d = doc and o.id = above group by all),
  numbered as materialized (select doc, id, v, row_number() over (partition by doc order by id) - 1 as preorder from every where kind = 'OBJECT'),
  node as materialized (select n.doc, n.preorder, p.preorder as parent, depth, v ->> 'id' as node_id, v ->> 'type' as type, v ->> 'parent_id' as parent_id, coalesce(v ->> 'segmented_filename', v ->> 'segmented_image') as segmented,
    (v -> 'bbox' ->> 0)::int as x1, (v -> 'bbox' ->> 1)::int as y1, (v -> 'bbox' ->> 2)::int as x2, (v -> 'bbox' ->> 3)::int as y2, coalesce(json_type(v, '$.ports') = 'OBJECT' or json_array_length(v, '$.ports') > 0, false) as has_ports,
    list_filter(list_concat(list_concat(json_extract_string(v, '$.ports.connected[*].segmented_filename'), json_extract_string(v, '$.ports.empty[*].segmented_filename')), json_extract_string(v, '$.ports[*].segmented_filename')), lambda x: x is not null) as files
    from numbered n join depths d on d.doc = n.doc and d.start = n.id left join around a on a.doc = n.doc and a.start = n.id left join (select doc, id, preorder from numbered) p on p.doc = a.doc and p.id = a.parent),
  dev as (select * from node where has_ports or regexp_matches(coalesce(type, ''), 'switch|patch_?panel'))"""

SQL = {
    "tree_nodes": f"with recursive {_DOCS} select doc, preorder, parent, depth::int as depth, node_id, type, parent_id, segmented, x1, y2, has_ports, len(files) as n_files from node",
    "tree_parents": f"""with recursive {_DOCS},
  own as (select doc, string_split(segmented, '/')[-1] as port_id, arg_min(coalesce(parent_id, ''), preorder) as parent_id, arg_min(struct_pack(x1 := x1, y1 := y1, w := x2 - x1, h := y2 - y1), preorder) as box, count(*) as n
    from node where segmented is not null and not (has_ports or regexp_matches(coalesce(type, ''), 'switch|patch_?panel')) group by all),
  held as (select doc, port_id, min(node_id) as holder from (select doc, node_id, string_split(unnest(files), '/')[-1] as port_id from dev where node_id is not null) group by all),
  firsts as (select doc, arg_min(node_id, preorder) as first_device from dev group by doc),
  boxes as (select doc, preorder, node_id, x1, y1, x2, y2 from node where node_id is not null and x1 is not null),
  ins as (select o.doc, port_id, arg_min(node_id, preorder) as around from own o join boxes b on b.doc = o.doc and o.box.x1 is not null
    where least(o.box.x1 + o.box.w, x2) > greatest(o.box.x1, x1) and least(o.box.y1 + o.box.h, y2) > greatest(o.box.y1, y1)
      and 100 * (least(o.box.x1 + o.box.w, x2) - greatest(o.box.x1, x1)) * (least(o.box.y1 + o.box.h, y2) - greatest(o.box.y1, y1)) >= 85 * o.box.w * o.box.h
      and 2 * o.box.x1 + o.box.w between 2 * x1 and 2 * x2 and 2 * o.box.y1 + o.box.h between 2 * y1 and 2 * y2 and 100 * (o.box.y1 + o.box.h - y1) <= 95 * (y2 - y1) group by all),
  found as (select o.doc, o.port_id, coalesce(d.node_id, h.holder, f.first_device, i.around) as resolved,
    case when d.node_id is not null then 'parent_id' when h.holder is not null then 'port_list' when f.first_device is not null then 'first_device' when i.around is not null then 'box' end as rule
    from own o left join dev d on d.doc = o.doc and d.node_id = o.parent_id left join held h on h.doc = o.doc and h.port_id = o.port_id left join firsts f on f.doc = o.doc left join ins i on i.doc = o.doc and i.port_id = o.port_id)
  select f.*, upper(n.type) as label, string_split(n.segmented, '/')[-1] as picture from found f left join node n on n.doc = f.doc and n.node_id = f.resolved""",
    "tree_files": f"""with recursive {_DOCS},
  f as (select distinct 'jobs/x/p_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '.JPG' as name from lineitem where l_linenumber = 1 union all select 'none.gif'),
  b as (select lower(string_split(segmented, '/')[-1]) as base, arg_min(coalesce(node_id, ''), preorder) as node_id from node where segmented is not null group by 1)
  select name, nullif(node_id, '') as node_id from f left join b on base = lower(string_split(name, '/')[-1])""",
    "device_pictures": f"with recursive {_DOCS} select doc, preorder, string_split(segmented, '/')[-1] as picture from dev where segmented is not null",
}
