"""Detection documents as node tables: every object of a nested JSON document becomes a row, in document order.

Each document is walked once, in its own row; what is asked of a tree afterwards (a node by id, the first device, the device whose port
list holds a picture, the files that show a node) are joins and aggregations over the rows of all documents (hierarchy).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import hierarchy

_BOX = pa.struct([(c, pa.int32()) for c in ("x1", "y1", "x2", "y2")])
_NODE = pa.struct([
    ("preorder", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("node_id", pa.string()), ("type", pa.string()), ("category", pa.string()), ("parent_type", pa.string()), ("parent_id", pa.string()),
    ("segmented", pa.string()), ("box", _BOX), ("has_ports", pa.bool_()), ("port_files", pa.list_(pa.string())),
])
_NODES = (
    "preorder int,parent int,depth int,node_id string,type string,category string,parent_type string,parent_id string,segmented string,"
    "box struct<x1:int,y1:int,x2:int,y2:int>,has_ports boolean,port_files array<string>"
)
_INT = 1 << 31


def _text(v) -> str | None:
    return v if isinstance(v, str) and v else None


def _picture(node) -> str | None:
    return (_text(node.get("segmented_filename")) or _text(node.get("segmented_image"))) if isinstance(node, dict) else None


def _box(v) -> dict | None:
    if not isinstance(v, list) or len(v) != 4 or not all(isinstance(c, (int, float)) and not isinstance(c, bool) and -_INT < c < _INT for c in v):
        return None
    return dict(zip(("x1", "y1", "x2", "y2"), map(int, v), strict=True))


def _row(node: dict, preorder: int, parent: int | None, depth: int) -> dict:
    ports = node.get("ports")
    lists = [v for v in ports.values() if isinstance(v, list)] if isinstance(ports, dict) else [ports] if isinstance(ports, list) else []
    names = [p.rpartition("/")[2].rpartition("\\")[2] for items in lists for p in map(_picture, items) if p]
    plain = {c: _text(node.get(c)) for c in ("type", "category", "parent_type", "parent_id")}
    return {"preorder": preorder, "parent": parent, "depth": depth, "node_id": _text(node.get("id")), **plain, "segmented": _picture(node), "box": _box(node.get("bbox")), "has_ports": bool(ports), "port_files": names}


#: Documents whose nodes are Python objects at a time.
_DOCS = 64


def _walk(json_texts: pa.Array) -> pa.Array:
    done = [pa.array([], pa.list_(_NODE))]
    for at in range(0, len(json_texts), _DOCS):
        done.append(pa.array(list(map(_nodes, json_texts.slice(at, _DOCS).to_pylist())), pa.list_(_NODE)))
    return pa.concat_arrays(done)


def _nodes(text: str | None) -> list[dict]:
    found = []
    try:
        rest = [(json.loads(text), None, 0)] if text is not None else []
    except (ValueError, RecursionError):
        rest = []
    while rest:
        v, parent, depth = rest.pop()
        if isinstance(v, dict):
            found.append(_row(v, len(found), parent, depth))
            parent, depth, v = len(found) - 1, depth + 1, list(v.values())
        if isinstance(v, list):
            rest += [(x, parent, depth) for x in reversed(v) if isinstance(x, (dict, list))]
    return found


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with their documents, of a few documents at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _DOCS):
            part = batch.slice(at, _DOCS)
            nodes = _walk(part.column(1))
            rows = nodes.flatten()
            yield pa.RecordBatch.from_arrays([part.column(0).take(pc.list_parent_indices(nodes)), *rows.flatten()], names=["doc", *(f.name for f in _NODE)])


def walk(docs: DataFrame, key: str = "doc", text: str = "json") -> DataFrame:
    """A row for each object of each document: doc, preorder (from 0, members in the order of the text), parent (preorder of the object around it), depth,
    node_id, type, category, parent_type, parent_id, segmented (its picture), box, has_ports (a port list that isn't empty) and port_files (base
    names of the pictures in its port lists). Fields of another kind, and empty texts, are null. A null or corrupt document, and one of more levels than the parser takes (about 1,000), has no rows."""
    return docs.select(F.col(key).alias("doc"), F.col(text)).mapInArrow(_walked, f"doc {docs.schema[key].dataType.simpleString()},{_NODES}")


def kinds(nodes: DataFrame) -> DataFrame:
    """nodes with `type` as the device test reads it: all words about what a node is."""
    return nodes.withColumn("type", F.concat_ws(" ", "type", "category", "parent_type"))


def port_lists(nodes: DataFrame) -> DataFrame:
    """doc, dev_id, port_id: which node lists the picture of which port. A node without an id lists for nobody."""
    return nodes.filter("node_id is not null").select("doc", F.col("node_id").alias("dev_id"), F.explode(F.array_distinct("port_files")).alias("port_id"))


def ports(nodes: DataFrame) -> DataFrame:
    """doc, port_id (base name of the picture), parent_id, box of the nodes that have a picture and are no devices; of equal pictures in a document the first node counts."""
    own = kinds(nodes).filter(F.col("segmented").isNotNull() & ~hierarchy.is_device(F.col("type"), F.col("node_id"), F.col("has_ports")))
    own = own.withColumn("port_id", F.regexp_extract("segmented", r"([^/\\]+)$", 1))
    return own.groupBy("doc", "port_id").agg(F.min_by(F.struct("parent_id", "box"), "preorder").alias("x")).select("doc", "port_id", "x.parent_id", "x.box")


def resolved(nodes: DataFrame, dealt: int | None = None) -> DataFrame:
    """The ports of all documents with their parent and the rule that found it (hierarchy.parents), its kind (parent_type, else type, else category) and the base name of its picture.

    Nodes are stored in buckets of documents. dealt: the documents came from repartition(dealt, doc), which walk hides from Spark; else nodes are dealt here.
    Documents with a first device are answered within their bucket, so that nothing is exchanged; only the nodes of the others, whose boxes are asked too, go through joins."""
    parts = dealt or int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.drop("parent", "depth")
    nodes = stored(nodes if dealt else nodes.repartition(parts, "doc"), "nodes", "doc", parts)
    told = hierarchy.first_device(kinds(nodes)).filter("first_device is not null")
    return _resolved_in_place(nodes).unionByName(_resolved_by_joins(stored(nodes.join(told, "doc", "left_anti"), "untold")))


def _name() -> Column:
    """A node's kind and the base name of its picture."""
    return F.struct(F.coalesce("parent_type", "type", "category").alias("kind"), F.regexp_extract("segmented", r"([^/\\]+)$", 1).alias("picture"))


def _resolved_in_place(nodes: DataFrame) -> DataFrame:
    """resolved for documents with a first device, by aggregations and windows whose keys begin with doc: unlike joins, they take nodes as they are dealt.

    A node becomes a row for its port, one for its id and one for each listed picture; ports and ids then meet where a port's parent_id, and later its resolved id, is the id.
    """
    device = hierarchy.is_device(F.concat_ws(" ", "type", "category", "parent_type"), F.col("node_id"), F.col("has_ports"))
    n = nodes.filter("doc is not null").select("doc", "preorder", "node_id", "parent_id", device.alias("dev"), F.when(F.col("segmented").isNotNull() & ~device, _name()["picture"]).alias("own"), _name().alias("name"), "port_files")
    parts = """concat(if(own is null, array(), array(named_struct('role', 'port', 'port_id', own, 'id', cast(null as string)))),
        if(node_id is null and not dev, array(), array(named_struct('role', 'id', 'port_id', cast(null as string), 'id', node_id))),
        if(node_id is null, array(), transform(array_distinct(port_files), f -> named_struct('role', 'list', 'port_id', f, 'id', cast(null as string)))))"""
    rows = n.select("*", F.inline(F.expr(parts)))

    def of(role: str, c: str) -> Column:
        return F.when(F.col("role") == role, F.col(c))

    rows = rows.select("doc", "port_id", "id", of("port", "preorder").alias("port_at"), of("port", "parent_id").alias("parent_id"), of("list", "node_id").alias("lister"), of("id", "preorder").alias("id_at"), F.when((F.col("role") == "id") & F.col("dev"), F.col("preorder")).alias("dev_at"), of("id", "name").alias("name"))
    # one row for each port_id and one for each id of a document
    x = rows.groupBy("doc", "port_id", "id").agg(F.min("port_at").alias("port_at"), F.min_by("parent_id", "port_at").alias("parent_id"), F.min("lister").alias("holder"), F.min("dev_at").alias("dev_at"), F.min_by("name", "id_at").alias("name"))
    x = x.withColumn("first_device", F.min(F.when(F.col("dev_at").isNotNull(), F.struct("dev_at", "id"))).over(Window.partitionBy("doc"))["id"])
    x = x.filter("first_device is not null and (port_at is not null or id is not null)").withColumn("ref", F.coalesce("id", "parent_id"))
    named = F.max(F.col("id").isNotNull() & F.col("dev_at").isNotNull()).over(Window.partitionBy("doc", "ref"))
    x = x.withColumn("named", F.when(named, F.col("ref")))
    x = x.withColumns({
        "resolved": F.coalesce("id", "named", "holder", "first_device"),
        "rule": F.when(F.col("named").isNotNull(), "parent_id").when(F.col("holder").isNotNull(), "port_list").otherwise("first_device"),
    })
    x = x.withColumn("name", F.max("name").over(Window.partitionBy("doc", "resolved")))
    return x.filter("port_at is not null").select("doc", "port_id", "resolved", "rule", F.upper("name.kind").alias("label"), "name.picture")


def _resolved_by_joins(nodes: DataFrame) -> DataFrame:
    found = hierarchy.parents(ports(nodes), kinds(nodes), port_lists(nodes))
    named = nodes.filter("node_id is not null").groupBy("doc", F.col("node_id").alias("resolved")).agg(F.min_by(_name(), "preorder").alias("x"))
    return found.join(named, ["doc", "resolved"], "left").select("doc", "port_id", "resolved", "rule", F.upper("x.kind").alias("label"), "x.picture")


def device_pictures(nodes: DataFrame) -> DataFrame:
    """doc, preorder, picture of all devices that have one, in document order."""
    d = kinds(nodes).filter(hierarchy.is_device(F.col("type"), F.col("node_id"), F.col("has_ports")) & F.col("segmented").isNotNull())
    return d.select("doc", "preorder", F.regexp_extract("segmented", r"([^/\\]+)$", 1).alias("picture"))
