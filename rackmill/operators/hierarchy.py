"""Trees of detected things as node tables, and lookups by falling priority.

nodes: doc, node_id, preorder (position in document order), parent_path, type, segmented, box, has_ports. A tree with nested
objects becomes such a table once (tree.walk); every lookup is then a join or an aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from ..sources.shared import stored
from .match import dimension, first_match
from .spatial import overlap_join

# ---- fixed values -------------------------------------------------------------------------------
#: Port and connector kinds that name a patch panel's model, tried in this order.
PANEL_MODELS = ((r"rj[-_\s]?45", "RJ_45"), (r"lc\s*upc", "LC_UPC"), (r"sc\s*upc", "SC_UPC"), (r"mpo", "MPO"), (r"st\b", "ST"), (r"keystone", "Keystone"))
#: Vendors looked for in free text, in this order.
KNOWN_VENDORS = ("cisco", "juniper", "hpe", "hp", "aruba", "dell", "dlink", "netgear", "tp-link", "ubiquiti", "mikrotik", "cumulus", "brocade", "zte")
# -------------------------------------------------------------------------------------------------


def is_device(kind: Column, node_id: Column, has_ports: Column) -> Column:
    """Has ports, or a device word in its type or id."""
    words = r"(?i)switch|patch_?panel|panel|rack|chassis"
    return F.coalesce(has_ports, F.lit(False)) | F.coalesce(kind.rlike(words), F.lit(False)) | F.coalesce(node_id.rlike(words), F.lit(False))


def segmented_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes with a segmented picture, in document order."""
    return nodes.filter("segmented is not null").orderBy("doc", "preorder")


def first_device(nodes: DataFrame) -> DataFrame:
    """Of each document its first device."""
    d = nodes.filter(is_device(F.col("type"), F.col("node_id"), F.col("has_ports")))
    return d.groupBy("doc").agg(F.min_by("node_id", "preorder").alias("first_device"))


def parents(ports: DataFrame, nodes: DataFrame, holds: DataFrame) -> DataFrame:
    """Each port with its parent: the device that its parent_id names, else the device whose port list holds it, else
    the document's first device, else the first node whose box contains it; rule says which.

    ports: doc, port_id, parent_id, box; holds: doc, dev_id, port_id (port lists of devices).
    """
    dev = nodes.filter(is_device(F.col("type"), F.col("node_id"), F.col("has_ports"))).select("doc", F.col("node_id").alias("named"))
    holder = holds.join(dev.select("doc", F.col("named").alias("dev_id")), ["doc", "dev_id"], "left_semi").groupBy("doc", "port_id").agg(F.min("dev_id").alias("holder"))
    first = first_device(nodes)
    # boxes count only in documents without a first device
    told = first.filter("first_device is not null").select("doc")
    boxes = nodes.filter("box is not null and node_id is not null").join(told, "doc", "left_anti").select("doc", "preorder", F.col("node_id").alias("around"), F.col("box").alias("around_box"))
    inside = overlap_join(ports.select("doc", "port_id", "box").filter("box is not null").join(told, "doc", "left_anti"), boxes, "doc", "box", "around_box").filter(g.containment(F.col("box"), F.col("around_box")) == "Valid").groupBy("doc", "port_id").agg(F.min_by("around", "preorder").alias("around"))
    ids = dev.distinct().select(F.col("doc").alias("_doc"), "named")  # ports may come from the nodes themselves
    p = ports.join(ids, (F.col("doc") == F.col("_doc")) & (F.col("parent_id") == F.col("named")), "left").drop("_doc")
    p = p.join(holder, ["doc", "port_id"], "left").join(first, "doc", "left").join(inside, ["doc", "port_id"], "left")
    found = F.coalesce("named", "holder", "first_device", "around")
    rule = F.when(F.col("named").isNotNull(), "parent_id").when(F.col("holder").isNotNull(), "port_list").when(F.col("first_device").isNotNull(), "first_device").when(F.col("around").isNotNull(), "box")
    return p.select(*ports.columns, found.alias("resolved"), rule.alias("rule"))


def base_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/\\]+)$", 1))


def file_match(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each file (name) with the first node (doc, node_id, preorder, segmented) whose picture has the same base name, or one that holds the
    other. Only names without an equal are compared by content."""
    n = nodes.filter("segmented is not null").select("node_id", "preorder", base_name(F.col("segmented")).alias("_b")).filter("_b <> ''")
    n = stored(n, "pictures")  # read for equal names, its size and names that hold each other
    f = files.withColumn("_n", base_name(F.col("name")))
    equal = f.join(n, F.col("_n") == F.col("_b")).groupBy("name").agg(F.min_by("node_id", "preorder").alias("node_id"))
    rest = f.join(equal.select("name"), "name", "left_anti").filter("_n <> ''")
    near = first_match(rest, n, "_n", [F.col("_b").endswith(F.col("_n")) | F.col("_n").endswith(F.col("_b")), F.contains("_b", "_n") | F.contains("_n", "_b")], "preorder")
    return files.join(equal.unionByName(near.select("name", "node_id").filter("node_id is not null")), "name", "left")


def describe(facts: DataFrame, dim: DataFrame) -> DataFrame:
    """facts (vendor, model) with the description by vendor and model, else by model, else of the first model that holds the model's
    key; empty descriptions count as missing. dim: ord, vendor, model, description; of a repeated key the last row counts for a vendor, the first without."""
    d = dim.select("ord", F.lower("vendor").alias("_v"), tx.model_key(F.col("model")).alias("_m"), F.nullif(F.col("description"), F.lit("")).alias("_d")).filter("_m <> ''")
    f = facts.withColumns({"_fv": F.lower("vendor"), "_fm": tx.model_key(F.col("model"))})
    both = d.groupBy(F.col("_v").alias("_fv"), F.col("_m").alias("_fm")).agg(F.max_by("_d", "ord").alias("_d1"))
    alone = d.groupBy(F.col("_m").alias("_fm")).agg(F.min_by("_d", "ord").alias("_d2"))
    f = f.join(dimension(both), ["_fv", "_fm"], "left").join(dimension(alone), "_fm", "left")
    models = d.filter("_d is not null").groupBy("_m").agg(F.min("ord").alias("_o"), F.min_by("_d", "ord").alias("_d3"))
    rest = f.filter("_d1 is null and _d2 is null and _fm <> ''").select("_fm").distinct()
    held = rest.join(dimension(models), F.contains("_m", "_fm")).groupBy("_fm").agg(F.min_by("_d3", "_o").alias("_d3"))
    return f.join(held, "_fm", "left").select(*facts.columns, F.coalesce("_d1", "_d2", "_d3").alias("description"))


def vendor_keys(facts: DataFrame, vendors: DataFrame) -> DataFrame:
    """facts (vendor) with the known vendor of the same normalised name, else the first that it holds, else the first that holds it. vendors: ord, known."""
    d = vendors.withColumn("_k", tx.vendor_key(F.col("known"))).filter("_k <> ''")
    f = facts.withColumn("_f", tx.vendor_key(F.col("vendor")))
    has = F.length("_f") > 0
    return first_match(f, d, "_f", [F.col("_f") == F.col("_k"), has & F.contains("_f", "_k"), has & F.contains("_k", "_f")], "ord").select(*facts.columns, "known", "rule")


def kept_units(units: DataFrame, rule: str) -> DataFrame:
    """units (n_switch, n_panel, n_ports) that a pipeline keeps: `ports` needs a device and ports, `one_kind` also that all devices are of one
    kind, `device` a device only."""
    device, ports = (F.col("n_switch") + F.col("n_panel")) > 0, F.col("n_ports") > 0
    return units.filter({"ports": device & ports, "one_kind": device & ports & ~((F.col("n_switch") > 0) & (F.col("n_panel") > 0)), "device": device}[rule])


def panel_model(text: Column) -> Column:
    """The first kind that the text names, else its port count, else null."""

    def named(low: Column) -> Column:
        out = F.when(F.lit(False), "")
        for pattern, name in PANEL_MODELS:
            out = out.when(low.rlike(pattern), name)
        count = F.nullif(F.replace(F.regexp_extract(low, r"(\b\d{1,2}[- ]?port\b|\b\d{1,2}p\b)", 1), F.lit(" "), F.lit("_")), F.lit(""))
        return out.otherwise(count)

    return tx.let(F.lower(text), named)


def guess(texts: Column, vendors: Sequence[str] = KNOWN_VENDORS) -> Column:
    """struct of vendor, model, description from cell texts: the first text with a known vendor (vendors in order), the first other
    text of at most 60 characters that looks like a model, and the longest remaining one over eight characters (the first of equals)."""

    def from_cells(cells: Column) -> Column:
        vendor = F.coalesce(*(F.get(F.filter(cells, _holding(v)), F.lit(0)) for v in vendors))
        return tx.let(vendor, lambda vendor: tx.let(_model_of(cells, vendor), lambda model: F.struct(vendor.alias("vendor"), model.alias("model"), _longest(cells, vendor, model).alias("description"))))

    return tx.let(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t != ""), from_cells)


def _model_of(cells: Column, vendor: Column) -> Column:
    return F.get(F.filter(cells, lambda t: t.rlike(r"[A-Za-z0-9][A-Za-z0-9_/-]{2,}") & (F.length(t) <= 60) & ~F.coalesce(t == vendor, F.lit(False))), F.lit(0))


def _longest(cells: Column, vendor: Column, model: Column) -> Column:
    rest = F.filter(cells, lambda t: ~F.coalesce(t == vendor, F.lit(False)) & ~F.coalesce(t == model, F.lit(False)) & (F.length(t) > 8))
    return tx.let(rest, lambda rest: F.get(F.filter(rest, lambda t: F.length(t) == F.array_max(F.transform(rest, lambda r: F.length(r)))), F.lit(0)))


def _holding(word: str):
    return lambda t: F.lower(t).contains(word)


def numbered(rows: DataFrame, per: Sequence[str], order: Sequence[str], pattern: str = "port_%d") -> DataFrame:
    """Running names within `per`."""
    n = F.row_number().over(Window.partitionBy(*per).orderBy(*order))
    return rows.withColumn("_n", n).withColumn("name", F.format_string(pattern, "_n")).drop("_n")
