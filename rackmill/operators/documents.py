"""Report texts: sections, line pairs, labels, summaries, and the nested audit document."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# The titles that open a section of a report, as reports have them; letter case doesn't matter.
SECTIONS = (
    ("patch_panel_details", "Patch Panel Classification Results"),
    ("rack_details", "Rack Detection Report"),
    ("switch_details", "OCR Vendor & Model Detection|Switch Make and Model|Switch Classification"),
    ("cable_classification", "Cable Classification Report"),
    ("empty_ports", "EMPTY PORT IDENTIFICATION AND LOCATION"),
    ("connected_ports", "Connected Port Classification"),
)


def lines(docs: DataFrame, key: str = "doc", text: str = "text", drop: Sequence[str] = ()) -> DataFrame:
    """key, line_no, line: white space collapsed, empty lines and lines with one of the prefixes dropped; numbers are those of the text."""
    raw = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    out = raw.withColumn("line", F.trim(F.regexp_replace("line", r"\s+", " "))).filter("line <> ''")
    for p in drop:
        out = out.filter(~F.col("line").startswith(p))
    return out


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc, text: pages in order with line ends between; null pages are skipped."""
    return pages.filter("text is not null").groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "\n").alias("text"))


def section_spans(heads: DataFrame, key: str = "doc", at: str = "start", name: str = "section", length: str = "length") -> DataFrame:
    """Where each section begins and ends: at the next header of any name, or the end; of a name the last occurrence counts."""
    w = Window.partitionBy(key).orderBy(at, name)
    spans = heads.withColumn("end", F.coalesce(F.lead(at).over(w), F.col(length)))
    return spans.groupBy(key, name).agg(F.max(at).alias("start"), F.max_by("end", at).alias("end"))


def sections(docs: DataFrame, key: str = "doc", text: str = "text", patterns: Sequence[tuple[str, str]] = SECTIONS) -> DataFrame:
    """key, section, text of all sections whose header is found."""
    heads = None
    for name, p in patterns:
        hits, pieces = F.regexp_extract_all(text, F.lit(f"(?i)({p})"), F.lit(1)), F.split(text, f"(?i)(?:{p})")
        h = docs.select(key, F.lit(name).alias("section"), F.length(text).alias("length"), F.explode(_starts(hits, pieces)).alias("start"))
        heads = h if heads is None else heads.unionByName(h)
    spans = section_spans(heads, key)
    return docs.join(spans, key).select(key, "section", F.substring(text, F.col("start") + 1, F.col("end") - F.col("start")).alias("text"))


def _starts(hits: Column, pieces: Column) -> Column:
    """Where each match begins: behind all texts between matches and all matches before it."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(hits, lambda h, i: total(F.slice(pieces, 1, i + 1)) + total(F.slice(hits, 1, i)))


def line_pairs(rows: DataFrame, key: str = "doc", order: str = "line_no", line: str = "line", first: str = "Vendor:", second: str = "Model:") -> DataFrame:
    """Lines that begin with `first` and are followed by one that begins with `second`: what stands behind both."""
    w = Window.partitionBy(key).orderBy(order)
    nxt = rows.withColumn("_next", F.lead(line).over(w)).filter(F.col(line).startswith(first) & F.col("_next").startswith(second))
    return nxt.select(key, order, F.trim(F.substring(line, len(first) + 1, 1 << 30)).alias("first"), F.trim(F.substring("_next", len(second) + 1, 1 << 30)).alias("second"))


def unit_lines(rows: DataFrame, line: str = "line") -> DataFrame:
    return rows.filter(F.col(line).rlike(r"(?i)\b\d+(st|nd|rd|th) unit"))


def keyword_lines(rows: DataFrame, words: Sequence[str], line: str = "line") -> DataFrame:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.lower(line).contains(w)
    return rows.filter(hit)


def long_lines(rows: DataFrame, words: int = 4, line: str = "line") -> DataFrame:
    return rows.filter(F.size(F.split(line, " ")) > words)


def leaf_labels(leaves: DataFrame, patterns: Sequence[tuple[str, str]], key: str = "doc", leaf: str = "leaf") -> DataFrame:
    """key and the sorted labels whose pattern matches any string leaf."""
    own = F.array_compact(F.array(*(F.when(F.col(leaf).rlike(p), F.lit(label)) for label, p in patterns)))
    return leaves.withColumn("_label", F.explode_outer(own)).groupBy(key).agg(F.array_sort(F.collect_set("_label")).alias("labels"))


_LEAVES = "array<struct<path:array<int>,leaf:string>>"


def _string_leaves(json_texts: pa.Array) -> pa.Array:
    out = []
    for t in json_texts.to_pylist():
        found, rest = [], [((), json.loads(t))] if t is not None else []
        while rest:
            path, v = rest.pop()
            if isinstance(v, str):
                found.append({"path": path, "leaf": v})
            elif isinstance(v, (dict, list)):
                rest += [((*path, i), x) for i, x in enumerate(v.values() if isinstance(v, dict) else v)][::-1]
        out.append(found)
    return pa.array(out, pa.list_(pa.struct([("path", pa.list_(pa.int32())), ("leaf", pa.string())])))


def json_leaves(docs: DataFrame, key: str = "doc", text: str = "json") -> DataFrame:
    """All string leaves of JSON documents, in document order with the members of an object by name; a corrupt document has none.
    Each document is walked in its own row, at any number of leaves; Spark's parser calls a document of over about 1,000 levels corrupt."""
    leaves = F.arrow_udf(_string_leaves, _LEAVES)(F.to_json(F.try_parse_json(text)))
    return docs.select(F.col(key), F.explode(leaves).alias("_l")).select(key, "_l.path", "_l.leaf")


def summary_sentence(units: Column, constant: str = "The rack holds no identified devices.") -> Column:
    """Vendor and device of each unit, comma-separated; the constant if there are none. units: array of struct(vendor, device)."""
    names = F.transform(units, lambda u: F.trim(F.concat_ws(" ", u["vendor"], u["device"])))
    return F.coalesce(F.nullif(F.array_join(F.filter(names, lambda n: n != ""), ", "), F.lit("")), F.lit(constant))


# ---- fixed values: kinds of ports and cables that a text names, and the units assumed where none is told -----------
PORT_KINDS = (("RJ-45 / Keystone", r"(?i)rj[ _-]?45|keystone"), ("LC Fiber", r"(?i)\bLC\b"), ("SC Fiber", r"(?i)\bSC\b"), ("ST Fiber", r"(?i)\bST\b"), ("SFP / QSFP", r"(?i)sfp"), ("USB", r"(?i)\bUSB\b"))
CABLE_KINDS = (("Ethernet copper cables", r"(?i)ethernet|cat[5-8]|twisted pair|copper"), ("fiber optic cables", r"(?i)fiber|optical|\b(?:lc|sc|st)\b"))
UNITS = 6
# --------------------------------------------------------------------------------------------------------------------
#: The summary as data: section, what must be there (names of facts; with ! what must not), and the sentence with the facts in it. Of a section's sentences all that hold are said, in order.
RULES = (
    ("", "type vendor", "The audit covers a rack of type {type} by {vendor}, with its panels, switches and cabling"),
    ("", "type !vendor", "The audit covers a rack of type {type}, with its panels, switches and cabling"),
    ("", "!type", "The audit covers a rack with its panels, switches and cabling"),
    ("", "", "Units are allocated in order and terminated alike"),
    ("", "lc", "Ethernet runs over RJ-45, and fiber links end in LC connectors"),
    ("", "!lc", "Ethernet runs over RJ-45"),
    ("", "qsfp", "Fast interfaces leave room for more bandwidth"),
    ("", "!qsfp", "The layout leaves room for additions"),
    ("Rack Overview", "type vendor", "Form factor {type}, by {vendor}."),
    ("Rack Overview", "type !vendor", "Form factor {type}."),
    ("Rack Overview", "!type vendor", "By {vendor}."),
    ("Rack Overview", "", "The rack has {n_units} units."),
    ("Rack Overview", "layout", "Layout: {layout}."),
    ("Rack Overview", "!layout", "Its units are panels, switches and empty slots."),
    ("Patch Panels", "", "RJ-45 is the standard termination."),
    ("Patch Panels", "", "Ports are coloured by use."),
    ("Patch Panels", "nema", "Power outlets such as NEMA 5-15 are on the panels."),
    ("Switches", "vendors", "Switches by {vendors}."),
    ("Switches", "!vendors", "No switch vendor could be read."),
    ("Switches", "models", "The models of some units are known."),
    ("Ports", "lc", "LC connectors serve the fiber segments."),
    ("Ports", "", "RJ-45 serves Ethernet."),
    ("Ports", "qsfp", "QSFP interfaces are there for more bandwidth."),
    ("Cabling", "colours", "Twisted pair in {colours}."),
    ("Cabling", "cables", "Cables: {cables}."),
    ("Cabling", "!cables", "Cables are twisted pair, and fiber where it applies."),
    ("Cabling", "ports", "Port kinds: {ports}."),
    ("Capacity", "", "Free interfaces and units allow for more links and devices."),
)


def kinds_named(texts: Column, kinds: Sequence[tuple[str, str]]) -> Column:
    """The sorted names of the kinds whose pattern any of the texts matches."""
    return F.array_sort(F.array_compact(F.array(*(F.when(F.exists(texts, _matching(p)), F.lit(name)) for name, p in kinds))))


def _matching(pattern: str):
    return lambda t: F.coalesce(t.rlike(pattern), F.lit(False))


def switch_pairs(switches: Column) -> Column:
    """Distinct (vendor, model) pairs in the order of their first place; null is empty. switches: array of struct(vendor, model)."""
    return F.array_distinct(F.transform(switches, lambda s: F.struct(F.coalesce(s["vendor"], F.lit("")).alias("vendor"), F.coalesce(s["model"], F.lit("")).alias("model"))))


def sections_of_summary(audit: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, compat: bool = False) -> DataFrame:
    """doc, section (empty for the first paragraph), place and points (array of sentences), one row for each section of the rules.

    audit: doc, rack_type, rack_vendor, units (array of struct(unit_no, kind)), switches (array of struct(vendor, model)), port_texts, panel_texts, leaves (arrays of strings), full_text. A null array is empty.
    compat: what older reports never found, connectors, outlets and units, is never there."""
    some = lambda c, t: F.coalesce(F.col(c), F.array().cast(t))
    texts = lambda c: some(c, "array<string>")
    names = lambda field: F.array_sort(F.filter(F.array_distinct(F.transform(switch_pairs(F.col("switches")), lambda s: s[field])), lambda v: v != ""))
    layout = F.array_join(F.transform(F.array_sort(some("units", audit.schema["units"].dataType.simpleString())), lambda u: F.concat(u["unit_no"].cast("string"), F.lit(": "), u["kind"])), ", ")
    found = lambda c, p: F.when(F.lit(not compat) & F.exists(texts(c), _matching(p)), F.lit("yes"))
    facts = {
        "type": F.lower(F.nullif("rack_type", F.lit(""))), "vendor": F.nullif("rack_vendor", F.lit("")),
        "n_units": (F.lit(UNITS) if compat else F.coalesce(F.array_max(F.transform("units", lambda u: u["unit_no"])), F.lit(UNITS))).cast("string"), "layout": F.lit(None).cast("string") if compat else F.nullif(layout, F.lit("")),
        "lc": found("port_texts", r"(?i)\bLC\b"), "qsfp": found("port_texts", r"(?i)\bQSFP(?:28)?\b"), "nema": found("panel_texts", r"(?i)\bNEMA\b"),
        "vendors": F.nullif(F.array_join(names("vendor"), ", "), F.lit("")), "models": F.nullif(F.array_join(names("model"), ", "), F.lit("")), "colours": F.nullif(F.array_join(tx.colours(F.col("full_text")), ", "), F.lit("")),
        "cables": F.nullif(F.array_join(kinds_named(texts("leaves"), CABLE_KINDS), ", "), F.lit("")), "ports": F.nullif(F.array_join(kinds_named(texts("leaves"), PORT_KINDS), ", "), F.lit("")),
    }
    d = audit.select("doc", *(v.alias(f"_{k}") for k, v in facts.items()))

    def said(needs: str, sentence: str) -> Column:
        ok = F.lit(True)
        for n in needs.split():
            ok = ok & (F.col(f"_{n[1:]}").isNull() if n.startswith("!") else F.col(f"_{n}").isNotNull())
        pieces = re.split(r"\{(\w+)\}", sentence)
        return F.when(ok, F.concat(*(F.lit(p) if k % 2 == 0 else F.coalesce(f"_{p}", F.lit("")) for k, p in enumerate(pieces))))

    titles = list(dict.fromkeys(t for t, _, _ in rules))
    own = [F.struct(F.lit(t).alias("section"), F.lit(k).alias("place"), F.array_compact(F.array(*(said(n, s) for title, n, s in rules if title == t))).alias("points")) for k, t in enumerate(titles)]
    return d.select("doc", F.explode(F.array(*own)).alias("_s")).select("doc", "_s.*")


def summary(audit: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, compat: bool = False) -> DataFrame:
    """doc and text: the sections with their titles, each sentence on a line of its own with a bullet and a full stop."""
    s = sections_of_summary(audit, rules, compat)
    bullets = F.array_join(F.transform("points", lambda p: F.concat(F.lit("- "), F.rtrim(p), F.when(F.rtrim(p).endswith("."), "").otherwise("."))), "\n")
    block = F.concat(F.when(F.col("section") == "", "").otherwise(F.concat(F.lit("**"), "section", F.lit("**\n"))), bullets)
    return s.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("text"))


def report_of(rows: Column, columns: Mapping[str, Callable[[Column], Column]], order: Callable[[Column], Column], name: str) -> Column:
    """An HTML table of an array of rows, every cell escaped. columns: header and what a row has below it; rows are in order, equal ones by their text."""
    cell = lambda c: F.concat(F.lit("<td>"), tx.html_escape(F.coalesce(c.cast("string"), F.lit("N/A"))), F.lit("</td>"))
    text = lambda x: F.concat(F.lit("<tr>"), *(cell(value(x)) for value in columns.values()), F.lit("</tr>"))
    body = F.array_join(F.transform(F.array_sort(F.transform(rows, lambda x: F.struct(order(x).alias("o"), text(x).alias("r")))), lambda x: x["r"]), "\n")
    head = "".join(f"<th>{c}</th>" for c in columns)
    return F.concat(F.lit(f"<html><body><h1>{name}</h1><table><tr>{head}</tr>\n"), body, F.lit("</table></body></html>"))


def report_table(rows: DataFrame, columns: Sequence[str], key: str, order: str, name: str) -> DataFrame:
    """key and an HTML table of its rows, every cell escaped; header and cells come from one list."""
    own = F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_c")))
    return rows.groupBy(key).agg(report_of(own, {c: _under(c) for c in columns}, lambda x: x["_o"], name).alias("html"))


def _under(column: str):
    return lambda x: x["_c"][column]


def _body_rows(docs: DataFrame, key: str, html: str, least: int) -> DataFrame:
    rows = docs.select(key, F.posexplode(tx.html_rows(F.col(html), "td")).alias("ord", "_c"))
    return rows.filter((F.col("ord") > 0) & (F.size("_c") >= least))


def connected_rows(docs: DataFrame, key: str = "doc", html: str = "html") -> DataFrame:
    """Ports of a report's table of connected ports. Its first row is the header; rows of fewer than six cells and those with
    n/a as description and as usage of the cable give nothing; a seventh cell is optional. ord is the row's number in the table."""
    names = ("cable", "cable_description", "usage", "port", "port_description", "other_port")
    out = _body_rows(docs, key, html, 6).select(key, "ord", *(F.coalesce(F.get("_c", F.lit(k)), F.lit("")).alias(n) for k, n in enumerate(names, 1)))
    return out.filter(~((F.lower("cable_description") == "n/a") & (F.lower("usage") == "n/a")))


def empty_rows(docs: DataFrame, key: str = "doc", html: str = "html", compat: bool = False) -> DataFrame:
    """Ports of a report's table of empty ports: QSFP28 or SFP if the class column says so, else Ethernet. The class stands in the second cell, or in the only one; rows without a cell give nothing.
    compat: by the first cell, which holds the picture, and SFP for both."""
    cell = F.get("_c", F.lit(0)) if compat else F.coalesce(F.get("_c", F.lit(1)), F.get("_c", F.lit(0)))
    kind = F.when(cell.contains("SFP"), "SFP").otherwise("Ethernet")
    kind = kind if compat else F.when(cell.contains("QSFP"), "QSFP28").otherwise(kind)
    return _body_rows(docs, key, html, 1).select(key, "ord", kind.alias("type"))


def nested_devices(ports: DataFrame, devices: DataFrame) -> DataFrame:
    """image and its devices, each with ports.connected and ports.empty, all arrays sorted. ports: image, port_id, state, box, parent_id, validation."""
    p = F.struct("port_id", "box", "validation")
    own = ports.filter("parent_id is not null").groupBy("image", F.col("parent_id").alias("dev_id")).agg(F.array_sort(F.collect_list(F.when(F.col("state") == "connected", p))).alias("connected"), F.array_sort(F.collect_list(F.when(F.col("state") == "empty", p))).alias("empty"))
    d = devices.join(own, ["image", "dev_id"], "left").withColumn("ports", F.struct("connected", "empty"))
    return d.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("ordinal", "dev_id", "kind", "box", "ports"))).alias("devices"))


def audit_document(units: DataFrame, connected: DataFrame, empty: DataFrame, compat: bool = False) -> DataFrame:
    """job and the nested audit. Port numbers run over all units of a job, connected before empty ones, units by number
    (compat: by name, so 10 comes before 2). Null fields vanish in JSON.

    units: job, unit_no, device_type, vendor, model, description; connected: job, unit_no, ord, port, port_description, other_port, cable, cable_description, usage;
    empty: job, unit_no, ord, type, description.
    """
    unit_order = F.col("unit_no").cast("string") if compat else F.col("unit_no")
    c = connected.filter(~((F.lower(F.coalesce("cable_description", F.lit(""))) == "n/a") & (F.lower(F.coalesce("usage", F.lit(""))) == "n/a")))
    every = c.select("job", "unit_no", F.lit(0).alias("k"), "ord", F.struct("port", "port_description", "other_port", "cable", "cable_description", "usage").alias("c"), F.lit(None).cast("struct<type:string,description:string>").alias("e"))
    kind = F.when(F.upper(F.col("type")).contains("QSFP"), "QSFP").when(F.upper(F.col("type")).contains("SFP"), "SFP").otherwise(F.coalesce("type", F.lit("Ethernet")))
    every = every.unionByName(empty.select("job", "unit_no", F.lit(1).alias("k"), "ord", F.lit(None).cast(every.schema["c"].dataType).alias("c"), F.struct(kind.alias("type"), "description").alias("e")))
    n = F.row_number().over(Window.partitionBy("job").orderBy(unit_order, "k", "ord"))
    numbered = every.withColumn("n", n).withColumn("port_id", F.format_string("port_%d", "n"))
    own = numbered.groupBy("job", "unit_no").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == 0, F.struct("n", "port_id", "c")))), lambda x: F.struct(x["port_id"].alias("port_id"), x["c"].alias("port"))).alias("connected_ports"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == 1, F.struct("n", "port_id", "e")))), lambda x: F.struct(x["port_id"].alias("port_id"), x["e"].alias("port"))).alias("empty_ports"),
    )
    u = units.join(own, ["job", "unit_no"], "left").withColumn("unit", F.struct(F.struct(unit_order.alias("o")).alias("o"), F.struct(F.concat(F.lit("unit"), F.col("unit_no").cast("string")).alias("unit_id"), "device_type", "vendor", "model", "description", "connected_ports", "empty_ports").alias("u")))
    return u.groupBy("job").agg(F.transform(F.array_sort(F.collect_list("unit")), lambda x: x["u"]).alias("units"))
