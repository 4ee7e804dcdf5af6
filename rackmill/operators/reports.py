"""HTML reports: six layouts as data, the merge of a job's reports, and the way back from reports to the audit document."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as tx
from . import hierarchy


@dataclass(frozen=True)
class Layout:
    """A report's title and its columns: header, kind of cell and field. Kinds: text; picture (a URI); band (of a confidence); label (of a port class); list (array of texts); pair (two fields, the first in capitals)."""

    title: str
    columns: tuple[tuple[str, str, str], ...]


# ---- fixed values -------------------------------------------------------------------------------
#: Titles and headers of the reports.
LAYOUTS = {
    "rack": Layout("Rack Analysis Report", (("Rack", "picture", "image"), ("Rack Type & Vendor", "pair", "rack_type vendor"), ("Annotated", "picture", "annotated"), ("Summary", "list", "summary"), ("Detected OCR", "text", "ocr_text"))),
    "switch": Layout("Switch Analysis Report", (("Switch", "picture", "image"), ("Predicted Vendor", "text", "vendor"), ("Switch Model", "text", "model"), ("Description", "text", "description"), ("Detected OCR", "text", "ocr_text"))),
    "patch_panel": Layout("Patch Panel Analysis Report", (("Patch Panel", "picture", "image"), ("Predicted Model", "text", "model"), ("Description", "text", "description"), ("Similarity", "band", "confidence"))),
    "connected_port": Layout("Connected Port Analysis Report", (("Image", "picture", "image"), ("Cable", "text", "cable"), ("Description", "text", "cable_description"), ("Usage", "text", "usage"), ("Port", "text", "port"), ("Port Desc", "text", "port_description"), ("Other Port", "text", "other_port"))),
    "empty_port": Layout("Empty Port Analysis Report", (("Port", "picture", "image"), ("Predicted Port", "text", "port_class"), ("Expected Cable", "label", "port_class"), ("Description", "text", "description"))),
    "cable": Layout("Cable Analysis Report", (("Cable", "picture", "image"), ("Predicted Model", "text", "model"), ("Cable Type", "text", "cable_type"), ("Usage", "text", "usage"), ("Key Features", "text", "features"), ("Description", "text", "description"))),
}
#: What an empty port's class stands for in the audit: word in the class, type, description. The first word that fits counts.
EMPTY_PORTS = (
    ("QSFP", "QSFP28", "Quad Small Form-factor Pluggable 28 connector supporting 100 Gbps high-speed data transmission over fiber optic cables."),
    ("SFP", "SFP", "Small Form-factor Pluggable transceiver used for high-speed fiber optic connections in telecommunications and data center networks."),
    ("", "Ethernet", "Eight-pin Ethernet connector used for wired LANs, supporting speeds from 10 Mbps to 10 Gbps depending on cable type."),
)
#: Words in a rack's type and what they mean, and what stands where nothing is found.
RACK_TYPES = (("enclosed", "enclosed"), ("openframe", "openframe"), ("open frame", "openframe"), ("wall", "wall_mounted"))
NO_TYPE, NO_VENDOR = "Network Rack", "Generic / Unknown"
#: Cell texts that say nothing.
STOP = ("switch model", "description", "detected ocr", "detected", "ocr", "model", "vendor", "switch", "device", "device info", "not detected", "unknown", "none", "n/a", "na")
HEADER_WORDS = ("model", "description", "vendor", "detected", "ocr")
NO_MODEL = ("unknown", "not detected", "model", "switch model")
# -------------------------------------------------------------------------------------------------


# ---- writing ----


def _text(c: Column) -> Column:
    return tx.html_escape(F.coalesce(c.cast("string"), F.lit("")))


def _cell(kind: str, field: str) -> Column:
    if kind == "picture":
        return F.when(F.col(field).isNotNull(), F.concat(F.lit('<img src="'), _text(F.col(field)), F.lit('">'))).otherwise("")
    if kind == "band":
        return F.coalesce(g.confidence_band(F.col(field)), F.lit(""))
    if kind == "label":
        return tx.html_escape(tx.cable_label(F.col(field)))
    if kind == "list":
        return F.concat(F.lit("<ul>"), F.array_join(F.transform(F.coalesce(field, F.array().cast("array<string>")), lambda x: F.concat(F.lit("<li>"), _text(x), F.lit("</li>"))), ""), F.lit("</ul>"))
    if kind == "pair":
        first, second = field.split(" ")
        return F.concat(F.lit("<b>"), F.upper(_text(F.col(first))), F.lit("</b><br>"), _text(F.col(second)))
    return _text(F.col(field))


def table_of(layout: Layout) -> tuple[str, Column]:
    """The header row and the row of a record: both come from the layout, so they always have the same cells."""
    cells = [F.concat(F.lit("<td>"), _cell(kind, field), F.lit("</td>")) for _, kind, field in layout.columns]
    return "<tr>" + "".join(f"<th>{header.replace('&', '&amp;')}</th>" for header, _, _ in layout.columns) + "</tr>", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))


def _listed(row: Column, order: Sequence[str]) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("_row")))), lambda x: x["_row"]), "\n")


def report(rows: DataFrame, layout: Layout, key: str, order: Sequence[str]) -> DataFrame:
    """key and the HTML report of its rows, in order; every text is escaped, null is empty."""
    head, row = table_of(layout)
    return rows.groupBy(key).agg(F.concat(F.lit(f"<html><body><h2>{layout.title}</h2><table>\n{head}\n"), _listed(row, order), F.lit("\n</table></body></html>")).alias("html"))


def unit_report(units: DataFrame, connected: DataFrame, empty: DataFrame) -> DataFrame:
    """job, name (unit<number>_report.html) and html of each unit: a badge, its device as a table, and a section for either kind of port.
    units: job, unit_no, device_type, kind (a layout), and the layout's fields; connected, empty: job, unit_no, ord and their layouts' fields."""
    on = ["job", "unit_no"]

    def section(rows: DataFrame, layout: str, title: str, out: str) -> DataFrame:
        head, row = table_of(LAYOUTS[layout])
        return rows.groupBy(*on).agg(F.concat(F.lit(f'<div class="section"><h2 class="section-title">{title}</h2><table>{head}\n'), _listed(row, ["ord"]), F.lit("</table></div>\n")).alias(out))

    head, row = table_of(LAYOUTS["switch"])
    u = units.join(section(connected, "connected_port", "Connected Ports", "_c"), on, "left").join(section(empty, "empty_port", "Empty Ports", "_e"), on, "left")
    info = F.concat(F.lit(f'<div class="device-info"><table>{head}\n'), row, F.lit("</table></div>\n"))
    html = F.concat(F.lit('<html><body><div class="device-badge">'), _text(F.col("device_type")), F.lit("</div>\n"), info, F.coalesce("_c", F.lit("")), F.coalesce("_e", F.lit("")), F.lit("</body></html>"))
    return u.select("job", F.concat(F.lit("unit"), F.col("unit_no").cast("string"), F.lit("_report.html")).alias("name"), html.alias("html"))


# ---- merging ----


def merged(reports: DataFrame, key: str = "job") -> DataFrame:
    """key and one document with a row for each report that says something, in order of category and then of name: its category, its name and
    its body, with addresses below the report's own folder. reports: key, name, folder, html. Reports named as without pictures are left out; a job of which nothing is left has no row.
    Null html says nothing."""
    body = tx.html_body(F.col("html"))
    own = reports.filter(tx.html_meaningful(F.col("html")) & ~tx.no_images(F.col("name")) & tx.body_meaningful(body))
    rank, name = tx.category_rank(F.col("name")), F.lower("name")
    title = F.initcap(F.replace(F.coalesce(tx.category(F.col("name")), F.lit("unknown")), F.lit("_"), F.lit(" ")))
    row = F.concat(F.lit("<tr><td><strong>"), title, F.lit("</strong><br/><small>"), tx.html_escape(F.col("name")), F.lit("</small></td><td>"), tx.rebased(body, F.col("folder")), F.lit("</td></tr>"))
    own = own.select(key, rank.alias("rank"), name.alias("low"), "name", row.alias("row"))
    return own.groupBy(key).agg(F.concat(F.lit("<html><body><table>\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "low", "name", "row"))), lambda x: x["row"]), "\n"), F.lit("\n</table></body></html>")).alias("html"))


# ---- reading ----


def _div(html: Column, name: str) -> Column:
    """What stands in the first <div> of a class, up to the next </div>; null without one."""
    return F.nullif(F.regexp_extract(html, rf"""(?is)(<div[^>]*class\s*=\s*["']{name}["'][^>]*>.*?)</div>""", 1), F.lit(""))


def _plain(html: Column) -> Column:
    """Text with a line for every piece between tags."""
    lines = F.regexp_replace(tx.html_unescape(F.regexp_replace(html, r"(?s)<[^>]*>", "\n")), r"[ \t]+", " ")
    return F.btrim(F.regexp_replace(lines, r"\s*\n\s*", "\n"), F.lit(" \n"))


def _column(table: Column, word: str) -> Column:
    """The first data row's cell below the first header that holds the word; null without one."""
    heads = F.transform(F.get(table, F.lit(0)), lambda h: F.lower(h).contains(word))
    return tx.let(F.array_position(heads, F.lit(True)) - 1, lambda at: F.when(at >= 0, F.trim(F.get(F.get(table, F.lit(1)), at.cast("int")))))


def _last(tables: Column, value) -> Column:
    """The last table's value that isn't null."""
    return tx.let(F.filter(F.transform(tables, value), lambda v: v.isNotNull()), lambda found: F.get(found, F.size(found) - 1))


def _after(text: Column, word: str) -> Column:
    """What stands behind a word, a colon or white space between; null if nothing."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"(?i){word}[:\s]+([^\n,]+)", 1)), F.lit(""))


def _said_after(text: Column, word: str) -> Column:
    """What stands behind a word and a colon, at the first place that says something. Words alone are headers of tables, which are read as such."""
    found = F.regexp_extract_all(text, F.lit(rf"(?i){word}\s*:\s*([^\n,]+)"), F.lit(1))
    return F.get(F.filter(F.transform(found, said), lambda v: v.isNotNull()), F.lit(0))


def said(value: Column) -> Column:
    """The value, or null where it is a placeholder."""
    return tx.placeholder(value, STOP, HEADER_WORDS)


def _named(value: Column) -> Column:
    """A guess, or null where the cell it comes from is a placeholder; capitals are no reason, since models are written so."""
    return F.when(~F.lower(value).isin(*STOP, *NO_MODEL), value)


def units(reports: DataFrame) -> DataFrame:
    """job, unit_no, device_type, vendor, model, description of reports named unit<number>..._report.html. reports: job, name, html.

    From the device's tables by their headers, the last table that says something; what is missing then is guessed from a switch's cells, read behind the word and a colon in the
    device's text, or for a patch panel told by the kinds that its text and description name. Patch panels have no vendor."""
    r = reports.withColumn("unit_no", _unit_no()).filter("unit_no is not null")
    return _told(r, []).select("job", "unit_no", "device_type", "vendor", "model", "description")


def _unit_no() -> Column:
    return F.nullif(F.regexp_extract("name", r"^unit(\d+).*_report\.html$", 1), F.lit("")).cast("long")


def _told(r: DataFrame, keep: Sequence[str]) -> DataFrame:
    """job, unit_no, what units() says, and the columns to keep. r: job, unit_no, html and those."""
    kind = F.lower(F.coalesce(F.nullif(_plain(_div(F.col("html"), "device-badge")), F.lit("")), F.lit("unknown")))
    r = r.select("job", "unit_no", *keep, kind.alias("device_type"), _div(F.col("html"), "device-info").alias("info"))
    tables = F.filter(F.transform(F.regexp_extract_all("info", F.lit(r"(?is)(<table.*?</table>)"), F.lit(1)), lambda t: tx.html_rows(t)), lambda t: F.size(t) > 1)
    r = r.select("job", "unit_no", *keep, "device_type", F.coalesce(tables, F.array().cast("array<array<array<string>>>")).alias("tables"), _plain(F.col("info")).alias("plain"))
    panel, switch = F.col("device_type").isin("patch panel", "patchpanel"), F.col("device_type") == "switch"
    model = _last(F.col("tables"), lambda t: tx.let(_column(t, "model"), lambda v: F.when(~F.lower(v).isin("", *NO_MODEL), v)))
    description = _last(F.col("tables"), lambda t: tx.let(said(_column(t, "description")), lambda v: F.when(F.length(v) > 2, tx.one_line(v))))
    r = r.withColumns({"vendor": F.when(~panel, _last(F.col("tables"), lambda t: said(_column(t, "vendor")))), "model": model, "description": description, "guess": F.when(switch, hierarchy.guess(F.get(F.get("tables", F.size("tables") - 1), F.lit(1))))})
    r = r.withColumns({
        "vendor": F.coalesce("vendor", F.col("guess.vendor"), F.when(~panel, _said_after(F.col("plain"), "vendor"))),
        "model": F.coalesce("model", _named(F.col("guess.model")), _said_after(F.col("plain"), "model")),
        "description": F.coalesce("description", _named(F.col("guess.description")), tx.one_line_or_null(_said_after(F.col("plain"), "description"))),
    })
    named = F.when(F.col("device_type").contains("patch"), hierarchy.panel_model(F.concat_ws(" ", "plain", "description")))
    return r.select("job", "unit_no", *keep, "device_type", "vendor", F.coalesce("model", named).alias("model"), "description")


_CONNECTED, _EMPTY = "Connected|✅", "^(?!.*(Connected|✅)).*(Empty|⭕)"
_CABLED = ("cable", "cable_description", "usage", "port", "port_description", "other_port")


def _ports(reports: DataFrame) -> DataFrame:
    """job, unit_no, html, and its ports as arrays: c (ord and the fields of connected()) and e (ord and which of EMPTY_PORTS). Each report is read once."""
    r = reports.select("job", _unit_no().alias("unit_no"), "html").filter("unit_no is not null")
    parts = F.slice(F.split("html", r"""(?i)<div[^>]*class\s*=\s*["']section["'][^>]*>"""), 2, 1 << 30)
    title = lambda p: F.regexp_extract(p, r"""(?is)<h2[^>]*class\s*=\s*["']section-title["'][^>]*>(.*?)</h2>""", 1)
    kinds = F.transform(parts, lambda p, s: F.transform(F.array(title(p)), lambda t: F.struct(s.alias("s"), t.rlike(_CONNECTED).alias("connected"), t.rlike(_EMPTY).alias("empty"), p.alias("part")))[0])
    r = r.select("job", "unit_no", "html", F.filter(kinds, lambda k: k["connected"] | k["empty"]).alias("kinds"))

    def body(k: Column) -> Column:
        rows = tx.html_rows(F.regexp_extract(k["part"], r"(?is)(<table.*?</table>)", 1), "td")
        return F.transform(F.slice(rows, 2, 1 << 30), lambda cells, n: F.struct(F.struct(k["s"].alias("s"), (n + 1).alias("row")).alias("ord"), k["connected"].alias("connected"), k["empty"].alias("empty"), cells.alias("cells")))

    r = r.select("job", "unit_no", "html", F.flatten(F.transform("kinds", body)).alias("rows"))
    cell = lambda x, k: F.coalesce(F.get(x["cells"], F.lit(k)), F.lit(""))
    cabled = F.filter("rows", lambda x: x["connected"] & (F.size(x["cells"]) >= 6) & ~((F.lower(cell(x, 2)) == "n/a") & (F.lower(cell(x, 3)) == "n/a")))
    free = F.filter("rows", lambda x: x["empty"] & (F.size(x["cells"]) >= 1))

    def which(x: Column) -> Column:
        name = F.coalesce(F.get(x["cells"], F.lit(1)), F.get(x["cells"], F.lit(0)))
        out = F.when(F.lit(False), F.lit(0))
        for k, (word, _, _) in enumerate(EMPTY_PORTS):
            out = out.when(name.contains(word), k)
        return out

    c = F.transform(cabled, lambda x: F.struct(x["ord"].alias("ord"), *(cell(x, k).alias(n) for k, n in enumerate(_CABLED, 1))))
    e = F.transform(free, lambda x: F.struct(x["ord"].alias("ord"), which(x).alias("which")))
    return r.select("job", "unit_no", "html", c.alias("c"), e.alias("e"))


def _of_empty(which: Column, column: int) -> Column:
    return F.get(F.array(*(F.lit(x[column]) for x in EMPTY_PORTS)), which)


def _each(reports: DataFrame, column: str) -> DataFrame:
    # an inner explode would have Spark infer a filter on the array, which reads every report once more
    return _ports(reports).select("job", "unit_no", F.explode_outer(column).alias("x")).filter("x is not null")


def connected(reports: DataFrame) -> DataFrame:
    """job, unit_no, ord and the fields of the ports in sections titled as connected; rows of fewer than six cells, and those with n/a as description and as usage, give nothing."""
    return _each(reports, "c").select("job", "unit_no", "x.*")


def empty(reports: DataFrame) -> DataFrame:
    """job, unit_no, ord, type and description of the ports in sections titled as empty (not as connected too), by what the class column says: the second cell, or the only one."""
    return _each(reports, "e").select("job", "unit_no", "x.ord", _of_empty(F.col("x.which"), 1).alias("type"), _of_empty(F.col("x.which"), 2).alias("description"))


def rack(reports: DataFrame) -> DataFrame:
    """job, type and vendor of reports named rack_report.html: from lines of the device's text, then from the first table, whose cell of type and vendor (a line break between) counts before the text."""
    r = reports.filter("name = 'rack_report.html'").select("job", _plain(_div(F.col("html"), "device-info")).alias("plain"), tx.html_rows(F.regexp_replace(F.regexp_extract("html", r"(?is)(<table.*?</table>)", 1), r"(?i)<br\s*/?>", "|")).alias("t"))

    def kind(text: Column) -> Column:
        out = F.when(F.lit(False), "")
        for word, name in RACK_TYPES:
            out = out.when(F.lower(text).contains(word), name)
        return out

    heads = F.transform(F.get("t", F.lit(0)), lambda h: F.lower(h))
    at = F.array_position(F.transform(heads, lambda h: h.contains("rack type") | (h == "type")), F.lit(True)) - 1
    cell = F.when(at >= 0, F.get(F.get("t", F.lit(1)), at.cast("int")))
    parts = F.filter(F.transform(F.split(cell, r"[|\-;,/]+"), lambda p: F.trim(p)), lambda p: p != "")
    known = lambda v: F.when(~F.lower(v).isin("not detected", "unknown", ""), v)
    alone = F.nullif(F.array_position(F.transform(heads, lambda h: h.contains("vendor") & ~h.contains("type")), F.lit(True)), F.lit(0).cast("long")) - 1
    vendor = _after(F.col("plain"), "vendor")
    vendor = F.when((F.length(vendor) > 2) & (vendor != "Not Detected"), vendor)
    return r.select("job", F.coalesce(kind(F.get(parts, F.lit(0))), kind(_after(F.col("plain"), "type")), F.lit(NO_TYPE)).alias("type"), F.coalesce(known(F.get(parts, F.lit(1))), vendor, known(F.trim(F.get(F.get("t", F.lit(1)), alone.cast("int")))), F.lit(NO_VENDOR)).alias("vendor"))


def audit(reports: DataFrame, generated: str, descriptions: DataFrame | None = None) -> DataFrame:
    """job and json: the audit document of a job's reports (job, name, html). generated: the date to print. descriptions: ord, vendor, model, description; they
    come before what a switch's report says. Ports are numbered over a job's units by number, connected before empty ones. Fields without a value are left out. A job has a row if it has a report of a unit or of its rack."""
    u = _told(_ports(reports), ["c", "e"])
    if descriptions is not None:
        facts = u.filter("device_type = 'switch'").select("vendor", "model").distinct()
        told = hierarchy.describe(facts, descriptions).select(F.col("vendor").alias("_v"), F.col("model").alias("_m"), F.col("description").alias("_d"))
        own = (F.col("device_type") == "switch") & F.col("vendor").eqNullSafe(F.col("_v")) & F.col("model").eqNullSafe(F.col("_m"))
        u = u.join(told, own, "left").withColumn("description", F.coalesce(tx.one_line_or_null(F.col("_d")), "description")).drop("_v", "_m", "_d")
    # one exchange on the job for units, numbers and documents
    told = F.struct("device_type", "vendor", "model", "description")
    u = u.repartition("job").groupBy("job", "unit_no").agg(F.array_sort(F.collect_list(told)).alias("told"), F.array_sort(F.flatten(F.collect_list("c"))).alias("c"), F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    before = F.sum(F.size("c") + F.size("e")).over(Window.partitionBy("job").orderBy("unit_no").rowsBetween(Window.unboundedPreceding, -1))
    u = u.withColumn("before", F.coalesce(before, F.lit(0).cast("long")))
    port_id = lambda n: F.concat(F.lit("port_"), (F.col("before") + 1 + n).cast("string")).alias("port_id")
    c = F.transform("c", lambda x, i: F.struct(port_id(i), *(x[f].alias(f) for f in ("port", "port_description", "other_port", "cable", "cable_description", "usage"))))
    e = F.transform("e", lambda x, i: F.struct(port_id(F.size("c") + i), _of_empty(x["which"], 1).alias("type"), _of_empty(x["which"], 2).alias("description")))
    u = u.select("job", "unit_no", "told", c.alias("connected_ports"), e.alias("empty_ports"))
    unit = F.transform("told", lambda t: F.struct(F.concat(F.lit("unit"), F.col("unit_no").cast("string")).alias("unit_id"), *(t[f].alias(f) for f in ("device_type", "vendor", "model", "description")), "connected_ports", "empty_ports"))
    every = u.groupBy("job").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit_no", unit.alias("units")))), lambda x: x["units"])).alias("units"))
    every = every.withColumn("devices", F.array_join(F.transform("units", lambda x: F.concat_ws(" ", x["vendor"], x["device_type"])), ", "))
    racks = rack(reports).groupBy("job").agg(F.min(F.struct("type", "vendor")).alias("rack"))
    both = every.join(racks, "job", "full")
    summary = F.concat(F.lit("Rack analysis detected a populated network rack containing "), F.coalesce(F.nullif("devices", F.lit("")), F.lit("network devices")), F.lit("."))
    units_ = F.coalesce("units", F.from_json(F.lit("[]"), every.schema["units"].dataType.simpleString()))
    doc = F.struct(F.coalesce("rack.type", F.lit(NO_TYPE)).alias("type"), F.coalesce("rack.vendor", F.lit(NO_VENDOR)).alias("vendor"), F.lit(generated).alias("report_generated"), summary.alias("summary"), units_.alias("units"))
    return both.select("job", F.to_json(doc).alias("json"))
