"""Registered queries: the audit operators on the driver's tables, over whole tables.

No images exist here, so inputs are derived from the tables with whole-number arithmetic that SQL can repeat (oracles.py).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import similarity as sim
from ..functions import text as tx
from ..operators import blocks, cluster, documents, hierarchy, jobs, match, spatial

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _int(c: Column) -> Column:
    return c.cast("int")


def _ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x, y = _int(F.col("event_id") * 37 % 960), _int(F.col("event_id") * 53 % 560)
    return e.select(F.col("user_id").alias("image"), F.col("event_id").alias("port_id"), F.when(F.col("event_id") % 3 == 0, "connected").otherwise("empty").alias("state"), g.box(x, y, x + 12, y + 10).alias("box"))


def _devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")  # every order is a device
    x, y = _int(F.col("o_orderkey") * 17 % 500), _int(F.col("o_orderkey") * 29 % 300)
    kind = F.when(F.col("o_orderkey") % 40 == 0, "switch").otherwise("patch_panel")
    return o.select(F.expr("o_custkey div 10").alias("image"), F.col("o_orderkey").alias("dev_id"), kind.alias("kind"), F.col("o_orderkey").alias("ordinal"), g.box(x, y, x + 400, y + 200).alias("box"))


def _detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as detections of image user_id."""
    e = table(spark, sf_dir, "events")
    x, y = _int(F.col("event_id") * 37 % 960), _int(F.col("event_id") * 53 % 560)
    return e.select(F.col("user_id").alias("image"), F.col("event_id").alias("det_id"), F.col("event_type").alias("class"), (F.col("event_id") * 31 % 1000 / 1000.0).alias("confidence"), g.box(x, y, x + 200, y + 90).alias("box"))


@query
def port_parent_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.assign_parents(_ports(spark, sf_dir), _devices(spark, sf_dir))
    return out.select("image", "port_id", "state", "parent_type", F.col("parent_id").cast("string").alias("parent_id"), "validation")


@query
def port_counts_per_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spatial.assign_parents(_ports(spark, sf_dir), _devices(spark, sf_dir)).filter("parent_id is not null")
    return out.groupBy("image", "parent_id").agg(F.count_if(F.col("state") == "connected").alias("n_connected"), F.count_if(F.col("state") == "empty").alias("n_empty"))


@query
def nested_device_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested document, read again: devices and ports in it."""
    d = _devices(spark, sf_dir)
    nested = documents.nested_devices(spatial.assign_parents(_ports(spark, sf_dir), d), d)
    dev = F.explode("devices").alias("d")
    return nested.select("image", dev).select("image", F.col("d.dev_id").alias("dev_id"), F.greatest(F.size("d.ports.connected"), F.lit(0)).cast("long").alias("n_connected"), F.greatest(F.size("d.ports.empty"), F.lit(0)).cast("long").alias("n_empty"))


@query
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    x, y = _int(F.col("o_orderkey") * 17 % 700), _int(F.col("o_orderkey") * 29 % 400)
    units = o.select(F.expr("o_custkey div 10").alias("image"), F.col("o_orderkey").alias("unit_no"), g.box(x, y, x + 220, y + 80).alias("box"))
    return spatial.label_units(units, _detections(spark, sf_dir)).select("image", "unit_no", "label", F.round("confidence", 6).alias("confidence"))


@query
def unit_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.unit_ordinals(_detections(spark, sf_dir)).select("image", "det_id", "unit_no")


@query
def best_rack(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    w = _int(F.col("o_orderkey") * 13 % 400) + 20
    racks = o.select((F.col("o_custkey") % 150).alias("image"), F.col("o_orderkey").alias("det_id"), (F.col("o_orderkey") * 7 % 1000 / 1000.0).alias("confidence"), g.box(F.lit(0), F.lit(0), w, F.lit(200)).alias("box"))
    return spatial.best_rack(racks)


@query
def class_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [("view", "rack", 0.3), ("click", "switch", 0.44), ("purchase", "patch_panel", 0.44), ("signup", "cable", 0.18)]
    aliases = spark.createDataFrame([("p", a, b) for a, b, _ in names], "pipeline string, class_raw string, class string")
    limits = spark.createDataFrame([("p", b, c) for _, b, c in names], "pipeline string, class string, min_conf double")
    d = _detections(spark, sf_dir).withColumnRenamed("class", "class_raw")
    return spatial.classify(d, aliases, limits, "p", keep_unknown=True).groupBy("class").agg(F.count("*").alias("n"))


@query
def box_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).withColumn("c", g.clamp(F.col("box"), F.lit(960), F.lit(560), 10))
    return d.filter("c is not null").select("det_id", F.col("c.x1").alias("x1"), F.col("c.y1").alias("y1"), F.col("c.x2").alias("x2"), F.col("c.y2").alias("y2"))


@query
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at"))


@query
def model_match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector asks all other vectors of its label."""
    e = table(spark, sf_dir, "embeddings")
    counts = F.array(*map(F.lit, g.PORT_COUNTS))
    base = e.select("vec_id", "embedding", F.concat(F.lit("Vendor "), F.col("label").cast("string")).alias("vendor"), F.get(counts, _int(F.col("vec_id") % 7)).alias("ports"), _int(F.col("vec_id") % 3 + 1).alias("rows"), F.get(F.array(*map(F.lit, ("LEFT", "RIGHT", "CENTER", "MIXED", "NONE"))), _int(F.col("vec_id") % 5)).alias("arrangement"))
    name = F.format_string("ref%06d", "vec_id")
    q = base.select(F.col("vec_id").alias("image"), name.alias("own"), "embedding", "vendor", _int(F.col("vec_id") % 11 * 4).alias("num_ports"), F.col("rows").alias("num_rows"), "arrangement")
    r = base.select("vendor", name.alias("filename"), "embedding", F.col("rows").alias("num_rows"), "arrangement", "ports")
    return match.match_models(q, r, "own")


@query
def two_stage_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_feat"), "label")
    r = e.select(F.col("vec_id").alias("r_id"), F.col("embedding").alias("r_feat"), "label")
    return match.two_stage(q, r, "label", 8, others=True).select("q_id", "r_id", F.round("score", 6).alias("score"))


@query
def phash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a label whose hashes differ in at most eight bits, one side by the nearer of two rotations."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", (F.col("vec_id") * 2654435761 % 4294967296).alias("h"))
    turned = F.shiftleft("h", 8).bitwiseAND(F.lit(4294967295)).bitwiseOR(F.shiftrightunsigned("h", 24))
    out = match.near_hashes(e.select("label", F.col("vec_id").alias("a"), F.col("h").alias("hash")), e.select("label", F.col("vec_id").alias("b"), F.array("h", turned).alias("variants")), "label", 8, bits=32)
    return out.filter("a < b")


@query
def input_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files for each order, in folders that differ in rank."""
    o = table(spark, sf_dir, "orders")
    places = ("input/a.PNG", "images/b.jpg", "input/images/c.Tiff", "output/rack/d.jpeg", "output/e.bmp", "other/deep/f.webp", "input/notes.txt")
    pick = lambda n: F.get(F.array(*map(F.lit, places)), _int(n % len(places)))
    path = lambda p: F.concat(F.lit("/jobs/job_"), F.col("o_orderkey").cast("string"), F.lit("/"), p)
    files = o.select(F.explode(F.array(path(pick(F.col("o_orderkey"))), path(pick(F.expr("o_orderkey div 7"))))).alias("path")).distinct()
    return jobs.input_images(jobs.output_inventory(files))


@query
def keyed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.keyed_distinct(table(spark, sf_dir, "part"), ["p_brand", "p_type", "p_size"], "p_partkey").select("p_partkey", "p_brand", "p_type", "p_size")


@query
def content_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.content_distinct(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "text", "doc_id").select("doc_id", "lang")


@query
def vendor_exact_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents vote for function words as vendors, without the fuzzy part of the score."""
    vendors = [(k, v, v) for k, v in enumerate(("the of", "and", "les", "der", "que", "with", "inor"))]
    aliases = spark.createDataFrame(vendors, "ord int, vendor string, alias string")
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image"), F.explode(F.split("text", "\n")).alias("part"))
    return match.vendor_vote(lines, aliases, 0.2, fuzzy=False).select("image", "vendor", F.round("total", 3).alias("total"), "votes")


@query
def vendor_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the fuzzy part, over parts between line ends, commas and semicolons, for brands spelled in several ways."""
    part = table(spark, sf_dir, "part")
    aliases = part.select("p_brand").distinct().select(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("ord"), F.col("p_brand").alias("vendor"), F.explode(F.array(F.col("p_brand"), F.concat(F.lit("b "), F.regexp_extract("p_brand", "([0-9]+)", 1)))).alias("alias"))
    spelled = F.when(F.col("p_partkey") % 4 == 0, F.replace("p_brand", F.lit("a"), F.lit("@"))).when(F.col("p_partkey") % 4 == 1, F.concat("p_brand", F.lit(" (rev 2)"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("made by "), F.upper("p_brand"))).otherwise(F.col("p_name"))
    parts = part.select(F.expr("p_partkey div 10").alias("image"), F.explode(F.filter(F.transform(F.split(F.concat(spelled, F.lit(", "), "p_type"), r"[\n,;]+"), lambda p: F.trim(p)), lambda p: p != "")).alias("part"))
    return match.vendor_vote(parts, aliases).select("image", "vendor", "total", "votes")


@query
def vendor_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("w", "with"), ("w", "and"), ("d", "der"), ("t", "the of")], "vendor string, alias string")
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("image"), F.explode(F.split("text", "\n")).alias("part"))
    return match.vendor_hits(lines, aliases)


@query
def port_count_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    model = F.concat(F.when(F.col("p_partkey") % 3 == 0, "WS-C").when(F.col("p_partkey") % 3 == 1, "GS").otherwise("DGS-"), F.col("p_partkey").cast("string"), F.lit("-"), F.col("p_size").cast("string"), F.lit("T"))
    return p.select("p_partkey", model.alias("model"), F.coalesce(tx.port_count(model), F.lit(-1)).alias("ports"))


@query
def model_regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best model-like token of each part's name and brand."""
    text = F.concat_ws(" ", F.col("p_name"), F.col("p_brand"), F.concat(F.lit("WS-C"), F.col("p_partkey").cast("string")))
    m = table(spark, sf_dir, "part").select("p_partkey", F.explode(tx.models(text, [(r"WS-C[0-9]+", 100), (r"[A-Z]+#[0-9]+", 10)])).alias("m"))
    return m.groupBy("p_partkey").agg(F.max_by("m.value", F.struct("m.score", "m.value")).alias("model"), F.max("m.score").alias("score"))


@query
def lookup_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = spark.createDataFrame([(0, "promo_plated", "c1"), (1, "small", "c2"), (2, "standard_x", "c3"), (3, "economy", "c4")], "ord int, port string, cable string")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("port_class"))
    return match.expected_cable(p, dim).select("p_partkey", "port_class", F.coalesce("rule", F.lit(-1)).alias("rule"), "cable")


@query
def cable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pre = F.get(F.array(*map(F.lit, ("rj45_", "hdmia-", "LC ", "sc_", "bnc ", "usb_a ", "ps2", "nema_5", "x_rs232_", "sfp ", "xfp-", "other_"))), _int(F.col("p_partkey") % 12))
    name = F.concat(pre, F.lower("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.cable_label(name).alias("label"))


@query
def description_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "nation").select(F.upper("n_name").alias("n_name"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("description"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "nowhere").otherwise(F.lower("n_name")).alias("name"))
    return match.lookup(c, dim, [("name", "n_name")], ["description"], "N/A").select("c_custkey", "name", "description")


@query
def missing_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with brands that no large part has."""
    p = table(spark, sf_dir, "part").withColumn("name", F.concat("p_name", F.lit("_"), F.upper("p_brand")))
    return match.missing_keys(p, p.filter("p_size > 25"), ("name", "name"))


@query
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(tx.html_text(F.col("html"))).alias("text_md5"))


@query
def html_meaningful(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.html_meaningful(F.col("html")).alias("meaningful"))


@query
def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.get(F.array(*map(F.lit, ("rack report", "Switch_x", "patch panel", "cables", "ports-results", "Connected port", "panel", "PatchPanel", "empty-port", "connected", "empty"))), _int(F.col("page_id") % 11)), F.lit("_"), F.col("page_id").cast("string"))
    p = table(spark, sf_dir, "pages").select("page_id", name.alias("name"))
    w = Window.partitionBy(F.col("page_id") % 10).orderBy(tx.category_rank(F.col("name")), F.lower("name"))
    return p.select("page_id", tx.category(F.col("name")).alias("category"), F.row_number().over(w).alias("position"))


@query
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles as section headers, turns as positions."""
    c = table(spark, sf_dir, "conversations")
    heads = c.withColumn("length", F.max("turn").over(Window.partitionBy("conv_id")) + 1).select("conv_id", F.col("turn").alias("start"), F.col("role").alias("section"), "length")
    return documents.section_spans(heads, "conv_id")


@query
def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.col("role"), F.lit(":"), F.length("text").cast("string")).alias("line"))
    return documents.line_pairs(c, "conv_id", "turn", first="user:", second="assistant:")


@query
def line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents.long_lines(documents.lines(table(spark, sf_dir, "documents"), "doc_id"))
    return out.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query
def leaf_label_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("leaf"))
    return documents.leaf_labels(e, [("one", "1"), ("seven", "7"), ("long", "^[0-9]{2,}$")], "event_id").select("event_id", F.array_join("labels", ",").alias("labels"))


@query
def colour_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.get(F.array(*map(F.lit, ("Black", "Whi", "Gr", "Y", "ow", "Reddish", "Teal"))), _int(F.col("p_partkey") % 7))
    text = F.concat(F.lit("cable RJ45_"), token, F.lit(" and RJ-45-"), F.lit("blu, rj45_red"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.colours(text), ",").alias("colours"))


@query
def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir).withColumn("band", g.confidence_band(F.col("confidence")))
    return d.groupBy("class", "band").agg(F.count("*").alias("n"))


@query
def layout_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.layout(_ports(spark, sf_dir).withColumn("width", F.lit(972)))


@query
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("multi", "image/jpeg", "jpg"), ("multi", "image/png", "png"), ("single", "image/jpeg", "jpg"), ("video", "video/mp4", "mp4")], "upload_type string, mime string, ext string")
    pick = lambda names, n: F.get(F.array(*map(F.lit, names)), _int(n))
    l = table(spark, sf_dir, "orders")
    kind = pick(("multi", "single", "video"), F.col("o_custkey") % 3)
    f = l.select(F.col("o_custkey").alias("upload_id"), kind.alias("upload_type"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string"), F.when(kind == "video", ".mp4").when(F.col("o_orderkey") % 17 == 0, ".gif").otherwise(".JPG")).alias("file_name"), F.when(kind == "video", "video/mp4").otherwise("image/jpeg").alias("mime"))
    return jobs.validate_uploads(f, allowed)


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.format_string("job_%d", "o_orderkey").alias("job_id"), F.col("o_custkey").cast("string").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("waiting").alias("status"), F.col("o_orderdate").alias("created_at"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "orders")
    folder = F.get(F.array(*map(F.lit, ("rack", "switch", "cable", "units/unit1/switch", "other"))), _int(F.col("o_orderkey") % 5))
    image = l.select(F.concat(F.lit("/out/job_"), F.col("o_orderkey").cast("string"), F.lit("/"), folder, F.lit("/img.jpg")).alias("path"))
    # a merged report below the output or beside it, or another PDF, which doesn't count
    place = F.get(F.array(*map(F.lit, ("/output/Results/Merged_Result.pdf", "/report.pdf", "/Results/other/Merged_Result.pdf", "/Results/Merged_Result.pdf"))), _int(F.col("o_orderkey") % 4))
    pdf = l.select(F.concat(F.lit("/out/job_"), F.col("o_orderkey").cast("string"), place).alias("path"))
    return jobs.output_inventory(image.unionByName(pdf))


@query
def job_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.job_history(_jobs(spark, sf_dir), _files(spark, sf_dir)).select("job_id", "user_id", "image")


@query
def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.createDataFrame([("switch", "switch"), ("switch", "switches")], "folder string, alias string")
    return jobs.gallery(_files(spark, sf_dir), "switch", aliases)


@query
def job_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "lineitem").select(F.format_string("job_%d", "l_orderkey").alias("job_id"), F.col("l_linenumber").alias("line_no"), F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("message"))
    out = jobs.job_with_logs(_jobs(spark, sf_dir), logs)
    return out.select("job_id", F.size("messages").cast("long").alias("n_messages"), F.array_join("messages", "").alias("all_messages"))


@query
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = _jobs(spark, sf_dir).filter("status = 'done'").select("job_id", "user_id", "created_at")
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("user_id"), F.format_string("job_%d", "o_orderkey").alias("job_id"), F.col("o_orderdate").alias("mtime"))
    return jobs.latest_job(j, f)


@query
def current_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all customers; a third names a job that may not exist."""
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("user_id"), F.when(F.col("c_custkey") % 3 == 0, F.format_string("job_%d", F.col("c_custkey") * 4)).alias("job_id"))
    j = _jobs(spark, sf_dir).filter("status = 'done'").select("job_id", "user_id", "created_at")
    f = table(spark, sf_dir, "orders").select(F.format_string("job_%d", "o_orderkey").alias("name"), F.col("o_orderdate").alias("mtime"), F.lit(True).alias("has_output"))
    return jobs.current_job(s, j, f)


def _port_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HTML report for each order with a row for each line: seven columns, or five if the order is urgent."""
    # numbers are grouped, the rows' texts made of them afterwards; lines and orders meet in one exchange, dealt before anything is sorted
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").alias("line"), F.lit(None).cast("boolean").alias("urgent"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.lit(None).cast(lines.schema["line"].dataType).alias("line"), F.coalesce(F.col("o_orderpriority") == "1-URGENT", F.lit(False)).alias("urgent"))
    both = lines.unionByName(orders).filter("doc is not null").repartition("doc").groupBy("doc").agg(F.collect_list("line").alias("lines"), F.collect_list("urgent").alias("urgent"))
    docs = both.filter("size(lines) > 0").select("doc", "lines", F.explode("urgent").alias("urgent"))
    power = lambda x: x["l_returnflag"] == "R"
    columns = {
        "no": lambda x: F.when(power(x), "QSFP28").otherwise(x["l_returnflag"]), "cable": lambda x: F.concat(F.lit("c"), x["l_returnflag"]), "cable_description": lambda x: F.when(power(x), "N/A").otherwise(x["l_returnflag"]),
        "usage": lambda x: F.when(power(x) | (x["l_linestatus"] == "O"), "n/a").otherwise("net"), "port": lambda x: x["l_partkey"], "port_description": lambda x: x["l_suppkey"], "other_port": lambda x: x["l_linenumber"],
    }
    at = lambda x: F.struct(x["l_linenumber"], x["l_partkey"], x["l_suppkey"])
    few = dict(list(columns.items())[:5])
    return docs.select("doc", F.when(F.col("urgent"), documents.report_of(F.col("lines"), few, at, "ports")).otherwise(documents.report_of(F.col("lines"), columns, at, "ports")).alias("html"))


@query
def connected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.connected_rows(_port_reports(spark, sf_dir)).withColumn("ord", F.col("ord").cast("long"))


@query
def empty_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.empty_rows(_port_reports(spark, sf_dir), compat=True).withColumn("ord", F.col("ord").cast("long"))


@query
def job_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.status_counts(_jobs(spark, sf_dir))


@query
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", _int(F.col("p_partkey") * 7 % 900 + 50).alias("w"), _int(F.col("p_partkey") * 11 % 500 + 50).alias("h"))
    t = p.select("p_partkey", F.explode(g.tiles(F.col("w"), F.col("h"), (200, 200), 0.2)).alias("t"))
    return t.groupBy("p_partkey").agg(F.count("*").alias("n_tiles"), F.sum("t.x1").alias("sum_x1"), F.sum("t.y1").alias("sum_y1"), F.sum("t.x2").alias("sum_x2"), F.sum("t.y2").alias("sum_y2"))


@query
def nearest_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(g.nearest_ports(F.col("p_size")), lambda x: x.cast("string")), ",").alias("ports"))


@query
def representative_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("crop_id"), (F.col("event_id") * 97 % 100000).alias("area"), (F.col("event_id") * 89 % 1500).cast("double").alias("sharpness"))
    return match.representative(d, ["user_id"])


@query
def ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.ordinal(F.col("p_partkey")).alias("ordinal"), tx.alnum(F.col("p_name")).alias("alnum"), tx.spaced(F.col("p_brand")).alias("spaced"), tx.ocr(F.col("p_brand")).alias("ocr"), tx.compact(F.col("p_type")).alias("compact"), tx.model_key(F.col("p_brand")).alias("model_key"))


@query
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    out = documents.report_table(n, ["n_name", "n_nationkey"], "n_regionkey", "n_nationkey", "Nations")
    return out.select("n_regionkey", F.md5("html").alias("html_md5"))


@query
def soft_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.soft_nms(_boxes(spark, sf_dir))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _detections(spark, sf_dir)
    return d.select("image", "class", "det_id", F.col("confidence").alias("score"), "box.x1", "box.y1", "box.x2", "box.y2")


@query
def box_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.box_fusion(_boxes(spark, sf_dir))


@query
def overlap_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.suppress_overlaps(_boxes(spark, sf_dir))


@query
def row_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.row_cluster(_ports(spark, sf_dir).select("image", F.col("port_id").alias("point_id"), F.col("box.y1").cast("double").alias("y")))


@query
def leader_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("class"), F.col("vec_id").alias("crop_id"), (F.col("vec_id") * 2654435761 % 4294967296).alias("phash"))
    return cluster.leader_cluster(e, ["class"], 0.6)


@query
def composite_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("class"), "vec_id", "embedding").filter("class is not null")
    alone = e.select("class", F.col("vec_id").alias("a"), F.col("vec_id").alias("b"), sim.dot(F.col("embedding"), F.col("embedding")).alias("score"))
    pairs = blocks.alike(e, "class", "vec_id", "embedding", 0.8).unionByName(alone)
    return cluster.composite_cluster(pairs)


@query
def penalised_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("job"), F.format_string("img%07d", "p_partkey").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ord"), "p_partkey")
    h = F.col("p_partkey") * 31 + F.col("ord") * 17
    return cluster.penalised_match(p.select("job", "image", "ord", F.format_string("v%d", h % 6).alias("vendor"), F.format_string("ref%d", h % 40).alias("ref"), (h % 100 / 100.0).alias("edge"), (h % 37 / 37.0).alias("feature")))


@query
def fuzzy_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    dim = part.select(F.concat(F.upper("p_name"), F.lit("/x"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("port")).alias("model"), F.col("p_type").alias("description")).groupBy("model").agg(F.min("description").alias("description"))
    return match.describe_models(part.select("p_partkey", F.concat("p_name", F.lit("s "), F.col("p_size").cast("string")).alias("model")), dim)


@query
def close_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return match.close_match(part.select("p_partkey", F.concat(F.substring("p_name", 2, 100), F.lit("_"), "p_type").alias("port")), part.select(F.concat("p_name", F.lit(" "), "p_type").alias("name")), "port", "name")


@query
def panel_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.get(F.array(*map(F.lit, ("RJ-45 jack", "LC UPC", "sc  upc", "MPO cassette", "keystone row", "patch panel", "row of"))), _int(F.col("p_partkey") % 7))
    name = F.concat_ws(" ", text, F.col("p_size").cast("string"), F.lit("port"))
    return table(spark, sf_dir, "part").select("p_partkey", hierarchy.panel_model(name).alias("model"))


@query
def text_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    vendor = F.when(F.col("p_partkey") % 3 == 0, "Cisco unit").when(F.col("p_partkey") % 3 == 1, "by ZTE").otherwise("?")
    cells = F.array(F.lit(" "), F.col("p_name"), vendor, F.concat(F.lit("a long description of "), F.col("p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", hierarchy.guess(cells).alias("g")).select("p_partkey", "g.*")


@query
def description_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    dim = table(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("vendor"), F.col("p_name").alias("model"), F.concat("p_type", F.lit(" "), F.col("p_size").cast("string")).alias("description"))
    facts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("vendor"), F.when(F.col("p_partkey") % 5 == 0, F.substring("p_name", 1, 4)).otherwise(F.col("p_name")).alias("model"))
    return hierarchy.describe(facts, dim).select("p_partkey", "description")


@query
def vendor_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("known"))
    facts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lower("n_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("x-"), F.col("n_name"), F.lit("."))).otherwise(F.substring("n_name", 1, 4)).alias("vendor"))
    return hierarchy.vendor_keys(facts, known).select("c_custkey", "known", F.coalesce("rule", F.lit(-1)).alias("rule"))


@query
def kept_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("n_switch"), (F.col("o_orderkey") % 2).alias("n_panel"), (F.col("o_orderkey") % 5).alias("n_ports"))
    return hierarchy.kept_units(u, "one_kind")


def _resolution(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ports and nodes: devices of an image as nodes, its ports with and without a parent id."""
    d = _devices(spark, sf_dir)
    nodes = d.select(F.col("image").alias("doc"), F.col("dev_id").cast("string").alias("node_id"), F.col("ordinal").alias("preorder"), F.when(F.col("dev_id") % 60 == 0, F.col("kind")).otherwise("thing").alias("type"), F.lit(None).cast("string").alias("segmented"), "box", F.lit(False).alias("has_ports"))
    p = _ports(spark, sf_dir).select(F.col("image").alias("doc"), "port_id", F.when(F.col("port_id") % 2 == 0, (F.col("port_id") % 750 * 20).cast("string")).alias("parent_id"), "box")
    return p, nodes


@query
def parent_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, nodes = _resolution(spark, sf_dir)
    holds = nodes.limit(0).select("doc", F.col("node_id").alias("dev_id"), F.lit(0).cast("long").alias("port_id"))
    return hierarchy.parents(p, nodes, holds).select("doc", "port_id", "resolved", "rule")


@query
def parent_resolution_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with port lists: every device lists the connected ports of its image."""
    p, nodes = _resolution(spark, sf_dir)
    connected = _ports(spark, sf_dir).filter("state = 'connected'").select(F.col("image").alias("doc"), "port_id")
    # only devices' lists are ever asked, so the others aren't made into rows
    lists = nodes.filter(hierarchy.is_device(F.col("type"), F.col("node_id"), F.col("has_ports")))
    holds = connected.join(lists.select("doc", F.col("node_id").alias("dev_id")), "doc")
    return hierarchy.parents(p, nodes, holds).select("doc", "port_id", "resolved", "rule")
