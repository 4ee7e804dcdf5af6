"""Retrieval, lookups by priority, dedup and votes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from . import blocks
from .fuzzy import ratio_join

#: A dimension of at most this many rows may be broadcast; a larger one is shuffled on the key.
DIMENSION_ROWS = 1_000_000
#: Vendor aliases that may go to all tasks.
VOCABULARY = 100_000


def dimension(d: DataFrame, limit: int = DIMENSION_ROWS) -> DataFrame:
    """Marked for broadcast after its size has been checked."""
    return F.broadcast(d) if d.limit(limit + 1).count() <= limit else d


def top_k(rows: DataFrame, key: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= k)


def cascade(rows: DataFrame, key: Sequence[str], flags: Sequence[Column]) -> DataFrame:
    """Filters in turn, each only for keys of which something would be left. One exchange on the key."""
    w = Window.partitionBy(*key)
    for k, flag in enumerate(flags):
        f, any_ = f"_f{k}", f"_a{k}"
        rows = rows.withColumn(f, F.coalesce(flag, F.lit(False))).withColumn(any_, F.max(f).over(w)).filter(F.col(f) | ~F.col(any_)).drop(f, any_)
    return rows


def match_models(queries: DataFrame, references: DataFrame, own: str | None = None) -> DataFrame:
    """The most similar reference of each query after the optional filters ports, rows, arrangement.

    queries: image, embedding, vendor?, num_ports, num_rows, arrangement; references: vendor, filename, embedding, num_rows, arrangement,
    ports. A known vendor restricts the references (unknown vendors match nothing), a null vendor doesn't. Detected counts of 0 or null skip a filter.
    own: a column of the queries with a filename that isn't compared with the query.

    The filters see only which kinds of references (ports, rows, arrangement) a vendor has and how many, so kinds of queries are filtered against kinds of
    references, and rows meet in blocks of the kinds that are left.
    """
    name = F.col(own) if own else F.lit(None).cast("string")
    q = queries.withColumns({"_own": name, "_k": F.when(F.col("vendor").isNull(), "*").otherwise(F.concat(F.lit("="), tx.alnum(F.col("vendor"))))})
    q = q.select("image", "embedding", "_k", "_own", *(F.col(c).alias(f"q_{c}") for c in ("num_ports", "num_rows", "arrangement")))
    r = references.withColumn("_k", F.explode(F.array(F.lit("*"), F.concat(F.lit("="), tx.alnum(F.col("vendor")))))).withColumn("_kind", F.to_json(F.struct("_k", "ports", "num_rows", "arrangement")))
    kinds = r.filter("_k is not null").groupBy("_k", "_kind", "ports", "num_rows", "arrangement").agg(F.count("*").alias("_n"))
    # the kinds of the references that a query leaves out
    skipped = r.groupBy("_k", F.col("filename").alias("_own")).agg(F.array_sort(F.collect_list("_kind")).alias("_out"))
    q = (q.join(skipped, ["_k", "_own"], "left") if own else q.withColumn("_out", F.lit(None).cast("array<string>"))).withColumn("_asks", F.to_json(F.struct("_k", "q_num_ports", "q_num_rows", "q_arrangement", "_out")))
    asked = q.groupBy("_asks").agg(*(F.first(c).alias(c) for c in ("_k", "q_num_ports", "q_num_rows", "q_arrangement", "_out"))).join(kinds, "_k")
    asked = asked.filter(F.col("_n") > F.size(F.filter(F.coalesce("_out", F.array().cast("array<string>")), lambda x: x == F.col("_kind"))))
    left = cascade(asked, ["_asks"], [
        (F.coalesce("q_num_ports", F.lit(0)) == 0) | F.array_contains(_nearest(F.col("q_num_ports")), F.col("ports")),
        (F.coalesce("q_num_rows", F.lit(0)) == 0) | (F.col("q_num_rows") == F.col("num_rows")),
        F.col("q_arrangement").isNull() | (F.col("q_arrangement") == F.col("arrangement")),
    ])
    x = q.join(left.select("_asks", "_kind"), "_asks").select("_kind", "image", F.col("embedding").alias("q_feat"), "_own")
    y = r.select("_kind", "vendor", "filename", F.col("embedding").alias("r_feat"))

    def nearest(a: pa.Table, b: pa.Table) -> list:
        b = blocks.in_order(b, "filename")
        out = blocks.equal_ids(a["_own"], b["filename"]) if own else None
        i, j, score, null = blocks.stacked(blocks.best(blocks.Vectors(a["q_feat"]), blocks.Vectors(b["r_feat"]), 1, True, out), 4)
        return [a["image"].take(pa.array(i)), b["vendor"].take(pa.array(j)), b["filename"].take(pa.array(j)), pa.array(score, pa.float64(), mask=null.astype(bool))]

    schema = f"image {queries.schema['image'].dataType.simpleString()}, vendor {references.schema['vendor'].dataType.simpleString()}, filename {references.schema['filename'].dataType.simpleString()}, similarity double"
    pairs = blocks.block_join(x, y, "_kind", "image", "filename", nearest, schema)
    return top_k(pairs, ["image"], [F.desc("similarity"), F.asc("filename")], 1).select("image", "vendor", "filename", F.round("similarity", 6).alias("similarity"))


def _nearest(n: Column) -> Column:
    from ..functions.geometry import nearest_ports

    return nearest_ports(n)


def two_stage(queries: DataFrame, references: DataFrame, key: str, head: int = 8, k: int = 5, others: bool = False) -> DataFrame:
    """Within the key, the k best by the product of the first `head` entries are scored again by the whole product: key, q_id, r_id, cheap and score of the best of them, of
    equals the first by r_id. Sides: key, q_id, q_feat and key, r_id, r_feat. others: a query isn't compared with its own id."""

    def short(a: pa.Table, b: pa.Table) -> list:
        b = blocks.in_order(b, "r_id")
        out = blocks.equal_ids(a["q_id"], b["r_id"]) if others else None
        i, j, cheap, no_cheap = blocks.stacked(blocks.best(blocks.Vectors(a["q_feat"], head), blocks.Vectors(b["r_feat"], head), k, left_out=out), 4)
        score, no_score = blocks.products(blocks.Vectors(a["q_feat"]), blocks.Vectors(b["r_feat"]), i, j)
        return [a[key].take(pa.array(i)), a["q_id"].take(pa.array(i)), b["r_id"].take(pa.array(j)), pa.array(cheap, pa.float64(), mask=no_cheap.astype(bool)), pa.array(score, pa.float64(), mask=no_score)]

    kind = lambda d, c: d.schema[c].dataType.simpleString()
    schema = f"`{key}` {kind(queries, key)}, q_id {kind(queries, 'q_id')}, r_id {kind(references, 'r_id')}, cheap double, score double"
    pairs = blocks.block_join(queries.select(key, "q_id", "q_feat"), references.select(key, "r_id", "r_feat"), key, "q_id", "r_id", short, schema)
    best = top_k(pairs, ["q_id"], [F.desc("cheap"), F.asc("r_id")], k).drop("rank")
    return top_k(best, ["q_id"], [F.desc("score"), F.asc("r_id")], 1).drop("rank")


def lookup(facts: DataFrame, dim: DataFrame, on: Sequence[tuple[str, str]], take: Sequence[str], default: str | None = None, order: str | None = None) -> DataFrame:
    """Left join on normalised (spaces, trimmed, lower-cased) keys; of a repeated key the last row by `order` counts."""
    d = dim.select(*(tx.spaced(F.col(r)).alias(f"_k{i}") for i, (_, r) in enumerate(on)), *take, *([order] if order else []))
    keys = [f"_k{i}" for i in range(len(on))]
    by = F.col(order) if order else F.struct(*take)
    d = d.groupBy(*keys).agg(*(F.max_by(c, by).alias(c) for c in take))
    f = facts.withColumns({f"_k{i}": tx.spaced(F.col(c)) for i, (c, _) in enumerate(on)})
    out = f.join(dimension(d), keys, "left").drop(*keys)
    return out if default is None else out.withColumns({c: F.coalesce(c, F.lit(default)) for c in take})


def first_match(facts: DataFrame, dim: DataFrame, key: str, rules: Sequence[Column], order: str) -> DataFrame:
    """Facts with the dimension row of the first rule that any row satisfies, the first row by `order` within it.

    Rules see both sides' columns (names must differ); all pairs of a distinct fact key with the dimension are
    looked at in one pass, and of the two what is small (the sizes are checked) goes to all tasks.
    """
    prio = F.coalesce(*(F.when(F.coalesce(r, F.lit(False)), F.lit(i)) for i, r in enumerate(rules)))
    distinct = facts.select(key).distinct()
    few = dim.limit(DIMENSION_ROWS + 1).count() <= DIMENSION_ROWS
    hits = (distinct.join(F.broadcast(dim), F.lit(True)) if few else dim.join(dimension(distinct), F.lit(True))).withColumn("rule", prio).filter("rule is not null")
    best = hits.groupBy(key).agg(F.min_by(F.struct("rule", *dim.columns), F.struct("rule", order)).alias("_hit"))
    return facts.join(best, facts[key].eqNullSafe(best[key]), "left").drop(best[key]).select(*facts.columns, "_hit.rule", *(f"_hit.{c}" for c in dim.columns))


def expected_cable(facts: DataFrame, port_cable: DataFrame, port: str = "port_class") -> DataFrame:
    """The cable that a port class expects: exact key, key contained either way, else a listed alias and its prefix. port_cable: ord, port, cable."""
    dim = port_cable.select("ord", tx.alnum(F.col("port")).alias("d_port"), "cable")
    f = facts.withColumn("_p", tx.alnum(F.col(port)))
    # of a repeated key the last row counts, as it does in a map, at the first one's place
    dim = dim.groupBy("d_port").agg(F.max_by("cable", "ord").alias("cable"), F.min("ord").alias("ord"))
    p, d = F.col("_p"), F.col("d_port")
    rules = [p == d, (F.length(d) > 0) & (F.length(p) > 0) & (p.contains(d) | d.contains(p))] + [p.contains(a) & d.startswith(x) for a, x in tx.CABLE_ALIASES]
    out = first_match(f, dim, "_p", rules, "ord")
    return out.withColumn("cable_label", F.when(F.col("cable").isNotNull(), tx.cable_label(F.col("cable"))).otherwise(tx.cable_label(F.col(port)))).drop("_p", "d_port", "ord")


def _formed(rows: DataFrame, column: str, form: Callable[[Column], Column], name: str) -> DataFrame:
    """The distinct values of a column, each with a form of it."""
    # of a plain column Spark moves filters below `distinct`, where every row's form would be made, in a scan for each filter
    return rows.select(column).distinct().withColumn(name, F.explode_outer(F.array(form(F.col(column)))))


def close_match(facts: DataFrame, dim: DataFrame, key: str, name: str, least: float = 0.6) -> DataFrame:
    """facts with `matched`: the dimension name that is equal after normalising, else the best by sequence ratio from `least` on (of equal ratios the last by its
    normalised form), else null. Names that are equal after normalising count as the first of them. Null and blank keys match nothing but their like."""
    d = _formed(dim.select(F.col(name).alias("_name")), "_name", tx.spaced, "_norm").groupBy("_norm").agg(F.min("_name").alias("_name"))
    f = _formed(facts, key, tx.spaced, "_q")
    texts = f.join(d.select(F.col("_norm").alias("_q")), "_q", "left_anti").select(F.col("_q").alias("text"))
    near = ratio_join(texts, d.select(F.col("_norm").alias("text")), lambda a, b: sim.sequence_ratio(b, a), least)
    best = near.groupBy(F.col("a").alias("_q")).agg(F.max_by("b", F.struct("ratio", "b")).alias("_norm"))
    both = f.join(best, "_q", "left").withColumn("_norm", F.coalesce("_norm", "_q")).join(d, "_norm", "left").select(F.col(key).alias("_key"), F.col("_name").alias("matched"))
    return facts.join(both, facts[key].eqNullSafe(F.col("_key")), "left").drop("_key")


def describe_models(facts: DataFrame, dim: DataFrame, key: str = "model", least: float = 85.0) -> DataFrame:
    """facts with the description of the model with the best Indel ratio, from `least` (0 to 100) on. dim: Model (several between slashes), Description."""
    d = dim.select(F.explode(F.split("model", "/")).alias("_m"), "description").withColumns({"_m": F.trim("_m"), "_n": tx.alnum(F.trim("_m"))}).filter("_n <> ''")
    d = d.groupBy("_n").agg(F.min(F.struct("_m", "description")).alias("_d"))
    f = _formed(facts, key, tx.alnum, "_q")
    hits = ratio_join(f.select(F.col("_q").alias("text")), d.select(F.col("_n").alias("text")), lambda a, b: sim.indel_ratio(a, b) / 100, least / 100)
    named = hits.join(d, F.col("b") == F.col("_n"))
    best = named.groupBy(F.col("a").alias("_q")).agg(F.min_by(F.struct(F.col("_d._m").alias("matched"), F.col("_d.description").alias("description"), F.round(F.col("ratio") * 100, 4).alias("ratio")), F.struct((-F.col("ratio")).alias("r"), F.col("_d._m"))).alias("_d"))
    found = f.join(best, "_q").select(F.col(key).alias("_key"), "_d.*")
    return facts.join(found, F.col(key) == F.col("_key"), "left").drop("_key")


def keyed_distinct(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row by `order` of each key, keys compared trimmed and lower-cased."""
    w = Window.partitionBy(*(tx.key(F.col(c)) for c in key)).orderBy(order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def content_distinct(rows: DataFrame, content: str, order: str, per: Sequence[str] = ()) -> DataFrame:
    """The first row by `order` of each content (MD5), within the `per` columns. Only key and order are aggregated before the rows are joined back."""
    d = rows.withColumn("_md5", F.md5(content))
    first = d.groupBy(*per, "_md5").agg(F.min(order).alias(order))
    return d.join(first, [*per, "_md5", order], "left_semi").drop("_md5")


def vendor_vote(parts: DataFrame, aliases: DataFrame, least: float = 0.2, fuzzy: bool = True, examples: bool = False) -> DataFrame:
    """The vendor of each image by a vote of its text parts: image, vendor, total, votes (and examples: the voting parts with their scores, in order).

    parts: image, part; aliases: ord, vendor, alias, a vocabulary of at most VOCABULARY rows. A part and what it has left of a bracket are alternatives; its score is that of its best vendor (the
    first by ord of equals): 1 for an alias that it holds, 0.6 of the share of the alias' words that it has, 0.5 of the sequence ratio (fuzzy). A part votes if that reaches
    `least`; the winner has the largest sum of scores (three decimals), then the most votes, then the lowest ord. Blank parts and aliases take no part.
    """
    listed = aliases.select("ord", "vendor", tx.ocr(F.col("alias")).alias("a")).filter("a <> ''").orderBy("ord", "vendor", "a").limit(VOCABULARY + 1).collect()
    if len(listed) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} aliases")
    spark = parts.sparkSession
    left = F.when(F.contains("part", F.lit("(")), F.nullif(F.trim(F.regexp_extract("part", r"^([^(]*)", 1)), F.lit("")))
    best = sim.best_alias(spark.sparkContext.broadcast([r.a for r in listed]), least, fuzzy)
    scored = parts.select("image", "part", best(tx.ocr(F.col("part")), tx.ocr(left)).alias("_b")).filter("_b is not null")
    names = spark.createDataFrame([(k, r.ord, r.vendor) for k, r in enumerate(listed)], "_k int, ord int, vendor string")
    votes = scored.select("image", "part", F.col("_b.score").alias("score"), F.col("_b.alias").alias("_k")).join(F.broadcast(names), "_k")
    own = [F.transform(F.sort_array(F.collect_list(F.struct("part", "score"))), lambda x: F.struct(x["part"].alias("part"), F.bround(x["score"], 3).alias("score"))).alias("examples")] if examples else []
    per = votes.groupBy("image", "vendor").agg(F.bround(F.sum("score"), 3).alias("total"), F.count("*").alias("votes"), F.min("ord").alias("ord"), *own)
    kept = ["vendor", "total", "votes", *(["examples"] if examples else [])]
    return per.groupBy("image").agg(F.max_by(F.struct(*kept), F.struct("total", "votes", (-F.col("ord")).alias("o"))).alias("w")).select("image", "w.*")


def vendor_hits(parts: DataFrame, aliases: DataFrame) -> DataFrame:
    """image, vendor, hits: the image's text parts that hold at least one alias of the vendor, whichever vendor they vote for.
    parts: image, part; aliases: vendor, alias. Vendors without a hit have no row; blank or null parts and aliases hit nothing."""
    p = parts.select("image", tx.ocr(F.col("part")).alias("_p")).filter("_p <> ''")
    v = aliases.withColumn("_a", tx.ocr(F.col("alias"))).filter("_a <> ''").groupBy("vendor").agg(F.collect_set("_a").alias("_as"))
    return p.join(dimension(v), F.exists("_as", lambda a: F.contains(F.col("_p"), a))).groupBy("image", "vendor").agg(F.count("*").alias("hits"))


def early_vendor(fragments: DataFrame, vendors: DataFrame, least: float = 65.0) -> DataFrame:
    """An exact substring, by band and then vendor order, beats any fuzzy hit; else the best fuzzy ratio from `least` on, the first of equals.
    fragments: image, band, text; vendors: ord, vendor."""
    pairs = fragments.withColumn("_t", tx.compact(F.col("text"))).join(dimension(vendors.withColumn("_v", tx.compact(F.col("vendor")))), F.lit(True)).filter("_t <> '' and _v <> ''")
    pairs = pairs.withColumn("exact", F.contains("_t", "_v"))
    sure = pairs.filter("exact").groupBy("image").agg(F.min_by("vendor", F.struct("band", "ord")).alias("vendor")).withColumn("score", F.lit(100.0))
    rest = pairs.join(sure.select("image"), "image", "left_anti").withColumn("score", sim.fuzzy_ratio(F.col("_t"), F.col("_v"))).filter(F.col("score") >= least)
    fuzzy = rest.groupBy("image").agg(F.max_by(F.struct("vendor", "score"), F.struct("score", (-F.col("band")).alias("b"), (-F.col("ord")).alias("o"))).alias("x")).select("image", "x.*")
    return sure.unionByName(fuzzy)


def near_hashes(left: DataFrame, right: DataFrame, key: str, most: int, bits: int = 64, scale: int = 32) -> DataFrame:
    """key, a, b, distance, similarity: all pairs within the key whose hashes differ in at most `most` bits, b by the nearest of its variants.

    left: key, a, hash (long); right: key, b, variants (array of long, such as a picture's rotations). Hashes are cut into most + 1 bands; two that differ in at most `most` bits
    agree in a whole band, so pairs that meet on (key, band) are all. Where bands are so short that most pairs meet in some, they meet on the key alone. Pairs are compared in blocks, and only near ones
    become rows. similarity: 1 - distance / scale, at least 0. A null hash or key is near nothing."""
    cuts = [bits * k // (most + 1) for k in range(most + 2)]
    x = left.filter(F.col("hash").isNotNull()).select(key, "a", F.col("hash").cast("long").alias("h"))
    y = right.select(key, "b", F.explode("variants").alias("v")).filter("v is not null").withColumn("v", F.col("v").cast("long")).distinct()
    kind, ids = left.schema[key].dataType.simpleString(), (left.schema["a"].dataType.simpleString(), right.schema["b"].dataType.simpleString())
    if sum(2.0 ** (p - q) for p, q in zip(cuts[:-1], cuts[1:], strict=True)) > 0.25:
        best = blocks.near_bits(x, y, key, most, kind, ids)
    else:

        def banded(d: DataFrame, h: str) -> DataFrame:
            own = (F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1) if b - a < 64 else F.lit(-1)).alias("bits")) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
            return d.filter(F.col(key).isNotNull()).withColumn("_at", F.explode(F.array(*own))).withColumn("_at", F.struct(key, "_at.band", "_at.bits"))

        near = blocks.near_bits(banded(x, "h").drop(key), banded(y, "v").drop(key), "_at", most, f"struct<`{key}`:{kind},band:int,bits:bigint>", ids)
        best = near.groupBy(F.col(f"_at.{key}").alias(key), "a", "b").agg(F.min("distance").alias("distance"))
    return best.withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("distance") / scale))


def ensemble(probabilities: DataFrame) -> DataFrame:
    """The class of the more confident model; the first model on ties. probabilities: image, model, class_names, probs."""
    p = probabilities.withColumns({"class": sim.argmax(F.col("probs"), F.col("class_names")), "confidence": F.array_max("probs")})
    return p.groupBy("image").agg(F.min_by(F.struct("class", "confidence", "model"), F.struct((-F.col("confidence")).alias("c"), F.col("model"))).alias("x")).select("image", "x.*")


def layout(ports: DataFrame) -> DataFrame:
    """num_ports and arrangement: LEFT or RIGHT if 60 % of the ports are in that half. ports: image, width, box."""
    centre = (F.col("box.x1") + F.col("box.x2")) < F.col("width")
    n = ports.groupBy("image").agg(F.count("*").alias("num_ports"), F.count_if(centre).alias("left"))
    return n.select("image", "num_ports", F.when(5 * F.col("left") >= 3 * F.col("num_ports"), "LEFT").when(5 * (F.col("num_ports") - F.col("left")) >= 3 * F.col("num_ports"), "RIGHT").otherwise("CENTER").alias("arrangement"))


def representative(crops: DataFrame, per: Sequence[str]) -> DataFrame:
    """Of each group the crop with the best mix of size and sharpness, the first of equals. crops: per, crop_id, area, sharpness."""
    from ..functions.geometry import representative_score

    score = representative_score(F.col("area"), F.col("sharpness"))
    return crops.groupBy(*per).agg(F.max_by("crop_id", F.struct(score.alias("s"), (-F.col("crop_id")).alias("o"))).alias("crop_id"), F.round(F.max(score), 6).alias("score"))


def missing_keys(facts: DataFrame, dim: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Normalised fact keys that the dimension lacks."""
    return facts.select(tx.spaced(F.col(on[0])).alias("key")).distinct().join(dim.select(tx.spaced(F.col(on[1])).alias("key")), "key", "left_anti")
