"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Each document's words and pairs of neighbouring words are hashed into BUCKETS. Two multinomials over the
buckets, of the trusted documents and of the whole corpus, are counted over all of them, with
add-ALPHA smoothing; a document's score is the mean over its n-grams of log(p_trusted / p_corpus).
No document counts for its own score: texts fall into FOLDS parts by their hash, so that copies are together, and a
part is scored with the counts of the others. A document is kept if it passes the base rules and its score is at least the
threshold, for every document and without any randomness. The threshold is the corpus's own: the highest step of
1 / STEPS that at most LOST of the trusted documents with LEAST_WORDS words or more are below, all scored as any document is.

Base rules: at least 20 words, and at most 30 % of the words in 8-word windows that occur twice or more.

Defined results: null, empty and word-less texts have all measures 0, score 0 and fail the base
rules. Without trusted n-grams the ratio and the threshold are 0. Repeated rows each get a row; other columns stay or
are ignored, and may have any names. A null id or a null flag is not trusted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, materialize, small

BUCKETS = 1 << 15
ALPHA = 1.0
FOLDS = 4
#: Share of the trusted documents that may be below the threshold, and steps in a unit of the score.
LOST, STEPS = 0.005, 1000
LEAST_WORDS, WINDOW, REPEATED_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"


def let(value: Column, then) -> Column:
    """then(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words(text: Column) -> Column:
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACE)), lambda t: F.when(t != "", F.split(t, "[ \\t-\\r]+")).otherwise(F.array().cast("array<string>")))


def joined(h: Column, gap: int = 1) -> Column:
    """Hashes of every element with the one `gap` places on."""
    n = F.greatest(F.size(h) - gap, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, 1 + gap, n), lambda a, b: F.xxhash64(a, b))


def hashed(docs: DataFrame, text_col: str, prefix: str) -> DataFrame:
    """docs with {prefix}ws (words), {prefix}h1 (their hashes) and {prefix}h2 (of pairs of neighbours)."""
    return docs.withColumn(f"{prefix}ws", words(F.col(text_col))).withColumn(f"{prefix}h1", F.transform(f"{prefix}ws", lambda w: F.xxhash64(w))).withColumn(f"{prefix}h2", joined(F.col(f"{prefix}h1")))


def repeated_words(h8: Column, window: int = WINDOW) -> Column:
    """How many words stand in windows that occur twice or more. h8: the windows' hashes."""

    def covered(s: Column) -> Column:
        # windows in order of (hash, position): those with an equal neighbour, then their positions in order
        n = F.size(s)
        twice = F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["h"] == e["h"])) | ((i < n - 1) & (F.get(s, i + 1)["h"] == e["h"])))
        at = F.array_sort(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("sum"), F.lit(-window).alias("last"))
        return F.aggregate(at, start, lambda a, i: F.struct((a["sum"] + F.least(F.lit(window), i - a["last"])).alias("sum"), i.alias("last")), lambda a: a["sum"])

    pairs = F.transform(h8, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(h8)) == F.size(h8), F.lit(0)).otherwise(let(F.array_sort(pairs), covered)).cast("long")


def duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def fold(text: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(folds)).cast("int")


def ratios(docs: DataFrame, trusted_col: str, text_col: str = "text", buckets: int = BUCKETS, alpha: float = ALPHA, folds: int = FOLDS) -> DataFrame:
    """For every fold the array of log(p_trusted / p_corpus) of all buckets, from the documents of the other folds: `folds` rows whatever the corpus, in a table of their own."""
    p = free(docs, "_rules_")
    d = hashed(docs.select(fold(F.col(text_col), folds).alias("fold"), F.coalesce(F.col(trusted_col), F.lit(False)).cast("int").alias("good"), F.col(text_col).alias("text")), "text", p)
    d = d.select("fold", "good", F.explode(F.concat(f"{p}h1", f"{p}h2")).alias("h")).groupBy("fold", F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("corpus"), F.sum("good").alias("trusted"))
    names = ("corpus", "trusted")
    of = {(n, f): F.coalesce(F.sum(F.when(F.col("fold") == f, F.col(n))), F.lit(0)).alias(f"{n}{f}") for n in names for f in range(folds)}
    counts = materialize(d.groupBy("bucket").agg(*of.values()), "buckets")
    total = counts.agg(*(F.coalesce(F.sum(f"{n}{f}"), F.lit(0)).alias(f"{n}{f}") for n, f in of)).first()
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left").fillna(0)
    rows = []
    for f in range(folds):
        others = [k for k in range(folds) if k != f]
        all_corpus, all_trusted = (sum(total[f"{n}{k}"] for k in others) for n in names)
        weight = F.lit(0.0)
        if all_corpus and all_trusted:
            corpus, trusted = (sum((F.col(f"{n}{k}") for k in others), F.lit(alpha)) for n in names)
            weight = F.log(trusted) - F.log(corpus) + F.lit(math.log(all_corpus + alpha * buckets) - math.log(all_trusted + alpha * buckets))
        rows.append(F.struct(F.lit(f).alias("fold"), "bucket", weight.alias("weight")))
    listed = every.select(F.explode(F.array(*rows)).alias("x")).groupBy("x.fold").agg(F.sort_array(F.collect_list(F.struct("x.bucket", "x.weight"))).alias("x"))
    return materialize(listed.select("fold", F.col("x.weight").alias("weights")), "weights")


def scored(docs: DataFrame, weights: DataFrame, text_col: str, prefix: str, buckets: int = BUCKETS, folds: int = FOLDS) -> DataFrame:
    """docs with the columns of hashed() and {prefix}score. weights: of ratios(); its few rows are broadcast."""
    p = prefix
    d = hashed(docs, text_col, p).withColumn(f"{p}fold", fold(F.col(text_col), folds))
    d = d.join(F.broadcast(weights.select(F.col("fold").alias(f"{p}fold"), F.col("weights").alias(f"{p}weights"))), f"{p}fold", "left")
    g = F.concat(f"{p}h1", f"{p}h2")
    total = F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(f"{p}weights", F.pmod(x, F.lit(buckets)).cast("int")))
    n = F.size(f"{p}h1") + F.size(f"{p}h2")
    return d.withColumn(f"{p}score", F.when(n > 0, F.round(total / n, 9)).otherwise(0.0)).drop(f"{p}fold", f"{p}weights")


def threshold(docs: DataFrame, trusted_col: str, weights: DataFrame, text_col: str = "text", lost: float = LOST, steps: int = STEPS) -> float:
    """From a histogram of the trusted documents' scores, which has at most as many bars as the score's range has steps."""
    p = free(docs, "_rules_")
    d = scored(docs.filter(F.col(trusted_col)).select(text_col), weights, text_col, p)
    step = F.when(F.size(f"{p}ws") >= LEAST_WORDS, F.floor(F.col(f"{p}score") * steps))
    bars = sorted((r.step, r["count"]) for r in d.groupBy(step.alias("step")).count().collect() if r.step is not None)
    below, most = 0, lost * sum(n for _, n in bars)
    for step, n in bars:
        if below + n > most:
            return step / steps
        below += n
    return 0.0


def measured(docs: DataFrame, weights: DataFrame, least: float, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with the measures, score, base_failed and kept, under names that begin with prefix; docs has no such names.
    {prefix}pin is at least 0 and without meaning: a filter that asks for it stays above the measures, where pushed further it would compute them again for each place in which it names them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    p = prefix
    d = scored(docs, weights, text_col, p).withColumn(f"{p}h4", joined(F.col(f"{p}h2"), 2)).withColumn(f"{p}h8", joined(F.col(f"{p}h4"), 4))
    d = d.withColumns({
        f"{p}n_words": F.size(f"{p}ws").cast("long"),
        f"{p}word_chars": F.length(F.array_join(f"{p}ws", "")).cast("long"),
        f"{p}n_symbols": F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long"),
        f"{p}n_dup_lines": duplicate_lines(text),
        f"{p}n_repeat_words": repeated_words(F.col(f"{p}h8")),
        f"{p}pin": F.rand(0),
    }).drop(*(f"{p}{x}" for x in ("ws", "h1", "h2", "h4", "h8")))
    failed = (F.col(f"{p}n_words") < LEAST_WORDS) | (100 * F.col(f"{p}n_repeat_words") > REPEATED_PERCENT * F.col(f"{p}n_words"))
    d = d.withColumn(f"{p}base_failed", failed)
    return d.withColumn(f"{p}kept", ~F.col(f"{p}base_failed") & (F.col(f"{p}score") >= least))


def trusted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", out: str = "trusted") -> DataFrame:
    """docs with a flag, whether the document is labelled good. labels: doc_id, quality. Their ids are broadcast up to a size; beyond it docs are shuffled once."""
    good = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_good")).distinct()
    return docs.join(small(good), F.col(id_col) == F.col("_good"), "left").withColumn(out, F.col("_good").isNotNull()).drop("_good")


def quality_rules(docs: DataFrame, trusted_col: str = "trusted", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, score, base_failed and kept for each row of docs."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(trusted_col).alias("trusted"))
    weights = ratios(d, "trusted")
    least = threshold(d, "trusted", weights)
    return measured(d.drop("trusted"), weights, least).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with docs' own columns. labels: doc_id, quality."""
    p = free(docs, "_rules_")
    d = trusted_documents(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")), labels, "_id").select("text", "trusted")
    weights = ratios(d, "trusted")
    least = threshold(d, "trusted", weights)
    return measured(docs, weights, least, text_col, p).filter(f"{p}kept and {p}pin >= 0").select(docs.columns)
