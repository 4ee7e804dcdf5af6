"""Exact joins on string ratios: an inverted index proposes pairs, only those that can reach the ratio are compared in full.

For strings a and b with S characters together and a longest common subsequence of L, the Indel ratio is 2 L / S and the sequence ratio
2 M / S with M <= L. A ratio of at least r needs L >= r S / 2, so of either string's characters (counted with repeats) r S / 2 are the
other's, and of its pairs of neighbours 3 L - S - 1, since each deletion breaks at most two pairs and each insertion one: at least
(1.5 r - 1) S - 1. The lengths are within r / (2 - r) of each other. Grams are numbered by occurrence, so that strings are sets of grams,
and put in order from rare to frequent: two sets with t grams in common meet among the first (size - t + 1) of each. A pair is proposed at
its first common one only, and must pass the count before it is compared. Nothing is lost; strings too short for a pair bound meet at a token of their own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bound(least: float) -> tuple[int, float, float]:
    """Size of the grams, and the factor and the constant in (common grams >= factor * S - constant)."""
    pairs = 1.5 * least - 1
    return (2, pairs, 1.0) if pairs > 0.2 else (1, least / 2, 0.0)


def _needed(total: Column, factor: float, constant: float) -> Column:
    return F.greatest(F.lit(0), F.ceil(total * factor - constant - 1e-9)).cast("int")


def _grams(text: str, size: int, short: int) -> Column:
    """Grams with their occurrence numbers; strings of up to `short` characters have one gram more."""
    n = F.greatest(F.length(text) - (size - 1), F.lit(0))
    own = F.array_sort(F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(text, i, F.lit(size))))
    counted = F.transform(own, lambda g, i: F.concat(g, F.lit("\x00"), (i + 1 - F.array_position(own, g)).cast("string")))
    return F.concat(counted, F.when(F.length(text) <= short, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))


def _sides(left: DataFrame, right: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    size, factor, constant = _bound(least)
    short = math.floor(constant / factor)

    def listed(d: DataFrame) -> DataFrame:
        return d.select("text").filter("text <> ''").distinct().withColumn("grams", _grams("text", size, short))

    def each_gram(d: DataFrame) -> DataFrame:
        # of an inner explode Spark infers a filter on the grams and moves it below `distinct`, where every row's grams would be made
        return d.select("text", F.explode_outer("grams").alias("gram")).filter("gram is not null")

    a, b = listed(left), listed(right)
    rare = each_gram(b).groupBy("gram").agg(F.count("*").alias("n"))

    def ordered(d: DataFrame) -> DataFrame:
        each = each_gram(d).join(rare, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        sets = each.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "gram"))), lambda x: x["gram"]).alias("grams"))
        size_ = F.length("text")
        need = F.greatest(_needed(size_ + F.ceil(size_ * (least / (2 - least)) - 1e-9), factor, constant), F.lit(1))
        return sets.withColumn("first", F.slice("grams", 1, F.greatest(F.size("grams") - need + 1, F.lit(0))))

    return ordered(a), ordered(b)


def proposals(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b: all pairs of texts (column `text` of either side) that may have a ratio of `least` (over 0, up to 1), each once; equal and empty texts don't take part as such."""
    _, factor, constant = _bound(least)
    x, y = _sides(left, right, least)
    x = x.select(F.col("text").alias("a"), F.col("grams").alias("a_grams"), F.col("first").alias("a_first"), F.explode("first").alias("_gram"))
    y = y.select(F.col("text").alias("b"), F.col("grams").alias("b_grams"), F.col("first").alias("b_first"), F.explode("first").alias("_gram"))
    la, lb = F.length("a"), F.length("b")
    near = (2 * F.least(la, lb) + 1e-9 >= least * (la + lb)) & (F.get(F.array_intersect("a_first", "b_first"), F.lit(0)) == F.col("_gram"))
    enough = F.size(F.array_intersect("a_grams", "b_grams")) - F.when(F.array_contains("a_grams", "") & F.array_contains("b_grams", ""), 1).otherwise(0) >= _needed(la + lb, factor, constant)
    return x.join(y, "_gram").filter(near).filter(enough).select("a", "b")


def ratio_join(left: DataFrame, right: DataFrame, ratio: Callable[[Column, Column], Column], least: float) -> DataFrame:
    """a, b and ratio of all pairs of distinct texts with a ratio of at least `least` (0 to 1). ratio: a similarity that is at most 2 L / S."""
    return proposals(left, right, least).withColumn("ratio", ratio(F.col("a"), F.col("b"))).filter(F.col("ratio") >= least)
