"""Spatial joins of boxes and what is assigned by them.

Boxes of one image that overlap share a grid cell; each pair is kept in the one cell that holds its
upper left common corner, so the join has an equi key and needs no distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

CELL = 256


def _cells(b: Column, cell: int) -> Column:
    """Cells of a box as (column, row) structs; zero-sized boxes have the cell of their corner."""
    xs = F.sequence(F.floor(b["x1"] / cell).cast("int"), F.floor(F.greatest(b["x2"], b["x1"]) / cell).cast("int"))
    ys = F.sequence(F.floor(b["y1"] / cell).cast("int"), F.floor(F.greatest(b["y2"], b["y1"]) / cell).cast("int"))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def overlap_join(left: DataFrame, right: DataFrame, on: str = "image", left_box: str = "box", right_box: str = "other", cell: int = CELL) -> DataFrame:
    """All pairs of one image whose boxes share area. Column names of the sides must differ but for `on`."""
    a = left.withColumn("_cell", F.explode(_cells(F.col(left_box), cell)))
    b = right.withColumn("_cell", F.explode(_cells(F.col(right_box), cell)))
    pairs = a.join(b, [on, "_cell"])
    own = F.struct(F.floor(F.greatest(F.col(f"{left_box}.x1"), F.col(f"{right_box}.x1")) / cell).cast("int").alias("cx"), F.floor(F.greatest(F.col(f"{left_box}.y1"), F.col(f"{right_box}.y1")) / cell).cast("int").alias("cy"))
    return pairs.filter((F.col("_cell") == own) & (g.intersection(F.col(left_box), F.col(right_box)) > 0)).drop("_cell")


def assign_parents(ports: DataFrame, devices: DataFrame, compat: bool = False) -> DataFrame:
    """Each port with parent_type, parent_id and validation.

    ports: image, port_id, box. devices: image, dev_id, kind (switch, patch_panel, or in compat mode rack and cables too), ordinal, box.
    The valid switch with the lowest ordinal wins, else the valid panel; else the reason of the last visited
    parent that shares area with the port, else "Orphaned Port". compat repeats this for each number k of
    detections of the image, with the parents up to ordinal k only, as passes over a growing list do (column pass_no).
    """
    parents = devices.filter(F.col("kind").isin("switch", "patch_panel")).select("image", "dev_id", "kind", "ordinal", F.col("box").alias("parent_box"))
    pairs = overlap_join(ports.select("image", "port_id", "box"), parents, right_box="parent_box")
    pairs = pairs.withColumns({"reason": g.containment(F.col("box"), F.col("parent_box")), "panel": (F.col("kind") == "patch_panel").cast("int")})
    keys = ["image", "port_id"]
    if compat:
        passes = devices.groupBy("image").agg(F.count("*").cast("int").alias("passes")).select("image", F.explode(F.sequence(F.lit(1), "passes")).alias("pass_no"))
        pairs = pairs.join(passes, "image").filter("ordinal <= pass_no")
        ports = ports.join(passes, "image")
        keys.append("pass_no")
    valid = F.min(F.when(F.col("reason") == "Valid", F.struct("panel", "ordinal", "dev_id", "kind")))
    last = F.max(F.when(F.col("reason") == "Port not contained", F.struct("panel", "ordinal", "dev_id", "reason")))
    best = pairs.groupBy(*keys).agg(valid.alias("won"), last.alias("lost"))
    return ports.join(best, keys, "left").select(
        *ports.columns,
        F.col("won.kind").alias("parent_type"),
        F.col("won.dev_id").alias("parent_id"),
        F.when(F.col("won").isNotNull(), "Valid").otherwise(F.coalesce("lost.reason", F.lit("Orphaned Port"))).alias("validation"),
    )


def label_units(units: DataFrame, detections: DataFrame, least: float = 0.25) -> DataFrame:
    """Each unit (image, unit_no, box) with the class of the most confident detection (image, det_id, class, confidence, box)
    whose IoU is above the limit; the first of equals; else `empty` and 0."""
    d = detections.select("image", "det_id", "class", "confidence", F.col("box").alias("det_box"))
    pairs = overlap_join(units.select("image", "unit_no", "box"), d, right_box="det_box").filter(g.iou(F.col("box"), F.col("det_box")) > least)
    best = pairs.groupBy("image", "unit_no").agg(F.max_by(F.struct("class", "confidence"), F.struct("confidence", -F.col("det_id"))).alias("best"))
    return units.join(best, ["image", "unit_no"], "left").select(*units.columns, F.coalesce("best.class", F.lit("empty")).alias("label"), F.coalesce("best.confidence", F.lit(0.0)).alias("confidence"))


def unit_ordinals(units: DataFrame) -> DataFrame:
    """unit_no from 1 by the upper edge, then the left edge, then the id."""
    by = Window.partitionBy("image").orderBy("box.y1", "box.x1", "det_id")
    return units.withColumn("unit_no", F.row_number().over(by))


def best_rack(racks: DataFrame) -> DataFrame:
    """Of each image the rack with the best mix of confidence and area; the first of equals. racks: image, det_id, confidence, box."""
    score = g.rack_score(F.col("confidence"), g.area(F.col("box")))
    key = F.struct(score.alias("score"), (-F.col("det_id")).alias("ord"))
    return racks.groupBy("image").agg(F.max_by("det_id", key).alias("det_id"), F.round(F.max(score), 6).alias("score"))


def classify(detections: DataFrame, aliases: DataFrame, thresholds: DataFrame, pipeline: str, default: float = 0.2, keep_unknown: bool = False) -> DataFrame:
    """Detections with their canonical class, above the class's threshold in this pipeline. aliases and thresholds are the
    parameter tables class_alias and thresholds; unknown classes stay or go."""
    a = aliases.filter(F.col("pipeline") == pipeline).select(F.col("class_raw").alias("_raw"), F.col("class").alias("_class"))
    t = thresholds.filter(F.col("pipeline") == pipeline).select(F.col("class").alias("_t"), "min_conf")
    d = detections.join(a, F.lower(F.trim("class_raw")) == F.col("_raw"), "left").withColumn("class", F.coalesce("_class", "class_raw") if keep_unknown else F.col("_class")).filter("class is not null")
    return d.join(t, F.col("class") == F.col("_t"), "left").filter(F.col("confidence") >= F.coalesce("min_conf", F.lit(default))).drop("_raw", "_class", "_t", "min_conf")


def first_stage(results: DataFrame, key: str = "image", stage: str = "stage") -> DataFrame:
    """Fallback ladder: of each image only the rows of its first stage that has any."""
    w = Window.partitionBy(key)
    return results.withColumn("_first", F.min(stage).over(w)).filter(F.col(stage) == F.col("_first")).drop("_first")
