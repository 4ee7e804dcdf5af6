"""Boxes as structs of x1, y1, x2, y2; all functions are Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Port counts that devices come with.
PORT_COUNTS = (8, 12, 16, 20, 24, 28, 48)


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def area(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """0 where both are empty."""
    i = intersection(a, b)
    return F.coalesce(F.try_divide(i.cast("double"), (area(a) + area(b) - i).cast("double")), F.lit(0.0))


def containment(port: Column, parent: Column, coverage: int = 85, bottom: int = 95) -> Column:
    """Valid, Port not contained or Invalid Parent, in whole numbers (per cent): no overlap; coverage of the port's
    area, centre inside, and the port's lower edge within the parent's height."""
    i, a = intersection(port, parent), area(port)
    height = parent["y2"] - parent["y1"]
    cx, cy = port["x1"] + port["x2"], port["y1"] + port["y2"]
    inside = (cx >= 2 * parent["x1"]) & (cx <= 2 * parent["x2"]) & (cy >= 2 * parent["y1"]) & (cy <= 2 * parent["y2"])
    good = (100 * i >= coverage * a) & inside & (height > 0) & (100 * (port["y2"] - parent["y1"]) <= bottom * height)
    return F.when((i <= 0) | (a <= 0), "Invalid Parent").when(good, "Valid").otherwise("Port not contained")


def clamp(b: Column, width: Column, height: Column, margin: int = 0, inclusive: bool = True) -> Column:
    """The box with a margin, within the image; null if nothing is left. inclusive: up to width - 1."""
    last = 1 if inclusive else 0
    x1, y1 = F.greatest(F.rint(b["x1"]).cast("int") - margin, F.lit(0)), F.greatest(F.rint(b["y1"]).cast("int") - margin, F.lit(0))
    x2, y2 = F.least(F.rint(b["x2"]).cast("int") + margin, width - last), F.least(F.rint(b["y2"]).cast("int") + margin, height - last)
    return F.when((x2 > x1) & (y2 > y1), box(x1, y1, x2, y2))


def crop_size(b: Column, least: int = 128) -> Column:
    """Width and height of a crop that is scaled up to the least side."""
    return F.struct(F.greatest(b["x2"] - b["x1"], F.lit(least)).alias("w"), F.greatest(b["y2"] - b["y1"], F.lit(least)).alias("h"))


def shifted(b: Column, dx: Column, dy: Column, scale: Column) -> Column:
    """From a scaled tile's coordinates to the image's."""
    return box(b["x1"] / scale + dx, b["y1"] / scale + dy, b["x2"] / scale + dx, b["y2"] / scale + dy)


def turned_back(b: Column, width: Column) -> Column:
    """From an image turned clockwise by 90 degrees to the image `width` wide before... a box's corners exchange roles."""
    return box(b["y1"], width - b["x2"], b["y2"], width - b["x1"])


def rack_type(w: Column, h: Column, probabilities: Column, classes: list[str], wall: str = "wall mounted") -> Column:
    """Wide or nearly square racks hang on the wall; else the likeliest class, and of the others the likelier one if that is the wall class."""
    square = (w > h) | (F.abs(w - h) * 10 <= F.greatest(w, h))
    p = F.transform(probabilities, lambda x, i: F.when(F.get(F.array(*map(F.lit, classes)), i) == wall, F.lit(-1.0)).otherwise(x.cast("double")))
    best = F.get(F.array(*map(F.lit, classes)), (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    return F.when(square, wall).otherwise(F.coalesce(best, F.lit("unknown")))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.4, "medium").when(c.isNotNull(), "low")


def nearest_ports(n: Column, k: int = 3) -> Column:
    """The k usual port counts that are nearest, smaller ones first on ties."""
    by = F.array_sort(F.transform(F.array(*map(F.lit, PORT_COUNTS)), lambda p: F.struct(F.abs(p - n).alias("d"), p.alias("p"))))
    return F.transform(F.slice(by, 1, k), lambda s: s["p"])


def port_tiers(n: Column) -> Column:
    """Port counts to search, nearest first; all where the count is unknown."""
    return F.when(n.isNull() | (n == 0), F.array(*map(F.lit, PORT_COUNTS))).otherwise(nearest_ports(n, len(PORT_COUNTS)))


def tiles(width: Column, height: Column, tile: tuple[int, int], overlap: float) -> Column:
    """Array of boxes: a grid with overlap, a last row and column at the edges where the grid's step doesn't end there, and the last corner. Repetitions stay."""
    tw, th = tile
    sx, sy = max(1, int(tw * (1 - overlap))), max(1, int(th * (1 - overlap)))
    right, bottom = F.greatest(width - tw, F.lit(0)), F.greatest(height - th, F.lit(0))
    xs, ys = F.sequence(F.lit(0), right, F.lit(sx)), F.sequence(F.lit(0), bottom, F.lit(sy))

    def at(x: Column, y: Column) -> Column:
        return box(x, y, F.least(x + tw, width), F.least(y + th, height))

    none = F.array().cast("array<struct<x1:int,y1:int,x2:int,y2:int>>")
    grid = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: at(x, y))))
    last_row = F.when(height % sy != 0, F.transform(xs, lambda x: at(x, bottom))).otherwise(none)
    last_column = F.when(width % sx != 0, F.transform(ys, lambda y: at(right, y))).otherwise(none)
    return F.concat(grid, last_row, last_column, F.array(at(right, bottom)))


def device_plausible(width: Column, height: Column, frame_area: Column, edges: Column, lines: Column, share: float = 0.00005, aspect: float = 1.0, edge: float = 0.002, horizontal: int = 0) -> Column:
    """A switch by its share of the frame, its proportions, edge density and horizontal lines."""
    long, short = F.greatest(width, height), F.greatest(F.least(width, height), F.lit(1))
    return (width * height >= share * frame_area) & (long >= aspect * short) & (edges >= edge) & (lines >= horizontal)


def panel_plausible(width: Column, height: Column, edges: Column, lines: Column) -> Column:
    return (width >= 1.6 * height) & (lines >= 3) & (edges > 0.0015)


def representative_score(area_px: Column, sharpness: Column) -> Column:
    return 0.6 * area_px / 1e6 + 0.4 * F.least(F.lit(1.0), sharpness / 1000)


def rack_score(confidence: Column, area_px: Column) -> Column:
    return 0.6 * confidence + 0.4 * F.least(area_px / 1e5, F.lit(1.0))


def switch_quality(aspect: Column, area_px: Column, sharpness: Column, contrast: Column) -> Column:
    """Long devices lose, large, sharp and contrasted ones win."""
    slim = 1 / (1 + F.greatest(aspect - 2, F.lit(0.0)))
    return 0.15 * slim + 0.40 * area_px / 1e6 + 0.35 * sharpness / 1000 + 0.10 * F.least(contrast / 64, F.lit(1.5))


def panel_quality(aspect: Column, area_px: Column, edges: Column, lines: Column) -> Column:
    """-1 for what is too square to be a panel."""
    up_to_one = lambda x: F.least(x, F.lit(1.0))
    score = 0.35 * up_to_one(lines / 10) + 0.25 * up_to_one(edges * 100) + 0.25 * up_to_one((aspect - 1.6) / 2) + 0.15 * area_px / 1e6
    return F.when(aspect < 1.6, -1.0).otherwise(score)
