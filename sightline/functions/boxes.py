"""Box arithmetic as Column expressions. A box is x, y, w, h in whole pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x:int,y:int,w:int,h:int>"


def box(x, y, w, h) -> Column:
    return F.struct(*(F.expr(v).cast("int").alias(n) if isinstance(v, str) else v.cast("int").alias(n) for v, n in zip((x, y, w, h), "xywh")))


def _common(a: Column, b: Column) -> Column:
    side = lambda p, s: F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p])
    zero = F.lit(0)
    return (F.greatest(side("x", "w"), zero).cast("bigint") * F.greatest(side("y", "h"), zero)).cast("double")


def area(a: Column) -> Column:
    return a["w"].cast("bigint") * a["h"]


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union is empty or nothing is shared."""
    common = _common(a, b)
    union = area(a) + area(b) - common
    return F.when((union <= 0) | (common <= 0), 0.0).otherwise(common / union)


def centre(a: Column) -> tuple[Column, Column]:
    """Whole pixels; halves truncate."""
    return (a["x"] + (a["w"] / 2).cast("int")), (a["y"] + (a["h"] / 2).cast("int"))


def corner(a: Column) -> tuple[Column, Column]:
    return a["x"], a["y"]


def corners_near(a: Column, b: Column, gate: int = 150) -> Column:
    return (F.abs(a["x"] - b["x"]) <= gate) & (F.abs(a["y"] - b["y"]) <= gate)


def fallback_score(a: Column, b: Column) -> Column:
    """(|dx| + |dy|) / 200 plus the areas' relative difference."""
    total = area(a) + area(b)
    shift = (F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"])) / 200.0
    return shift + F.when(total > 0, F.abs(area(a) - area(b)) / total).otherwise(0.0)


def mirrored(a: Column, width: Column) -> Column:
    """The box in the image flipped left to right."""
    return F.struct(F.greatest(width - a["x"] - a["w"], F.lit(0)).cast("int").alias("x"), a["y"].alias("y"), a["w"].alias("w"), a["h"].alias("h"))
