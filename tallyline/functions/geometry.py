"""Boxes: conversions, areas, regions, as column functions. A box is struct(x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def _finite(*xs: Column) -> Column:
    ok = F.lit(True)
    for x in xs:
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return ok


def pixel_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Rounded half to even and clamped to the image; null where a value isn't finite or nothing is left."""
    at = lambda v, most: F.greatest(F.lit(0), F.least(most.cast("int"), F.rint(v.cast("double")).cast("int")))
    a, b, c, d = at(x1, width), at(y1, height), at(x2, width), at(y2, height)
    return F.when(_finite(*[v.cast("double") for v in (x1, y1, x2, y2)]) & (c > a) & (d > b), box(a, b, c, d))


def yolo_box(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Centre and size, normalised, to pixels; null where the size isn't above 0."""
    got = pixel_box((cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height, width, height)
    return F.when((w > 0) & (h > 0), got)


def coco_to_yolo(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, cls: int = 0) -> Column:
    """A label line, six decimals."""
    return F.format_string(f"{cls} %.6f %.6f %.6f %.6f", (x + w / 2) / width, (y + h / 2) / height, w / width, h / height)


def area_ratio(b: Column, width: Column, height: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"]) * F.greatest(F.lit(0), b["y2"] - b["y1"]) / (width * height)


def center(b: Column, width: Column, height: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2 / width).alias("x"), ((b["y1"] + b["y2"]) / 2 / height).alias("y"))


def in_region(x: Column, y: Column, region: tuple[float, float, float, float]) -> Column:
    """Inclusive on all sides; the region is (x0, y0, x1, y1) in shares of the frame."""
    x0, y0, x1, y1 = region
    return x.between(x0, x1) & y.between(y0, y1)


def car_like(width: Column, height: Column) -> Column:
    """Both sides 20 pixels or more, and 2.2 times as wide as high."""
    return (F.least(width, height) >= 20) & (width / height >= 2.2)


def padded(b: Column, share: float, width: Column, height: Column) -> Column:
    """The box widened by a share of its extents (truncated), inside the frame."""
    px, py = ((b["x2"] - b["x1"]) * share).cast("int"), ((b["y2"] - b["y1"]) * share).cast("int")
    return box(F.greatest(F.lit(0), b["x1"] - px), F.greatest(F.lit(0), b["y1"] - py), F.least(width, b["x2"] + px), F.least(height, b["y2"] + py))


def body_band(height: Column) -> Column:
    """Rows [20 %, 85 %) of a crop, all rows if fewer than two are left."""
    a, b = (height * 0.20).cast("int"), (height * 0.85).cast("int")
    return F.when(b - a >= 2, F.struct(a.alias("top"), b.alias("bottom"))).otherwise(F.struct(F.lit(0).alias("top"), height.cast("int").alias("bottom")))
