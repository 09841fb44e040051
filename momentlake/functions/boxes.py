"""Boxes in a picture: structs of x1, y1, x2, y2 in pixels.  All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most times that a crop is enlarged, and the share of its size that is added around it.
ENLARGE, PAD = 4.0, 0.08


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Shared area by that of both together; 0 for boxes without area."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    shared = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    union = width(a) * height(a) + width(b) * height(b) - shared
    return F.when(union > 0, shared / F.greatest(union, F.lit(1e-9))).otherwise(0.0)


def proximity(a: Column, b: Column) -> Column:
    """1 for the same box, falling with the distance of the centres in units of the boxes' mean diagonal, times how far
    their areas agree: a box moved by its own diagonal has 0.5."""
    centre = lambda x, lo, hi: (x[lo] + x[hi]) / 2
    distance = F.hypot(centre(a, "x1", "x2") - centre(b, "x1", "x2"), centre(a, "y1", "y2") - centre(b, "y1", "y2"))
    diagonal = lambda x: F.hypot(width(x), height(x))
    scale = F.greatest((diagonal(a) + diagonal(b)) / 2, F.lit(1e-9))
    one, two = width(a) * height(a), width(b) * height(b)
    return F.least(one, two) / F.greatest(one, two, F.lit(1e-9)) / (1 + distance / scale)


def similarity(a: Column, b: Column, metric: str = "proximity", label_a: Column | None = None, label_b: Column | None = None) -> Column:
    """By proximity or iou; with labels, 0 for boxes of different classes."""
    from momentlake.errors import UnknownOption

    if metric not in ("proximity", "iou"):
        raise UnknownOption("metric", metric, ("proximity", "iou"))
    out = proximity(a, b) if metric == "proximity" else iou(a, b)
    return out if label_a is None or label_b is None else F.when(label_a == label_b, out).otherwise(0.0)


def crop(b: Column, image_width: Column, image_height: Column, pad: float = PAD) -> Column:
    """The whole pixels to cut out, padded and inside the picture; null for under two pixels a side."""
    px, py = width(b) * pad, height(b) * pad
    cut = F.struct(
        F.greatest(F.lit(0), F.bround(b["x1"] - px)).cast("int").alias("x1"), F.greatest(F.lit(0), F.bround(b["y1"] - py)).cast("int").alias("y1"),
        F.least(image_width, F.bround(b["x2"] + px)).cast("int").alias("x2"), F.least(image_height, F.bround(b["y2"] + py)).cast("int").alias("y2"),
    )
    return F.when((cut["x2"] - cut["x1"] >= 2) & (cut["y2"] - cut["y1"] >= 2), cut)


def enlargement(b: Column, side: float) -> Column:
    """How many times a crop is enlarged so that its longer side has `side` pixels: 1 to ENLARGE."""
    longer = F.greatest(width(b), height(b))
    return F.when(longer > 0, F.least(F.greatest(F.lit(side) / longer, F.lit(1.0)), F.lit(ENLARGE))).otherwise(1.0)
