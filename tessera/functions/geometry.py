"""Box expressions: structs ``(x1, y1, x2, y2)`` and arrays of them, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))


def from_xywh(x, y, w, h) -> Column:
    return box(x, y, x + w, y + h)


def from_center(cx, cy, w, h) -> Column:
    return box(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2)


def scaled(b: Column, sx, sy) -> Column:
    """Relative coordinates to absolute ones, or a grid's to pixels."""
    return box(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def floor_scaled(b: Column, scale: int) -> Column:
    return box(*[F.floor(b[c] / scale).cast("int") for c in ("x1", "y1", "x2", "y2")])


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def union_area(a: Column, b: Column) -> Column:
    return area(a) + area(b) - intersection(a, b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; null where both boxes are empty."""
    return F.try_divide(intersection(a, b).cast("double"), union_area(a, b).cast("double"))


def hull(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def giou_penalty(a: Column, b: Column) -> Column:
    """Share of the common hull that neither box covers; null for an empty hull."""
    whole = area(hull(a, b)).cast("double")
    return F.try_divide(whole - union_area(a, b), whole)


def giou(a: Column, b: Column) -> Column:
    return iou(a, b) - giou_penalty(a, b)


def giou_distance(a: Column, b: Column) -> Column:
    return 1 - giou(a, b)


def contains_point(b: Column, x, y) -> Column:
    """Half open: left and top edges belong to the box, right and bottom ones do not."""
    return (b["x1"] <= x) & (x < b["x2"]) & (b["y1"] <= y) & (y < b["y2"])


def in_any(boxes: Column, x, y) -> Column:
    return F.exists(boxes, lambda b: contains_point(b, x, y))


def within_area(boxes: Column, height, width, low: float = 0.001, high: float = 0.9) -> Column:
    """Boxes whose share of the image lies in [low, high]."""
    whole = (height * width).cast("double")
    return F.filter(boxes, lambda b: F.try_divide(area(b).cast("double"), whole).between(low, high))


def dilated(b: Column, height, width, part: int = 50) -> Column:
    """Rounded half to even, grown by a ``part``-th of the image on each side, clamped to it."""
    r = {c: F.bround(b[c].cast("double"), 0).cast("int") for c in ("x1", "y1", "x2", "y2")}
    dx, dy = F.floor(width / part).cast("int"), F.floor(height / part).cast("int")
    zero = F.lit(0)
    return box(
        F.greatest(r["x1"] - dx, zero), F.greatest(r["y1"] - dy, zero), F.least(r["x2"] + dx, width - 1), F.least(r["y2"] + dy, height - 1)
    )


def crops(boxes: Column, height, width) -> Column:
    """Dilated boxes over two pixels wide and high."""
    grown = F.transform(boxes, lambda b: dilated(b, height, width))
    return F.filter(grown, lambda b: (b["x2"] - b["x1"] > 2) & (b["y2"] - b["y1"] > 2))


def by_area(boxes: Column, descending: bool = True) -> Column:
    """Boxes in order of area; ties keep their order in the array."""
    keyed = F.transform(boxes, lambda b, i: F.struct((area(b) * (-1 if descending else 1)).alias("k"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(keyed), lambda s: s["b"])


def suppressed(detections: Column, threshold: float) -> Column:
    """Greedy suppression: ``(score, label, box)`` structs by falling score, ties in array order;
    one goes if a kept one overlaps it by more than ``threshold``. At 1 or more nothing goes.
    """
    keyed = F.transform(detections, lambda d, i: F.struct((-d["score"]).alias("k"), i.alias("i"), d.alias("d")))
    order = F.transform(F.array_sort(keyed), lambda s: s["d"])
    if threshold >= 1:
        return order

    def step(kept, d):
        over = F.exists(kept, lambda k: F.coalesce(iou(k["box"], d["box"]) > threshold, F.lit(False)))
        return F.when(over, kept).otherwise(F.array_append(kept, d))

    return F.aggregate(order, F.slice(order, 1, 0), step)


def merged(boxes: Column, overlap: float = 0.0, penalty: float = 0.1) -> Column:
    """Leader merge: by rising area, a box joins the first leader whose GIoU with it is over
    ``overlap`` or whose hull with it wastes under ``penalty``; else it leads. Comparison is
    with the leader itself. Returns the hull of each leader's boxes.
    """
    order = by_area(boxes, descending=False)
    state = F.transform(order, lambda b: F.struct(b.alias("seed"), b.alias("hull")))

    def step(groups, s):
        fits = lambda g: F.coalesce(giou(g["seed"], s["seed"]) > overlap, F.lit(False)) | F.coalesce(giou_penalty(g["seed"], s["seed"]) < penalty, F.lit(False))
        at = F.array_position(F.transform(groups, fits), True)
        put = F.transform(groups, lambda g, i: F.when(i + 1 == at, F.struct(g["seed"].alias("seed"), hull(g["hull"], s["hull"]).alias("hull"))).otherwise(g))
        return F.when(at > 0, put).otherwise(F.array_append(groups, s))

    return F.transform(F.aggregate(state, F.slice(state, 1, 0), step), lambda g: g["hull"])
