"""Boxes, quads and polygons as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = list[Column]


def iou(a: Box, b: Box) -> Column:
    """Overlap of two (x1, y1, x2, y2) boxes over their union; null where the union is empty."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    union = (area(a) + area(b) - w * h).cast("double")
    return F.when(union > 0, (w * h).cast("double") / union)


def letterbox(h: Column, w: Column, target_h: int, target_w: int) -> dict[str, Column]:
    """Ratio, resized shape and padding that fit an image into a target, split as evenly as pixels allow."""
    ratio = F.least(F.lit(float(target_h)) / h, F.lit(float(target_w)) / w)
    new_h, new_w = F.bround(h * ratio, 0).cast("int"), F.bround(w * ratio, 0).cast("int")
    half_h, half_w = (target_h - new_h) / 2, (target_w - new_w) / 2
    side = lambda x, nudge: F.bround(x + F.lit(nudge), 0).cast("int")
    return {
        "ratio": ratio, "new_h": new_h, "new_w": new_w,
        "top": side(half_h, -0.1), "bottom": side(half_h, 0.1), "left": side(half_w, -0.1), "right": side(half_w, 0.1),
    }


def centre_to_corners(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    """(centre, size) as corners."""
    return [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2]


def rescale(box: Box, ratio: Column, left: Column, top: Column) -> Box:
    """Back from a letterbox to the image: negatives to 0, half-even pixels."""
    shift = [left, top, left, top]
    return [F.bround(F.greatest((c - s) / ratio, F.lit(0.0)), 0).cast("int") for c, s in zip(box, shift, strict=True)]


def ordered_corners(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left, by sum and difference."""
    pick = lambda key, last: F.element_at(
        F.array_sort(F.transform(points, lambda p: F.struct(key(p).alias("key"), p.alias("p")))), -1 if last else 1
    )["p"]
    total, diff = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(pick(total, False), pick(diff, False), pick(total, True), pick(diff, True))


def expanded(points: Column, margin: float, width: Column, height: Column) -> Column:
    """Points moved away from their centroid by 2 * margin, kept within the image."""
    n = F.size(points)
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[c]) / n
    grow = 1 + 2 * margin
    move = lambda p, c, top: F.least(F.greatest(mean(c) + (p[c] - mean(c)) * grow, F.lit(0.0)), top)
    return F.transform(points, lambda p: F.struct(move(p, "x", width - 1).alias("x"), move(p, "y", height - 1).alias("y")))


def oriented_corners(cx: Column, cy: Column, w: Column, h: Column, angle: Column) -> list[tuple[Column, Column]]:
    """Corners of a rotated box."""
    c, s = F.cos(angle), F.sin(angle)
    return [(cx + dx * w / 2 * c - dy * h / 2 * s, cy + dx * w / 2 * s + dy * h / 2 * c) for dx, dy in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def polygon_area(points: Column) -> Column:
    """shoelace area; fewer than three points have none."""
    n = F.size(points)
    rolled = F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))
    cross = F.zip_with(points, rolled, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, x: a + x)) / 2).otherwise(0.0)


def polygon_centroid(points: Column) -> Column:
    """area-weighted centroid; the mean of the points where there is no area."""
    n = F.size(points)
    rolled = F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))
    cross = F.zip_with(points, rolled, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    moment = lambda c: F.zip_with(
        points, rolled, lambda p, q: (p[c] + q[c]) * (p["x"] * q["y"] - q["x"] * p["y"])
    )
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[c]) / n
    signed = total(cross) / 2
    at = lambda c: F.when((n >= 3) & (signed != 0), total(moment(c)) / (6 * signed)).otherwise(mean(c))
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def hausdorff(a: Column, b: Column) -> Column:
    """the farthest that a point of either set is from the other set; infinite if one is empty."""

    def one_way(p: Column, q: Column) -> Column:
        nearest = lambda m: F.array_min(F.transform(q, lambda n: F.hypot(m["x"] - n["x"], m["y"] - n["y"])))
        return F.array_max(F.transform(p, nearest))

    return F.when((F.size(a) == 0) | (F.size(b) == 0), float("inf")).otherwise(F.greatest(one_way(a, b), one_way(b, a)))


def resized(h: Column, w: Column, longest: int) -> tuple[Column, Column]:
    """Shape with the longest side at most ``longest``, never enlarged."""
    ratio = F.greatest(h, w) / F.lit(float(longest))
    return tuple(F.when(ratio > 1, F.floor(x / ratio)).otherwise(x).cast("int") for x in (h, w))


def angle_of(a: Column, b: Column) -> Column:
    """Direction from one point to another, in degrees from -180 to 180."""
    return F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"]))


def by_angle(points: Column) -> Column:
    """Points in the order of their direction from the centroid."""
    n = F.size(points)
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / n
    cx, cy = mean("x"), mean("y")
    keyed = F.array_sort(F.transform(points, lambda p: F.struct(F.atan2(p["y"] - cy, p["x"] - cx).alias("a"), p.alias("p"))))
    return F.transform(keyed, lambda k: k["p"])


def crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Where the lines through a, b and c, d meet; null if they are parallel."""
    det = (a["x"] - b["x"]) * (c["y"] - d["y"]) - (a["y"] - b["y"]) * (c["x"] - d["x"])
    p, q = a["x"] * b["y"] - a["y"] * b["x"], c["x"] * d["y"] - c["y"] * d["x"]
    x = F.try_divide(p * (c["x"] - d["x"]) - (a["x"] - b["x"]) * q, det)
    y = F.try_divide(p * (c["y"] - d["y"]) - (a["y"] - b["y"]) * q, det)
    return F.when(F.abs(det) > 1e-12, F.struct(x.alias("x"), y.alias("y")))


def foot(p: Column, a: Column, b: Column) -> Column:
    """The foot of the perpendicular from a point to the line through a and b; null if these are one."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.try_divide((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy, dx * dx + dy * dy)
    return F.when(t.isNotNull(), F.struct((a["x"] + t * dx).alias("x"), (a["y"] + t * dy).alias("y")))


def quad_of_longest(points: Column) -> Column:
    """The four corners in which the four longest sides of a polygon meet, in its order; null if two are parallel."""
    n = F.size(points)
    side = F.transform(points, lambda p, i: F.struct((-F.hypot(F.get(points, (i + 1) % n)["x"] - p["x"], F.get(points, (i + 1) % n)["y"] - p["y"])).alias("l"), i.alias("i"), p.alias("a"), F.get(points, (i + 1) % n).alias("b")))
    four = F.array_sort(F.transform(F.slice(F.array_sort(side), 1, 4), lambda s: F.struct(s["i"].alias("i"), s["a"].alias("a"), s["b"].alias("b"))))
    corners = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: crossing(F.get(four, k)["a"], F.get(four, k)["b"], F.get(four, (k + 1) % 4)["a"], F.get(four, (k + 1) % 4)["b"]))
    return F.when((n >= 4) & ~F.exists(corners, lambda c: c.isNull()), corners)
