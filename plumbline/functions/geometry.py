"""Planar geometry on Columns. A polygon is an array of struct(x, y), a segment a struct(x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kept import let


def _turned(points: Column) -> Column:
    """The points from the second on, then the first."""
    return F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def signed_area(points: Column) -> Column:
    """Shoelace area, positive counter-clockwise; 0 for fewer than three points. (F101)"""
    cross = lambda r: F.zip_with(r, _turned(r), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return let(points, lambda r: F.when(F.size(r) >= 3, _sum(cross(r)) / 2).otherwise(0.0))


def area(points: Column) -> Column:
    """(F100, F102)"""
    return F.abs(signed_area(points))


def perimeter(points: Column) -> Column:
    steps = lambda r: F.zip_with(r, _turned(r), lambda p, q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))
    return let(points, lambda r: F.when(F.size(r) >= 2, _sum(steps(r))).otherwise(0.0))


def area_m2(percent_points: Column, width_px: Column, height_px: Column, px_m: Column, manual: Column | None = None) -> Column:
    """Square metres of a polygon in percent of a page; a manual area above 0 wins. (F103-F105)"""
    px = F.transform(percent_points, lambda p: F.struct((p["x"] / 100 * width_px).alias("x"), (p["y"] / 100 * height_px).alias("y")))
    drawn = F.when(px_m > 0, area(px) / (px_m * px_m)).otherwise(0.0)
    return drawn if manual is None else F.when(manual > 0, manual).otherwise(drawn)


def contains(points: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a polygon, by ray casting. (F107)"""

    def crosses(p: Column, q: Column) -> Column:
        at = p["x"] + (y - p["y"]) * (q["x"] - p["x"]) / F.nullif(q["y"] - p["y"], F.lit(0.0))
        return F.when((p["y"] > y) != (q["y"] > y), x < at).otherwise(False)

    hits = lambda p: F.zip_with(p, _turned(p), crosses)
    return F.aggregate(let(points, hits), F.lit(False), lambda inside, hit: inside != hit)


def contained(inner: Column, outer: Column, samples: int = 8) -> Column:
    """Whether a polygon lies wholly in another: all corners, and so many places on every edge. (F109)

    As contains() of each place, with what it takes of the outer polygon's sides computed once for each row.
    """
    share = [F.lit(k / samples) for k in range(samples)]
    places = lambda p, q: F.array(*[F.struct((p["x"] + t * (q["x"] - p["x"])).alias("x"), (p["y"] + t * (q["y"] - p["y"])).alias("y")) for t in share])
    on_edges = let(inner, lambda p: F.flatten(F.zip_with(p, _turned(p), places)))
    side = lambda a, b: F.struct(a["x"].alias("x"), a["y"].alias("y"), b["y"].alias("ty"), (b["x"] - a["x"]).alias("dx"), F.nullif(b["y"] - a["y"], F.lit(0.0)).alias("dy"))
    sides = let(outer, lambda p: F.zip_with(p, _turned(p), side))
    meets = lambda s, p: F.when((s["y"] > p["y"]) != (s["ty"] > p["y"]), p["x"] < s["x"] + (p["y"] - s["y"]) * s["dx"] / s["dy"]).otherwise(False)
    held = lambda all_, p: F.aggregate(all_, F.lit(False), lambda inside, s: inside != meets(s, p))
    return F.coalesce((F.size(inner) >= 3) & let(sides, lambda s: F.forall(on_edges, lambda p: held(s, p))), F.lit(False))


def bbox(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def centroid(points: Column) -> Column:
    n = F.size(points)
    return F.struct((_sum(F.transform(points, lambda p: p["x"])) / n).alias("x"), (_sum(F.transform(points, lambda p: p["y"])) / n).alias("y"))


def length(s: Column) -> Column:
    return F.hypot(s["x2"] - s["x1"], s["y2"] - s["y1"])


def angle(s: Column) -> Column:
    """Degrees from 0 to 180."""
    return F.pmod(F.degrees(F.atan2(s["y2"] - s["y1"], s["x2"] - s["x1"])), F.lit(180.0))


def angle_delta(a: Column, b: Column) -> Column:
    """The difference of two directions, 0 to 90 degrees. (F118)"""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def circular_mean(degrees: Column) -> Column:
    """An aggregate: the mean direction mod 180. (F119)"""
    r = F.radians(degrees * 2)
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(r)), F.sum(F.cos(r)))) / 2, F.lit(180.0))


def line_distance(x: Column, y: Column, s: Column) -> Column:
    """From a point to the line through a segment. (F120)"""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    n = F.hypot(dx, dy)
    return F.when(n > 0, F.abs(dy * (x - s["x1"]) - dx * (y - s["y1"])) / n).otherwise(F.hypot(x - s["x1"], y - s["y1"]))


def along(x: Column, y: Column, s: Column) -> Column:
    """Position of a point's foot along a segment, in its length units. (F122)"""
    n = length(s)
    return F.when(n > 0, ((x - s["x1"]) * (s["x2"] - s["x1"]) + (y - s["y1"]) * (s["y2"] - s["y1"])) / n).otherwise(0.0)


def segment_distance(x: Column, y: Column, s: Column) -> Column:
    """(F121)"""
    n = length(s)
    t = F.when(n > 0, F.least(F.greatest(along(x, y, s) / n, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.hypot(x - (s["x1"] + t * (s["x2"] - s["x1"])), y - (s["y1"] + t * (s["y2"] - s["y1"])))


def intersection(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """struct(x, y, t, u) where two segments meet, t and u being the places on each; null if they don't. (F110)"""
    ax, ay, bx, by = a["x2"] - a["x1"], a["y2"] - a["y1"], b["x2"] - b["x1"], b["y2"] - b["y1"]
    cross = ax * by - ay * bx
    t = F.try_divide((b["x1"] - a["x1"]) * by - (b["y1"] - a["y1"]) * bx, cross)
    u = F.try_divide((b["x1"] - a["x1"]) * ay - (b["y1"] - a["y1"]) * ax, cross)
    inside = (F.abs(cross) > tolerance) & t.between(-tolerance, 1 + tolerance) & u.between(-tolerance, 1 + tolerance)
    return F.when(inside, F.struct((a["x1"] + t * ax).alias("x"), (a["y1"] + t * ay).alias("y"), t.alias("t"), u.alias("u")))


def box_faces(x: Column, y: Column, z: Column, width: Column, depth: Column, height: Column) -> Column:
    """The six faces of a mass with their areas. (F129)"""
    face = lambda name, a, b: F.struct(F.lit(name).alias("face"), (a * b).alias("area_m2"))
    return F.array(face("front", width, height), face("back", width, height), face("left", depth, height), face("right", depth, height), face("top", width, depth), face("bottom", width, depth))


def measured(kind: Column, s: Column, percent_points: Column, width_px: Column, height_px: Column, px_m: Column) -> Column:
    """struct(length_m, area_m2, perimeter_m) of a line or polygon in percent of a page. (F106)"""
    page = (width_px > 0) & (height_px > 0) & (px_m > 0)
    polygon = F.lower(kind) == "polygon"
    px = F.transform(percent_points, lambda p: F.struct((p["x"] / 100 * width_px).alias("x"), (p["y"] / 100 * height_px).alias("y")))
    line = F.hypot((s["x2"] - s["x1"]) / 100 * width_px, (s["y2"] - s["y1"]) / 100 * height_px) / px_m
    some = lambda c: F.when(page & c[0], c[1]).otherwise(0.0)
    closed = polygon & (F.size(percent_points) >= 3)
    return F.struct(some((~polygon, line)).alias("length_m"), some((closed, area(px) / (px_m * px_m))).alias("area_m2"), some((closed, perimeter(px) / px_m)).alias("perimeter_m"))


def calibrated_px_per_m(line: Column, metres: Column, width_px: Column, height_px: Column) -> Column:
    """Pixels a metre from a line in percent of a page and its length."""
    px = F.hypot((line["x2"] - line["x1"]) / 100 * width_px, (line["y2"] - line["y1"]) / 100 * height_px)
    return F.when((metres > 0) & (px > 0), px / metres)


def wall_metres(length_pt: Column, metres_per_mm: Column) -> Column:
    """Metres of a line in PDF points; null without a scale."""
    return length_pt * F.lit(25.4 / 72) * metres_per_mm


def opening_area(width: Column, height: Column) -> Column:
    """Null unless both sides are positive. (F134)"""
    return F.when((width > 0) & (height > 0), width * height)


def opening_fits(position: Column, width: Column, sill: Column, height: Column, wall_length: Column, wall_height: Column) -> Column:
    """Why an opening doesn't fit its wall, null if it does."""
    return F.when(~F.coalesce((wall_length > 0) & (wall_height > 0), F.lit(False)), "wall_invalid").when(~F.coalesce((width > 0) & (height > 0), F.lit(False)), "opening_invalid").when((position < 0) | (position + width > wall_length + 1e-6), "outside_length").when((sill < 0) | (sill + height > wall_height + 1e-6), "outside_height")


def opening_sized(width: Column, height: Column) -> Column:
    """The band of sizes that openings have."""
    return F.coalesce(width.between(0.3, 6.0) & height.between(0.3, 5.0), F.lit(False))


def opening_box(wall: Column, position: Column, width: Column, sill: Column, height: Column) -> Column:
    """struct of the opening's corners in space, along its wall. (F135)"""
    n = length(wall)
    at = lambda d, a: wall[f"{a}1"] + (wall[f"{a}2"] - wall[f"{a}1"]) * d / n
    end = position + width
    return F.when(n > 0, F.struct(at(position, "x").alias("x0"), at(position, "y").alias("y0"), at(end, "x").alias("x1"), at(end, "y").alias("y1"), sill.alias("z0"), (sill + height).alias("z1")))


def clamped_box(b: Column, width: Column, height: Column) -> Column:
    """A box with its corners in order and inside its page. (F138)"""
    lo = lambda p, q, top: F.least(F.greatest(F.least(b[p], b[q]), F.lit(0.0)), top)
    hi = lambda p, q, top: F.least(F.greatest(F.greatest(b[p], b[q]), F.lit(0.0)), top)
    return F.struct(lo("x0", "x1", width).alias("x0"), lo("y0", "y1", height).alias("y0"), hi("x0", "x1", width).alias("x1"), hi("y0", "y1", height).alias("y1"))
