"""Surfaces, rooms and facades: what a polygon belongs to, what counts as a room, what a footprint shows to each side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry
from ..scratch import shuffled

#: Bounds of rooms.
ROOM_LEAST_M2, ROOM_SOFT_M2, ROOM_MOST_M2, LONGEST, PAGE_SHARE, OUTLINE_SHARE, TITLE_X, TITLE_Y = 0.3, 1.0, 2500.0, 12.0, 0.75, 0.5, 0.60, 0.85
SAMPLES = 14  # columns and rows of the grid that measures an overlap
PAIRS = 1024  # pairs of polygons whose grids are looked at together
POINTS = "array<struct<x:double,y:double>>"


def _close(df: DataFrame, other: DataFrame, cell: float, margin: float) -> DataFrame:
    """Pairs of polygons of a page whose boxes, one widened by a margin, share a grid cell. Columns: id, points; other_id, other."""

    def tiled(d: DataFrame, m: float) -> DataFrame:
        box = geometry.bbox(F.col("points"))
        span = lambda a, b: F.sequence(F.floor((box[a] - m) / cell), F.floor((box[b] + m) / cell))
        return d.select("page_id", "id", "points", F.explode(span("x0", "x1")).alias("cx"), span("y0", "y1").alias("cys")).withColumn("cy", F.explode("cys")).drop("cys")

    right = tiled(other, margin).select("page_id", "cx", "cy", F.col("id").alias("other_id"), F.col("points").alias("other"))
    return tiled(df, 0.0).join(shuffled(right), ["page_id", "cx", "cy"]).drop("cx", "cy").dropDuplicates(["page_id", "id", "other_id"])


def overlap_ratio(a: Column, b: Column, n: int = SAMPLES) -> Column:
    """The share of a that lies in b, on a grid of n by n points over a's box. (F108)"""
    udf = F.pandas_udf(lambda *c: _shares(*c, n=n), "double")
    each = lambda p, k: F.transform(p, lambda q: q[k].cast("double"))
    return udf(*[each(p, k) for p in (a, b) for k in ("x", "y")])


def _shares(ax: pd.Series, ay: pd.Series, bx: pd.Series, by: pd.Series, n: int) -> pd.Series:
    """overlap_ratio() of many pairs: the points of all their grids are held against an edge of each polygon at a time."""

    def corners(*columns: pd.Series) -> list[np.ndarray]:
        """A row of corners for each polygon, the last repeated to equal length: such sides have no length."""
        most = max(1, max(0 if v is None else len(v) for v in columns[0]))
        filled = lambda v: np.full(most, np.nan) if v is None or not len(v) else np.pad(np.asarray(v, float), (0, most - len(v)), "edge")
        return [np.stack([filled(v) for v in c]) for c in columns]

    def holds(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """As geometry.contains()."""
        inside = np.zeros(x.shape, bool)
        for k in range(px.shape[1]):
            p_x, p_y, q_x, q_y = (c[:, [j]] for j in (k, (k + 1) % px.shape[1]) for c in (px, py))
            inside ^= ((p_y > y) != (q_y > y)) & (x < p_x + (y - p_y) * (q_x - p_x) / (q_y - p_y))
        return inside

    out, at = [], np.arange(n) + 0.5
    with np.errstate(all="ignore"):
        for k in range(0, len(ax), PAIRS):
            a_x, a_y = corners(ax[k : k + PAIRS], ay[k : k + PAIRS])
            low_x, low_y, high_x, high_y = (f(c, axis=1, keepdims=True) for f in (np.fmin.reduce, np.fmax.reduce) for c in (a_x, a_y))
            x, y = np.repeat(low_x + at * (high_x - low_x) / n, n, axis=1), np.tile(low_y + at * (high_y - low_y) / n, n)
            inside = holds(a_x, a_y, x, y)
            both = inside & holds(*corners(bx[k : k + PAIRS], by[k : k + PAIRS]), x, y)
            out.append(both.sum(axis=1) / np.maximum(1, inside.sum(axis=1)))
    return pd.Series(np.concatenate(out) if out else [], dtype=float)


def associate(surfaces: DataFrame, targets: DataFrame, proximity: float = 50.0) -> DataFrame:
    """The best target of each surface: contained, mostly inside, partly inside, by centre, near.

    surfaces and targets: page_id, id, points. A surface without a target near it isn't in the result.
    """
    c, t = geometry.centroid(F.col("points")), geometry.centroid(F.col("other"))
    pairs = _close(surfaces, targets, 4 * proximity, proximity).withColumn("overlap", overlap_ratio(F.col("points"), F.col("other")))
    corners = F.forall("points", lambda p: geometry.contains(F.col("other"), p["x"], p["y"]))
    distance = F.hypot(c["x"] - t["x"], c["y"] - t["y"])
    o = F.col("overlap")
    method = F.when(corners & (o >= 0.999), "containment").when(o >= 0.5, "majority_overlap").when(o >= 0.2, "intersection").when(geometry.contains(F.col("other"), c["x"], c["y"]), "centroid").when(distance <= proximity, "proximity")
    m = F.col("method")
    confidence = F.when(m == "containment", 0.95).when(m == "majority_overlap", 0.75 + 0.20 * (o - 0.5)).when(m == "intersection", 0.50 + 0.25 * (o - 0.2)).when(m == "centroid", 0.40).otherwise(F.greatest(F.lit(0.1), 0.35 * (1 - distance / proximity)))
    scored = pairs.withColumn("method", method).withColumn("confidence", confidence)
    # What has no method is left out of the minimum and not before it: a filter would be moved under the overlap and measure it again.
    rank = F.struct((-F.col("confidence")).alias("k"), F.col("other_id").alias("target_id"), "method", "overlap")
    best = scored.groupBy("page_id", "id").agg(F.min(F.when(m.isNotNull(), rank)).alias("b")).filter("b is not null")
    return best.select("page_id", "id", F.col("b.target_id").alias("target_id"), F.col("b.method").alias("method"), F.round("b.overlap", 4).alias("overlap"), (-F.col("b.k")).alias("confidence"))


def rooms(faces: DataFrame) -> DataFrame:
    """Which faces are rooms, and why not; what lowers the confidence in those that are.

    faces: page_id, id, points, m_per_pt, page_width, page_height, label.
    """
    pts = F.col("points")
    size = faces.groupBy("page_id").agg(F.count("*").alias("n_faces"))
    centres = faces.select("page_id", F.col("id").alias("other_id"), geometry.centroid(pts).alias("c"), geometry.area(pts).alias("other_area"))
    box = geometry.bbox(pts)
    cell = 200.0
    tiles = faces.select("page_id", "id", "points", F.explode(F.sequence(F.floor(box["x0"] / cell), F.floor(box["x1"] / cell))).alias("cx")).withColumn("cy", F.explode(F.sequence(F.floor(box["y0"] / cell), F.floor(box["y1"] / cell))))
    placed = centres.withColumn("cx", F.floor(F.col("c.x") / cell)).withColumn("cy", F.floor(F.col("c.y") / cell))
    inside = tiles.join(shuffled(placed), ["page_id", "cx", "cy"]).filter("id <> other_id").filter(geometry.contains(pts, F.col("c.x"), F.col("c.y")))
    held = inside.groupBy("page_id", "id").agg(F.count("*").alias("holds"), F.max(F.col("other_area") / geometry.area(pts)).alias("largest_inside"))
    d = faces.join(shuffled(size), "page_id").join(shuffled(held), ["page_id", "id"], "left").fillna({"holds": 0, "largest_inside": 0.0})
    pt2 = geometry.area(pts)
    m2 = pt2 * F.col("m_per_pt") * F.col("m_per_pt")
    w, h = box["x1"] - box["x0"], box["y1"] - box["y0"]
    long = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1e-9))
    labelled = F.coalesce(F.trim("label"), F.lit("")) != ""
    in_title = ((box["x0"] + box["x1"]) / 2 > TITLE_X * F.col("page_width")) & ((box["y0"] + box["y1"]) / 2 > TITLE_Y * F.col("page_height"))
    reason = F.when(F.size(pts) < 3, "degenerate").when(F.col("m_per_pt").isNull(), "un_calibrated").when(m2 < ROOM_LEAST_M2, "too_small").when(m2 > ROOM_MOST_M2, "too_large").when(in_title, "in_title_block_zone")
    reason = reason.when(pt2 > PAGE_SHARE * F.col("page_width") * F.col("page_height"), "covers_page").when((F.col("n_faces") > 1) & (F.col("holds") > OUTLINE_SHARE * F.col("n_faces")), "building_outline")
    reason = reason.when((m2 < ROOM_SOFT_M2) & ~labelled, "small_unlabeled").when((long > LONGEST) & ~labelled, "elongated_unlabeled")
    voids = F.col("largest_inside") > 0.01
    adjust = F.when(m2 < ROOM_SOFT_M2, -0.15).otherwise(0.0) + F.when(long > LONGEST, -0.10).otherwise(0.0) + F.when(voids, -0.20).otherwise(0.0)
    return d.select("page_id", "id", "label", m2.alias("area_m2"), reason.isNull().alias("is_room"), reason.alias("reason"), F.when(reason.isNull(), adjust).otherwise(0.0).alias("confidence_adjustment"), voids.alias("has_voids"))


def room_rows(found: DataFrame, with_ceiling: bool = False) -> DataFrame:
    """One take-off row a room for its floor and, if wanted, one for its ceiling."""
    row = lambda element, role: F.struct(F.lit(element).alias("element"), F.lit(role).alias("row_role"))
    kinds = F.array(row("Floor area", "floor_area"), *([row("Ceiling", "")] if with_ceiling else []))
    return found.filter("is_room").select("page_id", "id", F.coalesce("label", F.lit("Room")).alias("location"), F.lit("m²").alias("unit"), F.bround("area_m2", 3).alias("quantity"), F.inline(kinds))


def facades(footprints: DataFrame) -> DataFrame:
    """Edges of footprints by the side that they face: length and projected width. footprints: building_id, level, points."""
    p = F.col("points")
    turned = F.concat(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, 1))
    edges = footprints.filter(F.size(p) >= 3).select("building_id", "level", F.signum(geometry.signed_area(p)).alias("turn"), F.explode(F.arrays_zip(p.alias("a"), turned.alias("b"))).alias("e"))
    dx, dy = F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")
    s = F.when(F.col("turn") >= 0, 1).otherwise(-1)
    nx, ny = s * dy, -s * dx
    side = F.when(F.abs(nx) >= F.abs(ny), F.when(nx > 0, "East").otherwise("West")).otherwise(F.when(ny > 0, "North").otherwise("South"))
    named = edges.withColumn("side", side).withColumn("length_m", F.hypot(dx, dy)).filter("length_m > 0.02")
    lengths = named.groupBy("building_id", "side").agg(F.round(F.sum("length_m"), 4).alias("edge_length_m"), F.count("*").alias("edges"), F.array_sort(F.collect_set("level")).alias("levels"))
    box = geometry.bbox(p)
    whole = footprints.groupBy("building_id").agg((F.max(box["x1"]) - F.min(box["x0"])).alias("wx"), (F.max(box["y1"]) - F.min(box["y0"])).alias("wy"))
    return lengths.join(whole, "building_id").withColumn("projected_width_m", F.round(F.when(F.col("side").isin("North", "South"), F.col("wx")).otherwise(F.col("wy")), 4)).drop("wx", "wy")


def wall_cells(walls: DataFrame, openings: DataFrame) -> DataFrame:
    """Walls cut into rectangles that no opening covers: wall_ref, x0, x1, z0, z1.

    walls: wall_ref, width, height. openings: wall_ref, x0, x1, z0, z1.
    """
    box = F.collect_list(F.struct("x0", "x1", "z0", "z1")).alias("holes")
    d = walls.join(openings.groupBy("wall_ref").agg(box), "wall_ref", "left").withColumn("holes", F.coalesce("holes", F.array().cast("array<struct<x0:double,x1:double,z0:double,z1:double>>")))

    def cuts(a: str, b: str, top: str) -> Column:
        ends = F.flatten(F.transform("holes", lambda o: F.array(o[a], o[b])))
        inside = F.transform(ends, lambda v: F.greatest(F.lit(0.0), F.least(F.col(top), v)))
        return F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.col(top)), inside)))

    steps = lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda k: F.struct(F.element_at(c, k).alias("lo"), F.element_at(c, k + 1).alias("hi")))
    d = d.withColumn("xs", cuts("x0", "x1", "width")).withColumn("zs", cuts("z0", "z1", "height")).filter("width > 0 and height > 0")
    cells = d.select("wall_ref", "holes", "zs", F.explode(steps(F.col("xs"))).alias("x")).select("wall_ref", "holes", "x", F.explode(steps(F.col("zs"))).alias("z"))
    cx, cz = (F.col("x.lo") + F.col("x.hi")) / 2, (F.col("z.lo") + F.col("z.hi")) / 2
    free = ~F.exists("holes", lambda o: cx.between(o["x0"], o["x1"]) & cz.between(o["z0"], o["z1"]))
    return cells.filter(free).select("wall_ref", F.col("x.lo").alias("x0"), F.col("x.hi").alias("x1"), F.col("z.lo").alias("z0"), F.col("z.hi").alias("z1"))


def extents(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Bounds of each key's elements. elements: keys, x, y, z."""
    return elements.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))])


def spacing(strokes: DataFrame, keys: list[str], least_gap: float = 0.5) -> DataFrame:
    """Mean and variance of the gaps between offsets of parallel strokes. strokes: keys, offset."""
    w = W.partitionBy(*keys).orderBy("offset")
    gaps = strokes.withColumn("gap", F.col("offset") - F.lag("offset").over(w)).filter(F.col("gap") > least_gap)
    return gaps.groupBy(*keys).agg(F.avg("gap").alias("spacing"), F.var_pop("gap").alias("spacing_variance"), F.count("*").alias("gaps"))


def hulls(points: DataFrame, key: str) -> DataFrame:
    """The convex hull of each key's points, counter-clockwise from the least point. points: key, x, y. (F113, F114)

    Points are first cut to the lowest and highest of each x, which loses no corner, before a key's hull is walked.
    """

    def hull(xs: np.ndarray, ys: np.ndarray) -> list:
        p = list(zip(map(float, xs), map(float, ys), strict=True))
        if len(p) > 2:
            half = []
            for q in (p, p[::-1]):
                chain: list[tuple[float, float]] = []
                for c in q:
                    while len(chain) > 1 and (chain[-1][0] - chain[-2][0]) * (c[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (c[0] - chain[-2][0]) <= 0:
                        chain.pop()
                    chain.append(c)
                half += chain[:-1]
            p = half
        return [{"x": x, "y": y} for x, y in p]

    walk = F.pandas_udf(lambda x, y: pd.Series([hull(*p) for p in zip(x, y, strict=True)], dtype=object), POINTS)
    coordinate = lambda c: F.transform("p", lambda q: q[c].cast("double"))
    ends = points.groupBy(key, "x").agg(F.array_distinct(F.array(F.min("y"), F.max("y"))).alias("ys")).select(key, "x", F.explode("ys").alias("y"))
    sorted_ = ends.groupBy(key).agg(F.array_sort(F.array_distinct(F.collect_list(F.struct("x", "y")))).alias("p"))
    return sorted_.select(key, walk(coordinate("x"), coordinate("y")).alias("points"))


def simplify(points: pd.Series, epsilon: float) -> pd.Series:
    """Ramer-Douglas-Peucker on each row's points, without recursion. (F125)"""

    def one(rows) -> list:
        p = np.array([(r["x"], r["y"]) for r in rows], float)
        keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            d = p[b] - p[a]
            n = float(np.hypot(*d))
            off = p[a + 1 : b] - p[a]
            dist = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / n if n else np.hypot(off[:, 0], off[:, 1])
            k = int(dist.argmax())
            if dist[k] > epsilon:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return [{"x": float(p[k][0]), "y": float(p[k][1])} for k in sorted(keep)] if len(p) else []

    return points.map(one)


def simplified(df: DataFrame, column: str, epsilon: float) -> DataFrame:
    udf = F.pandas_udf(lambda s: simplify(s, epsilon), POINTS)
    return df.withColumn(column, udf(F.col(column)))


#: Kinds of sheets, and words, that painting is or isn't taken from.
DROPPED = ("Civil", "Structural", "Hydraulic", "Electrical", "Mechanical", "Landscape", "Survey")
KEPT = ("Floor Plan", "Elevation", "Section", "Reflected Ceiling Plan", "Finish Schedule", "Door / Window Schedule")
ROOF_WORDS = ("eave", "soffit", "fascia")


def page_relevance(page_type: Column, words: Column) -> Column:
    """struct(keep, score)."""
    kind, low = F.coalesce(F.trim(page_type), F.lit("Other")), F.lower(F.coalesce(words, F.lit("")))
    out = lambda keep, score: F.struct(keep.alias("keep"), F.lit(score).alias("score"))
    roof, paint = low.rlike("|".join(ROOF_WORDS)), low.rlike("paint|finish|coating|render|plasterboard|ceiling|facade")
    no, yes = F.lit(False), F.lit(True)
    ladder = F.when(kind.isin(*DROPPED), out(no, 0)).when(kind.isin(*KEPT), out(yes, 100)).when((kind == "Roof Plan") & roof, out(yes, 70)).when(kind == "Roof Plan", out(no, 10))
    return ladder.when(kind == "Title / Drawing Register", out(no, 20)).when(paint, out(yes, 60)).otherwise(out(no, 5))


def in_scope(scope: str) -> Column:
    """Whether a take-off row belongs to a quick scope."""
    t = lambda *cs: F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cs]))
    element, finish, wide = t("element"), t("element", "finish_system", "substrate"), t("section", "element", "substrate", "finish_system")
    rules = {
        "ceilings": finish.contains("ceiling") & ~element.rlike("wall|door|frame"),
        "internal_walls": element.contains("wall") & ~wide.rlike("external|cladding"),
        "doors": wide.rlike("door|frame|architrave|jamb"),
        "external": wide.rlike("external|cladding|render|facade|façade") & ~wide.rlike("soffit|eave"),
        "soffits": wide.rlike("soffit|eave"),
    }
    return rules.get(scope, F.lit(True))


def commercial_line(base: Column, factor: Column, deduction: Column, adjustment_pct: Column) -> Column:
    """struct(gross, net): net is the gross less deductions, adjusted, never below 0."""
    zero = F.lit(0.0)
    gross = F.greatest(zero, base) * F.greatest(zero, factor)
    net = F.greatest(zero, (gross - F.greatest(zero, deduction)) * (1 + adjustment_pct / 100))
    return F.struct(F.bround(gross, 3).alias("gross"), F.bround(net, 3).alias("net"))


def rectangles(lines: DataFrame, tolerance: float = 1.5, least: float = 5.0) -> DataFrame:
    """Rectangles that two horizontal and two vertical lines of a page close: page_id, x0, y0, x1, y1.

    lines: page_id, axis (h or v), fixed, lo, hi, already merged. A pair of verticals is closed by horizontals that
    reach both and on which both reach; corners meet within the tolerance, found through buckets of it.
    """
    h = lines.filter("axis = 'h'").select("page_id", F.col("fixed").alias("y"), F.col("lo").alias("hx0"), F.col("hi").alias("hx1"))
    v = lines.filter("axis = 'v'").select("page_id", F.col("fixed").alias("x"), F.col("lo").alias("vy0"), F.col("hi").alias("vy1"))
    cell = 64 * tolerance
    hs = h.withColumn("cx", F.explode(F.sequence(F.floor((F.col("hx0") - tolerance) / cell), F.floor((F.col("hx1") + tolerance) / cell)))).withColumn("cy", F.floor(F.col("y") / cell))
    vs = v.withColumn("cy", F.explode(F.sequence(F.floor((F.col("vy0") - tolerance) / cell), F.floor((F.col("vy1") + tolerance) / cell)))).withColumn("cx", F.floor(F.col("x") / cell))
    meet = hs.join(vs, ["page_id", "cx", "cy"]).filter(F.col("x").between(F.col("hx0") - tolerance, F.col("hx1") + tolerance) & F.col("y").between(F.col("vy0") - tolerance, F.col("vy1") + tolerance))
    corner = meet.select("page_id", F.struct("y", "hx0", "hx1").alias("h"), F.struct("x", "vy0", "vy1").alias("v"))
    # Neighbouring crossings along each horizontal are the sides; a rectangle is the same pair of verticals on the next horizontal.
    along = W.partitionBy("page_id", "h").orderBy(F.col("v.x"))
    sides = corner.withColumn("right", F.lead("v").over(along)).filter("right is not null")
    up = W.partitionBy("page_id", F.col("v"), F.col("right")).orderBy(F.col("h.y"))
    closed = sides.withColumn("top", F.lead("h").over(up)).filter("top is not null")
    out = closed.select("page_id", F.col("v.x").alias("x0"), F.col("h.y").alias("y0"), F.col("right.x").alias("x1"), F.col("top.y").alias("y1"))
    return out.filter((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))


def code_targets(codes: DataFrame, targets: DataFrame, proximity: float = 30.0) -> DataFrame:
    """The polygon that a finish code's place lies in, else the nearest by centre. codes: page_id, id, x, y."""
    box = geometry.bbox(F.col("points"))
    cell = 4 * proximity
    span = lambda a, b: F.sequence(F.floor((box[a] - proximity) / cell), F.floor((box[b] + proximity) / cell))
    tiles = targets.select("page_id", F.col("id").alias("target_id"), "points", F.explode(span("x0", "x1")).alias("cx"), span("y0", "y1").alias("cys")).withColumn("cy", F.explode("cys")).drop("cys")
    met = codes.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell)).join(shuffled(tiles), ["page_id", "cx", "cy"])
    c = geometry.centroid(F.col("points"))
    inside, d = geometry.contains(F.col("points"), F.col("x"), F.col("y")), F.hypot(F.col("x") - c["x"], F.col("y") - c["y"])
    near = met.withColumn("inside", inside).withColumn("distance", d).filter(F.col("inside") | (F.col("distance") <= proximity))
    best = near.groupBy("page_id", "id").agg(F.min(F.struct((~F.col("inside")).alias("o"), geometry.area(F.col("points")).alias("a"), "distance", "target_id")).alias("b"))
    return best.select("page_id", "id", F.col("b.target_id").alias("target_id"), (~F.col("b.o")).alias("inside"))


def unit_boundaries(contours: DataFrame, labels: DataFrame) -> DataFrame:
    """For each unit label the largest contour that holds it and no other. contours: page_id, id, points; labels: page_id, label, x, y."""
    box = geometry.bbox(F.col("points"))
    met = contours.withColumn("box", box).join(shuffled(labels), "page_id").filter(F.col("x").between(F.col("box.x0"), F.col("box.x1")) & F.col("y").between(F.col("box.y0"), F.col("box.y1")))
    held = met.filter(geometry.contains(F.col("points"), F.col("x"), F.col("y"))).groupBy("page_id", "id").agg(F.count_distinct("label").alias("n"), F.min("label").alias("label"), F.max(geometry.area(F.col("points"))).alias("area"))
    best = held.filter("n = 1").groupBy("page_id", "label").agg(F.max(F.struct("area", (-F.xxhash64("id")).alias("k"), "id")).alias("b"))
    return best.select("page_id", "label", F.col("b.id").alias("id"), F.col("b.area").alias("area"))


def triangles(points: pd.Series) -> pd.Series:
    """Each row's polygon as triangles, by cutting ears. (F123)"""

    def one(rows) -> list:
        p = [(float(r["x"]), float(r["y"])) for r in rows]
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        ring = list(range(len(p)))
        if sum(p[k][0] * p[(k + 1) % len(p)][1] - p[(k + 1) % len(p)][0] * p[k][1] for k in ring) < 0:
            ring.reverse()
        out = []
        while len(ring) > 3:
            for k in range(len(ring)):
                a, b, c = p[ring[k - 1]], p[ring[k]], p[ring[(k + 1) % len(ring)]]
                if turn(a, b, c) > 0 and not any(q not in (a, b, c) and turn(a, b, q) >= 0 and turn(b, c, q) >= 0 and turn(c, a, q) >= 0 for q in (p[j] for j in ring)):
                    out.append((a, b, c))
                    ring.pop(k)
                    break
            else:
                return []  # crosses itself
        out += [tuple(p[k] for k in ring)] if len(ring) == 3 else []
        return [[{"x": x, "y": y} for x, y in t] for t in out]

    return points.map(one)


def triangulated(df: DataFrame, column: str) -> DataFrame:
    """(F123, F124)"""
    return df.withColumn("triangles", F.pandas_udf(triangles, f"array<{POINTS}>")(F.col(column)))


#: How much a page's kind counts as a source of floor areas.
FLOOR_SOURCES = (("area schedule", 500), ("unit plan", 450), ("floor plan", 320), ("site plan", 220))


def floor_priority(words: Column) -> Column:
    """(F54)"""
    low, out = F.lower(F.coalesce(words, F.lit(""))), None
    for word, rank in FLOOR_SOURCES:
        out = F.when(low.contains(word), rank) if out is None else out.when(low.contains(word), rank)
    return out.otherwise(0)
