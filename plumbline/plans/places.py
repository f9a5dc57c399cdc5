"""Driver queries: drawings, walls, rooms and openings laid out of the tables' numbers on a plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, pricing, text
from ..operators import assembly, drawing, elevations, evidence, openings, pages, surfaces
from ..scratch import shuffled
from ..sources import readers
from .shared import choice, dealt, key, pick, query, table


def orders(spark, sf):
    return dealt(spark, sf, "orders", "o_orderkey")


def few(spark, sf):
    """The suppliers, for what takes long for each row, numbered as orders are."""
    return dealt(spark, sf, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("o_orderkey"))


FEW = "(SELECT s_suppkey AS o_orderkey FROM supplier) s"


def box(x0, y0, x1, y1):
    """A rectangle's corners, counter-clockwise."""
    c = [x if hasattr(x, "alias") else F.lit(float(x)) for x in (x0, y0, x1, y1)]
    at = lambda a, b: F.struct(c[a].cast("double").alias("x"), c[b].cast("double").alias("y"))
    return F.array(at(0, 1), at(2, 1), at(2, 3), at(0, 3))


@query("""WITH o AS (SELECT o_orderkey AS id, (1 + o_orderkey % 50)::DOUBLE AS w, (2 + o_orderkey % 7)::DOUBLE AS h FROM orders)
 SELECT id, round(w * h, 6) AS area, round(2 * (w + h), 6) AS perimeter, round(w / 100 * 1000 * h / 100 * 500 / 2500, 6) AS page_m2, CASE WHEN id % 4 = 0 THEN 7.0 ELSE round(w / 100 * 1000 * h / 100 * 500 / 2500, 6) END AS boxed_m2,
 round(w * 10 / 50, 6) AS line_m, w > 10 AND h > 3 AS holds, round(10 * sqrt(w * w + h * h) / 4, 6) AS px_per_m, CASE WHEN id % 3 = 0 THEN w * h ELSE 3 END AS space_m2 FROM o""")
def q_measures(spark, sf):
    """Areas and lengths of shapes, drawn and in percent of a page. (F102-F106, F92, F109, F132, F133)"""
    w, h = (1 + key() % 50).cast("double"), (2 + key() % 7).cast("double")
    d, p = F.lit, box(0, 0, w, h)
    seg = F.struct(d(0.0).alias("x1"), d(0.0).alias("y1"), w.alias("x2"), d(0.0).alias("y2"))
    diagonal = F.struct(d(0.0).alias("x1"), d(0.0).alias("y1"), w.alias("x2"), h.alias("y2"))
    page = geometry.area_m2(p, d(1000.0), d(500.0), d(50.0))
    line = geometry.measured(d("line"), seg, p, d(1000.0), d(500.0), d(50.0))["length_m"]
    return orders(spark, sf).select(
        key().alias("id"), F.round(geometry.area(p), 6).alias("area"), F.round(geometry.perimeter(p), 6).alias("perimeter"), F.round(page, 6).alias("page_m2"), F.round(geometry.area_m2(p, d(1000.0), d(500.0), d(50.0), F.when(key() % 4 == 0, 7.0)), 6).alias("boxed_m2"),
        F.round(line, 6).alias("line_m"), geometry.contained(box(1, 1, 10, 3), p).alias("holds"), F.round(geometry.calibrated_px_per_m(diagonal, d(4.0), d(1000.0), d(1000.0)), 6).alias("px_per_m"), assembly.space_area(F.when(key() % 3 == 0, w * h), d(3.0)).alias("space_m2"))


@query("""WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 40) / 10.0::DOUBLE AS p, 0.2 + (o_orderkey % 30) / 10.0::DOUBLE AS w, 1 + (o_orderkey % 20) / 10.0::DOUBLE AS h FROM orders)
 SELECT id, round(w * h, 6) AS area, CASE WHEN p + w > 4 + 1e-6 THEN 'outside_length' WHEN 0.5 + h > 2.7 + 1e-6 THEN 'outside_height' END AS problem, w >= 0.3 AND w <= 6 AND h >= 0.3 AND h <= 5 AS sized, round(p, 6) AS x0, round(p + w, 6) AS x1, round(0.5 + h, 6) AS z1, least(3, w)::DOUBLE AS clamped, CASE WHEN w * h >= 0.5 THEN round(w * h, 6) ELSE 0 END AS deducted, w >= 0.3 AND h >= 0.3 AND id % 2 = 0 AS qualified FROM o""")
def q_opening_geometry(spark, sf):
    """Openings on their walls: area, fit, size, place in space. (P21, P22, P27-P29, F81, F134, F135, F138)"""
    p, w, h = (key() % 40) / 10.0, 0.2 + (key() % 30) / 10.0, 1 + (key() % 20) / 10.0
    d = F.lit
    wall = F.struct(d(0.0).alias("x1"), d(0.0).alias("y1"), d(4.0).alias("x2"), d(0.0).alias("y2"))
    b = geometry.opening_box(wall, p, w, d(0.5), h)
    clamp = geometry.clamped_box(F.struct(w.alias("x0"), d(1.0).alias("y0"), d(-1.0).alias("x1"), d(0.0).alias("y1")), d(3.0), d(3.0))
    cand = orders(spark, sf).withColumns({"width_m": w, "height_m": h, "dimensional": d(True), "coord_space": d("page"), "calibration_space": F.when(key() % 2 == 0, "page").otherwise("crop")})
    area = geometry.opening_area(w, h)
    return cand.select(key().alias("id"), F.round(area, 6).alias("area"), geometry.opening_fits(p, w, d(0.5), h, d(4.0), d(2.7)).alias("problem"), geometry.opening_sized(w, h).alias("sized"), F.round(b["x0"], 6).alias("x0"), F.round(b["x1"], 6).alias("x1"), F.round(b["z1"], 6).alias("z1"), clamp["x1"].alias("clamped"), F.round(pricing.deduction(area, d("window")), 6).alias("deducted"), drawing.qualified(cand).alias("qualified"))


@query(f"""WITH o AS (SELECT o_orderkey AS page_id, (o_orderkey % 5) AS k FROM {FEW}) SELECT page_id, 'a' AS id, CASE WHEN k < 3 THEN 't1' ELSE 't2' END AS target_id, CASE k WHEN 0 THEN 'containment' WHEN 1 THEN 'majority_overlap' WHEN 2 THEN 'intersection' WHEN 3 THEN 'containment' ELSE 'proximity' END AS method FROM o""")
def q_associate(spark, sf):
    """What a surface belongs to. (J13, J14, F108)"""
    # t1 is (0, 0)-(100, 100), t2 (1000, 0)-(1100, 100); a lies inside, half over, a quarter over, in t2, beside t2.
    x = pick([F.lit(v) for v in (10.0, 70.0, 86.0, 1010.0, 1105.0)], key())
    wide = pick([F.lit(v) for v in (50.0, 50.0, 50.0, 50.0, 10.0)], key())
    a = few(spark, sf).select(key().alias("page_id"), F.lit("a").alias("id"), box(x, 10, x + wide, 60).alias("points"))
    t = few(spark, sf).select(key().alias("page_id"), F.inline(F.array(F.struct(F.lit("t1").alias("id"), box(0, 0, 100, 100).alias("points")), F.struct(F.lit("t2").alias("id"), box(1000, 0, 1100, 100).alias("points")))))
    return surfaces.associate(a, t, 70.0).select("page_id", "id", "target_id", "method")


@query("""WITH o AS (SELECT o_orderkey AS page_id, o_orderkey % 4 AS k FROM orders), f AS (SELECT page_id, 'room' AS id, true AS is_room, NULL AS reason, 25.0::DOUBLE AS area_m2 FROM o UNION ALL SELECT page_id, 'tiny', false, 'too_small', 0.01 FROM o
 UNION ALL SELECT page_id, 'extra', k = 3, CASE k WHEN 0 THEN 'elongated_unlabeled' WHEN 1 THEN 'in_title_block_zone' WHEN 2 THEN 'small_unlabeled' END, CASE k WHEN 0 THEN 2.0 WHEN 1 THEN 4.0 WHEN 2 THEN 0.5 ELSE 0.64 END::DOUBLE FROM o)
 SELECT page_id, id, is_room, reason, area_m2 FROM f""")
def q_rooms(spark, sf):
    """Which faces are rooms, and why others aren't."""
    d = F.lit
    face = lambda i, p, label: F.struct(d(i).alias("id"), p.alias("points"), label.alias("label"))
    # 10 points a metre; a long strip, a face in the title block, a small one without a label, a small one with one
    x0, y0 = pick([d(v) for v in (100.0, 800.0, 400.0, 400.0)], key()), pick([d(v) for v in (200.0, 900.0, 400.0, 400.0)], key())
    w, h = pick([d(v) for v in (100.0, 20.0, 10.0, 8.0)], key()), pick([d(v) for v in (2.0, 20.0, 5.0, 8.0)], key())
    faces = F.array(face("room", box(10, 10, 60, 60), d("Bed 1")), face("tiny", box(300, 300, 301, 301), d("")), face("extra", box(x0, y0, x0 + w, y0 + h), F.when(key() % 4 == 3, "WC").otherwise("")))
    rows = orders(spark, sf).select(key().alias("page_id"), F.inline(faces)).withColumns({"m_per_pt": d(0.1), "page_width": d(1000.0), "page_height": d(1000.0)})
    return surfaces.rooms(rows).select("page_id", "id", "is_room", "reason", F.round("area_m2", 6).alias("area_m2"))


@query("""WITH o AS (SELECT o_orderkey % 100 AS page_id, o_orderkey AS k, o_orderkey % 3 > 0 AS is_room, (o_orderkey % 50)::DOUBLE AS a FROM orders)
 SELECT page_id, 'Room' AS location, 'floor_area' AS row_role, count(*) FILTER (WHERE is_room)::BIGINT AS n, sum(CASE WHEN is_room THEN a ELSE 0 END)::DOUBLE AS m2, count(*)::BIGINT AS faces FROM o GROUP BY 1
 UNION ALL SELECT page_id, 'Room', '', count(*) FILTER (WHERE is_room)::BIGINT, sum(CASE WHEN is_room THEN a ELSE 0 END)::DOUBLE, count(*)::BIGINT FROM o GROUP BY 1""")
def q_room_rows(spark, sf):
    """Rows of rooms' floors and ceilings, and totals of pages."""
    found = orders(spark, sf).select((key() % 100).alias("page_id"), key().alias("id"), (key() % 3 > 0).alias("is_room"), (key() % 50).cast("double").alias("area_m2"), F.lit(None).cast("string").alias("label"))
    rows = surfaces.room_rows(found, with_ceiling=True).groupBy("page_id", "location", "row_role").agg(F.count("*").alias("n"), F.sum("quantity").alias("m2"))
    return rows.join(assembly.room_totals(found).select("page_id", "faces"), "page_id")


@query(f"""WITH o AS (SELECT o_orderkey AS page_id, 10 * (1 + o_orderkey % 20)::DOUBLE AS w FROM {FEW}) SELECT page_id, 'Bedroom' AS label, round(w * 100 * 0.01, 6) AS area_m2, true AS is_room FROM o UNION ALL SELECT page_id, NULL, round(w * 200 * 0.01, 6), CASE WHEN greatest(w, 200.0) / least(w, 200.0) > 12 THEN false ELSE true END FROM o""")
def q_rooms_from_segments(spark, sf):
    """Rooms that linework closes, with labels. (F112, F111, J11)"""
    w = 10 * (1 + key() % 20).cast("double")
    d = F.lit
    line = lambda k, *v: F.struct(d(k).alias("n"), *[(x if hasattr(x, "alias") else d(float(x))).alias(c) for c, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)])
    lines = F.array(line(0, 0, 0, w, 0), line(1, w, 0, w, 300), line(2, w, 300, 0, 300), line(3, 0, 300, 0, 0), line(4, 0, 100, w, 100), line(5, 5, 5, 5.1, 5.1))
    seg = few(spark, sf).select(key().alias("page_id"), F.inline(lines)).withColumn("seg_id", F.col("page_id") * 10 + F.col("n")).drop("n")
    labels = few(spark, sf).select(key().alias("page_id"), d(1).alias("label_id"), d("Bedroom").alias("label"), (w / 2).alias("x"), d(50.0).alias("y"))
    sizes = few(spark, sf).select(key().alias("page_id"), d(5000.0).alias("page_width"), d(5000.0).alias("page_height"), d(0.1).alias("m_per_pt"))
    return drawing.rooms_from_segments(seg, labels, sizes).select("page_id", "label", F.round("area_m2", 6).alias("area_m2"), "is_room")


@query("""SELECT o_orderkey AS building_id, s.side, round(CASE WHEN s.side IN ('North', 'South') THEN 5.0 + o_orderkey % 40 ELSE 3.0 + o_orderkey % 7 END, 4)::DOUBLE AS length_m, s.n::BIGINT AS edges FROM orders, (VALUES ('North', 1), ('South', 1), ('East', 1), ('West', 1)) s(side, n)""")
def q_facades(spark, sf):
    """Edges of footprints by the side that they face."""
    rows = orders(spark, sf).select(key().alias("building_id"), F.lit("G").alias("level"), box(0, 0, 5.0 + key() % 40, 3.0 + key() % 7).alias("points"))
    return surfaces.facades(rows).select("building_id", "side", F.col("projected_width_m").alias("length_m"), "edges")


@query("""WITH o AS (SELECT o_orderkey AS wall_ref, 4.0 + o_orderkey % 5 AS w FROM orders) SELECT wall_ref, c.x0::DOUBLE AS x0, coalesce(c.x1, w)::DOUBLE AS x1, c.z0::DOUBLE AS z0, c.z1::DOUBLE AS z1 FROM o, (VALUES (0, 1, 0, 1), (0, 1, 1, 2), (0, 1, 2, 3), (1, 2, 0, 1), (1, 2, 2, 3), (2, NULL, 0, 1), (2, NULL, 1, 2), (2, NULL, 2, 3)) c(x0, x1, z0, z1)""")
def q_wall_cells(spark, sf):
    """Walls cut into rectangles that no opening covers."""
    walls = orders(spark, sf).select(key().alias("wall_ref"), (4.0 + key() % 5).alias("width"), F.lit(3.0).alias("height"))
    holes = walls.select("wall_ref", *[F.lit(v).alias(c) for c, v in (("x0", 1.0), ("x1", 2.0), ("z0", 1.0), ("z1", 2.0))])
    return surfaces.wall_cells(walls, holes)


@query("""WITH o AS (SELECT o_custkey AS k, (o_orderkey % 97)::DOUBLE AS x, (o_orderkey % 31)::DOUBLE AS y, (o_orderkey % 7)::DOUBLE AS z, (o_orderkey % 97)::DOUBLE * 2 AS off FROM orders), e AS (SELECT k, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM o GROUP BY 1),
 g AS (SELECT k, off - lag(off) OVER (PARTITION BY k ORDER BY off) AS gap FROM o), s AS (SELECT k, round(avg(gap), 6) AS spacing, round(var_pop(gap), 6) AS spacing_variance, count(*)::BIGINT AS gaps FROM g WHERE gap > 0.5 GROUP BY 1) SELECT * FROM e LEFT JOIN s USING (k)""")
def q_extents(spark, sf):
    """Bounds of elements and spacing of strokes."""
    rows = orders(spark, sf).select(F.col("o_custkey").alias("k"), (key() % 97).cast("double").alias("x"), (key() % 31).cast("double").alias("y"), (key() % 7).cast("double").alias("z"), ((key() % 97) * 2).cast("double").alias("offset"))
    gaps = surfaces.spacing(rows, ["k"])
    return surfaces.extents(rows, ["k"]).join(gaps.select("k", F.round("spacing", 6).alias("spacing"), F.round("spacing_variance", 6).alias("spacing_variance"), "gaps"), "k", "left")


@query("""SELECT o_orderkey AS page_id, 0.0::DOUBLE AS x0, r.y0::DOUBLE AS y0, (50 + o_orderkey % 40)::DOUBLE AS x1, r.y1::DOUBLE AS y1 FROM orders, (VALUES (0, 20), (20, 60)) r(y0, y1)""")
def q_rectangles(spark, sf):
    """Rectangles that lines close."""
    w = (50 + key() % 40).cast("double")
    line = lambda axis, fixed, lo, hi: F.struct(F.lit(axis).alias("axis"), *[(v if hasattr(v, "alias") else F.lit(float(v))).alias(c) for c, v in (("fixed", fixed), ("lo", lo), ("hi", hi))])
    lines = F.array(*[line("h", y, 0, w) for y in (0, 20, 60)], line("v", 0, 0, 60), line("v", w, 0, 60), line("v", 30, 5, 15))
    return surfaces.rectangles(orders(spark, sf).select(key().alias("page_id"), F.inline(lines)))


@query("""WITH o AS (SELECT o_orderkey AS page_id, o_orderkey % 3 AS k FROM orders) SELECT page_id, 'c' AS id, CASE k WHEN 2 THEN 'large' ELSE 'small' END AS target_id, k <> 1 AS inside FROM o""")
def q_code_targets(spark, sf):
    """The polygon that a code lies in, else the nearest."""
    codes = orders(spark, sf).select(key().alias("page_id"), F.lit("c").alias("id"), pick([F.lit(v) for v in (15.0, -8.0, 90.0)], key()).alias("x"), pick([F.lit(v) for v in (15.0, 15.0, 90.0)], key()).alias("y"))
    targets = orders(spark, sf).select(key().alias("page_id"), F.inline(F.array(F.struct(F.lit("small").alias("id"), box(0, 0, 30, 30).alias("points")), F.struct(F.lit("large").alias("id"), box(0, 0, 200, 200).alias("points")))))
    return surfaces.code_targets(codes, targets, 30.0)


@query("""SELECT o_orderkey AS page_id, 'Unit ' || u.n AS label, u.n::VARCHAR AS id, (400 * (1 + o_orderkey % 3))::DOUBLE AS area FROM orders, (VALUES (1), (2)) u(n)""")
def q_unit_boundaries(spark, sf):
    """The largest contour that holds one unit's label alone."""
    h = (20 * (1 + key() % 3)).cast("double")
    contour = lambda i, p: F.struct(F.lit(i).alias("id"), p.alias("points"))
    contours = orders(spark, sf).select(key().alias("page_id"), F.inline(F.array(contour("1", box(0, 0, 20, h)), contour("2", box(30, 0, 50, h)), contour("both", box(-5, -5, 100, 100)), contour("inner", box(5, 5, 15, 15)))))
    labels = orders(spark, sf).select(key().alias("page_id"), F.inline(F.array(*[F.struct(F.lit(f"Unit {n}").alias("label"), F.lit(x).alias("x"), F.lit(10.0).alias("y")) for n, x in ((1, 10.0), (2, 40.0))])))
    return surfaces.unit_boundaries(contours, labels)


def _segments(numbers, *lines):
    """Each row a page with the given (x1, y1, x2, y2) lines."""
    line = lambda n, v: F.struct(F.lit(n).alias("n"), *[(x if hasattr(x, "alias") else F.lit(float(x))).alias(c) for c, x in zip(("x1", "y1", "x2", "y2"), v, strict=True)])
    return numbers.select(key().alias("page_id"), F.inline(F.array(*[line(n, v) for n, v in enumerate(lines)]))).select("page_id", (F.col("page_id") * 100 + F.col("n")).alias("seg_id"), "x1", "y1", "x2", "y2")


@query("""WITH o AS (SELECT o_orderkey AS page_id, 3 + (o_orderkey % 30) AS gap FROM orders) SELECT page_id, page_id * 100 AS a_seg_id, page_id * 100 + 1 AS b_seg_id, gap::DOUBLE AS gap, 80.0::DOUBLE AS overlap FROM o WHERE gap <= 18""")
def q_wall_pairs(spark, sf):
    """Parallel lines a wall's width apart."""
    gap = (3 + key() % 30).cast("double")
    return pages.wall_pairs(_segments(orders(spark, sf), (0, 0, 100, 0), (20, gap, 100, gap), (0, 500, 0, 600))).select("page_id", "a_seg_id", "b_seg_id", "gap", "overlap")


@query("""WITH o AS (SELECT o_orderkey AS page_id, 100 + o_orderkey % 50 AS x FROM orders) SELECT page_id, page_id * 100 + s.n AS seg_id, s.x1::DOUBLE AS x1, coalesce(s.x2, x)::DOUBLE AS x2 FROM o, (VALUES (0, 0, 40), (0, 40, NULL)) s(n, x1, x2)
 UNION ALL SELECT page_id, page_id * 100 + 1, 40, 40 FROM o UNION ALL SELECT page_id, page_id * 100 + 1, 40, 40 FROM o""")
def q_split(spark, sf):
    """Segments cut at their crossings."""
    return pages.split(_segments(orders(spark, sf), (0, 0, 100 + key() % 50, 0), (40, -10, 40, 10))).select("page_id", "seg_id", "x1", "x2")


@query("""WITH o AS (SELECT o_orderkey AS page_id, 80 + 2 * (o_orderkey % 20) AS w FROM orders) SELECT page_id, 'door' AS kind, page_id * 100 + 1 AS seg_id, 0.9::DOUBLE AS width_m, 5.0::DOUBLE AS at_m FROM o
 UNION ALL SELECT page_id, 'window', page_id * 100 + 2, round(w / 100.0, 6)::DOUBLE, round(10 + w / 200.0, 6)::DOUBLE FROM o""")
def q_doors_and_windows(spark, sf):
    """Door leaves and window jambs along a wall."""
    w = (80 + 2 * (key() % 20)).cast("double")
    seg = _segments(orders(spark, sf), (0, 0, 2000, 0), (500, 0, 500, 90), (1000, -20, 1000, 20), (1000 + w, -20, 1000 + w, 20))
    walls = orders(spark, sf).select(key().alias("page_id"), F.lit("W").alias("wall_ref"), *[F.lit(v).alias(c) for c, v in (("x1", 0.0), ("y1", 0.0), ("x2", 2000.0), ("y2", 0.0))])
    d = evidence.doors(seg, walls, 100.0).select("page_id", F.lit("door").alias("kind"), "seg_id", F.round("width_m", 6).alias("width_m"), F.round("position_along_wall_m", 6).alias("at_m"))
    w = evidence.windows(seg, walls, 100.0).select("page_id", F.lit("window"), "a_seg_id", F.round("width_m", 6), F.round("position_along_wall_m", 6))
    return d.unionAll(w)


@query("""WITH o AS (SELECT o_orderkey AS page_id, 50 + o_orderkey % 700 AS gap FROM orders) SELECT page_id, 'A' AS a, 'B' AS b, round(gap / 100.0, 6)::DOUBLE AS width_m FROM o WHERE gap <= 600 AND NOT (page_id % 5 = 0) UNION ALL SELECT page_id, 'C', 'B', round((gap - 20) / 100.0, 6) FROM o WHERE page_id % 5 = 0 AND gap - 20 BETWEEN 30 AND 600""")
def q_wall_gaps(spark, sf):
    """Gaps between collinear walls that no third wall fills."""
    gap = (50 + key() % 700).cast("double")
    wall = lambda ref, fixed, lo, hi: F.struct(F.lit(ref).alias("wall_ref"), F.lit("h").alias("axis"), *[(v if hasattr(v, "alias") else F.lit(float(v))).alias(c) for c, v in (("fixed", fixed), ("lo", lo), ("hi", hi))])
    third = wall("C", F.when(key() % 5 == 0, 2.0).otherwise(900.0), 110, 120)
    walls = orders(spark, sf).select(key().alias("page_id"), F.inline(F.array(wall("A", 0, 0, 100), wall("B", 5, 100 + gap, 2000 + gap), third)))
    return evidence.wall_gaps(walls, 100.0).select("page_id", "a", "b", F.round("width_m", 6).alias("width_m"))


@query("""WITH o AS (SELECT o_orderkey AS page_id, 1000 + o_orderkey % 2000 AS mm FROM orders) SELECT page_id, 1::BIGINT AS word_id, page_id * 100 AS seg_id, round(100.0 / (mm / 1000.0), 6)::DOUBLE AS pt_per_m FROM o""")
def q_dimension_scales(spark, sf):
    """Scales that dimensions and the lines near them suggest."""
    words = orders(spark, sf).select(key().alias("page_id"), F.lit(1).cast("long").alias("word_id"), F.concat((1000 + key() % 2000).cast("string"), F.lit("mm")).alias("text"), F.lit(50.0).alias("x"), F.lit(10.0).alias("y"))
    got = evidence.dimension_scales(words, _segments(orders(spark, sf), (0, 0, 100, 0), (0, 300, 100, 300)))
    return got.select("page_id", "word_id", "seg_id", F.round("pt_per_m", 6).alias("pt_per_m"))


@query("""WITH o AS (SELECT o_orderkey AS page_id, o_orderkey % 3 AS k, 10 + o_orderkey % 40 AS step FROM orders) SELECT page_id, 3::BIGINT AS divisions, CASE WHEN k < 2 THEN round(step / 1.0, 6) END::DOUBLE AS pt_per_m FROM o""")
def q_scale_bars(spark, sf):
    """Scale bars whose ticks are evenly spaced."""
    step = (10 + key() % 40).cast("double")
    ticks = orders(spark, sf).select(key().alias("page_id"), F.explode(F.array(F.lit(0.0), step, 2 * step, F.when(key() % 3 < 2, 3 * step).otherwise(5 * step))).alias("position"))
    return evidence.scale_bars(ticks, 1.0).select("page_id", "divisions", F.round("pt_per_m", 6).alias("pt_per_m"))


@query("""SELECT o_orderkey AS page_id, l.line::BIGINT AS line, l.t || CASE WHEN l.line = 1 THEN ' ' || o_orderkey ELSE '' END AS text FROM orders, (VALUES (1, 'Floor plan'), (2, 'Scale 1:100')) l(line, t)""")
def q_text_lines(spark, sf):
    """Words joined to lines."""
    word = lambda t, x, y: F.struct((t if hasattr(t, "alias") else F.lit(t)).alias("text"), F.lit(x).alias("x0"), F.lit(y).alias("y0"), F.lit(y + 10.0).alias("y1"))
    words = F.array(word("plan", 30.0, 101.0), word("1:100", 40.0, 140.0), word("Floor", 0.0, 100.0), word(key().cast("string"), 60.0, 102.0), word("Scale", 0.0, 141.0))
    return pages.text_lines(orders(spark, sf).select(key().alias("page_id"), F.inline(words))).select("page_id", F.col("line").cast("long").alias("line"), "text")


@query(f"""WITH o AS (SELECT o_orderkey AS k FROM {FEW}) SELECT k AS page_id, n, CASE n WHEN 4 THEN 'too few strokes' WHEN 8 THEN CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'dimension lines' ELSE 'grid words' END END AS reason FROM (SELECT k, unnest([4, 8])::BIGINT AS n FROM o WHERE k % 10 = 0) x
 UNION ALL SELECT k, 8::BIGINT, CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN 'dimension lines' ELSE 'grid words' END FROM o WHERE k % 10 <> 0""")
def q_hatches(spark, sf):
    """Groups of strokes, their metrics and why they aren't hatches. (F115, P25, A34-A36)"""
    lines = [(10 * n, 0, 10 * n, 50) for n in range(8)]
    rare = [(2000 + 10 * n, 2000, 2000 + 10 * n, 2050) for n in range(4)]
    seg = _segments(few(spark, sf), *lines, *rare).filter("seg_id % 100 < 8 or page_id % 10 = 0")
    text_at = lambda t, x, y: F.struct((t if hasattr(t, "alias") else F.lit(t)).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    words = few(spark, sf).filter(key() % 3 > 0).select(key().alias("page_id"), F.inline(F.array(*[text_at(F.when(key() % 3 == 1, "1200").otherwise("batten"), 40.0 + k, 30.0) for k in range(3)], text_at("1200", 900.0, 900.0))))
    sizes = few(spark, sf).select(key().alias("page_id"), F.lit(3000.0).alias("width"), F.lit(3000.0).alias("height"))
    return drawing.hatches(seg, words, sizes).select("page_id", "n", "reason")


@query("""SELECT o_orderkey AS page_id, s.n + o_orderkey * 1000000 AS seg_id, 'wall' AS kind, NULL AS axis FROM orders, (VALUES (0)) s(n) UNION ALL SELECT o_orderkey, o_orderkey * 1000000 + s.n, 'grid', s.axis FROM orders, (VALUES (2, 'h'), (3, 'v')) s(n, axis)""")
def q_wall_and_grid_lines(spark, sf):
    """Strokes with colour, width and dash, by which walls and grids are told. (F69, F145, S13, S17)"""
    s = lambda x2, y2, colour, width, dash: F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(x2).alias("x2"), F.lit(y2).alias("y2"), F.lit(colour).alias("colour"), F.lit(width).alias("width"), F.lit(dash).cast("string").alias("dash"))
    drawn = F.array(s(200.0, 0.0, "#202020", 1.0, None), s(200.0, 0.0, "#F02020", 1.0, None), s(150.0, 0.0, "#C0C0C0", 0.5, "4 2"), s(0.0, 150.0, "#C0C0C0", 0.5, "4 2"), s(150.0, 150.0, "#C0C0C0", 0.5, "4 2"), s(10.0, 0.0, "#000000", 1.0, None))
    strokes = readers.strokes(orders(spark, sf).select(key().alias("page_id"), drawn.alias("segments")), least=20.0)
    walls = drawing.wall_lines(strokes).select("page_id", "seg_id", F.lit("wall").alias("kind"), F.lit(None).cast("string").alias("axis"))
    return walls.unionAll(drawing.grid_lines(strokes).select("page_id", "seg_id", F.lit("grid"), "axis"))


@query("""WITH o AS (SELECT o_orderkey AS page_id, (10 + o_orderkey % 20)::DOUBLE AS w FROM orders) SELECT page_id, 'fill' AS part, 're' AS said, w * 5 AS size FROM o WHERE w * 5 >= 60 UNION ALL SELECT page_id, 'fill', 'l', w * 20 FROM o UNION ALL SELECT page_id, 'block', 'Ground floor', 30.0 FROM o UNION ALL SELECT page_id, 'word', 'Ground', 0 FROM o UNION ALL SELECT page_id, 'word', 'floor', 1 FROM o""")
def q_page_parts(spark, sf):
    """Filled shapes, words and blocks of extracted pages."""
    w = (10 + key() % 20).cast("double")
    at = lambda x, y: F.struct((x if hasattr(x, "alias") else F.lit(float(x))).alias("x"), F.lit(float(y)).alias("y"))
    shape = lambda kind, fill, *p: F.struct(F.lit(kind).alias("kind"), F.lit(fill).cast("string").alias("fill"), F.array(*p).alias("points"))
    shapes = F.array(shape("re", "#fff", at(0, 0), at(w, 5)), shape("l", "#000", at(0, 0), at(2 * w, 0), at(2 * w, 20)), shape("re", None, at(0, 0), at(9, 9)))
    word = lambda n, t, x: F.struct(F.lit(n).alias("word_id"), F.lit(t).alias("text"), F.lit(1).alias("block"), F.lit(x).alias("x0"), F.lit(0.0).alias("y0"), F.lit(x + 10.0).alias("x1"), F.lit(9.0).alias("y1"))
    rows = orders(spark, sf).select(key().alias("page_id"), shapes.alias("shapes"), F.array(word(0, "Ground", 0.0), word(1, "floor", 20.0)).alias("words"), F.array().cast("array<struct<x1:double>>").alias("segments"))
    f = readers.fills(rows, 60.0).select("page_id", F.lit("fill").alias("part"), F.col("kind").alias("said"), F.col("area").alias("size"))
    words = rows.select("page_id", F.inline("words"))
    b = readers.blocks(words).select("page_id", F.lit("block"), "text", F.col("x1") - F.col("x0"))
    _, w = readers.page_parts(rows.withColumn("words", F.transform("words", lambda x: F.struct(x["text"].alias("text")))))
    return f.unionAll(b).unionAll(w.select("page_id", F.lit("word"), "text", F.col("word_id").cast("double")))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, (o_orderkey // 4) AS g FROM orders), f AS (SELECT g, count(*) AS n FROM o GROUP BY 1 HAVING count(*) = 4) SELECT g * 4 AS id, 'merged' AS kind, 'auto_eligible' AS status, NULL AS conflict FROM f WHERE g % 2 = 0 UNION ALL SELECT g * 4, 'merged', 'review', 'conflicting_marks' FROM f WHERE g % 2 = 1
 UNION ALL SELECT g * 4 + 2, 'alone', 'review', 'conflicting_marks' FROM f WHERE g % 2 = 1 UNION ALL SELECT g * 4 + 2, 'alone', 'auto_eligible', NULL FROM f WHERE g % 2 = 0 UNION ALL SELECT g * 4 + 3, 'alone', 'auto_eligible', NULL FROM f""")
def q_physical_duplicates(spark, sf):
    """Evidence of one place merged, contradictions kept apart and named on both."""
    m, g = key() % 4, F.floor(key() / 4)
    full = orders(spark, sf).select(g.alias("g")).groupBy("g").agg(F.count("*").alias("n")).filter("n = 4").select("g")
    far = F.when((m == 2) & (g % 2 == 1), 1.1).when(m == 2, 5.0).when(m == 3, 9.0).otherwise(1.0 + m * 0.05)
    rows = orders(spark, sf).select(
        g.alias("g"), key().alias("opening_instance_id"), F.when(m == 2, "D02").when(m == 3, "").otherwise("D01").alias("type_mark"), g.cast("string").alias("wall_ref"), F.lit("").alias("level"), F.lit("door").alias("opening_type"), far.alias("position_along_wall_m"),
        F.lit(0.9).alias("width_m"), F.lit(2.1).alias("height_m"), F.lit("rough_opening").alias("dimension_basis"), F.lit("plan").alias("dimension_source"), F.lit(0.95).alias("geometry_confidence"), F.lit(0.95).alias("dimension_confidence"), F.lit(0.95).alias("association_confidence"),
        F.lit("plan").alias("source"), F.lit(None).cast("string").alias("plan_geometry_signature")).join(full, "g", "left_semi")
    got = openings.physical_duplicates(rows)
    return got.select(F.col("opening_instance_id").alias("id"), F.when(F.col("opening_instance_id") % 4 == 0, "merged").otherwise("alone").alias("kind"), F.col("deduction_status").alias("status"), F.get("physical_conflicts", F.lit(0)).alias("conflict"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k FROM orders) SELECT id, {choice(("2.1", "2.4", "2.1", "NULL", "2.1"), "k")}::DOUBLE AS height_m, {choice(("'agrees'", "'height_added'", "'height_conflict'", "'no_elevation'", "'agrees'"), "k")} AS outcome, {choice(("NULL", "'mark_conflict'", "'wrong_side'", "NULL", "'no_identity_signal'"), "k")} AS reason FROM o""")
def q_elevation_evidence(spark, sf):
    """What an elevation adds to an opening, and whether the two belong together. (F137, D30)"""
    d = lambda *v: pick([F.lit(x) for x in v], key())
    rows = orders(spark, sf).select(key().alias("id"), key().alias("opening_instance_id"), d(2.1, None, 2.1, None, 2.1).cast("double").alias("height_m"), F.lit(0.9).alias("sill_m"), F.when(key() % 5 != 3, key()).alias("elevation_id"), F.lit(0.5).alias("score"))
    elevations = orders(spark, sf).select(key().alias("elevation_id"), d(2.12, 2.4, 2.5, 2.0, 2.1).alias("e_height_m"), F.lit(0.8).alias("e_sill_m"))
    pairs = orders(spark, sf).select(key().alias("id"), d("W1", "W1", "", "W1", "").alias("p_mark"), d("w1", "W2", "", "W1", "").alias("e_mark"), d("N", "N", "N", "N", "").alias("p_side"), d("N", "N", "S", "N", "").alias("e_side"), F.lit("").alias("p_level"), F.lit("").alias("e_level"), F.lit(1.2).alias("p_width_m"), F.lit(1.25).alias("e_width_m"), F.lit("window").alias("p_opening_type"), F.lit("").alias("e_opening_type"))
    got = drawing.enriched_from_elevation(rows, elevations).withColumnRenamed("opening_instance_id", "id")
    return got.select("id", "height_m", "outcome").join(evidence.correlation(pairs).select("id", "reason"), "id")


@query("""SELECT p_partkey AS page_id, 2::BIGINT AS line, 'D' || (p_partkey % 90 + 1) AS mark, (700 + p_size)::INT AS width_mm, 2100::INT AS height_mm, (p_partkey % 4 + 1)::INT AS count, 'rough_opening' AS dimension_basis FROM part UNION ALL SELECT p_partkey, 3, 'W' || (p_partkey % 9 + 1), 900, 1200, 1, 'rough_opening' FROM part""")
def q_schedule_entries(spark, sf):
    """Openings of schedules by their heading lines."""
    k = F.col("p_partkey")
    s = lambda *v: F.array(*[x.cast("string") if hasattr(x, "alias") else F.lit(x) for x in v])
    lines = F.array(s("Door schedule", "", "", ""), s("Mark", "Rough opening width", "Rough opening height", "Qty"), s(F.concat(F.lit("D"), k % 90 + 1), 700 + F.col("p_size"), "2100mm", k % 4 + 1), s(F.concat(F.lit("W"), k % 9 + 1), "900", "1.2 m", ""), s("note", "", "", ""))
    rows = table(spark, sf, "part").select(k.alias("page_id"), F.posexplode(lines).alias("line", "cells")).withColumn("line", F.col("line").cast("long"))
    return evidence.schedule_entries(rows)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 0.9 WHEN o_orderkey % 3 = 1 THEN NULL END::DOUBLE AS scheduled_width_m, o_orderkey % 3 = 1 AS schedule_ambiguous FROM orders""")
def q_enriched_instances(spark, sf):
    """Instances with their mark's scheduled size; a mark with two sizes gives none."""
    marks = ("D1", "D2", "D9")
    instances = orders(spark, sf).select(key().alias("id"), pick([F.lit(m) for m in marks], key()).alias("type_mark"))
    entry = lambda m, w: F.struct(F.lit(m).alias("mark"), F.lit(w).alias("width_mm"), F.lit(2100).alias("height_mm"), F.lit("frame").alias("dimension_basis"))
    entries = table(spark, sf, "region").select(F.inline(F.array(entry("D1", 900), entry("D2", 800), entry("D2", 820))))
    return evidence.enrich(instances, entries).select("id", "scheduled_width_m", "schedule_ambiguous")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 6 AS k FROM orders) SELECT id, CASE k WHEN 1 THEN 'calibrated' WHEN 2 THEN 'printed' WHEN 3 THEN 'unknown' WHEN 4 THEN 'calibrated' WHEN 0 THEN 'inherited' ELSE 'inherited' END AS source, CASE k WHEN 1 THEN 50.0 WHEN 4 THEN 50.0 WHEN 0 THEN 50.0 WHEN 5 THEN 50.0 WHEN 2 THEN round(2000 / (0.352778::DOUBLE * 200), 6) END::DOUBLE AS px_per_m,
 CASE k WHEN 2 THEN 'PROVISIONAL_SCALE' WHEN 3 THEN 'NO_SCALE' WHEN 1 THEN 'SCALE_CONFLICT' WHEN 4 THEN 'SCALE_CONFLICT' END AS code FROM o""")
def q_page_scales(spark, sf):
    """Scales of pages: calibrated, inherited from pages of the same print, printed; and what is wrong with them."""
    from ..operators import registers

    calibrated = (key() % 6).isin(1, 4)
    rows = orders(spark, sf).select(key().alias("id"), F.floor(key() / 6).alias("workspace_id"), F.when(key() % 6 == 2, "1:200").when(key() % 6 == 3, "NTS").otherwise("1:100").alias("scale_text"), F.lit("").alias("extracted_text"), F.when(calibrated, 50.0).alias("px_per_m"), F.lit(None).cast("double").alias("render_zoom"), F.when(key() % 6 == 2, 5000).otherwise(2400 + key() % 6).alias("width_px"))
    scaled = registers.scales(rows)
    issues = registers.scale_issues(scaled).select("id", "code")
    return scaled.select("id", F.col("scale_source").alias("source"), F.round("resolved_px_per_m", 6).alias("px_per_m")).join(issues, "id", "left")


@query("""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 9 + 1 AS n FROM orders) SELECT id, 5::BIGINT AS hull, (n * n)::DOUBLE * 4 AS area, 3::BIGINT AS triangles, 2::BIGINT AS simple FROM o""")
def q_hulls(spark, sf):
    """Hulls, triangles and simplified lines. (F113, F114, F123-F125)"""
    n = (key() % 9 + 1).cast("double")
    at = lambda x, y: F.struct((n * x).alias("x"), (n * y).alias("y"))
    pentagon = F.array(at(0, 0), at(2, 0), at(2, 1.5), at(1, 2.5), at(0, 1.5))
    inner = F.array(at(1, 1), at(1, 0.5))
    rows = orders(spark, sf).select(key().alias("id"), F.inline(F.concat(pentagon, inner)))
    hull = surfaces.hulls(rows, "id").select("id", F.size("points").cast("long").alias("hull"), geometry.area(F.col("points")).alias("area"))
    tri = surfaces.triangulated(orders(spark, sf).select(key().alias("id"), pentagon.alias("p")), "p").select("id", F.size("triangles").cast("long").alias("triangles"))
    line = F.array(at(0, 0), at(1, 0.001), at(2, 0.0), at(3, 0.002), at(4, 0))
    simple = surfaces.simplified(orders(spark, sf).select(key().alias("id"), line.alias("p")), "p", 0.1).select("id", F.size("p").cast("long").alias("simple"))
    return hull.join(shuffled(tri), "id").join(shuffled(simple), "id")


@query("""WITH o AS (SELECT o_orderkey AS id, 1 + o_orderkey % 9 AS n FROM orders) SELECT id, f.face, (n * f.k)::DOUBLE AS area_m2, round(sqrt(n * n + 9.0), 6) AS distance, CASE WHEN id % 4 = 0 THEN 'South' ELSE 'East' END AS side FROM o, (VALUES ('front', 2), ('back', 2), ('left', 6), ('right', 6), ('top', 3), ('bottom', 3)) f(face, k) WHERE f.k <> 6
 UNION ALL SELECT id, f.face, 6.0, round(sqrt(n * n + 9.0), 6), CASE WHEN id % 4 = 0 THEN 'South' ELSE 'East' END FROM o, (VALUES ('left'), ('right')) f(face)""")
def q_masses(spark, sf):
    """Faces of a mass, distances from segments, sides. (F121, F129, F43)"""
    n, d = (1 + key() % 9).cast("double"), F.lit
    seg = F.struct(d(-5.0).alias("x1"), d(0.0).alias("y1"), d(0.0).alias("x2"), d(0.0).alias("y2"))
    said = F.when(key() % 4 == 0, "southern side").otherwise("east")
    return orders(spark, sf).select(key().alias("id"), F.inline(geometry.box_faces(d(0.0), d(0.0), d(0.0), n, d(3.0), d(2.0))), F.round(geometry.segment_distance(n, d(3.0), seg), 6).alias("distance"), text.orientation(said).alias("side"))


_RECTS = """SELECT o_custkey % 50 AS page_id, o_orderkey AS rect_id, (o_orderkey * 37 % 1000)::DOUBLE AS x0, (o_orderkey * 91 % 700)::DOUBLE AS y0, (floor(o_totalprice)::BIGINT % 140)::DOUBLE AS w, (floor(o_totalprice / 10)::BIGINT % 130)::DOUBLE AS h, CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'pdf_point' ELSE 'render_pixel' END AS space FROM orders"""


@query(f"""WITH r AS ({_RECTS}), w AS (SELECT p_partkey % 50 AS page_id, p_partkey AS word_id, CASE p_partkey % 5 WHEN 0 THEN 'd' || p_size WHEN 1 THEN 'see EW' || p_size || ' here' WHEN 2 THEN 'WD' || p_size WHEN 3 THEN 'W' || p_size * 100 ELSE p_name END AS text, (p_partkey * 53 % 1000)::DOUBLE AS x, (p_partkey * 29 % 700)::DOUBLE AS y FROM part),
 m AS (SELECT page_id, word_id, x, y, CASE word_id % 5 WHEN 0 THEN 'D' || substr(text, 2) WHEN 1 THEN split_part(text, ' ', 2) WHEN 3 THEN CASE WHEN length(text) <= 4 THEN text END END AS mark FROM w),
 f AS (SELECT page_id, rect_id, x0, y0, w, h, w / 20.0::DOUBLE AS wm, h / 20.0::DOUBLE AS hm FROM r WHERE coalesce(space, CASE WHEN page_id % 3 = 0 THEN 'pdf_point' ELSE 'render_pixel' END) = CASE WHEN page_id % 3 = 0 THEN 'pdf_point' ELSE 'render_pixel' END AND page_id % 7 <> 6 AND w / 20.0 BETWEEN 0.3 AND 6 AND h / 20.0 BETWEEN 0.3 AND 5),
 d AS (SELECT rect_id, mark, row_number() OVER (PARTITION BY rect_id ORDER BY sqrt(pow(greatest(x0 - x, 0, x - x0 - w), 2) + pow(greatest(y0 - y, 0, y - y0 - h), 2)), word_id) AS n FROM f JOIN m ON m.page_id = f.page_id AND mark IS NOT NULL AND sqrt(pow(greatest(x0 - x, 0, x - x0 - w), 2) + pow(greatest(y0 - y, 0, y - y0 - h), 2)) < 11)
 SELECT page_id, f.rect_id, round(wm, 4) AS width_m, round(hm, 4) AS height_m, coalesce(mark, '') AS label, (CASE WHEN wm BETWEEN 0.6 AND 4 AND hm BETWEEN 0.6 AND 3.5 THEN 0.65 ELSE 0.5 END + CASE WHEN mark IS NULL THEN 0 ELSE 0.1 END)::DOUBLE AS confidence FROM f LEFT JOIN d ON d.rect_id = f.rect_id AND n = 1""")
def q_elevation_openings(spark, sf):
    """Opening-sized rectangles of elevations with the marks near them, in metres only where coordinates are the same. (F136)"""
    o, p = orders(spark, sf), table(spark, sf, "part")
    x, y = (F.col("o_orderkey") * 37 % 1000).cast("double"), (F.col("o_orderkey") * 91 % 700).cast("double")
    w, h = (F.floor("o_totalprice") % 140).cast("double"), (F.floor(F.col("o_totalprice") / 10) % 130).cast("double")
    space = F.when(key() % 4 == 1, "pdf_point").when(key() % 4 > 1, "render_pixel")
    rects = o.select((F.col("o_custkey") % 50).alias("page_id"), key().alias("rect_id"), x.alias("x0"), y.alias("y0"), (x + w).alias("x1"), (y + h).alias("y1"), space.alias("coord_space"))
    k, size = F.col("p_partkey"), F.col("p_size")
    said = F.when(k % 5 == 0, F.concat(F.lit("d"), size)).when(k % 5 == 1, F.concat(F.lit("see EW"), size, F.lit(" here"))).when(k % 5 == 2, F.concat(F.lit("WD"), size)).when(k % 5 == 3, F.concat(F.lit("W"), size * 100)).otherwise(F.col("p_name"))
    words = p.select((k % 50).alias("page_id"), k.alias("word_id"), said.alias("text"), (k * 53 % 1000).cast("double").alias("x"), (k * 29 % 700).cast("double").alias("y"))
    page = F.col("c_custkey")
    scales = table(spark, sf, "customer").filter("c_custkey < 50").select(page.alias("page_id"), F.when(page % 3 == 0, "pdf_point").otherwise("render_pixel").alias("coord_space"), F.when(page % 7 != 6, 20.0).otherwise(0.0).alias("units_per_m"))
    return elevations.elevation_openings(rects, words, scales)
