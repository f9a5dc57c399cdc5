import pytest
from pyspark.sql import functions as F

from plumbline.operators import surfaces

P = "array<struct<x:double,y:double>>"


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]


def polygons(spark, **given):
    return spark.createDataFrame([(1, k, v) for k, v in given.items()], f"page_id long, id string, points {P}")


def test_associate(spark):
    got = {r["id"]: (r["target_id"], r["method"]) for r in surfaces.associate(polygons(spark, inner=box(2, 2, 8, 8), most=box(6, 6, 11, 11), far=box(900, 900, 910, 910), near=box(12, 0, 20, 8), part=box(8, 0, 14, 9)), polygons(spark, room=box(0, 0, 10, 10))).collect()}
    assert got == {"inner": ("room", "containment"), "most": ("room", "majority_overlap"), "near": ("room", "proximity"), "part": ("room", "intersection")}


def test_rooms(spark):
    rows = [("ok", box(0, 0, 100, 100), "Bed"), ("tiny", box(0, 200, 5, 205), "WC"), ("small", box(0, 300, 15, 315), None), ("strip", box(200, 300, 600, 315), None), ("hall", box(200, 400, 600, 420), "Hall"), ("title", box(700, 900, 900, 990), None), ("page", box(0, 0, 999, 999), None), ("bath", box(150, 0, 250, 100), "Bath")]
    df = spark.createDataFrame([(1, *r) for r in rows], f"page_id long, id string, points {P}, label string").withColumns({"m_per_pt": F.lit(0.05), "page_width": F.lit(1000.0), "page_height": F.lit(1000.0)})
    got = {r["id"]: r["reason"] for r in surfaces.rooms(df).collect()}
    assert got == {"ok": None, "bath": None, "tiny": "too_small", "small": "small_unlabeled", "strip": "elongated_unlabeled", "hall": None, "title": "in_title_block_zone", "page": "covers_page"}
    made = surfaces.room_rows(surfaces.rooms(df), with_ceiling=True)
    assert made.count() == 6 and made.filter("id = 'ok' and element = 'Ceiling'").first()["quantity"] == 25.0


def test_facades_cells_extents(spark):
    df = spark.createDataFrame([(1, "G", box(0, 0, 10, 6)), (1, "L1", list(reversed(box(0, 0, 10, 6))))], f"building_id long, level string, points {P}")
    got = {r["side"]: (r["edge_length_m"], r["projected_width_m"], r["edges"]) for r in surfaces.facades(df).collect()}
    assert got == {"North": (20.0, 10.0, 2), "South": (20.0, 10.0, 2), "East": (12.0, 6.0, 2), "West": (12.0, 6.0, 2)}
    walls = spark.createDataFrame([("A", 10.0, 3.0), ("B", 4.0, 2.0)], "wall_ref string, width double, height double")
    holes = spark.createDataFrame([("A", 2.0, 4.0, 1.0, 2.0), ("A", 6.0, 12.0, 0.0, 2.0)], "wall_ref string, x0 double, x1 double, z0 double, z1 double")
    cells = surfaces.wall_cells(walls, holes).withColumn("m2", (F.col("x1") - F.col("x0")) * (F.col("z1") - F.col("z0")))
    assert {r["wall_ref"]: r["m2"] for r in cells.groupBy("wall_ref").agg(F.sum("m2").alias("m2")).collect()} == {"A": pytest.approx(30 - 2 - 8), "B": 8.0}
    pts = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (1, 5.0, -2.0, 3.0)], "k long, x double, y double, z double")
    assert tuple(surfaces.extents(pts, ["k"]).first()) == (1, 0.0, 5.0, -2.0, 0.0, 1.0, 3.0)


def test_hull_and_simplify(spark):
    pts = spark.createDataFrame([(1, float(x), float(y)) for x in range(5) for y in range(5)] + [(2, 1.0, 1.0)], "k long, x double, y double")
    got = {r["k"]: [tuple(p) for p in r["points"]] for r in surfaces.hulls(pts, "k").collect()}
    assert got == {1: [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], 2: [(1.0, 1.0)]}
    line = spark.createDataFrame([([(float(x), 0.01 * (x % 2)) for x in range(9)] + [(9.0, 5.0)],)], f"points {P}")
    assert [tuple(p) for p in surfaces.simplified(line, "points", 0.1).first()["points"]] == [(0.0, 0.0), (8.0, 0.0), (9.0, 5.0)]
    strokes = spark.createDataFrame([(1, float(x)) for x in (0, 10, 20.2, 20.3, 30)], "k long, offset double")
    assert surfaces.spacing(strokes, ["k"]).first()["gaps"] == 3


def test_scopes(spark):
    rows = spark.createDataFrame([("Internal walls and ceilings", "Walls", "", ""), ("Internal", "Ceiling", "", ""), ("External", "Soffit lining", "", ""), ("External", "Cladding", "", ""), ("Internal", "Door frame", "", "")], "section string, element string, substrate string, finish_system string")
    count = lambda s: [r["element"] for r in rows.filter(surfaces.in_scope(s)).collect()]
    assert count("ceilings") == ["Ceiling"] and count("internal_walls") == ["Walls"] and count("doors") == ["Door frame"] and count("external") == ["Cladding"] and count("soffits") == ["Soffit lining"] and len(count("full")) == 5
    pages = spark.createDataFrame([("Floor Plan", ""), ("Roof Plan", "eave lining"), ("Roof Plan", ""), ("Structural", "paint"), ("Other", "paint system")], "t string, w string")
    assert [r["r"]["keep"] for r in pages.select(surfaces.page_relevance(F.col("t"), F.col("w")).alias("r")).collect()] == [True, True, False, False, True]
    assert tuple(spark.range(1).select(surfaces.commercial_line(F.lit(10.0), F.lit(2.0), F.lit(5.0), F.lit(10.0)).alias("c")).first()["c"]) == (20.0, 16.5)


def test_rectangles_and_targets(spark):
    lines = spark.createDataFrame([(1, "h", 0.0, 0.0, 100.0), (1, "h", 50.0, 0.0, 100.0), (1, "v", 0.0, 0.0, 50.0), (1, "v", 40.0, 0.0, 50.0), (1, "v", 100.0, 0.0, 50.0), (1, "v", 70.0, 10.0, 30.0)], "page_id long, axis string, fixed double, lo double, hi double")
    assert sorted((r["x0"], r["y0"], r["x1"], r["y1"]) for r in surfaces.rectangles(lines).collect()) == [(0.0, 0.0, 40.0, 50.0), (40.0, 0.0, 100.0, 50.0)]
    targets = polygons(spark, big=box(0, 0, 100, 100), small=box(10, 10, 30, 30))
    codes = spark.createDataFrame([(1, "a", 20.0, 20.0), (1, "b", 80.0, 80.0), (1, "c", 900.0, 900.0), (1, "d", 50.0, 115.0)], "page_id long, id string, x double, y double")
    assert {r["id"]: (r["target_id"], r["inside"]) for r in surfaces.code_targets(codes, targets, 70.0).collect()} == {"a": ("small", True), "b": ("big", True), "d": ("big", False)}
    labels = spark.createDataFrame([(1, "Unit 1", 20.0, 20.0), (1, "Unit 2", 80.0, 80.0)], "page_id long, label string, x double, y double")
    assert [(r["label"], r["id"], r["area"]) for r in surfaces.unit_boundaries(targets, labels).collect()] == [("Unit 1", "small", 400.0)]


def test_triangles(spark):
    shape = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    got = surfaces.triangulated(polygons(spark, a=shape, b=list(reversed(shape)), c=shape[:2]), "points").collect()
    for r in got[:2]:
        areas = [abs((t[1]["x"] - t[0]["x"]) * (t[2]["y"] - t[0]["y"]) - (t[1]["y"] - t[0]["y"]) * (t[2]["x"] - t[0]["x"])) / 2 for t in r["triangles"]]
        assert len(areas) == 3 and sum(areas) == pytest.approx(10.0)
    assert got[2]["triangles"] == []
