import pytest
from pyspark.sql import functions as F

from plumbline.functions import geometry, text
from plumbline.operators import assembly


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_text(spark):
    s = F.lit
    assert one(spark, text.safe_name(s(" a/b: c "))) == "a_b_c" and one(spark, text.safe_name(s("//"))) == "item"
    assert [one(spark, text.integer(s(v))) for v in ("3.9", "x", "")] == [3, 0, 0]
    assert [one(spark, text.inclusion(s(v))) for v in ("Yes", "opt", "no", "other")] == ["INCLUSION", "PROVISIONAL", "EXCLUSION", "other"]
    assert one(spark, text.descriptions_agree(s("Low sheen acrylic"), s("low sheen"))) and not one(spark, text.descriptions_agree(s("gloss"), s("gl")))
    assert one(spark, text.expand(s("PLBD wall"), {"plbd": "plasterboard"})) == "plasterboard wall"
    assert one(spark, text.colour(s("Charcoal grey"))) == "#3A3A3C" and one(spark, text.colour(s("x"), F.lit(None).cast("string"), s("#1"))) == "#1"
    assert one(spark, text.scope_groups(s("Building A and block 2, building a"))) == ["Building A", "Block 2"]
    assert one(spark, text.metres_per_page_mm(s("1:100"))) == 0.1 and one(spark, text.metres_per_page_mm(s("10 mm = 2 m"))) == 0.2
    assert [tuple(r) for r in one(spark, text.unit_areas(s("Unit 5 82.5 m2\nlobby 9 m2\nUnit 6 2 m2")))] == [("Unit 5", 82.5)]
    assert [tuple(r) for r in one(spark, text.substrate_areas(s("plasterboard 20 m2\ntimber and steel 5 m2")))] == [("Plasterboard", 20.0)]
    assert one(spark, text.semantic_heights(s("CH 2700, clg: 3.0m ch 900"))) == [2.7, 3.0]
    assert tuple(one(spark, text.lock_keys(F.lit(7), s("")))) == (7, 0)


def test_geometry(spark):
    d = lambda *v: [F.lit(float(x)) for x in v]
    assert one(spark, geometry.opening_fits(*d(1, 2, 0, 2, 5, 3))) is None and one(spark, geometry.opening_fits(*d(4, 2, 0, 2, 5, 3))) == "outside_length"
    wall = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("x1", 0), ("y1", 0), ("x2", 10), ("y2", 0))])
    assert tuple(one(spark, geometry.opening_box(wall, *d(2, 1, 0, 2)))) == (2.0, 0.0, 3.0, 0.0, 0.0, 2.0)
    assert one(spark, geometry.calibrated_px_per_m(wall, *d(2, 1000, 500))) == 50.0
    assert tuple(one(spark, geometry.measured(F.lit("line"), wall, F.array().cast("array<struct<x:double,y:double>>"), *d(1000, 500, 50)))) == (2.0, 0.0, 0.0)
    box = F.struct(*[F.lit(float(v)).alias(n) for n, v in (("x0", 9), ("y0", -1), ("x1", 2), ("y1", 4))])
    assert tuple(one(spark, geometry.clamped_box(box, *d(8, 3)))) == (2.0, 0.0, 8.0, 3.0)


def test_walls(spark):
    facades = spark.createDataFrame([("N1", "North", "G", 10.0), ("N2", "North", "G", 4.0), ("E1", "East", "L9", 5.0)], "wall_ref string, side string, level string, length_m double")
    heights = spark.createDataFrame([("G", 3.0)], "level string, height_m double")
    notes = spark.createDataFrame([("N1", None, "Render"), (None, "North", "Brick"), (None, "North", "Timber")], "wall_ref string, side string, substrate string")
    holes = spark.createDataFrame([("N2", None, True, 2.0), (None, "North", True, 1.0), (None, "East", False, 1.0)], "wall_ref string, elevation_side string, deduct boolean, area_m2 double")
    got = {r["wall_ref"]: (r["substrate"], r["net_m2"]) for r in assembly.registered_walls(facades, heights, notes, holes).collect()}
    assert got == {"N1": ("Render", 29.0), "N2": ("Mixed", 10.0), "E1": ("To confirm", 13.5)}
    levels = spark.createDataFrame([("l1", "Level 1"), ("l2", "LEVEL 2"), ("l3", "level-2")], "level_id string, name string")
    rows = spark.createDataFrame([("level 1",), ("Level 2",), (None,)], "level string")
    assert sorted(str(r["level_id"]) for r in assembly.resolve_level(rows, levels).collect()) == ["None", "None", "l1"]


def test_merging(spark):
    a = spark.createDataFrame([("Walls", "L1", 5.0), ("Walls", "L1", 5.00001)], "element string, location string, quantity double")
    b = spark.createDataFrame([(" walls", "l1", 5.0), ("Ceiling", "L1", 1.0)], "element string, location string, quantity double")
    assert sorted(r["element"] for r in assembly.merge_batches([a, b], ["element", "location", "quantity"]).collect()) == ["Ceiling", "Walls"]
    auto = spark.createDataFrame([("I1", "D1", "W1", 0.9, 2.1), ("I2", "D2", "W1", 0.9, 2.1), ("I3", "D3", "W2", 1.0, 2.1), ("I3", "D3", "W2", 1.0, 2.1)], "opening_instance_id string, type_mark string, wall_ref string, width_m double, height_m double")
    manual = spark.createDataFrame([("I1", "", "", 0.0, 0.0), ("M9", "D2", "W1", 0.9, 2.1)], auto.schema)
    assert [r["opening_instance_id"] for r in assembly.same_as_manual(auto, manual).collect()] == ["I3"]
    issues = spark.createDataFrame([("a", 1, "X", "m"), ("a", None, "Y", "m")], "category string, page_no int, code string, message string")
    more = spark.createDataFrame([("a", None, "Y", "m"), ("b", 2, "Z", "m"), ("b", 2, "Z", "m")], issues.schema)
    assert [(r["number"], r["code"]) for r in assembly.unregistered_issues(issues, more).orderBy("number").collect()] == [(1, "Y"), (2, "X"), (3, "Z")]


def test_checks(spark):
    c = lambda *v: one(spark, assembly.facade_check(*[F.lit(x).cast("double") for x in v]))
    assert [c(10, 10.1, 3, 3), c(10, 11, 3, None), c(10, 10, 3, None)] == ["verified", "conflict", "review"]
    rows = spark.createDataFrame([(100.0, 101.0), (100.0, 105.0), (100.0, 150.0), (None, 3.0)], "documented_m2 double, drawn_m2 double")
    assert [r["state"] for r in assembly.geometry_check(rows).collect()] == ["verified", "close", "conflict", "single source"]
    model = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 5.0), ("d", 5.0)], "ref string, area_m2 double")
    lines = spark.createDataFrame([("a", 5.0), ("b", 2.0), ("b", 3.0), ("d", 6.0)], "ref string, quantity double")
    assert {r["ref"]: r["state"] for r in assembly.match_report(model, lines).collect()} == {"a": "matched", "b": "ambiguous", "c": "unresolved", "d": "variance"}
    groups = spark.createDataFrame([(1, "A", 50.0, 10.0, 0.0, 0.0, 100.0, 100.0), (1, "B", 52.0, 90.0, 0.0, 0.0, 100.0, 100.0)], "facade_id long, code string, cx double, cy double, x double, y double, w double, h double")
    assert [(r["code"], r["axis"], r["from"], r["to"]) for r in assembly.bands(groups).orderBy("from").collect()] == [("A", "y", 0.0, 50.0), ("B", "y", 50.0, 100.0)]
    assert assembly.next_job(spark.createDataFrame([("PB25007",), ("X1",)], "job_no string")).first()[0] == "PB25008"
    assert assembly.next_job(spark.createDataFrame([], "job_no string")).first()[0] == "PB25001"


def test_registers(spark):
    pages = spark.createDataFrame([(1, "PT1 - Low sheen\nPT1: low sheen\nnote"), (2, "PT2 Gloss")], "id long, extracted_text string")
    assert [(r["code"], r["description"]) for r in assembly.legend(pages).orderBy("code").collect()] == [("PT1", "Low sheen"), ("PT2", "Gloss")]
    names = spark.createDataFrame([(1, "low sheen walls"), (2, "zzz")], "name_id long, name string")
    codes = spark.createDataFrame([("PT1", "Low sheen acrylic"), ("PT2", "Low gloss")], "code string, description string")
    assert {r["name_id"]: r["code"] for r in assembly.fuzzy_codes(names, codes).collect()} == {1: "PT1", 2: None}
    sides = spark.createDataFrame([(1, 1, "N", 9.0), (1, 2, "N", 8.0), (1, 2, "S", 3.0)], "workspace_id long, page_id long, side string, score double")
    rows, more = assembly.limited(sides, ["score"], 2)
    assert rows.count() == 2 and more
    assert one(spark, assembly.distinct_in_order(F.array(F.lit(" b"), F.lit("a"), F.lit("b"), F.lit("")))) == ["b", "a"]


def test_more(spark):
    prisms = spark.createDataFrame([(1, ["Block A"]), (2, ["Block B"]), (3, []), (4, ["Block C"])], "id long, groups array<string>")
    assert {r["id"]: r["scope_state"] for r in assembly.scope_prisms(prisms, ["Block A"], ["Block B"], False).collect()} == {1: "Included", 2: "Reference"}
    c = lambda a, b: one(spark, assembly.manual_calibration(F.lit(a), F.lit(b)))
    assert [c(50.0, 50.1), c(50.0, 51.0), c(0.0, 5.0)] == [False, True, False]
    rows = spark.createDataFrame([(1, "margin", "12"), (1, "gst", "x"), (2, "other", "1")], "workspace_id long, key string, value string")
    assert sorted(tuple(r) for r in assembly.settings(rows, {"margin": 10.0, "gst": 10.0}).collect()) == [(1, 12.0, 10.0), (2, 10.0, 10.0)]
    known = spark.createDataFrame([("P1", None, 2, 10.0), ("P2", "timber", 3, 12.0)], "finish_code string, kind string, coats int, coverage double")
    areas = spark.createDataFrame([("p1", "x", 10.0), ("zz", "Timber door", 12.0), ("", "other", 16.0)], "finish_code string, substrate string, area_m2 double")
    assert sorted(r["litres"] for r in assembly.systems(areas, known).collect()) == [2.0, 3.0, 3.0]
    pages = spark.createDataFrame([(1, "pitch 22.5° and 10 deg"), (1, "parapet")], "workspace_id long, extracted_text string")
    got = assembly.roof(pages, spark.createDataFrame([(1, 3.2), (1, 6.0)], "workspace_id long, height_m double")).first()
    assert got["pitches_deg"] == [10.0, 22.5] and got["parapet"] and got["roof_z"] == 6.0
    assert one(spark, assembly.element_of(F.lit("Bed 1 ceiling"))) == "Ceiling" and one(spark, assembly.hatch_confidence(*[F.lit(float(x)) for x in (20, 10, 0, 0, 5)])) == 1.0


def test_next_job_of_six_digits(spark):
    assert assembly.next_job(spark.createDataFrame([("PB999999",), ("PB25007",)], "job_no string")).first()[0] == "PB1000000"
