import math

import pytest
from pyspark.sql import functions as F

from plumbline.operators import openings, pages, registers
from plumbline.functions import geometry

SEG = "page_id long, seg_id long, x1 double, y1 double, x2 double, y2 double"


def seg(spark, *rows):
    return spark.createDataFrame([(1, k, *map(float, r)) for k, r in enumerate(rows)], SEG)


def test_faces_of_crossing_lines(spark):
    lines = seg(spark, (0, 0, 20, 0), (20, 0, 20, 10), (20, 10, 0, 10), (0, 10, 0, 0), (10, -5, 10, 15))
    got = pages.faces(lines)
    assert sorted((round(r["area"], 6), round(r["perimeter"], 6)) for r in got.collect()) == [(100.0, 40.0), (100.0, 40.0)]
    labels = spark.createDataFrame([(1, 1, "Kitchen", 5.0, 5.0), (1, 2, "Bath", 15.0, 5.0), (1, 3, "Out", 50.0, 5.0)], "page_id long, label_id long, label string, x double, y double")
    assert sorted(r["label"] for r in pages.label_faces(got, labels).collect()) == ["Bath", "Kitchen"]


def test_wall_pairs_and_snap(spark):
    got = pages.wall_pairs(seg(spark, (0, 0, 100, 0), (0, 5, 100, 5), (0, 60, 100, 60), (50, -50, 50, 50))).collect()
    assert [(r["a_seg_id"], r["b_seg_id"], r["gap"], r["overlap"]) for r in got] == [(0, 1, 5.0, 100.0)]
    ends = pages.snap(seg(spark, (0, 0, 10, 0), (10.5, 0.3, 10, 10), (0, 0.5, 0.2, 0.4))).collect()
    assert [(r["a"], r["b"]) for r in sorted(ends, key=lambda r: r["seg_id"])] == [(0, 1), (1, 2)]


def test_strokes_and_lines(spark):
    hatch = [(10 * k, 0, 10 * k + 20, 20) for k in range(8)] + [(500, 0, 520, 0)]
    got = pages.stroke_clusters(seg(spark, *hatch)).collect()
    assert len(got) == 1 and got[0]["n"] == 8 and got[0]["angle"] == pytest.approx(45) and got[0]["mean_length"] == pytest.approx(math.hypot(20, 20))
    words = spark.createDataFrame([(1, "B", 50.0, 10.0, 12.0), (1, "A", 5.0, 11.0, 13.0), (1, "next", 5.0, 40.0, 42.0)], "page_id long, text string, x0 double, y0 double, y1 double")
    assert [r["text"] for r in pages.text_lines(words).orderBy("line").collect()] == ["A B", "next"]
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 500.0, 0.0)], "page_id long, point_id long, x double, y double")
    tags = spark.createDataFrame([(1, 1, "D1", 30.0, 40.0), (1, 2, "D2", 100.0, 0.0)], "page_id long, word_id long, text string, x double, y double")
    assert [(r["point_id"], r["text"], r["distance"]) for r in pages.nearest_tags(points, tags).collect()] == [(1, "D1", 50.0)]


def test_polygons(spark):
    df = spark.sql("select array(struct(0D as x, 0D as y), struct(4D as x, 0D as y), struct(4D as x, 3D as y), struct(0D as x, 3D as y)) p")
    p = F.col("p")
    r = df.select(geometry.signed_area(p), geometry.perimeter(p), geometry.contains(p, F.lit(1.0), F.lit(1.0)), geometry.contains(p, F.lit(5.0), F.lit(1.0)), geometry.centroid(p)["x"]).first()
    assert tuple(r) == (12.0, 14.0, True, False, 2.0)


EVIDENCE = "opening_instance_id string, type_mark string, wall_ref string, level string, opening_type string, position_along_wall_m double, width_m double, height_m double, dimension_basis string, dimension_source string, geometry_confidence double, dimension_confidence double, association_confidence double, source string"


def door(**k):
    row = {"opening_instance_id": "I1", "type_mark": "D01", "wall_ref": "W01", "level": "Ground", "opening_type": "door", "position_along_wall_m": 2.0, "width_m": 0.82, "height_m": None, "dimension_basis": "unknown", "dimension_source": "plan", "geometry_confidence": 0.95, "dimension_confidence": 0.95, "association_confidence": 0.95, "source": "plan"} | k
    return tuple(row[c.split()[0]] for c in EVIDENCE.split(", "))


@pytest.mark.parametrize("basis,deducts", [("rough_opening", True), ("frame", False), ("leaf", False), ("clear_opening", False)])
def test_only_rough_openings_deduct(spark, basis, deducts):
    ev = spark.createDataFrame([door(), door(height_m=2.1, dimension_basis=basis, dimension_source="schedule_parse", source="schedule")], EVIDENCE)
    decided = openings.pipeline(ev)
    assert [r["deduct"] for r in decided.collect()] == [deducts]
    walls = spark.createDataFrame([("W01", 20.0), ("W02", 5.0)], "wall_ref string, gross_m2 double")
    got = {r["wall_ref"]: r["net_m2"] for r in openings.net_walls(walls, decided).collect()}
    assert got == {"W01": pytest.approx(20 - 0.82 * 2.1 if deducts else 20.0, abs=1e-4), "W02": 5.0}


def test_conflicts_force_review_and_pairs_are_found(spark):
    ev = spark.createDataFrame([door(height_m=2.1, dimension_basis="rough_opening"), door(width_m=0.95, height_m=2.1, source="elevation")], EVIDENCE)
    r = openings.pipeline(ev).first()
    assert r["conflicts"] == ["width"] and r["deduct"] is False
    many = spark.createDataFrame([door(opening_instance_id=f"I{k}", position_along_wall_m=p, level=lv) for k, (p, lv) in enumerate([(2.0, "Ground"), (2.2, ""), (2.15, "Level 1"), (9.0, "Ground")])], EVIDENCE)
    assert sorted((x["a_opening_instance_id"], x["b_opening_instance_id"]) for x in openings.same_opening_pairs(many).collect()) == [("I0", "I1"), ("I1", "I2")]


def test_registers(spark):
    pages_df = spark.createDataFrame([(1, 1, "A-101 Floor Plan Rev A", "PT1 walls", "1:100", 0.0, 2400, 2.0), (2, 1, "A-101 Floor Plan Rev B", "PT1 PT9", "1:100", 56.0, 2400, 2.0), (3, 1, "A-201 Elevation", "", None, 0.0, 2400, 2.0)], "id long, workspace_id long, page_label string, extracted_text string, scale_text string, px_per_m double, width_px int, render_zoom double")
    assert {r["id"]: (r["is_current"], r["superseded_by"]) for r in registers.revisions(pages_df).collect()} == {1: (False, 2), 2: (True, None), 3: (True, None)}
    scaled = registers.scales(pages_df)
    assert {r["id"]: r["scale_source"] for r in scaled.collect()} == {1: "inherited", 2: "calibrated", 3: "unknown"}
    assert [(r["id"], r["code"]) for r in registers.scale_issues(scaled).collect()] == [(3, "NO_SCALE")]
    entries = spark.createDataFrame([("pt1", "Low sheen", "Plasterboard", 1), ("PT1", "Low sheen acrylic", "Plasterboard", 2), ("PT2", "Gloss", "Timber", 1), ("PT2", "Epoxy", "Steel", 1)], "code string, description string, substrate string, page_id long")
    known = registers.materials(entries)
    assert {r["code"]: (r["status"], r["substrate"]) for r in known.collect()} == {"PT1": ("Confirmed", "Plasterboard"), "PT2": ("Conflict", None)}
    assert sorted((r["page_id"], r["code"], r["description"]) for r in registers.occurrences(pages_df, known).collect() if r["code"].startswith("PT")) == [(1, "PT1", "Low sheen"), (2, "PT1", "Low sheen"), (2, "PT9", "Unknown")]


def test_accuracy_and_trades(spark):
    truth = spark.createDataFrame([("floor", "a", 100.0, None), ("floor", "b", 50.0, None), ("finish", "x", None, "PT 1")], "category string, item_key string, expected_numeric double, expected_text string")
    pred = spark.createDataFrame([(1, "floor", "a", 10.0, None), (2, "floor", "a", 110.0, None), (3, "finish", "x", None, "pt1")], "id long, category string, item_key string, predicted_numeric double, predicted_text string")
    got = {r["category"]: r for r in registers.accuracy(truth, pred).collect()}
    assert got["floor"]["mape"] == pytest.approx(0.1) and got["floor"]["found"] == 1 and got["finish"]["accuracy"] == 1.0
    pages_df = spark.createDataFrame([(1, 1, "paint paint primer"), (2, 1, "paint")], "id long, workspace_id long, extracted_text string")
    words = [("painting", "paint", 3), ("painting", "primer", 10), ("tiling", "tile", 5)]
    assert [(r["trade"], r["score"]) for r in registers.detect_trades(pages_df, words).collect()] == [("painting", 15)]
