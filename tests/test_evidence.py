import pytest

from plumbline.operators import evidence

SEG = "page_id long, seg_id long, x1 double, y1 double, x2 double, y2 double"


def test_schedules(spark):
    rows = [(1, 0, ["Door schedule"]), (1, 1, ["Mark", "RO Width", "RO Height", "Qty"]), (1, 2, ["D01", "900", "2100mm", "3"]), (1, 3, ["W2", "1.2 m", "", ""]), (1, 4, ["note", "", "", ""]), (2, 0, ["Tag", "Size"]), (2, 1, ["D01", "900 x 2100"]), (2, 2, ["D05", "820/2040"]), (3, 0, ["D09", "900x2100"])]
    got = {(r["page_id"], r["mark"]): tuple(r)[3:] for r in evidence.schedule_entries(spark.createDataFrame(rows, "page_id long, line int, cells array<string>")).collect()}
    assert got == {(1, "D01"): (900, 2100, 3, "rough_opening"), (1, "W2"): (1200, None, 1, "rough_opening"), (2, "D01"): (900, 2100, 1, "unknown"), (2, "D05"): (820, 2040, 1, "unknown")}
    entries = spark.createDataFrame([("D01", 900, 2100, "rough_opening"), ("D01", 900, 2100, "rough_opening"), ("D02", 800, 2100, "x"), ("D02", 820, 2100, "x")], "mark string, width_mm int, height_mm int, dimension_basis string")
    out = {r["id"]: (r["scheduled_width_m"], r["schedule_ambiguous"]) for r in evidence.enrich(spark.createDataFrame([(1, "D01"), (2, "D02"), (3, "D03")], "id long, type_mark string"), entries).collect()}
    assert out == {1: (0.9, False), 2: (None, True), 3: (None, False)}


def test_correlation(spark):
    schema = "workspace_id long, id long, mark string, side string, level string, width_m double, opening_type string"
    plan = spark.createDataFrame([(1, 1, "W01", "North", "", 1.2, "window"), (1, 2, "", "South", "", 0.82, "door"), (1, 3, "", "South", "", 0.82, "door"), (1, 4, "W09", "East", "Ground", 2.0, "window"), (1, 5, "", "", "", 1.5, "window")], schema)
    elev = spark.createDataFrame([(1, 11, "w01", "North", "", 1.25, ""), (1, 12, "", "South", "", 0.82, ""), (1, 14, "W09", "East", "Level 1", 2.0, ""), (1, 15, "", "", "", 1.5, "")], schema)
    got = {(r["plan_id"], r["elevation_id"]): r["score"] for r in evidence.correlate(plan, elev).collect()}
    assert got == {(1, 11): pytest.approx(0.15 + 0.30 * (1 - 0.05 / 0.15) + 0.40, abs=1e-4)}


def test_plan_openings(spark):
    wall = [(1, 1, 0.0, 0.0, 1000.0, 0.0)]
    jambs = [(1, 2, 100.0, -5.0, 100.0, 36.0), (1, 3, 500.0, -10.0, 500.0, 10.0), (1, 4, 550.0, -10.0, 550.0, 10.0), (1, 5, 300.0, 0.0, 340.0, 0.0)]
    segs = spark.createDataFrame([(p, s, *map(float, c)) for p, s, *c in wall + jambs], SEG)
    walls = spark.createDataFrame([(1, "W1", 0.0, 0.0, 1000.0, 0.0)], "page_id long, wall_ref string, x1 double, y1 double, x2 double, y2 double")
    d = evidence.doors(segs, walls, 50.0).collect()
    assert [(r["seg_id"], r["width_m"], r["position_along_wall_m"], r["geometry_confidence"]) for r in d] == [(2, 0.82, 2.0, 0.60)]
    w = evidence.windows(segs, walls, 50.0).collect()
    assert [(r["a_seg_id"], r["b_seg_id"], r["width_m"], r["position_along_wall_m"]) for r in w] == [(3, 4, 1.0, 10.5)]
    lines = spark.createDataFrame([(1, "A", "h", 10.0, 0.0, 100.0), (1, "B", "h", 12.0, 150.0, 300.0), (1, "C", "h", 11.0, 350.0, 400.0), (1, "D", "h", 11.0, 305.0, 345.0), (1, "E", "v", 10.0, 150.0, 160.0)], "page_id long, wall_ref string, axis string, fixed double, lo double, hi double")
    gaps = {(r["a"], r["b"]): r["width_m"] for r in evidence.wall_gaps(lines, 50.0).collect()}
    assert gaps == {("A", "B"): 1.0}


def test_heights_and_scales(spark):
    pages = spark.createDataFrame([(1, "FFL RL 10.000\nFCL RL 12.700\nsomething RL 99.0 nothing\nFFL RL 13.200"), (2, "none"), (3, None)], "id long, extracted_text string")
    levels = evidence.reduced_levels(pages)
    assert sorted((r["rl"], r["kind"]) for r in levels.collect()) == [(10.0, "ffl"), (12.7, "fcl"), (13.2, "ffl")]
    got = [(r["height_m"], r["height_type"]) for r in evidence.height_pairs(levels).collect()]
    assert got == [(3.2, "floor_to_floor"), (2.7, "floor_to_ceiling")]
    best = evidence.best_height(spark.createDataFrame([(1, "r", 2, 0.9, 2.4), (2, "r", 1, 0.5, 2.7), (3, "r", 1, 0.8, 3.0)], "id long, room string, priority int, confidence double, h double"), ["room"]).first()
    assert best["h"] == 3.0
    ticks = spark.createDataFrame([(1, 28.346 * k) for k in range(11)] + [(2, float(x)) for x in (0, 10, 35)], "page_id long, position double")
    assert {r["page_id"]: r["pt_per_m"] for r in evidence.scale_bars(ticks, 1.0).collect()} == {1: pytest.approx(28.346), 2: None}
    words = spark.createDataFrame([(1, 1, "3600", 100.0, 12.0), (1, 2, "text", 100.0, 12.0)], "page_id long, word_id long, text string, x double, y double")
    segs = spark.createDataFrame([(1, 1, 10.0, 0.0, 190.0, 0.0), (1, 2, 0.0, 500.0, 10.0, 500.0)], SEG)
    assert [(r["seg_id"], r["pt_per_m"]) for r in evidence.dimension_scales(words, segs).collect()] == [(1, pytest.approx(50.0))]
