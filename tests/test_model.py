"""The canonical model: every reason of its ledger, and its parts."""

from plumbline.operators import model

LEVELS = "workspace_id long, name string, elevation_m double"
WALLS = "workspace_id long, wall_ref string, x1 double, y1 double, x2 double, y2 double, height_m double, thickness_m double, height_status string, level string, takeoff_eligible boolean"
OPENINGS = "workspace_id long, wall_ref string, id string, opening_type string, offset_m double, width_m double, height_m double, sill_m double, claimed_wall_ref string, level string, authorised boolean, excluded boolean"
FLOORS = "workspace_id long, id string, points array<struct<x:double,y:double>>, page_width_px int, page_height_px int, px_per_m double, level string, manual_m2 double"
CAPS = "workspace_id long, id string, points array<struct<x:double,y:double>>, z double, level string"
SQUARE, BOW, LINE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 8.0)], [(0.0, 0.0), (5.0, 0.0), (9.0, 0.0)]


def built(spark, validated=True):
    wall = lambda ref, level="Level 1", x2=10.0, status="confirmed", h=3.0: (1, ref, 0.0, 0.0, x2, 0.0, h, None, status, level, True)
    op = lambda k, wall="W1", at=1.0, w=1.0, h=2.0, sill=0.0, claim=None, level=None, ok=True, out=False: (1, wall, k, "door", at, w, h, sill, claim, level, ok, out)
    walls = [wall("W1"), wall("W2", "level-1"), wall("W2", "level-1"), wall("W3", None), wall("W4", x2=None), wall("W5", "Level 2", status="assumed"), (2, "W1", 0.0, 0.0, 5.0, 0.0, 3.0, 0.1, None, "Level 9", True)]
    ops = [op("ok"), op("high", at=1.2, sill=2.2, h=0.5), op("a", at=5.0), op("b", at=5.5, w=2.0), op("long", at=9.5), op("lost", "W9"), op("rejected", "W4"), op("host", claim="W2"), op("fine", "W2", claim="w-2"), op("level", at=3.0, level="Level 2"), op("out", "W2", at=4.0, out=True), op("plain", "W2", at=8.0, ok=False), op("nowhere", at=None), op("ok")]
    floors = [(1, "f1", SQUARE, 1000, 500, 10.0, "Level 1", None), (1, "bow", BOW, 1000, 500, 10.0, "Level 1", None), (1, "line", LINE, 1000, 500, 10.0, "Level 1", None), (1, "free", SQUARE, 1000, 500, None, "Level 1", None), (1, "storey", SQUARE, 1000, 500, 10.0, " ", None), (1, "typed", None, None, None, None, "Level 1", 40.0)]
    caps = [(1, "c1", SQUARE, 3.02, "Level 1"), (1, "c2", SQUARE, 4.0, "LEVEL 1"), (1, "c3", SQUARE, None, "Level 2"), (1, "c4", LINE, None, "Level 1"), (1, "c5", SQUARE, None, "Level 7")]
    levels = [(1, "LEVEL 1", 5.0), (1, "Level 2", 8.0), (1, "Level 1", None)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    return model.canonical(frame(levels, LEVELS), frame(walls, WALLS), frame(ops, OPENINGS), frame(floors, FLOORS), frame(caps, CAPS), validated)


def test_model(spark):
    m = built(spark)
    assert {(r["workspace_id"], r["level_slug"], r["name"], r["elevation_m"]) for r in m.levels.collect()} == {(1, "level1", "LEVEL 1", 5.0), (1, "level2", "Level 2", 8.0), (1, "unresolved", None, None), (2, "level9", "Level 9", None)}
    walls = {(r["workspace_id"], r["wall_ref"]): r for r in m.walls.collect()}
    assert set(walls) == {(1, "W1"), (1, "W2"), (1, "W3"), (1, "W5"), (2, "W1")}
    assert walls[1, "W1"]["deduction_authority"] and not walls[1, "W3"]["deduction_authority"] and walls[1, "W1"]["thickness_m"] == 0.23 and walls[2, "W1"]["thickness_m"] == 0.1
    assert {r["id"]: r["physical_state"] for r in m.openings.collect()} == {
        "ok": "physical_b5_authorised", "high": "physical_b5_authorised", "a": "conflict_overlap", "b": "conflict_overlap", "long": "invalid_geometry", "host": "wrong_host", "fine": "physical_b5_authorised",
        "level": "wrong_level", "out": "manual_exclusion", "plain": "physical_not_authorised", "nowhere": "invalid_geometry"}
    assert [(r["id"], r["area_m2"]) for r in m.floors.collect()] == [("f1", 50.0)]
    assert {r["id"]: (r["z_m"], r["z_message"], r["takeoff_eligible"]) for r in m.roofs.collect()} == {
        "c1": (8.0, None, True), "c2": (None, "disagrees with the walls' height", False), "c3": (None, "walls' heights are unconfirmed", False), "c5": (None, "level's elevation is unresolved", False)}
    assert {(r["id"], r["kind"]) for r in m.observations.collect()} == {("typed", "manual_floor_area_allowance"), ("bow", "rejected_floor_polygon"), ("line", "rejected_floor_polygon"), ("free", "rejected_floor_polygon"), ("storey", "unresolved_floor_level")}
    assert sorted((r["type"], r["id"], r["reason"]) for r in m.ledger.collect()) == sorted([
        ("WALL", "W2", "Repeated id"), ("WALL", "W4", "Missing or invalid start/end coordinates"), ("OPENING", "ok", "Repeated id"), ("OPENING", "lost", "Unknown or rejected wall"), ("OPENING", "rejected", "Unknown or rejected wall"),
        ("OPENING", "host", "wrong_host"), ("OPENING", "level", "wrong_level"), ("OPENING", "a", "conflict_overlap"), ("OPENING", "b", "conflict_overlap"), ("OPENING", "long", "Invalid opening geometry: outside_length"), ("OPENING", "nowhere", "Invalid opening geometry: no_place"),
        ("FLOOR", "bow", "Invalid floor polygon geometry: crosses itself"), ("FLOOR", "line", "Invalid floor polygon geometry: has no area"), ("FLOOR", "free", "Invalid floor polygon geometry: missing page dimensions or calibration"), ("FLOOR", "storey", "No storey identity"),
        ("ROOF", "c4", "Invalid roof cap geometry: has no area"),
    ])


def test_nothing_counts_unvalidated(spark):
    m = built(spark, validated=False)
    assert not [r for d in (m.walls, m.openings, m.floors, m.roofs) for r in d.filter("takeoff_eligible").collect()] and m.openings.filter("deduction_authority").count() == 0
    rows = {r["workspace_id"]: r for r in model.assembled(m).collect()}
    assert len(rows) == 2 and [w["wall_ref"] for w in rows[1]["walls"]] == ["W1", "W2", "W3", "W5"] and [o["id"] for o in rows[1]["walls"][1]["openings"]] == ["fine", "out", "plain"] and rows[2]["floors"] is None
