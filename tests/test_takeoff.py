import pytest
from pyspark.sql import functions as F

from plumbline.operators import gates, takeoff

COLUMNS = "id long, workspace_id long, section string, element string, location string, substrate string, finish_system string, quantity double, unit string, quantity_status string, source_page string, source_reference string, inclusion_status string, coats double, coverage_m2_per_litre double, productivity_m2_per_hour double, rate_per_unit double, confidence string, notes string, row_role string, commercial_authority_status string, commercial_authority_source string, commercial_authority_reviewed_by string, commercial_authority_reviewed_at string, commercial_authority_fingerprint string"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def rows(spark, *given):
    base = {"workspace_id": 1, "section": "Internal", "substrate": "Plasterboard", "unit": "m²", "coats": 2.0, "coverage_m2_per_litre": 12.0, "productivity_m2_per_hour": 8.0, "inclusion_status": "Included"}
    return spark.createDataFrame([tuple((base | {"id": k} | g).get(n) for n in NAMES) for k, g in enumerate(given, 1)], COLUMNS)


FOUR = [
    {"element": "Walls", "location": "Level 1", "quantity": 100.0, "rate_per_unit": 12.0, "source_reference": "AI plan review"},
    {"element": "Walls", "location": "Level 1", "quantity": 95.0, "rate_per_unit": 12.0},
    {"element": "Skirting", "location": "Ground", "quantity": 40.0, "rate_per_unit": 6.0, "unit": "lm"},
    {"section": "External", "element": "Facade", "location": "Level 1", "quantity": 60.0, "rate_per_unit": 15.0, "notes": "AI draft"},
]


def test_levels_and_quote(spark):
    got = {r["level"]: r for r in takeoff.quote(takeoff.per_level(takeoff.priced(rows(spark, *FOUR)))).collect()}
    one, ground = got["Level 1"], got["Ground"]
    assert (one["rows"], one["m2"], one["value_ex_gst"]) == (3, 255.0, 3240.0)
    assert (ground["lm"], ground["value_ex_gst"], ground["paint_litres"], ground["labour_hours"]) == (40.0, 240.0, 0.0, 5.0)
    assert one["total_inc_gst"] == pytest.approx(3240 * 1.1 * 1.1)


def test_excluded_and_unapproved_rows_are_never_priced(spark):
    model = {"element": "Walls", "location": "Ground", "quantity": 10.0, "rate_per_unit": 5.0, "row_role": "model_surface"}
    df = rows(spark, {"element": "Walls", "location": "Ground", "quantity": 9.0, "inclusion_status": "Excluded"}, model, {"element": "Floor", "location": "Ground", "quantity": 50.0, "row_role": "floor_area"})
    assert [r["id"] for r in takeoff.priced(df).orderBy("id").collect()] == [3]
    approved = takeoff.approve(df.filter("id = 2"), "sheet A1", "someone", "2024-01-01")
    assert takeoff.priced(approved).count() == 1
    assert takeoff.priced(approved.withColumn("quantity", F.lit(11.0))).count() == 0  # the row changed after approval
    assert takeoff.priced(approved.withColumn("row_role", F.lit(""))).count() == 0  # its role can't be laundered


def test_floor_is_shared_by_walls(spark):
    df = rows(spark, {"element": "Floor", "location": "Level 1", "quantity": 80.0, "row_role": "floor_area"}, {"element": "Wall A", "location": "Level 1", "quantity": 30.0, "rate_per_unit": 1.0}, {"element": "Wall B", "location": "Level 1", "quantity": 10.0, "rate_per_unit": 1.0}, {"element": "Ceiling", "location": "Level 1", "quantity": 7.0, "rate_per_unit": 1.0})
    got = {r["element"]: (r["priced_quantity"], r["pricing_basis"]) for r in takeoff.priced(df, "floor_m2").collect()}
    assert got["Wall A"] == (60.0, "Floor m² allocated") and got["Wall B"] == (20.0, "Floor m² allocated") and got["Ceiling"] == (7.0, "Quantity")


def test_reconcile(spark):
    lines = spark.createDataFrame([(2,)], "takeoff_row_id long")
    got = {r["element"]: r for r in takeoff.reconcile(rows(spark, *FOUR), lines).collect()}
    assert (got["Walls"]["ai_qty"], got["Walls"]["drawn_qty"], got["Walls"]["status"]) == (100.0, 95.0, "Difference")
    assert got["Skirting"]["status"] == "Manual / not yet measured" and got["Facade"]["status"] == "AI only (not drawn)"


def test_copies_to_a_level(spark):
    df = rows(spark, *FOUR)
    got = takeoff.copy_to_level(df, spark.createDataFrame([(1,), (3,)], "id long"), "Level 2").collect()
    assert sorted((r["element"], r["location"], r["quantity"]) for r in got) == [("Skirting", "Level 2", 0.0), ("Walls", "Level 2", 0.0)]


def test_measured_shapes(spark):
    df = rows(spark, {"element": "Walls", "location": "Ground", "quantity": 11.0, "unit": "lm"}, {"element": "Floor", "quantity": 1.0}).withColumns({"pre_map_quantity": F.lit(11.0), "ai_baseline_quantity": F.lit(None).cast("double"), "pre_map_quantity_status": F.lit("Manual")})
    shapes = spark.createDataFrame([(1, "line", None, 3.0, 0.0, 0.0), (1, "line", None, 4.0, 0.0, 0.0), (2, "polygon", None, 0.0, 9.0, 12.0), (2, "polygon", "deduction", 0.0, 2.0, 6.0), (2, "line", None, 5.0, 0.0, 0.0)], "takeoff_row_id long, kind string, measurement_basis string, length_m double, area_m2 double, perimeter_m double")
    got = {r["id"]: (r["quantity"], r["quantity_status"], r["bad_shapes"]) for r in takeoff.measured(df, shapes).collect()}
    assert got == {1: (7.0, "Mapped", 0), 2: (7.0, "Mapped", 1)}
    assert {r["quantity"] for r in takeoff.measured(df, shapes.filter("false")).collect()} == {11.0}


def test_gates(spark):
    df = rows(spark, *FOUR, {"element": "Doors", "location": "Ground", "quantity": None, "unit": ""})
    found = gates.signals(df)
    assert found.first()["severity"] == "BLOCKER"
    assert gates.preflight(df, found).first()["state"] == "BLOCKED"
    good = rows(spark, FOUR[1], FOUR[2])
    checked = gates.preflight(good, gates.signals(good))
    assert checked.first()["state"] == "READY"
    nothing = spark.createDataFrame([], "job string, fingerprint string")
    first = gates.publish(nothing, good, checked, "PB1")
    assert first.count() == 2
    assert gates.publish(first.select("job", "fingerprint"), good, checked, "PB1").count() == 0
    assert gates.publish(nothing, good.withColumn("quantity", F.col("quantity") + 1), checked, "PB1").count() == 0
    signed = gates.sign_off(good, checked, "someone").first()
    assert signed["signed"] and len(signed["signature"]) == 64


def test_overrides(spark):
    log = spark.createDataFrame([(1, "quantity", "5", 1), (1, "quantity", "7.5", 2), (1, "id", "99", 3), (3, "unit", "No.", 4), (3, "quantity", "x", 5)], "row_id long, field_name string, new_value string, seq long")
    got = {r["id"]: (r["quantity"], r["unit"]) for r in gates.apply_overrides(rows(spark, *FOUR), log).collect()}
    assert got[1] == (7.5, "m²") and got[3] == (40.0, "No.") and got[2] == (95.0, "m²")
