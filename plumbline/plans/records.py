"""Driver queries: take-off rows and registers, from files to gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import geometry, pricing, text
from ..operators import assembly, drawing, fusion, gates, provenance, registers, schedule, surfaces, takeoff
from ..sources import readers, writers
from .natural import _ROWS, rows
from .shared import choice, dealt, key, pick, query, table


def orders(spark, sf):
    return table(spark, sf, "orders")


@query("""SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2""")
def q_table_scan(spark, sf):
    """Columns and rows of a stored table."""
    return readers.scan(spark, f"{sf}/nation.parquet", ["n_nationkey", "n_name"], "n_regionkey = 2")


@query("""SELECT * FROM (VALUES ('q_nation', 'n_name', 'string'), ('q_nation', 'n_nationkey', 'int'), ('q_nation', 'n_regionkey', 'int'), ('q_region', 'r_name', 'string'), ('q_region', 'r_regionkey', 'int')) t(table_name, column_name, data_type)""")
def q_catalog(spark, sf):
    """Tables and their columns."""
    for name in ("nation", "region"):
        table(spark, sf, name).createOrReplaceTempView(f"q_{name}")
    return readers.tables(spark).filter("table_name in ('q_nation', 'q_region')")


@query("""SELECT sha256(r_name || chr(10)) AS sha256, (length(r_name) + 1)::BIGINT AS length FROM region WHERE r_regionkey >= 2""")
def q_new_files(spark, sf):
    """Files whose content isn't known yet."""
    at = scratch.path(spark, "files")
    names = table(spark, sf, "region").select(F.col("r_name").alias("value"))
    names.unionAll(names).coalesce(1).write.option("maxRecordsPerFile", 1).text(at)
    known = table(spark, sf, "region").filter("r_regionkey < 2").select(F.sha2(F.concat("r_name", F.lit("\n")), 256).alias("sha256"))
    return readers.new_files(spark, at, known).select("sha256", "length")


@query("""SELECT 7::BIGINT AS id, c_name AS content, 'missing' AS nothing FROM customer WHERE c_custkey = 7""")
def q_blob(spark, sf):
    """One record's bytes, and columns under the first name that is there."""
    stored = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.base64(F.col("c_name").cast("binary")).alias("content"))
    got = readers.blob(stored, 7).withColumn("content", F.col("content").cast("string"))
    return readers.first_existing(got, {"id": ("ident", "ID"), "content": ("body", "content"), "nothing": ("x", "y")}).withColumn("nothing", F.coalesce("nothing", F.lit("missing")))


@query("""SELECT o_orderkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS client FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def q_jobs(spark, sf):
    """Jobs with their client's name."""
    clients = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return readers.jobs(orders(spark, sf).select(key().alias("id"), F.col("o_custkey").alias("client_id")), clients).select("id", "client")


@query("""SELECT p_name AS element, 'm²' AS unit, (p_size)::DOUBLE AS quantity, round(p_retailprice, 2) AS rate_per_unit, CASE WHEN p_partkey % 3 = 0 THEN 'say "hi", ' || chr(10) || p_brand ELSE p_brand END AS notes FROM part WHERE p_size <> 0""")
def q_csv_takeoff(spark, sf):
    """A CSV export, with commas, quotes and line ends in its cells, read back by its headings."""
    at = scratch.path(spark, "csv")
    notes = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('say "hi", \n'), F.col("p_brand"))).otherwise(F.col("p_brand"))
    out = table(spark, sf, "part").select(notes.alias("Comments"), F.col("p_name").alias("Description"), F.lit("sqm").alias("UOM"), F.concat(F.lit("$ "), F.col("p_size")).alias("Qty (m2)"), F.round("p_retailprice", 2).alias("$ / m2"))
    writers.csv(out, at, ["Description", "Qty (m2)", "UOM"])
    return readers.takeoff_rows(readers.sheets(spark, at)).select("element", "unit", "quantity", "rate_per_unit", "notes")


@query("""SELECT o_custkey % 20 AS workspace_id, CASE WHEN (o_custkey % 20) % 2 = 0 THEN sum(o_orderkey)::BIGINT END AS total, (o_custkey % 20) % 2 = 0 AS fresh FROM orders GROUP BY 1, 3""")
def q_saved_models(spark, sf):
    """Saved models whose fingerprint still fits."""
    sums = orders(spark, sf).groupBy((F.col("o_custkey") % 20).alias("workspace_id")).agg(F.sum("o_orderkey").alias("total"))
    saved = sums.select("workspace_id", F.lit("canonical_model").alias("key"), F.to_json(F.struct(F.concat(F.lit("f"), "workspace_id").alias("fingerprint"), F.struct("total").alias("model"))).alias("value"))
    now = sums.select("workspace_id", F.concat(F.when(F.col("workspace_id") % 2 == 0, "f").otherwise("g"), "workspace_id").alias("fingerprint"))
    return readers.saved_models(saved, now, "total: bigint").select("workspace_id", "model.total", "fresh")


@query("""SELECT n_regionkey::BIGINT AS workspace_id, 'nations' AS source, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS record FROM nation UNION ALL SELECT r_regionkey, 'regions', '{"r_name":"' || r_name || '"}' FROM region""")
def q_snapshot(spark, sf):
    """Everything known of each workspace, with sorted keys, through a file of JSON lines."""
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("workspace_id"), "n_nationkey", "n_name")
    regions = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("workspace_id"), "r_name")
    at = scratch.path(spark, "snapshot")
    writers.json_lines(readers.snapshot({"regions": regions, "nations": nations}), at)
    read = spark.read.text(at).select(F.from_json("value", "workspace_id long, source string, record string").alias("r"))
    return read.select("r.*")


@query("""SELECT o_orderkey AS id, 'v ' || printf('%.4f', (o_orderkey % 9)::DOUBLE) || ' 0.0000 1.0000' AS first, 4::BIGINT AS lines FROM orders""")
def q_mesh(spark, sf):
    """Faces as OBJ text."""
    at = scratch.path(spark, "mesh")
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "alias") else x.cast("double").alias("x"), F.lit(y).alias("y"), F.lit(1.0).alias("z"))
    writers.mesh(orders(spark, sf).select(key().alias("face_id"), F.array(p(key() % 9, 0.0), p(20, 0.0), p(20, 5.0)).alias("points")), at)
    lines = spark.read.text(at)
    counted = lines.agg(F.count_if(F.col("value").startswith("v ")).alias("v"), F.count_if(F.col("value") == "f -3 -2 -1").alias("f"))
    firsts = orders(spark, sf).select(key().alias("id"), F.format_string("v %.4f %.4f %.4f", (key() % 9).cast("double"), F.lit(0.0), F.lit(1.0)).alias("first"))
    seen = lines.filter("value like 'v %'").select(F.col("value").alias("first")).distinct()
    return firsts.join(seen, "first", "left_semi").join(F.broadcast(counted), F.lit(True)).select("id", "first", F.expr("(v + f) div f").alias("lines"))


_WORK = "NOT excluded AND NOT is_floor AND NOT is_model"


@query(f"""WITH {_ROWS} SELECT workspace_id, count(*) FILTER (WHERE {_WORK})::BIGINT AS publishable_rows, sum(CASE WHEN {_WORK} THEN q * rate ELSE 0 END)::DOUBLE AS value_ex_gst, count(*) FILTER (WHERE is_model)::BIGINT AS blocker, count(*) FILTER (WHERE NOT is_floor AND NOT excluded AND rate = 0)::BIGINT AS high,
 CASE WHEN bool_or({_WORK}) THEN CASE WHEN bool_or(is_model) THEN 'BLOCKED' ELSE 'READY' END ELSE 'EMPTY' END AS state, true AS fingerprinted FROM t GROUP BY 1""")
def q_preflight(spark, sf):
    """Counts, totals, fingerprint and state of what would be published."""
    r = rows(spark, sf)
    got = gates.preflight(r, gates.row_signals(r))
    return got.select("workspace_id", "publishable_rows", "value_ex_gst", "blocker", "high", "state", (F.length("fingerprint") == 64).alias("fingerprinted"))


@query(f"""WITH {_ROWS} SELECT 'J1' AS job, workspace_id, count(*)::BIGINT AS rows, true AS first_time, false AS second_time FROM t WHERE NOT is_model AND rate > 0 AND level <> 'Unassigned' AND {_WORK} GROUP BY 2""")
def q_publish(spark, sf):
    """Rows published exactly once: the check seen is the check now, and a repeated call adds nothing.

    A workspace with a blocker publishes nothing, so rows of the model, without a rate or without a level are mended
    away first, in all workspaces.
    """
    r = rows(spark, sf).filter("coalesce(row_role, '') <> 'model-surface' and rate_per_unit > 0 and location <> 'shed'")
    r = scratch.written(r, "rows")
    seen = scratch.written(gates.preflight(r, gates.found_signals(r)), "seen")
    at = scratch.path(spark, "published")
    none = spark.createDataFrame([], "job string, fingerprint string")
    ready = gates.publish(none, r, seen, "J1", acknowledged=True).drop("job", "fingerprint")
    first = writers.publish_once(spark, at, ready, "J1", "print")
    second = writers.publish_once(spark, at, ready, "J1", "print")
    back = spark.read.option("basePath", at).parquet(f"{at}/publication=*")
    return back.groupBy("job", "workspace_id").agg(F.count("*").alias("rows")).select("*", F.lit(first).alias("first_time"), F.lit(second).alias("second_time"))


@query(f"""WITH {_ROWS}, p AS (SELECT * FROM t WHERE is_floor OR (NOT excluded AND NOT is_model)) SELECT workspace_id, sum(CASE WHEN NOT is_floor THEN q * rate ELSE 0 END)::DOUBLE AS value_ex_gst, sum(CASE WHEN NOT is_floor AND unit = 'm²' THEN q * 2 / 8 ELSE 0 END)::DOUBLE AS paint_litres, 'AB' AS estimator, workspace_id % 2 = 0 AS signed, true AS has_signature FROM p GROUP BY 1""")
def q_sign_off(spark, sf):
    """Totals signed by an estimator where the gates allow it. (K29, A44, F142)"""
    r = rows(spark, sf)
    checks = r.select("workspace_id").distinct().select("workspace_id", F.when(F.col("workspace_id") % 2 == 0, "READY").otherwise("BLOCKED").alias("state"), F.lit("f").alias("fingerprint"), F.lit(0).alias("blocker"))
    return gates.sign_off(r, checks, "AB").select("workspace_id", "value_ex_gst", "paint_litres", "estimator", "signed", (F.length("signature") == 64).alias("has_signature"))


@query(f"""WITH {_ROWS} SELECT id, CASE WHEN id % 4 = 0 THEN 3.5::DOUBLE ELSE rate END AS rate_per_unit, CASE WHEN id % 8 = 0 THEN 'Roof' END AS changed FROM t""")
def q_apply_overrides(spark, sf):
    """The last override of each field, those that don't fit passed over."""
    r = rows(spark, sf)
    entry = lambda f, v, n: F.struct(F.lit(f).alias("field_name"), F.lit(v).alias("new_value"), F.lit(n).alias("seq"))
    log = r.filter("id % 4 = 0").select(F.col("id").alias("row_id"), F.inline(F.array(entry("rate_per_unit", "9", 1), entry("rate_per_unit", "3.5", 2), entry("coats", "x", 3), entry("section", "no", 4))))
    log = log.unionAll(r.filter("id % 8 = 0").select("id", F.lit("location"), F.lit("Roof"), F.lit(1)))
    got = gates.apply_overrides(r, log)
    return got.select("id", "rate_per_unit", F.when(F.col("id") % 8 == 0, F.col("location")).alias("changed"))


@query("""SELECT o_custkey AS workspace_id, round(100 * (0.08 * max(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) + 0.24 * max(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END)), 1)::DOUBLE AS completeness_pct FROM orders GROUP BY 1""")
def q_completeness(spark, sf):
    """The weighted share of evidence that is there."""
    has = orders(spark, sf).groupBy(F.col("o_custkey").alias("workspace_id")).agg(F.max((key() % 2 == 0).cast("double")).alias("scale"), F.max((key() % 3 == 0).cast("double")).alias("floor"))
    return gates.completeness(has.unpivot("workspace_id", ["scale", "floor"], "part", "share"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS selected, o_orderkey % 5 <> 0 AS has_row, CASE WHEN o_orderkey % 4 = 0 THEN 0 WHEN o_orderkey % 4 = 1 THEN 1 ELSE 3 END AS priority FROM orders""")
def q_selected_pages(spark, sf):
    """Pages that an estimator took out stay out, and so do their rows."""
    pages = orders(spark, sf).select(key().alias("id"), F.lit(1).alias("selected"), pick([F.lit(x) for x in ("Artist render", "Elevation", "Plan", "x")], key()).alias("page_type"))
    kept = assembly.keep_deselected(pages, orders(spark, sf).select(key().alias("id"), F.when(key() % 5 == 0, 0).otherwise(1).alias("selected")))
    of = assembly.of_selected_pages(pages.select(F.col("id").alias("page_id")), kept).select(F.col("page_id").alias("id"), F.lit(True).alias("has"))
    order = drawing.studio_pages(pages).select("id", "priority")
    return kept.join(of, "id", "left").join(order, "id").select("id", "selected", F.coalesce("has", F.lit(False)).alias("has_row"), "priority")


@query("""SELECT o_orderkey AS line_id, CASE WHEN o_orderkey % 4 = 0 THEN 'A-' || o_orderkey END AS page_label, CASE o_orderkey % 3 WHEN 0 THEN '#123456' WHEN 1 THEN '#9A4B32' ELSE '#1F6FB2' END AS colour FROM orders""")
def q_coloured_lines(spark, sf):
    """Drawn lines with their page and the colour of their row."""
    lines = orders(spark, sf).select(key().alias("line_id"), key().alias("page_id"), F.when(key() % 3 < 2, key()).alias("takeoff_row_id"))
    pages = orders(spark, sf).filter(key() % 4 == 0).select(key().alias("id"), F.concat(F.lit("A-"), key()).alias("page_label"))
    r = orders(spark, sf).select(key().alias("id"), F.lit("brick").alias("substrate"), F.lit("").alias("finish_system"), F.when(key() % 3 == 0, "#123456").alias("row_colour"), F.lit(None).cast("string").alias("substrate_colour"))
    return drawing.coloured_lines(lines, pages, r).select("line_id", "page_label", "colour")


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k FROM orders) SELECT id, {choice(("true", "false", "false", "false", "false"), "k")} AS ceilings, {choice(("false", "true", "false", "false", "false"), "k")} AS internal_walls, {choice(("false", "false", "true", "false", "false"), "k")} AS doors, {choice(("false", "false", "false", "true", "false"), "k")} AS external, {choice(("false", "false", "false", "false", "true"), "k")} AS soffits FROM o""")
def q_quick_scope(spark, sf):
    """Which quick scopes a row belongs to."""
    lit = lambda *v: pick([F.lit(x) for x in v], key())
    r = orders(spark, sf).select(key().alias("id"), lit("Internal", "Internal", "Internal", "External", "External").alias("section"), lit("Ceiling", "Walls", "Door frame", "Cladding", "Soffit lining").alias("element"), F.lit("").alias("substrate"), F.lit("").alias("finish_system"))
    return r.select("id", *[surfaces.in_scope(s).alias(s) for s in ("ceilings", "internal_walls", "doors", "external", "soffits")])


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'Included' WHEN 1 THEN 'Reference' ELSE 'Included' END AS scope_state FROM orders WHERE o_orderkey % 4 <> 3""")
def q_prism_scope(spark, sf):
    """Prisms included, kept for reference or left out."""
    groups = pick([F.array(F.lit("Block A")), F.array(F.lit("Block B")), F.array().cast("array<string>"), F.array(F.lit("Block C"))], key())
    return assembly.scope_prisms(orders(spark, sf).select(key().alias("id"), groups.alias("groups")), ["Block A"], ["Block B"]).select("id", "scope_state")


@query("""SELECT o_orderkey AS id, o_orderkey % 4 IN (0, 1) AS authorised FROM orders""")
def q_authorised(spark, sf):
    """Deductions by hand, or automatic ones that pass every condition."""
    d = F.lit
    r = orders(spark, sf).select(key().alias("id"), (key() % 4 != 3).alias("deduct"), F.when(key() % 4 == 0, "Manual").otherwise("").alias("decided_by"), (key() % 4 == 1).alias("reconciliation_complete"), d("auto_eligible").alias("deduction_status"), d(0.9).alias("width_m"), d(2.1).alias("height_m"), d("rough_opening").alias("dimension_basis"), *[d(0.95).alias(c) for c in ("geometry_confidence", "dimension_confidence", "association_confidence")], d("W1").alias("wall_ref"), d(1.89).alias("area_m2"), d("I1").alias("opening_instance_id"), d(1).alias("page_no"), d(1).alias("workspace_id"), d("plan").alias("dimension_source"))
    return r.select("id", assembly.authorised(r).alias("authorised"))


@query("""WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 50)::DOUBLE AS a FROM orders) SELECT k AS workspace_id, CASE WHEN k % 2 = 0 THEN 'External' ELSE 'Internal' END AS section, 'zone' AS element, a AS quantity, 'm²' AS unit FROM o WHERE a > 0
 UNION ALL SELECT k, 'Internal', CASE WHEN k % 2 = 0 THEN 'area' ELSE 'line' END, CASE WHEN k % 2 = 0 THEN a + 1 ELSE a + 2 END, CASE WHEN k % 2 = 0 THEN 'm²' ELSE 'lm' END FROM o WHERE k % 3 > 0""")
def q_zone_rows(spark, sf):
    """Rows of mapped zones and of shapes that no row claims."""
    a = (key() % 50).cast("double")
    zones = orders(spark, sf).select(key().alias("workspace_id"), F.when(key() % 2 == 0, "North elevation").otherwise("Floor plan").alias("page_type"), F.lit("zone").alias("label"), a.alias("area_m2"))
    shapes = orders(spark, sf).select(key().alias("workspace_id"), F.lit("Floor plan").alias("page_type"), F.when(key() % 2 == 0, "area").otherwise("line").alias("label"), F.when(key() % 2 == 0, "Polygon").otherwise("line").alias("kind"), (a + 1).alias("area_m2"), (a + 2).alias("length_m"), F.when(key() % 3 == 0, key()).alias("takeoff_row_id"))
    return assembly.zone_rows(zones, shapes)


@query("""WITH w AS (SELECT s_suppkey AS k, (5 + s_suppkey % 20)::DOUBLE AS len FROM supplier) SELECT 'N' || k AS wall_ref, len * 3 AS gross_m2, CASE WHEN k % 2 = 0 THEN 'Render' ELSE 'Mixed' END AS substrate, 3.0::DOUBLE AS deducted_m2, len * 3 - 3 AS net_m2 FROM w UNION ALL SELECT 'E' || k, round(len * 2.7, 4), 'To confirm', 0.0, round(len * 2.7, 4) FROM w""")
def q_registered_walls(spark, sf):
    """Walls with height, substrate, openings and net area."""
    k, d = F.col("s_suppkey"), F.lit
    s = table(spark, sf, "supplier")
    length = (5 + k % 20).cast("double")
    north, east = F.concat(d("N"), k), F.concat(d("E"), k)
    wall = lambda ref, side, level: s.select(ref.alias("wall_ref"), F.concat(d(side), k).alias("side"), d(level).alias("level"), length.alias("length_m"))
    facades = wall(north, "North", "G").unionAll(wall(east, "East", "L9"))
    heights = table(spark, sf, "region").filter("r_regionkey = 0").select(d("G").alias("level"), d(3.0).alias("height_m"))
    side = F.concat(d("North"), k)
    notes = s.filter(k % 2 == 0).select(north.alias("wall_ref"), d(None).cast("string").alias("side"), d("Render").alias("substrate")).unionAll(s.select(d(None).cast("string"), side, d("Brick"))).unionAll(s.select(d(None).cast("string"), side, d("Timber")))
    holes = s.select(north.alias("wall_ref"), d(None).cast("string").alias("elevation_side"), d(True).alias("deduct"), d(2.0).alias("area_m2")).unionAll(s.select(d(None).cast("string"), side, d(True), d(1.0)))
    got = assembly.registered_walls(facades, heights, notes, holes)
    return got.select("wall_ref", F.round("gross_m2", 4).alias("gross_m2"), "substrate", "deducted_m2", "net_m2")


@query("""WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 50)::DOUBLE AS b, (o_orderkey % 3)::DOUBLE AS f, (o_orderkey % 20)::DOUBLE AS d FROM orders) SELECT id, b * f AS gross, round(greatest(0, (b * f - d) * 1.1), 3)::DOUBLE AS net, id % 3 = 0 AS by_hand, CASE WHEN b = 0 THEN 0 ELSE round((d - b) / b * 100, 6) END::DOUBLE AS off_pct, round(b * 4, 6) AS rescaled, round(b / cos(radians(30)), 6) AS pitched FROM o""")
def q_commercial_lines(spark, sf):
    """Gross and net of a line, calibrations by hand, variance, change of scale, slopes."""
    b, f, d = (key() % 50).cast("double"), (key() % 3).cast("double"), (key() % 20).cast("double")
    line = surfaces.commercial_line(b, f, d, F.lit(10.0))
    return orders(spark, sf).select(key().alias("id"), line["gross"].alias("gross"), line["net"].alias("net"), assembly.manual_calibration(F.when(key() % 3 == 0, 101.0).otherwise(100.1), F.lit(100.0)).alias("by_hand"), F.round(pricing.variance_pct(b, d), 6).alias("off_pct"), F.round(pricing.rescaled(b, F.lit(100.0), F.lit(50.0), 2), 6).alias("rescaled"), F.round(pricing.pitched_area(b, F.lit(30.0)), 6).alias("pitched"))


@query(f"""WITH {_ROWS} SELECT section, element, CASE level WHEN 'Unassigned' THEN 'Level 4 · shed' WHEN 'Basement 1' THEN 'Level 4 · Basement 1' WHEN 'Level 2' THEN 'Level 4 · lvl 2' WHEN 'Ground' THEN 'Level 4 floor' ELSE 'Level 4' END AS place, count(*)::BIGINT AS n, 0.0::DOUBLE AS quantity FROM t WHERE id % 10 = 0 GROUP BY 1, 2, 3""")
def q_copy_to_level(spark, sf):
    """Copies of rows at another level."""
    r = rows(spark, sf)
    got = takeoff.copy_to_level(r, r.filter("id % 10 = 0").select("id"), "Level 4")
    return got.groupBy("section", "element", F.col("location").alias("place")).agg(F.count("*").alias("n"), F.max("quantity").alias("quantity"))


@query(f"""WITH {_ROWS} SELECT 'Tiling - ' || section AS section, 0.0::DOUBLE AS rate, count(*)::BIGINT AS n, 'Trade: Tiling' AS notes FROM t GROUP BY 1""")
def q_tagged(spark, sf):
    """Rows marked with a trade."""
    got = assembly.tagged(rows(spark, sf), "Tiling")
    return got.groupBy("section", "notes").agg(F.count("*").alias("n"), F.max("rate_per_unit").alias("rate"))


@query("""SELECT c_custkey AS workspace_id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey::DOUBLE ELSE 10.0 END AS margin, 10.0::DOUBLE AS gst FROM customer""")
def q_settings(spark, sf):
    """Settings of each workspace with their defaults."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer")
    kept = c.select(k.alias("workspace_id"), F.lit("margin").alias("key"), F.when(k % 2 == 0, k.cast("string")).otherwise("x").alias("value")).unionAll(c.select(k, F.lit("other"), F.lit("1")))
    return assembly.settings(kept, {"margin": 10.0, "gst": 10.0})


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k::VARCHAR AS opening_instance_id, k % 3 = 2 AS left_over FROM o""")
def q_same_as_manual(spark, sf):
    """Automatic openings that no decision by hand covers."""
    d = F.lit
    auto = orders(spark, sf).select(key().cast("string").alias("opening_instance_id"), F.concat(d("D"), key()).alias("type_mark"), d("W1").alias("wall_ref"), d(0.9).alias("width_m"), d(2.1).alias("height_m"))
    by_id = auto.filter("cast(opening_instance_id as long) % 3 = 0").withColumn("type_mark", d(""))
    by_mark = auto.filter("cast(opening_instance_id as long) % 3 = 1").withColumn("opening_instance_id", F.concat(d("m"), F.col("opening_instance_id")))
    left = assembly.same_as_manual(auto, by_id.unionAll(by_mark)).select("opening_instance_id", d(True).alias("left"))
    return auto.join(left, "opening_instance_id", "left").select("opening_instance_id", F.coalesce("left", d(False)).alias("left_over"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'l1' END AS level_id, CASE WHEN o_orderkey % 2 = 0 THEN 'G' END AS wall_level FROM orders""")
def q_resolved_levels(spark, sf):
    """Levels by their normalised names and of walls, only where there is one."""
    levels = table(spark, sf, "region").filter("r_regionkey < 3").select(pick([F.lit(x) for x in ("l1", "l2", "l3")], F.col("r_regionkey")).alias("level_id"), pick([F.lit(x) for x in ("Level 1", "LEVEL 2", "level-2")], F.col("r_regionkey")).alias("name"))
    r = orders(spark, sf).select(key().alias("id"), pick([F.lit(x) for x in ("LEVEL-1", "Level 2", "attic")], key()).alias("level"))
    walls = orders(spark, sf).select(key().alias("wall_ref"), F.explode(F.when(key() % 2 == 0, F.array(F.lit("G"), F.lit("G"))).otherwise(F.array(F.lit("G"), F.lit("L1")))).alias("level"))
    of = assembly.level_map(walls).select(F.col("wall_ref").alias("id"), F.col("level").alias("wall_level"))
    return assembly.resolve_level(r, levels).select("id", "level_id").join(of, "id", "left")


@query(f"""WITH {_ROWS} SELECT section, unit, count(*)::BIGINT AS rows, sum(q)::DOUBLE AS quantity, sum(q * rate)::DOUBLE AS value_ex_gst FROM t GROUP BY 1, 2""")
def q_section_summary(spark, sf):
    """(A13-A15)"""
    return takeoff.section_summary(rows(spark, sf).withColumn("value_ex_gst", F.col("quantity") * F.col("rate_per_unit")))


@query("""SELECT p_type AS board_type, 13 AS thickness_mm, 1200 AS board_width_mm, 2400 AS board_length_mm, p_brand AS level, sum(p_size)::DOUBLE AS net_area_m2, sum(2 * p_size)::DOUBLE AS installed_board_area_m2, sum(p_size % 7)::BIGINT AS sheet_count FROM part GROUP BY 1, 5""")
def q_board_summary(spark, sf):
    """(A16)"""
    d, s = F.lit, F.col("p_size")
    return assembly.board_summary(table(spark, sf, "part").select(F.col("p_type").alias("board_type"), d(13).alias("thickness_mm"), d(1200).alias("board_width_mm"), d(2400).alias("board_length_mm"), F.col("p_brand").alias("level"), s.cast("double").alias("net_area_m2"), (2 * s).cast("double").alias("installed_board_area_m2"), (s % 7).alias("sheet_count")))


@query("""SELECT lower(p_type) AS element, p_size AS place, min(CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 2 END)::INT AS from_batch FROM part GROUP BY 1, 2""")
def q_merged_batches(spark, sf):
    """Rows of several readings, the first one's of equal keys kept."""
    p = table(spark, sf, "part")
    batch = lambda d, k: d.select(F.concat(F.lit(" "), "p_type").alias("element") if k == 1 else F.upper("p_type").alias("element"), F.col("p_size").alias("place"), F.lit(k).alias("from_batch"))
    got = assembly.merge_batches([batch(p.filter("p_partkey % 2 = 0"), 1), batch(p.filter("p_partkey % 2 = 1"), 2)], ["element", "place"])
    return got.select(F.lower(F.trim("element")).alias("element"), "place", "from_batch")


@query("""WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 40)::DOUBLE AS a FROM orders) SELECT id, CASE id % 4 WHEN 0 THEN CASE WHEN a = 0 THEN 7 ELSE round(2 * a, 3) END WHEN 1 THEN greatest(0, 10 - a) WHEN 2 THEN CASE WHEN a = 0 THEN 7 ELSE round(a * 2.7, 3) END ELSE 7 END::DOUBLE AS quantity, CASE WHEN id % 4 = 0 AND a > 0 OR id % 4 = 1 OR id % 4 = 2 AND a > 0 THEN 'Mapped' ELSE 'Was' END AS status FROM o""")
def q_measured(spark, sf):
    """Quantities from shapes; without a usable one the quantity before mapping."""
    a, d = (key() % 40).cast("double"), F.lit
    r = orders(spark, sf).select(key().alias("id"), F.when(key() % 4 == 0, "m2").otherwise("m²").alias("unit"), d(1.0).alias("quantity"), d("x").alias("quantity_status"), d(7.0).alias("pre_map_quantity"), d(None).cast("double").alias("ai_baseline_quantity"), d("Was").alias("pre_map_quantity_status"))
    shape = lambda kind, basis, area, perimeter: F.struct(d(kind).alias("kind"), d(basis).alias("measurement_basis"), d(0.0).alias("length_m"), area.cast("double").alias("area_m2"), perimeter.alias("perimeter_m"))
    two = F.array(shape("polygon", "", a, d(0.0)), shape("Polygon", "", a, d(0.0)))
    less = F.array(shape("polygon", "", d(10.0), d(0.0)), shape("polygon", "deduction", a, d(0.0)))
    walls = F.array(shape("polygon", "footprint_perimeter_height", d(0.0), a))
    line = F.array(shape("line", "", d(0.0), d(0.0)))
    shapes = orders(spark, sf).select(key().alias("takeoff_row_id"), F.inline(F.when(key() % 4 == 0, two).when(key() % 4 == 1, less).when(key() % 4 == 2, walls).otherwise(line)))
    return takeoff.measured(r, shapes).select("id", "quantity", F.col("quantity_status").alias("status"))


@query(f"""WITH {_ROWS}, s AS (SELECT workspace_id, count(*)::BIGINT AS rows, count(*) FILTER (WHERE {_WORK})::BIGINT AS work_rows, array_to_string(list_sort(list(DISTINCT unit)), ',') AS units, count(*) FILTER (WHERE is_model)::BIGINT AS blockers, count(*) FILTER (WHERE q > 0) AS m FROM t GROUP BY 1)
 SELECT workspace_id, rows, work_rows, units, blockers, CASE WHEN work_rows = 0 THEN 'Measure' WHEN blockers > 0 THEN 'Resolve blockers' WHEN m < work_rows THEN 'Complete quantities' ELSE 'Review' END AS next FROM s""")
def q_status(spark, sf):
    """Counts of each workspace and what to do next."""
    r = rows(spark, sf)
    got = assembly.status(r, gates.row_signals(r))
    return got.select("workspace_id", "rows", "work_rows", F.array_join("units", ",").alias("units"), "blockers", "next")


@query(f"""WITH {_ROWS}, s AS (SELECT workspace_id, sum(q)::DOUBLE AS q, count(DISTINCT unit) AS u, min(unit) AS unit, count(*)::BIGINT AS merged FROM t WHERE id IN (SELECT id FROM t WHERE unit = 'lm' OR workspace_id % 2 = 1) GROUP BY 1) SELECT workspace_id, CASE WHEN u = 1 THEN q END AS quantity, CASE WHEN u = 1 THEN unit END AS unit, merged FROM s""")
def q_merged_rows(spark, sf):
    """Rows as one of each workspace; different units give none."""
    r = rows(spark, sf)
    ids = r.filter("workspace_id % 2 = 1 or unit = 'lm'").select("id")
    return assembly.merge_rows(r, ids).select("workspace_id", "quantity", "unit", "merged")


@query("""WITH o AS (SELECT (o_orderkey % 60)::DOUBLE AS a, CASE WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END AS out, CASE WHEN o_orderkey % 2 = 0 THEN 50 ELSE 200 END AS p FROM orders) SELECT sum(CASE WHEN out = 0 THEN a ELSE 0 END)::DOUBLE AS total_m2, sum(CASE WHEN out = 0 THEN a * least(p, 100) / 100 ELSE 0 END)::DOUBLE AS done_m2, (SELECT sum(a) FROM o)::DOUBLE AS every_m2, (SELECT sum(CASE WHEN out = 1 THEN a ELSE 0 END) FROM o)::DOUBLE AS scaffold_m2 FROM o""")
def q_completion(spark, sf):
    """Done and remaining areas, totals of surfaces."""
    areas = orders(spark, sf).select((key() % 60).cast("double").alias("area_m2"), F.when(key() % 7 == 0, "Excluded").otherwise("").alias("status"), F.when(key() % 2 == 0, 50.0).otherwise(200.0).alias("progress_pct"), (key() % 7 == 0).alias("scaffold"))
    both = assembly.surface_total(areas).withColumnRenamed("total_m2", "every_m2").crossJoin(assembly.surface_total(areas, "scaffold").withColumnRenamed("total_m2", "scaffold_m2"))  # one row each
    return takeoff.completion(areas).select("total_m2", "done_m2").crossJoin(both)


@query("""WITH o AS (SELECT o_orderkey AS key, 100.0::DOUBLE AS a, (100 + o_orderkey % 20)::DOUBLE AS b FROM orders) SELECT key, round(abs(a - b) / b, 6) AS difference, CASE WHEN key % 7 = 0 THEN 'single source' WHEN abs(a - b) / b <= 0.03 THEN 'verified' WHEN abs(a - b) / b <= 0.08 THEN 'close' ELSE 'conflict' END AS state, CASE WHEN key % 7 = 0 THEN 'review' WHEN abs(a - b) / b > 0.02 THEN 'conflict' ELSE 'verified' END AS facade FROM o WHERE key % 7 <> 0 UNION ALL SELECT key, NULL, 'single source', 'review' FROM o WHERE key % 7 = 0""")
def q_geometry_checks(spark, sf):
    """Documented against drawn areas and widths."""
    a, b = F.when(key() % 7 != 0, 100.0), (100 + key() % 20).cast("double")
    r = orders(spark, sf).select(key().alias("key"), a.alias("documented_m2"), b.alias("drawn_m2"))
    got = assembly.geometry_check(r).withColumn("facade", assembly.facade_check(F.col("documented_m2"), F.col("drawn_m2"), F.lit(3.0), F.lit(3.0)))
    return got.select("key", F.when(F.col("documented_m2").isNotNull(), F.col("difference")).alias("difference"), "state", "facade")


@query("""SELECT o_orderkey AS ref, CASE o_orderkey % 5 WHEN 0 THEN 'matched' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'unresolved' WHEN 3 THEN 'variance' ELSE 'invalid' END AS state FROM orders""")
def q_match_report(spark, sf):
    """Model elements against take-off rows."""
    model = orders(spark, sf).select(key().alias("ref"), F.lit(5.0).alias("area_m2"))
    q = F.when(key() % 5 == 0, F.array(F.lit(5.0))).when(key() % 5 == 1, F.array(F.lit(2.0), F.lit(3.0))).when(key() % 5 == 3, F.array(F.lit(6.0))).when(key() % 5 == 4, F.array(F.lit(-1.0))).otherwise(F.array().cast("array<double>"))
    return assembly.match_report(model, orders(spark, sf).select(key().alias("ref"), F.explode(q).alias("quantity"))).select("ref", "state")


@query("""WITH o AS (SELECT o_orderkey AS facade_id, 10 + o_orderkey % 30 AS a FROM orders) SELECT facade_id, 'A' AS code, 'y' AS axis, 0.0::DOUBLE AS "from", (a + 90) / 2.0::DOUBLE AS "to" FROM o UNION ALL SELECT facade_id, 'B', 'y', (a + 90) / 2.0, 100.0 FROM o""")
def q_bands(spark, sf):
    """Material bands cut midway between their codes."""
    group = lambda code, cy: F.struct(F.lit(code).alias("code"), F.lit(50.0).alias("cx"), cy.alias("cy"), *[F.lit(v).alias(c) for c, v in (("x", 0.0), ("y", 0.0), ("w", 100.0), ("h", 100.0))])
    return assembly.bands(orders(spark, sf).select(key().alias("facade_id"), F.inline(F.array(group("A", (10 + key() % 30).cast("double")), group("B", F.lit(90.0))))))


@query("""SELECT 'PB' || (max(o_orderkey) + 1 + 20000)::VARCHAR AS job_no, (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders) x)::BIGINT AS customers FROM orders""")
def q_next_job(spark, sf):
    """The number after the last job's; rows numbered over a whole table."""
    jobs = orders(spark, sf).select(F.concat(F.when(key() % 10 == 9, "XX").otherwise("PB"), (key() + 20000).cast("string")).alias("job_no"))
    jobs = jobs.unionAll(orders(spark, sf).agg(F.concat(F.lit("PB"), F.max(key()) + 20000)))
    numbers = scratch.numbered(orders(spark, sf).select("o_custkey").distinct(), [F.col("o_custkey")]).agg(F.max("number").alias("customers"))
    return assembly.next_job(jobs).crossJoin(numbers)  # one row each


@query("""WITH n AS (SELECT DISTINCT o_custkey % 7 AS w, o_orderpriority AS p FROM orders), a AS (SELECT 'old' AS category, w::INT AS page_no, p AS code, 'm' AS message, 0 AS k FROM n WHERE w < 3 UNION ALL SELECT 'old', w::INT, p, 'm', 1 FROM n WHERE w >= 3) SELECT category, page_no, code, message, row_number() OVER (ORDER BY k, category, page_no, code, message)::BIGINT AS number FROM a""")
def q_issues(spark, sf):
    """Issues with new ones added, equal ones once, numbered over the whole."""
    every = orders(spark, sf).select(F.lit("old").alias("category"), (F.col("o_custkey") % 7).cast("int").alias("page_no"), F.col("o_orderpriority").alias("code"), F.lit("m").alias("message"))
    return assembly.unregistered_issues(every.filter("page_no < 3").distinct(), every)


@query("""WITH s AS (SELECT o_orderkey AS seg_id, o_custkey % 30 AS page_id, (o_orderkey % 500)::DOUBLE AS len FROM orders) SELECT seg_id, page_id, len AS length_pt FROM s WHERE len >= 200""")
def q_long_walls(spark, sf):
    """Wall lines of a least length, the longest first."""
    seg = orders(spark, sf).select(key().alias("seg_id"), (F.col("o_custkey") % 30).alias("page_id"), F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), (key() % 500).cast("double").alias("x2"), F.lit(0.0).alias("y2"))
    return assembly.long_walls(seg).select("seg_id", "page_id", "length_pt")


@query("""WITH f AS (SELECT o_custkey AS workspace_id, o_orderkey AS id, (o_orderkey % 30) * 4 AS a FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY workspace_id ORDER BY a DESC, id) AS n FROM f), p AS (SELECT o_orderkey AS id FROM orders ORDER BY 1 LIMIT 30 OFFSET 60) SELECT 'footprint' AS kind, id FROM b WHERE n = 1 UNION ALL SELECT 'page', id FROM p UNION ALL SELECT 'first', id FROM (SELECT o_orderkey AS id FROM orders ORDER BY 1 LIMIT 5) x""")
def q_bounded_reads(spark, sf):
    """The largest footprint, a page of a register, the first rows of an order, the first source with rows."""
    r = orders(spark, sf).select(key().alias("id"), F.col("o_custkey").alias("workspace_id"), (key() % 30).cast("double").alias("width"), F.lit(4.0).alias("depth"))
    some, more = assembly.limited(r.select("id"), ["id"], 5)
    name, first = assembly.first_available(("none", r.filter("false")), ("page", assembly.register_page(r, 2)))
    kind = lambda d, n: d.select(F.lit(n).alias("kind"), "id")
    return kind(assembly.largest_footprint(r), "footprint").unionAll(kind(first, name)).unionAll(kind(some, "first" if more else "all"))


@query("""WITH o AS (SELECT o_orderkey AS id FROM orders) SELECT id, 'b,a ' || id AS names, CASE WHEN id % 2 = 0 THEN 'East,South' ELSE '' END AS missing, 'scale:ok' AS ledger, CASE id % 3 WHEN 0 THEN 'schedule' WHEN 1 THEN 'plan' ELSE 'unknown' END AS provenance FROM o""")
def q_lists(spark, sf):
    """Distinct names in order, sides that are missing, ledgers, where a number was read."""
    d = F.lit
    names = assembly.distinct_in_order(F.array(d(" b"), d("b"), d(""), F.concat(d("a "), key()), d("b ")))
    sides = F.array(*[d(s) for s in ("South", "North", "East")])
    found = F.when(key() % 2 == 0, F.array(d("North"))).otherwise(sides)
    ledger = assembly.with_reason(d(None).cast("array<struct<stage:string,outcome:string>>"), "scale", d("ok"))
    r = orders(spark, sf).select(key().alias("id"), F.array_join(names, ",").alias("names"), F.array_join(assembly.missing(sides, found), ",").alias("missing"), F.array_join(F.transform(ledger, lambda x: F.concat(x["stage"], d(":"), x["outcome"])), ",").alias("ledger"), key().cast("string").alias("source_reference"))
    ref = lambda k: orders(spark, sf).filter(key() % 3 <= k).select(key().cast("string").alias("source_reference"))
    return assembly.provenance(r, [("schedule", ref(0)), ("plan", ref(1))]).select("id", "names", "missing", "ledger", "provenance")


@query("""SELECT 'PT' || (p_partkey % 40) AS code, min(CASE WHEN p_partkey % 3 = 0 THEN 'manual' WHEN p_partkey % 3 = 1 THEN 'nschedule' ELSE 'olegend' END) AS k, CASE min(CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 3 = 1 THEN 2 ELSE 3 END) WHEN 1 THEN 'manual' WHEN 2 THEN 'schedule' ELSE 'legend' END AS origin, CASE min(CASE WHEN p_partkey % 3 = 0 THEN 9 WHEN p_partkey % 3 = 1 THEN 2 ELSE 3 END) WHEN 2 THEN 'of schedule' WHEN 3 THEN 'of legend' END AS substrate FROM part GROUP BY 1""")
def q_merged_dictionary(spark, sf):
    """Manual codes before scheduled ones before the legend's; later ones fill gaps."""
    k = F.col("p_partkey")
    p = lambda n, s: table(spark, sf, "part").filter(k % 3 == n).select(F.concat(F.lit("PT"), k % 40).alias("code"), F.lit("d").alias("description"), F.lit(s).cast("string").alias("substrate")).distinct()
    got = registers.merged_dictionary(p(0, None), p(1, "of schedule"), p(2, "of legend"))
    rank = F.when(F.col("origin") == "manual", "manual").when(F.col("origin") == "schedule", "nschedule").otherwise("olegend")
    return got.select("code", rank.alias("k"), "origin", "substrate")


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k FROM orders) SELECT id, {choice(("650.0", "220.0", "15.0", "42.0", "0.0", "25.0"), "k")}::DOUBLE AS rate, {choice(("2", "3", "3", "3", "2", "3"), "k")}::INT AS coats, round(CASE WHEN k % 6 IN (0, 4) THEN 12 * 2 / 10.0 WHEN k % 6 = 1 THEN 12 * 3 / 12.0 ELSE 12 * 3 / 16.0 END, 6)::DOUBLE AS litres FROM o""")
def q_rates_and_systems(spark, sf):
    """Default rates, and paint systems by code, by substrate, or the default."""
    lit = lambda *v: pick([F.lit(x) for x in v], key())
    element, substrate, unit = lit("Entry door", "Door", "Skirting", "Walls", "Yard", "Ceiling"), lit("", "Timber", "", "Brick", "", ""), lit("No.", "No.", "lm", "m²", "m²", "m²")
    r = orders(spark, sf).select(key().alias("id"), element.alias("element"), substrate.alias("substrate"), unit.alias("unit"), lit("p1", "", "", "", "P1 ", "").alias("finish_code"), F.lit(12.0).alias("area_m2"))
    known = table(spark, sf, "region").filter("r_regionkey < 2").select(pick([F.lit("P1"), F.lit("P2")], F.col("r_regionkey")).alias("finish_code"), pick([F.lit(None).cast("string"), F.lit("timber")], F.col("r_regionkey")).alias("kind"), pick([F.lit(2), F.lit(3)], F.col("r_regionkey")).alias("coats"), pick([F.lit(10.0), F.lit(12.0)], F.col("r_regionkey")).alias("coverage"))
    got = assembly.systems(r, known)
    return got.select("id", pricing.default_rate(F.col("substrate"), F.col("element"), F.lit(""), F.col("unit")).alias("rate"), "coats", F.round("litres", 6).alias("litres"))


@query("""SELECT o_custkey AS workspace_id, '10.0,22.5' AS pitches, bool_or(o_orderkey % 2 = 0) AS parapet, max((o_orderkey % 9)::DOUBLE) AS roof_z FROM orders GROUP BY 1""")
def q_roofs(spark, sf):
    """Pitches that texts state and the height of roofs. (F130, F131)"""
    w = F.col("o_custkey").alias("workspace_id")
    pages = orders(spark, sf).select(w, F.concat(F.lit("pitch 22.5° or 10 deg"), F.when(key() % 2 == 0, " parapet").otherwise("")).alias("extracted_text"))
    got = assembly.roof(pages, orders(spark, sf).select(w, (key() % 9).cast("double").alias("height_m")))
    return got.select("workspace_id", F.array_join(F.transform("pitches_deg", lambda x: x.cast("string")), ",").alias("pitches"), "parapet", "roof_z")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 AS page_id FROM orders) SELECT page_id, count(*)::BIGINT AS n, bool_or(k % 2 = 1) AS replaced FROM (SELECT k, page_id FROM o WHERE page_id >= 5 UNION ALL SELECT 2 * k + 1, page_id FROM o WHERE page_id < 5 AND k % 3 = 0) x GROUP BY 1""")
def q_saved_shapes(spark, sf):
    """Shapes of pages replaced by new ones."""
    old = orders(spark, sf).select(key().alias("k"), (key() % 10).alias("page_id"))
    new = old.filter("page_id < 5 and k % 3 = 0").select((2 * F.col("k") + 1).alias("k"), "page_id")
    every = old.select("page_id").distinct().filter("page_id < 5")
    kept = assembly.save_shapes(old.join(every, "page_id", "left_semi"), new).unionByName(old.join(every, "page_id", "left_anti"))
    return kept.groupBy("page_id").agg(F.count("*").alias("n"), F.bool_or(F.col("k") % 2 == 1).alias("replaced"))


@query("""WITH o AS (SELECT o_orderkey % 40 AS g, o_orderkey % 3 AS c, (o_orderkey % 40 + 1)::DOUBLE AS a FROM orders) SELECT 'c' || c AS class, sum(DISTINCT a)::DOUBLE AS area_m2, count(DISTINCT g)::BIGINT AS regions FROM o GROUP BY 1""")
def q_overhead(spark, sf):
    """Overhead areas by class, equal regions once."""
    return assembly.overhead(orders(spark, sf).select((key() % 40).alias("geometry"), F.concat(F.lit("c"), key() % 3).alias("class"), (key() % 40 + 1).cast("double").alias("area_m2")))


@query(f"""WITH {_ROWS}, s AS (SELECT workspace_id, CASE WHEN element = 'Ceiling' THEN 'CEILING_FLAT' WHEN element = 'Floor' THEN 'FLOOR_EPOXY' ELSE 'INTERNAL_WALL' END AS surface_type, q FROM t), w AS (SELECT workspace_id, sum(q)::DOUBLE AS adjusted FROM t GROUP BY 1)
 SELECT workspace_id, surface_type, count(*)::BIGINT AS n, sum(q)::DOUBLE AS net_m2, any_value(adjusted) AS adjusted, 0::BIGINT AS scaffolds FROM s JOIN w USING (workspace_id) GROUP BY 1, 2""")
def q_surfaces_and_standards(spark, sf):
    """Kinds of surfaces, and the standards' heights and surcharges."""
    r = rows(spark, sf)
    kinds = schedule.surface_types(r).groupBy("workspace_id", "surface_type").agg(F.count("*").alias("n"), F.sum("net_paintable_area_m2").alias("net_m2"))
    adjusted = schedule.standards(r).groupBy("workspace_id").agg(F.sum("adjusted_quantity").alias("adjusted"), F.count_if("requires_scaffold").alias("scaffolds"))
    return kinds.join(adjusted, "workspace_id")


@query(f"""WITH {_ROWS}, c AS (SELECT *, CASE level WHEN 'Ground' THEN 'Ground' WHEN 'Level 1' THEN 'Level 1' WHEN 'Basement 1' THEN 'Basement 1' WHEN 'Roof' THEN 'Roof' ELSE 'Unassigned' END AS at_level FROM t),
 s AS (SELECT workspace_id, 1 AS stage, at_level, q FROM c WHERE is_floor AND q > 0 UNION ALL SELECT workspace_id, 2, at_level, q FROM c WHERE NOT is_floor AND element = 'Ceiling' AND q > 0 UNION ALL SELECT workspace_id, 3, at_level, q FROM c WHERE NOT is_floor AND section = 'Internal' AND element = 'Walls' AND q > 0
 UNION ALL SELECT workspace_id, 4, at_level, q FROM c WHERE NOT is_floor AND element = 'Door' UNION ALL SELECT workspace_id, 5, at_level, q FROM (SELECT DISTINCT workspace_id, at_level, level, element, unit, q FROM c WHERE NOT is_floor AND section = 'External facade') x
 UNION ALL SELECT s_suppkey, 6, 'External', 0 FROM supplier WHERE s_suppkey <= 10 AND s_suppkey > 0)
 SELECT workspace_id, stage, at_level AS level, count(*)::BIGINT AS lines, sum(q)::DOUBLE AS quantity FROM s GROUP BY 1, 2, 3""")
def q_commercial_schedule(spark, sf):
    """The commercial schedule's measured stages."""
    r = rows(spark, sf)
    pages = r.select("workspace_id").distinct().withColumn("words", F.lit("Floor plan, reflected ceiling plan"))
    finishes = table(spark, sf, "supplier").filter("s_suppkey between 1 and 10").select(F.col("s_suppkey").alias("workspace_id"), F.lit("PT9").alias("code"), F.lit("Soffit lining").alias("description"))
    got = schedule.commercial(r, pages, finishes)
    return got.groupBy("workspace_id", "stage", "level").agg(F.count("*").alias("lines"), F.sum("base_qty").alias("quantity"))


@query("""WITH o AS (SELECT o_orderkey AS w FROM orders) SELECT w AS workspace_id, 1 AS stage, 'Internal floor area' AS element, 40.0::DOUBLE AS base_qty, 'Measured basis' AS confidence, CASE WHEN w % 3 = 0 THEN 75.0 ELSE 66.7 END::DOUBLE AS completeness_pct FROM o UNION ALL SELECT w, 2, 'General painted ceilings', 40.0, 'Derived basis', 75.0 FROM o WHERE w % 3 = 0
 UNION ALL SELECT w, 3, 'Internal walls', 0.0, 'Pending', CASE WHEN w % 3 = 0 THEN 75.0 ELSE 66.7 END FROM o UNION ALL SELECT w, 4, 'Apartment entry doors & frames', 1.0, CASE WHEN w % 3 = 0 THEN 'High' ELSE 'Derived' END, CASE WHEN w % 3 = 0 THEN 75.0 ELSE 66.7 END FROM o""")
def q_derived_schedule(spark, sf):
    """The schedule's derived and pending lines, where only floors are measured."""
    d = F.lit
    r = orders(spark, sf).select(key().alias("workspace_id"), key().alias("id"), d("Unit 203").alias("location"), d("Floor").alias("element"), d("Internal").alias("section"), d("").alias("substrate"), d("m²").alias("unit"), d(40.0).alias("quantity"), d("floor_area").alias("row_role"), d("p1").alias("source_page"), *[d(None).cast("string").alias(c) for c in ("confidence", "quantity_status")])
    pages = orders(spark, sf).select(key().alias("workspace_id"), F.when(key() % 3 == 0, "RCP and door schedule").otherwise("floor plan").alias("words"))
    none = table(spark, sf, "supplier").filter("false").select(F.col("s_suppkey").alias("workspace_id"), F.col("s_name").alias("code"), F.col("s_name").alias("description"))
    lines = schedule.commercial(r, pages, none)
    return lines.select("workspace_id", "stage", "element", "base_qty", "confidence").join(schedule.progress(lines).select("workspace_id", "completeness_pct"), "workspace_id")


@query("""SELECT o_orderkey AS page_id, c.code, CASE WHEN c.code = 'PT1' THEN 'Low sheen' ELSE 'Unknown' END AS description FROM orders, (VALUES ('PT1'), ('WC7')) c(code)""")
def q_code_occurrences(spark, sf):
    """Finish codes of pages with their descriptions."""
    pages = orders(spark, sf).select(key().alias("id"), F.lit(1).alias("workspace_id"), F.lit("PT1 walls, WC7 and pt1").alias("extracted_text"))
    known = table(spark, sf, "region").filter("r_regionkey = 0").select(F.lit("PT1").alias("code"), F.lit("Low sheen").alias("description"))
    return registers.occurrences(pages, known).select("page_id", "code", "description")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 20 AS w, o_orderkey % 3 AS n FROM orders) SELECT w AS room, CASE WHEN bool_or(n = 0) THEN 0 WHEN bool_or(n = 1) THEN 1 ELSE 2 END::BIGINT AS priority FROM o GROUP BY 1""")
def q_best_heights(spark, sf):
    """The best evidence of a height by priority, confidence and id."""
    from ..operators import evidence

    got = evidence.best_height(orders(spark, sf).select((key() % 20).alias("room"), (key() % 3).alias("priority"), F.lit(0.5).alias("confidence"), key().alias("id")), ["room"])
    return got.select("room", "priority")


@query(f"""WITH {_ROWS} SELECT id, is_model AS model, CASE WHEN is_model THEN 'APPROVED' ELSE 'APPROVED' END AS authority FROM t WHERE is_model""")
def q_approved_rows(spark, sf):
    """Rows approved in their present state."""
    got = takeoff.approve(rows(spark, sf).filter("row_role = 'model-surface'"), "model", "AB", "2024-01-01")
    return got.select("id", takeoff.is_model_surface().alias("model"), takeoff.authority().alias("authority"))


@query("""SELECT n_regionkey::BIGINT AS region, n_name AS element, n_nationkey::DOUBLE AS quantity FROM nation WHERE n_nationkey > 0""")
def q_workbooks(spark, sf):
    """A workbook for each key, read back by its headings."""
    nations = table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_name").alias("Item"), F.col("n_nationkey").alias("Qty"), F.lit("a < b & \"c\"").alias("Notes"))
    books = writers.workbooks(nations, "region", ["Item", "Qty", "Notes"]).select(F.col("region").cast("string").alias("path"), "content")
    got = readers.takeoff_rows(readers.workbook_cells(books)).filter(F.col("notes") == "a < b & \"c\"")
    return got.select(F.col("file").cast("long").alias("region"), "element", "quantity")


@query("""WITH c AS (SELECT c_custkey AS k, c_custkey % 9 AS m FROM customer) SELECT k AS workspace_id, o.id, CASE WHEN o.id = 'x' AND m = 1 OR o.id = 'loop' OR o.id = 'twice' OR o.id = 'lost' THEN NULL ELSE 'site' END AS root, CASE o.id WHEN 'site' THEN 0 WHEN 'floor' THEN 1 WHEN 'wall' THEN 2 WHEN 'hole' THEN 3 END::BIGINT AS depth, CASE o.id WHEN 'lost' THEN 'orphan' WHEN 'loop' THEN 'cycle' WHEN 'twice' THEN 'duplicate_id' ELSE 'ok' END AS state
 FROM c, (VALUES ('site'), ('floor'), ('wall'), ('hole'), ('lost'), ('loop'), ('twice')) o(id)""")
def q_scene_graph(spark, sf):
    """Objects of scenes with their roots; ambiguous ids, orphans and cycles are told."""
    item = lambda i, up: F.struct(F.lit(i).alias("object_id"), F.lit(up).cast("string").alias("parent_id"), F.lit("k").alias("kind"))
    items = F.array(item("site", None), item("floor", "site"), item("wall", "floor"), item("hole", "wall"), item("lost", "nowhere"), item("loop", "loop"), item("twice", "site"), item("twice", "floor"))
    got = provenance.scene_graph(dealt(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("workspace_id"), F.inline(items)))
    return got.select("workspace_id", F.col("object_id").alias("id"), "root", "depth", "state")


@query("""WITH o AS (SELECT o_orderkey AS id, (1 + o_orderkey % 50)::DOUBLE AS w FROM orders) SELECT id AS shape_id, CASE WHEN id % 3 > 0 THEN round(w * 4 * 0.25, 6) END AS area_m2, CASE WHEN id % 3 > 0 THEN round((w + 4) * 2 * 0.5, 6) END AS perimeter_m, CASE WHEN id % 3 > 0 THEN 0.8 ELSE 0.4 END::DOUBLE AS confidence, w AS x1 FROM o""")
def q_surface_evidence(spark, sf):
    """Evidence of filled polygons. (F116)"""
    at = lambda x, y: F.struct(x.alias("x"), F.lit(float(y)).alias("y"))
    w, zero = (1 + key() % 50).cast("double"), F.lit(0.0)
    shapes = orders(spark, sf).select(F.lit(1).alias("workspace_id"), F.lit(1).alias("page_id"), key().alias("shape_id"), F.explode(F.array(F.array(at(zero, 0), at(w, 0), at(w, 4), at(zero, 4)), F.array(at(zero, 0), at(w, 0)))).alias("points"), F.when(key() % 3 > 0, 0.5).alias("m_per_pt"), F.lit(0.8).alias("scale_confidence"))
    got = provenance.surface_evidence(shapes)
    return got.select("shape_id", F.round("area_m2", 6).alias("area_m2"), F.round("perimeter_m", 6).alias("perimeter_m"), "confidence", F.col("box.x1").alias("x1"))


@query("""SELECT o_orderkey AS page_id, f.field, CASE f.field WHEN 'scale' THEN '1:' || (10 + o_orderkey % 90) ELSE chr((65 + o_orderkey % 20)::INT) END AS value FROM orders, (VALUES ('scale'), ('revision')) f(field)""")
def q_placed_fields(spark, sf):
    """Fields of title blocks by the nearest fitting value."""
    word = lambda n, t, x, y: F.struct(F.lit(n).alias("word_id"), (t if hasattr(t, "alias") else F.lit(t)).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    scale, rev = F.concat(F.lit("1:"), 10 + key() % 90), F.lower(F.char(65 + key() % 20))
    words = F.array(word(1, "Scale:", 800.0, 900.0), word(2, scale, 850.0, 900.0), word(3, "1:5000", 850.0, 980.0), word(4, "REV", 700.0, 950.0), word(5, F.upper(rev), 700.0, 965.0), word(6, "Scale", 10.0, 10.0), word(7, "1:20", 20.0, 10.0))
    rows_ = orders(spark, sf).select(key().alias("page_id"), F.inline(words)).withColumns({"page_width": F.lit(1000.0), "page_height": F.lit(1000.0)})
    return provenance.placed_fields(rows_).select("page_id", "field", "value")


@query(f"""WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 9 + 1)::VARCHAR AS n FROM orders) SELECT id, 'a b ' || n AS clean, 'm2' || n AS key, {choice(("'Unit ' || n || ' | Level 2'", "'Apartment ' || n || ' | Ground'", "'Block ' || n || ' | Unassigned'"), "id")} AS scope, round(abs(3 * n::INT) / 5.0, 6) AS off_line, round(4 * n::INT / 5.0, 6) AS along, {choice(("'Known'", "'Unknown'", "'Unknown'"), "id")} AS label FROM o""")
def q_basics(spark, sf):
    """Cleaned texts, keys, scopes, places along lines, dictionaries. (F1-F3, F12, F120, F122, J40)"""
    d, n = F.lit, key() % 9 + 1
    said = pick((F.concat(d("unit  "), n, d(", level 2")), F.concat(d("Apartment "), n, d(" ground floor")), F.concat(d("block "), n)), key())
    line = F.struct(d(0.0).alias("x1"), d(0.0).alias("y1"), d(8.0).alias("x2"), d(6.0).alias("y2"))
    x = n.cast("double")
    r = orders(spark, sf).select(key().alias("id"), text.clean(F.concat(d("  a \n b "), n)).alias("clean"), text.norm_key(F.concat(d("M² "), n)).alias("key"), text.scope(said).alias("scope"), F.round(geometry.line_distance(x, d(0.0), line), 6).alias("off_line"), F.round(geometry.along(x, d(0.0), line), 6).alias("along"), (key() % 3).alias("code"))
    known = table(spark, sf, "region").filter("r_regionkey = 0").select(F.col("r_regionkey").cast("long").alias("code"), d("Known").alias("label"))
    return fusion.lookup(r, known, "code", "label").drop("code")


@query("""SELECT 'regions' AS name, (SELECT count(*) FROM region)::BIGINT AS rows UNION ALL SELECT 'customers', (SELECT count(*) FROM customer) UNION ALL SELECT 'missing', 0""")
def q_ensured(spark, sf):
    """Tables of a shared folder made where they are missing; those that are there keep their rows."""
    at = scratch.path(spark, "shared")
    for name, source in (("regions", "region"), ("customers", "customer")):
        table(spark, sf, source).write.parquet(f"{at}/{name}")
    schemas = {name: spark.read.parquet(f"{at}/{name}").schema.simpleString()[7:-1].replace(":", " ") for name in ("regions", "customers")}
    made = writers.ensure(spark, at, {**schemas, "missing": "id long"})
    assert made == ["missing"]
    counts = [spark.read.parquet(f"{at}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("rows")) for name in (*schemas, "missing")]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])
