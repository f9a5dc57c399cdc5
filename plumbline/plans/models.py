"""Driver queries: the canonical model over orders as walls and lines as openings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import model, surface_process
from ..scratch import shuffled
from .shared import query, table


@query("""WITH w AS (SELECT o_orderkey AS k, round(o_totalprice % 40 + 1, 2) AS len, o_orderkey % 11 = 0 AS bad, CASE WHEN o_orderkey % 13 > 0 THEN 'level' || (o_orderkey % 3 + 1) ELSE 'unresolved' END AS lvl FROM orders),
 o AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS k, l_quantity % 30 AS off, round(l_discount * 20 + 0.3, 3) AS wd, round(l_tax * 20 + 0.4, 3) AS ht, (l_partkey % 10) / 10.0::DOUBLE AS sill, l_partkey % 17 = 0 AS host, l_suppkey % 9 = 0 AS says, l_returnflag = 'A' AS auth, l_linestatus = 'F' AND l_partkey % 5 = 0 AS ex FROM lineitem),
 c AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY auth, CASE WHEN host THEN 1 ELSE 0 END, ex, ht, CASE WHEN says THEN 1 ELSE 0 END, off, sill, wd) AS n FROM o),
 m AS (SELECT c.*, len, bad OR len IS NULL AS lost, CASE WHEN host THEN 'wrong_host' WHEN says AND lvl <> 'level1' THEN 'wrong_level' WHEN off < 0 OR off + wd > len + 1e-6 OR sill + ht > 3 + 1e-6 THEN 'invalid_geometry' WHEN ex THEN 'manual_exclusion' WHEN auth THEN 'physical_b5_authorised' ELSE 'physical_not_authorised' END AS state FROM c LEFT JOIN w ON w.k = c.k WHERE n = 1),
 p AS (SELECT * FROM m WHERE NOT lost AND state LIKE 'physical%'),
 x AS (SELECT DISTINCT a.id FROM p a JOIN p b ON a.k = b.k AND a.id <> b.id AND least(a.off + a.wd, b.off + b.wd) - greatest(a.off, b.off) > 0.001 AND least(a.sill + a.ht, b.sill + b.ht) - greatest(a.sill, b.sill) > 0.001),
 r AS (SELECT m.id, k, CASE WHEN x.id IS NOT NULL THEN 'conflict_overlap' ELSE state END AS state FROM m LEFT JOIN x ON x.id = m.id WHERE NOT lost)
 SELECT 'opening' AS part, id::VARCHAR AS id, state FROM r UNION ALL SELECT 'wall', 'W' || k, CASE WHEN k IN (SELECT k FROM r WHERE state = 'physical_b5_authorised') THEN 'deducts' ELSE 'stands' END FROM w WHERE NOT bad
 UNION ALL SELECT 'left out', 'W' || k, 'Missing or invalid start/end coordinates' FROM w WHERE bad UNION ALL SELECT 'left out', id::VARCHAR, 'Unknown or rejected wall' FROM m WHERE lost UNION ALL SELECT 'left out', id::VARCHAR, 'Repeated id' FROM c WHERE n > 1
 UNION ALL SELECT 'left out', id::VARCHAR, state FROM r WHERE state IN ('wrong_host', 'wrong_level', 'conflict_overlap') UNION ALL SELECT 'left out', m.id::VARCHAR, 'Invalid opening geometry: ' || CASE WHEN off < 0 OR off + wd > len + 1e-6 THEN 'outside_length' ELSE 'outside_height' END FROM m WHERE NOT lost AND state = 'invalid_geometry'""")
def q_canonical_model(spark, sf):
    """Walls and openings of each workspace with their states, and the ledger of what was left out."""
    o, line, d = table(spark, sf, "orders"), table(spark, sf, "lineitem"), F.lit
    k, ws = F.col("o_orderkey"), d(1).cast("long").alias("workspace_id")
    name = lambda c: F.concat(d("W"), c)
    length = F.when(k % 11 != 0, F.round(F.col("o_totalprice") % 40 + 1, 2))
    walls = o.select(ws, name(k).alias("wall_ref"), d(0.0).alias("x1"), d(0.0).alias("y1"), length.alias("x2"), F.when(length.isNotNull(), 0.0).alias("y2"), d(3.0).alias("height_m"), d(None).cast("double").alias("thickness_m"), F.when(k % 2 == 0, "Confirmed").alias("height_status"), F.when(k % 13 > 0, F.concat(d("Level "), k % 3 + 1)).alias("level"), d(True).alias("takeoff_eligible"))
    part = F.col("l_partkey")
    openings = line.select(
        ws, name(F.col("l_orderkey")).alias("wall_ref"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("id"), (F.col("l_quantity") % 30).alias("offset_m"), F.round(F.col("l_discount") * 20 + 0.3, 3).alias("width_m"), F.round(F.col("l_tax") * 20 + 0.4, 3).alias("height_m"), (part % 10 / 10.0).alias("sill_m"),
        F.when(part % 17 == 0, "elsewhere").alias("claimed_wall_ref"), F.when(F.col("l_suppkey") % 9 == 0, "LEVEL-1").alias("level"), (F.col("l_returnflag") == "A").alias("authorised"), ((F.col("l_linestatus") == "F") & (part % 5 == 0)).alias("excluded"))
    levels = o.select(ws, F.concat(d("Level "), k % 3 + 1).alias("name"), d(None).cast("double").alias("elevation_m"))
    point = "array<struct<x:double,y:double>>"
    none = o.filter("false")
    floors = none.select(ws, d("").alias("id"), d(None).cast(point).alias("points"), *[d(None).cast("double").alias(c) for c in ("page_width_px", "page_height_px", "px_per_m", "manual_m2")], d("").alias("level"))
    caps = none.select(ws, d("").alias("id"), d(None).cast(point).alias("points"), d(0.0).alias("z"), d("").alias("level"))
    m = model.canonical(levels, walls, openings, floors, caps, validated=True)
    out = m.openings.select(d("opening").alias("part"), "id", F.col("physical_state").alias("state"))
    out = out.unionAll(m.walls.select(d("wall"), "wall_ref", F.when(F.col("deduction_authority"), "deducts").otherwise("stands")))
    return out.unionAll(m.ledger.select(d("left out"), "id", "reason"))


@query("""WITH p AS (SELECT c_custkey AS k, c_custkey % 11 > 0 AS doc, c_custkey % 13 > 0 AS readable, CASE WHEN c_custkey % 5 = 0 THEN 'w' END AS we, CASE WHEN c_custkey % 7 = 0 THEN 'h' END AS he, CASE WHEN c_custkey % 6 = 0 THEN 't' END AS te, c_nationkey FROM customer),
 s AS (SELECT o_custkey AS k, 'fill' AS kind, o_orderkey AS id, (o_orderkey % 40) * 60 AS x FROM orders UNION ALL SELECT k, 'hatch', k, 120 FROM p WHERE c_nationkey % 3 = 0),
 e AS (SELECT s.k, kind, id, te IS NULL AND x + 20 <= 1000 AS tied, we, te FROM s JOIN p ON p.k = s.k WHERE doc AND readable AND (kind = 'fill' OR he IS NULL)),
 c AS (SELECT k, count(*) FILTER (kind = 'fill') AS fills, count(*) FILTER (kind = 'hatch') AS hatches, count(*) FILTER (tied) AS associated, count(*) FILTER (NOT tied) AS unassociated, count(*) FILTER (kind = 'hatch' AND we IS NOT NULL OR NOT tied AND te IS NOT NULL) AS to_check FROM e GROUP BY 1)
 SELECT p.k AS page_id, CASE WHEN NOT doc OR NOT readable THEN 'error' WHEN fills IS NULL THEN CASE WHEN he IS NULL THEN 'no_fills' ELSE 'partial' END WHEN coalesce(we, he, te) IS NULL THEN 'ok' ELSE 'partial' END AS status, CASE WHEN NOT doc THEN 'document' WHEN NOT readable THEN 'page' WHEN fills IS NULL THEN CASE WHEN he IS NULL THEN 'fills' ELSE 'hatches' END ELSE 'done' END AS stage,
 CASE WHEN NOT doc THEN 'no document' WHEN NOT readable THEN 'page can''t be read' WHEN fills IS NULL AND he IS NULL THEN 'nothing is filled or hatched' ELSE coalesce(we, he, te) END AS reason, coalesce(fills, 0)::BIGINT AS fills, coalesce(hatches, 0)::BIGINT AS hatches, (CASE WHEN doc AND readable AND we IS NULL THEN 1 ELSE 0 END)::BIGINT AS codes, coalesce(associated, 0)::BIGINT AS associated, coalesce(unassociated, 0)::BIGINT AS unassociated, coalesce(to_check, 0)::BIGINT AS to_check FROM p LEFT JOIN c ON c.k = p.k""")
def q_surface_process(spark, sf):
    """How far each page's surfaces came, why a page stopped, and what is to be checked. (F117)"""
    c, o, d = table(spark, sf, "customer"), table(spark, sf, "orders"), F.lit
    k = F.col("c_custkey")
    fails = lambda n, what: F.when(k % n == 0, what)
    pages = c.select(d(1).cast("long").alias("workspace_id"), k.alias("page_id"), (k % 11 > 0).alias("has_document"), (k % 13 > 0).alias("readable"), fails(5, "w").alias("words_error"), fails(7, "h").alias("hatch_error"), fails(6, "t").alias("targets_error"), d(0.01).alias("m_per_pt"), d(0.9).alias("scale_confidence"))
    at = lambda x, y: F.struct(x.cast("double").alias("x"), d(float(y)).alias("y"))
    square = lambda x, n: F.array(at(x, 10), at(x + n, 10), at(x + n, 10 + n), at(x, 10 + n))
    fills = o.select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("shape_id"), square(F.col("o_orderkey") % 40 * 60, 20).alias("points"))
    hatches = c.filter("c_nationkey % 3 = 0").select(k.alias("page_id"), k.alias("shape_id"), square(d(120), 20).alias("points"))
    words = c.select(k.alias("page_id"), d(1).alias("word_id"), d("PT01").alias("text"), d(125.0).alias("x"), d(15.0).alias("y"))
    targets = c.select(k.alias("page_id"), d("wall").alias("id"), F.array(at(d(0), 0), at(d(1000), 0), at(d(1000), 100), at(d(0), 100)).alias("points"))
    evidence, ledger = surface_process.processed(pages, fills, hatches, words, targets)
    check = evidence.groupBy("page_id").agg(F.count_if(F.col("status") == "needs_check").alias("to_check"))
    return ledger.drop("workspace_id").join(shuffled(check), "page_id", "left").fillna(0, ["to_check"])
