"""Driver queries that lay take-off rows, drawings, openings and page geometry out of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, pricing, text
from ..operators import fusion, gates, graph, openings, pages, registers, takeoff
from .shared import dealt, query, table

_TEXTS = {c: "string" for c in takeoff.BOUND if c not in ("workspace_id", "quantity", "coats", "coverage_m2_per_litre", "productivity_m2_per_hour", "rate_per_unit")}
_PLACES = ("Ground floor", "Level 1", "lvl 2", "Basement 1", "Roof", "shed")
_LEVELS = ("Ground", "Level 1", "Level 2", "Basement 1", "Roof", "Unassigned")


def _pick(values, key):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key + 1).cast("int"))


def rows(spark, sf):
    """Take-off rows out of order lines."""
    k = F.col("l_partkey") + F.col("l_linenumber")
    named = {
        "id": F.col("l_orderkey") * 8 + F.col("l_linenumber"), "workspace_id": F.col("l_suppkey") % 10 + 1, "section": _pick(("Internal", "External facade", "Internal"), k % 3), "element": _pick(("Walls", "Ceiling", "Floor", "Door"), k % 4),
        "location": _pick(_PLACES, k % 6), "unit": _pick(("m²", "lm", "No.", "m²", "L"), k % 5), "quantity": F.round("l_quantity"), "rate_per_unit": F.round(F.col("l_discount") * 100), "coats": F.lit(2.0), "coverage_m2_per_litre": F.lit(8.0), "productivity_m2_per_hour": F.lit(4.0),
        "inclusion_status": _pick(("Included", "EXCLUDED", "Included", "By others", "Exclusion "), k % 5), "row_role": _pick(("", "", "floor_area", "", "", "model-surface", ""), k % 7),
        "source_reference": _pick(("AI plan review", "Drawing 3", ""), k % 3), "source_page": F.lit("1"),
    }
    for c in (*_TEXTS, "commercial_authority_status", "commercial_authority_fingerprint"):
        named.setdefault(c, F.lit(None).cast("string"))
    return table(spark, sf, "lineitem").select(*[c.alias(n) for n, c in named.items()])


def _case(values, key):
    return "CASE " + key + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_K = "(l_partkey + l_linenumber)"
_ROWS = f"""t AS (SELECT l_orderkey * 8 + l_linenumber AS id, (l_suppkey % 10 + 1)::BIGINT AS workspace_id, {_case(("Internal", "External facade", "Internal"), _K + " % 3")} AS section, {_case(("Walls", "Ceiling", "Floor", "Door"), _K + " % 4")} AS element,
 {_case(_LEVELS, _K + " % 6")} AS level, {_case(("m²", "lm", "No.", "m²", "L"), _K + " % 5")} AS unit, round(l_quantity)::DOUBLE AS q, round(l_discount * 100)::DOUBLE AS rate, {_K} % 5 IN (1, 4) AS excluded, {_K} % 7 = 2 AS is_floor, {_K} % 7 = 5 AS is_model, {_K} % 3 AS ref FROM lineitem)"""


@query(f"WITH {_ROWS} SELECT id, NOT excluded AND NOT is_floor AND NOT is_model AS work FROM t")
def q_publishable_rows(spark, sf):
    """Floor references, excluded rows and unapproved model surfaces aren't work."""
    return rows(spark, sf).select("id", takeoff.is_work().alias("work"))


@query(f"""WITH {_ROWS}, p AS (SELECT * FROM t WHERE is_floor OR (NOT excluded AND NOT is_model))
 SELECT level, sum((NOT is_floor)::INT)::BIGINT AS rows, sum(CASE WHEN NOT is_floor AND unit = 'm²' THEN q ELSE 0 END)::DOUBLE AS m2, sum(CASE WHEN is_floor AND unit = 'm²' THEN q ELSE 0 END)::DOUBLE AS floor_m2, sum(CASE WHEN NOT is_floor AND unit = 'lm' THEN q ELSE 0 END)::DOUBLE AS lm,
 sum(CASE WHEN NOT is_floor AND unit = 'No.' THEN q ELSE 0 END)::DOUBLE AS count, sum(CASE WHEN NOT is_floor AND unit = 'm²' THEN q * 2 / 8 ELSE 0 END)::DOUBLE AS paint_litres, sum(CASE WHEN NOT is_floor AND unit <> 'L' THEN q / 4 ELSE 0 END)::DOUBLE AS labour_hours, sum(CASE WHEN NOT is_floor THEN q * rate ELSE 0 END)::DOUBLE AS value_ex_gst FROM p GROUP BY 1""")
def q_takeoff_levels(spark, sf):
    """Rows priced and summed by level."""
    return takeoff.per_level(takeoff.priced(rows(spark, sf)))


@query(f"""WITH {_ROWS}, c AS (SELECT * FROM t WHERE is_floor OR (NOT excluded AND NOT is_model)), f AS (SELECT workspace_id, level, arg_max(q, id) AS floor FROM c WHERE is_floor AND unit = 'm²' GROUP BY 1, 2),
 w AS (SELECT workspace_id, level, id, q, sum(q) OVER g AS s, count(*) OVER g AS n FROM c WHERE NOT is_floor AND unit = 'm²' AND element = 'Walls' AND section = 'Internal' WINDOW g AS (PARTITION BY workspace_id, level))
 SELECT id, CASE WHEN n = 1 THEN coalesce(floor, 0) WHEN s > 0 THEN coalesce(floor, 0) * q / s ELSE 0 END::DOUBLE AS priced_quantity FROM w LEFT JOIN f USING (workspace_id, level)""")
def q_floor_allocation(spark, sf):
    """Walls priced off their level's floor, in proportion."""
    got = takeoff.priced(rows(spark, sf).withColumn("confidence", F.lit("Confirmed")), "floor_m2")
    return got.filter(takeoff.is_internal_wall() & (F.col("unit") == "m²") & ~takeoff.is_floor_reference()).select("id", "priced_quantity")


@query(f"""WITH {_ROWS}, b AS (SELECT section, element, unit, level, q, CASE WHEN id % 4 = 0 THEN 'Drawn' WHEN ref = 0 THEN 'AI' ELSE 'Manual' END AS basis FROM t),
 g AS (SELECT section, element, level AS location, unit, sum(CASE WHEN basis = 'AI' THEN q ELSE 0 END)::DOUBLE AS ai_qty, sum(CASE WHEN basis = 'Drawn' THEN q ELSE 0 END)::DOUBLE AS drawn_qty, string_agg(DISTINCT basis, ', ' ORDER BY basis) AS basis FROM b GROUP BY 1, 2, 3, 4)
 SELECT *, drawn_qty - ai_qty AS variance, CASE WHEN ai_qty = 0 AND drawn_qty = 0 THEN 'Manual / not yet measured' WHEN ai_qty > 0 AND drawn_qty > 0 THEN CASE WHEN abs(drawn_qty - ai_qty) <= greatest(0.01::DOUBLE, 0.02::DOUBLE * greatest(ai_qty, drawn_qty)) THEN 'Matched' ELSE 'Difference' END WHEN ai_qty > 0 THEN 'AI only (not drawn)' ELSE 'Drawn only (no AI draft)' END AS status FROM g""")
def q_takeoff_reconcile(spark, sf):
    """(A10, A11, J3)"""
    r = rows(spark, sf)
    return takeoff.reconcile(r.withColumn("location", text.level(F.col("location"))), r.filter("id % 4 = 0").select(F.col("id").alias("takeoff_row_id")))


@query(f"""WITH {_ROWS} SELECT workspace_id, id, 'BLOCKER' AS severity, 'MODEL_SURFACE_UNAPPROVED' AS code FROM t WHERE is_model UNION ALL SELECT workspace_id, id, 'HIGH', 'RATE_MISSING' FROM t WHERE NOT is_floor AND NOT excluded AND rate = 0
 UNION ALL SELECT workspace_id, id, 'WARNING', 'LEVEL_UNKNOWN' FROM t WHERE NOT is_floor AND NOT excluded AND level = 'Unassigned'""")
def q_review_signals(spark, sf):
    """(D11, A59, A60)"""
    return gates.row_signals(rows(spark, sf)).select("workspace_id", "id", "severity", "code")


_MODES = ("Count / points", "Linear item", "Plan area", "Wall / vertical area", "Volume", "Duct surface area", "Allowance / item")


@query(f"""WITH m AS (SELECT l_orderkey, l_linenumber, {_case(_MODES, "l_partkey % 7")} AS mode, l_quantity AS a, l_tax * 100 AS b, l_linenumber::DOUBLE AS n FROM lineitem)
 SELECT l_orderkey, l_linenumber, mode, round(CASE l_mode WHEN 0 THEN n WHEN 1 THEN a * 2 WHEN 2 THEN greatest(0, a * b - 3) WHEN 3 THEN greatest(0, a * 3 - 3) WHEN 4 THEN greatest(0, a * b * 0.5 - 3) WHEN 5 THEN greatest(0, 2 * (b + 3) * a * 2 - 3) ELSE n END, 3)::DOUBLE AS quantity
 FROM (SELECT *, CASE mode {" ".join(f"WHEN '{m}' THEN {k}" for k, m in enumerate(_MODES))} END AS l_mode FROM m) x""")
def q_trade_modes(spark, sf):
    """(F82)"""
    d = F.lit
    mode, a, b = _pick(_MODES, F.col("l_partkey") % 7), F.col("l_quantity"), F.col("l_tax") * 100
    q = pricing.trade_quantity(mode, a, b, d(3.0), d(0.5), d(0.0), F.col("l_linenumber"), d(2), d(3.0), d(0.0), d(0.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", mode.alias("mode"), q.alias("quantity"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, greatest(0, l_quantity - 5)::DOUBLE AS net_m2 FROM lineitem)
 SELECT l_orderkey, l_linenumber, net_m2, net_m2 * 2 * l_linenumber AS installed_m2, CASE WHEN net_m2 > 0 THEN ceil(net_m2 * 2 * l_linenumber / 4)::BIGINT ELSE 0 END AS sheets FROM b""")
def q_board_sheets(spark, sf):
    """Whole sheets of board."""
    s = pricing.board_sheets(F.col("l_quantity"), F.lit(5.0), F.lit(2), F.col("l_linenumber"), F.lit(0.0), F.lit(1000.0), F.lit(4000.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query("""WITH p AS (SELECT o_orderkey AS id, 'A-' || (100 + o_custkey % 50) AS sheet, CASE WHEN o_orderkey % 3 = 0 THEN chr((65 + o_orderkey % 5)::INT) ELSE '0' || (o_orderkey % 9 + 1) END AS code, o_custkey % 4 AS workspace_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 + 1 ELSE o_orderkey % 9 + 1 END::INT AS rank FROM orders)
 SELECT id, sheet, code, rank, row_number() OVER w = 1 AS is_current, CASE WHEN row_number() OVER w > 1 THEN first_value(id) OVER w END AS superseded_by FROM p WINDOW w AS (PARTITION BY workspace_id, sheet ORDER BY rank DESC, id DESC)""")
def q_revisions(spark, sf):
    """Drawing revisions parsed from labels, the latest of each sheet current."""
    k = F.col("o_orderkey")
    code = F.when(k % 3 == 0, F.char(65 + k % 5)).otherwise(F.concat(F.lit("0"), (k % 9 + 1).cast("string")))
    label = F.concat(F.lit("A-"), (100 + F.col("o_custkey") % 50).cast("string"), F.lit(" Floor plan Rev "), code)
    drawn = table(spark, sf, "orders").select(k.alias("id"), (F.col("o_custkey") % 4).alias("workspace_id"), label.alias("page_label"))
    return registers.revisions(drawn).select("id", "sheet", F.col("rev.code").alias("code"), F.col("rev.rank").alias("rank"), "is_current", "superseded_by")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_quantity * 100 AS v, l_linenumber % 3 AS kind FROM lineitem) SELECT l_orderkey, l_linenumber, CASE kind WHEN 0 THEN v / 1000 WHEN 1 THEN CASE WHEN v / 100 BETWEEN 0.05 AND 200 THEN v / 100 END ELSE CASE WHEN v >= 100 THEN v / 1000 END END::DOUBLE AS metres FROM d""")
def q_dimension_parse(spark, sf):
    """Dimensions in mm, in m and bare."""
    v, kind = (F.col("l_quantity") * 100).cast("long"), F.col("l_linenumber") % 3
    words = F.when(kind == 0, F.concat(v.cast("string"), F.lit(" mm"))).when(kind == 1, F.concat((v / 100).cast("long").cast("string"), F.lit("m"))).otherwise(v.cast("string"))
    return dealt(spark, sf, "lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", text.dimension_m(words).alias("metres"))


_OPENING = """e AS (SELECT l_orderkey AS o, l_suppkey AS w, l_linenumber AS n, (0.8::DOUBLE + (l_partkey % 4) / 100.0)::DOUBLE AS width, 2.1::DOUBLE AS height, CASE WHEN l_linenumber % 2 = 0 THEN 'rough_opening' ELSE 'frame' END AS basis, round(0.6 + l_discount * 4, 2)::DOUBLE AS conf FROM lineitem)"""


@query(f"""WITH {_OPENING}, r AS (SELECT o, min(w) AS w, bool_or(basis = 'rough_opening') AS rough, max(width) - min(width) AS spread, max(conf) AS conf, arg_max(width, CASE WHEN basis = 'rough_opening' THEN 1 ELSE 0 END * 1000000 + round(conf * 100) * 1000 + round(width * 1000) / 10) AS width FROM e GROUP BY o)
 SELECT o::VARCHAR AS opening_instance_id, CASE WHEN NOT rough THEN 'review' WHEN least(conf, 0.95) >= 0.9 THEN 'auto_eligible' WHEN conf >= 0.7 THEN 'derived_eligible' ELSE 'review' END AS deduction_status, rough AND conf >= 0.7 AS deduct FROM r""")
def q_opening_decisions(spark, sf):
    """Evidence merged, reconciled and decided."""
    k = F.col("l_linenumber")
    conf = F.round(0.6 + F.col("l_discount") * 4, 2)
    evidence = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("opening_instance_id"), F.lit("D01").alias("type_mark"), F.concat(F.lit("W"), F.lit("1")).alias("wall_ref"), F.lit("").alias("level"), F.lit("door").alias("opening_type"), F.lit(1.0).alias("position_along_wall_m"),
        (0.8 + (F.col("l_partkey") % 4) / 100).alias("width_m"), F.lit(2.1).alias("height_m"), F.when(k % 2 == 0, "rough_opening").otherwise("frame").alias("dimension_basis"), F.lit("plan").alias("dimension_source"),
        F.lit(0.95).alias("geometry_confidence"), conf.alias("dimension_confidence"), F.lit(0.95).alias("association_confidence"), F.lit("plan").alias("source"))
    return openings.pipeline(evidence).select("opening_instance_id", "deduction_status", "deduct")


@query("""WITH s AS (SELECT l_suppkey AS wall, sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 0 THEN CAST(round(l_quantity) AS BIGINT) ELSE 0 END)::DOUBLE AS d, sum((l_returnflag = 'R' AND l_quantity > 0)::INT)::BIGINT AS n FROM lineitem GROUP BY 1)
 SELECT s_suppkey AS wall, coalesce(d, 0) AS deducted_m2, coalesce(n, 0) AS n_openings, NOT (coalesce(d, 0) - 4500 - 0.001 > 0) AS valid, CASE WHEN coalesce(d, 0) - 4500 - 0.001 > 0 THEN 0 ELSE 4500 - coalesce(d, 0) END::DOUBLE AS net_m2 FROM supplier LEFT JOIN s ON s_suppkey = wall""")
def q_net_walls(spark, sf):
    """Walls less their openings; more openings than wall is an error."""
    walls = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("wall_ref"), F.lit(4500.0).alias("gross_m2"))
    cut = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("wall_ref"), (F.col("l_returnflag") == "R").alias("deduct"), F.round("l_quantity").alias("area_m2"))
    return openings.net_walls(walls, cut).select(F.col("wall_ref").alias("wall"), "deducted_m2", "n_openings", "valid", "net_m2")


@query("""WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings) SELECT label, count(*)::BIGINT AS inside FROM p WHERE x + y < 0.1 AND x > -0.15 AND y > -0.15 GROUP BY 1""")
def q_point_in_polygon(spark, sf):
    """Points of each page inside a triangle. (F107, J10-J12)"""
    tri = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((-0.15, -0.15), (0.25, -0.15), (-0.15, 0.25))])
    at = lambda k: F.element_at("embedding", k).cast("double")
    return table(spark, sf, "embeddings").filter(geometry.contains(tri, at(1), at(2))).groupBy("label").agg(F.count("*").alias("inside"))


@query("""WITH p AS (SELECT vec_id, label, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings), m AS (SELECT a.label, a.vec_id AS point_id, b.vec_id AS tag, row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.vec_id) AS n
 FROM p a JOIN p b ON a.label = b.label AND a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 50) SELECT label AS page_id, point_id, tag::VARCHAR AS tag FROM m WHERE n = 1""")
def q_nearest_tag(spark, sf):
    """The nearest word of each point within a radius."""
    at = lambda k: F.element_at("embedding", k).cast("double") * 1000
    p = table(spark, sf, "embeddings").select(F.col("label").alias("page_id"), "vec_id", at(1).alias("x"), at(2).alias("y"))
    tags = p.filter("vec_id % 2 = 1").select("page_id", F.col("vec_id").alias("word_id"), F.col("vec_id").cast("string").alias("text"), "x", "y")
    points = p.filter("vec_id % 2 = 0").withColumnRenamed("vec_id", "point_id")
    return pages.nearest_tags(points, tags, 50.0).select("page_id", "point_id", F.col("text").alias("tag"))


_SEGMENTS = "p AS (SELECT vec_id AS id, label AS page, embedding[1]::DOUBLE * 1000 AS x1, embedding[2]::DOUBLE * 1000 AS y1, embedding[3]::DOUBLE * 1000 AS x2, embedding[4]::DOUBLE * 1000 AS y2 FROM embeddings)"


def _segments(spark, sf):
    at = lambda k: F.element_at("embedding", k).cast("double") * 1000
    return table(spark, sf, "embeddings").select(F.col("label").cast("long").alias("page_id"), F.col("vec_id").alias("seg_id"), at(1).alias("x1"), at(2).alias("y1"), at(3).alias("x2"), at(4).alias("y2"))


@query(f"""WITH {_SEGMENTS}, m AS (SELECT a.page, a.id AS i, b.id AS j, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS c, (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) AS t, (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) AS u FROM p a JOIN p b ON a.page = b.page AND a.id < b.id)
 SELECT page AS page_id, i AS a_seg_id, j AS b_seg_id FROM m WHERE abs(c) > 1e-9 AND t / c BETWEEN -1e-9 AND 1 + 1e-9 AND u / c BETWEEN -1e-9 AND 1 + 1e-9""")
def q_crossings(spark, sf):
    """Crossing segments of each page, found through a grid. (J18, F110)"""
    return pages.crossings(_segments(spark, sf)).select("page_id", "a_seg_id", "b_seg_id")


@query()
def q_faces(spark, sf):
    """Closed faces of each page's linework. (F111, U12)"""
    got = pages.faces(_segments(spark, sf), 1.0)
    return got.select("page_id", "face", F.round("area", 3).alias("area"), F.round("perimeter", 3).alias("perimeter"))


@query()
def q_snap(spark, sf):
    """(U16)"""
    return pages.snap(_segments(spark, sf), 15.0)


@query()
def q_stroke_clusters(spark, sf):
    """(U14, A34)"""
    return pages.stroke_clusters(_segments(spark, sf), 20.0, 100.0, 2).select("page_id", "cluster", "n", F.round("angle", 6).alias("angle"))


@query()
def q_greedy_assignment(spark, sf):
    """One-to-one by distance, the nearest first."""
    pairs = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("page"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_extendedprice").alias("cost"))
    return fusion.greedy_pairs(pairs, "page", "a", "b", "cost")


@query("""SELECT p_brand AS code, min(p_size)::INT AS first_page, count(*)::BIGINT AS entries, CASE WHEN count(DISTINCT p_type) <= 1 THEN 'Confirmed' ELSE 'Conflict' END AS status FROM part GROUP BY 1""")
def q_materials(spark, sf):
    """Codes with one description or with several."""
    entries = table(spark, sf, "part").select(F.col("p_brand").alias("code"), F.col("p_type").alias("description"), F.col("p_type").alias("substrate"), F.col("p_size").alias("page_id"))
    first = entries.groupBy(F.upper("code").alias("code")).agg(F.min("page_id").alias("first_page"))
    return registers.materials(entries).join(first, "code").select(F.initcap(F.lower("code")).alias("code"), "first_page", "entries", "status")


@query("""WITH l AS (SELECT l_partkey, l_suppkey, max(l_orderkey * 8 + l_linenumber) AS last, arg_max(l_quantity, l_orderkey * 8 + l_linenumber) AS predicted FROM lineitem GROUP BY 1, 2)
 SELECT p_brand AS category, count(*)::BIGINT AS items, count(predicted)::BIGINT AS found, round(avg(abs(predicted - p_size) / p_size), 9) AS mape, count(predicted)::DOUBLE / count(*) AS found_share FROM part LEFT JOIN l ON p_partkey = l_partkey AND l_suppkey = p_partkey % 50 + 1 GROUP BY 1""")
def q_accuracy_registers(spark, sf):
    """Truth against the latest prediction of each item."""
    part, lines = table(spark, sf, "part"), table(spark, sf, "lineitem")
    item = lambda a, b: F.concat_ws("/", a.cast("string"), b.cast("string"))
    truth = part.select(F.col("p_brand").alias("category"), item(F.col("p_partkey"), F.col("p_partkey") % 50 + 1).alias("item_key"), F.col("p_size").cast("double").alias("expected_numeric"), F.lit(None).cast("string").alias("expected_text"))
    pred = lines.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("p_brand").alias("category"), item(F.col("l_partkey"), F.col("l_suppkey")).alias("item_key"), F.col("l_quantity").alias("predicted_numeric"), F.lit(None).cast("string").alias("predicted_text"))
    return registers.accuracy(truth, pred).select("category", "items", "found", F.round("mape", 9).alias("mape"), "found_share")
