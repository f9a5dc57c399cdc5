"""Driver queries: what texts say. Texts are made of the tables' numbers, so the SQL knows from the numbers what must be read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes, sheets, text
from ..operators import assembly, drawing, evidence, registers, surfaces
from .shared import choice, dealt, key, nth, pick, query, table


def say(*parts):
    """Numbers and words joined."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, (o_orderkey % 9 + 1)::VARCHAR AS n, (o_orderkey % 5 + 1)::VARCHAR AS f FROM orders)
 SELECT id, {choice(("'Ground'", "'Level ' || f", "'Unassigned'", "'Unassigned'", "'Roof'", "'Unassigned'"), "k")} AS base, {choice(("'Ground'", "'Level ' || f", "'Level ' || n", "'Basement ' || n", "'Roof'", "'Unassigned'"), "k")} AS commercial,
 {choice(("'Ground'", "'Level ' || f", "'Unassigned'", "'Basement ' || n", "'Roof'", "'Level ' || n"), "k")} AS level FROM o""")
def q_levels_of_text(spark, sf):
    """Three readings of a level."""
    floor = key() % 5 + 1
    place = pick((say("Ground floor unit ", nth()), say("Level ", floor, " corridor"), say("Unit ", nth(), "0", nth()), say("B", nth(), " car park"), F.lit("Roof terrace"), say(nth(), "th floor store")), key())
    return table(spark, sf, "orders").select(key().alias("id"), text.level_base(place).alias("base"), text.level_commercial(place).alias("commercial"), text.level(place).alias("level"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, o_orderkey AS n FROM orders)
 SELECT id, {choice(("(n || '2')::DOUBLE", "0.0::DOUBLE", "n + 0.5::DOUBLE", "0.0::DOUBLE", "n::DOUBLE"), "k")} AS quantity, {choice(("0.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE", "0.0::DOUBLE", "n::DOUBLE"), "k")} AS number,
 {choice(("7", "7", "7", "7", "n"), "k")}::BIGINT AS whole, {choice(("'m²'", "'Abc'", "'M/Hr'", "''", "'lm'"), "k")} AS unit, {choice(("'m2'", "'Abc'", "'M/Hr'", "''", "'m'"), "k")} AS line_unit FROM o""")
def q_numbers_of_text(spark, sf):
    """Quantities, numbers and units in cells; a quantity keeps every digit of its cell, those of a unit too."""
    cell = pick((say(key(), " m2"), F.lit("abc"), say("$", key(), ".5"), F.lit(None).cast("string"), say(" ", key())), key())
    unit = pick((F.lit("area m2"), F.lit("abc"), F.lit("m/hr"), F.lit(None).cast("string"), F.lit("Lineal")), key())
    return table(spark, sf, "orders").select(key().alias("id"), text.quantity(cell).alias("quantity"), text.number(cell).alias("number"), text.integer(cell, 7).alias("whole"), text.unit(unit).alias("unit"), text.line_unit(unit).alias("line_unit"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, (10 + o_orderkey % 90) AS r, (o_orderkey % 9 + 1) AS n FROM orders), s AS (SELECT id, {choice(("r", "r * 10", "NULL", "NULL", "NULL"), "k")}::INT AS ratio, k, r, n FROM o)
 SELECT id, ratio, CASE WHEN ratio IS NOT NULL THEN ratio / 1000.0::DOUBLE WHEN k % 5 = 2 THEN n::DOUBLE / r::DOUBLE END AS metres_per_mm, round(72 * (25.4::DOUBLE / 72) * CASE WHEN ratio IS NOT NULL THEN ratio / 1000.0::DOUBLE WHEN k % 5 = 2 THEN n::DOUBLE / r::DOUBLE END, 6) AS wall_m,
 CASE WHEN ratio IS NOT NULL THEN round(2 * 1000 / (0.352778::DOUBLE * ratio), 6) END AS px_per_m FROM s""")
def q_scales_of_text(spark, sf):
    """Printed scales and what they make of lengths."""
    from ..functions import geometry, pricing

    r = 10 + key() % 90
    said = pick((say("Scale 1:", r), say("1 / ", r * 10, " @A1"), say(r, " mm = ", nth(), " m"), F.lit("NTS"), say("1:", r * 1000, "00")), key())
    per_mm, ratio = text.metres_per_page_mm(said), text.scale_ratio(said)
    return table(spark, sf, "orders").select(key().alias("id"), ratio.alias("ratio"), per_mm.alias("metres_per_mm"), F.round(geometry.wall_metres(F.lit(72.0), per_mm), 6).alias("wall_m"), F.round(pricing.px_per_m(ratio, F.lit(2.0)), 6).alias("px_per_m"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, 700 + o_orderkey % 200 AS w, 2000 + o_orderkey % 400 AS h FROM orders)
 SELECT id, {choice(("w", "w", "1200", "NULL", "NULL"), "k")}::INT AS pair_w, {choice(("h", "h", "2100", "NULL", "NULL"), "k")}::INT AS pair_h, {choice(("NULL", "NULL", "NULL", "w", "2400"), "k")}::INT AS one, {choice(("w", "w", "NULL", "NULL", "NULL"), "k")}::DOUBLE AS size_h, {choice(("h", "h", "NULL", "NULL", "NULL"), "k")}::DOUBLE AS size_w FROM o""")
def q_opening_sizes(spark, sf):
    """Sizes of openings as pairs and alone; none is made up where none is stated."""
    w, h = 700 + key() % 200, 2000 + key() % 400
    said = pick((say(w, " x ", h), say(w, "/", h), F.lit("1.2m x 2.1m"), say(w, "mm"), F.lit("2.4 m")), key())
    pair, size = text.dimension_pair_mm(said), text.opening_size_mm(said)
    one = F.when(key() % 5 >= 3, text.single_dimension_mm(said))
    return table(spark, sf, "orders").select(key().alias("id"), pair["width"].alias("pair_w"), pair["height"].alias("pair_h"), one.alias("one"), size["height"].alias("size_h"), size["width"].alias("size_w"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, (o_orderkey % 9 + 1)::VARCHAR AS n FROM orders)
 SELECT id, {choice(("'door'", "'window'", "'window'", "NULL", "NULL"), "k")} AS kind, {choice(("'D0' || n", "'W' || n", "'EW' || n", "NULL", "'D' || n"), "k")} AS mark,
 {choice(("'rough_opening'", "'frame'", "'leaf'", "'clear_opening'", "NULL"), "k")} AS basis FROM o""")
def q_opening_marks(spark, sf):
    """Kinds and marks of openings, and what a heading says that a dimension is of."""
    said = pick((say("D0", nth()), say("w", nth()), say("EW", nth()), F.lit("Door"), say("door d", nth(), " here")), key())
    head = pick([F.lit(x) for x in ("Rough opening width", "Frame size", "Leaf width", "Clear opening", "Width")], key())
    return table(spark, sf, "orders").select(key().alias("id"), text.opening_kind(said).alias("kind"), text.opening_mark(said).alias("mark"), text.heading_basis(head).alias("basis"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, (o_orderkey % 9 + 1)::VARCHAR AS n FROM orders)
 SELECT id, {choice(("'PF-0' || n || ',PT' || n", "'WC0' || n || 'A'", "''", "'PT0' || n", "'TR1'"), "k")} AS codes, {choice(("true", "true", "true", "false", "true"), "k")} AS accepted FROM o""")
def q_finish_code_rules(spark, sf):
    """Finish codes of a text, and whether the first is a finish or a drawing's tag."""
    line = pick((say("pt", nth(), " low sheen, pf-0", nth()), say("WC0", nth(), "a tile"), F.lit("none"), say("PT0", nth(), " key plan wall pieces"), F.lit("TR1 trim")), key())
    codes = text.finish_codes(line)
    return table(spark, sf, "orders").select(key().alias("id"), F.array_join(codes, ",").alias("codes"), text.finish_accepted(F.get(F.reverse(codes), F.lit(0)), line, F.lit(""), F.lit("paint schedule")).alias("accepted"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, (o_orderkey % 9 + 1)::VARCHAR AS n FROM orders)
 SELECT id, {choice(("'INCLUSION'", "'PROVISIONAL'", "'EXCLUSION'", "'SEPARATE ITEM'", "'By ' || n"), "k")} AS inclusion, {choice(("'plan_' || n || '.pdf'", "'item'", "'a-' || n", "'x_y'", "'n' || n"), "k")} AS file,
 {choice(("'North'", "'South'", "NULL", "'East'", "'West'"), "k")} AS side, {choice(("'Building A,Stage ' || n", "'Wing ' || n", "''", "'Block B'", "''"), "k")} AS groups, {choice(("'#3A3A3C'", "'#F2F0EB'", "'#C9BFA6'", "'#9A4B32'", "'#111111'"), "k")} AS colour,
 {choice(("'Ceiling'", "'Door'", "'Wall'", "NULL", "'Soffit'"), "k")} AS element, {choice(("true", "false", "true", "true", "false"), "k")} AS agree, {choice(("'plasterboard wall'", "'PBX'", "'a plasterboard'", "''", "'pb2'"), "k")} AS written FROM o""")
def q_small_rules(spark, sf):
    """Inclusion, file names, sides, groups, colours, elements, agreement of descriptions, abbreviations."""
    lit = lambda *v: pick([F.lit(x) for x in v], key())
    inclusion = pick((F.lit(" Base"), F.lit("opt"), F.lit("No"), F.lit("separate item"), say("By ", nth())), key())
    name = pick((say("plan ", nth(), ".pdf"), F.lit("  "), say("a-", nth()), F.lit("x/y"), say("n", nth())), key())
    groups = pick((say("Building A and stage ", nth()), say("wing ", nth(), " and Wing ", nth()), F.lit("units"), F.lit("block b"), F.lit(None).cast("string")), key())
    own = F.when(key() % 5 == 4, "#111111")
    return table(spark, sf, "orders").select(
        key().alias("id"), text.inclusion(inclusion).alias("inclusion"), text.safe_name(name).alias("file"), text.orientation(lit("northern view", "South elevation", "plan", "the east", "West")).alias("side"), F.array_join(text.scope_groups(groups), ",").alias("groups"),
        text.colour(lit("Charcoal metal", "White", "unknown", "face brick", "white"), own).alias("colour"), assembly.element_of(lit("ceiling of hall", "Door 3", "party wall", "yard", "soffit")).alias("element"),
        text.descriptions_agree(lit("Low Sheen", "gloss", "low sheen acrylic", "Matt", "short"), lit("low-sheen", "matt", "Low sheen", "matt", "sho")).alias("agree"), text.expand(lit("PB wall", "PBX", "a pb", "", "pb2"), {"pb": "plasterboard"}).alias("written"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, 2 + (o_orderkey % 9 + 1) / 10.0::DOUBLE AS h FROM orders)
 SELECT id, {choice(("round(h, 3)::VARCHAR", "'2.4,2.7'", "''", "round(h, 3)::VARCHAR", "''"), "k")} AS heights, {choice(("'floor_to_ceiling'", "'floor_to_floor'", "'parapet'", "'generic'", "'floor_to_floor'"), "k")} AS kind FROM o""")
def q_heights_of_text(spark, sf):
    """Ceiling heights that texts state, and what two reduced levels make of a height."""
    said = pick((say("CH ", "2.", nth(), "m"), F.lit("ceiling 2700 / wall height: 2.4 m"), F.lit("ceiling 300"), say("clg: 2", nth(), "00mm"), F.lit("2.7")), key())
    lit = lambda *v: pick([F.lit(x) for x in v], key())
    heights = F.array_join(F.transform(text.semantic_heights(said), lambda x: F.round(x, 3).cast("string")), ",")
    return table(spark, sf, "orders").select(key().alias("id"), heights.alias("heights"), text.height_type(lit("FFL", "FFL", "parapet", "natural", "level"), lit("fcl", "ffl", "RL", "rl", "floor")).alias("kind"))


@query("""WITH o AS (SELECT o_orderkey AS page_id, o_orderkey % 30 AS d FROM orders), l AS (SELECT page_id, 100 + d AS a, 'ffl' AS ka, 102.7 + d AS b, 'fcl' AS kb FROM o)
 SELECT page_id, round(a, 3)::DOUBLE AS a_rl, round(b, 3)::DOUBLE AS b_rl, round(b - a, 4)::DOUBLE AS height_m, 'floor_to_ceiling' AS height_type FROM l
 UNION ALL SELECT page_id, round(b, 3)::DOUBLE, round(106 + d, 3)::DOUBLE, 3.3::DOUBLE, 'floor_to_ceiling' FROM o JOIN l USING (page_id)
 UNION ALL SELECT page_id, round(a, 3)::DOUBLE, round(106 + d, 3)::DOUBLE, 6::DOUBLE, 'floor_to_floor' FROM o JOIN l USING (page_id)""")
def q_reduced_levels(spark, sf):
    """Reduced levels of texts and the heights between them, the three nearest to three metres."""
    d = key() % 30
    said = F.concat_ws("\n", say("FFL rl ", 100 + d, ".00"), say("fcl RL: ", 102 + d, ".70"), say("ffl rl ", 106 + d, ".00"), F.lit("rl 9.00 of nothing"))
    return evidence.height_pairs(evidence.reduced_levels(table(spark, sf, "orders").select(key().alias("id"), said.alias("extracted_text"))))


@query("""WITH o AS (SELECT o_orderkey AS id, (o_orderkey % 9 + 1) AS n FROM orders) SELECT id, 'Unit ' || n AS label, (50 + n)::DOUBLE AS area_m2, 'unit' AS of FROM o UNION ALL SELECT id, 'Villa 2', 91.5::DOUBLE, 'unit' FROM o
 UNION ALL SELECT id, 'Render', (10 * n)::DOUBLE, 'substrate' FROM o UNION ALL SELECT id, 'Masonry', 7.5::DOUBLE, 'substrate' FROM o""")
def q_areas_of_text(spark, sf):
    """Areas that texts state of units and of substrates."""
    said = F.concat_ws("\n", say("Unit ", nth(), " internal ", 50 + nth(), " m2"), F.lit("villa 2: 91.5 sqm"), F.lit("lot 3 2 m2"), say("rendered wall ", 10 * nth(), " m²"), F.lit("brick 7.5 m2"), F.lit("timber and steel 5 m2"))
    rows = table(spark, sf, "orders").select(key().alias("id"), said.alias("t"))
    units = rows.select("id", F.inline(text.unit_areas(F.col("t")))).withColumn("of", F.lit("unit"))
    return units.unionByName(rows.select("id", F.inline(text.substrate_areas(F.col("t")))).withColumnRenamed("substrate", "label").withColumn("of", F.lit("substrate")))


@query("""SELECT o_orderkey AS id, sha256(o_orderpriority) AS digest, (o_orderkey & 2147483647)::BIGINT AS a, ((('0x' || md5(o_orderpriority)[1:8])::BIGINT) & 2147483647)::BIGINT AS b, true AS stamped_today FROM orders""")
def q_lock_keys(spark, sf):
    """Digests, lock keys and stamps, which are of now. (D17, F140, F141)"""
    keys = text.lock_keys(key(), F.col("o_orderpriority"))
    return table(spark, sf, "orders").select(key().alias("id"), text.digest(F.col("o_orderpriority")).alias("digest"), keys["a"].alias("a"), keys["b"].alias("b"), (F.abs(F.unix_timestamp(text.stamp()) - F.unix_timestamp()) < 86400).alias("stamped_today"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k FROM orders) SELECT id, {choice(("id", "id", "id", "NULL", "NULL"), "k")}::BIGINT AS n, {choice(("'x}'", "'y'", "NULL", "NULL", "NULL"), "k")} AS s FROM o""")
def q_json_objects(spark, sf):
    """The first complete object in a text, read by a schema."""
    said = pick((say('Here: {"n": ', key(), ', "s": "x}"} and {"n": 0}'), say('note {x} then {"s": "y", "n": ', key(), "} end"), say('{"n": ', key(), "}"), F.lit("{broken"), F.lit(None).cast("string")), key())
    from ..sources import readers

    got = readers.json_documents(table(spark, sf, "orders").select(key().alias("id"), said.alias("t")), "t", "n long, s string")
    return got.select("id", "document.n", "document.s")


_HEADS = {"Qty (m2)": "quantity", "$ / m2": "rate_per_unit", "m2/h": "productivity_m2_per_hour", "sqmt": "quantity", "m2/l": "coverage_m2_per_litre", "Room": "location", "Paint System used": "finish_system", "": None, "zz": None, "Description of work": "element"}


@query(f"""SELECT o_orderkey AS id, {choice(["NULL" if v is None else f"'{v}'" for v in _HEADS.values()], "o_orderkey")} AS target FROM orders""")
def q_headings(spark, sf):
    """The take-off columns that headings name."""
    from ..sources import readers

    return dealt(spark, sf, "orders", "o_orderkey").select(key().alias("id"), readers.heading(pick([F.lit(h) for h in _HEADS], key())).alias("target"))


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 7 AS kind FROM orders), c AS (SELECT 'PT' || (k % 9 + 1) AS code, min(k) AS page_id FROM o WHERE kind < 3 GROUP BY 1)
 SELECT code, 'low sheen ' || code[3:] AS description, page_id FROM c UNION ALL SELECT 'WC' || (k % 9 + 1), 'Tile', min(k) FROM o WHERE kind = 3 GROUP BY 1""")
def q_legend(spark, sf):
    """Codes and descriptions of legend lines, equal pairs once."""
    said = pick((say("PT", nth(), " - low sheen ", nth()), say("note\npt", nth(), ": low sheen ", nth()), say("PT", nth(), " = low sheen ", nth(), "\n"), say("WC", nth(), " Tile"), F.lit("nothing"), F.lit(""), F.lit("PT1")), key())
    return assembly.legend(table(spark, sf, "orders").select(key().alias("id"), said.alias("extracted_text")))


@query("""SELECT o_orderkey AS page_id, 1::BIGINT AS line, 'PT' || (o_orderkey % 9 + 1) AS code, 'Low sheen washable ' || o_orderkey AS description FROM orders UNION ALL SELECT o_orderkey, 4, 'WC2', 'Tile a b c' FROM orders""")
def q_descriptions(spark, sf):
    """Schedule lines with up to three lines that continue them."""
    lines = F.array(F.lit("Legend"), say("pt", nth(), " Low sheen"), F.lit("washable"), key().cast("string"), F.lit("WC2 Tile"), *[F.lit(x) for x in "abcd"])
    rows = dealt(spark, sf, "orders", "o_orderkey").select(key().alias("page_id"), F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line").cast("long"))
    return registers.descriptions(rows)


@query("""WITH o AS (SELECT o_orderkey AS name_id, o_orderkey % 3 AS k FROM orders) SELECT name_id, CASE k WHEN 0 THEN 'A1' WHEN 1 THEN 'B2' END AS code, CASE k WHEN 0 THEN 2 WHEN 1 THEN 1 END::BIGINT AS shared FROM o""")
def q_fuzzy_codes(spark, sf):
    """The code whose description shares most words."""
    names = table(spark, sf, "orders").select(key().alias("name_id"), pick([F.lit(x) for x in ("Low sheen acrylic", "gloss to doors", "of a")], key()).alias("name"))
    codes = table(spark, sf, "region").select(pick([F.lit(x) for x in ("A1", "B2", "C3", "D4", "E5")], F.col("r_regionkey")).alias("code"), pick([F.lit(x) for x in ("low sheen", "Gloss enamel", "low matt", "tile", "tile sheen")], F.col("r_regionkey")).alias("description"))
    return assembly.fuzzy_codes(names, codes).drop("name")


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 10 AS w FROM orders), p AS (SELECT w AS workspace_id, k, CASE WHEN k % 3 < 2 THEN 8 ELSE 0 END AS paint, CASE WHEN k % 3 > 0 THEN 3 ELSE 0 END AS tile FROM o)
 SELECT workspace_id, 'Painting' AS trade, sum(least(paint, 6))::BIGINT AS score, count(*) FILTER (WHERE paint > 0)::BIGINT AS pages FROM p GROUP BY 1 HAVING sum(least(paint, 6)) >= 4
 UNION ALL SELECT workspace_id, 'Tiling', sum(tile)::BIGINT, count(*) FILTER (WHERE tile > 0)::BIGINT FROM p GROUP BY 1 HAVING sum(tile) >= 4""")
def q_trades(spark, sf):
    """Trades by keywords, capped by page."""
    said = pick((F.lit("Paint and primer"), F.lit("PAINT, primer, tile"), F.lit("Tile")), key())
    pages = table(spark, sf, "orders").select((key() % 10).alias("workspace_id"), key().alias("id"), said.alias("extracted_text"))
    return registers.detect_trades(pages, [("Painting", "paint", 4), ("Painting", "primer", 4), ("Tiling", "Tile", 3)], page_cap=6)


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS id, CASE k % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS keep, CASE k % 5 WHEN 0 THEN 100 WHEN 1 THEN 70 WHEN 2 THEN 10 WHEN 3 THEN 0 ELSE 60 END::INT AS score,
 CASE k % 5 WHEN 0 THEN 'FLOOR_PLAN' WHEN 1 THEN 'ELEVATION' WHEN 2 THEN 'REFLECTED_CEILING_PLAN' WHEN 3 THEN 'DOOR_WINDOW_SCHEDULE' ELSE 'OTHER_GENERAL' END AS role, CASE k % 5 WHEN 0 THEN 'Level 1' ELSE 'Unassigned' END AS storey, CASE WHEN k % 5 = 0 THEN 320 ELSE 0 END::INT AS floor_rank FROM o""")
def q_page_roles(spark, sf):
    """Relevance, role, storey and floor source of pages."""
    lit = lambda *v: pick([F.lit(x) for x in v], key())
    pages = table(spark, sf, "orders").select(key().alias("id"), lit("Floor plan level 1", "North elevation", "RCP", "Window schedule", "Notes").alias("page_label"), lit("", "eave", "", "", "paint").alias("extracted_text"), lit("Floor Plan", "Roof Plan", "Roof Plan", "Structural", "Other").alias("kind"))
    rel = surfaces.page_relevance(F.col("kind"), F.col("extracted_text"))
    return registers.roles(pages).select("id", rel["keep"].alias("keep"), rel["score"].alias("score"), F.col("sheet_role.role").alias("role"), "storey", surfaces.floor_priority(F.col("page_label")).alias("floor_rank"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, (o_orderkey % 9 + 1)::VARCHAR AS n FROM orders)
 SELECT id, {choice(("'Lineaboard Cladding'", "'Rendered / Blockwork'", "'Soffits / Eaves'", "''", "'Cappings & Gutters'"), "k")} AS substrate, {choice(("'level / dimension'", "'drawing tag'", "'finish'", "'material / substrate'", "'drawing abbreviation'"), "k")} AS category,
 {choice(("'breezeway'", "'balcony_soffit'", "'external_soffit'", "'internal_ceiling'", "'unknown'"), "k")} AS overhead, {choice(("true", "true", "true", "false", "false"), "k")} AS outside, {choice(("0.95", "0.95", "0.95", "0.95", "0.4"), "k")}::DOUBLE AS sure, {choice(("'white'", "'red'", "'monument'", "NULL", "'grey'"), "k")} AS colour FROM o""")
def q_classes(spark, sf):
    """Substrates, legend entries, overhead regions and colours by their words."""
    lit = lambda *v: pick([F.lit(x) for x in v], key())
    over = classes.overhead(lit("Breezeway 2", "balcony with soffit", "Eaves", "RCP", "floor"), F.lit(1.0))
    entry = classes.legend_category(lit("ffl", "D1", "PT1", "FC1", "typ"), lit("", "wall type 3", "Low sheen", "fibre cement", "typical"))
    return table(spark, sf, "orders").select(
        key().alias("id"), classes.substrate(lit("Linea weatherboard", "blockwork wall", "EAVE lining", None, "Gutter")).alias("substrate"), entry.alias("category"),
        over["kind"].alias("overhead"), over["outside"].alias("outside"), over["scope_confidence"].alias("sure"), classes.colour_word(lit(" Off-White", "rendered", "Monument", "door", "greyish")).alias("colour"))


@query(f"""WITH o AS (SELECT o_orderkey AS id, o_orderkey AS k, (o_orderkey % 9 + 1)::VARCHAR AS n, o_orderkey % 900 + 300 AS mm FROM orders)
 SELECT id, {choice(("mm / 1000.0::DOUBLE", "mm / 1000.0::DOUBLE", "NULL", "NULL"), "k")} AS metres, {choice(("'Level ' || n", "'Ground'", "'Level 1'", "'Level ' || n"), "k")} AS storey, {choice(("'Floor Plan'", "'Elevation'", "'Other'", "'Section'"), "k")} AS page_type, {choice(("'A10' || n", "'Page ' || k", "'Page ' || k", "'Page ' || k"), "k")} AS label,
 {choice(("'Other'", "'Floor Plan'", "'Floor Plan'", "'Section'"), "k")} AS offline, {choice(("'Floor Plan'", "'Elevation'", "NULL", "NULL"), "k")} AS heading, {choice(("'A10' || n", "NULL", "NULL", "'WD-1' || n"), "k")} AS drawing, {choice(("'PT' || n", "NULL", "NULL", "'RBL'"), "k")} AS code, {choice(("'A10' || n", "NULL", "NULL", "NULL"), "k")} AS sheet, {choice(("0.9", "0.6", "0.6", "0.9"), "k")}::DOUBLE AS sure FROM o""")
def q_sheet_rules(spark, sf):
    """Dimensions, storeys, classes, headings, title blocks, drawing and finish codes of sheets."""
    k, n, mm = key(), nth(), key() % 900 + 300
    size = pick((mm.cast("string"), say(mm, " mm"), F.lit("99"), F.lit("1:100")), k)
    label = pick((say("A10", n, " level 0", n, " floor plan"), F.lit("ground floor NORTH ELEVATION"), F.lit("site plan, First Floor"), say("long section L", n)), k)
    block = pick((say("Dwg no. A10", n), F.lit("notes"), F.lit(None).cast("string"), F.lit("Scale 1:50")), k)
    head = pick((F.lit("notes\nUNIT PLAN - L1"), F.lit("South elevation"), F.lit("see roof plan"), F.lit("")), k)
    said = pick((say("D12 then A10", n), F.lit("PT01 W3"), F.lit(""), say("Drawing no: wd-1", n)), k)
    w = lambda t: F.struct(t.alias("text"), *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 0.0), ("x1", 10.0), ("y1", 4.0))])
    code = sheets.finish_codes_at(F.array(w(F.lit("wall")), w(pick((say("pt", n), F.lit("x"), F.lit(""), F.lit("to RBL")), k))))
    kind, title = sheets.page_class(label, F.lit("set.pdf"), k), sheets.title_block(block)
    return table(spark, sf, "orders").select(
        k.alias("id"), sheets.dimension_geometry_m(size).alias("metres"), sheets.storey_level(label).alias("storey"), kind["page_type"].alias("page_type"), kind["label"].alias("label"), sheets.page_class(pick((F.lit("3d view"), label, label, label), k), F.lit(""), k, sheets.OFFLINE_CLASSES)["page_type"].alias("offline"),
        sheets.strong_heading(head)["page_type"].alias("heading"), sheets.drawing_code(said).alias("drawing"), F.get(code, F.lit(0))["code"].alias("code"), title["sheet_no"].alias("sheet"), title["confidence"].alias("sure"))


@query(f"""WITH o AS (SELECT o_orderkey AS page_id, o_orderkey AS k, (o_orderkey % 900 + 100) AS n FROM orders), d AS (SELECT page_id, {choice(("n::DOUBLE", "(n * 1000)::DOUBLE", "NULL", "n::DOUBLE", "NULL"), "k")} AS value, {choice(("'mm'", "'mm'", "NULL", "'mm'", "NULL"), "k")} AS unit FROM o WHERE k % 5 NOT IN (1) OR n * 1000 <= 100000)
 SELECT page_id, 1::BIGINT AS word_id, value, unit FROM d WHERE value IS NOT NULL AND unit IS NOT NULL AND value BETWEEN 10 AND 100000""")
def q_detect_dimensions(spark, sf):
    """Dimensions that words state. (F64)"""
    n = key() % 900 + 100
    said = pick((n.cast("string"), say(n, "m"), F.lit("x"), say("w=", n), F.lit("a long text that is no dimension 1200")), key())
    return drawing.dimensions(table(spark, sf, "orders").select(key().alias("page_id"), F.lit(1).cast("long").alias("word_id"), said.alias("text")))


@query("""SELECT o_orderkey AS page_id, 'Master BEDROOM' AS label, 'text_label' AS type FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'Enclosed Area', 'rectangle' FROM orders WHERE o_orderkey % 40000 > 10000 - 10 * (o_orderkey % 2)""")
def q_named_rooms(spark, sf):
    """Words that name rooms, and filled rectangles of a room's size."""
    rows = table(spark, sf, "orders")
    words = rows.select(key().alias("page_id"), pick([F.lit(x) for x in (" Master BEDROOM ", "1200", "north")], key()).alias("text"))
    return drawing.named_rooms(words, rows.select(key().alias("page_id"), (key() % 40000 + 10 * (key() % 2)).cast("double").alias("area")))


@query("""SELECT o_orderkey AS page_id, 'Walk in Robe' AS label, 50.0::DOUBLE AS x, 105.0::DOUBLE AS y, 0.95::DOUBLE AS confidence FROM orders UNION ALL SELECT o_orderkey, 'Kitchen', 115.0, 105.0, 0.85 FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'Master Bedroom' ELSE 'Bedroom' END, CASE WHEN o_orderkey % 2 = 0 THEN 30.0 ELSE 145.0 END, 205.0, CASE WHEN o_orderkey % 2 = 0 THEN 0.95 ELSE 0.85 END FROM orders
 UNION ALL SELECT o_orderkey, 'Master', 10.0, 205.0, 0.85 FROM orders WHERE o_orderkey % 2 = 1""")
def q_room_labels(spark, sf):
    """Room labels, phrases before words."""
    far = F.when(key() % 2 == 0, 25.0).otherwise(130.0)
    word = lambda i, t, x, y, w=20.0: F.struct(F.lit(i).cast("long").alias("word_id"), F.lit(t).alias("text"), (x if not isinstance(x, float) else F.lit(x)).alias("x0"), F.lit(y).alias("y0"), ((x if not isinstance(x, float) else F.lit(x)) + w).alias("x1"), F.lit(y + 10.0).alias("y1"))
    words = F.array(word(1, "Walk", 20.0, 100.0), word(2, "in", 42.0, 100.0, 10.0), word(3, "Robe", 55.0, 100.0, 25.0), word(4, "Kitchen", 100.0, 100.0, 30.0), word(5, "1200", 200.0, 103.0), word(6, "Master", 0.0, 200.0), word(7, "Bedroom", far, 200.0, 30.0 + 0.0))
    rows = dealt(spark, sf, "orders", "o_orderkey").select(key().alias("page_id"), F.inline(words))
    rows = rows.withColumn("x1", F.when((F.col("word_id") == 7) & (F.col("page_id") % 2 == 0), 60.0).when(F.col("word_id") == 7, 160.0).otherwise(F.col("x1")))
    return drawing.room_labels(rows, ["walk", "robe", "kitchen", "master", "bedroom"], ["walk in robe", "master bedroom"])
