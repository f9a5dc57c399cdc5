"""The canonical building model: levels, walls, openings, floors and roofs of each workspace, and a ledger of what was left out and why.

Parents are found by joins, never guessed: what names a wall or a level that isn't there, that was rejected itself or
that contradicts its owner is kept apart with its reason. Nothing without proof gets authority. The parts stay tables;
assembled() nests them only at the end, a row for each workspace.

Defined results: of rows that share an id the first by all their values stands and the others go to the ledger; a blank
level is the level `unresolved`; levels with one normalised name are one; a wall's missing thickness is 0.23 m.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..scratch import written
from . import fusion

#: A wall's thickness in metres, what overlaps count from, how far a roof may be from its walls' height, the states.
THICKNESS_M, LEAST_OVERLAP_M, AGREES_M = 0.23, 1e-3, 0.05
UNRESOLVED = "unresolved"
PHYSICAL = ("physical_b5_authorised", "physical_not_authorised")


@dataclass(frozen=True)
class Model:
    levels: DataFrame
    walls: DataFrame
    openings: DataFrame
    floors: DataFrame
    roofs: DataFrame
    observations: DataFrame
    ledger: DataFrame


def _level(c: Column) -> Column:
    slug = text.norm_key(c)
    return F.when(F.coalesce(slug, F.lit("")) == "", UNRESOLVED).otherwise(slug)


def _once(rows: DataFrame, keys: list[str], kind: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The first row of each id, and a ledger line for each other."""
    others = [c for c in rows.columns if c not in keys]
    listed = [c for c in others if rows.schema[c].dataType.typeName().startswith(("array", "map"))]
    best = F.min(F.struct(*sorted(set(others) - set(listed)), *listed)).alias("best")
    # One aggregate, written, says which stands and how many don't: each reader would sum and sort the rows anew.
    one = written(rows.groupBy(*keys).agg(best, F.count("*").alias("n_of_id")).select(*[F.col(c) if c in keys else F.col(f"best.{c}") for c in rows.columns], "n_of_id"), kind.lower())
    again = one.filter("n_of_id > 1").withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_of_id") - 1)))
    return one.drop("n_of_id"), _ledger(again, kind, F.col(name), F.lit("Repeated id"))


def _ledger(rows: DataFrame, kind: str, name: Column, reason: Column) -> DataFrame:
    return rows.select("workspace_id", name.cast("string").alias("id"), F.lit(kind).alias("type"), reason.alias("reason"))


def polygon_problem(points: Column) -> Column:
    """Why a polygon is none, null if it is one: too few points, a repeated one, no area, or edges that cross."""
    same = lambda a, b: (F.abs(a["x"] - b["x"]) <= 1e-9) & (F.abs(a["y"] - b["y"]) <= 1e-9)
    n = F.size(points)
    closed = (n >= 2) & same(F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1)))
    p = F.when(closed, F.slice(points, 1, F.greatest(n - 1, F.lit(0)))).otherwise(points)
    different = F.size(F.array_distinct(F.transform(p, lambda q: F.struct(F.round(q["x"], 9).alias("x"), F.round(q["y"], 9).alias("y")))))
    m = F.size(p)
    edge = lambda k: F.struct(F.element_at(p, k)["x"].alias("x1"), F.element_at(p, k)["y"].alias("y1"), F.element_at(p, k % m + 1)["x"].alias("x2"), F.element_at(p, k % m + 1)["y"].alias("y2"))
    apart = lambda i, j: (j > i + 1) & ~((i == 1) & (j == m))  # noqa: E731  edges that don't share a corner
    crossing = F.exists(F.sequence(F.lit(1), m), lambda i: F.exists(F.sequence(F.lit(1), m), lambda j: apart(i, j) & geometry.intersection(edge(i), edge(j)).isNotNull()))
    return (
        F.when(F.coalesce(n, F.lit(0)) < 3, "needs 3 points").when(different < 3, "fewer than 3 distinct points").when(different != m, "repeats a point")
        .when(geometry.area(p) * 2 <= 1e-9, "has no area").when(crossing, "crosses itself")
    )


def canonical(levels: DataFrame, walls: DataFrame, openings: DataFrame, floors: DataFrame, caps: DataFrame, validated: bool = False) -> Model:
    """levels: workspace_id, name, elevation_m. walls: workspace_id, wall_ref, x1, y1, x2, y2, height_m, thickness_m, height_status, level, takeoff_eligible.
    openings: workspace_id, wall_ref (its owner), id, opening_type, offset_m, width_m, height_m, sill_m, claimed_wall_ref, level, authorised, excluded.
    floors: workspace_id, id, points (percent of the page), page_width_px, page_height_px, px_per_m, level, manual_m2. caps: workspace_id, id, points, z, level.

    Only a validated workspace's walls, openings and floors may count in a take-off.
    """
    # Walls: both ends, or none.
    walls, again = _once(walls, ["workspace_id", "wall_ref"], "WALL", "wall_ref")
    ended = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    state = F.when(F.lower(F.trim("height_status")) == "confirmed", "CONFIRMED").when(F.lower(F.trim("height_status")) == "inferred", "INFERRED").otherwise("REVIEW_REQUIRED")
    good = walls.filter(ended).withColumns({"level_slug": _level(F.col("level")), "thickness_m": F.coalesce("thickness_m", F.lit(THICKNESS_M)), "review_state": state, "takeoff_eligible": F.coalesce("takeoff_eligible", F.lit(False)) & F.lit(validated)})
    good = written(good.withColumn("length_m", F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))), "walls")
    ledger = again.unionAll(_ledger(walls.filter(~ended), "WALL", F.col("wall_ref"), F.lit("Missing or invalid start/end coordinates")))

    # Openings: their owner must be a wall of the model, and everything they say of it must agree.
    openings, again = _once(openings, ["workspace_id", "id"], "OPENING", "id")
    owner = good.select("workspace_id", "wall_ref", F.col("level_slug").alias("wall_level"), "length_m", F.col("height_m").alias("wall_height_m"), F.col("takeoff_eligible").alias("wall_eligible"))
    met = openings.join(owner, ["workspace_id", "wall_ref"], "left")
    ref = lambda c: text.norm_key(F.col(c))
    wrong_host = F.coalesce((ref("claimed_wall_ref") != "") & (ref("claimed_wall_ref") != ref("wall_ref")), F.lit(False))
    said = _level(F.col("level"))
    wrong_level = (said != UNRESOLVED) & (said != F.col("wall_level"))
    problem = geometry.opening_fits(F.col("offset_m"), F.col("width_m"), F.col("sill_m"), F.col("height_m"), F.col("length_m"), F.col("wall_height_m"))
    placed_nowhere = F.col("offset_m").isNull() | F.col("sill_m").isNull()
    state = (
        F.when(wrong_host, "wrong_host").when(wrong_level, "wrong_level").when(problem.isNotNull() | placed_nowhere, "invalid_geometry")
        .when(F.coalesce("excluded", F.lit(False)), "manual_exclusion").when(F.coalesce("authorised", F.lit(False)) & F.lit(validated), PHYSICAL[0]).otherwise(PHYSICAL[1])
    )
    met = written(met.withColumns({"physical_state": state, "problem": F.coalesce(problem, F.when(placed_nowhere, "no_place"))}), "openings")
    ledger = ledger.unionAll(again).unionAll(_ledger(met.filter("length_m is null"), "OPENING", F.col("id"), F.lit("Unknown or rejected wall")))
    owned = met.filter("length_m is not null")
    physical = owned.filter(F.col("physical_state").isin(*PHYSICAL)).select("workspace_id", "wall_ref", "id", "offset_m", (F.col("offset_m") + F.col("width_m")).alias("end_m"), "sill_m", (F.col("sill_m") + F.col("height_m")).alias("head_m"))
    beside = fusion.overlapping(physical, ["workspace_id", "wall_ref"], "id", "offset_m", "end_m", 1.0)
    up = lambda p: physical.select("workspace_id", F.col("id").alias(f"{p}_id"), F.col("sill_m").alias(f"{p}_sill"), F.col("head_m").alias(f"{p}_head"))
    beside = beside.join(up("a"), ["workspace_id", "a_id"]).join(up("b"), ["workspace_id", "b_id"])
    over = (F.least("a_end_m", "b_end_m") - F.greatest("a_offset_m", "b_offset_m") > LEAST_OVERLAP_M) & (F.least("a_head", "b_head") - F.greatest("a_sill", "b_sill") > LEAST_OVERLAP_M)
    clash = beside.filter(over).select("workspace_id", F.explode(F.array("a_id", "b_id")).alias("id")).distinct().withColumn("clash", F.lit(True))
    owned = owned.join(clash, ["workspace_id", "id"], "left").withColumn("physical_state", F.when(F.col("clash"), "conflict_overlap").otherwise(F.col("physical_state")))
    deducts = F.col("physical_state") == PHYSICAL[0]
    owned = written(owned.withColumns({"deduction_authority": deducts, "takeoff_eligible": deducts & F.col("wall_eligible"), "review_state": F.when(deducts, "CONFIRMED").otherwise("REVIEW_REQUIRED")}), "openings")
    reason = F.when(F.col("physical_state") == "invalid_geometry", F.concat(F.lit("Invalid opening geometry: "), "problem")).otherwise(F.col("physical_state"))
    ledger = ledger.unionAll(_ledger(owned.filter(F.col("physical_state").isin("wrong_host", "wrong_level", "invalid_geometry", "conflict_overlap")), "OPENING", F.col("id"), reason))
    authority = owned.groupBy("workspace_id", "wall_ref").agg(F.bool_or("deduction_authority").alias("deduction_authority"))
    good = good.join(authority, ["workspace_id", "wall_ref"], "left").withColumn("deduction_authority", F.coalesce("deduction_authority", F.lit(False)))

    # Floors: percent of a calibrated page to metres; an area without a polygon is evidence only.
    floors, again = _once(floors, ["workspace_id", "id"], "FLOOR", "id")
    flat = F.col("manual_m2").isNotNull() & (F.coalesce(F.size("points"), F.lit(0)) <= 0)
    known = (F.col("page_width_px") > 0) & (F.col("page_height_px") > 0) & (F.col("px_per_m") > 0)
    metres = F.transform("points", lambda p: F.struct((p["x"] / 100 * F.col("page_width_px") / F.col("px_per_m")).alias("x"), (p["y"] / 100 * F.col("page_height_px") / F.col("px_per_m")).alias("y")))
    drawn = floors.filter(~F.coalesce(flat, F.lit(False))).withColumns({"known": F.coalesce(known, F.lit(False)), "polygon": metres, "level_slug": _level(F.col("level"))})
    why = F.when(~F.col("known"), "Invalid floor polygon geometry: missing page dimensions or calibration").when(polygon_problem(F.col("polygon")).isNotNull(), F.concat(F.lit("Invalid floor polygon geometry: "), polygon_problem(F.col("polygon"))))
    drawn = written(drawn.withColumn("why", F.coalesce(why, F.when(F.col("level_slug") == UNRESOLVED, "No storey identity"))), "floors")
    placed = drawn.filter("why is null").withColumn("area_m2", geometry.area(F.col("polygon"))).withColumn("takeoff_eligible", F.lit(validated))
    ledger = ledger.unionAll(again).unionAll(_ledger(drawn.filter("why is not null"), "FLOOR", F.col("id"), F.col("why")))
    seen = floors.filter(flat).select("workspace_id", F.col("id").cast("string").alias("id"), F.lit("manual_floor_area_allowance").alias("kind"), F.col("manual_m2").alias("area_m2"))
    seen = seen.unionAll(drawn.filter("why is not null").select("workspace_id", F.col("id").cast("string"), F.when(F.col("why") == "No storey identity", "unresolved_floor_level").otherwise("rejected_floor_polygon"), F.lit(None).cast("double")))

    # Levels: those declared, and those that walls and floors are on.
    named = levels.select("workspace_id", F.col("name"), F.col("elevation_m").cast("double").alias("elevation_m"), F.lit(0).alias("rank"))
    for d in (good, placed):
        named = named.unionAll(d.select("workspace_id", F.col("level"), F.lit(None).cast("double"), F.lit(1)))
    stood = fusion.choose(named.withColumn("level_slug", _level(F.col("name"))), ["workspace_id", "level_slug"], [F.col("rank"), F.col("elevation_m").isNull(), F.col("elevation_m"), F.col("name")]).select("workspace_id", "level_slug", "name", "elevation_m")

    # Roofs: their height only where the level's elevation and all its walls' heights are known and agree.
    caps, again = _once(caps, ["workspace_id", "id"], "ROOF", "id")
    shaped = caps.withColumns({"level_slug": _level(F.col("level")), "why": polygon_problem(F.col("points"))})
    ledger = ledger.unionAll(again).unionAll(_ledger(shaped.filter("why is not null"), "ROOF", F.col("id"), F.concat(F.lit("Invalid roof cap geometry: "), "why")))
    heights = good.groupBy("workspace_id", "level_slug").agg(F.min((F.coalesce(F.col("height_m") > 0, F.lit(False))) & (F.col("review_state") == "CONFIRMED")).alias("sure"), F.max("height_m").alias("top_m"))
    under = shaped.filter("why is null").join(heights, ["workspace_id", "level_slug"], "left").join(stood.select("workspace_id", "level_slug", "elevation_m"), ["workspace_id", "level_slug"], "left")
    sure = F.coalesce("sure", F.lit(False))
    agrees = F.col("z").isNull() | (F.abs(F.col("z") - F.col("top_m")) <= AGREES_M)
    message = F.when(F.col("elevation_m").isNull(), "level's elevation is unresolved").when(~sure, "walls' heights are unconfirmed").when(~F.coalesce(agrees, F.lit(False)), "disagrees with the walls' height")
    roofs = under.withColumn("z_message", message).withColumn("z_m", F.when(F.col("z_message").isNull(), F.col("elevation_m") + F.col("top_m")))
    roofs = roofs.select("workspace_id", F.col("id").cast("string").alias("id"), "level_slug", "points", "z_m", "z_message", (F.col("z_m").isNotNull() & (F.col("level_slug") != UNRESOLVED) & F.lit(validated)).alias("takeoff_eligible"))
    wall_columns = ("workspace_id", "wall_ref", "level_slug", "x1", "y1", "x2", "y2", "height_m", "thickness_m", "length_m", "review_state", "takeoff_eligible", "deduction_authority")
    return Model(stood, good.select(*wall_columns), owned.drop("clash", "wall_eligible", "length_m", "wall_height_m"), placed.select("workspace_id", F.col("id").cast("string").alias("id"), "level_slug", "polygon", "area_m2", "takeoff_eligible"), roofs, seen, ledger)


def assembled(model: Model) -> DataFrame:
    """A nested row for each workspace: levels, walls with their openings, floors, roofs and what was left out."""
    nested = lambda d, name, by: d.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*[c for c in d.columns if c not in by]))).alias(name))
    walls = model.walls.join(nested(model.openings.select("workspace_id", "wall_ref", "id", "physical_state", "deduction_authority"), "openings", ["workspace_id", "wall_ref"]), ["workspace_id", "wall_ref"], "left")
    parts = [nested(d, name, ["workspace_id"]) for d, name in ((model.levels, "levels"), (walls, "walls"), (model.floors, "floors"), (model.roofs, "roofs"), (model.ledger, "ledger"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "workspace_id", "full")
    return out
