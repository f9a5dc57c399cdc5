"""Take-off rows: what may be priced, what it costs, what a level and a quote come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing, text
from ..functions.kept import kept

#: Fields that an approval binds.
BOUND = (
    "workspace_id", "section", "element", "location", "substrate", "finish_system", "quantity", "unit", "quantity_status", "source_page", "source_reference",
    "inclusion_status", "coats", "coverage_m2_per_litre", "productivity_m2_per_hour", "rate_per_unit", "confidence", "notes", "row_role",
    "commercial_authority_source", "commercial_authority_reviewed_by", "commercial_authority_reviewed_at",
)
NOTHING = ("", "nan", "none", "null")


def _token(c: str) -> Column:
    return F.translate(F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))), "- ", "__")


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


@kept
def is_floor_reference() -> Column:
    return _token("row_role") == "floor_area"


@kept
def is_excluded() -> Column:
    """(P5)"""
    return _token("inclusion_status").isin("exclude", "excluded", "exclusion")


@kept
def is_model_surface() -> Column:
    """Rows from the 3D model; once they carry marks of an approval they stay such."""
    source = _token("source_reference")
    marked = ~F.lower(_text("commercial_authority_fingerprint")).isin(*NOTHING) | ~F.lower(_text("commercial_authority_source")).isin(*NOTHING) | (_token("commercial_authority_status") == "approved")
    return (_token("row_role") == "model_surface") | source.contains("3d_surface_editor") | _token("source_page").isin("3d_model", "3d", "model_surface") | marked


@kept
def approval_fingerprint() -> Column:
    """sha256 over every bound field in order; nulls are told apart from empty text."""
    field = lambda c: F.coalesce(F.concat(F.lit("="), F.trim(F.col(c).cast("string"))), F.lit("~"))
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(c), field(c)) for c in BOUND]), 256)


@kept
def authority() -> Column:
    """Why a model surface isn't approved, APPROVED if it is, NOT_MODEL_SURFACE for other rows."""
    missing = lambda c: _token(c).isin(*NOTHING)
    out = F.when(~is_model_surface(), "NOT_MODEL_SURFACE").when(F.upper(_text("commercial_authority_status")) != "APPROVED", "NO_APPROVAL")
    out = out.when(~F.coalesce(F.col("workspace_id") > 0, F.lit(False)), "NO_WORKSPACE").when(missing("commercial_authority_source"), "NO_SOURCE")
    out = out.when(missing("commercial_authority_reviewed_by"), "NO_REVIEWER").when(missing("commercial_authority_reviewed_at"), "NO_TIMESTAMP")
    return out.when(_text("commercial_authority_fingerprint") != approval_fingerprint(), "ROW_CHANGED").otherwise("APPROVED")


def approve(rows: DataFrame, source: str, reviewer: str, at: str) -> DataFrame:
    """Rows with an approval of their present state."""
    if any(x.strip().lower() in NOTHING for x in (source, reviewer, at)):
        raise ValueError("source, reviewer and time of review are required")
    named = {"commercial_authority_status": "APPROVED", "commercial_authority_source": source, "commercial_authority_reviewed_by": reviewer, "commercial_authority_reviewed_at": at}
    return rows.withColumns({k: F.lit(v) for k, v in named.items()}).withColumn("commercial_authority_fingerprint", approval_fingerprint())


@kept
def is_work() -> Column:
    """Rows that may be priced: no floor reference, not excluded, model surfaces only if approved."""
    return ~is_floor_reference() & ~is_excluded() & authority().isin("NOT_MODEL_SURFACE", "APPROVED")


def commercial(rows: DataFrame) -> DataFrame:
    """Work and floor references."""
    return rows.filter(is_work() | is_floor_reference())


#: Section words that make a wall external.
EXTERNAL = ("external", "exterior", "facade", "elevation", "soffit", "cladding", "roof", "canopy", "balcony", "deck")


def is_internal_wall() -> Column:
    """(P7)"""
    section, element = F.lower(_text("section")), F.lower(_text("element"))
    outside = F.lit(False)
    for w in EXTERNAL:
        outside = outside | section.contains(w)
    return element.contains("wall") & ~outside


def floor_rows(rows: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """One floor reference a scope: mapped before reviewed before others, then the later id."""
    floors = rows.filter(is_floor_reference() & (text.unit(F.col("unit")) == "m²")).withColumn("scope", text.scope(F.col("location")))
    is_mapped = F.lower(_text("quantity_status")) == "mapped"
    if mapped is not None:
        known = mapped.select(F.col("takeoff_row_id").alias("mapped_id")).distinct()
        floors = floors.join(known, floors["id"] == known["mapped_id"], "left")
        is_mapped = is_mapped | F.col("mapped_id").isNotNull()
    reviewed = F.lower(_text("confidence")).isin("confirmed", "reviewed", "verified", "approved")
    ai = F.concat_ws(" ", "source_reference", "notes", "confidence")
    by_hand = ~F.lower(ai).rlike("ai draft|ai plan review|ai-generated|ai generated")
    rank = F.struct(F.when(is_mapped, 5).otherwise(0).alias("a"), F.when(reviewed, 3).when(by_hand, 1).otherwise(0).alias("b"), F.col("id").alias("id"))
    best = floors.groupBy("workspace_id", "scope").agg(F.max_by(F.greatest(F.lit(0.0), "quantity"), rank).alias("floor_m2"))
    return best.withColumn("level", F.element_at(F.split("scope", r" \| "), -1))


def priced(rows: DataFrame, basis: str = "wall_m2", mapped: DataFrame | None = None) -> DataFrame:
    """Commercial rows with litres, hours, priced quantity, pricing basis and value.

    On the basis floor_m2, internal walls share the floor of their scope, or else of their level where only one scope
    of it has a floor, in proportion to their areas.
    """
    rows = commercial(rows)
    q = F.greatest(F.lit(0.0), F.coalesce(F.col("quantity"), F.lit(0.0)))
    u = F.col("unit")
    pick = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    out = rows.withColumn("is_floor", is_floor_reference()).withColumn("scope", text.scope(F.col("location"))).withColumn("level", text.level(F.col("location")))
    if basis == "floor_m2":
        out = out.withColumn("shares", ~F.col("is_floor") & (text.unit(u) == "m²") & is_internal_wall())
        floors = floor_rows(rows, mapped)
        exact = floors.select("workspace_id", "scope", F.col("floor_m2").alias("own_floor"))
        lone = floors.filter("floor_m2 > 0").groupBy("workspace_id", "level").agg(F.count("*").alias("n"), F.max("floor_m2").alias("level_floor")).filter("n = 1").drop("n")
        walls = out.filter("shares").groupBy("workspace_id", "scope").agg(F.sum(q).alias("scope_m2"), F.count("*").alias("scope_rows"))
        out = out.join(exact, ["workspace_id", "scope"], "left").join(lone, ["workspace_id", "level"], "left").join(walls, ["workspace_id", "scope"], "left")
        floor = F.coalesce("own_floor", "level_floor", F.lit(0.0))
        share = F.when(F.col("scope_rows") == 1, floor).when(F.col("scope_m2") > 0, floor * q / F.col("scope_m2")).otherwise(0.0)
        amount = F.when(F.col("shares"), share).otherwise(q)
        label = F.when(F.col("shares") & (F.col("scope_rows") > 1), "Floor m² allocated").when(F.col("shares"), "Floor m²").otherwise("Quantity")
    else:
        amount, label = q, F.lit("Quantity")
    out = out.withColumns({
        "paint_litres": F.when(F.col("is_floor"), 0.0).otherwise(pricing.litres(q, u, pick("coats", 2.0), pick("coverage_m2_per_litre", 12.0))),
        "labour_hours": F.when(F.col("is_floor"), 0.0).otherwise(pricing.hours(q, u, pick("productivity_m2_per_hour", 8.0))),
        "priced_quantity": F.when(F.col("is_floor"), F.when(u == "m²", q).otherwise(0.0)).otherwise(amount),
        "pricing_basis": F.when(F.col("is_floor"), "Floor area (reference)").otherwise(label),
    })
    out = out.withColumn("value_ex_gst", F.when(F.col("is_floor"), 0.0).otherwise(pricing.value(F.col("priced_quantity"), pick("rate_per_unit", 0.0))))
    return out.select(*rows.columns, "level", "scope", "paint_litres", "labour_hours", "priced_quantity", "pricing_basis", "value_ex_gst")


def per_level(priced_rows: DataFrame) -> DataFrame:
    """Conditional sums of each level, in building order. (A1, A2, A4)"""
    work, q = ~is_floor_reference(), F.coalesce(F.col("quantity"), F.lit(0.0))
    total = lambda when, what: F.sum(F.when(when, what).otherwise(0.0))
    out = priced_rows.groupBy("level").agg(
        F.sum(work.cast("long")).alias("rows"), total(work & (F.col("unit") == "m²"), q).alias("m2"), total(~work & (F.col("unit") == "m²"), q).alias("floor_m2"), total(work & (F.col("unit") == "lm"), q).alias("lm"),
        total(work & F.col("unit").isin("No.", "item"), q).alias("count"), F.sum("paint_litres").alias("paint_litres"), F.sum("labour_hours").alias("labour_hours"), F.sum("value_ex_gst").alias("value_ex_gst"),
    )
    return out.orderBy(text.level_rank(F.col("level")), "level")


def quote(levels: DataFrame, margin_pct: float = 10.0, gst_pct: float = 10.0) -> DataFrame:
    """(A3)"""
    out = levels.withColumn("markup_ex_gst", F.col("value_ex_gst") * (1 + margin_pct / 100))
    return out.withColumn("gst", F.col("markup_ex_gst") * (gst_pct / 100)).withColumn("total_inc_gst", F.col("markup_ex_gst") + F.col("gst"))


def difference(first: Column, second: Column) -> Column:
    """matched, different or which side alone; within 2 % of the larger, a hundredth at least. (A10)"""
    near = F.abs(second - first) <= F.greatest(F.lit(0.01), 0.02 * F.greatest(first, second))
    return F.when((first == 0) & (second == 0), "Manual / not yet measured").when((first > 0) & (second > 0), F.when(near, "Matched").otherwise("Difference")).when(first > 0, "AI only (not drawn)").otherwise("Drawn only (no AI draft)")


def reconcile(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Drafted against drawn quantities of each section, element, location and unit."""
    drawn = lines.filter("takeoff_row_id is not null").select(F.col("takeoff_row_id").alias("drawn_id")).distinct()
    ai = F.coalesce(F.col("source_reference").contains("AI"), F.lit(False)) | F.coalesce(F.col("notes").rlike("AI plan review|AI-generated|AI draft"), F.lit(False))
    basis = F.when(F.col("drawn_id").isNotNull(), "Drawn").when(ai, "AI").when(F.col("source_page").endswith(" import"), "Imported").otherwise("Manual")
    keys = ["section", "element", "location", "unit"]
    based = rows.join(drawn, rows["id"] == drawn["drawn_id"], "left").select(*[F.coalesce(k, F.lit("")).alias(k) for k in keys], F.coalesce("quantity", F.lit(0.0)).alias("q"), basis.alias("basis"))
    of = lambda b: F.sum(F.when(F.col("basis") == b, F.col("q")).otherwise(0.0))
    out = based.groupBy(*keys).agg(of("AI").alias("ai_qty"), of("Drawn").alias("drawn_qty"), F.array_join(F.array_sort(F.collect_set("basis")), ", ").alias("basis"))
    return out.withColumn("variance", F.col("drawn_qty") - F.col("ai_qty")).withColumn("status", difference(F.col("ai_qty"), F.col("drawn_qty")))


def copy_to_level(rows: DataFrame, ids: DataFrame, target: str) -> DataFrame:
    """Copies of the rows named, at another level with quantity 0, unless an equal row stands there."""
    here = F.coalesce(F.trim("location"), F.lit(""))
    named = r"(?i)ground|level [1-5]|roof"
    moved = F.when(here.rlike(named), F.regexp_replace(here, rf"^(.*?)({named})", f"$1{target}")).when(here == "", F.lit(target)).otherwise(F.concat(F.lit(f"{target} · "), here))
    copies = rows.join(ids.select("id").distinct(), "id", "left_semi").withColumn("location", moved).withColumn("quantity", F.lit(0.0)).withColumn("id", F.lit(None).cast(rows.schema["id"].dataType))
    keys = ["workspace_id", "section", "element", "location", "substrate", "unit"]
    cond = None
    there = rows.select(*[F.col(k).alias(f"at_{k}") for k in keys]).distinct()
    for k in keys:
        c = copies[k].eqNullSafe(F.col(f"at_{k}"))
        cond = c if cond is None else cond & c
    return copies.join(there, cond, "left_anti").select(*rows.columns)


def measured(rows: DataFrame, shapes: DataFrame, wall_height: float = 2.7) -> DataFrame:
    """Quantities from the shapes drawn for each row; without a usable shape the quantity before mapping.

    shapes: takeoff_row_id, kind, measurement_basis, length_m, area_m2, perimeter_m.
    """
    unit = rows.select(F.col("id").alias("takeoff_row_id"), text.line_unit(F.col("unit")).alias("u"))
    polygon = F.lower(F.col("kind")) == "polygon"
    basis = F.lower(F.coalesce(F.trim("measurement_basis"), F.lit("")))
    square = F.when(~polygon, None).when(basis == "footprint_perimeter_height", F.col("perimeter_m") * wall_height).when(basis == "deduction", -F.col("area_m2")).otherwise(F.col("area_m2"))
    val = F.when(F.col("u") == "m2", square).when(F.col("u") == "m", F.when(polygon, F.col("perimeter_m")).otherwise(F.col("length_m")))
    sums = shapes.join(unit, "takeoff_row_id").withColumn("val", val).groupBy("takeoff_row_id").agg(F.sum("val").alias("total"), F.sum((F.col("val") != 0).cast("long")).alias("used"), F.sum(F.col("val").isNull().cast("long")).alias("bad_shapes"))
    joined = rows.join(sums, rows["id"] == sums["takeoff_row_id"], "left").drop("takeoff_row_id")
    usable = F.coalesce(F.col("used") > 0, F.lit(False))
    fallback = F.greatest(F.lit(0.0), F.coalesce("pre_map_quantity", "ai_baseline_quantity", F.lit(0.0)))
    return joined.withColumn("quantity", F.when(usable, F.bround(F.greatest(F.lit(0.0), "total"), 3)).otherwise(fallback)).withColumn("quantity_status", F.when(usable, "Mapped").otherwise(F.coalesce("pre_map_quantity_status", F.lit("To measure")))).drop("total", "used")


def section_summary(rows: DataFrame) -> DataFrame:
    """(A13-A15)"""
    return rows.groupBy("section", "unit").agg(F.count("*").alias("rows"), F.sum("quantity").alias("quantity"), F.sum("value_ex_gst").alias("value_ex_gst"))


def completion(areas: DataFrame) -> DataFrame:
    """Total, done and remaining area with excluded areas left out."""
    a = areas.filter(F.lower(F.coalesce("status", F.lit(""))) != "excluded")
    done = F.sum(F.col("area_m2") * F.least(F.greatest(F.coalesce("progress_pct", F.lit(0.0)), F.lit(0.0)), F.lit(100.0)) / 100)
    out = a.agg(F.coalesce(F.sum("area_m2"), F.lit(0.0)).alias("total_m2"), F.coalesce(done, F.lit(0.0)).alias("done_m2"))
    return out.withColumn("remaining_m2", F.col("total_m2") - F.col("done_m2")).withColumn("pct", F.coalesce(F.try_divide("done_m2", "total_m2") * 100, F.lit(0.0)))
