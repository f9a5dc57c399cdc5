"""The commercial schedule: what is measured, what is derived, what is still to be measured, in six stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing, text
from ..scratch import written
from . import takeoff

#: Words that put a row or a finish into a stage.
EXTERNAL = ("external", "exterior", "facade", "cladding", "soffit", "eave", "screen", "balustrade", "sunhood", "downpipe", "render")
SPECIALIST = ("texture", "acratex", "epoxy", "2 pac", "2-pack", "two pack", "non-slip", "non slip", "intumescent", "clear finish", "stain", "membrane", "elastomeric", "specialist")
#: What a page must say to count as evidence of a stage.
EVIDENCE = {
    "has_rcp": ("reflected ceiling", "rcp", "ceiling plan"),
    "has_partition": ("partition plan", "floor plan", "unit plan", "general arrangement"),
    "has_doors": ("door schedule", "door elevations", "door / window schedule"),
}
COLUMNS = ("workspace_id", "stage", "level", "area", "element", "unit", "base_qty", "confidence", "from_row")


def _holds(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | c.contains(w), words, F.lit(False))


def commercial(rows: DataFrame, pages: DataFrame, finishes: DataFrame) -> DataFrame:
    """Schedule lines of each workspace by stage; a stage's measured rows keep it from being derived.

    Stages: 1 floors, for reference; 2 ceilings, measured, else the floors' areas where a ceiling plan is among the
    pages; 3 internal walls, measured, else pending for each level; 4 doors, measured, else one set a named unit; 5
    external rows, equal ones once; 6 soffits and specialist finishes of the dictionary. rows: take-off rows. pages:
    workspace_id, words. finishes: workspace_id, code, description.

    The rows are read once: each lists the stages that it is measured in, and these lines are written. What a
    workspace has measured is one row of flags, by which stages are derived.
    """
    low = lambda *cs: F.lower(F.concat_ws(" ", *cs))
    q = F.coalesce("quantity", F.lit(0.0))
    shown = F.bround(F.greatest(F.lit(0.0), q), 3)
    level = text.level_commercial(F.concat_ws(" ", "location", "source_page"))
    named = F.when(F.lower("location").rlike(r"\b(?:unit|apt|apartment|villa|townhouse)\b"), F.col("location"))
    is_floor, all_words = F.col("is_floor"), F.col("all_words")
    said = lambda basis: F.coalesce("confidence", "quantity_status", F.lit(basis))
    line = lambda stage, when, area, element, unit, basis: F.when(when, F.struct(F.lit(stage).alias("stage"), F.coalesce("location", F.lit(area)).alias("area"), element.alias("element"), F.coalesce(unit, F.lit("m²")).alias("unit"), said(basis).alias("confidence")))
    own, unit = F.col("element"), F.col("unit")
    stages = F.array_compact(F.array(
        line(1, is_floor & (q > 0), "Internal", F.lit("Internal floor area"), F.lit("m²"), "Measured basis"),
        line(2, ~is_floor & low("element", "location").contains("ceiling") & (q > 0), "General", own, unit, "To review"),
        line(3, ~is_floor & all_words.contains("internal") & all_words.contains("wall") & (q > 0), "General", own, unit, "To review"),
        line(4, ~is_floor & low("element", "location").contains("door"), "General", own, unit, "To review"),
        line(5, ~is_floor & _holds(all_words, EXTERNAL), "General", own, unit, "To review"),
    ))
    once = F.struct(*[F.lower(F.trim(F.coalesce(c, F.lit("")))).alias(c) for c in ("element", "location", "substrate", "unit")], F.bround(q, 3).alias("q")).alias("once")
    marked = rows.withColumns({"is_floor": takeoff.is_floor_reference(), "all_words": low("section", "element", "location")})
    lines = marked.select("workspace_id", level.alias("level"), shown.alias("base_qty"), q.alias("q"), F.col("id").cast("long").alias("from_row"), named.alias("named"), once, F.inline(stages))
    lines = written(lines.withColumn("once", F.when(F.col("stage") == 5, F.col("once"))), "schedule-lines")

    outside = lines.filter("stage = 5").groupBy("workspace_id", "once").agg(F.min_by(F.struct(*COLUMNS), "from_row").alias("row")).select("row.*")
    groups = lines.filter("stage = 1").groupBy("workspace_id", "level").agg(F.sum("q").alias("qty"), F.count_distinct("named").alias("units"))
    has = lines.groupBy("workspace_id").agg(*[F.bool_or(F.col("stage") == k).alias(f"has_{k}") for k in (1, 2, 3, 4)])
    flags = pages.groupBy("workspace_id").agg(*[F.bool_or(_holds(F.lower("words"), w)).alias(n) for n, w in EVIDENCE.items()])
    known = has.join(flags, "workspace_id", "full").fillna(False)
    # Without floors, walls are pending where a plan is among the pages, at no level.
    met = known.join(groups, "workspace_id", "left").withColumn("floors", F.col("level").isNotNull()).withColumn("level", F.coalesce("level", F.lit("Unassigned")))
    derived = lambda stage, when, area, element, unit, quantity, confidence: F.when(when, F.struct(F.lit(stage).alias("stage"), F.lit(area).alias("area"), F.lit(element).alias("element"), F.lit(unit).alias("unit"), F.bround(F.greatest(F.lit(0.0), quantity), 3).alias("base_qty"), confidence.alias("confidence")))
    c = F.col
    made = F.array_compact(F.array(
        derived(2, c("floors") & ~c("has_2") & c("has_rcp"), "Apartments / internal", "General painted ceilings", "m²", c("qty"), F.lit("Derived basis")),
        derived(3, ~c("has_3") & (c("floors") | (c("has_partition") & ~c("has_1"))), "Apartments / internal", "Internal walls", "m²", F.lit(0.0), F.lit("Pending")),
        derived(4, c("floors") & ~c("has_4") & (c("units") > 0), "Apartments", "Apartment entry doors & frames", "No.", c("units").cast("double"), F.when(c("has_doors"), "High").otherwise("Derived")),
    ))
    rest = met.select("workspace_id", "level", F.lit(None).cast("long").alias("from_row"), F.inline(made)).select(*COLUMNS)
    words = F.lower("description")
    kind = F.when(_holds(words, ("soffit", "eave")), "External soffits / eaves").when(_holds(words, SPECIALIST), "Specialist finish")
    extra = finishes.withColumn("kind", kind).filter("kind is not null")
    soffit = F.col("kind").startswith("External")
    listed = extra.select("workspace_id", F.lit(6).alias("stage"), F.when(soffit, "External").otherwise("As documented").alias("level"), F.when(soffit, "Soffits / eaves").otherwise("Specialist").alias("area"), F.col("kind").alias("element"), F.lit("m²").alias("unit"), F.lit(0.0).alias("base_qty"), F.lit("Pending").alias("confidence"), F.lit(None).cast("long").alias("from_row"))
    return reduce(DataFrame.unionByName, (lines.filter("stage < 5").select(*COLUMNS), outside, rest, listed))


def progress(schedule: DataFrame) -> DataFrame:
    """Measured and pending lines of each workspace, and the share that is measured."""
    measured, pending = F.count_if(F.col("base_qty") > 0), F.count_if((F.col("base_qty") <= 0) & (F.lower("confidence") == "pending"))
    out = schedule.groupBy("workspace_id").agg(measured.alias("measured"), pending.alias("pending"))
    return out.withColumn("completeness_pct", F.round(100.0 * F.col("measured") / F.greatest(F.lit(1), F.col("measured") + F.col("pending")), 1))


def surface_types(rows: DataFrame, pitch: float = 25.0) -> DataFrame:
    """Each row's kind of surface, its net area and its length."""
    e, u, q = F.lower(F.coalesce("element", F.lit(""))), F.lower(F.coalesce("unit", F.lit("m²"))), F.coalesce("quantity", F.lit(0.0))
    kind = F.when(_holds(e, ("skirting", "cornice")) | (u == "m"), "SKIRTING_LINEAR").when(e.contains("ceiling") & _holds(e, ("pitched", "raked")), "CEILING_PITCHED").when(e.contains("ceiling"), "CEILING_FLAT")
    kind = kind.when(_holds(e, ("floor", "epoxy")), "FLOOR_EPOXY").when(_holds(e, ("soffit", "eave")), "SOFFIT").otherwise("INTERNAL_WALL")
    out = rows.withColumn("surface_type", kind)
    line = F.col("surface_type") == "SKIRTING_LINEAR"
    net = F.when(line, 0.0).when(F.col("surface_type") == "CEILING_PITCHED", pricing.pitched_area(q, F.lit(pitch))).otherwise(q)
    return out.select("workspace_id", "id", "surface_type", F.when(line, 0.0).otherwise(q).alias("flat_area_m2"), net.alias("net_paintable_area_m2"), F.when(line, q).otherwise(0.0).alias("linear_metres"))


def standards(rows: DataFrame, default_height: float = 2.7) -> DataFrame:
    """Each row's working height, surcharge and adjusted quantity."""
    notes, place, e = (F.lower(F.coalesce(c, F.lit(""))) for c in ("notes", "location", "element"))
    height = F.when(_holds(notes, ("high", "void")), 4.8).when(_holds(place, ("stair", "external")), 3.6).otherwise(default_height)
    out = rows.withColumn("height_m", height)
    factor = pricing.height_surcharge(F.col("height_m"))
    adjusted = pricing.minimum_area(F.coalesce("quantity", F.lit(0.0)), text.unit(F.coalesce("unit", F.lit("m²"))), e.contains("column"))
    return out.select("workspace_id", "id", "height_m", factor.alias("height_surcharge_factor"), (adjusted * factor).alias("adjusted_quantity"), (F.col("height_m") >= 3.0).alias("requires_scaffold"))
