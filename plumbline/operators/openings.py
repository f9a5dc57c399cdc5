"""Openings: one record for each physical opening, what it may take off its wall, and what is left of the wall.

Evidence rows: opening_instance_id, type_mark, wall_ref, level, opening_type, position_along_wall_m, width_m, height_m,
dimension_basis, dimension_source, geometry_confidence, dimension_confidence, association_confidence, source, accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import graph

#: Thresholds and tolerances.
AUTO, DERIVED, REVIEW = 0.90, 0.70, 0.50
WIDTH_TOLERANCE, HEIGHT_TOLERANCE, POSITION_TOLERANCE = 0.05, 0.05, 0.20
CONFLICT_M = 0.05
WALL_TOLERANCE_M2 = 0.001
#: What a dimension is of, the better first.
BASES = ("rough_opening", "clear_opening", "frame", "leaf", "unknown")
ANY_KIND = "opening"


def basis_rank(basis: Column) -> Column:
    out = F.when(F.lit(False), 0)
    for k, name in enumerate(BASES[:-1]):
        out = out.when(basis == name, len(BASES) - 1 - k)
    return out.otherwise(0)


def least_confidence() -> Column:
    """The least of the three confidences; null if one is missing or out of range."""
    three = [text.confidence(F.col(c)) for c in ("geometry_confidence", "dimension_confidence", "association_confidence")]
    known = three[0].isNotNull() & three[1].isNotNull() & three[2].isNotNull()
    return F.when(known, F.least(*three))


def deduction_status() -> Column:
    """auto_eligible, derived_eligible, review or none."""
    whole = (F.col("width_m") > 0) & (F.col("height_m") > 0) & (F.coalesce("wall_ref", F.lit("")) != "") & (F.col("dimension_basis") == "rough_opening")
    c = F.coalesce(least_confidence(), F.lit(0.0))
    return F.when(~F.coalesce(whole, F.lit(False)), "review").when(c >= AUTO, "auto_eligible").when(c >= DERIVED, "derived_eligible").when(c >= REVIEW, "review").otherwise("none")


def eligible() -> Column:
    """All conditions of an automatic deduction; anything missing is a no."""
    finite = lambda c: (F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf"))
    positive = lambda c: F.col(c).isNull() | (F.col(c) > 0)
    every = F.col("reconciliation_complete") & F.col("deduction_status").isin("auto_eligible", "derived_eligible") & finite("width_m") & finite("height_m") & (F.col("dimension_basis") == "rough_opening")
    every = every & (least_confidence() >= DERIVED) & text.clean_id(F.col("wall_ref")).isNotNull() & finite("area_m2") & text.clean_id(F.col("opening_instance_id")).isNotNull()
    every = every & positive("page_no") & positive("workspace_id") & text.clean_id(F.col("dimension_source")).isNotNull()
    return F.coalesce(every, F.lit(False))


def _near(a: str, b: str, tolerance: float) -> Column:
    """Null agrees with anything."""
    return F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance + 1e-9, F.lit(True))


def same_opening_pairs(evidence: DataFrame, id_column: str = "opening_instance_id") -> DataFrame:
    """Pairs a < b that are provably one opening: same wall, near position, nothing that contradicts.

    Positions go into buckets of the tolerance, so a wall's openings are never all compared with each other.
    """
    cols = ["level", "opening_type", "position_along_wall_m", "width_m", "height_m", id_column]
    rows = evidence.filter("wall_ref is not null and wall_ref <> '' and position_along_wall_m is not null").select("wall_ref", *cols)
    keyed = rows.withColumn("bucket", F.floor(F.col("position_along_wall_m") / POSITION_TOLERANCE))
    side = lambda d, p: d.select("wall_ref", "bucket", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    around = keyed.withColumn("bucket", F.explode(F.sequence(F.col("bucket") - 2, F.col("bucket") + 2)))
    pairs = side(keyed, "a").join(side(around, "b"), ["wall_ref", "bucket"]).filter(F.col(f"a_{id_column}") < F.col(f"b_{id_column}"))
    agree = lambda c, free: (F.coalesce(f"a_{c}", F.lit(free)) == free) | (F.coalesce(f"b_{c}", F.lit(free)) == free) | (F.col(f"a_{c}") == F.col(f"b_{c}"))
    ok = agree("level", "") & agree("opening_type", ANY_KIND) & _near("a_position_along_wall_m", "b_position_along_wall_m", POSITION_TOLERANCE)
    return pairs.filter(ok & _near("a_width_m", "b_width_m", WIDTH_TOLERANCE) & _near("a_height_m", "b_height_m", HEIGHT_TOLERANCE)).drop("bucket")


def physical_duplicates(evidence: DataFrame) -> DataFrame:
    """Merged openings with the conflicts that keep others at the same place apart. (U4)

    At one place of a wall, evidence without contradiction is merged; different marks, or a door and a window, stay
    apart with the conflict named on both, and so do equal plan geometries on different walls. A conflict forces
    review. evidence has plan_geometry_signature beside the columns above. Merging is transitive.
    """
    cols = ["opening_instance_id", "type_mark", "level", "opening_type", "position_along_wall_m", "width_m", "height_m"]
    rows = evidence.filter("wall_ref is not null and wall_ref <> '' and position_along_wall_m is not null").select("wall_ref", *cols).withColumn("bucket", F.floor(F.col("position_along_wall_m") / POSITION_TOLERANCE))
    side = lambda d, p: d.select("wall_ref", "bucket", *[F.col(c).alias(f"{p}_{c}") for c in cols])
    around = rows.withColumn("bucket", F.explode(F.sequence(F.col("bucket") - 2, F.col("bucket") + 2)))
    pairs = side(rows, "a").join(side(around, "b"), ["wall_ref", "bucket"]).filter("a_opening_instance_id < b_opening_instance_id")
    given = lambda c: F.nullif(F.upper(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    differ = lambda c: F.coalesce(given(f"a_{c}") != given(f"b_{c}"), F.lit(False))
    any_kind = (F.coalesce("a_opening_type", F.lit(ANY_KIND)) == ANY_KIND) | (F.coalesce("b_opening_type", F.lit(ANY_KIND)) == ANY_KIND)
    here = pairs.filter(~differ("level") & _near("a_position_along_wall_m", "b_position_along_wall_m", POSITION_TOLERANCE) & _near("a_width_m", "b_width_m", WIDTH_TOLERANCE))
    reason = F.when(~any_kind & differ("opening_type"), "conflicting_types").when(differ("type_mark"), "conflicting_marks")
    here = here.withColumn("reason", reason)
    edges = here.filter(F.col("reason").isNull() & _near("a_height_m", "b_height_m", HEIGHT_TOLERANCE)).select("a_opening_instance_id", "b_opening_instance_id")
    joined = graph.components(edges, "a_opening_instance_id", "b_opening_instance_id").select(F.col("node").alias("opening_instance_id"), F.col("component").alias("merged_into"))
    members = evidence.join(joined, "opening_instance_id", "left").withColumn("merged_into", F.coalesce("merged_into", "opening_instance_id"))
    walls = members.filter("plan_geometry_signature is not null").groupBy("plan_geometry_signature").agg(F.count_distinct("wall_ref").alias("walls")).filter("walls > 1")
    ambiguous = members.join(walls, "plan_geometry_signature", "left_semi").select("merged_into", F.lit("wall_association_conflict").alias("reason"))
    ends = here.filter("reason is not null").select("reason", F.explode(F.array("a_opening_instance_id", "b_opening_instance_id")).alias("opening_instance_id"))
    named = ends.join(members.select("opening_instance_id", "merged_into").distinct(), "opening_instance_id").select("merged_into", "reason").unionAll(ambiguous)
    reasons = named.groupBy(F.col("merged_into").alias("opening_instance_id")).agg(F.array_sort(F.collect_set("reason")).alias("physical_conflicts"))
    out = reconcile(merge(members.withColumn("opening_instance_id", F.col("merged_into")))).join(reasons, "opening_instance_id", "left")
    return out.withColumn("deduction_status", F.when(F.col("physical_conflicts").isNotNull(), "review").otherwise(F.col("deduction_status")))


def merge(evidence: DataFrame) -> DataFrame:
    """One record of each instance id: the best whole pair of dimensions, the largest confidences, all sources.

    Dimensions come together or not at all: by basis, then confidence, then a schedule before other sources.
    """
    both = F.col("width_m").isNotNull() & F.col("height_m").isNotNull()
    schedule = (F.col("dimension_source") == "schedule_parse").cast("int")
    rank = F.struct(basis_rank(F.col("dimension_basis")).alias("r"), F.round("dimension_confidence", 9).alias("c"), schedule.alias("s"), F.col("width_m").alias("width_m"), F.col("height_m").alias("height_m"), F.col("dimension_basis").alias("basis"), F.col("dimension_source").alias("source"))
    best = F.max(F.when(both, rank)).alias("best")
    first = [F.min(F.when(F.col(c) != "", F.col(c))).alias(c) for c in ("type_mark", "wall_ref", "level")]
    kind = F.min(F.when(F.col("opening_type") != ANY_KIND, F.col("opening_type"))).alias("kind")
    confidences = [F.max(c).alias(c) for c in ("geometry_confidence", "dimension_confidence", "association_confidence")]
    spread = [(F.max(c) - F.min(c)).alias(f"{c}_spread") for c in ("width_m", "height_m")]
    out = evidence.groupBy("opening_instance_id").agg(best, *first, kind, F.min("position_along_wall_m").alias("position_along_wall_m"), *confidences, *spread, F.count_distinct("type_mark").alias("marks"), F.array_sort(F.collect_set("source")).alias("sources"))
    out = out.withColumns({"width_m": F.col("best.width_m"), "height_m": F.col("best.height_m"), "dimension_basis": F.coalesce("best.basis", F.lit("unknown")), "dimension_source": F.col("best.source"), "opening_type": F.coalesce("kind", F.lit(ANY_KIND))})
    return out.withColumn("area_m2", F.bround(F.col("width_m") * F.col("height_m"), 4)).drop("best", "kind")


def reconcile(merged: DataFrame) -> DataFrame:
    """Names conflicts between the sources; an opening with one goes to review."""
    found = F.array(F.when(F.col("width_m_spread") > CONFLICT_M, "width"), F.when(F.col("height_m_spread") > CONFLICT_M, "height"), F.when(F.col("marks") > 1, "mark"), F.when(F.col("dimension_basis") == "unknown", "basis"))
    out = merged.withColumn("conflicts", F.filter(found, lambda x: x.isNotNull())).withColumn("deduction_status", deduction_status())
    return out.withColumn("deduction_status", F.when(F.size("conflicts") > 0, "review").otherwise(F.col("deduction_status"))).withColumn("reconciliation_complete", F.lit(True))


def decide(reconciled: DataFrame) -> DataFrame:
    """deduct is true only where every condition holds."""
    rows = reconciled
    for c, kind in (("page_no", "long"), ("workspace_id", "long")):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast(kind))
    return rows.withColumn("deduct", eligible())


def pipeline(evidence: DataFrame) -> DataFrame:
    """Evidence to decisions."""
    return decide(reconcile(merge(evidence)))


def net_walls(walls: DataFrame, openings: DataFrame) -> DataFrame:
    """gross, deducted and net area of each wall; more deducted than there is is an error, net 0."""
    good = F.coalesce(F.col("deduct") & (F.col("area_m2") > 0) & ~F.isnan("area_m2"), F.lit(False))
    sums = openings.filter(good).groupBy("wall_ref").agg(F.bround(F.sum("area_m2"), 4).alias("deducted_m2"), F.count("*").alias("n_openings"))
    out = walls.join(sums, "wall_ref", "left").withColumns({"deducted_m2": F.coalesce("deducted_m2", F.lit(0.0)), "n_openings": F.coalesce("n_openings", F.lit(0))})
    over = F.col("deducted_m2") - F.col("gross_m2") - WALL_TOLERANCE_M2 > 0
    return out.withColumn("valid", ~over).withColumn("net_m2", F.when(over, 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.col("gross_m2") - F.col("deducted_m2")), 4)))


def attach(openings: DataFrame, walls: DataFrame) -> DataFrame:
    """Each opening's wall: the one it names, else the longest wall of its side."""
    longest = walls.groupBy("side").agg(F.max_by("wall_ref", F.struct("length_m", "wall_ref")).alias("side_wall"))
    known = walls.select("wall_ref", F.lit(True).alias("known"))
    out = openings.join(known, "wall_ref", "left").join(longest, openings["elevation_side"] == longest["side"], "left").drop("side")
    return out.withColumn("attached_wall", F.when(F.col("known"), F.col("wall_ref")).otherwise(F.col("side_wall"))).drop("known", "side_wall")


def substrates(walls: DataFrame, evidence: DataFrame) -> DataFrame:
    """A wall's substrate: what is said of the wall itself, else of its side; several are Mixed, none To confirm."""
    agg = lambda k: evidence.filter(F.col(k).isNotNull()).groupBy(k).agg(F.array_sort(F.collect_set("substrate")).alias(f"of_{k}"))
    out = walls.join(agg("wall_ref"), "wall_ref", "left").join(agg("side"), "side", "left")
    found = F.coalesce("of_wall_ref", "of_side")
    return out.withColumn("substrate", F.when(found.isNull() | (F.size(found) == 0), "To confirm").when(F.size(found) == 1, found[0]).otherwise("Mixed")).drop("of_wall_ref", "of_side")
