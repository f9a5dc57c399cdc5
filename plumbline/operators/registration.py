"""Elevation pages registered to the four sides of a building, page by page: a side that is used counts less from then on.

What a page gets depends on the pages before it only through the set of used sides, and that set grows four times at
most. So the walk is not made page by page: the first page that would use a new side is found for all workspaces at
once, as a minimum that combines before the shuffle, and after four such rounds every page knows the set it meets. A
workspace may have any number of pages.

Defined results: a page without a named side takes the best score, ties in the order of SIDES; a named side is taken
whatever its score; a page without usable dimensions has confidence 0 for every side; a side without a width is 0 m
wide; pages with a null workspace have one of their own; a null page number comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kept import let
from ..scratch import written

#: The sides in order, the bounds of a dimension in metres, what a percent of difference costs, what a named side gains and a used one loses, and the states of a registration.
SIDES = ("North", "East", "South", "West")
LEAST_M, MOST_M, PER_PERCENT, NAMED, USED = 0.25, 150.0, 8.0, 80, 8
CLOSE_PCT, NEAR_PCT = 2.0, 5.0
VERIFIED, ORIENTED, PROBABLE, OPEN = "Verified cross-view", "Orientation identified; width needs review", "Probable width match; orientation needs review", "Needs estimator registration"


def width_match(width: Column, candidates: Column) -> Column:
    """struct(dimension_m, difference_pct, confidence): the first of the candidates nearest to a side's width."""
    valid = F.filter(F.coalesce(candidates, F.array().cast("array<double>")), lambda v: v.between(LEAST_M, MOST_M))
    nearest = F.array_min(F.transform(valid, lambda v, k: F.struct(F.abs(v - width).alias("off"), k.alias("k"), v.alias("v"))))

    def match(best: Column) -> Column:
        known = (width > 0) & best.isNotNull()
        pct = best["off"] / width * 100.0
        sure = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(100.0 - pct * PER_PERCENT)))
        return F.struct(F.when(known, F.bround(best["v"], 4)).alias("dimension_m"), F.when(known, F.bround(pct, 3)).alias("difference_pct"), F.when(known, sure).otherwise(0.0).cast("int").alias("confidence"))

    return let(nearest, match)  # said six times, and so searched for six times


def _choices(scores: Column) -> Column:
    """For each set of sides that are taken, by its bits, two bits: the number of the side with the best score."""
    each = lambda used: F.greatest(*[(scores[k] - (USED if used >> k & 1 else 0)) * len(SIDES) + (len(SIDES) - 1 - k) for k in range(len(SIDES))])
    packed = [F.shiftleft((len(SIDES) - 1 - F.pmod(each(used), F.lit(len(SIDES)))).cast("long"), 2 * used) for used in range(1 << len(SIDES))]
    return sum(packed[1:], packed[0])


def _chosen(used: Column) -> Column:
    """The number of the side that a page takes where the sides of the bits of used are taken."""
    return F.when(F.col("explicit"), F.col("named")).otherwise(F.call_function("shiftrightunsigned", F.col("choices"), (2 * used).cast("int")).bitwiseAND(F.lit(3)).cast("int"))


def register_sides(pages: DataFrame, facades: DataFrame) -> DataFrame:
    """pages: workspace_id, page_id, page_no, orientation, candidates. facades: workspace_id, side, projected_width_m.

    A row per page: page_id, page_no, orientation, orientation_explicit, plan_width_m, elevation_dimension_m, difference_pct, status, confidence.
    """
    ws = F.struct("workspace_id").alias("ws")
    widths = facades.groupBy(ws).agg(F.array(*[F.coalesce(F.max(F.when(F.col("side") == s, F.col("projected_width_m"))), F.lit(0.0)) for s in SIDES]).alias("widths"))
    rows = pages.withColumn("ws", ws).join(widths, "ws", "left").withColumn("widths", F.coalesce("widths", F.array(*[F.lit(0.0)] * len(SIDES))))
    rows = rows.withColumn("matches", F.transform("widths", lambda w: width_match(w, F.col("candidates"))))
    named = F.array_position(F.array(*map(F.lit, SIDES)), F.col("orientation")) - 1
    explicit = F.coalesce(named >= 0, F.lit(False))
    # Scores first, in a step of their own: what the sixteen sets of sides make of them reads them sixty-four times.
    choices = let(F.transform("matches", lambda m: m["confidence"]), _choices)
    rows = rows.withColumns({"choices": choices, "named": F.when(explicit, named).cast("int"), "explicit": explicit})
    rows = written(rows.withColumn("at", F.struct("page_no", "page_id")), "registered-pages")

    state = "struct<at: struct<page_no: {}, page_id: {}>, used: int>".format(*[rows.schema[c].dataType.simpleString() for c in ("page_no", "page_id")])
    states = rows.select("ws").distinct().withColumn("steps", F.array().cast(f"array<{state}>"))
    used_now = lambda: F.coalesce(F.try_element_at("steps", F.lit(-1))["used"], F.lit(0))
    for _ in SIDES:
        met = rows.select("ws", "at", "choices", "named", "explicit").join(states, "ws").withColumn("used", used_now())
        met = met.withColumn("bit", F.pow(F.lit(2), _chosen(F.col("used"))).cast("int"))
        last = F.try_element_at("steps", F.lit(-1))["at"]
        fresh = met.filter((F.col("bit").bitwiseAND(F.col("used")) == 0) & (last.isNull() | (F.col("at") > last)))
        step = fresh.groupBy("ws").agg(F.min(F.struct(F.col("at"), F.col("used").bitwiseOR(F.col("bit")).alias("used"))).alias("step"))
        states = written(states.join(step, "ws", "left").withColumn("steps", F.when(F.col("step").isNotNull(), F.array_append("steps", F.col("step").cast(state))).otherwise(F.col("steps"))).drop("step"), "sides")
    before = F.filter("steps", lambda s: s["at"] < F.col("at"))
    met = rows.join(states, "ws").withColumn("used", F.coalesce(F.try_element_at(before, F.lit(-1))["used"], F.lit(0)))
    got = met.withColumn("k", _chosen(F.col("used"))).withColumn("match", F.element_at("matches", F.col("k") + 1))
    pct = F.col("match.difference_pct")
    close = F.coalesce(pct <= CLOSE_PCT, F.lit(False))
    status = F.when(F.col("explicit") & close, VERIFIED).when(F.col("explicit"), ORIENTED).when(close, PROBABLE).otherwise(OPEN)
    sure = F.when(F.col("explicit") & close, "Verified").when(F.col("explicit") & F.coalesce(pct <= NEAR_PCT, F.lit(True)), "High").otherwise("Review")
    return got.select(
        "workspace_id", "page_id", "page_no", F.element_at(F.array(*map(F.lit, SIDES)), F.col("k") + 1).alias("orientation"), F.col("explicit").alias("orientation_explicit"), F.element_at("widths", F.col("k") + 1).alias("plan_width_m"),
        F.col("match.dimension_m").alias("elevation_dimension_m"), pct.alias("difference_pct"), status.alias("status"), sure.alias("confidence"))
