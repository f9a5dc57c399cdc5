"""Evidence from schedules, elevations, sections and plans: what it says of openings, heights and scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..scratch import shuffled
from . import fusion

#: What the columns of an opening schedule are called.
MARKS = ("mark", "door", "window", "tag", "ref", "label", "item", "id", "no", "d#", "w#", "type")
SIZES = ("size", "dims", "dim", "dimensions", "w×h", "w*x", "w x h", "w/h", "wxh")
WIDTHS, HEIGHTS, COUNTS = ("width", "wide", "wdth"), ("height", "ht", "hgt", "high"), ("qty", "quantity", "count", "nos", "no.", "number")
WIDTH_TOLERANCE, LEAST_SCORE = 0.15, 0.30


def _role(cell: Column) -> Column:
    x = F.lower(F.trim(cell))
    holds = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: x.contains(w))
    return F.when(x == "", None).when(x.isin(*MARKS), "mark").when(holds(SIZES), "dims").when(holds(WIDTHS), "width").when(holds(HEIGHTS), "height").when(x.isin(*COUNTS), "count")


def schedule_entries(rows: DataFrame) -> DataFrame:
    """Openings of schedules: page_id, mark, width_mm, height_mm, count, dimension_basis.

    rows: page_id, line, cells. A page's first line with a mark or size heading is its heading line. Width and height
    have a basis only if both headings state the same; a size column brings its own.
    """
    rows = rows.withColumn("roles", F.transform("cells", _role))
    heads = rows.filter(F.array_contains("roles", "mark") | F.array_contains("roles", "dims")).groupBy("page_id").agg(F.min(F.struct("line", "roles", F.col("cells").alias("names"))).alias("h"))
    body = rows.drop("roles").join(shuffled(heads), "page_id").filter("line > h.line")
    at = lambda role: F.array_position("h.roles", role).cast("int")
    cell = lambda role: F.when(at(role) > 0, F.get("cells", at(role) - 1))
    basis = lambda role: F.when(at(role) > 0, text.heading_basis(F.get("h.names", at(role) - 1)))
    pair = F.when(at("dims") > 0, text.dimension_pair_mm(cell("dims")))
    one = lambda role: F.coalesce(pair[role], text.single_dimension_mm(cell(role)))
    mark = F.coalesce(text.opening_mark(cell("mark")), text.opening_mark(F.array_join("cells", " ")))
    stated = F.coalesce(basis("dims"), F.when(basis("width") == basis("height"), basis("width")), F.lit("unknown"))
    count = F.greatest(F.lit(1), F.coalesce(text.first(cell("count"), r"(\d+)").cast("int"), F.lit(1)))
    return body.select("page_id", "line", mark.alias("mark"), one("width").alias("width_mm"), one("height").alias("height_mm"), count.alias("count"), stated.alias("dimension_basis")).filter("mark is not null")


def enrich(instances: DataFrame, entries: DataFrame) -> DataFrame:
    """Instances with their mark's scheduled dimensions; a mark scheduled in two ways gives none."""
    by_mark = entries.filter("width_mm is not null and height_mm is not null").groupBy(F.col("mark").alias("type_mark")).agg(F.count_distinct("width_mm", "height_mm", "dimension_basis").alias("ways"), F.min("width_mm").alias("width_mm"), F.min("height_mm").alias("height_mm"), F.min("dimension_basis").alias("scheduled_basis"))
    only = lambda c: F.when(F.col("ways") == 1, c)
    out = instances.join(by_mark, "type_mark", "left")
    out = out.withColumns({"scheduled_width_m": only(F.col("width_mm") / 1000), "scheduled_height_m": only(F.col("height_mm") / 1000), "schedule_ambiguous": F.coalesce(F.col("ways") > 1, F.lit(False))})
    return out.withColumn("scheduled_basis", only(F.col("scheduled_basis"))).drop("ways", "width_mm", "height_mm")


def correlation(pairs: DataFrame) -> DataFrame:
    """score and reason of (plan, elevation) pairs: p_ and e_ columns mark, side, level, width_m, opening_type.

    Marks, kinds, sides or levels that contradict, and widths further apart than the tolerance, rule a pair out; what
    is left needs a width and an identity, an equal mark or an equal side.
    """
    up = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    both = lambda c: (up(f"p_{c}") != "") & (up(f"e_{c}") != "")
    differ = lambda c: both(c) & (up(f"p_{c}") != up(f"e_{c}"))
    same = lambda c: both(c) & (up(f"p_{c}") == up(f"e_{c}"))
    kind = text.opening_kind(F.col("e_mark"))
    gap = F.abs(F.col("p_width_m") - F.col("e_width_m"))
    width = F.when(gap <= WIDTH_TOLERANCE, 0.30 * (1 - gap / WIDTH_TOLERANCE)).otherwise(0.0)
    by_mark, by_side = same("mark"), same("side") & (width > 0) & ~same("mark")
    reason = F.when(differ("mark"), "mark_conflict").when(kind.isNotNull() & F.col("p_opening_type").isin("door", "window") & (kind != F.col("p_opening_type")), "opening_type_conflict").when(differ("side"), "wrong_side").when(differ("level"), "wrong_level")
    reason = reason.when(F.coalesce(gap > WIDTH_TOLERANCE, F.lit(False)), "width_mismatch").when(F.coalesce(width, F.lit(0.0)) <= 0, "no_width_signal").when(~by_mark & ~by_side, "no_identity_signal")
    score = F.least(F.lit(1.0), F.when(same("side"), 0.15).otherwise(0.0) + width + F.when(by_mark, 0.40).when(by_side, 0.15).otherwise(0.0))
    return pairs.withColumn("reason", reason).withColumn("score", F.when(F.col("reason").isNull(), score).otherwise(0.0))


def correlate(plan: DataFrame, elevation: DataFrame) -> DataFrame:
    """Plan openings and elevation openings that are each other's only best match.

    Candidates share a bucket of the width tolerance, as a pair without near widths can't score.
    """
    fields = ("id", "mark", "side", "level", "width_m", "opening_type")
    bucket = F.floor(F.col("width_m") / WIDTH_TOLERANCE)
    side = lambda d, p, b: d.filter("width_m is not null").select("workspace_id", b.alias("bucket"), *[F.col(c).alias(f"{p}_{c}") for c in fields])
    pairs = side(plan, "p", bucket).join(side(elevation, "e", F.explode(F.array(bucket - 1, bucket, bucket + 1))), ["workspace_id", "bucket"])
    good = correlation(pairs).filter(F.col("score") >= LEAST_SCORE)
    return fusion.mutual_unique_best(good.select("workspace_id", F.col("p_id").alias("plan_id"), F.col("e_id").alias("elevation_id"), F.bround("score", 4).alias("score")), "plan_id", "elevation_id", "score")


def _seg(p: str = "") -> Column:
    return F.struct(*[F.col(f"{p}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


def jambs(segments: DataFrame, walls: DataFrame, pt_per_m: float, longest_m: float, near_m: float = 0.6) -> DataFrame:
    """Segments square to a wall and near it, with their place along it. walls: page_id, wall_ref, x1, y1, x2, y2."""
    wall = walls.select("page_id", "wall_ref", *[F.col(c).alias(f"w_{c}") for c in ("x1", "y1", "x2", "y2")])
    n = geometry.length(_seg())
    short = segments.withColumn("length_pt", n).filter(F.col("length_pt").between(0.3 * pt_per_m, longest_m * pt_per_m))
    cell = max(50.0, 2 * near_m * pt_per_m)
    mid = lambda k: (F.col(f"{k}1") + F.col(f"{k}2")) / 2
    placed = short.withColumn("mx", mid("x")).withColumn("my", mid("y")).withColumn("cx", F.floor(F.col("mx") / cell)).withColumn("cy", F.floor(F.col("my") / cell))
    reach = near_m * pt_per_m
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / cell), F.floor((F.greatest(a, b) + reach) / cell))
    tiled = wall.withColumn("cx", F.explode(span("w_x1", "w_x2"))).withColumn("cy", F.explode(span("w_y1", "w_y2")))
    met = placed.join(shuffled(tiled), ["page_id", "cx", "cy"])
    square = F.abs(geometry.angle_delta(geometry.angle(_seg()), geometry.angle(_seg("w_"))) - 90) <= 10
    met = met.filter(square & (geometry.segment_distance(F.col("mx"), F.col("my"), _seg("w_")) <= reach))
    return met.select("page_id", "wall_ref", "seg_id", "length_pt", "mx", "my", geometry.along(F.col("mx"), F.col("my"), _seg("w_")).alias("along_pt"))


def doors(segments: DataFrame, walls: DataFrame, pt_per_m: float) -> DataFrame:
    """Door leaves: single segments square to a wall, none parallel within two metres of them."""
    leaves = jambs(segments, walls, pt_per_m, 1.5)
    w = W.partitionBy("page_id", "wall_ref").orderBy("along_pt", "seg_id")
    gap = F.least(F.coalesce(F.col("along_pt") - F.lag("along_pt").over(w), F.lit(1e9)), F.coalesce(F.lead("along_pt").over(w) - F.col("along_pt"), F.lit(1e9)))
    alone = leaves.withColumn("gap", gap).filter(F.col("gap") > 2.0 * pt_per_m)
    width = F.col("length_pt") / pt_per_m
    return alone.select("page_id", "wall_ref", "seg_id", width.alias("width_m"), (F.col("along_pt") / pt_per_m).alias("position_along_wall_m"), F.when(width.between(0.6, 1.2), 0.60).otherwise(0.45).alias("geometry_confidence"))


def windows(segments: DataFrame, walls: DataFrame, pt_per_m: float) -> DataFrame:
    """Window jambs: pairs of neighbouring segments along a wall, no more than 1.2 m apart, each used once.

    Along the wall jambs pair greedily from its start: in a run of jambs that each lie near the next, the odd ones
    begin a pair.
    """
    j = jambs(segments, walls, pt_per_m, 3.0)
    w = W.partitionBy("page_id", "wall_ref").orderBy("along_pt", "seg_id")
    new = F.when(F.coalesce(F.col("along_pt") - F.lag("along_pt").over(w) <= 1.2 * pt_per_m, F.lit(False)), 0).otherwise(1)
    runs = j.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy("page_id", "wall_ref", "run").orderBy("along_pt", "seg_id")
    pairs = runs.withColumn("nth", F.row_number().over(inside)).withColumn("next_pt", F.lead("along_pt").over(inside)).withColumn("next_seg", F.lead("seg_id").over(inside)).filter("nth % 2 = 1 and next_pt is not null")
    width = (F.col("next_pt") - F.col("along_pt")) / pt_per_m
    return pairs.select("page_id", "wall_ref", F.col("seg_id").alias("a_seg_id"), F.col("next_seg").alias("b_seg_id"), width.alias("width_m"), ((F.col("along_pt") + F.col("next_pt")) / 2 / pt_per_m).alias("position_along_wall_m"), F.when(width.between(0.3, 3.0), 0.70).otherwise(0.60).alias("geometry_confidence"))


def wall_gaps(walls: DataFrame, pt_per_m: float, least_m: float = 0.3, most_m: float = 6.0, offset_pt: float = 15.0) -> DataFrame:
    """Gaps between collinear walls of a page that no third wall fills. Walls run along an axis: page_id, wall_ref, axis, fixed, lo, hi."""
    lane = F.floor(F.col("fixed") / offset_pt)
    a = walls.select("page_id", "axis", lane.alias("lane"), F.col("wall_ref").alias("a"), F.col("fixed").alias("a_fixed"), F.col("hi").alias("a_hi"))
    b = walls.select("page_id", "axis", F.explode(F.array(lane - 1, lane, lane + 1)).alias("lane"), F.col("wall_ref").alias("b"), F.col("fixed").alias("b_fixed"), F.col("lo").alias("b_lo"))
    met = a.join(shuffled(b), ["page_id", "axis", "lane"]).filter((F.col("a") != F.col("b")) & (F.abs(F.col("a_fixed") - F.col("b_fixed")) <= offset_pt))
    gaps = met.withColumn("gap_pt", F.col("b_lo") - F.col("a_hi")).filter(F.col("gap_pt").between(least_m * pt_per_m, most_m * pt_per_m))
    third = walls.select("page_id", "axis", F.explode(F.array(lane - 1, lane, lane + 1)).alias("lane"), F.col("wall_ref").alias("c"), F.col("fixed").alias("c_fixed"), F.col("lo").alias("c_lo"), F.col("hi").alias("c_hi"))
    fills = ["page_id", "axis", "lane"]
    filled = gaps.join(shuffled(third), fills).filter((F.col("c") != F.col("a")) & (F.col("c") != F.col("b")) & (F.abs(F.col("c_fixed") - F.col("a_fixed")) <= offset_pt) & (F.col("c_lo") < F.col("b_lo")) & (F.col("c_hi") > F.col("a_hi")))
    return gaps.join(shuffled(filled.select("page_id", "a", "b").distinct()), ["page_id", "a", "b"], "left_anti").select("page_id", "a", "b", (F.col("gap_pt") / pt_per_m).alias("width_m"))


#: Words that say what a reduced level is of.
LEVEL_WORDS = r"(ffl|fcl|ceiling|floor|soffit|parapet|level)"


def reduced_levels(pages: DataFrame) -> DataFrame:
    """RL values of page texts with the word that stands nearest before or after: page_id, n, rl, kind."""
    hits = F.regexp_extract_all(F.lower("extracted_text"), F.lit(rf"{LEVEL_WORDS}?[^\n]{{0,30}}?\brl\s*[:+]?\s*(\d{{1,4}}\.\d{{1,3}})[^\n]{{0,12}}?{LEVEL_WORDS}?"), F.lit(0))
    rows = pages.select(F.col("id").alias("page_id"), F.posexplode(hits).alias("n", "hit"))
    return rows.select("page_id", "n", text.first(F.col("hit"), r"rl\s*[:+]?\s*(\d{1,4}\.\d{1,3})").cast("double").alias("rl"), text.first(F.col("hit"), LEVEL_WORDS).alias("kind")).filter("kind is not null")


def height_pairs(levels: DataFrame, least: float = 1.8, most: float = 12.0, anchor: float = 3.0, top: int = 3) -> DataFrame:
    """Differences of a page's reduced levels that can be heights, the three nearest to 3 m."""
    distinct = levels.groupBy("page_id", "rl").agg(F.min("kind").alias("kind"))
    bucket = F.floor(F.col("rl") / most)
    side = lambda p, b: distinct.select("page_id", b.alias("bucket"), F.col("rl").alias(f"{p}_rl"), F.col("kind").alias(f"{p}_kind"))
    pairs = side("a", bucket).join(side("b", F.explode(F.array(bucket - 1, bucket))), ["page_id", "bucket"])
    pairs = pairs.withColumn("height_m", F.round(F.col("b_rl") - F.col("a_rl"), 4)).filter(F.col("height_m").between(least, most))
    kinds = F.array_sort(F.array("a_kind", "b_kind"))
    kind = F.when((kinds[0] == "fcl") & (kinds[1] == "ffl"), "floor_to_ceiling").when((F.col("a_kind") == "ffl") & (F.col("b_kind") == "ffl"), "floor_to_floor").otherwise("generic")
    w = W.partitionBy("page_id").orderBy(F.abs(F.col("height_m") - anchor), "a_rl", "b_rl")
    return pairs.withColumn("height_type", kind).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= top).select("page_id", "a_rl", "b_rl", "height_m", "height_type")


def best_height(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """The evidence of the best priority, then confidence, then id."""
    return fusion.choose(evidence, keys, [F.col("priority"), -F.col("confidence"), F.col("id")])


def scale_bars(ticks: DataFrame, metres_per_division: float, deviation: float = 0.05, least_divisions: int = 2, least_span_m: float = 1.0) -> DataFrame:
    """Points a metre from the ticks of a scale bar; null unless they are evenly spaced. ticks: page_id, position."""
    w = W.partitionBy("page_id").orderBy("position")
    steps = ticks.select("page_id", "position").distinct().withColumn("step", F.col("position") - F.lag("position").over(w)).filter("step is not null")
    got = steps.groupBy("page_id").agg(F.count("*").alias("divisions"), F.avg("step").alias("mean"), F.min("step").alias("low"), F.max("step").alias("high"))
    off = F.greatest(F.col("high") - F.col("mean"), F.col("mean") - F.col("low")) / F.col("mean")
    even = (F.col("divisions") >= least_divisions) & (off <= deviation) & (F.col("divisions") * metres_per_division >= least_span_m)
    return got.select("page_id", "divisions", off.alias("deviation"), F.when(even, F.col("mean") / metres_per_division).alias("pt_per_m"))


def dimension_scales(words: DataFrame, segments: DataFrame, radius: float = 60.0, top: int = 4) -> DataFrame:
    """Points a metre that dimension texts and the segments near them suggest, four to a text.

    words: page_id, word_id, text, x, y. Feed the result to fusion.consensus.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    dims = words.withColumn("metres", text.dimension_m(F.col("text"))).filter("metres is not null").select("page_id", "word_id", "x", "y", "metres", F.explode(F.sequence(cell("x") - 1, cell("x") + 1)).alias("cx")).withColumn("cy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
    span = lambda a, b: F.sequence(F.floor(F.least(a, b) / radius), F.floor(F.greatest(a, b) / radius))
    tiled = segments.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))
    near = dims.join(shuffled(tiled), ["page_id", "cx", "cy"]).withColumn("distance", geometry.segment_distance(F.col("x"), F.col("y"), _seg())).filter(F.col("distance") <= radius).dropDuplicates(["page_id", "word_id", "seg_id"])
    w = W.partitionBy("page_id", "word_id").orderBy("distance", "seg_id")
    return near.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= top).select("page_id", "word_id", "seg_id", (geometry.length(_seg()) / F.col("metres")).alias("pt_per_m"))
