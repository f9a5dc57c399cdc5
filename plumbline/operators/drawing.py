"""What a drawing page shows: wall and grid lines, dimensions, room labels, hatches, rooms closed by its linework."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..scratch import shuffled
from . import pages, surfaces

#: Bounds of wall and grid lines.
WALL_LENGTH, WALL_WIDTHS, DARK, GRID_LENGTH, LIGHT = 50.0, (0.3, 5.0), 0.4, 100.0, 0.5
#: Words that name rooms.
ROOM_KEYWORDS = (
    "bedroom", "bed", "living", "dining", "kitchen", "bathroom", "bath", "ensuite", "laundry", "garage", "carport", "patio", "deck", "veranda", "hallway", "hall", "entry", "foyer", "study", "office", "rumpus",
    "theatre", "media", "powder", "toilet", "wc", "store", "storage", "utility", "mud", "butlers", "butler", "pantry", "walk-in", "robe", "closet", "void", "voids", "mech", "mechanical", "electrical", "switchboard", "meter", "hp", "hot water", "air con", "ac",
)
ENCLOSED_PT2 = 10_000.0
#: Bounds of hatches.
HATCH = {"strokes": 5, "page_share": 0.60, "spread": 35.0, "parallel": 0.50, "spacing": (1.5, 120.0), "sparse": 40.0, "near": 100.0}


def _channels(c: Column) -> list[Column]:
    """Red, green and blue from 0 to 1 of #rrggbb; black where there is no colour."""
    digits = F.coalesce(text.first(F.lower(c), "^#?([0-9a-f]{6})$"), F.lit("000000"))
    return [F.conv(F.substring(digits, k, 2), 16, 10).cast("double") / 255 for k in (1, 3, 5)]


def wall_lines(strokes: DataFrame) -> DataFrame:
    """Dark strokes of a wall's length and width. strokes: as readers.strokes gives them."""
    dark = [c <= DARK for c in _channels(F.col("colour"))]
    return strokes.filter((F.col("length_pt") >= WALL_LENGTH) & dark[0] & dark[1] & dark[2] & F.col("width").between(*WALL_WIDTHS))


def grid_lines(strokes: DataFrame) -> DataFrame:
    """Long dashed light strokes along an axis: page_id, seg_id, axis, at, lo, hi, grid_detected. (F145)

    A page has a grid if it has more than two such lines each way.
    """
    light = [c >= LIGHT for c in _channels(F.col("colour"))]
    angle = geometry.angle(F.struct("x1", "y1", "x2", "y2"))
    axis = F.when((angle < 5) | (angle > 175), "h").when((angle > 85) & (angle < 95), "v")
    rows = strokes.filter((F.col("length_pt") >= GRID_LENGTH) & F.col("dash").isNotNull() & (light[0] | light[1] | light[2])).withColumn("axis", axis).filter("axis is not null")
    flat = F.col("axis") == "h"
    pick = lambda a, b: F.when(flat, a).otherwise(b)
    rows = rows.select("page_id", "seg_id", "axis", pick((F.col("y1") + F.col("y2")) / 2, (F.col("x1") + F.col("x2")) / 2).alias("at"), pick(F.least("x1", "x2"), F.least("y1", "y2")).alias("lo"), pick(F.greatest("x1", "x2"), F.greatest("y1", "y2")).alias("hi"))
    counts = rows.groupBy("page_id").agg(F.count_if(F.col("axis") == "h").alias("h"), F.count_if(F.col("axis") == "v").alias("v"))
    return rows.join(counts.select("page_id", ((F.col("h") > 2) & (F.col("v") > 2)).alias("grid_detected")), "page_id")


def dimensions(words: DataFrame) -> DataFrame:
    """Dimensions that words state: page_id, word_id, value, unit (mm or scale). (F64)

    The first form that fits counts: a whole number of two to five digits as millimetres, metres, feet and inches, a
    scale. Lengths are from 10 mm to 100 m.
    """
    x = F.trim("text")
    plain = text.first(x, r"\b(\d{2,5})\b").cast("double")
    metres = text.first(x, r"(?i)\b(\d+\.?\d*)\s*m\b").cast("double") * 1000
    feet = (text.first(x, r"\b(\d+)'\s*-?\s*\d+['\"]").cast("double") * 12 + text.first(x, r"\b\d+'\s*-?\s*(\d+)['\"]").cast("double")) * 25.4
    scale = text.first(x, r"1\s*[:/]\s*(\d{2,4})").cast("double")
    sized = lambda v: F.when(v.between(10, 100_000), F.struct(v.alias("value"), F.lit("mm").alias("unit")))
    found = F.when(plain.isNotNull(), sized(plain)).when(metres.isNotNull(), sized(metres)).when(feet.isNotNull(), F.struct(feet.alias("value"), F.lit("mm").alias("unit"))).when(scale.isNotNull(), F.struct(scale.alias("value"), F.lit("scale").alias("unit")))
    rows = words.filter(F.length(x).between(2, 20)).withColumn("d", found).filter("d is not null")
    return rows.select("page_id", "word_id", "d.value", "d.unit")


def named_rooms(words: DataFrame, filled: DataFrame) -> DataFrame:
    """Words that hold a room's name, and filled rectangles of a room's size: page_id, label, type."""
    low = F.lower(F.trim("text"))
    hit = F.exists(F.array(*[F.lit(w) for w in ROOM_KEYWORDS]), lambda w: low.contains(w))
    said = words.filter(hit).select("page_id", F.trim("text").alias("label"), F.lit("text_label").alias("type"))
    closed = filled.filter(F.col("area") > ENCLOSED_PT2).select("page_id", F.lit("Enclosed Area").alias("label"), F.lit("rectangle").alias("type"))
    return said.unionAll(closed)


def room_labels(words: DataFrame, vocabulary: list[str], phrases: list[str], line: float = 8.0, gap: float = 30.0) -> DataFrame:
    """Room labels of a page, phrases of up to three words before single words: page_id, label, x, y, confidence.

    words: page_id, word_id, text, x0, y0, x1, y1. A phrase begins at a word of the vocabulary; its words stand on one
    line, no further apart than gap, and none counts twice: the walk over a line goes from left to right.
    """
    down, along = W.partitionBy("page_id").orderBy("y0", "x0", "word_id"), W.partitionBy("page_id", "line").orderBy("x0", "word_id")
    new = F.when(F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(down)) > line, F.lit(True)), 1).otherwise(0)
    rows = words.filter(F.trim("text") != "").withColumn("new", new).withColumn("line", F.sum("new").over(down.rowsBetween(W.unboundedPreceding, 0)))
    key, known = F.lower(F.regexp_replace("text", "[^A-Za-z]", "")), F.array(*[F.lit(p.lower()) for p in phrases])
    rows = rows.withColumn("key", key).withColumn("nth", F.row_number().over(along))
    near = lambda k: F.lead("x0", k).over(along) - F.lead("x1", k - 1).over(along) <= gap
    two = F.concat_ws(" ", "key", F.lead("key", 1).over(along))
    three = F.concat_ws(" ", "key", F.lead("key", 1).over(along), F.lead("key", 2).over(along))
    starts = F.col("key").isin(*[v.lower() for v in vocabulary])
    length = F.when(starts & F.array_contains(known, three) & near(1) & near(2), 3).when(starts & F.array_contains(known, two) & near(1), 2).when(starts, 1).otherwise(0)
    ends = [F.greatest(*[F.when(F.col("length") > k, F.lead(c, k).over(along)) for k in range(3)]).alias(c) for c in ("x1", "y1")]
    rows = rows.withColumn("length", length)
    label = F.concat_ws(" ", *[F.when(F.col("length") > k, F.lead("text", k).over(along) if k else F.col("text")) for k in range(3)])
    top = F.least(*[F.when(F.col("length") > k, F.lead("y0", k).over(along)) for k in range(3)]).alias("y0")
    rows = rows.select("page_id", "line", "nth", "length", label.alias("label"), "x0", top, *ends).filter("length > 0")
    # A start inside a phrase that was taken is passed over; phrases have three words at most, so a line's starts chain.
    item = F.struct("nth", "length", "label", "x0", "y0", "x1", "y1")
    lines = rows.groupBy("page_id", "line").agg(F.sort_array(F.collect_list(item)).alias("items"))
    begin = F.struct(F.lit(0).alias("upto"), F.slice("items", 1, 0).alias("out"))
    step = lambda a, x: F.when(x["nth"] > a["upto"], F.struct((x["nth"] + x["length"] - 1).cast("int").alias("upto"), F.array_append(a["out"], x).alias("out"))).otherwise(a)
    taken = lines.select("page_id", F.inline(F.aggregate("items", begin, step, lambda a: a["out"])))
    return taken.select("page_id", "label", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), F.when(F.col("length") > 1, 0.95).otherwise(0.85).alias("confidence"))


def hatch_reason(c: DataFrame) -> Column:
    """Why a group of strokes isn't a hatch, null if it is; the first reason counts. (P25)

    Columns: n, longest, diagonal, angle_spread, parallel_share, cross, spacing, extent, dimension_words, grid_words.
    """
    at = lambda name: c[name]
    out = F.when(at("n") < HATCH["strokes"], "too few strokes").when(at("longest") > HATCH["page_share"] * at("diagonal"), "stroke spans the page")
    out = out.when(~at("cross") & (at("angle_spread") > HATCH["spread"]), "angle spread").when(~at("cross") & (at("parallel_share") < HATCH["parallel"]), "not parallel")
    out = out.when((at("spacing") > 0) & (at("spacing") < HATCH["spacing"][0]), "too dense").when(at("spacing") > HATCH["spacing"][1], "too sparse")
    out = out.when(at("dimension_words") >= 3, "dimension lines").when(at("grid_words") > 0, "grid words")
    return out.when((at("spacing") > 0) & (at("extent") > 0) & (at("n") / at("extent") < 1 / HATCH["sparse"]), "line density")


def hatches(strokes: DataFrame, words: DataFrame, sizes: DataFrame, angle: float = 5.0, distance: float = 35.0) -> DataFrame:
    """Groups of parallel strokes with their metrics and why they aren't hatches: U14, A34, A35, P25. (F115)

    strokes: page_id, seg_id, x1, y1, x2, y2. words: page_id, text, x, y. sizes: page_id, width, height.
    """
    found = pages.stroke_clusters(strokes, angle, distance, 2)
    member = pages.cluster_members(strokes, angle, distance).join(found.select("page_id", "cluster", F.col("angle").alias("mean_angle")), ["page_id", "cluster"])
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    r = F.radians("mean_angle")
    delta = geometry.angle_delta(geometry.angle(F.struct("x1", "y1", "x2", "y2")), F.col("mean_angle"))
    member = member.withColumns({"offset": F.round(my * F.cos(r) - mx * F.sin(r), 9), "delta": delta, "length": F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))})
    metrics = member.groupBy("page_id", "cluster").agg(F.max("length").alias("longest"), F.max("delta").alias("angle_spread"), F.avg((F.col("delta") <= angle).cast("double")).alias("parallel_share"), (F.max("offset") - F.min("offset")).alias("extent"), F.avg(mx).alias("cx"), F.avg(my).alias("cy"))
    gaps = surfaces.spacing(member.select("page_id", "cluster", "offset"), ["page_id", "cluster"])
    rows = found.join(metrics, ["page_id", "cluster"]).join(gaps, ["page_id", "cluster"], "left").join(sizes, "page_id")
    side = F.sqrt((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    rows = rows.withColumn("reach", F.greatest(side, F.lit(HATCH["near"])))
    cell = 200.0
    tiled = rows.select("page_id", "cluster", "cx", "cy", "reach", F.explode(F.sequence(F.floor((F.col("cx") - F.col("reach")) / cell), F.floor((F.col("cx") + F.col("reach")) / cell))).alias("tx"), F.sequence(F.floor((F.col("cy") - F.col("reach")) / cell), F.floor((F.col("cy") + F.col("reach")) / cell)).alias("tys")).withColumn("ty", F.explode("tys"))
    said = words.withColumn("is_dimension", F.col("text").rlike(r"^\d{3,5}(?:\s*mm)?$|^\d+\.\d+\s*m$")).withColumn("is_grid", F.lower("text").rlike("grid|batten|louvre|acoustic")).filter("is_dimension or is_grid")
    said = said.withColumn("tx", F.floor(F.col("x") / cell)).withColumn("ty", F.floor(F.col("y") / cell))
    near = tiled.join(said, ["page_id", "tx", "ty"]).filter(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) < F.col("reach"))
    counts = near.groupBy("page_id", "cluster").agg(F.count_if("is_dimension").alias("dimension_words"), F.count_if("is_grid").alias("grid_words"))
    rows = rows.join(counts, ["page_id", "cluster"], "left").fillna(0, ["dimension_words", "grid_words", "spacing"])
    rows = rows.withColumn("diagonal", F.hypot("width", "height")).withColumn("cross", F.lit(False))
    return rows.withColumn("reason", hatch_reason(rows)).select("page_id", "cluster", "n", "angle", "longest", "angle_spread", "parallel_share", "spacing", "extent", "dimension_words", "grid_words", "reason")


def rooms_from_segments(segments: DataFrame, labels: DataFrame, sizes: DataFrame, least_area: float = 0.05) -> DataFrame:
    """Rooms that a page's linework closes: faces, their labels, and which of them are rooms. (F112: F111, J11, P23)

    segments: page_id, seg_id, x1, y1, x2, y2. labels: page_id, label_id, label, x, y. sizes: page_id, page_width,
    page_height, m_per_pt. Segments shorter than half a point both ways are left out.
    """
    drawn = segments.filter((F.abs(F.col("x2") - F.col("x1")) >= 0.5) | (F.abs(F.col("y2") - F.col("y1")) >= 0.5))
    found = pages.label_faces(pages.faces(drawn, least_area), labels)
    own = F.when(F.col("n_labels") > 0, F.col("label"))  # a made-up name is no label
    shaped = found.select("page_id", F.col("face").alias("id"), "points", own.alias("label"), "n_labels").join(shuffled(sizes), "page_id")
    return surfaces.rooms(shaped).join(shuffled(found.select("page_id", F.col("face").alias("id"), "n_labels")), ["page_id", "id"])


def studio_pages(rows: DataFrame) -> DataFrame:
    """Pages that are in, impressions before elevations before sections before others, then by id."""
    kind = F.lower(F.coalesce("page_type", F.lit("")))
    rank = F.when(kind.rlike("render|artist|impression"), 0).when(kind.contains("elevation"), 1).when(kind.contains("section"), 2).otherwise(3)
    return rows.filter("selected = 1").withColumn("priority", rank).orderBy("priority", "id")


def coloured_lines(lines: DataFrame, page_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """Drawn lines with their page's label and the colour of their take-off row, its substrate or its finish.

    lines: line_id, page_id, takeoff_row_id. page_rows: id, page_label. rows: id, substrate, finish_system, row_colour,
    substrate_colour. Lines without a row keep a default colour.
    """
    named = lines.join(page_rows.select(F.col("id").alias("page_id"), "page_label"), "page_id", "left")
    own = rows.select(F.col("id").alias("takeoff_row_id"), "substrate", text.colour(F.concat_ws(" ", "substrate", "finish_system"), F.col("row_colour"), F.col("substrate_colour")).alias("colour"))
    return named.join(own, "takeoff_row_id", "left").withColumn("colour", F.coalesce("colour", F.lit("#1F6FB2"))).select("line_id", "page_id", "page_label", "takeoff_row_id", "substrate", "colour")


def qualified(candidate: DataFrame) -> Column:
    """Whether an elevation's candidate may have metres: calibrated in its own coordinates, measured, opening-sized."""
    same = F.coalesce(candidate["dimensional"] & (candidate["coord_space"] == candidate["calibration_space"]), F.lit(False))
    return same & geometry.opening_sized(candidate["width_m"], candidate["height_m"])


def enriched_from_elevation(openings: DataFrame, elevations: DataFrame) -> DataFrame:
    """Openings with what their elevation adds: height and sill where they have none, and the ledger of it. (F137)

    openings: opening_instance_id, height_m, sill_m, elevation_id, score. elevations: elevation_id, e_height_m,
    e_sill_m. A height that differs by more than 5 cm is kept and named as a conflict.
    """
    d = openings.join(elevations, "elevation_id", "left")
    conflict = F.coalesce(F.abs(F.col("height_m") - F.col("e_height_m")) > 0.05, F.lit(False))
    outcome = F.when(F.col("elevation_id").isNull(), "no_elevation").when(conflict, "height_conflict").when(F.col("height_m").isNull() & F.col("e_height_m").isNotNull(), "height_added").otherwise("agrees")
    return d.select("opening_instance_id", F.coalesce("height_m", "e_height_m").alias("height_m"), F.coalesce("sill_m", "e_sill_m").alias("sill_m"), outcome.alias("outcome"), F.when(F.col("elevation_id").isNotNull(), F.col("score")).alias("correlation_score"))
