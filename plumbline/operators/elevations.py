"""Openings on elevation drawings, from rectangles, words and a calibration. (F136)"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..scratch import shuffled

#: How far a mark may be from its opening in metres, sizes that are beyond doubt, confidences.
LABEL_RADIUS_M, CELL_M = 0.5, 2.0
SURE_WIDTH, SURE_HEIGHT = (0.6, 4.0), (0.6, 3.5)
CONFIDENCE, SURE_CONFIDENCE, LABELLED, MOST = 0.5, 0.65, 0.1, 0.85
#: Shares of a page's rows.
SHARES = 16
MARK = r"(?i)\b((?:ED|ID|EW|IW|D|W)\d{1,3})\b"


def elevation_openings(rects: DataFrame, words: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Opening-sized rectangles in metres with the mark nearest to their edge: page_id, rect_id, width_m, height_m, label, confidence.

    rects: page_id, rect_id, x0, y0, x1, y1, coord_space (null: the page's). words: page_id, word_id, text, x, y (their
    centres). calibrations: page_id, coord_space, units_per_m. Only a rectangle in the calibration's own coordinates has
    metres; others, and those of pages without a positive calibration, give none. A mark counts within half a metre and
    a unit of the rectangle, the nearest first, then the first word. Words and rectangles meet in cells of two metres,
    of which a rectangle of an opening's size touches a bounded number. Of marks at one place only the first word can
    be the nearest. A page's calibration is dealt over SHARES shares of its rows, so a large page is more than one task's.
    """
    share = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES)).alias("share")
    each = calibrations.select("page_id", F.col("coord_space").alias("space"), "units_per_m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share")).filter("units_per_m > 0")
    scaled = rects.withColumn("share", share("rect_id")).join(shuffled(each), ["page_id", "share"]).drop("share")
    same = F.coalesce(F.col("coord_space"), F.col("space")) == F.col("space")
    w, h = F.abs(F.col("x1") - F.col("x0")) / F.col("units_per_m"), F.abs(F.col("y1") - F.col("y0")) / F.col("units_per_m")
    found = scaled.filter(same).withColumns({"width_m": w, "height_m": h}).filter(geometry.opening_sized(F.col("width_m"), F.col("height_m")))
    found = found.withColumns({"left": F.least("x0", "x1"), "right": F.greatest("x0", "x1"), "top": F.least("y0", "y1"), "bottom": F.greatest("y0", "y1"), "reach": LABEL_RADIUS_M * F.col("units_per_m") + 1})
    cell = CELL_M * F.col("units_per_m")
    span = lambda a, b: F.sequence(F.floor((F.col(a) - F.col("reach")) / cell), F.floor((F.col(b) + F.col("reach")) / cell))
    near = found.withColumn("cx", F.explode(span("left", "right"))).withColumn("cy", F.explode(span("top", "bottom")))
    marks = words.withColumn("mark", F.upper(text.first(F.col("text"), MARK))).filter("mark is not null and x is not null and y is not null")
    marks = marks.groupBy("page_id", "x", "y").agg(F.min(F.struct("word_id", "mark")).alias("w")).select("page_id", "x", "y", "w.*")
    marks = marks.withColumn("share", share("word_id")).join(shuffled(each.drop("space")), ["page_id", "share"])
    marks = marks.select("page_id", "word_id", "mark", "x", "y", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy"))
    d = F.hypot(F.greatest(F.col("left") - F.col("x"), F.lit(0.0), F.col("x") - F.col("right")), F.greatest(F.col("top") - F.col("y"), F.lit(0.0), F.col("y") - F.col("bottom")))
    met = near.join(shuffled(marks), ["page_id", "cx", "cy"]).withColumn("d", d).filter(F.col("d") < F.col("reach"))
    best = met.groupBy("page_id", "rect_id").agg(F.min(F.struct("d", "word_id", "mark")).alias("b")).select("page_id", "rect_id", F.col("b.mark").alias("label"))
    sure = F.col("width_m").between(*SURE_WIDTH) & F.col("height_m").between(*SURE_HEIGHT)
    confidence = F.least(F.lit(MOST), F.when(sure, SURE_CONFIDENCE).otherwise(CONFIDENCE) + F.when(F.col("label").isNotNull(), LABELLED).otherwise(0.0))
    out = found.join(shuffled(best), ["page_id", "rect_id"], "left")
    return out.select("page_id", "rect_id", F.bround("width_m", 4).alias("width_m"), F.bround("height_m", 4).alias("height_m"), F.coalesce("label", F.lit("")).alias("label"), F.round(confidence, 2).alias("confidence"))
