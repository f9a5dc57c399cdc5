"""The way of a page's surfaces from shapes to measured targets, with a ledger that says how far each page came and why it stopped. (F117)

All pages go through each stage together; what stops a page is a column, never an exception or an absent row.

Defined results: a page that isn't in a table has no rows of it there; of several failures of a page the first stage's
is the reason, and the notes on its evidence name each; a page listed twice is an error of the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import shuffled, written
from . import provenance, surfaces

STAGES = ("document", "page", "words", "fills", "hatches", "targets", "done")


def processed(pages: DataFrame, fills: DataFrame, hatches: DataFrame, words: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The evidence and the ledger.

    pages: workspace_id, page_id, has_document, readable, words_error, hatch_error, targets_error (null: none), m_per_pt,
    scale_confidence. fills, hatches: page_id, shape_id, points. words: page_id, word_id, text, x, y. targets: page_id,
    id, points.

    Evidence: that of provenance.surface_evidence with kind, finish_code (the first code that lies on it), target_id,
    method, status (ok, or needs_check where something it depends on failed) and notes. Ledger: workspace_id, page_id,
    status (error, no_fills, partial, ok), stage (the last that was reached), reason, fills, hatches, codes, associated,
    unassociated.
    """
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    pages = written(pages.withColumn("open", ok("has_document") & ok("readable")), "pages")
    going = pages.filter("open")
    kinds = fills.select("page_id", "shape_id", "points", F.lit("fill").alias("kind")).unionAll(hatches.join(shuffled(going.filter("hatch_error is null").select("page_id")), "page_id", "left_semi").select("page_id", "shape_id", "points", F.lit("hatch")))
    shapes = kinds.join(shuffled(going.select("page_id", "workspace_id", "m_per_pt", "scale_confidence", "words_error", "hatch_error", "targets_error")), "page_id").withColumn("shape_id", F.concat_ws(":", "kind", "shape_id"))
    shapes = written(shapes, "shapes")
    made = provenance.surface_evidence(shapes)

    good_words = words.join(shuffled(going.filter("words_error is null").select("page_id")), "page_id", "left_semi")
    codes = good_words.withColumn("code", F.get(text.finish_codes(F.col("text")), F.lit(0))).filter("code is not null")
    spots = codes.select("page_id", F.col("word_id").alias("id"), "x", "y", "code")
    on = surfaces.code_targets(spots.drop("code"), shapes.select("page_id", F.col("shape_id").alias("id"), "points")).join(shuffled(spots.select("page_id", "id", "code")), ["page_id", "id"])
    finish = on.groupBy("page_id", F.col("target_id").alias("shape_id")).agg(F.min_by("code", "id").alias("finish_code"))
    measured = targets.join(shuffled(going.filter("targets_error is null").select("page_id")), "page_id", "left_semi")
    found = surfaces.associate(shapes.select("page_id", F.col("shape_id").alias("id"), "points"), measured).select("page_id", F.col("id").alias("shape_id"), "target_id", "method")

    said = lambda what, c: F.when(c.isNotNull(), F.concat(F.lit(what), c))
    extra = shapes.select("page_id", "shape_id", "kind", "words_error", "targets_error")
    all_ = made.join(shuffled(extra), ["page_id", "shape_id"]).join(shuffled(finish), ["page_id", "shape_id"], "left").join(shuffled(found), ["page_id", "shape_id"], "left")
    unfiltered, loose = (F.col("kind") == "hatch") & F.col("words_error").isNotNull(), F.col("target_id").isNull() & F.col("targets_error").isNotNull()
    notes = F.array_compact(F.array(
        F.when(unfiltered, said("Hatch text-based false-positive filters unavailable: ", F.col("words_error"))),
        F.when(loose, said("Measured-surface association unavailable: ", F.col("targets_error"))),
        F.when(F.col("finish_code").isNull(), said("Finish code extraction unavailable: ", F.col("words_error"))),
    ))
    evidence = all_.withColumns({"method": F.coalesce("method", F.lit("none")), "status": F.when(unfiltered | loose, "needs_check").otherwise("ok"), "notes": notes}).drop("words_error", "targets_error")
    evidence = written(evidence, "surface-evidence")

    counts = evidence.groupBy("page_id").agg(F.count_if(F.col("kind") == "fill").alias("fills"), F.count_if(F.col("kind") == "hatch").alias("hatches"), F.count_if(F.col("target_id").isNotNull()).alias("associated"), F.count_if(F.col("target_id").isNull()).alias("unassociated"))
    told = codes.groupBy("page_id").agg(F.count("*").alias("codes"))
    names = ("fills", "hatches", "codes", "associated", "unassociated")
    rows = pages.join(shuffled(counts), "page_id", "left").join(shuffled(told), "page_id", "left").fillna(0, list(names))
    nothing = F.col("fills") + F.col("hatches") == 0
    failed = F.coalesce("words_error", "hatch_error", "targets_error")
    status = F.when(~F.col("open"), "error").when(nothing & F.col("hatch_error").isNotNull(), "partial").when(nothing, "no_fills").when(failed.isNotNull(), "partial").otherwise("ok")
    stage = F.when(~ok("has_document"), STAGES[0]).when(~ok("readable"), STAGES[1]).when(nothing & F.col("hatch_error").isNotNull(), STAGES[4]).when(nothing, STAGES[3]).otherwise(STAGES[6])
    reason = F.when(~ok("has_document"), "no document").when(~ok("readable"), "page can't be read").when(nothing & F.col("hatch_error").isNull(), "nothing is filled or hatched").otherwise(failed)
    return evidence, rows.select("workspace_id", "page_id", status.alias("status"), stage.alias("stage"), reason.alias("reason"), *names)
