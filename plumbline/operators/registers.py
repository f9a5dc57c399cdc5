"""Registers: drawings and their revisions, scales of pages, materials and legends, accuracy against truth, trades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pricing, text
from . import fusion


def revisions(pages: DataFrame) -> DataFrame:
    """Each page with its sheet, revision, whether it is current and what supersedes it."""
    named = pages.withColumn("sheet", text.sheet_number(F.col("page_label"))).withColumn("rev", text.revision(F.col("page_label")))
    return fusion.superseded(named, ["workspace_id", "sheet"], [F.desc("rev.rank"), F.desc("id")], "id")


def roles(pages: DataFrame) -> DataFrame:
    """(F21, K34, P8)"""
    return pages.withColumn("sheet_role", text.sheet_role(F.col("page_label"), F.col("extracted_text"))).withColumn("storey", text.level(F.col("page_label")))


def scales(pages: DataFrame) -> DataFrame:
    """Pixels a metre of each page: its own calibration, its printed scale, else a donor's of the same printed scale and size.

    A donor is a calibrated page of the workspace with the same ratio and a size within 2.5 %; the donors' median
    counts, if they lie within 5 % of it.
    """
    ratio = F.coalesce(text.scale_ratio(F.col("scale_text")), text.scale_ratio(F.col("extracted_text")))
    p = pages.withColumn("ratio", ratio).withColumn("printed", pricing.px_per_m(F.col("ratio"), F.coalesce("render_zoom", F.lit(2.0))))
    size = F.round(F.log(F.col("width_px").cast("double")) / F.log(F.lit(1.05))).cast("int")
    donors = p.filter("px_per_m > 0 and ratio is not null").withColumn("size", size).select("workspace_id", "ratio", "size", F.col("px_per_m").alias("donor"), F.col("width_px").alias("donor_width"), F.col("id").alias("donor_id"))
    asks = p.filter("coalesce(px_per_m, 0) <= 0 and ratio is not null").withColumn("size", F.explode(F.sequence(size - 1, size + 1)))
    met = asks.join(donors, ["workspace_id", "ratio", "size"]).filter((F.abs(F.col("width_px") - F.col("donor_width")) <= 0.025 * F.col("donor_width")) & (F.col("id") != F.col("donor_id")))
    got = met.groupBy("id").agg(F.median("donor").alias("inherited"), F.min("donor").alias("low"), F.max("donor").alias("high"))
    got = got.filter((F.col("high") - F.col("low")) <= 0.05 * F.col("inherited")).select("id", "inherited")
    out = p.join(got, "id", "left")
    source = F.when(F.col("px_per_m") > 0, "calibrated").when(F.col("inherited").isNotNull(), "inherited").when(F.col("printed").isNotNull(), "printed").otherwise("unknown")
    return out.withColumn("resolved_px_per_m", F.coalesce(F.when(F.col("px_per_m") > 0, F.col("px_per_m")), "inherited", "printed")).withColumn("scale_source", source)


def scale_issues(scaled: DataFrame) -> DataFrame:
    """(D9, D10)"""
    code = F.when(F.col("scale_source") == "unknown", "NO_SCALE").when(F.col("scale_source") == "printed", "PROVISIONAL_SCALE").when((F.col("scale_source") == "calibrated") & (F.abs(F.col("px_per_m") - F.col("printed")) > 0.05 * F.col("printed")), "SCALE_CONFLICT")
    return scaled.withColumn("code", code).filter("code is not null").select("workspace_id", "id", "code", F.when(F.col("code") == "NO_SCALE", "BLOCKER").otherwise("HIGH").alias("severity"))


def materials(entries: DataFrame) -> DataFrame:
    """A row per code: its first description, substrate if only one is named, status.

    entries: code, description, substrate, page_id. Descriptions that hold one another agree.
    """
    e = entries.withColumn("code", F.upper(F.trim("code"))).filter("code <> ''").withColumn("key", text.norm_key(F.col("description")))
    got = e.groupBy("code").agg(F.min_by("description", F.struct("page_id", "key")).alias("description"), F.array_sort(F.collect_set("key")).alias("keys"), F.array_sort(F.collect_set("substrate")).alias("substrates"), F.count("*").alias("entries"))
    longest = F.array_max(F.transform("keys", lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    agree = F.forall("keys", lambda k: longest.contains(k))
    return got.withColumn("status", F.when(agree & (F.size("substrates") <= 1), "Confirmed").otherwise("Conflict")).withColumn("substrate", F.when(F.size("substrates") == 1, F.element_at("substrates", 1))).drop("keys", "substrates")


def merged_dictionary(manual: DataFrame, schedule: DataFrame, legend: DataFrame) -> DataFrame:
    """Manual codes before scheduled ones before the legend's."""
    ranked = [d.select("code", "description", "substrate").withColumn("rank", F.lit(k)).withColumn("origin", F.lit(n)) for k, (n, d) in enumerate((("manual", manual), ("schedule", schedule), ("legend", legend)))]
    every = reduce(DataFrame.unionByName, ranked)
    first = every.groupBy("code").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(c) for c in ("description", "substrate")], F.min_by("origin", "rank").alias("origin"))
    return first


def occurrences(pages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Every finish code on every page with its description, Unknown where no dictionary has it."""
    codes = pages.select("workspace_id", F.col("id").alias("page_id"), F.explode(text.finish_codes(F.col("extracted_text"))).alias("code"))
    return fusion.lookup(codes, dictionary.select("code", "description"), "code", "description")


def accuracy(truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """MAPE, accuracy and share found of each category, from the latest prediction of each item.

    truth: category, item_key, expected_numeric, expected_text. predictions: id, category, item_key,
    predicted_numeric, predicted_text.
    """
    latest = fusion.choose(predictions, ["category", "item_key"], [F.col("id")], largest=True).select("category", "item_key", "predicted_numeric", "predicted_text", F.lit(True).alias("found"))
    rows = truth.join(latest, ["category", "item_key"], "left")
    error = F.when(F.col("expected_numeric") != 0, F.abs(F.col("predicted_numeric") - F.col("expected_numeric")) / F.abs("expected_numeric"))
    right = F.when(F.col("found") & F.col("expected_text").isNotNull(), (text.norm_key(F.col("predicted_text")) == text.norm_key(F.col("expected_text"))).cast("double"))
    return rows.groupBy("category").agg(F.count("*").alias("items"), F.count("found").alias("found"), F.avg(error).alias("mape"), F.avg(right).alias("accuracy")).withColumn("found_share", F.col("found") / F.col("items"))


def detect_trades(pages: DataFrame, keywords: list[tuple[str, str, int]], least: int = 4, page_cap: int = 12) -> DataFrame:
    """Trades by keyword score: at most page_cap from a page. keywords: (trade, keyword, points)."""
    words = F.array(*[F.struct(F.lit(t).alias("trade"), F.lit(k.lower()).alias("keyword"), F.lit(p).alias("points")) for t, k, p in keywords])
    texts = pages.select("workspace_id", F.col("id").alias("page_id"), F.lower(F.coalesce("extracted_text", F.lit(""))).alias("t"))
    found = texts.select("workspace_id", "page_id", F.inline(F.filter(words, lambda w: F.col("t").contains(w["keyword"]))))
    by_page = found.groupBy("workspace_id", "trade", "page_id").agg(F.least(F.sum("points"), F.lit(page_cap)).alias("score"))
    out = by_page.groupBy("workspace_id", "trade").agg(F.sum("score").alias("score"), F.count("*").alias("pages"))
    return out.filter(F.col("score") >= least).orderBy(F.desc("score"), "trade")


def descriptions(lines: DataFrame, most: int = 3) -> DataFrame:
    """Schedule lines: a code and up to three following lines that continue it. lines: page_id, line, text."""
    order = W.partitionBy("page_id").orderBy("line")
    code = text.first(F.upper(F.trim("text")), r"^([A-Z]{1,4}-?\d{1,3}[A-Z]?)\b")
    rows = lines.withColumn("code", code).withColumn("start", F.last(F.when(F.col("code").isNotNull(), F.col("line")), ignorenulls=True).over(order))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("page_id", "start").orderBy("line"))).filter(F.col("start").isNotNull() & (F.col("nth") <= most + 1))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "text"))), lambda x: F.trim(x["text"])), " ")
    out = rows.groupBy("page_id", "start").agg(F.max("code").alias("code"), joined.alias("whole"))
    return out.select("page_id", F.col("start").alias("line"), "code", F.trim(F.substr("whole", F.length("code") + 1)).alias("description"))
