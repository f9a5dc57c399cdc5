"""Gates before publishing: review signals, preflight, overrides, sign-off, publication exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.kept import kept
from . import fusion, takeoff

SEVERITIES = ("BLOCKER", "HIGH", "WARNING", "INFO")
#: Fields that an override may change, and their types.
OVERRIDABLE = {"quantity": "double", "rate_per_unit": "double", "coats": "double", "unit": "string", "inclusion_status": "string", "location": "string", "substrate": "string", "finish_system": "string"}


def severity_rank(c: Column) -> Column:
    """Unknown severities count as blockers."""
    out = None
    for k, s in enumerate(SEVERITIES):
        hit = F.upper(F.trim(c)) == s
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out.otherwise(0)


@kept
def _broken() -> Column:
    """array of struct(severity, code): a rule that a take-off row breaks, null for each that it keeps."""
    q, rate = F.coalesce("quantity", F.lit(0.0)), F.coalesce("rate_per_unit", F.lit(0.0))
    work = ~takeoff.is_floor_reference() & ~takeoff.is_excluded()
    unit = text.unit(F.col("unit"))
    rules = (
        (F.col("quantity").isNull() | F.isnan("quantity") | (q < 0), "BLOCKER", "QUANTITY_INVALID"),
        (work & (q == 0), "HIGH", "QUANTITY_ZERO"),
        (work & (rate <= 0), "HIGH", "RATE_MISSING"),
        (F.coalesce(F.trim("unit"), F.lit("")) == "", "BLOCKER", "UNIT_MISSING"),
        (work & (text.level(F.col("location")) == "Unassigned"), "WARNING", "LEVEL_UNKNOWN"),
        (work & (unit == "m²") & (F.coalesce("coverage_m2_per_litre", F.lit(12.0)) <= 0), "WARNING", "COVERAGE_INVALID"),
        (takeoff.authority().isin("NOT_MODEL_SURFACE", "APPROVED") == F.lit(False), "BLOCKER", "MODEL_SURFACE_UNAPPROVED"),
        (F.lower(F.coalesce("quantity_status", F.lit(""))).contains("provisional"), "WARNING", "PROVISIONAL"),
    )
    return F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(code).alias("code"))) for c, s, code in rules])


def row_signals(rows: DataFrame) -> DataFrame:
    """One row for each rule that a take-off row breaks: id, severity, code.

    Rules that are kept are left out after the rows are made: an array without them would be made twice, as Spark asks
    for its size first, and not by compiled code.
    """
    return rows.select("workspace_id", "id", F.inline(_broken())).filter("severity is not null")


def duplicate_signals(rows: DataFrame) -> DataFrame:
    """Rows that repeat another's section, element, location, substrate and unit."""
    keys = ["workspace_id", "section", "element", "location", "substrate", "unit"]
    seen = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("id")).filter("n > 1")
    return seen.select("workspace_id", "id", F.lit("WARNING").alias("severity"), F.lit("DUPLICATE_ROWS").alias("code"))


@kept
def _order() -> Column:
    return severity_rank(F.col("severity"))


def found_signals(rows: DataFrame) -> DataFrame:
    """All signals in no order, for what only counts them: an order costs a sample and a sort of all of them."""
    return row_signals(rows).unionByName(duplicate_signals(rows))


def signals(rows: DataFrame) -> DataFrame:
    """All signals, the severest first, in an order that repeats. (L1)"""
    return found_signals(rows).orderBy("workspace_id", _order(), "code", "id")


def preflight(rows: DataFrame, found: DataFrame) -> DataFrame:
    """A row per workspace: counts, totals, fingerprint of what would be published, state.

    Rows and signals go through the same two aggregates, by range of the rows' digests and by workspace; nothing is
    joined. Without rows that may be published there is no fingerprint.
    """
    mine = rows.select("workspace_id", *_checked()).select("workspace_id", "work", "value", "digest", fusion.range_of(F.col("digest")).alias("range"), F.lit(None).cast("int").alias("rank"))
    seen = found.select("workspace_id", F.lit(False).alias("work"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("range"), _order().alias("rank"))
    counts = [s.lower() for s in SEVERITIES]
    ranged = mine.unionAll(seen).groupBy("workspace_id", "range").agg(*_summed(*counts))
    out = ranged.groupBy("workspace_id").agg(*_put_together(*counts))
    return out.withColumns({"state": _state(), "fingerprint": F.when(F.col("publishable_rows") > 0, F.col("fingerprint"))})


def _checked() -> list[Column]:
    work = takeoff.is_work()
    return [work.alias("work"), F.when(work, F.col("quantity") * F.col("rate_per_unit")).alias("value"), F.when(work, _digest()).alias("digest")]


@kept
def _digest() -> Column:
    return fusion.row_digest(list(takeoff.BOUND), ["id"])


def _summed(*counts: str) -> list[Column]:
    return [fusion.range_digest(F.col("digest")).alias("digest"), F.count_if("work").alias("publishable_rows"), F.sum("value").alias("value_ex_gst"), *[F.count_if(F.col("rank") == k).alias(n) for k, n in enumerate(counts)]]


def _put_together(*counts: str) -> list[Column]:
    return [F.sum("publishable_rows").alias("publishable_rows"), F.coalesce(F.sum("value_ex_gst"), F.lit(0.0)).alias("value_ex_gst"), fusion.whole_digest(F.col("range"), F.col("digest")).alias("fingerprint"), *[F.sum(n).alias(n) for n in counts]]


@kept
def _state() -> Column:
    return F.when(F.col("publishable_rows") == 0, "EMPTY").when(F.col("blocker") > 0, "BLOCKED").when(F.col("high") + F.col("warning") > 0, "ACKNOWLEDGE").otherwise("READY")


def publish(published: DataFrame, rows: DataFrame, checked: DataFrame, job: str, acknowledged: bool = False) -> DataFrame:
    """Rows to append to the published table: none if anything changed since the check, or if they are there.

    checked is the preflight that the estimator saw. The key is job and fingerprint, so a repeated call adds nothing.
    """
    now = preflight(rows, found_signals(rows)).select("workspace_id", "fingerprint", "state", "publishable_rows")
    seen = checked.select("workspace_id", F.col("fingerprint").alias("seen"))
    ready = F.col("state") == "READY" if not acknowledged else F.col("state").isin("READY", "ACKNOWLEDGE")
    ok = now.join(seen, "workspace_id").filter(ready & (F.col("fingerprint") == F.col("seen"))).select("workspace_id", "fingerprint")
    new = rows.filter(takeoff.is_work()).join(ok, "workspace_id").withColumn("job", F.lit(job))
    return new.join(published.select("job", "fingerprint").distinct(), ["job", "fingerprint"], "left_anti")


def apply_overrides(rows: DataFrame, log: DataFrame) -> DataFrame:
    """rows with the last override of each field; log: row_id, field_name, new_value, seq.

    Only fields that may be overridden are; a value that doesn't fit the field's type is passed over.
    """
    last = fusion.fold(log.filter(F.col("field_name").isin(*OVERRIDABLE)), ["row_id", "field_name"], [F.col("seq")])
    wide = last.groupBy("row_id").pivot("field_name", list(OVERRIDABLE)).agg(F.first("new_value")).select("row_id", *[F.col(f).try_cast(t).alias(f"new_{f}") for f, t in OVERRIDABLE.items()])
    joined = rows.join(wide, rows["id"] == wide["row_id"], "left")
    return joined.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in OVERRIDABLE else F.col(c) for c in rows.columns])


def sign_off(rows: DataFrame, checks: DataFrame, estimator: str) -> DataFrame:
    """A record per workspace with the checks' true results and a signature. (K29, A44, F142)"""
    priced = takeoff.priced(rows).groupBy("workspace_id").agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("value_ex_gst", "paint_litres", "labour_hours")])
    out = priced.join(checks.select("workspace_id", "state", "fingerprint", "blocker"), "workspace_id").withColumn("estimator", F.lit(estimator))
    line = F.format_string("%d:%.2f:%.2f:%.2f:%s", "workspace_id", "value_ex_gst", "paint_litres", "labour_hours", "fingerprint")
    return out.withColumn("signed", (F.col("state").isin("READY", "ACKNOWLEDGE")) & (F.col("blocker") == 0)).withColumn("signature", F.sha2(line, 256))


def completeness(parts: DataFrame) -> DataFrame:
    """Weighted share of evidence that is there; parts: workspace_id, part, share."""
    #: Weights of the six parts.
    weights = {"scale": 0.08, "floor": 0.24, "walls": 0.20, "openings": 0.20, "finishes": 0.18, "review": 0.10}
    w = F.coalesce(*[F.when(F.col("part") == k, F.lit(v)) for k, v in weights.items()], F.lit(0.0))
    share = F.least(F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return parts.groupBy("workspace_id").agg(F.round(100 * F.sum(w * share), 1).alias("completeness_pct"))
