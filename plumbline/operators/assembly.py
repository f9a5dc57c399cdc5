"""Putting sources together: walls with all that is known of them, registers, deduplication, checks, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import numbered
from . import fusion, openings, takeoff


def distinct_in_order(values: Column) -> Column:
    """Trimmed values, the first of equals kept, empty ones dropped."""
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: v != ""))


def missing(all_values: Column, found: Column) -> Column:
    """(U11)"""
    return F.array_sort(F.array_except(all_values, found))


def with_reason(ledger: Column, stage: str, outcome: Column) -> Column:
    """A ledger of decisions with one more entry."""
    return F.array_append(F.coalesce(ledger, F.array().cast("array<struct<stage:string,outcome:string>>")), F.struct(F.lit(stage).alias("stage"), outcome.alias("outcome")))


def merge_batches(batches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several readings, the first reading's of equal keys kept; texts compare without case."""
    ranked = [b.withColumn("batch", F.lit(k)) for k, b in enumerate(batches)]
    every = ranked[0]
    for b in ranked[1:]:
        every = every.unionByName(b, allowMissingColumns=True)
    kinds = dict(every.dtypes)
    folded = [F.lower(F.trim(F.coalesce(k, F.lit("")))) if kinds[k] == "string" else F.round(k, 4) if kinds[k] == "double" else F.col(k) for k in keys]
    named = every.withColumn("key", F.struct(*[c.alias(f"k{i}") for i, c in enumerate(folded)]))
    return fusion.choose(named, ["key"], [F.col("batch"), F.xxhash64(*batches[0].columns)]).drop("key", "batch")


def merge_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows named as one of each workspace: summed, references joined; different units give null."""
    got = rows.join(ids.select("id").distinct(), "id", "left_semi").groupBy("workspace_id").agg(F.sum("quantity").alias("q"), F.collect_set(text.unit(F.col("unit"))).alias("units"), F.array_join(F.array_sort(F.collect_set("source_reference")), "; ").alias("source_reference"), F.bool_and(F.lower(F.coalesce("quantity_status", F.lit(""))).isin("mapped", "measured")).alias("all_measured"), F.count("*").alias("merged"))
    one = F.size("units") == 1
    return got.select("workspace_id", F.when(one, F.col("q")).alias("quantity"), F.when(one, F.col("units")[0]).alias("unit"), "source_reference", "all_measured", "merged")


def registered_walls(facades: DataFrame, heights: DataFrame, substrate_notes: DataFrame, opening_rows: DataFrame) -> DataFrame:
    """Walls with height, gross area, substrate, openings and net area.

    facades: wall_ref, side, level, length_m. heights: level, height_m. substrate_notes: wall_ref, side, substrate.
    opening_rows: wall_ref, elevation_side, deduct, area_m2.
    """
    walls = facades.join(heights, "level", "left").withColumn("gross_m2", F.col("length_m") * F.coalesce("height_m", F.lit(2.7)))
    walls = openings.substrates(walls, substrate_notes)
    placed = openings.attach(opening_rows, walls).drop("wall_ref").withColumnRenamed("attached_wall", "wall_ref")
    return openings.net_walls(walls, placed)


def level_map(walls: DataFrame) -> DataFrame:
    """Each wall's level, where only one is named."""
    return walls.groupBy("wall_ref").agg(F.count_distinct("level").alias("n"), F.min("level").alias("level")).filter("n = 1").drop("n")


def resolve_level(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """A level's id by its normalised name, null where none or several match: never guessed."""
    known = levels.select(text.norm_key(F.col("name")).alias("key"), F.col("level_id")).groupBy("key").agg(F.count_distinct("level_id").alias("n"), F.min("level_id").alias("level_id")).filter("n = 1").drop("n")
    return rows.withColumn("key", text.norm_key(F.col("level"))).join(known, "key", "left").drop("key")


def same_as_manual(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """Automatic openings that no manual decision covers: by instance, or by mark, wall and size."""
    size = lambda d: [text.clean_id(d["type_mark"]), d["wall_ref"], F.round(d["width_m"], 3), F.round(d["height_m"], 3)]
    key = lambda d: F.xxhash64(*[F.coalesce(c.cast("string"), F.lit("")) for c in size(d)])
    once = automatic.dropDuplicates(["opening_instance_id"])
    left = once.join(manual.select("opening_instance_id").distinct(), "opening_instance_id", "left_anti")
    marked = manual.filter(text.clean_id(F.col("type_mark")).isNotNull())
    return left.withColumn("k", key(left)).join(marked.select(key(marked).alias("k")).distinct(), "k", "left_anti").drop("k")


def provenance(rows: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """Where each row's number was read: the first source, in order, with its reference."""
    out, names = rows, []
    for name, s in sources:
        c = f"from_{name}"
        out = out.join(s.select("source_reference", F.lit(name).alias(c)).distinct(), "source_reference", "left")
        names.append(c)
    return out.withColumn("provenance", F.coalesce(*names, F.lit("unknown"))).drop(*names)


def facade_check(plan_width: Column, elevation_width: Column, plan_height: Column, elevation_height: Column, tolerance: float = 0.02) -> Column:
    """verified, conflict or review."""
    off = lambda a, b: F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))
    w, h = off(plan_width, elevation_width), off(plan_height, elevation_height)
    return F.when(F.coalesce(w > tolerance, F.lit(False)) | F.coalesce(h > tolerance, F.lit(False)), "conflict").when(w.isNull() | h.isNull(), "review").otherwise("verified")


def geometry_check(rows: DataFrame, close: float = 0.08, verified: float = 0.03) -> DataFrame:
    """Documented against drawn areas: verified, close or conflict. rows: key, documented_m2, drawn_m2."""
    off = F.abs(F.col("documented_m2") - F.col("drawn_m2")) / F.greatest("documented_m2", "drawn_m2", F.lit(1e-9))
    state = F.when(F.col("documented_m2").isNull() | F.col("drawn_m2").isNull(), "single source").when(off <= verified, "verified").when(off <= close, "close").otherwise("conflict")
    return rows.withColumn("difference", F.round(off, 6)).withColumn("state", state)


def match_report(canonical: DataFrame, rows: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Model elements against take-off rows of the same reference.

    canonical: ref, area_m2. rows: ref, quantity. None, several, a bad quantity, a match or a variance.
    """
    hits = rows.groupBy("ref").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.sum(F.coalesce(F.isnan("quantity") | (F.col("quantity") < 0), F.lit(True)).cast("int")).alias("bad"))
    d = canonical.join(hits, "ref", "left")
    state = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") > 1, "ambiguous").when(F.col("bad") > 0, "invalid").when(F.abs(F.col("quantity") - F.col("area_m2")) <= tolerance, "matched").otherwise("variance")
    return d.select("ref", "area_m2", "quantity", state.alias("state"))


def status(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Counts of each workspace and what to do next."""
    counts = rows.groupBy("workspace_id").agg(F.count("*").alias("rows"), F.sum(takeoff.is_work().cast("long")).alias("work_rows"), F.sum(F.coalesce(F.col("quantity") > 0, F.lit(False)).cast("long")).alias("measured_rows"), F.array_sort(F.collect_set(text.unit(F.col("unit")))).alias("units"))
    blockers = found.filter("severity = 'BLOCKER'").groupBy("workspace_id").agg(F.count("*").alias("blockers"))
    d = counts.join(blockers, "workspace_id", "left").fillna({"blockers": 0})
    return d.withColumn("next", F.when(F.col("work_rows") == 0, "Measure").when(F.col("blockers") > 0, "Resolve blockers").when(F.col("measured_rows") < F.col("work_rows"), "Complete quantities").otherwise("Review"))


def bands(groups: DataFrame) -> DataFrame:
    """Material bands of an elevation, cut midway between the centres of its codes.

    groups: facade_id, code, cx, cy, x, y, w, h (the facade's box). The axis along which the centres spread more wins.
    """
    all_of = W.partitionBy("facade_id")
    spread = lambda c, s: (F.max(c).over(all_of) - F.min(c).over(all_of)) / F.greatest(F.col(s), F.lit(1.0))
    d = groups.withColumn("vertical", spread("cy", "h") > spread("cx", "w") * 1.2)
    at, low, size = (F.when(F.col("vertical"), F.col(a)).otherwise(F.col(b)) for a, b in (("cy", "cx"), ("y", "x"), ("h", "w")))
    d = d.withColumn("at", at).withColumn("low", low).withColumn("high", low + size)
    w = W.partitionBy("facade_id").orderBy("at", "code")
    begin = F.coalesce((F.lag("at").over(w) + F.col("at")) / 2, F.col("low"))
    end = F.coalesce((F.lead("at").over(w) + F.col("at")) / 2, F.col("high"))
    return d.select("facade_id", "code", F.when(F.col("vertical"), "y").otherwise("x").alias("axis"), begin.alias("from"), end.alias("to"))


def next_job(jobs: DataFrame, prefix: str = "PB", first_number: int = 25001) -> DataFrame:
    """The number after the last job's."""
    n = F.max(text.first(F.col("job_no"), rf"^{prefix}(\d+)$").cast("long"))
    number = F.coalesce(n + 1, F.lit(first_number)).cast("string")
    return jobs.agg(F.concat(F.lit(prefix), F.lpad(number, F.greatest(F.lit(5), F.length(number)), "0")).alias("job_no"))


def legend(pages: DataFrame) -> DataFrame:
    """Code and description pairs of legend lines, equal pairs once."""
    lines = pages.select(F.col("id").alias("page_id"), F.explode(F.split("extracted_text", "\n")).alias("line"))
    code = text.first(F.upper(F.trim("line")), r"^([A-Z]{1,4}-?\d{1,3}[A-Z]?)\s*[-:=\s]\s*\S")
    d = lines.withColumn("code", code).filter("code is not null").withColumn("description", F.trim(F.regexp_replace(F.trim("line"), r"^\S+\s*[-:=]?\s*", "")))
    return d.groupBy("code", F.lower("description").alias("key")).agg(F.min(F.struct("page_id", "description")).alias("b")).select("code", F.col("b.description").alias("description"), F.col("b.page_id").alias("page_id"))


def fuzzy_codes(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The dictionary code whose description shares most words with a name, ties to the lower code."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > 2))
    a = names.select("name_id", F.explode(tokens(F.col("name"))).alias("token"))
    b = dictionary.select("code", F.explode(tokens(F.col("description"))).alias("token"))
    shared = a.join(b, "token").groupBy("name_id", "code").agg(F.count("*").alias("n"))
    best = shared.groupBy("name_id").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("code").alias("code"))).alias("b"))
    return names.join(best.select("name_id", F.col("b.code").alias("code"), (-F.col("b.k")).alias("shared")), "name_id", "left")


def unregistered_issues(issues: DataFrame, more: DataFrame) -> DataFrame:
    """Issues with new ones added, equal ones once, numbered anew."""
    keys = ["category", "page_no", "code", "message"]
    new = more.select(*keys).distinct().join(issues.select(*[F.col(k).alias(f"o_{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys], "left_anti")
    every = issues.select(*keys, F.lit(0).alias("new")).unionAll(new.select(*keys, F.lit(1)))
    return numbered(every, [F.col("new"), *[F.col(k) for k in keys]]).drop("new")


def register_page(register: DataFrame, page: int, size: int = 30) -> DataFrame:
    """One page of a register in order of its id."""
    return register.orderBy("id").offset(page * size).limit(size)


def limited(df: DataFrame, order: list[str], most: int) -> tuple[DataFrame, bool]:
    """The first rows of an order, and whether there are more."""
    return df.orderBy(*order).limit(most), df.limit(most + 1).count() > most


def largest_footprint(footprints: DataFrame) -> DataFrame:
    """(L7)"""
    return fusion.choose(footprints, ["workspace_id"], [-(F.col("width") * F.col("depth")), F.col("id")])


def overhead(regions: DataFrame) -> DataFrame:
    """Overhead areas by class, equal regions once. regions: geometry, class, area_m2."""
    return regions.dropDuplicates(["geometry", "class"]).groupBy("class").agg(F.bround(F.sum("area_m2"), 3).alias("area_m2"), F.count("*").alias("regions"))


def board_summary(rows: DataFrame) -> DataFrame:
    """(A16)"""
    keys = ["board_type", "thickness_mm", "board_width_mm", "board_length_mm", "level"]
    return rows.groupBy(*keys).agg(F.sum("net_area_m2").alias("net_area_m2"), F.sum("installed_board_area_m2").alias("installed_board_area_m2"), F.sum("sheet_count").alias("sheet_count"))


def room_totals(rooms: DataFrame) -> DataFrame:
    """(A24, A25)"""
    return rooms.groupBy("page_id").agg(F.count("*").alias("faces"), F.sum(F.col("is_room").cast("long")).alias("rooms"), F.bround(F.sum(F.when(F.col("is_room"), F.col("area_m2"))), 3).alias("floor_m2"))


def keep_deselected(pages: DataFrame, captured: DataFrame) -> DataFrame:
    """Pages that an estimator had taken out stay out after automation."""
    out = captured.filter("selected = 0").select("id", F.lit(True).alias("was_out")).distinct()
    return pages.join(out, "id", "left").withColumn("selected", F.when(F.col("was_out"), 0).otherwise(F.col("selected"))).drop("was_out")


def of_selected_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of the pages that are in."""
    return rows.join(pages.filter("selected = 1").select(F.col("id").alias("page_id")), "page_id", "left_semi")


def zone_rows(zones: DataFrame, shapes: DataFrame) -> DataFrame:
    """Take-off rows of mapped zones and of shapes that no row claims; without an area none."""
    outside = F.lower(F.concat_ws(" ", "page_type", "label")).rlike("elevation|external|facade")
    named = lambda d, q, u: d.select("workspace_id", F.when(outside, "External").otherwise("Internal").alias("section"), F.col("label").alias("element"), q.alias("quantity"), F.lit(u).alias("unit"))
    free = shapes.filter("takeoff_row_id is null")
    area, line = free.filter("lower(kind) = 'polygon'"), free.filter("lower(kind) <> 'polygon'")
    every = named(zones, F.bround("area_m2", 3), "m²").unionByName(named(area, F.bround("area_m2", 3), "m²")).unionByName(named(line, F.bround("length_m", 3), "lm"))
    return every.filter("quantity > 0")


def scope_prisms(prisms: DataFrame, included: list[str], reference: list[str], unassigned: bool = True) -> DataFrame:
    """Prisms whose groups are included or kept for reference; those without a group by a switch. prisms: groups."""
    has = lambda names: F.arrays_overlap("groups", F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"))
    state = F.when(F.coalesce(F.size("groups"), F.lit(0)) <= 0, F.lit("Included" if unassigned else "Excluded")).when(has(included), "Included").when(has(reference), "Reference").otherwise("Excluded")
    return prisms.withColumn("scope_state", state).filter("scope_state <> 'Excluded'")


def authorised(rows: DataFrame) -> Column:
    """A deduction by hand, or an automatic one that passes every condition."""
    return F.coalesce(F.col("deduct") & ((F.lower(F.coalesce("decided_by", F.lit(""))) == "manual") | openings.eligible()), F.lit(False))


def room_words(words: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Words that name a room: letters, of the vocabulary."""
    x = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    return words.filter((F.length(x) >= 3) & x.isin(*[v.lower() for v in vocabulary]))


def tagged(rows: DataFrame, trade: str) -> DataFrame:
    """Rows marked with a trade; rates come from the estimator, so they begin at 0."""
    return rows.withColumn("section", F.concat(F.lit(f"{trade} - "), F.coalesce("section", F.lit("")))).withColumn("notes", F.concat_ws("; ", F.col("notes"), F.lit(f"Trade: {trade}"))).withColumn("rate_per_unit", F.lit(0.0))


def manual_calibration(stored: Column, automatic: Column, drift: float = 0.003) -> Column:
    """Whether a page's scale was set by hand: it differs from the automatic one by more than 0.3 %."""
    return F.coalesce((stored > 0) & ((automatic <= 0) | (F.abs(stored - automatic) > drift * automatic)), F.lit(False))


def settings(rows: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Numeric settings of each workspace with their defaults. rows: workspace_id, key, value."""
    wide = rows.groupBy("workspace_id").pivot("key", list(defaults)).agg(F.max("value"))
    return wide.select("workspace_id", *[text.number(F.col(k), v).alias(k) for k, v in defaults.items()])


def long_walls(segments: DataFrame, least_pt: float = 200.0) -> DataFrame:
    """(L6)"""
    n = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return segments.withColumn("length_pt", n).filter(F.col("length_pt") >= least_pt).orderBy(F.desc("length_pt"), "seg_id")


def first_available(*sources: tuple[str, DataFrame]) -> tuple[str, DataFrame]:
    """The first source that has rows."""
    for name, d in sources:
        if d.limit(1).count():
            return name, d
    return sources[-1]


def save_shapes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Shapes with those of the pages in new replaced."""
    return old.join(new.select("page_id").distinct(), "page_id", "left_anti").unionByName(new, allowMissingColumns=True)


def hatch_confidence(strokes: Column, spacing_mean: Column, spacing_variance: Column, length_variance: Column, length_mean: Column) -> Column:
    """From the number of strokes and how even their spacing and lengths are."""
    even = lambda v, m: 1 - F.least(F.lit(1.0), F.sqrt(v) / F.greatest(m, F.lit(1e-9)))
    return F.round(0.4 * F.least(F.lit(1.0), strokes / 20) + 0.35 * even(spacing_variance, spacing_mean) + 0.25 * even(length_variance, length_mean), 4)


#: Paint systems by finish code: substrate, coats, coverage, productivity. Used where a project brings none.
SYSTEM_DEFAULT = ("Plasterboard", 3, 16.0, 15.0)


def systems(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Each row's paint system by code, else by its substrate's kind, else the default, and its litres.

    known: finish_code, kind (timber, cement, floor or null), coats, coverage.
    """
    s = F.lower(F.coalesce("substrate", F.lit("")))
    kind = F.when(s.rlike("timber|wood|door"), "timber").when(s.rlike("cement|fc|external"), "cement").when(s.rlike("floor|concrete|epoxy"), "floor")
    by_code = known.select(F.upper("finish_code").alias("code"), F.struct("coats", "coverage").alias("by_code"))
    by_kind = known.filter("kind is not null").groupBy(F.col("kind").alias("row_kind")).agg(F.min_by(F.struct("coats", "coverage"), "finish_code").alias("by_kind"))
    d = rows.withColumn("code", F.upper(F.trim("finish_code"))).withColumn("row_kind", kind).join(by_code, "code", "left").join(by_kind, "row_kind", "left")
    used = F.coalesce("by_code", "by_kind", F.struct(F.lit(SYSTEM_DEFAULT[1]).alias("coats"), F.lit(SYSTEM_DEFAULT[2]).alias("coverage")))
    return d.withColumn("coats", used["coats"]).withColumn("litres", F.when((F.col("area_m2") > 0) & (used["coverage"] > 0), F.col("area_m2") * used["coats"] / used["coverage"]).otherwise(0.0)).drop("code", "row_kind", "by_code", "by_kind")


def surface_total(rows: DataFrame, flag: str | None = None) -> DataFrame:
    """(A51-A53)"""
    return (rows if flag is None else rows.filter(F.coalesce(F.col(flag), F.lit(False)))).agg(F.coalesce(F.sum("area_m2"), F.lit(0.0)).alias("total_m2"))


def roof(pages: DataFrame, walls: DataFrame) -> DataFrame:
    """Pitches that texts state and the height at which a roof sits: the highest wall. (F130, F131)"""
    found = F.regexp_extract_all(F.lower("extracted_text"), F.lit(r"(\d{1,2}(?:\.\d)?)\s*(?:°|deg)"), F.lit(1))
    said = pages.groupBy("workspace_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform(found, lambda x: x.cast("double")))))).alias("pitches_deg"), F.bool_or(F.lower("extracted_text").contains("parapet")).alias("parapet"))
    return said.join(walls.groupBy("workspace_id").agg(F.max("height_m").alias("roof_z")), "workspace_id", "full")


def space_area(specified: Column, drawn: Column) -> Column:
    """(F132, F133)"""
    return F.when(specified > 0, specified).otherwise(drawn)


def element_of(c: Column) -> Column:
    """The element that a location's words name, null if none."""
    rules = (("ceiling", "Ceiling"), ("skirting", "Skirting"), ("door", "Door"), ("window", "Window"), ("wall", "Wall"), ("floor", "Floor"), ("soffit", "Soffit"))
    return text.first_keyword(c, rules)
