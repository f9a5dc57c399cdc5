"""Readers: tables, spreadsheets as CSV and xlsx, JSON documents, external databases, extracted pages.

PDF, raster and docx need libraries that aren't at hand; pages come in as extracted words, segments and polygons.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..functions.kept import let
from ..scratch import written

#: Headings of take-off columns.
HEADINGS = {
    "section": ("section", "division", "category", "part", "area type", "trade"),
    "element": ("element", "item", "scope", "work", "work item", "description", "task", "component"),
    "location": ("location", "room", "zone", "floor", "level", "site", "location/area", "area/location"),
    "substrate": ("substrate", "surface", "material", "background", "base material", "substrate/surface", "wall type", "surface type"),
    "finish_system": ("finish system", "finish", "system", "paint system", "spec", "coating", "finish spec", "paint type"),
    "quantity": ("quantity", "qty", "quantity (m2)", "qty (m2)", "quantity m2", "qty m2", "area m2", "area (m2)", "amount", "count", "qty (no.)", "qty (no)", "quantity (no.)", "m2", "sqm", "area"),
    "floor_area": ("floor area", "floor area m2", "floor m2", "internal floor area", "internal floor area m2", "gross floor area", "nett floor area", "net floor area", "floor area (m2)"),
    "unit": ("unit", "uom", "units", "unit of measure", "measure"),
    "quantity_status": ("quantity status", "status", "measurement status", "qty status", "takeoff status"),
    "source_page": ("source page", "page", "drawing", "sheet", "plan no", "drawing no", "ref page"),
    "source_reference": ("source reference", "reference", "ref", "source", "doc ref", "item ref"),
    "inclusion_status": ("inclusion status", "inclusion", "inc/exc", "inc exc", "include/exclude"),
    "coats": ("coats", "coat", "no coats", "number of coats", "coats no"),
    "coverage_m2_per_litre": ("coverage m2 per litre", "coverage", "m2 per litre", "m2/l", "m2/litre", "sqm/l", "spread rate"),
    "productivity_m2_per_hour": ("productivity m2 per hour", "productivity", "m2 per hour", "m2/hr", "m2/hour", "labour rate", "labour", "labor", "production rate"),
    "rate_per_unit": ("rate per unit", "rate", "unit rate", "rate per m2", "price", "rate ($)", "value"),
    "confidence": ("confidence", "basis", "measurement basis"),
    "notes": ("notes", "note", "comments", "remarks", "comment"),
}


#: Units that are rates beside a dollar sign, and short forms that headings take.
MONEY_UNITS = ("m2", "m", "sqm")
SHORT_FORMS = {"quantity": ("m2", "sqm", "sqmt", "area"), "coverage_m2_per_litre": ("m2l", "sqml"), "productivity_m2_per_hour": ("m2h", "m2hr", "sqmh")}


def _key(word: str) -> str:
    return "".join(c for c in word.lower().replace("²", "2") if c.isalnum() and c.isascii())


def heading(c: Column) -> Column:
    """The take-off column that a heading names: exactly, else by the words it holds, 4 letters at least.

    A dollar sign beside a bare unit makes it a rate; short forms of square metres, of those a litre and of those an
    hour are quantities, coverages and productivities.
    """

    def target(key: Column) -> Column:
        money = F.coalesce(c, F.lit("")).contains("$") & key.isin(*MONEY_UNITS)
        out = F.when(F.trim(F.coalesce(c, F.lit(""))) == "", None).when(money, "rate_per_unit")
        for name, words in HEADINGS.items():
            out = out.when(key.isin(*{_key(w) for w in words}), name)
        for name, words in SHORT_FORMS.items():
            out = out.when(key.isin(*words), name)
        scores = [F.struct(sum((F.when(key.contains(_key(w)), len(_key(w))).otherwise(0) for w in words), F.lit(0)).alias("score"), F.lit(-k).alias("order"), F.lit(t).alias("target")) for k, (t, words) in enumerate(HEADINGS.items())]
        return out.otherwise(let(F.greatest(*scores), lambda best: F.when(best["score"] >= 4, best["target"])))

    return let(text.norm_key(c), target)


#: A quoted cell from its beginning to its end, and the end of one that began on an earlier line.
_QUOTED, _REST = r'(?:^|,)\s*+"(?:[^"]++|"")*+"', r'^(?:[^"]++|"")*+"'


def _opens(line: Column) -> Column:
    """Whether a line that begins a record, or goes on after a quoted cell, ends inside a quoted cell."""
    return F.regexp_replace(line, _QUOTED, ",").rlike(r'(?:^|,)\s*+"')


def sheets(spark: SparkSession, path: str, columns: int = 256) -> DataFrame:
    """CSV files as numbered records of cells: file, line (from 0), cells.

    Quoted cells may hold commas, quotes and line ends, and still a file is read in many tasks. Each line says where a
    reader is at its end, inside a quoted cell or not, for both cases at its beginning; put together, block by block of
    a file and then over its blocks, that tells which line ends are inside a cell, and how many records lie before.
    Records that lie in two or more blocks are put together from their parts. Only a row for each block is gathered.
    Cells are trimmed; line ends in them are \\n. A record with more than so many columns is an error, never cut.
    """
    m = F.col("_metadata")
    raw = spark.read.option("lineSep", "\n").text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), F.regexp_replace("value", "\r$", "").alias("text"))
    has, rest = F.col("text").contains('"'), F.regexp_replace("text", _REST, "")
    stays = ~F.col("text").rlike(_REST)
    raw = raw.withColumns({"after_out": has & _opens(F.col("text")), "after_in": ~has | stays | _opens(rest)})
    return _records(raw, *_blocks(raw), columns)


def _blocks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """file, block, inside (whether it begins in a cell), before (records that begin before it), for each block; and the same, to join."""

    def run(batches):
        held: dict = {}
        for b in batches:
            for (file, block), rows in b.groupby(["file", "block"], sort=False):
                out, into = rows["after_out"].to_numpy(bool), rows["after_in"].to_numpy(bool)
                was = held.setdefault((file, block), [[False, 0], [True, 0]])
                plain = ~out & into  # such a line leaves things as they are
                at, last = np.flatnonzero(~plain), 0
                for state in was:
                    last = 0
                    for k in at:
                        state[1] += 0 if state[0] else int(k) - last + 1  # lines that begin a record
                        state[0] = bool(into[k] if state[0] else out[k])
                        last = int(k) + 1
                    state[1] += 0 if state[0] else len(rows) - last
        yield pd.DataFrame([(f, k, *s[0], *s[1]) for (f, k), s in held.items()], columns=["file", "block", "end_out", "n_out", "end_in", "n_in"])

    seen = raw.select("file", "block", "after_out", "after_in").mapInPandas(run, "file string, block long, end_out boolean, n_out long, end_in boolean, n_in long")
    rows, state = [], {}
    for r in sorted(seen.collect(), key=lambda r: (r["file"], r["block"])):  # a row for each block of a file
        inside, before = state.get(r["file"], (False, 0))
        rows.append((r["file"], r["block"], inside, before))
        state[r["file"]] = (r["end_in"], before + r["n_in"]) if inside else (r["end_out"], before + r["n_out"])
    starts = raw.sparkSession.createDataFrame(rows, "file string, block long, inside boolean, before long")
    return starts, F.broadcast(starts)


def _records(raw: DataFrame, starts: DataFrame, few: DataFrame, columns: int) -> DataFrame:
    def cells(text: str) -> list[str]:
        csv.field_size_limit(1 << 30)
        got = [c.strip() for c in next(csv.reader(io.StringIO(text, newline=""), skipinitialspace=True), [])]
        while got and not got[-1]:
            got.pop()
        if len(got) > columns:
            raise ValueError(f"a line has more than {columns} columns")
        return got

    def run(batches):
        at, inside, nth, held = None, False, 0, []  # held: the lines of an open record
        begun = None  # the number of the record that is open; None if it began in an earlier block

        def part() -> list[tuple]:
            """What is open at a block's end: a record's beginning, or a block that lies inside one."""
            return [(*at, begun if begun is not None else -1, "\n".join(held), None)] if held else []

        for b in batches:
            out: list[tuple] = []
            for file, block, text, after_out, after_in, starts_in, before in b.itertuples(index=False):
                if (file, block) != at:
                    out += part() if at else []
                    at, inside, nth, held, begun = (file, block), starts_in, before, [], None
                if not inside:
                    begun, nth = nth, nth + 1
                inside = after_in if inside else after_out
                held.append(text)
                if not inside:
                    whole = "\n".join(held)
                    if whole:  # an empty line is no record
                        out.append((*at, begun, None, cells(whole)) if begun is not None else (*at, -2, whole, None))
                    held = []
            yield pd.DataFrame(out, columns=["file", "block", "line", "part", "cells"])
        if at and held:
            yield pd.DataFrame(part(), columns=["file", "block", "line", "part", "cells"])

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        return pd.DataFrame({"file": [rows["file"].iloc[0]], "line": [rows["line"].max()], "cells": [cells("\n".join(rows["part"]))]})

    rows = raw.join(few, ["file", "block"]).select("file", "block", "text", "after_out", "after_in", "inside", "before")
    found = written(rows.mapInPandas(run, "file string, block long, line long, part string, cells array<string>"), "records")
    whole = found.filter("cells is not null").select("file", "line", "cells")
    # A record that goes on in other blocks: its beginning, blocks within it, and the end.
    parts = found.filter("part is not null")
    order = W.partitionBy("file").orderBy("block", (F.col("line") >= 0).cast("int"))  # two a block at most
    parts = parts.withColumn("record", F.last(F.when(F.col("line") >= 0, F.col("line")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    rest = parts.groupBy("file", "record").applyInPandas(joined, "file string, line long, cells array<string>")
    return whole.unionAll(rest)


def workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Sheets of xlsx files as numbered lines of cells, as sheets() gives those of CSV: file, sheet, line, cells.

    An xlsx file is an archive of XML, small by its nature (a sheet has 1,048,576 lines at most), and is read by one
    task, sheet by sheet and line by line. Numbers come as they are stored, formulas as their last results.
    """
    return workbook_cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content"))


def workbook_cells(files: DataFrame) -> DataFrame:
    """The lines of workbooks that are at hand as bytes. files: path, content."""
    return files.select("path", "content").mapInPandas(_workbooks, "file string, sheet string, line long, cells array<string>")


_MAIN, _REL = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}", "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _workbooks(batches):
    for b in batches:
        for name, content in zip(b["path"], b["content"], strict=True):
            rows: list[tuple] = []
            for row in _workbook(content):
                rows.append((name, *row))
                if len(rows) == 5000:
                    yield pd.DataFrame(rows, columns=["file", "sheet", "line", "cells"])
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["file", "sheet", "line", "cells"])


def _workbook(content: bytes):
    """(sheet, line, cells) of every line of every sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        texts: list[str] = []
        if "xl/sharedStrings.xml" in names:
            texts = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets[sheet.get(f"{_REL}id")]
            with z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}") as f:
                line = 0
                for _, row in ElementTree.iterparse(f):
                    if row.tag != f"{_MAIN}row":
                        continue
                    line = int(row.get("r") or line + 1)
                    cells: list[str] = []
                    for c in row.iter(f"{_MAIN}c"):
                        at = 0  # cells without a reference follow each other
                        for letter in (c.get("r") or "").rstrip("0123456789"):
                            at = 26 * at + ord(letter) - 64
                        cells += [""] * (at - 1 - len(cells))
                        value = c.find(f"{_MAIN}v")
                        if c.get("t") == "inlineStr":
                            cells.append("".join(t.text or "" for t in c.iter(f"{_MAIN}t")))
                        elif value is None:
                            cells.append("")
                        else:
                            cells.append(texts[int(value.text)] if c.get("t") == "s" else value.text or "")
                    yield sheet.get("name"), line, [x.strip() for x in cells]
                    row.clear()


def header_lines(cells: DataFrame, most: int = 60) -> DataFrame:
    """The best heading line of each file: the most distinct take-off columns among its first lines."""
    first = cells.filter(F.col("line") < most)
    scored = first.select("file", "line", F.transform("cells", heading).alias("targets"))
    scored = scored.withColumn("score", F.size(F.array_distinct(F.filter("targets", lambda t: t.isNotNull()))))
    return scored.groupBy("file").agg(F.max(F.struct("score", (-F.col("line")).alias("neg"), "targets")).alias("b")).select("file", F.col("b.score").alias("score"), (-F.col("b.neg")).alias("header"), F.col("b.targets").alias("targets"))


#: Columns that are numbers.
NUMBERS = ("quantity", "rate_per_unit", "coats", "coverage_m2_per_litre", "productivity_m2_per_hour", "floor_area")


def takeoff_rows(cells: DataFrame) -> DataFrame:
    """Rows below each file's heading line, cells under their take-off columns.

    Where a column is, is looked up once a file.
    """
    heads = header_lines(cells).filter("score >= 2").select("file", "header", *[F.array_position("targets", t).cast("int").alias(f"at_{t}") for t in HEADINGS])
    body = cells.join(heads, "file").filter("line > header")
    out = body.select("file", "line", *[F.when(F.col(f"at_{t}") > 0, F.coalesce(F.get("cells", F.col(f"at_{t}") - 1), F.lit(""))).alias(t) for t in HEADINGS])
    number = lambda c: F.when(F.col(c).isNotNull(), text.quantity(F.col(c)))
    # An array that is taken apart again is worked out once, before any filter.
    out = out.select("*", F.explode(F.array(F.struct(*[number(c).alias(c) for c in NUMBERS]))).alias("numbers")).drop(*NUMBERS)
    out = out.filter("coalesce(numbers.quantity, 0) <> 0 or coalesce(numbers.floor_area, 0) <> 0")
    return out.select("*", "numbers.*").withColumn("unit", text.unit(F.col("unit"))).select("file", "line", *HEADINGS)


def first_existing(df: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under new names, each the first of its candidates that is there, null if none is."""
    have = {c.lower(): c for c in df.columns}
    pick = lambda names: next((F.col(have[n.lower()]) for n in names if n.lower() in have), F.lit(None).cast("string"))
    return df.select(*[pick(names).alias(k) for k, names in wanted.items()])


def json_documents(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The first object in a text, read by a schema; texts without one give null."""
    return df.withColumn("document", F.from_json(text.json_object(F.col(column)), schema))


def new_files(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """Files whose content isn't known yet, one of each content: path, sha256, length."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")
    once = files.groupBy("sha256").agg(F.min("path").alias("path"), F.first("length").alias("length"))
    return once.join(known.select("sha256"), "sha256", "left_anti")


def _segments(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.posexplode("segments").alias("n", "s")).select("page_id", ((F.col("page_id") * 1_000_000) + F.col("n")).alias("seg_id"), "s.*")


def page_parts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Extracted pages to segments and words; pages: page_id, segments and words as arrays of structs."""
    segments = _segments(pages)
    words = pages.select("page_id", F.posexplode("words").alias("n", "w")).select("page_id", F.col("n").alias("word_id"), "w.*")
    return segments, words


def strokes(pages: DataFrame, least: float = 0.0, most: float = float("inf")) -> DataFrame:
    """Stroked segments of a length within bounds with colour, width, layer and dash, each null where it isn't known."""
    segments = _segments(pages)
    for c, kind in (("colour", "string"), ("width", "double"), ("layer", "string"), ("dash", "string")):
        segments = segments if c in segments.columns else segments.withColumn(c, F.lit(None).cast(kind))
    n = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return segments.withColumn("length_pt", n).filter(F.col("length_pt").between(least, most)).select("page_id", "seg_id", "x1", "y1", "x2", "y2", "length_pt", "colour", "width", "layer", "dash")


def fills(pages: DataFrame, least_area: float = 0.0) -> DataFrame:
    """Filled shapes as polygons: rectangles by their corners, quadrilaterals and paths by their points.

    pages: page_id, shapes as an array of struct(kind, points, fill); a rectangle (kind re) has two opposite corners.
    """
    rows = pages.select("page_id", F.posexplode("shapes").alias("n", "s")).filter("s.fill is not null")
    a, b = F.get("s.points", F.lit(0)), F.get("s.points", F.lit(1))
    at = lambda x, y: F.struct(x["x"].alias("x"), y["y"].alias("y"))
    points = F.when(F.col("s.kind") == "re", F.array(at(a, a), at(b, a), at(b, b), at(a, b))).otherwise(F.col("s.points"))
    rows = rows.select("page_id", F.col("n").alias("shape_id"), F.col("s.kind").alias("kind"), F.col("s.fill").alias("fill"), points.alias("points"))
    return rows.withColumn("area", geometry.area(F.col("points"))).filter((F.size("points") >= 3) & (F.col("area") >= least_area))


def blocks(words: DataFrame) -> DataFrame:
    """Text blocks with their boxes, words in reading order. words: page_id, block, word_id, text, x0, y0, x1, y1."""
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_id", "text"))), lambda w: w["text"]), " ")
    return words.groupBy("page_id", "block").agg(said.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def jobs(job_rows: DataFrame, clients: DataFrame) -> DataFrame:
    """Jobs with their client's name, "" where there is none, the latest first."""
    named = job_rows.join(clients.select(F.col("id").alias("client_id"), F.col("name").alias("client")), "client_id", "left")
    return named.withColumn("client", F.coalesce("client", F.lit(""))).orderBy(F.desc("id"))


def placeholders(sql: str, style: str = "%s") -> str:
    """A statement's question marks in another driver's style, those inside quotes left alone. (S3)"""
    return "".join(part if k % 2 else part.replace("?", style) for k, part in enumerate(re.split(r"('(?:[^']|'')*')", sql)))


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A stored table's columns and rows; both choices reach the files."""
    rows = spark.read.parquet(path)
    rows = rows.filter(where) if where else rows
    return rows.select(*columns) if columns else rows


def tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and their columns, as rows."""
    found = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables(database) for c in spark.catalog.listColumns(t.name, database)]
    return spark.createDataFrame(found, "table_name string, column_name string, data_type string")


def blob(df: DataFrame, record_id: int, column: str = "content") -> DataFrame:
    """One record's bytes, base64 text decoded; the filter and the column reach the source."""
    data = F.col(column) if dict(df.dtypes)[column] == "binary" else F.unbase64(column)
    return df.filter(F.col("id") == record_id).select("id", data.alias("content"))


def saved_models(settings: DataFrame, current: DataFrame, schema: str) -> DataFrame:
    """Models whose fingerprint is still that of their sources; others come back null.

    settings: workspace_id, key, value with {"fingerprint": ..., "model": ...}. current: workspace_id, fingerprint.
    """
    read = settings.filter("key = 'canonical_model'").withColumn("saved", F.from_json("value", f"fingerprint string, model struct<{schema}>"))
    now = current.select("workspace_id", F.col("fingerprint").alias("now"))
    fresh = F.col("saved.fingerprint") == F.col("now")
    return read.join(now, "workspace_id", "left").select("workspace_id", F.when(fresh, F.col("saved.model")).alias("model"), F.coalesce(fresh, F.lit(False)).alias("fresh"))


def snapshot(sources: dict[str, DataFrame]) -> DataFrame:
    """Everything known of each workspace as one row a record: workspace_id, source, record (JSON)."""
    parts = [d.select("workspace_id", F.lit(name).alias("source"), F.to_json(F.struct(*[c for c in sorted(d.columns) if c != "workspace_id"])).alias("record")) for name, d in sorted(sources.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
