"""Writers: replacing what an owner wrote, upserts, exports. Files are replaced by writing beside and swapping."""

from __future__ import annotations

import hashlib
import io
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fusion


def _swap(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Writes df, which may read path, to a folder beside, and then puts that in its place.

    The old table is first moved aside and only deleted once the new one stands, so a crash in between loses nothing:
    recover() puts the old one back.
    """
    beside, aside = f"{path.rstrip('/')}__new", f"{path.rstrip('/')}__old"
    recover(spark, path)
    df.write.mode("overwrite").parquet(beside)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    old, new, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, beside, aside))
    fs = old.getFileSystem(conf)
    if not fs.rename(old, kept):
        raise OSError(f"{path} could not be moved aside")
    if not fs.rename(new, old):
        fs.rename(kept, old)
        raise OSError(f"{beside} could not take the place of {path}")
    fs.delete(kept, True)


def recover(spark: SparkSession, path: str) -> bool:
    """Puts back a table that a crash has left aside; true if there was one to put back."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here, kept = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}__old"))
    fs = here.getFileSystem(conf)
    if not fs.exists(kept):
        return False
    if fs.exists(here):
        fs.delete(kept, True)  # the new table stands
        return False
    return bool(fs.rename(kept, here))


def replace_owned(spark: SparkSession, path: str, new: DataFrame, owner: str, prefix: str) -> None:
    """(K4-K9)"""
    _swap(spark, fusion.replace_owned(spark.read.parquet(path), new, owner, prefix), path)


def upsert(spark: SparkSession, path: str, new: DataFrame, keys: list[str]) -> None:
    """(K3, K10, K12)"""
    _swap(spark, fusion.upsert(spark.read.parquet(path), new, keys), path)


def publish_once(spark: SparkSession, path: str, rows: DataFrame, job: str, fingerprint: str) -> bool:
    """Appends rows as one publication of a job, unless that fingerprint is there; true if they were added.

    Every call writes a folder of its own, which is renamed into place once it is whole. That rename succeeds for one
    call only and is all that publishes, so a crash leaves nothing half written and nothing that would stop the next
    call. False means that the publication stands; any other failure is an error.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    name = hashlib.sha256(f"{job}/{fingerprint}".encode()).hexdigest()[:32]
    fs = at(path).getFileSystem(conf)
    place, beside = fs.makeQualified(at(f"{path}/publication={name}")), fs.makeQualified(at(f"{path}/_new/{name}-{uuid.uuid4().hex}"))
    if fs.exists(place):
        return False
    try:
        rows.withColumn("job", F.lit(job)).withColumn("fingerprint", F.lit(fingerprint)).write.parquet(beside.toString())
        never_over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), conf).rename(beside, place, never_over)
        except Py4JJavaError as e:
            if not fs.exists(place):
                raise OSError(f"{beside} could not take its place") from e
            return False
        return True
    finally:
        fs.delete(beside, True)


def ensure(spark: SparkSession, path: str, schemas: dict[str, str]) -> list[str]:
    """Creates the tables of a shared folder that aren't there, empty; returns their names."""
    made = []
    for name, schema in schemas.items():
        there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
            spark.createDataFrame([], schema).write.parquet(f"{path}/{name}")
            made.append(name)
    return made


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """One folder of CSV with headings, wanted columns first; quotes inside cells are doubled."""
    first = [c for c in columns or [] if c in df.columns]
    df.select(*first, *[c for c in df.columns if c not in first]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


SHEET_ROWS = 1_048_576  # lines that a sheet of a workbook may have


def workbooks(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A workbook of one sheet for each key, headings first: key, content (xlsx).

    A key's rows go through one task, as a file has to; more than a sheet may have are an error, never cut. Rows are in
    the order of the columns.
    """

    def book(rows: pd.DataFrame) -> pd.DataFrame:
        if len(rows) >= SHEET_ROWS:
            raise ValueError(f"{len(rows)} rows are more than a sheet may have")
        rows = rows.sort_values(columns, kind="stable", na_position="first")
        return pd.DataFrame({key: [rows[key].iloc[0]], "content": [_xlsx(columns, rows[columns].itertuples(index=False))]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, *[c for c in columns if c != key]).groupBy(key).applyInPandas(book, f"{key} {kind}, content binary")


def _xlsx(columns: list[str], rows) -> bytes:
    """A workbook with one sheet; texts stand in their cells, so no table of texts has to be held."""
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"

    def cell(v) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>" if isinstance(v, int) else f"<c><v>{float(v)!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f"<worksheet {main}><sheetData>".encode())
            for row in (columns, *rows):
                f.write(f"<row>{''.join(map(cell, row))}</row>".encode())
            f.write(b"</sheetData></worksheet>")
    return out.getvalue()


def mesh(faces: DataFrame, path: str) -> None:
    """Vertices and faces as OBJ text; faces: face_id, points of (x, y, z).

    A face's vertices are numbered from the end of the file (negative numbers), so faces need no shared count.
    """
    v = F.transform("points", lambda p: F.format_string("v %.4f %.4f %.4f", p["x"], p["y"], p["z"]))
    f = F.concat(F.lit("f "), F.array_join(F.transform(F.sequence(F.size("points"), F.lit(1)), lambda k: F.concat(F.lit("-"), k)), " "))
    faces.orderBy("face_id").select(F.array_join(F.concat(v, F.array(f)), "\n").alias("value")).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    """(K25, K26, K28)"""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
