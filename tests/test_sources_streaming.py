import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline import streaming
from plumbline.functions import pricing
from plumbline.sources import readers, writers


def test_spreadsheet(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Job,Tower\n\nSection,"Work item",Location,Qty (m2),UOM,Rate ($),Comments\nInternal,"Walls, hall",Level 1,"1,200.5",sqm,$12,ok\nInternal,Doors,Level 1,,each,220,\nInternal,Skirting,Ground,40,lm,6,\n')
    cells = readers.sheets(spark, f"{tmp_path}/*.csv")
    head = readers.header_lines(cells).first()
    assert head["score"] == 7 and head["targets"][:4] == ["section", "element", "location", "quantity"]
    got = [(r["element"], r["location"], r["quantity"], r["unit"], r["rate_per_unit"], r["notes"]) for r in readers.takeoff_rows(cells).orderBy("line").collect()]
    assert got == [("Walls, hall", "Level 1", 1200.5, "m²", 12.0, "ok"), ("Skirting", "Ground", 40.0, "lm", 6.0, "")]


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([("x {\"a\": 1} y",), ("none",), (None,)], "t string")
    assert [r["document"] and r["document"]["a"] for r in readers.json_documents(df, "t", "a int").collect()] == [1, None, None]
    assert readers.first_existing(df, {"text": ("body", "T"), "no": ("z",)}).columns == ["text", "no"]
    for name, data in (("1.bin", b"a"), ("2.bin", b"a"), ("3.bin", b"b")):
        (tmp_path / name).write_bytes(data)
    import hashlib

    known = spark.createDataFrame([(hashlib.sha256(b"b").hexdigest(),)], "sha256 string")
    assert [r["path"].endswith("1.bin") for r in readers.new_files(spark, str(tmp_path), known).collect()] == [True]


def test_writers(spark, tmp_path):
    path = f"{tmp_path}/rows"
    spark.createDataFrame([(1, "auto:x", 1.0), (2, "manual", 2.0)], "id long, owner string, v double").write.parquet(path)
    writers.replace_owned(spark, path, spark.createDataFrame([(9, "auto:y", 9.0)], "id long, owner string, v double"), "owner", "auto:")
    writers.upsert(spark, path, spark.createDataFrame([(2, "manual", 5.0)], "id long, owner string, v double"), ["id"])
    assert sorted((r["id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(2, 5.0), (9, 9.0)]
    faces = spark.sql("select 1 as face_id, array(struct(0D as x, 0D as y, 0D as z), struct(1D as x, 0D as y, 0D as z), struct(0D as x, 1D as y, 0D as z)) as points")
    writers.mesh(faces, f"{tmp_path}/obj")
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/obj").collect()][-1] == "f -3 -2 -1"
    writers.csv(spark.read.parquet(path), f"{tmp_path}/csv", ["v"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["v", "id", "owner"]


def events(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [(k, at(m), u, "view", v) for k, (m, u, v) in enumerate([(0, 1, 1.0), (10, 1, 2.0), (70, 1, 3.0), (75, 2, 4.0), (300, 2, 5.0)])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    return df, streaming.table_stream(spark, f"{tmp_path}/in", df.schema)


@pytest.mark.parametrize("kind", ["windows", "sessions", "once"])
def test_streams_equal_their_batch_form(spark, tmp_path, kind):
    batch, stream = events(spark, tmp_path)
    make = {"windows": streaming.windowed_counts, "sessions": streaming.sessions, "once": lambda s: streaming.once(s, "event_id").select("event_id")}[kind]
    q = make(stream).writeStream.format("memory").queryName(f"out_{kind}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table(f"out_{kind}").count()
    if kind == "once":
        assert got == 5
    else:
        assert 0 < got <= make(batch).count()


def test_fold_into(spark, tmp_path):
    _, stream = events(spark, tmp_path)
    for _ in range(2):
        streaming.fold_into(stream, f"{tmp_path}/table", ["user_id"], ["ts", "event_id"], f"{tmp_path}/cp").awaitTermination(120)
    assert sorted((r["user_id"], r["value"]) for r in spark.read.parquet(f"{tmp_path}/table").collect()) == [(1, 3.0), (2, 5.0)]


def test_pricing(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    rate = lambda *a: value(pricing.default_rate(*map(F.lit, a)))
    assert [rate("", "Fire door", "", "No."), rate("Timber door", "Entry", "", "each"), rate("Timber door", "", "", "m²"), rate("Steel", "Beam", "", "lm"), rate("Plasterboard", "Wall", "", "m²"), rate("Concrete", "Floor", "Epoxy", "m²"), rate("x", "y", "z", "m²")] == [500.0, 650.0, 220.0, 38.0, 28.0, 95.0, 0.0]
    assert [value(pricing.height_surcharge(F.lit(h))) for h in (2.9, 3.0, 4.49, 4.5)] == [1.0, 1.15, 1.15, 1.3]
    assert value(pricing.pitched_area(F.lit(10.0), F.lit(60.0))) == pytest.approx(20.0) and value(pricing.pitched_area(F.lit(10.0), F.lit(85.0))) == 10.0
    assert value(pricing.px_per_m(F.lit(100), F.lit(2.0))) == pytest.approx(56.69, abs=0.01)
    assert value(pricing.variance_pct(F.lit(50.0), F.lit(55.0))) == pytest.approx(10.0)
