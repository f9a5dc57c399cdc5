"""The job database over embedded Derby, whose jars come with Spark."""

import uuid

import pytest
from pyspark.sql import functions as F

from plumbline.sources import database

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture
def url(spark):
    at = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    database.execute(
        spark, at, 'CREATE TABLE pushes (push_id VARCHAR(80) PRIMARY KEY, row_count BIGINT)', 'CREATE TABLE lines ("id" BIGINT PRIMARY KEY, "area" VARCHAR(40), "m2" DOUBLE)',
        'CREATE TABLE blobs ("job_id" BIGINT NOT NULL, "file_name" VARCHAR(80) NOT NULL, "data" BLOB, PRIMARY KEY ("job_id", "file_name"))', 'CREATE TABLE settings ("k" VARCHAR(20) PRIMARY KEY, "v" VARCHAR(20))', **DRIVER)
    return at


def lines(spark, n, first=0):
    return spark.range(first, first + n).select("id", F.concat(F.lit("Unit "), "id").alias("area"), (F.col("id") * 1.5).alias("m2")).repartition(5)


def test_read_in_parts(spark, url):
    database.execute(spark, url, "INSERT INTO settings VALUES ('a', 'x')", **DRIVER)
    lines(spark, 97).unionAll(lines(spark, 3, -3)).write.jdbc(url, "lines", mode="append", properties=DRIVER)
    got = database.read(spark, url, "lines", '"id"', 4, **DRIVER)
    assert got.rdd.getNumPartitions() == 4 and sorted(r["id"] for r in got.collect()) == list(range(-3, 97))
    assert [tuple(r) for r in database.read(spark, url, "(SELECT * FROM settings) s", **DRIVER).collect()] == [("a", "x")]


def test_pushed_once(spark, url):
    assert database.push_once(lines(spark, 40), url, "lines", "job 1/print", **DRIVER) == 40
    assert database.push_once(lines(spark, 40), url, "lines", "job 1/print", **DRIVER) == 0
    assert database.push_once(lines(spark, 5, 100), url, "lines", "job 2/print", **DRIVER) == 5
    assert database.read(spark, url, "lines", **DRIVER).count() == 45
    assert {tuple(r) for r in database.read(spark, url, "pushes", **DRIVER).collect()} == {("job 1/print", 40), ("job 2/print", 5)}


def test_a_failed_push_leaves_nothing(spark, url):
    clash = lines(spark, 10).unionAll(lines(spark, 1).withColumn("area", F.lit("another of the same id")))
    with pytest.raises(Exception, match="unique|primary key"):
        database.push_once(clash, url, "lines", "job", **DRIVER)
    assert database.read(spark, url, "lines", **DRIVER).count() == 0 and database.read(spark, url, "pushes", **DRIVER).count() == 0
    with pytest.raises(Exception, match="lines|does not exist|division|cast|raise"):
        database.push_once(lines(spark, 10).withColumn("m2", F.raise_error(F.lit("raise")).cast("double")), url, "lines", "job", **DRIVER)
    assert database.push_once(lines(spark, 10), url, "lines", "job", **DRIVER) == 10


def test_rows_of_a_task_run_again_count_once(spark, url):
    twice = lines(spark, 10).unionAll(lines(spark, 10))  # what the staging table holds after a repeated task
    assert database.push_once(twice, url, "lines", "job", **DRIVER) == 10


def test_replace(spark, url):
    row = lambda k, v: (k, v)
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, v string")
    assert database.replace(frame(row("a", "1"), row("b", "2")), url, "settings", ["k"], **DRIVER) == 2
    assert database.replace(frame(row("b", "3"), row("c", "4")), url, "settings", ["k"], **DRIVER) == 2
    assert sorted(tuple(r) for r in database.read(spark, url, "settings", **DRIVER).collect()) == [("a", "1"), ("b", "3"), ("c", "4")]
    with pytest.raises(Exception, match="unique|primary key"):
        database.replace(frame(row("a", "5"), row("a", "6")), url, "settings", ["k"], **DRIVER)
    assert sorted(r["v"] for r in database.read(spark, url, "settings", **DRIVER).collect()) == ["1", "3", "4"]


def test_markers(spark, url):
    for data in (b"PK\x03\x04 a package", b"PK\x03\x04 a later one", b"PK\x03\x04 a later one"):
        marker = spark.createDataFrame([(1, "progress.zip", bytearray(data)), (2, "progress.zip", bytearray(b"x" * 100_000))], "job_id long, file_name string, data binary")
        assert database.replace(marker.unionAll(marker), url, "blobs", ["job_id", "file_name"], **DRIVER) == 2
        assert {r["job_id"]: bytes(r["data"]) for r in database.read(spark, url, "blobs", **DRIVER).collect()} == {1: data, 2: b"x" * 100_000}
