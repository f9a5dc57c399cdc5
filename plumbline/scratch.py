"""Intermediate tables in the folder that the driver and all executors share, and row numbers of whole tables."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[str] = []


def clean() -> int:
    """Deletes all intermediate tables made so far; for when the results that were made of them are written. The number deleted."""
    jvm, context, n = SparkContext._jvm, SparkContext._active_spark_context, 0
    while _made and jvm is not None:
        at = jvm.org.apache.hadoop.fs.Path(_made.pop())
        conf = context._jsc.hadoopConfiguration() if context else jvm.org.apache.hadoop.conf.Configuration()
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


@atexit.register
def _at_the_end() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone; the folder is a scratch folder
        clean()


def path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Without that setting a local session gets a temporary folder; a cluster, whose executors would each write to a
    disk of their own, gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='scratch-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str = "table", **options: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor loses nothing of it.

    It is there until clean() is called or the session's process ends.
    """
    at = path(df.sparkSession, name)
    df.write.options(**options).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def written_at(df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
    """written(), and where, for a table that removed() ends before clean()."""
    got = written(df, name)
    return got, _made[-1]


def removed(spark: SparkSession, at: str) -> None:
    """Deletes an intermediate table that nothing reads any more, so that rounds don't add up on the disk."""
    to = spark._jvm.org.apache.hadoop.fs.Path(at)
    to.getFileSystem(spark._jsc.hadoopConfiguration()).delete(to, True)
    _made.remove(at)


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join in which both sides are shuffled, however small Spark guesses df to be.

    Its guesses of exploded rows and of compressed tables are far too low; what it broadcasts by them has to fit the driver.
    """
    return df.hint("merge")


def numbered(df: DataFrame, order: list[Column], name: str = "number", first: int = 1) -> DataFrame:
    """df with the row numbers of a whole order: sorted by range, counted from each partition's own ids.

    Only a count per partition meets on the driver. Rows that are equal in the order have any order among them.
    """
    spark = df.sparkSession
    at, part = f"{name}_at", f"{name}_part"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    ranged = written(ranged, "numbered").withColumn(part, F.shiftright(at, 33))
    before, starts = first, []
    for r in sorted(ranged.groupBy(part).agg(F.count("*").alias("n")).collect(), key=lambda r: r[part]):
        starts.append((r[part], before - (r[part] << 33)))
        before += r["n"]
    shift = spark.createDataFrame(starts, f"{part} long, {name}_shift long")
    return ranged.join(F.broadcast(shift), part).withColumn(name, F.col(at) + F.col(f"{name}_shift")).drop(at, part, f"{name}_shift")
