"""Structured Streaming. An addition: the application that the operators stem from has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import fusion


def table_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour", step: str | None = None) -> DataFrame:
    """Counts of each kind in tumbling, or sliding, windows; events later than late are dropped."""
    w = F.window("ts", width, step) if step else F.window("ts", width)
    counted = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    got = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return got.select("user_id", F.col("w.start").alias("low"), F.col("w.end").alias("high"), "n")


def once(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def fold_into(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str):
    """Keeps the last row of each key in a table: every batch is folded and upserted, so a repeated batch changes nothing."""
    from ..sources import writers

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        last = fusion.fold(rows, keys, [F.col(c) for c in order])
        try:
            old = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last.write.parquet(path)
            return
        both = fusion.fold(old.unionByName(last), keys, [F.col(c) for c in order])
        writers._swap(spark, both, path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
