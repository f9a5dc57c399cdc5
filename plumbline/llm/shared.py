"""Helpers that the training-data operators share: scratch tables, table loading and column idioms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import path as scratch
from ..scratch import written

__all__ = ["SPACES", "let", "numbered_within", "ranges", "scratch", "small_batches", "table", "words_of", "written"]

#: White space that separates words, as a regular expression for Java, DuckDB and Python alike.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranges(spark: SparkSession, rows: int, each: int = 1_000_000) -> int:
    """Partitions for so many slim rows: as many as the session says, more where each would get more rows than each."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, even where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES, -1), "")


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bounds what a Python worker gets at a time: whole texts are long, and Spark's default is 10,000 rows a batch.

    Frames are lazy, so the session's settings stay changed; smaller ones that the user has set are kept.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def numbered_within(rows: DataFrame, key: str, order: list, name: str, parts: int) -> DataFrame:
    """rows with their numbers, from 1, in the given order among the rows of their key, which is never null.

    The rows are sorted by ranges of key and order, so a key of many rows lies in many tasks; each counts its own, and
    what the ranges before hold of the key that a range begins with is added. Only a row for each range meets on the
    driver. Rows equal in key and order have any order among them.
    """
    import pyarrow as pa
    from pyspark.taskcontext import TaskContext

    spark = rows.sparkSession
    at, part, shift = f"{name}_at", f"{name}_part", f"{name}_shift"

    def run(batches):
        own, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
            begins = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1])
            place = np.arange(len(keys))
            count = place - np.maximum.accumulate(np.where(begins, place, 0)) + 1
            if not begins[0]:
                count[: np.flatnonzero(begins)[0] if begins.any() else len(keys)] += n
            last, n = keys[-1], int(count[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(count, pa.int64()), pa.array(np.full(len(keys), own), pa.int32())], [*b.schema.names, at, part])

    by = [key, *order]
    kind = T.StructType([*rows.schema.fields, T.StructField(at, T.LongType()), T.StructField(part, T.IntegerType())])
    ranged = written(rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(run, kind), name)
    ends = ranged.groupBy(part).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.max(F.struct(key, at)).alias("last")).collect()  # a row for each range
    carried, n, shifts = None, 0, []
    for r in sorted(ends, key=lambda r: r[part]):
        if r["low"] == carried and n:
            shifts.append((r[part], r["low"], n))
        n = r["last"][at] + (n if r["low"] == r["high"] == carried else 0)
        carried = r["high"]
    kinds = T.StructType([T.StructField(part, T.IntegerType()), T.StructField(key, rows.schema[key].dataType), T.StructField(shift, T.LongType())])
    moved = F.broadcast(spark.createDataFrame(shifts, kinds))  # at most one for each range
    return ranged.join(moved, [part, key], "left").withColumn(name, F.col(at) + F.coalesce(F.col(shift), F.lit(0))).select(*rows.columns, name)
