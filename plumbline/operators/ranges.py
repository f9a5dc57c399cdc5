"""Scans along an order within keys of any size: rows are sorted by ranges of key and order, and a range gets what those before it hold of its key.

A key of half of all rows so lies in many tasks. Windows run within (range, key), whose rows a task has anyway; what is
carried over is one row for each range and key, and a key has no more of them than there are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import shuffled, written

PART = "range_part"


def ranged(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df with its range; the table is written once."""
    return written(df.repartitionByRange(*[F.col(k) for k in by], *order).withColumn(PART, F.spark_partition_id()), "ranged")


def within(by: list[str], order: list[Column]) -> WindowSpec:
    """The rows of a key within its range, in order."""
    return W.partitionBy(PART, *by).orderBy(*order)


def same(by: list[str], prefix: str) -> Column:
    out = F.col(PART) == F.col(f"{prefix}{PART}")
    for k in by:
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return out


def carried(df: DataFrame, by: list[str], folds: dict[str, tuple[Column, str]], after: bool = False, many: bool = False) -> DataFrame:
    """df with a column for each fold: (aggregate over a range's rows of a key, how those of the ranges before are put together).

    Together: sum, max, first or last, the latter two of what isn't null. after: of the ranges after instead.
    many: there may be as many keys as rows, so that what is carried is shuffled and never sent to the driver.
    """
    ends = df.groupBy(PART, *by).agg(*[a.alias(name) for name, (a, _) in folds.items()])
    # After: the same frame against the order, as one that ends at the last row is gone through anew for each row.
    along = W.partitionBy(*by).orderBy(F.desc(PART) if after else PART).rowsBetween(W.unboundedPreceding, -1)
    turned = {"first": "last", "last": "first"} if after else {}
    put = {"sum": F.sum, "max": F.max, "min": F.min, "first": lambda c: F.first(c, ignorenulls=True), "last": lambda c: F.last(c, ignorenulls=True)}
    beside = ends.select(*[F.col(k).alias(f"in_{k}") for k in (PART, *by)], *[put[turned.get(how, how)](name).over(along).alias(name) for name, (_, how) in folds.items()])
    return df.join(shuffled(beside) if many else beside, same(by, "in_"), "left").drop(*[f"in_{k}" for k in (PART, *by)])


def number(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df with row numbers from 1 along the order, which must be unique, within each key."""
    here = ranged(df, by, order).withColumn(name, F.row_number().over(within(by, order)))
    return carried(here, by, {"before": (F.count("*"), "sum")}, many=True).withColumn(name, (F.col(name) + F.coalesce("before", F.lit(0))).cast("long")).select(*df.columns, name)
