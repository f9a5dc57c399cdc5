"""What the driver queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


#: Bytes of a table's files for each partition that its rows are dealt or shuffled into, and the most partitions.
EACH, MOST = 1 << 20, 2000
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def parts(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Partitions by the size of a table's files."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return min(MOST, -(-size // EACH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Shuffles begin with partitions by its size, so that a task's rows don't grow with it; Spark puts small ones together.

    Frames are lazy, so the session's setting stays raised; a larger one is kept.
    """
    n = parts(spark, sf_dir, name)
    if n > int(spark.conf.get(PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(PARTITIONS, n)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, ident: str) -> DataFrame:
    """A table's rows dealt by an id over all cores, for what makes many rows of each or takes long for each.

    A few megabytes of files are one task's otherwise; and rows that are laid out of one row, as a page's are, are then
    in one partition already and aren't shuffled again to be grouped by it.
    """
    n = max(4 * spark.sparkContext.defaultParallelism, parts(spark, sf_dir, name))
    return table(spark, sf_dir, name).repartition(n, ident)


def key() -> Column:
    return F.col("o_orderkey")


def nth() -> Column:
    """1 to 9."""
    return key() % 9 + 1


def pick(values, by: Column) -> Column:
    """The value whose turn it is: that of by modulo their number."""
    return F.element_at(F.array(*values), (by % len(values) + 1).cast("int"))


def choice(values, by: str) -> str:
    """The same in SQL."""
    return f"([{', '.join(values)}])[(({by}) % {len(values)} + 1)::INT]"


def cents(c: str) -> Column:
    """Money as whole cents, so that sums don't depend on their order."""
    return F.round(F.col(c) * 100).cast("long")


#: The same in SQL.
CENTS = "CAST(round({} * 100) AS BIGINT)"
#: Extended price less discount in hundredths of cents.
NET = f"({CENTS.format('l_extendedprice')} * (100 - {CENTS.format('l_discount')}))"


def net() -> Column:
    return cents("l_extendedprice") * (100 - cents("l_discount"))
