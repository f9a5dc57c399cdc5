"""The job database, by JDBC: tables read in parts, rows pushed once, rows and blobs replaced by key.

Spark's writer commits each partition by itself, and a task that is run again writes its rows again. So rows go to a
staging table first, which may hold some twice, and one statement in one transaction moves them, together with the
record that they were moved. What is reported is what that statement wrote.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _jdbc(spark: SparkSession, url: str, do: Callable, properties: dict[str, str]):
    """do(connection) in one transaction; rolled back if it fails."""
    jvm = spark._jvm
    login = jvm.java.util.Properties()
    for k, v in properties.items():
        if k == "driver":
            jvm.java.lang.Class.forName(v)
        else:
            login.setProperty(k, v)
    connection = jvm.java.sql.DriverManager.getConnection(url, login)
    try:
        connection.setAutoCommit(False)
        out = do(connection)
        connection.commit()
        return out
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def execute(spark: SparkSession, url: str, *statements: str, **properties: str) -> list[int]:
    """Statements in one transaction; the number of rows that each changed."""

    def do(connection) -> list[int]:
        counts = []
        for sql in statements:
            s = connection.createStatement()
            counts.append(s.executeUpdate(sql))
            s.close()
        return counts

    return _jdbc(spark, url, do, properties)


def read(spark: SparkSession, url: str, name: str, key: str | None = None, parts: int = 1, **properties: str) -> DataFrame:
    """A table, or a query in brackets with a name; in so many tasks by the remainder of a whole-number key, null keys included. (S3)"""
    if not key or parts < 2:
        return spark.read.jdbc(url, name, properties=properties)
    rest = [f"MOD(ABS({key}), {parts}) = {k}" for k in range(parts)]
    rest[0] += f" OR {key} IS NULL"
    return spark.read.jdbc(url, name, predicates=rest, properties=properties)


def _staged(rows: DataFrame, url: str, target: str, properties: dict[str, str]) -> tuple[str, str]:
    """A new table with the rows, and the statement that leaves each of them once in it.

    A row is known by a digest of all its values, so those of a task that was run again are known to be the same.
    """
    name = f"{target}_new_{uuid.uuid4().hex[:12]}"
    digest = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    keyed = rows.withColumns({"row_key": digest, "row_stamp": F.uuid()})
    keyed.write.option("createTableColumnTypes", "row_key VARCHAR(64), row_stamp VARCHAR(36)").jdbc(url, name, mode="errorifexists", properties=properties)
    return name, f'DELETE FROM {name} WHERE EXISTS (SELECT 1 FROM {name} t WHERE t."row_key" = {name}."row_key" AND t."row_stamp" < {name}."row_stamp")'


def push_once(rows: DataFrame, url: str, target: str, push_id: str, **properties: str) -> int:
    """Appends rows, equal ones once, to a table unless that push is recorded; how many were added.

    The record is a row of the table `pushes` (push_id, its primary key, and row_count), which must be there. A second
    call, at the same time or later, adds nothing and returns 0; so does a task that is run again.
    """
    spark = rows.sparkSession
    columns = ", ".join(f'"{c}"' for c in rows.columns)
    staging, once = _staged(rows, url, target, properties)

    def do(connection) -> int:
        claim = connection.prepareStatement("INSERT INTO pushes (push_id, row_count) VALUES (?, 0)")
        claim.setString(1, push_id)
        claim.executeUpdate()
        connection.createStatement().executeUpdate(once)
        n = connection.createStatement().executeUpdate(f"INSERT INTO {target} ({columns}) SELECT {columns} FROM {staging}")
        done = connection.prepareStatement("UPDATE pushes SET row_count = ? WHERE push_id = ?")
        done.setLong(1, n)
        done.setString(2, push_id)
        done.executeUpdate()
        return n

    try:
        return _jdbc(spark, url, do, properties)
    except Py4JJavaError:
        if not read(spark, url, "pushes", **properties).filter(F.lower("push_id") == push_id.lower()).count():
            raise  # not because the push is there
        return 0
    finally:
        execute(spark, url, f"DROP TABLE {staging}", **properties)


def replace(rows: DataFrame, url: str, target: str, keys: list[str], **properties: str) -> int:
    """Puts rows, with blobs or without, in place of those with the same keys; how many were written. Keys are not null.

    Rows of one key must be equal, and stand once: where the table's own key says so, others fail and nothing changes.
    """
    spark = rows.sparkSession
    columns = ", ".join(f'"{c}"' for c in rows.columns)
    staging, once = _staged(rows, url, target, properties)
    staged = lambda k: f'CAST(s."{k}" AS VARCHAR(1000))' if rows.schema[k].dataType.typeName() == "string" else f's."{k}"'  # noqa: E731  Spark may stage texts in columns that can't be compared
    same = " AND ".join(f'{staged(k)} = {target}."{k}"' for k in keys)
    try:
        return execute(spark, url, once, f"DELETE FROM {target} WHERE EXISTS (SELECT 1 FROM {staging} s WHERE {same})", f"INSERT INTO {target} ({columns}) SELECT {columns} FROM {staging}", **properties)[2]
    finally:
        execute(spark, url, f"DROP TABLE {staging}", **properties)
