"""Connected components by alternating large and small stars, in DataFrame functions.

Each round gives every node's larger neighbours its smallest neighbour, and then every node's smaller neighbours their
smallest; the edges shrink towards one star for each component, with its smallest node in the middle, in about
log(nodes) rounds. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that isn't the smallest of its component; edges: (a long, b long)."""
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    known = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("s")).first()
        if now == known or not now["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        known = now
        edges = written(_small(_large(edges)), "edges")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionAll(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.distinct().join(least, "a")
    pairs = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return pairs.filter("a <> b").distinct()
