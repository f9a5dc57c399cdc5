"""Graphs over tables of any size: connected components of edge lists, cycles of permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import removed, shuffled, written, written_at


def components(edges: DataFrame, a: str, b: str, most_rounds: int | None = None) -> DataFrame:
    """node, component: the least node that can be reached.

    A node hangs on its least neighbour that is less than itself; labels of labels, taken until they settle, name the
    node that each hangs on in the end. Then each node is put in place of those that hang on it, and edges within one
    are gone: a round only sees what the rounds before have left. The least node of a component hangs on none, so it
    stays to the end. With most_rounds, labels that still change after so many are an error. Tables are written to the
    shared folder and deleted once they are read.
    """
    spark = edges.sparkSession
    left, left_at = written_at(edges.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node is not null and other is not null").distinct(), "round")
    maps: list[DataFrame] = []
    rounds = 0
    while True:
        ends = left.unionAll(left.select(F.col("other"), F.col("node")))
        labels, at = written_at(ends.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "round")
        while True:
            further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
            new, new_at = written_at(labels.join(shuffled(further), "label").select("node", F.col("further").alias("label"), (F.col("further") != F.col("label")).alias("moved")), "round")
            removed(spark, at)
            labels, at = new.select("node", "label"), new_at
            if new.filter("moved").isEmpty():
                break
            rounds = _counted(rounds, most_rounds)
        maps.append(labels)
        for end in ("node", "other"):
            left = left.join(shuffled(labels.select(F.col("node").alias(end), F.col("label").alias("as"))), end).drop(end).withColumnRenamed("as", end)
        new, new_at = written_at(left.select("node", "other").filter("node <> other").distinct(), "round")
        removed(spark, left_at)
        left, left_at = new, new_at
        if left.isEmpty():
            break
        rounds = _counted(rounds, most_rounds)
    removed(spark, left_at)
    found = maps.pop()
    while maps:
        found = maps.pop().join(shuffled(found.select(F.col("node").alias("label"), F.col("label").alias("least"))), "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    return found.select("node", F.col("label").alias("component"))


def _counted(rounds: int, most: int | None) -> int:
    if rounds + 1 == most:
        raise RuntimeError(f"labels still change after {most} rounds")
    return rounds + 1


def rings(steps: DataFrame) -> DataFrame:
    """id, ring, place: the cycles of a permutation, each named by its least id, and how many steps an id is after that. (F111, F126)

    steps: id, next, long; every id is the next of one id. Rings are found by doubling: after k rounds an id knows the
    least of the 2^k that follow, and how far off it is. An id that is the least both of those and of as many after
    them has come round to itself: its ring is known, and leaves the rounds. So they are as many as the longest ring
    has bits, but short rings cost only the first few, and no ring has to fit a task.
    """
    spark = steps.sparkSession
    left, at = written_at(steps.select("id", "next", F.struct(F.col("id").alias("least"), F.lit(0).cast("long").alias("off")).alias("low")), "round")
    done, span = None, 1
    while True:
        ahead = left.select(F.col("id").alias("next"), F.col("next").alias("over"), F.col("low").alias("more"))
        more = F.struct(F.col("more.least").alias("least"), (F.col("more.off") + span).alias("off"))
        round_ = (F.col("low.least") == F.col("id")) & (F.col("more.least") == F.col("id"))
        new, new_at = written_at(left.join(shuffled(ahead), "next").select("id", F.col("over").alias("next"), F.least("low", more).alias("low"), round_.alias("round")), "round")
        removed(spark, at)
        known = new.filter("round").select(F.col("id").alias("ring"))
        # One join tells who has come round and who is left; it is written, as both are read, and tables of rounds before are gone.
        told, at = written_at(new.drop("round").join(shuffled(known), F.col("low.least") == F.col("ring"), "left"), "round")
        removed(spark, new_at)
        found = cut(told.filter("ring is not null").select("id", "ring", F.col("low.off").alias("off")))
        done = found if done is None else done.unionAll(found)
        left = told.filter("ring is null").drop("ring")
        span *= 2
        if left.isEmpty():
            break
    removed(spark, at)
    # What is known is the way to the least id; the way from it is the rest of the ring.
    sizes = done.groupBy("ring").agg(F.count("*").alias("n"))
    return done.join(shuffled(sizes), "ring").select("id", "ring", F.pmod(-F.col("off"), F.col("n")).alias("place"))


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows as a table in the shared folder."""
    return written(df, "round")
