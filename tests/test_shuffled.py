"""Joins whose sides both grow with the data shuffle them: no size that Spark guesses makes the driver hold one."""

import pytest

from oracle import SF
from plumbline.plans import registry

NAMES = [
    "q_code_targets",
    "q_doors_and_windows",
    "q_dimension_scales",
    "q_placed_fields",
    "q_schedule_entries",
    "q_split",
    "q_wall_gaps",
    "q_wall_pairs",
    "q_rooms",
    "q_associate",
    "q_hulls",
]


def test_rings_and_components_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from plumbline.operators import graph

    steps = spark.range(64).select("id", ((F.col("id") + 8) % 64).alias("next"))
    for df in (graph.rings(steps), graph.components(steps, "id", "next")):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert graph.rings(steps).groupBy("ring").count().filter("count = 8").count() == 8


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_nothing_is_broadcast(spark, name):
    plan = registry.QUERIES[name](spark, str(SF))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
