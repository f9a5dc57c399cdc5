"""Shares of polygons that lie in others, many pairs at a time, against the plain count over one pair's grid."""

import random

from pyspark.sql import functions as F

from plumbline.operators import surfaces

P = "array<struct<x:double,y:double>>"


def plain(a, b, n):
    def holds(p, x, y):
        inside = False
        for (px, py), (qx, qy) in zip(p, p[1:] + p[:1], strict=True):
            inside ^= (py > y) != (qy > y) and x < px + (y - py) * (qx - px) / (qy - py)
        return inside

    if not a:
        return 0.0
    x0, x1, y0, y1 = min(x for x, _ in a), max(x for x, _ in a), min(y for _, y in a), max(y for _, y in a)
    own = [(x, y) for i in range(n) for j in range(n) for x, y in [(x0 + (i + 0.5) * (x1 - x0) / n, y0 + (j + 0.5) * (y1 - y0) / n)] if holds(a, x, y)]
    return sum(holds(b or [], x, y) for x, y in own) / len(own) if own else 0.0


def test_shares(spark):
    rng = random.Random(3)
    shape = lambda: [(rng.uniform(0, 9), float(rng.randrange(9))) for _ in range(rng.randrange(0, 8))]
    rows = [(k, shape(), shape()) for k in range(300)] + [(300, None, shape()), (301, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)], None)]
    df = spark.createDataFrame(rows, f"id long, a {P}, b {P}")
    ratio = surfaces.overlap_ratio(F.col("a"), F.col("b"))
    got = dict(df.select("id", ratio).collect())
    assert got == {k: plain(a, b, surfaces.SAMPLES) for k, a, b in rows} and len(set(got.values())) > 50


def test_each_pair_is_sampled_once(spark):
    rows = spark.createDataFrame([(1, "a", [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])], f"page_id long, id string, points {P}")
    plan = surfaces.associate(rows, rows)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert surfaces.associate(rows, rows).first()["overlap"] == 1.0
