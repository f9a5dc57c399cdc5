import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import fusion, graph


def test_choose_keeps_null_keys_and_breaks_ties(spark):
    df = spark.createDataFrame([(None, 1, 5.0), (None, 2, 5.0), ("a", 3, 1.0), ("a", 4, None)], "k string, id long, v double")
    got = sorted((r["k"] or "", r["id"]) for r in fusion.choose(df, ["k"], [F.col("v"), F.col("id")], largest=True).collect())
    assert got == [("", 2), ("a", 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_pairs_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), k, r.uniform(1, 3)) for k in range(150)]
    got = {(x["a_id"], x["b_id"]) for x in fusion.near_pairs(spark.createDataFrame(rows, "g string, id long, v double"), ["g"], "id", "v", 0.02).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and abs(a[2] - b[2]) <= 0.02 * max(a[2], b[2])}


def test_mutual_unique_best(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.5), (2, 2, 0.5), (3, 3, 0.7), (3, 4, 0.7), (5, 1, 0.2)], "a long, b long, s double")
    assert [(r["a"], r["b"]) for r in fusion.mutual_unique_best(df, "a", "b", "s").collect()] == [(1, 1)]


def test_nearest(spark):
    left = spark.createDataFrame([("g", 1, 10.0), ("g", 2, 14.9), ("h", 3, 1.0), ("g", 4, 15.0)], "k string, id long, v double")
    right = spark.createDataFrame([("g", 7, 10.0), ("g", 8, 20.0), ("g", 6, 10.0)], "k string, rid long, w double")
    got = {r["id"]: r["near_rid"] for r in fusion.nearest(left, right, ["k"], "v", "w", "rid").collect()}
    assert got == {1: 6, 2: 6, 3: None, 4: 6}


def test_allocate_consensus_conflicts(spark):
    df = spark.createDataFrame([("a", 1.0, 90.0), ("a", 2.0, 90.0), ("b", 0.0, 5.0), ("c", 0.0, 4.0), ("c", 0.0, 4.0)], "k string, w double, t double")
    got = sorted((r["k"], r["s"]) for r in fusion.allocate(df, ["k"], "w", "t", "s").collect())
    assert got == [("a", 30.0), ("a", 60.0), ("b", 5.0), ("c", 0.0), ("c", 0.0)]
    ev = spark.createDataFrame([(1, 100.0, 1.0), (1, 102.0, 1.0), (1, 200.0, 1.5), (2, 7.0, 1.0)], "p int, v double, w double")
    best = {r["p"]: r for r in fusion.consensus(ev, ["p"], "v", "w", 0.035).collect()}
    assert best[1]["n"] == 2 and best[1]["solved"] == pytest.approx(101.0) and best[1]["spread"] == pytest.approx(1 / 101) and best[2]["n"] == 1
    assert [r["p"] for r in fusion.conflicts(ev, ["p"], "v", 50.0).collect()] == [1]


@pytest.mark.parametrize("seed", [3, 4])
def test_intervals_against_brute_force(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), k, float(a := r.randint(0, 300)), float(a + r.randint(0, 9))) for k in range(60)]
    df = spark.createDataFrame(rows, "g string, id long, lo double, hi double")
    got = {(x["a_id"], x["b_id"]) for x in fusion.overlapping(df, ["g"], "id", "lo", "hi", 7.0).collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3]}
    want = []
    for g in "ab":
        islands = []
        for _, _, lo, hi in sorted((x for x in rows if x[0] == g), key=lambda x: (x[2], x[3])):
            if islands and lo - islands[-1][1] <= 2:
                islands[-1] = (islands[-1][0], max(hi, islands[-1][1]), islands[-1][2] + 1)
            else:
                islands.append((lo, hi, 1))
        want += [(g, *i) for i in islands]
    assert sorted((x["g"], x["lo"], x["hi"], x["n"]) for x in fusion.merge_intervals(df, ["g"], "lo", "hi", 2.0).collect()) == sorted(want)


def test_writes(spark):
    old = spark.createDataFrame([(1, "auto:x", 1.0), (2, "manual", 2.0), (3, None, 3.0)], "id long, owner string, v double")
    new = spark.createDataFrame([(9, "auto:y", 9.0)], "id long, owner string, v double")
    assert sorted(r["id"] for r in fusion.replace_owned(old, new, "owner", "auto:").collect()) == [2, 3, 9]
    changed = spark.createDataFrame([(2, "manual", 7.0), (None, "x", 1.0)], "id long, owner string, v double")
    assert sorted((r["id"] or 0, r["v"]) for r in fusion.upsert(old, changed, ["id"]).collect()) == [(0, 1.0), (1, 1.0), (2, 7.0), (3, 3.0)]


def test_greedy_and_components(spark):
    pairs = spark.createDataFrame([(1, 1, 1, 5.0), (1, 1, 2, 1.0), (1, 2, 2, 2.0), (1, 2, 1, 9.0)], "page long, a long, b long, d double")
    assert sorted((r["a"], r["b"]) for r in fusion.greedy_pairs(pairs, "page", "a", "b", "d").collect()) == [(1, 2), (2, 1)]
    edges = spark.createDataFrame([(k, k + 1) for k in range(10, 40)] + [(100, 50), (50, 60)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges, "a", "b").collect()}
    assert got == {k: 10 for k in range(10, 41)} | {50: 50, 60: 50, 100: 50}
