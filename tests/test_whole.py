"""Queries take every row of their tables: held against brute force and against their SQL."""

import math
import random

import pytest

from oracle import SF, compare
from plumbline.operators import fusion, graph
from plumbline.plans import registry

tables = pytest.mark.skipif(not SF.exists(), reason="no tables here")


def drawn(spark, tmp_path, rows):
    """The embeddings table of a folder: one page of segments, (vec_id, x1, y1, x2, y2)."""
    data = [(k, 1, [v / 1000 for v in xy]) for k, *xy in rows]
    spark.createDataFrame(data, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def crossing(a, b):
    """Whether two segments (id, x1, y1, x2, y2) meet, by the signs of four triangles; nothing touches in the fixture."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]) > 0
    p, q, r, s = a[1:3], a[3:5], b[1:3], b[3:5]
    return side(p, q, r) != side(p, q, s) and side(r, s, p) != side(r, s, q)


@pytest.mark.parametrize("seed", [5, 6])
def test_crossings_of_all_segments(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(k, *[r.uniform(-400, 400) for _ in range(4)]) for k in range(60)]
    got = [(x["a_seg_id"], x["b_seg_id"]) for x in registry.QUERIES["q_crossings"](spark, drawn(spark, tmp_path, rows)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and crossing(a, b)}


@tables
def test_crossings_of_whole_tables(spark):
    compare(spark, registry.QUERIES["q_crossings"], registry.ORACLES["q_crossings"])


def test_faces_snap_and_strokes_of_all_segments(spark, tmp_path):
    # a square of 200 by 200 whose sides have ids of every remainder by 4, and a line through it
    sf = drawn(spark, tmp_path, [(1, 0, 0, 200, 0), (2, 200, 0, 200, 200), (3, 200, 200, 0, 200), (4, 0, 200, 0, 0), (5, 100, -50, 100, 250)])
    assert sorted((r["area"], r["perimeter"]) for r in registry.QUERIES["q_faces"](spark, sf).collect()) == [(20000.0, 600.0)] * 2
    snapped = registry.QUERIES["q_snap"](spark, sf).collect()
    assert sorted((r["seg_id"], r["a"], r["b"]) for r in snapped) == [(1, 0, 1), (2, 1, 2), (3, 2, 3), (4, 3, 0), (5, 4, 5)]
    # the upright lines are 100 apart and their middles no more than 200: one group
    strokes = registry.QUERIES["q_stroke_clusters"](spark, sf).collect()
    assert (2, 3) in [(r["cluster"], r["n"]) for r in strokes]
    assert math.isclose(next(r["angle"] for r in strokes if r["cluster"] == 2), 90.0)


def lines(spark, tmp_path, rows, columns):
    """The lineitem table of a folder."""
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_overlaps_of_all_lines(spark, tmp_path):
    r = random.Random(7)
    rows = [(r.randint(1, 2), r.randint(1, 25), float(r.randint(1, 50)), r.randint(0, 120)) for _ in range(80)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_orderkey long, l_quantity double, d int")
    df.selectExpr("l_suppkey", "l_orderkey", "l_quantity", "date_add(date'1995-01-01', d) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    windows = {}
    for s, o, _, d in rows:
        low, high = windows.get((s, o), (d, d))
        windows[s, o] = min(low, d), max(high, d)
    want = {(a[0], a[1], b[1]) for a, (al, ah) in windows.items() for b, (bl, bh) in windows.items() if a[0] == b[0] and a[1] < b[1] and al <= bh + 3 and bl <= ah + 3}
    got = [(x["l_suppkey"], x["a_order"], x["b_order"]) for x in registry.QUERIES["q_interval_overlap"](spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@tables
def test_overlaps_of_whole_tables(spark):
    compare(spark, registry.QUERIES["q_interval_overlap"], registry.ORACLES["q_interval_overlap"])


@pytest.mark.parametrize("seed", [8, 9])
def test_greedy_assignment_of_all_lines(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(r.randint(1, 25), r.randint(1, 15), float(r.choice((900, 1500, 2500, 40000, r.randint(900, 90000))))) for _ in range(200)]
    want, used = set(), set()
    for cost, a, b in sorted((c, a, b) for a, b, c in rows):
        if not {(b % 10, "a", a), (b % 10, "b", b)} & used:
            used |= {(b % 10, "a", a), (b % 10, "b", b)}
            want.add((b % 10, a, b, cost))
    got = [(x["page"], x["a"], x["b"], x["cost"]) for x in registry.QUERIES["q_greedy_assignment"](spark, lines(spark, tmp_path, rows, "l_partkey long, l_suppkey long, l_extendedprice double")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_greedy_takes_nulls_as_ends(spark):
    rows = [(1, None, 1, 1.0), (1, None, 2, 2.0), (1, 5, 2, None), (None, 7, 7, 3.0), (None, 7, 8, 1.0)]
    got = fusion.greedy_pairs(spark.createDataFrame(rows, "g long, a long, b long, c double"), "g", "a", "b", "c")
    assert {tuple(x) for x in got.collect()} == {rows[0], rows[2], rows[4]}


def union_find(edges):
    """The least node of each node's component."""
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in list(up)}


@pytest.mark.parametrize("seed", [10, 11])
def test_components_of_all_lines(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(r.randint(1, 60), r.randint(1, 60), float(r.randint(1, 50)), r.randint(0, 10) / 100) for _ in range(70)]
    got = registry.QUERIES["q_connected_components"](spark, lines(spark, tmp_path, rows, "l_orderkey long, l_suppkey long, l_quantity double, l_discount double")).collect()
    want = union_find((o, s + 100000000) for o, s, *_ in rows)
    assert len(set(want.values())) > 1
    assert len(got) == len(want) and {x["node"]: x["component"] for x in got} == want


@tables
def test_components_of_whole_tables(spark):
    edges = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("l_orderkey", "l_suppkey + 100000000").collect()
    got = registry.QUERIES["q_connected_components"](spark, str(SF)).collect()
    assert {x["node"]: x["component"] for x in got} == union_find(map(tuple, edges)) and len(got) == len({n for e in edges for n in e})


def test_components_that_do_not_settle_raise(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="2 rounds"):
        graph.components(path, "a", "b", most_rounds=2)


def test_materials_of_all_parts(spark, tmp_path):
    rows = [("Brand#1", "STEEL", 3), ("Brand#1", "BRASS", 50), ("Brand#2", "TIN", 9), ("Brand#2", "TIN", 48), ("Brand#3", "COPPER", 5)]
    spark.createDataFrame(rows, "p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = registry.QUERIES["q_materials"](spark, str(tmp_path)).collect()
    assert sorted((r["code"], r["first_page"], r["entries"], r["status"]) for r in got) == [("Brand#1", 3, 2, "Conflict"), ("Brand#2", 9, 2, "Confirmed"), ("Brand#3", 5, 1, "Confirmed")]


def test_fanout_of_all_lines(spark, tmp_path):
    got = registry.QUERIES["q_explode_fanout"](spark, lines(spark, tmp_path, [(1, 1, 4.0), (1, 2, 48.0)], "l_orderkey long, l_linenumber int, l_quantity double")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, "ceiling", 2.0), (1, 1, "skirting", 1.0), (1, 1, "wall", 4.0), (1, 2, "ceiling", 24.0), (1, 2, "skirting", 12.0), (1, 2, "wall", 48.0)]


@tables
@pytest.mark.parametrize("name", ["q_materials", "q_explode_fanout"])
def test_whole_tables(spark, name):
    assert not any(w in registry.ORACLES[name] for w in ("p_size > 47", "l_quantity > 40"))
    compare(spark, registry.QUERIES[name], registry.ORACLES[name])
