"""Faces, snapping, stroke groups, rings and parts of random pages against plain walks over the whole page."""

import collections
import math
import random

import pytest

from plumbline.functions import geometry  # noqa: F401
from plumbline import scratch
from plumbline.operators import graph, pages, planar

SEG = "page_id long, seg_id long, x1 double, y1 double, x2 double, y2 double"


def page(seed, n, size, grid=None):
    r = random.Random(seed)
    at = (lambda: float(r.randrange(0, size, grid))) if grid else (lambda: round(r.uniform(0, size), 2))
    rows = []
    for k in range(n):
        x, y = at(), at()
        rows.append((1 + k % 2, k, x, y, *((x, at()) if r.random() < 0.5 else (at(), y))) if grid else (1 + k % 2, k, x, y, at(), at()))
    return rows


def traced(pieces, least):
    """Faces of one page's cut lines, side by side in a dictionary of turns."""
    around, key = collections.defaultdict(set), lambda x, y: (round(x, 8) + 0.0, round(y, 8) + 0.0)
    for x1, y1, x2, y2 in pieces:
        a, b = key(x1, y1), key(x2, y2)
        if a != b:
            around[a].add(b)
            around[b].add(a)
    turns = {}
    for v, others in around.items():
        order = sorted(others, key=lambda o: (math.atan2(o[1] - v[1], o[0] - v[0]), o))
        turns.update({(o, v): (v, order[k - 1]) for k, o in enumerate(order)})
    found, seen = [], set()
    for e in sorted(turns):
        ring = []
        while e not in seen:
            seen.add(e)
            ring.append(e[0])
            e = turns[e]
        area = sum(p[0] * q[1] - p[1] * q[0] for p, q in zip(ring, ring[1:] + ring[:1])) / 2
        if len(ring) >= 3 and area >= least:
            found.append(ring)
    return found


@pytest.mark.parametrize("seed,n,size,grid", [(1, 40, 100, None), (2, 60, 60, 10), (3, 80, 40, 5), (4, 2, 50, None)])
def test_faces(spark, seed, n, size, grid):
    df = spark.createDataFrame(page(seed, n, size, grid), SEG).repartition(3)
    cut = pages.split(df).collect()
    got = collections.defaultdict(list)
    for r in pages.faces(df, 0.05).orderBy("page_id", "face").collect():
        got[r["page_id"]].append([(p["x"], p["y"]) for p in r["points"]])
        assert len(got[r["page_id"]]) == r["face"]
    for k in (1, 2):
        want = traced([r[2:6] for r in cut if r["page_id"] == k], 0.05)
        assert got[k] == want and (n == 2 or want)


@pytest.mark.parametrize("seed,n,size,grid", [(5, 120, 100, None), (6, 150, 90, 10)])
def test_faces_over_squares(spark, seed, n, size, grid):
    """faces that lie in several squares, of which some are quartered, are those of the page as a whole."""
    df = spark.createDataFrame(page(seed, n, size, grid), SEG).repartition(3)
    laid = planar.squares(df, 25, 10)
    assert laid.filter("e = 9999").isEmpty() and (grid or laid.select("page_id", "e").distinct().count() > 2)
    cut, got = pages.split(df).collect(), planar.faces(df, 0.05, 25, 10).orderBy("page_id", "lx", "ly", "ltx", "lty").collect()
    for k in (1, 2):
        want = traced([r[2:6] for r in cut if r["page_id"] == k], 0.05)
        assert [[(p["x"], p["y"]) for p in r["points"]] for r in got if r["page_id"] == k] == want and want


def test_no_table_has_a_row_for_each_crossing(spark, tmp_path, monkeypatch):
    """every side between crossings was a row of tables that were written in each round."""

    made = []

    def path(_, name):
        made.append(f"file://{tmp_path}/{name}-{len(made)}")
        scratch._made.append(made[-1])
        return made[-1]

    df = spark.createDataFrame(page(8, 160, 100), SEG)
    crossings = pages.crossings(df).count()
    monkeypatch.setattr(scratch, "path", path)
    found = pages.faces(df, 20.0).count()
    rows = [spark.read.parquet(str(p)).count() for p in tmp_path.iterdir()]
    assert found and rows and max(rows) < crossings / 2


def walked(rows, tolerance):
    """Ends of one page's segments put to running means, one after the other."""
    nodes, ends = [], {}
    for _, k, x1, y1, x2, y2 in sorted(rows):
        own = []
        for x, y in ((x1, y1), (x2, y2)):
            near = min(((math.hypot(n[0] / n[2] - x, n[1] / n[2] - y), i) for i, n in enumerate(nodes)), default=(math.inf, 0))
            if near[0] <= tolerance:
                i = near[1]
                nodes[i] = [nodes[i][0] + x, nodes[i][1] + y, nodes[i][2] + 1]
            else:
                i = len(nodes)
                nodes.append([x, y, 1])
            own.append(i)
        ends[k] = tuple(own)
    at = [(n[0] / n[2], n[1] / n[2]) for n in nodes]
    return {k: (a, b, *at[a], *at[b]) for k, (a, b) in ends.items() if a != b}


@pytest.mark.parametrize("seed,n,size,tolerance", [(1, 60, 100, 1.25), (2, 120, 100, 4.0), (3, 80, 30, 3.0), (4, 300, 200, 2.0)])
def test_snap(spark, seed, n, size, tolerance):
    rows = page(seed, n, size)
    got = pages.snap(spark.createDataFrame(rows, SEG).repartition(4), tolerance).collect()
    for k in (1, 2):
        want = walked([r for r in rows if r[0] == k], tolerance)
        have = {r["seg_id"]: tuple(r)[2:] for r in got if r["page_id"] == k}
        assert have.keys() == want.keys()
        for s, v in want.items():
            assert have[s][:2] == v[:2] and have[s][2:] == pytest.approx(v[2:], abs=1e-9)


def test_a_page_has_many_parts(spark):
    from pyspark.sql import functions as F

    rows = page(7, 200, 2000)
    ends = spark.createDataFrame(rows, SEG).select("page_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    assert pages._parts(ends, 2.5).select("part").distinct().count() > 150


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_stroke_clusters(spark, seed):
    r = random.Random(seed)
    rows = []
    for k in range(120):
        x, y, a, n = r.uniform(0, 500), r.uniform(0, 500), math.radians(r.choice([0, 3, 45, 90])), r.uniform(10, 40)
        rows.append((1, k, x, y, x + n * math.cos(a), y + n * math.sin(a)))
    turn = lambda s: math.degrees(math.atan2(s[5] - s[3], s[4] - s[2])) % 180
    mid = lambda s: ((s[2] + s[4]) / 2, (s[3] + s[5]) / 2)
    def off(p, s):
        dx, dy = s[4] - s[2], s[5] - s[3]
        return abs(dy * (p[0] - s[2]) - dx * (p[1] - s[3])) / math.hypot(dx, dy)

    def box_gap(s, t):  # the operator looks only at boxes, widened by the distance, that meet
        lo, hi = lambda v, i: min(v[i], v[i + 2]), lambda v, i: max(v[i], v[i + 2])
        return all(lo(s, i) - 35 <= hi(t, i) + 35 and lo(t, i) - 35 <= hi(s, i) + 35 for i in (2, 3))

    of = {k: k for k in range(120)}
    for s in rows:
        for t in rows:
            if s[1] < t[1]:
                d = abs(turn(s) - turn(t)) % 180
                if min(d, 180 - d) <= 5 and off(mid(t), s) <= 35 and math.dist(mid(s), mid(t)) <= 70 and box_gap(s, t):
                    a, b = of[s[1]], of[t[1]]
                    of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
    want = {c: n for c, n in collections.Counter(of.values()).items() if n >= 5}
    got = pages.stroke_clusters(spark.createDataFrame(rows, SEG)).collect()
    assert {x["cluster"]: x["n"] for x in got} == want and want


def strokes_linked(rows, angle, distance):
    """The least id that links lead to, of each stroke of one page that has a link."""
    mid = [((s[2] + s[4]) / 2, (s[3] + s[5]) / 2) for s in rows]
    turn = [math.degrees(math.atan2(s[5] - s[3], s[4] - s[2])) % 180 for s in rows]
    of, seen = list(range(len(rows))), set()

    def root(k):
        while of[k] != k:
            of[k] = of[of[k]]
            k = of[k]
        return k

    for i, s in enumerate(rows):
        dx, dy = s[4] - s[2], s[5] - s[3]
        for j in range(i + 1, len(rows)):
            d = abs(turn[i] - turn[j])
            if math.dist(mid[i], mid[j]) <= 2 * distance and min(d, 180 - d) <= angle and abs(dy * (mid[j][0] - s[2]) - dx * (mid[j][1] - s[3])) / math.hypot(dx, dy) <= distance:
                seen |= {i, j}
                a, b = root(i), root(j)
                of[max(a, b)] = min(a, b)
    return {rows[k][1]: rows[root(k)][1] for k in seen}


def crowded(seed):
    """Bands of strokes, and few others."""
    r = random.Random(seed)
    rows = []
    for k in range(260):
        x, y, a, n = r.uniform(0, 24), r.choice([0, 40, 140]) + r.uniform(0, 5), math.radians(r.choice([0, 0.5, 178, 90])), r.uniform(10, 40)
        rows.append((1, k, x, y, x + n * math.cos(a), y + n * math.sin(a)))
    return [*rows, *[(1, 300 + k, 900.0 + 50 * k, 0.0, 930.0 + 50 * k, 40.0 * k) for k in range(3)]]


@pytest.mark.parametrize("seed", [1, 2])
def test_strokes_of_crowded_groups(spark, monkeypatch, seed):
    """all strokes of a crowded place were paired with each other; groups meet by few of them, and by all where those leave them apart."""
    edges, real = [], graph.components

    def seen(df, *by):
        edges.append(df.count())
        return real(df, *by)

    rows = crowded(seed)
    monkeypatch.setattr(graph, "components", seen)
    got = pages.cluster_members(spark.createDataFrame(rows, SEG).repartition(3)).collect()
    assert {r["seg_id"]: r["cluster"] for r in got} == strokes_linked(rows, 5.0, 35.0) and len(got) == len({r["seg_id"] for r in got})
    assert edges and sum(edges) < len(rows)


def test_groups_linked_by_strokes_within(spark):
    """none of the outermost strokes of two groups are linked, one within is."""
    middles = [(0, 10, 0), (20, 10, 0), (10, 0, 0), (10, 20, 0), (10, 19, 4), (68, 56, 0), (60, 60, 0), (73, 60, 0), (66, 70, 0)]
    turned = lambda a: (5 * math.cos(math.radians(a)), 5 * math.sin(math.radians(a)))
    rows = [(1, k, x - turned(a)[0], y - turned(a)[1], x + turned(a)[0], y + turned(a)[1]) for k, (x, y, a) in enumerate(middles)]
    for taken, n in ((rows, 1), ([r for r in rows if r[1] != 4], 2)):
        got = {r["seg_id"]: r["cluster"] for r in pages.cluster_members(spark.createDataFrame(taken, SEG)).collect()}
        assert got == strokes_linked(taken, 5.0, 35.0) and len(set(got.values())) == n and len(got) == len(taken)


@pytest.mark.parametrize("sizes", [[1], [1, 2, 3], [500, 1, 7]])
def test_rings(spark, sizes):
    r = random.Random(len(sizes))
    ids = r.sample(range(10_000), sum(sizes))
    want, steps = {}, []
    for n in sizes:
        own, ids = ids[:n], ids[n:]
        k = own.index(min(own))
        own = own[k:] + own[:k]
        want.update({v: (own[0], i) for i, v in enumerate(own)})
        steps += list(zip(own, own[1:] + own[:1]))
    got = graph.rings(spark.createDataFrame(steps, "id long, next long").repartition(3)).collect()
    assert {x["id"]: (x["ring"], x["place"]) for x in got} == want
