"""Scans over ranges of a key, and elevation pages registered in order, against plain Python; one key has most rows."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import fusion, ranges, registration


@pytest.fixture
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def hot(seed, n=900):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 1, 2, None]), k, round(r.uniform(1, 400), 1)) for k in range(n)]


def test_a_key_lies_in_many_ranges(many_ranges):
    df = many_ranges.createDataFrame(hot(1), "g int, id int, v double")
    parts = ranges.ranged(df, ["g"], [F.col("v")]).filter("g = 1").select(ranges.PART).distinct().count()
    assert parts >= 4


@pytest.mark.parametrize("gap", [0.0, 0.4, 5.0])
def test_merge_intervals(many_ranges, gap):
    r = random.Random(3)
    rows = [(g, v, v + r.choice([0.0, 0.1, 3.0, 60.0 * (k % 50 == 0)])) for k, (g, _, v) in enumerate(hot(2))]
    got = sorted(map(tuple, fusion.merge_intervals(many_ranges.createDataFrame(rows, "g int, lo double, hi double"), ["g"], "lo", "hi", gap).collect()), key=str)
    want = []
    for g in (None, 1, 2):
        island = None
        for lo, hi in sorted((a, b) for k, a, b in rows if k == g):
            if island and lo - island[2] <= gap:
                island[2], island[3] = max(island[2], hi), island[3] + 1
            else:
                island = [g, lo, hi, 1]
                want.append(island)
    assert got == sorted(map(tuple, want), key=str)


def test_superseded(many_ranges):
    rows = [(g, k, int(v)) for g, k, v in hot(4)]
    got = fusion.superseded(many_ranges.createDataFrame(rows, "g int, id int, v int"), ["g"], [F.desc("v"), F.desc("id")], "id").collect()
    for g in (None, 1, 2):
        order = sorted(((v, k) for key, k, v in rows if key == g), reverse=True)
        want = {k: (n + 1, n == 0, None if n == 0 else order[0][1]) for n, (_, k) in enumerate(order)}
        assert {r["id"]: (r["rank_in_key"], r["is_current"], r["superseded_by"]) for r in got if r["g"] == g} == want


def test_consensus(many_ranges):
    rows = [(g or 3, v, float(k % 5)) for g, k, v in hot(5)]
    got = {r["g"]: r for r in fusion.consensus(many_ranges.createDataFrame(rows, "g int, v double, w double"), ["g"], "v", "w", 0.07).collect()}
    for g in (1, 2, 3):
        own = [(v, w) for key, v, w in rows if key == g]
        near = lambda b: [(v, w) for v, w in own if abs(v - b) <= 0.07 * b]  # noqa: B023, E731
        best = min({v for v, _ in own}, key=lambda b: (-sum(w for _, w in near(b)), b))
        cluster = near(best)
        solved = sum(v * w for v, w in cluster) / sum(w for _, w in cluster)
        assert (got[g]["base"], got[g]["n"], got[g]["weight"]) == (best, len(cluster), sum(w for _, w in cluster))
        assert got[g]["solved"] == pytest.approx(solved) and got[g]["spread"] == pytest.approx(max(abs(v - solved) for v, _ in cluster) / solved)


def test_nearest(many_ranges):
    r = random.Random(6)
    odd = lambda v: r.choice([v] * 8 + [None, float("nan")])
    lefts, rights = [(g, k, odd(v)) for g, k, v in hot(7, 300) if g], [(g, k, odd(v)) for g, k, v in hot(8, 300) if g]
    left, right = many_ranges.createDataFrame(lefts, "g int, lid int, x double"), many_ranges.createDataFrame(rights, "g int, rid int, y double")
    got = {x["lid"]: x["near_rid"] for x in fusion.nearest(left, right, ["g"], "x", "y", "rid").collect()}
    real = lambda v: v is not None and v == v
    assert got == {k: min(((abs(y - x), y, n) for h, n, y in rights if h == g and real(y)), default=(0, 0, None))[2] if real(x) else None for g, k, x in lefts}
    assert fusion.nearest(many_ranges.createDataFrame([(1, 1, 5.0)], "g int, lid int, x double"), many_ranges.createDataFrame([(1, 1, 6.0), (1, 2, None)], "g int, rid int, y double"), ["g"], "x", "y", "rid").first()["near_rid"] == 1


def walked(pages, widths):
    out, used = {}, set()
    for page_no, page, named, cands in sorted(pages, key=lambda p: (p[0], p[1])):
        scored = []
        for side in [named] if named else registration.SIDES:
            w, valid = widths.get(side, 0.0), [c for c in cands or [] if 0.25 <= c <= 150]
            if w > 0 and valid:
                best = min(valid, key=lambda c: abs(c - w))
                pct = abs(best - w) / w * 100
                sure = max(0, min(100, round(100 - pct * 8)))
                match = (round(best, 4), round(pct, 3))
            else:
                sure, match = 0, (None, None)
            scored.append((sure + 80 * (named == side) - 8 * (side in used and not named), side, match))
        _, side, (d, pct) = sorted(scored, key=lambda s: -s[0])[0]
        used.add(side)
        status = ("Verified cross-view" if pct is not None and pct <= 2 else "Orientation identified; width needs review") if named else "Probable width match; orientation needs review" if pct is not None and pct <= 2 else "Needs estimator registration"
        sure = ("Verified" if pct is not None and pct <= 2 else "High" if pct is None or pct <= 5 else "Review") if named else "Review"
        out[page] = (side, bool(named), d, pct, status, sure)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_register_sides(spark, seed):
    r = random.Random(seed)
    pages, widths = {}, {}
    for ws in (1, 2, None, 4):
        widths[ws] = {s: round(r.uniform(5, 12), 1) for s in registration.SIDES if r.random() < 0.8} if ws != 4 else {}
        pages[ws] = [(r.randrange(6), 100 * (ws or 9) + k, r.choice([None] * 4 + list(registration.SIDES)), r.choice([None, [], [0.1], [round(r.uniform(5, 12), 1) for _ in range(3)]])) for k in range(r.choice([1, 6, 12]))]
    p = spark.createDataFrame([(ws, page, no, side, c) for ws, ps in pages.items() for no, page, side, c in ps], "workspace_id int, page_id int, page_no int, orientation string, candidates array<double>")
    f = spark.createDataFrame([(ws, s, w) for ws, each in widths.items() for s, w in each.items()], "workspace_id int, side string, projected_width_m double")
    got = {x["page_id"]: (x["orientation"], x["orientation_explicit"], x["elevation_dimension_m"], x["difference_pct"], x["status"], x["confidence"]) for x in registration.register_sides(p, f).collect()}
    assert got == {k: v for ws, ps in pages.items() for k, v in walked(ps, widths[ws]).items()}


def test_more_pages_than_sides(spark):
    p = spark.createDataFrame([(1, k, k, None, [8.0]) for k in range(6)], "workspace_id int, page_id int, page_no int, orientation string, candidates array<double>")
    f = spark.createDataFrame([(1, s, 8.0) for s in registration.SIDES], "workspace_id int, side string, projected_width_m double")
    assert [x["orientation"] for x in registration.register_sides(p, f).orderBy("page_id").collect()] == ["North", "East", "South", "West", "North", "North"]
