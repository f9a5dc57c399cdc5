"""Work that grows no faster than the tables: frames, joins and rounds whose cost or size once did."""

import pytest
from pyspark.sql import functions as F

from oracle import SF
from plumbline import scratch
from plumbline.functions import geometry, text
from plumbline.operators import elevations, fusion, graph, pages, ranges
from plumbline.plans import registry
from plumbline.sources import readers


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_frame_is_gone_through_anew_for_each_row(spark):
    """a frame up to the last row costs the square of a range's rows."""
    left = spark.createDataFrame([(1, 1, 5.0), (1, 2, 9.5), (1, 3, 2.0), (1, 4, None)], "g int, lid int, x double")
    right = spark.createDataFrame([(1, 1, 4.0), (1, 2, 6.0), (1, 3, 9.0), (1, 4, 4.0)], "g int, rid int, y double")
    got = fusion.nearest(left, right, ["g"], "x", "y", "rid")
    assert {r["lid"]: r["near_rid"] for r in got.collect()} == {1: 1, 2: 3, 3: 1, 4: None}
    rows = spark.createDataFrame([(1, k) for k in range(9)], "g int, k int")
    carried = ranges.carried(ranges.ranged(rows, ["g"], [F.col("k")]), ["g"], {"next": (F.min("k"), "first")}, after=True)
    assert all("unboundedfollowing" not in plan(df).lower() for df in (got, carried))


def test_pairs_near_in_one_measure_only_do_not_meet(spark):
    """the second measure has buckets, too, and the join is shuffled."""
    rows = spark.createDataFrame([(1, k, 100.0 + k % 3 / 10, k) for k in range(60)], "g int, id int, v double, size int")
    got = fusion.near_pairs(rows, ["g"], "id", "v", 0.005, beside=("size", 2))
    assert {(r["a_id"], r["b_id"]) for r in got.collect()} == {(a, b) for a in range(60) for b in range(a + 1, min(60, a + 3))}
    physical = got._jdf.queryExecution().sparkPlan().toString()
    assert "beside" in physical and "SortMergeJoin" in physical and "Broadcast" not in physical


def times(df, what):
    return plan(df).lower().count(what)


def test_values_of_a_row_are_computed_once(spark):
    """What branches share was an expression in each of them."""
    one = spark.createDataFrame([(s,) for s in ("1200", "12 mm", "3.5m", "99", "250m", "", None, "1e5")], "t string")
    assert times(one.select(text.dimension_m(F.col("t")).alias("m")), "regexp_replace(") == 1
    assert [r["m"] for r in one.select(text.dimension_m(F.col("t")).alias("m")).collect()] == [1.2, None, 3.5, None, None, None, None, None]
    assert times(one.select(readers.heading(F.col("t")).alias("h")), "regexp_replace(") == 1
    inner, outer = (F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p]) for p in ([(1.0, 1.0), (2.0, 1.0), (2.0, 2.0)], [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0)]))
    held = one.limit(1).select(geometry.contained(inner, outer).alias("a"), geometry.contained(outer, inner).alias("b"))
    assert [(r["a"], r["b"]) for r in held.collect()] == [(True, False)]


def test_rounds_leave_one_table_each_of_what_came_round(spark, tmp_path, monkeypatch):
    """Tables of earlier rounds added up on the disk."""
    made = []

    def path(_, name):
        made.append(f"file://{tmp_path}/{name}-{len(made)}")
        scratch._made.append(made[-1])
        return made[-1]

    monkeypatch.setattr(scratch, "path", path)
    got = graph.rings(spark.range(64).select("id", ((F.col("id") + 8) % 64).alias("next")))
    assert got.groupBy("ring").count().filter("count = 8").count() == 8
    there, read = {p.name for p in tmp_path.iterdir()}, {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    assert read and there == read and len(made) > 2 * len(read)


def test_strokes_meet_by_their_middles(spark):
    """long strokes met in every cell that their boxes touch."""
    strokes = spark.createDataFrame([(1, k, 0.0, 30.0 * k, 5000.0, 30.0 * k) for k in range(4)] + [(1, 9, 9000.0, 0.0, 9100.0, 0.0)], "page_id long, seg_id long, x1 double, y1 double, x2 double, y2 double")
    got = pages.cluster_members(strokes)
    assert {(r["seg_id"], r["cluster"]) for r in got.collect()} == {(k, 0) for k in range(4)}


def test_marks_at_one_place_meet_once(spark):
    """of marks at one place the first word alone counts, and is the only one that meets rectangles."""
    rects = spark.createDataFrame([(1, 1, 0.0, 0.0, 20.0, 40.0, None)], "page_id long, rect_id long, x0 double, y0 double, x1 double, y1 double, coord_space string")
    words = spark.createDataFrame([(1, k, f"D{k}", 22.0, 20.0) for k in (7, 5, 6)], "page_id long, word_id long, text string, x double, y double")
    scales = spark.createDataFrame([(1, "page", 20.0)], "page_id long, coord_space string, units_per_m double")
    got = elevations.elevation_openings(rects, words, scales)
    assert [r["label"] for r in got.collect()] == ["D5"]
    assert "share" in plan(got) and "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["q_scene_graph", "q_unit_boundaries", "q_rooms_from_segments"])
def test_the_driver_gets_no_side_of_a_join(spark, name):
    """sides that grow with the tables were broadcast by their guessed size."""
    physical = registry.QUERIES[name](spark, str(SF))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in physical or name == "q_scene_graph"
    assert "Broadcast" not in physical


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["q_descriptions", "q_room_labels"])
def test_rows_laid_out_of_one_are_not_shuffled(spark, name):
    """rows are dealt before they are made of a page, not each of them after."""
    physical = registry.QUERIES[name](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange ") == 1 and "Exchange hashpartitioning(o_orderkey" in physical


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
def test_the_join_of_wall_pairs_is_compiled(spark):
    """the JVM compiles no method of more than 8,000 bytes; the join's had 8,735."""
    import contextlib
    import io
    import re

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        said = io.StringIO()
        with contextlib.redirect_stdout(said):
            registry.QUERIES["q_wall_pairs"](spark, str(SF)).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", said.getvalue()))) < 8000


def test_what_only_counts_signals_does_not_sort_them(spark):
    """the check before publishing sorted all signals by range, with a sample, and made each row's rules twice."""
    from plumbline.operators import gates
    from plumbline.plans import natural

    rows = natural.rows(spark, str(SF))
    assert "sort [" not in plan(gates.preflight(rows, gates.found_signals(rows))).lower()
    ordered = gates.publish(spark.createDataFrame([], "job string, fingerprint string"), rows, gates.preflight(rows, gates.found_signals(rows)), "J")
    assert "sort [" not in plan(ordered).lower()
    assert "size(" not in plan(gates.row_signals(rows)).lower()
    assert gates.found_signals(rows).exceptAll(gates.signals(rows)).isEmpty()


def test_an_overlap_copies_rows_by_levels_that_are_worth_it(spark):
    """a row was copied for each level above its own on one side of the join, for a few long intervals."""
    rows = [(k % 3, k, float(k * 7 % 500), float(k * 7 % 500 + (300 if k % 50 == 0 else 4))) for k in range(400)]
    df = spark.createDataFrame(rows, "g int, id int, low double, high double")
    got = fusion.overlapping(df, ["g"], "id", "low", "high", 30)
    want = sorted((a, b) for g, a, low, high in rows for h, b, at, end in rows if g == h and a < b and low <= end and at <= high)
    assert sorted((r["a_id"], r["b_id"]) for r in got.collect()) == want
    assert fusion._worth_a_copy({0: 392, 4: 8}) == [0]
    assert fusion._worth_a_copy({0: 392, 7: 8}) == [0, 7] and fusion._worth_a_copy({}) == [0]
    assert fusion._worth_a_copy({0: 100, 1: 100, 2: 1, 3: 100}) == [0, 2]


def test_rounds_of_components_see_only_what_is_left(spark, monkeypatch):
    """each round went over all edges both ways, and its tables stayed."""
    edges = [(o, 1000 + (o * k) % 7) for o in range(60) for k in (1, 3)] + [(70, 71), (72, 71), (72, 73), (5000, 5000), (6000, None)]
    sizes, real = [], graph.removed

    def seen(session, at):
        table = session.read.parquet(at)
        if table.columns == ["node", "other"]:
            sizes.append(table.count())
        real(session, at)

    monkeypatch.setattr(graph, "removed", seen)
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    want, nodes = {}, {n for a, b in edges if b is not None for n in (a, b)}
    for n in sorted(nodes):
        reached, new = set(), {n}
        while new:
            reached |= new
            new = {y for e in edges if None not in e and reached & set(e) for y in e} - reached
        want[n] = min(reached)
    assert {r["node"]: r["component"] for r in got} == want and len(got) == len(nodes)
    assert sizes == sorted(set(sizes), reverse=True) and sizes[-1] == 0


def test_a_page_searches_for_its_nearest_dimension_once(spark):
    """the search was said six times for each side, and the sixteen choices of a page were an array written and read again by each round."""
    from plumbline.operators import registration

    df = spark.createDataFrame([([3.0, 7.0], 6.5, [90, 90, 40, 95])], "c array<double>, w double, s array<int>")
    got = df.select(registration.width_match(F.col("w"), F.col("c")).alias("m"), registration._choices(F.col("s")).alias("choices"))
    assert times(got, "array_min") == 1 and got.schema["choices"].dataType.simpleString() == "bigint"
    r = got.first()
    assert (r["m"]["dimension_m"], r["m"]["confidence"]) == (7.0, 38)
    scores = [90, 90, 40, 95]
    best = lambda used: max(range(4), key=lambda k: (scores[k] - 8 * (used >> k & 1), -k))
    assert [r["choices"] >> 2 * used & 3 for used in range(16)] == [best(used) for used in range(16)]


def test_of_one_id_rows_are_gone_through_once(spark):
    """the row that stands and the ledger of the others each summed and sorted all rows anew, for every reader."""
    from plumbline.operators import model

    rows = spark.createDataFrame([(1, "a", 2.0, [1]), (1, "a", 1.0, [3]), (1, "a", 1.0, [2]), (1, "b", None, [9])], "workspace_id long, id string, x double, l array<int>")
    stands, again = model._once(rows, ["workspace_id", "id"], "OPENING", "id")
    assert stands.columns == rows.columns
    assert {(r["id"], r["x"], *r["l"]) for r in stands.collect()} == {("a", 1.0, 2), ("b", None, 9)}
    assert [r["id"] for r in again.collect()] == ["a", "a"]
    assert all("aggregate" not in plan(df).lower() for df in (stands, again))


def test_outlines_within_a_square_go_through_no_rounds(spark, monkeypatch):
    """every side of every outline was numbered, and went through all rounds."""
    import numpy as np

    from plumbline.operators import raster

    drawn = {k: np.where(np.random.default_rng(k).random((12, 13)) < 0.2 * k, 0, 255).astype(np.uint8) for k in (1, 2, 3, 4)}
    given = spark.createDataFrame([(k, *g.shape, 1, bytearray(g.tobytes())) for k, g in drawn.items()], "page_id long, height int, width int, channels int, data binary")
    seen, real = [], graph.rings

    def counted(steps):
        seen.append(steps.count())
        return real(steps)

    monkeypatch.setattr(graph, "rings", counted)
    shape = lambda r: (r["page_id"], r["component"], r["ring"], r["area"], r["length"], r["centre_area"], r["x0"], r["y0"], r["x1"], r["y1"], r["points"])
    for diagonal in (True, False):
        marked = raster.labelled(raster.runs(raster.tiles(given, 16), F.lit(128), 16, diagonal=diagonal), 16, diagonal)
        whole = sorted(map(shape, raster.outlines(marked, diagonal).collect()))
        assert whole and not seen
        # In squares of five pixels pieces are put together.
        assert sorted(map(shape, raster.outlines(marked, diagonal, size=5).collect())) == whole
        assert seen.pop() > 0
        if not diagonal:
            continue
        # The sides of all rings are those that cracks() lists one by one.
        sides = graph.cut(raster.cracks(marked))
        steps = sides.join(real(sides.select("id", "next")), "id").groupBy("page_id", "component", "ring").agg(F.sum(F.abs(F.col("tx") - F.col("x")) + F.abs(F.col("ty") - F.col("y"))).alias("length"))
        assert sorted((r["page_id"], r["component"], r["length"]) for r in steps.collect()) == sorted((r[0], r[1], r[4]) for r in whole)


def test_shares_are_summed_as_rows_pass(spark):
    """sums were joined to the rows they were taken of, so that a task sorted them twice, and its rows grew with the table."""
    df = spark.createDataFrame([("a", 1.0, 90.0), ("a", 2.0, 90.0), (None, 3.0, 7.0), ("b", None, 5.0), ("c", None, 5.0), ("c", 4.0, 6.0)], "k string, w double, t double")
    got = fusion.allocate(df, ["k"], "w", "t", "s")
    assert sorted((r["k"], r["s"]) for r in got.filter("w is not null").collect()) == [("a", 30.0), ("a", 60.0), ("c", 6.0)]
    assert {(r["k"], r["s"]) for r in got.filter("w is null").collect()} == {("b", 5.0), ("c", None)}
    assert "join" not in plan(got).lower()


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
def test_lines_are_dealt_by_the_size_of_their_table(spark):
    """Spark put a task's rows together up to a size of its own, more of them for a larger table."""
    physical = registry.QUERIES["q_allocate_proportional"](spark, str(SF))._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange ") == 2 and "REPARTITION_BY_NUM" in physical and "SortMergeJoin" in physical
