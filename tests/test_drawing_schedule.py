"""Files, drawings and schedules: what the queries over the tables can't show."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline import scratch
from plumbline.functions import geometry, text
from plumbline.operators import drawing, fusion, openings
from plumbline.sources import readers, writers


def workbook(sheets):
    """A small xlsx file: shared and inline strings, numbers, gaps."""
    out, shared = io.BytesIO(), []
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(out, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>{names}</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="{"/xl/" if k == 2 else ""}worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1)) + "</Relationships>")
        for k, rows in enumerate(sheets.values(), 1):
            lines = []
            for n, row in rows:
                cells = []
                for at, v in row.items():
                    if isinstance(v, str) and k == 1:
                        shared.append(v)
                        cells.append(f'<c r="{at}{n}" t="s"><v>{len(shared) - 1}</v></c>')
                    elif isinstance(v, str):
                        cells.append(f'<c r="{at}{n}" t="inlineStr"><is><t>{v}</t></is></c>')
                    else:
                        cells.append(f'<c r="{at}{n}"><v>{v}</v></c>' if v is not None else f'<c r="{at}{n}"/>')
                lines.append(f'<row r="{n}">{"".join(cells)}</row>')
            z.writestr(f"xl/worksheets/s{k}.xml", f"<worksheet {ns}><sheetData>{''.join(lines)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook({"Take-off": [(1, {"A": "Job"}), (3, {"A": "Item", "B": "Qty", "D": "$ / m2", "AA": "Notes"}), (4, {"A": "Walls", "B": 12.5, "D": 30, "AA": "x"})], "Other": [(1, {"B": "b"})]}))
    got = {(r["sheet"], r["line"]): r["cells"] for r in readers.workbooks(spark, str(tmp_path)).collect()}
    assert got["Take-off", 3][:4] == ["Item", "Qty", "", "$ / m2"] and got["Take-off", 3][26] == "Notes" and got["Other", 1] == ["", "b"] and len(got) == 4
    rows = readers.takeoff_rows(readers.workbooks(spark, str(tmp_path)).filter("sheet = 'Take-off'").drop("sheet")).collect()
    assert [(r["element"], r["quantity"], r["rate_per_unit"], r["notes"]) for r in rows] == [("Walls", 12.5, 30.0, "x")]


def test_csv_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"two\nlines, and ""quotes""",c\n\n1,2,3,4,5\n')
    assert [r["cells"] for r in readers.sheets(spark, f"{tmp_path}/a.csv").orderBy("line").collect()] == [["a", 'two\nlines, and "quotes"', "c"], ["1", "2", "3", "4", "5"]]
    with pytest.raises(Exception, match="more than 3 columns"):
        readers.sheets(spark, f"{tmp_path}/a.csv", columns=3).collect()


def test_placeholders():
    assert readers.placeholders("select '?', \"a\" from t where a = ? and b = ?") == "select '?', \"a\" from t where a = %s and b = %s"


def test_swap_survives_a_crash(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "id long")
    rows(1, 2).write.parquet(path)
    (tmp_path / "t").rename(tmp_path / "t__old")  # a crash after the old table was moved aside
    writers.upsert(spark, path, rows(3), ["id"]) if writers.recover(spark, path) else None
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    (tmp_path / "t__old").mkdir()  # a crash after the new one was put in place
    assert not writers.recover(spark, path) and not (tmp_path / "t__old").exists()
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == ["t"]


def test_published_once(spark, tmp_path):
    rows = spark.createDataFrame([(1,), (2,)], "id long")
    assert [writers.publish_once(spark, f"{tmp_path}/p", rows, j, f) for j, f in (("a", "x"), ("a", "x"), ("a", "y"), ("b", "x"))] == [True, False, True, True]
    assert spark.read.parquet(f"{tmp_path}/p/publication=*").count() == 6
    import hashlib

    name = hashlib.sha256(b"c/x").hexdigest()[:32]
    for left in ("_locks", "_new"):  # what a crash may have left behind stops nobody
        (tmp_path / "p" / left / name).mkdir(parents=True, exist_ok=True)
    assert writers.publish_once(spark, f"{tmp_path}/p", rows, "c", "x")
    assert spark.read.option("basePath", f"{tmp_path}/p").parquet(f"{tmp_path}/p/publication=*").filter("job = 'c'").count() == 2


def test_published_once_of_two_at_a_time(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    rows = spark.range(5)
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda _: writers.publish_once(spark, f"{tmp_path}/p", rows, "a", "x"), range(4)))
    assert sorted(done) == [False, False, False, True] and spark.read.parquet(f"{tmp_path}/p/publication=*").count() == 5
    assert not list((tmp_path / "p" / "_new").iterdir())


def test_ensured_tables(spark, tmp_path):
    assert writers.ensure(spark, str(tmp_path), {"a": "id long", "b": "x string"}) == ["a", "b"] and writers.ensure(spark, str(tmp_path), {"a": "id long"}) == []
    assert spark.read.parquet(f"{tmp_path}/b").columns == ["x"]


def test_numbered(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "v long").repartition(3)
    assert sorted((r["v"], r["number"]) for r in scratch.numbered(df, [F.col("v")]).collect()) == [(1, 1), (3, 2), (5, 3), (9, 4)]
    assert scratch.numbered(df.filter("false"), [F.col("v")]).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_of_any_length(spark, seed):
    import random

    r = random.Random(seed)
    rows = [(r.randint(1, 2), k, float(a := r.choice([r.uniform(-50, 50), r.randint(-3, 3)])), a + r.choice([0.0, 1.0, 7.0, 1000.0, 10.0 ** r.randint(0, 6)])) for k in range(80)]
    df = spark.createDataFrame(rows, "g long, id long, lo double, hi double")
    got = [(x["g"], x["a_id"], x["b_id"]) for x in fusion.overlapping(df, ["g"], "id", "lo", "hi", 1.0).collect()]
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] <= b[3] and b[2] <= a[3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_mutual_unique_best(spark):
    rows = [(1, 1, 5.0), (1, 2, 5.0), (2, 1, 3.0), (3, 3, 9.0), (3, 4, 1.0), (4, 3, 8.0), (5, 5, None)]
    assert [tuple(x) for x in fusion.mutual_unique_best(spark.createDataFrame(rows, "a long, b long, s double"), "a", "b", "s").collect()] == [(3, 3, 9.0)]


def test_fingerprint_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (2, "b", 1), (3, None, 2)], "id long, v string, g long")
    of = lambda d: {r["g"]: (r["fingerprint"], r["n_rows"]) for r in fusion.fingerprint(d, ["v"], ["id"], ["g"]).collect()}
    assert of(df) == of(df.orderBy(F.desc("id")).repartition(3)) and of(df) != of(df.dropDuplicates())


def test_json_objects(spark):
    rows = [('a {b} {"x": {"y": 1}} {"x": 2}',), ("{}",), ("{",), ("none",), (None,), ('{"s": "}{"} tail',)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(text.json_object(F.col("t"))).collect()]
    assert got == ['{"x":{"y":1}}', "{}", None, None, None, '{"s":"}{"}']


def test_duplicates_with_types_and_walls(spark):
    schema = "opening_instance_id long, type_mark string, wall_ref string, level string, opening_type string, position_along_wall_m double, width_m double, height_m double, dimension_basis string, dimension_source string, geometry_confidence double, dimension_confidence double, association_confidence double, source string, plan_geometry_signature string"
    row = lambda i, wall, kind, at, sig=None: (i, "", wall, "", kind, at, 0.9, 2.1, "rough_opening", "plan", 0.95, 0.95, 0.95, "plan", sig)
    rows = [row(1, "A", "door", 1.0), row(2, "A", "window", 1.1), row(3, "A", "opening", 5.0), row(4, "A", "door", 5.1), row(5, "B", "door", 1.0, "g"), row(6, "C", "door", 9.0, "g")]
    got = {r["opening_instance_id"]: (r["physical_conflicts"], r["deduction_status"], r["opening_type"]) for r in openings.physical_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (["conflicting_types"], "review", "door"), 2: (["conflicting_types"], "review", "window"), 3: (None, "auto_eligible", "door"), 5: (["wall_association_conflict"], "review", "door"), 6: (["wall_association_conflict"], "review", "door")}


def test_contained_sees_edges_that_leave(spark):
    at = lambda *p: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])
    notched = at((0, 0), (10, 0), (10, 10), (6, 10), (6, 2), (4, 2), (4, 10), (0, 10))
    got = spark.range(1).select(geometry.contained(at((1, 1), (9, 1), (9, 1.5), (1, 1.5)), notched), geometry.contained(at((1, 5), (9, 5), (9, 6), (1, 6)), notched)).first()
    assert tuple(got) == (True, False)


def test_room_phrases_are_taken_from_the_left(spark):
    words = [(1, k, t, x, 0.0, x + 10.0, 10.0) for k, (t, x) in enumerate([("Master", 0.0), ("Bed", 12.0), ("Room", 24.0), ("WC", 200.0)])]
    df = spark.createDataFrame(words, "page_id long, word_id long, text string, x0 double, y0 double, x1 double, y1 double")
    got = drawing.room_labels(df, ["master", "bed", "wc"], ["master bed", "bed room"])
    assert sorted((r["label"], r["x"], r["confidence"]) for r in got.collect()) == [("Master Bed", 11.0, 0.95), ("WC", 205.0, 0.85)]
    assert drawing.room_labels(df.filter("false"), ["wc"], []).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_nearest_across_ranges(spark, seed):
    """One large key lies in several ranges; some ranges have no right row of it."""
    import random

    r = random.Random(seed)
    left = [(r.choice([1, 1, 1, 2, None]), k, r.uniform(0, 100)) for k in range(200)]
    right = [(r.choice([1, 1, 2, 3]), 1000 + k, r.choice([r.uniform(0, 10), r.uniform(90, 100), 50.0])) for k in range(20)]
    a = spark.createDataFrame(left, "g long, id long, v double")
    b = spark.createDataFrame(right, "g long, rid long, w double")
    got = {x["id"]: x["near_rid"] for x in fusion.nearest(a, b, ["g"], "v", "w", "rid").collect()}
    want = {k: min(((abs(w - v), w, i) for h, i, w in right if h == g), default=(0, 0, None))[2] for g, k, v in left}
    assert got == want
