import pytest
from pyspark.sql import functions as F

from plumbline.functions import text


def run(spark, function, values, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["o"] for r in df.select("k", function(F.col("v")).alias("o")).orderBy("k").collect()]


CASES = [
    (text.level, ["Ground Floor", "lower ground", "LVL 3", "second floor", "3rd floor", "Basement", "B2 carpark", "roof deck", "mezz", "shed", None], ["Ground", "Lower Ground", "Level 3", "Level 2", "Level 3", "Basement 1", "Basement 2", "Roof", "Mezzanine", "Unassigned", "Unassigned"]),
    (text.scope, ["Unit 12, Level 2", "Block A ground", "hall"], ["Unit 12 | Level 2", "Block A | Ground", "Unassigned"]),
    (text.unit, ["m2", "SQM", "lin m", "each", "ltr", "Items", "allow", "pair", "", None], ["m²", "m²", "lm", "No.", "L", "item", "allowance", "Pair", "", ""]),
    (text.quantity, ["12.5 m2"[:4], "$1,200.50", "", None, "n/a"], [12.5, 1200.5, 0.0, 0.0, 0.0]),
    (text.scale_ratio, ["SCALE 1:100 @ A1", "1/50", "1 : 20000", "none", None], [100, 50, None, None, None]),
    (text.sheet_number, ["A-101 Floor Plan", "wd 204b x", "Cover sheet", None], ["A-101", "WD204B", "COVER", "UNKNOWN"]),
    (text.dimension_m, ["3600", "1200 mm", "3.6m", "45", "0.01m", "x"], [3.6, 1.2, 3.6, None, None, None]),
    (text.finish_codes, ["PT1 and pt-02, PT1", None], [["PT-02", "PT1"], []]),
    (text.opening_kind, ["D01", "iw12", "W12a", "room"], ["door", "window", None, None]),
    (text.opening_mark, ["Door ed12 glazed", "WD3", "II", None], ["ED12", "WD3", None, None]),
    (text.heading_basis, ["Rough Opening Width", "RO ht", "Frame size", "leaf height", "Clear opening", "Width"], ["rough_opening", "rough_opening", "frame", "leaf", "clear_opening", None]),
    (text.single_dimension_mm, ["900mm", "2.1 m", "1,200", "99", "x", None], [900, 2100, 1200, None, None, None]),
    (text.clean_id, [" W1 ", "None", "nan", ""], ["W1", None, None, None]),
]


@pytest.mark.parametrize("function,values,wanted", CASES, ids=[c[0].__name__ for c in CASES])
def test_extraction(spark, function, values, wanted):
    assert run(spark, function, values) == wanted


def test_revision(spark):
    got = run(spark, text.revision, ["Plan Rev B", "A101_02.pdf", "Rev C2", "plan", None])
    assert [tuple(x) for x in got] == [("B", 2), ("02", 2), ("C2", 1), ("0", 0), ("0", 0)]


def test_levels_sort(spark):
    names = ["Roof", "Level 10", "Level 2", "Ground", "Basement 2", "Basement 1", "Lower Ground", "Mezzanine", "Unassigned"]
    ranks = run(spark, text.level_rank, names)
    assert [n for _, n in sorted(zip(ranks, names))] == ["Basement 1", "Basement 2", "Lower Ground", "Ground", "Mezzanine", "Level 2", "Level 10", "Roof", "Unassigned"]


def test_dimension_pair(spark):
    got = run(spark, text.dimension_pair_mm, ["900 x 2100", "0.9m x 2.1m", "820/2040", "hello"])
    assert [x and tuple(x) for x in got] == [(900, 2100), (900, 2100), (820, 2040), None]
