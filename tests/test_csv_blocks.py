"""CSV files read in small blocks against a reader that takes a file whole."""

import csv
import io
import random

import pytest

from plumbline.sources import readers


@pytest.fixture
def small_blocks(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def whole(text):
    csv.field_size_limit(1 << 30)
    rows = [[c.strip() for c in r] for r in csv.reader(io.StringIO(text.replace("\r\n", "\n"), newline=""), skipinitialspace=True) if r]
    for r in rows:
        while r and not r[-1]:
            r.pop()
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cells_over_blocks(small_blocks, tmp_path, seed):
    r = random.Random(seed)
    cell = lambda: r.choice(["", "a", "12 m", 'say "x"', "b,c", "two\nlines", "long\n" * 40, 'odd"', "é漢", '"', "\n", "x\r\ny", " z "])
    texts = {}
    for name in ("a", "b"):
        out = io.StringIO(newline="")
        csv.writer(out, lineterminator=r.choice(["\n", "\r\n"])).writerows([[cell() for _ in range(r.randrange(1, 6))] for _ in range(80)])
        texts[name] = out.getvalue() + r.choice(["", '5" pipe,as it is\n', 'last,"open'])
        (tmp_path / f"{name}.csv").write_text(texts[name], newline="")
    got = readers.sheets(small_blocks, f"{tmp_path}/*.csv").orderBy("file", "line").collect()
    for name, text in texts.items():
        mine = [list(x["cells"]) for x in got if x["file"].endswith(f"{name}.csv")]
        assert mine == whole(text)
    raw = small_blocks.read.option("lineSep", "\n").text(f"{tmp_path}/a.csv")
    assert raw.rdd.getNumPartitions() > 10


def test_cells_of_one_block(spark, tmp_path):
    text = 'Item,Qty\n"a ""b""\nc",2\n' + '"' + "y" * 300_000 + '",3\n'
    (tmp_path / "c.csv").write_text(text)
    assert [list(x["cells"]) for x in readers.sheets(spark, str(tmp_path)).orderBy("line").collect()] == whole(text)
