"""Near duplicates by SimHash, compared exactly in tiles.

Fingerprints are told apart first: copies of a text, and texts that agree in their fingerprint, are one class from
then on. Classes are dealt into tiles by a hash, and every pair of tiles is compared by exclusive-or and bit counts
in numpy. Within a pair of tiles the fingerprints are grouped by their population counts, whole or by 16-bit words:
the counts of two fingerprints can't differ by more, in sum, than the fingerprints do in bits, so groups whose counts
differ beyond the radius are skipped. A pair of tiles gives a spanning forest of its links, never the links
themselves, so a large group of near copies costs no more rows than it has members; forests are then joined to
components.

Each class goes to as many tasks as there are tiles. Tiles grow with the table up to MOST_TILE classes, so there are
24 until then; beyond, work is quadratic in the number of different fingerprints, as the method is.

Defined results: texts without words, null ones too, have the fingerprint zero and are linked like others; a null
doc_id is never a component's id unless the component has no other; repeated rows are members of their own; an empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import stars
from .shared import small_batches, table, written

RADIUS = 3
SHINGLE = 3
SEED = 42
LEAST_TILE, MOST_TILE, TILES = 16_384, 500_000, 24
CHUNK = 1 << 21  # comparisons at a time
FINE = 40_000  # tiles beyond this size are grouped by the counts of four words, smaller ones by the whole count


def fingerprint(text: str) -> int:
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # both know ASCII letters and white space only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)], strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        part = h[k : k + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([_signed(fingerprint(x)) for x in s], dtype="int64")


def fingerprint_of(text) -> F.Column:
    return _fingerprints(F.coalesce(text, F.lit("")))


class Forest:
    """Union of numbered members by pairs in bulk; every root is the smallest of its tree."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.roots(i), self.roots(j)
            m = a != b
            if not m.any():
                return
            np.minimum.at(self.up, np.maximum(a[m], b[m]), np.minimum(a[m], b[m]))
            i, j = i[m], j[m]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        r = self.roots(np.arange(len(self.up)))
        inner = np.flatnonzero(r != np.arange(len(r)))
        return inner, r[inner]


def _cells(x: np.ndarray, words: int) -> tuple[np.ndarray, dict[tuple, tuple[int, int]]]:
    """An order of x that brings equal population counts together, and where each lies in it."""
    if words == 1:
        counts = np.bitwise_count(x)[:, None]
    else:
        counts = np.bitwise_count(np.ascontiguousarray(x).view(np.uint16).reshape(-1, 4))
    order = np.lexsort(counts.T)
    counts = counts[order]
    cut = np.concatenate([[0], np.flatnonzero((counts[1:] != counts[:-1]).any(axis=1)) + 1, [len(x)]]) if len(x) else np.array([0])
    return order, {tuple(map(int, counts[a])): (int(a), int(b)) for a, b in zip(cut[:-1], cut[1:], strict=True)}


def links(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as two arrays of fingerprints, of the pairs of a and b (None: of a itself) within RADIUS."""
    own = b is None
    b = a if own else b
    words = 4 if min(len(a), len(b)) > FINE else 1
    order_a, cells_a = _cells(a, words)
    order_b, cells_b = (order_a, cells_a) if own else _cells(b, words)
    sa, sb = a[order_a], b[order_b]
    forest = Forest(len(a) if own else len(a) + len(b))
    shift = 0 if own else len(a)
    ball = [d for d in product(range(-RADIUS, RADIUS + 1), repeat=words) if sum(map(abs, d)) <= RADIUS]
    for key, (lo, hi) in cells_a.items():
        near = [cells_b[k] for d in ball if (k := tuple(x + y for x, y in zip(key, d, strict=True))) in cells_b and (not own or k >= key)]
        if not near:
            continue
        at = np.concatenate([np.arange(x, y) for x, y in near])
        others = sb[at]
        step = max(1, CHUNK // len(others))
        for k in range(lo, hi, step):
            i, j = np.nonzero(np.bitwise_count(sa[k : min(hi, k + step), None] ^ others[None, :]) <= RADIUS)
            i, j = order_a[k + i], order_b[at[j]] + shift
            m = i != j
            forest.join(i[m], j[m])
    x, y = forest.edges()
    everything = a if own else np.concatenate([a, b])
    return everything[x], everything[y]


def _pack(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"tile": [rows["tile"].iloc[0]], "data": [rows["fp"].to_numpy(np.int64).tobytes()]})


def _compare(rows: pd.DataFrame) -> pd.DataFrame:
    parts = [np.frombuffer(x, np.uint64) for x in rows["data"]]
    x, y = links(parts[0], parts[1] if len(parts) > 1 else None)
    return pd.DataFrame({"a": x.view(np.int64), "b": y.view(np.int64)})


def link_forest(classes: DataFrame, n: int) -> DataFrame:
    """(a, b) fingerprints: forests whose union has the components of all links. classes: (fp), n of them."""
    tiles = -(-n // max(LEAST_TILE, min(MOST_TILE, -(-n // TILES)))) or 1
    packed = classes.select("fp", F.pmod(F.xxhash64("fp"), F.lit(tiles)).cast("int").alias("tile")).groupBy("tile").applyInPandas(_pack, "tile int, data binary")
    packed = written(packed, "tiles")
    other = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("other")
    dealt = packed.select("tile", "data", other).select(F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "data")
    return dealt.groupBy("x", "y").applyInPandas(_compare, "a long, b long")


def classes_of(prints: DataFrame) -> DataFrame:
    """(fp, first, component) of every fingerprint; prints: (fp, key), the least key of a component names it."""
    classes = written(prints.groupBy("fp").agg(F.min("key").alias("first")), "classes")
    roots = stars(link_forest(classes.select("fp"), classes.count()))
    labelled = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component"))
    return labelled.join(least, "root").select("fp", "first", "component")


def _key(doc_id: str, row: str) -> F.Column:
    """Sorts by doc_id, nulls last, then by row."""
    return F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(row).alias("row"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, fingerprint, component_id."""
    small_batches(docs.sparkSession)
    prints = written(docs.select("doc_id", fingerprint_of(F.col("text")).alias("fp")), "prints")
    labels = classes_of(prints.withColumn("row", F.lit(0)).select("fp", _key("doc_id", "row").alias("key"))).select("fp", F.col("component.id").alias("component_id"))
    return prints.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, that with the least doc_id, with all its columns."""
    small_batches(docs.sparkSession)
    rows = written(docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), fingerprint_of(F.col("text")).alias("fp"), F.monotonically_increasing_id().alias("row")), "prints-and-texts")
    labels = classes_of(rows.select("fp", _key("id", "row").alias("key")))
    kept = labels.select(F.col("component.row").alias("row")).distinct()
    return rows.join(kept, "row", "left_semi").select("doc.*")


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
