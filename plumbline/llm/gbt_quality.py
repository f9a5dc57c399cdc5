"""A quality classifier: histogram gradient-boosted trees over statistics of a document's text.

A bounded sample is drawn from the labels first (SAMPLE ids, those with the least hashes), so statistics for training
are taken of its documents alone. The trees are trained on the driver from them: statistics are cut into at most BINS
bins; each level of a tree takes one histogram of gradients per node and statistic. The trees are then flattened into
arrays, level by level in perfect binary order, so that numpy takes all rows of a batch down a tree in as many steps as
it is deep. One pass over all texts takes each one's statistics and scores them; nothing is written in between.

Only the text is looked at: labels, language, source and id are no inputs. Rows whose crc32(doc_id) mod 3 is 1 are
held out from training.

Defined results: a null text is empty, and an empty text has statistics like others, so it is scored; labels that are
neither 0 nor 1 are ignored; a document with several labels has their majority, 1 at a tie; without a label to learn
from every score is 0.5; a null doc_id isn't held out and has no label; rows that share a doc_id are scored each, and
the greatest text of them is learnt from; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .shared import small_batches, table

SAMPLE = 40_000
BINS = 64
TREES, DEPTH, RATE = 80, 4, 0.15
L2, LEAST_HESSIAN = 1.0, 2.0

NAMES = (
    "log_bytes", "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeat_next", "log_lines", "line_words", "blank_lines",
    "dup_lines", "upper", "digits", "spaces", "points", "symbols", "exclaims", "bars", "high_bytes", "entropy", "capital_words", "end_points", "short_lines",
    "longest_run", "links", "upper_words", "symbol_words", "window_repeats",
)
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?'\"()-", b"#*$%&<>@^~_=+/\\{}[]`", b"!", b"|"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8


def statistics(text: str) -> list[float]:
    """The numbers that NAMES lists, of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=counts, minlength=9) / n
    share = counts[counts > 0] / n
    words = raw.split()
    m = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    same = np.fromiter((a == b for a, b in zip(words, words[1:], strict=False)), bool, max(0, len(words) - 1))
    run = 0
    if same.any():
        ends = np.flatnonzero(np.concatenate([~same, [True]]))
        run = int(np.diff(np.concatenate([[-1], ends])).max()) - 1
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()]
    k = max(1, len(full))
    threes = len(words) - 2
    distinct = len(set(zip(words, words[1:], words[2:], strict=False))) if threes > 0 else 0
    return [
        np.log1p(len(raw)), np.log1p(len(words)), lengths.sum() / m, float((lengths > 12).sum()) / m, float((lengths < 3).sum()) / m, len(seen) / m, max(seen.values(), default=0) / m, same.sum() / m, np.log1p(len(full)), len(words) / k, 1 - len(full) / len(lines),
        1 - len(set(full)) / k, kinds[1], kinds[2], kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], -float((share * np.log2(share)).sum()), sum(w[:1].isupper() for w in words) / m, sum(x.rstrip()[-1:] in b".!?" for x in full) / k, sum(len(x) < 40 for x in full) / k,
        np.log1p(run), raw.count(b"http") / m, sum(w.isupper() for w in words) / m, sum(not w.isalnum() and w[-1:] in b"*#$%&" for w in words) / m, 1 - distinct / max(1, threes) if threes > 0 else 0.0,
    ]


@F.pandas_udf(ArrayType(FloatType()))
def _statistics(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([np.array(statistics(x), np.float32) for x in s])


def statistics_of(text: F.Column) -> F.Column:
    return _statistics(F.coalesce(text, F.lit("")))


@dataclass
class Trees:
    """Perfect binary trees in level order: node k has the children 2k+1 and 2k+2. Rows with x >= cut go right."""

    feature: np.ndarray  # tree, inner node
    cut: np.ndarray  # tree, inner node
    value: np.ndarray  # tree, leaf
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows, depth = np.full(len(x), self.base), np.arange(len(x)), int(np.log2(self.value.shape[1])) if self.value.size else 0
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] >= c[node])
            out += v[node - len(c)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic loss, second-order gains."""
    n, width = x.shape
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    if not n:
        return Trees(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), 0.0)
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    slots = bins + BINS * np.arange(width)  # a slot for each statistic and bin
    trees, margin = [], np.full(n, base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (width * BINS) + slots).ravel()
            shape = (many, width, BINS)
            hist_g = np.bincount(at, np.repeat(g, width), many * width * BINS).reshape(shape)
            hist_h = np.bincount(at, np.repeat(h, width), many * width * BINS).reshape(shape)
            left_g, left_h = hist_g.cumsum(axis=2), hist_h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = left_g**2 / (left_h + L2) + (all_g - left_g) ** 2 / (all_h - left_h + L2) - all_g**2 / (all_h + L2)
            gain[(left_h < LEAST_HESSIAN) | (all_h - left_h < LEAST_HESSIAN)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k, b in enumerate(best):
                f, j = divmod(int(b), BINS)
                if gain[k, f, j] > 1e-6 and j < len(edges[f]):
                    feature[first + k], cut[first + k] = f, edges[f][j]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] >= cut[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + L2)
        margin += value[leaf]
        trees.append((feature, cut, value))
    return Trees(*(np.stack(t) for t in zip(*trees, strict=True)), base)


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, y): at most so many labelled documents, held-out ones left out, those whose ids have the least hashes.

    A bound on the hash, from the number of labelled documents, keeps what is sorted about as small as the sample.
    """
    marks = labels.filter("quality in (0, 1) and doc_id is not null").filter(~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")).withColumn("k", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    n = marks.count()
    within = 1.0 if n <= 2 * most else min(1.0, (1.1 * most + 1000) / n)
    return marks.filter(F.col("k") < int(within * (1 << 40))).orderBy("k", "doc_id").limit(most).select("doc_id", "y")


def train(docs: DataFrame, labels: DataFrame) -> Trees:
    """Learns from the documents of the sample."""
    drawn = docs.select("doc_id", "text").join(F.broadcast(sample(labels)), "doc_id")  # SAMPLE rows of two numbers
    texts = drawn.groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    got = texts.select("doc_id", "y", statistics_of(F.col("text")).alias("stats")).toPandas().sort_values("doc_id")  # SAMPLE rows
    x = np.stack(got["stats"].to_list()).astype(np.float32) if len(got) else np.zeros((0, len(NAMES)), np.float32)
    return fit(x, got["y"].to_numpy(float))


def scored(text: F.Column, trees: Trees) -> F.Column:
    """The score of each text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([statistics(t) for t in texts], np.float32).reshape(len(texts), len(NAMES))
        return pd.Series(trees.score(x))

    return score(F.coalesce(text, F.lit("")))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(F.col("text"), train(docs, labels)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents predicted to be good, with all their columns."""
    small_batches(docs.sparkSession)
    return docs.filter(scored(F.col("text"), train(docs, labels)) >= 0.5)


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def fold(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 3
