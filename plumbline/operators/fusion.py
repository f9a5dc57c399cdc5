"""Evidence fusion: choosing, matching, clustering and merging rows that speak of the same thing.

Groups are reduced before they are shuffled wherever the semantics allow (choices are minima or maxima of structs, so
they combine map-side); joins on values go through buckets of the tolerance, never through all pairs of a group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import shuffled, written
from . import graph, ranges


def choose(df: DataFrame, keys: list[str], order: list[Column], largest: bool = False) -> DataFrame:
    """One row of each key: the first by order, or the last. Null keys are a key. (W1-W4, A5, D-priority)

    The order must end in something unique.
    """
    rank = F.struct(*[c.alias(f"o{k}") for k, c in enumerate(order)], F.struct(*df.columns).alias("row"))
    best = (F.max if largest else F.min)(rank)
    return df.groupBy(*keys).agg(best.alias("best")).select("best.row.*")


def superseded(df: DataFrame, keys: list[str], order: list[Column], id_column: str) -> DataFrame:
    """Marks the first row of each key as current and names it on the others.

    A key's rows may lie in many ranges: places are counted within each and carried on.
    """
    w = ranges.within(keys, order)
    here = ranges.ranged(df, keys, order).withColumn("nth", F.row_number().over(w))
    all_ = ranges.carried(here, keys, {"before": (F.count("*"), "sum"), "head": (F.min_by(id_column, "nth"), "first")})
    rank = F.col("nth") + F.coalesce("before", F.lit(0))
    head = F.coalesce("head", F.first(id_column).over(w))
    out = all_.withColumns({"rank_in_key": rank.cast("int"), "current": head}).withColumn("is_current", F.col("rank_in_key") == 1)
    return out.withColumn("superseded_by", F.when(~F.col("is_current"), F.col("current"))).select(*df.columns, "rank_in_key", "is_current", "superseded_by")


def lookup(df: DataFrame, dim: DataFrame, on: str, label: str, default: str = "Unknown") -> DataFrame:
    """Left join to a dictionary; what it doesn't know gets the default label."""
    return df.join(dim.select(on, label), on, "left").withColumn(label, F.coalesce(label, F.lit(default)))


def near_pairs(df: DataFrame, by: list[str], id_column: str, value: str, relative: float, extra: Column | None = None, beside: tuple[str, float] | None = None) -> DataFrame:
    """Pairs (a, b) of rows of the same key, a < b by id, whose values are within a relative tolerance of the larger.

    Values are laid into buckets of their logarithm as wide as the tolerance, so a partner is in the same bucket or
    the next one. Values must be positive; others pair with nothing. extra(a, b) may be given on a_ and b_ columns.
    beside: a second measure that must be no further apart than so much; it has buckets of its own, so that pairs that
    are near in one measure only don't meet. Both sides are shuffled: there are far more pairs than rows.
    """
    width = -math.log1p(-relative)
    keyed = df.filter(F.col(value) > 0).withColumn("bucket", F.floor(F.log(value) / width))
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    at = [*by, "bucket"]
    if beside:
        keyed, at = keyed.withColumn("beside", F.floor(F.col(beside[0]) / beside[1])), [*at, "beside"]
    right = keyed.withColumn("bucket", around("bucket"))
    if beside:
        right = right.withColumn("beside", around("beside"))
    side = lambda d, p: d.select(*at, *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c not in by])
    pairs = side(keyed, "a").join(shuffled(side(right, "b")), at).filter(F.col(f"a_{id_column}") < F.col(f"b_{id_column}"))
    a, b = F.col(f"a_{value}"), F.col(f"b_{value}")
    pairs = pairs.filter(F.abs(a - b) <= relative * F.greatest(a, b))
    if beside:
        pairs = pairs.filter(F.abs(F.col(f"a_{beside[0]}") - F.col(f"b_{beside[0]}")) <= beside[1])
    pairs = pairs.drop("bucket", "beside")
    return pairs if extra is None else pairs.filter(extra)


def mutual_unique_best(pairs: DataFrame, a: str, b: str, score: str) -> DataFrame:
    """Pairs that are the only best of both their sides. Scores are compared at 12 decimals.

    The pairs, often an aggregate themselves, are written once. A side's scores are counted before its best is taken,
    so its best one comes with the number of pairs that have it.
    """
    named = written(pairs.withColumns({"in_a": F.col(a), "in_b": F.col(b), "s": F.bround(score, 12)}).filter("s is not null"), "pairs")

    def best(side: str, other: str) -> DataFrame:
        counted = named.groupBy(side, "s").agg(F.count("*").alias("n"), F.min(other).alias(other))
        return counted.groupBy(side).agg(F.max(F.struct("s", "n", other)).alias("m")).filter("m.n = 1").select(side, f"m.{other}", "m.s")

    won = best("in_a", "in_b").join(best("in_b", "in_a"), ["in_a", "in_b", "s"])
    return named.join(won, ["in_a", "in_b", "s"], "left_semi").select(*pairs.columns)


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_value: str, right_value: str, right_id: str) -> DataFrame:
    """Each left row with the right row of the same key whose value is nearest; ties go to the lower value, then id.

    Null and NaN are no values: nothing is near to them and they are near to nothing. Both sides are sorted together by
    ranges of key and value, so a key may be as large as it likes: the candidates are the last right row before and the
    first after, within a range or, where it has none, from the ranges beside it.
    """
    lacks = lambda d, c: F.col(c).isNull() | (F.isnan(c) if d.schema[c].dataType.typeName() in ("double", "float") else F.lit(False))
    r = F.struct(F.col(right_value).alias("v"), F.col(right_id).alias("id"))
    rights = right.filter(~lacks(right, right_value)).groupBy(*by, F.col(right_value).alias("at")).agg(F.min(r).alias("hit")).withColumn("row", F.lit(None).cast(left.select(F.struct("*").alias("s")).schema["s"].dataType))
    at = F.when(~lacks(left, left_value), F.col(left_value)).alias("at")
    lefts = left.select(*by, at, F.lit(None).cast(rights.schema["hit"].dataType).alias("hit"), F.struct("*").alias("row"))
    ranged = ranges.ranged(rights.select(*by, "at", "hit", "row").unionByName(lefts), by, [F.col("at")])
    # Both frames begin at an end of the range and grow: a frame that ends at the last row is gone through anew for each row.
    upto = lambda order: F.last("hit", ignorenulls=True).over(ranges.within(by, [order]).rangeBetween(W.unboundedPreceding, 0))
    here = ranged.withColumn("below", upto(F.col("at"))).withColumn("above", upto(F.col("at").desc()))
    hits = F.when(F.col("hit").isNotNull(), F.struct("at", "hit"))
    both = ranges.carried(ranges.carried(here, by, {"before": (F.max(hits), "last")}), by, {"after": (F.min(hits), "first")}, after=True).filter("row is not null")
    both = both.withColumns({"below": F.coalesce("below", "before.hit"), "above": F.coalesce("above", "after.hit")})
    take_above = F.col("below").isNull() | (F.col("above.v") - F.col("at") < F.col("at") - F.col("below.v"))
    near = F.when(F.col("at").isNotNull(), F.when(F.coalesce(take_above, F.lit(False)), F.col("above")).otherwise(F.coalesce("below", "above")))
    return both.withColumn("near", near).select("row.*", F.col("near.id").alias(f"near_{right_id}"), F.col("near.v").alias(f"near_{right_value}"))


def allocate(df: DataFrame, by: list[str], weight: str, total: str, out: str) -> DataFrame:
    """Shares a key's total among its rows by weight; a single row takes all, no weight gives 0.

    Rows are sorted by key once, and sums are taken as they pass: to join sums to them would make and sort all rows
    twice in a task. Rows without a key have no share and are left out.
    """
    key = W.partitionBy(*by)
    summed = df.dropna(subset=by).withColumns({"all_weight": F.sum(weight).over(key), "n_rows": F.count("*").over(key)})
    share = F.when(F.col("n_rows") == 1, F.col(total)).when(F.col("all_weight") > 0, F.col(total) * F.col(weight) / F.col("all_weight")).otherwise(0.0)
    return summed.withColumn(out, share).drop("all_weight", "n_rows")


def consensus(df: DataFrame, by: list[str], value: str, weight: str, tolerance: float) -> DataFrame:
    """The heaviest cluster of each key: around one value, all within a relative tolerance of it.

    Returns key, base, weight, solved (weighted mean), spread (largest relative deviation from it) and n. Ties go to
    the lower base; weights of clusters are compared at 9 decimals. The weight of a cluster is the difference of the
    running weights at its two ends, which are sorted among the values by ranges, so a key may have any number of rows.
    """
    # |v - base| <= tolerance * base is base * (1 - tolerance) <= v <= base * (1 + tolerance)
    down, up = -math.log1p(-tolerance), math.log1p(tolerance)
    rows = df.filter(F.col(value) > 0)
    values = rows.groupBy(*by, F.col(value).alias("base")).agg(F.sum(weight).alias("own")).withColumn("ln", F.log("base"))
    ends = F.array(*[F.struct(x.alias("at"), F.lit(k).alias("kind")) for k, x in enumerate((F.col("ln") - down, F.col("ln"), F.col("ln") + up))])
    order = [F.col("at"), F.col("kind")]
    marks = ranges.ranged(values.select(*by, "base", "own", F.inline(ends)).withColumn("adds", F.when(F.col("kind") == 1, F.col("own")).otherwise(0)), by, order)
    here = marks.withColumn("running", F.sum("adds").over(ranges.within(by, order).rowsBetween(W.unboundedPreceding, 0)))
    upto = F.col("running") + F.coalesce("earlier", F.lit(0))
    sums = ranges.carried(here, by, {"earlier": (F.sum("adds"), "sum")}).withColumn("upto", upto).filter("kind <> 1")
    sized = sums.groupBy(*by, "base").agg(F.bround(F.sum(F.when(F.col("kind") == 2, F.col("upto")).otherwise(-F.col("upto"))), 9).alias("cluster_weight"))
    base = sized.groupBy(*by).agg(F.min(F.struct((-F.col("cluster_weight")).alias("k"), "base")).alias("b")).select(*by, F.col("b.base").alias("base"))
    inside = rows.join(base, by).filter(F.abs(F.col(value) - F.col("base")) <= tolerance * F.col("base"))
    solved = inside.groupBy(*by, "base").agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("solved"), F.sum(weight).alias("weight"), F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
    spread = F.greatest(F.col("high") - F.col("solved"), F.col("solved") - F.col("low")) / F.col("solved")
    return solved.withColumn("spread", spread).drop("low", "high")


def merge_intervals(df: DataFrame, by: list[str], low: str, high: str, gap: Column | float) -> DataFrame:
    """Islands of intervals that overlap or lie no more than gap apart: key, low, high, n.

    The furthest end so far and the number of islands begun are carried from range to range of a key's intervals.
    """
    order = [F.col(low), F.col(high)]
    w = ranges.within(by, order)
    here = ranges.ranged(df, by, order).withColumn("reach", F.max(high).over(w.rowsBetween(W.unboundedPreceding, -1)))
    here = ranges.carried(here, by, {"reached": (F.max(high), "max")}).withColumn("reach", F.greatest("reach", "reached"))
    begins = F.when(F.col("reach").isNull() | (F.col(low) - F.col("reach") > gap), 1).otherwise(0)
    marked = written(here.withColumn("begins", begins), "begun").withColumn("island", F.sum("begins").over(w.rowsBetween(W.unboundedPreceding, 0)))
    marked = ranges.carried(marked, by, {"earlier": (F.sum("begins"), "sum")}).withColumn("island", F.col("island") + F.coalesce("earlier", F.lit(0)))
    return marked.groupBy(*by, "island").agg(F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("n")).drop("island")


def overlapping(df: DataFrame, by: list[str], id_column: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs a < b of rows of the same key whose intervals overlap.

    Of two intervals that overlap, the one that begins later begins within the other. So an interval lies in the
    buckets that it touches, and the beginnings of all look for those that they are in. Intervals have a level by their
    length, doubling from the width on, and lie in the two buckets at most of their own level that they touch. Each
    level costs a copy of all beginnings, so one whose intervals make fewer copies in the buckets of the level below is
    laid there: a row is copied by the number of levels at most, however long it is.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(high) - F.col(low), F.lit(width)) / width))).cast("int")
    rows = written(df.filter(F.col(low) <= F.col(high)).select(*by, *[F.col(c) for c in (id_column, low, high)], level.alias("level")), "intervals")
    levels = _worth_a_copy({r["level"]: r["n"] for r in rows.groupBy("level").agg(F.count("*").alias("n")).collect()})
    size = lambda k: F.lit(float(width)) * F.pow(F.lit(2.0), k)
    of = lambda c: F.floor(F.col(c) / size(F.col("at")))
    own = F.coalesce(*[F.when(F.col("level") >= k, F.lit(k)) for k in reversed(levels)])
    side = lambda d, p: d.select(*by, "at", "bucket", *[F.col(c).alias(f"{p}_{c}") for c in (id_column, low, high)])
    whole = side(rows.withColumn("at", own).withColumn("bucket", F.explode(F.sequence(of(low), of(high)))), "x")
    begun = side(rows.withColumn("at", F.explode(F.array(*map(F.lit, levels)))).withColumn("bucket", of(low)), "y")
    x_low, y_low, first = F.col(f"x_{low}"), F.col(f"y_{low}"), F.col(f"x_{id_column}") < F.col(f"y_{id_column}")
    inside = (y_low <= F.col(f"x_{high}")) & ((x_low < y_low) | ((x_low == y_low) & first))
    pairs = whole.join(begun, [*by, "at", "bucket"]).filter(inside & (F.col(f"x_{id_column}") != F.col(f"y_{id_column}")))
    pick = lambda p, c: F.when(first if p == "a" else ~first, F.col(f"x_{c}")).otherwise(F.col(f"y_{c}")).alias(f"{p}_{c}")
    return pairs.select(*by, *[pick(p, c) for p in "ab" for c in (id_column, low, high)])


def _worth_a_copy(counts: dict[int, int]) -> list[int]:
    """Of levels and their numbers of intervals those that have buckets, ascending; the others are laid in those of the next one below."""
    levels, rows, above = sorted(counts) or [0], sum(counts.values()), {}
    kept = [levels[0]]
    for k, below in zip(reversed(levels[1:]), reversed(levels[:-1]), strict=True):
        above[k] = counts[k]
        if sum(n << (m - below) for m, n in above.items()) > rows:
            kept.append(k)
            above = {}
    return sorted(kept)


def conflicts(df: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys whose values lie further apart than the tolerance: key, low, high, n, spread."""
    got = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
    return got.withColumn("spread", F.col("high") - F.col("low")).filter(F.col("spread") > tolerance)


def greedy_pairs(pairs: DataFrame, group: str, a: str, b: str, cost: str) -> DataFrame:
    """One-to-one assignment within a group, cheapest pairs first, ties by a and b; costs that are null come last.

    A pair that is the first of both its ends is one that the walk in order of cost takes, whatever else there is, so
    all such pairs are taken at once, the other pairs of their ends dropped, and so on until none is left. No group
    has to fit a task. There are as many rounds as the longest chain of pairs that wait for each other. Nulls are a
    group and an end like any other.
    """
    order = F.struct(F.col(cost).isNull().alias("none"), F.col(cost).alias("cost"), F.col(a).alias("a"), F.col(b).alias("b"))
    ends = [F.struct(F.col(group).alias("g"), F.col(c).alias("end")).alias(k) for k, c in (("at_a", a), ("at_b", b))]
    left = graph.cut(pairs.select(*ends, order.alias("rank"), F.struct(*pairs.columns).alias("row")).groupBy("at_a", "at_b").agg(F.min(F.struct("rank", "row")).alias("best")))
    taken = left.limit(0)
    while not left.isEmpty():
        best_a, best_b = (left.groupBy(k).agg(F.min(F.struct("best.rank", o, "best")).alias(f"first_{k}")) for k, o in (("at_a", "at_b"), ("at_b", "at_a")))
        won = best_a.select("at_a", F.col("first_at_a.at_b").alias("at_b"), F.col("first_at_a.best").alias("best")).join(best_b, "at_b").filter(F.col("first_at_b.at_a").eqNullSafe(F.col("at_a")))
        won = graph.cut(won.select("at_a", "at_b", "best"))
        taken = taken.unionAll(won)
        left = graph.cut(left.join(won.select("at_a"), "at_a", "left_anti").join(won.select("at_b"), "at_b", "left_anti").select("at_a", "at_b", "best"))
    return taken.select("best.row.*")


def fold(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key of an append-only log."""
    return choose(df, keys, order, largest=True)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new put in place of those of the same keys; null keys match each other."""
    cond = None
    renamed = new.select(*[F.col(k).alias(f"new_{k}") for k in keys]).distinct()
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"new_{k}"))
        cond = c if cond is None else cond & c
    return old.join(renamed, cond, "left_anti").unionByName(new, allowMissingColumns=True)


def replace_owned(old: DataFrame, new: DataFrame, owner: str, prefix: str) -> DataFrame:
    """old without the rows whose owner begins with the prefix, and the new rows. (K4-K8)"""
    return old.filter(~F.coalesce(F.col(owner).startswith(prefix), F.lit(False))).unionByName(new, allowMissingColumns=True)


def row_digest(columns: list[str], order: list[str]) -> Column:
    """A row's part of a fingerprint: the columns of the order and then the others, joined by bars."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in [*order, *columns]]), 256)


def range_of(digest: Column) -> Column:
    """Which of 4096 ranges a digest lies in."""
    return F.substring(digest, 1, 3)


def range_digest(digest: Column) -> Column:
    """Aggregate over a range's rows; null digests don't count."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(digest)), "\n"), 256)


def whole_digest(key: Column, digest: Column) -> Column:
    """Aggregate over the ranges; those with a null key don't count."""
    held = F.collect_list(F.when(key.isNotNull(), F.struct(key.alias("range"), digest.alias("digest"))))
    return F.sha2(F.array_join(F.transform(F.sort_array(held), lambda r: r["digest"]), "\n"), 256)


def fingerprint(df: DataFrame, columns: list[str], order: list[str], group: list[str] | None = None) -> DataFrame:
    """sha256 over the rows of each group, in whatever order they come.

    Rows become digests, the sorted digests of each of 4096 ranges a digest, and those of the ranges, in order, the
    fingerprint: no list is longer than a range.
    """
    by = group or []
    rows = df.select(*by, row_digest(columns, order).alias("digest")).withColumn("range", range_of(F.col("digest")))
    ranges = rows.groupBy(*by, "range").agg(range_digest(F.col("digest")).alias("digest"), F.count("*").alias("n"))
    return ranges.groupBy(*by).agg(whole_digest(F.col("range"), F.col("digest")).alias("fingerprint"), F.sum("n").alias("n_rows"))
