"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions.

Documents of a source are shuffled by a hash of id and text. A document's virtual finish time is the words of its
source up to and with it, divided by the source's target; a later epoch of the source adds the whole source once more.
All copies, sorted by that time, make the mixture, which ends where the budget is used up: every source has then come
about as near to its own target as any other. Rows that repeat each other in id, source and text stand side by side as
one counted row, whose sums follow by multiplication, so the end may fall between them and no place holds many rows.

Targets come from one row for each source: on the driver as long as sources are few, beyond that in rounds over a table
of sources, each of which only brings back two sums; large sources are then joined by a broadcast of fewer than LARGE
rows, the others by a shuffle, in which none of them is large.

Running sums within a source are made in two steps, since one source may hold much of the corpus: hash buckets of
about sqrt(n) documents are summed each by itself, then the buckets' totals. The global order is a range sort whose
partitions are summed; only the partition in which the budget ends is looked into row by row.

Defined results: a null text has no words; a null source is the last source; rows that share an id, even
a null one, are documents of their own, and rows equal in id, source and text are taken one by one, any of them first;
a document without words is never taken; a target of a source
without words is 0; an empty table gives no rows. Columns other than doc_id, text and source are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ranges, table, words_of, written

LARGE = 10_000  # a source of more than one document in so many is large
COPIES = 1000  # equal documents of a row

@dataclass(frozen=True)
class Mix:
    #: Weights of the sources in code point order, repeating.
    weights: tuple[int, ...] = (5, 2, 1)
    #: Epochs of a source that the mixture may hold at most.
    most: int = 3
    #: Sources up to this number are listed on the driver and broadcast; more are ranked and joined by shuffles.
    listed_sources: int = 200_000
    bucket_rows: int = 500


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Words wanted of each source: by weight, no more than most times its size, the excess shared out again."""
    weight = [mix.weights[k % len(mix.weights)] for k in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), sum(sizes), set(range(len(sizes)))
    while free:
        all_weight = sum(weight[k] for k in free)
        full = [k for k in free if left * weight[k] / all_weight > mix.most * sizes[k]]
        for k in full or free:
            out[k] = float(mix.most * sizes[k]) if full else left * weight[k] / all_weight
        if not full:
            break
        left -= sum(mix.most * sizes[k] for k in full)
        free -= set(full)
    return out


def source_targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """targets() over a table of any number of sources: source, rank, source_size, target, docs. sources: source, size, docs."""
    spark = sources.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(ranges(spark, sources.count()), *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "mix-ranked").withColumn("part", F.shiftright("at", 33))
    before, starts = 0, []
    for r in sorted(ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect(), key=lambda r: r["part"]):  # a row per partition
        starts.append((r["part"], before - r["first"]))
        before += r["n"]
    shift = spark.createDataFrame(starts, "part long, shift long")
    ranked = ranged.join(F.broadcast(shift), "part").withColumn("rank", F.col("at") + F.col("shift"))
    weight = F.element_at(F.array(*[F.lit(w) for w in mix.weights]), (F.col("rank") % len(mix.weights) + 1).cast("int")).cast("decimal(38,0)")
    ranked = written(ranked.select("source", "size", "docs", "rank", weight.alias("weight"), (F.col("size") * mix.most).cast("decimal(38,0)").alias("cap")), "mix-weighed")
    sums = ranked.agg(F.sum("size").alias("left"), F.sum("weight").alias("weight")).first()
    total, all_weight = int(sums["left"] or 0), int(sums["weight"] or 0)
    left, free, n = total, all_weight, 0
    while True:  # the sources at their caps only become more
        full = F.col("cap") * F.lit(free) < F.col("weight") * F.lit(left) if free else F.lit(True)
        got = ranked.filter(full).agg(F.count("*").alias("n"), F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
        if got["n"] == n or not free:
            break
        n, left, free = got["n"], total - int(got["cap"]), all_weight - int(got["weight"])
    share = F.lit(float(left)) * F.col("weight").cast("double") / F.lit(float(free)) if free else F.col("cap").cast("double")
    return ranked.select("source", "rank", F.col("size").alias("source_size"), F.when(full, F.col("cap").cast("double")).otherwise(share).alias("target"), "docs")


def _by_source(rows: DataFrame, of: str, listed: DataFrame, total: int, few: bool) -> DataFrame:
    """rows joined to the row of their source, named in the column of. listed: source, docs and others."""
    same = lambda name: F.col(of).eqNullSafe(F.col(name))
    if few:
        return rows.join(F.broadcast(listed), same("source"))
    large = F.col("docs") * LARGE > total
    named = listed.filter(large).select(F.col("source").alias("large"))
    rest = rows.join(F.broadcast(named), same("large"), "left_anti").join(listed.filter(~large), same("source"))
    return rows.join(F.broadcast(listed.filter(large)), same("source")).unionByName(rest)


def place() -> Column:
    """The shuffled place of a document in its source: 60 bits of a digest of its id and text."""
    either = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return F.conv(F.substring(F.md5(F.concat(either[0], F.lit(":"), either[1]).cast("binary")), 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), place().alias("place"))


def finish(epoch: Column) -> Column:
    """Of a row of copies(). Null where nothing is wanted of the source, which then has no words."""
    upto = F.col("base") + F.col("size") * F.col("number")
    return F.try_divide((upto + epoch * F.col("source_size")).cast("double"), F.col("target"))


def within(epoch: Column, cut: tuple[float, int] | None) -> Column:
    """Whether the copy of that epoch lies before the end of the mixture."""
    if cut is None:
        return F.lit(False)
    t = finish(epoch)
    return (F.col("size") > 0) & F.coalesce((t < cut[0]) | ((t == cut[0]) & (F.col("rank") <= cut[1])), F.lit(False))


def queue(docs: DataFrame, mix: Mix) -> tuple[DataFrame, tuple[float, int] | None, tuple[int, bool]]:
    """Counted rows, the last (finish time, rank) taken, the number of documents and whether sources are few.

    Rows: doc_id, source, size, place, equal (rows of that id, source and text), first and last (which of them, no more
    than COPIES in a row), base (words before the first of all equal ones), rank, source_size, target.
    """
    spark = docs.sparkSession
    rows = written(_sized(docs).groupBy("doc_id", "source", "size", "place").agg(F.count("*").alias("equal")), "mix-sizes")
    sources = written(rows.groupBy("source").agg(F.sum(F.col("size") * F.col("equal")).alias("size"), F.sum("equal").alias("docs"), F.max("equal").alias("most")), "mix-sources")
    known = sources.agg(F.count("*").alias("k"), F.sum("docs").alias("n"), F.sum("size").alias("size"), F.max("most").alias("most")).first()
    n, few = known["n"] or 0, known["k"] <= mix.listed_sources
    if few:
        got = sorted(sources.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))  # listed_sources rows
        want = targets([r["size"] for r in got], mix)
        listed = spark.createDataFrame([(r["source"], k, r["size"], want[k], r["docs"]) for k, r in enumerate(got)], "source string, rank long, source_size long, target double, docs long")
    else:
        listed = source_targets(sources, mix)
    listed = listed.withColumn("buckets", F.ceil(F.col("docs") / F.greatest(F.lit(mix.bucket_rows), F.floor(F.sqrt("docs")))))
    rows = _by_source(rows.withColumnRenamed("source", "of"), "of", listed, n, few)
    rows = rows.withColumn("bucket", F.floor(F.col("place") / F.lit(float(1 << 60)) * F.col("buckets"))).withColumn("words", F.col("size") * F.col("equal"))
    key = ["rank", "bucket"]
    totals = rows.groupBy(*key).agg(F.sum("words").alias("in_bucket"))
    before = totals.select(*key, (F.sum("in_bucket").over(W.partitionBy("rank").orderBy("bucket")) - F.col("in_bucket")).alias("before"))
    inside = F.sum("words").over(W.partitionBy(*key).orderBy("place", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("inside", inside).join(before, key).withColumn("base", F.col("inside") + F.col("before") - F.col("words"))
    rows = rows.withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("equal"), F.lit(COPIES).cast("long"))))
    rows = rows.withColumn("last", F.least(F.col("equal"), F.col("first") + (COPIES - 1)))
    rows = rows.select("doc_id", "source", "size", "place", "equal", "first", "last", "base", "rank", "source_size", "target")
    if (known["most"] or 0) > COPIES:
        rows = rows.repartition(ranges(spark, n))
    rows = written(rows, "mix-queue")
    return rows, _cut(rows, known["size"] or 0, n, mix), (n, few)


def copies(rows: DataFrame) -> DataFrame:
    """A row for each document: number, which of the equal ones it is, in place of first and last."""
    return rows.withColumn("number", F.explode(F.sequence("first", "last"))).drop("first", "last")


def epochs(rows: DataFrame, mix: Mix) -> DataFrame:
    """Every copy of every document that has words, with its finish time. rows: copies()."""
    each = F.array(*[F.struct(F.lit(e).alias("epoch"), finish(F.lit(e)).alias("finish")) for e in range(mix.most)])
    return rows.filter("size > 0").select("*", F.inline(each))


def _cut(rows: DataFrame, budget: int, n: int, mix: Mix) -> tuple[float, int] | None:
    order = ["finish", "rank", "place", "doc_id", "size", "number"]
    ranged = epochs(copies(rows), mix).select(*order).repartitionByRange(ranges(rows.sparkSession, n * mix.most), *order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("at", F.monotonically_increasing_id()), "mix-order")
    part = F.shiftright("at", 33)
    sums = sorted(ranged.groupBy(part.alias("part")).agg(F.sum("size").alias("size")).collect(), key=lambda r: r["part"])
    used = 0
    for r in sums:
        if used + r["size"] > budget:
            break
        used += r["size"]
    else:
        r = sums[-1] if sums else None
    if r is None:
        return None
    here = ranged.withColumn("part", part).filter(F.col("part") == r["part"])
    here = here.withColumn("upto", F.sum("size").over(W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    last = here.filter(F.col("upto") <= budget - (used if used + r["size"] > budget else used - r["size"])).agg(F.max(F.struct("finish", "rank")).alias("k")).first()["k"]
    if last is None:  # the budget ends at this partition's first copy
        last = ranged.withColumn("part", part).filter(F.col("part") < r["part"]).agg(F.max(F.struct("finish", "rank")).alias("k")).first()["k"]
    return last and (last["finish"], last["rank"])


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mixture itself, sorted: doc_id, source, epoch, finish, size."""
    rows, cut, _ = queue(docs, mix)
    taken = epochs(copies(rows), mix).filter(within(F.col("epoch"), cut))
    return taken.orderBy("finish", "rank", "place", "doc_id", "number").select("doc_id", "source", "epoch", "finish", "size")


def _times(cut: tuple[float, int] | None, mix: Mix) -> Column:
    return sum((within(F.lit(e), cut).cast("long") for e in range(1, mix.most)), within(F.lit(0), cut).cast("long"))


def shares(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    rows, cut, _ = queue(docs, mix)
    return copies(rows).select("doc_id", "size", "source_size", "target", (F.col("size") * _times(cut, mix)).alias("taken"))


def resample(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mixture with all their columns, a row for each copy.

    Within a source and an epoch the mixture takes a prefix of the shuffled order, so its end for each source and
    epoch is all that the texts need to know: they are not moved. Only where an end falls between equal rows are
    these, and no others, written and numbered.
    """
    rows, cut, (n, few) = queue(docs, mix)
    spot = F.struct("place", "doc_id", "size", "number", "equal")
    taken = epochs(copies(rows), mix).filter(within(F.col("epoch"), cut)).groupBy("source").agg(*[F.max(F.when(F.col("epoch") == e, spot)).alias(f"end_{e}") for e in range(mix.most)])
    ends = rows.groupBy("source").agg(F.sum(F.col("last") - F.col("first") + 1).alias("docs")).withColumnRenamed("source", "name")
    ends = written(ends.join(taken, F.col("name").eqNullSafe(F.col("source")), "left").drop("source").withColumnRenamed("name", "source"), "mix-ends")
    own = docs.select(F.struct("*").alias("row"), F.col("source").alias("of"), F.struct(place().alias("place"), F.col("doc_id").alias("doc_id"), F.size(words_of(F.col("text"))).cast("long").alias("size")).alias("spot"))
    joined = _by_source(own, "of", ends, n, few)
    place_of = lambda e: F.struct(*[F.col(f"end_{e}.{c}").alias(c) for c in ("place", "doc_id", "size")])
    at_end = lambda e: F.col(f"end_{e}").isNotNull() & F.col("spot").eqNullSafe(place_of(e))
    split = [at_end(e) & (F.col(f"end_{e}.number") < F.col(f"end_{e}.equal")) for e in range(mix.most)]
    any_split = split[0]
    for s in split[1:]:
        any_split = any_split | s
    before = lambda e: F.col(f"end_{e}").isNotNull() & (F.col("spot") < place_of(e))

    def repeated(rows: DataFrame, number: Column) -> DataFrame:
        there = [before(e) | (at_end(e) & (number <= F.col(f"end_{e}.number"))) for e in range(mix.most)]
        times = sum((F.coalesce(t, F.lit(False)).cast("int") for t in there[1:]), F.coalesce(there[0], F.lit(False)).cast("int"))
        times = F.when(F.col("spot.size") > 0, times).otherwise(0)
        return rows.withColumn("times", times).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")

    cuts = [F.coalesce(F.col(f"end_{e}.number") < F.col(f"end_{e}.equal"), F.lit(False)) for e in range(mix.most)]
    if not ends.filter(sum((c.cast("int") for c in cuts[1:]), cuts[0].cast("int")) > 0).limit(1).count():
        return repeated(joined, F.lit(1))
    few_ends = [f"end_{e}" for e in range(mix.most)]
    held = written(joined.filter(any_split).select("row", "of", "spot", *few_ends).withColumn("at", F.monotonically_increasing_id()), "mix-equal").withColumn("part", F.shiftright("at", 33))
    group = ["of", "spot"]
    sums = held.groupBy("part", *group).agg(F.count("*").alias("n"))
    sums = sums.withColumn("held_before", F.sum("n").over(W.partitionBy(*group).orderBy("part")) - F.col("n")).select(F.col("part").alias("in_part"), F.struct(*group).alias("in_group"), "held_before")
    held = held.withColumn("nth", F.row_number().over(W.partitionBy("part", *group).orderBy("at")))
    held = held.join(sums, (F.col("part") == F.col("in_part")) & F.struct(*group).eqNullSafe(F.col("in_group")))
    return repeated(joined.filter(~any_split), F.lit(1)).unionByName(repeated(held, F.col("nth") + F.col("held_before")))


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1)::BIGINT AS rank FROM d GROUP BY source),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight FROM s),
o AS (SELECT *, sum(3 * source_size) OVER q AS caps, sum(weight) OVER q AS weights, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
             row_number() OVER (ORDER BY source_size::DOUBLE / weight, rank) AS n FROM w WINDOW q AS (ORDER BY source_size::DOUBLE / weight, rank)),
l AS (SELECT n AS capped, (total - caps)::DOUBLE AS left_words, (all_weight - weights)::DOUBLE AS left_weight FROM o
      UNION ALL SELECT 0, max(total)::DOUBLE, max(all_weight)::DOUBLE FROM o),
c AS (SELECT min(capped) AS capped FROM l WHERE NOT EXISTS (SELECT 1 FROM o WHERE n > capped AND left_words * weight / left_weight > 3 * source_size)),
t AS (SELECT source, source_size, rank, CASE WHEN n <= c.capped THEN (3 * source_size)::DOUBLE ELSE left_words * weight / left_weight END AS target FROM o, c JOIN l ON l.capped = c.capped),
u AS (SELECT doc_id, size, place, rank, source_size, target, sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT size, rank, place, doc_id, e, (upto + e * source_size)::DOUBLE / target AS finish FROM u, (SELECT unnest([0, 1, 2]) AS e) z WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, place, doc_id, size ROWS UNBOUNDED PRECEDING) AS running FROM k),
x AS (SELECT finish, rank FROM r WHERE running <= (SELECT sum(size) FROM d) ORDER BY finish DESC, rank DESC LIMIT 1)
SELECT doc_id, size, source_size, target, (size * CASE WHEN size = 0 THEN 0 ELSE
  (SELECT count(*) FROM (SELECT unnest([0, 1, 2]) AS e) z, x WHERE (u.upto + e * u.source_size)::DOUBLE / u.target < x.finish OR ((u.upto + e * u.source_size)::DOUBLE / u.target = x.finish AND u.rank <= x.rank)) END)::BIGINT AS taken
FROM u
"""
