"""Shards of near equal size that keep equal texts together: minimax contiguous partition, in DataFrame functions.

The atoms are the groups of equal texts, ordered by a 64-bit hash of the text. Wanted is the smallest capacity with
which a greedy walk over the atoms fills no more than the given number of shards; the cuts then keep to that capacity.
They aren't the greedy walk's own: where one atom is heavier than a shard's share, a greedy walk fills every shard up to
that atom's size and leaves the last ones empty. Such atoms get a shard of their own instead, and what lies before,
between and after them is cut at the boundaries nearest to even shares, as far as the capacity allows: no shard is
larger than the smallest capacity, and the others are of about one size.

The atoms are never gathered. The driver holds a list of leaves, ranges of the hash with their bytes. A leaf is one
atom or may be split further. A binary search for the capacity runs twice over the leaves: as if each was one atom (a
capacity that surely works), and as if those that aren't could be cut anywhere (below which none works). Leaves in
which a walk between the two could end are then split by their next hash bits, until both searches agree and every cut
falls between atoms. The two capacities are no further apart than the largest leaf that isn't an atom, so the heaviest
leaves are split first, at most MOST_OPEN in a round into MOST_NEW parts altogether: the list grows by so many a round
at most, whatever the input and its largest group. Rounds are one aggregation each of the rows that lie in the split
leaves, which a join on the leaves' common prefix picks out.

Defined results: a null text has no bytes and belongs to the group of the empty text; repeated rows are rows of
their own; rows of an empty table: none. With fewer groups than shards some shards stay empty. Columns other than
doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ranges, table, written

BITS = 12  # hash bits of the first leaves, and the most by which a leaf is split at once
MOST_OPEN, MOST_NEW = 256, 1 << 16


@dataclass(frozen=True)
class Leaf:
    """Hashes low to high, both included; all that share the bits from shift upwards."""

    low: int
    high: int
    size: int
    rows: int
    shift: int

    @property
    def atom(self) -> bool:
        return self.low == self.high


class Walk:
    """Greedy walks over ordered leaves."""

    def __init__(self, leaves: list[Leaf]):
        self.leaves, self.at = leaves, [0]
        for x in leaves:
            self.at.append(self.at[-1] + x.size)
        self.total = self.at[-1]

    def reach(self, start: int, capacity: int, loose: bool) -> int:
        """How many bytes lie before the cut of a shard that starts at start; loose: leaves that aren't atoms can be cut."""
        end = start + capacity
        if end >= self.total:
            return self.total
        k = bisect_right(self.at, end) - 1
        return end if loose and not self.leaves[k].atom else max(self.at[k], start)

    def fits(self, capacity: int, shards: int, loose: bool, start: int = 0) -> bool:
        for _ in range(shards):
            start = self.reach(start, capacity, loose)
        return start >= self.total

    def smallest(self, shards: int, loose: bool) -> int:
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid, shards, loose) else (mid + 1, high)
        return low

    def open_between(self, low: int, high: int, shards: int) -> set[int]:
        """Leaves, not atoms, in which a cut can fall for some capacity from low to high."""
        found, a, b = set(), 0, 0
        for _ in range(shards):
            a, b = self.reach(a, low, False), self.reach(b, high, True)
            found.update(self.inside(a, b))
        return found

    def inside(self, a: int, b: int) -> list[int]:
        first, last = max(0, bisect_right(self.at, a) - 1), bisect_right(self.at, min(b, self.total - 1)) - 1
        return [k for k in range(first, min(last, len(self.leaves) - 1) + 1) if not self.leaves[k].atom]


def heavy_leaves(walk: Walk, shards: int) -> list[int]:
    """Leaves heavier than what is left for each shard once such leaves have shards of their own."""
    heavy: list[int] = []
    while True:
        rest, free = walk.total - sum(walk.leaves[k].size for k in heavy), shards - len(heavy)
        found = [k for k, x in enumerate(walk.leaves) if x.size * free > rest] if free > 0 else heavy
        if len(found) <= len(heavy):
            return heavy
        heavy = found


def even_cuts(walk: Walk, shards: int, capacity: int) -> tuple[list[int], set[int]]:
    """Leaf numbers that begin shards 1.. and the leaves, not atoms, that must be finer for exact cuts.

    Heavy leaves stand alone; what lies before, between and after them is cut evenly into its share of the other
    shards. No shard ends later than the capacity allows or sooner than the shards after it can take the rest.
    """
    back = [len(walk.leaves)]  # the earliest leaf from which so many shards take the rest
    for _ in range(shards):
        k = bisect_right(walk.at, walk.at[back[-1]] - capacity - 1)
        back.append(min(k, back[-1]))
    heavy = heavy_leaves(walk, shards)
    cuts, start, rough = [], 0, {k for k in heavy if not walk.leaves[k].atom}
    for done in range(1, shards):
        left, at = shards - done, walk.at
        ahead = heavy[bisect_left(heavy, start) :]
        rest = walk.total - at[start] - sum(walk.leaves[k].size for k in ahead)
        share = rest / max(1, left + 1 - len(ahead))
        stop = ahead[0] if ahead else len(walk.leaves)  # the next heavy leaf, or the end
        gap = at[stop] - at[start]
        if ahead and gap <= share / 2 and at[stop + 1] - at[start] <= capacity:
            k = stop + 1
        else:
            want = at[start] + gap / max(1, round(gap / share) if share else 1)
            k = bisect_right(at, want) - 1
            if k < stop and at[k + 1] - want < want - at[k]:
                k += 1
            k = min(stop, max(k, start + 1))
        latest = bisect_right(at, at[start] + capacity) - 1
        k = max(min(k, latest, len(walk.leaves)), back[left], start)
        rough.update(j for j in (k - 1, k) if 0 <= j < len(walk.leaves) and not walk.leaves[j].atom)
        cuts.append(k)
        start = k
    return cuts, rough


def next_open(leaves: list[Leaf], todo: set[int], most: int = MOST_OPEN) -> list[int]:
    """Which leaves to split in this round: the heaviest, as many as most, all with one shift."""
    first = sorted(todo, key=lambda k: (-leaves[k].size, leaves[k].low))[:most]
    return [k for k in first if leaves[k].shift == leaves[first[0]].shift]


def _leaves(rows: DataFrame, within: list[Leaf], most: int) -> list[Leaf]:
    """The given leaves, of one shift, split by as many of their next bits as give most parts altogether."""
    shift = within[0].shift
    bits = max(1, min(BITS, most.bit_length() - 1 - (len(within) - 1).bit_length(), shift))
    if shift < 64:
        cells = rows.sparkSession.createDataFrame([(x.low >> shift,) for x in within], "cell long")
        rows = rows.withColumn("cell", F.shiftright("h", shift)).join(F.broadcast(cells), "cell", "left_semi")  # MOST_OPEN rows or the shards' number times four
    got = rows.groupBy(F.shiftright("h", shift - bits).alias("bin")).agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("h").alias("low"), F.max("h").alias("high"))
    return [Leaf(r["low"], r["high"], r["size"], r["rows"], shift - bits) for r in got.collect()]


def plan(rows: DataFrame, shards: int) -> tuple[int, list[int | None], int]:
    """The smallest capacity, the smallest hash of each shard from the second on, and the number of rows; rows: (h, size)."""
    most_open, most_new = max(MOST_OPEN, 4 * shards), max(MOST_NEW, 64 * shards)
    leaves = sorted(_leaves(rows, [Leaf(-(1 << 63), (1 << 63) - 1, 0, 0, 64)], most_new), key=lambda x: x.low)
    while True:
        walk = Walk(leaves)
        low, high = walk.smallest(shards, True), walk.smallest(shards, False)
        todo = walk.open_between(low, high, shards) if low < high else set()
        if not todo:
            cuts, todo = even_cuts(walk, shards, high)
        if not todo:
            return high, [leaves[k].low if k < len(leaves) else None for k in cuts], sum(x.rows for x in leaves)
        now = next_open(leaves, todo, most_open)
        finer = _leaves(rows, [leaves[k] for k in now], most_new)
        leaves = sorted([x for k, x in enumerate(leaves) if k not in set(now)] + finer, key=lambda x: x.low)


def _sharded(rows: DataFrame, firsts: list[int | None]) -> DataFrame:
    """rows with shard, the number of firsts up to h: those of cells before h's by a join, the few of its own cell one by one."""
    known = sorted(f for f in firsts if f is not None)
    shift = 64 - min(BITS + 4, max(2, len(firsts).bit_length() + 2))
    cells: dict[int, list[int]] = {}
    for f in known:
        cells.setdefault(f >> shift, []).append(f)
    listed = [(c, bisect_left(known, c << shift), cells.get(c, [])) for c in range(-(1 << 63 - shift), 1 << 63 - shift)]  # up to 8 times the shards
    cell = rows.sparkSession.createDataFrame(listed, "cell long, before int, own array<bigint>")
    joined = rows.withColumn("cell", F.shiftright("h", shift)).join(F.broadcast(cell), "cell")
    return joined.withColumn("shard", F.col("before") + F.size(F.filter("own", lambda f: f <= F.col("h")))).drop(*cell.columns)


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("h"))
    rows = written(rows, "sizes")
    _, firsts, n = plan(rows.select("h", "size"), shards)
    # Row numbers of the whole order: ranges of it in partitions, counted from each partition's own ids.
    order = ["h", "doc_id"]
    placed = _sharded(rows, firsts).repartitionByRange(ranges(docs.sparkSession, n), *order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part"), "shard").agg(F.count("*").alias("n"), F.min("at").alias("first")).collect()  # a row per partition and cut
    before: dict[int, int] = {}
    starts = []
    for r in sorted(counts, key=lambda r: (r["part"], r["shard"])):
        starts.append((r["part"], r["shard"], before.get(r["shard"], 0) - r["first"]))
        before[r["shard"]] = before.get(r["shard"], 0) + r["n"]
    shift = docs.sparkSession.createDataFrame(starts, "part long, shard int, shift long")
    out = placed.withColumn("part", part).join(F.broadcast(shift), ["part", "shard"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
