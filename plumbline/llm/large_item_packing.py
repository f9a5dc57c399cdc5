"""Packing documents into sequences of tokens: large items are matched, small ones fill the gaps they fit best.

Documents are encoded once, into a table of pieces: one longer than a sequence is cut into whole sequences, with what
is left over in front. How pieces can share sequences depends only on their lengths, so the plan is made from the
number of pieces of each length: at most as many numbers as a sequence has tokens, whatever the corpus.

Pieces longer than a third of a sequence come at most two to a sequence: from the longest down, each is matched with
the longest other that fits beside it. The shorter ones follow, longest first, each into the fullest sequence that has
room for it, and as many of it as fit; where none has room a new sequence begins. All this is done for whole runs of
equal pieces, so the plan is a list of runs: of a length, from which piece to which, so many to a sequence, from which
sequence on, at which offset. It grows with the lengths, not with the pieces, and is broadcast.

A piece finds its run by its number among those of its length. It is counted in its own task while encoding; what the
tasks before hold of each length is summed in a table of (task, length), which is joined to the pieces by shuffle.

Defined results: null and empty texts are the end id alone; null and repeated doc_ids are documents of their own; an
empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import small_batches, table, written
from .token_files import encode_batch, larger

CAPACITY = 1024
SENT = 1 << 13  # pieces that a task hands over at a time, however long a text is


@dataclass(frozen=True)
class Run:
    """Pieces first to first + n - 1 of a length: each to a sequence, from sequence on, side by side from offset."""

    length: int
    first: int
    n: int
    each: int
    sequence: int
    offset: int


class _Gaps:
    """Runs of open sequences (first, n) by the room they have left."""

    def __init__(self, capacity: int):
        self.capacity, self.sizes, self.runs = capacity, [], {}

    def put(self, gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in self.runs:
                insort(self.sizes, gap)
            self.runs.setdefault(gap, []).append((first, n))

    def best(self, length: int) -> tuple[int, int, int] | None:
        """The gap that fits best, taken out: its size, first sequence and number of sequences."""
        k = bisect_left(self.sizes, length)
        if k == len(self.sizes):
            return None
        gap = self.sizes[k]
        first, n = self.runs[gap].pop()
        if not self.runs[gap]:
            del self.runs[gap]
            self.sizes.pop(k)
        return gap, first, n


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """counts: pieces of each length from 1 to capacity."""
    left, taken = {k: n for k, n in counts.items() if n}, dict.fromkeys(counts, 0)
    runs: list[Run] = []
    gaps, sequences = _Gaps(capacity), 0

    def take(length: int, n: int, each: int, sequence: int, offset: int) -> None:
        runs.append(Run(length, taken[length], n, each, sequence, offset))
        taken[length] += n
        left[length] -= n

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = next((j for j in range(len(large) - 1, -1, -1) if large[j] + a <= capacity and left[large[j]] > (j == len(large) - 1)), None)
        if k is None:
            n, used = left[a], a
            take(a, n, 1, sequences, 0)
        elif large[k] == a:
            n, used = left[a] // 2, 2 * a
            take(a, 2 * n, 2, sequences, 0)
        else:
            n, used = min(left[a], left[large[k]]), a + large[k]
            take(a, n, 1, sequences, 0)
            take(large[k], n, 1, sequences, a)
        gaps.put(capacity - used, sequences, n)
        sequences += n
    for a in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[a]:
            found = gaps.best(a)
            if found is None:
                found = (capacity, sequences, -(-left[a] // (capacity // a)))
                sequences += found[2]
            gap, first, n = found
            each = gap // a
            full = min(n, left[a] // each)
            if full:
                take(a, full * each, each, first, capacity - gap)
                gaps.put(gap - each * a, first, full)
            if full < n:
                rest = left[a] if left[a] < each else 0
                if rest:
                    take(a, rest, rest, first + full, capacity - gap)
                    gaps.put(gap - rest * a, first + full, 1)
                    full += 1
                gaps.put(gap, first + full, n - full)
    return runs


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, 4 bytes each), task, number (from 0, of the task's pieces of that length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in larger(batches):
            ids, n = encode_batch(tokenizer, b.column(1))
            # A document's pieces follow each other, so the pieces' ends cut the ids of all documents in a row.
            count = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = (n - 1) % capacity + 1
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            order = np.argsort(length, kind="stable")
            run_of = np.searchsorted(length[order], length)  # where the run of its length begins
            number = np.empty(len(doc), np.int64)
            number[order] = np.arange(len(doc))
            number += seen[length] - run_of
            seen += np.bincount(length, minlength=capacity + 1)
            ids = ids.astype("<u4")
            ends = np.cumsum(length)
            for a in range(0, len(doc), SENT):
                z = min(a + SENT, len(doc))
                at = np.append(ends[a] - length[a], ends[a:z])
                data = pa.py_buffer(ids[at[0] : at[-1]])
                cells = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(((at - at[0]) * 4).astype(np.int32)), data])
                column = lambda v, kind: pa.array(v[a:z], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(doc[a:z])), column(piece, pa.int32()), column(start, pa.int64()), column(length, pa.int64()), cells, pa.array(np.full(z - a, own), pa.int32()), column(number, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids", "task", "number"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, task int, number long")
    return written(made, "pieces", compression="zstd")


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset."""
    spark = pieces.sparkSession
    held = written(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs: dict[int, list[Run]] = {}
    for r in plan(counts, capacity):
        runs.setdefault(r.length, []).append(r)
    kind = "length long, runs array<struct<first: long, each: long, sequence: long, offset: long>>"
    listed = spark.createDataFrame([(k, [(r.first, r.each, r.sequence, r.offset) for r in v]) for k, v in runs.items()], kind)
    before = held.select("length", "task", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    rows = pieces.join(before, ["length", "task"]).join(F.broadcast(listed), "length")
    number = F.col("number") + F.col("before")
    run = F.element_at(F.filter("runs", lambda r: r["first"] <= F.col("rank")), -1)
    rows = rows.withColumn("rank", number).withColumn("run", run).withColumn("in_run", F.col("rank") - F.col("run.first"))
    sequence = F.col("run.sequence") + F.floor(F.col("in_run") / F.col("run.each"))
    offset = F.col("run.offset") + F.col("in_run") % F.col("run.each") * F.col("length")
    return rows.select(*[c for c in pieces.columns if c not in ("task", "number")], sequence.cast("long").alias("sequence_id"), offset.alias("offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids, sequence_id, offset."""
    return placed(pieces_of(docs, tokenizer, capacity), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """A row per sequence: sequence_id, length, ids (binary) and pieces (offset, doc_id, piece, length), for training."""
    one = F.struct("offset", "doc_id", "piece", "length", "ids")
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(one)).alias("held"))  # capacity pieces at most
    ids = F.unhex(F.array_join(F.transform("held", lambda x: F.hex(x["ids"])), ""))
    pieces = F.transform("held", lambda x: F.struct(x["offset"].alias("offset"), x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["length"].alias("length")))
    return held.select("sequence_id", F.aggregate("held", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"), ids.alias("ids"), pieces.alias("pieces"))


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    # Checksums are taken before the pieces move, so the ids stay where they are.
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
