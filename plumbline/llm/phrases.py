"""Phrases whose words go together more often than by chance, mined from all texts by language.

Texts are cut into pieces at punctuation, and identical pieces are counted once with their multiplicity: lines and
passages that many documents share cost no more than one. Rows are never shuffled by themselves: a task sums its pieces
in chunks with DuckDB and sends each hash bucket of pieces the chunk's sums as one compressed block, so a piece that is
everywhere costs a row in each chunk. A bucket sums its blocks, lists the phrases of up to LONGEST words of its pieces,
sums their multiplicities in chunks again and sends these to hash buckets of phrases. A bucket is counted in DuckDB,
which gets its blocks one by one and spills to disk beyond its memory (a folder of the task's own, gone at its end).
Only phrases found often enough leave a bucket: the parts of a candidate are as frequent as it is.

A candidate asks for the counts of its parts by shuffle: for each cut two requests (language, part) are joined to the
counts. A part that much of them ask for is a skewed key of an equi-join, whose partitions Spark splits. The lowest
score of a candidate's cuts is its own. Subphrases of frequent longer candidates are dropped by a join with their
maximum. Ranks within a language come from a sort by ranges, whose numbers are carried on from range to range, so one
language may have all candidates.

Defined results: null and empty texts have no words; a null language is `und`, together with one of that name; words
are whatever lies between spaces, tabs and the marks that end a piece, so other white space is part of a word; repeated
texts and pieces count as often as they come; phrases that tie in all but the name are ordered by UTF-8 bytes; texts of
any length are read whole; an empty table gives no rows. Columns other than text and lang are not read.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import let, numbered_within, ranges, small_batches, table, written

#: Fixed values of the rule: what ends a piece (spaces and tabs separate words), the words of a phrase, the least count, the
#: percentage of a longer phrase from which a shorter one is dropped, the length of a language's list.
ENDS = r"[.,;:!?\x0A-\x0D]"
SHORTEST, LONGEST, LEAST, PERCENT, LISTED = 2, 3, 10, 50, 2000

CHUNK = 4 << 20  # bytes of texts or pieces that are summed together
WORDS = 1 << 18  # words whose phrases are listed together, however long a piece is
MEMORY = "200MB"  # of a DuckDB; two tasks of an executor have one each
ITEMS = pa.schema([("lang", pa.string()), ("item", pa.string()), ("n", pa.int64())])  # pieces or phrases
#: A block: a row for each language, its items joined by line ends, which none of them holds; so they need no offsets.
PACKED = pa.schema([("lang", pa.string()), ("items", pa.string()), ("n", pa.list_(pa.int64()))])
COUNTED = pa.schema([("lang", pa.string()), ("k", pa.int8()), ("gram", pa.string()), ("n", pa.int64())])


def _folding() -> bytes:
    """A byte for each byte of UTF-8: capital letters become small, what ends a piece a line end, a tab a space."""
    table = bytearray(range(256))
    for c in range(256):
        letter = chr(c)
        table[c] = 10 if c < 128 and re.fullmatch(ENDS, letter) else 32 if letter == "\t" else c + 32 if "A" <= letter <= "Z" else c
    return bytes(table)


FOLDED = _folding()


def pieces_in(texts: pa.RecordBatch) -> pa.Table:
    """lang, item, n: the pieces of texts (lang, text), trimmed, one by one; those without words are left out."""
    text = texts.column(1)
    offsets, data = text.buffers()[1:]
    folded = pa.py_buffer(memoryview(data or b"").tobytes().translate(FOLDED))
    lists = pc.split_pattern(pa.Array.from_buffers(pa.string(), len(text), [None, offsets, folded], offset=text.offset), "\n")
    of = np.repeat(np.arange(len(text)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    rows = pa.table([texts.column(0).take(pa.array(of)), pc.utf8_trim(lists.flatten(), " "), pa.array(np.ones(len(of), np.int64))], schema=ITEMS)
    return rows.filter(pc.not_equal(rows["item"], ""))


def phrases(pieces: pa.Table, longest: int, block: int = WORDS) -> Iterator[pa.Table]:
    """Every phrase of the pieces, with the piece's n, so many words' phrases at a time."""
    lists = pc.split_pattern(pieces["item"].combine_chunks(), " ")
    word, of = lists.flatten(), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(word, "").to_numpy(zero_copy_only=False)  # where spaces follow each other
    if not real.all():
        word, of = word.filter(pa.array(real)), of[real]
    lang, n = pieces["lang"].combine_chunks(), pieces["n"].combine_chunks()
    ends = np.append(np.flatnonzero(of[1:] != of[:-1]) + 1, len(of)) if len(of) else np.zeros(0, np.int64)
    left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(of))  # words from here to the piece's end
    for a in range(0, len(of), block):
        here = left[a : a + block]
        for k in range(1, longest + 1):
            at = np.flatnonzero(here >= k) + a
            gram = word.slice(a, len(here)) if k == 1 else pc.binary_join_element_wise(*[word.take(pa.array(at + j)) for j in range(k)], " ")
            rows = pa.array(of[at])
            yield pa.Table.from_arrays([lang.take(rows), gram, n.take(rows)], schema=ITEMS)


class _Sums:
    """Sums in a DuckDB of the task's own, which spills into a folder that goes when the task ends."""

    def __enter__(self) -> _Sums:
        import duckdb

        self.folder = tempfile.TemporaryDirectory()
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.folder.name, "preserve_insertion_order": False})
        return self

    def __exit__(self, *_) -> None:
        self.con.close()
        self.folder.cleanup()

    def blocks(self, rows: pa.Table, buckets: int) -> pa.RecordBatch:
        """bucket, block: the sums of n by language and item, packed for each bucket."""
        con = self.con.cursor()
        con.register("chunk", rows)
        got = con.sql(f"SELECT (hash(lang, item) % {buckets})::INTEGER AS bucket, * FROM (SELECT lang, item, sum(n)::BIGINT AS n FROM chunk GROUP BY ALL) ORDER BY bucket, lang").to_arrow_table()
        con.close()
        bucket = got["bucket"].to_numpy()
        own, starts = np.unique(bucket, return_index=True)
        sums = got.select(ITEMS.names).cast(ITEMS).combine_chunks()
        parts = [_packed(sums.slice(a, z - a)) for a, z in zip(starts, [*starts[1:], len(bucket)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(parts, pa.binary())], ["bucket", "block"])

    def whole(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums of n over all blocks, which are read one by one."""
        con = self.con.cursor()
        con.register("blocks", pa.RecordBatchReader.from_batches(ITEMS, _unpacked(batches)))
        yield from con.sql("SELECT lang, item, sum(n)::BIGINT AS n FROM blocks GROUP BY ALL").to_arrow_reader(20_000)


def _packed(rows: pa.Table) -> bytes:
    """rows, sorted by lang, as a block."""
    runs = pc.run_end_encode(rows["lang"].combine_chunks())
    ends = pa.array(np.append(0, runs.run_ends.to_numpy()), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c in ("item", "n")]
    joined = pc.binary_join(lists[0], "\n")
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, PACKED, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_batch(pa.RecordBatch.from_arrays([runs.values, joined, lists[1]], schema=PACKED))
    return sink.getvalue().to_pybytes()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block in b.column(0):
            for held in pa.ipc.open_stream(block.as_buffer()):
                for k in range(held.num_rows):
                    row = held.slice(k, 1)
                    items = pc.split_pattern(row.column(1), "\n").flatten()
                    yield pa.RecordBatch.from_arrays([pa.repeat(row.column(0)[0], len(items)), items, row.column(2).flatten()], schema=ITEMS)


def _chunks(rows: Iterator[pa.Table], size: int) -> Iterator[pa.Table]:
    held, bytes_held = [], 0
    for t in rows:
        held.append(t)
        bytes_held += t.nbytes
        if bytes_held >= size:
            yield pa.concat_tables(held)
            held, bytes_held = [], 0
    if any(t.num_rows for t in held):
        yield pa.concat_tables(held)


def _keys(spark: SparkSession, buckets: int) -> Column:
    """An array of a number for each bucket, such that Spark's hash deals each bucket to a partition of its own.

    A sort by range would do so as well, but make all blocks twice, the first time only to sample them.
    """
    dealt = F.pmod(F.hash("id"), F.lit(buckets))
    first = spark.range(64 * buckets).select(F.col("id").cast("int").alias("id")).groupBy(dealt.alias("part")).agg(F.min("id").alias("id"))
    key = {r["part"]: r["id"] for r in first.collect()}  # a row for each bucket
    return F.from_json(F.lit(str([key.get(k, k) for k in range(buckets)])), "array<int>")


def pieces_of(docs: DataFrame, buckets: int, chunk: int = CHUNK) -> DataFrame:
    """bucket, block: pieces by hash bucket, summed within chunks of texts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Sums() as sums:
            for t in _chunks((pieces_in(b) for b in batches if b.num_rows), chunk):
                yield sums.blocks(t, buckets)

    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(send, "bucket int, block binary")


def counts(pieces: DataFrame, buckets: int, longest: int = LONGEST, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """lang, k, gram, n of every phrase of k words found least times, and a row with k = 0 for each language and bucket: n words.

    pieces: pieces_of().
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Sums() as sums:
            unique = (pa.Table.from_batches([b]).cast(ITEMS) for b in sums.whole(batches))
            for t in _chunks(unique, chunk):
                for listed in _chunks(phrases(t, longest), 10 * chunk):
                    yield sums.blocks(listed, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        with _Sums() as sums:
            for b in sums.whole(batches):
                b = b.append_column("k", pc.add(pc.count_substring(b["item"], " "), 1).cast(pa.int8()))
                single = pa.Table.from_batches([b.filter(pc.equal(b["k"], 1))])
                for r in single.group_by("lang").aggregate([("n", "sum")]).to_pylist():
                    words[r["lang"]] += r["n_sum"]
                often = b.filter(pc.greater_equal(b["n"], least))
                yield pa.RecordBatch.from_arrays([often[c] for c in ("lang", "k", "item", "n")], schema=COUNTED)
        if words:
            yield pa.RecordBatch.from_pylist([{"lang": lang, "k": 0, "gram": "", "n": n} for lang, n in words.items()], schema=COUNTED)

    keys = _keys(pieces.sparkSession, buckets)
    dealt = lambda blocks: blocks.withColumn("bucket", F.element_at(keys, F.col("bucket") + 1)).repartition(buckets, "bucket").select("block")
    listed = dealt(pieces).mapInArrow(send, "bucket int, block binary")
    return written(dealt(listed).mapInArrow(count, "lang string, k tinyint, gram string, n long"), "phrase-counts")


def scored(known: DataFrame) -> DataFrame:
    """lang, gram, k, a, l, r, score of every candidate; known: counts()."""
    candidates = known.filter(F.col("k") >= SHORTEST).select("lang", "gram", F.col("k").cast("int").alias("k"), F.col("n").alias("a"))
    cut = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.expr("substring_index(gram, ' ', cut)").alias("part")), F.struct(F.lit(1).alias("side"), F.expr("substring_index(gram, ' ', cut - k)").alias("part")))
    asked = cut.select("lang", "gram", "k", "a", "cut", F.inline(sides))
    answers = known.filter("k > 0").select("lang", F.col("gram").alias("part"), F.col("n").alias("f"))
    found = asked.join(answers, ["lang", "part"]).repartition("lang", "gram")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cuts = found.groupBy("lang", "gram", "k", "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))
    whole = {c: F.col(c).cast("decimal(19,0)") for c in "alr"}
    score = F.expr("(x.a * x.a * 1000000BD) div (x.l * x.r)")
    cuts = cuts.withColumn("x", F.struct(*[v.alias(c) for c, v in whole.items()])).withColumn("score", score)
    best = cuts.groupBy("lang", "gram", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "gram", "k", "a", "best.l", "best.r", "best.score")


def unabsorbed(candidates: DataFrame, percent: int = PERCENT) -> DataFrame:
    """candidates without those that lie in a longer one that is frequent enough beside them."""
    words = F.split("gram", " ")
    inner = let(words, lambda w: F.flatten(F.transform(F.sequence(F.lit(SHORTEST), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.array_join(F.slice(w, at, size), " ")))))
    longer = candidates.filter(F.col("k") > SHORTEST).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(inner)).alias("gram"))
    longer = longer.groupBy("lang", "gram").agg(F.max("longer").alias("longer"))
    absorbed = F.coalesce(100 * F.col("longer") >= percent * F.col("a"), F.lit(False))
    return candidates.join(longer, ["lang", "gram"], "left").filter(~absorbed).drop("longer")


def collocations(docs: DataFrame, listed: int = LISTED, longest: int = LONGEST, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first of each language by score, count and phrase."""
    buckets = ranges(docs.sparkSession, 1)
    known = counts(pieces_of(docs, buckets, chunk), buckets, longest, least, chunk)
    n = known.filter("k = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    kept = unabsorbed(written(scored(known), "phrase-scores"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("gram")]
    ranked = numbered_within(kept, "lang", order, "rank", buckets).filter(F.col("rank") <= listed)
    return ranked.join(n, "lang").select("lang", "rank", F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")


def op13_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


OP13_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws, count(*) AS m FROM p GROUP BY ALL),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS gram, sum(m)::BIGINT AS f
      FROM (SELECT lang, ws, m, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) z) y GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, gram, string_split(gram, ' ') AS ws, f AS a FROM g WHERE k > 1 AND f >= 10),
cut AS (SELECT lang, k, gram, a, array_to_string(ws[:x], ' ') AS lp, array_to_string(ws[x + 1:], ' ') AS rp, x FROM (SELECT *, unnest(range(1, k)) AS x FROM c) z),
s AS (SELECT cut.lang, cut.k, cut.gram, a, x, lf.f AS l, rf.f AS r, ((1000000::HUGEINT * a * a) // (lf.f::HUGEINT * rf.f))::BIGINT AS score
      FROM cut JOIN g lf ON lf.lang = cut.lang AND lf.gram = lp JOIN g rf ON rf.lang = cut.lang AND rf.gram = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, x) = 1),
i AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS gram, max(a) AS longer FROM (SELECT *, unnest([1, 2]) AS i FROM c WHERE k = 3) z GROUP BY ALL),
o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.gram = b.gram WHERE longer IS NULL OR 100 * longer < 50 * a),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(gram)) AS rank FROM o)
SELECT q.lang, rank, gram AS phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000
"""
