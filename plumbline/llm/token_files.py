"""Token-id files: documents are encoded with a tokenizer and stored by rans.py, in ascending order of doc_id.

Writing takes three passes: texts become ids (a table in the shared folder), the ids are counted, and the ids, sorted
by range of doc_id, are packed file by file. A data set is a folder with the shared frequency table and a table of
files, each row one file with its place: the range partition that made it and the ids before it there. Only sums by
partition meet on the driver.

Defined results: a null text is empty and has the end id alone; a null doc_id comes first; rows that share a doc_id
are ordered by length and checksum of their ids; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from . import rans
from .byte_units import UnitCache, flat
from .shared import ranges, scratch, small_batches, table, written

END = 2
FILE_IDS = 1 << 20
PART_IDS = 32 << 20  # ids of a range of documents, on average
TOGETHER = 12 << 20  # bytes of texts that are encoded together
CACHED = 320 << 20  # bytes of units that a worker remembers; tasks of a table share most of them, so they stay from task to task
_open: dict[str, UnitCache] = {}


def _cache(path: str) -> UnitCache:
    """One tokenizer and one cache for each Python worker."""
    if path not in _open:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        kind = _kind(tokenizer.get_vocab_size())
        length = np.zeros(1 + max(tokenizer.get_vocab().values()), np.int64)
        for token, k in tokenizer.get_vocab().items():
            length[k] = len(token)  # a token of this vocabulary has a character for each byte

        def each(new: list[str]) -> list[bytes]:
            return [np.array(x.ids, dtype=kind).tobytes() for x in tokenizer.encode_batch_fast(new, add_special_tokens=False)]

        def row(new: list[str]) -> list[bytes]:
            """All units in one call, which costs much less; the tokens' lengths in bytes tell the units apart."""
            ids = np.array(tokenizer.encode_batch_fast(["".join(new)], add_special_tokens=False)[0].ids, dtype=kind)
            ends = np.cumsum([len(x.encode()) for x in new])
            cut = np.searchsorted(np.cumsum(length[ids]), ends) + 1
            raw, width, at = ids.tobytes(), ids.itemsize, [0, *cut.tolist()]
            return [raw[width * a : width * b] for a, b in zip(at[:-1], at[1:], strict=True)]

        _open[path] = UnitCache(each, row, CACHED)
        _open[path].kind = kind
    return _open[path]


def _kind(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def larger(batches: Iterator[pa.RecordBatch], size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches put together up to a size, so that fewer of their units differ and must be looked up."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= size:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def encode_batch(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, none null, in a row, each text's followed by the end id, and how many each text has."""
    cache = _cache(path)
    ids, n = flat(cache, texts, cache.kind)
    return np.insert(ids, np.cumsum(n), END), n + 1


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, width (bytes of an id), ids (binary, with the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in larger(batches):
            ids, n = encode_batch(path, b.column(1))
            width = ids.itemsize
            ends = np.append(0, np.cumsum(n)) * width
            if ends[-1] < 1 << 31:
                parts = [(0, len(n))]
            else:  # more than an array of cells can hold: document by document
                parts = [(k, k + 1) for k in range(len(n))]
            raw = ids.view(np.uint8)
            for a, z in parts:
                data = pa.py_buffer(raw[ends[a] : ends[z]])
                cells = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((ends[a : z + 1] - ends[a]).astype(np.int32)), data])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(np.full(z - a, width), pa.int32()), cells], ["doc_id", "width", "ids"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, width int, ids binary")


def counts(ids: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for width, rows in b.groupby("width"):
                more = np.bincount(np.frombuffer(b"".join(rows["ids"]), f"<u{width}"))
                total, small = (more, total) if len(more) > len(total) else (total, more)
                total[: len(small)] += small
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    got = ids.mapInPandas(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row per id of the vocabulary
    out = np.zeros(1 + max((r["id"] for r in got), default=-1), np.int64)
    for r in got:
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Writes a data set of all documents to path."""
    spark = docs.sparkSession
    ids = written(encoded(docs, tokenizer), "ids", compression="zstd")
    seen = counts(ids)
    freq = rans.Table.of_counts(seen).freq.astype(np.int64)
    spark.createDataFrame([(k, int(n)) for k, n in enumerate(freq) if n], "id long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared, part, start = rans.Table(freq), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        size = 0

        def file() -> pd.DataFrame:
            nonlocal names, held, size, start
            out = pd.DataFrame({"part": [part], "start": [start], "n_ids": [size], "data": [rans.pack(names, held, shared)]})
            names, held, size, start = [], [], 0, start + size
            return out

        for b in batches:
            for name, width, data in zip(b["doc_id"], b["width"], b["ids"], strict=True):
                names.append(None if pd.isna(name) else int(name))
                held.append(np.frombuffer(data, f"<u{width}"))
                size += len(held[-1])
                if size >= FILE_IDS:
                    yield file()
        if names:
            yield file()

    parts = ranges(spark, int(seen.sum()), PART_IDS)
    order = ["doc_id", "size", "crc"]
    ranged = ids.withColumns({"size": F.octet_length("ids"), "crc": F.crc32("ids")}).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged.select(F.col("doc_id").cast("string"), "width", "ids").mapInPandas(run, "part int, start long, n_ids long, data binary").write.option("compression", "uncompressed").parquet(f"{path}/files")


def read_table(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/table").collect()
    freq = np.zeros(1 + max(r["id"] for r in rows), np.int64)
    for r in rows:
        freq[r["id"]] = r["freq"]
    return freq


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a data set and, if asked for, ids (binary, 4 bytes each)."""
    small_batches(spark)
    freq = read_table(spark, path)
    files = spark.read.schema("part int, start long, n_ids long, data binary").parquet(f"{path}/files")
    totals = {r["part"]: r["n"] for r in files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # a row per partition
    before, n = {}, 0
    for part in sorted(totals):
        before[part], n = n, n + totals[part]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shared = rans.Table(freq)
        for b in batches:
            for part, start, data in zip(b["part"], b["start"], b["data"], strict=True):
                names, lengths, ids = rans.unpack(data, shared)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                own = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                out = {"doc_id": pd.array(names, dtype="Int64"), "start": before[part] + start + ends - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": [zlib.crc32(x) for x in own]}
                yield pd.DataFrame(out | ({"ids": [bytes(x) for x in own]} if with_ids else {}))

    return files.select("part", "start", "data").mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, path)
