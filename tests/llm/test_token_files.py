import functools
import random
import zlib

import numpy as np
import public_tokenizers as tokenizers_at
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import rans, token_files
from plumbline.llm.byte_units import UnitCache, units
from plumbline.llm.shared import scratch

PATH = tokenizers_at.path("byte_bpe_50k.json")


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ALPHABET = [" ", " ", "\n", "\t", "\xa0", "\x1c", "a", "é", "'s", "1", "!", "漢", "<|endoftext|>", "　", "word"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join))
def test_units_encode_as_the_whole_text(text):
    tok = tokenizer()
    assert "".join(units(text)) == text
    cache = UnitCache(lambda new: [tuple(x.ids) for x in tok.encode_batch(new, add_special_tokens=False)], most_bytes=5000)
    assert [i for p in cache.parts(text) for i in p] == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("sizes", [[1], [0, 5, 0], [31, 1, 33], [8192 * 3 + 17, 40_000], [rans.BLOCK], [rans.BLOCK + 1], [100_000, 3]])
def test_rans_round_trip(sizes):
    rng = np.random.default_rng(1)
    docs = [np.minimum(rng.zipf(1.3, n), 50_000).astype(np.uint32) for n in sizes]
    table = rans.Table.of_counts(np.bincount(np.concatenate(docs), minlength=10))
    assert table.freq.sum() == 1 << rans.PRECISION
    names = [None, *range(1, len(docs))]
    data = rans.pack(names, docs, table)
    got, lengths, ids = rans.unpack(data, table)
    assert got == names and list(lengths) == sizes and (ids == np.concatenate(docs)).all()
    broken = bytearray(data)
    broken[-1 - len(data) // 3] ^= 1
    with pytest.raises(ValueError):
        rans.unpack(bytes(broken), table)


def test_rare_symbols_keep_a_frequency():
    counts = np.ones(60_000, dtype=np.int64)
    counts[7] = 10**12
    table = rans.Table.of_counts(counts)
    assert table.freq.min() == 1 and table.freq.sum() == 1 << rans.PRECISION


def test_data_set_against_the_library(spark):
    tok = tokenizer()
    r = random.Random(2)
    rows = [(2**60 + k, "".join(r.choices(ALPHABET, k=r.randint(0, 60))), "x") for k in range(200)] + [(None, "null id", "x"), (5, None, "y"), (6, "", "y"), (7, "dup", "y"), (7, "dup", "y"), (8, "long " * 60_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(7)
    path = scratch(spark, "t")
    token_files.write_tokens(docs, path, PATH)
    got = sorted((x["start"], x["doc_id"], x["n_tokens"], x["ids_crc32"], bytes(x["ids"])) for x in token_files.read_tokens(spark, path, True).collect())
    start = 0
    for (at, doc, n, crc, raw), (want, text, _) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert (at, doc, n, raw) == (start, want, len(ids), ids.tobytes()) and crc == zlib.crc32(ids.tobytes())
        start += n


def test_empty_table(spark):
    path = scratch(spark, "t")
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert token_files.read_tokens(spark, path).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), max_size=6))
def test_batches_encode_as_whole_texts(texts):
    import pyarrow as pa

    ids, n = token_files.encode_batch(PATH, pa.array(["before", *texts], pa.string()).slice(1))
    want = [[*tokenizer().encode(t, add_special_tokens=False).ids, token_files.END] for t in texts]
    assert n.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
