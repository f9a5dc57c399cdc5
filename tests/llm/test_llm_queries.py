"""The queries themselves over whole tables: against their SQL, or against plain Python."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as tokenizers_at
import pytest
from oracle import SF, compare
from test_pairs import components_of, fingerprint
from test_rules_shards_mix import measures, mix
from test_trie_pack_phrases import packed_by_hand

from plumbline.llm import gbt_quality, quality_rules, queries

pytestmark = pytest.mark.skipif(not SF.exists(), reason="no tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    compare(spark, queries.QUERIES[name], queries.ORACLES[name])


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def multi():
    import base64

    import tiktoken

    with open(tokenizers_at.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers_at.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_op1(spark, documents):
    from tokenizers import Tokenizer

    tok, start, want = Tokenizer.from_file(tokenizers_at.path("byte_bpe_50k.json")), 0, []
    for d, text, _ in sorted(documents):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.QUERIES["op1_rans_token_files"](spark, str(SF)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_op5(spark, documents):
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_gbt_quality"](spark, str(SF)).collect()}
    assert got.keys() == {d for d, _, _ in documents}
    trees = gbt_quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    for d, text, _ in documents:
        score = trees.score(np.array([gbt_quality.statistics(text or "")], np.float32))[0]
        assert got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) and got[d]["score"] == pytest.approx(score) and got[d]["predicted"] == (got[d]["score"] >= 0.5)


def linked(prints):
    """The component of each of the given fingerprints, every pair looked at."""
    nodes = sorted(set(prints))
    return components_of(nodes, [(p, q) for i, p in enumerate(nodes) for q in nodes[:i] if (p ^ q).bit_count() <= 3])


def test_op6(spark, documents):
    prints = {d: fingerprint(text) for d, text, _ in documents}
    of, least = linked(prints.values()), {}
    for d, p in prints.items():
        least[of[p]] = min(d, least.get(of[p], d))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op6_simhash_tiles"](spark, str(SF)).collect()}
    assert got == {d: (f"{p:016x}", least[of[p]]) for d, p in prints.items()}


def test_op10(spark, documents):
    library = multi()
    got = {r["doc_id"]: tuple(r)[1:4] for r in queries.QUERIES["op10_prefix_bpe"](spark, str(SF)).collect()}
    assert got == {d: encoded(library, text) for d, text, _ in documents}


def kept_by_rules(documents):
    """The rules and hosts' verdicts in plain Python."""
    limits, counts, hosts = quality_rules.Limits(), {}, {}
    for d, text, source in documents:
        words, _, symbols, dup, repeats = measures(text)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n"))
        failed = (words < 10 or 100 * repeats > 20 * words, 100 * symbols > limits.max_symbols_per_100_words * words, 100 * dup > limits.max_dup_line_percent * lines)
        counts[d] = failed
        n, x = hosts.get(source, (0, [0, 0, 0]))
        hosts[source] = n + 1, [a + b for a, b in zip(x, failed)]
    docs, bad = len(documents), set()
    for k, top in enumerate((limits.base_rate, limits.symbol_rate, limits.line_rate)):
        mean, square = sum(x[k] for _, x in hosts.values()) / docs, sum(x[k] ** 2 / n for n, x in hosts.values()) / docs
        a, b = quality_rules.prior(mean, square, len(hosts), docs)
        bad |= {h for h, (n, x) in hosts.items() if (x[k] + a) / (n + a + b) > top}
    return [r for r in documents if not counts[r[0]][0] and r[2] not in bad]


def test_pipeline(spark, documents):
    import corpus_pipeline

    trees = gbt_quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scores = trees.score(np.array([gbt_quality.statistics(t or "") for _, t, _ in documents], np.float32))
    docs = kept_by_rules([r for r, s in zip(documents, scores) if s >= 0.5])
    prints = {d: fingerprint(text) for d, text, _ in docs}
    of, least = linked(prints.values()), {}
    for d, p in prints.items():
        least[of[p]] = min(d, least.get(of[p], d))
    docs = [r for r in docs if r[0] in set(least.values())]
    library, want = multi(), []
    shares = {d: (size, taken) for d, size, _, _, taken in mix(docs)}
    for d, text, _ in docs:
        size, taken = shares[d]
        want += [(d, *encoded(library, text))] * (taken // size if size else 0)
    assert want and sorted(map(tuple, corpus_pipeline.run(spark, str(SF)).collect())) == sorted(want)


def test_op12(spark, documents):
    from tokenizers import Tokenizer

    tok, want = Tokenizer.from_file(tokenizers_at.path("byte_bpe_50k.json")), []
    for d, text, _ in documents:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        want += [(d, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    got = queries.QUERIES["op12_large_item_packing"](spark, str(SF)).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    used = {}
    for r in got:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(used) == packed_by_hand([r["length"] for r in got], 1024)
