"""WARC, chat and BPE: round trips and brute force; the classifier: held-out accuracy; the pipeline as a whole."""

import base64
import collections
import functools
import gzip
import hashlib
import math
import os
import random

import numpy as np
import public_tokenizers as tokenizers_at
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chat_format, gbt_quality, prefix_bpe, warc_transactions
from plumbline.llm.shared import scratch

PATH = tokenizers_at.path("byte_bpe_multi_50k.tiktoken")


def test_warc(spark):
    html = ["<p>a</p>", "x\r\n\r\nWARC/1.1\r\nContent-Length: 3", "", None, "é漢", "y" * 200_000, "<p>a</p>"]
    rows = [(k + 10, f"http://h/{k}\r\nX: y", t, "n") for k, t in enumerate(html)] + [(k, "u", "hot", "n") for k in range(200, 260)] + [(None, None, "hot", "n"), (None, "u", "lone", "n"), (10, "http://h/0\r\nX: y", "<p>a</p>", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    path = scratch(spark, "warc")
    warc_transactions.write_warc(pages, path)
    recs = warc_transactions.records(spark, path, with_payload=True)
    assert recs.count() == 3 * len(rows)
    got = warc_transactions.transactions(recs).collect()
    least = {}
    for d, _, t, _ in rows:
        t = t or ""
        least[t] = min(x for x in (d, least.get(t)) if x is not None) if d is not None or least.get(t) is not None else None
    want = []
    for d, _, t, _ in rows:
        t = t or ""
        revisit = least[t] is not None and d != least[t]
        want.append((d or -1, len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "revisit" if revisit else "response", least[t] if revisit else -1))
    have = [(r["metadata"]["page_id"] or -1, r["response"]["payload_bytes"], r["response"]["payload_digest"], r["response"]["type"], r["metadata"]["refers_to_page"] or -1) for r in got]
    assert sorted(have) == sorted(want)
    by_id = {r["capture_id"]: r for r in got}
    for r in got:
        assert r["n_request"] >= 1 and r["request"]["uri"] == r["uri"] and "\n" not in r["uri"]
        if r["response"]["type"] == "revisit":
            assert by_id[r["response"]["refers_to"]]["response"]["payload_digest"] == r["response"]["payload_digest"]
        else:
            assert len(r["response"]["payload"]) == r["response"]["payload_bytes"]
    only_large = scratch(spark, "warc")
    warc_transactions.write_warc(pages, only_large, min_revisit=5)
    kinds = {(r["payload_bytes"], r["type"]) for r in warc_transactions.records(spark, only_large).filter("payload_bytes is not null").collect()}
    assert (3, "response") in kinds and (3, "revisit") not in kinds and (8, "revisit") in kinds


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_warc_without_a_broadcast_and_in_small_files(spark, monkeypatch, compression):
    monkeypatch.setattr(warc_transactions, "BROADCAST_FIRSTS", 0)
    monkeypatch.setattr(warc_transactions, "FILE_BYTES", 200_000)
    rows = [(k, f"http://h/{k}", "hot" if k % 3 else f"page {k} " * 1000) for k in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = scratch(spark, "warc")
    warc_transactions.write_warc(pages, path, compression=compression)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    assert len(files) > 4 and (compression == "gzip" or max(f["length"] for f in files) < 1_500_000)
    got = {r["metadata"]["page_id"]: (r["response"]["type"], r["metadata"]["refers_to_page"], r["response"]["payload_bytes"]) for r in warc_transactions.transactions(warc_transactions.records(spark, path)).collect()}
    assert got == {k: ("revisit", 1, 3) if k % 3 and k != 1 else ("response", None, len(t)) for k, _, t in rows}


def test_warc_of_many_gzip_members_and_strange_records():
    first = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nx: y\r\n\r\n"
    second = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <b>\r\nContent-Length: 8\r\n\r\nH\r\n\r\nabc\r\n\r\n"
    got = list(warc_transactions.parse(gzip.compress(first) + gzip.compress(second)))
    assert [r["type"] for r in got] == ["warcinfo", "response"] and got[1]["payload_bytes"] == 3
    with pytest.raises(ValueError):
        list(warc_transactions.parse(second[:-1]))
    with pytest.raises(ValueError):
        list(warc_transactions.parse(b"junk\r\n" + first))


def test_warc_empty(spark):
    path = scratch(spark, "warc")
    warc_transactions.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_transactions.transactions(warc_transactions.records(spark, path)).count() == 0


def test_chat(spark):
    tricky = [chat_format.PROBE, "\\\\h \\t </turn>\n### x: ####", "", None, "a\\", "### Assistant: hi</turn></turn>", "漢字 \\c:", "\\h##\\"]
    roles = ["system", "user", "assistant", "a: b</turn>###", None, "user", "assistant", "\\c"]
    convs = {1: ["user", "assistant"], 2: ["system", "user", "assistant", "user"], 3: ["assistant"], 4: ["system", "user", "assistant", "user", "assistant"], 5: roles, None: ["user"], 6: ["user", "user", "assistant"]}
    rows = [(c, k, role, tricky[(k + (c or 0)) % len(tricky)], "e") for c, rs in convs.items() for k, role in enumerate(rs)] + [(7, None, "user", "q", "e"), (7, 0, "assistant", "r", "e"), (7, 0, "assistant", "r", "e")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string").repartition(4)
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1, role or "", text or "") for x, t, role, text, _ in rows if x == c))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        r = got[c]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x}\n{t}\n" for _, x, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert {c: r["valid"] for c, r in got.items()} == {1: True, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False, None: False}
    assert got[2]["state"] == "user" and got[3]["state"] == "bad"
    assert chat_format.digests(chat_format.format_chats(df.filter("false"))).count() == 0


@pytest.mark.parametrize("template", [chat_format.Template(open="[INST] ", after_role="|", close="[/INST]\n"), chat_format.Template(open="<|im_start|>", after_role=" >> ", close="<|im_end|>"), chat_format.Template(open="", after_role="##", close="##.*$(\n")])
def test_other_templates_come_back(spark, template):
    controls = [template.open, template.after_role, template.close, template.open.strip(), template.close.strip(), "\\", "h", "t", "\n", "x"]
    r = random.Random(1)
    rows = [(c, k, "".join(r.choices([*controls, "user", "assistant"], k=r.randint(1, 3))), "".join(r.choices(controls, k=r.randint(0, 9)))) for c in range(40) for k in range(3)] + [(99, 0, "user", "q"), (99, 1, "assistant", template.close * 3), (99, 2, "user", "long " * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chats = chat_format.format_chats(df, template)
    from pyspark.sql import functions as F

    got = {x["conv_id"]: [(p["role"], p["text"]) for p in x["turns"]] for x in chats.select("conv_id", chat_format.parse(F.array_join(F.col("segments.text"), ""), template).alias("turns")).collect()}
    assert got == {c: [(role, text) for d, _, role, text in rows if d == c] for c in {x[0] for x in rows}}
    loss = chat_format.digests(chats, template).filter("conv_id = 99").first()
    assert loss["loss_sha256"] == hashlib.sha256((template.close * 3).encode()).hexdigest()


def test_templates_that_cannot_be_read_back_are_refused():
    for wrong in ({"close": " \n"}, {"after_role": " "}, {"open": "\\a"}):
        with pytest.raises(ValueError):
            chat_format.Template(**wrong)


@functools.cache
def coder():
    return prefix_bpe.coder(PATH, tokenizers_at.PATTERN)


@functools.cache
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizers_at.PATTERN, mergeable_ranks=coder().merges.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="abcdeinrst  '\n1é漢", max_size=80)))
def test_bpe_against_the_library(text):
    ids = coder().encode(text)
    assert ids == ",".join(map(str, library().encode_ordinary(text))) and coder().decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 60), st.integers(0, 5), st.binary(max_size=6))
def test_prefixes_append_and_edit(piece, at, cut, new):
    m = coder().merges
    p = prefix_bpe.Prefixes(m, piece[:7])
    p.append(piece[7:])
    assert p.last == prefix_bpe.Prefixes(m, piece).last
    for end in range(len(piece) + 1):
        assert p.encoding(end) == [m.ranks[x] for x in m.merge(piece[:end])]
    at = min(at, len(piece))
    p.replace(at, min(len(piece), at + cut), new)
    changed = piece[:at] + new + piece[min(len(piece), at + cut) :]
    assert p.piece == changed and p.last == prefix_bpe.Prefixes(m, changed).last


def test_an_edit_stays_near(spark):
    p = prefix_bpe.Prefixes(coder().merges, b"thequickbrownfoxjumpsoverthelazydog" * 60)
    assert p.replace(100, 101, b"zz") < 400


def test_bpe_documents(spark):
    rows = [(1, None), (2, ""), (3, "hello  world\n\n x"), (None, "a"), (3, "hello  world\n\n x"), (2**60, "b" * 50_000), (5, "<|endoftext|>")]
    df = spark.createDataFrame([(*r, "i") for r in rows], "doc_id long, text string, ids string").repartition(3)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in prefix_bpe.encode_documents(df, PATH, tokenizers_at.PATTERN).collect())
    want = []
    for d, t in rows:
        ids = library().encode_ordinary(t or "")
        want.append((d or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert prefix_bpe.encode_documents(df.filter("false"), PATH, tokenizers_at.PATTERN).count() == 0


def quality_rows(n):
    r = random.Random(4)
    good = lambda: ". ".join(" ".join(r.choices(["river", "stone", "walks", "bright", "under", "a", "the"], k=12)).capitalize() for _ in range(r.randint(1, 8))) + "."
    bad = lambda: r.choice([lambda: "BUY NOW!! " * r.randint(3, 60), lambda: "same " * r.randint(8, 80), lambda: " | ".join(r.choices(["aa", "bb"], k=30))])()
    return [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(n)]


def test_classifier(spark):
    rows = quality_rows(600)
    docs = spark.createDataFrame([(k, t, 0.5) for k, t, _ in rows] + [(9000, None, 0.1), (9001, "", 0.1), (None, "x", 0.1), (1, rows[1][1], 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in rows] + [(9001, 7, 0), (1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in gbt_quality.classify(docs, labels).collect()}
    held = [(got[k]["predicted"], y) for k, _, y in rows if gbt_quality.fold(k) == 1]
    assert all(got[k]["held_out"] == (gbt_quality.fold(k) == 1) for k, _, _ in rows) and not got[None]["held_out"]
    assert sum(p == y for p, y in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values()) and 9000 in got
    swapped = labels.withColumn("quality", labels["quality"]).filter("doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")
    same = {r["doc_id"]: r["score"] for r in gbt_quality.classify(docs, swapped).collect()}
    assert same == {k: r["score"] for k, r in got.items()}  # labels held out change nothing
    none = gbt_quality.classify(docs, labels.filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    kept = gbt_quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert gbt_quality.classify(docs.filter("false"), labels).count() == 0 and gbt_quality.keep_good(docs.filter("false"), labels).count() == 0


def test_statistics():
    text = "Alpha beta beta GAMMA\n\n12 http://x.y ok! |\nAlpha beta beta GAMMA\n"
    got = dict(zip(gbt_quality.NAMES, gbt_quality.statistics(text), strict=True))
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, threes = len(text), [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = collections.Counter(text)
    want = {
        "log_bytes": math.log1p(n), "log_words": math.log1p(len(words)), "word_length": sum(map(len, words)) / len(words), "long_words": sum(len(w) > 12 for w in words) / len(words), "short_words": sum(len(w) < 3 for w in words) / len(words),
        "distinct_words": len(set(words)) / len(words), "top_word": max(map(words.count, words)) / len(words), "repeat_next": sum(a == b for a, b in zip(words, words[1:])) / len(words), "log_lines": math.log1p(len(lines)), "line_words": len(words) / len(lines),
        "blank_lines": 1 - len(lines) / len(text.split("\n")), "dup_lines": 1 - len(set(lines)) / len(lines), "upper": sum("A" <= c <= "Z" for c in text) / n, "digits": sum(c.isdigit() for c in text) / n, "spaces": sum(c in " \n" for c in text) / n,
        "points": sum(c in ".,;:?'\"()-" for c in text) / n, "symbols": sum(c in "#*$%&<>@^~_=+/\\{}[]`" for c in text) / n, "exclaims": text.count("!") / n, "bars": text.count("|") / n, "high_bytes": 0, "entropy": -sum(c / n * math.log2(c / n) for c in counts.values()),
        "capital_words": sum(w[0].isupper() for w in words) / len(words), "end_points": sum(x[-1] in ".!?" for x in lines) / len(lines), "short_lines": sum(len(x) < 40 for x in lines) / len(lines), "longest_run": math.log1p(1), "links": text.count("http") / len(words),
        "upper_words": sum(w.isupper() for w in words) / len(words), "symbol_words": 0, "window_repeats": 1 - len(set(threes)) / len(threes),
    }
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items())
    assert len(gbt_quality.statistics("")) == len(gbt_quality.NAMES) and np.isfinite(gbt_quality.statistics("")).all()
    assert np.isfinite(gbt_quality.statistics("word " * 400_000)).all()


def test_fit_takes_the_best_cut(monkeypatch):
    """One tree of one level against a search over every cut of every statistic."""
    monkeypatch.setattr(gbt_quality, "TREES", 1)
    monkeypatch.setattr(gbt_quality, "DEPTH", 1)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (120, 3)).astype(np.float32)  # fewer values than bins: every cut is tried
    y = ((x[:, 1] > 4) ^ (rng.random(120) < 0.1)).astype(float)
    t = gbt_quality.fit(x, y)
    p = y.mean()
    g, h = p - y, np.full(120, p * (1 - p))

    def gain(m):
        return g[m].sum() ** 2 / (h[m].sum() + gbt_quality.L2)

    cuts = {(f, c): gain(x[:, f] < c) + gain(x[:, f] >= c) for f in range(3) for c in np.unique(x[:, f])[1:]}
    best = max(cuts.values())
    f, c = int(t.feature[0, 0]), float(t.cut[0, 0])
    assert gain(x[:, f] < c) + gain(x[:, f] >= c) == pytest.approx(best)
    left = x[:, f] < c
    want = [-gbt_quality.RATE * g[m].sum() / (h[m].sum() + gbt_quality.L2) for m in (left, ~left)]
    assert np.allclose(t.value[0], want) and t.base == pytest.approx(np.log(p / (1 - p)))


def test_sample_is_bounded_and_stable(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(3000)] + [(5, 0)] * 40 + [(None, 1), (7, 9)], "doc_id long, quality int")
    few = [tuple(r) for r in gbt_quality.sample(labels, 50).collect()]
    assert len(few) == 50 and few == [tuple(r) for r in gbt_quality.sample(labels.repartition(7), 50).collect()]
    assert all(gbt_quality.fold(d) != 1 for d, _ in few)
    every = {r["doc_id"]: r["y"] for r in gbt_quality.sample(labels).collect()}
    assert every.keys() == {k for k in range(3000) if gbt_quality.fold(k) != 1} and every.get(5, 0) == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no tables here")
    got = gbt_quality.op5_query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").select("score", "predicted", "quality").toPandas()
    assert (got["predicted"] == got["quality"]).mean() >= 0.9
    ranks = got["score"].rank()
    ones = got["quality"] == 1
    auc = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    print("held-out accuracy", (got["predicted"] == got["quality"]).mean(), "AUC", auc, "rows", len(got))
    assert auc >= 0.95


def test_flat_trees():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4)).astype(np.float32)
    t = gbt_quality.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float))

    def walk(row):
        out = t.base
        for f, c, v in zip(t.feature, t.cut, t.value, strict=True):
            node = 0
            while node < len(c):
                node = 2 * node + 1 + int(row[f[node]] >= c[node])
            out += v[node - len(c)]
        return out

    assert np.allclose(t.margin(x[:50]), [walk(r) for r in x[:50]])
    assert ((t.score(x) >= 0.5) == (x[:, 0] * x[:, 1] > 0)).mean() > 0.9


def docs_of(spark, extra, rows):
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}")


@pytest.mark.parametrize("extra", ["row string, bad string, spot string"])
def test_pipeline(spark, tmp_path, extra):
    import corpus_pipeline
    from plumbline.llm.shared import table

    rows = [(k, t, "en", f"s{k % 3}", "a", "b", "c") for k, t, _ in quality_rows(240)]
    rows += [(1000 + k, rows[1][1] if k % 2 else rows[1][1] + " Once", "en", "s0", "a", "b", "c") for k in range(20)] + [(2000, None, None, None, "a", "b", "c"), (2001, "", "en", "s1", "a", "b", "c"), (1, rows[1][1], "en", "s1", "a", "b", "c")]
    spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {extra}").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, y, 0) for k, _, y in quality_rows(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, before = table(spark, str(tmp_path), "documents"), None
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
            assert 0 < docs.count()
    empty, long = docs_of(spark, extra, []), docs_of(spark, extra, [(1, "river stone walks " * 100_000, "en", "s0", "a", "b", "c")])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
        assert stage(spark, long, str(tmp_path)).count() in (0, 1, 3)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == sorted(tuple(r) for r in docs.collect()) and got
    assert docs.count() == before.count()
