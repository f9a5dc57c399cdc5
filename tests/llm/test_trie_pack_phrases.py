"""The conversation trie, packing and phrases against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as tokenizers_at
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import large_item_packing, phrases, prefix_trie


def nodes_of(rows):
    """rows: (conv_id, turn, role, text). The nodes by plain dictionaries, with turns that share a number in the operator's order."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [t[3] for t in sorted(ts)] for c, ts in own.items()}
    members = collections.defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


SCHEMA = "conv_id long, turn long, role string, text string, place string, node int"


def tree(spark, rows, block):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(3)
    return prefix_trie.trie(frame, block).collect()


def test_trie_against_dictionaries(spark):
    rng = random.Random(5)
    rows = [(-7, 0, "user", "x"), (-7, 1, "a", "yy"), (3, None, None, None), (3, 0, "user", "é漢"), (3, 0, "user", "b"), (3, 0, "user", "b"), (None, 0, "user", "lost"), (77, 4, "", ""), (105, 1, "user", "p" * 100_000)]
    for c in range(100, 330):
        for k in range(rng.choice([0, 1, 2, 3, 9])):
            rows.append((c, k, rng.choice("ab"), rng.choice(["", "x", "xy"])))
    for c in (400, 401, 402, 407):  # long ones that part late, whole or in the middle of a block
        rows += [(c, k, "a", f"t{k}" if k < 70 + c % 5 else f"{c}-{k}") for k in range(90 + c % 3)]
    for block in (2, 4, 32):
        got = tree(spark, rows, block)
        assert sorted((tuple(r)[:8] for r in got), key=lambda r: (r[0], r[1])) == nodes_of(rows), block
        spans = {(r["place"], r["end"]) for r in got}
        assert sorted(a for a, _ in spans) == list(range(1, len(got) + 1))
        open_ends = []
        for a, b in sorted(spans):  # subtrees lie in each other or apart
            while open_ends and open_ends[-1] < a:
                open_ends.pop()
            assert not open_ends or b <= open_ends[-1]
            open_ends.append(b)


def test_trie_of_few_or_none(spark):
    assert tree(spark, [], 32) == []
    assert tree(spark, [(None, 1, "user", "x")], 32) == []
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    [only] = tree(spark, [(c, 0, "user", "x")], 32)  # its base is absent, so it is turnless
    assert tuple(only)[:8] == (c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())


def test_trie_of_copies(spark):
    rows = [(c, k, "user", f"same {k}") for c in range(1000, 1600) for k in range(3)]
    assert sorted(tuple(r)[:8] for r in tree(spark, rows, 2)) == nodes_of(rows)


def packed_by_hand(lengths, capacity):
    """The same rule, piece by piece; the number of sequences."""
    free, large = [], sorted((k for k in lengths if 3 * k > capacity), reverse=True)
    while large:
        a = large.pop(0)
        k = next((j for j, b in enumerate(large) if a + b <= capacity), None)
        free.append(capacity - a - (large.pop(k) if k is not None else 0))
    for a in sorted((k for k in lengths if 3 * k <= capacity), reverse=True):
        fits = [k for k, gap in enumerate(free) if gap >= a]
        if fits:
            free[min(fits, key=free.__getitem__)] -= a
        else:
            free.append(capacity - a)
    return len(free)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.data())
def test_plan_equals_piece_by_piece(capacity, data):
    lengths = data.draw(st.lists(st.integers(1, capacity), max_size=60))
    counts = collections.Counter(lengths)
    runs = large_item_packing.plan(dict(counts), capacity)
    used, seen = collections.defaultdict(list), collections.Counter()
    for r in runs:
        assert r.first == seen[r.length]
        seen[r.length] += r.n
        for k in range(r.n):
            used[r.sequence + k // r.each].append((r.offset + k % r.each * r.length, r.length))
    assert seen == counts
    for held in used.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(used) == list(range(len(used)))
    assert len(used) == packed_by_hand(lengths, capacity)
    largest = sum(3 * k > capacity for k in lengths)
    assert len(used) >= max(-(-sum(lengths) // capacity), -(-largest // 2))


def test_plan_of_many_pieces_is_short():
    counts = {k: 10**9 + 7919 * k for k in range(1, 1025)}
    runs = large_item_packing.plan(counts)
    assert len(runs) < 10_000 and sum(r.n for r in runs) == sum(counts.values())
    n = max(r.sequence + -(-r.n // r.each) for r in runs)
    assert n <= 1.001 * sum(k * v for k, v in counts.items()) / 1024


def test_pack(spark):
    from tokenizers import Tokenizer

    path = tokenizers_at.path("byte_bpe_50k.json")
    tok, rng = Tokenizer.from_file(path), random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "beta", "é漢", "x"]) for _ in range(rng.choice([0, 3, 40, 300, 500, 2000]))) for _ in range(80)]
    rows = [(k, t, "n") for k, t in enumerate(texts)] + [(None, None, "n"), (None, "a", "n"), (7, "b" * 50_000, "n"), (8, "again", "n"), (8, "again", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(5)
    packed = large_item_packing.pack(docs, path, 256)
    got = packed.collect()
    want = collections.Counter()
    for d, text, _ in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 256 + 1
        cuts = [0, *range(first, len(ids) + 1, 256)]
        want.update((d, k, a, z - a, np.array(ids[a:z], "<u4").tobytes()) for k, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == want
    assert len({r["sequence_id"] for r in got}) == packed_by_hand([r["length"] for r in got], 256)
    whole = large_item_packing.sequences(packed).collect()
    assert sum(r["length"] for r in whole) == sum(r["length"] for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], bytes(r["ids"])))
    for r in whole:
        assert bytes(r["ids"]) == b"".join(x for _, x in sorted(by[r["sequence_id"]])) and r["length"] * 4 == len(r["ids"]) <= 1024
        assert [p["offset"] for p in r["pieces"]] == sorted(o for o, _ in by[r["sequence_id"]])
    assert large_item_packing.pack(docs.limit(0), path).count() == 0


def phrases_by_hand(rows, longest, least, listed):
    n, f = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = lang or "und" if lang is not None else "und"
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, ws), a in found.items():
        for size in range(2, len(ws)):
            for i in range(len(ws) - size + 1):
                longer[lang, ws[i : i + size]] = max(longer[lang, ws[i : i + size]], a)
    out = collections.defaultdict(list)
    for (lang, ws), a in found.items():
        if 100 * longer[lang, ws] < 50 * a or not longer[lang, ws]:
            score, k = min((10**6 * a * a // (f[lang, ws[:k]] * f[lang, ws[k:]]), k) for k in range(1, len(ws)))
            out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, r + 1, p.decode(), -a, left, right, n[lang], -score) for lang, all_ in out.items() for r, (score, a, p, left, right) in enumerate(sorted(all_)[:listed]))


def test_phrases(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["a", "B", "c", "é漢", " x", "d\x00", "\U0001f600"])
    rows = [("".join(word() + rng.choice([" ", " ", "\t", "  ", ".", "\n", ", "]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), ("...", "en"), ("the same passage, again and again", "en")] + [("the same passage", "fr")] * 40 + [("long " * 50_000, "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, n int").repartition(4)
    for longest, least, chunk in ((3, 10, 1 << 20), (3, 3, 100), (5, 4, 1000)):
        got = phrases.collocations(docs, 50, longest, least, chunk).collect()
        assert sorted(map(tuple, got)) == phrases_by_hand(rows, longest, least, 50)
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.filter("text is null")).count() == 0


def test_scores_beyond_64_bits(spark):
    known = [("en", 1, "x", 3 * 10**13), ("en", 1, "y", 2 * 10**13), ("en", 2, "x y", 10**13)]
    frame = spark.createDataFrame(known, "lang string, k tinyint, gram string, n long")
    assert [tuple(r) for r in phrases.scored(frame).collect()] == [("en", "x y", 2, 10**13, 3 * 10**13, 2 * 10**13, 10**32 // (6 * 10**26))]
