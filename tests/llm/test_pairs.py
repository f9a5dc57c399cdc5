"""Near duplicates: SimHash tiles and lattice hashing against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from plumbline.llm import components, e8_lattice, simhash_tiles


def fingerprint(text):
    """Word for word what is wanted, bit by bit."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_of(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", "  \n", "One", "a b", "A B c", "É é Ω x y z 漢字", "the cat " * 40, "x\x1fy\x85z q\x0bw\x0ce r", "\xa0 a\xa0b"])
def test_fingerprint(text):
    assert simhash_tiles.fingerprint(text) == fingerprint(text)


def test_fingerprint_is_spark_hash(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("words,n", [(1, 700), (4, 700)])
def test_links_against_brute_force(words, n, monkeypatch):
    rng = np.random.default_rng(words)
    x = rng.integers(0, 2**63, n).astype(np.uint64)
    for k in range(1, n // 2):
        if rng.random() < 0.7:
            x[k] = x[k - 1] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    x = np.unique(x)
    rng.shuffle(x)
    monkeypatch.setattr(simhash_tiles, "FINE", 0 if words == 4 else 10**6)  # which grouping is used
    monkeypatch.setattr(simhash_tiles, "CHUNK", 5000)
    a, b = x[: n // 3], x[n // 3 :]
    found = [p for s, t in ((a, None), (b, None), (a, b)) for p in zip(*map(np.ndarray.tolist, simhash_tiles.links(s, t)), strict=True)]
    nodes = x.tolist()
    want = [(p, q) for i, p in enumerate(nodes) for q in nodes[:i] if (p ^ q).bit_count() <= 3]
    assert components_of(nodes, found) == components_of(nodes, want)


def documents(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefgh", k=4)) for _ in range(400)]
    texts = [" ".join(r.choices(vocabulary, k=r.randint(1, 200))) for _ in range(60)]
    for _ in range(60):
        w = r.choice(texts[:60]).split()
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    long = " ".join(r.choices(vocabulary, k=30_000))
    texts += [texts[0]] * 9 + [None, "", " \n\t", texts[1].upper(), long, long + " end"]
    return [(k + 5, t, "x", -1) for k, t in enumerate(texts)] + [(5, texts[0], "x", -1), (None, "no id here at all", "x", 1), (None, texts[0], "x", 1)]


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(simhash_tiles, "LEAST_TILE", 25)
    rows = documents(3)
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int").repartition(5)
    got = simhash_tiles.near_duplicates(docs).collect()
    prints = {t: fingerprint(t) for _, t, _, _ in rows}
    nodes = sorted(set(prints.values()))
    comp = components_of(nodes, [(p, q) for i, p in enumerate(nodes) for q in nodes[:i] if (p ^ q).bit_count() <= 3])
    least = {}
    for d, t, _, _ in rows:
        c = comp[prints[t]]
        least[c] = min(d if d is not None else 10**9, least.get(c, 10**9))
    want = sorted((d or 0, f"{prints[t]:016x}", None if least[comp[prints[t]]] == 10**9 else least[comp[prints[t]]]) for d, t, _, _ in rows)
    key = lambda x: (x[0], x[1], x[2] or 0)
    assert sorted([(r["doc_id"] or 0, r["fingerprint"], r["component_id"]) for r in got], key=key) == sorted(want, key=key)
    kept = simhash_tiles.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(0 if v == 10**9 else v for v in least.values())


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_tiles.near_duplicates(docs).count() == 0 and simhash_tiles.keep_one(docs).count() == 0
    assert e8_lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_stars(spark):
    r = random.Random(5)
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(70)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components.stars(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of({n for p in links for n in p}, links)
    assert got == {n: c for n, c in want.items() if n != c}


def test_lattice():
    v = e8_lattice.shortest()
    assert v.shape == (240, 8) and np.allclose((v * v).sum(axis=1), 2)
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    near = e8_lattice.decode(x)
    assert np.all((2 * near) % 1 == 0) and np.all(near.sum(axis=1) % 2 == 0)
    around = near[:, None] + v[None]
    assert (((x - near) ** 2).sum(axis=1) <= ((x[:, None] - around) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()  # no neighbour is nearer


@pytest.mark.parametrize("dim", [2, 3, 4, 8, 10, 12, 16, 64, 384])
def test_recall_at_the_edge(dim):
    """Pairs at a cosine of 0.98 and a little more, the hardest ones, must meet in a cell of some table."""
    rng = np.random.default_rng(dim)
    a = e8_lattice.units(rng.normal(size=(4000, dim)))
    b = rng.normal(size=(4000, dim))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9801 * a + np.sqrt(1 - 0.9801**2) * e8_lattice.units(b)
    k, m = e8_lattice.cells(a), e8_lattice.cells(e8_lattice.units(b))
    found = np.zeros(4000, bool)
    for t in range(e8_lattice.TABLES):
        found |= e8_lattice._meet(k, m, t)
    print(dim, found.mean())
    assert found.mean() >= 0.97


@pytest.mark.parametrize("kind,value", [("string", "a"), ("long", 2**40)])
def test_labels_of_any_kind(spark, kind, value):
    other = {"string": "b", "long": 2**40 + 2**33, "double": 2.5}[kind]
    rows = [(1, [1.0, 0.0], value), (2, [1.0, 0.01], value), (3, [1.0, 0.0], other), (4, [1.0, 0.0], None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e8_lattice.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<double>, label {kind}")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4)}


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(e8_lattice, "BLOCK", 12)  # so that cells are cut into blocks
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    vecs = [*base, *(base[0] + rng.normal(size=16) * 0.08 for _ in range(60)), *(base[k % 40] + rng.normal(size=16) * 0.15 for k in range(80)), base[3], base[3] * 2.5]
    rows = [(k, [float(np.float32(x)) for x in v], int(k % 7 == 0)) for k, v in enumerate(vecs)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] + [1.0] * 15, 0), (1004, rows[0][1], None), (1005, rows[1][1][:8], 0), (1006, [float("inf")] + [1.0] * 15, 0), (1007, [], 0), (1, rows[1][1], 0), (1008, rows[1][1], 0), (None, rows[1][1], 0)]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows + odd], "vec_id long, embedding array<float>, label int, n string").repartition(4)
    good = [(k, np.array(v) / np.linalg.norm(v), c) for k, v, c in rows + odd[-3:-1] + [odd[5]]]
    links = [(i, j) for i, (a, u, c) in enumerate(good) for j, (b, w, d) in enumerate(good) if i != j and c == d and len(u) == len(w) and u @ w >= 0.98]
    comp = components_of(range(len(good)), links)
    least = {}
    for i, (k, _, _) in enumerate(good):
        least[comp[i]] = min(k, least.get(comp[i], k))
    want = [(k, sum(a == i for a, _ in links), least[comp[i]], k == least[comp[i]]) for i, (k, _, _) in enumerate(good)]
    want += [(k, 0, k, True) for k in (1000, 1001, 1002, 1003, 1004, 1006, 1007)] + [(None, 0, None, True)]
    got = [tuple(r) for r in e8_lattice.near_duplicates(df).collect()]
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(n for _, n, _, _ in want) > 500
