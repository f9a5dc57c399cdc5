"""Quality rules, shards and mixing against plain Python."""

import collections
import random
import re
import zlib

import pytest

from plumbline.llm import fair_mix, minimax_shards, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = {w for w in windows if windows.count(w) > 1}
    covered = {k + j for k, w in enumerate(windows) if w in often for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \n\t ", "one", "a b c d e", "a b c d e a b c d e", "x " * 9, "x " * 12, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "dup line\ndup line\n\ndup line \nother\n",
    "# * $ % & | < > ##", "a b c d e f a b c d e f g a b c d e", "é漢字 x\x85y z\xa0q", "p q r s t u v p q r s t z z z z z z z", "long " * 30_000,
]


def test_measures(spark):
    docs = spark.createDataFrame([(k, t, None, 1, "r") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], None, 1, "r")], "doc_id long, text string, source string, n_words int, m string")
    got = sorted(tuple(r)[:6] for r in quality_rules.judge(docs).collect())
    quick = [t if t is None or len(t) < 10_000 else None for t in TEXTS]
    want = [(k, *(measures(t) if q is t else (30_000, 120_000, 0, 0, 30_000))) for k, (t, q) in enumerate(zip(TEXTS, quick, strict=True))]
    assert got == sorted([*want, want[0]])


def test_hosts(spark):
    good = "the quick brown fox jumps over the lazy dog near a river bank today"
    rows = [(k, good, "clean") for k in range(40)] + [(100 + k, "spam " * 20 if k % 10 else good, "bad") for k in range(50)] + [(200, "spam " * 20, "tiny"), (201, good, "tiny"), (300, good, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, source string, bad int")
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality_rules.judge(docs).collect()}
    assert all(kept[k] == (False, True) for k in range(40)) and kept[300] == (False, True)
    assert kept[100] == (False, False) and kept[101] == (True, False)  # a good text of a host that fails nine in ten
    assert kept[201] == (False, True)  # one failure in two says too little about a small host
    few = quality_rules.judge(docs, quality_rules.Limits(broadcast_hosts=0))  # the join without a broadcast
    assert {r["doc_id"]: (r["base_failed"], r["kept"]) for r in few.collect()} == kept
    whole = quality_rules.keep_good(docs)
    assert whole.columns == docs.columns and {r["doc_id"] for r in whole.collect()} == {d for d, (_, k) in kept.items() if k}


@pytest.mark.parametrize("schema", ["doc_id long, text string, source string"])
def test_empty(spark, schema):
    docs = spark.createDataFrame([], schema)
    assert quality_rules.judge(docs).count() == 0 and quality_rules.keep_good(docs).count() == 0
    assert minimax_shards.assign(docs).count() == 0
    assert fair_mix.shares(docs).count() == 0 and fair_mix.resample(docs).count() == 0 and fair_mix.mixture(docs).count() == 0


def best_capacity(sizes, shards):
    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        n, room = 1, mid
        for s in sizes:
            if s > mid:
                n = shards + 1
                break
            if s > room:
                n, room = n + 1, mid
            room -= s
        low, high = (low, mid) if n <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed,hot", [(1, 0), (2, 60), (3, 400)])
def test_shards(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(minimax_shards, "BITS", 3)  # so that leaves must be split again and again
    r = random.Random(seed)
    texts = ["".join(r.choices("abé漢 ", k=r.randint(0, 120))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts + ["hot copy"] * hot + [None, "", None])] + [(3, texts[3]), (None, "x")] + [(9000, "y" * 2_000_000)] * (seed == 2)
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, size int").repartition(6)
    got = minimax_shards.assign(df, 8).collect()
    assert sorted((x["doc_id"] if x["doc_id"] is not None else -1, x["size"], x["text_crc32"]) for x in got) == sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    shard_of = {}
    for x in got:
        assert shard_of.setdefault((x["text_crc32"], x["size"]), x["shard"]) == x["shard"] and 0 <= x["shard"] < 8
    for s in range(8):
        slots = sorted(x["slot"] for x in got if x["shard"] == s)
        assert slots == list(range(len(slots)))
    from pyspark.sql import functions as F

    groups = df.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("s")).orderBy("h").collect()
    load = [sum(x["size"] for x in got if x["shard"] == s) for s in range(8)]
    best = best_capacity([g["s"] for g in groups], 8)
    assert max(load) == best
    if seed == 1:
        assert min(load) > 0.8 * best


class FakeRows:
    """Atoms (hash, size) in place of a table, for plan() alone; counts what each round brings to the driver."""

    def __init__(self, atoms):
        self.atoms, self.brought = atoms, []

    def leaves(self, rows, within, most):
        shift = within[0].shift
        bits = max(1, min(minimax_shards.BITS, most.bit_length() - 1 - (len(within) - 1).bit_length(), shift))
        prefixes = {x.low >> shift for x in within}
        found = {}
        for h, size in self.atoms:
            if shift == 64 or h >> shift in prefixes:
                s, n, low, high = found.get(h >> shift - bits, (0, 0, h, h))
                found[h >> shift - bits] = s + size, n + 1, min(low, h), max(high, h)
        self.brought.append((len(within), len(found)))
        return [minimax_shards.Leaf(low, high, s, n, shift - bits) for s, n, low, high in found.values()]


@pytest.mark.parametrize("heavy", [[], [0.4], [0.11, 0.11], [0.2, 0.12, 0.1, 0.05, 0.02]])
def test_plan_of_many_atoms_with_heavy_ones(heavy, monkeypatch):
    r = random.Random(len(heavy))
    atoms = {r.randrange(-(1 << 63), 1 << 63): r.randint(1, 5000) for _ in range(60_000)}
    total = sum(atoms.values())
    for share in heavy:
        atoms[r.randrange(-(1 << 63), 1 << 63)] = int(share * total / (1 - sum(heavy)))
    atoms = sorted(atoms.items())
    fake = FakeRows(atoms)
    monkeypatch.setattr(minimax_shards, "_leaves", fake.leaves)
    capacity, firsts, n = minimax_shards.plan(fake, 8)
    assert n == len(atoms) and capacity == best_capacity([s for _, s in atoms], 8)
    load = [0] * 8
    for h, s in atoms:
        load[sum(h >= f for f in firsts if f is not None)] += s
    assert max(load) <= capacity
    average = total / 8 if not heavy else total / (8 - sum(h > 0.09 for h in heavy))
    assert max(sorted(load)[: 8 - len(heavy)]) < 1.6 * average  # shards without a heavy atom
    assert sum(x < 0.6 * average for x in load) <= len(heavy) + 1  # what lies between two heavy atoms may be less
    assert len(fake.brought) < 30 and all(opened <= minimax_shards.MOST_OPEN and new <= minimax_shards.MOST_NEW for opened, new in fake.brought)


def test_shards_of_a_table_against_brute_force(spark):
    """The query itself over a whole table: the contract's law, groups, slots and the least capacity."""
    from pathlib import Path

    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    if not Path(sf).exists():
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {x["doc_id"]: x for x in minimax_shards.op4_query(spark, sf).collect()}
    rows = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    assert len(got) == len(rows)
    groups, load, slots, homes = {}, [0] * 8, {}, {}
    for d, text, h in rows:
        raw, x = (text or "").encode(), got[d]
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        groups[h] = groups.get(h, 0) + x["size"]
        load[x["shard"]] += x["size"]
        slots.setdefault(x["shard"], []).append(x["slot"])
        assert homes.setdefault(text or "", x["shard"]) == x["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) == best_capacity([s for _, s in sorted(groups.items())], 8)
    assert min(load) > 0.9 * max(load)


def mix(rows):
    """taken of each row, by a plain queue: (doc_id, size, source_size, target, taken), sorted."""
    import hashlib

    spot = lambda d, t: int(hashlib.md5(f"{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:15], 16)
    sized = [(d, s, len(WORD.findall(t or "")), spot(d, t)) for d, t, s in rows]
    sources = sorted({s for _, s, _, _ in sized}, key=lambda s: (s is None, s or ""))
    total = {s: sum(x[2] for x in sized if x[1] == s) for s in sources}
    want = dict(zip(sources, fair_mix.targets([total[s] for s in sources], fair_mix.Mix()), strict=True))
    copies = []
    for rank, s in enumerate(sources):
        upto = 0
        for k, (_, _, n, p) in sorted(((k, x) for k, x in enumerate(sized) if x[1] == s), key=lambda x: x[1][3]):
            upto += n
            copies += [((upto + e * total[s]) / want[s], rank, p, k, n) for e in range(3) if n]
    left, taken = sum(total.values()), collections.Counter()
    for t in sorted(copies, key=lambda c: c[:3]):
        left -= t[4]
        if left < 0:
            break
        taken[t[3]] += t[4]
    null_last = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    return sorted(((d, n, total[s], want[s], taken[k]) for k, (d, s, n, _) in enumerate(sized)), key=null_last)


@pytest.mark.parametrize("seed,chunk", [(1, 1000), (2, 2), (3, 1000)])
def test_mix(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(fair_mix, "COPIES", chunk)
    r = random.Random(seed)
    rows = [(k, "w " * r.randint(0, 40), r.choice(["a", "a", "a", "b", "c", None, "Z"])) for k in range(400)] + [(1000, None, "a"), (1001, " ", "empty"), (1002, "x " * 900, "tiny")]
    rows += [(5, "same text", "a")] * 60 + [(None, "none here", None)] * 30 + [(None, f"none {k}", "b") for k in range(50)] + [(7, "w", "a"), (7, "w", "b")]
    if seed == 3:
        rows = [(None, "five words are in here", s) for s in "abc" for _ in range(200)]
    docs = spark.createDataFrame([(*x, "t") for x in rows], "doc_id long, text string, source string, target string").repartition(5)
    got = fair_mix.shares(docs, fair_mix.Mix(bucket_rows=20)).collect()
    null_last = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(map(tuple, got), key=null_last) == mix(rows)
    for target in {x["target"] for x in got}:
        assert abs(sum(x["taken"] for x in got if x["target"] == target) - target * len({x["source_size"] for x in got if x["target"] == target})) <= 1000
    assert all(x["taken"] <= 3 * x["size"] for x in got)
    counts = collections.Counter()
    for x in got:
        counts[x["doc_id"], x["size"]] += x["taken"] // x["size"] if x["size"] else 0
    again = fair_mix.resample(docs)
    assert again.columns == docs.columns
    seen = collections.Counter((x["doc_id"], len((x["text"] or "").split())) for x in again.collect())
    assert seen == +counts
    ordered = [x["finish"] for x in fair_mix.mixture(docs).collect()]
    assert ordered == sorted(ordered) and len(ordered) == sum(counts.values())


@pytest.mark.parametrize("ids", ["null", "one", "own"])
def test_targets_are_met_whatever_the_ids(spark, ids):
    rows = [({"null": None, "one": 9, "own": k}[ids], f"{' w' * 20} {k if ids != 'one' else ''}", s) for k, s in enumerate("abc" * 1000)]
    got = fair_mix.shares(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    taken = collections.Counter()
    for x in got:
        taken[x["target"]] += x["taken"]
    assert len(taken) == 3 and all(abs(n - target) <= 22 for target, n in taken.items())


def test_long_texts_are_counted_whole(spark):
    docs = spark.createDataFrame([(1, "w " * 200_000, "a"), (2, "x y", "b")], "doc_id long, text string, source string")
    assert {r["doc_id"]: r["size"] for r in fair_mix.shares(docs).collect()} == {1: 200_000, 2: 2}


def test_targets():
    m = fair_mix.Mix()
    assert fair_mix.targets([100, 100, 100], m) == [187.5, 75.0, 37.5]
    got = fair_mix.targets([10, 1000, 1000], m)
    assert got[0] == 30.0 and sum(got) == pytest.approx(2010) and got[1] == pytest.approx(2 * got[2])
    assert fair_mix.targets([0, 0], m) == [0.0, 0.0] and fair_mix.targets([], m) == []


@pytest.mark.parametrize("large", [4, 10_000])
def test_more_sources_than_are_listed(spark, large, monkeypatch):
    """The way over a table of sources gives what the driver's list gives, wherever large sources begin."""
    monkeypatch.setattr(fair_mix, "LARGE", large)
    r = random.Random(large)
    names = [None, "é", *map(str, range(30))]
    rows = [(k, "w " * r.randint(0, 30), r.choice(names[:3]) if k % 3 else r.choice(names), "x") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, docs string").repartition(3)
    want = sorted(tuple(x) for x in fair_mix.shares(docs).collect())
    few = fair_mix.Mix(listed_sources=3)
    assert sorted(tuple(x) for x in fair_mix.shares(docs, few).collect()) == want
    again = lambda m: sorted(x["doc_id"] for x in fair_mix.resample(docs, m).collect())
    assert again(few) == again(fair_mix.Mix()) and fair_mix.resample(docs, few).columns == docs.columns
    assert fair_mix.shares(docs.filter("false"), fair_mix.Mix(listed_sources=-1)).count() == 0


@pytest.mark.parametrize("shards", [500, 4096])
def test_thousands_of_shards(spark, shards):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', int(id % 50)) || id AS text")
    got = minimax_shards.assign(docs, shards).collect()
    load = collections.Counter()
    for x in got:
        load[x["shard"]] += x["size"]
    assert len(got) == 20_000 and len(load) == shards and sorted(load) == list(range(shards))
    from pyspark.sql import functions as F

    groups = docs.groupBy(F.xxhash64("text").alias("h")).agg(F.sum(F.octet_length("text") + 1).alias("s")).orderBy("h").collect()
    assert max(load.values()) == best_capacity([g["s"] for g in groups], shards)
