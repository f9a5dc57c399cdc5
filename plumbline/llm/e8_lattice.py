"""Near duplicates of embeddings by lattice hashing with E8.

Each table projects the unit vectors to eight dimensions at random, scales them and decodes them to the nearest point
of the E8 lattice, their home cell. A vector lies in its home cell and also visits the nearest cells around it; a pair
meets where one lies and the other lies or visits. What meets is compared by cosine in double precision.

Equal vectors of a label are one class. Cells with many vectors are cut into blocks, so no task gets more than BLOCK
of those that lie and BLOCK of those that visit. A pair may meet in several cells; it counts in one, which both can
tell from their cells: the first table in which they meet, and there the lower cell. So links are counted without
listing pairs, and a cell gives counts and a spanning forest, no more rows than it has members.

Recall at a cosine of exactly 0.98 and above is measured by the tests for 2 to 384 dimensions, which fail below 0.97.

Defined results: vectors link only with vectors of their own label and length; a null label, a null vector, null or
non-finite components, no component but zeros or a null vec_id: links with nothing, and its component is its own
vec_id; labels that aren't integers are told apart by a 64-bit hash; equal vectors are found again by 128 bits of hash;
repeated rows count as vectors of their own; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import stars
from .simhash_tiles import Forest
from .shared import ranges, table, written

TABLES, CELLS, SCALE, SEED = 4, 3, 4.0, 7
COSINE = 0.98
BLOCK = 4096
PLACES = 200_000  # vectors with their cells that a task gets to compare, on average
#: Cells with more than BLOCK members are broadcast up to this number, beyond it joined by a shuffle.
BROADCAST_CELLS = 50_000


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in combinations(range(8), 2):
        for a, b in product((-1.0, 1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            whole.append(v)
    halves = [np.array(s) for s in product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + halves)


def _d8(x: np.ndarray) -> np.ndarray:
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 and D8 moved by a half."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


@cache
def projections(dim: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    return np.stack([np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))[0][:dim] for _ in range(TABLES)])


def scale(dim: int) -> float:
    """SCALE from 16 dimensions on. Projecting shortens distances by the root of 8/dim, and not at all up to eight
    dimensions: there the scale is as much smaller as pairs lie further apart than those of 16 dimensions."""
    return SCALE * min(1.0, max(8, dim) / 16) ** 0.5


def cells(unit: np.ndarray) -> np.ndarray:
    """For each vector and table the cells it is in, its home first: (vector, table, CELLS) 64-bit keys."""
    out = np.empty((len(unit), TABLES, CELLS), np.int64)
    around = shortest()
    for t, p in enumerate(projections(unit.shape[1])):
        x = unit @ p * scale(unit.shape[1])
        home = decode(x)
        nearest = np.argsort(-((x - home) @ around.T), axis=1, kind="stable")[:, : CELLS - 1]
        points = np.concatenate([home[:, None], home[:, None] + around[nearest]], axis=1)
        out[:, t] = (2 * points).astype(np.int8).view(np.int64)[..., 0]  # half steps fit a byte: |x| <= SCALE
    return out


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1 in double precision; dividing by the largest component first keeps squares in range."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _by_length(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for _, rows in b.groupby(b["embedding"].map(len)):
        yield rows, np.stack(rows["embedding"].to_list())


def _places(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One line per vector, table and cell: which vector, the table, the cell, whether it is the home."""
    keys = cells(unit)
    n = len(unit)
    which = np.repeat(np.arange(n), TABLES * CELLS)
    return which, np.tile(np.repeat(np.arange(TABLES), CELLS), n), keys.ravel(), np.tile(np.arange(CELLS) == 0, n * TABLES)


PLACE = "label long, dim int, tab int, cell long, home boolean"


def _assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for rows, vectors in _by_length(b):
            which, tab, cell, home = _places(units(vectors))
            yield pd.DataFrame({"label": rows["label"].to_numpy()[which], "dim": vectors.shape[1], "tab": tab, "cell": cell, "home": home})


def _assign_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for start in range(0, len(b), 1000):
            for rows, vectors in _by_length(b[start : start + 1000]):
                which, tab, cell, home = _places(units(vectors))
                keys = cell.reshape(len(vectors), -1)
                data = [k.tobytes() + v.tobytes() for k, v in zip(keys, vectors, strict=True)]  # components as wide as they came
                own = rows["node"].to_numpy()[which], rows["n"].to_numpy()[which]
                yield pd.DataFrame({"label": rows["label"].to_numpy()[which], "dim": vectors.shape[1], "tab": tab, "cell": cell, "home": home, "node": own[0], "n": own[1], "data": [data[k] for k in which]})


def _meet(k: np.ndarray, m: np.ndarray, t: int) -> np.ndarray:
    """Whether pairs with the cells k and m (pair, table, CELLS) meet in table t."""
    return (k[:, t] == m[:, t, :1]).any(axis=1) | (m[:, t] == k[:, t, :1]).any(axis=1)


def counted_here(visitor: np.ndarray, host: np.ndarray, tab: int, cell: int, lower: np.ndarray) -> np.ndarray:
    """Whether this is the one place that counts pairs of a visitor and a host whose home is cell."""
    here = np.ones(len(visitor), bool)
    for t in range(tab):
        here &= ~_meet(visitor, host, t)
    home = visitor[:, tab, 0]
    back = (host[:, tab] == home[:, None]).any(axis=1)  # the host visits the visitor's home in turn
    return here & np.where(home == cell, lower, ~back | (cell < home))


def compare(dim: int, tab: int, cell: int, is_host: np.ndarray, node: np.ndarray, n: np.ndarray, data: list[bytes]) -> pd.DataFrame | None:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    width = 8 * TABLES * CELLS
    keys = np.ascontiguousarray(raw[:, :width]).view(np.int64).reshape(-1, TABLES, CELLS)
    unit = units(np.ascontiguousarray(raw[:, width:]).view(np.float32 if raw.shape[1] == width + 4 * dim else np.float64))
    hosts, visitors = np.flatnonzero(is_host), np.flatnonzero(~is_host)
    if not len(hosts) or not len(visitors):
        return None
    names, at = np.unique(node, return_inverse=True)
    forest, links = Forest(len(names)), np.zeros(len(names), np.int64)
    step = max(1, (1 << 21) // len(hosts))
    for k in range(0, len(visitors), step):
        part = visitors[k : k + step]
        i, j = np.nonzero(unit[part] @ unit[hosts].T >= COSINE)
        i, j = part[i], hosts[j]
        other = node[i] != node[j]
        i, j = i[other], j[other]
        own = counted_here(keys[i], keys[j], tab, cell, node[i] < node[j])
        i, j = i[own], j[own]
        np.add.at(links, at[i], n[j])
        np.add.at(links, at[j], n[i])
        forest.join(at[i], at[j])
    x, y = forest.edges()
    seen = np.flatnonzero(links)
    if not len(seen):
        return None
    none = [None] * len(seen)
    return pd.concat([pd.DataFrame({"a": names[seen], "b": pd.array(none, "Int64"), "links": pd.array(links[seen], "Int64")}), pd.DataFrame({"a": names[x], "b": pd.array(names[y], "Int64"), "links": pd.array([None] * len(x), "Int64")})])


KEYS = ["label", "dim", "tab", "cell", "host_block", "visit_block"]


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compares group by group; batches come sorted by KEYS, and groups may go on from one batch to the next."""
    held: list[pd.DataFrame] = []

    def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for k, m in _runs(rows):
            if m - k > 1:
                g = rows.iloc[k:m]
                first = g.iloc[0]
                out = compare(int(first["dim"]), int(first["tab"]), int(first["cell"]), g["is_host"].to_numpy(bool), g["node"].to_numpy(np.int64), g["n"].to_numpy(np.int64), g["data"].to_list())
                if out is not None:
                    yield out

    for b in batches:
        if not len(b):
            continue
        if held and not (b[KEYS].iloc[0] == held[-1][KEYS].iloc[-1]).all():
            yield from done(pd.concat(held))
            held = []
        last = _runs(b)[-1][0]
        if last:
            yield from done(pd.concat([*held, b.iloc[:last]]))
            held = []
        held.append(b.iloc[last:])
    if held:
        yield from done(pd.concat(held))


def _runs(rows: pd.DataFrame) -> list[tuple[int, int]]:
    keys = rows[KEYS].to_numpy(np.int64)
    cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    ends = [0, *cut.tolist(), len(rows)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def _valid() -> F.Column:
    good = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))) & F.exists("embedding", lambda x: x != 0)
    return F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(good, F.lit(False))


def met(classes: DataFrame, n: int) -> DataFrame:
    """(a, null, links) for each place and node with links, and (a, b, null) for the edges of forests; n classes."""
    vectors = classes.select("label", "embedding", "node", "n")
    key = KEYS[:4]
    full = vectors.select("label", "embedding").mapInPandas(_assign, PLACE).groupBy(*key).agg(F.sum(F.col("home").cast("long")).alias("lie"), F.count("*").alias("all")).filter(F.col("all") > BLOCK)
    full = written(full.select(*key, F.ceil(F.col("lie") / BLOCK).cast("int").alias("host_blocks"), F.ceil(F.col("all") / BLOCK).cast("int").alias("visit_blocks")), "full-cells")
    if full.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS:
        full = F.broadcast(full)
    rows = vectors.mapInPandas(_assign_whole, PLACE + ", node long, n long, data binary").join(full, key, "left")
    hosts, visits = F.greatest(F.coalesce("host_blocks", F.lit(1)), F.lit(1)), F.coalesce("visit_blocks", F.lit(1))
    own = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    place = lambda h, v, host: F.struct(h.alias("host_block"), v.alias("visit_block"), F.lit(host).alias("is_host"))
    as_visitor = F.transform(F.sequence(F.lit(0), hosts - 1), lambda h: place(h, own(visits), False))
    as_host = F.transform(F.sequence(F.lit(0), visits - 1), lambda v: place(own(hosts), v, True))
    dealt = rows.select(*key, "node", "n", "data", F.explode(F.when(F.col("home"), F.concat(as_visitor, as_host)).otherwise(as_visitor)).alias("p")).select(*key, "p.*", "node", "n", "data")
    parts = ranges(classes.sparkSession, n * TABLES * (CELLS + 1), PLACES)
    return dealt.repartition(parts, *KEYS).sortWithinPartitions(*KEYS).mapInPandas(_groups, "a long, b long, links long")


def _label(vectors: DataFrame) -> F.Column:
    whole = dict(vectors.dtypes)["label"] in ("tinyint", "smallint", "int", "bigint")
    return F.col("label").cast("long") if whole else F.when(F.col("label").isNotNull(), F.xxhash64("label"))


def _name() -> F.Column:
    """128 bits of a class's label and vector, to join by in their place."""
    return F.when(F.col("valid"), F.struct(F.xxhash64("label", "embedding").alias("h"), F.xxhash64("embedding", F.lit(SEED), "label").alias("i")))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """A row per vector: vec_id, n_links, component_id, kept."""
    rows = vectors.select("vec_id", "embedding", _label(vectors).alias("label")).withColumn("valid", _valid())
    classes = rows.filter("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("n"))
    classes = written(classes.withColumns({"node": F.monotonically_increasing_id(), "valid": F.lit(True)}).withColumn("name", _name()).drop("valid"), "classes")
    found = written(met(classes, classes.count()), "met")
    links = found.filter("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = stars(found.filter("links is null").select("a", "b"))
    labelled = classes.join(links, "node", "left").join(roots, "node", "left").select("name", "first", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component"))
    labelled = labelled.join(least, "root").select("name", "links", "component")
    joined = rows.select("vec_id", _name().alias("name")).join(labelled, "name", "left")
    out = joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP8_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND NOT list_bool_or(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.a = vec_id
"""
