"""The trie of conversation prefixes, numbered in preorder: every subtree is an interval of places.

Conversations are first rebuilt: every hundred of ids shares a base, whose first turns replace as many of each one's own.
A turn is a digest of role and text, so texts are read once and never moved. The path to a node is kept in blocks of
BLOCK turns: a node knows the digests of its own block and a digest of the blocks before, which is made of the block
digests in the same way, level by level. So nothing is longer than a block, however many turns a conversation has, and
groups of (conversation, block) are small whatever the skew. Nodes are the distinct path digests.

Lexicographic ranks come the same way: within a block by its digests; where paths are longer than a block, each block,
whole or not, is replaced by its rank among all, and paths of ranks are again cut into blocks. Sorted by range, nodes
get their places in preorder (a node before its subtree) and running sums of leaves and savings. The end of a subtree
is the last place at which one of its members ends; it is stored with the running sums there, so that leaves and
savings of the subtree are differences of two sums. Nodes and ends are found by sums and maxima, which combine before
the shuffle: a node that holds most conversations costs each task a row.

The conversation ids that end at a node are hashed in ascending order: sorted by range, joined to long strings in many
tasks, and only these are passed one by one through a running SHA-256.

Defined results: rows with a null conv_id belong to no conversation; null roles and texts are empty; a null turn comes
first, and turns that share a number are ordered by the digest of role and text, repeated rows being turns of their
own; the remainder of a negative id is negative (-7 has the base 0); an empty text is a turn that saves nothing; texts
of any length count whole; a table without conversations gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .shared import numbered_within, ranges, table, written

BLOCK = 32
GROUP, HEAD = 100, 6  # conversations of a base; a base's turns are taken up to HEAD - 1
JOINED = 1 << 16  # ids of a string


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, sym (hex digest of role and text), chars."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sym = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", sym.alias("sym"), F.length(text).cast("long").alias("chars"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, at from 1, sym, chars) of the rebuilt conversations, and the ids (conv_id) of all, turnless ones too."""
    spark = conversations.sparkSession
    own = turns_of(conversations)
    parts = ranges(spark, conversations.count())
    own = numbered_within(own, "conv_id", [F.col("turn").asc_nulls_first(), "sym"], "pos", parts)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    ids = written(own.select("conv_id").distinct(), "conversations")
    heads = own.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEAD)).select(F.col("conv_id").alias("base"), "pos", "sym", "chars")
    wanted = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), h.alias("h")).filter("h > 0")
    from_base = wanted.join(heads, "base").filter("pos <= h").select("conv_id", F.lit(0).alias("half"), "pos", "sym", "chars")
    kept = own.filter(F.col("pos") > h).select("conv_id", F.lit(1).alias("half"), "pos", "sym", "chars")
    turns = numbered_within(from_base.unionByName(kept), "conv_id", ["half", "pos"], "at", parts)
    return turns.select("conv_id", "at", "sym", "chars"), ids


def blocked(rows: DataFrame, block: int) -> DataFrame:
    """rows (conv_id, at, sym and others) with key, the syms of their block up to them in one string."""
    w = W.partitionBy("conv_id", F.floor((F.col("at") - 1) / block)).orderBy("at")
    return rows.withColumn("key", F.array_join(F.collect_list("sym").over(w), ""))


def longest(rows: DataFrame) -> int:
    return rows.agg(F.max("at").alias("n")).first()["n"] or 0


def with_paths(rows: DataFrame, block: int) -> DataFrame:
    """rows (conv_id, at, sym and others) with key, node, the digest of the whole path, and parent, that of the path one shorter."""
    rows = written(blocked(rows, block), "blocked")
    digest = lambda before, own: F.md5(F.concat(before, F.lit("/"), own).cast("binary"))
    own = lambda key: F.md5(key.cast("binary"))
    if longest(rows) <= block:
        rows = rows.withColumns({"before": F.lit(""), "edge": F.lit("")})
    else:
        ends = rows.filter(F.col("at") % block == 0).select("conv_id", (F.col("at") / block).cast("long").alias("at"), own(F.col("key")).alias("sym"))
        upper = with_paths(ends, block)
        upper = upper.select("conv_id", F.col("at").alias("blocks"), F.col("node").alias("before"), digest(F.col("parent"), F.col("sym")).alias("edge"))
        rows = rows.withColumn("blocks", F.floor((F.col("at") - 1) / block)).join(upper, ["conv_id", "blocks"], "left").drop("blocks")
        rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("before", "edge")})
    shorter = F.expr("substring(key, 1, length(key) - length(sym))")
    parent = F.when(F.col("at") % block == 1, F.col("edge")).otherwise(digest(F.col("before"), own(shorter)))
    return rows.withColumns({"node": digest(F.col("before"), own(F.col("key"))), "parent": parent}).drop("before", "edge")


def lexicographic(nodes: DataFrame, marks: DataFrame, block: int, parts: int) -> DataFrame:
    """nodes (node, conv_id, at, key) as (node, path), in whose order a node comes before its subtree and nothing between.

    marks (conv_id, at, node) has the nodes at whole blocks. A path of more than a block becomes the path of its blocks'
    ranks: a part of a block ranks before its continuations, and only those lie between.
    """
    if longest(nodes) <= block:
        return nodes.select("node", F.col("key").alias("path"))
    keys = nodes.select(F.lit(0).alias("all"), "key").distinct()
    ranks = numbered_within(keys, "all", ["key"], "rank", parts).select("key", F.lpad(F.hex("rank"), 16, "0").alias("sym"))
    nodes = written(nodes.join(ranks, "key").select("node", "conv_id", F.ceil(F.col("at") / block).alias("at"), "sym"), "ranked")
    marks = marks.join(nodes.select("node", "sym"), "node")
    marks = written(blocked(marks, block), "marks")
    before = marks.filter(F.col("at") % block != 0).select("conv_id", (F.col("at") + 1).alias("at"), F.col("key").alias("before"))
    upper = nodes.join(before, ["conv_id", "at"], "left").withColumn("key", F.concat(F.coalesce("before", F.lit("")), "sym"))
    higher = marks.filter(F.col("at") % block == 0).select("conv_id", (F.col("at") / block).cast("long").alias("at"), "node")
    return lexicographic(upper.select("node", "conv_id", "at", "key"), higher, block, parts)


def placed(nodes: DataFrame, parts: int) -> DataFrame:
    """nodes with place (from 1, in the order of path) and the sums of leaf and saved up to and with each: leaves, savings."""
    spark = nodes.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, upto = TaskContext.get().partitionId(), np.zeros(3, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            each = np.stack([np.ones(b.num_rows, np.int64), *(b.column(b.schema.get_field_index(c)).to_numpy() for c in ("leaf", "saved"))])
            sums = np.cumsum(each, axis=1) + upto[:, None]
            upto = sums[:, -1]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, sums), pa.array(np.full(b.num_rows, own), pa.int64())], [*b.schema.names, "p", "l", "s", "part"])

    ranged = nodes.repartitionByRange(parts, "path").sortWithinPartitions("path").drop("path")
    more = ", ".join(f"{c} long" for c in ("p", "l", "s", "part"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    ranged = written(ranged.mapInArrow(run, f"{kind}, {more}"), "placed")
    before, starts = (0, 0, 0), []
    for r in sorted(ranged.groupBy("part").agg(*[F.max(c).alias(c) for c in "pls"]).collect(), key=lambda r: r["part"]):  # a row for each range
        starts.append((r["part"], *before))
        before = tuple(a + r[c] for a, c in zip(before, "pls", strict=True))
    shift = spark.createDataFrame(starts, "part long, dp long, dl long, ds long")
    sums = {name: F.col(c) + F.col(f"d{c}") for name, c in (("place", "p"), ("leaves", "l"), ("savings", "s"))}
    return ranged.join(F.broadcast(shift), "part").withColumns(sums).drop("part", *"pls", "dp", "dl", "ds")


def id_digests(ends: DataFrame, parts: int) -> DataFrame:
    """ends (node, conv_id): node, ends_sha256, the SHA-256 of its ascending ids in decimal, comma-joined."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, n = TaskContext.get().partitionId(), 0
        for b in batches:
            nodes, ids = b["node"].to_numpy(), b["conv_id"].astype(str).tolist()
            starts = [*(np.flatnonzero(nodes[1:] != nodes[:-1]) + 1).tolist(), len(nodes)]
            cuts, text, of = [0, *starts], [], []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                for k in range(a, z, JOINED):
                    text.append(",".join(ids[k : min(z, k + JOINED)]))
                    of.append(nodes[a])
            yield pd.DataFrame({"node": of, "part": own, "n": range(n, n + len(text)), "ids": text})
            n += len(text)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for b in batches:
            done: list[tuple[str, str]] = []
            for node, ids in zip(b["node"], b["ids"], strict=True):
                if node == last:
                    state.update(b",")
                else:
                    if last is not None:
                        done.append((last, state.hexdigest()))
                    last, state = node, hashlib.sha256()
                state.update(ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if last is not None:
            yield pd.DataFrame([(last, state.hexdigest())], columns=["node", "ends_sha256"])

    order = ["node", "conv_id"]
    joined = ends.select(*order).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(join, "node string, part int, n long, ids string")
    return joined.repartition(parts, "node").sortWithinPartitions("node", "part", "n").mapInPandas(digest, "node string, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, place and end (the interval of its subtree in preorder)."""
    spark = conversations.sparkSession
    turns, ids = rebuilt(conversations)
    rows = with_paths(turns, block).select("conv_id", "at", "node", "parent", "key", "chars")
    root = ids.select("conv_id", F.lit(0).cast("long").alias("at"), F.lit("").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("key"), F.lit(0).cast("long").alias("chars"))
    rows = written(rows.unionByName(root), "paths")
    nodes = written(rows.groupBy("node", "at", "parent", "key", "chars").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")), "nodes")
    first = nodes.filter("node = ''").select("conv_id").first()
    parts = ranges(spark, nodes.count())
    marks = rows.filter((F.col("at") > 0) & (F.col("at") % block == 0)).select("conv_id", (F.col("at") / block).cast("long").alias("at"), "node")
    paths = lexicographic(nodes.select("node", "conv_id", "at", "key"), marks, block, parts)
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children")).filter("node is not null")
    sized = nodes.select("node", "conv_id", F.col("at").alias("depth"), "parent", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    sized = sized.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    sized = placed(sized.withColumn("leaf", (F.col("n_children") == 0).cast("long")).join(paths, "node"), parts)
    ends = written(rows.groupBy("conv_id").agg(F.max(F.struct("at", "node")).alias("end")).select("conv_id", "end.node"), "ends")
    # Conversations that end at one node pass the same nodes: one of them tells where it ends.
    stops = ends.groupBy("node").agg(F.min("conv_id").alias("conv_id")).join(sized.select("node", "place", "leaves", "savings"), "node").drop("node")
    last = rows.select("conv_id", "node").join(stops, "conv_id").groupBy("node").agg(*[F.max(c).alias(f"last_{c}") for c in ("place", "leaves", "savings")])
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = sized.join(last, "node").join(id_digests(ends, parts), "node", "left")
    deep = out.filter("depth > 1").join(parents, "parent")
    flat = out.filter("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first["conv_id"] if first else None)).cast("long"))
    return deep.unionByName(flat).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("last_leaves") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("last_savings") - F.col("savings") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"), "place", F.col("last_place").alias("end"),
    )


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).drop("place", "end")


OP11_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                  md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
                  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
bits AS (SELECT c::BIGINT AS c, list_reduce(list_prepend(c::BIGINT, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM range(256) r(c)),
tab AS (SELECT list(v ORDER BY c) AS tab FROM bits),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
             lambda x, b: xor(x >> 8, tab[1 + (xor(x, b) & 255)])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), tab),
r AS (SELECT c.conv_id, 0 AS half, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.pos <= h
      UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY half, pos) AS nth, role, text FROM r),
l AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY nth) AS whole FROM a GROUP BY conv_id),
w AS (SELECT c.conv_id, coalesce(whole, []) AS whole FROM c LEFT JOIN l ON l.conv_id = c.conv_id),
p AS (SELECT conv_id, d AS depth, whole[:d] AS path, len(whole) = d AS ends FROM w, unnest(range(len(whole) + 1)) u(d)),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
             (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(path[depth].t) END AS saved FROM p GROUP BY path, depth),
k AS (SELECT path[:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (SELECT path[:d] AS path, sum(CASE WHEN n_children IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
      FROM (SELECT n.path, n.depth, n.saved, k.n_children FROM n LEFT JOIN k ON k.path = n.path) z, unnest(range(depth + 1)) u(d) GROUP BY 1)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n LEFT JOIN k ON k.path = n.path JOIN s ON s.path = n.path LEFT JOIN n q ON n.depth > 0 AND q.path = n.path[:n.depth - 1]
"""
