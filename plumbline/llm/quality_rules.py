"""Quality rules judged by document and by host, in DataFrame functions only.

Every document gets its own counts and a base verdict. Failures of each rule are then counted by host, the
host's failure rates are shrunk with a beta prior that is fitted to all hosts (empirical Bayes, by moments), and
hosts whose shrunk rate of any rule is above the rule's limit are rejected; documents take over the verdict of
their host.

Defined results: a null text has no words; a null host is a host of its own; repeated rows count each; an empty
table gives no rows. Columns of the input other than those named are not read, so their names can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import SPACES, let, table, words_of, written

WINDOW = 5
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """Limits of a document's rules, and the host's highest shrunk failure rate for each of them."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols_per_100_words: int = 50
    max_dup_line_percent: int = 50
    base_rate: float = 0.5
    symbol_rate: float = 0.6
    line_rate: float = 0.6
    #: Rejected hosts up to this number are broadcast; more are joined by a shuffle.
    broadcast_hosts: int = 20_000


def _repeat_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text.

    Windows are told apart by a 64-bit hash of their words. Sorting (hash, position) brings equal windows
    together; the positions of repeated ones, in order, then give the covered words as a sum of steps.
    """

    def covered(hashes: Column) -> Column:
        n = F.size(hashes)
        pairs = F.sort_array(F.zip_with(hashes, F.sequence(F.lit(0), n - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def at(s: Column) -> Column:
            same = lambda k, j: s[k]["h"] == s[j]["h"]
            hit = lambda k: F.when(k > 0, same(k, F.greatest(k - 1, F.lit(0)))).otherwise(False) | F.when(k < n - 1, same(k, F.least(k + 1, n - 1))).otherwise(False)
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), n - 1), hit), lambda k: s[k]["i"]))

        def total(p: Column) -> Column:
            steps = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.least(F.lit(WINDOW), b - a))
            return F.aggregate(steps, F.lit(WINDOW), lambda acc, x: acc + x)

        return F.when(F.size(F.array_distinct(hashes)) == n, 0).otherwise(let(let(pairs, at), total))

    windows = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[w[i + k] for k in range(WINDOW)]))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(let(let(words, windows), covered))


def measures(text: Column) -> Column:
    """One struct of counts for a text; the text is split into words once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    long = lambda c, name: c.cast("long").alias(name)
    n_symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))

    def of_lines(w: Column, ls: Column) -> Column:
        return F.struct(
            long(F.size(w), "n_words"),
            long(F.length(F.array_join(w, "")), "word_chars"),
            long(n_symbols, "n_symbols"),
            long(F.size(ls), "n_lines"),
            long(F.size(ls) - F.size(F.array_distinct(ls)), "n_dup_lines"),
            long(_repeat_words(w), "n_repeat_words"),
        )

    return let(words_of(text), lambda w: let(lines, lambda ls: of_lines(w, ls)))


def failures(m: Column, limits: Limits) -> dict[str, Column]:
    """The rules, each true where a document with the counts m fails it."""
    return {
        "base": (m["n_words"] < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_repeat_percent * m["n_words"]),
        "symbol": 100 * m["n_symbols"] > limits.max_symbols_per_100_words * m["n_words"],
        "line": 100 * m["n_dup_lines"] > limits.max_dup_line_percent * m["n_lines"],
    }


def host_verdicts(measured: DataFrame, limits: Limits) -> DataFrame:
    """(host, rejected, shrunk rates) from (host, failed_base, failed_symbol, failed_line) rows of documents."""
    rules = {"base": limits.base_rate, "symbol": limits.symbol_rate, "line": limits.line_rate}
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(f"failed_{r}").cast("long")).alias(r) for r in rules])
    hosts = written(hosts, "hosts")
    # One row for all hosts: the moments of each rule's rates.
    mean = {r: F.sum(r) / F.sum("n") for r in rules}
    square = {r: F.sum(F.col(r) * F.col(r) / F.col("n")) / F.sum("n") for r in rules}
    got = hosts.agg(F.count("*").alias("hosts"), F.sum("n").alias("docs"), *[c.alias(f"m_{r}") for r, c in mean.items()], *[c.alias(f"s_{r}") for r, c in square.items()]).first()
    shrunk = {}
    for r in rules:
        a, b = prior(got[f"m_{r}"], got[f"s_{r}"], got["hosts"], got["docs"])
        shrunk[r] = (F.col(r) + F.lit(a)) / (F.col("n") + F.lit(a + b))
    rejected = F.lit(False)
    for r, top in rules.items():
        rejected = rejected | (shrunk[r] > top)
    return hosts.select("host", rejected.alias("rejected"), *[c.alias(f"rate_{r}") for r, c in shrunk.items()])


def prior(mean: float | None, mean_square: float | None, hosts: int, docs: int | None) -> tuple[float, float]:
    """alpha and beta of the beta prior: mean of all documents, variance between hosts beyond chance.

    Without any failure, any success or any variance beyond chance the prior is as strong as 1000 documents.
    """
    if not docs or not 0 < mean < 1:
        strength = 1000.0
    else:
        between = (mean_square - mean * mean) - mean * (1 - mean) * hosts / docs
        strength = 1000.0 if between <= 0 else min(1000.0, max(1.0, mean * (1 - mean) / between - 1))
    return (mean or 0.0) * strength, (1 - (mean or 0.0)) * strength


def with_verdicts(rows: DataFrame, limits: Limits) -> DataFrame:
    """rows (host, m, any others), written once, plus base_failed and kept."""
    failed = failures(F.col("m"), limits)
    kept_as = written(rows.withColumns({f"failed_{r}": c for r, c in failed.items()}), "measured")
    bad = host_verdicts(kept_as, limits).filter("rejected").select(F.col("host").alias("bad_host"), F.lit(True).alias("bad"))
    bad = written(bad, "bad-hosts")
    if bad.limit(limits.broadcast_hosts + 1).count() <= limits.broadcast_hosts:
        bad = F.broadcast(bad)
    joined = kept_as.join(bad, F.col("host").eqNullSafe(F.col("bad_host")), "left")
    return joined.withColumns({"base_failed": F.col("failed_base"), "kept": ~F.col("failed_base") & F.col("bad").isNull()})


def judge(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """A row per document: doc_id, its counts, base_failed and kept."""
    rows = docs.select("doc_id", F.col(host).alias("host"), measures(F.col("text")).alias("m"))
    return with_verdicts(rows, limits).select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame, limits: Limits = Limits(), host: str = "source") -> DataFrame:
    """The documents that judge() keeps, with all their columns."""
    rows = docs.select(F.struct("*").alias("row"), F.col(host).alias("host"), measures(F.col("text")).alias("m"))
    return with_verdicts(rows, limits).filter("kept").select("row.*")


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


_L = Limits()
OP2_SQL = f"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls, row_number() OVER () AS rid
  FROM documents),
wins AS (
  SELECT rid, i, list_aggregate(ws[i:i + {WINDOW - 1}], 'string_agg', ' ') AS win
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW}) u),
dups AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) d WHERE c > 1),
cover AS (SELECT rid, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM dups) s GROUP BY rid),
m AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words, coalesce(length(list_aggregate(ws, 'string_agg', '')), 0)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN cover USING (rid)),
f AS (
  SELECT *, (n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_repeat_percent} * n_words) AS f1, (100 * n_symbols > {_L.max_symbols_per_100_words} * n_words) AS f2, (100 * n_dup_lines > {_L.max_dup_line_percent} * n_lines) AS f3 FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(f1::INT)::DOUBLE AS x1, sum(f2::INT)::DOUBLE AS x2, sum(f3::INT)::DOUBLE AS x3 FROM f GROUP BY source),
g AS (SELECT count(*)::DOUBLE AS k, sum(n) AS d, sum(x1) / sum(n) AS m1, sum(x2) / sum(n) AS m2, sum(x3) / sum(n) AS m3, sum(x1 * x1 / n) / sum(n) AS s1, sum(x2 * x2 / n) / sum(n) AS s2, sum(x3 * x3 / n) / sum(n) AS s3 FROM h),
p AS (SELECT m1, m2, m3, {", ".join(f"CASE WHEN NOT (m{i} > 0 AND m{i} < 1) OR (s{i} - m{i} * m{i}) - m{i} * (1 - m{i}) * k / d <= 0 THEN 1000 ELSE least(1000, greatest(1, m{i} * (1 - m{i}) / ((s{i} - m{i} * m{i}) - m{i} * (1 - m{i}) * k / d) - 1)) END AS z{i}" for i in (1, 2, 3))} FROM g),
bad AS (SELECT source, ({" OR ".join(f"(x{i} + m{i} * z{i}) / (n + z{i}) > {r}" for i, r in ((1, _L.base_rate), (2, _L.symbol_rate), (3, _L.line_rate)))}) AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 AS base_failed, (NOT f1 AND NOT rejected) AS kept
FROM f JOIN bad ON f.source IS NOT DISTINCT FROM bad.source
"""
