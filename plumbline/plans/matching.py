"""Driver queries: matching, clustering, merging, text, geometry, writing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import geometry, text
from ..operators import fusion, graph, registration
from .shared import CENTS, cents, dealt, query, table


@query("""SELECT a.p_brand, a.p_partkey AS a_partkey, b.p_partkey AS b_partkey FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
 WHERE abs(a.p_retailprice - b.p_retailprice) <= 0.005::DOUBLE * greatest(a.p_retailprice, b.p_retailprice) AND abs(a.p_size - b.p_size) <= 2""")
def q_tolerance_join(spark, sf):
    """Pairs within tolerances on two measures."""
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice", "p_size")
    pairs = fusion.near_pairs(rows, ["p_brand"], "p_partkey", "p_retailprice", 0.005, beside=("p_size", 2))
    return pairs.select("p_brand", F.col("a_p_partkey").alias("a_partkey"), F.col("b_p_partkey").alias("b_partkey"))


_PAIRS = """SELECT l_partkey AS a, l_suppkey AS b, sum(CAST(round(l_quantity) AS BIGINT))::DOUBLE AS score FROM lineitem GROUP BY 1, 2"""


@query(f"""WITH p AS ({_PAIRS}), s AS (SELECT *, max(score) OVER (PARTITION BY a) AS ma, max(score) OVER (PARTITION BY b) AS mb FROM p),
 t AS (SELECT *, count(*) FILTER (WHERE score = ma) OVER (PARTITION BY a) AS na, count(*) FILTER (WHERE score = mb) OVER (PARTITION BY b) AS nb FROM s)
 SELECT a, b, score FROM t WHERE score = ma AND score = mb AND na = 1 AND nb = 1""")
def q_mutual_unique_best(spark, sf):
    """Pairs that are each other's only best."""
    pairs = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum(F.round("l_quantity").cast("long")).cast("double").alias("score"))
    return fusion.mutual_unique_best(pairs, "a", "b", "score")


@query("""WITH c AS (SELECT * FROM customer WHERE c_custkey % 7 <> 0), n AS (SELECT s_suppkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(c_acctbal - s_acctbal), c_acctbal, c_custkey) AS n FROM supplier JOIN c ON s_nationkey = c_nationkey WHERE s_suppkey % 10 <> 0)
 SELECT s.s_suppkey, s_nationkey, c_custkey AS near_c_custkey, c_acctbal AS near_c_acctbal FROM supplier s LEFT JOIN n ON n.s_suppkey = s.s_suppkey AND n.n = 1""")
def q_nearest_value(spark, sf):
    """The customer of the same nation with the nearest balance; null and NaN are near to nothing."""
    left = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), F.when(F.col("s_suppkey") % 10 != 0, F.col("s_acctbal")).alias("balance"))
    known = F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).when(F.col("c_custkey") % 2 == 0, F.lit(float("nan")))
    right = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey", known.alias("c_acctbal"))
    near = fusion.nearest(left, right, ["nation"], "balance", "c_acctbal", "c_custkey")
    return near.select("s_suppkey", F.col("nation").alias("s_nationkey"), "near_c_custkey", "near_c_acctbal")


@query("""WITH v AS (SELECT p_brand, p_retailprice AS v, p_size::DOUBLE AS w FROM part),
 c AS (SELECT a.p_brand, a.v AS base, sum(b.w) AS weight FROM (SELECT DISTINCT p_brand, v FROM v) a JOIN v b ON a.p_brand = b.p_brand AND abs(b.v - a.v) <= 0.035::DOUBLE * a.v GROUP BY 1, 2),
 t AS (SELECT p_brand, base, weight FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY weight DESC, base) AS n FROM c) x WHERE n = 1)
 SELECT t.p_brand, base, weight, count(*)::BIGINT AS n, round(sum(v * w) / sum(w), 4) AS solved, round(max(abs(v - s.solved) / s.solved), 6) AS spread
 FROM t JOIN v ON t.p_brand = v.p_brand AND abs(v.v - base) <= 0.035::DOUBLE * base JOIN (SELECT t.p_brand, sum(v * w) / sum(w) AS solved FROM t JOIN v ON t.p_brand = v.p_brand AND abs(v.v - base) <= 0.035::DOUBLE * base GROUP BY 1) s ON s.p_brand = t.p_brand GROUP BY 1, 2, 3""")
def q_consensus_cluster(spark, sf):
    """The heaviest cluster of prices of each brand."""
    rows = table(spark, sf, "part").select("p_brand", F.col("p_retailprice").alias("v"), F.col("p_size").cast("double").alias("w"))
    out = fusion.consensus(rows, ["p_brand"], "v", "w", 0.035)
    return out.select("p_brand", "base", "weight", "n", F.round("solved", 4).alias("solved"), F.round("spread", 6).alias("spread"))


@query("""WITH e AS (SELECT user_id, floor(epoch(ts))::BIGINT AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) <= 1800 THEN 0 ELSE 1 END AS b FROM e),
 i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT user_id, min(t) AS low, max(t) AS high, count(*)::BIGINT AS n FROM i GROUP BY user_id, island""")
def q_interval_merge(spark, sf):
    """Sessions: events no more than half an hour apart."""
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select("user_id", t.alias("low"), t.alias("high"))
    return fusion.merge_intervals(rows, ["user_id"], "low", "high", F.lit(1800))


@query("""WITH i AS (SELECT l_suppkey, l_orderkey, min(epoch(l_shipdate)::BIGINT // 86400) AS low, max(epoch(l_shipdate)::BIGINT // 86400) AS high FROM lineitem GROUP BY 1, 2)
 SELECT a.l_suppkey, a.l_orderkey AS a_order, b.l_orderkey AS b_order FROM i a JOIN i b ON a.l_suppkey = b.l_suppkey AND a.l_orderkey < b.l_orderkey AND a.low <= b.high + 3 AND b.low <= a.high + 3""")
def q_interval_overlap(spark, sf):
    """Orders of a supplier whose shipping windows, three days longer, overlap."""
    day = F.floor(F.unix_timestamp(F.col("l_shipdate").cast("timestamp")) / 86400)
    windows = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.min(day).alias("low"), (F.max(day) + 3).alias("high"))
    pairs = fusion.overlapping(windows, ["l_suppkey"], "l_orderkey", "low", "high", 30)
    return pairs.select("l_suppkey", F.col("a_l_orderkey").alias("a_order"), F.col("b_l_orderkey").alias("b_order"))


@query()
def q_connected_components(spark, sf):
    """Components of orders and suppliers that share lines; tests hold them against union-find."""
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_suppkey") + 100000000).alias("b")).distinct()
    return graph.components(edges, "a", "b")


@query(f"""SELECT 'BLOCKER' AS severity, 1 AS rank, 'MISSING_RATE' AS code, l_orderkey AS entity, l_linenumber::BIGINT AS part FROM lineitem WHERE l_discount = 0 AND l_quantity > 49
 UNION ALL SELECT 'WARNING', 2, 'LOW_QUANTITY', l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < 2 AND l_tax > 0.07
 UNION ALL SELECT 'INFO', 3, 'URGENT', o_orderkey, 0 FROM orders WHERE o_orderpriority LIKE '1%' AND {CENTS.format('o_totalprice')} > 45000000""")
def q_issue_union(spark, sf):
    """Issues of several rules with their severity."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")

    def issues(rows, severity, rank, code, entity, part):
        return rows.select(F.lit(severity).alias("severity"), F.lit(rank).alias("rank"), F.lit(code).alias("code"), F.col(entity).alias("entity"), part.cast("long").alias("part"))

    found = issues(lines.filter("l_discount = 0 and l_quantity > 49"), "BLOCKER", 1, "MISSING_RATE", "l_orderkey", F.col("l_linenumber"))
    found = found.unionAll(issues(lines.filter("l_quantity < 2 and l_tax > 0.07"), "WARNING", 2, "LOW_QUANTITY", "l_orderkey", F.col("l_linenumber")))
    found = found.unionAll(issues(orders.filter("o_orderpriority like '1%'").filter(cents("o_totalprice") > 45000000), "INFO", 3, "URGENT", "o_orderkey", F.lit(0)))
    return found.orderBy("rank", "code", "entity", "part")


@query("""SELECT source, count(*)::BIGINT AS items, sum(CASE WHEN (n_chars >= 200) = (quality = 1) THEN 1 ELSE 0 END)::DOUBLE / count(*) AS accuracy, round(avg(abs(n_chars - 1000 * quality)::DOUBLE / greatest(n_chars, 1)), 6) AS mape FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def q_accuracy_eval(spark, sf):
    """Accuracy and mean relative error against labels."""
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    right = (F.col("n_chars") >= 200) == (F.col("quality") == 1)
    error = F.abs(F.col("n_chars") - 1000 * F.col("quality")).cast("double") / F.greatest("n_chars", F.lit(1))
    return rows.groupBy("source").agg(F.count("*").alias("items"), (F.sum(right.cast("int")).cast("double") / F.count("*")).alias("accuracy"), F.round(F.avg(error), 6).alias("mape"))


_WORDS = {"the": 1, "und": 2, "que": 2, "el ": 2, "license": 4, "email": 4}


@query("""WITH s AS (SELECT source, """ + " + ".join(f"least(12, {w} * ((length(lower(text)) - length(replace(lower(text), '{k}', ''))) // {len(k)}))" for k, w in _WORDS.items()) + """ AS score FROM documents)
 SELECT source, sum(least(score, 36))::BIGINT AS score, count(*)::BIGINT AS pages FROM s WHERE score >= 4 GROUP BY 1""")
def q_keyword_score(spark, sf):
    """Keyword scores, capped by word and by page."""
    score = sum((F.least(F.lit(12), w * F.regexp_count(F.lower("text"), F.lit(k))) for k, w in _WORDS.items()), F.lit(0))
    # The filter is part of the sums: as a filter of its own it would be pushed below, and each text scored twice.
    counts = F.struct(F.when(score >= 4, F.least(score, F.lit(36))).alias("s"))
    rows = table(spark, sf, "documents").select("source", F.element_at(F.transform(F.array(counts), lambda x: x["s"]), 1).alias("score"))
    return rows.groupBy("source").agg(F.sum("score").cast("long").alias("score"), F.count("score").alias("pages")).filter("pages > 0")


@query(r"""SELECT page_id, CAST(nullif(regexp_extract(html, 'track\((\d+)\)', 1), '') AS BIGINT) AS tracker, nullif(regexp_extract(url, '://([^/]+)', 1), '') AS host, len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs FROM pages""")
def q_regex_extract(spark, sf):
    """The tracker's number, the host and the count of paragraphs of web pages. The rules F14-F34 are in functions/text.py and functions/sheets.py."""
    return table(spark, sf, "pages").select("page_id", text.first(F.col("html"), r"track\((\d+)\)").cast("long").alias("tracker"), text.first(F.col("url"), "://([^/]+)").alias("host"), F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0))).alias("paragraphs"))


@query("""WITH l AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'Ground floor' WHEN 1 THEN 'Basement 2' WHEN 2 THEN 'lvl 3 - east' WHEN 3 THEN 'second floor' WHEN 4 THEN 'Roof deck' ELSE 'shed' END AS place FROM events)
 SELECT level, rank, count(*)::BIGINT AS n FROM (SELECT CASE place WHEN 'Ground floor' THEN 'Ground' WHEN 'Basement 2' THEN 'Basement 2' WHEN 'lvl 3 - east' THEN 'Level 3' WHEN 'second floor' THEN 'Level 2' WHEN 'Roof deck' THEN 'Roof' ELSE 'Unassigned' END AS level,
 CASE place WHEN 'Ground floor' THEN 0 WHEN 'Basement 2' THEN -98 WHEN 'lvl 3 - east' THEN 3 WHEN 'second floor' THEN 2 WHEN 'Roof deck' THEN 1000 ELSE 2000 END::DOUBLE AS rank FROM l) x GROUP BY 1, 2""")
def q_level_sort(spark, sf):
    """Levels named in text, in building order."""
    places = F.element_at(F.array(*[F.lit(x) for x in ("Ground floor", "Basement 2", "lvl 3 - east", "second floor", "Roof deck", "shed")]), (F.col("event_id") % 6 + 1).cast("int"))
    level = text.level(places)
    return table(spark, sf, "events").select(level.alias("level")).groupBy("level").agg(F.count("*").alias("n")).withColumn("rank", text.level_rank(F.col("level"))).orderBy("rank")


@query("""SELECT event_type, count(*)::BIGINT AS n, count(json_extract_string(props, '$.k'))::BIGINT AS with_k FROM events GROUP BY 1""")
def q_json_props(spark, sf):
    """(S27, S29)"""
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::DOUBLE) AS e FROM embeddings)
 SELECT vec_id, round(abs((e[1] * e[4] - e[3] * e[2]) + (e[3] * e[6] - e[5] * e[4]) + (e[5] * e[8] - e[7] * e[6]) + (e[7] * e[2] - e[1] * e[8])) / 2, 9) AS area FROM v""")
def q_poly_area(spark, sf):
    """Shoelace area of four vertices. (F100-F104)"""
    e = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    points = F.array(*[F.struct(F.element_at("e", 2 * k + 1).alias("x"), F.element_at("e", 2 * k + 2).alias("y")) for k in range(4)])
    return table(spark, sf, "embeddings").select("vec_id", e.alias("e")).select("vec_id", F.round(geometry.area(points), 9).alias("area"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), a AS (SELECT vec_id, sqrt(list_dot_product(e, e)) AS n, degrees(atan2(e[2], e[1])) AS d FROM v)
 SELECT vec_id, round(n, 6) AS norm, floor((d + CASE WHEN d < 0 THEN 180 ELSE 0 END) / 10)::INT AS bucket FROM a""")
def q_dot_and_angle(spark, sf):
    """Norms and direction buckets of ten degrees. (F118, F119)"""
    dot = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    d = F.degrees(F.atan2(F.element_at("embedding", 2).cast("double"), F.element_at("embedding", 1).cast("double")))
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(dot), 6).alias("norm"), F.floor((d + F.when(d < 0, 180).otherwise(0)) / 10).cast("int").alias("bucket"))


@query("""SELECT o_orderkey AS id, o_orderpriority AS owner, o_totalprice AS amount FROM orders WHERE NOT (o_orderpriority LIKE '1%') UNION ALL SELECT o_orderkey, o_orderpriority, o_totalprice * 2 FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'O'""")
def q_replace_by_owner(spark, sf):
    """Rows of an owner replaced by a new set. (K4-K8)"""
    rows = table(spark, sf, "orders")
    old = rows.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"), F.col("o_totalprice").alias("amount"))
    new = rows.filter("o_orderpriority like '1%' and o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"), (F.col("o_totalprice") * 2).alias("amount"))
    return fusion.replace_owned(old, new, "owner", "1")


@query("""WITH o AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), n AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events WHERE event_id % 2 = 1 AND value > 50 GROUP BY 1, 2)
 SELECT coalesce(n.user_id, o.user_id) AS user_id, coalesce(n.event_type, o.event_type) AS event_type, coalesce(n.event_id, o.event_id) AS event_id FROM o FULL JOIN n ON o.user_id = n.user_id AND o.event_type = n.event_type""")
def q_upsert_last_wins(spark, sf):
    """(K3, K10, K12, H9)"""
    events = table(spark, sf, "events")
    last = lambda rows: rows.groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))
    return fusion.upsert(last(events.filter("event_id % 2 = 0")), last(events.filter("event_id % 2 = 1 and value > 50")), ["user_id", "event_type"])


@query("""WITH d AS (SELECT r_name, sha256(n_nationkey::VARCHAR || '|' || n_nationkey::VARCHAR || '|' || n_name) AS digest FROM nation JOIN region ON n_regionkey = r_regionkey),
 g AS (SELECT r_name, digest[1:3] AS range, sha256(string_agg(digest, chr(10) ORDER BY digest)) AS digest, count(*) AS n FROM d GROUP BY 1, 2)
 SELECT r_name, sha256(string_agg(digest, chr(10) ORDER BY range)) AS fingerprint, sum(n)::BIGINT AS n_rows FROM g GROUP BY 1""")
def q_fingerprint(spark, sf):
    """(D15, D18, D27)"""
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return fusion.fingerprint(rows, ["n_nationkey", "n_name"], ["n_nationkey"], ["r_name"])


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) x WHERE n = 1""")
def q_fold_overrides(spark, sf):
    """The last entry of a log for each key."""
    rows = table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return fusion.fold(rows, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]).drop("ts")


@query("""SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2""")
def q_stream_window_counts(spark, sf):
    """Counts by hour of a stream of events, run until its files are used up."""
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counted = stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    at = scratch.path(spark, "stream")
    step = lambda rows, _: rows.select(F.col("w.start").alias("window_start"), "event_type", "n").write.mode("overwrite").parquet(f"{at}/rows")
    counted.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(step).start().awaitTermination()
    return spark.read.parquet(f"{at}/rows")


@query("""WITH RECURSIVE p AS (SELECT o_custkey % 40 AS ws, o_orderkey AS page_id, epoch(o_orderdate)::BIGINT // 86400 AS page_no, CASE o_orderkey % 6 WHEN 0 THEN 1 + o_orderkey % 4 END AS named, [round(o_totalprice % 40 + 1, 2), round(o_totalprice % 27 + 1, 2)] AS c FROM orders),
 f AS (SELECT c_custkey % 40 AS ws, list(w ORDER BY k) AS widths FROM (SELECT c_custkey, c_custkey % 40 AS x, k, max(CASE WHEN c_nationkey % 4 = k THEN round(abs(c_acctbal) % 40 + 1, 2) END) OVER (PARTITION BY c_custkey % 40, k) AS w FROM customer, (SELECT unnest([0, 1, 2, 3]) AS k) z) y WHERE c_custkey < 40 GROUP BY 1),
 m AS (SELECT p.ws, page_id, named, dense_rank() OVER (PARTITION BY p.ws ORDER BY page_no, page_id) AS nth, k, coalesce(widths[k], 0) AS w, c, CASE WHEN widths[k] > 0 THEN CASE WHEN abs(c[2] - widths[k]) < abs(c[1] - widths[k]) THEN c[2] ELSE c[1] END END AS d FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM p) p LEFT JOIN f ON f.ws = p.ws),
 n AS (SELECT ws, page_id, named, dense_rank() OVER (PARTITION BY ws ORDER BY nth) AS nth, list(CASE WHEN d IS NULL THEN 0 ELSE greatest(0, least(100, round_even(100.0::DOUBLE - abs(d - w) / w * 100.0::DOUBLE * 8.0::DOUBLE, 0))) END::INT ORDER BY k) AS s, list(w ORDER BY k) AS ws4, list(d ORDER BY k) AS ds FROM m GROUP BY ws, page_id, named, nth),
 walk(ws, nth, used, page_id, side) AS (SELECT DISTINCT ws, 0::BIGINT, 0, NULL::BIGINT, NULL::INT FROM n
  UNION ALL SELECT ws, nth, used | (1 << (side - 1)), page_id, side FROM (SELECT w.ws, n.nth, w.used, n.page_id, coalesce(n.named, list_position([n.s[i] - 8 * ((w.used >> (i - 1)) & 1) for i in [1, 2, 3, 4]], list_max([n.s[i] - 8 * ((w.used >> (i - 1)) & 1) for i in [1, 2, 3, 4]])))::INT AS side FROM walk w JOIN n ON n.ws = w.ws AND n.nth = w.nth + 1) x),
 r AS (SELECT w.page_id, w.side, n.named IS NOT NULL AS explicit, n.ws4[w.side] AS width, n.ds[w.side] AS d FROM walk w JOIN n ON n.page_id = w.page_id), q AS (SELECT *, abs(d - width) / width * 100.0::DOUBLE AS pct FROM r)
 SELECT page_id, ['North', 'East', 'South', 'West'][side] AS orientation, explicit AS orientation_explicit, width::DOUBLE AS plan_width_m, d::DOUBLE AS elevation_dimension_m, CASE WHEN explicit AND pct <= 2.0005 THEN 'Verified cross-view' WHEN explicit THEN 'Orientation identified; width needs review' WHEN pct <= 2.0005 THEN 'Probable width match; orientation needs review' ELSE 'Needs estimator registration' END AS status FROM q""")
def q_elevation_sides(spark, sf):
    """Elevation pages registered to sides in the order of their pages; sides may be used again."""
    o = dealt(spark, sf, "orders", "o_orderkey")
    number = lambda c, n: F.round(F.col(c) % n + 1, 2)
    named = F.when(F.col("o_orderkey") % 6 == 0, F.element_at(F.array(*[F.lit(s) for s in registration.SIDES]), (F.col("o_orderkey") % 4 + 1).cast("int")))
    pages = o.select((F.col("o_custkey") % 40).alias("workspace_id"), F.col("o_orderkey").alias("page_id"), F.floor(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) / 86400).alias("page_no"), named.alias("orientation"), F.array(number("o_totalprice", 40), number("o_totalprice", 27)).alias("candidates"))
    sides = F.element_at(F.array(*[F.lit(s) for s in registration.SIDES]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    facades = table(spark, sf, "customer").select((F.col("c_custkey") % 40).alias("workspace_id"), sides.alias("side"), F.round(F.abs("c_acctbal") % 40 + 1, 2).alias("projected_width_m"))
    return registration.register_sides(pages, facades).select("page_id", "orientation", "orientation_explicit", "plan_width_m", "elevation_dimension_m", "status")
