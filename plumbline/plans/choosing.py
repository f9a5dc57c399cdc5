"""Driver queries: pricing, summaries, choosing and joining rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing
from ..operators import fusion, takeoff
from ..scratch import shuffled
from .shared import CENTS, NET, cents, dealt, net, query, table


@query(f"""SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n_rows, sum(CAST(round(l_quantity) AS BIGINT))::DOUBLE AS quantity,
 (sum({NET}) / 10000.0)::DOUBLE AS value_ex_gst, sum(CASE WHEN l_quantity >= 25 THEN CAST(round(l_quantity) AS BIGINT) ELSE 0 END)::DOUBLE AS large_quantity
 FROM lineitem GROUP BY 1, 2""")
def q_price_summary(spark, sf):
    """Conditional sums of each group."""
    whole = F.round("l_quantity").cast("long")
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n_rows"), F.sum(whole).cast("double").alias("quantity"), (F.sum(net()) / F.lit(10000.0)).alias("value_ex_gst"),
        F.sum(F.when(F.col("l_quantity") >= 25, whole).otherwise(0)).cast("double").alias("large_quantity"))


@query(f"""WITH v AS (SELECT o_orderpriority AS level, (sum({NET}) / 10000.0)::DOUBLE AS value_ex_gst FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
 m AS (SELECT level, value_ex_gst, value_ex_gst * 1.1::DOUBLE AS markup_ex_gst FROM v)
 SELECT level, value_ex_gst, markup_ex_gst, markup_ex_gst * 0.1::DOUBLE AS gst, markup_ex_gst + markup_ex_gst * 0.1::DOUBLE AS total_inc_gst FROM m""")
def q_quote_markup(spark, sf):
    """Mark-up and tax over a summary. (A3)"""
    lines = table(spark, sf, "lineitem").select("l_orderkey", net().alias("net")).groupBy("l_orderkey").agg(F.sum("net").alias("net"))
    joined = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    return takeoff.quote(joined.groupBy(F.col("o_orderpriority").alias("level")).agg((F.sum("net") / F.lit(10000.0)).alias("value_ex_gst")))


@query("""WITH s AS (SELECT l_partkey, sum(CASE WHEN l_suppkey % 2 = 0 THEN l_quantity ELSE 0 END)::DOUBLE AS ai_qty, sum(CASE WHEN l_suppkey % 2 = 1 THEN l_quantity ELSE 0 END)::DOUBLE AS drawn_qty FROM lineitem GROUP BY 1)
 SELECT *, drawn_qty - ai_qty AS variance, CASE WHEN ai_qty = 0 AND drawn_qty = 0 THEN 'Manual / not yet measured' WHEN ai_qty > 0 AND drawn_qty > 0 THEN CASE WHEN abs(drawn_qty - ai_qty) <= greatest(0.01::DOUBLE, 0.02::DOUBLE * greatest(ai_qty, drawn_qty)) THEN 'Matched' ELSE 'Difference' END
 WHEN ai_qty > 0 THEN 'AI only (not drawn)' ELSE 'Drawn only (no AI draft)' END AS status FROM s""")
def q_reconcile_two_sources(spark, sf):
    """Two sources' sums of each key, within tolerance or not. (A10)"""
    even = F.col("l_suppkey") % 2 == 0
    sums = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.sum(F.when(even, F.col("l_quantity")).otherwise(0.0)).alias("ai_qty"), F.sum(F.when(~even, F.col("l_quantity")).otherwise(0.0)).alias("drawn_qty"))
    return sums.withColumn("variance", F.col("drawn_qty") - F.col("ai_qty")).withColumn("status", takeoff.difference(F.col("ai_qty"), F.col("drawn_qty")))


@query("""SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) x WHERE n = 1""")
def q_latest_per_key(spark, sf):
    """(W1, W2)"""
    return fusion.choose(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], largest=True)


@query("""SELECT o_custkey, o_orderkey, (row_number() OVER w)::INT AS rank_in_key, row_number() OVER w = 1 AS is_current, CASE WHEN row_number() OVER w > 1 THEN first_value(o_orderkey) OVER w END AS superseded_by
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)""")
def q_superseded_flag(spark, sf):
    """(W1, K33)"""
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return fusion.superseded(rows, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], "o_orderkey").drop("o_orderdate")


_RANK = {"purchase": 1, "signup": 2, "click": 3, "view": 4}


@query("""SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 WHEN 'view' THEN 4 ELSE 9 END, value DESC NULLS LAST, event_id) AS n FROM events) x WHERE n = 1""")
def q_priority_pick(spark, sf):
    """Best evidence by rank of its kind, then value."""
    kind = F.coalesce(*[F.when(F.col("event_type") == k, r) for k, r in _RANK.items()], F.lit(9))
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    return fusion.choose(rows, ["user_id"], [kind, F.col("value").isNull(), -F.col("value"), F.col("event_id")])


@query("""SELECT user_id, event_id, value, value >= 50 AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(value >= 50, false) DESC, ts DESC, event_id DESC) AS n FROM events) x WHERE n = 1""")
def q_accepted_last(spark, sf):
    """The last accepted observation, else the last."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "value", (F.col("value") >= 50).alias("accepted"), "ts")
    return fusion.choose(rows, ["user_id"], [F.coalesce("accepted", F.lit(False)), F.col("ts"), F.col("event_id")], largest=True).drop("ts")


@query("""SELECT coalesce(p_brand, 'Unknown') AS brand, count(*)::BIGINT AS n_lines FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) p ON l_partkey = p_partkey GROUP BY 1""")
def q_left_lookup_unknown(spark, sf):
    """(J39)"""
    known = table(spark, sf, "part").filter("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("brand"))
    lines = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"))
    return fusion.lookup(lines, known, "l_partkey", "brand").groupBy("brand").agg(F.sum("n").alias("n_lines"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def q_anti_missing(spark, sf):
    """(J38, K11)"""
    large = table(spark, sf, "orders").filter("o_totalprice > 200000").select("o_custkey")
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity > 49)")
def q_semi_referenced(spark, sf):
    """(J37, K35)"""
    used = table(spark, sf, "lineitem").filter("l_returnflag = 'R' and l_quantity > 49").select("l_suppkey").distinct()
    return table(spark, sf, "supplier").select("s_suppkey", "s_name").join(used, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")


@query(f"SELECT r_name, n_name, count(*)::BIGINT AS customers, (sum({CENTS.format('c_acctbal')}) / 100.0)::DOUBLE AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def q_broadcast_dims(spark, sf):
    """Inner joins to small dimensions, after the fact is aggregated."""
    facts = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"), (F.sum(cents("c_acctbal")) / F.lit(100.0)).alias("balance"))
    dims = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return facts.join(dims, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "customers", "balance")


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) x WHERE n <= 4""")
def q_topk_per_group(spark, sf):
    """The four highest of each key."""
    from pyspark.sql import Window as W

    w = W.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return rows.withColumn("n", F.row_number().over(w)).filter("n <= 4").drop("n")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, l_quantity, sum(l_quantity) OVER (PARTITION BY l_orderkey) AS s, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
 SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN o_totalprice WHEN s > 0 THEN o_totalprice * l_quantity / s ELSE 0 END::DOUBLE AS allocated FROM w JOIN orders ON l_orderkey = o_orderkey""")
def q_allocate_proportional(spark, sf):
    """An order's price shared among its lines by quantity."""
    # Dealt by the key in as many parts as lines have MiB, which Spark doesn't put together: a task's rows are as many at any size.
    lines = dealt(spark, sf, "lineitem", "l_orderkey").select("l_orderkey", "l_linenumber", "l_quantity")
    joined = lines.join(shuffled(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")), "l_orderkey")
    return fusion.allocate(joined, ["l_orderkey"], "l_quantity", "o_totalprice", "allocated").select("l_orderkey", "l_linenumber", "allocated")


@query("""SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY sha256(text)""")
def q_dedup_keys(spark, sf):
    """Exact copies, the least id kept."""
    return table(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("SELECT l_partkey, min(l_tax)::DOUBLE AS low, max(l_tax)::DOUBLE AS high, count(*)::BIGINT AS n, (max(l_tax) - min(l_tax))::DOUBLE AS spread FROM lineitem GROUP BY 1 HAVING max(l_tax) - min(l_tax) > 0.0701")
def q_conflict_detect(spark, sf):
    """(D1, D2)"""
    return fusion.conflicts(table(spark, sf, "lineitem"), ["l_partkey"], "l_tax", 0.0701)


@query("""SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%steel%' THEN 95 WHEN lower(p_type) LIKE '%brass%' THEN 42 WHEN lower(p_brand) LIKE '%1%' THEN 28 WHEN p_size > 25 THEN 15 ELSE 0 END::DOUBLE AS rate FROM part""")
def q_rank_match_first(spark, sf):
    """The first rule of a ladder that fits."""
    kind, brand = F.lower("p_type"), F.lower("p_brand")
    rate = F.when(kind.contains("steel"), 95.0).when(kind.contains("brass"), 42.0).when(brand.contains("1"), 28.0).when(F.col("p_size") > 25, 15.0).otherwise(0.0)
    return table(spark, sf, "part").select("p_partkey", rate.alias("rate"))


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_quantity / 10 < 3 THEN 1.0 WHEN l_quantity / 10 < 4.5 THEN 1.15 ELSE 1.3 END)::DOUBLE AS factor, CASE WHEN l_returnflag = 'R' THEN greatest(l_discount * 10, 0.5::DOUBLE) ELSE l_discount * 10 END::DOUBLE AS area FROM lineitem""")
def q_min_area_surcharge(spark, sf):
    """(F74, F75)"""
    small = F.col("l_returnflag") == "R"
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pricing.height_surcharge(F.col("l_quantity") / 10).alias("factor"), pricing.minimum_area(F.col("l_discount") * 10, F.lit("m²"), small).alias("area"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN greatest(0, l_quantity * 2 / 12) ELSE 0 END::DOUBLE AS litres, CASE WHEN l_discount > 0 THEN greatest(0, l_quantity / (l_discount * 100)) ELSE 0 END::DOUBLE AS hours FROM lineitem""")
def q_paint_units(spark, sf):
    """Arithmetic guarded by units and by zero."""
    unit = F.when(F.col("l_linestatus") == "O", "m²").otherwise("lm")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", pricing.litres(F.col("l_quantity"), unit, F.lit(2.0), F.lit(12.0)).alias("litres"), pricing.hours(F.col("l_quantity"), unit, F.col("l_discount") * 100).alias("hours"))


@query("""SELECT l_orderkey, l_linenumber, side, l_quantity * share AS quantity FROM lineitem, (VALUES ('wall', 1::DOUBLE), ('ceiling', 0.5::DOUBLE), ('skirting', 0.25::DOUBLE)) s(side, share)""")
def q_explode_fanout(spark, sf):
    """One row to several."""
    parts = F.array(*[F.struct(F.lit(n).alias("side"), F.lit(s).alias("share")) for n, s in (("wall", 1.0), ("ceiling", 0.5), ("skirting", 0.25))])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.inline(parts)).select("l_orderkey", "l_linenumber", "side", (F.col("l_quantity") * F.col("share")).alias("quantity"))


@query("""SELECT l_orderkey, l_linenumber, channel, amount FROM (SELECT l_orderkey, l_linenumber, unnest(['quantity', 'discount', 'tax']) AS channel, unnest([l_quantity, l_discount, l_tax]) AS amount FROM lineitem) x WHERE amount > 0""")
def q_unpivot_channels(spark, sf):
    """Quantity channels to rows, empty ones left out."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return rows.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "discount", "tax"], "channel", "amount").filter("amount > 0")
