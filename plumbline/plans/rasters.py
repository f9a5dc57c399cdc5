"""Driver queries: what is drawn on raster pages. Their pixels are made of the tables' rows, a page for each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import raster
from ..scratch import shuffled
from .shared import dealt, query, table

WIDE = 16  # pixels of a row of the pictures that vectors make


@query(f"""WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) < 0 AS dark, len(embedding) // {WIDE} * {WIDE} AS n FROM embeddings),
 g AS (SELECT vec_id, k % {WIDE} AS x, k // {WIDE} AS y FROM v WHERE dark AND k < n),
 q AS (SELECT vec_id, x + dx AS x, y + dy AS y, count(*) AS n, bool_or(dx = 0 AND dy = 0) AND bool_or(dx = 1 AND dy = 1) AND count(*) = 2 OR bool_or(dx = 1 AND dy = 0) AND bool_or(dx = 0 AND dy = 1) AND count(*) = 2 AS diagonal FROM g, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) d(dx, dy) GROUP BY ALL),
 e AS (SELECT vec_id, ((count(*) FILTER (n = 1) - count(*) FILTER (n = 3) - 2 * count(*) FILTER (diagonal)) // 4)::BIGINT AS euler FROM q GROUP BY 1),
 s AS (SELECT a.vec_id, count(*)::BIGINT AS pixels, sum(4 - (SELECT count(*) FROM g b WHERE b.vec_id = a.vec_id AND abs(a.x - b.x) + abs(a.y - b.y) = 1))::BIGINT AS length FROM g a GROUP BY 1)
 SELECT s.vec_id, pixels, length, euler FROM s JOIN e ON e.vec_id = s.vec_id""")
def q_outlines(spark, sf):
    """Outlines of what is dark in each vector's picture: their areas make its pixels, outer ones less holes its Euler number. (F126, F128)"""
    n = F.floor(F.size("embedding") / WIDE).cast("int")
    gray = lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 400 + 128).cast("int")))
    data = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, n * WIDE), lambda v: F.lpad(F.hex(gray(v)), 2, "0")), ""))
    pages = dealt(spark, sf, "embeddings", "vec_id").select(F.col("vec_id").alias("page_id"), n.alias("height"), F.lit(WIDE).alias("width"), F.lit(1).alias("channels"), data.alias("data"))
    marked = raster.labelled(raster.runs(raster.tiles(pages, 8), F.lit(128), 8), 8)
    rings = raster.outlines(marked, points=False)
    return rings.groupBy(F.col("page_id").alias("vec_id")).agg(F.sum("area").alias("pixels"), F.sum("length").alias("length"), F.sum(F.signum("area")).cast("long").alias("euler"))


def _dealt(df, ident: str):
    """The rows that pictures are made of, dealt over all cores: a few megabytes of them are one task's otherwise."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, ident)


def _picture(ident, height: int, width: int, rows):
    """A page of one channel from (rows, [(pixels, dark)])."""
    run = lambda n, dark: F.repeat(F.lit("00" if dark else "FF"), n)
    line = lambda runs: F.concat(*[run(n, dark) for n, dark in runs])
    data = F.unhex(F.concat(*[F.repeat(line(runs), n) for n, runs in rows]))
    return [ident.alias("page_id"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("channels"), data.alias("data")]


@query("""WITH p AS (SELECT p_partkey AS page_id, 4 + p_partkey % 7 AS x, 5 + p_partkey % 5 AS y, 12 + p_size % 30 AS w, 12 + floor(p_retailprice)::BIGINT % 25 AS h FROM part), b AS (SELECT page_id, x - 1 AS x0, y - 1 AS y0, w + 2 AS w, h + 2 AS h FROM p UNION ALL SELECT page_id, x + 1, y + 1, w - 2, h - 2 FROM p)
 SELECT page_id, x0::BIGINT AS x0, y0::BIGINT AS y0, (x0 + w)::BIGINT AS x1, (y0 + h)::BIGINT AS y1, CASE WHEN page_id % 3 > 0 THEN w / 20.0::DOUBLE END AS width_m, CASE WHEN page_id % 3 > 0 THEN h / 20.0::DOUBLE END AS height_m FROM b WHERE ((w - 1) * (h - 1))::DOUBLE / (w * h) >= 0.35""")
def q_raster_rectangles(spark, sf):
    """Rectangles drawn on rendered elevations, in metres where the calibration is of the same pixels."""
    k = F.col("p_partkey")
    x, y, w, h = 4 + k % 7, 5 + k % 5, 12 + F.col("p_size") % 30, 12 + F.floor("p_retailprice") % 25
    x, y, w, h = (v.cast("int") for v in (x, y, w, h))
    blank, edge = [(F.lit(64), False)], [(x, False), (w, True), (64 - x - w, False)]
    sides = [(x, False), (F.lit(1), True), (w - 2, False), (F.lit(1), True), (64 - x - w, False)]
    pages = _dealt(table(spark, sf, "part"), "p_partkey").select(*_picture(k, 64, 64, [(y, blank), (F.lit(1), edge), (h - 2, sides), (F.lit(1), edge), (64 - y - h, blank)]))
    scales = table(spark, sf, "part").select(k.alias("page_id"), F.when(k % 3 == 1, "render_pixel").when(k % 3 == 2, "render_pixel").otherwise("pdf_point").alias("coord_space"), F.lit(20.0).alias("px_per_m"))
    got = raster.rectangles(pages, scales, tile=64)
    return got.select("page_id", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")], "width_m", "height_m")


@query("""WITH s AS (SELECT s_suppkey AS page_id, 20 + s_suppkey % 7 AS x, 10 + s_suppkey % 5 AS y, 100 + s_nationkey AS w, 40 + s_suppkey % 11 AS h FROM supplier)
 SELECT page_id, x::BIGINT AS x0, y::BIGINT AS y0, (x + w)::BIGINT AS x1, (y + h)::BIGINT AS y1, (2 * 3 * w + (h - 6) * 6 - 3 * 6)::BIGINT AS pixels, round(((w - 1) / 2.0) * (h - 1) / 100, 2)::DOUBLE AS envelope_pct FROM s""")
def q_raster_plans(spark, sf):
    """The dominant drawing of each page and its building's envelope, whose door is a gap in the wall. (F127, F128)"""
    k = F.col("s_suppkey")
    x, y, w, h = (v.cast("int") for v in (20 + k % 7, 10 + k % 5, 100 + F.col("s_nationkey"), 40 + k % 11))
    blank, wall = [(F.lit(200), False)], [(x, False), (w, True), (200 - x - w, False)]
    door = [(x, False), (F.lit(30), True), (F.lit(6), False), (w - 36, True), (200 - x - w, False)]
    sides = [(x, False), (F.lit(3), True), (w - 6, False), (F.lit(3), True), (200 - x - w, False)]
    # A few kilobytes of suppliers are one task's otherwise; 2,000 pictures are 40 MB of pixels.
    rows = table(spark, sf, "supplier")
    pages = rows.repartition(max(4 * spark.sparkContext.defaultParallelism, rows.count() // 2000), "s_suppkey").select(*_picture(k, 100, 200, [(y, blank), (F.lit(3), door), (h - 6, sides), (F.lit(3), wall), (100 - y - h, blank)]))
    drawn = raster.drawing_component(pages, tile=64).select("page_id", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")], "pixels")
    return drawn.join(shuffled(raster.envelopes(pages, tile=128).filter("nth = 1").select("page_id", F.col("area_pct").alias("envelope_pct"))), "page_id", "left")
