"""Where things come from: the graph of a scene's objects, evidence of surfaces, fields of a title block by their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..scratch import shuffled, written

#: What a title block calls its fields, and what a value of each looks like.
FIELDS = {
    "scale": (r"^scale[:.]?$", r"^1\s*[:/]\s*\d{2,4}$"),
    "revision": (r"^rev(?:ision)?[:.]?$", r"^[A-Z0-9]{1,3}$"),
    "sheet_no": (r"^(?:dwg|drawing|sheet)(?:\s*no)?[:.]?$", r"^[A-Z]{1,3}[-. ]?\d{2,4}[A-Z]?$"),
    "date": (r"^date[:.]?$", r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4}$"),
}
TITLE_X, TITLE_Y, REACH = 0.55, 0.70, 120.0


def scene_graph(objects: DataFrame) -> DataFrame:
    """Each object's root, depth and state. objects: workspace_id, object_id, parent_id, kind.

    An id that occurs more than once is ambiguous and rejected, and so is what hangs from it; an object whose parent
    isn't there is an orphan, one that is its own ancestor a cycle. Paths are followed by doubling steps, so there are
    as many rounds as the logarithm of the deepest tree, each a join of the whole table with itself on the id.
    """
    keys = ["workspace_id", "object_id"]
    counted = objects.groupBy(*keys).agg(F.count("*").alias("n"), F.min("parent_id").alias("parent_id"), F.min("kind").alias("kind"))
    single = counted.filter("n = 1")
    rejected = counted.filter("n > 1").select(*keys, "kind", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit("duplicate_id").alias("state"))
    here = single.select("workspace_id", F.col("object_id").alias("parent_id"), F.lit(True).alias("there"))
    nodes = single.join(shuffled(here), ["workspace_id", "parent_id"], "left")
    whole = F.col("parent_id").isNull()
    # up: the farthest ancestor seen so far, steps away; done where it is a root or its parent is missing
    nodes = nodes.select(*keys, "kind", F.when(whole, F.col("object_id")).otherwise(F.col("parent_id")).alias("up"), F.when(whole, 0).otherwise(1).cast("long").alias("steps"), F.when(whole, "root").when(F.col("there"), "open").otherwise("orphan").alias("end"))
    nodes = written(nodes, "scene")
    left, before = nodes.filter("end = 'open'").count(), None
    while left and left != before:  # a round in which none ends leaves cycles alone
        ahead = nodes.select("workspace_id", F.col("object_id").alias("up"), F.col("up").alias("further"), F.col("steps").alias("more"), F.col("end").alias("next"))
        joined = nodes.join(shuffled(ahead), ["workspace_id", "up"], "left")
        go = F.col("end") == "open"
        nodes = written(joined.select(*keys, "kind", F.when(go, F.col("further")).otherwise(F.col("up")).alias("up"), F.when(go, F.col("steps") + F.col("more")).otherwise(F.col("steps")).alias("steps"), F.when(go, F.col("next")).otherwise(F.col("end")).alias("end")), "scene")
        before, left = left, nodes.filter("end = 'open'").count()
    ok = F.col("end") == "root"
    out = nodes.select(*keys, "kind", F.when(ok, F.col("up")).alias("root"), F.when(ok, F.col("steps")).alias("depth"), F.when(ok, "ok").when(F.col("end") == "open", "cycle").otherwise("orphan").alias("state"))
    return out.unionByName(rejected)


def surface_evidence(polygons: DataFrame) -> DataFrame:
    """Evidence of each filled polygon: area and perimeter in metres, box, centre, confidence, key. (F116)

    polygons: workspace_id, page_id, shape_id, points, m_per_pt, scale_confidence. Without a scale areas are null and
    the confidence is halved. Polygons that don't enclose anything aren't evidence.
    """
    p, m = F.col("points"), F.col("m_per_pt")
    box, centre = geometry.bbox(p), geometry.centroid(p)
    rounded = F.array_join(F.transform(p, lambda q: F.concat_ws(",", F.round(q["x"], 2).cast("string"), F.round(q["y"], 2).cast("string"))), ";")
    scaled = F.coalesce(m > 0, F.lit(False))
    rows = polygons.filter((F.size(p) >= 3) & (geometry.area(p) > 0))
    return rows.select(
        "workspace_id", "page_id", "shape_id", F.when(scaled, geometry.area(p) * m * m).alias("area_m2"), F.when(scaled, geometry.perimeter(p) * m).alias("perimeter_m"), box.alias("box"), centre.alias("centre"),
        F.when(scaled, F.coalesce("scale_confidence", F.lit(0.0))).otherwise(F.coalesce("scale_confidence", F.lit(0.0)) / 2).alias("confidence"), F.sha2(F.concat_ws("|", F.col("page_id").cast("string"), rounded), 256).alias("geometry_key"),
    )


def _named(c: Column, at: int) -> Column:
    x, out = F.trim(c), F.when(F.lit(False), "")
    for name, patterns in FIELDS.items():
        out = out.when(x.rlike(f"(?i){patterns[at]}"), name)
    return out


def placed_fields(words: DataFrame) -> DataFrame:
    """Fields of title blocks by place: the nearest fitting value right of or below each label.

    words: page_id, word_id, text, x, y, page_width, page_height. Only words in the lower right of a page count. A
    grid of the reach brings labels and values together.
    """
    inside = words.filter((F.col("x") > TITLE_X * F.col("page_width")) & (F.col("y") > TITLE_Y * F.col("page_height")))
    cell = lambda c: F.floor(F.col(c) / REACH)
    labels = inside.withColumn("field", _named(F.col("text"), 0)).filter("field is not null").select("page_id", "field", F.col("x").alias("lx"), F.col("y").alias("ly"), F.explode(F.array(*[cell("x") + d for d in (-1, 0, 1)])).alias("cx"), F.array(*[cell("y") + d for d in (-1, 0, 1)]).alias("cys")).withColumn("cy", F.explode("cys")).drop("cys")
    fits = [F.when(F.trim("text").rlike(p[1]) & F.lit(True), F.lit(n)) for n, p in FIELDS.items()]
    values = inside.filter(_named(F.col("text"), 0).isNull()).withColumn("field", F.explode(F.array_compact(F.array(*fits)))).select("page_id", "field", "word_id", F.trim("text").alias("value"), "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    met = labels.join(shuffled(values), ["page_id", "field", "cx", "cy"]).filter((F.col("x") >= F.col("lx") - 2) & (F.col("y") >= F.col("ly") - 4))
    met = met.withColumn("distance", F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly"))).filter(F.col("distance") <= REACH)
    best = met.groupBy("page_id", "field").agg(F.min(F.struct("distance", "word_id", "value")).alias("b"))
    return best.select("page_id", "field", F.when(F.col("field") == "revision", text.clean(F.upper("b.value"))).otherwise(F.col("b.value")).alias("value"), F.col("b.distance").alias("distance"))
