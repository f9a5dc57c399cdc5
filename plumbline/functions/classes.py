"""Classes that words put things into: substrates, legend entries, overhead regions, colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: Words of a material and the substrate that they mean, in order of precedence.
SUBSTRATES = (
    (("lineaboard", "linea"), "Lineaboard Cladding"),
    (("textureboard",), "Textureboard Cladding"),
    (("easylap",), "Easylap Cladding"),
    (("fibre cement", "fiber cement", "fc sheet", "fc cladding"), "Fibre Cement Cladding"),
    (("render", "rendered", "blockwork", "masonry"), "Rendered / Blockwork"),
    (("timber", "weatherboard"), "Timber / Weatherboard Cladding"),
    (("soffit", "eave"), "Soffits / Eaves"),
    (("screen",), "Screens"),
    (("balustrade",), "Balustrade"),
    (("sunhood", "sun hood"), "Sunhoods"),
    (("downpipe",), "Downpipes"),
    (("garage door",), "Garage Doors"),
    (("roof sheet", "roofing"), "Roof Sheet"),
    (("gutter", "capping", "parapet cap"), "Cappings & Gutters"),
)
#: Codes and words of a legend's classes.
LEVEL_CODES = ("AFFL", "FFL", "FCL", "RL", "NGL", "SSL", "TOS", "TOC", "CL", "C/L")
DRAWING_CODES = ("TYP", "UNO", "UON", "NTS", "COS", "EQ", "EX", "EXT", "INT", "CJ", "EJ")
LEVEL_WORDS = (
    "finished floor level", "above finished floor", "finished ceiling level", "reduced level", "natural ground level", "structural slab level", "top of steel", "top of concrete",
    "centre line", "center line", "dimension", "level datum", "datum level",
)
REFERENCE_WORDS = (
    "wall type", "partition type", "door type", "window type", "detail", "keynote", "key note", "panel type", "assembly type", "wall piece", "piece mark", "drawing reference", "section reference",
)
MATERIAL_WORDS = (
    "cladding", "substrate", "render", "blockwork", "masonry", "plasterboard", "gypsum", "fibre cement", "fiber cement", "fc sheet", "weatherboard", "linea", "easylap",
    "textureboard", "timber", "steel", "metal", "aluminium", "aluminum", "soffit", "eave", "balustrade", "screen", "concrete", "precast", "brick", "roof sheet", "gutter", "capping",
)
#: Patterns of overhead regions, in order of precedence, and which of them are outside.
OVERHEAD = (
    ("breezeway", r"\bbreezeway\b|common\s+circulation"),
    ("balcony_soffit", r"balcon(?:y|ies).*soffit|soffit.*balcon"),
    ("external_soffit", r"\bsoffit\b|\beaves?\b|external\s+ceiling"),
    ("canopy", r"\bcanopy\b|awning"),
    ("bulkhead", r"\bbulkhead\b|ceiling\s+drop"),
    ("internal_ceiling", r"\bceiling\b|\brcp\b"),
)
OUTSIDE = ("breezeway", "balcony_soffit", "external_soffit", "canopy")
#: Words of colours, in the order in which a word is tried for them.
COLOUR_WORDS = (
    "white", "black", "grey", "gray", "cream", "beige", "tan", "brown", "red", "blue", "green", "yellow", "orange", "purple", "pink", "charcoal", "anthracite", "monument", "surfmist", "paperbark",
    "cornshell", "dune", "stone", "cottage", "wl", "night sky", "deep ocean", "neutral", "natural", "primed", "painted",
)


def _any(x: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | x.contains(w), words, F.lit(False))


def substrate(description: Column) -> Column:
    """The substrate that a description names, "" where it names none."""
    x, out = F.lower(F.coalesce(description, F.lit(""))), F.when(F.lit(False), "")
    for words, name in SUBSTRATES:
        out = out.when(_any(x, words), name)
    return out.otherwise("")


def legend_category(code: Column, description: Column) -> Column:
    """What kind of thing a legend's entry is."""
    c, x = F.upper(F.coalesce(code, F.lit(""))), text.low(description)
    tag = (_any(x, text.TAG_WORDS)) | _any(x, REFERENCE_WORDS)
    out = F.when(c.isin(*LEVEL_CODES) | _any(x, LEVEL_WORDS), "level / dimension").when(tag, "drawing tag").when(_any(x, text.FINISH_WORDS), "finish")
    return out.when(_any(x, MATERIAL_WORDS), "material / substrate").when(c.isin(*DRAWING_CODES), "drawing abbreviation").otherwise("general abbreviation")


def overhead(said: Column, area: Column) -> Column:
    """struct(kind, outside, geometry_confidence, scope_confidence) of an overhead region."""
    x, kind = F.coalesce(said, F.lit("")), F.when(F.lit(False), "")
    for name, pattern in OVERHEAD:
        kind = kind.when(x.rlike(f"(?i){pattern}"), name)
    kind = kind.otherwise("unknown")
    return F.struct(kind.alias("kind"), kind.isin(*OUTSIDE).alias("outside"), F.when(area.isNotNull(), 0.95).otherwise(0.55).alias("geometry_confidence"), F.when(kind != "unknown", 0.95).otherwise(0.4).alias("scope_confidence"))


def colour_word(word: Column) -> Column:
    """The first colour that a word holds, null without one."""
    x = F.lower(F.trim(F.coalesce(word, F.lit(""))))
    return F.get(F.filter(F.array(*[F.lit(c) for c in COLOUR_WORDS]), lambda c: x.contains(c)), F.lit(0))
