"""What drawing text says, as Column expressions: levels, scopes, units, scales, revisions, sheets, dimensions, codes.

Every function takes and returns Columns, treats null as empty text and never invents a value: where nothing is found
the result is null (or the named remainder class).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kept import let


def clean(c: Column) -> Column:
    """Null as empty, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " "))


def low(c: Column) -> Column:
    return F.lower(clean(c))


def norm_key(c: Column) -> Column:
    """Lower-case letters and digits only; raised 2 and 3 become digits. (F2)"""
    return F.regexp_replace(F.translate(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "²³", "23"), "[^a-z0-9]+", "")


def first(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the pattern's first match, null where there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def number(c: Column, default: float = 0.0) -> Column:
    """A finite number, or the default. (F8)"""
    x = F.expr("cast(null as double)") if c is None else c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(x)


def quantity(c: Column) -> Column:
    """The number in a quantity cell, whatever stands around it; 0 where there is none."""
    return number(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[^0-9.\-]", ""))


#: Spellings of the canonical units.
UNITS = {
    "m²": ("m2", "sqm", "sq m", "m²", "square metres", "square meter"),
    "lm": ("lm", "m", "lin m", "lineal", "linear metre", "metre"),
    "No.": ("no", "no.", "nos", "ea", "each", "count", "each (no.)"),
    "L": ("l", "litre", "litres", "ltr", "lt"),
}


def unit(c: Column) -> Column:
    """The canonical unit; unknown units keep their name in title case."""
    x = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F.when(x.isin(*UNITS["m²"]) | x.contains("m2") | x.contains("m²"), F.lit("m²"))
    for name in ("lm", "No.", "L"):
        out = out.when(x.isin(*UNITS[name]), F.lit(name))
    return out.when(x.contains("item"), F.lit("item")).when(x.contains("allow"), F.lit("allowance")).otherwise(title(x))


def title(c: Column) -> Column:
    """Every letter that follows none upper case, as in M/Hr."""
    parts = F.split(c, r"(?<!\p{L})(?=\p{L})", -1)
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def line_unit(c: Column) -> Column:
    """m, m2 or the text itself for measured shapes."""
    u = unit(c)
    return F.when(u == "lm", F.lit("m")).when(u == "m²", F.lit("m2")).otherwise(u)


#: Ordinals of storeys.
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth")


def level(c: Column) -> Column:
    """The building level that a location names, "Unassigned" where it names none."""
    x = low(c)
    basement = F.coalesce(first(x, r"\bbasement\s*([0-9]+)"), first(x, r"\bb\s*([0-9]+)\b"), F.lit("1")).cast("int")
    storey = F.coalesce(first(x, r"\b(?:level|lvl)\s*[-:]?\s*([0-9]{1,2})\b"), first(x, r"\b([0-9]{1,2})(?:st|nd|rd|th)?\s+floor\b"))
    out = F.when(x.rlike(r"\blower\s+ground\b|\blg\b"), F.lit("Lower Ground"))
    out = out.when(x.rlike(r"\bbasement\b|\bb\s*[0-9]+\b"), F.concat(F.lit("Basement "), basement.cast("string")))
    out = out.when(x.rlike(r"\bground(?:\s+floor)?\b|\bgf\b"), F.lit("Ground")).when(x.rlike(r"\bmezz(?:anine)?\b"), F.lit("Mezzanine"))
    out = out.when(storey.isNotNull(), F.concat(F.lit("Level "), storey.cast("int").cast("string")))
    for k, word in enumerate(ORDINALS, 1):
        out = out.when(x.contains(f"{word} floor"), F.lit(f"Level {k}"))
    return out.when(x.contains("roof"), F.lit("Roof")).otherwise(F.lit("Unassigned"))


def level_rank(c: Column) -> Column:
    """Sorts levels from the lowest basement to the roof, unknown ones last. (L3)"""
    n = F.coalesce(first(c, r"(\d+)").cast("double"), F.lit(1.0))
    out = F.when(c.startswith("Basement"), n - 100.0).when(c == "Lower Ground", -10.0).when(c == "Ground", 0.0).when(c == "Mezzanine", 0.5)
    return out.when(c.rlike(r"^Level\s+\d+"), n).when(c == "Roof", 1000.0).otherwise(2000.0)


SCOPES = (r"\bunits?\s*[#:-]?\s*[a-z0-9]+", r"\b(?:apartment|apt|townhouse|villa|lot)\s*[#:-]?\s*[a-z0-9]+", r"\b(?:block|building|wing|stage)\s*[#:-]?\s*[a-z0-9]+")


def scope(c: Column) -> Column:
    """Unit, apartment, block and level of a location, separated by bars."""
    x = low(c)
    parts = [F.initcap(clean(first(x, p, 0))) for p in SCOPES]
    named = F.filter(F.array(*parts, level(c)), lambda p: p.isNotNull() & (p != ""))
    return F.array_join(F.array_distinct(named), " | ")


def scale_ratio(c: Column) -> Column:
    """n of a printed scale 1:n or 1/n from 5 to 10000."""
    n = first(F.coalesce(c, F.lit("")), r"(?i)1\s*[:/]\s*(\d{2,5})").cast("int")
    return F.when(n.between(5, 10000), n)


def revision(c: Column) -> Column:
    """struct(code, rank): letters and numbers rank by value, other codes 1, none 0."""
    x = F.coalesce(c, F.lit(""))
    code = F.upper(F.coalesce(first(x, r"(?i)rev(?:ision)?[\s\-_]*([a-z0-9]{1,3})"), first(x, r"(?i)[\s\-_]([a-z]|\d{1,3})\.[a-z0-9]+$")))
    rank = F.when(code.rlike(r"^\d+$"), code.try_cast("int")).when(code.rlike("^[A-Z]$"), F.ascii(code) - 64).otherwise(1)
    return F.struct(F.coalesce(code, F.lit("0")).alias("code"), F.when(code.isNull(), 0).otherwise(rank).cast("int").alias("rank"))


def sheet_number(c: Column) -> Column:
    """A-101 and the like; else the label's first word; else UNKNOWN."""
    found = F.replace(F.upper(first(c, r"(?i)([a-z]{1,2}[\s\-_]?\d{3,4}[a-z]?)")), F.lit(" "), F.lit(""))
    return F.coalesce(found, F.upper(first(F.trim(c), r"^(\S+)")), F.lit("UNKNOWN"))


#: Words of a sheet's title or text, in order of precedence, and what they make it.
SHEET_ROLES = (
    (("reflected ceiling", "rcp", "ceiling plan"), ("REFLECTED_CEILING_PLAN", 0.95, "ARCHITECTURAL", "CEILING")),
    (("door schedule", "window schedule", "door & window", "opening schedule"), ("DOOR_WINDOW_SCHEDULE", 0.95, "ARCHITECTURAL", "OPENINGS")),
    (("finish schedule", "finishes schedule", "paint schedule", "room finish"), ("FINISH_SCHEDULE", 0.95, "INTERIOR", "FINISHES")),
    (("cover sheet", "title sheet", "locality plan", "drawing index", "legend & notes", "abbreviations"), ("COVER_INDEX_LEGEND", 0.95, "GENERAL", "NONE")),
    (("elevation", "facade", "section"), ("ELEVATION", 0.90, "ARCHITECTURAL", "ELEVATION_SURFACE")),
    (("floor plan", "ground plan", "level 1", "level 2", "level 3", "basement plan", "layout plan"), ("FLOOR_PLAN", 0.90, "ARCHITECTURAL", "WALL_FLOOR")),
    (("plan",), ("FLOOR_PLAN", 0.70, "ARCHITECTURAL", "WALL_FLOOR")),
)


def sheet_role(title: Column, text: Column) -> Column:
    """struct(role, confidence, discipline, target)."""
    x = F.lower(F.concat_ws(" ", title, text))
    make = lambda r: F.struct(F.lit(r[0]).alias("role"), F.lit(r[1]).alias("confidence"), F.lit(r[2]).alias("discipline"), F.lit(r[3]).alias("target"))
    out = None
    for words, result in SHEET_ROLES:
        hit = x.rlike("|".join(words))
        out = F.when(hit, make(result)) if out is None else out.when(hit, make(result))
    return out.otherwise(make(("OTHER_GENERAL", 0.50, "GENERAL", "NONE")))


def dimension_m(c: Column) -> Column:
    """A dimension in metres, 0.05 to 200: with its unit, or millimetres where a bare number is 100 or more. (F16)"""

    def metres(x: Column) -> Column:
        number, unit = (F.regexp_extract(x, r"^(\d+(?:\.\d+)?)(mm|m)?$", k) for k in (1, 2))
        bare = (unit == "") & x.rlike(r"^\d{2,5}(?:\.\d{1,3})?$")
        return let(F.struct(number.try_cast("double").alias("v"), unit.alias("unit"), bare.alias("bare")), lambda s: F.when(s["unit"] == "mm", s["v"] / 1000).when(s["unit"] == "m", s["v"]).when(s["bare"] & (s["v"] >= 100), s["v"] / 1000))

    x = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", "")
    return let(let(x, metres), lambda v: F.when(v.between(0.05, 200), v))


def dimensions_m(c: Column, least: float = 0.25, most: float = 150.0) -> Column:
    """All dimensions of a text in metres, distinct and ascending."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?<![\d:.])(\d{1,5}(?:\.\d{1,3})?\s*(?:mm|m)?)(?![\d:a-z])"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, dimension_m), lambda x: x.between(least, most))))


def dimension_pair_mm(c: Column, least: int = 200, most: int = 6000) -> Column:
    """struct(width, height) in mm of "900 x 2100", "900/2100" or "0.9m x 2.1m"; null where there is none."""
    x = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("×"), F.lit("x"))
    pair = r"(\d{3,4})\s*(?:mm)?\s*(?:[wh]\b)?\s*[x/]\s*(\d{3,4})"
    metre = r"(\d{1,2}\.\d{1,3})\s*m?\s*[x/]\s*(\d{1,2}\.\d{1,3})"
    side = lambda g: F.coalesce(first(x, pair, g).cast("int"), F.bround(first(x, metre, g).cast("double") * 1000).cast("int"))
    return F.when(side(1).between(least, most) & side(2).between(least, most), F.struct(side(1).alias("width"), side(2).alias("height")))


def finish_codes(c: Column) -> Column:
    """Distinct finish codes such as PT1, PF-02 or WC03A, ascending."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit(r"\b([A-Z]{1,4}-?\d{1,3}[A-Z]?)\b"), F.lit(1))))


def opening_kind(c: Column) -> Column:
    """door or window by an opening's mark, null for other text."""
    x = F.upper(F.trim(c))
    return F.when(x.rlike(r"^[EI]?D\d{1,3}$"), F.lit("door")).when(x.rlike(r"^[EI]?W\d{1,3}$"), F.lit("window"))


def opening_mark(c: Column) -> Column:
    """The first opening mark in a text, upper case. (F32)"""
    return F.upper(first(c, r"(?i)\b((?:[EI]?[DW]|WD|DW)\d{1,4})\b"))


#: What headings say that a dimension is of.
BASIS_WORDS = (
    (r"\b(?:rough\s*opening|ro\s*(?:size|wdth|ht)|structural\s*opening|r\.?o\.?\s*(?:width|height|wdth|ht|hgt))\b", "rough_opening"),
    (r"\b(?:frame\s*(?:size|width|height|wdth|ht|hgt)|fr\s*size)\b", "frame"),
    (r"\bleaf\s*(?:size|width|height|wdth|ht|hgt)\b", "leaf"),
    (r"\bclear\s*(?:opening|size|width|height|wdth|ht|hgt)\b", "clear_opening"),
)


def heading_basis(c: Column) -> Column:
    """The basis that a heading states; null for plain width, height or size."""
    x, out = F.lower(F.trim(c)), None
    for pattern, basis in BASIS_WORDS:
        out = F.when(x.rlike(pattern), basis) if out is None else out.when(x.rlike(pattern), basis)
    return out


def single_dimension_mm(c: Column, least: int = 200, most: int = 6000) -> Column:
    """One dimension in mm: in mm, in m, or a bare number."""
    x = F.replace(F.lower(F.trim(c)), F.lit(","), F.lit(""))
    metres = F.bround(first(x, r"(\d{1,3}(?:\.\d{1,3})?)\s*m\b").try_cast("double") * 1000).cast("int")
    v = F.coalesce(first(x, r"(\d{2,5})\s*mm").cast("int"), metres, x.try_cast("double").cast("int"))
    return F.when(v.between(least, most), v)


def orientation(c: Column) -> Column:
    """The cardinal side that a text names."""
    x = F.lower(c)
    out = None
    for side in ("north", "south", "east", "west"):
        hit = x.rlike(rf"\b{side}(?:ern)?\b")
        out = F.when(hit, F.lit(side.title())) if out is None else out.when(hit, F.lit(side.title()))
    return out


def first_keyword(c: Column, rules: tuple[tuple[str, str], ...], otherwise: str | None = None) -> Column:
    """The label of the first rule (word, label) whose word the text holds."""
    x, out = F.lower(F.coalesce(c, F.lit(""))), None
    for word, label in rules:
        out = F.when(x.contains(word), F.lit(label)) if out is None else out.when(x.contains(word), F.lit(label))
    return out.otherwise(F.lit(otherwise)) if out is not None else F.lit(otherwise)


def confidence(c: Column) -> Column:
    """A confidence from 0 to 1; anything else is null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & x.between(0, 1), x)


#: Texts that stand for no id.
NO_ID = ("", "none", "nan", "null", "n/a", "na", "-")


def clean_id(c: Column) -> Column:
    x = F.trim(c.cast("string"))
    return F.when(~F.lower(x).isin(*NO_ID), x)


def json_object(c: Column) -> Column:
    """The first complete object in a text, whatever stands around it; null where no brace begins one.

    A JSON reader ends where the object does, so each brace is tried as its beginning.
    """
    tried = lambda p: F.transform(p, lambda x, k: F.when(x.startswith("{"), F.get_json_object(F.array_join(F.slice(p, k + 1, F.size(p)), ""), "$")))
    pieces = F.array(F.split(F.coalesce(c, F.lit("")), r"(?=\{)", -1))
    return F.get(F.filter(F.flatten(F.transform(pieces, tried)), lambda x: x.isNotNull()), F.lit(0))


def level_base(c: Column) -> Column:
    """Ground, Level 1 to 5 or Roof by plain words."""
    x = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(x.contains("ground"), "Ground")
    for k in range(5, 0, -1):
        out = out.when(x.contains(f"level {k}"), f"Level {k}")
    return out.when(x.contains("roof"), "Roof").otherwise("Unassigned")


def level_commercial(c: Column) -> Column:
    """As level(), and a unit's number such as 501 hints at its storey."""
    x = F.lower(F.coalesce(c, F.lit("")))
    found = [F.coalesce(F.lit(None), first(x, p).cast("int").cast("string")) for p in (r"\b(?:basement|b)\s*0*([1-9]\d*)\b", r"\blevel\s*0*([0-9]{1,2})\b", r"\b(?:unit|apt|apartment)\s*[-#:]*\s*([1-9])\d{2}\b")]
    out = F.when(x.contains("ground") | x.rlike(r"\b(?:gf|gnd)\b"), "Ground").when(found[0].isNotNull(), F.concat(F.lit("Basement "), found[0]))
    out = out.when(found[1].isNotNull(), F.concat(F.lit("Level "), found[1])).when(found[2].isNotNull(), F.concat(F.lit("Level "), found[2]))
    return out.when(x.contains("roof"), "Roof").otherwise("Unassigned")


def opening_size_mm(c: Column) -> Column:
    """struct(height, width) of "2040 x 820"; nulls where none is stated, so that nothing is deducted for it."""
    pattern = r"(?i)(\d{3,4})\s*(?:h|mm)?\s*[:x*/]\s*(\d{3,4})"
    side = lambda g: first(F.coalesce(c, F.lit("")), pattern, g).cast("double")
    return F.struct(side(1).alias("height"), side(2).alias("width"))


#: What two words beside reduced levels make of the height between them, and the words' families.
HEIGHT_PAIRS = {
    ("fcl", "ffl"): "floor_to_ceiling", ("ceiling", "ffl"): "floor_to_ceiling", ("fcl", "floor"): "floor_to_ceiling", ("ceiling", "floor"): "floor_to_ceiling",
    ("ffl", "soffit"): "generic", ("fcl", "soffit"): "floor_to_ceiling", ("ffl", "parapet"): "parapet",
}
CEILING_WORDS, FLOOR_WORDS, PARAPET_WORDS = ("fcl", "ceiling", "soffit"), ("ffl", "floor", "level", "storey", "story", "finished"), ("parapet",)


def height_type(a: Column, b: Column) -> Column:
    """What the height between two reduced levels is of."""
    x, y = F.lower(a), F.lower(b)
    lo, hi = F.least(x, y), F.greatest(x, y)
    of = lambda words: x.isin(*words) | y.isin(*words)
    out = F.when(F.lit(False), "")
    for (p, q), kind in HEIGHT_PAIRS.items():
        out = out.when((lo == p) & (hi == q), kind)
    out = out.when((x == y) & x.isin(*CEILING_WORDS), "floor_to_ceiling").when((x == y) & x.isin(*FLOOR_WORDS), "floor_to_floor")
    other = F.when(x == "ffl", y).otherwise(x)
    floor = (x == "ffl") | (y == "ffl")
    out = out.when(floor & other.isin(*CEILING_WORDS), "floor_to_ceiling").when(floor & other.isin(*PARAPET_WORDS), "parapet").when(floor, "floor_to_floor")
    return out.when(of(CEILING_WORDS) & ~of(FLOOR_WORDS), "floor_to_ceiling").when(of(FLOOR_WORDS) & ~of(CEILING_WORDS), "floor_to_floor").when(of(PARAPET_WORDS), "parapet").otherwise("generic")


#: Words that show that a code is a drawing tag, and words that show that it is a finish.
TAG_WORDS = (
    "key plan", "wall piece", "wall pieces", "wall type", "wall types", "wall tag", "wall tags", "partition type", "partition types", "partition tag", "key note", "keynote", "detail tag", "detail reference", "drawing key",
    "plan key", "legend symbol", "panel type", "panel types", "wall panel", "wall panels", "piece mark", "piece marks", "assembly type", "assembly types",
)
FINISH_WORDS = (
    "paint", "painting", "paint finish", "finish schedule", "finishes schedule", "finishing schedule", "paint schedule", "colour schedule", "color schedule", "dulux", "haymes", "taubmans", "resene", "wattyl", "intergrain", "sikkens",
    "low sheen", "semi gloss", "semi-gloss", "semigloss", "matt", "matte", "gloss", "satin", "acrylic", "enamel", "epoxy", "two pack", "2 pack", "2-pack", "primer", "undercoat", "topcoat", "sealer", "coating", "stain",
    "clear finish", "texture coat", "membrane", "elastomeric",
)


def finish_accepted(code: Column, source_line: Column, description: Column, page: Column) -> Column:
    """Whether a PT, PF or WF code is a finish, by its own line first and by its page last; other codes are."""
    holds = lambda c, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low(c).contains(w))
    local = F.concat_ws(" ", source_line, description)
    tag = lambda c: holds(c, TAG_WORDS) & ~holds(c, FINISH_WORDS)
    styled = F.coalesce(F.upper(F.trim(code)).rlike(r"^(?:PT|PF|WF)\d+$"), F.lit(False))
    return F.when(~styled, True).when(tag(source_line) | tag(local), False).when(holds(local, FINISH_WORDS), True).otherwise(holds(page, FINISH_WORDS) & ~holds(local, TAG_WORDS))


def safe_name(c: Column, fallback: str = "item") -> Column:
    """A file name's safe characters."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"[^A-Za-z0-9._-]+", "_"), F.lit("_")), F.lit("")), F.lit(fallback))


def integer(c: Column, default: int = 0) -> Column:
    """A whole number, a decimal one cut off, or the default."""
    return F.coalesce(c.try_cast("double").try_cast("long"), F.lit(default).cast("long"))


#: Spellings of what is in and out.
INCLUSION = {
    "INCLUSION": ("", "base", "included", "include", "yes", "incl", "inc"), "PROVISIONAL": ("optional", "opt", "option", "provisional", "prov"), "EXCLUSION": ("excluded", "exclude", "exc", "no"),
    "SEPARATE ITEM": ("separate", "separate item"), "CLARIFICATION": ("clarification", "clarify"),
}


def inclusion(c: Column) -> Column:
    """(F59)"""
    x, out = F.lower(F.trim(F.coalesce(c, F.lit("")))), None
    for name, words in INCLUSION.items():
        out = F.when(x.isin(*words), name) if out is None else out.when(x.isin(*words), name)
    return out.otherwise(F.trim(c))


def descriptions_agree(a: Column, b: Column, least: int = 8) -> Column:
    """Equal, or one holds the other and that is 8 characters long at least."""
    x, y = norm_key(a), norm_key(b)
    return (x == y) | ((F.length(y) >= least) & x.contains(y)) | ((F.length(x) >= least) & y.contains(x))


def expand(c: Column, words: dict[str, str]) -> Column:
    """Abbreviations as whole words written out."""
    for short, long in words.items():
        c = F.regexp_replace(c, rf"(?i)\b{short}\b", long)
    return c


#: Words of a finish and the colours they are drawn in, in order of precedence.
COLOURS = (
    ("charcoal", "#3A3A3C"), ("graphite", "#4A4A4C"), ("black", "#222222"), ("white", "#F2F0EB"), ("cream", "#E8E1CC"), ("ivory", "#F4F0E3"), ("grey", "#9A9A96"), ("gray", "#9A9A96"), ("silver", "#C6C6C2"),
    ("zinc", "#8E8E8A"), ("aluminium", "#B8B8B4"), ("timber", "#9A6A3A"), ("wood", "#9A6A3A"), ("cedar", "#A3703C"), ("brick", "#9A4B32"), ("render", "#D8CFBE"), ("beige", "#CBB79A"), ("sand", "#C9B79C"),
    ("brown", "#7A5230"), ("blue", "#4A74A4"), ("green", "#4F7A4F"), ("red", "#A04444"), ("orange", "#C07830"), ("yellow", "#C9B93C"),
)


def colour(c: Column, own: Column | None = None, of_substrate: Column | None = None) -> Column:
    """The colour of a row, else of its substrate, else of the words of its finish."""
    said = first_keyword(c, COLOURS, "#C9BFA6")
    return F.coalesce(*[x for x in (own, of_substrate) if x is not None], said)


def scope_groups(c: Column) -> Column:
    """Buildings, blocks, wings and stages named in a text."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b((?:building|block|wing|stage|tower|zone)\s+[a-z0-9]{1,3})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, F.initcap))


def metres_per_page_mm(c: Column) -> Column:
    """What a millimetre of paper is: n/1000 of a scale 1:n, M/N of "N mm = M m"."""
    x = F.lower(F.coalesce(c, F.lit("")))
    ratio = scale_ratio(c) / 1000.0
    mm, m = first(x, r"(\d+(?:\.\d+)?)\s*mm\s*=\s*\d").try_cast("double"), first(x, r"mm\s*=\s*(\d+(?:\.\d+)?)\s*m\b").try_cast("double")
    return F.coalesce(ratio, F.try_divide(m, mm))


def unit_areas(c: Column, least: float = 8.0, most: float = 1000.0) -> Column:
    """struct(label, area_m2) of every unit whose line states its area."""
    lines = F.split(F.lower(F.coalesce(c, F.lit(""))), "\n")
    read = F.transform(lines, lambda x: F.struct(first(x, r"\b((?:unit|apartment|apt|townhouse|villa|lot)\s*[a-z0-9]+)\b").alias("label"), first(x, r"(\d+(?:\.\d+)?)\s*(?:m2|m²|sqm)").try_cast("double").alias("area_m2")))
    good = F.filter(read, lambda r: r["label"].isNotNull() & r["area_m2"].between(least, most))
    return F.transform(good, lambda r: F.struct(F.initcap(r["label"]).alias("label"), r["area_m2"].alias("area_m2")))


#: Materials by the words that name them.
MATERIALS = (("plasterboard", "Plasterboard"), ("fibre cement", "Fibre cement"), ("concrete", "Precast concrete"), ("masonry", "Masonry"), ("brick", "Masonry"), ("timber", "Timber"), ("steel", "Structural steel"), ("render", "Render"))


def substrate_areas(c: Column) -> Column:
    """struct(substrate, area_m2) of every line that names one material and an area."""
    lines = F.split(F.lower(F.coalesce(c, F.lit(""))), "\n")
    named = lambda x: F.array_distinct(F.filter(F.array(*[F.when(x.contains(w), F.lit(n)) for w, n in MATERIALS]), lambda v: v.isNotNull()))
    read = F.transform(lines, lambda x: F.struct(named(x).alias("n"), first(x, r"(\d+(?:\.\d+)?)\s*(?:m2|m²|sqm)").try_cast("double").alias("a")))
    good = F.filter(read, lambda r: (F.size(r["n"]) == 1) & r["a"].between(0.2, 50000))
    return F.transform(good, lambda r: F.struct(r["n"][0].alias("substrate"), r["a"].alias("area_m2")))


def semantic_heights(c: Column, least: float = 1.8, most: float = 12.0) -> Column:
    """Heights in metres that a text calls ceiling or wall heights."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\b(?:ch|clg|ceiling height|ceiling|wall height|soffit)\s*[:=]?\s*(\d{1,4}(?:\.\d{1,3})?\s*(?:mm|m)?)\b"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, dimension_m), lambda h: h.between(least, most))))


def stamp() -> Column:
    """(F140)"""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def digest(c: Column) -> Column:
    """(F141)"""
    return F.sha2(F.coalesce(c.cast("string"), F.lit("")), 256)


def lock_keys(job: Column, fingerprint: Column) -> Column:
    """struct(a, b): two positive 31-bit keys of a job and a fingerprint."""
    b = F.when(F.coalesce(fingerprint, F.lit("")) == "", 0).otherwise(F.conv(F.substring(F.md5(fingerprint.cast("binary")), 1, 8), 16, 10).cast("long"))
    mask = F.lit(0x7FFFFFFF).cast("long")
    return F.struct(job.cast("long").bitwiseAND(mask).alias("a"), b.cast("long").bitwiseAND(mask).alias("b"))
