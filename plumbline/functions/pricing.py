"""Pricing, paint, labour, calibration: arithmetic on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

M2, LM, COUNTS = "m²", "lm", ("No.", "item")


def litres(quantity: Column, unit: Column, coats: Column, coverage: Column) -> Column:
    """Paint of square metres; 0 for other units or without a coverage."""
    return F.when((unit == M2) & (coverage > 0), F.greatest(F.lit(0.0), quantity * coats / coverage)).otherwise(0.0)


def hours(quantity: Column, unit: Column, productivity: Column) -> Column:
    """Labour of measured units; 0 without a productivity."""
    return F.when(unit.isin(M2, LM, *COUNTS) & (productivity > 0), F.greatest(F.lit(0.0), quantity / productivity)).otherwise(0.0)


def value(quantity: Column, rate: Column) -> Column:
    """(F72)"""
    return F.greatest(F.lit(0.0), quantity * rate)


def _has(c: Column, *words: str) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return hit


#: The default rates, $ a unit, in order of precedence. Each line: what the element, the substrate and the finish hold (any of the words; a dash: anything), the units it is for, the rate.
RATES = (
    ("door&entry|door&front|door&feature", "-", "-", "count", 650.0),
    ("door&double|door&pair", "-", "-", "count", 900.0),
    ("door&fire", "-", "-", "count", 500.0),
    ("-", "door", "-", "any", 220.0),
    ("door", "-", "-", "any", 220.0),
    ("architrave|skirting|dado|chair rail|trim", "-", "-", "any", 15.0),
    ("-", "timber trim", "-", "any", 15.0),
    ("handrail|balustrade|balcony rail", "-", "-", "any", 115.0),
    ("fascia", "-", "-", "any", 20.0),
    ("gutter", "-", "-", "any", 18.0),
    ("downpipe", "-", "-", "any", 32.0),
    ("window", "-", "-", "any", 280.0),
    ("stair", "-", "-", "any", 2000.0),
    ("-", "-", "interior coatings|paint", "any", 60.0),
    ("floor|balcony|deck", "-", "epoxy", "any", 95.0),
    ("floor|balcony|deck", "-", "seal|clear", "any", 42.0),
    ("floor|balcony|deck", "-", "-", "any", 60.0),
    ("ceiling|soffit", "fibre|soffit", "-", "any", 38.0),
    ("-", "fibre|soffit", "ceiling flat", "any", 38.0),
    ("ceiling|soffit", "-", "-", "any", 25.0),
    ("-", "-", "ceiling flat", "any", 25.0),
    ("-", "steel|metal", "-", "length", 38.0),
    ("-", "steel|metal", "-", "any", 95.0),
    ("-", "render|brick|block|masonry", "-", "any", 42.0),
    ("-", "previously painted", "-", "any", 32.0),
    ("-", "fibre cement", "-", "any", 42.0),
    ("-", "plasterboard", "-", "any", 28.0),
    ("-", "concrete", "-", "any", 48.0),
    ("-", "timber", "-", "length", 15.0),
    ("-", "timber", "-", "any", 55.0),
    ("-", "soffit", "-", "any", 45.0),
    ("-", "other", "-", "any", 25.0),
)
UNITS_OF = {"count": ("No.", "item", "each"), "length": ("lm", "m")}


def default_rate(substrate: Column, element: Column, finish: Column, unit: Column) -> Column:
    """The rate of the first line that fits, 0 where none does.

    A door among the substrates takes the element's own door rates too, as those lines come first.
    """
    text = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    el, sub, fin, u = text(element), text(substrate), text(finish), F.trim(F.coalesce(unit, F.lit("")))
    out = None
    for in_el, in_sub, in_fin, kind, rate in RATES:
        hit = F.lit(True)
        if in_el != "-":
            any_of = F.lit(False)
            for words in in_el.split("|"):
                *lead, last = words.split("&")
                every = el.contains(last)
                for w in lead:
                    every = every & (el.contains(w) | sub.contains(w))
                any_of = any_of | every
            hit = hit & any_of
        if in_sub != "-":
            hit = hit & _has(sub, *in_sub.split("|"))
        if in_fin != "-":
            hit = hit & _has(fin, *in_fin.split("|"))
        if kind != "any":
            hit = hit & u.isin(*UNITS_OF[kind])
        out = F.when(hit, rate) if out is None else out.when(hit, rate)
    return out.otherwise(0.0)


def height_surcharge(height_m: Column) -> Column:
    """1.00 below 3 m, 1.15 below 4.5 m, 1.30 from there on."""
    return F.when(height_m < 3.0, 1.00).when(height_m < 4.5, 1.15).otherwise(1.30)


def minimum_area(quantity: Column, unit: Column, small: Column) -> Column:
    """Small items count half a square metre at least."""
    return F.when((unit == M2) & small, F.greatest(quantity, F.lit(0.5))).otherwise(quantity)


def pitched_area(flat: Column, degrees: Column) -> Column:
    """Area of a roof surface from its plan area; as it is from 85 degrees on and without a pitch."""
    return F.when(flat <= 0, 0.0).when((degrees > 0) & (degrees < 85), flat / F.cos(F.radians(degrees))).otherwise(flat)


def px_per_m(ratio: Column, zoom: Column) -> Column:
    """Pixels a metre of a page rendered at zoom and printed at 1:ratio."""
    return F.when(ratio > 0, zoom * 1000 / (F.lit(0.352778) * ratio))


def m_per_pt(px_m: Column, zoom: Column) -> Column:
    """Metres a PDF point."""
    return F.when(px_m > 0, zoom / px_m)


def rescaled(length: Column, old: Column, new: Column, power: int = 1) -> Column:
    """Lengths and, with power 2, areas after a change of scale."""
    return F.when((old > 0) & (new > 0), length * F.pow(old / new, F.lit(power))).otherwise(length)


def deduction(area: Column, kind: Column, least: float = 0.5) -> Column:
    """What an opening takes off a wall: its area from half a square metre on."""
    return F.when(area >= least, area).otherwise(0.0)


def variance_pct(measured: Column, predicted: Column) -> Column:
    """Signed, of the measured value; 0 where nothing was measured."""
    return F.when(F.abs(measured) < 1e-9, 0.0).otherwise((predicted - measured) / measured * 100)


def board_sheets(gross: Column, openings: Column, sides: Column, layers: Column, waste_pct: Column, width_mm: Column, length_mm: Column) -> Column:
    """struct(net, installed, sheets) of board linings; sheets are whole."""
    net = F.greatest(F.lit(0.0), gross - openings)
    installed = net * F.greatest(F.lit(1), sides) * F.greatest(F.lit(1), layers)
    sheet = width_mm / 1000 * (length_mm / 1000)
    sheets = F.when((installed > 0) & (sheet > 0), F.ceil(installed * (1 + waste_pct / 100) / sheet)).otherwise(0)
    return F.struct(net.alias("net_m2"), installed.alias("installed_m2"), sheets.cast("long").alias("sheets"))


def trade_quantity(mode: Column, length: Column, width: Column, height: Column, depth: Column, plan_area: Column, count: Column, runs: Column, deductions: Column, waste_pct: Column, pitch: Column) -> Column:
    """The quantity of a trade measurement by its mode."""
    waste = 1 + F.greatest(F.lit(0.0), waste_pct) / 100
    area = F.when(plan_area > 0, plan_area).otherwise(length * width)
    net = lambda gross: F.greatest(F.lit(0.0), gross - deductions) * waste
    slope = F.when(pitch > 0, 1 / F.cos(F.radians(F.least(pitch, F.lit(89.0))))).otherwise(1.0)
    many = F.greatest(F.lit(1), runs)
    out = F.when(mode == "Count / points", count.cast("double")).when(mode.isin("Linear route / length", "Linear item"), length * many * waste)
    out = out.when(mode == "Plan area", net(area)).when(mode == "Wall / vertical area", net(length * height)).when(mode == "Volume", net(length * width * depth))
    out = out.when(mode == "Duct surface area", net(2 * (width + height) * length * many)).when(mode == "Roof slope area", net(area * slope))
    return F.bround(out.otherwise(F.when(count > 0, count.cast("double")).otherwise(1.0)), 3)
