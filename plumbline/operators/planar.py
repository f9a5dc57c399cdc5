"""Faces of linework, square by square. (F111, U12)

A page is laid out in squares, smaller ones where it has more segments, and a square gets the segments that pass it. In
it numpy cuts them where they cross, knows of each side of a line the one that follows, and follows faces. Those within
one square are done; of others the pieces are put together by doubling. What a segment has next beyond a square is told
by the other squares' first and last points on it. So no table has a row for each crossing, and no page or face has to
fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import numbered, shuffled
from . import graph
from .raster import _ends

ENDS = ("x1", "y1", "x2", "y2")
SQUARE = ["page_id", "e", "ix", "iy"]
WHOLE = 9999  # in place of a side's exponent: a page of few segments, as a whole
MOST, USUAL = 1000, 150  # segments of a square before it is quartered, and how many squares begin with
LEAST_E, QUARTERED = -6, 8  # exponent of the least side, rounds of quartering
KNOWN, PASSED = 1e-4, 2e-4  # how far beyond its sides a square knows points, and segments
TOGETHER = 1 << 20  # pairs of segments that are looked at together
EACH = 10_000  # segments of squares for each task


def squares(segments: DataFrame, most: int = MOST, usual: int = USUAL) -> DataFrame:
    """page_id, e, ix, iy, seg_id, x1, y1, x2, y2: segments in each square of a side of 2^e that they pass. Of equal ones the least id stands."""
    finite = F.lit(True)
    for c in ENDS:
        finite &= F.abs(F.col(c)) < float("inf")
    kept = segments.filter(finite & F.expr("(x1 <> x2 or y1 <> y2) and page_id is not null and seg_id is not null"))
    kept = graph.cut(kept.groupBy("page_id", *[F.col(c).cast("double").alias(c) for c in ENDS]).agg(F.min("seg_id").alias("seg_id")))
    low, high = (lambda a: F.least(f"{a}1", f"{a}2")), (lambda a: F.greatest(f"{a}1", f"{a}2"))
    span = lambda a: F.max(high(a)) - F.min(low(a))
    sizes = kept.groupBy("page_id").agg(F.count("*").alias("n"), span("x").alias("w"), span("y").alias("h"), F.sum(F.abs(F.col("x2") - F.col("x1")) + F.abs(F.col("y2") - F.col("y1"))).alias("long"))
    side = F.greatest(usual * F.col("w") * F.col("h") / F.col("long"), F.greatest("w", "h") / 4096, F.lit(2.0**LEAST_E))
    sized = kept.join(shuffled(sizes.select("page_id", F.when(F.col("n") <= most, WHOLE).otherwise(F.ceil(F.log2(side))).cast("int").alias("e"))), "page_id")

    def laid(rows: DataFrame) -> DataFrame:
        s = F.pow(F.lit(2.0), "e")
        rows = rows.withColumn("ix", F.explode(F.sequence(F.floor((low("x") - PASSED) / s), F.floor((high("x") + PASSED) / s))))
        at = lambda x: F.when(F.col("x1") == F.col("x2"), F.lit(None)).otherwise(F.col("y1") + (x - F.col("x1")) * (F.col("y2") - F.col("y1")) / F.nullif(F.col("x2") - F.col("x1"), F.lit(0.0)))
        a, b = at(F.greatest(F.col("ix") * s - PASSED, low("x"))), at(F.least((F.col("ix") + 1) * s + PASSED, high("x")))
        bottom, top = F.coalesce(F.greatest(low("y"), F.least(a, b)), low("y")), F.coalesce(F.least(high("y"), F.greatest(a, b)), high("y"))
        return rows.withColumn("iy", F.explode(F.sequence(F.floor((bottom - PASSED) / s), F.floor((top + PASSED) / s))))

    columns = [*SQUARE, "seg_id", *ENDS]
    no = F.lit(0).cast("long")
    out = graph.cut(laid(sized.filter(F.col("e") != WHOLE)).select(columns).unionByName(sized.filter(F.col("e") == WHOLE).withColumns({"ix": no, "iy": no}).select(columns)))
    for _ in range(QUARTERED):
        over = graph.cut(out.filter((F.col("e") != WHOLE) & (F.col("e") > LEAST_E)).groupBy(SQUARE).count().filter(F.col("count") > most).drop("count"))
        if over.isEmpty():
            break
        old = out.join(shuffled(over), SQUARE).select("page_id", (F.col("e") - 1).alias("e"), F.col("ix").alias("ox"), F.col("iy").alias("oy"), "seg_id", *ENDS)
        quarters = laid(old).filter((F.shiftright("ix", 1) == F.col("ox")) & (F.shiftright("iy", 1) == F.col("oy")))
        out = graph.cut(out.join(shuffled(over), SQUARE, "left_anti").select(columns).unionByName(quarters.select(columns)))
    return out


def _rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds: halves away from zero, of the shortest decimal that names a value. Never -0.0."""
    scale = 10.0**digits
    a = np.abs(v) * scale
    whole = np.floor(a)
    up = a - whole
    k = whole + (up >= 0.5)
    for i in np.flatnonzero((np.abs(up - 0.5) < 1e-3) | (a >= 1e12)):
        k[i] = float(Decimal(repr(float(abs(v[i])))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP).scaleb(digits))
    return np.copysign(k / scale, v) + 0.0


def _whole(v: np.ndarray, digits: int) -> np.ndarray:
    """Rounded values as whole numbers from 0."""
    k = np.rint(v * 10.0**digits)
    return (k - k.min(initial=0)).astype(np.int64) if np.abs(k).max(initial=0) < 1 << 50 else np.unique(v, return_inverse=True)[1]


def _ordered(major: np.ndarray, key: np.ndarray, *minor: np.ndarray) -> np.ndarray:
    """The order by major, key (both whole and not negative) and minors: as lexsort, but one sort of whole numbers, and of those that are equal in both and not in a minor by themselves."""
    bits = int(key.max(initial=0)).bit_length()
    if bits + int(major.max(initial=0)).bit_length() > 62:
        return np.lexsort((*minor[::-1], key, major))
    key = (major << bits) | key
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    differ = np.zeros(len(same), bool)
    for m in minor:
        m = m[order]
        differ |= m[1:] != m[:-1]
    differ &= same
    if differ.any():
        run = np.cumsum(np.append(True, ~same)[: len(key)]) - 1
        mixed = np.zeros(len(key), bool)
        mixed[run[1:][differ]] = True
        at = np.flatnonzero(mixed[run])
        own = order[at]
        order[at] = own[np.lexsort((*[m[own] for m in minor[::-1]], key[at]))]
    return order


class _Rows:
    """Segments of whole squares, in order of square and id; at: the square of each, from 0."""

    def __init__(self, b: pd.DataFrame, at: np.ndarray):
        self.at, self.first = at, np.flatnonzero(np.diff(at, prepend=-1))
        self.x1, self.y1, self.x2, self.y2 = (b[c].to_numpy(np.float64) for c in ENDS)
        e = b["e"].to_numpy(np.int64)
        self.whole, self.side = e == WHOLE, np.ldexp(1.0, np.where(e == WHOLE, 0, e).astype(np.int32))
        self.ix, self.iy = b["ix"].to_numpy(np.int64), b["iy"].to_numpy(np.int64)

    def own(self, row: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = self.side[row]
        return self.whole[row] | ((np.floor(x / s) == self.ix[row]) & (np.floor(y / s) == self.iy[row]))

    def known(self, row: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        s = self.side[row]
        left, top = self.ix[row] * s - KNOWN, self.iy[row] * s - KNOWN
        return self.whole[row] | ((x >= left) & (x <= left + s + 2 * KNOWN) & (y >= top) & (y <= top + s + 2 * KNOWN))

    def crossed(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of pairs of segments, the first with the lower id, those that meet in their square, and where."""
        ax, ay, bx, by = self.x2[i] - self.x1[i], self.y2[i] - self.y1[i], self.x2[j] - self.x1[j], self.y2[j] - self.y1[j]
        dx, dy = self.x1[j] - self.x1[i], self.y1[j] - self.y1[i]
        cross = ax * by - ay * bx
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (dx * by - dy * bx) / cross, (dx * ay - dy * ax) / cross
            met = np.flatnonzero((np.abs(cross) > 1e-9) & (t >= -1e-9) & (t <= 1 + 1e-9) & (u >= -1e-9) & (u <= 1 + 1e-9))
        i, j, t = i[met], j[met], t[met]
        x, y = self.x1[i] + t * ax[met], self.y1[i] + t * ay[met]
        near = np.flatnonzero(self.known(i, x, y))
        i, j = i[near], j[near]
        return i, j, _rounded(x[near], 8), _rounded(y[near], 8)

    def _placed(self, row: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Points of segments, and how far along they are."""
        dx, dy = self.x2[row] - self.x1[row], self.y2[row] - self.y1[row]
        t = _rounded(((x - self.x1[row]) * dx + (y - self.y1[row]) * dy) / np.hypot(dx, dy), 7)
        return row, t, _rounded(x, 8), _rounded(y, 8)

    def _once(self, row: np.ndarray, t: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
        """Points in their order along each segment; of those at one place the least stands."""
        order = _ordered(row, _whole(t, 7), x, y)
        row, t, x, y = row[order], t[order], x[order], y[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (t[1:] != t[:-1])
        return row[new], t[new], x[new], y[new]

    def points(self) -> tuple[np.ndarray, ...]:
        """row, t, x, y: each segment's ends and crossings in its square and a little beyond, in their order along it."""
        every = np.arange(len(self.at))
        end = np.append(self.first[1:], len(every))[self.at]
        others = end - every - 1
        row, x, y = np.concatenate([every, every]), np.concatenate([self.x1, self.x2]), np.concatenate([self.y1, self.y2])
        near = self.known(row, x, y)
        found = [self._placed(row[near], x[near], y[near])]
        for rows in np.split(every, np.flatnonzero(np.diff(np.cumsum(others) // TOGETHER)) + 1):
            n = others[rows]
            i = np.repeat(rows, n)
            i, j, x, y = self.crossed(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n))
            found.append(self._placed(np.concatenate([i, j]), np.concatenate([x, x]), np.concatenate([y, y])))
            if sum(len(p[0]) for p in found[1:]) > 4 * TOGETHER:  # many may be at one place
                found = [self._once(*map(np.concatenate, zip(*found, strict=True)))]
        return self._once(*map(np.concatenate, zip(*found, strict=True)))


def _by_squares(batches: Iterator[pd.DataFrame], each) -> Iterator[pd.DataFrame]:
    """each(rows, square of each row) for whole squares of sorted rows, so many together as have a bounded number of pairs."""

    def cut(b: pd.DataFrame, at: np.ndarray) -> Iterator[pd.DataFrame]:
        if len(b):
            n = np.bincount(at).astype(np.int64)
            part = (np.cumsum(n * n // 2 + n) // TOGETHER)[at]
            for k in np.split(np.arange(len(b)), np.flatnonzero(np.diff(part)) + 1):
                got = each(b.iloc[k], at[k] - at[k[0]])
                if got is not None and len(got):
                    yield got

    held: list[pd.DataFrame] = []  # the last square may go on, over several batches
    for b in batches:
        if b.empty:
            continue
        new = np.append(True, (b[SQUARE].to_numpy()[1:] != b[SQUARE].to_numpy()[:-1]).any(axis=1))
        if held and (held[-1][SQUARE].iloc[-1].to_numpy() == b[SQUARE].iloc[0].to_numpy()).all():
            new[0] = False
        starts = np.flatnonzero(new)
        if not len(starts):
            held.append(b)
            continue
        done = pd.concat([*held, b.iloc[: starts[-1]]], ignore_index=True)
        if len(done):
            values = done[SQUARE].to_numpy()
            yield from cut(done, np.cumsum(np.append(False, (values[1:] != values[:-1]).any(axis=1))))
        held = [b.iloc[starts[-1] :]]
    if held:
        b = pd.concat(held, ignore_index=True)
        yield from cut(b, np.zeros(len(b), np.int64))


def _runs(b: pd.DataFrame, at: np.ndarray) -> pd.DataFrame:
    """Where each segment comes into its square's points and where it leaves them."""
    rows = _Rows(b, at)
    row, t, x, y = rows.points()
    own = rows.own(row, x, y)
    same = np.append(False, (row[1:] == row[:-1]) & own[:-1] & own[1:])
    first, last = np.flatnonzero(own & ~same), np.flatnonzero(own & ~np.append(same[1:], False))
    return pd.DataFrame({c: b[c].to_numpy()[row[first]] for c in (*SQUARE, "seg_id")} | {"t": t[first], "fx": x[first], "fy": y[first], "lx": x[last], "ly": y[last]})


def _followed(after: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sides piece by piece, each from its first to its last one; where pieces begin; which are whole rings, which begin at their least side. after: the next side, -1 where it is another square's."""
    every = np.arange(len(after))
    ends = after < 0
    jump, low, reached = np.where(ends, every, after), every, -1
    while True:
        lower, further = np.minimum(low, low[jump]), jump[jump]
        n = np.count_nonzero(ends[further])
        still = n == reached and (lower == low).all()
        low, jump, reached = lower, further, n
        if still:
            break
    ring = ~ends[jump]
    end, off = _ends(np.where(ring & (low[after] == after), -1, after))
    order = np.argsort(end * (off.max(initial=0) + 1) + (off.max(initial=0) - off))
    starts = np.flatnonzero(np.diff(end[order], prepend=-1))
    return order, starts, ring[order[starts]]


def _pieces(b: pd.DataFrame, at: np.ndarray, least_area: float) -> pd.DataFrame | None:
    """Faces of a square, and pieces of those that go on in others."""
    told = b["kind"].to_numpy() == 1
    of = np.flatnonzero(~told)
    rows = _Rows(b, at)  # of edges that are told, too, for their squares
    segments = _Rows(b.iloc[of], np.unique(at[of], return_inverse=True)[1])
    row, _, x, y = segments.points()
    own = segments.own(row, x, y)
    there = np.flatnonzero(own)
    row, x, y = of[row[there]], x[there], y[there]
    beside = np.flatnonzero((row[1:] == row[:-1]) & (np.diff(there) == 1))
    edge = np.flatnonzero(told)
    row = np.concatenate([row, edge, edge])
    x, y = np.concatenate([x, rows.x1[edge], rows.x2[edge]]), np.concatenate([y, rows.y1[edge], rows.y2[edge]])
    order = _ordered(at[row], _whole(x, 8), y)
    ox, oy, og = x[order], y[order], at[row][order]
    new = np.ones(len(order), bool)
    new[1:] = (ox[1:] != ox[:-1]) | (oy[1:] != oy[:-1]) | (og[1:] != og[:-1])
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(new) - 1
    nx, ny, n_row = ox[new], oy[new], row[order][new]
    here, count, points = rows.own(n_row, nx, ny), len(nx), len(x) - 2 * len(edge)
    a, z = node[beside], node[beside + 1]
    v = np.concatenate([a, z, node[points : points + len(edge)]])
    w = np.concatenate([z, a, node[points + len(edge) :]])
    key = np.sort((v * count + w)[(v != w) & here[v]]) if count else np.zeros(0, np.int64)
    if not len(key):
        return None
    key = key[np.append(True, key[1:] != key[:-1])]
    v, w = key // count, key % count
    # Around each node: coming along w to v, the next side is the one before v to w against the clock.
    angle = np.arctan2(ny[w] - ny[v], nx[w] - nx[v])
    around = _ordered(v, ((angle + np.pi) * (1 << 28)).astype(np.int64), angle, w)
    begins = np.flatnonzero(np.diff(v, prepend=-1))
    before = np.append(-1, around[:-1])
    before[begins] = around[np.append(begins[1:], len(v)) - 1]
    turn = np.empty(len(v), np.int64)
    turn[around] = before
    # Sides w to v in their own order, each with the one that follows. Of those within the square the other way is known, too, so both are the same in order.
    other = w * count + v
    by = np.argsort(other)
    inside = here[w]
    within = by[inside[by]]
    back = np.zeros(len(key), np.int64)
    back[within] = np.flatnonzero(inside)
    if (key[back] != other)[inside].any():
        raise ValueError("a side that ends in a square isn't known there")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    out = turn[by]
    after = np.where(inside[out], rank[back[out]], -1)
    side, starts, ring = _followed(after)
    n = np.diff(np.append(starts, len(side)))
    ax, ay, bx, by_ = nx[w[by]], ny[w[by]], nx[v[by]], ny[v[by]]
    area = np.add.reduceat((ax * by_ - bx * ay)[side], starts) / 2
    kept = np.flatnonzero(~ring | ((n >= 3) & (area >= least_area)))
    if not len(kept):
        return None
    least = np.minimum.reduceat(side, starts)[kept]
    place = np.empty(len(side), np.int64)
    place[side] = np.arange(len(side))
    first, last, open_ = side[starts[kept]], side[starts[kept] + n[kept] - 1], ~ring[kept]
    to = out[last]
    goes = lambda c: np.where(open_, c, np.nan)
    inner = np.repeat(starts[kept] - np.append(0, np.cumsum(n[kept])[:-1]), n[kept]) + np.arange(n[kept].sum())
    parts = np.cumsum(n[kept])[:-1]
    return pd.DataFrame(
        {
            "page_id": b["page_id"].to_numpy()[n_row[v[by[first]]]], "open": open_, "n": n[kept], "turn": area[kept], "at": place[least] - starts[kept],
            "hx": goes(ax[first]), "hy": goes(ay[first]), "htx": goes(bx[first]), "hty": goes(by_[first]), "nx": goes(nx[v[to]]), "ny": goes(ny[v[to]]), "ntx": goes(nx[w[to]]), "nty": goes(ny[w[to]]),
            "lx": ax[least], "ly": ay[least], "ltx": bx[least], "lty": by_[least], "xs": np.split(ax[side[inner]], parts), "ys": np.split(ay[side[inner]], parts)})


def faces(segments: DataFrame, least_area: float, most: int = MOST, usual: int = USUAL) -> DataFrame:
    """page_id, lx, ly, ltx, lty (a face's least side), points from there, of each face of at least that area."""
    laid = squares(segments, most, usual)
    kind = {c: laid.schema[c].dataType.simpleString() for c in ("page_id", "seg_id")}
    tasks = min(10_000, max(4 * laid.sparkSession.sparkContext.defaultParallelism, laid.count() // EACH))
    dealt = lambda rows, *order: rows.repartition(tasks, *SQUARE).sortWithinPartitions(*SQUARE, *order)
    square = f"page_id {kind['page_id']}, e int, ix long, iy long"
    runs = dealt(laid.filter(F.col("e") != WHOLE), "seg_id").mapInPandas(lambda b: _by_squares(b, _runs), f"{square}, seg_id {kind['seg_id']}, t double, fx double, fy double, lx double, ly double")
    along = W.partitionBy("page_id", "seg_id").orderBy("t")
    step = lambda x, y, there: F.struct(F.col(x).alias("x1"), F.col(y).alias("y1"), F.col(f"{there}.x").alias("x2"), F.col(f"{there}.y").alias("y2"))
    ended = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    told = runs.withColumns({"before": F.lag(ended("lx", "ly")).over(along), "then": F.lead(ended("fx", "fy")).over(along)})
    told = told.select(*SQUARE, F.inline(F.array(step("fx", "fy", "before"), step("lx", "ly", "then")))).filter("x2 is not null")
    both = laid.withColumn("kind", F.lit(0)).unionByName(told.withColumns({"kind": F.lit(1), "seg_id": F.lit(None).cast(kind["seg_id"])}))
    sides = ", ".join(f"{c} double" for c in ("turn", "hx", "hy", "htx", "hty", "nx", "ny", "ntx", "nty", "lx", "ly", "ltx", "lty"))
    found = dealt(both, "kind", "seg_id").mapInPandas(lambda b: _by_squares(b, lambda rows, at: _pieces(rows, at, least_area)), f"page_id {kind['page_id']}, open boolean, n long, at long, {sides}, xs array<double>, ys array<double>")
    found = graph.cut(found)
    least = ["lx", "ly", "ltx", "lty"]
    whole = found.filter("not open").select("page_id", *least, "xs", "ys")
    parts = found.filter("open")
    if not parts.isEmpty():
        whole = whole.unionByName(_joined(parts, least_area).select(whole.columns))
    return whole.select("page_id", *least, F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("points"))


def _joined(parts: DataFrame, least_area: float) -> DataFrame:
    """Faces of their pieces: those of a ring one after the other, from the least side on."""
    head, to = ["hx", "hy", "htx", "hty"], ["nx", "ny", "ntx", "nty"]
    parts = graph.cut(numbered(parts, [F.col(c) for c in ("page_id", *head)], "id"))
    heads = parts.select("page_id", *[F.col(h).alias(t) for h, t in zip(head, to, strict=True)], F.col("id").alias("next"))
    placed = parts.join(shuffled(graph.rings(parts.select("page_id", *to, "id").join(shuffled(heads), ["page_id", *to]).select("id", "next"))), "id")
    sums = placed.groupBy("page_id", "ring").agg(F.sum("n").alias("n"), F.sum("turn").alias("turn"), F.min(F.struct("lx", "ly", "ltx", "lty", "place", "at")).alias("low"))
    kept = sums.filter((F.col("n") >= 3) & (F.col("turn") >= least_area)).select("page_id", "ring", "low")
    put = placed.select("page_id", "ring", "place", "xs", "ys").join(shuffled(kept), ["page_id", "ring"]).groupBy("page_id", "ring").agg(F.first("low").alias("low"), F.array_sort(F.collect_list(F.struct("place", "xs", "ys"))).alias("s"))

    def turned(c: Column | str, k: Column) -> Column:
        return F.concat(F.slice(c, k + 1, F.size(c)), F.slice(c, F.lit(1), k))

    put = put.withColumn("s", turned("s", F.col("low.place").cast("int")))
    flat = put.select("page_id", "low.*", *[F.flatten(f"s.{c}").alias(c) for c in ("xs", "ys")])
    return flat.withColumns({c: turned(c, F.col("at").cast("int")) for c in ("xs", "ys")})
