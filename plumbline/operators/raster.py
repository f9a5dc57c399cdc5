"""Raster pages: what is drawn on them as connected components, outlines, rectangles and envelopes. (S36, F126-F128)

A page comes as pixels (Spark's own `image` source) and is cut into tiles. In a tile numpy finds the runs of dark pixels
in each row and labels those that touch; labels that touch over a seam of tiles are edges of a graph whose components
are the page's. Outlines are the cracks between pixels inside and outside: each crack has one successor. They are
followed in squares of the page; rings that lie in one are done, and the pieces of others are put together by doubling.
So a page, a component or an outline may be larger than a task. Drawings and envelopes of pages of up to LOCAL pixels
are found a page at a time, by the same steps: there a tile's rows would be more than its pixels' worth.

A page is named by page_id and goes with it everywhere; where a page is looked at in several ways (thresholds), each way
is a page of its own. Coordinates are pixels, y downwards; boxes are half open.

Defined results: an image without pixels, or null, has no tiles and so nothing in it; what touches only at corners is
one component where diagonal is set; equal scores go to the component that comes first from the top left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import numbered, shuffled
from . import graph

TILE = 512
SENT = 16 << 20  # pixels of tiles that are handed over together
SQUARE = 256  # pixels of a side of the squares in which outlines are followed
TOGETHER = 1 << 18  # pixels of squares that are followed together
LOCAL = 1 << 20  # pixels of a page that is looked at as a whole, in one task, and not in tiles
#: Fixed values of the drawing component: what is ink, the page's part that is looked at, a component's least and most shares.
INK, SIDES, BOTTOM_PLAN, BOTTOM_ELEVATION = 205, (0.03, 0.97), 0.86, 0.82
LEAST_WIDE, LEAST_HIGH, COVER, DENSE = 0.12, 0.10, (0.015, 0.78), (0.006, 0.45)
#: Fixed values of rectangle candidates: what is dark, the least side in pixels, the share of its box that a contour fills, its confidence.
DARK, LEAST_SIDE, FILLS, CONFIDENCE = 160, 8, 0.35, 0.7
#: Fixed values of envelopes: percentiles of grey that are thresholds, their bounds, kernels that close gaps, shares of dark pixels that say nothing, what may be smoothed away of an outline, by the page's longer side.
PERCENTILES, BAND, LADDER, DARK_SHARE, SMOOTH = (55, 70, 82, 90), (6, 245), (9, 21, 45, 81, 121, 181), (0.002, 0.75), 0.006


def pictures(images: DataFrame) -> DataFrame:
    """page_id, height, width, channels, data of the rows of Spark's image source (page_id, image)."""
    i = "image."
    return images.select("page_id", *[F.col(i + a).alias(b) for a, b in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])


def _gray(r) -> np.ndarray:
    """A page's greys: the usual weights of blue, green and red, in whole numbers."""
    p = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)
    return p[:, :, 0] if r.channels < 3 else ((p[:, :, :3].astype(np.int32) @ np.array([1868, 9617, 4899], np.int32) + 8192) >> 14).astype(np.uint8)


def tiles(pages: DataFrame, tile: int = TILE, margin: int = 0) -> DataFrame:
    """page_id, width, height, x0, y0 (of the tile), x, y, w, h (of its pixels with a margin, as far as the page goes), gray."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "width", "height", "x0", "y0", "x", "y", "w", "h", "gray"]
        held: list[tuple] = []
        for b in batches:
            for r in b.itertuples(index=False):
                if not r.data or not r.width or not r.height:
                    continue
                gray = _gray(r)
                for y0 in range(0, r.height, tile):
                    for x0 in range(0, r.width, tile):
                        x, y = max(0, x0 - margin), max(0, y0 - margin)
                        cut = gray[y : y0 + tile + margin, x : x0 + tile + margin]
                        held.append((r.page_id, r.width, r.height, x0, y0, x, y, cut.shape[1], cut.shape[0], cut.tobytes()))
                        if len(held) * held[0][7] * held[0][8] >= SENT:
                            yield pd.DataFrame(held, columns=names)
                            held = []
        if held:
            yield pd.DataFrame(held, columns=names)

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "width", "height", "channels", "data").mapInPandas(run, f"page_id {kind}, width int, height int, x0 int, y0 int, x int, y int, w int, h int, gray binary")


def _widened(mask: np.ndarray, k: int) -> np.ndarray:
    """Every pixel that has one of the mask within a square of k pixels around it."""
    back, ahead = (k - 1) // 2, k // 2
    for axis in (0, 1):
        n = mask.shape[axis]
        at = lambda m, i, j: m[i:j] if axis == 0 else m[:, i:j]  # noqa: B023, E731
        wide = np.zeros([v + (back + ahead) * (a == axis) for a, v in enumerate(mask.shape)], bool)
        at(wide, back, back + n)[:] = mask
        mask = wide
        reach = 1  # pixels that a place stands for
        while 2 * reach <= k:
            mask = at(mask, 0, mask.shape[axis] - reach) | at(mask, reach, mask.shape[axis])
            reach *= 2
        mask = at(mask, 0, n) | at(mask, k - reach, k - reach + n)
    return mask


def _tile_runs(mask: np.ndarray, diagonal: bool) -> tuple[np.ndarray, ...]:
    """Row, begin, end and label of the runs of a mask; runs that touch have one label."""
    # All rows as one, with a pixel that isn't in the mask before each: where that changes, a run begins or ends.
    rows = np.zeros((mask.shape[0], mask.shape[1] + 1), bool)
    rows[:, 1:] = mask
    rows = np.append(rows.ravel(), False)
    turns = np.flatnonzero(rows[1:] != rows[:-1])
    y, x0 = np.divmod(turns[::2], mask.shape[1] + 1)
    x1 = turns[1::2] - y * (mask.shape[1] + 1)
    label = list(range(len(y)))
    # Runs of the next row that a run touches are side by side in the order of rows.
    d, wide = int(diagonal), mask.shape[1] + 3
    below = (y + 1) * wide
    low, high = np.searchsorted(y * wide + x1, below + x0 - d, side="right"), np.searchsorted(y * wide + x0, below + x1 + d)
    n = np.maximum(high - low, 0)
    upper = np.repeat(np.arange(len(y)), n)
    lower = low[upper] + np.arange(len(upper)) - np.repeat(np.cumsum(n) - n, n)
    for a, b in zip(upper.tolist(), lower.tolist(), strict=True):
        while label[a] != a:
            label[a] = a = label[label[a]]
        while label[b] != b:
            label[b] = b = label[label[b]]
        if a < b:
            label[b] = a
        else:
            label[a] = b
    for k, up in enumerate(label):  # labels are never greater, and those before are final
        label[k] = label[up]
    return y, x0, x1, np.array(label, np.int64)


def runs(tiled: DataFrame, below: Column, tile: int = TILE, close: int = 1, widen: int = 1, inside: bool = True, diagonal: bool = True, region: tuple[Column, Column, Column, Column] | None = None) -> DataFrame:
    """Runs of pixels darker than a value, or of the others if not inside: page_id, y, x0, x1, label (page_id, ty, tx, n).

    Gaps are closed and lines widened by squares of that many pixels first; the tiles' margin must be as wide as both
    together. Only pixels of the region (x0, y0, x1, y1) count.
    """
    kind = tiled.schema["page_id"].dataType.simpleString()
    box = region or (F.lit(0), F.lit(0), F.col("width"), F.col("height"))
    rows = tiled.select("page_id", "x0", "y0", "x", "y", "w", "h", "gray", below.cast("double").alias("below"), *[c.cast("int").alias(n) for n, c in zip(("rx0", "ry0", "rx1", "ry1"), box, strict=True)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages: list = []
            parts: list[np.ndarray] = []
            for r in b.itertuples(index=False):
                left, top, right, bottom = max(r.x, r.rx0), max(r.y, r.ry0), min(r.x + r.w, r.rx1), min(r.y + r.h, r.ry1)
                if left >= right or top >= bottom:
                    continue
                mask = np.frombuffer(r.gray, np.uint8).reshape(r.h, r.w)[top - r.y : bottom - r.y, left - r.x : right - r.x] < r.below
                if close > 1:
                    mask = ~_widened(~_widened(mask, close), close)
                if widen > 1:
                    mask = _widened(mask, widen)
                x0, y0 = max(r.x0, left), max(r.y0, top)
                own = mask[y0 - top : r.y0 + tile - top, x0 - left : r.x0 + tile - left]
                y, a, z, n = _tile_runs(own if inside else ~own, diagonal)
                if len(y):
                    pages.extend([r.page_id] * len(y))
                    parts.append(np.stack([y + y0, a + x0, z + x0, np.full(len(y), r.y0 // tile), np.full(len(y), r.x0 // tile), n]))
            if parts:
                yield pd.DataFrame({"page_id": pages, **dict(zip(("y", "x0", "x1", "ty", "tx", "n"), np.concatenate(parts, axis=1), strict=True))})

    found = rows.mapInPandas(run, f"page_id {kind}, y int, x0 int, x1 int, ty int, tx int, n long")
    return graph.cut(found.select("page_id", "y", "x0", "x1", F.struct("page_id", "ty", "tx", "n").alias("label")))


def labelled(found: DataFrame, tile: int = TILE, diagonal: bool = True) -> DataFrame:
    """runs() with component, the least label that its own touches over the seams of tiles. (F128)"""
    d = int(diagonal)
    last, first = F.col("y") % tile == tile - 1, F.col("y") % tile == 0
    over = found.filter(last).select("page_id", (F.col("y") + 1).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("label").alias("a"), F.explode(F.sequence(F.floor((F.col("x0") - d) / tile), F.floor((F.col("x1") + d - 1) / tile))).alias("column"))
    under = found.filter(first).select("page_id", "y", "x0", "x1", F.col("label").alias("b"), F.floor(F.col("x0") / tile).alias("column"))
    down = over.join(shuffled(under), ["page_id", "y", "column"]).filter((F.col("a0") < F.col("x1") + d) & (F.col("x0") < F.col("a1") + d)).select("a", "b")
    right = found.filter(F.col("x1") % tile == 0).select("page_id", F.col("x1").alias("x0"), F.explode(F.sequence(F.col("y") - d, F.col("y") + d)).alias("y"), F.col("label").alias("a"))
    beside = found.filter(F.col("x0") % tile == 0).select("page_id", "x0", "y", F.col("label").alias("b"))
    edges = down.unionAll(right.join(shuffled(beside), ["page_id", "x0", "y"]).select("a", "b")).distinct()
    whole = graph.components(edges, "a", "b").select(F.col("node").alias("label"), "component")
    return graph.cut(found.join(shuffled(whole), "label", "left").withColumn("component", F.coalesce("component", "label")))


def components(marked: DataFrame) -> DataFrame:
    """page_id, component, x0, y0, x1, y1, pixels, first (its first pixel from the top left)."""
    return marked.groupBy("page_id", "component").agg(F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"), F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.min(F.struct("y", "x0")).alias("first"))


def cracks(marked: DataFrame, diagonal: bool = True) -> DataFrame:
    """id, next, page_id, component, x, y, tx, ty and px, py, qx, qy: the sides of pixels that have the component on their right only.

    p and q are the first and last pixel along the side. At a corner where pixels touch, the ring goes on along the
    other pixel where diagonal is set, and along the same one where it isn't. This is every side as a row of one table,
    which outlines() doesn't make: tests hold its rings against it.
    """
    row = W.partitionBy("page_id", "y").orderBy("x0")
    begins = F.when(F.col("x0") == F.lag("x1").over(row), 0).otherwise(1)  # runs are cut at tiles
    one = marked.withColumn("begins", begins).withColumn("k", F.sum("begins").over(row.rowsBetween(W.unboundedPreceding, 0)))
    one = graph.cut(one.groupBy("page_id", "component", "y", "k").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")))
    x0, x1, y = F.col("x0"), F.col("x1"), F.col("y")
    # Sides that go on straight into the next row are one. Where level sides meet between two rows, the upright ones above and below run opposite ways.
    ends = one.select("page_id", "component", "y", F.inline(F.array(F.struct(x1.alias("x"), F.lit(True).alias("down")), F.struct(x0.alias("x"), F.lit(False).alias("down")))))
    column = ["page_id", "component", "x", "down"]
    tall = ends.withColumn("k", F.col("y") - F.row_number().over(W.partitionBy(*column).orderBy("y"))).groupBy(*column, "k").agg(F.min("y").alias("top"), F.max("y").alias("foot"))
    x, down, top, foot = F.col("x"), F.col("down"), F.col("top"), F.col("foot")
    px = F.when(down, x - 1).otherwise(x)
    ways = {"x": x, "y": F.when(down, top).otherwise(foot + 1), "tx": x, "ty": F.when(down, foot + 1).otherwise(top), "px": px, "py": F.when(down, top).otherwise(foot), "qx": px, "qy": F.when(down, foot).otherwise(top)}
    upright = tall.select("page_id", "component", *[v.cast("int").alias(n) for n, v in ways.items()])
    # Along the line between two rows: where the row below has pixels and the one above hasn't, and the other way round.
    mark = lambda at, x, up, down: F.struct(at.alias("line"), x.alias("at"), F.lit(up).alias("up"), F.lit(down).alias("down"), F.when(F.lit(up == 1), F.col("component")).alias("above"), F.when(F.lit(down == 1), F.col("component")).alias("below"))
    marks = one.select("page_id", F.inline(F.array(mark(y, x0, 0, 1), mark(y, x1, 0, -1), mark(y + 1, x0, 1, 0), mark(y + 1, x1, -1, 0))))
    marks = marks.groupBy("page_id", "line", "at").agg(F.sum("up").alias("up"), F.sum("down").alias("down"), F.max("above").alias("above"), F.max("below").alias("below"))
    along = W.partitionBy("page_id", "line").orderBy("at")
    upto = along.rowsBetween(W.unboundedPreceding, 0)
    parts = marks.select("page_id", "line", "at", F.lead("at").over(along).alias("to"), F.sum("up").over(upto).alias("up"), F.sum("down").over(upto).alias("down"), F.last("above", ignorenulls=True).over(upto).alias("above"), F.last("below", ignorenulls=True).over(upto).alias("below"))
    parts = parts.filter(F.col("up") != F.col("down")).withColumn("component", F.when(F.col("down") == 1, F.col("below")).otherwise(F.col("above")))
    top = F.col("down") == 1  # of a level side, the row below is inside
    level = parts.select(
        "page_id", "component", F.when(top, F.col("at")).otherwise(F.col("to")).alias("x"), F.col("line").alias("y"), F.when(top, F.col("to")).otherwise(F.col("at")).alias("tx"), F.col("line").alias("ty"),
        F.when(top, F.col("at")).otherwise(F.col("to") - 1).alias("px"), F.when(top, F.col("line")).otherwise(F.col("line") - 1).alias("py"), F.when(top, F.col("to") - 1).otherwise(F.col("at")).alias("qx"), F.when(top, F.col("line")).otherwise(F.col("line") - 1).alias("qy"))
    every = graph.cut(numbered(upright.unionByName(level), [F.col(c) for c in ("page_id", "y", "x", "ty", "tx")], "id"))
    after = every.select("page_id", "component", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("id").alias("next"), F.col("tx").alias("nx"), F.col("ty").alias("ny"))
    turn = (F.col("tx") - F.col("x")) * (F.col("ny") - F.col("ty")) - (F.col("ty") - F.col("y")) * (F.col("nx") - F.col("tx"))
    met = every.join(shuffled(after), ["page_id", "component", "tx", "ty"])
    to = met.groupBy("id").agg((F.min_by if diagonal else F.max_by)("next", F.signum(turn)).alias("next"))
    return every.join(shuffled(to), "id")


def _ends(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last of the chain that each side is in, and how many steps off it is; after: the next side, -1 at an end."""
    jump = np.where(after < 0, np.arange(len(after)), after)
    off = (after >= 0).astype(np.int64)
    while off[jump].any():
        off, jump = off + off[jump], jump[jump]
    return jump, off


def _cut_rings(after: np.ndarray) -> np.ndarray:
    """after with every ring and every chain cut before its least side, so that rings are chains, too."""
    every = np.arange(len(after))
    ends = after < 0
    jump, low, reached = np.where(ends, every, after), every, -1
    while True:
        lower, further = np.minimum(low, low[jump]), jump[jump]
        n = np.count_nonzero(ends[further])
        if n == reached and (lower == low).all():
            break
        low, jump, reached = lower, further, n
    chain = np.where(ends[jump], jump, low)
    least = np.empty(len(after), np.int64)
    least[chain[::-1]] = every[::-1]  # of several the last one stays, which is the least
    return np.where((after >= 0) & (least[chain[after]] != after), after, -1)


def _corner(y: np.ndarray, x: np.ndarray, way: np.ndarray) -> np.ndarray:
    """One long of a side's first corner and its way, in the order of corners from the top left."""
    return ((y + (way >= 2)) << 32) | ((x + ((way == 1) | (way == 2))) << 2) | way


def _followed(at: np.ndarray, by: np.ndarray, bx: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, component: np.ndarray, size: int, diagonal: bool, points: bool) -> tuple[np.ndarray, dict]:
    """The pieces of rings within squares, each from its first side to its last: the run that each begins at, and its columns.

    at: the square of each run, ascending. Sides of single pixels have one of four ways: along its upper side to the
    right, down its right one, back along its lower one, up its left one. The next side follows from the three pixels
    around its end, which the square or its margin has.
    """
    x0, x1 = np.maximum(x0, bx * size - 1), np.minimum(x1, (bx + 1) * size + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    at = np.cumsum(np.diff(at, prepend=-1) != 0) - 1
    top, left = np.minimum.reduceat(y, first) - 1, np.minimum.reduceat(x0, first) - 1
    wide, high = np.maximum.reduceat(x1, first) - left + 1, np.maximum.reduceat(y, first) - top + 2
    begin = np.cumsum(wide * high) - wide * high
    n = x1 - x0
    run = np.repeat(np.arange(len(y)), n)
    px = x0[run] + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    pixel = (begin[at] + (y - top[at]) * wide[at] - left[at])[run] + px
    seen = np.full(int((wide * high).sum()), -1, np.int64)
    seen[pixel] = component[run]
    own = (y[run] // size == by[run]) & (px // size == bx[run])
    run, px, pixel = run[own], px[own], pixel[own]
    py, inside, row = y[run], component[run], wide[at[run]]
    steps = ((1, 0), (0, 1), (-1, 0), (0, -1))
    found = []
    for way, (sx, sy) in enumerate(steps):
        ox, oy = steps[way - 1]  # outwards
        k = np.flatnonzero(seen[pixel + ox + oy * row] != inside)
        ahead, out, mine = sx + sy * row[k], ox + oy * row[k], inside[k]
        on, over = seen[pixel[k] + ahead] == mine, seen[pixel[k] + ahead + out] == mine
        over &= on | diagonal  # where pixels only touch, along the other one or along the same one
        on |= over
        turn = np.where(over, -1, np.where(on, 0, 1))
        found.append(np.stack([run[k], px[k], py[k], pixel[k], np.full(len(k), way), px[k] + sx * on + ox * over, py[k] + sy * on + oy * over, pixel[k] + ahead * on + out * over, (way + turn) % 4]))
    run, px, py, pixel, way, nx, ny, to, then = np.concatenate(found, axis=1)
    key = _corner(py, px, way)
    order = np.lexsort((key, at[run]))
    run, px, py, pixel, way, nx, ny, to, then, key = (v[order] for v in (run, px, py, pixel, way, nx, ny, to, then, key))
    side = np.full(4 * len(seen), -1, np.int64)
    side[4 * pixel + way] = np.arange(len(key))
    end, off = _ends(_cut_rings(side[4 * to + then]))
    order = np.lexsort((-off, end))
    run, px, py, way, nx, ny, then, key, end = (v[order] for v in (run, px, py, way, nx, ny, then, key, end))
    starts = np.flatnonzero(np.diff(end, prepend=-1))
    if not len(starts):
        return starts, {}
    last = np.append(starts[1:], len(end)) - 1
    x, y = (key >> 2) & ((1 << 30) - 1), key >> 32
    sx, sy = np.array(steps).T[:, way]
    total = lambda v: np.add.reduceat(v, starts)
    columns = {
        "head": key[starts], "next": _corner(ny[last], nx[last], then[last]), "area": total(x * sy - sx * y), "length": last - starts + 1, "centre": total(px * ny - nx * py),
        "x0": np.minimum.reduceat(px, starts), "y0": np.minimum.reduceat(py, starts), "x1": np.maximum.reduceat(px, starts) + 1, "y1": np.maximum.reduceat(py, starts) + 1}
    if points:  # where the way turns: the pixel before and the one after
        turns = way != then
        parts = np.cumsum(2 * total(turns.astype(np.int64)))[:-1]
        for name, p, q in (("xs", px, nx), ("ys", py, ny)):
            columns[name] = np.split(np.stack([p[turns], q[turns]], axis=1).ravel(), parts)
    return run[starts], columns


def pieces(marked: DataFrame, diagonal: bool = True, points: bool = True, size: int = SQUARE) -> DataFrame:
    """Rings as far as they lie in one square of a page: page_id, component, head, next, sums of a piece's sides, xs and ys of its turns. (F126)

    head and next are the piece's first side and the one after its last; where they are the same it is a whole ring.
    A square gets the runs in it and in a margin of a pixel, so no page, component or ring has to fit a task.
    """
    kind = marked.schema["page_id"].dataType.simpleString()
    reach = lambda low, high: F.explode(F.sequence(F.greatest(F.lit(0), F.floor((low - 1) / size)), F.floor(high / size)))
    rows = marked.filter("page_id is not null").select("page_id", "y", "x0", "x1", "component.ty", "component.tx", "component.n", reach(F.col("y"), F.col("y") + 1).alias("by"))
    rows = rows.withColumn("bx", reach(F.col("x0"), F.col("x1"))).repartition("page_id", "by", "bx").sortWithinPartitions("page_id", "by", "bx")
    square = ["page_id", "by", "bx"]

    def follow(b: pd.DataFrame, at: np.ndarray) -> Iterator[pd.DataFrame]:
        code = b.groupby(["ty", "tx", "n"], sort=False).ngroup().to_numpy()
        v = {c: b[c].to_numpy(np.int64) for c in ("by", "bx", "y", "x0", "x1")}
        first = np.flatnonzero(np.diff(at, prepend=-1))
        # So many squares at once as have a bounded number of pixels together.
        room = (np.maximum.reduceat(v["y"], first) - np.minimum.reduceat(v["y"], first) + 3) * (np.minimum(np.maximum.reduceat(v["x1"], first) - np.minimum.reduceat(v["x0"], first), size + 2) + 2)
        part = (np.cumsum(room) // TOGETHER)[at]
        for k in np.split(np.arange(len(b)), np.flatnonzero(np.diff(part)) + 1):
            run, columns = _followed(at[k], *(v[c][k] for c in ("by", "bx", "y", "x0", "x1")), code[k], size, diagonal, points)
            if len(run):
                yield pd.DataFrame({c: b[c].to_numpy()[k[run]] for c in ("page_id", "ty", "tx", "n")} | columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            if b.empty:
                continue
            at = np.cumsum((b[square] != b[square].shift()).any(axis=1).to_numpy()) - 1
            whole = int(np.searchsorted(at, at[-1]))  # the last square may go on
            held = b.iloc[whole:]
            if whole:
                yield from follow(b.iloc[:whole], at[:whole])
        if held is not None:
            yield from follow(held, np.zeros(len(held), np.int64))

    lists = ", xs array<long>, ys array<long>" if points else ""
    found = rows.mapInPandas(run, f"page_id {kind}, ty int, tx int, n long, head long, next long, area long, length long, centre long, x0 int, y0 int, x1 int, y1 int{lists}")
    return found.withColumn("component", F.struct("page_id", "ty", "tx", "n").cast(marked.schema["component"].dataType)).drop("ty", "tx", "n")


def outlines(marked: DataFrame, diagonal: bool = True, points: bool = True, size: int = SQUARE) -> DataFrame:
    """A row per ring: page_id, component, ring, area (pixels within, negative for a hole), length, centre_area and x0, y0, x1, y1 of its pixels, and points. (F126)

    ring is one within its page. centre_area is that of the polygon through the centres of the ring's pixels, which
    also are the points, in order from the top left and without those between two on a line. Rings within a square are
    whole at once; of others only their pieces, a few rows for each square, go through rounds.
    """
    found = graph.cut(pieces(marked, diagonal, points, size))
    sums = ["area", "length", "centre"]
    lists = ["xs", "ys"] if points else []
    box = {"x0": F.min, "y0": F.min, "x1": F.max, "y1": F.max}
    whole = found.filter("head = next").select("page_id", "component", F.col("head").alias("ring"), *sums, *box, *lists)
    parts = found.filter("head <> next")
    if not parts.isEmpty():
        # Numbers along the order of corners: a ring's least piece is the one that begins at its first corner.
        parts = graph.cut(numbered(parts, [F.col("page_id"), F.col("head")], "id"))
        heads = parts.select("page_id", F.col("head").alias("next"), F.col("id").alias("after"))
        steps = parts.select("page_id", "next", "id").join(shuffled(heads), ["page_id", "next"]).select("id", F.col("after").alias("next"))
        placed = parts.join(shuffled(graph.rings(steps)), "id")
        along = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", c))), lambda s: s[c])).alias(c)
        joined = placed.groupBy("page_id", "component", "ring").agg(F.min("head").alias("head"), *[F.sum(c).alias(c) for c in sums], *[f(c).alias(c) for c, f in box.items()], *map(along, lists))
        whole = whole.unionByName(joined.drop("ring").withColumnRenamed("head", "ring"))
    rings = whole.select("page_id", "component", "ring", (F.col("area") / 2).cast("long").alias("area"), "length", (F.abs("centre") / 2).alias("centre_area"), *box, *lists)
    if not points:
        return rings
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    turned = F.zip_with("xs", "ys", at)
    # The last pixel is the first of the side that begins at the first corner.
    rings = rings.withColumn("way", F.concat(F.slice(turned, -1, 1), F.slice(turned, F.lit(1), F.size(turned) - 1)))
    once = F.filter("way", lambda p, k: (k == 0) | (F.try_element_at("way", k) != p))
    once = F.when((F.size(once) > 1) & (F.try_element_at(once, F.lit(1)) == F.try_element_at(once, F.lit(-1))), F.slice(once, 1, F.size(once) - 1)).otherwise(once)
    return rings.select(*[c for c in rings.columns if c not in ("way", *lists)], once.alias("points"))


def _by_size(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages that are looked at as a whole, and the others."""
    small = F.col("width").cast("long") * F.col("height") <= LOCAL
    return pages.filter(small), pages.filter(~small)


def _named(pages: DataFrame) -> str:
    return f"page_id {pages.schema['page_id'].dataType.simpleString()}"


def _shaped(found: DataFrame, name: str) -> DataFrame:
    return found.withColumn(name, F.zip_with("xs", "ys", lambda x, y: F.struct(x.alias("x"), y.alias("y")))).drop("xs", "ys")


def _outer_rings(parts: list[tuple[np.ndarray, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """xs and ys of the outer outline of each component: y, x0, x1 of its runs; as outlines() has its points."""
    out: list = [None] * len(parts)
    room = np.cumsum([(p[0][-1] - p[0][0] + 3) * (p[2].max() - p[1].min() + 2) for p in parts]) // TOGETHER
    for k in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(room)) + 1):
        n = [len(parts[i][0]) for i in k]
        at, none = np.repeat(np.arange(len(k)), n), np.zeros(sum(n), np.int64)
        y, x0, x1 = (np.concatenate([parts[i][c] for i in k]) for c in range(3))
        run, ring = _followed(at, none, none, y, x0, x1, none, 1 << 30, True, True)
        for j in np.flatnonzero(ring["area"] > 0):  # a component has one
            way = np.stack([ring["xs"][j], ring["ys"][j]], axis=1).astype(np.float64)
            way = np.roll(way, 1, axis=0)
            way = way[np.append(True, (way[1:] != way[:-1]).any(axis=1))]
            way = way[:-1] if len(way) > 1 and (way[0] == way[-1]).all() else way
            out[k[at[run[j]]]] = way[:, 0], way[:, 1]
    return out


def _drawn(batches: Iterator[pd.DataFrame], elevation: bool) -> Iterator[pd.DataFrame]:
    """drawing_component() of whole pages."""
    for b in batches:
        rows, parts = [], []
        for r in b.itertuples(index=False):
            if not r.data or not r.width or not r.height:
                continue
            left, right = math.floor(r.width * SIDES[0]), math.floor(r.width * SIDES[1])
            bottom = max(1, math.floor(r.height * (BOTTOM_ELEVATION if elevation else BOTTOM_PLAN)))
            k = 5 if max(r.width, r.height) >= 2200 else 3
            mask = _gray(r)[:bottom, left:right] <= INK
            if not mask.any():
                continue
            y, x0, x1, n = _tile_runs(~_widened(~_widened(mask, k), k), True)
            order = np.argsort(n, kind="stable")
            y, x0, x1, n = y[order], x0[order] + left, x1[order] + left, n[order]
            first = np.flatnonzero(np.diff(n, prepend=-1))  # the first run of a component is its first from the top left
            a, z, top, foot, pixels = np.minimum.reduceat(x0, first), np.maximum.reduceat(x1, first), y[first], np.maximum.reduceat(y, first) + 1, np.add.reduceat(x1 - x0, first)
            w, h, rw, rh = z - a, foot - top, right - left, bottom
            box = w * h
            density = pixels / box
            cover = box / max(1, rw * rh)
            fits = np.flatnonzero((w >= rw * LEAST_WIDE) & (h >= rh * LEAST_HIGH) & (cover >= COVER[0]) & (cover <= COVER[1]) & (density >= DENSE[0]) & (density <= DENSE[1]))
            if not len(fits):
                continue
            score = box * (0.45 + np.minimum(density, 0.12) * 5.0)
            c = min(fits, key=lambda c: (-score[c], y[first[c]], x0[first[c]]))  # noqa: B023
            own = slice(first[c], first[c + 1] if c + 1 < len(first) else len(n))
            rows.append((r.page_id, a[c], top[c], z[c], foot[c], pixels[c], density[c]))
            parts.append((y[own], x0[own], x1[own]))
        if rows:
            found = pd.DataFrame(rows, columns=["page_id", "x0", "y0", "x1", "y1", "pixels", "density"])
            rings = _outer_rings(parts)
            yield found.assign(xs=[p[0] for p in rings], ys=[p[1] for p in rings])


def drawing_component(pages: DataFrame, elevation: bool = False, tile: int = TILE) -> DataFrame:
    """The dominant drawing of each page: page_id, x0, y0, x1, y1, pixels, density, polygon. (F128)

    Title blocks at the foot and the page's sides are left out. Gaps of ink are closed by 3 pixels, by 5 on pages of
    2,200 pixels and more; each size of page is a pass of its own.
    """
    small, pages = _by_size(pages)
    here = _shaped(small.mapInPandas(lambda b: _drawn(b, elevation), f"{_named(small)}, x0 int, y0 int, x1 int, y1 int, pixels long, density double, xs array<double>, ys array<double>"), "polygon")
    if pages.isEmpty():
        return here
    w, h = F.col("width"), F.col("height")
    bottom = F.greatest(F.lit(1), F.floor(h * (BOTTOM_ELEVATION if elevation else BOTTOM_PLAN)))
    left, right = F.floor(w * SIDES[0]), F.floor(w * SIDES[1])
    large = F.greatest("width", "height") >= 2200
    found = None
    for k, own in ((3, ~large), (5, large)):
        part = runs(tiles(pages.filter(own), tile, 2 * k), F.lit(INK + 1), tile, close=k, region=(left, F.lit(0), right, bottom))
        found = part if found is None else found.unionAll(part)
    marked = labelled(found, tile)
    sizes = pages.select("page_id", (right - left).alias("rw"), bottom.alias("rh"))
    cw, ch = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    boxed = components(marked).join(shuffled(sizes), "page_id").withColumn("box", cw * ch)
    cover, density = F.col("box") / F.greatest(F.lit(1), F.col("rw") * F.col("rh")), F.col("pixels") / F.col("box")
    fits = (cw >= F.col("rw") * LEAST_WIDE) & (ch >= F.col("rh") * LEAST_HIGH) & cover.between(*COVER) & density.between(*DENSE)
    score = F.col("box") * (0.45 + F.least(density, F.lit(0.12)) * 5.0)
    best = boxed.filter(fits).groupBy("page_id").agg(F.min(F.struct((-score).alias("s"), "first", "component", "x0", "y0", "x1", "y1", "pixels", density.alias("density"))).alias("b")).select("page_id", "b.*")
    best = graph.cut(best)
    rings = outlines(marked.join(shuffled(best.select("component")), "component", "left_semi")).filter("area > 0").groupBy("page_id", "component").agg(F.max_by("points", "area").alias("polygon"))
    return here.unionByName(best.join(shuffled(rings), ["page_id", "component"]).select("page_id", "x0", "y0", "x1", "y1", "pixels", "density", "polygon"))


def rectangles(pages: DataFrame, calibrations: DataFrame, tile: int = TILE, dark: int = DARK, least_side: int = LEAST_SIDE) -> DataFrame:
    """Candidates for openings on rendered elevations: page_id, x0, y0, x1, y1, width_m, height_m, geometry_confidence, review_status.

    calibrations: page_id, coord_space, px_per_m. Metres come only from a calibration in the picture's own pixels;
    without one the candidates stay, without metres. Dark lines are widened by a pixel, and contours are those of
    components and of their holes that fill enough of their box.
    """
    marked = labelled(runs(tiles(pages, tile, 3), F.lit(dark + 1), tile, widen=3), tile)
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    found = outlines(marked, points=False).filter((w >= least_side) & (h >= least_side) & (F.col("centre_area") / (w * h) >= FILLS))
    proven = F.when((F.col("coord_space") == "render_pixel") & (F.col("px_per_m") > 0), F.col("px_per_m"))
    got = found.join(shuffled(calibrations), "page_id", "left").withColumn("scale", proven)
    return got.select("page_id", "x0", "y0", "x1", "y1", F.bround(w / F.col("scale"), 4).alias("width_m"), F.bround(h / F.col("scale"), 4).alias("height_m"), F.lit(CONFIDENCE).alias("geometry_confidence"), F.lit("review").alias("review_status"))


def thresholds(tiled: DataFrame) -> DataFrame:
    """page_id, threshold: where a page's greys are cut, by percentiles, else by the grey that most pixels don't pass. tiled without margin."""
    kind = tiled.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for page, gray in zip(b["page_id"], b["gray"], strict=True):
                n = np.bincount(np.frombuffer(gray, np.uint8), minlength=256)
                yield pd.DataFrame({"page_id": page, "v": np.flatnonzero(n), "n": n[n > 0]})

    seen = tiled.select("page_id", "gray").mapInPandas(run, f"page_id {kind}, v int, n long").groupBy("page_id", "v").agg(F.sum("n").alias("n"))
    upto = W.partitionBy("page_id").orderBy("v")  # 256 values a page
    seen = seen.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("page_id")))
    grays = seen.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("v", "upto"))).alias("g"), F.max("all").alias("all"))
    value = lambda k: F.get(F.filter("g", lambda s: s["upto"] > k), F.lit(0))["v"]  # noqa: E731  the k-th pixel from 0
    at = [(F.col("all") - 1) * (p / 100) for p in PERCENTILES]
    cut = [value(F.floor(x)) + (x - F.floor(x)) * (value(F.ceil(x)) - value(F.floor(x))) for x in at]
    good = F.array_distinct(F.filter(F.array(*[F.when(v.between(*BAND), F.floor(v).cast("int")) for v in cut]), lambda v: v.isNotNull()))
    most = F.greatest(F.lit(2), F.get(F.filter("g", lambda s: s["upto"] >= F.col("all") * 0.8), F.lit(0))["v"])
    return grays.select("page_id", F.explode(F.when(F.size(good) > 0, good).otherwise(F.array(most))).alias("threshold"))


def envelopes(pages: DataFrame, least_pct: float = 0.4, most: int = 3, tile: int = TILE) -> DataFrame:
    """The outlines of each page's building: page_id (a long), nth, points in percent of the page, area_pct. (F127)

    For each threshold of the page, gaps in dark lines are closed by larger and larger squares until what the paper
    around can't be reached from covers least_pct of the page. Of outlines within 2 % of area of a larger one only that
    stays, and no more than most of a page.
    """
    every = pages.filter((F.col("width") >= 16) & (F.col("height") >= 16)).select("page_id", "width", "height")
    small, pages = _by_size(pages)
    here = _shaped(small.mapInPandas(lambda b: _enveloped(b, least_pct), f"{_named(small)}, threshold int, xs array<double>, ys array<double>"), "points")
    if pages.isEmpty():
        return _best_envelopes(here, every, most)
    sizes = pages.filter((F.col("width") >= 16) & (F.col("height") >= 16)).select("page_id", "width", "height")
    pages = pages.join(shuffled(sizes.select("page_id")), "page_id", "left_semi")
    cuts = graph.cut(thresholds(tiles(pages, tile)))
    # A page seen with a threshold is a page of its own, the threshold in its last eight bits.
    way, page, cut = F.shiftleft("page_id", 8).bitwiseOR(F.col("threshold")), F.shiftright("page_id", 8), F.col("page_id").bitwiseAND(F.lit(255))
    ways = lambda t, kept: t.join(shuffled(kept), "page_id").withColumn("page_id", way).drop("threshold")
    sized = graph.cut(ways(sizes, cuts))
    dark = runs(ways(tiles(pages, tile), cuts), cut, tile).groupBy("page_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).join(shuffled(sized), "page_id")
    share = F.col("n") / (F.col("width") * F.col("height"))
    left = graph.cut(dark.filter((share > DARK_SHARE[0]) & (share < DARK_SHARE[1])).select("page_id", "width", "height"))
    found = None
    for k in LADDER:
        seen = ways(tiles(pages, tile, 2 * k), cuts).join(shuffled(left.select("page_id")), "page_id", "left_semi")
        paper = labelled(runs(seen, cut, tile, close=k, inside=False, diagonal=False), tile, diagonal=False)
        border = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("width"))
        around = paper.join(shuffled(left), "page_id").filter(border).select("component").distinct()
        inner = _others(paper.join(shuffled(around), "component", "left_semi"), left, tile)
        area = inner.groupBy("page_id").agg(F.sum(F.col("x1") - F.col("x0")).alias("n")).join(shuffled(left), "page_id")
        large = graph.cut(area.filter(F.col("n") >= least_pct / 100 * F.col("width") * F.col("height")).select("page_id"))
        marked = labelled(inner.join(shuffled(large), "page_id", "left_semi"), tile)
        first = components(marked).groupBy("page_id").agg(F.min_by("component", "first").alias("component")).select("component")
        rings = outlines(marked.join(shuffled(first), "component", "left_semi")).filter("area > 0").groupBy("page_id").agg(F.max_by("points", "area").alias("points")).filter(F.size("points") >= 4)
        rings = graph.cut(rings)
        found = rings if found is None else found.unionAll(rings)
        left = graph.cut(left.join(shuffled(rings.select("page_id")), "page_id", "left_anti"))
        if left.isEmpty():
            break
    return _best_envelopes(here.unionByName(found.select(page.alias("page_id"), cut.cast("int").alias("threshold"), "points")), every, most)


def _cuts(gray: np.ndarray) -> list[int]:
    """thresholds() of a whole page."""
    n = np.bincount(gray.ravel(), minlength=256)
    v = np.flatnonzero(n)
    upto = np.cumsum(n[v])
    value = lambda k: int(v[np.searchsorted(upto, k, side="right")])
    cuts = []
    for p in PERCENTILES:
        x = float(upto[-1] - 1) * (p / 100)
        low = math.floor(x)
        cut = value(low) + (x - low) * (value(math.ceil(x)) - value(low))
        if BAND[0] <= cut <= BAND[1] and math.floor(cut) not in cuts:
            cuts.append(math.floor(cut))
    return cuts or [max(2, int(v[np.searchsorted(upto, float(upto[-1]) * 0.8)]))]


def _inner(dark: np.ndarray, k: int, least: float) -> tuple[np.ndarray, ...] | None:
    """Runs of the first component of what paper from a page's border doesn't reach, where gaps of what is dark are closed by k; None if that is too small."""
    h, w = dark.shape
    y, x0, x1, n = _tile_runs(_widened(~_widened(dark, k), k), False)
    around = np.zeros(len(n), bool)
    around[n[(y == 0) | (y == h - 1) | (x0 == 0) | (x1 == w)]] = True
    out = around[n]
    marks = np.zeros((h, w + 1), np.int8)
    marks[y[out], x0[out]] = 1
    marks[y[out], x1[out]] = -1
    inside = np.cumsum(marks[:, :w], axis=1, dtype=np.int8) == 0
    if np.count_nonzero(inside) < least:
        return None
    y, x0, x1, n = _tile_runs(inside, True)
    own = n == n[0] if len(n) else np.zeros(0, bool)
    return y[own], x0[own], x1[own]


def _enveloped(batches: Iterator[pd.DataFrame], least_pct: float) -> Iterator[pd.DataFrame]:
    """Of whole pages the outlines that envelopes() chooses from: a row for each threshold that has one."""

    def climbed(ways: list[tuple]) -> Iterator[pd.DataFrame]:
        for k in LADDER:
            tried = [(w, part) for w in ways if (part := _inner(w[2], k, w[3])) is not None and len(part[0])]
            rings = _outer_rings([part for _, part in tried]) if tried else []
            # With fewer than four turns it is no outline of a building, so larger gaps are tried.
            good = [(w, ring) for (w, _), ring in zip(tried, rings, strict=True) if ring is not None and len(ring[0]) >= 4]
            if good:
                yield pd.DataFrame([w[:2] for w, _ in good], columns=["page_id", "threshold"]).assign(xs=[p[0] for _, p in good], ys=[p[1] for _, p in good])
            found = {id(w) for w, _ in good}
            ways = [w for w in ways if id(w) not in found]
            if not ways:
                break

    ways: list[tuple] = []
    held = 0
    for b in batches:
        for r in b.itertuples(index=False):
            if not r.data or not r.width or not r.height or r.width < 16 or r.height < 16:
                continue
            gray = _gray(r)
            for cut in _cuts(gray):
                dark = gray < cut
                if DARK_SHARE[0] < np.count_nonzero(dark) / (r.width * r.height) < DARK_SHARE[1]:
                    ways.append((r.page_id, cut, dark, least_pct / 100 * r.width * r.height))
                    held += dark.size
            if held >= SENT // 4:
                yield from climbed(ways)
                ways, held = [], 0
    yield from climbed(ways)


def _others(given: DataFrame, pages: DataFrame, tile: int) -> DataFrame:
    """The runs of the pages' (page_id, width, height) pixels that lie in none of the given ones, labelled within tiles."""
    rows = pages.select("page_id", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    mark = lambda x, d: F.struct(x.cast("int").alias("x"), F.lit(d).alias("d"))
    edges = given.select("page_id", "y", F.inline(F.array(mark(F.col("x0"), 1), mark(F.col("x1"), -1))))
    # Rows end, and their runs are cut, where tiles do.
    seams = rows.select("page_id", "y", F.inline(F.array_append(F.transform(F.sequence(F.lit(0), F.col("width") - 1, F.lit(tile)), lambda x: mark(x, 0)), mark(F.col("width"), 0))))
    marks = edges.unionByName(seams).groupBy("page_id", "y", "x").agg(F.sum("d").alias("d"))
    along = W.partitionBy("page_id", "y").orderBy("x")
    parts = marks.select("page_id", "y", F.col("x").alias("x0"), F.lead("x").over(along).alias("x1"), F.sum("d").over(along.rowsBetween(W.unboundedPreceding, 0)).alias("n"))
    return graph.cut(_joined_rows(parts.filter((F.col("n") == 0) & F.col("x1").isNotNull()), tile))


def _joined_rows(found: DataFrame, tile: int) -> DataFrame:
    """Runs with a label of their tile's own: those of a tile that touch, diagonally too, have one."""
    kind = found.schema["page_id"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(rows["ty"].iloc[0]) * tile, int(rows["tx"].iloc[0]) * tile
        mask = np.zeros((tile, tile), bool)
        for y, a, z in zip(rows["y"], rows["x0"], rows["x1"], strict=True):
            mask[y - y0, a - x0 : z - x0] = True
        y, a, z, n = _tile_runs(mask, True)
        return pd.DataFrame({"page_id": [rows["page_id"].iloc[0]] * len(y), "y": y + y0, "x0": a + x0, "x1": z + x0, "ty": y0 // tile, "tx": x0 // tile, "n": n})

    tiled = found.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x0") / tile).cast("int")})
    got = tiled.select("page_id", "y", "x0", "x1", "ty", "tx").groupBy("page_id", "ty", "tx").applyInPandas(run, f"page_id {kind}, y int, x0 int, x1 int, ty int, tx int, n long")
    return got.select("page_id", "y", "x0", "x1", F.struct("page_id", "ty", "tx", "n").alias("label"))


def _best_envelopes(found: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    from ..functions import geometry
    from .surfaces import simplified

    longer = F.greatest("width", "height")
    scaled = F.transform("points", lambda p: F.struct((p["x"] / longer).alias("x"), (p["y"] / longer).alias("y")))
    flat = simplified(found.join(shuffled(sizes), "page_id").withColumn("points", scaled), "points", SMOOTH)
    pct = F.transform("points", lambda p: F.struct(F.round(p["x"] * longer / F.col("width") * 100, 3).alias("x"), F.round(p["y"] * longer / F.col("height") * 100, 3).alias("y")))
    sized = flat.withColumn("points", pct).withColumn("area_pct", F.round(geometry.area(F.col("points")) / 100, 2))
    listed = sized.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("area_pct")).alias("a"), "threshold", "points"))).alias("all"))  # a row for each threshold
    kept = F.aggregate("all", F.filter("all", lambda s: F.lit(False)), lambda acc, s: F.when((F.size(acc) > 0) & (F.abs(F.try_element_at(acc, F.lit(-1))["a"] - s["a"]) <= 2.0), acc).otherwise(F.array_append(acc, s)))
    return listed.select("page_id", F.posexplode(F.slice(kept, 1, most)).alias("nth", "s")).select("page_id", (F.col("nth") + 1).alias("nth"), "s.points", (-F.col("s.a")).alias("area_pct"))
