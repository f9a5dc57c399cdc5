"""Raster pages against flood fills and tracing in plain Python, through PNG files and Spark's image source."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import raster

PAGES = "page_id long, height int, width int, channels int, data binary"


def given(spark, pages):
    return spark.createDataFrame([(k, *g.shape, 1, bytearray(g.tobytes())) for k, g in pages.items()], PAGES)


def noise(seed, h, w, share=0.45):
    r = np.random.default_rng(seed)
    return np.where(r.random((h, w)) < share, 0, 255).astype(np.uint8)


def blobs(mask, diagonal):
    """Pixels of each component, by flood fill, in the order of their first pixels."""
    left, found = set(zip(*(v.tolist() for v in np.nonzero(mask)))), []
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not (a and b))]
    for start in sorted(left):
        if start in left:
            left.discard(start)
            todo, own = [start], []
            while todo:
                p = todo.pop()
                own.append(p)
                for a, b in steps:
                    q = (p[0] + a, p[1] + b)
                    if q in left:
                        left.discard(q)
                        todo.append(q)
            found.append(sorted(own))
    return found


def moore(mask):
    """The pixels around a region, clockwise from its first, each step to the first neighbour after the one come from."""
    turn = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    inside = lambda p: 0 <= p[0] < mask.shape[0] and 0 <= p[1] < mask.shape[1] and mask[p]
    start = tuple(map(int, np.argwhere(mask)[0]))
    at, back, ring = start, 6, [start]
    first = None
    while True:
        for i in range(1, 9):
            k = (back + i) % 8
            q = (at[0] + turn[k][0], at[1] + turn[k][1])
            if inside(q):
                break
        else:
            return ring
        if first is None:
            first = k
        elif at == start and k == first:
            return ring[:-1]
        # The way back from there is to the last place looked at before it.
        before = (at[0] + turn[(k - 1) % 8][0] - q[0], at[1] + turn[(k - 1) % 8][1] - q[1])
        at, back = q, turn.index(before)
        ring.append(at)


@pytest.mark.parametrize("seed,h,w,diagonal", [(1, 40, 50, True), (2, 40, 50, False), (3, 7, 90, True), (4, 64, 64, False)])
def test_components(spark, seed, h, w, diagonal):
    pages = {1: noise(seed, h, w), 2: noise(seed + 50, h, w, 0.6), 3: np.full((h, w), 255, np.uint8), 4: np.zeros((h, w), np.uint8)}
    marked = raster.labelled(raster.runs(raster.tiles(given(spark, pages), 16), F.lit(128), 16, diagonal=diagonal), 16, diagonal)
    got = sorted((r["page_id"], r["x0"], r["y0"], r["x1"], r["y1"], r["pixels"]) for r in raster.components(marked).collect())
    want = []
    for k, g in pages.items():
        for own in blobs(g < 128, diagonal):
            ys, xs = [p[0] for p in own], [p[1] for p in own]
            want.append((k, min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(own)))
    assert got == sorted(want)


@pytest.mark.parametrize("diagonal", [True, False])
def test_outlines(spark, diagonal):
    pages = {k: noise(k, 30, 33, 0.3 + 0.1 * k) for k in (1, 2, 3)}
    marked = raster.labelled(raster.runs(raster.tiles(given(spark, pages), 8), F.lit(128), 8, diagonal=diagonal), 8, diagonal)
    rings = raster.outlines(marked, diagonal).collect()
    for k, g in pages.items():
        own = blobs(g < 128, diagonal)
        assert sum(r["area"] for r in rings if r["page_id"] == k) == int((g < 128).sum())
        outer = [r for r in rings if r["page_id"] == k and r["area"] > 0]
        assert len(outer) == len(own)
        holes = [b for b in blobs(np.pad(g >= 128, 1, constant_values=True), not diagonal)][1:]
        inner = sorted(-r["area"] for r in rings if r["page_id"] == k and r["area"] < 0)
        assert len(inner) == len(holes) and all(a >= b for a, b in zip(inner, sorted(map(len, holes)), strict=True))  # islands within count
        if diagonal:
            traced = {}
            for b in own:
                mask = np.zeros_like(g, bool)
                mask[tuple(np.array(b).T)] = True
                traced[b[0]] = moore(mask)
            for r in outer:
                points = [(int(p["y"]), int(p["x"])) for p in r["points"]]
                ring = traced[points[0]]
                full = []
                for p, q in zip(points, points[1:] + points[:1]):  # points between two on a line are left out
                    n = max(abs(q[0] - p[0]), abs(q[1] - p[1]))
                    full += [(p[0] + (q[0] - p[0]) * i // n, p[1] + (q[1] - p[1]) * i // n) for i in range(n)] if n else [p]
                assert full == ring


def closed(mask, k, grow_only=False):
    def wide(m):
        out = np.zeros_like(m)
        for dy in range(-((k - 1) // 2), k // 2 + 1):
            for dx in range(-((k - 1) // 2), k // 2 + 1):
                src = m[max(0, dy) : m.shape[0] + min(0, dy), max(0, dx) : m.shape[1] + min(0, dx)]
                out[max(0, -dy) : m.shape[0] + min(0, -dy), max(0, -dx) : m.shape[1] + min(0, -dx)] |= src
        return out

    grown = wide(mask)
    return grown if grow_only else ~wide(~grown)


@pytest.mark.parametrize("k,tile", [(3, 16), (5, 16), (9, 32)])
def test_gaps_are_closed_alike_in_tiles(spark, k, tile):
    g = noise(k, 70, 61, 0.15)
    got = np.zeros_like(g, bool)
    for r in raster.runs(raster.tiles(given(spark, {1: g}), tile, 2 * k), F.lit(128), tile, close=k).collect():
        got[r["y"], r["x0"] : r["x1"]] = True
    assert (got == closed(g < 128, k)).all()


def png(gray):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = gray.shape
    lines = b"".join(b"\0" + gray[y].tobytes() for y in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def plan(seed, h=300, w=400):
    """A building of walls with gaps, and a title block."""
    r = random.Random(seed)
    g = np.full((h, w), 255, np.uint8)
    x0, y0, x1, y1 = 40 + r.randrange(20), 30 + r.randrange(20), 300 + r.randrange(40), 180 + r.randrange(40)
    for y in (y0, y1, (y0 + y1) // 2):
        g[y : y + 3, x0:x1] = 0
    for x in (x0, x1 - 3, (x0 + x1) // 2):
        g[y0 : y1 + 3, x : x + 3] = 0
    g[y0 : y0 + 3, x0 + 30 : x0 + 36] = 255  # a door
    g[h - 20 : h - 10, 10 : w - 10] = 0
    return g, (x0, y0, x1, y1 + 3)


def test_drawing_component_of_png_files(spark, tmp_path):
    want = {}
    for k in (1, 2, 3):
        g, box = plan(k)
        (tmp_path / f"{k}.png").write_bytes(png(g))
        want[k] = box
    images = spark.read.format("image").load(str(tmp_path)).withColumn("page_id", F.regexp_extract("image.origin", r"(\d+)\.png", 1).cast("long"))
    got = raster.drawing_component(raster.pictures(images), tile=64).collect()
    assert {r["page_id"]: (r["x0"], r["y0"], r["x1"], r["y1"]) for r in got} == want
    for r in got:
        g, _ = plan(r["page_id"])
        roi = closed(g[: int(300 * 0.86), 12:388] <= 205, 3)
        best = max((b for b in blobs(roi, True)), key=len)
        assert r["pixels"] == len(best) and r["density"] == pytest.approx(len(best) / ((r["x1"] - r["x0"]) * (r["y1"] - r["y0"])))
        assert {(p["x"], p["y"]) for p in r["polygon"]} >= {(float(r["x0"]), float(r["y0"])), (float(r["x1"] - 1), float(r["y1"] - 1))}


def test_rectangles(spark):
    g = np.full((200, 240), 255, np.uint8)
    for x, y, w, h in ((20, 20, 40, 30), (100, 50, 25, 60)):
        g[y, x : x + w] = g[y + h - 1, x : x + w] = 0
        g[y : y + h, x] = g[y : y + h, x + w - 1] = 0
    g[150, 10:200] = 0  # a line is no rectangle
    scales = spark.createDataFrame([(1, "render_pixel", 20.0), (2, "pdf_point", 20.0)], "page_id long, coord_space string, px_per_m double")
    got = raster.rectangles(given(spark, {1: g, 2: g, 3: g}), scales, tile=32).collect()
    boxes = {(19, 19, 61, 51), (21, 21, 59, 49), (99, 49, 126, 111), (101, 51, 124, 109)}  # outlines and holes of lines three pixels wide
    for k in (1, 2, 3):
        assert {(r["x0"], r["y0"], r["x1"], r["y1"]) for r in got if r["page_id"] == k} == boxes
    assert {(r["width_m"], r["height_m"]) for r in got if r["page_id"] == 1} == {(2.1, 1.6), (1.9, 1.4), (1.35, 3.1), (1.15, 2.9)}
    assert all(r["width_m"] is None and r["review_status"] == "review" for r in got if r["page_id"] != 1)


def test_envelopes(spark):
    g, (x0, y0, x1, y1) = plan(5)
    got = raster.envelopes(given(spark, {7: g, 8: np.full((300, 400), 255, np.uint8), 9: np.zeros((4, 4), np.uint8)}), tile=128).collect()
    [r] = [r for r in got if r["nth"] == 1]
    assert r["page_id"] == 7
    xs, ys = [p["x"] * 4 for p in r["points"]], [p["y"] * 3 for p in r["points"]]
    assert (min(xs), min(ys), max(xs), max(ys)) == pytest.approx((x0, y0, x1 - 1, y1 - 1), abs=0.02)
    assert r["area_pct"] == pytest.approx((x1 - x0 - 1) * (y1 - y0 - 1) / 1200, abs=0.3)


def test_nothing_drawn(spark):
    none = given(spark, {1: np.full((20, 20), 255, np.uint8)}).limit(0)
    assert raster.drawing_component(none).count() == 0
    empty = spark.createDataFrame([(1, 0, 0, 1, None)], PAGES)
    assert raster.labelled(raster.runs(raster.tiles(empty), F.lit(9))).count() == 0


def sketch(seed, h=90, w=130):
    """Boxes of grey walls with gaps of several widths over uneven paper, and a few dark pixels."""
    r = np.random.default_rng(seed)
    g = (200 + r.integers(0, 40, (h, w))).astype(np.uint8)
    for _ in range(3):
        x0, y0, n, m = (int(v) for v in (r.integers(0, w // 2), r.integers(0, h // 2), r.integers(30, w // 2), r.integers(25, h // 2)))
        dark, gap = int(r.integers(0, 160)), int(r.integers(0, 16))
        g[y0 : y0 + 2, x0 : x0 + n] = g[y0 + m - 2 : y0 + m, x0 : x0 + n] = dark
        g[y0 : y0 + m, x0 : x0 + 2] = g[y0 : y0 + m, x0 + n - 2 : x0 + n] = dark
        g[y0 : y0 + 2, x0 + 9 : x0 + 9 + gap] = 230
    g[r.random((h, w)) < 0.01] = 0
    return g


@pytest.mark.parametrize("what", ["drawing_component", "envelopes"])
def test_whole_pages_are_as_their_tiles(spark, monkeypatch, what):
    """each page of few pixels went through all the shuffles and rounds that join tiles."""
    from plumbline.operators import graph

    monkeypatch.setattr(raster, "LADDER", (9, 21))
    monkeypatch.setattr(raster, "SENT", 1 << 16)  # pages are also handed over in several lots
    drawn = {k: sketch(k) for k in range(1, 9)} | {9: noise(3, 60, 70), 10: np.full((40, 40), 255, np.uint8), 11: np.zeros((30, 20), np.uint8), 12: noise(4, 10, 12)}
    looked = lambda: sorted(map(tuple, getattr(raster, what)(given(spark, drawn), tile=48).collect()))
    whole, cuts = looked(), []
    monkeypatch.setattr(raster, "LOCAL", 0)
    assert looked() == whole and len({r[0] for r in whole}) >= 4
    monkeypatch.undo()
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(df) or df)
    assert getattr(raster, what)(given(spark, drawn), tile=48).count() and not cuts
