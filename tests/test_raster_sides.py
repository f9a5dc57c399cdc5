from plumbline.operators import raster


def test_straight_sides_are_one(spark):
    """A ring round a 12 x 20 rectangle has four sides, however tall it is; two pixels that touch at a corner have eight."""
    rows = [bytearray(b"\xff" * 32) for _ in range(32)]
    for y in range(4, 24):
        rows[y][5:17] = bytes(12)
    rows[28][28] = rows[29][29] = 0
    pages = spark.createDataFrame([(1, 32, 32, 1, b"".join(map(bytes, rows)))], "page_id long, height int, width int, channels int, data binary")
    marked = raster.labelled(raster.runs(raster.tiles(pages, 32), raster.F.lit(128), 32), 32)
    assert raster.cracks(marked).count() == 12
