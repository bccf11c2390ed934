"""TIFF rasters: blocks, predictors, ranges that are read, boxes, points."""

import io
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchwater.sources import providers, raster

R = np.random.default_rng(3)


@pytest.mark.parametrize("predictor", [1, 2, 3])
@pytest.mark.parametrize("shape,side", [((300, 520), 64), ((10, 7), 16), ((64, 64), 64)])
def test_what_is_written_is_read(predictor, shape, side):
    z = np.round(R.random(shape) * 1000) if predictor == 2 else R.random(shape).astype(np.float32).astype(float)
    z[3, 4] = np.nan
    t = raster.Raster(io.BytesIO(raster.encoded(z, 10.0, 50.0, 0.01, side, predictor)))
    assert (t.width, t.height, t.west, t.north) == (shape[1], shape[0], 10.0, 50.0) and t.blocks == -(-shape[0] // side) * -(-shape[1] // side)
    rows, cols = (x.ravel() for x in np.mgrid[-1 : shape[0] + 1, -1 : shape[1] + 1])
    got = t.value(rows, cols)
    inside = (rows >= 0) & (rows < shape[0]) & (cols >= 0) & (cols < shape[1])
    assert np.array_equal(got[inside], z.ravel(), equal_nan=True) and np.isnan(got[~inside]).all()


def test_strips_in_the_other_byte_order():
    z = np.arange(60, dtype=">i2").reshape(6, 10)
    strips = [zlib.compress(z[r : r + 4].tobytes()) for r in (0, 4)]
    fields = [(256, 3, 1, 10), (257, 3, 1, 6), (258, 3, 1, 16), (259, 3, 1, 32946), (273, 4, 2, None), (278, 3, 1, 4), (279, 4, 2, None), (339, 3, 1, 2)]
    base = 8 + 2 + 12 * len(fields) + 4
    data = struct.pack(">2sHIH", b"MM", 42, 8, len(fields))
    for tag, kind, n, v in fields:
        data += struct.pack(">HHI", tag, kind, n) + (struct.pack(">I", base if tag == 273 else base + 8) if n > 1 else struct.pack(">HH", v, 0))
    data += b"\0" * 4 + struct.pack(">II", base + 16, base + 16 + len(strips[0])) + struct.pack(">II", *map(len, strips)) + b"".join(strips)
    rows, cols = (x.ravel() for x in np.mgrid[0:6, 0:10])
    assert raster.Raster(io.BytesIO(data)).value(rows, cols).tolist() == list(range(60))
    for bad in (b"GIF89a" + b"\0" * 20, struct.pack("<2sH", b"II", 43) + b"\0" * 20):
        with pytest.raises(ValueError, match="TIFF"):
            raster.Raster(io.BytesIO(bad))


@pytest.fixture(scope="module")
def tiles(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('tiles')}"
    cells = spark.range(300 * 300).selectExpr("10 + (id % 300 + 0.5D) / 150 AS lon", "-1 + (id div 300 + 0.5D) / 150 AS lat", "double(id % 977) AS value")
    raster.write_tiles(cells, path, 150, side=32)
    return path, cells


def test_source_equals_cells(spark, tiles):
    path, cells = tiles
    got = raster.read(spark, path)
    assert got.count() == 90_000 and sorted(r[0] for r in got.select("tile").distinct().collect()) == ["N00_00_E010_00", "N00_00_E011_00", "S01_00_E010_00", "S01_00_E011_00"]
    key = lambda d: d.select(F.round(F.col("lon") * 1500).alias("x"), F.round(F.col("lat") * 1500).alias("y"), "value")
    assert key(got).exceptAll(key(cells)).count() == 0
    few = raster.read(spark, path, (10.2, -0.3, 10.3, -0.2)).where("lon BETWEEN 10.2 AND 10.3 AND lat BETWEEN -0.3 AND -0.2")
    assert few.count() == cells.where("lon BETWEEN 10.2 AND 10.3 AND lat BETWEEN -0.3 AND -0.2").count() > 0


def test_filters_reach_the_reader(spark, tiles):
    path, cells = tiles
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        where = "lon > 10.2 AND lon <= 10.3 AND lat >= -0.3 AND lat < -0.2"
        assert raster.read(spark, path).where(where).count() == cells.where(where).count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_box_reads_few_bytes(tiles, tmp_path):
    z = R.random((2000, 2000))
    (tmp_path / "big.tif").write_bytes(raster.encoded(z, 0.0, 1.0, 1 / 2000, 128))
    size = (tmp_path / "big.tif").stat().st_size
    reader = raster.TiffReader({"path": str(tmp_path), "box": "0.4,0.4,0.41,0.41", "split": str(size // 3)})
    parts = reader.partitions()
    batches = [b for p in parts for b in reader.read(p)]
    assert len(parts) >= 3 and 1 <= len(batches) <= 4 and reader.taken < len(parts) * raster.HEAD + len(batches) * 128 * 128 * 4 < size / 4
    whole = raster.TiffReader({"path": str(tmp_path)})
    assert sum(b.num_rows for p in whole.partitions() for b in whole.read(p)) == 4_000_000
    from pyspark.sql.datasource import GreaterThan, LessThanOrEqual

    pushed = raster.PushedReader({"path": str(tmp_path)})
    kept = list(pushed.pushFilters([GreaterThan(("lon",), 0.4), LessThanOrEqual(("lon",), 0.41), GreaterThan(("lat",), 0.4), LessThanOrEqual(("lat",), 0.41)]))
    assert len(kept) == 4 and len([b for p in pushed.partitions() for b in pushed.read(p)]) == len(batches)


def test_points_equal_tile_sample(spark, tiles):
    path, _ = tiles
    points = spark.createDataFrame([(k, float(R.uniform(-1.2, 1.2)), float(R.uniform(9.8, 12.2)), "x") for k in range(400)] + [(999, None, 10.0, "y"), (5, 0.5, 10.5, "again"), (1000, -1.0, 10.0, "corner")], "point_id long, lat double, lon double, note string")
    got = sorted(map(tuple, raster.sample(points, path, 150, block=64).select("point_id", "note", "elevation").collect()), key=str)
    table = raster.read(spark, path).select("tile", "row", "col", "value")
    want = sorted(map(tuple, providers.tile_sample(points, table, 150).select("point_id", "note", "elevation").collect()), key=str)
    same = [a == b for a, b in zip(got, want)]
    assert len(got) == len(want) == 403 and sum(same) >= 402  # a point on a tile's northern edge is the later tile's here
    assert any(g[2] is None for g in got) and any(g[2] is not None for g in got)


def test_empty_folder(spark, tmp_path):
    assert raster.read(spark, f"file://{tmp_path}").count() == 0
