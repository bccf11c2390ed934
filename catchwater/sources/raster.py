"""Elevation rasters: a Python data source for tiled TIFF, tile files written from cells, and values at points.

A file is read by ranges: its header, its directory and the places of its blocks, then only the blocks that are wanted. Blocks may be deflated,
with or without a predictor. Partitions are shares of a file's blocks, planned from file sizes alone; a box, given as an option or (where the
session lets filters reach Python sources) as filters on lon and lat, leaves blocks out before they are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from catchwater.scratch import store_of
from catchwater.sources.providers import tile_key

SCHEMA = "tile string, row int, col int, lon double, lat double, value double"
SPLIT = 16 << 20  # bytes of a file for each of its partitions
HEAD = 1 << 14  # bytes that are read first; a longer directory takes more reads
# Field types of the format and their sizes, and the tags that are read.
KINDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, STRIP_ROWS, STRIP_BYTES, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, FORMAT, SCALE, TIE, NODATA = 256, 257, 258, 259, 273, 278, 279, 317, 322, 323, 324, 325, 339, 33550, 33922, 42113
PLAIN, DEFLATE = 1, (8, 32946)


@dataclass
class Box:
    min_lon: float = -np.inf
    min_lat: float = -np.inf
    max_lon: float = np.inf
    max_lat: float = np.inf


class Raster:
    """A tiled or stripped TIFF of one band. `taken`: bytes that were read. stream: an open file that can be sought."""

    def __init__(self, stream):
        self.stream, self.taken, self.head = stream, 0, b""
        self.head = self.range(0, HEAD)
        mark = self.head[:2]
        if mark not in (b"II", b"MM"):
            raise ValueError("no TIFF")
        self.order = "<" if mark == b"II" else ">"
        version, first = self.unpack("HI", 2, 6)
        if version == 43:
            raise ValueError("BigTIFF is not read")
        (n,) = self.unpack("H", first, 2)
        self.tags = {}
        for k in range(n):
            tag, kind, count = self.unpack("HHI", first + 2 + 12 * k, 8)
            if kind in KINDS:
                code, size = KINDS[kind]
                at = first + 2 + 12 * k + 8
                if size * count > 4:
                    (at,) = self.unpack("I", at, 4)
                self.tags[tag] = self.range(at, count).split(b"\0")[0] if code == "s" else self.unpack(code * count, at, size * count)
        one = lambda tag, default=None: self.tags[tag][0] if tag in self.tags else default
        self.width, self.height = one(WIDTH), one(HEIGHT)
        self.tile_width, self.tile_height = one(TILE_WIDTH, self.width), one(TILE_HEIGHT) or min(one(STRIP_ROWS, self.height), self.height)
        self.offsets, self.sizes = self.tags.get(TILE_OFFSETS) or self.tags[STRIP_OFFSETS], self.tags.get(TILE_BYTES) or self.tags[STRIP_BYTES]
        self.compression, self.predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
        letter = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
        self.dtype = np.dtype(f"{self.order}{letter}{one(BITS, 1) // 8}")
        if self.compression not in (PLAIN, *DEFLATE) or self.predictor not in (1, 2, 3):
            raise ValueError(f"compression {self.compression} with predictor {self.predictor} is not read")
        self.across = -(-self.width // self.tile_width)
        self.blocks = self.across * -(-self.height // self.tile_height)
        (sx, sy, *_), (i, j, _, x, y, *_) = self.tags.get(SCALE, (1.0, 1.0)), self.tags.get(TIE, (0.0,) * 6)
        self.step_x, self.step_y, self.west, self.north = sx, sy, x - i * sx, y + j * sy
        self.nodata = float(self.tags[NODATA]) if NODATA in self.tags else None

    def range(self, at: int, size: int) -> bytes:
        if at + size <= len(self.head):
            return self.head[at : at + size]
        self.stream.seek(at)
        data = self.stream.read(size)
        self.taken += len(data)
        return data

    def unpack(self, code: str, at: int, size: int) -> tuple:
        return struct.unpack(self.order + code, self.range(at, size))

    def bounds(self, block: int) -> tuple[int, int, int, int]:
        """First row and column, and those behind the last."""
        r, c = block // self.across * self.tile_height, block % self.across * self.tile_width
        return r, c, min(self.height, r + self.tile_height), min(self.width, c + self.tile_width)

    def meets(self, block: int, box: Box) -> bool:
        """Whether the centre of a cell of the block can lie in the box."""
        r0, c0, r1, c1 = self.bounds(block)
        west, east, north, south = self.west + (c0 + 0.5) * self.step_x, self.west + (c1 - 0.5) * self.step_x, self.north - (r0 + 0.5) * self.step_y, self.north - (r1 - 0.5) * self.step_y
        return west <= box.max_lon and east >= box.min_lon and south <= box.max_lat and north >= box.min_lat

    def block(self, k: int) -> np.ndarray:
        """The values of a block as doubles, NaN where there is no data."""
        r0, c0, r1, c1 = self.bounds(k)
        if not self.sizes[k]:
            return np.full((r1 - r0, c1 - c0), np.nan)
        data = self.range(self.offsets[k], self.sizes[k])
        if self.compression != PLAIN:
            data = zlib.decompress(data)
        rows = self.tile_height if TILE_OFFSETS in self.tags else r1 - r0
        if self.predictor == 3:
            x = np.frombuffer(data, np.uint8).reshape(rows, -1).cumsum(1, dtype=np.uint8)
            x = x.reshape(rows, self.dtype.itemsize, -1).transpose(0, 2, 1).copy().view(self.dtype.newbyteorder(">"))[:, :, 0]
        else:
            x = np.frombuffer(data, self.dtype).reshape(rows, -1)
            if self.predictor == 2:
                x = x.cumsum(1, dtype=self.dtype.newbyteorder("="))
        x = x[: r1 - r0, : c1 - c0].astype(float)
        if self.nodata is not None:
            x[x == self.nodata] = np.nan
        return x

    def value(self, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        """The values of cells, NaN for those outside; each block is read once."""
        out = np.full(len(rows), np.nan)
        (inside,) = np.nonzero((rows >= 0) & (rows < self.height) & (cols >= 0) & (cols < self.width))
        of = rows[inside] // self.tile_height * self.across + cols[inside] // self.tile_width
        for k in np.unique(of).tolist():
            at = inside[of == k]
            r0, c0, _, _ = self.bounds(k)
            out[at] = self.block(k)[rows[at] - r0, cols[at] - c0]
        return out


def tile_of(path: str) -> str:
    return path.rpartition("/")[2].rpartition(".")[0]


class Share(InputPartition):
    def __init__(self, path: str, k: int, n: int):
        self.path, self.k, self.n = path, k, n


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.box = Box(*map(float, options["box"].split(","))) if options.get("box") else Box()
        self.taken = 0

    def partitions(self):
        from pyarrow import fs

        store, inner, head = store_of(self.path)
        info = store.get_file_info(inner)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
        found = sorted((f.path, f.size) for f in files if f.type == fs.FileType.File and f.path.lower().endswith((".tif", ".tiff")))
        return [Share(head + path, k, n) for path, size in found for n in [max(1, -(-size // self.split))] for k in range(n)] or [Share("", 0, 1)]

    def read(self, part: Share) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        store, inner, _ = store_of(part.path)
        with store.open_input_file(inner) as stream:
            raster, tile = Raster(stream), tile_of(part.path)
            for k in range(raster.blocks * part.k // part.n, raster.blocks * (part.k + 1) // part.n):
                if raster.meets(k, self.box):
                    yield self.rows(raster, tile, k)
            self.taken += raster.taken

    def rows(self, raster: Raster, tile: str, k: int) -> pa.RecordBatch:
        r0, c0, r1, c1 = raster.bounds(k)
        r, c = (x.ravel() for x in np.mgrid[r0:r1, c0:c1].astype(np.int32))
        value = pa.array(raster.block(k).ravel(), from_pandas=True)
        cols = [pa.array([tile] * len(r)), pa.array(r), pa.array(c), pa.array(raster.west + (c + 0.5) * raster.step_x), pa.array(raster.north - (r + 0.5) * raster.step_y), value]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])


class PushedReader(TiffReader):
    """For sessions in which filters reach Python sources."""

    def pushFilters(self, filters):
        """Bounds of lon and lat narrow the box; Spark tests every filter on the rows again."""
        for f in filters:
            if len(f.attribute) == 1 and f.attribute[0] in ("lon", "lat") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                name = f.attribute[0]
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    setattr(self.box, f"min_{name}", max(float(f.value), getattr(self.box, f"min_{name}")))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    setattr(self.box, f"max_{name}", min(float(f.value), getattr(self.box, f"max_{name}")))
            yield f


class TiffSource(DataSource):
    """spark.read.format("tiff").option("box", "min_lon,min_lat,max_lon,max_lat").load(path)"""

    @classmethod
    def name(cls):
        return "tiff"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        options = dict(self.options)
        return (PushedReader if options.get("pushdown") == "true" else TiffReader)(options)


def read(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(tile, row, col, lon, lat, value) of the cells of all rasters of a folder; of those whose blocks meet a box (min_lon, min_lat, max_lon, max_lat). No data is null."""
    spark.dataSource.register(TiffSource)
    reader = spark.read.format("tiff").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    return (reader.option("box", ",".join(map(repr, map(float, box)))) if box else reader).load(path)


def encoded(values: np.ndarray, west: float, north: float, step: float, side: int = 256, predictor: int = 3) -> bytes:
    """A TIFF of float32 values (rows from the north) in deflated blocks of side x side cells. predictor: 1, 2 or 3; NaN is no data."""
    h, w = values.shape
    dtype = np.dtype("<f4") if predictor != 2 else np.dtype("<i4")
    out = np.where(np.isnan(values), -32768.0, values).astype(dtype)
    across, down = -(-w // side), -(-h // side)
    blocks = []
    for k in range(across * down):
        r, c = k // across * side, k % across * side
        x = np.zeros((side, side), dtype)
        part = out[r : r + side, c : c + side]
        x[: part.shape[0], : part.shape[1]] = part
        if predictor == 3:
            b = x.astype(">f4").view(np.uint8).reshape(side, side, 4).transpose(0, 2, 1).reshape(side, -1)
            x = np.diff(b, axis=1, prepend=np.zeros((side, 1), np.uint8)).astype(np.uint8)
        elif predictor == 2:
            x = np.diff(x, axis=1, prepend=np.zeros((side, 1), dtype)).astype(dtype)
        blocks.append(zlib.compress(x.tobytes(), 6))
    n = len(blocks)
    fields = [(WIDTH, "I", [w]), (HEIGHT, "I", [h]), (BITS, "H", [32]), (COMPRESSION, "H", [8]), (277, "H", [1]), (PREDICTOR, "H", [predictor]), (TILE_WIDTH, "I", [side]), (TILE_HEIGHT, "I", [side]), (TILE_OFFSETS, "I", [0] * n), (TILE_BYTES, "I", [len(b) for b in blocks]), (FORMAT, "H", [2 if predictor == 2 else 3]), (SCALE, "d", [step, step, 0.0]), (TIE, "d", [0.0, 0.0, 0.0, west, north, 0.0]), (NODATA, "s", [b"-32768\0"])]
    kind_of = {"H": 3, "I": 4, "d": 12, "s": 2}
    at = 8 + 2 + 12 * len(fields) + 4
    later = at
    for _, code, v in fields:
        size = len(v[0]) if code == "s" else KINDS[kind_of[code]][1] * len(v)
        later += size if size > 4 else 0
    starts = np.cumsum([later, *(len(b) for b in blocks)])[:-1].tolist()
    head, tail = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    for tag, code, v in fields:
        v = starts if tag == TILE_OFFSETS else v
        data = v[0] if code == "s" else struct.pack("<" + code * len(v), *v)
        head += struct.pack("<HHI", tag, kind_of[code], len(data) if code == "s" else len(v)) + (data.ljust(4, b"\0") if len(data) <= 4 else struct.pack("<I", at + len(tail)))
        tail += data if len(data) > 4 else b""
    return head + b"\0" * 4 + tail + b"".join(blocks)


def write_tiles(cells: DataFrame, path: str, per_degree: int, side: int = 256, predictor: int = 3) -> None:
    """One-degree tiles named by tile_key in a folder, from cells (lon, lat, value): a group for each tile, whose raster has per_degree x per_degree cells. Of cells at one place the lowest counts, so a group holds no more rows than its raster has cells. A file appears whole, by a move."""
    tile = cells.select(tile_key(F.col("lat"), F.col("lon")).alias("tile"), F.floor("lon").alias("west"), (F.floor("lat") + 1).alias("north"), "lon", "lat", "value")
    place = lambda x: F.least(F.greatest((x * per_degree).cast("int"), F.lit(0)), F.lit(per_degree - 1))
    tile = tile.groupBy("tile", "west", "north", place(F.col("north") - F.col("lat")).alias("r"), place(F.col("lon") - F.col("west")).alias("c")).agg(F.min("value").alias("value"))

    def f(pdf):
        store, root, _ = store_of(path)
        store.create_dir(root, recursive=True)
        west, north = float(pdf["west"].iloc[0]), float(pdf["north"].iloc[0])
        z = np.full((per_degree, per_degree), np.inf)
        z[pdf["r"].to_numpy(), pdf["c"].to_numpy()] = pdf["value"].fillna(np.inf).to_numpy(float)
        name, hidden = f"{pdf['tile'].iloc[0]}.tif", f"{root}/_{uuid.uuid4().hex}"
        with store.open_output_stream(hidden, compression=None) as out:
            out.write(encoded(np.where(np.isinf(z), np.nan, z), west, north, 1 / per_degree, side, predictor))
        store.move(hidden, f"{root}/{name}")
        return pdf.iloc[:1][["tile"]]

    tile.groupBy("tile").applyInPandas(f, "tile string").count()


def sample(points: DataFrame, path: str, per_degree: int, block: int = 512) -> DataFrame:
    """points (point_id, lat, lon) with elevation: the cell that holds each point, in the file of its one-degree tile; null without a file or data.

    Points are grouped by tile and by squares of `block` cells; a group reads the header of its file and the blocks that hold its points.
    """
    row = F.floor((F.floor("lat") + 1 - F.col("lat")) * per_degree).cast("int")
    col = F.floor((F.col("lon") - F.floor("lon")) * per_degree).cast("int")
    at = points.select(*points.columns, tile_key(F.col("lat"), F.col("lon")).alias("_tile"), F.least(F.greatest(row, F.lit(0)), F.lit(per_degree - 1)).alias("_r"), F.least(F.greatest(col, F.lit(0)), F.lit(per_degree - 1)).alias("_c"))
    at, names = at.withColumns({"_br": F.floor(F.col("_r") / block), "_bc": F.floor(F.col("_c") / block)}), points.columns

    def f(pdf):
        out = pdf[names].copy()
        out["elevation"] = None
        store, root, _ = store_of(path)
        try:
            stream = store.open_input_file(f"{root}/{pdf['_tile'].iloc[0]}.tif")
        except FileNotFoundError:
            return out
        with stream:
            z = Raster(stream).value(pdf["_r"].to_numpy(np.int64), pdf["_c"].to_numpy(np.int64))
        out["elevation"] = [None if np.isnan(v) else float(v) for v in z]
        return out

    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in points.schema) + ", elevation double"
    placed = at.where("_tile IS NOT NULL").groupBy("_tile", "_br", "_bc").applyInPandas(f, schema)
    return placed.union(at.where("_tile IS NULL").select(*points.columns, F.lit(None).cast("double").alias("elevation")))
