"""Rasters as compressed GeoTIFF tiles with a mosaic over them: a data source that executors write and read.

`write_raster` gathers pixels by tile, at most size x size of them, and every task writes
its tiles into a folder of the job.  The mosaic (a VRT file, which names the tiles) is
written last, by the commit: readers only know tiles that it names, so a job that
fails leaves the raster as it was, and takes its tiles away again.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree as ET

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from hydroframe.operators.raster import NODATA, Grid

# Tags of TIFF and GeoTIFF, and of the library that made "no data" a tag.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, BYTES, PLANAR, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA_TEXT = 33550, 33922, 34735, 42113
#: Types of values: code, format, bytes.
SHORT, LONG, DOUBLE, ASCII = (3, "H", 2), (4, "I", 4), (12, "d", 8), (2, "c", 1)
DEFLATE, FLOAT, SEPARATE = 8, 3, 2


def encode(bands: np.ndarray, x: float, y: float, size: float, epsg: int | None = None, nodata: float = NODATA) -> bytes:
    """A GeoTIFF of bands (band, row, col), upper left corner x, y: one deflated strip of 64-bit floats a band."""
    n, height, width = bands.shape
    strips = [zlib.compress(np.ascontiguousarray(b, "<f8").tobytes(), 6) for b in bands]
    tags = {
        WIDTH: (LONG, [width]), HEIGHT: (LONG, [height]), BITS: (SHORT, [64] * n), COMPRESSION: (SHORT, [DEFLATE]), PHOTOMETRIC: (SHORT, [1]), STRIPS: (LONG, [0] * n), SAMPLES: (SHORT, [n]), ROWS: (LONG, [height]),
        BYTES: (LONG, [len(s) for s in strips]), PLANAR: (SHORT, [SEPARATE]), FORMAT: (SHORT, [FLOAT] * n), PIXEL_SCALE: (DOUBLE, [size, size, 0.0]), TIE_POINT: (DOUBLE, [0.0, 0.0, 0.0, x, y, 0.0]),
        GEO_KEYS: (SHORT, [1, 1, 0, 2, 1024, 0, 1, 1, 1025, 0, 1, 1] if epsg is None else [1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, epsg]), NODATA_TEXT: (ASCII, [bytes([c]) for c in repr(nodata).encode() + b"\0"]),
    }
    far = 8 + 2 + 12 * len(tags) + 4  # what doesn't fit into a tag's four bytes comes after the tags, then the strips
    place = far + sum(len(v) * k[2] + (len(v) * k[2]) % 2 for k, v in tags.values() if len(v) * k[2] > 4)
    tags[STRIPS] = (LONG, [place + sum(len(s) for s in strips[:i]) for i in range(n)])
    head, more = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for tag, ((code, form, size_of), values) in sorted(tags.items()):
        raw = struct.pack(f"<{len(values)}{form}", *values)
        if len(raw) > 4:
            at = far + len(more)
            more += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", at)
        head += struct.pack("<HHI", tag, code, len(values)) + raw.ljust(4, b"\0")
    return head + struct.pack("<I", 0) + more + b"".join(strips)


def decode(data: bytes) -> np.ndarray:
    """bands (band, row, col) of a file as `encode` writes it."""
    order, magic, at = struct.unpack_from("<2sHI", data)
    if order != b"II" or magic != 42:
        raise ValueError("not a little-endian TIFF")
    tags = {}
    for i in range(struct.unpack_from("<H", data, at)[0]):
        tag, code, n = struct.unpack_from("<HHI", data, at + 2 + 12 * i)
        kind = {k[0]: k for k in (SHORT, LONG, DOUBLE, ASCII)}.get(code)
        if kind:
            place = at + 10 + 12 * i if n * kind[2] <= 4 else struct.unpack_from("<I", data, at + 10 + 12 * i)[0]
            tags[tag] = struct.unpack_from(f"<{n}{kind[1]}", data, place)
    if tags[COMPRESSION][0] != DEFLATE or set(tags[BITS]) != {64} or tags[PLANAR][0] != SEPARATE:
        raise ValueError("another kind of TIFF than is written here")
    strips = [zlib.decompress(data[a : a + n]) for a, n in zip(tags[STRIPS], tags[BYTES], strict=True)]
    return np.stack([np.frombuffer(s, "<f8").reshape(tags[HEIGHT][0], tags[WIDTH][0]) for s in strips])


def tiles(pixels: DataFrame, grid: Grid, bands: list[str], size: int = 256, epsg: int | None = None, nodata: float = NODATA) -> DataFrame:
    """tile_row, tile_col, data: a GeoTIFF of every tile that has a pixel.

    Of pixels that repeat the greatest value stays; missing values are nodata.
    """
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    each = pixels.groupBy(at("row").alias("tile_row"), at("col").alias("tile_col"), "row", "col").agg(*(F.max(F.col(b).cast("double")).alias(b) for b in bands))
    place = ((F.col("row") - F.col("tile_row") * size) * size + F.col("col") - F.col("tile_col") * size).cast("int")
    values = [F.coalesce(F.nanvl(F.col(b), F.lit(nodata)), F.lit(nodata)).alias(f"b{i}") for i, b in enumerate(bands)]
    whole = each.groupBy("tile_row", "tile_col").agg(F.collect_list(F.struct(place.alias("at"), *values)).alias("p"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row, col, p = batch.slice(i, 1).columns
                flat = p.flatten()
                block = np.full((len(bands), size * size), nodata)
                for k in range(len(bands)):
                    block[k, flat.field("at").to_numpy()] = flat.field(f"b{k}").to_numpy()
                r, c = row[0].as_py(), col[0].as_py()
                data = encode(block.reshape(-1, size, size), grid.x + c * size * grid.size, grid.y - r * size * grid.size, grid.size, epsg, nodata)
                yield pa.RecordBatch.from_pydict({"tile_row": row, "tile_col": col, "data": pa.array([data], pa.binary())})

    return whole.mapInArrow(made, "tile_row int, tile_col int, data binary")


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The tiles of a task: row, col, file."""

    tiles: list[tuple[int, int, str]]


class TileWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.job, self.overwrite = options["path"].rstrip("/"), f"tiles-{uuid.uuid4().hex}", overwrite
        self.size, self.bands = int(options["size"]), options["bands"].split(",")
        self.grid = tuple(float(options[k]) for k in ("x", "y", "pixel", "nodata"))

    def write(self, iterator: Iterator) -> Written:
        disk, top = _files(self.path)
        disk.create_dir(f"{top}/{self.job}", recursive=True)
        done: list[tuple[int, int, str]] = []
        try:
            for row in iterator:
                name = f"{self.job}/{row['tile_row']}_{row['tile_col']}_{uuid.uuid4().hex[:8]}.tif"  # a task that is tried again has names of its own
                done.append((row["tile_row"], row["tile_col"], name))
                with disk.open_output_stream(f"{top}/{name}") as out:
                    out.write(bytes(row["data"]))
        except BaseException:
            for *_, name in done:
                if disk.get_file_info(f"{top}/{name}").type != fs.FileType.NotFound:
                    disk.delete_file(f"{top}/{name}")
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        disk, top = _files(self.path)
        before = mosaic(self.path) if disk.get_file_info(f"{top}/mosaic.vrt").type == fs.FileType.File else None
        made = sorted(t for m in messages if m is not None for t in m.tiles)
        if before is not None and not self.overwrite:
            if (before.size, before.bands, before.grid) != (self.size, self.bands, self.grid):
                raise ValueError("tiles of another grid, size or other bands can't be appended")
            new = {t[:2] for t in made}
            made = sorted(made + [t for t in before.tiles if t[:2] not in new])
        with disk.open_output_stream(f"{top}/.mosaic-{self.job}") as out:
            out.write(Mosaic(self.size, self.bands, self.grid, made).xml())
        disk.move(f"{top}/.mosaic-{self.job}", f"{top}/mosaic.vrt")
        used = {posixpath.dirname(name) for *_, name in made}
        for old in {posixpath.dirname(name) for *_, name in before.tiles} - used if before is not None else ():
            disk.delete_dir(f"{top}/{old}")

    def abort(self, messages: list[Written | None]) -> None:
        disk, top = _files(self.path)
        if disk.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            disk.delete_dir(f"{top}/{self.job}")


@dataclass
class Mosaic:
    """Tiles side by side: pixels of a tile, names of bands, (x, y, pixel, nodata), and (row, col, file) of each."""

    size: int
    bands: list[str]
    grid: tuple[float, ...]
    tiles: list[tuple[int, int, str]]

    def xml(self) -> bytes:
        x, y, pixel, nodata = self.grid
        rows, cols = [t[0] for t in self.tiles] or [0], [t[1] for t in self.tiles] or [0]
        r0, c0, size = min(rows), min(cols), self.size
        top = ET.Element("VRTDataset", rasterXSize=str((max(cols) - c0 + 1) * size), rasterYSize=str((max(rows) - r0 + 1) * size))
        ET.SubElement(top, "GeoTransform").text = f"{x + c0 * size * pixel!r}, {pixel!r}, 0.0, {y - r0 * size * pixel!r}, 0.0, {-pixel!r}"
        about = ET.SubElement(top, "Metadata")
        for key, value in {"first_row": r0, "first_col": c0, "tile": size, "x": x, "y": y, "pixel": pixel, "nodata": nodata}.items():
            ET.SubElement(about, "MDI", key=key).text = repr(value)
        for i, band in enumerate(self.bands, 1):
            node = ET.SubElement(top, "VRTRasterBand", dataType="Float64", band=str(i))
            ET.SubElement(node, "Description").text = band
            ET.SubElement(node, "NoDataValue").text = repr(nodata)
            for row, col, name in self.tiles:
                source = ET.SubElement(node, "SimpleSource")
                ET.SubElement(source, "SourceFilename", relativeToVRT="1").text = name
                ET.SubElement(source, "SourceBand").text = str(i)
                ET.SubElement(source, "SrcRect", xOff="0", yOff="0", xSize=str(size), ySize=str(size))
                ET.SubElement(source, "DstRect", xOff=str((col - c0) * size), yOff=str((row - r0) * size), xSize=str(size), ySize=str(size))
        return ET.tostring(top)


def mosaic(path: str) -> Mosaic:
    """What the mosaic of a raster names."""
    disk, top = _files(path.rstrip("/"))
    with disk.open_input_stream(f"{top}/mosaic.vrt") as f:
        tree = ET.fromstring(f.read())
    about = {x.get("key"): x.text for x in tree.iter("MDI")}
    size, r0, c0 = (int(about[k]) for k in ("tile", "first_row", "first_col"))
    bands = tree.findall("VRTRasterBand")
    named = [(x.find("DstRect"), x.findtext("SourceFilename")) for x in bands[0].findall("SimpleSource")] if bands else []
    return Mosaic(size, [b.findtext("Description") for b in bands], tuple(float(about[k]) for k in ("x", "y", "pixel", "nodata")), [(r0 + int(d.get("yOff")) // size, c0 + int(d.get("xOff")) // size, name) for d, name in named])


@dataclass
class Tiles(InputPartition):
    files: list[tuple[int, int, str]]


class TileReader(DataSourceReader):
    """Tiles by task; filters on row and col leave tiles out before they are opened."""

    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"].rstrip("/"), int(options.get("tilesPerTask", 64))
        self.mosaic = mosaic(self.path)
        self.bounds = {"row": [-(2**31), 2**31], "col": [-(2**31), 2**31]}  # inclusive

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in self.bounds and not (isinstance(f, In) and not f.value):
                low, high = self.bounds[name]
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, f.value - isinstance(f, LessThan))
                if isinstance(f, In):
                    low, high = max(low, min(f.value)), min(high, max(f.value))
                self.bounds[name] = [low, high]
            yield f  # Spark still tests every pixel

    def partitions(self) -> list[Tiles]:
        size, (r0, r1), (c0, c1) = self.mosaic.size, self.bounds["row"], self.bounds["col"]
        asked = [t for t in self.mosaic.tiles if t[0] * size <= r1 and (t[0] + 1) * size > r0 and t[1] * size <= c1 and (t[1] + 1) * size > c0]
        return [Tiles(asked[i : i + self.most]) for i in range(0, len(asked), self.most)] or [Tiles([])]

    def read(self, partition: Tiles) -> Iterator[pa.RecordBatch]:
        disk, top = _files(self.path)
        size, nodata, names = self.mosaic.size, self.mosaic.grid[3], ["row", "col", *self.mosaic.bands]
        for row, col, name in partition.files:
            with disk.open_input_stream(f"{top}/{name}") as f:
                bands = decode(f.read())
            r, c = np.nonzero((bands != nodata).any(axis=0))
            values = [pa.array(b[r, c], pa.float64(), mask=b[r, c] == nodata) for b in bands]
            yield pa.RecordBatch.from_arrays([pa.array((row * size + r).astype(np.int32)), pa.array((col * size + c).astype(np.int32)), *values], names)


class GeoTiffSource(DataSource):
    """`hydro_geotiff`: tiles (tile_row, tile_col, data) in, pixels (row, col, bands) out."""

    @classmethod
    def name(cls) -> str:
        return "hydro_geotiff"

    def schema(self) -> str:
        return "row int, col int, " + ", ".join(f"`{b}` double" for b in mosaic(self.options["path"]).bands)

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> TileWriter:
        return TileWriter(self.options, overwrite)


def write_raster(pixels: DataFrame, grid: Grid, bands: list[str], path: str, size: int = 256, epsg: int | None = None, nodata: float = NODATA, mode: str = "overwrite") -> None:
    """Pixels (row, col, bands) as GeoTIFF tiles and a mosaic in a folder; mode append replaces tiles that it has."""
    pixels.sparkSession.dataSource.register(GeoTiffSource)
    options = {"size": size, "bands": ",".join(bands), "x": grid.x, "y": grid.y, "pixel": grid.size, "nodata": nodata}
    tiles(pixels, grid, bands, size, epsg, nodata).write.format("hydro_geotiff").options(**options).mode(mode).save(path)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """row, col and bands of a raster's pixels that have a value."""
    spark.dataSource.register(GeoTiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("hydro_geotiff").load(path)
