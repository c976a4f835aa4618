"""GeoTIFF rasters: read by Spark's reader of binary files into long form, written as a file of bounded size."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Affine = tuple[float, float, float, float, float, float]

#: Fixed values of the format: field types (code: struct letter and size) and the tags used here.
TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, TRANSFORM, KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735, 42113
PROJECTED, GEOGRAPHIC = 3072, 2048
KINDS = {1: "u", 2: "i", 3: "f"}

#: Pixels of all bands that write_geotiff gathers at most; larger rasters are for Parquet.
LARGEST = 200_000_000


@dataclass
class Raster:
    """bands: (band, row, column); affine: x' = a x + b y + c, y' = d x + e y + f of a pixel's corner."""

    bands: np.ndarray
    affine: Affine | None = None
    epsg: int | None = None
    nodata: float | None = None


def _tags(content: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(content[:2])
    if order is None or struct.unpack(order + "H", content[2:4])[0] != 42:
        raise ValueError("no TIFF file")
    at = struct.unpack(order + "I", content[4:8])[0]
    found = {}
    for k in range(struct.unpack(order + "H", content[at : at + 2])[0]):
        tag, kind, count = struct.unpack(order + "HHI", content[at + 2 + 12 * k : at + 10 + 12 * k])
        if kind not in TYPES:
            continue
        letter, size = TYPES[kind]
        place = at + 10 + 12 * k
        if size * count > 4:
            place = struct.unpack(order + "I", content[place : place + 4])[0]
        raw = content[place : place + size * count]
        found[tag] = (raw.rstrip(b"\0").decode("ascii", "replace"),) if letter == "s" else struct.unpack(order + letter * count, raw)
    return order, found


def decode(content: bytes) -> Raster:
    """The first image of a file: strips or tiles, plain or deflated, whole numbers or floats of 8 to 64 bits."""
    order, tags = _tags(content)
    one = lambda tag, other=None: tags.get(tag, (other,))[0]
    width, height, samples, planar = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(PLANAR, 1)
    if one(COMPRESSION, 1) not in (1, 8, 32946):
        raise ValueError(f"compression {one(COMPRESSION)} is not supported")
    if one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"predictor {one(PREDICTOR)} is not supported")
    kind = np.dtype(f"{order}{KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
    tiled = TILES in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    across, down, deep = -(-width // w), -(-height // h), samples if planar == 1 else 1
    out = np.zeros((samples, height, width), dtype=kind.newbyteorder("="))
    for k, (at, size) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        raw = content[at : at + size]
        if one(COMPRESSION, 1) != 1:
            raw = zlib.decompress(raw)
        plane, place = divmod(k, across * down)
        y, x = (place // across) * h, (place % across) * w
        rows = h if tiled else min(h, height - y)
        part = np.frombuffer(raw, dtype=kind, count=rows * w * deep).reshape(rows, w, deep)
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=kind)
        part = part[: height - y, : width - x].transpose(2, 0, 1)
        out[plane : plane + 1 if planar == 2 else samples, y : y + part.shape[1], x : x + part.shape[2]] = part
    affine = None
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in tags and TIEPOINT in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags[SCALE], tags[TIEPOINT]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = tags.get(KEYS, ())
    codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}
    return Raster(out, affine, codes.get(PROJECTED, codes.get(GEOGRAPHIC)), float(one(NODATA)) if NODATA in tags else None)


def encode(raster: Raster, rows: int = 256) -> bytes:
    """A deflated file with a plane for each band, in strips of `rows` rows."""
    bands = np.ascontiguousarray(raster.bands, dtype=raster.bands.dtype.newbyteorder("<"))
    n, height, width = bands.shape
    kind = {v: k for k, v in KINDS.items()}[bands.dtype.kind]
    strips = [zlib.compress(band[y : y + rows].tobytes()) for band in bands for y in range(0, height, rows)]
    tags: dict[int, tuple[int, tuple | bytes]] = {
        WIDTH: (4, (width,)), HEIGHT: (4, (height,)), BITS: (3, (bands.dtype.itemsize * 8,) * n), COMPRESSION: (3, (8,)), PHOTOMETRIC: (3, (1,)),
        SAMPLES: (3, (n,)), ROWS: (4, (rows,)), STRIP_BYTES: (4, tuple(map(len, strips))), PLANAR: (3, (2,)), FORMAT: (3, (kind,) * n), STRIPS: (4, (0,) * len(strips)),
    }
    if raster.affine:
        a, b, c, d, e, f = raster.affine
        if b or d or e > 0:
            tags[TRANSFORM] = (12, (a, b, 0.0, c, d, e, 0.0, f, *[0.0] * 7, 1.0))
        else:
            tags |= {SCALE: (12, (a, -e, 0.0)), TIEPOINT: (12, (0.0, 0.0, 0.0, c, f, 0.0))}
    if raster.epsg:
        geographic = 4000 <= raster.epsg < 5000
        tags[KEYS] = (3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, raster.epsg))
    if raster.nodata is not None:
        tags[NODATA] = (2, f"{raster.nodata:.17g}".encode() + b"\0")
    head = 8 + 2 + 12 * len(tags) + 4
    packed = {t: v if k == 2 else struct.pack("<" + TYPES[k][0] * len(v), *v) for t, (k, v) in tags.items()}
    data = head + sum(len(x) + len(x) % 2 for x in packed.values() if len(x) > 4)
    places = np.cumsum([data, *map(len, strips)])[:-1]
    packed[STRIPS] = struct.pack("<" + "I" * len(strips), *places.tolist())
    entries, tail, at = b"", b"", head
    for t in sorted(tags):
        x = packed[t]
        value = x.ljust(4, b"\0")
        if len(x) > 4:
            value, tail, at = struct.pack("<I", at), tail + x + b"\0" * (len(x) % 2), at + len(x) + len(x) % 2
        entries += struct.pack("<HHI", t, tags[t][0], len(tags[t][1])) + value
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + tail + b"".join(strips)


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """path, band (from 1), y, x, v of every pixel of the files; v is null where a file says it has no data,
    and for NaN.  A task decodes a file at a time."""

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                raster = decode(content)
                width = raster.bands.shape[2]
                step = max(1, 1_000_000 // max(width, 1))
                for k, band in enumerate(raster.bands, 1):
                    for top in range(0, len(band), step):
                        part = band[top : top + step]
                        v = part.astype(float).ravel()
                        out = np.isnan(v) if raster.nodata is None else np.isnan(v) | (v == raster.nodata)
                        y, x = np.indices(part.shape).reshape(2, -1)
                        yield pd.DataFrame({"path": name, "band": k, "y": y + top, "x": x, "v": pd.Series(v).mask(out).astype("Float64")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pixels, "path string, band int, y int, x int, v double")


def read_affine(spark: SparkSession, path: str) -> tuple[Affine | None, int | None, tuple[int, int]]:
    """A file's affine, EPSG code and shape."""
    raster = decode(spark.read.format("binaryFile").load(path).select("content").first()[0])
    return raster.affine, raster.epsg, raster.bands.shape[1:]


def write_geotiff(pixels: DataFrame, path: str, shape: tuple[int, int], affine: Affine | None = None, epsg: int | None = None, nodata: float | None = None, kind: str = "float32") -> None:
    """`pixels` (band from 1, y, x, v) as one file, by the file system that the path names; missing pixels and
    nulls are `nodata` (default: NaN, 0 for whole numbers).  One file is made in one place: rasters of more than
    LARGEST pixels raise, and are for Parquet."""
    bands = pixels.agg(F.max("band")).first()[0] or 1
    if bands * shape[0] * shape[1] > LARGEST:
        raise ValueError(f"{bands} bands of {shape} are too many pixels for one file")
    out = np.full((bands, *shape), nodata if nodata is not None else np.nan if np.dtype(kind).kind == "f" else 0, dtype=kind)
    rows = pixels.where(F.col("v").isNotNull() & F.col("y").between(0, shape[0] - 1) & F.col("x").between(0, shape[1] - 1)).select("band", "y", "x", "v").toPandas()
    out[rows["band"] - 1, rows["y"], rows["x"]] = rows["v"]
    spark = pixels.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(encode(Raster(out, affine, epsg, nodata))))
    stream.close()


def read_stack(spark: SparkSession, path: str) -> DataFrame:
    """A file's bands as the scenes 0, 1, ... of a stack: scene, y, x, v."""
    return read_geotiff(spark, path).select((F.col("band") - 1).alias("scene"), "y", "x", "v")
