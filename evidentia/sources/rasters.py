"""Grids as files: GeoTIFF in and out, mosaics of terrain tiles, and GeoJSON text sequences.

Files are read where ``binaryFile`` or ``text`` deals them; a grid is written as one file a tile, so no file or group
holds more than a tile.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.sources.captures import read_dted

# Tags and types of TIFF 6.0 and GeoTIFF 1.1.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _PHOTOMETRIC, _OFFSETS, _SAMPLES, _ROWS, _SIZES, _FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 339
_SCALE, _TIE, _KEYS, _NODATA = 33550, 33922, 34735, 42113
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 12: "d"}


def geotiff_bytes(values: np.ndarray, north: float, west: float, size_deg: float, nodata: float = -9999.0) -> bytes:
    """One band of 32-bit floats in degrees, rows from the north; NaN is written as ``nodata``."""
    rows, cols = values.shape
    data = np.where(np.isnan(values), nodata, values).astype("<f4").tobytes()
    # Geographic coordinates, pixels are areas, WGS 84.
    keys = (1, 1, 0, 3, 1024, 0, 1, 2, 1025, 0, 1, 1, 2048, 0, 1, 4326)
    tags = [
        (_WIDTH, 4, (cols,)), (_HEIGHT, 4, (rows,)), (_BITS, 3, (32,)), (_COMPRESSION, 3, (1,)), (_PHOTOMETRIC, 3, (1,)), (_OFFSETS, 4, (0,)), (_SAMPLES, 3, (1,)), (_ROWS, 4, (rows,)), (_SIZES, 4, (len(data),)),
        (_FORMAT, 3, (3,)), (_SCALE, 12, (size_deg, size_deg, 0.0)), (
            _TIE, 12, (0.0, 0.0, 0.0, west, north, 0.0)
        ), (_KEYS, 3, keys), (_NODATA, 2, f"{nodata:g}".encode() + b"\0"),
    ]
    at, extra, entries = 8 + 2 + 12 * len(tags) + 4, b"", []
    for tag, kind, value in tags:
        raw = value if kind == 2 else struct.pack(f"<{len(value)}{_TYPES[kind]}", *value)
        if len(raw) > 4:
            entries.append((tag, kind, len(value), struct.pack("<I", at + len(extra))))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            entries.append((tag, kind, len(value), raw.ljust(4, b"\0")))
    begin = at + len(extra)
    head = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(tags))
    for tag, kind, count, raw in entries:
        head += struct.pack("<HHI", tag, kind, count) + (struct.pack("<I", begin) if tag == _OFFSETS else raw)
    return head + struct.pack("<I", 0) + extra + data


def parse_geotiff(data: bytes) -> tuple[float, float, float, np.ndarray]:
    """North, west, cell size and values (NaN where there are none) of an uncompressed single band; anything else is refused."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, count = struct.unpack(order + "HHI", entry[:8])
        if kind not in _TYPES:
            continue
        size = struct.calcsize(_TYPES[kind]) * count
        raw = entry[8 : 8 + size] if size <= 4 else data[(o := struct.unpack(order + "I", entry[8:])[0]) : o + size]
        tags[tag] = raw.rstrip(b"\0 ") if kind == 2 else struct.unpack(f"{order}{count}{_TYPES[kind]}", raw)
    if tags.get(_COMPRESSION, (1,))[0] != 1 or tags.get(_SAMPLES, (1,))[0] != 1 or _SCALE not in tags or _TIE not in tags:
        raise ValueError("only uncompressed single bands with a scale and a tie point are read")
    kind = {(1, 8): "u1", (1, 16): "u2", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((tags.get(_FORMAT, (1,))[0], tags[_BITS][0]))
    if kind is None:
        raise ValueError("unknown kind of sample")
    raw = b"".join(data[o : o + n] for o, n in zip(tags[_OFFSETS], tags[_SIZES], strict=True))
    values = np.frombuffer(raw, order + kind).reshape(tags[_HEIGHT][0], tags[_WIDTH][0]).astype(np.float64)
    if _NODATA in tags:
        values = np.where(values == float(tags[_NODATA]), np.nan, values)
    x, y, west, north = tags[_TIE][0], tags[_TIE][1], tags[_TIE][3], tags[_TIE][4]
    dx, dy = tags[_SCALE][:2]
    return north + y * dy, west - x * dx, dx, values


def rasters(files: DataFrame) -> DataFrame:
    """path, north, west, size_deg, row, col, cell_value of GeoTIFF files read as ``binaryFile``; cells without a value are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                north, west, size, values = parse_geotiff(content)
                row, col = np.nonzero(~np.isnan(values))
                n = len(row)
                cols = [
                    pa.array([path] * n, pa.string()), *(pa.array(np.full(n, v)) for v in (north, west, size)), pa.array(row), pa.array(col),
                    pa.array(values[row, col])
                ]
                yield pa.RecordBatch.from_arrays(cols, ["path", "north", "west", "size_deg", "row", "col", "cell_value"])

    return files.select("path", "content").mapInArrow(
        run, "path string, north double, west double, size_deg double, row long, col long, cell_value double"
    )


def raster_files(cells: DataFrame, north: float, west: float, size_deg: float, edge: int = 512) -> DataFrame:
    """tile_row, tile_col, content: the cells (row, col, cell_value) of a grid as GeoTIFF files of at most ``edge`` cells a side."""

    def build(group: pa.Table) -> pa.Table:
        tr, tc = group.column("tile_row")[0].as_py(), group.column("tile_col")[0].as_py()
        values = np.full((edge, edge), np.nan)
        values[group.column("row").to_numpy() - tr * edge, group.column("col").to_numpy() - tc * edge] = group.column("cell_value").to_numpy()
        content = geotiff_bytes(values, north - tr * edge * size_deg, west + tc * edge * size_deg, size_deg)
        return pa.table({"tile_row": [tr], "tile_col": [tc], "content": pa.array([content], pa.binary())})

    own = cells.select(
        F.floor(F.col("row") / edge).alias("tile_row"), F.floor(F.col("col") / edge).alias("tile_col"), F.col("row").cast("long"),
        F.col("col").cast("long"), F.col("cell_value").cast("double")
    )
    return own.groupBy("tile_row", "tile_col").applyInArrow(build, "tile_row long, tile_col long, content binary")


def mosaic_elevation(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """points (id, lat, lon) with the height of the terrain tile (path, content) of their degree, null where there is none.

    Points meet tiles by degree; a tile's points are dealt by ``PIECES``, so a tile where all points lie is no single task.
    """

    def corner(content: pd.Series) -> pd.DataFrame:
        found = [read_dted(bytes(c))[:2] for c in content]
        return pd.DataFrame({"south": [int(np.floor(s)) for s, _ in found], "west": [int(np.floor(w)) for _, w in found]})

    where = F.pandas_udf(corner, "south int, west int")
    placed = tiles.select(where("content").alias("c"), "content").select("c.south", "c.west", "content")
    placed = placed.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(PIECES - 1))))
    own = points.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    own = own.withColumns(
        {"south": F.floor("lat").cast("int"), "west": F.floor("lon").cast("int"), "piece": F.pmod(F.xxhash64("id"), F.lit(PIECES)).cast("int")}
    )

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        heights = np.full(len(left), np.nan)
        if len(left) and len(right):
            south, west, grid = read_dted(bytes(right["content"].iloc[0]))
            rows, cols = grid.shape
            y, x = (left["lat"].to_numpy() - south) * (rows - 1), (left["lon"].to_numpy() - west) * (cols - 1)
            i, j = np.minimum(y.astype(int), rows - 2), np.minimum(x.astype(int), cols - 2)
            a, b = y - i, x - j
            heights = grid[i, j] * (1 - a) * (1 - b) + grid[i + 1, j] * a * (1 - b) + grid[i, j + 1] * (1 - a) * b + grid[i + 1, j + 1] * a * b
        return pd.DataFrame({"id": left["id"], "height_m": heights})

    keys = ("south", "west", "piece")
    found = own.groupBy(*keys).cogroup(placed.groupBy(*keys)).applyInPandas(look, f"id {own.schema['id'].dataType.simpleString()}, height_m double")
    return found.withColumn("height_m", F.when(~F.isnan("height_m"), F.col("height_m")))


PIECES = 16


def geojson_lines(features: DataFrame, feature: Column, path: str) -> None:
    """One feature a line, as GeoJSON text sequences have it: many files, each written where its rows are."""
    features.select(feature.alias("value")).write.text(path)


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """geometry (JSON text) and properties of features, one a line; other lines are left out."""
    parsed = spark.read.text(path).select(F.from_json("value", "type string, geometry string, properties map<string,string>").alias("f"))
    return parsed.filter("f.type = 'Feature'").select("f.geometry", "f.properties")
