"""GeoTIFF, terrain mosaics and GeoJSON lines: exact round trips and values by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.sources import captures, logs, rasters


def test_geotiff_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    cells = [(r, c, float(np.float32(rng.normal()))) for r in range(9) for c in range(7) if rng.random() < 0.8]
    grid = spark.createDataFrame(cells, "row long, col long, cell_value double")
    for r in rasters.raster_files(grid, 52.0, 5.0, 0.25, edge=4).collect():
        (tmp_path / f"{r.tile_row}-{r.tile_col}.tif").write_bytes(bytes(r.content))
    got = rasters.rasters(spark.read.format("binaryFile").load(str(tmp_path)))
    back = got.select(
        F.round((52.0 - F.col("north")) / 0.25).cast("long") + F.col("row"), F.round((F.col("west") - 5.0) / 0.25).cast("long") + F.col("col"),
        "cell_value"
    )
    assert sorted(map(tuple, back.collect())) == sorted(cells) and {x.size_deg for x in got.collect()} == {0.25}


def test_geotiff_refusals():
    good = rasters.geotiff_bytes(np.array([[1.0, np.nan]]), 10, 20, 0.5)
    north, west, size, values = rasters.parse_geotiff(good)
    assert (north, west, size) == (10.0, 20.0, 0.5) and values[0, 0] == 1 and math.isnan(values[0, 1])
    with pytest.raises(ValueError, match="not a TIFF"):
        rasters.parse_geotiff(b"PK" + good[2:])
    at = good.index((259).to_bytes(2, "little")) + 8
    with pytest.raises(ValueError, match="uncompressed"):
        rasters.parse_geotiff(good[:at] + b"\x05" + good[at + 1 :])


def test_mosaic(spark):
    heights = {(50, 5): np.arange(121.0).reshape(11, 11), (51, 5): np.full((11, 11), 700.0)}
    tiles = spark.createDataFrame([(f"{s}", bytearray(captures.write_dted(s, w, h))) for (s, w), h in heights.items()], "path string, content binary")
    points = [(1, 50.05, 5.15), (2, 51.5, 5.5), (3, 60.0, 5.0), (4, 50.0, 5.0)]
    got = {r.id: r.height_m for r in rasters.mosaic_elevation(spark.createDataFrame(points, "id long, lat double, lon double"), tiles).collect()}
    assert got[2] == 700 and got[3] is None and got[4] == 0
    assert got[1] == pytest.approx(captures.elevation(50, 5, heights[50, 5], 50.05, 5.15))


def test_geojson_lines(spark, tmp_path):
    rows = spark.createDataFrame(
        [('{"type":"Point","coordinates":[5,52]}', "a"), ('{"type":"Point","coordinates":[6,53]}', "b")], "g string, name string"
    )
    path = str(tmp_path / "f")
    rasters.geojson_lines(rows, logs.feature(F.col("g"), F.create_map(F.lit("name"), F.col("name")), F.lit("measured")), path)
    (tmp_path / "f" / "extra.txt").write_text("not json\n")
    got = rasters.read_geojson_lines(spark, path).collect()
    assert {r.properties["name"] for r in got} == {"a", "b"} and all(r.properties["tier"] == "measured" and "Point" in r.geometry for r in got)
