import datetime
import math

import pytest
from pyspark.sql import functions as F

from skyweave.functions import atmosphere, codec, grid, quality, temporal


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def many(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.orderBy("i").select(f(F.col("v")).alias("x")).collect()]


def test_scene_classes(spark):
    assert many(spark, range(12), "int", quality.scl_quality) == [65535, 65535, 2, 2, 0, 0, 0, 1, 65535, 65535, 65535, 0]


def test_fmask(spark):
    assert many(spark, [0, 255, 2, 1, 8, 4, 16, 64, 128, 192], "int", quality.fmask_score) == [0, 65535, 65535, 2, 2, 1, 1, 0, 1, 1]
    assert many(spark, [0, 64, 128, 255], "int", quality.fmask_clear) == [True, True, False, False]


def test_cloud_score(spark):
    assert many(spark, [1.0, 0.5, 0.0, 0.25], "double", quality.cloud_score_quality) == [0, 5000, 10000, 7500]
    assert many(spark, [math.nan, -0.1, 1.1, None], "double", quality.cloud_score_quality) == [65535] * 4


def test_encoding(spark):
    assert many(spark, [0.0, 0.1234, math.nan, None, -0.1, 6.6], "double", codec.encode) == [0, 1234, 65535, 65535, 65535, 65535]
    assert many(spark, [0.0, 12.4, 200.0, 200.1, math.nan], "double", codec.encode_uncertainty) == [0, 12, 200, 255, 255]
    assert many(spark, [1234, 65535], "int", codec.decode) == [0.1234, None]
    with pytest.raises(ValueError):
        codec.Encoding(scale=0)


def test_stride(spark):
    start, stop = F.lit("2024-07-01").cast("date"), F.lit("2024-07-31").cast("date")
    assert [d.day for d in one(spark, temporal.stride(start, stop, 7))] == [1, 8, 15, 22, 29]
    with pytest.raises(ValueError):
        temporal.stride(start, stop, 0)


def test_offsets(spark):
    rows = [("sentinel-2-l2a", "05.00", "x"), ("sentinel-2-l2a", "04.00", "x"), ("sentinel-2-l2a", "02.14", "x"), ("sentinel-2-l2a", None, "S2_N0400_x"), ("sentinel-2-l2a", None, "S2_N0214_x"), ("hls2-s30", "05.00", "x")]
    df = spark.createDataFrame(rows, "c string, b string, i string")
    out = df.select((F.lit(2000) - atmosphere.boa_offset(F.lit(2000), F.col("c"), F.col("b"), F.col("i"))).alias("o")).collect()
    assert [r["o"] for r in out] == [1000, 1000, 0, 1000, 0, 0]


def test_tiles(spark):
    assert many(spark, ["16TCN", "48MYT", "junk", "61TCN"], "string", temporal.epsg_of_tile) == [32616, 32748, None, None]
    assert many(spark, ["48MYT"], "string", lambda c: temporal.epsg_of_tile(c, True)) == [32648]
    ids = ["S2A_31TCJ_20240701_0_L2A", "HLS.S30.T31TCJ.2024183T105031.v2.0", "MCD43A4.A2024183.h18v04.061", "junk"]
    assert many(spark, ids, "string", temporal.tile_of_id) == ["31TCJ", "31TCJ", "h18v04", ""]
    assert many(spark, ids[2:3], "string", temporal.granule_day) == [datetime.date(2024, 7, 1)]


def test_periods_and_instants(spark):
    assert one(spark, temporal.interval(F.lit("2024-07-01/2024-07-31"))) == "2024-07-01T00:00:00Z/2024-07-31T23:59:59Z"
    assert one(spark, temporal.interval(F.lit("../2024-07-31"))) == "../2024-07-31T23:59:59Z"
    assert one(spark, temporal.period_label(F.lit("2024-07-01"), F.lit("2024-07-31"))) == "2024-07"
    assert one(spark, temporal.shift_month(F.lit(1), -2)) == 11
    assert temporal.range_name([("a", "b"), ("c", "d")], 3) == "a..b,c..d:sample-every-3-days"


def test_correction(spark):
    x = (F.lit(0.2) / (1 - 0.145 * F.lit(0.2)) + 0.08) / 1.27
    assert abs(one(spark, atmosphere.correct(x, F.lit(1.27), F.lit(0.08), F.lit(0.145))) - 0.2) < 1e-12
    assert one(spark, atmosphere.correct(F.lit(math.nan), F.lit(1.27), F.lit(0.08), F.lit(0.145))) is None
    assert one(spark, atmosphere.correct(F.lit(0.0), F.lit(1.27), F.lit(0.08), F.lit(0.145))) == 0.0
    arr = F.array(F.lit(0.1), F.lit(0.2))
    assert len(one(spark, atmosphere.correct_stack(arr, arr, arr, arr))) == 2


def test_interpolation(spark):
    nodes, values = F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), F.array(F.lit(10.0), F.lit(20.0), F.lit(0.0))
    assert [one(spark, atmosphere.interpolate(nodes, values, F.lit(w))) for w in (0.0, 1.5, 3.0, 9.0)] == [10.0, 15.0, 10.0, 0.0]
    empty = F.array().cast("array<double>")
    assert tuple(one(spark, atmosphere.coefficients(empty, empty, empty, empty, F.lit(1.0)))) == (1.0, 0.0, 0.0)


def test_transfer_inverts(spark):
    o = atmosphere.optics(F.lit(0.3), F.lit(0.49))
    toa = atmosphere.forward(F.lit(0.1), o["path"], o["transmission"], o["albedo"])
    assert abs(one(spark, atmosphere.inverse(toa, o["path"], o["transmission"], o["albedo"])) - 0.1) < 1e-9


def test_known_grid():
    g = grid.Grid.from_wgs84((30.5, 30.5, 31.6, 31.5), 60)
    assert (g.crs, g.west, g.south, g.east, g.north, g.width, g.height) == (32636, 260040, 3375000, 367080, 3487740, 1784, 1879)
    with pytest.raises(ValueError):
        grid.Grid(0, 0, -1, 1, 32636, 10)
    with pytest.raises(ValueError):
        grid.Grid.from_wgs84((0, 0, 1, 1), 60, output="other")


def test_projection_columns(spark):
    got = one(spark, grid.project_columns(F.lit(31.0), F.lit(31.0), F.lit(32636)))
    assert abs(got["x"] - grid.project(31.0, 31.0, 32636)[0]) < 1e-6
    assert abs(got["y"] - grid.project(31.0, 31.0, 32636)[1]) < 1e-6
    south = one(spark, grid.project_columns(F.lit(31.0), F.lit(-31.0), F.lit(32736)))
    assert abs(south["y"] - grid.project(31.0, -31.0, 32736)[1]) < 1e-6


def test_chunks(spark):
    chunks = one(spark, grid.chunk_layout(F.lit(700), F.lit(1300), 512))
    assert len(chunks) == 6 and {c["height"] for c in chunks} == {512, 188} and {c["width"] for c in chunks} == {512, 276}
    assert grid.snap_chunk(600, 256) == 512 and grid.snap_chunk(128, 256) == 256
    assert one(spark, grid.overlapped_chunks(F.lit(1), F.lit(0), 8, 10, 5)) == [0, 5]


@pytest.mark.parametrize("crs", [32636, 32736, grid.SINUSOIDAL])
def test_projection_round_trip(spark, crs):
    for lon, lat in ((30.5, 31.0), (33.0, -12.0), (35.9, 60.0)):
        back = grid.unproject(*grid.project(lon, lat, crs), crs)
        assert abs(back[0] - lon) < 1e-9 and abs(back[1] - lat) < 1e-9
    if crs != grid.SINUSOIDAL:
        x, y = grid.project(33.0, 12.0, crs)
        got = one(spark, grid.unproject_columns(F.lit(x), F.lit(y), crs))
        assert abs(got["lon"] - 33.0) < 1e-9 and abs(got["lat"] - 12.0) < 1e-9


def test_positions_across_systems(spark):
    a = grid.Grid(500000, 3300000, 501000, 3301000, 32636, 10)
    b = grid.Grid(*grid.snap(grid.project_bounds(grid.wgs84_bounds(a), grid.SINUSOIDAL), 10), grid.SINUSOIDAL, 10)
    row, col = one(spark, F.struct(*grid.source_position(a, b, F.lit(50), F.lit(50))))
    lon, lat = grid.unproject(500505, 3300495, 32636)
    x, y = grid.project(lon, lat, grid.SINUSOIDAL)
    assert abs(row - (b.north - y) / 10) < 1e-6 and abs(col - (x - b.west) / 10) < 1e-6
    same = one(spark, F.struct(*grid.source_position(a, a, F.lit(3), F.lit(4))))
    assert tuple(same) == (3.5, 4.5)


def test_chunk_rows_are_the_layout_of_every_grid(spark):
    sizes = [(1, 700, 1300), (2, 512, 512), (3, 1, 1), (4, 5, 0), (5, 1025, 513), (6, 0, 9)]
    grids = spark.createDataFrame(sizes, "g int, h int, w int")
    got = {tuple(r) for r in grid.chunk_rows(grids, 512).collect()}
    want = {(g, r * -(-w // 512) + c, r * 512, c * 512, min(512, h - r * 512), min(512, w - c * 512)) for g, h, w in sizes for r in range(-(-h // 512)) for c in range(-(-w // 512))}
    assert got == want
    # rows of one large grid are dealt, so its chunks are in several tasks and in no array
    large = grid.chunk_rows(spark.createDataFrame([(1, 300_000, 500_000)], "g int, h int, w int"), 512)
    parts = large.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 586 * 977 and len(parts) > 4
