import math
import random

import pytest
from pyspark.sql import functions as F

from skyweave.functions.quality import NODATA
from skyweave.operators import asof, compare, compose, partition, resample, scout, select_scenes, spectra

OBS = "pid int, obs_order int, quality int, sample_index int, b0 double, scene_index int, chunk_id int"


def frame(spark, rows):
    return spark.createDataFrame(rows, OBS)


def test_argmin(spark):
    rows = [(0, 0, 1, 5, 0.1, 0, 0), (0, 1, 0, 9, 0.2, 1, 0), (1, 0, 0, 5, 0.1, 0, 0), (1, 1, 0, 9, 0.2, 1, 0), (2, 0, 0, 5, 0.1, 0, 0), (2, 1, 0, 2, 0.2, 1, 0), (3, 0, 0, 8, 0.1, 0, 0), (3, 1, 0, 8, 0.2, 1, 0)]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = {r["pid"]: (r["b0"], r["observation_count"]) for r in compose.best_pixel(frame(spark, rows), ["pid"], ["b0"]).collect()}
        assert got == {0: (0.2, 2), 1: (0.1, 2), 2: (0.2, 2), 3: (0.1, 2)}


def test_score_is_a_sum(spark):
    rows = [(0, 0, 0, 5, 0.1, 0, 0), (0, 1, 0, 4, 0.2, 1, 0)]
    assert compose.best_pixel(frame(spark, rows), ["pid"], ["b0"]).first()["b0"] == 0.1


def test_invalid_never_wins(spark):
    rows = [(0, 0, 0, 0, math.nan, 0, 0), (0, 1, 0, 0, math.inf, 1, 0), (0, 2, NODATA, 0, 0.3, 2, 0), (0, 3, 40000, 0, 0.4, 3, 0), (0, 4, 2, 0, 0.5, 4, 0), (1, 0, NODATA, 0, 0.1, 0, 0)]
    won = compose.best_pixel(frame(spark, rows), ["pid"], ["b0"])
    assert [(r["pid"], r["b0"], r["observation_count"]) for r in won.collect()] == [(0, 0.5, 1)]
    full = compose.full_grid(spark.range(3).select(F.col("id").cast("int").alias("pid")), won, ["pid"], {"quality": NODATA, "observation_count": 0})
    assert {r["pid"]: (r["b0"], r["quality"]) for r in full.collect()} == {0: (0.5, 2), 1: (None, NODATA), 2: (None, NODATA)}


def test_uncertainty_fallback(spark):
    obs = frame(spark, [(0, 0, 0, 0, 0.1, 0, 0), (0, 1, 1, 0, 0.2, 1, 0)])
    out = compose.relative_uncertainty(obs, ["pid"], ["b0"], compose.best_pixel(obs, ["pid"], ["b0"]).select("pid", "b0"))
    assert abs(out.first()["b0_unc"] - 50) < 1e-9


def test_spread(spark):
    obs = frame(spark, [(0, k, 0, 0, float(v), k, 0) for k, v in enumerate((1000, 1100, 1200))])
    out = compose.temporal_spread(obs, ["pid"], ["b0"], compose.best_pixel(obs, ["pid"], ["b0"]))
    assert abs(out.first()["b0_spread"] - math.hypot(100, 20)) < 1e-9


def test_legacy_carry(spark):
    obs = frame(spark, [(0, 0, 1, 7, 0.1, 0, 0), (0, 1, 0, None, 0.2, 1, 0)])
    got = compose.carried(obs, ["pid"], ["b0"], "sample_index").first()
    assert (got["sample_index"], got["winner_order"]) == (7, 1)


def stats(spark, rows):
    return spark.createDataFrame(rows, "scene_index int, chunk_id int, usable_fraction double, mean_clear double, tile string")


def picks(df):
    return [r["scene_index"] for r in df.orderBy("chunk_id", "pick").collect()]


def test_top_k(spark):
    assert picks(select_scenes.top_k_by_chunk(stats(spark, [(i, 0, 1.0, c, None) for i, c in enumerate((0.95, 0.5, 0.8, 0.1))]), 3)) == [0, 2, 1]
    usable = stats(spark, [(0, 0, 0.95, 0.95, None), (1, 0, 0.0, 0.9, None), (2, 0, 0.05, 0.05, None)])
    assert picks(select_scenes.top_k_by_chunk(select_scenes.eligible(usable), 3)) == [0, 2]
    turns = stats(spark, [(i, 0, 1.0, c, t) for i, (c, t) in enumerate([(0.99, "T"), (0.95, "T"), (0.90, "T"), (0.85, "T"), (0.4, "U")])])
    assert picks(select_scenes.top_k_by_chunk(turns, 2)) == [0, 4, 1]
    with pytest.raises(ValueError):
        select_scenes.top_k_by_chunk(turns, 0)


def test_coverage_greedy(spark):
    rows = spark.createDataFrame([(0, i, f) for i, f in enumerate((0.9, 0.5, 0.8, 0.01, 0.3))], "c int, s int, f double")
    out = select_scenes.by_coverage(rows, ["c"], "f", [F.col("s")], 0.98, 2, 8)
    assert [r["s"] for r in out.orderBy("pick").collect()] == [0, 2] or [r["s"] for r in out.orderBy("pick").collect()] == [0, 2, 1]
    assert [r["s"] for r in select_scenes.by_coverage(rows, ["c"], "f", [F.col("s")], 0.999, 2, 3).orderBy("pick").collect()] == [0, 2, 1]


def test_adaptive(spark):
    schema = "chunk_id int, tile string, scene_index int, valid_words array<bigint>, clear_words array<bigint>"
    full = (1 << 40) - 1
    half, rest = (1 << 20) - 1, full ^ ((1 << 20) - 1)

    def run(rows, **how):
        return [r["scene_index"] for r in select_scenes.adaptive(spark.createDataFrame(rows, schema), **how).orderBy("pick").collect()]

    both = [(0, "T", 0, [full], [half]), (0, "T", 1, [full], [half]), (0, "T", 2, [full], [rest])]
    assert run(both, target=0.95, least=1) == [0, 2]  # complementary
    assert run(both, target=0.4, least=2) == [0, 2]  # least scenes
    assert run(both, target=0.95, least=1, most=1) == [0]  # cap
    partial = [(0, "T", 0, [half], [half]), (0, "T", 1, [full], [half >> 1]), (0, "T", 2, [full], [rest])]
    assert run(partial, target=0.5, least=1)[0] == 2  # observers of everything first
    assert run(partial, target=0.5, least=1, prefer_full=False)[0] in (0, 2)
    assert run([(0, "T", 0, [full], [0])]) == []


def test_masks(spark):
    obs = spark.createDataFrame([(0, 0, 0, True, True), (0, 0, 0, True, False), (0, 0, 1, True, False), (0, 0, 2, False, False), (1, 0, 1, True, True)], "scene_index int, chunk_id int, cell int, valid boolean, clear boolean")
    masks = scout.cell_masks(obs, F.col("cell"), F.col("valid"), F.col("clear"))
    got = {r["scene_index"]: (r["valid_mask"], r["clear_mask"]) for r in masks.collect()}
    assert got == {0: (3, 1), 1: (2, 2)}
    assert scout.union_coverage(masks).first()["clear"] == 2


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, 100.0), (2, 1000.0)], "k int, t double")
    right = spark.createDataFrame([(10, 90.0), (11, 110.0), (12, 400.0)], "m int, u double")
    got = asof.nearest(left, right, "k", F.col("t"), F.col("u"), ["m"], "m", 50).collect()
    assert [(r["k"], r["m"], r["gap"]) for r in got] == [(1, 10, 10.0)]
    means = {r["k"]: (r["mean"], r["n"]) for r in asof.interval_mean(left, right.withColumn("v", F.col("m") * 1.0), "k", F.col("t"), F.col("u"), "v", 50).collect()}
    assert means == {1: (10.5, 2), 2: (None, 0)}


@pytest.mark.parametrize("tolerance", [0, 7, 50])
def test_asof_and_means_equal_all_pairs(spark, tolerance):
    rng = random.Random(tolerance)
    times = [float(rng.randrange(-200, 200)) for _ in range(300)] + [rng.uniform(-60, 60) for _ in range(60)] + [10.0] * 200 + [None] * 3
    left = [(rng.randrange(500), t) for t in times]
    right = [(rng.randrange(60), t, rng.choice([None, 1.0, 2.5, -4.0])) for t in (times[::2] + [rng.uniform(-300, 300) for _ in range(40)])]
    lf, rf = spark.createDataFrame(left, "k int, t double").repartition(3), spark.createDataFrame(right, "m int, u double, v double").repartition(3)
    pairs = [(k, t, m, u, v) for k, t in left for m, u, v in right if t is not None and u is not None and abs(t - u) <= tolerance]
    want = {}
    for k, t, m, u, _ in pairs:
        want[k] = min(want.get(k, (1e9, 0)), (abs(t - u), m))
    got = {r["k"]: (r["gap"], r["m"]) for r in asof.nearest(lf, rf, "k", F.col("t"), F.col("u"), ["m"], "m", tolerance).collect()}
    assert got == want
    means = {r["k"]: (r["mean"], r["n"]) for r in asof.interval_mean(lf, rf, "k", F.col("t"), F.col("u"), "v", tolerance).collect()}
    held = {k: [v for a, _, _, _, v in pairs if a == k and v is not None] for k, _ in left}
    assert set(means) == set(held)
    for k, values in held.items():
        assert means[k][1] == len(values) and (not values or abs(means[k][0] - sum(values) / len(values)) < 1e-9)


def test_comparison(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, None), (3, 4.0)], "p int, v double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.1), (2, 3.0), (3, None)], "p int, v double")
    got = compare.compare(a, b, ["p"], "v").first()
    assert (got["joint"], got["only_a"], got["only_b"]) == (2, 1, 1) and abs(got["max_abs"] - 0.1) < 1e-9


def test_knn_paths_agree(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, [rng.random() for _ in range(3)], [rng.random()]) for i in range(60)], "k int, a array<double>, t array<double>")
    ask, library = rows.where("k < 10"), rows.where("k >= 10").withColumnRenamed("k", "l")
    x = spectra.knn(ask, library, "k", "l", "a", "t", 5).orderBy("k").collect()
    y = spectra.knn(ask, library, "k", "l", "a", "t", 5, shipped=0).orderBy("k").collect()
    assert [(r["k"], round(r["prediction"][0], 9), round(r["distance"], 9)) for r in x] == [(r["k"], round(r["prediction"][0], 9), round(r["distance"], 9)) for r in y]


def test_pca(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i, (i % 3) * 0.01) for i in range(30)], "a double, b double, c double")
    mean, parts, share = spectra.principal_components(rows, ["a", "b", "c"])
    assert share[0] > 0.999
    assert spectra.subspace_residual(rows, ["a", "b", "c"], mean, parts[:2]).agg(F.max("residual")).first()[0] < 0.02


def test_partition(spark):
    chunks = spark.createDataFrame([(r * 2 + c, c * 512.0, 512.0 - r * 512.0, c * 512 + 512.0, 1024.0 - r * 512.0) for r in range(2) for c in range(2)], "chunk_id int, west double, south double, east double, north double")

    def box(x0, x1, y0=0.0, y1=1024.0):
        return [[[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]]

    def run(tiles):
        out = partition.classify(chunks, spark.createDataFrame(tiles, "tile string, rings array<array<array<double>>>"), 8.0).orderBy("chunk_id").collect()
        return [r["required"] for r in out], [r["unreachable"] for r in out]

    required, unreachable = run([("T", box(0.0, 700.0)), ("U", box(600.0, 1024.0))])
    assert required == [["T"], ["U", "T"], ["T"], ["U", "T"]] and unreachable == [0.0] * 4
    assert run([("T", box(0.0, 1024.0)), ("U", box(0.0, 1024.0))])[0] == [["T"]] * 4
    assert run([("T", box(0.0, 1024.0, 512.0, 1024.0))])[1] == [0.0, 0.0, 1.0, 1.0]


def test_bilinear_of_a_plane(spark):
    source = spark.createDataFrame([(r, c, 100 * r + 10 * c) for r in range(4) for c in range(4)], "row int, col int, v int")
    target = spark.createDataFrame([(0, 1.0, 1.0), (1, 1.5, 1.25), (2, 9.0, 1.0)], "i int, y double, x double")
    got = {r["i"]: r["v"] for r in resample.bilinear(target, source, ["i"], F.col("y"), F.col("x"), "v", 4, 4).collect()}
    assert got == {0: 55, 1: 108, 2: NODATA}
    near = {r["i"]: r["v"] for r in resample.nearest(target, source, F.col("y"), F.col("x"), "v", 255).collect()}
    assert near == {0: 110, 1: 110, 2: 255}


@pytest.mark.parametrize("mode", ["prior", "iterate", "raw"])
def test_inversion_closes_the_loop(spark, mode):
    from skyweave.functions import atmosphere
    from skyweave.operators import inversion

    rng = random.Random(3)
    anchors, targets, truth = [1.6, 2.2], [0.44, 0.49, 0.56], 0.3

    def surface(seed):
        a, b = seed
        return [0.1 + 0.4 * a, 0.05 + 0.4 * b], [0.02 + 0.1 * a, 0.03 + 0.12 * a + 0.02 * b, 0.05 + 0.1 * b]

    library = spark.createDataFrame([(i, *surface((rng.random(), rng.random()))) for i in range(400)], "lk int, anchor array<double>, target array<double>")
    scene = spark.createDataFrame([(i, 0, *surface((rng.random(), rng.random()))) for i in range(40)], "k int, cell int, anchor array<double>, target array<double>")
    toa = scene.select("k", "cell", inversion._each(F.col("anchor"), anchors, F.lit(truth), atmosphere.forward).alias("anchor"), inversion._each(F.col("target"), targets, F.lit(truth), atmosphere.forward).alias("target"))
    grid = [round(0.05 * i, 2) for i in range(1, 17)]
    out = inversion.solve(toa, library, "k", "lk", anchors, targets, grid, mode, F.lit(0.3) if mode == "prior" else None, pool="cell").first()
    assert abs(out["aod"] - truth) <= (0.1 if mode == "raw" else 0.051)
    none = inversion.solve(toa, library, "k", "lk", anchors, targets, grid, mode, F.lit(0.3) if mode == "prior" else None, least_surface=9.0)
    assert none.where("cost < double('infinity')").count() == 0
    with pytest.raises(ValueError):
        inversion.solve(toa, library, "k", "lk", anchors, targets, grid, "other")


def test_footprints(spark):
    import json

    from skyweave.functions import grid

    square = [[30.0, 30.0], [31.0, 30.0], [31.0, 31.0], [30.0, 30.0]]
    rows = [("T", json.dumps({"type": "Polygon", "coordinates": [square]})), ("T", json.dumps({"type": "Polygon", "coordinates": [square]})), ("T", json.dumps({"type": "MultiPolygon", "coordinates": [[square], [[[32.0, 30.0], *square[1:]]]]})), ("", "{}"), (None, None)]
    got = partition.footprints(spark.createDataFrame(rows, "tile string, geometry string"), 32636).collect()
    assert len(got) == 1 and len(got[0]["rings"]) == 2
    x, y = grid.project(30.0, 30.0, 32636)
    assert any(abs(p[0] - x) < 1e-6 and abs(p[1] - y) < 1e-6 for ring in got[0]["rings"] for p in ring)


def test_rings_of_a_tile_are_united(spark):
    chunks = spark.createDataFrame([(0, 0.0, 0.0, 100.0, 100.0)], "chunk_id int, west double, south double, east double, north double")

    def box(x0, x1):
        return [[x0, 0.0], [x1, 0.0], [x1, 100.0], [x0, 100.0]]

    tiles = [("X", [box(0.0, 60.0), box(10.0, 60.0)]), ("Y", [box(-5.0, 105.0)]), ("Z", [box(0.0, 100.0)])]
    got = partition.classify(chunks, spark.createDataFrame(tiles, "tile string, rings array<array<array<double>>>"), 10.0).first()
    assert got["tiles"] == ["X", "Y", "Z"] and got["required"] == ["Y"] and got["unreachable"] == 0.0


def test_overlay_areas():
    import numpy as np

    rng = np.random.default_rng(7)
    star = np.array([[0, 0], [10, 10], [10, 0], [0, 10]], float)  # crosses itself: two triangles
    own, alone, whole = partition.overlay([star], [0], 1)
    assert own[0] == pytest.approx(50.0) and alone[0] == pytest.approx(50.0) and whole == pytest.approx(50.0)
    own, alone, whole = partition.overlay([np.array([[0, 0], [4, 0], [4, 4], [0, 4]], float), np.array([[2, -2], [6, 2], [2, 6]], float)], [0, 1], 2)
    assert own.tolist() == pytest.approx([16.0, 16.0]) and alone.tolist() == pytest.approx([8.0, 8.0]) and whole == pytest.approx(24.0)
    assert partition.overlay([], [], 2)[2] == 0.0 and partition.overlay([np.zeros((4, 2))], [0], 1)[2] == 0.0
    # boxes on whole numbers against counting cells; then any triangles against sampling
    for _ in range(30):
        corners = rng.integers(0, 12, (9, 2, 2))
        low, high = corners.min(1), corners.max(1) + 1
        owners = rng.integers(0, 3, 9).tolist()
        held = np.zeros((3, 14, 14), bool)
        for (x0, y0), (x1, y1), o in zip(low, high, owners, strict=True):
            held[o, y0:y1, x0:x1] = True
        rings = [np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]], float) for (x0, y0), (x1, y1) in zip(low, high, strict=True)]
        own, alone, whole = partition.overlay(rings, owners, 3)
        assert own.tolist() == pytest.approx(held.sum((1, 2)).tolist()) and alone.tolist() == pytest.approx((held & (held.sum(0) == 1)).sum((1, 2)).tolist()) and whole == pytest.approx(held.any(0).sum())
    y, x = np.mgrid[0:1:1000j, 0:1:1000j]
    for _ in range(5):
        rings, owners = [rng.random((3, 2)) for _ in range(7)], rng.integers(0, 3, 7).tolist()
        held = np.zeros((3, 1000, 1000), bool)
        for ring, o in zip(rings, owners, strict=True):
            signs = [(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0 for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True)]
            held[o] |= np.all(signs, axis=0) | ~np.any(signs, axis=0)
        own, alone, whole = partition.overlay(rings, owners, 3)
        assert own.tolist() == pytest.approx(held.mean((1, 2)).tolist(), abs=4e-3) and alone.tolist() == pytest.approx((held & (held.sum(0) == 1)).mean((1, 2)).tolist(), abs=4e-3) and whole == pytest.approx(held.any(0).mean(), abs=4e-3)


def test_clipping_is_exact():
    import numpy as np

    triangle = np.array([[0.0, 0.0], [4.0, 0.0], [0.0, 4.0]])
    assert partition.area(partition.clip(triangle, (0, 0, 2, 2))) == 4.0
    assert partition.area(partition.clip(triangle, (1, 1, 3, 3))) == 2.0
    assert partition.area(partition.clip(triangle, (5, 5, 6, 6))) == 0.0


def test_trend_needs_four_groups(spark):
    rows = spark.createDataFrame([(float(i), 2.0 * i) for i in range(3)], "bias double, aod double")
    assert compare.trend(rows, "bias", "aod").first()["r"] is None
    assert compare.trend(rows.union(spark.createDataFrame([(3.0, 6.0)], "bias double, aod double")), "bias", "aod").first()["slope"] == 0.5


def test_sidecars_and_positions(spark):
    from skyweave.operators import asof

    scenes = spark.createDataFrame([("a", "T1", "d1"), ("b", "T1", "d1"), ("c", "T2", "d1"), (None, "T1", None)], "id string, tile string, day string")
    by_id = spark.createDataFrame([("a", 5.0, 2), ("a", 6.0, 1)], "id string, aod double, n int")
    by_day = spark.createDataFrame([("T1", "d1", 7.0, 3), ("T1", "d1", 8.0, 9)], "tile string, day string, aod double, n int")
    got = {r["id"]: (r["aod"], r["found"]) for r in asof.sidecar(scenes, by_id, by_day, "aod", "n").collect()}
    assert got == {"a": (6.0, "id"), "b": (7.0, "tile and day"), "c": (None, None), None: (None, None)}
    rows = spark.createDataFrame([(1, ["x", "y"], [1.0, 2.0])], "k int, name array<string>, xap array<double>")
    assert [tuple(r) for r in asof.by_position(rows, ["name", "xap"]).collect()] == [(1, 0, "x", 1.0), (1, 1, "y", 2.0)]
    with pytest.raises(Exception, match="one length"):
        asof.by_position(rows.withColumn("xap", F.slice("xap", 1, 1)), ["name", "xap"]).collect()


def test_empty_spectral_library(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0])], "k int, e array<double>")
    none = rows.limit(0).withColumnRenamed("k", "l").withColumn("t", F.col("e"))
    for shipped in (0, 100):
        assert spectra.knn(rows, none, "k", "l", "e", "t", shipped=shipped).count() == 0
        assert spectra.cosine_match(rows, none, "k", "l", "e", shipped=shipped).count() == 0
    assert spectra.knn(rows.limit(0), rows.withColumnRenamed("k", "l").withColumn("t", F.col("e")), "k", "l", "e", "t").count() == 0


def test_residual_by_band(spark):
    from skyweave.operators import spectra

    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [None, 1.0])], "k int, e array<double>")
    got = {r["k"]: r for r in spectra.reconstruction_residual(rows, rows.withColumnRenamed("k", "l"), "k", "l", "e", own="k").collect()}
    assert set(got) == {1, 2} and got[1]["residual"] == [0.0, 1.0] and abs(got[1]["rmse"] - 0.5**0.5) < 1e-12


def test_chunks_of_one_box_are_classified_once(spark, monkeypatch, tmp_path):
    seen = tmp_path / "seen"
    asked = partition.requirement

    def counted(box, tiles, least):
        with seen.open("a") as out:
            out.write(f"{box}\n")
        return asked(box, tiles, least)

    monkeypatch.setattr(partition, "requirement", counted)
    chunks = spark.range(60).selectExpr("cast(id as int) chunk_id", "id % 2 * 10 west", "0 south", "id % 2 * 10 + 10 east", "10 north")
    rings = [[[0.0, 0.0], [10.0, 0.0], [10.0, 10.0], [0.0, 10.0]], [[4.0, 0.0], [14.0, 0.0], [14.0, 10.0], [4.0, 10.0]]]
    tiles = spark.createDataFrame([("A", rings[:1]), ("B", rings[1:])], "tile string, rings array<array<array<double>>>")
    got = {r["chunk_id"]: (r["tiles"], r["required"], round(r["unreachable"], 9)) for r in partition.classify(chunks, tiles, 1.0).collect()}
    assert got == {k: (["B"], ["B"], 0.6) if k % 2 else (["A", "B"], ["A"], 0.0) for k in range(60)}
    assert len(seen.read_text().splitlines()) == 2


def test_upright_rectangles_are_clipped_as_polygons():
    import numpy as np

    rng, box = np.random.default_rng(2), (0.0, 0.0, 10.0, 8.0)
    for _ in range(30):
        rings = []
        for _ in range(40):
            x0, y0, x1, y1 = *rng.integers(-6, 9, 2), *rng.integers(-2, 14, 2)
            ring = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], float)
            ring = ring if rng.random() < 0.8 else ring[rng.permutation(4)]  # some cross themselves
            rings.append(ring if rng.random() < 0.5 else np.concatenate([ring, ring[:1]]))
        rings.append(np.array([(1, 1), (5, 2), (3, 6)], float))
        plain = [p for r in rings if partition.area(p := partition.clip(r, box)) > 0]
        a, b = partition.overlay(plain, [0] * len(plain), 1)[2], partition.overlay(own := partition._inside(rings, box), [0] * len(own), 1)[2]
        assert abs(a - b) < 1e-9
