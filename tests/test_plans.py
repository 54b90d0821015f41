import json

import pytest
from pyspark.sql import functions as F

from skyweave.functions.grid import Grid
from skyweave.plans import pipelines, store, views
from skyweave.sources import catalog, rasters
from skyweave.streaming import fold

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def obs(spark):
    return views.joined(spark, SF).persist()


def test_composite_counts_every_pixel(spark, obs):
    grid = views.pixels(spark, SF).select("pid")
    out = pipelines.build_composite(obs, grid, pipelines.Build(top_k=2, strict=True))
    assert out.count() == grid.count() and out.where("observation_count = 0 and quality <> 65535").count() == 0
    adaptive = pipelines.build_composite(obs, grid, pipelines.Build(coverage_target=0.9, emit_uncertainty=True))
    assert "b0_unc" in adaptive.columns and adaptive.count() == grid.count()
    with pytest.raises(ValueError):
        pipelines.build_composite(obs, grid, pipelines.Build(bands=("b9",)))
    with pytest.raises(ValueError):
        pipelines.Build(top_k=0)


def test_monthly_is_each_month_alone(spark, obs):
    grid = views.pixels(spark, SF).select("pid")
    how = pipelines.Build(strict=True)
    both = pipelines.build_monthly(obs, grid, how, [1997, 1997], [3, 4])
    assert both.select("period").distinct().count() == 2 and both.count() == 2 * grid.count()
    with pytest.raises(ValueError):
        pipelines.periods(spark, [1997], [13])


def test_order_of_rows_does_not_matter(spark, obs):
    grid = views.pixels(spark, SF).select("pid")
    a = pipelines.build_composite(obs, grid, pipelines.Build(strict=True))
    b = pipelines.build_composite(obs.repartition(7).orderBy(F.rand(3)), grid, pipelines.Build(strict=True))
    assert a.exceptAll(b).count() == 0


def test_corrected_composite(spark):
    obs = spark.createDataFrame([(0, 1, 0.9, 0.3), (0, 2, 0.9, 0.4), (1, 1, 0.2, 0.3), (1, 2, 0.9, 0.4)], "pid int, scene_index int, cs double, b0 double")
    c = spark.createDataFrame([(1, 0.3, [1.0], [0.0], [0.0]), (2, 0.12, [1.0], [0.0], [0.0])], "scene_index int, aod double, xap array<double>, xbp array<double>, xcp array<double>")
    half = pipelines.build_corrected(obs, c, ["b0"], low_aod_fraction=0.5)
    assert {r["pid"]: r["scene_index"] for r in half.collect()} == {0: 2, 1: 2}


def test_store(spark, obs, tmp_path):
    keep = store.Store(spark, f"file://{tmp_path}/products")
    grid = Grid(0, 0, 100, 100, 32636, 10)
    provider = pipelines.Provider(keep, "fixture", pipelines.Build(strict=True))
    request = provider.request(grid, "p", ("b0", "b1", "b2"))
    pixels = views.pixels(spark, SF).select("pid")
    assert not keep.has(request.hash())
    first = provider.build(request, obs, pixels)
    assert keep.has(request.hash()) and provider.build(request, obs.limit(0), pixels).count() == first.count()
    assert len(request.hash()) == 24 and keep.item(request.hash())["assets"]["b1"]["band_index"] == 1
    assert request.hash() != provider.request(grid, "p", ("b0", "b2", "b1")).hash()
    with pytest.raises(ValueError):
        provider.request(grid, "p", ("b0",), temporal_filter=("2024-02-01", "2024-01-01"))


def test_tokens_and_bands(spark):
    rows = spark.createDataFrame([("a b",), ("a-b",), ("..",)], "n string")
    assert [r[0] for r in rows.select(store.safe_token(F.col("n"))).collect()] == ["a-b", "a-b", "value"]
    assert store.colliding_tokens(rows, "n").count() == 1
    bands = spark.createDataFrame([(0,), (2,), (2,), (5,)], "band_index int")
    assert {r[0] for r in store.missing_bands(bands, 3).collect()} == {1, 2, 5}


def item(i, day, cloud=10, **more):
    return {"id": i, "collection": "sentinel-2-l2a", "bbox": [0, 0, 1, 1], "geometry": None, "properties": {"datetime": f"{day}T10:00:00Z", "eo:cloud_cover": str(cloud), **more}, "assets": {"red": {"href": f"{i}.tif"}, "scl": {"href": "s.tif"}}}


def test_catalogue(spark, tmp_path):
    features = [item("S2A_31TCJ_20240702_0_L2A", "2024-07-02"), item("S2A_31TCJ_20240701_0_L2A", "2024-07-01", **{"s2:mgrs_tile": "31TXX"}), item("c", "2024-07-03", 95), item("S2A_31TCJ_20240702_0_L2A", "2024-07-02")]
    path = tmp_path / "items.json"
    path.write_text(json.dumps({"features": features}))
    found = catalog.search(catalog.read_items(spark, str(path)), ["sentinel-2-l2a"], (0.5, 0.5, 2, 2), "2024-07-01", "2024-07-31")
    scenes = catalog.scenes(found)
    assert [(r["scene_index"], r["tile"]) for r in scenes.orderBy("scene_index").collect()] == [(0, "31TXX"), (1, "31TCJ")]
    assert catalog.with_assets(scenes, {"b0": "red", "q": "scl"}).count() == 4
    assert catalog.with_assets(scenes, {"b0": "nir"}).count() == 0
    assert catalog.pick_endpoint("auto", "us-west-2").name == "earth-search" and catalog.pick_endpoint("auto").name == "planetary-computer"


def test_npz(spark, tmp_path):
    import numpy as np

    np.savez(tmp_path / "a.npz", d=np.array([[[0.1, np.nan]]], np.float32), q=np.array([[0, 3]]))
    manifest = tmp_path / "m.json"
    manifest.write_text(json.dumps({"name": "x", "band_names": ["b0"], "items": [{"path": "a.npz", "data_key": "d", "quality_key": "q"}]}))
    rows = rasters.read_npz(spark, f"file://{manifest}", ["b0"]).orderBy("col").collect()
    assert [(r["col"], r["quality"]) for r in rows] == [(0, 0), (1, 3)] and rows[1]["value"] is None
    with pytest.raises(ValueError):
        rasters.read_npz(spark, f"file://{manifest}", ["b1"])


def tiff(tile, predictor):
    """A one-tile classic TIFF."""
    import struct
    import zlib

    import numpy as np

    raw = np.diff(tile.astype(np.uint16), axis=1, prepend=np.zeros((tile.shape[0], 1), np.uint16)).astype("<u2") if predictor == 2 else tile.astype("<u2")
    data = zlib.compress(raw.tobytes())
    tags = [(256, 3, tile.shape[1]), (257, 3, tile.shape[0]), (258, 3, 16), (259, 3, 8), (317, 3, predictor), (322, 3, tile.shape[1]), (323, 3, tile.shape[0]), (324, 4, 0), (325, 4, len(data))]
    at = 8 + 2 + 12 * len(tags) + 4
    body = b"".join(struct.pack("<HHI", t, k, 1) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", at if t == 324 else v)) for t, k, v in tags)
    return b"II*\x00" + struct.pack("<I", 8) + struct.pack("<H", len(tags)) + body + struct.pack("<I", 0) + data


@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff(spark, tmp_path, predictor):
    import numpy as np

    tile = (np.arange(256).reshape(16, 16) * 517 % 65536).astype(np.uint16)
    path = tmp_path / "t.tif"
    path.write_bytes(tiff(tile, predictor))
    levels = rasters.read_levels(path.read_bytes())
    assert np.array_equal(rasters.read_window(path.read_bytes(), levels[0], 3, 4, 5, 6), tile[3:8, 4:10])
    got = {(r["row"], r["col"]): r["value"] for r in rasters.read_tiff(spark, [f"file://{path}"]).collect()}
    assert got == {(r, c): int(tile[r, c]) for r in range(16) for c in range(16)}
    with pytest.raises(ValueError):
        rasters.read_levels(b"MM\x00*")


def test_ranges_and_bits():
    import numpy as np

    assert rasters.coalesce_ranges([0, 100, 9000], [100, 50, 10]) == [(0, 150), (9000, 9010)]
    assert rasters.coalesce_ranges([0, 1 << 20], [10, 10], gap=1 << 21) == [(0, 10), (1 << 20, (1 << 20) + 10)]
    bits = np.unpackbits(np.array([0b10101010, 0b11110000, 0b11000000], np.uint8))
    assert rasters.unpack(np.packbits(bits).tobytes(), 12, 1).tolist() == [0b101010101111]


def test_fold_equals_all_at_once(spark, obs, tmp_path):
    rows = obs.withColumn("quality", F.col("scl")).select("pid", "quality", "day", "scene_index", "b0", "b1", "b2")
    bands = ["b0", "b1", "b2"]
    state = fold.StreamedComposite(spark, f"file://{tmp_path}/state", ["pid"], bands)
    for k in (2, 0, 1):  # any order of arrival
        state.take(rows.where(F.col("scene_index") % 3 == k), {2: 0, 0: 1, 1: 2}[k])
    state.take(rows.where(F.col("scene_index") % 3 == 1), 2)  # a batch again
    whole = fold.winners(rows, ["pid"], bands)
    assert state.current().exceptAll(whole).count() == 0 and whole.exceptAll(state.current()).count() == 0


def test_only_touched_chunks_are_written(spark, obs, tmp_path):
    bands = ["b0", "b1", "b2"]
    rows = obs.withColumn("quality", F.col("scl")).select("chunk_id", "pid", "quality", "day", "scene_index", *bands)
    state = fold.ChunkedComposite(spark, f"file://{tmp_path}/state", ["pid"], bands)
    assert state.current() is None
    state.take(rows.limit(0), 0)
    assert state.current() is None
    state.take(rows.where("scene_index % 3 = 0"), 1)
    chunks = sorted(r["chunk_id"] for r in rows.select("chunk_id").distinct().collect())
    held = lambda: sorted((p.parent.name, p.name) for p in (tmp_path / "state" / "parts").glob("v=*/chunk_id=*"))
    assert held() == [("v=1", f"chunk_id={c}") for c in chunks]
    state.take(rows.where(f"scene_index % 3 = 1 and chunk_id = {chunks[0]}"), 2)
    assert [x for x in held() if x[0] == "v=2"] == [("v=2", f"chunk_id={chunks[0]}")]  # one chunk is written
    state.take(rows.where(f"scene_index % 3 = 1 and chunk_id = {chunks[0]}"), 2)  # a batch again
    rest = rows.where(f"scene_index % 3 = 2 or (scene_index % 3 = 1 and chunk_id <> {chunks[0]})")
    state.take(rest, 3)
    assert not [x for x in held() if x == ("v=1", f"chunk_id={chunks[0]}")]  # superseded before batch 3 began
    whole = fold.winners(rows, ["chunk_id", "pid"], bands)
    got = state.current()
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0
    # a version whose list is not complete does not count
    import shutil

    shutil.copytree(tmp_path / "state" / "parts" / "v=2", tmp_path / "state" / "parts" / "v=4")
    shutil.copytree(tmp_path / "state" / "manifest" / "v=2", tmp_path / "state" / "manifest" / "v=4")
    (tmp_path / "state" / "manifest" / "v=4" / "_SUCCESS").unlink()
    got = state.current()
    assert got.exceptAll(whole).count() == 0 and whole.exceptAll(got).count() == 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and entry.entry(spark).count() == 200


def test_export_reads_back(spark):
    import numpy as np

    from skyweave.plans import export

    grid = Grid(0, 0, 300, 200, 32636, 1)
    product = grid.pixels(spark).where("row < 150").withColumn("b0", (F.col("row") * 300 + F.col("col")) % 60000)
    files = export.chunk_files(product, grid, ["b0"], chunk=128, tile=128).collect()
    assert len(files) == 6 - 0 and {(f["row"], f["col"]) for f in files} == {(r, c) for r in (0, 128) for c in (0, 128, 256)}
    for f in files:
        level = rasters.read_levels(bytes(f["content"]))[0]
        data = rasters.read_window(bytes(f["content"]), level, 0, 0, level.height, level.width)
        rows, cols = np.indices(data.shape) + np.array([f["row"], f["col"]])[:, None, None]
        assert np.array_equal(data, np.where(rows < 150, (rows * 300 + cols) % 60000, 65535))
    with pytest.raises(ValueError):
        export.encode_tiff(np.zeros((2, 2)), grid)


def test_command_line(spark, tmp_path, capsys):
    from skyweave import cli

    common = ["--bbox", "30.5", "30.5", "30.505", "30.505", "--product", "p", "--bands", "b0"]
    assert cli.main(["request-hash", *common, "--catalogue", "x"]) == 0
    first = capsys.readouterr().out.strip()
    assert len(first) == 24 and cli.main(["request-hash", *common, "--catalogue", "x", "--top-k", "4"]) == 0
    assert capsys.readouterr().out.strip() != first
    obs = spark.createDataFrame([(0, 0, 1, "T", 0, 0, 4, 0.5)], "pid long, chunk_id int, scene_index int, tile string, obs_order int, sample_index int, scl int, b0 double")
    obs.write.parquet(f"{tmp_path}/obs")
    assert cli.main(["build", *common, "--observations", f"{tmp_path}/obs", "--store", f"file://{tmp_path}/store"]) == 0
    assert json.loads(capsys.readouterr().out)["properties"]["product"] == "p"
    with pytest.raises(SystemExit):
        cli.main(["build", *common, "--observations", "a", "--catalogue", "b", "--store", "s"])


def test_paged_source(spark, tmp_path):
    from skyweave.sources import paged

    (tmp_path / "a.json").write_text(json.dumps({"features": [item("x", "2024-07-01")], "links": [{"rel": "next", "href": "b.json"}]}))
    (tmp_path / "b.json").write_text(json.dumps({"features": [item("y", "2024-07-02"), item("z", "2024-07-03")], "links": [{"rel": "next", "href": "a.json"}]}))
    spark.dataSource.register(paged.PagedCatalogue)
    rows = spark.read.format("paged_catalogue").option("start", f"{tmp_path}/a.json").load()
    assert sorted(r["id"] for r in rows.collect()) == ["x", "y", "z"]


def test_ranges_are_retried_and_kept():
    from skyweave.sources import paged

    told, slept = [], []

    def opener(url, start, end):
        told.append(url)
        if len(told) < 3:
            raise paged.Refused(503, 7.0 if len(told) == 1 else None)
        return b"x" * (end - start)

    assert paged.with_retries(lambda: opener("u", 0, 4), slept.append) == b"xxxx" and slept[0] == 7.0 and 0.3 <= slept[1] <= 0.5
    with pytest.raises(paged.Refused):
        paged.with_retries(lambda: (_ for _ in ()).throw(paged.Refused(404)), slept.append)
    reader = paged.RangeReader(opener, most=10)
    reader.get("u", 0, 8), reader.get("u", 0, 8)
    assert len(told) == 4
    reader.get("u", 8, 16), reader.get("u", 0, 8)
    assert len(told) == 6


def test_table_cache(spark, tmp_path):
    from skyweave.plans.cache import TableCache

    cache, made = TableCache(spark, f"file://{tmp_path}/cache"), []

    def make():
        made.append(1)
        return spark.range(3)

    assert cache.get("scout", {"a": 1}, make).count() == 3 and cache.get("scout", {"a": 1}, make).count() == 3 and len(made) == 1
    assert cache.get("scout", {"a": 2}, make).count() == 3 and len(made) == 2


def test_every_spectrum_is_asked(spark, tmp_path):
    import numpy as np

    from skyweave.operators import inversion, spectra
    from skyweave.plans import queries

    x = np.random.default_rng(2).uniform(0.05, 0.4, (40, 8)).astype(np.float32).astype(float)
    frame = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    near = {r["vec_id"]: r for r in queries.knn_predict_every(spark, str(tmp_path)).collect()}
    match = {r["vec_id"]: r for r in queries.cosine_1nn_gain_every(spark, str(tmp_path)).collect()}
    rest = {r["vec_id"]: r for r in queries.knn_residual_every(spark, str(tmp_path)).collect()}
    assert sorted(near) == sorted(match) == sorted(rest) == list(range(40))
    for i in range(40):
        d = np.linalg.norm(x[:, 3:7] - x[i, 3:7], axis=1)
        top = [j for j in np.argsort(d, kind="stable") if j != i][:10]
        w = 1 / (d[top] + 1e-6)
        assert np.allclose([near[i][f"t{k}"] for k in range(3)], w @ x[top, :3] / w.sum(), atol=2e-6) and abs(near[i]["distance"] - d[top[0]]) < 2e-6
        assert abs(rest[i]["rmse"] - np.sqrt(((x[i, 3:7] - w @ x[top, 3:7] / w.sum()) ** 2).mean())) < 2e-6
        y = x[:, :7]
        score = np.where(np.arange(40) == i, -2, y @ y[i] / np.linalg.norm(y, axis=1))
        assert match[i]["match"] == score.argmax() and abs(match[i]["gain"] - y[score.argmax()] @ y[i] / (y[score.argmax()] @ y[score.argmax()])) < 2e-6
    rows = queries._every_spectrum(spark, str(tmp_path))
    library = rows.withColumnRenamed("vec_id", "lk")
    shipped, blocked = (spectra.knn(rows, library, "vec_id", "lk", "anchor", "target", shipped=n, own="vec_id").select("vec_id", F.round("distance", 9)) for n in (100, 1))
    assert sorted(map(tuple, shipped.collect())) == sorted(map(tuple, blocked.collect()))
    # one label for each row: all rows are inverted, none of them by itself
    alone = frame.withColumn("label", F.col("vec_id").cast("int"))
    alone.write.parquet(f"{tmp_path}/alone/embeddings.parquet")
    got = {r["label"]: r["cost"] for r in queries.aod_inversion(spark, f"{tmp_path}/alone").collect()}
    assert sorted(got) == list(range(40))
    bands = alone.select("vec_id", F.slice(F.transform(F.col("embedding").cast("array<double>"), lambda v: v + 0.02), 1, 5).alias("e")).select("vec_id", F.slice("e", 1, 2).alias("anchor"), F.slice("e", 3, 3).alias("target"))
    for i in (0, 7):
        one = inversion.solve(bands.where(F.col("vec_id") == i), bands.where(F.col("vec_id") != i).withColumnRenamed("vec_id", "lk"), "vec_id", "lk", [1.6, 2.2], [0.44, 0.49, 0.56], [k / 20 for k in range(1, 17)], "prior", F.lit(0.3)).first()
        assert abs(got[i] - one["cost"]) < 2e-6


def test_every_scene_has_a_position(spark):
    from skyweave.plans import queries

    sf = "/root/testdata/sf0.01"
    ids = {(str(r["day"]), r["id"]) for r in queries._scene_ids(spark, sf).select("day", "id").collect()}
    got = {r["position"]: r["id"] for r in queries.all_scenes_in_order(spark, sf).collect()}
    assert len(ids) > 200 and got == {k: i for k, (_, i) in enumerate(sorted(ids))}


def test_paged_source_follows_every_page(spark, tmp_path):
    import json

    from skyweave.sources import paged

    n = 1001
    for k in range(n):
        links = [{"rel": "next", "href": f"p{k + 1}.json"}] if k + 1 < n else []
        (tmp_path / f"p{k}.json").write_text(json.dumps({"features": [{"id": f"i{k}", "collection": "c"}] if k % 2 == 0 else [], "links": links}))
    spark.dataSource.register(paged.PagedCatalogue)
    got = spark.read.format("paged_catalogue").option("start", f"{tmp_path}/p0.json").load().select("id").collect()
    assert sorted(r["id"] for r in got) == sorted(f"i{k}" for k in range(0, n, 2))


def test_scene_reader(spark, tmp_path):
    import numpy as np

    from skyweave.functions.grid import Grid
    from skyweave.plans import export
    from skyweave.sources import paged, scenes

    rng = np.random.default_rng(1)
    image = Grid(600.0, 0.0, 600.0 + 70 * 60, 90 * 60, 32631, 60.0)
    data = {b: rng.integers(1, 5000, (90, 70)).astype(np.uint16) for b in ("a", "q")}
    data["a"][10:20, 10:20] = 0
    for band, own in data.items():
        (tmp_path / f"{band}.tif").write_bytes(export.encode_tiff(own, image, 16))
    assets = spark.createDataFrame([(1, b, f"{tmp_path}/{b}.tif", 100) for b in data] + [(2, "a", f"{tmp_path}/a.tif", None)], "scene_index long, band string, href string, offset int")
    windows = spark.createDataFrame([(1, 0, 0, 0, 30, 40), (1, 1, 30, 0, 75, 90), (2, 0, 0, 0, 30, 40), (2, 9, 300, 300, 2, 2)], "scene_index long, chunk_id int, row int, col int, height int, width int")
    target = Grid(600.0 - 120, 90.0, 600.0 + 120 * 60, 92 * 60 + 90, 32631, 60.0)
    asked: list[int] = []

    def opener(url, start, end):
        asked.append(1)
        if len(asked) % 5 == 2:
            raise paged.Refused(503, 0.0)
        return scenes.open_range(url, start, end)

    got = {(r["scene_index"], r["chunk_id"], r["row"], r["col"]): (r["a"], r["q"]) for r in scenes.scene_pixels(assets, windows, target, ["a", "q"], ("q",), offset="offset", sign=lambda h: h, opener=opener).collect()}
    assert len(got) == 30 * 40 + 75 * 90 + 30 * 40 + 4
    for (scene, _, r, c), (a, q) in got.items():
        y, x = (image.north - (target.north - (r + 0.5) * 60)) / 60, (target.west + (c + 0.5) * 60 - image.west) / 60
        inside = 0 <= y < 90 and 0 <= x < 70
        assert q == (int(data["q"][int(y), int(x)]) if inside and scene == 1 else None)
        y0, x0 = int(np.floor(y - 0.5)), int(np.floor(x - 0.5))
        fy, fx = y - 0.5 - y0, x - 0.5 - x0
        total = weight = 0.0
        for dy, dx, w in ((0, 0, (1 - fy) * (1 - fx)), (0, 1, (1 - fy) * fx), (1, 0, fy * (1 - fx)), (1, 1, fy * fx)):
            if 0 <= y0 + dy < 90 and 0 <= x0 + dx < 70 and (v := int(data["a"][y0 + dy, x0 + dx])):
                total, weight = total + w * v, weight + w
        lost = any(w > 0 and not 0 <= y0 + d < 90 for d, w in ((0, 1 - fy), (1, fy)))
        want = None if lost or weight == 0 else max(int(np.floor(total / weight + 0.5)) - (100 if scene == 1 else 0), 0)
        assert a == want, (scene, r, c)
    one = scenes.read_part(paged.RangeReader(scenes.open_range), f"{tmp_path}/q.tif", image.part(3, 5, 4, 6), nearest=True)
    assert np.array_equal(one, data["q"][3:7, 5:11])
    head = (tmp_path / "q.tif").read_bytes()[:40]
    with pytest.raises(ValueError):
        scenes.read_header(paged.RangeReader(lambda u, a, b: head[a:b]), "broken")


def test_places_in_order(spark):
    from pyspark.sql import functions as F

    from skyweave.operators.ordering import numbered

    rows = [(v, k) for k, v in enumerate([3.0, None, 1.0, 2.0, 2.0, None, 7.5, 1.0])]
    frame = spark.createDataFrame(rows, "v double, k int")
    got = [(r["v"], r["k"]) for r in numbered(frame, F.floor("v"), ["v", "k"], "place").orderBy("place").collect()]
    assert got == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_signing_by_container(spark):
    from skyweave.sources import catalog

    asked, now = [], [0.0]

    def fetch(account, container):
        asked.append((account, container))
        return f"sig={account}{len(asked)}", 600.0

    signer = catalog.ContainerSigning(fetch, lambda: now[0])
    rows = spark.createDataFrame([("https://acc.blob.core.windows.net/box/a.tif",), ("https://acc.blob.core.windows.net/box/b.tif?x=1",), ("https://other.org/c.tif",), (None,)], "href string")
    want = {"https://acc.blob.core.windows.net/box/a.tif?sig=acc1", "https://acc.blob.core.windows.net/box/b.tif?x=1&sig=acc1", "https://other.org/c.tif", None}
    assert {r["href"] for r in signer.sign(rows).collect()} == want and {r["href"] for r in signer.sign(rows).collect()} == want
    now[0] = 541.0
    assert any("acc2" in (r["href"] or "") for r in signer.sign(rows).collect()) and asked == [("acc", "box")] * 2


def test_landed_products(spark, tmp_path):
    import numpy as np

    from skyweave.functions import grid, temporal
    from skyweave.plans import export
    from skyweave.sources import catalog, rasters

    assert catalog.granule_searches(spark, "mcd43", [("a", "b"), ("c", "d")]).count() == 4
    assert catalog.band_selection(["r", "n"], {"r": "B1", "n": "B2"}, {"r": "Q", "n": "Q"}) == ["B1", "B2", "Q"]
    with pytest.raises(ValueError):
        catalog.band_selection(["r"], {"r": "B1"}, {})
    step = grid.MODIS_TILE / 2400
    inside = grid.Grid(grid.MODIS_WEST + 18 * grid.MODIS_TILE + 10 * step, grid.MODIS_NORTH - 4 * grid.MODIS_TILE - 25 * step, grid.MODIS_WEST + 18 * grid.MODIS_TILE + 30 * step, grid.MODIS_NORTH - 4 * grid.MODIS_TILE - 5 * step, grid.SINUSOIDAL, step)
    names = spark.createDataFrame([("MCD43A1.A2020001.h18v04.061.x.hdf",), ("MCD43A1.A2020001.h17v04.061.x.hdf",), ("odd",)], "name string")
    got = [r["w"] for r in names.select(grid.modis_window(F.col("name"), inside, 2400).alias("w")).collect()]
    assert tuple(got[0])[:2] == (5, 10) and got[1:] == [None, None]
    days = spark.createDataFrame([("2020-06-30T23:30:00Z",)], "t string").select(*(temporal.local_day(F.col("t"), z).cast("string").alias(z[:3]) for z in ("UTC", "Asia/Tokyo", "America/Lima"))).first()
    assert tuple(days) == ("2020-06-30", "2020-07-01", "2020-06-30")
    (tmp_path / "station.csv").write_text("station data\nversion 3\nAERONET_Site,Date(dd:mm:yyyy),Time(hh:mm:ss),AOD_500nm,440-870_Angstrom_Exponent\ns,01:02:2020,10:00:00,0.2,1.0\ns,01:02:2020,11:00:00,-999,1.0\n")
    rows = rasters.aeronet(spark, f"file://{tmp_path}/station.csv").collect()
    assert len(rows) == 1 and abs(rows[0]["aod"] - 0.2 * (550 / 500) ** -1.0) < 1e-9
    there = grid.Grid(0.0, 0.0, 180.0, 120.0, 32631, 60.0)
    arrays = export.as_arrays(spark.createDataFrame([(0, 1, 7), (1, 2, None)], "row int, col int, b int"), there, ["b"], {"year": 2020, "month": 7})
    assert arrays["year"] == 2020 and np.array_equal(arrays["b"], [[65535, 7, 65535], [65535, 65535, 65535]])
    items = spark.createDataFrame([("a", "2020-01-05"), ("b", "2020-03-05"), ("c", "2020-06-05")], "id string, d string").select("id", F.lit("k").alias("collection"), F.array(*(F.lit(x) for x in (0.0, 0.0, 1.0, 1.0))).alias("bbox"), F.create_map(F.lit("datetime"), "d", F.lit("eo:cloud_cover"), F.lit("5")).alias("properties"))
    found = catalog.search_ranges(items, ["k"], (0, 0, 1, 1), [("2020-01-01", "2020-01-31"), ("2020-06-01", "2020-06-30")])
    assert sorted(r["id"] for r in found.collect()) == ["a", "c"]


def test_crossover_is_that_of_the_table_in_order(spark, tmp_path):
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq

    from skyweave.plans import queries

    # chunks whose mean is at the limit, over two files: sums of the halves, joined, fall on the other side of it in some
    rng, rows, want, halves = np.random.default_rng(5), [[], []], {}, {}
    for chunk in range(40):
        tax = rng.permutation([0.01, 0.03, 0.05, 0.07] * 25)
        total, parts = 0.0, [0.0, 0.0]
        for at, t in enumerate(tax):
            total, parts[at >= 50] = total + t, parts[at >= 50] + t
            rows[at >= 50].append((chunk, float(t)))
        want[chunk] = 1 if total / 100 - 0.04 >= 0 else None
        halves[chunk] = 1 if (parts[0] + parts[1]) / 100 - 0.04 >= 0 else None
    assert want != halves
    (tmp_path / "lineitem.parquet").mkdir()
    base = pq.read_table(f"{SF}/lineitem.parquet").slice(0, len(rows[0]))
    for k, own in enumerate(rows):
        cols = {"l_partkey": pa.array([c % 5 * 10 + c // 5 * 500 for c, _ in own], pa.int64()), "l_linenumber": pa.array([1] * len(own), pa.int32()), "l_tax": pa.array([t for _, t in own])}
        part = base
        for name, column in cols.items():
            part = part.set_column(part.schema.get_field_index(name), name, column)
        pq.write_table(part, tmp_path / "lineitem.parquet" / f"{k}.parquet")
    got = queries.first_crossover(spark, str(tmp_path)).collect()
    assert {r["chunk_id"]: r["crossover"] for r in got} == want
