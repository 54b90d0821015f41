"""Command line: build a composite from scene files or an observation table, hash a request, show a product's metadata."""

from __future__ import annotations

import argparse
import json
import time

from skyweave.functions.grid import Grid
from skyweave.plans import pipelines, store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="skyweave")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("build", "request-hash", "item"):
        own = commands.add_parser(name, aliases=["stac-item-path"] if name == "item" else [])
        own.add_argument("--bbox", type=float, nargs=4, required=True)
        own.add_argument("--product", required=True)
        own.add_argument("--bands", nargs="+", required=True)
        own.add_argument("--resolution", type=float, default=60.0)
        own.add_argument("--output-crs", default="native", choices=["native", "utm"])
        own.add_argument("--top-k", type=int, default=3)
        own.add_argument("--scout-factor", type=int, default=8)
        own.add_argument("--max-cloud-cover", type=float, default=90.0)
        own.add_argument("--coverage-target", type=float, default=0.0)
        own.add_argument("--min-k", type=int, default=2)
        own.add_argument("--max-k", type=int, default=8)
        own.add_argument("--emit-uncertainty", action="store_true")
        own.add_argument("--strict", action="store_true")
        own.add_argument("--temporal-filter", nargs=2, help="days that observations must be of")
        own.add_argument("--temporal-range", nargs=2, action="append", help="days to search; may be repeated")
        own.add_argument("--store", required=name != "request-hash")
        source = own.add_mutually_exclusive_group(required=True)
        source.add_argument("--observations", help="Parquet: pid, chunk_id, scene_index, tile, day, obs_order, sample_index, scl and bands")
        source.add_argument("--catalogue", help="JSON of items whose assets are scene files")
        source.add_argument("--manifest", help="manifest of NPZ items")
        own.add_argument("--collection", action="append", default=[])
        own.add_argument("--asset", action="append", default=[], metavar="BAND=KEY", help="asset key of a band; scl for the class codes")
        own.add_argument("--offset", type=int, default=0, help="taken off valid values")
        own.add_argument("--max-scenes", type=int)
        own.add_argument("--headers", help="folder in which parsed headers stay")
        own.add_argument("--scouts", help="folder in which shares of scouted scenes stay")
        own.add_argument("--tiff", help="folder for one file of each band, of quality, count and scene, and the seconds of each step")
        own.add_argument("--chunk", type=int, default=512)
        if name == "build":
            own.add_argument("--rebuild", action="store_true")
    return out


def _from_catalogue(spark, told, grid: Grid, how: pipelines.Build):
    """The composite of a catalogue's scenes, by its options."""
    from pyspark.sql import functions as F

    from skyweave.plans import build
    from skyweave.sources import catalog

    aliases = dict(x.split("=", 1) for x in told.asset)
    ranges = [tuple(x) for x in told.temporal_range or ([told.temporal_filter] if told.temporal_filter else [])]
    lost = [b for b in (*told.bands, "scl") if b not in aliases]
    if lost or not told.collection or not ranges:
        raise SystemExit(f"a catalogue needs --collection, --temporal-range and an --asset for every band and scl (without one: {', '.join(lost) or 'none'})")
    reading = build.Reading({b: aliases[b] for b in (*told.bands, "scl")}, headers=told.headers, scouts=told.scouts, offset="offset" if told.offset else None)
    items = catalog.read_items(spark, told.catalogue)
    out, _ = build.build_from_items(items, grid, how, reading, told.collection, ranges, told.chunk, max_scenes=told.max_scenes, offset=told.offset)
    return out.select((F.col("row").cast("long") * grid.width + F.col("col")).alias("pid"), *(c for c in out.columns if c not in ("row", "col")))


def _from_manifest(spark, path: str, bands: list[str], grid: Grid, how: pipelines.Build):
    """The composite of a manifest's items, whose pixels lie on the grid: an item is a scene, all are used."""
    from pyspark.sql import functions as F

    from skyweave.operators import compose
    from skyweave.sources import rasters

    rows = rasters.read_npz(spark, path, bands)
    first = [F.max(F.when(F.col("band") == b, F.col("value"))).alias(b) for b in bands]
    wide = rows.groupBy("item", "row", "col").agg(*first, F.first("quality").alias("quality"), F.first("sample_index").alias("sample_index"))
    obs = wide.select((F.col("row").cast("long") * grid.width + F.col("col")).alias("pid"), *bands, "quality", "sample_index", F.col("item").cast("long").alias("scene_index"), F.col("item").alias("obs_order"))
    won = compose.best_pixel(obs, ["pid"], bands, ["scene_index"], how.strict)
    return compose.full_grid(_pids(spark, grid), won, ["pid"], {"scene_index": -1, "quality": 65535, "observation_count": 0})


def _files(product, grid: Grid, bands: list[str], folder: str) -> dict[str, str]:
    """The files of a stored product: bands encoded where they are not whole numbers yet, quality, count and scene."""
    from pyspark.sql import functions as F

    from skyweave.functions import codec
    from skyweave.plans import export

    kinds = dict(product.dtypes)
    own = [F.col(b).cast("int").alias(b) if kinds[b] in ("int", "bigint", "smallint") else codec.encode(F.col(b)).alias(b) for b in bands]
    scene = F.when(F.col("scene_index") >= 0, F.col("scene_index")).cast("int").alias("selected")
    pixels = product.select(F.floor(F.col("pid") / grid.width).cast("int").alias("row"), (F.col("pid") % grid.width).cast("int").alias("col"), *own, "quality", F.col("observation_count").cast("int").alias("count"), scene)
    return {r["band"]: r["path"] for r in export.band_files(pixels, grid, [*bands, "quality", "count", "selected"], folder).collect()}


def _pids(spark, grid: Grid):
    return grid.pixels(spark).selectExpr(f"cast(row as bigint) * {grid.width} + col as pid")


def main(args: list[str] | None = None) -> int:
    told = parser().parse_args(args)
    grid = Grid.from_wgs84(tuple(told.bbox), told.resolution, output=told.output_crs)
    how = pipelines.Build(
        resolution=told.resolution, top_k=told.top_k, scout_factor=told.scout_factor, max_cloud_cover=told.max_cloud_cover, coverage_target=told.coverage_target,
        min_k=told.min_k, max_k=told.max_k, emit_uncertainty=told.emit_uncertainty, strict=told.strict, bands=tuple(told.bands),
    )
    provider = pipelines.Provider(None, told.observations or told.catalogue or told.manifest, how)
    ranges = [x for pair in told.temporal_range or [] for x in pair]
    window = tuple(told.temporal_filter) if told.temporal_filter else ((min(ranges), max(ranges)) if ranges else None)
    request = provider.request(grid, told.product, tuple(told.bands), window, period=",".join("/".join(x) for x in told.temporal_range) if told.temporal_range and len(told.temporal_range) > 1 else None)
    if told.command == "request-hash":
        print(request.hash())
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    provider.store = store.Store(spark, told.store)
    if told.command == "build":
        began, took = time.perf_counter(), {}
        if told.observations:
            provider.build(request, spark.read.parquet(told.observations), _pids(spark, grid), told.rebuild)
        else:
            made = (lambda: _from_catalogue(spark, told, grid, how)) if told.catalogue else (lambda: _from_manifest(spark, told.manifest, told.bands, grid, how))
            provider.keep(request, made, told.rebuild)
        took["build"] = round(time.perf_counter() - began, 3)
        if told.tiff:
            began = time.perf_counter()
            files = _files(provider.store.load(request.hash()), grid, told.bands, told.tiff)
            print(json.dumps({"files": files, "seconds": took | {"files": round(time.perf_counter() - began, 3)}}))
    print(json.dumps(provider.store.item(request.hash())))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
