"""Gridded granules read by ranges: an index of chunk addresses instead of the container's own reader.

The index is a JSON document beside each container, in the public layout of
chunk references: ``<layer>/.zarray`` tells shape, chunks, kind and filters,
``<layer>/<row>.<col>`` is [address, offset, length] of a deflated chunk.  Which
granules hold a grid is decided by their tile, which chunks by a join on chunk
positions, so nothing else of a container is opened.  A granule may have several
index documents, each with the ``.zarray`` of the layers it tells chunks of.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions.grid import Grid, modis_window
from skyweave.operators.ordering import dealt
from skyweave.sources.paged import RangeReader
from skyweave.sources.rasters import coalesce_ranges
from skyweave.sources.scenes import open_range

_META = "shape array<int>, chunks array<int>, dtype string, filters array<struct<id:string>>, fill_value double"


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(granule, layer, chunk_row, chunk_col, url, start, length, shape, chunks, dtype, shuffled, fill_value) of every chunk of the indexes at ``path``."""
    told = spark.read.text(path, wholetext=True).select(F.from_json("value", "granule string, refs map<string,string>").alias("i"))
    refs = told.select("i.granule", F.explode("i.refs").alias("key", "value"))
    layer = F.regexp_extract("key", r"^(.*)/[^/]+$", 1).alias("layer")
    meta = refs.where("key like '%/.zarray'").select("granule", layer, F.from_json("value", _META).alias("m")).select("granule", "layer", "m.*")
    meta = meta.select("granule", "layer", "shape", "chunks", "dtype", F.coalesce(F.exists("filters", lambda f: f["id"] == "shuffle"), F.lit(False)).alias("shuffled"), "fill_value").dropDuplicates(["granule", "layer"])
    place = [F.regexp_extract("key", r"/(\d+)\.(\d+)$", k).cast("int") for k in (1, 2)]
    parts = F.from_json("value", "array<string>")
    chunks = refs.where(F.col("key").rlike(r"/\d+\.\d+$")).select("granule", layer, place[0].alias("chunk_row"), place[1].alias("chunk_col"), parts[0].alias("url"), parts[1].cast("long").alias("start"), parts[2].cast("long").alias("length"))
    return chunks.join(meta, ["granule", "layer"])


def holding(index: DataFrame, grid: Grid, size: int) -> DataFrame:
    """(granule, row, col, height, width): the window of ``grid`` in every granule whose tile holds it whole; others have no row."""
    names = index.select("granule").distinct()
    return names.select("granule", modis_window(F.concat(F.lit("."), F.col("granule"), F.lit(".")), grid, size).alias("w")).where("w is not null").select("granule", "w.*")


def needed_chunks(index: DataFrame, windows: DataFrame, layers: list[str]) -> DataFrame:
    """The chunks of ``layers`` that the windows touch: both meet by granule and chunk position."""
    own = index.where(F.col("layer").isin(*layers))
    shapes = own.select("granule", "layer", "chunks").distinct()
    spans = windows.join(shapes, "granule")
    along = [F.sequence(F.floor(F.col(at) / F.col("chunks")[k]).cast("int"), F.floor((F.col(at) + F.col(n) - 1) / F.col("chunks")[k]).cast("int")) for k, (at, n) in enumerate((("row", "height"), ("col", "width")))]
    met = spans.select("granule", "layer", "row", "col", "height", "width", F.explode(along[0]).alias("chunk_row"), along[1].alias("_c")).withColumn("chunk_col", F.explode("_c")).drop("_c")
    return met.join(own, ["granule", "layer", "chunk_row", "chunk_col"])


def _decode(data: bytes, kind: np.dtype, shape: tuple[int, int], shuffled: bool) -> np.ndarray:
    raw = zlib.decompress(data)
    if shuffled:  # bytes by significance
        raw = np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T.tobytes()
    return np.frombuffer(raw, kind).reshape(shape)


def _strips(index: DataFrame, windows: DataFrame, layers: list[str], most: int) -> DataFrame:
    """(granule, first, row, col, height, width): windows cut into strips of about ``most`` pixels, between rows of chunks; ``first`` is the row of the window."""
    tall = index.where(F.col("layer").isin(*layers)).groupBy("granule").agg(F.max(F.col("chunks")[0]).alias("_tall"))
    step = F.greatest(F.floor(F.lit(most) / (F.col("width") * F.col("_tall"))), F.lit(1)).cast("int") * F.col("_tall")
    stop = F.col("first") + F.col("_full")
    cut = windows.join(tall, "granule").select("granule", F.col("row").alias("first"), "col", F.col("height").alias("_full"), "width", step.alias("_step"))
    tops = F.sequence((F.floor(F.col("first") / F.col("_step")) * F.col("_step")).cast("int"), stop - 1, F.col("_step"))
    cut = cut.withColumn("_top", F.explode(tops)).withColumn("row", F.greatest("_top", "first"))
    return cut.select("granule", "first", "row", "col", (F.least(F.col("_top") + F.col("_step"), stop) - F.col("row")).alias("height"), "width")


def granule_pixels(index: DataFrame, grid: Grid, layers: list[str], size: int, opener: Callable[[str, int, int], bytes] = open_range, most: int = 1 << 18) -> DataFrame:
    """(granule, row, col, layers) of the pixels of ``grid`` from every granule that holds it, layers as doubles.

    Granules that do not have all ``layers`` are left out; fill values, and what
    no chunk holds, are null.  One task holds a strip of the window of one
    granule, of about ``most`` pixels; neighbouring chunks are one range.
    """
    chunk = F.struct("layer", "chunk_row", "chunk_col", "url", "start", "length", "chunks", "dtype", "shuffled", "fill_value")
    whole = index.where(F.col("layer").isin(*layers)).groupBy("granule").agg(F.count_distinct("layer").alias("n")).where(F.col("n") == len(set(layers)))
    windows = _strips(index, holding(index.join(whole.select("granule"), "granule", "left_semi"), grid, size), layers, most)
    needed = needed_chunks(index, windows.drop("first"), layers).groupBy("granule", "row").agg(F.collect_list(chunk).alias("parts"))
    todo = windows.join(needed, ["granule", "row"], "left")  # a strip without a chunk is null

    def run(batches):
        reader = RangeReader(opener)
        for batch in batches:
            for w in batch.to_pylist():
                out = {layer: np.full((w["height"], w["width"]), np.nan) for layer in layers}
                parts = w["parts"] or []
                for url in {p["url"] for p in parts}:
                    own = sorted((p for p in parts if p["url"] == url), key=lambda p: (p["start"], p["length"]))
                    at = 0
                    for a, b in coalesce_ranges([p["start"] for p in own], [p["length"] for p in own]):
                        blob = reader.get(url, a, b)
                        while at < len(own) and own[at]["start"] + own[at]["length"] <= b:
                            p, at = own[at], at + 1
                            tall, wide = p["chunks"]
                            data = _decode(blob[p["start"] - a : p["start"] - a + p["length"]], np.dtype(p["dtype"]), (tall, wide), p["shuffled"]).astype(np.float64)
                            if p["fill_value"] is not None:
                                data = np.where(data == p["fill_value"], np.nan, data)
                            top, left = p["chunk_row"] * tall - w["row"], p["chunk_col"] * wide - w["col"]
                            r0, r1, c0, c1 = max(top, 0), min(top + tall, w["height"]), max(left, 0), min(left + wide, w["width"])
                            out[p["layer"]][r0:r1, c0:c1] = data[r0 - top : r1 - top, c0 - left : c1 - left]
                rows, cols = np.indices((w["height"], w["width"]))
                columns = [pa.array([w["granule"]] * rows.size), pa.array((rows.ravel() + w["row"] - w["first"]).astype(np.int32)), pa.array(cols.ravel().astype(np.int32)), *(pa.array(out[x].ravel(), mask=np.isnan(out[x].ravel())) for x in layers)]
                yield pa.RecordBatch.from_arrays(columns, ["granule", "row", "col", *layers])

    schema = "granule string, row int, col int, " + ", ".join(f"`{x}` double" for x in layers)
    return dealt(todo, "granule", "row").mapInArrow(run, schema)


def _described(layer: str, shape: tuple[int, int], chunks: tuple[int, int], kind: np.dtype, fill: float | None) -> dict[str, str]:
    told = {"shape": shape, "chunks": chunks, "dtype": kind.str, "compressor": {"id": "zlib"}, "filters": [{"id": "shuffle", "elementsize": kind.itemsize}], "fill_value": fill}
    return {f"{layer}/.zarray": json.dumps(told)}


def _packed(part: np.ndarray) -> bytes:
    return zlib.compress(np.frombuffer(part.tobytes(), np.uint8).reshape(-1, part.dtype.itemsize).T.tobytes())


def encode_container(layers: dict[str, np.ndarray], url: str, granule: str, chunks: tuple[int, int], fill: float | None = None) -> tuple[bytes, str]:
    """(container, index) of arrays of one shape: deflated, shuffled chunks one after the other, those at the edges filled up."""
    blob, refs = b"", {}
    for name, data in layers.items():
        kind = data.dtype.newbyteorder("<")
        refs |= _described(name, data.shape, chunks, kind, fill)
        for r in range(-(-data.shape[0] // chunks[0])):
            for c in range(-(-data.shape[1] // chunks[1])):
                part = np.full(chunks, 0 if fill is None else fill, kind)
                own = data[r * chunks[0] : (r + 1) * chunks[0], c * chunks[1] : (c + 1) * chunks[1]]
                part[: own.shape[0], : own.shape[1]] = own
                packed = _packed(part)
                refs[f"{name}/{r}.{c}"] = [url, len(blob), len(packed)]
                blob += packed
    return blob, json.dumps({"granule": granule, "refs": refs})


def write_containers(pixels: DataFrame, layers: list[str], shape: tuple[int, int], folder: str, chunks: tuple[int, int], fill: int) -> DataFrame:
    """(granule, band, url): the 16-bit ``layers`` of ``pixels`` (granule, row, col, layers) as containers in ``folder``, their indexes in ``folder``/index.

    A task holds one row of chunks of one granule and writes it as a container
    of its own, so a granule may be of any size; chunks without a pixel are
    not written.  A rerun writes the same.
    """
    tall, wide = chunks

    def work(group: pa.Table) -> pa.Table:
        name, band = group["granule"][0].as_py(), group["band"][0].as_py()
        row, col = group["row"].to_numpy() - band * tall, group["col"].to_numpy()
        url, blob, refs = f"{folder}/{name}-{band}.bin", b"", {}
        for layer in layers:
            data, kind = group[layer].fill_null(fill).to_numpy().astype("<i2"), np.dtype("<i2")
            refs |= _described(layer, shape, chunks, kind, fill)
            for c in np.unique(col // wide).tolist():
                own, part = col // wide == c, np.full(chunks, fill, kind)
                part[row[own], col[own] - c * wide] = data[own]
                packed = _packed(part)
                refs[f"{layer}/{band}.{c}"] = [url, len(blob), len(packed)]
                blob += packed
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(f"{root}/index", recursive=True)
        for path, content in ((f"{root}/{name}-{band}.bin", blob), (f"{root}/index/{name}-{band}.json", json.dumps({"granule": name, "refs": refs}).encode())):
            with store.open_output_stream(path) as out:
                out.write(content)
        return pa.table({"granule": [name], "band": pa.array([band], pa.int32()), "url": [url]})

    cut = pixels.select("granule", F.floor(F.col("row") / tall).cast("int").alias("band"), "row", "col", *layers)
    return dealt(cut, "granule", "band").groupBy("granule", "band").applyInArrow(work, "granule string, band int, url string")
