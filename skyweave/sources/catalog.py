"""Scene catalogues: item JSON to scenes, presets, signers and observation sources."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.functions import temporal
from skyweave.operators.ordering import numbered

ITEM = (
    "id string, collection string, bbox array<double>, geometry string, "
    "properties map<string,string>, assets map<string,struct<href:string>>"
)


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Items from JSON documents: bare items, or collections with a ``features`` array."""
    raw = spark.read.text(path, wholetext=True)
    features = F.from_json("value", f"struct<features:array<struct<{ITEM.replace(' string', ':string').replace(' array', ':array').replace(' map', ':map')}>>>")["features"]
    one = F.from_json("value", ITEM)
    return raw.select(F.explode(F.coalesce(features, F.array(one))).alias("i")).select("i.*").where("id is not null")


def search(items: DataFrame, collections: list[str], box: tuple[float, float, float, float], start: str, stop: str, max_cloud_cover: float = 90.0) -> DataFrame:
    """Items that meet the box and the days, under the cloud cover if that is below 100."""
    day = temporal.day(F.col("properties")["datetime"])
    west, south, east, north = (F.col("bbox")[k] for k in range(4))
    out = items.where(F.col("collection").isin(*collections) & (west <= box[2]) & (east >= box[0]) & (south <= box[3]) & (north >= box[1]) & day.between(F.lit(start).cast("date"), F.lit(stop).cast("date")))
    return out.where(F.col("properties")["eo:cloud_cover"].try_cast("double") < max_cloud_cover) if max_cloud_cover < 100 else out


def search_ranges(items: DataFrame, collections: list[str], box: tuple[float, float, float, float], ranges: list[tuple[str, str]], max_cloud_cover: float = 90.0) -> DataFrame:
    """Items of any of the ranges of days, each once."""
    if not ranges:
        raise ValueError("a range is needed")
    day = temporal.day(F.col("properties")["datetime"])
    met = F.lit(False)
    for start, stop in ranges:
        met = met | day.between(F.lit(start).cast("date"), F.lit(stop).cast("date"))
    return search(items, collections, box, min(a for a, _ in ranges), max(b for _, b in ranges), max_cloud_cover).where(met)


def granule_searches(spark: SparkSession, product: str, ranges: list[tuple[str, str]]) -> DataFrame:
    """(collection, version, start, stop): every search that a product of several collections needs."""
    rows = [(c, v, a, b) for c, v in product_collections(product) for a, b in ranges]
    return spark.createDataFrame(rows, "collection string, version string, start string, stop string")


def band_selection(bands: list[str], band_map: dict[str, str], quality_map: dict[str, str]) -> list[str]:
    """Layers to fetch: those of the bands, then the distinct quality layers; a band without either is an error."""
    missing = [b for b in bands if b not in band_map or b not in quality_map]
    if missing:
        raise ValueError(f"no layer for {', '.join(missing)}")
    return list(dict.fromkeys([*(band_map[b] for b in bands), *(quality_map[b] for b in bands)]))


def scenes(items: DataFrame, max_scenes: int | None = None) -> DataFrame:
    """Scenes in the order of time and id, numbered from 0; of items with one id the first stays."""
    stamp = F.col("properties")["datetime"]
    first = items.withColumn("_n", F.row_number().over(Window.partitionBy(F.coalesce("id", F.uuid())).orderBy(stamp, "collection"))).where("_n = 1").drop("_n")
    listed = first.withColumn("datetime", stamp).withColumn("tile", temporal.tile(F.col("properties"), F.col("id")))
    if max_scenes is not None:
        listed = listed.orderBy("datetime", "id").limit(max_scenes)
    return numbered(listed, F.substring("datetime", 1, 10), ["datetime", "id"], "scene_index")


def with_assets(scenes_: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """(scene_index, band, href) of scenes that have every band; ``aliases``: asset key of each band."""
    pairs = F.array(*(F.struct(F.lit(b).alias("band"), F.col("assets")[k]["href"].alias("href")) for b, k in aliases.items()))
    whole = scenes_.withColumn("_p", pairs).where(F.forall("_p", lambda p: p["href"].isNotNull()))
    return whole.select("scene_index", F.explode("_p").alias("p")).select("scene_index", "p.*")


@dataclass(frozen=True)
class Endpoint:
    name: str
    url: str
    collection: str
    quality: str
    harmonised: bool = False


# Public catalogue endpoints.
ENDPOINTS = {
    e.name: e
    for e in (
        Endpoint("earth-search", "https://earth-search.aws.element84.com/v1", "sentinel-2-l2a", "scl", True),
        Endpoint("planetary-computer", "https://planetarycomputer.microsoft.com/api/stac/v1", "sentinel-2-l2a", "scl"),
        Endpoint("hls", "https://planetarycomputer.microsoft.com/api/stac/v1", "hls2-s30", "fmask"),
        Endpoint("cdse", "https://stac.dataspace.copernicus.eu/v1", "sentinel-2-l2a", "scl"),
        Endpoint("mcd43a4", "https://planetarycomputer.microsoft.com/api/stac/v1", "modis-43A4-061", "mandatory"),
    )
}


# Public product collections and their versions.
PRODUCTS = {
    "mcd43": (("MCD43A1", "061"), ("MCD43A2", "061")),
    "vnp43": (("VNP43IA1", "001"), ("VNP43IA2", "001")),
    "mcd19": (("MCD19A3", "061"),),
}


def product_collections(product: str) -> tuple[tuple[str, str], ...]:
    if product.lower() not in PRODUCTS:
        raise ValueError(f"product must be one of {', '.join(PRODUCTS)}")
    return PRODUCTS[product.lower()]


def pick_endpoint(name: str = "auto", region: str | None = None) -> Endpoint:
    """By name; ``auto`` stays within a US region's catalogue, else the planetary one."""
    if name == "auto":
        name = "earth-search" if (region or "").startswith("us-") else "planetary-computer"
    if name not in ENDPOINTS:
        raise ValueError(f"unknown endpoint {name}")
    return ENDPOINTS[name]


def no_signing(href: Column) -> Column:
    return href


def token_signing(token: str) -> Callable[[Column], Column]:
    """Signs by a query token, which a caller fetches once for a container."""
    return lambda href: F.concat(href, F.when(F.instr(href, "?") > 0, "&").otherwise("?"), F.lit(token))


def container_of(href: Column) -> Column:
    """``account/container`` of a blob address, or null."""
    found = F.regexp_extract(href, r"^https://([^./]+)\.blob\.core\.windows\.net/([^/?]+)", 0)
    return F.when(found != "", F.concat_ws("/", F.regexp_extract(found, r"//([^.]+)\.", 1), F.regexp_extract(found, r"/([^/]+)$", 1)))


class ContainerSigning:
    """Signs blob addresses with a token for each container, asked for once and again when it is about to end.

    ``fetch``: (account, container) to (token, seconds it holds).  Containers
    are few against addresses; addresses elsewhere stay as they are.
    """

    def __init__(self, fetch: Callable[[str, str], tuple[str, float]], clock: Callable[[], float] = time.monotonic, spare: float = 60.0):
        self.fetch, self.clock, self.spare = fetch, clock, spare
        self.held: dict[str, tuple[str, float]] = {}

    def token(self, name: str) -> str:
        if name not in self.held or self.held[name][1] - self.spare <= self.clock():
            token, seconds = self.fetch(*name.split("/"))
            self.held[name] = token, self.clock() + seconds
        return self.held[name][0]

    def sign(self, assets: DataFrame, href: str = "href") -> DataFrame:
        names = [r["c"] for r in assets.select(container_of(F.col(href)).alias("c")).distinct().where("c is not null").collect()]
        signed = F.col(href)
        for name in names:
            signed = F.when(container_of(F.col(href)) == name, token_signing(self.token(name))(F.col(href))).otherwise(signed)
        return assets.withColumn(href, signed)


class InMemory:
    """Observations already in a frame, if their bands are those asked for; others are passed over."""

    def __init__(self, observations: dict[tuple[str, ...], DataFrame], name: str = "memory"):
        self.observations, self.name = observations, name

    def load(self, bands: tuple[str, ...]) -> DataFrame | None:
        return self.observations.get(tuple(bands))


def keep_whole_granules(layers: DataFrame, wanted: list[str], granule: str = "granule", name: str = "name") -> DataFrame:
    """Layers whose name contains a wanted one, whatever the case, of granules that have all of them."""
    pattern = F.explode(F.array(*(F.lit(w.lower()) for w in wanted))).alias("band")
    met = layers.select("*", pattern).where(F.lower(name).contains(F.col("band")))
    whole = met.groupBy(granule).agg(F.count_distinct("band").alias("n")).where(F.col("n") == len(set(w.lower() for w in wanted)))
    return met.join(whole.select(granule), granule, "left_semi")
