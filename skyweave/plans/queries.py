"""The registered queries of the raster operators, each beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyweave.functions import atmosphere, codec, grid, quality, temporal
from skyweave.operators import asof, compare, compose, resample, scout, select_scenes, spectra
from skyweave.plans.views import BANDS, ORDER, joined, observations, pixels, scenes, sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def with_quality(obs: DataFrame) -> DataFrame:
    return obs.withColumn("quality", quality.scl_quality(F.col("scl")))


BEST = """SELECT pid, "row", col, chunk_id, period, arg_min(struct_pack(b0 := b0, b1 := b1, b2 := b2, scene_index := scene_index, quality := quality, obs_order := obs_order),
  {score}) AS w, count(*) AS observation_count FROM obs WHERE {valid} GROUP BY ALL"""
STRICT = "quality <= 32767 AND b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL"
SCORE = "struct_pack(s := quality * 1e6 + coalesce(sample_index, 0) + obs_order, o := obs_order)"
PY = f"""best AS (SELECT pid, arg_min(struct_pack(b0 := b0, b1 := b1, b2 := b2, scene_index := scene_index, quality := quality, obs_order := obs_order), {SCORE}) AS w,
  count(*) AS observation_count FROM obs WHERE {STRICT} GROUP BY pid)"""
ENCODE = "CASE WHEN {0} BETWEEN 0 AND 6.5534 THEN CAST(round_even({0} * 10000, 0) AS INTEGER) ELSE 65535 END"


def _best(spark: SparkSession, sf_dir: str, strict: bool = True) -> DataFrame:
    return compose.best_pixel(with_quality(observations(spark, sf_dir)), ["pid"], list(BANDS), ["scene_index"], strict)


@query(sql(f"""SELECT px.pid, px."row", px.col, {', '.join(ENCODE.format(f'w.b{k}') + f' AS b{k}' for k in range(3))},
  coalesce(w.scene_index, -1) AS scene_index, coalesce(w.quality, 65535) AS quality, coalesce(observation_count, 0) AS observation_count
  FROM px LEFT JOIN best USING (pid)""", PY))  # fmt: skip
def best_pixel_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict composite on the full grid, encoded."""
    full = compose.full_grid(pixels(spark, sf_dir).select("pid", "row", "col"), _best(spark, sf_dir), ["pid"], {"scene_index": -1, "quality": 65535, "observation_count": 0})
    return full.select("pid", "row", "col", *(codec.encode(F.col(b)).alias(b) for b in BANDS), "scene_index", "quality", "observation_count")


@query(sql("""SELECT pid, w.scene_index AS scene_index, w.quality AS quality, w.b0 AS b0, w.b1 AS b1, n AS observation_count FROM (SELECT pid,
  arg_min(struct_pack(scene_index := scene_index, quality := quality, b0 := b0, b1 := b1), struct_pack(q := quality, o := obs_order)) AS w, count(*) AS n FROM obs WHERE quality <> 65535 GROUP BY pid)"""))  # fmt: skip
def best_pixel_rs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality alone decides, ties to the earliest; bands may be missing."""
    return _best(spark, sf_dir, strict=False).select("pid", "scene_index", "quality", "b0", "b1", "observation_count")


AOD = "((scene_index * 7) % 10) / 10.0::DOUBLE + 0.05"


def _aod(obs: DataFrame) -> DataFrame:
    return obs.withColumn("aod", (F.col("scene_index") * 7 % 10) / 10.0 + 0.05)


@query(sql(f"""SELECT pid, w.scene_index AS scene_index, round(w.aod, 6) AS aod, round(w.cs, 6) AS cs, w.b0 AS b0, n AS observation_count FROM (SELECT pid, arg_min(struct_pack(scene_index := scene_index, aod := {AOD}, cs := cs, b0 := b0),
  struct_pack(a := {AOD}, c := -cs, o := obs_order)) AS w, count(*) AS n FROM obs WHERE cs > 0.6 GROUP BY pid)"""))  # fmt: skip
def best_pixel_l1c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least optical depth among clear observations, then the clearest."""
    won = compose.clearest(_aod(observations(spark, sf_dir)), ["pid"], ["b0"], F.col("obs_order"))
    return rounded(won.select("pid", "scene_index", "aod", "cs", "b0", "observation_count"), "aod", "cs")


@query(sql("SELECT pid, strftime(arg_max(day, struct_pack(c := cs, o := -obs_order)), '%Y-%m-%d') AS day, max(cs) AS cs FROM obs WHERE cs > 0.3 GROUP BY pid"))
def clearest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of the clearest observation, the first on ties."""
    clear = observations(spark, sf_dir).where("cs > 0.3")
    return clear.groupBy("pid").agg(F.max_by("day", F.struct("cs", (-F.col("obs_order")).alias("o"))).cast("string").alias("day"), F.max("cs").alias("cs"))


@query(sql(f"SELECT px.pid, coalesce(n, 0) AS observation_count FROM px LEFT JOIN (SELECT pid, count(*) AS n FROM obs WHERE {STRICT} GROUP BY pid) USING (pid)"))
def obs_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = with_quality(observations(spark, sf_dir, ordered=False))
    counted = obs.where(quality.usable([F.col(b) for b in BANDS], F.col("quality"))).groupBy("pid").agg(F.count("*").alias("observation_count"))
    return pixels(spark, sf_dir).select("pid").join(counted, "pid", "left").fillna(0, ["observation_count"])


@query(sql(f"""SELECT pid, {', '.join(f"round(CASE WHEN w.b{k} <> 0 THEN s{k} / abs(w.b{k}) * 100 END, 4) AS b{k}_unc" for k in range(3))}
  FROM best JOIN (SELECT pid, {', '.join(f'stddev_pop(b{k}) AS s{k}' for k in range(3))} FROM obs WHERE {STRICT} GROUP BY pid) USING (pid)""", PY))  # fmt: skip
def rel_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = with_quality(observations(spark, sf_dir))
    out = compose.relative_uncertainty(obs, ["pid"], list(BANDS), _best(spark, sf_dir).select("pid", *BANDS))
    return rounded(out, *(f"{b}_unc" for b in BANDS), places=4)


@query(sql("""SELECT pid, round(CASE WHEN w.d IS NOT NULL THEN greatest(sqrt(v + (0.02 * w.d) ** 2), 10) END, 3) AS dn_spread FROM (SELECT pid, coalesce(var_samp(b0 * 10000), 0) AS v,
  arg_min(struct_pack(d := b0 * 10000), struct_pack(q := quality, o := obs_order)) AS w FROM obs WHERE quality <> 65535 GROUP BY pid)"""))  # fmt: skip
def temporal_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = with_quality(observations(spark, sf_dir)).withColumn("dn", F.col("b0") * 10000)
    out = compose.temporal_spread(obs, ["pid"], ["dn"], compose.best_pixel(obs, ["pid"], ["dn"], strict=False))
    return rounded(out, "dn_spread", places=3)


@query(sql("""SELECT pid, arg_max(sample_index, obs_order) FILTER (WHERE sample_index IS NOT NULL) AS sample_index, max(obs_order) AS winner_order, count(*) AS leaders FROM (
  SELECT *, min(score) OVER (PARTITION BY pid ORDER BY obs_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM (
  SELECT *, quality * 1e6 + coalesce(sample_index, 0) + obs_order AS score FROM obs WHERE """ + STRICT + """)) WHERE least IS NULL OR score < least GROUP BY pid"""))  # fmt: skip
def legacy_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.carried(with_quality(observations(spark, sf_dir)), ["pid"], list(BANDS), "sample_index")


STATS = """stats AS (SELECT scene_index, chunk_id, avg(CASE WHEN scl <> 0 THEN 1.0 ELSE 0.0 END) AS usable_fraction,
  avg(CASE WHEN scl <> 0 THEN cs END) AS mean_clear FROM obs GROUP BY ALL),
tiled AS (SELECT stats.*, tile FROM stats JOIN scn USING (scene_index))"""


def _chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = scout.chunk_stats(observations(spark, sf_dir, ordered=False), quality.scl_valid(F.col("scl")), F.col("cs"))
    return stats.join(scenes(spark, sf_dir), "scene_index", "left")


@query(sql("SELECT scene_index, chunk_id, round(usable_fraction, 6) AS usable_fraction, round(mean_clear, 6) AS mean_clear, tile FROM tiled", STATS))
def scout_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_chunk_stats(spark, sf_dir), "usable_fraction", "mean_clear")


SCENE = """sstats AS (SELECT scene_index, count_if(scl <> 0) / count(*) AS usable_fraction, CASE WHEN count_if(scl <> 0) > 0 THEN count_if(scl IN (4, 5, 6, 11)) / count_if(scl <> 0) END AS mean_clear FROM obs GROUP BY 1),
stiled AS (SELECT sstats.*, tile FROM sstats JOIN scn USING (scene_index))"""


def _scene_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = scout.scene_stats(observations(spark, sf_dir, ordered=False), quality.scl_valid(F.col("scl")), quality.scl_clear(F.col("scl")))
    return stats.join(scenes(spark, sf_dir), "scene_index")


@query(sql("SELECT scene_index, round(usable_fraction, 6) AS usable_fraction, round(mean_clear, 6) AS mean_clear, tile FROM stiled", SCENE))
def scene_scout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_scene_stats(spark, sf_dir), "usable_fraction", "mean_clear")


@query(sql("SELECT scene_index, chunk_id, round(count_if(fmask <> 255 AND fmask & 15 = 0 AND (fmask >> 6) & 3 <= 1) / count(*), 6) AS clear_fraction FROM obs GROUP BY ALL"))
def chunk_clear_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scout.clear_fraction(observations(spark, sf_dir, ordered=False), quality.fmask_clear(F.col("fmask"))), "clear_fraction")


MASKS = """cells AS (SELECT scene_index, chunk_id, ("row" % 10) * 10 + col % 10 AS cell, count_if(scl <> 0) AS seen, count_if(scl IN (4, 5, 6, 11)) AS clear FROM obs GROUP BY ALL),
masks AS (SELECT scene_index, chunk_id, CAST(cell // 50 AS INTEGER) AS word, bit_or(1::BIGINT << (cell % 50)) AS valid_mask,
  coalesce(bit_or(1::BIGINT << (cell % 50)) FILTER (WHERE 2 * clear >= seen), 0) AS clear_mask FROM cells WHERE seen > 0 GROUP BY ALL)"""


def _masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.col("row") % 10 * 10 + F.col("col") % 10
    # fifty cells a word keep masks positive in either engine
    spread = F.floor(cell / 50) * 64 + cell % 50
    return scout.cell_masks(observations(spark, sf_dir, ordered=False), spread.cast("int"), quality.scl_valid(F.col("scl")), quality.scl_clear(F.col("scl")))


@query(sql("SELECT * FROM masks", MASKS))
def chunk_cell_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(spark, sf_dir)


@query(sql("""SELECT chunk_id, word, CAST(bit_count(v) AS INTEGER) AS seen, CAST(bit_count(c) AS INTEGER) AS clear, CAST(bit_count(v & ~c) AS INTEGER) AS missing FROM (
  SELECT chunk_id, word, bit_or(valid_mask) AS v, bit_or(clear_mask) AS c FROM masks GROUP BY ALL)""", MASKS))  # fmt: skip
def mask_union_popcount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scout.union_coverage(_masks(spark, sf_dir))


@query(sql(f"SELECT l_orderkey, l_linenumber, l_partkey, {ENCODE.format('b0')} AS code, {ENCODE.format('b1')} AS code1 FROM obs"))
def encode_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir, ordered=False).select("l_orderkey", "l_linenumber", "l_partkey", codec.encode(F.col("b0")).alias("code"), codec.encode(F.col("b1")).alias("code1"))


@query(sql(f"SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN c <> 65535 THEN c / 10000 END AS value FROM (SELECT *, {ENCODE.format('b0')} AS c FROM obs)"))
def decode_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir, ordered=False).select("l_orderkey", "l_linenumber", "l_partkey", codec.decode(codec.encode(F.col("b0"))).alias("value"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN u BETWEEN 0 AND 200 THEN CAST(round_even(u, 0) AS INTEGER) ELSE 255 END AS code, CASE WHEN u BETWEEN 0 AND 200 THEN round_even(u, 0) END AS percent FROM (SELECT *, l_quantity * 4.5 AS u FROM lineitem)")
def encode_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = codec.encode_uncertainty(F.col("l_quantity") * 4.5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", code.alias("code"), codec.decode_uncertainty(code).alias("percent"))


@query(sql("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN cs >= 0.2 THEN CAST(round_even((1 - cs) * 10000, 0) AS INTEGER) ELSE 65535 END AS quality FROM obs"))
def cloud_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir, ordered=False).select("l_orderkey", "l_linenumber", "l_partkey", quality.cloud_score_quality(F.col("cs"), 0.2).alias("quality"))


@query(sql("SELECT scl, quality, count(*) AS n, CAST(count_if(scl <> 0) AS BIGINT) AS valid, CAST(count_if(scl IN (4, 5, 6, 11)) AS BIGINT) AS clear FROM obs GROUP BY ALL"))
def scl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = with_quality(observations(spark, sf_dir, ordered=False))
    return obs.groupBy("scl", "quality").agg(F.count("*").alias("n"), F.count_if(quality.scl_valid(F.col("scl"))).alias("valid"), F.count_if(quality.scl_clear(F.col("scl"))).alias("clear"))


@query(sql("""SELECT fmask, fmask <> 255 AND fmask & 15 = 0 AND (fmask >> 6) & 3 <= 1 AS clear, CASE WHEN fmask = 255 OR fmask & 2 <> 0 THEN 65535 WHEN fmask & 9 <> 0 THEN 2
  WHEN fmask & 4 <> 0 OR (fmask >> 6) & 3 >= 2 THEN 1 WHEN fmask & 16 <> 0 THEN 1 ELSE 0 END AS score, count(*) AS n FROM obs GROUP BY ALL"""))  # fmt: skip
def fmask_clear_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("fmask")
    return observations(spark, sf_dir, ordered=False).groupBy("fmask", quality.fmask_clear(code).alias("clear"), quality.fmask_score(code).alias("score")).agg(F.count("*").alias("n"))


@query(sql("SELECT mandatory, mandatory = 0 AS clear, CASE WHEN mandatory IN (0, 1) THEN mandatory ELSE 65535 END AS score, count(*) AS n FROM obs GROUP BY ALL"))
def modis_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("mandatory")
    return observations(spark, sf_dir, ordered=False).groupBy("mandatory", quality.mandatory_clear(code).alias("clear"), quality.mandatory_score(code).alias("score")).agg(F.count("*").alias("n"))


@query(sql("""SELECT pid, max(greatest(scl, mandatory)) AS merged, max(CASE WHEN mandatory IN (255) THEN 65535 ELSE mandatory END) AS filled FROM obs GROUP BY pid"""))
def merged_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several quality bands merged to the worst, fill values to no data."""
    obs = observations(spark, sf_dir, ordered=False)
    return obs.groupBy("pid").agg(F.max(quality.merged(F.col("scl"), F.col("mandatory"))).alias("merged"), F.max(quality.fill_to_nodata(F.col("mandatory"), 255)).alias("filled"))


SCENE_IDS = """ids AS (SELECT DISTINCT scene_index, tile, day, concat('S2A_', 31 + scene_index % 20, 'TC', chr(65 + CAST(scene_index % 20 AS INTEGER)), '_', strftime(day, '%Y%m%d'), '_0_L2A') AS id,
  concat('N0', 200 + 100 * (scene_index % 4)) AS token FROM joined)"""


def _scene_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joined(spark, sf_dir, ordered=False).select("scene_index", "tile", "day").distinct()
    letter = F.char(65 + F.col("scene_index") % 20)
    item = F.concat(F.lit("S2A_"), (31 + F.col("scene_index") % 20).cast("string"), F.lit("TC"), letter, F.lit("_"), F.date_format("day", "yyyyMMdd"), F.lit("_0_L2A"))
    return rows.withColumn("id", item).withColumn("token", F.concat(F.lit("N0"), (200 + 100 * (F.col("scene_index") % 4)).cast("string")))


@query(sql("""SELECT id, regexp_extract(id, '^S2[^_]*_([0-9]{1,2}[A-Z]{3})_', 1) AS tile, strftime(strptime(regexp_extract(id, '_(\\d{8})_', 1), '%Y%m%d'), '%Y-%m-%d') AS day FROM ids""", SCENE_IDS))
def tile_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _scene_ids(spark, sf_dir)
    return ids.select("id", temporal.tile_of_id(F.col("id")).alias("tile"), temporal.tile_and_day(F.col("id"))["day"].cast("string").alias("day"))


@query(sql("""SELECT id, CASE WHEN try_cast(substr(token, 2) AS DOUBLE) / 100 >= 4.0 THEN greatest(3000 - scene_index * 50 - 1000, 0) ELSE 3000 - scene_index * 50 END AS dn FROM ids""", SCENE_IDS))
def boa_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _scene_ids(spark, sf_dir).withColumn("full", F.concat("id", F.lit("_"), "token"))
    number = F.lit(3000) - F.col("scene_index") * 50
    return ids.select("id", atmosphere.boa_offset(number, F.lit("sentinel-2-l2a"), F.lit(None).cast("string"), F.col("full")).alias("dn"))


@query(sql("SELECT tile, CAST(regexp_extract(tile, '^(\\d{1,2})', 1) AS INTEGER) + CASE WHEN tile LIKE '__S%' THEN 32600 WHEN substr(tile, 3, 1) >= 'N' THEN 32600 ELSE 32700 END AS epsg FROM (SELECT DISTINCT regexp_extract(id, '^S2[^_]*_([0-9]{1,2}[A-Z]{3})_', 1) AS tile FROM ids)", SCENE_IDS))
def mgrs_epsg(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = _scene_ids(spark, sf_dir).select(temporal.tile_of_id(F.col("id")).alias("tile")).distinct()
    return tiles.select("tile", temporal.epsg_of_tile(F.col("tile")).alias("epsg"))


@query("SELECT s_suppkey, strftime(unnest(range(DATE '1997-01-01' + CAST(s_suppkey % 50 AS INTEGER), DATE '1997-02-28' + 1, INTERVAL 7 DAY)), '%Y-%m-%d') AS day FROM supplier")
def stride_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_add(F.lit("1997-01-01").cast("date"), (F.col("s_suppkey") % 50).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(temporal.stride(start, F.lit("1997-02-28").cast("date"), 7)).alias("day")).withColumn("day", F.col("day").cast("string"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, (day(o_orderdate) % 10) / 10.0::DOUBLE AS aod FROM orders WHERE o_orderstatus = 'F')
  SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS kept FROM lineitem LEFT JOIN d ON CAST(l_shipdate AS DATE) = d.day WHERE coalesce(aod <= 0.4, true) GROUP BY 1""")
def aod_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of days within the limit of optical depth; unknown days stay."""
    from skyweave.plans.pipelines import gate_by_aod

    by_day = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderdate").cast("date").alias("day"), (F.dayofmonth("o_orderdate") % 10 / 10.0).alias("aod")).distinct()
    kept = gate_by_aod(observations(spark, sf_dir, ordered=False), by_day, 0.4)
    return kept.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("kept"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(y / (1 + 0.145 * y), 0), 9) AS corrected FROM (SELECT *, 1.27 * l_discount - 0.08 AS y FROM lineitem)")
def sixs_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = atmosphere.correct(F.col("l_discount"), F.lit(1.27), F.lit(0.08), F.lit(0.145))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(out, 9).alias("corrected"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(1.1 + 0.02 * w, 6) AS xap, round(0.05 + 0.01 * w, 6) AS xbp, round(0.1 - 0.005 * w, 6) AS xcp FROM (SELECT *, least(greatest(0.5 + 50 * l_tax, 0.5), 4.0) AS w FROM lineitem)")
def lut_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients at a water vapour, clamped to the nodes."""
    nodes = [0.5, 1.5, 2.5, 3.5, 4.0]

    def values(a: float, b: float) -> Column:
        return F.array(*(F.lit(a + b * n) for n in nodes))

    c = atmosphere.coefficients(F.array(*(F.lit(n) for n in nodes)), values(1.1, 0.02), values(0.05, 0.01), values(0.1, -0.005), F.col("l_tax") * 50 + 0.5)
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", c.alias("c")).select("l_orderkey", "l_linenumber", "l_partkey", "c.*"), "xap", "xbp", "xcp")


_RT = """rt AS (SELECT *, 0.008569 * lam ** -4 * (1 + 0.0113 * lam ** -2 + 0.00013 * lam ** -4) AS tr, aod * (lam / 0.55) ** -1.2 AS ta, cos(radians(28)) AS ms, cos(radians(5)) AS mv,
  sin(radians(28)) * sin(radians(5)) * cos(radians(120)) - cos(radians(28)) * cos(radians(5)) AS ct FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS rho, 0.05 + l_tax AS aod, 0.443 + 0.1 * (l_linenumber % 4) AS lam FROM lineitem)),
rt2 AS (SELECT *, (tr * 0.75 * (1 + ct * ct) + 0.95 * ta * (1 - 0.65 ** 2) / (1 + 0.65 ** 2 - 1.3 * ct) ** 1.5) / (4 * ms * mv) AS p, exp(-(0.5 * tr + ta * (1 - 0.95 * 0.65)) * (1 / ms + 1 / mv)) AS t, 0.92 * tr + 0.33 * ta AS s FROM rt)"""


@query(f"WITH {_RT} SELECT l_orderkey, l_linenumber, l_partkey, round(p + t * rho / (1 - s * rho), 6) AS toa, round(rho, 6) AS surface FROM rt2")
def rt_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward transfer to the top of the atmosphere, and back."""
    rows = table(spark, sf_dir, "lineitem").withColumn("o", atmosphere.optics(F.col("l_tax") + 0.05, F.col("l_linenumber") % 4 * 0.1 + 0.443))
    o = [F.col(f"o.{c}") for c in ("path", "transmission", "albedo")]
    toa = atmosphere.forward(F.col("l_discount"), *o)
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", toa.alias("toa"), atmosphere.inverse(toa, *o).alias("surface")), "toa", "surface")


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax * (550.0 / 500.0) ** -(1 + l_discount), 9) AS aod FROM lineitem")
def aod_wavelength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(atmosphere.aod_at(F.col("l_tax"), F.col("l_discount") + 1), 9).alias("aod"))


PICKS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, tile ORDER BY round(mean_clear, 9) DESC NULLS LAST, round(usable_fraction, 9) DESC, scene_index) AS r,
  min(scene_index) OVER (PARTITION BY chunk_id, tile) + 1000000 AS o FROM tiled WHERE usable_fraction > 0),
picks AS (SELECT chunk_id, scene_index, row_number() OVER (PARTITION BY chunk_id ORDER BY r, o, scene_index) AS pick FROM ranked WHERE r <= 2)"""


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_scenes.top_k_by_chunk(select_scenes.eligible(_chunk_stats(spark, sf_dir)), 2)


@query(sql("SELECT * FROM picks", STATS, PICKS))
def topk_chunk_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


CHUNK_TILES = """chunk_tiles AS (SELECT chunk_id, tile, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, tile) AS tile_ord FROM joined GROUP BY chunk_id, tile)"""


def _chunk_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = joined(spark, sf_dir, ordered=False).groupBy("chunk_id", "tile").agg(F.count("*").alias("n"))
    return counts.select("chunk_id", "tile", F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.col("n").desc(), "tile")).alias("tile_ord"))


@query(sql("""SELECT scene_index, row_number() OVER (ORDER BY u, scene_index) AS compose_order FROM (SELECT scene_index, min(struct_pack(c := chunk_id, t := tile_ord, r := r)) AS u FROM (
  SELECT *, row_number() OVER (PARTITION BY tile ORDER BY mean_clear DESC, scene_index) AS r FROM stiled WHERE usable_fraction > 0 AND mean_clear IS NOT NULL) JOIN chunk_tiles USING (tile) WHERE r <= 3 GROUP BY 1)""", SCENE, CHUNK_TILES))  # fmt: skip
def topk_scene_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_scenes.top_k_by_scene(_scene_stats(spark, sf_dir), _chunk_tiles(spark, sf_dir), 3)


@query(sql("""SELECT scene_index, row_number() OVER (ORDER BY r, tile, scene_index) AS compose_order FROM (SELECT *, row_number() OVER (PARTITION BY tile ORDER BY mean_clear DESC, scene_index) AS r
  FROM stiled WHERE usable_fraction > 0 AND mean_clear IS NOT NULL) WHERE r <= 3""", SCENE))  # fmt: skip
def topk_roundrobin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_scenes.top_k_by_tile(_scene_stats(spark, sf_dir), 3)


@query(sql("""SELECT chunk_id, scene_index, pick, round(covered_before, 6) AS covered_before FROM (SELECT *, 1 - exp(coalesce(sum(CASE WHEN f >= 1 THEN -1e9 ELSE ln(1 - f) END) OVER (PARTITION BY chunk_id ORDER BY pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS covered_before
  FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY f DESC, scene_index) AS pick FROM (SELECT scene_index, chunk_id, count_if(scl IN (4, 5, 6, 11)) / count(*) AS f FROM obs GROUP BY ALL) WHERE f > 0.02))
  WHERE pick <= 8 AND (pick <= 2 OR covered_before < 0.98)"""))  # fmt: skip
def coverage_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    fractions = scout.clear_fraction(observations(spark, sf_dir, ordered=False), quality.scl_clear(F.col("scl")))
    kept = select_scenes.by_coverage(fractions, ["chunk_id"], "clear_fraction", [F.col("scene_index")])
    return rounded(kept.select("chunk_id", "scene_index", "pick", "covered_before"), "covered_before")


@query(sql("SELECT chunk_id, tile, scene_index, pick FROM step WHERE pick > 0", MASKS, """dense AS (SELECT chunk_id, tile, scene_index, coalesce(max(valid_mask) FILTER (word = 0), 0) AS v0, coalesce(max(valid_mask) FILTER (word = 1), 0) AS v1,
  coalesce(max(clear_mask) FILTER (word = 0), 0) AS c0, coalesce(max(clear_mask) FILTER (word = 1), 0) AS c1 FROM masks JOIN scn USING (scene_index) GROUP BY ALL HAVING c0 <> 0 OR c1 <> 0),
reach AS (SELECT chunk_id, tile, bit_or(c0) AS r0, bit_or(c1) AS r1 FROM dense GROUP BY ALL),
cand AS (SELECT dense.*, bit_count(r0)::INTEGER + bit_count(r1) AS reachable, (bit_count(r0 & ~v0)::INTEGER + bit_count(r1 & ~v1)) * 100 <= bit_count(r0)::INTEGER + bit_count(r1) AS whole FROM dense JOIN reach USING (chunk_id, tile)),
step AS (SELECT chunk_id, tile, NULL::BIGINT AS scene_index, 0 AS pick, 0::BIGINT AS a0, 0::BIGINT AS a1, []::BIGINT[] AS used FROM reach UNION ALL
  SELECT chunk_id, tile, w.s, pick + 1, a0 | w.c0, a1 | w.c1, list_append(used, w.s) FROM (
    SELECT step.chunk_id, step.tile, step.pick, step.a0, step.a1, step.used, max(bit_count(cand.c0 & ~step.a0) + bit_count(cand.c1 & ~step.a1)) AS most,
      arg_max(struct_pack(s := cand.scene_index, c0 := cand.c0, c1 := cand.c1), struct_pack(h := bit_count(cand.c0 & ~step.a0) + bit_count(cand.c1 & ~step.a1) > 0, f := whole, g := bit_count(cand.c0 & ~step.a0) + bit_count(cand.c1 & ~step.a1), s := -cand.scene_index)) AS w
    FROM step JOIN cand ON cand.chunk_id = step.chunk_id AND cand.tile = step.tile
    WHERE NOT list_contains(step.used, cand.scene_index) AND step.pick < 8 AND (step.pick < 2 OR (bit_count(step.a0) + bit_count(step.a1)) / reachable < 0.95)
    GROUP BY ALL) WHERE pick < 2 OR most > 0)""").replace("WITH", "WITH RECURSIVE", 1))  # fmt: skip
def adaptive_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy cover of every chunk and tile."""
    words = _masks(spark, sf_dir).join(scenes(spark, sf_dir), "scene_index").groupBy("chunk_id", "tile", "scene_index")
    dense = words.agg(*(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda w: F.coalesce(F.element_at(F.map_from_arrays(F.collect_list("word"), F.collect_list(m)), w), F.lit(0).cast("long"))).alias(f"{m[:5]}_words") for m in ("valid_mask", "clear_mask")))
    return select_scenes.adaptive(dense)


@query(sql("SELECT pid, w.scene_index AS scene_index, w.quality AS quality, observation_count FROM best", STATS, PICKS, f"""best AS (SELECT pid, arg_min(struct_pack(scene_index := scene_index, quality := quality), struct_pack(s := quality * 1e6 + coalesce(sample_index, 0) + pick, o := pick, p := obs_order)) AS w,
  count(*) AS observation_count FROM obs JOIN picks USING (chunk_id, scene_index) WHERE {STRICT} GROUP BY pid)"""))  # fmt: skip
def plan_semi_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only planned scenes of every chunk compete, in the order of the plan."""
    from skyweave.plans.pipelines import compose_plan

    # the columns that number observations decide ties themselves, so nothing is numbered before the plan prunes
    obs = with_quality(observations(spark, sf_dir, ordered=False))
    return compose_plan(obs, _plan(spark, sf_dir), ["pid"], list(BANDS), order=ORDER).select("pid", "scene_index", "quality", "observation_count")


@query(sql("SELECT chunk_id FROM (SELECT DISTINCT chunk_id FROM px) EXCEPT SELECT chunk_id FROM tiled WHERE usable_fraction > 0.99 AND mean_clear >= 0.75", STATS))
def empty_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks for which no scene is good enough."""
    good = select_scenes.eligible(_chunk_stats(spark, sf_dir), 0.75).where("usable_fraction > 0.99")
    return pixels(spark, sf_dir).select("chunk_id").distinct().join(good.select("chunk_id").distinct(), "chunk_id", "left_anti")


@query("SELECT y AS year, m AS month, strftime(last_day(make_date(y, m, 1)), '%Y-%m-%d') AS month_end, format('{:04d}-{:02d}', y, m) AS period FROM (SELECT DISTINCT year(o_orderdate)::INTEGER AS y FROM orders), (SELECT DISTINCT month(o_orderdate)::INTEGER AS m FROM orders)")
def period_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month of every year that the orders are of."""
    from skyweave.plans.pipelines import periods_of

    return periods_of(table(spark, sf_dir, "orders"), F.col("o_orderdate")).withColumn("month_end", F.col("month_end").cast("string"))


@query(sql(f"""SELECT pid, period, w.b0 AS b0, w.scene_index AS scene_index, n AS observation_count FROM (SELECT pid, period, arg_min(struct_pack(b0 := b0, scene_index := scene_index), {SCORE}) AS w, count(*) AS n FROM obs WHERE {STRICT} GROUP BY ALL)"""))
def monthly_best_pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A composite for every month in one job: the period is one more key."""
    obs = with_quality(observations(spark, sf_dir))
    won = compose.best_pixel(obs, ["pid", "period"], list(BANDS), ["scene_index"])
    return won.select("pid", "period", "b0", "scene_index", "observation_count")


@query(sql("SELECT id, arg_min(scene_index, struct_pack(d := day, s := scene_index)) AS scene_index, count(*) AS copies FROM (SELECT concat(tile, '_', strftime(day, '%Y%m')) AS id, scene_index, day FROM ids) GROUP BY id", SCENE_IDS))
def dedup_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _scene_ids(spark, sf_dir).select(F.concat("tile", F.lit("_"), F.date_format("day", "yyyyMM")).alias("id"), "scene_index", "day")
    return ids.groupBy("id").agg(F.min_by("scene_index", F.struct("day", "scene_index")).alias("scene_index"), F.count("*").alias("copies"))


@query(sql("SELECT tile, strftime(day, '%Y-%m-%d') AS day, min(scene_index) AS scene_index FROM ids GROUP BY ALL", SCENE_IDS))
def first_scene_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scene_ids(spark, sf_dir).groupBy("tile", F.col("day").cast("string").alias("day")).agg(F.min("scene_index").alias("scene_index"))


@query(sql("SELECT id, row_number() OVER (ORDER BY strftime(day, '%Y-%m-%d'), id, scene_index) - 1 AS position FROM ids", SCENE_IDS))
def ordered_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every listing by time, id and scene, repeated ids included."""
    from skyweave.operators.ordering import numbered

    return numbered(_scene_ids(spark, sf_dir), F.col("day"), ["day", "id", "scene_index"], "position").select("id", "position")


@query(sql("SELECT id, row_number() OVER (ORDER BY strftime(day, '%Y-%m-%d'), id) - 1 AS position FROM (SELECT DISTINCT id, day FROM ids)", SCENE_IDS))
def all_scenes_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position of every scene by time and id, one of each id."""
    from skyweave.sources import catalog

    stamp = F.create_map(F.lit("datetime"), F.date_format("day", "yyyy-MM-dd"))
    items = _scene_ids(spark, sf_dir).select("id", F.lit("c").alias("collection"), stamp.alias("properties"))
    return catalog.scenes(items).select("id", F.col("scene_index").alias("position"))


@query("SELECT s_suppkey, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS epsg, CAST(floor((lon + 180) / 6) + 1 AS INTEGER) + 32600 AS north_epsg FROM (SELECT s_suppkey, s_suppkey * 3.5 % 360 - 180 AS lon, s_nationkey * 6.0 - 72 AS lat FROM supplier)")
def utm_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = F.col("s_suppkey") * 3.5 % 360 - 180, F.col("s_nationkey") * 6.0 - 72
    return table(spark, sf_dir, "supplier").select("s_suppkey", temporal.utm_epsg(lon, lat).alias("epsg"), temporal.utm_epsg(lon, lat, True).alias("north_epsg"))


@query("SELECT s_suppkey, floor(s_acctbal / 60) * 60 AS low, ceil((s_acctbal + 1000) / 60) * 60 AS high FROM supplier")
def snap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = grid.snap_columns(F.col("s_acctbal"), F.col("s_acctbal") + 1000, 60.0)
    return table(spark, sf_dir, "supplier").select("s_suppkey", low.alias("low"), high.alias("high"))


@query("""SELECT s_suppkey, r * nc + c AS chunk_id, r * 512 AS "row", c * 512 AS col, least(512, h - r * 512) AS height, least(512, w - c * 512) AS width FROM (SELECT *, unnest(range(0, nc)) AS c FROM (SELECT *, unnest(range(0, (h + 511) // 512)) AS r FROM (SELECT s_suppkey, 300 + s_suppkey * 11 AS h, 700 + s_suppkey * 13 AS w, (700 + s_suppkey * 13 + 511) // 512 AS nc FROM supplier)))""")
def chunk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "supplier").select("s_suppkey", (300 + F.col("s_suppkey") * 11).cast("int").alias("h"), (700 + F.col("s_suppkey") * 13).cast("int").alias("w"))
    return grid.chunk_rows(sizes, 512)


@query(sql("""SELECT scene_index, min(chunk_id // 5 * 10) AS "row", min(chunk_id % 5 * 10) AS col, max(chunk_id // 5 * 10 + 10) - min(chunk_id // 5 * 10) AS height, max(chunk_id % 5 * 10 + 10) - min(chunk_id % 5 * 10) AS width,
  (max(chunk_id // 5 * 10 + 10) - min(chunk_id // 5 * 10)) * (max(chunk_id % 5 * 10 + 10) - min(chunk_id % 5 * 10)) / 1e6 AS megapixels FROM picks GROUP BY 1""", STATS, PICKS))  # fmt: skip
def scene_fetch_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _plan(spark, sf_dir).select("scene_index", (F.floor(F.col("chunk_id") / 5) * 10).alias("row"), (F.col("chunk_id") % 5 * 10).alias("col"), F.lit(10).alias("height"), F.lit(10).alias("width"))
    return grid.fetch_window(chunks, ["scene_index"])


SRC = """src AS (SELECT "row", col, CAST(2000 + (pid * 37) % 900 AS INTEGER) AS v FROM px), dims AS (SELECT max("row") + 1 AS h, 50 AS w FROM px)"""


def _source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).select("row", "col", (2000 + F.col("pid") * 37 % 900).cast("int").alias("v"))


@query(sql("""SELECT px.pid, coalesce(v, 255) AS v FROM px LEFT JOIN src ON src."row" = CAST(floor(px."row" * 0.7::DOUBLE + 3.2::DOUBLE) AS INTEGER) AND src.col = CAST(floor(px.col * 1.1::DOUBLE - 2.4::DOUBLE) AS INTEGER)""", SRC))
def nearest_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.nearest(pixels(spark, sf_dir).select("pid", F.col("row").alias("y"), F.col("col").alias("x")), _source(spark, sf_dir), F.col("y") * 0.7 + 3.2, F.col("x") * 1.1 - 2.4, "v", 255)
    return out.select("pid", "v")


@query(sql("""SELECT pid, CASE WHEN count(v) = 4 THEN CAST(floor(sum(wt * v) / sum(wt) + 0.5) AS INTEGER) ELSE 65535 END AS v FROM (
  SELECT pid, CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END AS wt, CAST(floor(y) AS INTEGER) + dy AS r, CAST(floor(x) AS INTEGER) + dx AS c
  FROM (SELECT pid, "row" * 0.75 + 0.625 - 0.5 AS y, col * 0.875 + 2.25 - 0.5 AS x FROM px), (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)) LEFT JOIN src ON src."row" = r AND src.col = c GROUP BY pid""", SRC))  # fmt: skip
def bilinear_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = pixels(spark, sf_dir).select("pid", F.col("row").alias("y"), F.col("col").alias("x"))
    return resample.bilinear(target, _source(spark, sf_dir), ["pid"], F.col("y") * 0.75 + 0.625, F.col("x") * 0.875 + 2.25, "v", 1 << 20, 50, strict=True)


@query(sql("""SELECT cr, cc, unnest(range(cr * 8 // 10, (cr * 8 + 7) // 10 + 1)) * 5 + c AS chunk_id FROM (SELECT cr, cc, unnest(range(cc * 8 // 10, (cc * 8 + 7) // 10 + 1)) AS c FROM (SELECT DISTINCT "row" // 8 AS cr, col // 8 AS cc FROM px WHERE col < 48))"""))
def coarse_cell_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = pixels(spark, sf_dir).where("col < 48").select(F.floor(F.col("row") / 8).cast("int").alias("cr"), F.floor(F.col("col") / 8).cast("int").alias("cc")).distinct()
    return cells.select("cr", "cc", F.explode(grid.overlapped_chunks(F.col("cr"), F.col("cc"), 8, 10, 5)).alias("chunk_id"))


@query(sql("""SELECT "row" // 4 AS "row", col // 4 AS col, round(avg(cs), 6) AS cs FROM obs GROUP BY ALL"""))
def coarse_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(resample.coarse_mean(observations(spark, sf_dir, ordered=False), 4, "cs"), "cs")


_SECONDS = "epoch(ts)"


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


@query(f"""WITH l AS (SELECT event_id, {_SECONDS} AS t FROM events WHERE event_type = 'error'), r AS (SELECT event_id AS match, {_SECONDS} AS u FROM events WHERE event_type = 'view')
  SELECT event_id, arg_min(match, struct_pack(g := abs(t - u), m := match)) AS match, round(min(abs(t - u)), 3) AS gap FROM l JOIN r ON u BETWEEN t - 300 AND t + 300 GROUP BY 1""")
def asof_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    right = _events(spark, sf_dir, "view").withColumnRenamed("event_id", "match")
    out = asof.nearest(_events(spark, sf_dir, "error"), right, "event_id", F.col("at"), F.col("at"), ["match"], "match", 300)
    return rounded(out, "gap", places=3)


@query(f"""WITH l AS (SELECT event_id, {_SECONDS} AS t FROM events WHERE event_type = 'error'), r AS (SELECT value, {_SECONDS} AS u FROM events WHERE event_type = 'purchase')
  SELECT event_id, round(avg(value), 6) AS mean, count(value) AS n FROM l LEFT JOIN r ON u BETWEEN t - 10800 AND t + 10800 GROUP BY 1""")
def interval_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.interval_mean(_events(spark, sf_dir, "error"), _events(spark, sf_dir, "purchase"), "event_id", F.col("at"), F.col("at"), "value", 10800)
    return rounded(out, "mean")


def _product(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    obs = with_quality(observations(spark, sf_dir)).where(F.col("scene_index") % 2 == parity)
    return compose.best_pixel(obs, ["pid"], list(BANDS), ["scene_index"]).select("pid", "b0")


_PRODUCT = "{1} AS (SELECT pid, arg_min(b0, " + SCORE + ") AS {2} FROM obs WHERE scene_index % 2 = {0} AND " + STRICT + " GROUP BY pid)"


@query(sql("""SELECT count_if(x IS NOT NULL AND y IS NOT NULL)::BIGINT AS joint, count_if(y IS NULL)::BIGINT AS only_a, count_if(x IS NULL)::BIGINT AS only_b, round(max(abs(y - x)), 6) AS max_abs, round(avg(abs(y - x)), 6) AS mean_abs,
  round(median(abs(y - x)), 6) AS median_abs, round(quantile_cont(abs(y - x), 0.95), 6) AS p95_abs, round(sqrt(avg((y - x) ** 2)), 6) AS rmse, round(avg(y - x), 6) AS bias, round(corr(y, x), 6) AS r,
  round(regr_r2(y, x), 6) AS r2, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM pa FULL JOIN pb USING (pid)""", _PRODUCT.format(0, "pa", "x"), _PRODUCT.format(1, "pb", "y")))  # fmt: skip
def product_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.compare(_product(spark, sf_dir, 0), _product(spark, sf_dir, 1), ["pid"], "b0")
    return rounded(out, *[c for c in out.columns if c not in ("joint", "only_a", "only_b")])


def _every_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return rows.select("vec_id", F.slice("e", 4, 4).alias("anchor"), F.slice("e", 1, 3).alias("target"), F.slice("e", 1, 7).alias("spectrum"))


def _spectra(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every row, and the library of every row; of five folds a row meets the other four."""
    rows = _every_spectrum(spark, sf_dir).withColumn("fold", F.col("vec_id") % 5)
    return rows, rows.withColumnRenamed("vec_id", "lk")


_SPECTRA = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM e), l AS (SELECT vec_id AS lk, e AS le FROM e)"


@query(f"""WITH {_SPECTRA}, d AS (SELECT vec_id, lk, le, list_distance(e[4:7], le[4:7]) AS d FROM q JOIN l ON lk % 5 <> vec_id % 5),
  k AS (SELECT *, 1 / (d + 1e-6) AS w FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, lk) <= 10)
  SELECT vec_id, round(sum(w * le[1]) / sum(w), 6) AS t0, round(sum(w * le[2]) / sum(w), 6) AS t1, round(sum(w * le[3]) / sum(w), 6) AS t2, round(min(d), 6) AS distance FROM k GROUP BY 1""")
def knn_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask, library = _spectra(spark, sf_dir)
    out = spectra.knn(ask, library, "vec_id", "lk", "anchor", "target", own="fold", group="fold")
    return out.select("vec_id", *(F.round(F.col("prediction")[k], 6).alias(f"t{k}") for k in range(3)), F.round("distance", 6).alias("distance"))


@query(f"""WITH {_SPECTRA}, s AS (SELECT vec_id, lk, list_inner_product(e[1:7], le[1:7]) AS yl, list_inner_product(le[1:7], le[1:7]) AS ll FROM q JOIN l ON lk % 5 <> vec_id % 5)
  SELECT vec_id, arg_max(lk, struct_pack(s := yl / sqrt(ll), m := -lk)) AS match, round(arg_max(yl / ll, struct_pack(s := yl / sqrt(ll), m := -lk)), 6) AS gain FROM s GROUP BY 1""")
def cosine_1nn_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask, library = _spectra(spark, sf_dir)
    return rounded(spectra.cosine_match(ask, library, "vec_id", "lk", "spectrum", own="fold", group="fold"), "gain")


@query(sql("""SELECT chunk_id, arg_min(cand, struct_pack(c := c, k := cand)) AS cand, round(min(c), 6) AS cost FROM (SELECT chunk_id, cand, avg((b2 - cand / 200.0) ** 2 + 0.001 * abs(cs - cand / 20.0)) AS c FROM obs, range(0, 20) t(cand) GROUP BY ALL) GROUP BY 1"""))
def aod_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate of least mean cost of every pooled cell; candidates are made in place, without a join."""
    tried = observations(spark, sf_dir, ordered=False).select("chunk_id", "b2", "cs", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("cand"))
    costs = tried.withColumn("cost", F.pow(F.col("b2") - F.col("cand") / 200.0, F.lit(2.0)) + 0.001 * F.abs(F.col("cs") - F.col("cand") / 20.0))
    return rounded(spectra.grid_search(costs, "chunk_id", "cand", "cost"), "cost")


@query(sql("""SELECT chunk_id, round(any_value(m), 6) AS median, round(quantile_cont(b0, 0.9), 6) AS p90, round(quantile_cont(b0, 0.99), 6) AS p99, round(median(abs(b0 - m)), 6) AS mad FROM obs JOIN (SELECT chunk_id, median(b0) AS m FROM obs GROUP BY 1) USING (chunk_id) GROUP BY 1"""))
def robust_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.robust(observations(spark, sf_dir, ordered=False), ["chunk_id"], "b0"), "median", "p90", "p99", "mad")


@query(sql(f"SELECT scene_index, round({AOD}, 6) AS aod, place FROM (SELECT *, row_number() OVER (ORDER BY {AOD}, scene_index) AS place, greatest(round_even(count(*) OVER () * 0.6, 0), 1) AS k FROM scn) WHERE place <= k"))
def low_aod_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyweave.plans.pipelines import lowest_fraction

    return rounded(lowest_fraction(_aod(scenes(spark, sf_dir)), "aod", "scene_index", 0.6).select("scene_index", "aod", "place"), "aod")


@query(sql("SELECT chunk_id, round(regr_slope(b0, b2), 4) AS slope, round(regr_intercept(b0, b2), 5) AS intercept, round(avg(b2 - b0), 6) AS bias, count(*) AS n FROM obs GROUP BY 1 HAVING count(*) >= 10"))
def debias_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compare.debias(observations(spark, sf_dir, ordered=False), ["chunk_id"], "b2", "b0", 10)
    return out.select("chunk_id", F.round("slope", 4).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("bias", 6).alias("bias"), "n")


@query(sql("SELECT chunk_id, count(*) AS n, sha1(string_agg(id, ',' ORDER BY id)) AS signature FROM (SELECT DISTINCT chunk_id, concat(tile, '_', scene_index) AS id FROM joined) GROUP BY 1"))
def scene_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyweave.plans.store import signature

    ids = joined(spark, sf_dir, ordered=False).select("chunk_id", F.concat("tile", F.lit("_"), "scene_index").alias("id"))
    return ids.groupBy("chunk_id").agg(F.count_distinct("id").alias("n"), signature(F.collect_set("id")).alias("signature"))


@query("""SELECT s_suppkey, substr(sha256('{"name":"' || s_name || '","nation":' || s_nationkey || ',"resolution":60}'), 1, 24) AS request FROM supplier""")
def request_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyweave.plans.store import hash_columns

    request = hash_columns(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(60).alias("resolution")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", request.alias("request"))


@query(sql("SELECT pid, obs_order, CAST(sum(CAST(l_quantity AS BIGINT) * 4000) OVER (PARTITION BY pid ORDER BY obs_order ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) % 65536 AS BIGINT) AS sample FROM obs"))
def predictor_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undo horizontal differencing: running sums in 16 bits."""
    order = Window.partitionBy("pid").orderBy("obs_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return observations(spark, sf_dir).select("pid", "obs_order", (F.sum(F.col("l_quantity").cast("long") * 4000).over(order) % 65536).alias("sample"))


@query(sql("SELECT chunk_id, round(avg(CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM (SELECT px.pid, px.chunk_id, count(obs.pid) AS n FROM px LEFT JOIN obs ON obs.pid = px.pid AND obs.cs > 0.9 GROUP BY ALL) GROUP BY 1"))
def coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = observations(spark, sf_dir, ordered=False).where("cs > 0.9").groupBy("pid").agg(F.count("*").alias("observation_count"))
    full = pixels(spark, sf_dir).select("pid", "chunk_id").join(counted, "pid", "left")
    return rounded(compare.coverage(full, ["chunk_id"]), "coverage")


@query(sql("SELECT scene_index, count(*) AS n FROM obs JOIN scn USING (scene_index) WHERE day BETWEEN DATE '1996-03-01' AND DATE '1997-09-30' AND tile = 'T1' GROUP BY 1 HAVING count(*) >= 3"))
def temporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates inclusive at both ends, a tile, and a least number of samples."""
    kept = joined(spark, sf_dir, ordered=False).where("day between date'1996-03-01' and date'1997-09-30' and tile = 'T1'")
    return kept.groupBy("scene_index").agg(F.count("*").alias("n")).where("n >= 3")


@query(sql("SELECT pid, CASE WHEN w.b0 IS NULL THEN 0 ELSE CAST(floor(least(greatest(w.b0 * 0.1 * 3.5, 0), 1) * 255) AS INTEGER) END AS red FROM px LEFT JOIN best USING (pid)", PY))
def rgb_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = pixels(spark, sf_dir).select("pid").join(_best(spark, sf_dir), "pid", "left")
    return full.select("pid", codec.preview(F.col("b0") * 0.1).alias("red"))


@query("SELECT p_partkey, coalesce(nullif(trim(regexp_replace(p_name || ' #' || p_brand, '[^A-Za-z0-9._-]', '-', 'g'), '._-'), ''), 'value') AS token FROM part")
def asset_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyweave.plans.store import safe_token

    return table(spark, sf_dir, "part").select("p_partkey", safe_token(F.concat("p_name", F.lit(" #"), "p_brand")).alias("token"))


@query(f"WITH {_SPECTRA} SELECT vec_id FROM e WHERE list_min(list_transform(e[1:7], lambda x: abs(x))) > 0.001 AND list_max(e[1:7]) < 0.4")
def library_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra whose values are all finite and in range."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 7).alias("s"))
    return rows.where(F.forall("s", lambda x: quality.finite(x) & (F.abs(x) > 0.001)) & (F.array_max("s") < 0.4)).select("vec_id")


@query(f"""WITH {_SPECTRA}, d AS (SELECT vec_id, lk, le, e, list_distance(e[4:7], le[4:7]) AS d FROM q JOIN l ON lk % 5 <> vec_id % 5),
  k AS (SELECT *, 1 / (d + 1e-6) AS w FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, lk) <= 10),
  p AS (SELECT vec_id, any_value(e) AS e, sum(w * le[4]) / sum(w) AS p4, sum(w * le[5]) / sum(w) AS p5, sum(w * le[6]) / sum(w) AS p6, sum(w * le[7]) / sum(w) AS p7 FROM k GROUP BY 1)
  SELECT vec_id, round(sqrt(((e[4] - p4) ** 2 + (e[5] - p5) ** 2 + (e[6] - p6) ** 2 + (e[7] - p7) ** 2) / 4), 6) AS rmse FROM p""")
def knn_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well neighbours reproduce the anchors themselves."""
    ask, library = _spectra(spark, sf_dir)
    return rounded(spectra.reconstruction_residual(ask, library, "vec_id", "lk", "anchor", own="fold", group="fold").select("vec_id", "rmse"), "rmse")


@query(f"""WITH {_SPECTRA}, p AS (SELECT a.e AS x, b.e AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
  g AS (SELECT degrees(acos(least(greatest(list_inner_product(x[1:7], y[1:7]) / sqrt(list_inner_product(x[1:7], x[1:7]) * list_inner_product(y[1:7], y[1:7])), -1), 1))) AS a FROM p)
  SELECT round(avg(a), 5) AS mean_angle, round(median(a), 5) AS median_angle FROM g""")
def spectral_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 7).alias("a"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return rounded(compare.angles(pairs, "a", "b"), "mean_angle", "median_angle", places=5)


_THIRD = """whole AS (SELECT * FROM obs WHERE b0 IS NOT NULL AND b1 IS NOT NULL AND b2 IS NOT NULL),
m AS (SELECT avg(b0) AS m0, avg(b1) AS m1, avg(b2) AS m2, covar_samp(b0, b0) AS a, covar_samp(b1, b1) AS b, covar_samp(b2, b2) AS c, covar_samp(b0, b1) AS d, covar_samp(b0, b2) AS e, covar_samp(b1, b2) AS f FROM whole),
q AS (SELECT *, (a + b + c) / 3 AS q, sqrt(((a - (a + b + c) / 3) ** 2 + (b - (a + b + c) / 3) ** 2 + (c - (a + b + c) / 3) ** 2 + 2 * (d * d + e * e + f * f)) / 6) AS p FROM m),
r AS (SELECT *, least(greatest(((a - q) * ((b - q) * (c - q) - f * f) - d * (d * (c - q) - f * e) + e * (d * f - (b - q) * e)) / (2 * p ** 3), -1), 1) AS r FROM q),
l AS (SELECT *, q + 2 * p * cos(acos(r) / 3 + 2 * pi() / 3) AS l FROM r),
v AS (SELECT *, d * f - e * (b - l) AS v0, e * d - (a - l) * f AS v1, (a - l) * (b - l) - d * d AS v2 FROM l)"""


@query(sql("SELECT l_orderkey, l_linenumber, l_partkey, round(abs((b0 - m0) * v0 + (b1 - m1) * v1 + (b2 - m2) * v2) / sqrt(3 * (v0 * v0 + v1 * v1 + v2 * v2)), 5) AS residual FROM (SELECT l_orderkey, l_linenumber, l_partkey, b0, b1, b2 FROM obs), (SELECT m0, m1, m2, v0, v1, v2 FROM v)", _THIRD))
def pca_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every observation from the subspace of two components, fitted on whole ones: of three bands, along the third; null where a band is."""
    obs = observations(spark, sf_dir, ordered=False).select("l_orderkey", "l_linenumber", "l_partkey", *BANDS)
    mean, parts, _ = spectra.principal_components(obs.dropna(subset=list(BANDS)), list(BANDS))
    return rounded(spectra.subspace_residual(obs, list(BANDS), mean, parts[:2]).drop(*BANDS), "residual", places=5)


@query(sql("""SELECT chunk_id, c.k AS cand, round(c.s, 4) AS sharpness FROM (SELECT chunk_id, arg_min(struct_pack(k := cand, s := (before + after - 2 * cost) / cost), struct_pack(c := cost, k := cand)) AS c FROM (
  SELECT *, lag(cost, 5) OVER w AS before, lead(cost, 5) OVER w AS after FROM (SELECT chunk_id, cand, avg((b2 - cand / 200.0) ** 2) AS cost FROM obs, range(0, 20) t(cand) GROUP BY ALL) WINDOW w AS (PARTITION BY chunk_id ORDER BY cand)) GROUP BY 1)"""))  # fmt: skip
def cost_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    tried = observations(spark, sf_dir, ordered=False).select("chunk_id", "b2", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("cand"))
    curve = tried.groupBy("chunk_id", "cand").agg(F.avg(F.pow(F.col("b2") - F.col("cand") / 200.0, F.lit(2.0))).alias("cost"))
    return rounded(spectra.sharpness(curve, ["chunk_id"], "cand", "cost"), "sharpness", places=4)


@query(sql("SELECT round(corr(bias, aod), 6) AS r, round(regr_slope(bias, aod), 6) AS slope, count(*) AS n FROM (SELECT scene_index, avg(b0 - b2) AS bias, any_value(" + AOD + ") AS aod FROM obs GROUP BY 1)"))
def bias_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = _aod(observations(spark, sf_dir, ordered=False)).groupBy("scene_index").agg(F.avg(F.col("b0") - F.col("b2")).alias("bias"), F.first("aod").alias("aod"))
    return rounded(compare.trend(groups, "bias", "aod"), "r", "slope")


@query(sql("SELECT y AS year, count(*) AS n, round(avg(b0), 6) AS mean FROM (SELECT DISTINCT substr(period, 1, 4) AS y FROM obs) JOIN obs ON substr(period, 1, 4) <> y GROUP BY 1"))
def leave_one_year_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all years but one, from one pass: the total less the year."""
    years = observations(spark, sf_dir, ordered=False).groupBy(F.substring("period", 1, 4).alias("year")).agg(F.count("*").alias("k"), F.sum("b0").alias("s"))
    every = Window.partitionBy(F.lit(0))  # a row for each year
    out = years.select("year", (F.sum("k").over(every) - F.col("k")).alias("n"), (F.sum("s").over(every) - F.col("s")).alias("rest"))
    return out.select("year", "n", F.round(F.col("rest") / F.col("n"), 6).alias("mean"))


@query(sql("SELECT scene_index FROM obs GROUP BY 1 HAVING count(DISTINCT l_linenumber) = 7 AND count(b1) > 0"))
def required_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes that have every asset; others are dropped whole."""
    kept = observations(spark, sf_dir, ordered=False).groupBy("scene_index").agg(F.count_distinct("l_linenumber").alias("n"), F.count("b1").alias("m"))
    return kept.where("n = 7 and m > 0").select("scene_index")


@query(sql("""SELECT id, coalesce(a.aod, b.aod) AS aod, CASE WHEN a.aod IS NOT NULL THEN 'id' WHEN b.aod IS NOT NULL THEN 'tile and day' END AS found FROM ids
  LEFT JOIN (SELECT id AS i, min(scene_index % 9) AS aod FROM ids WHERE tile = 'T0' GROUP BY 1) a ON a.i = ids.id
  LEFT JOIN (SELECT tile AS t, day AS d, arg_min(scene_index % 9, scene_index) AS aod FROM ids WHERE tile <> 'T3' GROUP BY ALL) b ON b.t = ids.tile AND b.d = ids.day""", SCENE_IDS))  # fmt: skip
def sidecar_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correction records by scene id, else by tile and day, the first of several."""
    ids = _scene_ids(spark, sf_dir)
    records = ids.withColumn("aod", F.col("scene_index") % 9)
    first = records.where("tile = 'T0'").withColumn("order", F.col("aod")), records.where("tile <> 'T3'").withColumn("order", F.col("scene_index"))
    return asof.sidecar(ids.select("id", "tile", "day"), *first, "aod", "order").select("id", "aod", "found")


@query(sql("""SELECT chunk_id, min(CASE WHEN k >= 1 AND d >= 0 THEN k END) AS crossover FROM (SELECT chunk_id, l_linenumber AS k, avg(b2) - 0.04 AS d FROM obs GROUP BY ALL) GROUP BY 1"""))
def first_crossover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first number at which the mean reaches a limit; means at the limit are those of the table's own order."""
    obs = observations(spark, sf_dir, ordered=False, placed=True).select("chunk_id", F.col("l_linenumber").alias("k"), "b2", "place")
    curve = compare.means_over(obs, ["chunk_id", "k"], "b2", 0.04, "place", "d")
    return compare.crossover(curve, ["chunk_id"], "k", "k", "d")


@query("SELECT p_partkey, CASE WHEN c1 > c0 AND r1 > r0 THEN r0 END AS r, CASE WHEN c1 > c0 AND r1 > r0 THEN c0 END AS c, CASE WHEN c1 > c0 AND r1 > r0 THEN r1 - r0 END AS h, CASE WHEN c1 > c0 AND r1 > r0 THEN c1 - c0 END AS w FROM (SELECT p_partkey, CAST(least(greatest(floor((x - 1000) / 60), 0), 200) AS BIGINT) AS c0, CAST(least(greatest(ceil((x + 700 - 1000) / 60), 0), 200) AS BIGINT) AS c1, CAST(least(greatest(floor((9000 - y - 700) / 60), 0), 100) AS BIGINT) AS r0, CAST(least(greatest(ceil((9000 - y) / 60), 0), 100) AS BIGINT) AS r1 FROM (SELECT p_partkey, p_partkey * 7.0 AS x, p_size * 200.0 AS y FROM part))")
def image_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("p_partkey") * 7.0, F.col("p_size") * 200.0
    window = grid.image_window(x, y, x + 700, y + 700, 1000.0, 9000.0, 60.0, 100, 200)
    return table(spark, sf_dir, "part").select("p_partkey", window.alias("q")).select("p_partkey", F.col("q.row").alias("r"), F.col("q.col").alias("c"), F.col("q.height").alias("h"), F.col("q.width").alias("w"))


@query(sql("""SELECT i, j, avg(b2) AS value FROM (SELECT i, j FROM range(0, 10) a(i), range(0, 10) b(j)) LEFT JOIN obs ON obs."row" = i * 3 + 1 AND obs.col = j * 5 + 2 GROUP BY ALL""").replace("avg(b2)", "round(avg(b2), 6)"))
def point_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regular lattice of points over the stack, by position."""
    axis = F.sequence(F.lit(0), F.lit(9))
    points = spark.range(1).select(F.explode(axis).alias("i")).select("i", F.explode(axis).alias("j"))
    at = points.select("i", "j", (F.col("i") * 3 + 1).alias("row"), (F.col("j") * 5 + 2).alias("col"))
    met = at.join(observations(spark, sf_dir, ordered=False).select("row", "col", "b2"), ["row", "col"], "left")
    return rounded(met.groupBy("i", "j").agg(F.avg("b2").alias("value")), "value")


@query(sql("SELECT l_orderkey, l_linenumber, l_partkey, round((b0 - avg(b0) OVER ()) / stddev_pop(b0) OVER (), 5) AS b0, round((b2 - avg(b2) OVER ()) / stddev_pop(b2) OVER (), 5) AS b2 FROM obs"))
def standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = observations(spark, sf_dir, ordered=False).select("l_orderkey", "l_linenumber", "l_partkey", "b0", "b2")
    return rounded(spectra.standardise(obs, ["b0", "b2"]), "b0", "b2", places=5)


@query("SELECT o_orderkey, (month(o_orderdate) - 1 + 5) % 12 + 1 AS later, CASE WHEN month(o_orderdate) <= 2 THEN month(o_orderdate) + 10 ELSE month(o_orderdate) - 2 END AS earlier, strftime(last_day(o_orderdate), '%Y-%m-%d') AS month_end, strftime(o_orderdate, '%Y-%m') AS label FROM orders")
def month_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.month("o_orderdate")
    end = temporal.month_end(F.year("o_orderdate"), month)
    label = temporal.period_label(F.date_format("o_orderdate", "yyyy-MM-dd"), end.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.shift_month(month, 5).alias("later"), temporal.shift_month(month, -2).alias("earlier"), end.cast("string").alias("month_end"), label.alias("label"))


@query(sql("""SELECT pid, w.s AS scene_index, round(w.aod, 6) AS aod, round(greatest((1.27 * w.b0 - 0.08) / (1 + 0.145 * (1.27 * w.b0 - 0.08)), 0), 6) AS b0, round(greatest((1.2 * w.b2 - 0.07) / (1 + 0.12 * (1.2 * w.b2 - 0.07)), 0), 6) AS b2, n AS observation_count
  FROM (SELECT pid, arg_min(struct_pack(s := scene_index, aod := aod, b0 := b0, b2 := b2), struct_pack(a := aod, c := -cs, s := scene_index, o := obs_order)) AS w, count(*) AS n FROM hazy SEMI JOIN used USING (scene_index) WHERE cs > 0.6 GROUP BY pid)""",
  f"""low AS (SELECT scene_index, aod FROM (SELECT *, row_number() OVER (ORDER BY aod, scene_index) AS place, greatest(round_even(count(*) OVER () * 0.6, 0), 1) AS k FROM (SELECT scene_index, {AOD} AS aod FROM scn)) WHERE place <= k),
hazy AS (SELECT obs.*, aod FROM obs JOIN low USING (scene_index)),
share AS (SELECT scene_index, aod, avg(CASE WHEN cs > 0.6 THEN 1.0 ELSE 0.0 END) AS f FROM hazy GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (ORDER BY f DESC, aod, scene_index) AS pick FROM share WHERE f > 0.02),
covered AS (SELECT *, 1 - exp(coalesce(sum(CASE WHEN f >= 1 THEN -1e9 ELSE ln(1 - f) END) OVER (ORDER BY pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS before FROM placed),
used AS (SELECT scene_index FROM covered WHERE pick <= 8 AND (pick <= 2 OR before < 0.98))"""))  # fmt: skip
def corrected_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corrected build: least aerosol wins among the scenes that cover the area."""
    from skyweave.plans.pipelines import build_corrected

    c = _aod(scenes(spark, sf_dir)).select("scene_index", "aod", F.array(F.lit(1.27), F.lit(1.2)).alias("xap"), F.array(F.lit(0.08), F.lit(0.07)).alias("xbp"), F.array(F.lit(0.145), F.lit(0.12)).alias("xcp"))
    won = build_corrected(observations(spark, sf_dir), c, ["b0", "b2"])
    return rounded(won.select("pid", "scene_index", "aod", "b0", "b2", "observation_count"), "aod", "b0", "b2")


@query(sql(f"""SELECT px.pid, w.b0 AS b0, w.b1 AS b1, w.b2 AS b2, coalesce(w.scene_index, -1) AS scene_index, coalesce(w.quality, 65535) AS quality, w.obs_order AS obs_order, coalesce(n, 0) AS observation_count,
  {', '.join(f"round(CASE WHEN w.b{k} <> 0 THEN s{k} / abs(w.b{k}) * 100 END, 4) AS b{k}_unc" for k in range(3))}
  FROM px LEFT JOIN fbest USING (pid) LEFT JOIN (SELECT pid, {', '.join(f'stddev_pop(b{k}) AS s{k}' for k in range(3))} FROM obs WHERE {STRICT} GROUP BY pid) USING (pid)""",
  """fstats AS (SELECT scene_index, chunk_id, any_value(tile) AS tile, avg(CASE WHEN scl <> 0 THEN 1.0 ELSE 0.0 END) AS usable_fraction, avg(CASE WHEN scl IN (4, 5, 6, 11) THEN 1.0 WHEN scl <> 0 THEN 0.0 END) AS mean_clear FROM joined GROUP BY 1, 2),
franked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, tile ORDER BY round(mean_clear, 9) DESC NULLS LAST, round(usable_fraction, 9) DESC, scene_index) AS r,
  min(scene_index) OVER (PARTITION BY chunk_id, tile) + 1000000 AS o FROM fstats WHERE usable_fraction > 0),
fpicks AS (SELECT chunk_id, scene_index, row_number() OVER (PARTITION BY chunk_id ORDER BY r, o, scene_index) AS pick FROM franked WHERE r <= 3)""",
  f"""fbest AS (SELECT pid, arg_min(struct_pack(b0 := b0, b1 := b1, b2 := b2, scene_index := scene_index, quality := quality, obs_order := obs_order), struct_pack(s := quality * 1e6 + coalesce(sample_index, 0) + pick, o := pick, p := obs_order)) AS w,
  count(*) AS n FROM obs JOIN fpicks USING (chunk_id, scene_index) WHERE {STRICT} GROUP BY pid)"""))  # fmt: skip
def full_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build: scouting, ranked selection, composition, uncertainty."""
    from skyweave.plans.pipelines import Build, build_composite

    out = build_composite(joined(spark, sf_dir), pixels(spark, sf_dir).select("pid"), Build(strict=True, emit_uncertainty=True))
    return rounded(out, *(f"{b}_unc" for b in BANDS), places=4)


# every scene of a tile has a box of its own; boxes of a tile overlap, and areas come from the cells between all edges
BOXES = """boxes AS (SELECT tile, (scene_index * 37 % 11) * 24 + CAST(substr(tile, 2) AS INTEGER) * 160 AS x0, (scene_index * 53 % 7) * 16 AS y0, (scene_index * 37 % 11) * 24 + CAST(substr(tile, 2) AS INTEGER) * 160 + 96 + 8 * (scene_index % 5) AS x1, 60 * 10 + 16 * (scene_index % 9) AS y1 FROM scn),
chunks AS (SELECT chunk_id, col0 * 120 AS west, (row0 - row0 // 6 * 6) * 120 AS south, col0 * 120 + 120 AS east, (row0 - row0 // 6 * 6) * 120 + 120 AS north FROM (SELECT DISTINCT chunk_id, chunk_id % 5 AS col0, chunk_id // 5 AS row0 FROM px)),
xs AS (SELECT DISTINCT unnest([x0, x1]) AS x FROM boxes UNION SELECT unnest([west, east]) FROM chunks), ys AS (SELECT DISTINCT unnest([y0, y1]) AS y FROM boxes UNION SELECT unnest([south, north]) FROM chunks),
xc AS (SELECT x AS xa, lead(x) OVER (ORDER BY x) AS xb FROM xs), yc AS (SELECT y AS ya, lead(y) OVER (ORDER BY y) AS yb FROM ys),
cells AS (SELECT chunk_id, xa, xb, ya, yb, (xb - xa) * (yb - ya) AS a FROM chunks, xc, yc WHERE xa >= west AND xb <= east AND ya >= south AND yb <= north),
held AS (SELECT DISTINCT chunk_id, xa, ya, a, tile FROM cells JOIN boxes ON x0 <= xa AND x1 >= xb AND y0 <= ya AND y1 >= yb),
several AS (SELECT *, count(*) OVER (PARTITION BY chunk_id, xa, ya) AS n FROM held),
areas AS (SELECT chunk_id, tile, sum(a) AS own, coalesce(sum(a) FILTER (n = 1), 0) AS alone FROM several GROUP BY ALL),
needed AS (SELECT chunk_id, tile, alone FROM areas WHERE alone >= 256 UNION ALL SELECT chunk_id, arg_min(tile, struct_pack(o := -own, t := tile)), 0 FROM areas GROUP BY chunk_id HAVING max(alone) < 256),
reached AS (SELECT chunk_id, sum(a) AS a FROM (SELECT DISTINCT chunk_id, xa, ya, a FROM held) GROUP BY chunk_id)"""


@query(sql("""SELECT chunk_id, coalesce(tiles, '') AS tiles, coalesce(required, '') AS required, round(1 - coalesce(reached.a, 0) / 14400.0, 6) AS unreachable FROM chunks
  LEFT JOIN (SELECT chunk_id, string_agg(tile, ',' ORDER BY tile) AS tiles FROM areas GROUP BY 1) USING (chunk_id) LEFT JOIN (SELECT chunk_id, string_agg(tile, ',' ORDER BY alone DESC, tile) AS required FROM needed GROUP BY 1) USING (chunk_id) LEFT JOIN reached USING (chunk_id)""", BOXES))  # fmt: skip
def tile_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles that chunks need, from the footprints of every scene; those of a tile overlap."""
    from skyweave.operators import partition

    row, col = F.floor(F.col("chunk_id") / 5) % 6, F.col("chunk_id") % 5
    chunks = pixels(spark, sf_dir).select("chunk_id").distinct().select("chunk_id", (col * 120).alias("west"), (row * 120).alias("south"), (col * 120 + 120).alias("east"), (row * 120 + 120).alias("north"))
    s, t = F.col("scene_index"), F.substring("tile", 2, 9).cast("int") * 160
    x0, y0 = s * 37 % 11 * 24 + t, s * 53 % 7 * 16
    x1, y1 = x0 + 96 + 8 * (s % 5), 60 * 10 + 16 * (s % 9)
    ring = F.array(*(F.array(x.cast("double"), y.cast("double")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))))
    tiles = scenes(spark, sf_dir).groupBy("tile").agg(F.collect_set(ring).alias("rings"))
    out = partition.classify(chunks, tiles, 16.0)
    return out.select("chunk_id", F.array_join("tiles", ",").alias("tiles"), F.array_join("required", ",").alias("required"), F.round("unreachable", 6).alias("unreachable"))


_EVERY = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT * FROM e), l AS (SELECT vec_id AS lk, e AS le FROM e)"


@query(f"""WITH {_EVERY}, d AS (SELECT vec_id, lk, le, list_distance(e[4:7], le[4:7]) AS d FROM q JOIN l ON lk <> vec_id),
  k AS (SELECT *, 1 / (d + 1e-6) AS w FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, lk) <= 10)
  SELECT vec_id, round(sum(w * le[1]) / sum(w), 6) AS t0, round(sum(w * le[2]) / sum(w), 6) AS t1, round(sum(w * le[3]) / sum(w), 6) AS t2, round(min(d), 6) AS distance FROM k GROUP BY 1""")
def knn_predict_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``knn_predict`` of every row from all others."""
    rows = _every_spectrum(spark, sf_dir)
    out = spectra.knn(rows, rows.withColumnRenamed("vec_id", "lk"), "vec_id", "lk", "anchor", "target", own="vec_id")
    return out.select("vec_id", *(F.round(F.col("prediction")[k], 6).alias(f"t{k}") for k in range(3)), F.round("distance", 6).alias("distance"))


@query(f"""WITH {_EVERY}, s AS (SELECT vec_id, lk, list_inner_product(e[1:7], le[1:7]) AS yl, list_inner_product(le[1:7], le[1:7]) AS ll FROM q JOIN l ON lk <> vec_id)
  SELECT vec_id, arg_max(lk, struct_pack(s := yl / sqrt(ll), m := -lk)) AS match, round(arg_max(yl / ll, struct_pack(s := yl / sqrt(ll), m := -lk)), 6) AS gain FROM s GROUP BY 1""")
def cosine_1nn_gain_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cosine_1nn_gain`` of every row among all others."""
    rows = _every_spectrum(spark, sf_dir)
    return rounded(spectra.cosine_match(rows, rows.withColumnRenamed("vec_id", "lk"), "vec_id", "lk", "spectrum", own="vec_id"), "gain")


@query(f"""WITH {_EVERY}, d AS (SELECT vec_id, lk, le, e, list_distance(e[4:7], le[4:7]) AS d FROM q JOIN l ON lk <> vec_id),
  k AS (SELECT *, 1 / (d + 1e-6) AS w FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, lk) <= 10),
  p AS (SELECT vec_id, any_value(e) AS e, sum(w * le[4]) / sum(w) AS p4, sum(w * le[5]) / sum(w) AS p5, sum(w * le[6]) / sum(w) AS p6, sum(w * le[7]) / sum(w) AS p7 FROM k GROUP BY 1)
  SELECT vec_id, round(sqrt(((e[4] - p4) ** 2 + (e[5] - p5) ** 2 + (e[6] - p6) ** 2 + (e[7] - p7) ** 2) / 4), 6) AS rmse FROM p""")
def knn_residual_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``knn_residual`` of every row from all others."""
    rows = _every_spectrum(spark, sf_dir)
    out = spectra.reconstruction_residual(rows, rows.withColumnRenamed("vec_id", "lk"), "vec_id", "lk", "anchor", own="vec_id")
    return rounded(out.select("vec_id", "rmse"), "rmse")


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: abs(x::DOUBLE) + 0.02) AS e FROM embeddings),
rt AS (SELECT lam, k, k / 20 AS aod, 0.008569 * lam ** -4 * (1 + 0.0113 * lam ** -2 + 0.00013 * lam ** -4) AS tr, k / 20 * (lam / 0.55) ** -1.2 AS ta, cos(radians(28)) AS ms, cos(radians(5)) AS mv,
  sin(radians(28)) * sin(radians(5)) * cos(radians(120)) - cos(radians(28)) * cos(radians(5)) AS ct FROM (VALUES (1.6::DOUBLE), (2.2), (0.44), (0.49), (0.56)) w(lam), range(1, 17) c(k)),
o AS (SELECT lam, k, aod, (tr * 0.75 * (1 + ct * ct) + 0.95 * ta * (1 - 0.65 ** 2) / (1 + 0.65 ** 2 - 1.3 * ct) ** 1.5) / (4 * ms * mv) AS p, exp(-(0.5 * tr + ta * (1 - 0.95 * 0.65)) * (1 / ms + 1 / mv)) AS t, 0.92 * tr + 0.33 * ta AS s FROM rt),
q AS (SELECT vec_id, label, e, y1 / (1 + x.s * y1) AS a1, y2 / (1 + y.s * y2) AS a2 FROM (SELECT e.*, (e.e[1] - x.p) / x.t AS y1, (e.e[2] - y.p) / y.t AS y2 FROM e, (SELECT p, t, s FROM o WHERE lam = 1.6 AND k = 6) x, (SELECT p, t, s FROM o WHERE lam = 2.2 AND k = 6) y) z,
  (SELECT s FROM o WHERE lam = 1.6 AND k = 6) x, (SELECT s FROM o WHERE lam = 2.2 AND k = 6) y),
d AS (SELECT q.vec_id, l.vec_id AS lk, l.e AS le, sqrt((a1 - l.e[1]) ** 2 + (a2 - l.e[2]) ** 2) AS d FROM q JOIN e l ON l.vec_id <> q.vec_id),
n AS (SELECT *, 1 / (d + 1e-6) AS w FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, lk) <= 10),
p AS (SELECT vec_id, sum(w * le[3]) / sum(w) AS p1, sum(w * le[4]) / sum(w) AS p2, sum(w * le[5]) / sum(w) AS p3 FROM n GROUP BY 1),
c AS (SELECT label, a.aod, avg((a.p + a.t * p1 / (1 - a.s * p1) - e[3]) ** 2 + (b.p + b.t * p2 / (1 - b.s * p2) - e[4]) ** 2 + (f.p + f.t * p3 / (1 - f.s * p3) - e[5]) ** 2) AS cost
  FROM e JOIN p USING (vec_id), o a JOIN o b ON a.k = b.k JOIN o f ON a.k = f.k WHERE a.lam = 0.44 AND b.lam = 0.49 AND f.lam = 0.56 GROUP BY 1, 2)
SELECT label, arg_min(aod, struct_pack(c := cost, a := aod)) AS aod, round(min(cost), 6) AS cost FROM c GROUP BY 1""")  # fmt: skip
def aod_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optical depth pooled by label: anchors at a prior, neighbours among all other rows, a grid of candidates."""
    from skyweave.operators import inversion

    rows = table(spark, sf_dir, "embeddings").withColumn("e", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.abs(x) + 0.02))
    rows = rows.select("vec_id", "label", F.slice("e", 1, 2).alias("anchor"), F.slice("e", 3, 3).alias("target"))
    library = rows.select(F.col("vec_id").alias("lk"), "anchor", "target")
    waves = ([1.6, 2.2], [0.44, 0.49, 0.56])
    out = inversion.solve(rows, library, "vec_id", "lk", *waves, [k / 20 for k in range(1, 17)], "prior", F.lit(0.3), pool="label", apart=True)
    return rounded(out, "cost")


@query(sql("""SELECT i AS scene_index, r AS "row", c AS col, CASE WHEN r % 32 < 31 AND r + 1 < h THEN CAST(floor(avg(v) + 0.5) AS INTEGER) END AS v FROM (
  SELECT (r // 32) * 2 + c // 32 AS i, r, c, (SELECT max("row") + 1 FROM px) AS h FROM (SELECT unnest(range(0, (SELECT max("row") + 1 FROM px))) AS r), range(0, 50) t(c)) LEFT JOIN src ON src."row" IN (r, r + 1) AND src.col IN (c, c + 1) AND src."row" // 32 * 2 + src.col // 32 = i GROUP BY i, r, c, h""", SRC))
def scene_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes written as tiled TIFF files, read back by ranges half a pixel off, one window each."""
    from skyweave.plans import export
    from skyweave.sources import scenes as reader

    height = pixels(spark, sf_dir).agg(F.max("row") + 1).first()[0]
    there = grid.Grid(0.0, 0.0, 3000.0, 60.0 * height, 32631, 60.0)
    shifted = grid.Grid(30.0, -30.0, 3030.0, 60.0 * height - 30, 32631, 60.0)
    files = export.written(export.chunk_files(_source(spark, sf_dir), there, ["v"], 32, tile=16), export.shared_folder(spark))
    index = (F.col("row") / 32).cast("int") * 2 + (F.col("col") / 32).cast("int")
    assets = files.select(index.alias("scene_index"), "band", F.col("path").alias("href"))
    cut = spark.range(1).select(F.explode(grid.chunk_layout(F.lit(height), F.lit(50), 32)).alias("w")).select("w.*")
    windows = cut.select(F.col("chunk_id").alias("scene_index"), *cut.columns)
    return reader.scene_pixels(assets, windows, shifted, ["v"], nodata=65535).select("scene_index", "row", "col", "v")


FILED = """filed AS (SELECT scene_index, pid, "row", col, chunk_id, 1 + CAST(floor(l_extendedprice) AS BIGINT) % 5000 AS b0, CAST(round(l_tax * 100) AS INTEGER) - 3 AS b1, scl
  FROM obs QUALIFY row_number() OVER (PARTITION BY scene_index, pid ORDER BY obs_order) = 1)"""
# cells of two by two pixels hold the code of their first one; every chunk has 25 of them
SCOUTED = """gridded AS (SELECT s.scene_index, c.chunk_id, f.scl FROM scn s CROSS JOIN (SELECT r AS "row", k AS col, CAST((r // 10) * 5 + k // 10 AS INTEGER) AS chunk_id FROM range(0, (SELECT max("row") + 1 FROM px), 2) a(r), range(0, 50, 2) b(k)) c
  LEFT JOIN filed f ON f.scene_index = s.scene_index AND f."row" = c."row" AND f.col = c.col WHERE s.scene_index IN (SELECT scene_index FROM filed)),
fstats AS (SELECT scene_index, chunk_id, avg(CASE WHEN scl <> 0 THEN 1.0 ELSE 0.0 END) AS usable_fraction, avg(CASE WHEN scl IN (4, 5, 6, 11) THEN 1.0 WHEN scl <> 0 THEN 0.0 END) AS mean_clear FROM gridded GROUP BY ALL),
franked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, tile ORDER BY round(mean_clear, 9) DESC NULLS LAST, round(usable_fraction, 9) DESC, scene_index) AS r,
  min(scene_index) OVER (PARTITION BY chunk_id, tile) + 1000000 AS o FROM fstats JOIN scn USING (scene_index) WHERE usable_fraction > 0),
fpicks AS (SELECT chunk_id, scene_index, row_number() OVER (PARTITION BY chunk_id ORDER BY r, o, scene_index) AS pick FROM franked WHERE r <= 3),
fwon AS (SELECT "row", col, arg_min(struct_pack(b0 := b0, b1 := b1, scene_index := scene_index, quality := quality), struct_pack(s := quality * 1e6 + pick, o := pick)) AS w, count(*) AS n
  FROM (SELECT *, CASE WHEN scl IN (4, 5, 6, 11) THEN 0 WHEN scl = 7 THEN 1 WHEN scl IN (2, 3) THEN 2 ELSE 65535 END AS quality FROM filed JOIN fpicks USING (chunk_id, scene_index)) WHERE quality <= 32767 AND b0 > 0 AND b1 > 0 GROUP BY ALL)"""


def _scene_assets(spark: SparkSession, sf_dir: str, there: grid.Grid) -> DataFrame:
    """Every scene as tiled files with an overview: b0 unsigned, b1 signed, the class codes."""
    from skyweave.plans import export

    number = F.row_number().over(Window.partitionBy("scene_index", "pid").orderBy("obs_order"))
    first = observations(spark, sf_dir).withColumn("n", number).where("n = 1")
    b0, b1 = 1 + F.floor("l_extendedprice").cast("long") % 5000, F.round(F.col("l_tax") * 100).cast("int") - 3
    pixels_ = first.select("scene_index", "row", "col", b0.alias("b0"), b1.alias("b1"), "scl")
    files = export.written(export.scene_files(pixels_, there, ["b0", "b1", "scl"], tile=16, signed=("b1",), cropped=True), export.shared_folder(spark))
    return files.select(F.col("row").cast("long").alias("scene_index"), "band", F.col("path").alias("href"))


@query(sql("""SELECT g."row" AS "row", g.col AS col, CAST(w.b0 AS INTEGER) AS b0, CAST(w.b1 AS INTEGER) AS b1, coalesce(w.scene_index, -1) AS scene_index, coalesce(w.quality, 65535) AS quality, coalesce(n, 0) AS observation_count
  FROM (SELECT r AS "row", k AS col FROM range(0, (SELECT max("row") + 1 FROM px)) a(r), range(0, 50) b(k)) g LEFT JOIN fwon USING ("row", col)""", FILED, SCOUTED))  # fmt: skip
def composite_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole build from scene files: scouted at an overview, planned by chunk and tile, only planned windows read."""
    from skyweave.plans import build
    from skyweave.plans.pipelines import Build
    from skyweave.plans.shared import kept, shared_folder

    height = pixels(spark, sf_dir).agg(F.max("row") + 1).first()[0]
    there = grid.Grid(0.0, 0.0, 3000.0, 60.0 * height, 32631, 60.0)
    assets = kept(_scene_assets(spark, sf_dir, there))
    reading = build.Reading(aliases={"b0": "b0", "b1": "b1"}, headers=shared_folder(spark))
    out, _ = build.build_from_scenes(scenes(spark, sf_dir), assets, there, Build(strict=True, scout_factor=2), reading, chunk=10)
    return out.select("row", "col", "b0", "b1", "scene_index", "quality", "observation_count")


@query(sql("""SELECT 'v' AS band, lv AS level, "row" // p AS "row", col // p AS col, v AS value FROM src, (SELECT unnest([0, 1, 2]) AS lv, unnest([1, 2, 4]) AS p) WHERE "row" % p = 0 AND col % p = 0
  UNION ALL SELECT 'm', 0, "row", col, v FROM src UNION ALL SELECT 'm', 1, "row", col, v FROM once UNION ALL SELECT 'm', 2, "row" // 2, col // 2, CAST(floor(avg(v) + 0.5) AS INTEGER) FROM once GROUP BY ALL""",
  SRC, """once AS (SELECT "row" // 2 AS "row", col // 2 AS col, CAST(floor(avg(v) + 0.5) AS INTEGER) AS v FROM src GROUP BY ALL)"""))
def raster_file_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file a band, made in parallel, with overviews by every second pixel and by means; read back at all levels."""
    from skyweave.plans import export
    from skyweave.sources import rasters

    source = _source(spark, sf_dir)
    height = source.agg(F.max("row") + 1).first()[0]
    there = grid.Grid(0.0, 0.0, 3000.0, 60.0 * height, 32631, 60.0)
    files = export.band_files(source.withColumn("m", F.col("v")), there, ["v", "m"], export.shared_folder(spark), tile=16, levels=2, mean=("m",))
    paths = [r["path"] for r in files.select("path").collect()]  # two
    out = None
    for level in range(3):
        own = rasters.read_tiff(spark, paths, 2.0**level).where("value <> 65535").select(F.regexp_extract("path", r"(\w+)\.tif$", 1).alias("band"), F.lit(level).alias("level"), "row", "col", "value")
        out = own if out is None else out.unionByName(own)
    return out


@query(sql("""SELECT "row", col, CASE WHEN b0 < 3000 THEN b0 END AS b0, CASE WHEN b1 < 700 THEN b1 END AS b1, CASE WHEN b0 < 3000 AND b1 < 700 THEN greatest(q0, q1) ELSE 255 END AS quality FROM landed""",
  """landed AS (SELECT "row", col, CAST(pid % 3100 AS DOUBLE) AS b0, CAST(pid * 7 % 900 AS DOUBLE) AS b1, CAST(pid % 4 AS INTEGER) AS q0, CAST(pid // 5 % 3 AS INTEGER) AS q1 FROM px)"""))  # fmt: skip
def landed_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of several samples, two bands and their quality layers, written as it lands and read with layers matched by name."""
    from skyweave.plans import export
    from skyweave.sources import catalog, rasters

    height = pixels(spark, sf_dir).agg(F.max("row") + 1).first()[0]
    there = grid.Grid(0.0, 0.0, 3000.0, 60.0 * height, 32631, 60.0)
    b0, b1 = F.col("pid") % 3100, F.col("pid") * 7 % 900
    rows = pixels(spark, sf_dir).select("row", "col", F.when(b0 < 3000, b0).alias("b0"), F.when(b1 < 700, b1).alias("b1"), (F.col("pid") % 4).alias("q0"), (F.floor(F.col("pid") / 5) % 3).alias("q1"))
    layers = catalog.band_selection(["b0", "b1"], {"b0": "b0", "b1": "b1"}, {"b0": "q0", "b1": "q1"})
    files = export.written(export.stack_files(rows, there, layers, rows=16, strip=8), export.shared_folder(spark))
    read = rasters.read_stack(spark, [r["path"] for r in files.select("path").collect()], layers)
    row = F.regexp_extract("path", r"stack-(\d+)-0\.tif$", 1).cast("int") + F.col("row")
    whole = F.col("b0").isNotNull() & F.col("b1").isNotNull()
    worst = F.when(whole, quality.merged(F.col("q0"), F.col("q1")).cast("int")).otherwise(255)
    return read.select(row.alias("row"), "col", "b0", "b1", worst.alias("quality"))


@query(sql("""SELECT g AS granule, "row", col, CASE WHEN v % 7 <> 0 THEN CAST(v + k AS DOUBLE) END AS a, CAST((pid + k) % 250 AS DOUBLE) AS q FROM (SELECT px.pid, px."row", px.col, src.v FROM px JOIN src USING ("row", col)), (VALUES ('A2020001.h18v04', 0), ('A2020002.h18v04', 1)) t(g, k)""", SRC))
def granule_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of indexed containers, read by ranges of the chunks that the grid touches; granules of other tiles are not opened."""
    from skyweave.plans.shared import shared_folder
    from skyweave.sources import granules

    height, folder = pixels(spark, sf_dir).agg(F.max("row") + 1).first()[0], shared_folder(spark)
    size = 600 * -(-(height + 90) // 600)  # a tile of as many pixels as hold the grid
    step = grid.MODIS_TILE / size
    west, north = grid.MODIS_WEST + 18 * grid.MODIS_TILE + 70 * step, grid.MODIS_NORTH - 4 * grid.MODIS_TILE - 90 * step
    there = grid.Grid(west, north - (height - 1e-3) * step, west + (50 - 1e-3) * step, north, grid.SINUSOIDAL, step)
    every = F.explode(F.array(*(F.struct(F.lit(g).alias("granule"), F.lit(k).alias("k")) for g, k in (("A2020001.h18v04", 0), ("A2020002.h18v04", 1), ("A2020001.h19v04", 2)))))
    rows = _source(spark, sf_dir).select("row", "col", "v", (F.col("row") * 50 + F.col("col")).alias("pid"), every.alias("g"))
    value = F.when(F.col("v") % 7 == 0, -1).otherwise(F.col("v") + F.col("g.k"))
    made = rows.select("g.granule", (F.col("row") + 90).alias("row"), (F.col("col") + 70).alias("col"), value.cast("int").alias("a"), ((F.col("pid") + F.col("g.k")) % 250).cast("int").alias("q"))
    granules.write_containers(made, ["a", "q"], (size, size), folder, (64, 200), -1).count()
    read = granules.granule_pixels(granules.read_index(spark, f"{folder}/index"), there, ["a", "q"], size)
    return read.where("q is not null")  # every pixel of the table has a code


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
