"""Optical depth by grid search: the candidate that explains a scene best, by pixel and pooled by cell.

The surface is predicted from anchor bands, which aerosol touches little, by
spectral neighbours; the candidate is judged on the other bands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions import atmosphere
from skyweave.operators.spectra import knn


def _each(values: Column, wavelengths: list[float], aod: Column, how) -> Column:
    """``how`` (transfer in either direction) applied to every band of an array."""
    out = []
    for k, wavelength in enumerate(wavelengths):
        o = atmosphere.optics(aod, F.lit(wavelength))
        out.append(how(F.get(values, F.lit(k)), o["path"], o["transmission"], o["albedo"]))
    return F.array(*out)


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def solve(
    toa: DataFrame, library: DataFrame, key: str, library_key: str, anchor_waves: list[float], target_waves: list[float], candidates: list[float],
    mode: str = "prior", prior: Column | None = None, k: int = 10, least_surface: float | None = None, pool: str | None = None, apart: bool = False,
) -> DataFrame:
    """(key or pool, aod, cost) for ``toa`` (key, anchor, target), arrays by band in micrometres.

    ``prior``: anchors are corrected once at a prior optical depth; ``raw``: not
    at all; ``iterate``, also without a prior: at every candidate.  A candidate
    that takes any band under ``least_surface`` is not feasible.  Ties go to the
    least candidate.  ``apart``: the library's row of the same key is left out.
    """
    own_key = "_own_key" if apart else None
    toa = toa.withColumn("_own_key", F.col(key))
    if mode not in ("prior", "raw", "iterate"):
        raise ValueError("mode must be prior, raw or iterate")
    mode = "iterate" if mode == "prior" and prior is None else mode
    grid = F.explode(F.array(*(F.lit(float(c)) for c in candidates))).alias("aod")
    keep = [c for c in dict.fromkeys([key, pool]) if c]
    if mode == "iterate":
        tried = toa.select(*keep, "_own_key", "anchor", "target", grid).withColumn("_id", F.struct(F.col(key).alias("k"), "aod"))
        ask = tried.select(F.to_json("_id").alias("_j"), "_own_key", _each(F.col("anchor"), anchor_waves, F.col("aod"), atmosphere.inverse).alias("anchor"))
        found = knn(ask, library, "_j", library_key, "anchor", "target", k, own=own_key).select("_j", "prediction")
        both = tried.withColumn("_j", F.to_json("_id")).join(found, "_j")
        surface = _each(F.col("target"), target_waves, F.col("aod"), atmosphere.inverse)
        cost = _square(F.col("prediction"), surface)
    else:
        own = F.col("anchor") if mode == "raw" else _each(F.col("anchor"), anchor_waves, prior, atmosphere.inverse)
        found = knn(toa.withColumn("anchor", own), library, key, library_key, "anchor", "target", k, own=own_key).select(key, "prediction")
        both = toa.select(*keep, "target").join(found, key).select("*", grid)
        surface = _each(F.col("target"), target_waves, F.col("aod"), atmosphere.inverse)
        cost = _square(_each(F.col("prediction"), target_waves, F.col("aod"), atmosphere.forward), F.col("target"))
    if least_surface is not None:
        cost = F.when(F.exists(surface, lambda x: x < least_surface), float("inf")).otherwise(cost)
    by = pool or key
    mean = both.withColumn("cost", cost).groupBy(by, "aod").agg(F.avg("cost").alias("cost"))
    return mean.groupBy(by).agg(F.min_by("aod", F.struct("cost", "aod")).alias("aod"), F.min("cost").alias("cost"))
