"""Resampling as equality joins on source pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyweave.functions.quality import NODATA


def nearest(target: DataFrame, source: DataFrame, row: Column, col: Column, value: str, fill) -> DataFrame:
    """``target`` with the value of the source pixel that holds each position (in source pixels); outside it, fill."""
    at = target.withColumn("_r", F.floor(row).cast("int")).withColumn("_c", F.floor(col).cast("int"))
    own = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value))
    return at.join(own, ["_r", "_c"], "left").drop("_r", "_c").withColumn(value, F.coalesce(value, F.lit(fill)))


def bilinear(target: DataFrame, source: DataFrame, keys: list[str], row: Column, col: Column, value: str, height: int, width: int, strict: bool = False) -> DataFrame:
    """(keys, value): the weighted four source pixels around each position, rounded half up.

    Positions are in source pixels, pixel centres at halves.  At the left and
    right edges the weights of what is inside are scaled up; rows outside give
    no data.  ``strict``: all four pixels must be there.
    """
    y, x = row - 0.5, col - 0.5
    r0, c0 = F.floor(y), F.floor(x)
    at = target.select(*keys, r0.cast("int").alias("_r0"), c0.cast("int").alias("_c0"), (y - r0).alias("_fy"), (x - c0).alias("_fx"))
    corner = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (0, 1) for dx in (0, 1)))).alias("k")
    four = at.select("*", corner).select(
        *keys, (F.col("_r0") + F.col("k.dy")).alias("_r"), (F.col("_c0") + F.col("k.dx")).alias("_c"),
        (F.when(F.col("k.dy") == 1, F.col("_fy")).otherwise(1 - F.col("_fy")) * F.when(F.col("k.dx") == 1, F.col("_fx")).otherwise(1 - F.col("_fx"))).alias("_w"),
    )
    if not strict:  # rows are clamped inside the image: beyond them only with weight 0
        four = four.where((F.col("_w") > 0) | (F.col("_r").between(0, height - 1) & F.col("_c").between(0, width - 1)))
    own = source.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v"))
    met = four.join(own, ["_r", "_c"], "left")
    there = F.col("_v").isNotNull()
    weight = F.sum(F.when(there, F.col("_w")))
    lost = F.max((F.col("_w") > 0) & ~F.col("_r").between(0, height - 1)) if not strict else F.max(~there)
    out = F.floor(F.sum(F.when(there, F.col("_w") * F.col("_v"))) / weight + 0.5)
    return met.groupBy(*keys).agg(F.when(~lost & (weight > 0), out.cast("int")).otherwise(NODATA).alias(value))


def coarse_mean(pixels: DataFrame, factor: int, value: str, keys: list[str] = ()) -> DataFrame:
    """Means over cells of ``factor`` by ``factor`` pixels."""
    cell = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("row", "col")]
    return pixels.groupBy(*keys, *cell).agg(F.avg(value).alias(value))
