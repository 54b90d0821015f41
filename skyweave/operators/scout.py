"""Scouting: how usable and how clear scenes are, by chunk and over all, and coverage masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_stats(obs: DataFrame, valid: Column, score: Column, keys: list[str] = ("scene_index", "chunk_id")) -> DataFrame:
    """Usable share of all, and mean score of the valid; null if none is valid."""
    return obs.groupBy(*keys).agg(F.avg(valid.cast("double")).alias("usable_fraction"), F.avg(F.when(valid, score)).alias("mean_clear"))


def scene_stats(obs: DataFrame, valid: Column, clear: Column, keys: list[str] = ("scene_index",)) -> DataFrame:
    """Valid over total, and clear over valid."""
    total, good = F.count("*"), F.count_if(valid)
    return obs.groupBy(*keys).agg((good / total).alias("usable_fraction"), F.when(good > 0, F.count_if(valid & clear) / good).alias("mean_clear"))


def clear_fraction(obs: DataFrame, clear: Column, keys: list[str] = ("scene_index", "chunk_id")) -> DataFrame:
    """Clear over total, valid or not."""
    return obs.groupBy(*keys).agg((F.count_if(clear) / F.count("*")).alias("clear_fraction"))


def cell_masks(obs: DataFrame, cell: Column, valid: Column, clear: Column) -> DataFrame:
    """64-bit masks of a chunk's cells: valid if any observation is, clear if at least half of those are."""
    cells = obs.withColumn("cell", cell).groupBy("scene_index", "chunk_id", "cell").agg(F.count_if(valid).alias("seen"), F.count_if(valid & clear).alias("clear"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("cell") % 64).cast("int"))
    return (
        cells.where("seen > 0")
        .groupBy("scene_index", "chunk_id", F.floor(F.col("cell") / 64).cast("int").alias("word"))
        .agg(F.bit_or(bit).alias("valid_mask"), F.coalesce(F.bit_or(F.when(2 * F.col("clear") >= F.col("seen"), bit)), F.lit(0).cast("long")).alias("clear_mask"))
    )


def union_coverage(masks: DataFrame, keys: list[str] = ("chunk_id", "word")) -> DataFrame:
    """Cells that any scene sees or sees clear, and those that none sees clear."""
    valid, clear = F.bit_or("valid_mask"), F.bit_or("clear_mask")
    return masks.groupBy(*keys).agg(F.bit_count(valid).alias("seen"), F.bit_count(clear).alias("clear"), F.bit_count(valid.bitwiseAND(F.bitwise_not(clear))).alias("missing"))
