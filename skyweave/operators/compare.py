"""Comparison and fit statistics of products."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compare(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row: joint and one-sided counts, differences, fit of b on a over joint values.

    Correlation and fit need two joint values and a spread in both.
    """
    x, y = a.select(*keys, F.col(value).alias("x")), b.select(*keys, F.col(value).alias("y"))
    both = x.join(y, keys, "full").withColumn("d", F.abs(F.col("y") - F.col("x")))
    joint = F.col("x").isNotNull() & F.col("y").isNotNull()
    px, py = F.when(joint, F.col("x")), F.when(joint, F.col("y"))
    fits = (F.count_if(joint) > 1) & (F.stddev_pop(px) > 0) & (F.stddev_pop(py) > 0)
    return both.agg(
        F.count_if(joint).alias("joint"),
        F.count_if(F.col("x").isNotNull() & F.col("y").isNull()).alias("only_a"),
        F.count_if(F.col("x").isNull() & F.col("y").isNotNull()).alias("only_b"),
        F.max("d").alias("max_abs"), F.avg("d").alias("mean_abs"), F.median("d").alias("median_abs"), F.percentile("d", 0.95).alias("p95_abs"),
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse"), F.avg(F.col("y") - F.col("x")).alias("bias"),
        F.when(fits, F.corr(px, py)).alias("r"), F.when(fits, F.regr_r2(py, px)).alias("r2"),
        F.when(fits, F.regr_slope(py, px)).alias("slope"), F.when(fits, F.regr_intercept(py, px)).alias("intercept"),
    )


def robust(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median, median absolute deviation, 90th and 99th percentile of every group."""
    middle = frame.groupBy(*keys).agg(F.median(value).alias("median"), F.percentile(value, 0.9).alias("p90"), F.percentile(value, 0.99).alias("p99"))
    away = frame.join(middle, keys).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return middle.join(away, keys)


def debias(frame: DataFrame, keys: list[str], predicted: str, true: str, least: int = 2) -> DataFrame:
    """Slope and intercept that take predictions to the truth, and the bias; groups of ``least`` rows or more."""
    return frame.groupBy(*keys).agg(
        F.regr_slope(true, predicted).alias("slope"), F.regr_intercept(true, predicted).alias("intercept"), F.avg(F.col(predicted) - F.col(true)).alias("bias"), F.count("*").alias("n")
    ).where(F.col("n") >= least)


def trend(groups: DataFrame, bias: str, covariate: str, least: int = 4) -> DataFrame:
    """Correlation and slope of a bias against a covariate over groups; null under ``least`` groups."""
    enough = F.count("*") >= least
    return groups.agg(F.when(enough, F.corr(bias, covariate)).alias("r"), F.when(enough, F.regr_slope(bias, covariate)).alias("slope"), F.count("*").alias("n"))


def angles(frame: DataFrame, a: str, b: str) -> DataFrame:
    """Mean and median angle in degrees between array columns."""
    from skyweave.operators.spectra import dot

    cosine = dot(F.col(a), F.col(b)) / F.sqrt(dot(F.col(a), F.col(a)) * dot(F.col(b), F.col(b)))
    angle = F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
    return frame.agg(F.avg(angle).alias("mean_angle"), F.median(angle).alias("median_angle"))


def coverage(counts: DataFrame, keys: list[str], count: str = "observation_count") -> DataFrame:
    """Share of pixels with any observation, by key."""
    return counts.groupBy(*keys).agg(F.avg((F.coalesce(F.col(count), F.lit(0)) > 0).cast("double")).alias("coverage"))


def means_over(rows: DataFrame, keys: list[str], value: str, limit: float, place: str, name: str) -> DataFrame:
    """(keys, name): the mean of every group less ``limit``, of a sign that no cut into tasks decides.

    A sum of doubles depends on the order of its terms.  Where rounding could
    turn the sign, the terms are added one by one in the order of ``place``;
    other groups, nearly all, are combined before their shuffle.
    """
    terms, n = F.col(value), F.count(value)
    # both orders are off by at most about n roundings of the sum of sizes
    doubt = n * (F.avg(F.abs(terms)) + abs(limit)) * 1e-15
    told = rows.groupBy(*keys).agg((F.avg(value) - limit).alias(name), doubt.alias("_doubt"))
    near = told.where(F.abs(name) <= F.col("_doubt")).select(*(F.col(k).alias(f"_{k}") for k in keys))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    by_place = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    again = rows.where(terms.isNotNull()).join(near, same, "left_semi").withColumn("_sum", F.sum(value).over(by_place))
    again = again.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg((F.max_by("_sum", place) / F.count("*") - limit).alias("_again"))
    return told.join(again, same, "left").select(*keys, F.coalesce("_again", name).alias(name))


def crossover(curve: DataFrame, keys: list[str], index: str, x: str, difference: str) -> DataFrame:
    """The first x after the start at which the difference is not negative."""
    return curve.groupBy(*keys).agg(F.min(F.when((F.col(index) >= 1) & (F.col(difference) >= 0), F.col(x))).alias("crossover"))
