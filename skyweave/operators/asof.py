"""Joins in time: the nearest record within a tolerance, and means over an interval.

Times are dealt to buckets as wide as the tolerance, so all that a time can meet
is in its own and the two neighbouring buckets.  Rows of one time are collapsed
first; within a bucket running windows carry the last record, or a sum, along
the order of times, and the ends of the neighbours come by equality.  Work grows
with the rows and the distinct times, never with pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def _along(order: Column) -> Window:
    """All of a bucket up to a time, rows of the same time included."""
    return Window.partitionBy("_bucket").orderBy(order).rangeBetween(*_SO_FAR)


def nearest(left: DataFrame, right: DataFrame, key: str, left_time: Column, right_time: Column, payload: list[str], tie: str, tolerance: int) -> DataFrame:
    """For each left key its nearest right record; ties to the least ``tie``; left rows without any are left out.

    Rows without a time meet nothing; a key that repeats has one row, of its
    nearest record over all its times.
    """
    width = max(tolerance, 1)
    bucket = F.floor(F.col("_at") / width)
    record = F.struct(F.col("_at").alias("at"), F.col("_tie").alias("tie"), F.col("_own").alias("own"))
    known = right.select(F.struct(*payload).alias("_own"), F.col(tie).alias("_tie"), right_time.alias("_at")).where("_at is not null")
    known = known.groupBy("_at").agg(F.min_by("_own", "_tie").alias("_own"), F.min("_tie").alias("_tie")).select("_at", bucket.alias("_bucket"), record.alias("_record"))
    asked = left.select(left_time.alias("_at")).where("_at is not null").distinct().select("_at", bucket.alias("_bucket"))
    points = known.withColumn("_asked", F.lit(False)).unionByName(asked.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    before, after = (F.last("_record", ignorenulls=True).over(_along(order)) for order in (F.col("_at").asc(), F.col("_at").desc()))
    inside = points.select("_at", "_bucket", "_asked", before.alias("_before"), after.alias("_after")).where("_asked")
    ends = known.groupBy("_bucket").agg(F.min_by("_record", "_at").alias("first"), F.max_by("_record", "_at").alias("last"))
    inside = inside.join(ends.select((F.col("_bucket") + 1).alias("_bucket"), "last"), "_bucket", "left").join(ends.select((F.col("_bucket") - 1).alias("_bucket"), "first"), "_bucket", "left")

    def near(record: Column) -> Column:
        return F.when(F.abs(F.col("_at") - record["at"]) <= tolerance, F.struct(F.abs(F.col("_at") - record["at"]).alias("gap"), record["tie"].alias("tie"), record["own"].alias("own")))

    both = inside.select("_at", near(F.coalesce("_before", "last")).alias("b"), near(F.coalesce("_after", "first")).alias("a"))
    sooner = F.col("a").isNull() | (F.struct("b.gap", "b.tie") <= F.struct("a.gap", "a.tie"))
    met = both.select("_at", F.when(F.col("b").isNotNull() & sooner, F.col("b")).otherwise(F.col("a")).alias("m")).where("m is not null")
    rows = left.select(key, left_time.alias("_at")).join(met, "_at")
    won = rows.groupBy(key).agg(F.min_by("m", F.struct("m.gap", "m.tie")).alias("m"))
    return won.select(key, "m.own.*", "m.gap")


def interval_mean(left: DataFrame, right: DataFrame, key: str, left_time: Column, right_time: Column, value: str, width: int) -> DataFrame:
    """For each left row the mean of right values within ``width`` seconds and their number; null and 0 without any.

    The interval of a time holds its own bucket whole, the end of the one before
    and the beginning of the one after: a total and two running sums.  A key
    that repeats has a row for each of its rows, over all its times.
    """
    step = max(width, 1)
    bucket = F.floor(F.col("_at") / step)
    known = right.select(right_time.alias("_at"), F.col(value).cast("double").alias("_v")).where("_at is not null and _v is not null")
    known = known.groupBy("_at").agg(F.sum("_v").alias("_s"), F.count("*").alias("_n")).select("_at", bucket.alias("_bucket"), "_s", "_n")
    asked = left.select(left_time.alias("_at")).where("_at is not null").distinct().select(F.col("_at").alias("_t"), bucket.alias("_bucket"))
    early = asked.select("_t", (F.col("_bucket") - 1).alias("_bucket"), (F.col("_t") - width).alias("_at"))
    late = asked.select("_t", (F.col("_bucket") + 1).alias("_bucket"), (F.col("_t") + width).alias("_at"))

    def part(points: DataFrame, order: Column) -> DataFrame:
        every = known.unionByName(points, allowMissingColumns=True)
        sums = (F.sum(c).over(_along(order)).alias(c) for c in ("_s", "_n"))
        return every.select("_t", *sums).where("_t is not null and _n > 0")

    whole = known.groupBy("_bucket").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    whole = asked.join(whole, "_bucket").select("_t", "_s", "_n")
    if width == 0:
        early, late, whole = early.limit(0), late.limit(0), asked.join(known, asked["_t"] == known["_at"]).select("_t", "_s", "_n")
    sums = whole.unionByName(part(early, F.col("_at").desc())).unionByName(part(late, F.col("_at").asc()))
    sums = sums.groupBy("_t").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    rows = left.select(key, left_time.alias("_t")).join(sums, "_t")
    means = rows.groupBy(key).agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n"))
    return left.select(key).join(means, key, "left").fillna({"n": 0})


def sidecar(scenes: DataFrame, by_id: DataFrame, by_day: DataFrame, value: str, order: str) -> DataFrame:
    """``scenes`` (id, tile, day) with ``value`` and ``found``: the record of the same id, else of the same tile and day.

    Of several records that of the least ``order`` counts; ``found``: ``id``,
    ``tile and day`` or null; rows with a null id, tile or day find nothing there.
    """
    exact = by_id.groupBy("id").agg(F.min_by(value, order).alias("_exact"))
    near = by_day.groupBy("tile", "day").agg(F.min_by(value, order).alias("_near"))
    both = scenes.join(exact, "id", "left").join(near, ["tile", "day"], "left")
    found = F.when(F.col("_exact").isNotNull(), "id").when(F.col("_near").isNotNull(), "tile and day")
    return both.withColumn(value, F.coalesce("_exact", "_near")).withColumn("found", found).drop("_exact", "_near")


def by_position(rows: DataFrame, lists: list[str]) -> DataFrame:
    """A row for every place of the array columns ``lists``, which must be of one length: ``position`` and their elements."""
    sizes = [F.size(c) for c in lists]
    same = F.lit(True)
    for n in sizes[1:]:
        same = same & (n == sizes[0])
    zipped = F.when(same, F.arrays_zip(*lists)).otherwise(F.raise_error(F.lit("lists of one length are needed")))
    return rows.select(*(c for c in rows.columns if c not in lists), F.posexplode(zipped).alias("position", "_z")).select("*", "_z.*").drop("_z")
