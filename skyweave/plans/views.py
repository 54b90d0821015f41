"""The raster views that the registered queries read from the star-schema tables.

``SQL`` holds the same views for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns of the grid and cells of a chunk's edge.
WIDTH, EDGE = 50, 10
ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
BANDS = ("b0", "b1", "b2")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixel_columns(pid: Column) -> dict[str, Column]:
    row, col = F.floor(pid / WIDTH).cast("int"), (pid % WIDTH).cast("int")
    return {"pid": pid, "row": row, "col": col, "chunk_id": (F.floor(row / EDGE) * (WIDTH // EDGE) + F.floor(col / EDGE)).cast("int")}


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pixel of the grid: one for each part."""
    return table(spark, sf_dir, "part").select(*(c.alias(n) for n, c in pixel_columns(F.col("p_partkey")).items()))


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scene_index, tile)."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene_index"), F.concat(F.lit("T"), (F.col("s_nationkey") % 4).cast("string")).alias("tile"))


def observations(spark: SparkSession, sf_dir: str, ordered: bool = True, placed: bool = False) -> DataFrame:
    """A row for each observation of a pixel by a scene; ``obs_order`` numbers those of a pixel, ``place`` tells where the table has it."""
    rows = table(spark, sf_dir, "lineitem")
    place = [F.struct("_metadata.file_path", "_metadata.row_index").alias("place")] if placed else []
    quantity = F.col("l_quantity").cast("int")
    out = rows.select(
        *(c.alias(n) for n, c in pixel_columns(F.col("l_partkey")).items()),
        F.col("l_suppkey").alias("scene_index"),
        F.date_format("l_shipdate", "yyyy-MM").alias("period"),
        F.col("l_shipdate").cast("date").alias("day"),
        (F.col("l_extendedprice") / 12000).alias("b0"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("b1"),
        F.col("l_tax").alias("b2"),
        (quantity % 12).alias("scl"),
        (F.floor("l_extendedprice").cast("bigint") % 256).cast("int").alias("fmask"),
        F.when(quantity % 4 == 0, 0).when(quantity % 4 == 1, 1).otherwise(255).alias("mandatory"),
        ((quantity % 11) / 10.0).alias("cs"),
        F.when(F.col("l_returnflag") != "N", F.col("l_linenumber")).alias("sample_index"),
        *ORDER,
        *place,
    )
    if ordered:
        # by the pixel column, so that an aggregation by pixel reuses the exchange and its order
        out = out.withColumn("obs_order", F.row_number().over(Window.partitionBy("pid").orderBy(*ORDER)))
    return out


def joined(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    """Observations with the tile of their scene, a small dimension that the planner broadcasts by its size."""
    return observations(spark, sf_dir, ordered).join(scenes(spark, sf_dir), "scene_index")


_PIXEL = """{0} AS pid, CAST({0} // 50 AS INTEGER) AS "row", CAST({0} % 50 AS INTEGER) AS col,
  CAST((({0} // 50) // 10) * 5 + ({0} % 50) // 10 AS INTEGER) AS chunk_id"""

SQL = f"""
px AS (SELECT {_PIXEL.format('p_partkey')} FROM part),
scn AS (SELECT s_suppkey AS scene_index, concat('T', CAST(s_nationkey % 4 AS VARCHAR)) AS tile FROM supplier),
obs AS (SELECT {_PIXEL.format('l_partkey')}, l_suppkey AS scene_index,
  strftime(l_shipdate, '%Y-%m') AS period, CAST(l_shipdate AS DATE) AS day,
  l_extendedprice / 12000 AS b0, nullif(l_discount, 0) AS b1, l_tax AS b2,
  CAST(l_quantity AS INTEGER) % 12 AS scl, CAST(CAST(floor(l_extendedprice) AS BIGINT) % 256 AS INTEGER) AS fmask,
  CASE CAST(l_quantity AS INTEGER) % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 255 END AS mandatory,
  (CAST(l_quantity AS INTEGER) % 11) / 10.0::DOUBLE AS cs,
  CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS sample_index, {', '.join(ORDER)},
  row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(ORDER)}) AS obs_order,
  CASE WHEN CAST(l_quantity AS INTEGER) % 12 IN (4, 5, 6, 11) THEN 0 WHEN CAST(l_quantity AS INTEGER) % 12 = 7 THEN 1
    WHEN CAST(l_quantity AS INTEGER) % 12 IN (2, 3) THEN 2 ELSE 65535 END AS quality
  FROM lineitem),
joined AS (SELECT obs.*, tile FROM obs JOIN scn USING (scene_index))
"""


def sql(query: str, *ctes: str) -> str:
    """A query over the views."""
    return f"WITH {SQL}{''.join(f', {c}' for c in ctes)} {query}"
