"""What the corpus operators share on the Spark side: scratch tables and components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, wherever ``use`` reads it.

    A column that a lambda reads may be put into the lambda by the optimiser and
    evaluated for every element; a variable of an outer lambda never is.
    """
    return F.get(F.transform(F.array(value), use), 0)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and all runs on this machine (local tests)
    a temporary folder is made; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skyweave-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(_delete, spark, root)
    return root


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is gone; the cluster's own clean-up removes the folder
        pass


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors.

    ``keep`` writes and rereads a frame.  ``drop`` removes tables that no later
    plan reads; whatever a returned frame still reads is removed at exit.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(_delete, spark, self.root)

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            _delete(self.spark, df._scratch_path)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component: its smallest node.

    Alternating large-star and small-star rounds (Kiveris et al. 2014): every
    round is two aggregations with map-side minima and two joins that adaptive
    execution can split, so a hub with very many neighbours is no single task.
    The rounds stop when the edge set no longer changes.  Edges that are null
    or loops are ignored; no edges give an empty frame.
    """
    now = scratch.keep(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    while True:
        state = now.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("long")).alias("s")
        ).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").where("u <> v")
        after = scratch.keep(small.distinct())
        scratch.drop(now, large)
        now = after
    out = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


#: Bits of the map by which ``restrict`` leaves rows out: 1 MB, whatever the input.
MAP_BITS = 1 << 23
_BUCKET = 32768  # bits of one value of bitmap_construct_agg


def restrict(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``key`` is not among ``wanted``.

    Every wanted key sets one bit of a map of fixed size, which is broadcast, so
    a join that follows shuffles few other rows.  The more keys there are, the
    more other rows pass; the result of the join does not depend on it.
    """
    return _marked(rows, key, wanted).where("_sw_bit").drop("_sw_bit")


def split_by(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be wanted, rows whose key is not)."""
    marked = _marked(rows, key, wanted)
    return marked.where("_sw_bit").drop("_sw_bit"), marked.where("not _sw_bit").drop("_sw_bit")


def _marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    def bit(column: str):
        return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(MAP_BITS))

    made = wanted.where(F.col(key).isNotNull()).select(bit(key).alias("at")).groupBy(F.expr(f"at div {_BUCKET}").alias("_sw_bucket"))
    made = made.agg(F.bitmap_construct_agg(F.col("at") % _BUCKET).alias("_sw_map"))
    at = bit(key)
    joined = rows.withColumn("_sw_at", F.coalesce(at, F.lit(-1))).withColumn("_sw_b", F.expr(f"_sw_at div {_BUCKET}"))
    joined = joined.join(F.broadcast(made.withColumnRenamed("_sw_bucket", "_sw_r")), F.col("_sw_b") == F.col("_sw_r"), "left")
    place = (F.col("_sw_at") % _BUCKET).cast("int")
    byte = F.conv(F.hex(F.col("_sw_map").substr((place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce((F.shiftright(byte, 0) / F.pow(F.lit(2), place % 8)).cast("int") % 2 == 1, F.lit(False)) & F.col(key).isNotNull()
    return joined.withColumn("_sw_bit", hit).drop("_sw_at", "_sw_b", "_sw_r", "_sw_map")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    """Apply ``work`` to every group of rows that arrive sorted by integer ``keys``; one group and one batch are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        columns = [table[k].to_numpy() for k in keys]
        edge = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, b in zip([0, *edge[:-1].tolist()], edge.tolist(), strict=False):
            if (out := work(table.slice(a, b - a))) is not None:
                yield out
        held = table.slice(int(edge[-1]) if len(edge) else 0).combine_chunks().to_batches()
    if held and (out := work(pa.Table.from_batches(held))) is not None:
        yield out
