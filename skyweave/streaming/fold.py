"""Composites that take in new scenes as they come.

The winner of a pixel is the least of a total order, so composites fold: that of
the old winner and the new observations is that of all.  Late scenes need no
watermark, and a batch that is seen twice changes nothing but counts, which are
kept by scene.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.functions import quality


def winners(obs: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """(keys, w): the best observation by quality score, time and scene, which does not depend on arrival."""
    usable = obs.where(quality.usable([F.col(b) for b in bands], F.col("quality")))
    return usable.groupBy(*keys).agg(F.min(F.struct("quality", "day", "scene_index", *bands)).alias("w"))


def fold(old: DataFrame | None, new: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    fresh = winners(new, keys, bands)
    if old is None:
        return fresh
    return old.unionByName(fresh).groupBy(*keys).agg(F.min("w").alias("w"))


class StreamedComposite:
    """Writes the folded composite after every batch, each to a folder of its own.

    ``root`` is shared by all executors.  A version is complete once Spark has
    marked it so; the newest complete one is the state, so a lost driver goes on
    from there and a repeated batch writes its version again.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], bands: list[str]):
        self.spark, self.root, self.keys, self.bands = spark, root.rstrip("/"), keys, bands

    def _versions(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS")))

    def current(self, before: int | None = None) -> DataFrame | None:
        known = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.root}/v={known[-1]}") if known else None

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        fold(self.current(batch_id), batch, self.keys, self.bands).write.mode("overwrite").parquet(f"{self.root}/v={batch_id}")

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class ChunkedComposite:
    """The folded composite by chunk: a batch rewrites the chunks that it touches, and no others.

    A version is what one batch wrote: pixels of its chunks under ``parts``, then
    the list of them under ``manifest``; the state of a chunk is in its newest
    version whose list is complete.  What a chunk had before its last version but
    one is deleted, as a repeated batch only folds into what was before it.  So
    bytes written grow with batches and bytes kept with the composite.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], bands: list[str], chunk: str = "chunk_id"):
        self.spark, self.root, self.keys, self.bands, self.chunk = spark, root.rstrip("/"), keys, bands, chunk

    def _versions(self) -> tuple[list[int], list[int]]:
        """Complete and broken versions."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        told = {int(n[2:]): fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest/{n}/_SUCCESS")) for n in names if n.startswith("v=")}
        return sorted(v for v, whole in told.items() if whole), sorted(v for v, whole in told.items() if not whole)

    def _lists(self, before: int | None) -> DataFrame | None:
        """(chunk, v) of the complete versions."""
        whole, broken = self._versions()
        whole = [v for v in whole if before is None or v < before]
        if not whole:
            return None
        every = self.spark.read.parquet(f"{self.root}/manifest").withColumn("v", F.col("v").cast("long"))
        return every.where((F.col("v") <= whole[-1]) & ~F.col("v").isin(*broken, -1))

    def current(self, before: int | None = None) -> DataFrame | None:
        """(chunk, keys, w), or None before the first batch."""
        lists = self._lists(before)
        if lists is None or lists.isEmpty():
            return None
        newest = lists.groupBy(self.chunk).agg(F.max("v").alias("v"))
        parts = self.spark.read.parquet(f"{self.root}/parts").withColumn("v", F.col("v").cast("long"))
        return parts.join(newest, [self.chunk, "v"], "left_semi").select(self.chunk, *self.keys, "w")

    def take(self, batch: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch``."""
        own = [self.chunk, *self.keys]
        fresh = winners(batch, own, self.bands).persist()
        try:
            touched = fresh.select(self.chunk).distinct()
            old = self.current(batch_id)
            every = fresh if old is None else old.join(touched, self.chunk, "left_semi").unionByName(fresh).groupBy(*own).agg(F.min("w").alias("w"))
            every.repartition(self.chunk).write.mode("overwrite").partitionBy(self.chunk).parquet(f"{self.root}/parts/v={batch_id}")
            touched.write.mode("overwrite").parquet(f"{self.root}/manifest/v={batch_id}")
        finally:
            fresh.unpersist()
        self._clear(batch_id)

    def _clear(self, batch_id: int) -> None:
        """Delete what a complete version before ``batch_id`` has superseded; a broken deletion is made up by a later one."""
        lists = self._lists(batch_id)
        if lists is None:
            return
        newest = lists.groupBy(self.chunk).agg(F.max("v").alias("last"))
        there = self.spark.read.parquet(f"{self.root}/parts").select(F.col("v").cast("long").alias("v"), self.chunk).distinct()
        gone = there.join(newest, self.chunk).where("v < last").select(F.concat(F.lit(f"{self.root}/parts/v="), F.col("v").cast("string"), F.lit(f"/{self.chunk}="), F.col(self.chunk).cast("string")).alias("path"))

        def run(batches):
            for batch in batches:
                for path in batch.column(0).to_pylist():
                    store, name = pa.fs.FileSystem.from_uri(path)
                    if store.get_file_info(name).type == pa.fs.FileType.Directory:
                        store.delete_dir(name)
                yield batch

        gone.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_clearness(stream: DataFrame, at: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Mean cloud score by scene over tumbling windows of event time; rows later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), "scene_index").agg(F.avg("cs").alias("mean_clear"), F.count("*").alias("n"))
