"""Tables kept by the content of what made them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from skyweave.plans.store import stable_hash


class TableCache:
    """``get`` reads a table that an equal key has made before, else makes and writes it.

    Whether one is there is Spark's own mark of a complete write, so a broken
    one counts as missing and is written again.
    """

    def __init__(self, spark: SparkSession, root: str, version: int = 1):
        self.spark, self.root, self.version = spark, root.rstrip("/"), version

    def path(self, kind: str, key: dict) -> str:
        return f"{self.root}/{kind}/{stable_hash({'version': self.version, 'key': key})}"

    def complete(self, path: str) -> bool:
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def get(self, kind: str, key: dict, make: Callable[[], DataFrame]) -> DataFrame:
        path = self.path(kind, key)
        if self.complete(path):
            try:
                return self.spark.read.parquet(path)
            except AnalysisException:
                pass  # unreadable: made again below
        make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
