"""Intermediate tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Writes a DataFrame as Parquet under the shared folder and reads it back.

    A written table cuts the lineage and survives the loss of any executor. What is left goes when
    the application ends. Where ``spark.checkpoint.dir`` is unset, a local session takes a temporary
    folder, and a cluster's is refused.
    """

    def __init__(self, spark: SparkSession):
        conf = spark.sparkContext.getConf()
        base = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the cluster shares")
            base = tempfile.mkdtemp(prefix="lapidary-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.spark = spark
        self.root = f"{base.rstrip('/')}/lapidary-{uuid.uuid4().hex}"
        system, root = self._at(self.root)
        system.mkdirs(root)
        system.deleteOnExit(root)

    def _at(self, path: str):
        """A path and its file system on the JVM's side."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete written tables that no later read needs."""
        for name in names:
            system, target = self._at(self.path(name))
            system.delete(target, True)


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound what one Arrow batch holds, in bytes and alike for all operators, unless the session has a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not _is_set(spark, key):
        spark.conf.set(key, size)


def _is_set(spark: SparkSession, key: str) -> bool:
    return spark._jsparkSession.sessionState().conf().contains(key)
