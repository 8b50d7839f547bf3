"""Scratch tables in the folder that a cluster shares."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Only where that is unset and Spark runs in one process, a temporary one: on a cluster
    the driver's folder isn't the executors', so that is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="concordia-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder in order to cut lineage: a lost executor costs no recomputation of what is
    written. drop() frees tables early; what is left goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def write(self, df: DataFrame, name: str, *, partition_by: str | None = None) -> DataFrame:
        path = f"{self.root}/{name}"
        out = df.write.mode("overwrite")
        (out.partitionBy(partition_by) if partition_by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(f"{self.root}/{name}")

    def free_shuffles(self) -> None:
        """Lets Spark remove the shuffle files of plans that are over, instead of whenever the driver collects garbage."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _end(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # noqa: BLE001  the JVM is gone already
            pass
