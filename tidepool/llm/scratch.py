"""Intermediate tables in the folder that the cluster shares (``spark.checkpoint.dir``).

Lineage is cut by writing Parquet there and reading it again, so a lost executor costs a
re-read and not a recomputation.  A scratch area belongs to one operator call; ``drop``
removes tables that nothing reads any more, and the rest goes when the interpreter ends.
"""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; one below the warehouse only where none is configured."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    return f"{warehouse}/tidepool_scratch"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A private folder for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{tag}_{uuid.uuid4().hex}"
        self._n = 0
        _OPEN.append((spark, self.root))

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}_{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a DataFrame that reads it."""
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._scratch_path)


@atexit.register
def _clean() -> None:
    for spark, root in _OPEN:
        try:
            if spark.sparkContext._jsc is not None and not root.startswith("viewfs:") and os.getppid():
                _delete(spark, root)
        except Exception:  # the session has ended: the cluster's own clean-up of the folder applies
            return
