"""Cutting lineage between the rounds of an iterative plan, and folders that go when they aren't read any more."""

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, or a folder below the warehouse where it is unset."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (configured or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints").rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the interpreter ends."""
    path = f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a written table: computed once, later rounds and lost executors read it and don't recompute."""
    spark, path = df.sparkSession, folder(df.sparkSession, "cut")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing reads any more; others are passed over."""
    for t in tables:
        if (path := getattr(t, "_cut_path", None)) in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)


@atexit.register
def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the cluster's own clean-up of the folder applies
            return
