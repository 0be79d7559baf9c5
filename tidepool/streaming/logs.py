"""Log batches as a stream: deduplication within a watermark, windowed counts, and a table sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.plans.lineage import folder


def event_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 1) -> DataFrame:
    """The ``events`` table as a file stream, its event time as ``ts``."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else path.replace("events.parquet", "events*.parquet"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def log_batches(stream: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events counted by type and tumbling window, each event once however often it is delivered.

    Ids are remembered, and windows stay open, until the watermark has passed them by ``late``.
    """
    once = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"))


def delivered_twice(stream: DataFrame, again: str) -> DataFrame:
    """``stream`` with the rows for which ``again`` holds delivered a second time."""
    return stream.withColumn("_times", F.explode(F.when(F.expr(again), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_times")


def run_to_table(counts: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream of windowed counts over what there is and returns the last state of each window."""
    root = folder(spark, "stream")
    flat = counts.select(F.col("w.start").alias("start"), "event_type", "n_events")

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    query = flat.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema("start timestamp, event_type string, n_events long, batch int").parquet(f"{root}/out")
    return rows.groupBy("start", "event_type").agg(F.max_by("n_events", "batch").alias("n_events"))


def staged(logs: DataFrame, heads: DataFrame, stay: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Logs (chain, block, ts, ...) of blocks whose head (head_chain, head_block, head_ts) comes too, before or after them.

    The earlier side waits in the join's state; pairs more than ``stay`` apart don't meet, and the
    watermark drops what can't meet any more, so the state needs no cap of blocks.
    """
    on = F.expr(f"chain = head_chain and block = head_block and head_ts between ts - interval {stay} and ts + interval {stay}")
    return logs.withWatermark("ts", late).join(heads.withWatermark("head_ts", late), on).drop("head_chain", "head_block")


def append_to_table(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream of appended rows over what there is and returns them as a table."""
    root = folder(spark, "stream")
    rows.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/out")
