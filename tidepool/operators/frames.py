"""Frames of a subscription and responses of block logs: sound rows, foreign frames, and faults with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.plans.lineage import folder

#: The result stays text until it is known to be ours.
ENVELOPE = "params struct<subscription: string, result: string>, _corrupt string"
LOG = "address string, topics array<string>, data string, blockHash string, blockNumber string, logIndex string, removed boolean, _corrupt string"
RESPONSE = "id long, result string, error string, _corrupt string"


def quantity(text: Column) -> Column:
    """The number in a hex quantity (0x and 1 to 16 digits); null for any other text."""
    return F.when(text.rlike("^0x[0-9a-fA-F]{1,16}$"), F.conv(F.substring(text, 3, 16), 16, 10).cast("decimal(20,0)"))


def hex_bytes(text: Column, size: int | None = None) -> Column:
    """The digits of hex data in lower case, of ``size`` bytes if given; null for a missing prefix, odd digits or another length."""
    count = "(?:[0-9a-fA-F]{2})*" if size is None else f"[0-9a-fA-F]{{{2 * size}}}"
    return F.when(text.rlike(f"^0x{count}$"), F.lower(F.substring(text, 3, 2**31 - 1)))


def _json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"columnNameOfCorruptRecord": "_corrupt"})


def _log(raw: Column) -> tuple[Column, Column]:
    """(a decoded log, why it isn't one)."""
    topics = F.transform(raw.topics, lambda t: hex_bytes(t, 32))
    log = F.struct(
        hex_bytes(raw.address, 20).alias("address"), topics.alias("topics"), hex_bytes(raw.data).alias("data"), hex_bytes(raw.blockHash, 32).alias("block_hash"),
        quantity(raw.blockNumber).alias("number"), quantity(raw.logIndex).alias("log_index"), F.coalesce(raw.removed, F.lit(False)).alias("removed"),
    )
    given = lambda c, value: c.isNotNull() & value.isNull()
    fault = (
        F.when(raw.isNull() | raw["_corrupt"].isNotNull(), "not_json").when(hex_bytes(raw.address, 20).isNull(), "bad_address").when(raw.topics.isNull() | F.exists(topics, lambda t: t.isNull()), "bad_topics")
        .when(hex_bytes(raw.data).isNull(), "bad_data").when(given(raw.blockHash, hex_bytes(raw.blockHash, 32)), "bad_block_hash")
        .when(given(raw.blockNumber, quantity(raw.blockNumber)) | given(raw.logIndex, quantity(raw.logIndex)), "bad_quantity")
    )
    return log, fault


def classified(frames: DataFrame, own: str) -> DataFrame:
    """``frames`` (frame and any other columns) with kind, reason and log.

    foreign: no params, or another subscription than ``own``; fault: no JSON, or a frame of ours without a
    result or with one that is no log, with the reason; sound: a log.  A null frame is a fault.
    """
    rows = frames.withColumn("_envelope", _json(F.col("frame"), ENVELOPE))
    params = F.col("_envelope.params")
    rows = rows.withColumn("_raw", _json(params.result, LOG))
    log, fault = _log(F.col("_raw"))
    broken = F.col("frame").isNull() | F.col("_envelope").isNull() | F.col("_envelope._corrupt").isNotNull()
    foreign = params.isNull() | ~F.coalesce(params.subscription == own, F.lit(False))
    reason = F.when(broken, "not_json").when(foreign, None).when(params.result.isNull(), "missing_result").otherwise(fault)
    kind = F.when(broken, "fault").when(foreign, "foreign").when(reason.isNotNull(), "fault").otherwise("sound")
    return rows.withColumns({"reason": reason, "kind": kind}).withColumn("log", F.when(F.col("kind") == "sound", log)).drop("_envelope", "_raw")


def block_logs(responses: DataFrame) -> DataFrame:
    """request, fault and logs of each response (request, block_hash asked for, body).

    fault: not_json, error, other_id, not_a_list, or the first fault of a log; other_block if a log names another
    block.  One bad log fails its response, which then has no logs.
    """
    rows = responses.withColumn("_r", _json(F.col("body"), RESPONSE)).withColumn("_logs", F.from_json(F.col("_r.result"), "array<string>"))
    raws = F.transform("_logs", lambda t: _json(t, LOG))
    rows = rows.withColumn("_raws", raws)
    faults = F.array_compact(F.transform("_raws", lambda raw: _log(raw)[1]))
    logs = F.transform("_raws", lambda raw: _log(raw)[0])
    rows = rows.withColumns({"_faults": faults, "_found": logs})
    other = F.exists("_found", lambda log: ~log["block_hash"].eqNullSafe(F.col("block_hash")))
    fault = (
        F.when(F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "not_json").when(F.col("_r.error").isNotNull(), "error").when(~F.col("_r.id").eqNullSafe(F.col("request")), "other_id")
        .when(F.col("_logs").isNull() | ~F.ltrim("_r.result").startswith("["), "not_a_list").when(F.size("_faults") > 0, F.get("_faults", F.lit(0))).when(other, "other_block")
    )
    return rows.select("request", fault.alias("fault"), F.when(fault.isNull(), F.col("_found")).alias("logs"))


def split(frames: DataFrame, own: str, root: str | None = None) -> dict[str, DataFrame]:
    """Runs a stream of frames (frame and other columns) over what there is, into a table for each kind: sound, foreign and fault.

    A batch that is tried again replaces its own part of each table.
    """
    spark = frames.sparkSession
    root = root or folder(spark, "frames")
    rows = classified(frames, own).select(*frames.columns, "kind", "reason", "log")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{root}/out/batch={number}")

    rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(rows.schema.add("batch", "integer")).option("basePath", f"{root}/out").parquet(f"{root}/out")
    of = lambda kind, *more: out.where(F.col("kind") == kind).select(*frames.columns, *more)
    return {"sound": of("sound", "log.*"), "foreign": of("foreign"), "fault": of("fault", "reason")}
