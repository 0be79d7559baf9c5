"""Looking at the row before, in series too long for one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.plans.lineage import cut

#: Numbers in a bucket: a task's window holds at most as many rows.
WIDTH = 4096


def with_previous(rows: DataFrame, key: str, number: str, values: Sequence[str], width: int = WIDTH) -> DataFrame:
    """``rows`` with ``before``: ``number`` and ``values`` of the row before it by ``number``; null for the first of a key.

    Numbers are unique in a key, and neither is null.  Windows span buckets of numbers; only the last
    row of each bucket is looked at across buckets.
    """
    row = F.struct(number, *values)
    placed = rows.withColumn("_bucket", F.floor(F.col(number) / width))
    near = placed.withColumn("_near", F.lag(row).over(Window.partitionBy(key, "_bucket").orderBy(number)))
    last = placed.groupBy(key, "_bucket").agg(F.max_by(row, number).alias("_last"))
    last = last.select(key, "_bucket", F.lag("_last").over(Window.partitionBy(key).orderBy("_bucket")).alias("_far"))
    return near.join(last, [key, "_bucket"]).withColumn("before", F.coalesce("_near", "_far")).drop("_bucket", "_near", "_far")


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``position``, from 0 in the order of columns that are unique together.

    Rows are dealt to tasks by ranges of the order and numbered there; only the tasks' counts are looked at together.
    """
    dealt = cut(rows.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()))
    before = dealt.groupBy("_task").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("_task", F.coalesce(F.sum("n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_task").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_task").withColumn("position", F.col("_before") + F.col("_own")).drop("_task", "_own", "_before")
