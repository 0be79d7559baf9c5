"""Walks along parent links in graphs too long for one task: links are followed within regions first.

``links`` (chain, block, to) names each block once and no block's ``to`` is null.  Rows are dealt to
tasks by ranges of (chain, block) and cut into regions of at most ``REGION`` rows; a region's walks
are followed in the task, so that only blocks that another region names (gates) are left for
rounds of joins.  Where parents lie near their blocks these are few, whatever the length of a chain;
where they lie anywhere, as many as the blocks, and the rounds double the distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.plans.lineage import cut, drop

#: Most rows of a region: a task follows the walks of one at a time.
REGION = 1 << 16


def _targets(chain: np.ndarray, block: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Row that holds each row's (chain, to), -1 without one."""
    n = len(block)
    chains = np.unique(chain, return_inverse=True)[1].astype(np.int64)
    names = np.unique(np.concatenate([block, to]), return_inverse=True)[1].astype(np.int64)
    own, aim = (chains << 32) + names[:n], (chains << 32) + names[n:]
    order = np.argsort(own, kind="stable")
    at = np.searchsorted(own, aim, sorter=order)
    row = order[np.minimum(at, n - 1)]
    return np.where(own[row] == aim, row, -1)


def _column(c: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy()


def _followed(region: pa.Table) -> pa.Table:
    """``region`` with ``exit`` (the first block outside, null for walks that never leave) and ``steps`` to it."""
    jump = _targets(*(_column(region.column(c)) for c in ("chain", "block", "to")))
    n = len(jump)
    steps, tail = np.ones(n, np.int64), np.arange(n)
    for _ in range(n.bit_length() + 1):
        going = np.flatnonzero(jump >= 0)
        if not len(going):
            break
        ahead = jump[going]
        steps[going], tail[going], jump[going] = steps[going] + steps[ahead], tail[ahead], jump[ahead]
    ends = region.column("to").take(pa.array(np.where(jump < 0, tail, 0), mask=jump >= 0))
    return region.append_column("exit", ends).append_column("steps", pa.array(np.where(jump < 0, steps, 0)))


def followed(links: DataFrame, size: int = REGION) -> DataFrame:
    """chain, block, to, exit, steps and region of each link, written once."""
    kinds = {f.name: f.dataType for f in links.schema}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in ("chain", "block", "to")] + [T.StructField("exit", kinds["to"]), T.StructField("steps", T.LongType()), T.StructField("region", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            whole = _followed(pa.Table.from_batches(held).combine_chunks())
            yield from whole.append_column("region", pa.array(np.full(whole.num_rows, (task << 32) + k))).to_batches()

        for batch in batches:
            for first in range(0, batch.num_rows, size):
                part = batch.slice(first, size)
                if held and n + part.num_rows > size:
                    yield from flush()
                    k, held, n = k + 1, [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield from flush()

    return cut(links.select("chain", "block", "to").repartitionByRange("chain", "block").sortWithinPartitions("chain", "block").mapInArrow(run, schema))


def _gates(placed: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """The rows of ``placed`` that another region or a start names."""
    named = placed.where("exit is not null").select("chain", F.col("exit").alias("block"))
    named = cut((named if starts is None else named.union(starts.select("chain", "block"))).distinct())
    out = cut(placed.join(named, ["chain", "block"], "left_semi"))
    drop(named)
    return out


def arriving(links: DataFrame, ends: DataFrame, size: int = REGION) -> DataFrame:
    """chain, block of the links whose walk comes to its chain's block in ``ends``, which are no links themselves."""
    placed = followed(links, size)
    home = ends.select("chain", F.col("block").alias("to"), F.lit(True).alias("home"))
    steps = _gates(placed).where("exit is not null").select("chain", "block", F.col("exit").alias("to"))
    steps = cut(steps.join(F.broadcast(home), ["chain", "to"], "left").select("chain", "block", "to", F.coalesce("home", F.lit(False)).alias("home")))  # one row for each chain
    done, going = steps.where("home"), steps.where("not home")
    while True:
        ahead = done.union(going).select("chain", F.col("block").alias("to"), F.col("to").alias("next"), F.col("home").alias("arrives"))
        moved = cut(going.join(ahead, ["chain", "to"]).select("chain", "block", F.col("next").alias("to"), F.col("arrives").alias("home")))
        arrived = moved.where("home")
        if arrived.isEmpty():  # the nearest of those still under way would have arrived
            break
        done, going = cut(done.union(arrived)), moved.where("not home")
    reached = cut(done.select("chain", F.col("block").alias("exit")).union(ends.select("chain", F.col("block").alias("exit"))))
    return placed.join(reached, ["chain", "exit"], "left_semi").select("chain", "block")


def _walked_gates(gates: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chain, block, distance) of the starts, gates and ends of the walks, and the chains that end in a cycle."""
    sizes = cut(gates.groupBy("chain").agg(F.count(F.lit(1)).alias("n")))
    longest = sizes.agg(F.max("n")).first()[0] or 0
    jumps = cut(gates.where("exit is not null").select("chain", "block", F.col("exit").alias("to"), "steps"))
    marked, step = cut(starts.select("chain", "block", F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("hops"))), 1
    while step <= 2 * longest:
        reached = cut(marked.join(jumps, ["chain", "block"]).select("chain", F.col("to").alias("block"), (F.col("distance") + F.col("steps")).alias("distance"), (F.col("hops") + step).alias("hops")))
        if reached.isEmpty():
            break
        old, marked, step = marked, cut(marked.union(reached)), 2 * step
        drop(old, reached)
        longer = jumps.alias("a").join(jumps.alias("b"), (F.col("a.chain") == F.col("b.chain")) & (F.col("a.to") == F.col("b.block")))
        old, jumps = jumps, cut(longer.select("a.chain", "a.block", F.col("b.to").alias("to"), (F.col("a.steps") + F.col("b.steps")).alias("steps")))
        drop(old)
    drop(jumps)
    # A walk runs into a cycle of gates if it has more hops than its chain has gates, or into one within a region.
    round_gates = marked.join(F.broadcast(sizes), "chain").where("hops > n").select("chain")
    within = marked.join(gates.where("exit is null").select("chain", "block"), ["chain", "block"], "left_semi").select("chain")
    return marked.select("chain", "block", "distance"), cut(round_gates.union(within).distinct())


def walked(links: DataFrame, starts: DataFrame, size: int = REGION) -> tuple[DataFrame, DataFrame]:
    """Two tables of chain, block, distance: the links on the walks from ``starts`` (one block of each chain), and the one block where each ends, which is no link.

    A chain whose walk runs into a cycle is in neither.
    """
    placed = followed(links, size)
    starts = cut(starts.select("chain", "block"))
    gates = _gates(placed, starts)
    marked, endless = _walked_gates(gates, starts)
    marked = marked.join(F.broadcast(endless), "chain", "left_anti")  # one row for each chain
    ends = cut(marked.join(gates.select("chain", "block"), ["chain", "block"], "left_anti"))
    entries = cut(marked.join(gates.select("chain", "block", "region"), ["chain", "block"]).select("region", "chain", "block", "distance"))
    kinds = {f.name: f.dataType for f in placed.schema}
    schema = T.StructType([T.StructField("chain", kinds["chain"]), T.StructField("block", kinds["block"]), T.StructField("distance", T.LongType())])

    def run(region: pa.Table, entry: pa.Table) -> pa.Table:
        chain, block = region.column("chain"), region.column("block")
        ahead = _targets(_column(chain), _column(block), _column(region.column("to"))).tolist()
        row = {key: k for k, key in enumerate(zip(chain.to_pylist(), block.to_pylist(), strict=True))}
        at, far = [], []
        for c, b, d in zip(*(entry.column(x).to_pylist() for x in ("chain", "block", "distance")), strict=True):
            k = row[c, b]
            while k >= 0:
                at.append(k)
                far.append(d)
                k, d = ahead[k], d + 1
        at = pa.array(at, pa.int64())
        return pa.table({"chain": chain.take(at), "block": block.take(at), "distance": pa.array(far, pa.int64())})

    crossed = placed.select("region", "chain", "block", "to").join(F.broadcast(entries.select("region").distinct()), "region", "left_semi")  # one row for each region
    return crossed.groupBy("region").cogroup(entries.groupBy("region")).applyInArrow(run, schema), ends
