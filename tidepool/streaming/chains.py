"""Block heads, logs and finality as one stream: a graph of each chain that the next event changes.

Events of a chain come in the order of ``seq``:

* head (block, parent, number, touched): the observed head, if it is in the graph then; admitted, or refused as self_parent, anchor_readmit,
  duplicate_block, conflicting_parent (the first one seen stays) or pending_full.  A block whose
  parent isn't connected with the anchor is pending; admitting the parent connects it.
* log (block, log_index, pool_id): applied to a block that is in the graph, staged for one that isn't,
  duplicate if it was there, refused if ``MOST_STAGED`` other blocks are staged already.  Staged logs are
  drained by their block's head; a refused head leaves them.
* complete (block): the block's logs are all there.
* final (block): the anchor advances along the path from the observed head, to the last block at or
  below ``block`` before the first that is touched but not complete.  What doesn't descend from the new
  anchor, all pending blocks and all staged logs end there.  A block off the path changes nothing.

Finality ends state, not a clock: it holds the blocks above the anchor with their logs, and at most
``MOST_PENDING`` pending and ``MOST_STAGED`` staged blocks.  The state of a chain lives in the state
store and is read once a batch; a restart goes on from the checkpoint.

A chain's events are packed into Arrow batches before its task and its outcomes unpacked after it, in as many tasks as the
stream has.  The chain's task keeps the graph in sorted arrays (a ``Shelf``) and makes Python objects only of the blocks that
``STEP`` events name, and of all where the anchor moves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidepool.plans.lineage import folder

MOST_PENDING = MOST_STAGED = 1024
EVENTS = "chain long, seq long, kind string, block long, parent long, number long, touched boolean, log_index long, pool_id long"
#: Rows in a chunk of a journal, and events between two visits to the shelf.
CHUNK, STEP = 8192, 100_000
OUTCOMES = "chain long, seq long, kind string, block long, outcome string, log_index long, pool_id long, n_blocks long, n_staged long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for null in arrays of longs.
NULL = -(2**63)
KINDS = ["head", "log", "complete", "final"]
ENDINGS = [
    "self_parent", "anchor_readmit", "duplicate_block", "conflicting_parent", "pending_full", "admitted", "drained", "refused", "duplicate", "applied", "staged", "completed", "unknown_block", "advanced", "ignored",
]
_CODE = {e: k for k, e in enumerate(ENDINGS)}
_PACKED = pa.ipc.IpcWriteOptions(compression="zstd")


class Shelf:
    """A chain's blocks and logs as arrays sorted by block; ``nodes``: block, parent, number, flags and ``place``, ``logs``: block, log_index and pool."""

    def __init__(self, nodes: np.ndarray | None = None, logs: np.ndarray | None = None):
        self.nodes = np.zeros((0, 7), np.int64) if nodes is None else nodes
        self.logs = np.zeros((0, 3), np.int64) if logs is None else logs

    def find(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of nodes and of logs of ``blocks`` (sorted, distinct)."""
        at = np.searchsorted(self.nodes[:, 0], blocks)
        here = at < len(self.nodes)
        here[here] = self.nodes[at[here], 0] == blocks[here]
        low, high = (np.searchsorted(self.logs[:, 0], blocks, side) for side in ("left", "right"))
        n = high - low
        which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return self.nodes[at[here]], self.logs[which]

    def put(self, nodes: np.ndarray, logs: np.ndarray) -> None:
        """Replaces or adds ``nodes``, adds ``logs``."""
        nodes = nodes[np.argsort(nodes[:, 0])]
        at = np.searchsorted(self.nodes[:, 0], nodes[:, 0])
        here = at < len(self.nodes)
        here[here] = self.nodes[at[here], 0] == nodes[here, 0]
        self.nodes[at[here]] = nodes[here]
        self.nodes = np.insert(self.nodes, at[~here], nodes[~here], axis=0)
        logs = logs[np.argsort(logs[:, 0], kind="stable")]
        self.logs = np.insert(self.logs, np.searchsorted(self.logs[:, 0], logs[:, 0], "right"), logs, axis=0)


class Graph:
    """One chain above its anchor; ``nodes``: block to [parent, number, connected, touched, complete]; ``logs``: (block, log_index) to pool.

    With a ``shelf``, ``nodes`` and ``logs`` are empty at first and hold what was fetched (``recall``) since the last ``settle``.
    """

    def __init__(self, anchor: int, head: int, nodes: dict, logs: dict, most_pending: int, most_staged: int, shelf: Shelf | None = None):
        self.anchor, self.head, self.nodes, self.shelf = anchor, head, nodes, shelf or Shelf()
        self.asked, self.changed, self.added, self.n_fetched, self.pruned = set(), set(), [], 0, False
        self.most_pending, self.most_staged = most_pending, most_staged
        self.placed()
        self.waiting = defaultdict(list)  # pending blocks by parent
        self.of_block = defaultdict(dict)
        for block, (parent, _, connected, *_) in nodes.items():
            if not connected:
                self.waiting[parent].append(block)
        pending = self.shelf.nodes[self.shelf.nodes[:, 3] & 1 == 0]
        for block, parent in pending[:, :2].tolist():
            self.waiting[parent].append(block)
        self.n_pending = sum(map(len, self.waiting.values()))
        for (block, index), pool in logs.items():
            self.of_block[block][index] = pool
        self.n_staged = sum(b not in nodes for b in self.of_block)  # blocks
        self.n_staged += int((~np.isin(np.unique(self.shelf.logs[:, 0]), self.shelf.nodes[:, 0])).sum())

    def __len__(self) -> int:
        return len(self.shelf.nodes) - self.n_fetched + len(self.nodes)

    def recall(self, blocks: Iterable[int]) -> None:
        """Fetches blocks and their logs from the shelf, those that weren't asked for since the last ``settle``."""
        blocks = set(blocks) - self.asked
        self.asked |= blocks
        if not blocks or not len(self.shelf.nodes) + len(self.shelf.logs):
            return
        nodes, logs = self.shelf.find(np.array(sorted(blocks), np.int64))
        self.n_fetched += len(nodes)
        for block, parent, number, flags, *place in nodes.tolist():
            self.nodes[block] = [parent, number, bool(flags & 1), bool(flags & 2), bool(flags & 4)]
            if flags & 1:
                self.place[block] = tuple(place)
        for block, index, pool in logs.tolist():
            self.of_block[block][index] = pool

    def node(self, block: int) -> list:
        if block not in self.nodes:
            self.recall([block])
        return self.nodes[block]

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        """Puts what changed on the shelf and returns these rows of nodes and logs; nothing stays fetched."""
        rows = []
        for block in self.nodes if self.pruned else self.changed:
            parent, number, connected, touched, complete = self.nodes[block]
            rows.append((block, parent, number, connected + 2 * touched + 4 * complete, *self.place.get(block, (0, NULL, NULL))))
        if self.pruned:
            self.added = [(b, i, p) for b, known in self.of_block.items() for i, p in known.items()]
        nodes, logs = np.array(rows, np.int64).reshape(-1, 7), np.array(self.added, np.int64).reshape(-1, 3)
        self.shelf.put(nodes, logs)
        self.nodes, self.place, self.of_block = {}, {}, defaultdict(dict)
        self.asked, self.changed, self.added, self.n_fetched, self.pruned = set(), set(), [], 0, False
        return nodes, logs

    def placed(self) -> None:
        """``place``: connected blocks' distance from the anchor, their path's first block above it and a block further down the path to jump to."""
        children = defaultdict(list)
        for block, (parent, _, connected, *_) in self.nodes.items():
            if connected:
                children[parent].append(block)
        self.place, todo = {}, [*children[self.anchor]]
        while todo:
            block = todo.pop()
            self.connect(block, self.nodes[block][0])
            todo += children[block]

    def spot(self, block: int) -> tuple[int, int, int]:
        if block == self.anchor:
            return 0, block, block
        if block not in self.place:
            self.recall([block])
        return self.place[block]

    def connect(self, block: int, parent: int) -> None:
        """Jumps double in length where two in a row are equally long, so every block is some 2 log n jumps from those below it."""
        depth, first, jump = self.spot(parent)
        below, _, next_ = self.spot(jump)
        self.place[block] = depth + 1, first if depth else block, next_ if depth - below == below - self.spot(next_)[0] else parent

    def at_depth(self, block: int, depth: int) -> int:
        """The block of ``block``'s path at this distance from the anchor."""
        while (here := self.spot(block))[0] > depth:
            block = here[2] if self.spot(here[2])[0] >= depth else self.node(block)[0]
        return block

    def admit(self, block: int, parent: int, number: int, touched: bool) -> tuple[str, int]:
        """(outcome, how many blocks it connected)."""
        if block == parent:
            return "self_parent", 0
        if block == self.anchor:
            return "anchor_readmit", 0
        if block in self.nodes:
            return ("duplicate_block" if self.nodes[block][0] == parent else "conflicting_parent"), 0
        connects = parent == self.anchor or (parent in self.nodes and self.nodes[parent][2])
        if not connects and self.n_pending >= self.most_pending:
            return "pending_full", 0
        self.changed.add(block)
        self.n_staged -= block in self.of_block
        if not connects:
            self.nodes[block] = [parent, number, False, touched, False]
            self.waiting[parent].append(block)
            self.n_pending += 1
            return "admitted", 0
        self.nodes[block] = [parent, number, True, touched, False]
        self.connect(block, parent)
        todo, n = [block], 1
        while todo:
            at = todo.pop()
            for child in self.waiting.pop(at, ()):
                self.node(child)[2] = True
                self.changed.add(child)
                self.connect(child, at)
                self.n_pending -= 1
                todo.append(child)
                n += 1
        return "admitted", n

    def log(self, block: int, index: int, pool: int) -> str:
        known = self.of_block.get(block)
        if known is None and block not in self.nodes:
            if self.n_staged >= self.most_staged:
                return "refused"
            self.n_staged += 1
        if known is not None and index in known:
            return "duplicate"
        self.of_block[block][index] = pool
        self.added.append((block, index, pool))
        return "applied" if block in self.nodes else "staged"

    def complete(self, block: int) -> bool:
        """Whether the block is in the graph."""
        if block not in self.nodes:
            return False
        self.nodes[block][4] = True
        self.changed.add(block)
        return True

    def finalize(self, target: int) -> bool:
        """Whether the anchor moved.

        Looks at the whole graph only if it moves.
        """
        self.recall([target, self.head])
        if target not in self.place or self.head not in self.place:
            return False
        depth, first, _ = self.place[target]
        if self.at_depth(self.head, depth) != target or (self.node(first)[3] and not self.nodes[first][4]):
            return False
        self.recall(self.shelf.nodes[:, 0].tolist() + self.shelf.logs[:, 0].tolist())
        path, at = [], self.head
        while at in self.nodes and self.nodes[at][2]:
            path.append(at)
            at = self.nodes[at][0]
        if at != self.anchor or target not in path:
            return False
        free = None
        for block in reversed(path[path.index(target) :]):
            if self.nodes[block][3] and not self.nodes[block][4]:
                break
            free = block
        if free is None:
            return False
        children = defaultdict(list)
        for block, (parent, _, connected, *_) in self.nodes.items():
            if connected:
                children[parent].append(block)
        kept, todo = {}, [free]
        while todo:
            for child in children[todo.pop()]:
                kept[child] = self.nodes[child]
                todo.append(child)
        self.anchor, self.nodes = free, kept
        self.head = self.head if self.head in kept else free
        self.of_block = defaultdict(dict, {b: v for b, v in self.of_block.items() if b in kept})
        self.waiting, self.n_pending, self.n_staged = defaultdict(list), 0, 0
        self.shelf, self.pruned, self.n_fetched = Shelf(), True, 0
        self.placed()
        return True


class Journal:
    """Rows of longs in a map of the state store, in numbered chunks: later rows of a key replace earlier ones."""

    def __init__(self, state, columns: int, key: int):
        self.state, self.columns, self.key, self.n, self.chunks = state, columns, key, 0, 0

    def read(self) -> np.ndarray:
        """The rows, sorted by their key (the first columns)."""
        chunks = [pa.ipc.open_stream(rows[0]).read_next_batch() for _, rows in sorted(self.state.iterator())]
        rows = np.concatenate([np.zeros((0, self.columns), np.int64), *(np.stack([c.to_numpy() for c in chunk.columns], 1) for chunk in chunks)])
        self.n, self.chunks = len(rows), len(chunks)
        rows = rows[np.lexsort(rows[:, : self.key].T[::-1])]  # stable: the last of a key is its newest
        last = np.ones(len(rows), bool)
        last[:-1] = (rows[1:, : self.key] != rows[:-1, : self.key]).any(1)
        return rows[last]

    def write(self, changed: list[np.ndarray], every: np.ndarray, anew: bool) -> None:
        """Adds what changed, or writes all anew where rows went or most of the map is out of date."""
        changed = np.concatenate([every[:0], *changed])
        if anew or self.n + len(changed) > 2 * len(every) + CHUNK:
            self.state.clear()
            changed, self.chunks = every, 0
        for first in range(0, len(changed), CHUNK):
            part = changed[first : first + CHUNK]
            self.state.updateValue((self.chunks,), (packed(pa.RecordBatch.from_arrays([*map(pa.array, part.T)], names=[str(k) for k in range(self.columns)])),))
            self.chunks += 1


class ChainProcessor(StatefulProcessor):
    """Keeps a ``Graph`` for every chain in journals of the state store, to which a batch adds what it changed."""

    def __init__(self, anchor: int, most_pending: int = MOST_PENDING, most_staged: int = MOST_STAGED):
        self.start, self.most_pending, self.most_staged = anchor, most_pending, most_staged

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ends = handle.getValueState("ends", "anchor bigint, head bigint")
        self.nodes = handle.getMapState("nodes", "chunk bigint", "rows binary")
        self.logs = handle.getMapState("logs", "chunk bigint", "rows binary")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803  (names of the interface)
        anchor, head = self.ends.get() if self.ends.exists() else (self.start, self.start)
        journals = Journal(self.nodes, 7, 1), Journal(self.logs, 3, 2)
        graph = Graph(anchor, head, {}, {}, self.most_pending, self.most_staged, Shelf(*(j.read() for j in journals)))
        events, changes, anew = pa.Table.from_batches(b for r in rows for b in pa.ipc.open_stream(r["rows"])), ([], []), False
        events = events.take(np.argsort(events["seq"].to_numpy(), kind="stable"))
        for first in range(0, len(events), STEP):
            step = events.slice(first, STEP)
            graph.recall(np.unique(np.concatenate([step["block"].to_numpy(), step["parent"].to_numpy()])).tolist())
            yield Row(chain=key[0], rows=packed(told(graph, step)))
            if graph.pruned:
                anew, changes = True, ([], [])
            for list_, rows_ in zip(changes, graph.settle(), strict=True):
                list_.append(rows_)
        self.ends.update((graph.anchor, graph.head))
        for journal, changed, every in zip(journals, changes, (graph.shelf.nodes, graph.shelf.logs), strict=True):
            journal.write(changed, every, anew)

    def close(self) -> None:
        pass


def told(graph: Graph, events: pa.Table) -> pa.RecordBatch:
    """The outcomes of events, which change the graph, without their chain."""
    out, code = [], _CODE
    for kind, seq, block, parent, number, touched, index, pool in zip(*(events[c].to_numpy().tolist() for c in ("kind", "seq", "block", "parent", "number", "touched", "log_index", "pool_id")), strict=True):
        if kind == 0:
            outcome, n = graph.admit(block, parent, number, touched)
            if block in graph.nodes or block == graph.anchor:
                graph.head = block
            out.append((seq, 0, block, code[outcome], NULL, NULL, n, NULL))
            if outcome == "admitted" and block in graph.of_block:
                out += [(seq, 0, block, code["drained"], i, p, NULL, NULL) for i, p in sorted(graph.of_block[block].items())]
        elif kind == 1:
            out.append((seq, 1, block, code[graph.log(block, index, pool)], index, pool, NULL, NULL))
        elif kind == 2:
            out.append((seq, 2, block, code["completed" if graph.complete(block) else "unknown_block"], NULL, NULL, NULL, NULL))
        elif kind == 3:
            moved = graph.finalize(block)
            out.append((seq, 3, block, code["advanced" if moved else "ignored"], NULL, NULL, len(graph), graph.n_staged))
    table = np.array(out, np.int64).reshape(-1, 8)
    columns = {c: pa.array(table[:, k], mask=table[:, k] == NULL) for k, c in enumerate(("seq", "kind", "block", "outcome", "log_index", "pool_id", "n_blocks", "n_staged"))}
    columns |= {"kind": pa.array(KINDS).take(columns["kind"]), "outcome": pa.array(ENDINGS).take(columns["outcome"])}
    return pa.RecordBatch.from_pydict(columns)


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_PACKED) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chain, rows): a batch's events of each chain, nulls as ``NULL`` and kinds by number."""
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.table({n: batch.column(n).fill_null(NULL) for n in ("seq", "block", "parent", "number", "log_index", "pool_id")})
        table = table.append_column("kind", pc.index_in(batch.column("kind"), pa.array(KINDS)).fill_null(-1)).append_column("touched", batch.column("touched").fill_null(False))
        order = pc.sort_indices(batch.column("chain"))
        chain, table = batch.column("chain").take(order), table.take(order)
        value = np.stack([chain.fill_null(0).to_numpy(), chain.is_null().to_numpy(zero_copy_only=False)])
        starts = np.flatnonzero(np.r_[True, (value[:, 1:] != value[:, :-1]).any(0)])
        parts = [table.slice(a, b - a).combine_chunks().to_batches()[0] for a, b in zip(starts, [*starts[1:], len(chain)], strict=True)]
        yield pa.RecordBatch.from_arrays([chain.take(pa.array(starts)), pa.array(map(packed, parts), pa.binary())], names=["chain", "rows"])


def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chain, rows in zip(batch.column(0), batch.column(1), strict=True):
            for told_ in pa.ipc.open_stream(rows.as_buffer()):
                yield pa.RecordBatch.from_arrays([pa.repeat(chain, len(told_)), *told_.columns], names=["chain", *told_.schema.names])


def outcomes(events: DataFrame, anchor: int, most_pending: int = MOST_PENDING, most_staged: int = MOST_STAGED) -> DataFrame:
    """What becomes of every event of a stream (``EVENTS``), and the logs that heads drain (``OUTCOMES``)."""
    rows = events.mapInArrow(pack, "chain long, rows binary").groupBy("chain")
    return rows.transformWithState(ChainProcessor(anchor, most_pending, most_staged), "chain long, rows binary", "Append", "None").mapInArrow(unpack, OUTCOMES)


def run_on(spark: SparkSession, deliveries: list[DataFrame], anchor: int, root: str | None = None, **caps: int) -> DataFrame:
    """Outcomes of deliveries (``EVENTS``) one after the other; the stream stops after each and starts again from its checkpoint."""
    root = root or folder(spark, "chains")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        for rows in deliveries:
            rows.write.mode("append").parquet(f"{root}/in")
            stream = spark.readStream.schema(EVENTS).parquet(f"{root}/in")
            query = outcomes(stream, anchor, **caps).writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(OUTCOMES).parquet(f"{root}/out")
