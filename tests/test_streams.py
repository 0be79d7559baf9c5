"""Chains as one stream: staging, caps, reorganisations, finality, restarts."""

import numpy as np
import pyarrow as pa
import pytest

from tidepool.streaming import chains

FIELDS = [f.split()[0] for f in chains.EVENTS.split(", ")]


def event(chain, kind, block, **more):
    return {"chain": chain, "kind": kind, "block": block} | more


def frame(spark, events, start=0):
    return spark.createDataFrame([tuple((e | {"seq": start + k}).get(f) for f in FIELDS) for k, e in enumerate(events)], chains.EVENTS)


def run(spark, *parts, **caps):
    start, frames = 0, []
    for p in parts:
        frames.append(frame(spark, p, start))
        start += len(p)
    return sorted((r.asDict() for r in chains.run_on(spark, frames, 1000, **caps).collect()), key=lambda r: (r["seq"], r["outcome"] == "drained", r["log_index"] or 0))


def head(block, parent, chain=1, touched=False, number=None):
    return event(chain, "head", block, parent=parent, number=number or block, touched=touched)


def log(block, index, pool=5, chain=1):
    return event(chain, "log", block, log_index=index, pool_id=pool)


def test_flood_of_orphaned_logs_stays_bounded(spark):
    """3000 blocks of logs without heads; the first still drains into the graph, and a head frees a place."""
    flood = [log(9_000_000 + k, 0) for k in range(3000)]
    got = run(spark, flood, [head(9_000_000, 1000), log(9_999_999, 0), log(8_888_888, 0)])
    outcomes = [r["outcome"] for r in got if r["seq"] < 3000]
    assert outcomes == ["staged"] * chains.MOST_STAGED + ["refused"] * (3000 - chains.MOST_STAGED)
    assert [r["outcome"] for r in got if r["seq"] >= 3000] == ["admitted", "drained", "staged", "refused"]


def test_outcomes_of_heads_and_logs(spark):
    events = [
        head(1000, 999), head(7, 7), head(1001, 1000), head(1001, 1000), head(1001, 900), log(1001, 3), log(1001, 3), log(1003, 1), log(1003, 1), log(1003, 0),
        head(1003, 1002), head(1004, 1003), head(1005, 1004), head(1006, 1005), head(1002, 1001), log(1003, 2), event(1, "complete", 50),
    ]
    got = run(spark, events[:8], events[8:], most_pending=3)
    assert [(r["outcome"], r["n_blocks"]) for r in got if r["kind"] == "head" and r["outcome"] != "drained"] == [
        ("anchor_readmit", 0), ("self_parent", 0), ("admitted", 1), ("duplicate_block", 0), ("conflicting_parent", 0), ("admitted", 0), ("admitted", 0), ("admitted", 0), ("pending_full", 0), ("admitted", 4),
    ]
    assert [r["outcome"] for r in got if r["kind"] == "log"] == ["applied", "duplicate", "staged", "duplicate", "staged", "applied"]
    assert [(r["block"], r["log_index"]) for r in got if r["outcome"] == "drained"] == [(1003, 0), (1003, 1)] and got[-1]["outcome"] == "unknown_block"


def test_finality_prunes_forks_and_staging(spark):
    events = [head(k, k - 1, touched=k == 1003) for k in range(1001, 1006)] + [head(2002, 1001, number=1002), head(2003, 2002), head(1006, 1005), head(5000, 4999), log(6000, 0), head(1007, 1006)]
    got = run(spark, events, [event(1, "final", 2003), event(1, "final", 1005), event(1, "complete", 1003), log(6001, 0), event(1, "final", 1005), head(5000, 4999), log(6000, 0), head(2003, 2002), head(1002, 1001)])
    finals = [(r["outcome"], r["n_blocks"], r["n_staged"]) for r in got if r["kind"] == "final"]
    # A block of the losing fork moves nothing; 1003 blocks the first advance behind 1002; then 1006 and 1007 stay.
    assert finals == [("ignored", 10, 1), ("advanced", 5, 0), ("advanced", 2, 0)]
    assert [r["outcome"] for r in got][-4:] == ["admitted", "staged", "admitted", "admitted"]  # all pending now: nothing of the old graph is known


def test_state_stays_flat_and_restarts_change_nothing(spark):
    rng = np.random.default_rng(3)
    events = []
    for k in range(1001, 1601):
        events += [log(k, int(rng.integers(0, 3)), int(rng.integers(0, 9))) for _ in range(2)]
        events.append(head(k, k - 1, touched=True))
        events.append(head(100_000 + k, k - 1, number=k))  # a fork at every height
        events.append(head(k, k - 1))
        events.append(event(1, "complete", k))
        if k % 10 == 0:
            events += [head(k * 7, k * 7 - 1), head(k + 1, k), event(1, "final", k - 20)]
    whole = run(spark, events)
    pieces = run(spark, *(events[a:b] for a, b in zip([0, 100, 777, 2000], [100, 777, 2000, len(events)], strict=True)))
    assert whole == pieces
    sizes = [r["n_blocks"] for r in whole if r["outcome"] == "advanced"]
    assert len(sizes) > 50 and max(sizes[5:]) <= 60 and max(sizes[5:]) - min(sizes[5:]) <= 4
    two = run(spark, events[:500] + [e | {"chain": 2} for e in events[:500]])
    tell = lambda rows: [(r["kind"], r["block"], r["outcome"], r["log_index"]) for r in rows]
    assert tell([r for r in two if r["chain"] == 2]) == tell([r for r in two if r["chain"] == 1]) == tell([r for r in whole if r["seq"] < 500])


@pytest.mark.parametrize("n", [0, 1])
def test_empty_deliveries(spark, n):
    assert len(run(spark, [], [head(1001, 1000)][:n])) == n


def test_ignored_finality_does_not_walk_the_chain():
    class Counted(dict):
        looks = 0

        def __getitem__(self, k):
            Counted.looks += 1
            return super().__getitem__(k)

    graph = chains.Graph(1000, 1000, Counted(), {}, 1024, 1024)
    for k in range(1001, 4001):  # 1001 never completes
        graph.admit(k, k - 1, k, k == 1001)
        graph.head = k
        if k > 1020:
            assert not graph.finalize(k - 20)
    assert len(graph.nodes) == 3000 and Counted.looks < 50 * 3000  # about 4 million in walks from the head before
    graph.nodes[1001][4] = True
    assert graph.finalize(3000) and graph.anchor == 3000 and len(graph.nodes) == 1000 and not graph.finalize(3000) and graph.finalize(3500)


def test_finality_of_a_low_fork_jumps_down_the_chain():
    class Counted(dict):
        looks = 0

        def __getitem__(self, k):
            Counted.looks += 1
            return super().__getitem__(k)

    graph = chains.Graph(1000, 1000, Counted(), {}, 1024, 1024)
    graph.admit(7, 1000, 1001, False)
    for k in range(1001, 9001):
        graph.admit(k, k - 1, k, k == 1001)
    graph.head, Counted.looks = 9000, 0
    assert not any(graph.finalize(7) or graph.finalize(1001 + k) for k in range(100)) and Counted.looks < 100 * 100  # 1.6 million before
    assert all(graph.at_depth(9000, d) == 1000 + d for d in (1, 2, 511, 512, 4095, 7999, 8000))


def test_shelved_graph_tells_the_same(spark):
    """Every few events the graph goes to the shelf; odd ones name null blocks, parents and logs."""
    rng = np.random.default_rng(5)
    events = [head(None, 1000), head(5000, None), head(44, 43), log(None, None), log(None, None), log(1001, None), event(1, None, 3), event(None, "head", 1001, parent=1000)]
    for k in range(1001, 1401):
        events += [log(k + int(rng.integers(-1, 2)), int(rng.integers(0, 3)))] + [head(k + 1, k)] * (k % 9 == 0) + [head(k, k - 1, touched=k % 50 == 0)]
        events += [event(1, "complete", k - int(rng.integers(0, 4))), event(1, "complete", 1000 + k % 50 * 50)]
        events += [head(k - 1 + 10_000, k - 2), head(k - 2, k - 3 - k % 2), head(k, k - 1)] if k % 5 == 0 else []
        events += [event(1, "final", k - int(rng.integers(3, 30)))] if k % 7 == 0 else []
    rows = spark.createDataFrame([tuple((e | {"seq": k}).get(f) for f in FIELDS) for k, e in enumerate(events)], chains.EVENTS).toArrow().to_batches()
    packs = [c.as_buffer() for b in chains.pack(iter(rows)) for at, c in zip(b.column(0), b.column(1), strict=True) if at.as_py() == 1]
    table = pa.Table.from_batches(x for c in packs for x in pa.ipc.open_stream(c))
    table = table.take(np.argsort(table["seq"].to_numpy(), kind="stable"))
    whole = chains.told(chains.Graph(1000, 1000, {}, {}, 9, 9), table).to_pylist()
    assert {"advanced", "ignored", "drained", "duplicate_block", "conflicting_parent", "unknown_block"} <= {r["outcome"] for r in whole}
    for step in (1, 3, 17):
        graph, got = chains.Graph(1000, 1000, {}, {}, 9, 9, chains.Shelf()), []
        for first in range(0, len(table), step):
            part = table.slice(first, step)
            graph.recall([*part["block"].to_pylist(), *part["parent"].to_pylist()])
            got += chains.told(graph, part).to_pylist()
            graph.settle()
            if first % 5 == 0:
                graph = chains.Graph(graph.anchor, graph.head, {}, {}, 9, 9, graph.shelf)
        assert got == whole
