"""Near-duplicate embeddings by NN-descent within equal labels.

Equal vectors of a label are one node with a multiplicity from the start.  A first neighbour
graph comes from ``ROUNDS`` orders by random-projection codes: nodes are range-partitioned and
sorted by code, and runs of ``RUN`` adjacent nodes are compared.  NN-descent then refines it:
around every node, its neighbours and those it is a neighbour of are compared with each other
(neighbours of neighbours), and each keeps its ``K`` nearest, until few lists change.
Neighbours below ``FLOOR`` are not listed: the way to a link leads over nearer ones.

A list that is full of links is saturated: its node may have more links than the list holds.
Saturated lists are made ``LARGER`` and refined again around their nodes until they aren't
full any more or hold ``MOST_K``.  For what stays full, every node of its component is compared,
block against block, with the component's nodes and all that are listed beside them, so that
links are counted and connected without making rows of pairs.  Recall is audited: a bounded
number of nodes (``AUDIT`` of the smallest hashes among all, among those with links, and among
those without a link that have a neighbour above ``CLOSE``) is compared with every node of its label; while
the share of their links that is counted is below ``RECALL``, further orders and descents are
added, ``MORE`` times at most.  If the last audit fails too, every node is compared in blocks
over its label.  The audit's figures are returned.  Links are those of cosine >= ``percent``
/ 100 in double precision; every one was computed from the two vectors.

Defined cases: rows whose label or vector is null, and vectors that are empty, zero or hold a
null or non-finite component, link with nothing: no links, their own id as component.  Vectors
of different dimensions aren't compared.  Repeated rows are vectors of their own, linked with
each other.  A component's id is the smallest non-null vec_id in it.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.components import connected_components
from tidepool.llm.scratch import Scratch

K, ROUNDS, RUN, FLOOR, STEPS, MORE = 10, 4, 128, 0.9, 4, 3
AUDIT, RECALL, SETTLED, BLOCK, NEAR = 256, 0.98, 0.01, 512, 2048
#: How much longer a saturated list gets, neighbours in the largest one, similarity from which an unlinked node is worth an audit.
LARGER, MOST_K, CLOSE = 4, 160, 0.95
BITS = 32


def unit_rows(column: pa.Array, wide: bool) -> np.ndarray:
    """Vectors of one dimension, as unit rows in double precision."""
    data = b"".join(column.to_pylist())
    x = np.frombuffer(data, "<f8" if wide else "<f4").reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _runs_of_equal(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of rows that are equal in all columns."""
    n = len(columns[0])
    if n == 0:
        return []
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return list(zip(at, np.append(at[1:], n), strict=True))


def vector_rows(embeddings: DataFrame) -> tuple[DataFrame, bool]:
    """vec_id, kind (label and dimension) and node of every row; both null where a vector links with nothing."""
    wide = "double" in embeddings.schema["embedding"].dataType.simpleString()
    v = F.col("embedding").cast("array<double>" if wide else "array<float>")
    limit = F.lit(float("inf")).cast("double")
    sound = F.col("label").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit)) & F.exists(v, lambda x: x != 0)
    sound = F.coalesce(sound, F.lit(False))
    kind = F.when(sound, F.xxhash64(F.col("label").cast("string"), F.size(v)))
    rows = embeddings.select("vec_id", kind.alias("kind"), F.when(sound, F.xxhash64(F.col("label").cast("string"), v)).alias("node"), v.alias("vector"))
    return rows, wide


def packed(rows: DataFrame, wide: bool) -> DataFrame:
    """node, kind, n (vectors) and vec (bytes) of each distinct sound vector."""
    distinct = rows.where("node is not null").groupBy("node").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("n"), F.first("vector").alias("vector"))
    form = np.dtype("<f8" if wide else "<f4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(3)
            flat = vectors.flatten().to_numpy().astype(form)
            bounds = np.concatenate([[0], np.cumsum(vectors.value_lengths().to_numpy())])
            vec = [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(vec, pa.binary())], names=["node", "kind", "n", "vec"])

    return distinct.select("node", "kind", "n", "vector").mapInArrow(run, "node long, kind long, n long, vec binary")


def _best(sims: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best entries of at least ``floor``."""
    k = min(k, sims.shape[1])
    top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(sims)), k)
    column = top.ravel()
    good = sims[row, column] >= floor
    return row[good], column[good]


def first_lists(nodes: DataFrame, wide: bool, seed: int, k: int, floor: float) -> DataFrame:
    """(a, b, sim): neighbours among nodes that are adjacent in one order by projection codes."""

    def planes(dim: int) -> np.ndarray:
        return np.random.default_rng([seed, dim]).standard_normal((dim, BITS))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = pa.compute.binary_length(batch.column(2)).to_numpy()
            out = np.zeros(batch.num_rows, np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                x = unit_rows(batch.column(2).take(pa.array(own)), wide)
                out[own] = ((x @ planes(x.shape[1]) > 0) << np.arange(BITS - 1, -1, -1)).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(out)], names=["node", "kind", "vec", "code"])

    def compare(node: np.ndarray, kind: np.ndarray, vec: pa.Array) -> Iterator[pa.RecordBatch]:
        for low, high in _runs_of_equal(kind):
            for a in range(low, max(low + 1, high - RUN // 2), RUN // 2):
                b = min(high, a + RUN)
                x = unit_rows(vec.slice(a, b - a), wide)
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                i, j = _best(sims, k, floor)
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(node[a + i]), pa.array(node[a + j]), pa.array(sims[i, j])], names=["a", "b", "sim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # some thousand rows, of which the last half run is kept for the next
        for batch in batches:
            kept.append(batch)
            if sum(x.num_rows for x in kept) >= 16 * RUN:
                table = pa.Table.from_batches(kept).combine_chunks()
                yield from compare(table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).combine_chunks())
                kept = table.slice(table.num_rows - RUN // 2).to_batches()
        if kept:
            table = pa.Table.from_batches(kept).combine_chunks()
            yield from compare(table.column(0).to_numpy(), table.column(1).to_numpy(), table.column(2).combine_chunks())

    coded = nodes.select("node", "kind", "vec").mapInArrow(code, "node long, kind long, vec binary, code long")
    ordered = coded.repartitionByRange("kind", "code", "node").sortWithinPartitions("kind", "code", "node")
    return ordered.select("node", "kind", "vec").mapInArrow(run, "a long, b long, sim double")


def _own_k(rows: DataFrame, node: str, k: int, enlarged: DataFrame | None) -> DataFrame:
    """``rows`` with the length ``k`` of the list of each ``node``."""
    if enlarged is None:
        return rows.withColumn("k", F.lit(k))
    return rows.join(enlarged.select(F.col("node").alias(node), F.col("k").alias("_k")), node, "left").withColumn("k", F.coalesce("_k", F.lit(k))).drop("_k")


def nearest(found: DataFrame, k: int, enlarged: DataFrame | None = None) -> DataFrame:
    """The k best neighbours of each node among rows (a, b, sim), each once; more for ``enlarged`` ones (node, k)."""
    once = found.groupBy("a", "b").agg(F.max("sim").alias("sim"))
    ranked = once.withColumn("r", F.expr("row_number() over (partition by a order by sim desc, b)"))
    return _own_k(ranked, "a", k, enlarged).where(F.col("r") <= F.col("k")).select("a", "b", "sim")


def descend(lists: DataFrame, nodes: DataFrame, wide: bool, k: int, floor: float, enlarged: DataFrame | None = None, focus: DataFrame | None = None) -> DataFrame:
    """(a, b, sim): pairs around common neighbours that are nearer than the worst of a's full list.

    With ``focus`` (node) only around these nodes and those in their lists.
    """
    near = lists.select(F.col("a").alias("hub"), F.col("b").alias("node"))
    back = lists.withColumn("r", F.expr("row_number() over (partition by b order by sim desc, a)"))
    back = _own_k(back, "b", k, enlarged).where(F.col("r") <= F.col("k")).select(F.col("b").alias("hub"), F.col("a").alias("node"))
    sizes = _own_k(lists.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("sim").alias("least")), "a", k, enlarged)
    worst = sizes.select(F.col("a").alias("node"), F.when(F.col("n") >= F.col("k"), F.col("least")).otherwise(floor).alias("worst"))
    members = near.union(back).distinct()
    if focus is not None:
        hubs = focus.select(F.col("node").alias("hub")).union(lists.join(focus.select(F.col("node").alias("a")), "a", "left_semi").select("b")).distinct()
        members = members.join(hubs, "hub", "left_semi")
    members = members.join(nodes.select("node", "vec"), "node").join(worst, "node", "left").select("hub", "node", "vec", F.coalesce("worst", F.lit(floor)).alias("worst"))
    most = k if enlarged is None else MOST_K

    def run(group: pa.Table) -> pa.Table:
        node, worst = group.column("node").to_numpy(), group.column("worst").to_numpy()
        x = unit_rows(group.column("vec").combine_chunks(), wide)
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        i, j = _best(np.where(sims > worst[:, None], sims, -2), most, floor)
        return pa.table({"a": node[i], "b": node[j], "sim": sims[i, j]})

    return members.groupBy("hub").applyInArrow(run, "a long, b long, sim double")


def _refined(lists: DataFrame, nodes: DataFrame, wide: bool, scratch: Scratch, k: int, floor: float, steps: int) -> DataFrame:
    size = lists.count()
    for _ in range(steps):
        fresh = scratch.table(descend(lists, nodes, wide, k, floor), "fresh")
        changed = fresh.select("a", "b").distinct().join(lists, ["a", "b"], "left_anti").count()
        if changed:
            lists = scratch.table(nearest(lists.union(fresh), k), "lists")
        if changed <= SETTLED * max(size, 1):
            break
    return lists


def _enlarged(lists: DataFrame, nodes: DataFrame, wide: bool, scratch: Scratch, threshold: float, k: int, floor: float) -> tuple[DataFrame, DataFrame | None]:
    """Lists after enlarging the saturated ones until they aren't, or hold ``MOST_K``; and the enlarged nodes (node, k).

    A list of a dense group fills in one descent: with k neighbours on each side of a hub, a pair of m alike meets 4 k * k / m times.
    """
    enlarged, size = None, k
    while size < MOST_K:
        full = lists.where(F.col("sim") >= threshold).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= size)
        full = scratch.table(full.select("node"), "saturated")
        if full.isEmpty():
            break
        size = min(LARGER * size, MOST_K)
        longer = full.withColumn("k", F.lit(size))
        enlarged = scratch.table(longer if enlarged is None else enlarged.join(full, "node", "left_anti").unionByName(longer), "enlarged")
        fresh = descend(lists, nodes, wide, k, floor, enlarged, full)
        lists = scratch.table(nearest(lists.union(fresh), k, enlarged), "lists")
    return lists, enlarged


def audit(nodes: DataFrame, counts: DataFrame, lists: DataFrame, wide: bool, threshold: float, queries: int = AUDIT) -> tuple[int, int]:
    """(links counted, links there are) of sampled nodes, against every node.

    ``counts``: node and links, of every node that has links.  The sample is ``queries`` nodes of
    the smallest hashes among all, as many among those with links, and as many among those
    without a link whose best neighbour in ``lists`` is above ``CLOSE``.
    """
    spark = nodes.sparkSession
    some = nodes.select("node", "kind", "vec")
    linked = counts.where("links > 0").select("node")
    close = lists.where(F.col("sim") >= CLOSE).select(F.col("a").alias("node")).distinct().join(linked, "node", "left_anti")
    least = lambda rows: rows.orderBy(F.xxhash64("node", F.lit(5)), "node").limit(queries).collect()
    asked = {r["node"]: r for rows in (some, some.join(linked, "node", "left_semi"), some.join(close, "node", "left_semi")) for r in least(rows)}  # three times ``queries`` rows at most
    if not asked:
        return 0, 0
    by_kind: dict[int, list] = {}
    for r in asked.values():
        by_kind.setdefault(r["kind"], []).append((r["node"], bytes(r["vec"])))
    shared = spark.sparkContext.broadcast(by_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {kind: (np.array([q[0] for q in qs]), unit_rows(pa.array([q[1] for q in qs], pa.binary()), wide)) for kind, qs in shared.value.items()}
        for batch in batches:
            node, kind, n = (batch.column(c).to_numpy() for c in range(3))
            for one in np.unique(kind):
                if one in ready:
                    own = np.flatnonzero(kind == one)
                    sims = ready[one][1] @ unit_rows(batch.column(3).take(pa.array(own)), wide).T
                    linked = (sims >= threshold) & (ready[one][0][:, None] != node[own][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(ready[one][0]), pa.array(linked @ n[own])], names=["node", "there"])

    true = nodes.select("node", "kind", "n", "vec").mapInArrow(run, "node long, there long").groupBy("node").agg(F.sum("there").alias("there"))
    row = true.join(counts, "node", "left").agg(F.sum(F.least(F.coalesce("links", F.lit(0)), "there")).alias("found"), F.sum("there").alias("all")).first()
    return row["found"] or 0, row["all"] or 0


def links_in_blocks(members: DataFrame, around: DataFrame, nodes: DataFrame, wide: bool, threshold: float, scratch: Scratch) -> DataFrame:
    """(node, links, asked, other) of the links that nodes of ``members`` have with the nodes ``around`` their component.

    ``members`` and ``around``: node and component.  A component's nodes are asked in groups of about BLOCK.  A
    node may be linked with a group only if its angle to the group's middle is at most the group's
    radius plus the threshold's angle; those nodes, again in blocks, are compared with the group.
    Each task returns a row for each node that has links, not for each link: how many (asked
    rows: of a member; others: with members), and a node that stands for those connected in the task.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    own = members.join(sizes, "component").select("node", F.col("component").alias("kind"), F.xxhash64("component", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))).alias("group"))
    asks = scratch.table(own.join(nodes.drop("kind"), "node").select("kind", "group", "node", "n", "vec"), "asks")
    reach = float(np.arccos(min(1.0, threshold))) + 1e-6

    def middle(group: pa.Table) -> pa.Table:
        x = unit_rows(group.column("vec").combine_chunks(), wide)
        center = x.sum(axis=0)
        size = np.sqrt(center @ center)
        center = center / size if size > 1e-6 else x[0]
        radius = float(np.arccos(np.clip(x @ center, -1, 1)).max())
        return pa.table({"kind": group.column("kind")[:1], "group": group.column("group")[:1], "center": pa.array([center.astype("<f8").tobytes()], pa.binary()), "radius": [radius]})

    middles = scratch.table(asks.groupBy("kind", "group").applyInArrow(middle, "kind long, group long, center binary, radius double"), "middles")
    # Every node around a component with the middles of its groups, in blocks of both; ``kind`` is the component from here on.
    whole, nodes = nodes, around.select("node", F.col("component").alias("kind")).join(nodes.drop("kind"), "node")
    wanted = middles.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / NEAR).alias("q_blocks"))
    told = nodes.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / NEAR).alias("r_blocks")).join(wanted, "kind")
    block = lambda name, blocks: F.pmod(F.xxhash64(name, F.lit(4)), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    left = middles.join(told, "kind").select("kind", block("group", "q_blocks").alias("q"), every("r_blocks").alias("r"), F.col("group").alias("id"), F.col("center").alias("vec"), "radius")
    right = nodes.join(told, "kind").select("kind", every("q_blocks").alias("q"), block("node", "r_blocks").alias("r"), F.col("node").alias("id"), "vec", F.lit(None).cast("double").alias("radius"))

    def near(rows: pa.Table) -> pa.Table:
        is_middle = rows.column("radius").is_valid().to_numpy()
        q, r = np.flatnonzero(is_middle), np.flatnonzero(~is_middle)
        if not len(q) or not len(r):
            return pa.table({"group": pa.array([], pa.int64()), "node": pa.array([], pa.int64())})
        vec, ids = rows.column("vec").combine_chunks(), rows.column("id").to_numpy()
        radius = rows.column("radius").take(pa.array(q)).to_numpy()
        cosine = unit_rows(vec.take(pa.array(q)), True) @ unit_rows(vec.take(pa.array(r)), wide).T
        i, j = np.nonzero(cosine >= np.cos(np.minimum(radius + reach, np.pi))[:, None] - 1e-12)
        return pa.table({"group": ids[q][i], "node": ids[r][j]})

    close = scratch.table(left.unionByName(right).groupBy("kind", "q", "r").applyInArrow(near, "group long, node long"), "close")
    parts = close.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / NEAR).alias("parts"))
    part = F.pmod(F.xxhash64("node", F.lit(6)), F.col("parts"))
    ask = asks.join(parts, "group").select("group", every("parts").alias("part"), "node", "n", "vec", F.lit(True).alias("asks"), F.lit(True).alias("member"))
    known = asks.select("node", F.lit(True).alias("member"))
    rest = close.join(parts, "group").join(whole.select("node", "n", "vec").join(known, "node", "left"), "node").select("group", part.alias("part"), "node", "n", "vec", F.lit(False).alias("asks"), F.coalesce("member", F.lit(False)).alias("member"))

    def run(rows: pa.Table) -> pa.Table:
        asks, member = (rows.column(c).to_numpy() for c in ("asks", "member"))
        node, n = rows.column("node").to_numpy(), rows.column("n").to_numpy()
        vec = rows.column("vec").combine_chunks()
        q, r = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(r):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "asked": pa.array([], pa.bool_()), "other": pa.array([], pa.int64())})
        sims = unit_rows(vec.take(pa.array(q)), wide) @ unit_rows(vec.take(pa.array(r)), wide).T
        linked = (sims >= threshold) & (node[q][:, None] != node[r][None, :])
        # The least row of those connected in this task; ``len(q)`` stands for none.
        mine, theirs = np.arange(len(q)), np.full(len(r), len(q))
        while True:
            theirs = np.where(linked, mine[:, None], len(q)).min(axis=0)
            less = np.minimum(mine, np.where(linked, theirs[None, :], len(q)).min(axis=1))
            if (less == mine).all():
                break
            mine = less
        some_q, some_r = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
        links = np.concatenate([(linked @ n[r])[some_q], np.where(member[r], 0, n[q] @ linked)[some_r]])
        return pa.table({"node": np.concatenate([node[q][some_q], node[r][some_r]]), "links": links.astype(np.int64), "asked": np.concatenate([np.ones(len(some_q), bool), np.zeros(len(some_r), bool)]), "other": node[q][np.concatenate([mine[some_q], theirs[some_r]])]})

    return ask.unionByName(rest).groupBy("group", "part").applyInArrow(run, "node long, links long, asked boolean, other long")


def _counted(lists: DataFrame, nodes: DataFrame, enlarged: DataFrame | None, wide: bool, scratch: Scratch, threshold: float, k: int, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """(a, b): edges that connect what is linked; and (node, links) of every node that has links.

    The components with a list that is still full are counted in blocks; with ``every`` each node is, over its label.
    """
    links = lists.where(F.col("sim") >= threshold)
    links = _own_k(links.withColumn("n", F.expr("count(*) over (partition by a)")), "a", k, enlarged)
    links = scratch.table(links.select("a", "b", (F.col("n") >= F.col("k")).alias("full")), "links")
    # A link stands in the list of one side at least.
    both = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct(), "both")
    if not every and links.where("full").isEmpty():
        held = both.join(nodes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
        return both, scratch.table(held, "counts")
    if every:
        members = around = nodes.select("node", F.col("kind").alias("component"))
    else:
        labels = scratch.table(connected_components(both, scratch), "parts")
        full = links.where("full").select(F.col("a").alias("node")).distinct().join(labels, "node").select("component").distinct()
        members = scratch.table(labels.join(full, "component", "left_semi"), "saturated")
        beside = lists.select(F.col("a").alias("node"), "b").union(lists.select("b", "a")).join(members, "node").select(F.col("b").alias("node"), "component")
        around = scratch.table(members.select("node", "component").union(beside).distinct(), "around")
    blocks = scratch.table(links_in_blocks(members, around, nodes, wide, threshold, scratch), "blocks")
    edges = both.union(blocks.where("node <> other").select("node", "other").distinct())
    # A member's links are all counted in blocks; others have those with members from there and the rest from the lists.
    within = members.select("node", F.lit(True).alias("member"))
    outer = both.join(members.select(F.col("node").alias("a")), "a", "left_anti").join(members.select(F.col("node").alias("b")), "b", "left_anti")
    listed = outer.join(nodes.select(F.col("node").alias("b"), "n"), "b").select(F.col("a").alias("node"), F.col("n").alias("links"))
    asked = blocks.join(within, "node", "left").where(F.col("asked") | F.col("member").isNull()).select("node", "links")
    return edges, scratch.table(listed.union(asked).groupBy("node").agg(F.sum("links").alias("links")), "counts")


def near_duplicates(embeddings: DataFrame, threshold: float = 0.98, k: int = K, floor: float = FLOOR, steps: int = STEPS) -> DataFrame:
    """vec_id, n_links, component_id, kept, audit_found and audit_links, one row for each row of ``embeddings`` (vec_id, embedding, label).

    The audit's columns are the same in every row: how many links of its sample were counted, and how many there are.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "nn_descent")
    floor = min(floor, threshold)
    rows, wide = vector_rows(embeddings)
    nodes = scratch.table(packed(rows, wide), "nodes")

    lists = None
    for more in range(MORE + 1):
        found = lists
        for turn in range(ROUNDS):
            one = first_lists(nodes, wide, more * ROUNDS + turn, k, floor)
            found = one if found is None else found.union(one)
        lists = scratch.table(nearest(found, k), "lists")
        lists = _refined(lists, nodes, wide, scratch, k, floor, steps)
        longer, enlarged = _enlarged(lists, nodes, wide, scratch, threshold, k, floor)
        edges, counts = _counted(longer, nodes, enlarged, wide, scratch, threshold, k)
        have, there = audit(nodes, counts, longer, wide, threshold)
        if have >= RECALL * there:
            break
    else:  # the lists miss too much: every node is counted in blocks
        edges, counts = _counted(longer, nodes, enlarged, wide, scratch, threshold, k, every=True)
        have, there = audit(nodes, counts, longer, wide, threshold)

    labels = scratch.table(connected_components(edges, scratch), "components")
    per_node = nodes.select("node", "n").join(labels, "node", "left").join(counts, "node", "left")
    per_node = per_node.select("node", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    ids = rows.select("vec_id", "node")
    placed = scratch.table(ids.join(per_node, "node", "left"), "placed")
    least = placed.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("least"))
    out = placed.join(least, "component", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumns({"kept": F.col("vec_id").eqNullSafe(F.col("component_id")), "audit_found": F.lit(have).cast("long"), "audit_links": F.lit(there).cast("long")})


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
