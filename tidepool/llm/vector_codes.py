"""Vector code compression: product quantisation with codebooks from ball k-means.

Components become integers, vectors are cut into equal parts, and every part position has its
codebook, refined by rounds of k-means in exact integer arithmetic (ties to the lower index,
means rounded down).  From the second assignment on, an entry with its parts is a ball: its
radius is the largest distance of a part that it held in the round before.  Entries further
away than twice the radius aren't its neighbours.  A part nearer to its entry than half the way
to the nearest neighbour is in the stable core and stays without further work; the others lie
in annular rings between half the distances to one neighbour and the next, and are compared
with the neighbours up to their ring alone.  By the triangle inequality this finds the same
entry as all distances would.  Balls are those of an Arrow batch, so radii are as tight as the
batch allows and need no pass of their own.

A round reads the vectors with their codes once, and writes them with the new codes and, for
each task, the sums of the parts by entry.  The driver holds codebooks alone: ``ENTRIES`` rows
of the vectors' dimension.  The tables of a round go when the next is written.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped, and
so are those whose dimension isn't that of the smallest vec_id (the smallest one with a
positive multiple of ``PARTS`` components).  Fewer than ``ENTRIES`` rows give as many entries.  Equal
vec_ids are ordered by their vectors; null ones come last.  Components beyond ``limit`` are set
to it, so that errors fit a long: 2 ** 28 for 16 dimensions, less by the square root for more;
a label's sum stops at the largest long.
Null labels are equal to each other.  Other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.exact_dedup import join_groups
from tidepool.llm.scratch import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Parts that are compared with their candidates in one step.
CHUNK = 256


def limit(dim: int) -> int:
    """Largest component, so that squared distances stay below 2 ** 62."""
    return int(np.sqrt(2.0**62 / dim)) // 2


def scaled(column: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors of a list column."""
    x = column.flatten().to_numpy().reshape(-1, dim)
    most = limit(dim)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -most, most).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``x`` to every row of ``c``: in doubles where these are exact, else in longs."""
    far = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * far * far < 2**53:
        x, c = x.astype(np.float64), c.astype(np.float64)
    return ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).astype(np.int64)


def nearest_of_all(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Index of each row's nearest entry, the lower one of equally near ones."""
    out = np.zeros(len(x), np.int64)
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = squared(x[k : k + 4096], book).argmin(axis=1)
    return out


class Balls:
    """A codebook with its entries in the order of their distance from each other."""

    def __init__(self, book: np.ndarray):
        self.book = book
        # 4 * own >= distance between two entries, for whole numbers: own >= a quarter of it, rounded up.
        quarter = (squared(book, book) + 3) // 4
        self.order = np.argsort(quarter, axis=1, kind="stable")
        self.quarter = np.take_along_axis(quarter, self.order, axis=1)

    def own(self, x: np.ndarray, held: np.ndarray) -> np.ndarray:
        """Squared distance of each part to the entry that holds it."""
        step = x - self.book[held]
        return (step * step).sum(axis=1)

    def assign(self, x: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, int]:
        """Each part's nearest entry, given the one that held it, and how many distances that took."""
        own, out, looked = self.own(x, held), held.copy(), len(x)
        radius = np.full(len(self.book), -1, np.int64)
        np.maximum.at(radius, held, own)
        neighbours = np.array([np.searchsorted(q, r, side="right") for q, r in zip(self.quarter, radius, strict=True)])
        nearest = self.quarter[:, 1] if len(self.book) > 1 else np.full(len(self.book), np.iinfo(np.int64).max)
        active = np.flatnonzero(own >= nearest[held])  # the others are in the stable core
        active = active[np.lexsort((own[active], held[active]))]
        edges = np.append(np.flatnonzero(np.diff(held[active], prepend=-1)), len(active))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            entry = held[active[a]]
            near, rings = self.order[entry, : neighbours[entry]], self.quarter[entry, : neighbours[entry]]
            for k in range(a, b, CHUNK):
                some = active[k : min(b, k + CHUNK)]
                ring = np.searchsorted(rings, own[some], side="right")
                candidates = near[: ring[-1]]
                far = squared(x[some], self.book[candidates])
                far[np.arange(len(candidates))[None, :] >= ring[:, None]] = np.iinfo(np.int64).max
                least = far.min(axis=1)
                out[some] = np.where(far == least[:, None], candidates[None, :], len(self.book)).min(axis=1)
                looked += far.size
        return out, looked


def sound_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and vector (doubles) of the rows that have a vector of finite components, in whole parts."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(v.isNotNull() & (F.size(v) > 0) & (F.size(v) % PARTS == 0) & finite)


def first_books(rows: DataFrame) -> tuple[DataFrame, list[np.ndarray]]:
    """The rows of the right dimension, and the first codebooks: the parts of the ``ENTRIES`` smallest ids."""
    least = lambda df: df.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).collect()
    first = least(rows)  # at most ENTRIES rows
    if not first:
        return rows, []
    dim = len(first[0]["vector"])
    rows = rows.where(F.size("vector") == dim)
    if any(len(r["vector"]) != dim for r in first):
        first = least(rows)
    start = scaled(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), dim)
    return rows, np.split(start, PARTS, axis=1)


def _sums(parts: list[np.ndarray], codes: np.ndarray, total: np.ndarray, counts: np.ndarray) -> None:
    for p, x in enumerate(parts):
        np.add.at(total[p], codes[:, p], x)
        counts[p] += np.bincount(codes[:, p], minlength=counts.shape[1])


def assigned(table: DataFrame, books: list[np.ndarray], label: str, first: bool) -> DataFrame:
    """Rows (kind 0) with new codes, and each task's sums by part and entry (kind 1).

    The first time ``table`` holds vectors, after that vec (integers) and codes of the round before.
    """
    dim, size = sum(b.shape[1] for b in books), len(books[0])
    schema = f"kind int, vec_id {table.schema['vec_id'].dataType.simpleString()}, label {label}, vec binary, codes binary, part int, entry int, n long, total array<long>"
    names = ["kind", "vec_id", "label", "vec", "codes", "part", "entry", "n", "total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [] if first else [Balls(b) for b in books]
        total, counts = np.zeros((PARTS, size, dim // PARTS), np.int64), np.zeros((PARTS, size), np.int64)
        kinds = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n, kinds = batch.num_rows, (batch.column("vec_id").type, batch.column("label").type)
            x = scaled(batch.column("vector"), dim) if first else _vectors(batch.column("vec"), dim)
            parts = np.split(x, PARTS, axis=1)
            if first:
                codes = np.stack([nearest_of_all(q, b) for q, b in zip(parts, books, strict=True)], axis=1)
            else:
                held = _codes(batch.column("codes"))
                codes = np.stack([balls[p].assign(parts[p], held[:, p])[0] for p in range(PARTS)], axis=1)
            _sums(parts, codes, total, counts)
            vec = _pieces(x.astype("<i4")) if first else batch.column("vec")
            none = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("vec_id"), batch.column("label"), vec, _pieces(codes.astype(np.uint8)), *none], names=names)
        if kinds:
            part, entry = np.nonzero(counts)
            n = len(part)
            none = [pa.nulls(n, t) for t in (*kinds, pa.binary(), pa.binary())]
            sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), *none, pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), sums], names=names)

    return table.mapInArrow(run, schema)


def _pieces(rows: np.ndarray) -> pa.Array:
    """Rows of an array as a binary column."""
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())]).cast(pa.binary())


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64)


def refined(books: list[np.ndarray], sums: DataFrame) -> list[np.ndarray]:
    """Codebooks after a round: means rounded down; entries without parts stay.

    ``sums`` has a row for each task and used entry; those of an entry, as many as tasks, are added exactly.
    """

    def mean(group: pa.Table) -> pa.Table:
        total = np.array(group.column("total").to_pylist(), object).sum(axis=0)
        n = sum(group.column("n").to_pylist())
        return pa.table({"part": group.column("part")[:1], "entry": group.column("entry")[:1], "center": pa.array([[int(t) // n for t in total]], pa.list_(pa.int64()))})

    found = sums.select("part", "entry", "n", "total").groupBy("part", "entry").applyInArrow(mean, "part int, entry int, center array<long>")
    books = [b.copy() for b in books]
    for r in found.collect():  # a row an entry
        books[r["part"]][r["entry"]] = r["center"]
    return books


def coded(table: DataFrame, books: list[np.ndarray], label: str) -> DataFrame:
    """vec_id, label, code (hex) and error of each row, from the codes of the last round."""
    dim = sum(b.shape[1] for b in books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        balls = [Balls(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, held = np.split(_vectors(batch.column("vec"), dim), PARTS, axis=1), _codes(batch.column("codes"))
            codes = np.stack([balls[p].assign(parts[p], held[:, p])[0] for p in range(PARTS)], axis=1)
            error = sum(balls[p].own(parts[p], codes[:, p]) for p in range(PARTS))
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return table.mapInArrow(run, f"vec_id {table.schema['vec_id'].dataType.simpleString()}, label {label}, code string, error long")


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for b in books for entry in b for c in entry).encode()).hexdigest()


def compress(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code and error of each kept row; the codebook of each part position)."""
    scratch = Scratch(embeddings.sparkSession, "vector_codes")
    rows, books = first_books(sound_vectors(embeddings))
    label = embeddings.schema["label"].dataType.simpleString()
    if not books:
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    table, old = rows, None
    for turn in range(rounds):
        out = scratch.table(assigned(table, books, label, turn == 0), "round")
        books = refined(books, out.where("kind = 1"))
        if old is not None:
            scratch.drop(old)
        old, table = out, out.where("kind = 0").select("vec_id", "label", "vec", "codes")
    return scratch.table(coded(table, books, label), "coded"), books


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    rows, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label_key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("long")
    sums = rows.groupBy("label_key").agg(total.alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = join_groups(rows, sums, "label_key", "n", rows.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    distance = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, p.part, any_value(p.x) AS x, min(({distance})::BIGINT * {ENTRIES} + entry) AS m FROM p JOIN b{k} b ON p.part = b.part GROUP BY vec_id, p.part)")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT part, m % {ENTRIES} AS entry, i, floor(sum(x[i]) / count(*)) AS c FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM p))) AS i) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, b{k}.x) AS x FROM b{k} LEFT JOIN (SELECT part, entry, list(c ORDER BY i) AS x FROM s{k} GROUP BY part, entry) n USING (part, entry))""")
    return f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, e[part * (len(e) // {PARTS}) + 1 : (part + 1) * (len(e) // {PARTS})] AS x FROM v, (SELECT unnest(range({PARTS})) AS part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM p QUALIFY entry < {ENTRIES}),
{", ".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', m % {ENTRIES}), '' ORDER BY part) AS code, sum(m // {ENTRIES})::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) FROM b{rounds}) AS codebooks_sha256
FROM v JOIN c USING (vec_id)
"""


OP13_SQL = _sql()
