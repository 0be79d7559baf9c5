"""Exact dedup over a cuckoo-filter index of live digests.

The index is a table of shards in the shared folder: a shard holds the digests (SHA-256 of the
normalised text) whose leading bits name it, with the largest doc_id and the number of copies,
and a cuckoo filter over them.  Rows that come in are summed by digest within their Arrow batch
first, so that a text which a third of all rows repeat makes one row a batch, and are dealt to
their shards.  A shard asks its filter: a miss is a new digest, which is inserted; a hit is
held against the stored digests themselves (all 32 bytes), since another digest may have the
same fingerprint.  Live digests can be deleted, which frees their slot and no other's.  An
insertion that finds no slot after ``KICKS`` rounds is an overflow: the filter is built anew
with twice the buckets from the stored keys.  Shards are as many as keep each at about
``SHARD_KEYS`` digests; when an insertion would make them larger, stored keys are dealt to more.

Each change writes a new version of the table and leaves the old one, which is dropped after
that; a lost task reads its shards again.

Defined cases: a null text is empty, and empty texts equal each other.  A null doc_id is smaller
than any other; among rows with null ids alone, all have a null keep_id and are kept, as are
rows that repeat the kept id.  Other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.decontaminate import lower_ascii
from tidepool.llm.scratch import Scratch
from tidepool.llm.text_arrays import mix64

SLOTS, KICKS, FIRST_BUCKETS, SHARD_KEYS = 4, 64, 64, 4096
#: A group with more than one in so many rows is hot; there are at most so many of these.
HOT_SHARE = 1000

_U = np.uint64
NONE = np.iinfo(np.int64).min  # stands for a null doc_id inside a shard


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; every key has two buckets, each found from the other and the fingerprint."""

    def __init__(self, buckets: int = FIRST_BUCKETS, slots: np.ndarray | None = None):
        self.slots = np.zeros((buckets, SLOTS), np.uint16) if slots is None else slots

    @property
    def buckets(self) -> int:
        return len(self.slots)

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, first bucket) of 64-bit keys; a fingerprint is never 0, which marks a free slot."""
        print_ = ((keys >> _U(48)) % _U(65535) + _U(1)).astype(np.uint16)
        return print_, (mix64(keys) & _U(self.buckets - 1)).astype(np.int64)

    def other(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        return bucket ^ (mix64(print_.astype(_U)) & _U(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        print_, one = self.places(keys)
        two = self.other(print_, one)
        return (self.slots[one] == print_[:, None]).any(axis=1) | (self.slots[two] == print_[:, None]).any(axis=1)

    def _put(self, print_: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Fills free slots; which of the fingerprints found one."""
        done = np.zeros(len(print_), bool)
        left = np.arange(len(print_))
        for _ in range(SLOTS):
            left = left[(self.slots[bucket[left]] == 0).any(axis=1)]
            if not len(left):
                break
            _, once = np.unique(bucket[left], return_index=True)  # one fingerprint a bucket at a time
            now = left[once]
            self.slots[bucket[now], (self.slots[bucket[now]] == 0).argmax(axis=1)] = print_[now]
            done[now] = True
            left = left[~done[left]]
        return done

    def insert(self, keys: np.ndarray) -> bool:
        """Inserts all keys; False, with the filter spoilt, if some found no slot."""
        print_, bucket = self.places(keys)
        for kick in range(KICKS):
            done = self._put(print_, bucket)
            print_, bucket = print_[~done], bucket[~done]
            if not len(print_):
                return True
            bucket = self.other(print_, bucket)
            done = self._put(print_, bucket)
            print_, bucket = print_[~done], bucket[~done]
            if not len(print_):
                return True
            # In each full bucket one fingerprint takes another's slot, and that one goes on to its other bucket.
            _, once = np.unique(bucket, return_index=True)
            slot = (once + kick) % SLOTS
            out = self.slots[bucket[once], slot]
            self.slots[bucket[once], slot] = print_[once]
            print_[once] = out
            bucket[once] = self.other(out, bucket[once])
        return False

    def delete(self, keys: np.ndarray) -> None:
        """Frees one slot for each key, all of which must have been inserted."""
        print_, one = self.places(keys)
        two = self.other(print_, one)
        left = np.arange(len(keys))
        while len(left):
            here = np.where((self.slots[one[left]] == print_[left, None]).any(axis=1), one[left], two[left])
            _, first = np.unique(here, return_index=True)
            now, at = left[first], here[first]
            held = self.slots[at] == print_[now, None]
            if not held.any(axis=1).all():
                raise ValueError("a key to be deleted isn't in the filter")
            self.slots[at, held.argmax(axis=1)] = 0
            left = np.delete(left, first)

    @classmethod
    def over(cls, keys: np.ndarray, buckets: int) -> CuckooFilter:
        """A filter of the keys with ``buckets`` buckets, or as many more as they need."""
        while True:
            new = cls(buckets)
            if len(keys) <= buckets * SLOTS and new.insert(keys):
                return new
            buckets *= 2


class Shard:
    """The live digests of one shard: sorted, with largest doc_id and number of rows, and their filter."""

    def __init__(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray, filter_: CuckooFilter):
        self.digests, self.ids, self.counts, self.filter = digests, ids, counts, filter_

    @classmethod
    def empty(cls) -> Shard:
        return cls(np.zeros(0, "S32"), np.zeros(0, np.int64), np.zeros(0, np.int64), CuckooFilter())

    @classmethod
    def from_row(cls, row: dict) -> Shard:
        slots = np.frombuffer(row["slots"], "<u2").reshape(-1, SLOTS).copy()
        ids, counts = (np.frombuffer(row[c], "<i8") for c in ("ids", "counts"))
        return cls(np.frombuffer(row["digests"], "S32"), ids.copy(), counts.copy(), CuckooFilter(slots=slots))

    def to_row(self, shard: int) -> dict:
        return {"shard": shard, "live": len(self.digests), "slots": self.filter.slots.astype("<u2").tobytes(), "digests": self.digests.tobytes(), "ids": self.ids.astype("<i8").tobytes(), "counts": self.counts.astype("<i8").tobytes()}

    @staticmethod
    def keys(digests: np.ndarray) -> np.ndarray:
        """64 bits of each digest for the filter, behind those that name the shard."""
        return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)[:, 3].astype(_U)

    def find(self, digests: np.ndarray) -> np.ndarray:
        """Place of each digest among the live ones, or -1: the filter answers first, stored digests have the last word."""
        out = np.full(len(digests), -1)
        maybe = np.flatnonzero(self.filter.contains(self.keys(digests))) if len(self.digests) else np.zeros(0, np.int64)
        at = np.searchsorted(self.digests, digests[maybe])
        there = at < len(self.digests)
        there[there] = self.digests[at[there]] == digests[maybe[there]]
        out[maybe[there]] = at[there]
        return out

    def insert(self, digests: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Adds rows; digests may repeat."""
        digests, group = np.unique(digests, return_inverse=True)
        top, sums = np.full(len(digests), NONE), np.zeros(len(digests), np.int64)
        np.maximum.at(top, group, ids)
        np.add.at(sums, group, counts)
        at = self.find(digests)
        old, new = at >= 0, at < 0
        self.ids[at[old]] = np.maximum(self.ids[at[old]], top[old])
        self.counts[at[old]] += sums[old]
        if new.any():
            merged = np.concatenate([self.digests, digests[new]])
            order = np.argsort(merged, kind="stable")
            self.digests = merged[order]
            self.ids, self.counts = (np.concatenate(x)[order] for x in ((self.ids, top[new]), (self.counts, sums[new])))
            if not self.filter.insert(self.keys(digests[new])):
                self.filter = CuckooFilter.over(self.keys(self.digests), 2 * self.filter.buckets)

    def delete(self, digests: np.ndarray) -> None:
        """Takes digests out; those that aren't live are passed over."""
        at = self.find(np.unique(digests))
        at = at[at >= 0]
        self.filter.delete(self.keys(self.digests[at]))
        self.digests, self.ids, self.counts = (np.delete(x, at) for x in (self.digests, self.ids, self.counts))


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id and digest (32 bytes) of each row: the SHA-256 of its text with A to Z in lower case."""
    return docs.select("doc_id", F.unhex(F.sha2(lower_ascii(F.coalesce(F.col("text"), F.lit(""))), 256)).alias("digest"))


def summed_in_batches(digests: DataFrame) -> DataFrame:
    """digest, top (largest doc_id) and n of the rows of each Arrow batch: bounded, and no exchange."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table({"digest": batch.column("digest"), "top": batch.column("doc_id").cast(pa.int64())})
            out = table.group_by("digest").aggregate([("top", "max"), ([], "count_all")]).select(["digest", "top_max", "count_all"])
            yield from out.rename_columns(["digest", "top", "n"]).to_batches()

    return digests.select("digest", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "digest binary, top long, n long")


def shard_of(digest: Column, shards: int) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long") * shards / (1 << 32)


SHARD_SCHEMA = "shard int, live long, slots binary, digests binary, ids binary, counts binary"
ROW_SCHEMA = "digest binary, top long, n long"


def _binary(column: pa.Array) -> np.ndarray:
    """Digests of a binary column, as 32-byte strings."""
    return np.frombuffer(b"".join(column.to_pylist()), "S32")


def _changed(batches: Iterator[pa.RecordBatch], change: str) -> Iterator[pa.RecordBatch]:
    """Shard rows after the rows that follow them; input is sorted by shard, its stored row first."""
    number, shard = None, None
    names = [f.split()[0] for f in SHARD_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int64(), *[pa.binary()] * 4]

    def done() -> pa.RecordBatch:
        row = shard.to_row(number)
        return pa.RecordBatch.from_arrays([pa.array([row[c]], t) for c, t in zip(names, types, strict=True)], names=names)

    for batch in batches:
        numbers = batch.column("shard").to_numpy()
        edges = np.append(np.flatnonzero(np.diff(numbers, prepend=-1)), len(numbers))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if numbers[a] != number:
                if shard is not None:
                    yield done()
                number, shard = int(numbers[a]), Shard.empty()
            part = batch.slice(a, b - a)
            if part.column("slots")[0].is_valid:
                shard = Shard.from_row(part.slice(0, 1).to_pylist()[0])
                part = part.slice(1)
            if part.num_rows:
                digests = _binary(part.column("digest"))
                if change == "delete":
                    shard.delete(digests)
                else:
                    ids = part.column("top").fill_null(NONE).to_numpy()
                    shard.insert(digests, ids, part.column("n").to_numpy())
    if shard is not None:
        yield done()


class DigestIndex:
    """A versioned table of shards; ``insert`` and ``delete`` give the next version."""

    def __init__(self, spark: SparkSession, scratch: Scratch | None = None, shard_keys: int = SHARD_KEYS):
        self.spark, self.scratch, self.shard_keys = spark, scratch or Scratch(spark, "digests"), shard_keys
        self.shards, self.table = 1, None

    def _apply(self, rows: DataFrame, change: str) -> None:
        stored = self.table.select(*SHARD_COLUMNS) if self.table is not None else self.spark.createDataFrame([], SHARD_SCHEMA)
        new = rows.select(F.floor(shard_of(F.col("digest"), self.shards)).cast("int").alias("shard"), "digest", "top", "n")
        both = stored.unionByName(new, allowMissingColumns=True)
        # The stored row comes first: its filter isn't null, and it has no digest of its own.
        dealt = both.repartition(max(1, min(self.shards, self._parallel())), "shard").sortWithinPartitions("shard", F.col("slots").isNull())
        out = dealt.mapInArrow(lambda batches: _changed(batches, change), SHARD_SCHEMA)
        old, self.table = self.table, self.scratch.table(out, "shards")
        if old is not None:
            self.scratch.drop(old)

    def _parallel(self) -> int:
        return int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _grown(self, live: int) -> None:
        """More shards if ``live`` digests would overfill them, dealt from the stored keys."""
        wanted = self.shards
        while wanted * self.shard_keys < live:
            wanted *= 2
        if wanted > self.shards:
            stored, self.shards = self.table, wanted
            if stored is not None:
                self.table = None
                self._apply(entries(stored).select("digest", F.col("keep_id").alias("top"), F.col("group_size").alias("n")), "insert")
                self.scratch.drop(stored)

    def live(self) -> int:
        return 0 if self.table is None else self.table.agg(F.sum("live")).first()[0] or 0

    def insert(self, docs: DataFrame) -> DigestIndex:
        """Adds the rows of ``docs`` (doc_id, digest)."""
        summed = self.scratch.table(summed_in_batches(docs), "summed")
        self._grown(self.live() + summed.count())
        self._apply(summed, "insert")
        self.scratch.drop(summed)
        return self

    def delete(self, docs: DataFrame) -> DigestIndex:
        """Takes out the digests of ``docs`` (digest), with all their copies."""
        rows = docs.select("digest").distinct().withColumns({"top": F.lit(None).cast("long"), "n": F.lit(0).cast("long")})
        if self.table is not None:
            self._apply(rows, "delete")
        return self

    def entries(self) -> DataFrame:
        return entries(self.table)


SHARD_COLUMNS = [f.split()[0] for f in SHARD_SCHEMA.split(", ")]


def entries(table: DataFrame) -> DataFrame:
    """digest, keep_id and group_size of the live digests of a table of shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.from_row(row)
                digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), len(shard.digests), [None, pa.py_buffer(shard.digests.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array(shard.ids, mask=shard.ids == NONE), pa.array(shard.counts)], names=["digest", "keep_id", "group_size"])

    return table.mapInArrow(run, "digest binary, keep_id long, group_size long")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` with the columns of their group, by the column ``key``.

    Groups with more than one in ``HOT_SHARE`` of the ``total`` rows, which are at most that many,
    are broadcast; of the others no key holds more than that share of the exchange.
    """
    hot = groups.where(F.col(size) * HOT_SHARE > total)
    few = F.broadcast(hot)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(size) * HOT_SHARE <= total), key)
    return rows.join(few, key).unionByName(rest)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, digest, keep_id, group_size and kept of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    rows = scratch.table(with_digest(docs), "digests")
    index = DigestIndex(spark, scratch).insert(rows)
    groups = scratch.table(index.entries(), "groups")
    out = join_groups(rows, groups, "digest", "group_size", rows.count())
    return out.withColumn("keep_id", F.col("keep_id").cast(docs.schema["doc_id"].dataType)).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op12_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP12_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
