"""Best-fit packing by a configuration linear program over the length histogram.

Token sequences of documents are cut into pieces of at most ``CAPACITY`` tokens.  Only the
histogram of piece lengths (``CAPACITY`` numbers at most) reaches the driver.  There, the
configuration program (as few sequences as cover all lengths) is solved by multiplicative
weights: prices of lengths that are covered fall, and the best pattern for the prices is
found by knapsack dynamic programming over exact lengths.  Shares of its fractional solution
are rounded down to whole patterns, and what is left goes best fit into the remaining space.  The
solution is a short table of runs (length, ranks, sequence, offset); each piece's rank among
those of its length is found by Spark in two levels, so that no length's pieces meet in one
task, and looked up in that table.

Defined cases: a null text is an empty one and has the one id 0; empty tables have no pieces.
Repeated rows are packed each.  Documents of any length are encoded whole.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.scratch import Scratch
from tidepool.llm.text_arrays import text_runs

CAPACITY = 2048
#: Pieces below this length are not in the program, they fill what its patterns leave: the first one below which
#: one in SAND_SHARE tokens lies at most.
SAND, SAND_SHARE = (256, 128, 64, 32, 16, 0), 8
#: How much of the fractional solution is rounded down to whole patterns; best fit places the rest.
ROUNDED = (1.0, 0.6, 0.3)
STEPS, SHARPNESS = 4000, 0.15

#: Pieces of text whose ids a worker keeps, and the longest of them in characters.
KNOWN, LONGEST = 1 << 19, 64
#: The end of the Latin letters in Unicode.
LATIN = 0x250


class Encoder:
    """Token ids, as little-endian 32-bit numbers, by a tokenizer file.

    A byte-level tokenizer encodes the pieces of its splitting pattern one by one, so each distinct
    piece is encoded once and looked up after that.  Texts that name a special token, and all texts
    of other tokenizers, are encoded whole.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import public_tokenizers
        import regex
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        by_pieces = isinstance(self.tokenizer.pre_tokenizer, tokenizers.pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None
        self.split = regex.compile(public_tokenizers.PATTERN).findall if by_pieces else None
        # The same pattern over Latin letters alone, for the library that has no character properties and is faster.
        letters, numbers, blanks = (re.escape("".join(c for c in map(chr, range(LATIN)) if regex.match(kind, c))) for kind in (r"\p{L}", r"\p{N}", r"\s"))
        latin = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blanks}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
        self.split_latin = re.compile(latin.replace(r"\s", f"[{blanks}]").replace(r"\S", f"[^{blanks}]")).findall
        self.beyond_latin = re.compile(f"[^\0-{chr(LATIN - 1)}]").search
        self.known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [self.split is None or any(s in t for s in self.special) for t in texts]
        parts = [[] if w else self.split(t) if self.beyond_latin(t) else self.split_latin(t) for t, w in zip(texts, whole, strict=True)]
        if len(self.known) > KNOWN:
            self.known.clear()
        fresh = list(set(chain.from_iterable(parts)).difference(self.known))
        self.known.update(zip(fresh, self._ids(fresh), strict=True))
        ids = [self._ids([t])[0] if w else b"".join(map(self.known.__getitem__, p)) for t, w, p in zip(texts, whole, parts, strict=True)]
        for p in fresh:
            if len(p) > LONGEST:
                del self.known[p]
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The encoder of a tokenizer file, once for each Python worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""
    source = docs.select("doc_id", "text")
    schema = source.select("doc_id").schema.add("piece", T.IntegerType()).add("start", T.LongType()).add("length", T.LongType()).add("ids_crc32", T.LongType())
    end = np.zeros(1, "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            encoded = chain.from_iterable(encode(texts) for _, texts in text_runs(batch.column(1)))
            for k, data in enumerate(ids + end for ids in encoded):
                n = len(data) // 4
                at = [0] if n <= capacity else list(range(0 if n % capacity == 0 else n % capacity - capacity, n, capacity))
                for j, a in enumerate(at):
                    b = min(n, a + capacity)
                    a = max(a, 0)
                    row.append(k)
                    piece.append(j)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(data[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=schema.names)

    return source.mapInArrow(run, schema)


def best_pattern(ascending: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is taken by the most valuable pattern that fits: an unbounded knapsack."""
    # A size that isn't dearer than all smaller ones is in no better pattern than these.
    dearer = np.ones(len(price), bool)
    dearer[1:] = price[1:] > np.maximum.accumulate(price)[:-1]
    kept = np.flatnonzero(dearer)
    size, gain = ascending[kept], price[kept]
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    least = int(size[0])
    for a in range(least, capacity + 1, least):  # no capacity of a run depends on another one of it
        c = np.arange(a, min(a + least, capacity + 1))
        m = int(np.searchsorted(size, c[-1], side="right"))
        rest = c[:, None] - size[None, :m]
        total = np.where(rest >= 0, value[rest] + gain[:m], -1.0)
        choice[c] = total.argmax(axis=1)
        value[c] = total[np.arange(len(c)), choice[c]]
    pattern, c = np.zeros(len(ascending), np.int64), capacity
    while c > 0 and choice[c] >= 0:
        pattern[kept[choice[c]]] += 1
        c -= int(size[choice[c]])
    return pattern


def configuration_program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """Patterns (counts of each size) and how often each is used, fractionally, to cover ``demand``.

    Multiplicative weights for the covering program; the pricing problem is an unbounded
    knapsack by dynamic programming over the capacity.
    """
    k = len(sizes)
    order = np.argsort(sizes)
    ascending = sizes[order]
    log_weight, covered = np.zeros(k), np.zeros(k)
    used: dict[bytes, float] = defaultdict(float)
    for _ in range(STEPS):
        price = np.exp(log_weight - log_weight.max()) / demand
        pattern = np.zeros(k, np.int64)
        pattern[order] = best_pattern(ascending, price[order], capacity)
        inside = pattern > 0
        step = float((demand[inside] / pattern[inside]).min())
        used[pattern.tobytes()] += step
        share = step * pattern / demand
        covered += share
        log_weight -= SHARPNESS * share
        if covered.min() >= 12 / SHARPNESS:
            break
    # Scaled so that the demand of most sizes is met; rounding deals with the rest exactly.
    scale = 1 / max(float(np.average(covered, weights=sizes * demand)), 1e-9)
    return [(np.frombuffer(p, np.int64), x * scale) for p, x in sorted(used.items(), key=lambda u: -u[1])]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Groups of equal sequences (lengths, how many) that hold every piece of the histogram exactly once.

    One fractional solution is rounded down with each of the factors ``ROUNDED``; the fewest sequences count.
    """
    total = sum(n * c for n, c in histogram.items())
    sand = next(s for s in SAND if s == 0 or SAND_SHARE * sum(n * c for n, c in histogram.items() if n < s) <= total)
    sizes = np.array(sorted(n for n, c in histogram.items() if c > 0 and n >= sand), np.int64)
    patterns = configuration_program(sizes, np.array([histogram[int(n)] for n in sizes], float), capacity) if len(sizes) else []
    return min((_rounded(histogram, capacity, sizes, patterns, share) for share in ROUNDED), key=lambda groups: sum(count for _, count in groups))


def _rounded(histogram: dict[int, int], capacity: int, sizes: np.ndarray, patterns: list[tuple[np.ndarray, float]], share: float) -> list[tuple[tuple[int, ...], int]]:
    left = {n: c for n, c in histogram.items() if c > 0}
    spaces: dict[int, list[list]] = defaultdict(list)  # space left -> [lengths, count]
    for pattern, times in patterns:
        need = {int(sizes[k]): int(pattern[k]) for k in np.flatnonzero(pattern)}
        run = min(math.floor(times * share), *(left[n] // m for n, m in need.items()))
        if run > 0:
            for n, m in need.items():
                left[n] -= run * m
            lengths = tuple(n for n, m in need.items() for _ in range(m))
            spaces[capacity - sum(lengths)].append([lengths, run])
    # Best fit, longest first: the least space that takes the piece, a whole run of equal sequences at a time.
    for n in sorted((n for n, c in left.items() if c > 0), reverse=True):
        count, space = left[n], n
        while count:
            while space <= capacity and not spaces.get(space):
                space += 1
            if space > capacity:
                each = capacity // n
                if full := count // each:
                    spaces[capacity - each * n].append([(n,) * each, full])
                if count % each:
                    spaces[capacity - count % each * n].append([(n,) * (count % each), 1])
                break
            group = spaces[space].pop()
            fit = min(space // n, count)
            run = min(group[1], count // fit)
            if run < group[1]:
                spaces[space].append([group[0], group[1] - run])
            spaces[space - fit * n].append([group[0] + (n,) * fit, run])
            count -= run * fit
    return [(tuple(sorted(lengths, reverse=True)), count) for groups in spaces.values() for lengths, count in groups]


def run_table(groups: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset), sorted."""
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for lengths, count in groups:
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            copies = lengths.count(n)
            rows.append((n, rank[n], copies, sequence, offset))
            rank[n] += copies * count
            offset += copies * n
        sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its sequence_id and the offset in it."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = scratch.table(pieces(docs, vocabulary, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    table = run_table(solve(histogram, capacity))
    salts = max(1, math.ceil(max(histogram.values(), default=1) / max(64, sum(histogram.values()) // 4096)))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(salts)))
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.selectExpr("length", "salt", "sum(n) over (partition by length order by salt) - n as before")
    ranked = salted.selectExpr("*", "row_number() over (partition by length, salt order by doc_id, piece, ids_crc32) - 1 as own")
    ranked = ranked.join(before, ["length", "salt"]).select(*cut.columns, (F.col("own") + F.col("before")).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # its size depends on ``capacity``, not on the documents
    schema = cut.schema.add("sequence_id", T.LongType()).add("offset", T.LongType())
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        index = runs[:, 0] * (1 << 44) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(index, length * (1 << 44) + rank, side="right") - 1
            inner = rank - runs[at, 1]
            sequence = runs[at, 3] + inner // runs[at, 2]
            offset = runs[at, 4] + inner % runs[at, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(sequence), pa.array(offset)], names=names)

    return ranked.mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
