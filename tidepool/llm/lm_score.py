"""Cross-entropy difference of matched target and background word-bigram models.

Tokens are the words of a text (runs of bytes that aren't white space, A to Z lower-cased) and
a mark at its end; the same mark stands before its first word.  Both models share one
vocabulary, all words of the corpus and the mark, and the same smoothing: a bigram's
probability is a Dirichlet prior's mean (``STRENGTH`` tokens of the word's own probability), a
word's is interpolated with the uniform distribution by Witten and Bell.  The background is
counted over every document, held-out ones included; the target over those marked as wanted.
A document's score is the mean over its tokens of background loss minus target loss, in
nats: above 0, the target model predicts it better.

Counts cover all n-grams, none is pruned, and the tables grow with the corpus.  Texts are read
once, in batches of about ``BATCH_BYTES``, whose words are written as indices into the batch's
sorted word hashes.  A batch asks for the counts of its distinct words and bigrams, in
squeezed arrays dealt by ranges of the hash; each range is summed over all batches in one
task (about ``RANGE_KEYS`` of the batches' distinct n-grams) and answered.  So an n-gram
that every document holds comes once from each batch, and no document's n-grams are rows.

Defined cases: a null text is an empty one; empty texts score 0 and are not counted.  Without
target documents the target model is the uniform one.  Repeated documents count each time.
Any number of labels of a document counts as wanted if one is.  Empty tables give no rows.
Words are known by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.quality_classifier import fold
from tidepool.llm.scratch import Scratch
from tidepool.llm.text_arrays import LOWER, WHITE_SPACE, mix64, slices, text_column, word_hashes, words

BATCH_BYTES, RANGE_KEYS = 8 << 20, 2_000_000
#: Weight of a word's own probability in that of a bigram, in tokens.
STRENGTH = 2.0
_U = np.uint64


def squeeze(values: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: planes of leading zeros take no space."""
    return zlib.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), 1)


def loosen(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=_U(0)))


def loosen_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(loosen(data, _U), dtype=_U)


def batches(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(batch, ids, n, vocabulary, tokens, sizes): documents' words as indices into the batch's word hashes.

    ``n``: tokens, ends included; ``sizes``: words of each document.  Each document that has
    words is followed by the mark of hash 0.
    """
    source = docs.select("doc_id", "text")
    fields = [T.StructField("batch", T.LongType()), T.StructField("ids", T.ArrayType(source.schema["doc_id"].dataType)), T.StructField("n", T.LongType())]
    schema = T.StructType([*fields, *(T.StructField(c, T.BinaryType()) for c in ("vocabulary", "tokens", "sizes"))])

    def hashed(part: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = LOWER[part]
        starts, ends, doc = words(raw, where, WHITE_SPACE)
        size = np.bincount(doc, minlength=len(where) - 1)
        ends_at = np.cumsum(size)[size > 0]
        return np.insert(word_hashes(raw, starts, ends) | _U(1), ends_at, _U(0)), size

    def row(k: int, ids: list, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        token, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        vocabulary, index = np.unique(token, return_inverse=True)
        ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([(TaskContext.get().partitionId() << 32) + k]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(token)]),
                *(pa.array([x], pa.binary()) for x in (squeeze_sorted(vocabulary), squeeze(index.astype(np.uint32)), squeeze(size.astype(np.uint32)))),
            ],
            names=schema.names,
        )

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, ids, parts, held = 0, [], [], 0
        for batch in rows:
            raw, bounds = text_column(batch.column(1))
            for first, last, part, where in slices(raw, bounds):
                ids.append(batch.column(0).slice(first, last - first))
                parts.append(hashed(part, where))
                held += len(part)
                if held >= batch_bytes:
                    yield row(k, ids, parts)
                    k, ids, parts, held = k + 1, [], [], 0
        if parts:
            yield row(k, ids, parts)

    return source.mapInArrow(run, schema)


class Batch:
    """One row of ``batches`` (with ``wanted``, positions of documents), taken apart."""

    def __init__(self, row: dict):
        self.vocabulary, self.token, self.sizes = loosen_sorted(row["vocabulary"]), loosen(row["tokens"], np.uint32), loosen(row["sizes"], np.uint32).astype(np.int64)
        length = np.where(self.sizes > 0, self.sizes + 1, 0)
        self.doc = np.repeat(np.arange(len(length)), length)
        flags = np.zeros(len(length), bool)
        flags[row["wanted"] or []] = True
        self.wanted = flags[self.doc]
        # The mark, index 0, stands before each document's first word: the token before that is its predecessor's mark.
        before = np.concatenate([[0], self.token[:-1]]).astype(np.uint64) if len(self.token) else np.zeros(0, _U)
        pair = before << _U(32) | self.token
        pairs, self.pair = np.unique(pair, return_inverse=True)
        self.before, self.word = (pairs >> _U(32)).astype(np.int64), (pairs & _U(0xFFFFFFFF)).astype(np.int64)
        self.gram = mix64(mix64(self.vocabulary[self.before] + _U(1)) + self.vocabulary[self.word])
        self.order = np.argsort(self.gram)


def _asks(marked: DataFrame, level: str, ranges: int) -> DataFrame:
    """(range, batch, keys, background, target) of each batch's distinct words or bigrams."""
    upper = np.array([(k << 64) // ranges for k in range(1, ranges)], _U)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in rows:
            for row in some.to_pylist():
                b = Batch(row)
                index, keys = (b.token, b.vocabulary) if level == "word" else (b.pair, b.gram[b.order])
                n, m = np.bincount(index, minlength=len(keys)), np.bincount(index[b.wanted], minlength=len(keys))
                if level == "bigram":
                    n, m = n[b.order], m[b.order]
                cut = [0, *np.searchsorted(keys, upper), len(keys)]
                for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if lo < hi:
                        yield pa.RecordBatch.from_pylist([{"range": k, "batch": row["batch"], "keys": squeeze_sorted(keys[lo:hi]), "background": squeeze(n[lo:hi].astype(np.uint32)), "target": squeeze(m[lo:hi].astype(np.uint32))}])

    return marked.select("batch", "vocabulary", "tokens", "sizes", "wanted").mapInArrow(run, "range long, batch long, keys binary, background binary, target binary")


def _answers(asks: DataFrame, level: str) -> DataFrame:
    """(level, range, batch, background, target): the asked keys' counts over all batches, in the same order.

    kinds, target_kinds and the sums n and target_n of a range stand in one of its rows.
    """

    def run(group: pa.Table) -> pa.Table:
        keys = [loosen_sorted(k) for k in group.column("keys").to_pylist()]
        unique, where = np.unique(np.concatenate(keys), return_inverse=True)
        cut, out = np.cumsum([len(k) for k in keys])[:-1], {}
        for side in ("background", "target"):
            total = np.bincount(where, weights=np.concatenate([loosen(x, np.uint32) for x in group.column(side).to_pylist()]), minlength=len(unique)).astype(_U)
            out[side] = [squeeze(x) for x in np.split(total[where], cut)]
            out[f"{side}_n"], out[f"{side}_kinds"] = int(total.sum()), int((total > 0).sum())
        once = lambda x: [x] + [0] * (len(keys) - 1)
        return pa.table({"level": [level] * len(keys), "range": group.column("range"), "batch": group.column("batch"), "background": out["background"], "target": out["target"], **{name: once(out[name]) for name in _TOTALS}})

    return asks.groupBy("range").applyInArrow(run, "level string, range long, batch long, background binary, target binary, " + ", ".join(f"{t} long" for t in _TOTALS))


_TOTALS = ("background_n", "background_kinds", "target_n", "target_kinds")


def _scores(marked: DataFrame, answers: DataFrame, totals: dict[str, int]) -> DataFrame:
    """doc_id, n_tokens and score of every document."""
    schema = T.StructType([T.StructField("doc_id", marked.schema["ids"].dataType.elementType), T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())])
    uniform = 1 / max(totals["background_kinds"], 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b, loss = Batch(left.drop_columns(["ids"]).to_pylist()[0]), []
        rows = sorted(right.select(["level", "range", "background", "target"]).to_pylist(), key=lambda r: r["range"])
        for side in ("background", "target"):
            counts = {level: np.concatenate([np.zeros(0), *(loosen(r[side], _U) for r in rows if r["level"] == level)]) for level in ("word", "bigram")}
            n, kinds = totals[f"{side}_n"], totals[f"{side}_kinds"]
            word = (counts["word"] + kinds * uniform) / (n + kinds) if n else np.full(len(counts["word"]), uniform)
            gram = np.zeros(len(b.gram))
            gram[b.order] = counts["bigram"]
            # The mark counts as a context as often as it ends a text, and so does every word.
            loss.append(-np.log((gram + STRENGTH * word[b.word]) / (counts["word"][b.before] + STRENGTH)))
        difference = np.bincount(b.doc, weights=(loss[0] - loss[1])[b.pair], minlength=len(b.sizes))
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table({"doc_id": ids, "n_tokens": b.sizes, "score": difference / (b.sizes + 1)})

    return marked.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(run, schema)


def word_cross_entropy_difference(docs: DataFrame, wanted: DataFrame, batch_bytes: int = BATCH_BYTES, range_keys: int = RANGE_KEYS) -> DataFrame:
    """doc_id, n_tokens (words) and score of every row of ``docs``; ``wanted`` has the doc_ids of the target corpus."""
    scratch = Scratch(docs.sparkSession, "cross_entropy")
    rows = scratch.table(batches(docs, batch_bytes), "batches")
    ids = wanted.where("doc_id is not null").select(F.col("doc_id").alias("col")).distinct()
    marks = rows.select("batch", F.posexplode("ids")).join(ids, "col").groupBy("batch").agg(F.collect_list("pos").alias("wanted"))  # no more than a batch holds
    marked = scratch.table(rows.join(marks, "batch", "left"), "marked")
    scratch.drop(rows)
    ranges = math.ceil((marked.agg(F.sum("n")).first()[0] or 0) / range_keys) or 1
    singles = scratch.table(_answers(_asks(marked, "word", ranges), "word"), "words")
    totals = singles.agg(*(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in _TOTALS)).first().asDict()
    pairs = scratch.table(_answers(_asks(marked, "bigram", ranges), "bigram"), "bigrams")
    return _scores(marked, singles.union(pairs), totals)


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Target: documents of label quality 1 outside the held-out fold (crc32 of the id modulo 3 is 1)."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    wanted = labels.where((F.col("quality") == 1) & (fold("doc_id") != 1))
    scored = word_cross_entropy_difference(docs, wanted)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "n_tokens", "score")
