"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-cased text (white space runs as
one blank), weighted by relative frequency times inverse document frequency.  Document
frequencies are counted over every text that may be learnt from.  The weights are trained by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows
(``SAMPLE_ROWS`` in expectation and twice that at most, spread evenly over languages by hash
order), and a temperature is then
fitted on a part of that sample that training hasn't seen.  Scoring is one pass over whole
texts without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0.  Null languages
are never learnt.  With no learnable row every text is ``und``; with one language all others
get it.  Repeated rows are scored each; ties between languages go to the first by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.text_arrays import text_runs

BITS = 15
DIMENSIONS = 1 << BITS
#: Most rows that the classifier is fitted on.
SAMPLE_ROWS = 2000
EPOCHS, ALPHA, BETA, L1, L2 = 8, 1.0, 1.0, 1e-5, 1e-6


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, flat, and each text's bounds; grams don't cross texts."""
    cleaned = [" " + " ".join(t.lower().split()) + " " for t in texts]
    code = np.frombuffer("".join(cleaned).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, cleaned), np.int64, len(cleaned))
    bounds = np.concatenate([[0], np.cumsum(size)])
    one = code * np.uint32(2654435761)
    grams = np.zeros((len(code), 3), np.uint32)
    grams[:, 0] = one
    grams[:, 1] = one * np.uint32(31)
    grams[:-1, 1] += one[1:] ^ np.uint32(0x5BD1E995)
    grams[:, 2] = grams[:, 1] * np.uint32(0x01000193)
    grams[:-2, 2] += one[2:] ^ np.uint32(0x27D4EB2F)
    grams ^= grams >> np.uint32(15)
    grams *= np.uint32(0x85EBCA6B)
    grams >>= np.uint32(32 - BITS)
    last = bounds[1:] - 1
    grams[last, 1] = grams[last, 0]  # no n-gram reaches into the next text
    grams[last, 2] = grams[last, 0]
    grams[last[size > 1] - 1, 2] = grams[last[size > 1] - 1, 1]
    return grams, bounds


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each hashed n-gram stands, and how many texts there are.

    Each task sums its documents first and emits DIMENSIONS counts at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, np.int64), 0
        seen = np.zeros(DIMENSIONS, bool)
        for batch in batches:
            for _, texts in text_runs(batch.column(0)):
                grams, bounds = _grams(texts)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    seen[:] = False
                    seen[grams[a:b].ravel()] = True
                    total += seen
                n += len(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"g": pa.array(np.append(at, -1)), "n": pa.array(np.append(total[at], n))})

    counted = docs.select("text").mapInArrow(run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).toArrow()
    gram, n = counted["g"].to_numpy(), counted["n"].to_numpy()
    out = np.zeros(DIMENSIONS, np.int64)
    out[gram[gram >= 0]] = n[gram >= 0]
    return out, int(n[gram < 0].sum())


def sparse_features(docs: DataFrame) -> DataFrame:
    """lang, and the indices and relative frequencies of a text's n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(1)
            for first, texts in text_runs(batch.column(0)):
                grams, bounds = _grams(texts)
                at, tf = [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    ids, n = np.unique(grams[a:b].ravel(), return_counts=True)
                    at.append(ids.astype(np.int32))
                    tf.append((n / n.sum()).astype(np.float32))
                yield pa.RecordBatch.from_pydict({"lang": langs.slice(first, len(texts)), "at": pa.array(at, pa.list_(pa.int32())), "tf": pa.array(tf, pa.list_(pa.float32()))})

    return docs.select("text", "lang").mapInArrow(run, "lang string, at array<int>, tf array<float>")


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # (DIMENSIONS, languages), idf included
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, languages) from flat n-grams; all texts have some."""
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        for c in range(len(self.languages)):
            column = np.ascontiguousarray(self.weights[:, c])
            out[:, c] = np.add.reduceat(column[grams].sum(1), bounds[:-1])
        return out / (3 * np.diff(bounds))[:, None] + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray) -> LanguageModel:
    """FTRL-proximal with elastic net over (language index, n-grams, frequencies), then a temperature.

    Every fifth row is kept for the temperature, which is chosen by its log loss.
    """
    k = len(languages)
    z, n = np.zeros((DIMENSIONS + 1, k)), np.zeros((DIMENSIONS + 1, k))
    scale = 100.0  # relative frequencies are small numbers

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zz, nn = z[at], n[at]
        w = -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(nn)) / ALPHA + L2)
        return np.where(np.abs(zz) <= L1, 0.0, w)

    learn = [(y, np.append(at, DIMENSIONS), np.append(tf * idf[at] * scale, 1.0)) for i, (y, at, tf) in enumerate(rows) if i % 5]
    kept = [(y, np.append(at, DIMENSIONS), np.append(tf * idf[at] * scale, 1.0)) for i, (y, at, tf) in enumerate(rows) if i % 5 == 0]
    for _ in range(EPOCHS):
        for y, at, x in learn:
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    model = LanguageModel(languages, (w[:-1] * idf[:, None] * scale).astype(np.float32), w[-1])
    if kept:
        logits, truth = np.stack([x @ w[at] for _, at, x in kept]), np.array([y for y, _, _ in kept])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 60))
        doubt = 1 / (len(truth) + 2)  # Laplace's estimate of the error rate that so few rows can't show
        target = np.full((len(truth), k), doubt / k)
        target[np.arange(len(truth)), truth] += 1 - doubt
        loss = [-(target * np.log(np.maximum(_softmax(logits / t), 1e-300))).sum(1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def fit_language_model(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Fit on ``docs`` (text, lang, order): frequencies over all rows, weights on a sample.

    ``order`` is a pseudo-random number below 1 that decides which rows are in the sample: each
    language's smallest, in equal shares, ``sample_rows`` in expectation and 2 * ``sample_rows``
    at most, whatever repeats; rows equal in language, text and order count once.  The cut-offs
    come from how many different numbers a language has (estimated), so no group is gathered
    anywhere.  Languages beyond the ``sample_rows`` most frequent are left out.
    """
    spark = docs.sparkSession
    known = docs.where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("order", 0.02).alias("n")).orderBy(F.desc("rows"), "lang").limit(sample_rows).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((DIMENSIONS, 0), np.float32), np.zeros(0))
    frequency, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + frequency)) + 1
    share = sample_rows / len(languages)
    # One row a language, ``sample_rows`` at most.
    cuts = spark.createDataFrame([(lang, min(1.0, share / n)) for lang, n in sizes.items()], "cut_lang string, cut double")
    picked = known.join(F.broadcast(cuts), F.col("lang") == F.col("cut_lang")).where("order < cut")
    picked = picked.select("text", "lang", "order", (F.col("order") / F.col("cut")).alias("rank")).dropDuplicates(["lang", "order", "text"]).orderBy("rank", "lang", "text").limit(2 * sample_rows)
    index = {lang: k for k, lang in enumerate(languages)}
    sample = sparse_features(picked).toArrow()  # 2 * sample_rows rows at most
    rows = [(index[lang], at.values.to_numpy().astype(np.int64), tf.values.to_numpy().astype(float)) for lang, at, tf in zip(sample["lang"].to_pylist(), sample["at"], sample["tf"], strict=True)]
    rows.sort(key=lambda r: (len(r[1]), r[0], r[2].tolist()))  # the same order however the input is split
    order = np.random.default_rng(7).permutation(len(rows))
    return train([rows[i] for i in order], languages, idf)


def predict(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of every row of ``docs`` (column ``text``)."""
    names = list(keep)
    readable = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    source = docs.select(*keep, F.when(readable, F.col("text")).alias("__text"))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    labels = np.array([*model.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("__text")
            blank = column.is_null().to_numpy(zero_copy_only=False)
            best, score = np.full(len(blank), len(labels) - 1), np.zeros(len(blank))
            for first, texts in text_runs(column) if model.languages else ():
                p = _softmax(model.logits(*_grams(texts)) / model.temperature)
                best[first : first + len(texts)] = p.argmax(1)
                score[first : first + len(texts)] = p.max(1)
            best[blank], score[blank] = len(labels) - 1, 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(labels[best], pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held_out = F.coalesce(crc % 5 == 0, F.lit(False))
    order = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)).alias("order")
    learn = docs.where((crc % 5 != 0) & F.col("lang").isNotNull()).select("text", "lang", order)
    model = fit_language_model(learn)
    return predict(docs, model, "doc_id").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
