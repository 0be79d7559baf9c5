"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a Gaussian over the statistics.  Its covariance is the class's own, shrunk
towards the pooled one and towards a scaled identity; the score is the logistic function of
the difference of the two log densities (Mahalanobis distances by cached Cholesky factors)
and of the log prior odds.  Means and covariances come from sums over *all* labelled rows,
pre-aggregated in each task: the driver receives one small matrix for each task's batch run.

Defined cases: a null text is an empty one; empty texts have all statistics 0 and get a score
like any other.  Labels other than 0 and 1 are ignored, and a document with several labels
counts once for each.  With fewer than two labelled rows of either class every score is the
share of label 1 (0.5 without labels).  Statistics see whole texts, however long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.llm.scratch import Scratch
from tidepool.llm.text_arrays import LOWER, WHITE_SPACE, shingle_hashes, slices, sums_by_document, text_column, word_hashes, words

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "sd_word", "upper", "digit", "symbol", "marks", "pipe", "non_ascii", "short_words",
    "no_letter_words", "distinct_words", "repeated_next", "capital_words", "words_a_line",
)


#: Words and bytes at the usual rate that each text's rates are shrunk by.
WORD_WEIGHT, BYTE_WEIGHT = 10.0, 50.0


def _class_table() -> np.ndarray:
    """Columns: upper, lower, digit, symbol, sentence mark, pipe, line end, byte of a non-ASCII letter, letter."""
    b = np.arange(256)
    upper, lower, digit, other = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57), b >= 128
    mark = np.isin(b, np.frombuffer(b".,;:!?", np.uint8))
    pipe, line = b == 124, b == 10
    space = WHITE_SPACE
    symbol = ~(upper | lower | digit | other | mark | pipe | space)
    return np.stack([upper, lower, digit, symbol, mark, pipe, line, other, upper | lower | other], axis=1)


_CLASSES = _class_table()


def statistics(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The transformed statistics of each document in a slice: (documents, len(STATISTICS))."""
    n = len(bounds) - 1
    out = np.zeros((n, len(STATISTICS)))
    if not len(raw):
        return out
    counts = np.stack([sums_by_document(_CLASSES[:, k][raw], bounds) for k in range(_CLASSES.shape[1])], axis=1)
    size = np.maximum(np.diff(bounds), 1).astype(float)
    at, end, doc = words(raw, bounds, WHITE_SPACE)
    n_words = np.bincount(doc, minlength=n).astype(float)
    safe = np.maximum(n_words, 1)
    length = (end - at).astype(float)
    # Rates of short texts say little: each has the weight of a few words or bytes at a usual rate besides.
    by_doc = lambda x, usual: (np.bincount(doc, weights=x, minlength=n) + WORD_WEIGHT * usual) / (n_words + WORD_WEIGHT)
    rate = lambda k, usual: np.sqrt((counts[:, k] + BYTE_WEIGHT * usual) / (size + BYTE_WEIGHT))
    mean = by_doc(length, 4.5)
    letters = np.concatenate([[0], np.cumsum(_CLASSES[:, 8][raw])])
    hashes = word_hashes(LOWER[raw], at, end)
    _, owner = shingle_hashes(hashes, doc, n, 1)
    distinct = np.bincount(owner, minlength=n) / safe
    again = np.zeros(len(at))
    if len(at) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    capital = _CLASSES[:, 0][raw[at]] if len(at) else np.zeros(0)
    upper_total = np.concatenate([[0], np.cumsum(_CLASSES[:, 0][raw])])
    shout = (upper_total[end] - upper_total[at]) >= 2
    lines = counts[:, 6] + 1
    columns = [
        np.log1p(size), np.log1p(n_words), np.log1p(lines), np.log1p(mean), np.log1p(np.sqrt(np.maximum(by_doc(length**2, 26.0) - mean**2, 0))),
        rate(0, 0.02), rate(2, 0.0), rate(3, 0.0), rate(4, 0.03), rate(5, 0.0),
        counts[:, 7] / size, by_doc(length <= 3, 0.4), np.sqrt(by_doc(letters[end] == letters[at], 0.0)), distinct * np.log1p(n_words), np.sqrt(by_doc(again, 0.0)),
        np.sqrt(by_doc(shout, 0.0)) + by_doc(capital, 0.1), np.log1p(n_words / lines),
    ]
    out[:] = np.stack(columns, axis=1)
    out[np.diff(bounds) == 0] = 0
    return out


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``stats`` (array of double) of every row of ``docs`` (column ``text``)."""
    source = docs.select(*keep, "text")
    schema = source.select(*keep).schema.add("stats", T.ArrayType(T.DoubleType()))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_column(batch.column("text"))
            parts = [statistics(part, where) for _, _, part, where in slices(raw, bounds)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))
            width = x.shape[1]
            stats = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), stats], names=[*names, "stats"])

    return source.mapInArrow(run, schema)


@dataclass
class Discriminant:
    """Fitted model: ``log_odds`` of class 1 against class 0."""

    mean: np.ndarray
    inverse: np.ndarray  # inverse Cholesky factors, one for each class
    log_det: np.ndarray
    log_prior: np.ndarray
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        density = [-0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) - 0.5 * self.log_det[c] + self.log_prior[c] for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit_from_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float, to_identity: float) -> Discriminant:
    """From each class's count, sum and sum of outer products."""
    n = np.array([sums[c][0] if c in sums else 0.0 for c in (0, 1)])
    if n.min() < 2:
        return Discriminant(np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0), constant=float(n[1] / n.sum()) if n.sum() else 0.5)
    mean = np.stack([sums[c][1] / n[c] for c in (0, 1)])
    own = np.stack([sums[c][2] / n[c] - np.outer(mean[c], mean[c]) for c in (0, 1)])
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    scale = np.maximum(np.diag(pooled), 1e-6)
    covariance = [(1 - to_pooled) * own[c] + to_pooled * pooled + to_identity * np.diag(scale) for c in (0, 1)]
    lower = [np.linalg.cholesky(c) for c in covariance]
    inverse = np.stack([np.linalg.inv(x) for x in lower])
    log_det = np.array([2 * np.log(np.diag(x)).sum() for x in lower])
    return Discriminant(mean, inverse, log_det, np.log(n / n.sum()))


def fit(rows: DataFrame, to_pooled: float = 0.1, to_identity: float = 0.05) -> Discriminant:
    """Fit on every row of ``rows`` (columns ``stats`` and ``label``)."""
    width = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            x = np.array(batch.column("stats").flatten()).reshape(-1, width)
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                own = x[label == c]
                if len(own):
                    old = total.setdefault(c, [0.0, np.zeros(width), np.zeros((width, width))])
                    old[0] += len(own)
                    old[1] += own.sum(0)
                    old[2] += own.T @ own
        if total:
            yield pa.RecordBatch.from_pydict({"label": pa.array(list(total), pa.int32()), "sums": [[v[0], *v[1], *v[2].ravel()] for v in total.values()]})

    each = rows.where("label in (0, 1)").select("label", "stats").mapInArrow(run, "label int, sums array<double>")
    parts = each.select("label", F.posexplode("sums")).groupBy("label", "pos").agg(F.sum("col").alias("v"))
    sums: dict[int, tuple] = {}
    flat: dict[int, np.ndarray] = {}
    for row in parts.collect():  # 2 x (1 + p + p^2) numbers, whatever the number of rows
        flat.setdefault(row["label"], np.zeros(1 + width + width * width))[row["pos"]] = row["v"]
    for c, v in flat.items():
        sums[c] = (v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width))
    return fit_from_sums(sums, to_pooled, to_identity)


def score(rows: DataFrame, model: Discriminant, *keep: str) -> DataFrame:
    """The columns ``keep`` with ``score`` and ``predicted`` of every row of ``rows`` (column ``stats``)."""
    names, width = list(keep), len(STATISTICS)
    source = rows.select(*keep, "stats")
    schema = source.select(*keep).schema.add("score", "double").add("predicted", T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(np.array(batch.column("stats").flatten()).reshape(-1, width))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    return source.mapInArrow(run, schema)


def fold(doc_id: str):
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def fit_quality(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on the labelled ones of ``rows`` (doc_id and stats) outside the held-out fold.

    The join carries ids and statistics, some 150 bytes a document, and no texts.
    """
    label = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("label"))
    learn = label.where(fold("doc_id") != 1)
    return fit(rows.where(F.col("doc_id").isNotNull()).select("doc_id", "stats").join(learn, "doc_id"))


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Texts are read once: their statistics are written, fitted on and scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = Scratch(spark, "quality").table(with_statistics(docs, "doc_id"), "statistics")
    scored = score(rows, fit_quality(rows, spark.read.parquet(f"{sf_dir}/labels.parquet")), "doc_id")
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", "predicted")
