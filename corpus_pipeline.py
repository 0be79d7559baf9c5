"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared folder and gives the reread table to the next.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import decontaminate, minhash_dedup, packing, quality_classifier, secret_scan
from tidepool.llm.scratch import Scratch

#: SQL has no Gaussian discriminant fit, tokenizer or packing program: the tests hold the stages against brute force.
ORACLE_SQL = None


def whole_rows(docs: DataFrame) -> DataFrame:
    """``docs`` as one column ``row``, so that no operator's column can clash with one of theirs."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1."""
    rows = whole_rows(docs).select("row", F.col("row.text").alias("text"))
    rows = Scratch(spark, "quality").table(quality_classifier.with_statistics(rows, "row"), "statistics")
    model = quality_classifier.fit_quality(rows.select("row.doc_id", "stats"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.score(rows, model, "row").where("predicted = 1").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, 0.8): that with the smallest doc_id.

    Among rows of that id with different texts, the one with the smallest text hash stays; rows
    that repeat id and text are one document.  A null doc_id counts behind all others.  Documents
    without words are in no group and stay.
    """
    found = minhash_dedup.near_duplicates(docs, width=5, percent=80).select("doc_id", "th", "component")
    chosen = found.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("c"))
    chosen = chosen.select(F.col("c.doc_id").alias("kept_id"), F.col("c.th").alias("kept_th"))
    wordless = found.where("component is null").select("doc_id", "th")
    keys = chosen.union(wordless).distinct()
    kept = docs.join(keys, docs["doc_id"].eqNullSafe(keys["kept_id"]) & (F.xxhash64(docs["text"]) == keys["kept_th"]), "left_semi")
    repeated = found.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark passages."""
    judged = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = judged.where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("th").alias("bad_th")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_th"]), "left_anti")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the spans of secrets in its text replaced by a mark; n_chars is that of the new text."""
    found = secret_scan.scan(docs.withColumn("repository", F.col("doc_id")), "repository", "source")
    spans = found.where(F.size("spans") > 0).select(F.col("doc_id").alias("s_id"), F.col("th").alias("s_th"), "spans").dropDuplicates(["s_id", "s_th"])
    of_row = F.col("row.doc_id").eqNullSafe(F.col("s_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("s_th"))
    joined = whole_rows(docs).join(spans, of_row, "left").withColumn("clean", F.when(F.col("spans").isNotNull(), secret_scan.redact(F.col("row.text"), F.col("spans"))))
    row = F.col("row").withField("text", F.col("clean"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("clean").cast("long"))
    return joined.select(F.when(F.col("spans").isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequences of at most 2048 tokens."""
    return packing.pack(docs, packing.default_vocabulary())


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
