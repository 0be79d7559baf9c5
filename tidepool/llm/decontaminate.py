"""Benchmark decontamination by winnowing, in built-in functions only.

A document's words are hashed in k-grams (``K`` words); in every window of ``W`` consecutive
k-grams the smallest hash is kept (the leftmost among equals).  Any shared run of
``K + W - 1`` words has a kept hash in common, so with K + W - 1 at most the window length
every item window that stands in a document is found.  The fingerprints are joined, and each
hit is extended along its diagonal: the words of item and document are compared where the two
are aligned, and runs of at least the window's words are hits.  Runs are kept as stretches and
their overlaps are counted once, so an alignment costs no more than its item has words, in a
document that repeats one word as in any other.  Items shorter than a window
are one window of all their words; those shorter than ``K + W - 1`` are found through the
hash of the whole item instead, at the item lengths that occur (12 at most).

Hot fingerprints (a passage that a third of all documents hold) make one row for each document
and item alignment, nothing is paired within a group; partial aggregation runs before each
shuffle.  Benchmark fingerprints are broadcast only if there are few of them
(``BROADCAST_ROWS``), else the join is sorted and split by adaptive execution.

Defined cases: a null or wordless text has 0 words and isn't contaminated; items without words
occur nowhere.  Equal item texts with different ids are different items; rows with equal item
ids count as one item, whose windows are those of all its texts.  Repeated documents are
judged each.  Empty tables: no items give no hits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.scratch import Scratch
from tidepool.llm.url_filter import LOWER, UPPER

WINDOW = 13
K, W = 7, 7
BROADCAST_ROWS = 500_000
#: More than a text can have words (a string holds under 2 ** 31 bytes).
MOST_WORDS = 2**30

#: What stands between words, after lower-casing A to Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A to Z in lower case and nothing else changed (ASCII texts take the faster way)."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text; an empty array for a null."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def with_runs(df: DataFrame, values: str, n: int, name: str, combine: Callable[[Column, Column], Column], least: int = 0) -> DataFrame:
    """Adds ``name``: ``combine`` over every n neighbours of the array ``values``, in doubling steps.

    Each step is a column of its own, so that it is evaluated once.  ``combine`` sees nulls behind
    the end; runs that reach over it are cut off, but for the first ``least`` of them.
    """
    width, df = 1, df.withColumn(name, F.col(values))
    while width < n:
        step = min(width, n - width)
        df = df.withColumn(name, F.zip_with(name, F.slice(name, step + 1, MOST_WORDS), combine))
        width += step
    return df.withColumn(name, F.slice(name, F.lit(1), F.greatest(F.size(values) - (n - 1), F.lit(least))))


def with_grams(df: DataFrame, n: int, name: str) -> DataFrame:
    """Adds ``name``: hashes of all runs of n of the word hashes in ``hashes``; empty for fewer words."""
    return with_runs(df, "hashes", n, name, lambda a, b: F.xxhash64(a, b))


def with_fingerprints(df: DataFrame, window: int, name: str) -> DataFrame:
    """Adds ``name``: winnowed (position, hash) structs of ``grams``; each window's smallest hash, all picks once.

    A gram stands as its hash's upper bits above its position, so that a window's smallest number
    tells where its pick is.  Texts of fewer grams than a window keep their smallest one.
    """
    upper, lower = F.lit(-MOST_WORDS).cast("long"), F.lit(MOST_WORDS - 1).cast("long")
    df = df.withColumn("placed", F.transform("grams", lambda g, i: g.bitwiseAND(upper).bitwiseOR(i.cast("long"))))
    df = with_runs(df, "placed", window, "picks", lambda a, b: F.least(a, b), least=1)
    at = lambda p: p.bitwiseAND(lower).cast("int")
    return df.withColumn(name, F.transform(F.array_distinct("picks"), lambda p: F.struct(at(p).alias("at"), F.get("grams", at(p)).alias("h")))).drop("placed", "picks")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("th"))


def _short_marks(n: int) -> Column:
    """(kind, at, h) of every run of n words, to be held against whole items of n words."""
    return F.transform(f"runs{n}", lambda h, i: F.struct(F.lit(n).alias("kind"), i.alias("at"), h.alias("h")))


def find_hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, th, item_id, start, end): stretches of document words that are all inside occurrences of item windows.

    ``th`` is the hash of the document's text: with the id it names a document.  Stretches may overlap.
    """
    if k + w - 1 > window:
        raise ValueError("windows shorter than k + w - 1 words would be missed")
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where("size(words) > 0").distinct()
    items = items.withColumns({"ih": F.xxhash64("words"), "hashes": _hashes(F.col("words"))})
    items = scratch.table(items, "items")
    long = k + w - 1
    lengths = sorted(r[0] for r in items.where(F.size("words") < long).select(F.size("words")).distinct().collect())  # 12 at most

    marks = with_fingerprints(with_grams(items.where(F.size("words") >= long), k, "grams"), w, "prints")
    marks = marks.select("item_id", "ih", F.size("words").alias("size"), F.lit(0).alias("kind"), F.explode("prints").alias("f")).select("item_id", "ih", "size", "kind", F.col("f.at").alias("item_at"), F.col("f.h").alias("h"))
    whole = None
    for n in lengths:
        grams = with_grams(items.where(F.size("words") == n), n, "whole").select("item_id", "ih", F.lit(n).alias("size"), F.lit(n).alias("kind"), F.lit(0).alias("item_at"), F.get("whole", F.lit(0)).alias("h"))
        whole = grams if whole is None else whole.union(grams)
    marks = scratch.table(marks if whole is None else marks.union(whole), "marks")

    # Each array is a column of its own: inside a lambda, an expression would be evaluated for every element.
    hashed = _documents(docs).select("doc_id", "th", _hashes(words_of(F.col("text"))).alias("hashes"))
    hashed = with_fingerprints(with_grams(hashed, k, "grams"), w, "prints").drop("grams")
    found = F.transform("prints", lambda x: F.struct(F.lit(0).alias("kind"), x["at"].alias("at"), x["h"].alias("h")))
    for n in lengths:
        hashed = with_grams(hashed, n, f"runs{n}")
        found = F.concat(found, _short_marks(n))
    prints = hashed.select("doc_id", "th", F.explode(found).alias("f")).select("doc_id", "th", "f.kind", F.col("f.at").alias("at"), F.col("f.h").alias("h"))
    side = F.broadcast(marks) if marks.count() <= BROADCAST_ROWS else marks
    aligned = prints.join(side, ["h", "kind"]).select("doc_id", "th", "item_id", "ih", "size", (F.col("at") - F.col("item_at")).alias("shift"))
    aligned = scratch.table(aligned.distinct(), "aligned")

    shifts = aligned.groupBy("doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    keys = ["doc_id", "th"]
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])
    near = _documents(docs)
    held = near.join(shifts, same(near, shifts), "left_semi").select("doc_id", "th", words_of(F.col("text")).alias("doc_words")).dropDuplicates(keys)
    # An alignment takes along only the document's words under its item, from ``first`` on, not the whole document.
    first, ahead = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    under = F.slice("doc_words", first + 1, F.greatest(F.col("size") - ahead, F.lit(0)))
    rows = aligned.join(held, same(aligned, held)).select(aligned["doc_id"], aligned["th"], "item_id", "ih", first.alias("first"), ahead.alias("ahead"), under.alias("under"))
    need = F.least(F.size("words"), F.lit(window))
    equal = F.zip_with("under", F.slice("words", F.col("ahead") + 1, F.greatest(F.size("under"), F.lit(0))), lambda d, v: d.eqNullSafe(v))
    rows = rows.join(items.select("item_id", "ih", "words"), ["item_id", "ih"]).select("doc_id", "th", "item_id", "first", need.alias("need"), equal.alias("equal"))
    # Where the two differ, with a mark before and behind: what lies between two marks are equal words.
    marks_at = F.concat(F.array(F.lit(-1)), F.filter(F.transform("equal", lambda e, j: F.when(~e, j)), lambda j: j.isNotNull()), F.array(F.size("equal")))
    rows = rows.select("doc_id", "th", "item_id", "first", "need", marks_at.alias("m"))
    runs = F.zip_with(F.slice("m", 1, F.size("m") - 1), F.slice("m", 2, MOST_WORDS), lambda a, b: F.struct((F.col("first") + a + 1).alias("start"), (F.col("first") + b).alias("end")))
    runs = F.filter(runs, lambda r: r["end"] - r["start"] >= F.col("need"))
    return rows.select("doc_id", "th", "item_id", F.explode(runs).alias("r")).groupBy("doc_id", "th", "item_id", "r.start").agg(F.max("r.end").alias("end"))


def covered(hits: DataFrame) -> DataFrame:
    """(doc_id, th, n_hit): how many words of each document lie in its stretches (start, end), overlaps once."""
    once = hits.groupBy("doc_id", "th", "start").agg(F.max("end").alias("end"))
    before = F.coalesce(F.expr("max(end) over (partition by doc_id, th order by start rows between unbounded preceding and 1 preceding)"), F.lit(0))
    fresh = once.withColumn("before", before).select("doc_id", "th", F.greatest(F.col("end") - F.greatest("start", "before"), F.lit(0)).alias("n"))
    return fresh.groupBy("doc_id", "th").agg(F.sum("n").alias("n_hit"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, w: int = W) -> DataFrame:
    """One row per document: doc_id, th, n_words, n_hit, n_items, items (sorted ids as strings), contaminated.

    Contaminated: n_hit > 0 and 20 * n_hit >= n_words.  ``items`` is no longer than the benchmark.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    hits = scratch.table(find_hits(docs, benchmark, scratch, window, k, w), "hits")
    words = covered(hits)
    items = hits.select("doc_id", "th", "item_id").distinct().groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("items"))
    per_doc = words.alias("a").join(items.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))).select("a.doc_id", "a.th", "n_hit", "items")
    per_doc = scratch.table(per_doc, "per_document")
    every = _documents(docs).select("doc_id", "th", F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(per_doc, every["doc_id"].eqNullSafe(per_doc["doc_id"]) & (every["th"] == per_doc["th"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    return out.select(
        every["doc_id"], every["th"], "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return contamination(docs, benchmark).select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM h)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
