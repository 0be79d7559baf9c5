"""Secret scan with corpus-wide ownership frequency, in built-in functions only.

Base patterns (assignments, access keys, long hex runs) are found in every whole text, leftmost
and without overlaps for each kind.  Wider candidate patterns (key blocks, vendor-prefixed
tokens, signed web tokens, long mixed-case tokens) are judged by who holds them: a candidate's
hash is counted over distinct repositories and owners in the whole corpus.  What few owners
hold in few repositories is taken for a live credential and its span is added; what many owners
or many repositories hold is a widely copied example and is left out.  Base spans always stay.

Positions are code points (end exclusive): a text is split at the matches, and the lengths of
the pieces and matches between them give each match's place.

Hot hashes: distinct (hash, owner, repository) rows are pre-aggregated before each shuffle,
and the join back is split by adaptive execution.

Defined cases: null texts are empty; empty texts have no spans and the digest of an empty
string.  Null owners or repositories count as one of their own.  Repeated rows are reported
each and count once in the frequencies.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.scratch import Scratch

_VALUE = r"([A-Za-z0-9+/_.=-]+)"
#: kind -> (pattern, group whose length counts, least length).  Fixed values of the contract.
BASE = {
    "assign": (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?" + _VALUE, 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),  # greedy runs, so the same as runs of any length of which shorter ones are dropped
}
#: A token begins where no other word or hyphenated word goes on.  Behind a prefix that names of packages and settings have too,
#: there must be twelve letters and digits in a row, digits among them.
_APART = r"(?<![A-Za-z0-9_-])"
_DRAWN = r"(?=[A-Za-z0-9_-]{0,200}?(?=[A-Za-z]{0,11}+[0-9])[A-Za-z0-9]{12})"
#: Wider candidates, kept only where ownership says so.
CANDIDATES = {
    "block": (r"-----BEGIN [A-Z ]*?PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]*?PRIVATE KEY-----", 0, 40),
    "vendor": (_APART + r"(?:gh[oprsu]_|glpat-|xox[abprs]-|sk_live_|AIza|ya29\.|(?:sk-|npm_|hf_)" + _DRAWN + r")[A-Za-z0-9_-]{16,}", 0, 20),
    "signed": (_APART + r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 32),
    "mixed": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])", 0, 32),
}
ORDER = {kind: k for k, kind in enumerate([*BASE, *CANDIDATES])}
#: A candidate that more owners hold, or that stands in more repositories, is an example.
MOST_OWNERS, MOST_REPOSITORIES = 2, 8

SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def in_chunks(rows: Column) -> Column:
    """An array as an array of about as many chunks as each has elements."""
    each = F.ceil(F.sqrt(F.size(rows))).cast("int")
    return let(each, lambda c: F.transform(F.sequence(F.lit(0), ((F.size(rows) - 1) / c).cast("int")), lambda k: F.slice(rows, k * c + 1, c)))


def before_each(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each value of a short array, ``combine`` of ``zero`` and all values before it."""
    start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]


def spans_of(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (start, rank, end, kind) and h, the match's hash, of one pattern's matches, in order.

    Starts are running sums, made in chunks: n matches take about n ** 1.5 short steps.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = matches if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    rows = let(matches, lambda found: F.zip_with(F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, p: F.struct(F.length(p).cast("long").alias("p"), F.length(m).cast("long").alias("m"), F.xxhash64(m).alias("h"))), counted, lambda r, v: r.withField("v", F.length(v))))
    zero, total = F.lit(0).cast("long"), lambda at, n: at + n

    def placed(chunk: Column, start: Column) -> Column:
        starts = before_each(F.transform(chunk, lambda r: r["p"] + r["m"]), start, total)
        return F.zip_with(chunk, starts, lambda r, at: F.struct((at + r["p"]).alias("start"), F.lit(ORDER[kind]).alias("rank"), (at + r["p"] + r["m"]).alias("end"), F.lit(kind).alias("kind"), r["h"].alias("h"), r["v"].alias("v")))

    def spans(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda at, r: at + r["p"] + r["m"]))
        every = F.flatten(F.zip_with(chunks, before_each(sizes, zero, total), placed))
        return F.transform(F.filter(every, lambda s: s["v"] >= least), lambda s: s.dropFields("v"))

    return F.when(text.rlike(pattern), let(let(rows, in_chunks), spans)).otherwise(F.array().cast(f"array<{SPAN[:-1]},h:bigint>>"))


def all_spans(text: Column, patterns: dict[str, tuple[str, int, int]]) -> Column:
    return F.array_sort(F.concat(*(spans_of(text, kind, *how) for kind, how in patterns.items())))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, repository: str, owner: str, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Every row's doc_id, th (text hash), base and added spans, and how many candidates were live or examples.

    ``repository`` and ``owner`` name columns of ``docs``.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"), text.alias("text"))
    found = rows.select(
        "doc_id", "th", "repository", "owner", F.transform(all_spans(F.col("text"), BASE), lambda s: s.dropFields("h")).alias("base"),
        F.transform(all_spans(F.col("text"), CANDIDATES), lambda s: F.struct(s.dropFields("h").alias("span"), s["h"].alias("h"))).alias("wider"),
    )
    found = scratch.table(found, "found")
    held = found.select("doc_id", "th", "repository", "owner", F.explode("wider").alias("w")).select("doc_id", "th", "repository", "owner", "w.span", "w.h").distinct()
    by_owner = held.select("h", "owner", "repository").distinct().groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    frequency = by_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    judged = held.join(frequency, "h").select("doc_id", "th", "span", ((F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories)).alias("live"))
    added = judged.groupBy("doc_id", "th").agg(F.collect_list(F.when(F.col("live"), F.col("span"))).alias("added"), F.count_if(~F.col("live")).alias("n_examples"))
    out = found.alias("f").join(added.alias("a"), F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.th") == F.col("a.th")), "left")
    none = F.array().cast(f"array<{SPAN}>")
    extra = F.coalesce(F.col("a.added"), none)
    return out.select("f.doc_id", "f.th", "base", F.array_sort(extra).alias("added"), F.array_sort(F.concat("base", extra)).alias("spans"), F.coalesce("n_examples", F.lit(0)).alias("n_examples"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span (sorted by start) replaced by ``mark``; overlapping spans become one.

    A chunk of spans is cut out of the stretch of text that it reaches over, not out of the whole.
    """
    zero = F.lit(0).cast("long")
    cut = lambda whole, a, b: F.substring(whole, (a + 1).cast("int"), F.greatest(b - a, zero).cast("int"))
    last = lambda part: F.array_max(F.transform(part, lambda s: s["end"]))

    def replaced(chunk: Column, at: Column) -> Column:
        def pieces(stretch: Column) -> Column:
            ends = before_each(F.transform(chunk, lambda s: s["end"]), at, F.greatest)
            fresh = lambda s, end: F.concat(cut(stretch, end - at, s["start"] - at), F.lit(mark))
            return F.array_join(F.zip_with(chunk, ends, lambda s, end: F.when(s["start"] >= end, fresh(s, end)).otherwise("")), "")

        return let(cut(text, at, last(chunk)), pieces)

    def body(chunks: Column) -> Column:
        return F.array_join(F.zip_with(chunks, before_each(F.transform(chunks, last), zero, F.greatest), replaced), "")

    replaced_all = F.concat(let(in_chunks(spans), body), cut(text, last(spans), F.length(text).cast("long")))
    return F.when(F.size(spans) > 0, replaced_all).otherwise(text)


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    """Each document stands for one repository and its source for the owner."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = scan(docs.withColumn("repository", F.col("doc_id")), "repository", "source")
    return out.select("doc_id", *(of(kind) for kind in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
