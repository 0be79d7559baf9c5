"""Fill-in-middle transformation: texts are cut in three and put together in another order.

A wavelet matrix over character classes indexes a slice of texts: every UTF-8 byte has a class
that tells whether it continues a character, is blank, stands inside a word, or begins a word
or a line.  A text unit (character, word or line) begins on bytes of certain classes, so ranks
of these classes add up to the number of unit boundaries before any position, and bisection on
those ranks finds the byte where the k-th unit begins.  All texts of a slice (about a megabyte,
or one longer text) are asked together; no text is decoded and none crosses an exchange.

A document's cuts and form depend on its id alone: they come from the SHA-256 of ``seed``, a
colon and the decimal doc_id.  ``restore`` rebuilds the text from output and form, in built-in
functions.

Defined cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain.
A null doc_id counts as an empty string; repeated ids have equal numbers, each with its own
text.  Words are runs without ASCII white space; a cut before the first unit is the text's
start, one behind the last its end.  Other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.text_arrays import WHITE_SPACE, slices, text_column

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_FROM, SPM_BELOW = 90, 20

#: Classes of bytes, in three bits.
CONTINUES, BLANK, INSIDE, WORD, LINE_BLANK, LINE_WORD = range(6)
LEVELS = 3
#: The classes on which a unit begins.
UNITS = {"character": (BLANK, INSIDE, WORD, LINE_BLANK, LINE_WORD), "word": (WORD, LINE_WORD), "line": (LINE_BLANK, LINE_WORD)}


def byte_classes(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Class of each byte; ``bounds`` are the offsets of the texts in ``raw``."""
    blank = WHITE_SPACE[raw]
    first = np.zeros(len(raw), bool)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    line, word = first.copy(), first.copy()
    line[1:] |= raw[:-1] == 10
    word[1:] |= blank[:-1]
    out = np.where(blank, np.where(line, LINE_BLANK, BLANK), np.where(line, LINE_WORD, np.where(word, WORD, INSIDE))).astype(np.uint8)
    out[((raw & 0xC0) == 0x80) & ~first] = CONTINUES
    return out


class WaveletMatrix:
    """Ranks of symbols of ``levels`` bits; a quarter byte a symbol and level."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.size, self.levels = len(symbols), []
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.zeros((self.size // 64 + 1) * 8, np.uint8)
            packed[: (self.size + 7) // 8] = np.packbits(bit, bitorder="little")
            words = packed.view("<u8")
            ones = np.bitwise_count(words).astype(np.int64)
            before = np.cumsum(ones) - ones
            zeros = self.size - int(ones.sum())
            self.levels.append((level, words, before, zeros))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(words[word] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` symbols are ``symbol``, for every value of ``at``."""
        low, high = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for level, words, before, zeros in self.levels:
            low, high = (self._ones(words, before, x) for x in (low, high)) if (symbol >> level) & 1 else (x - self._ones(words, before, x) for x in (low, high))
            if (symbol >> level) & 1:
                low, high = low + zeros, high + zeros
        return high - low


class Boundaries:
    """Counts and places of the unit boundaries in texts that stand one behind the other."""

    def __init__(self, raw: np.ndarray, bounds: np.ndarray, unit: str):
        self.bounds, self.classes = bounds, UNITS[unit]
        self.others = [c for c in range(LINE_WORD + 1) if c not in self.classes]
        self.matrix = WaveletMatrix(byte_classes(raw, bounds))
        self.before = self.count(bounds)

    def count(self, at: np.ndarray) -> np.ndarray:
        """Boundaries on the first ``at`` bytes: the ranks of the unit's classes, or what those of the others leave."""
        if len(self.others) < len(self.classes):
            return at - sum(self.matrix.rank(c, at) for c in self.others)
        return sum(self.matrix.rank(c, at) for c in self.classes)

    def sizes(self) -> np.ndarray:
        """Units of every text."""
        return np.diff(self.before)

    def cut(self, text: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Byte behind the first ``units`` units of each text: where the next one begins, or the text's end."""
        low, high = self.bounds[text].copy(), self.bounds[text + 1].copy()
        goal = self.before[text] + units
        low_end, end = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            over = self.count(middle) > goal
            high = np.where(open_ & over, middle, high)
            low = np.where(open_ & ~over, middle + 1, low)
        found = np.where(self.count(low) > goal, low - 1, end)
        return np.where(units == 0, low_end, found)


def with_form(docs: DataFrame, seed: str = "1", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, text, the two numbers of the cuts and the form (plain, psm or spm) of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    number = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")
    held = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    plain = (F.length(text) == 0) | held | (number(2) % 100 >= plain_from)
    form = F.when(plain, "plain").when(number(3) % 100 < spm_below, "spm").otherwise("psm")
    return docs.select("doc_id", text.alias("text"), digest.alias("digest")).select("doc_id", "text", number(0).alias("h1"), number(1).alias("h2"), form.alias("form"))


def _assembled(raw: np.ndarray, bounds: np.ndarray, forms: list[str], one: np.ndarray, two: np.ndarray) -> pa.Array:
    """The output texts, as one string column."""
    whole, parts, size = raw.tobytes(), [], [0]
    marks = {k: v.encode() for k, v in (("p", PREFIX), ("s", SUFFIX), ("m", MIDDLE))}
    for form, start, a, b, end in zip(forms, bounds[:-1].tolist(), one.tolist(), two.tolist(), bounds[1:].tolist(), strict=True):
        if form == "plain":
            out = [whole[start:end]]
        else:
            p, m, s = marks["p"] + whole[start:a], marks["m"] + whole[a:b], marks["s"] + whole[b:end]
            out = [p, s, m] if form == "psm" else [s, p, m]
        parts += out
        size.append(size[-1] + sum(map(len, out)))
    return pa.StringArray.from_buffers(len(forms), pa.py_buffer(np.array(size, np.int32)), pa.py_buffer(b"".join(parts)))


def transform(docs: DataFrame, unit: str = "character", seed: str = "1", plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units (null if plain) and output of each row of ``docs``."""
    schema = docs.select("doc_id").schema.add("n", "long").add("form", "string").add("prefix_units", "long").add("middle_units", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, bounds = text_column(batch.column("text"))
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for first, last, part, at in slices(raw, bounds):
                form = batch.column("form").slice(first, last - first)
                forms = form.to_pylist()
                units = Boundaries(part, at, unit)
                n = units.sizes()
                cuts = np.sort(np.stack([h1[first:last] % (n + 1), h2[first:last] % (n + 1)]), axis=0)
                cut = np.flatnonzero(np.array(forms) != "plain")
                one, two = at[:-1].copy(), at[1:].copy()
                one[cut], two[cut] = (units.cut(cut, c[cut]) for c in cuts)
                plain = np.ones(last - first, bool)
                plain[cut] = False
                sizes = [pa.array(x, pa.int64(), mask=plain) for x in (cuts[0], cuts[1] - cuts[0])]
                columns = [batch.column("doc_id").slice(first, last - first), pa.array(n, pa.int64()), form, *sizes, _assembled(part, at, forms, one, two)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return with_form(docs, seed, plain_from, spm_below).mapInArrow(run, schema)


def restore(rows: DataFrame) -> DataFrame:
    """Adds ``restored`` to rows with output and form: the text that ``transform`` had."""
    output, body = F.col("output"), F.substring("output", len(PREFIX) + 1, 2**31 - 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(F.substring_index(body, SUFFIX, 1), middle, F.substring_index(F.substring_index(body, SUFFIX, -1), MIDDLE, 1))
    spm = F.concat(F.substring_index(F.substring_index(body, PREFIX, -1), MIDDLE, 1), middle, F.substring_index(body, PREFIX, 1))
    return rows.withColumn("restored", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(output))


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    rows = restore(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    chars = [F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars")]
    return rows.select("doc_id", "n", "form", *chars, F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = f"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
g AS (SELECT doc_id, t, n, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS b,
        ('0x' || substr(d, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS e FROM h),
f AS (SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
        CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR c >= {PLAIN_FROM} THEN 'plain' WHEN e < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM g)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN (q - p)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || substr(t, 1, p) || '{SUFFIX}' || substr(t, q + 1) || '{MIDDLE}' || substr(t, p + 1, q - p)
         ELSE '{SUFFIX}' || substr(t, q + 1) || '{PREFIX}' || substr(t, 1, p) || '{MIDDLE}' || substr(t, p + 1, q - p) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM f
"""
