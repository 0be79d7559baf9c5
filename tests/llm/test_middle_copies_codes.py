"""Fill-in-middle, the digest index and vector codes against plain versions and edge cases."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.llm import exact_dedup, fill_in_middle, vector_codes

DOCS = "doc_id long, text string, lang string, h1 long, digest binary, restored string"
LONG = "".join(f"w{k % 977} 漢é😀\n" for k in range(20_000))
ODD = [(1, None), (2, ""), (3, " \n\t\n "), (4, LONG), (5, LONG.upper()), (5, LONG), (5, LONG), (None, "One two"), (None, "one TWO"), (6, "x<P>y"), (7, "<S"), (8, "P><M"), (9, "Straße ÉÀ"), (10, "straße ÉÀ"), (11, "straße éà")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "en", 7, b"clash", "clash") for r in ODD], DOCS)


def test_ranks_equal_counts():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fill_in_middle.WaveletMatrix(symbols)
        for s in range(8):
            assert matrix.rank(s, np.arange(n + 1)).tolist() == [0, *np.cumsum(symbols == s).tolist()]


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_cuts_equal_plain_ones(unit):
    texts = ["", "a", "añ b\nc 漢字 x\n\n y", " \n", "\n", "one  two\tthree\r\nfour", "😀" * 70, "x y " * 50, ""]
    data = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    found = fill_in_middle.Boundaries(np.frombuffer(b"".join(data), np.uint8), bounds, unit)
    for k, t in enumerate(texts):
        starts = {"character": list(range(len(t))), "word": [m.start() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)], "line": [m.start() for m in re.finditer(r"[^\n]*\n|[^\n]+$", t)]}[unit]
        assert found.sizes()[k] == len(starts)
        for u in range(len(starts) + 1):
            want = 0 if u == 0 else starts[u] if u < len(starts) else len(t)
            cut = found.cut(np.array([k]), np.array([u]))[0] - bounds[k]
            assert data[k][:cut].decode() == t[:want]


def middle(doc_id, text):
    t = text or ""
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(t) + 1) for x in h[:2])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(t), "plain", None, None, t
    p, m, s = "<P>" + t[:a], "<M>" + t[a:b], "<S>" + t[b:]
    return (len(t), "spm", a, b - a, s + p + m) if h[3] % 100 < 20 else (len(t), "psm", a, b - a, p + s + m)


def test_fill_in_middle_equals_plain_version(spark, odd):
    more = spark.createDataFrame([(k, f"text {k} é\n" * (k % 40), "", 0, b"", "") for k in range(100, 400)], DOCS)
    rows = fill_in_middle.restore(fill_in_middle.transform(odd.union(more))).collect()
    texts = ODD + [(k, f"text {k} é\n" * (k % 40)) for k in range(100, 400)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r["doc_id"], r["n"], r["form"], r["prefix_units"], r["middle_units"], r["output"]) for r in rows), key=key) == sorted(((i, *middle(i, t)) for i, t in texts), key=key)
    assert sorted((str(r["doc_id"]), r["restored"]) for r in rows) == sorted((str(i), t or "") for i, t in texts)
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(odd.limit(0)).count() == 0


def test_fill_in_middle_by_words(odd):
    rows = fill_in_middle.restore(fill_in_middle.transform(odd, unit="word", plain_from=100)).collect()
    assert sorted((str(r["doc_id"]), r["restored"]) for r in rows) == sorted((str(i), t or "") for i, t in ODD)
    assert {r["n"] for r in rows if r["doc_id"] in (4, 5)} == {len(LONG.split())}


def test_filter_inserts_overflows_and_deletes():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 3000).astype(np.uint64))
    small = exact_dedup.CuckooFilter(16)
    assert not small.insert(keys[:200])  # 64 slots
    full = exact_dedup.CuckooFilter.over(keys, 16)
    assert full.contains(keys).all() and full.buckets * exact_dedup.SLOTS >= len(keys)
    full.delete(keys[::2])
    assert full.contains(keys[1::2]).all() and full.contains(keys[::2]).mean() < 0.01
    with pytest.raises(ValueError):
        exact_dedup.CuckooFilter(16).delete(keys[:1])
    # Keys that differ in bits that neither fingerprint nor bucket show share their slots' value; deleting one leaves the other.
    twins = exact_dedup.CuckooFilter(16)
    assert twins.insert(np.repeat(keys[:1], 2))
    twins.delete(keys[:1])
    assert twins.contains(keys[:1]).all()


def test_hits_are_verified_and_filters_grow():
    shard = exact_dedup.Shard.empty()
    known = {}
    rng = np.random.default_rng(4)
    for _ in range(30):
        pick = rng.integers(0, 1500, 200)
        digests = np.array([hashlib.sha256(str(p).encode()).digest() for p in pick], "S32")
        ids = rng.integers(0, 10**6, 200)
        shard.insert(digests, ids, np.ones(200, np.int64))
        for d, i in zip(digests, ids, strict=True):
            top, n = known.get(bytes(d), (-1, 0))
            known[bytes(d)] = (max(top, i), n + 1)
        gone = np.array([hashlib.sha256(str(p).encode()).digest() for p in rng.integers(0, 1500, 20)], "S32")
        shard.delete(gone)
        for d in gone:
            known.pop(bytes(d), None)
    assert {bytes(d): (i, n) for d, i, n in zip(shard.digests, shard.ids.tolist(), shard.counts.tolist(), strict=True)} == known
    assert shard.filter.buckets > exact_dedup.FIRST_BUCKETS
    # A filter that says yes to everything must not make other digests equal.
    shard.filter.slots[:] = shard.filter.places(shard.keys(np.array([b"\x01" * 32], "S32")))[0][0]
    assert shard.find(np.array([b"\x01" * 32], "S32")).tolist() == [-1]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_exact_dedup_equals_grouping(spark, odd):
    more = spark.createDataFrame([(k, "Hot text" if k % 3 == 0 else f"text {k % 700}", "", 0, b"", "") for k in range(100, 3100)], DOCS)
    rows = exact_dedup.deduplicated(odd.union(more)).collect()
    texts = ODD + [(k, "Hot text" if k % 3 == 0 else f"text {k % 700}") for k in range(100, 3100)]
    groups = {}
    for i, t in texts:
        groups.setdefault(lowered(t), []).append(i)
    want = []
    for i, t in texts:
        g = groups[lowered(t)]
        top = max((x for x in g if x is not None), default=None)
        want.append((str(i), str(top), len(g), i == top, hashlib.sha256(lowered(t).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"], r["digest"].hex()) for r in rows) == sorted(want)
    assert exact_dedup.deduplicated(odd.limit(0)).count() == 0


def test_index_lives_through_insertions_and_deletions(spark):
    batch = lambda low, high: exact_dedup.with_digest(spark.createDataFrame([(k, f"t{k % 250}") for k in range(low, high)], "doc_id long, text string"))
    index = exact_dedup.DigestIndex(spark, shard_keys=64)
    index.insert(batch(0, 300)).insert(batch(300, 400))
    assert index.shards > 1 and index.live() == 250
    index.delete(batch(0, 100)).delete(batch(0, 10))
    assert index.live() == 150
    index.insert(batch(1000, 1020))  # the texts t0 to t19, new again
    got = {r["digest"].hex(): (r["keep_id"], r["group_size"]) for r in index.entries().collect()}
    want = {f"t{k}": (max(x for x in range(400) if x % 250 == k), len([x for x in range(400) if x % 250 == k])) for k in range(100, 250)} | {f"t{k % 250}": (k, 1) for k in range(1000, 1020)}
    assert got == {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}


@pytest.mark.parametrize("spread", [2, 40, 10**7])
def test_balls_find_the_nearest_entry(spread):
    rng = np.random.default_rng(spread)
    x, book = rng.integers(-spread, spread, (3000, 4)), rng.integers(-spread, spread, (60, 4))
    book[7] = book[3]  # equal entries: the lower index wins
    want = ((x[:, None, :] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (vector_codes.nearest_of_all(x, book) == want).all()
    for held in (want, rng.integers(0, 60, 3000)):
        assert (vector_codes.Balls(book).assign(x, held)[0] == want).all()


def test_stable_cores_skip_work():
    rng = np.random.default_rng(5)
    book = rng.integers(-1000, 1000, (100, 8))
    held = rng.integers(0, 100, 5000)
    x = book[held] + rng.integers(-20, 20, (5000, 8))
    found, looked = vector_codes.Balls(book).assign(x, held)
    assert (found == held).all() and looked < 2 * len(x)


def plain_codes(rows, dim, entries):
    """Rows of (vec_id, vector, label), sorted; all distances."""
    w = dim // 4
    x = [[int(np.floor(np.float64(v) * 1024)) for v in r[1]] for r in rows]
    parts = [[v[p * w : (p + 1) * w] for v in x] for p in range(4)]
    books = [part[:entries] for part in parts]
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(v, book[e], strict=True)), e))
    for _ in range(4):
        for p in range(4):
            codes = [nearest(v, books[p]) for v in parts[p]]
            books[p] = [[sum(c) // len(own) for c in zip(*own, strict=True)] if (own := [v for v, k in zip(parts[p], codes, strict=True) if k == e]) else books[p][e] for e in range(len(books[p]))]
    codes = [[nearest(parts[p][k], books[p]) for p in range(4)] for k in range(len(x))]
    errors = [sum((a - b) ** 2 for p in range(4) for a, b in zip(parts[p][k], books[p][codes[k][p]], strict=True)) for k in range(len(x))]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return {r[0]: ("".join(f"{c:02x}" for c in code), e) for r, code, e in zip(rows, codes, errors, strict=True)}, digest


def test_vector_codes_equal_plain_version(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "ENTRIES", 12)
    rng = np.random.default_rng(6)
    base = rng.standard_normal((10, 8))
    rows = [(k, (base[k % 10] + 0.1 * rng.standard_normal(8)).astype("f4").tolist(), k % 3 if k % 5 else None) for k in range(3, 200)]
    rows += [(200 + k, rows[0][1], 1) for k in range(50)]
    rows.append((300, [3e38] * 8, 2))
    rows.append((301, [-0.0] * 8, 2))
    bad = [(0, None, 1), (1, [None] * 8, 1), (2, [float("nan")] * 8, 1), (-1, [1.0] * 7 + [float("inf")], 1), (-2, [], 1), (-3, [1.0] * 7, 1), (400, [1.0] * 12, 1)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows + bad], "vec_id long, embedding array<float>, label int, code string, kind string")
    most = vector_codes.limit(8)
    want, digest = plain_codes([(i, [min(float(v), most / 1024) for v in vec], lab) for i, vec, lab in rows], 8, 12)
    got, books = vector_codes.compress(df)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got.collect()} == want and vector_codes.codebooks_digest(books) == digest
    assert vector_codes.compress(df.limit(0))[0].count() == 0
    few, books = vector_codes.compress(df.where("vec_id between 3 and 5"))
    assert few.count() == 3 and len(books[0]) == 3 and few.agg(F.sum("error")).first()[0] == 0
