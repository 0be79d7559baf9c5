"""Walks by regions against plain walks, in regions of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidepool.operators import blocks, walks
from tidepool.plans import lineage
from tidepool.sources import market


def test_walks_across_regions_equal_plain_ones(spark):
    rng = random.Random(3)
    parents = {(c, b): rng.choice([b - 1, b - 1, b - 2, rng.randrange(1, b + 3)]) for c in range(12) for b in range(2, 60) if rng.random() < 0.97}
    parents = {(c, b): p for (c, b), p in parents.items() if p != b}
    heads = {c: rng.randrange(40, 62) for c in range(12)}
    links = spark.createDataFrame([(c, b, p) for (c, b), p in parents.items()], "chain long, block long, to long")
    starts = spark.createDataFrame(list(heads.items()), "chain long, block long")

    def path(c, b):
        out = [b]
        while (c, b) in parents:
            b = parents[c, b]
            if b in out:
                return None
            out.append(b)
        return out

    want = {c: path(c, b) for c, b in heads.items()}
    assert any(p is None for p in want.values()) and any(p and len(p) > 15 for p in want.values())
    inner, ends = walks.walked(links, starts, 7)
    assert sorted(map(tuple, inner.collect())) == sorted((c, b, d) for c, p in want.items() if p for d, b in enumerate(p[:-1]))
    assert sorted(map(tuple, ends.collect())) == sorted((c, p[-1], len(p) - 1) for c, p in want.items() if p)
    home = links.where("block <> 1").join(starts.where("chain < 0"), ["chain", "block"], "left_anti")
    came = walks.arriving(home, spark.createDataFrame([(c, 1) for c in range(12)], "chain long, block long"), 7)
    assert {tuple(r) for r in came.collect()} == {(c, b) for c, b in parents if (p := path(c, b)) and p[-1] == 1}


@pytest.mark.parametrize("n", [300, 9000])
def test_tables_written_do_not_grow_with_a_chain(spark, monkeypatch, n):
    written, plain = [], lineage.folder
    monkeypatch.setattr(lineage, "folder", lambda *a: written.append(plain(*a)) or written[-1])
    heads = spark.range(1, n + 1).select(F.lit(1).cast("long").alias("chain"), F.col("id").alias("block"), (F.col("id") - 1).alias("parent"))
    assert blocks.canonical(heads).agg(F.count(F.lit(1)), F.max("distance")).first()[:] == (n + 1, n)
    assert len(written) <= 15  # two for each doubling of the length before: 29 for 9000 blocks


def test_headers_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(market, "WIDTH", 64)
    got = sorted(map(tuple, market.numbered_heads(spark, "/root/testdata/sf0.001").collect()))
    chains, want = {}, []
    for r in sorted(market.table(spark, "/root/testdata/sf0.001", "events").select("event_id", "user_id").collect()):
        own = chains.setdefault(r["user_id"] % 20, [])
        back = 2 if r["event_id"] % 5 == 0 and len(own) > 1 else 1
        want.append((r["user_id"] % 20, r["event_id"], own[-back] if own else None, len(own) + 1))
        own.append(r["event_id"])
    assert got == sorted(want, key=lambda r: r[:2])
