"""Caches in versions, frames, block logs, slices and chain policies."""

import json

import pytest
from pyspark.sql import functions as F

from test_market import SF, duck, plain  # noqa: F401  (duck is a fixture)
from tidepool.operators import cache, dims, frames, slices
from tidepool.plans import catalog, serving
from tidepool.plans.lineage import folder

NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == serving.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    want = duck.execute(catalog.SQL[name]).df()
    assert len(want) and plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(want)


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "chain long, key string, seq long, ok boolean, fee long")


def entries(df):
    return {(r["chain"], r["key"]): r["fee"] for r in df.collect()}


def test_upserts_rewrite_touched_buckets_alone(spark):
    store = cache.Cache(spark, folder(spark, "test_cache"), "fee long")
    assert entries(store.read()) == {} and store.versions() == []
    first = {(c, f"{k:02x}"): k for c in (1, 2) for k in range(60)}
    store.upsert(results(spark, *((c, k, 0, True, v) for (c, k), v in first.items())))
    before = {(r["chain"], r["bucket"]): r["path"] for r in store.manifest().collect()}
    store.upsert(results(spark, (1, "05", 1, True, 100), (1, "05", 2, True, 101), (1, "05", 3, False, 999), (1, "zz", 1, True, 7), (2, "06", 1, False, 999)))
    after = {(r["chain"], r["bucket"]): r["path"] for r in store.manifest().collect()}
    want = first | {(1, "05"): 101, (1, "zz"): 7}
    moved = {k for k in after if after[k] != before.get(k)}
    assert entries(store.read()) == want and 1 <= len(moved) <= 2 and {c for c, _ in moved} == {1}
    assert entries(store.read(2)) == {k: v for k, v in want.items() if k[0] == 2}
    asked = spark.createDataFrame([(1, "05"), (1, "05"), (2, "3b"), (2, "nothing")], "chain long, key string")
    assert entries(store.lookup(asked)) == {(1, "05"): 101, (2, "3b"): 59}
    assert store.upsert(results(spark, (1, "05", 4, False, 0))) == 3 and entries(store.read()) == want


def test_lost_writers_leave_the_old_version(spark):
    root = folder(spark, "test_cache")
    store = cache.Cache(spark, root, "fee long")
    store.upsert(results(spark, (1, "a", 0, True, 1), (2, "b", 0, True, 2)))
    # A writer that died: its data are written, its manifest isn't complete.
    spark.createDataFrame([("a", 666, 1, 0)], "key string, fee long, chain long, bucket int").write.partitionBy("chain", "bucket").parquet(f"{root}/data/write=lost")
    spark.createDataFrame([(1, 0, f"{root}/data/write=lost/chain=1/bucket=0")], cache.MANIFEST).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/manifest/v=2")
    assert store.versions() == [1] and entries(store.read()) == {(1, "a"): 1, (2, "b"): 2}
    store.files.delete(store._path("manifest", "v=2"), True)
    store.upsert(results(spark, (1, "a", 1, True, 5)))
    store.vacuum()
    assert store.versions() == [2] and entries(store.read()) == {(1, "a"): 5, (2, "b"): 2}
    left = [s.getPath().toString() for s in store.files.globStatus(store._path("data", "*", "chain=*", "bucket=*"))]
    assert len(left) == 2 and not any("lost" in p for p in left)


def test_quantities_and_hex(spark):
    rows = spark.createDataFrame([("0x0",), ("0xFf",), ("0xffffffffffffffff",), ("0x10000000000000000",), ("ff",), ("0x",), ("0xg",), (None,)], "t string")
    got = rows.select(frames.quantity(F.col("t")).alias("q"), frames.hex_bytes(F.col("t")).alias("h"), frames.hex_bytes(F.col("t"), 1).alias("one")).collect()
    assert [None if r["q"] is None else int(r["q"]) for r in got] == [0, 255, 2**64 - 1, None, None, None, None, None]
    assert [r["h"] for r in got] == [None, "ff", "f" * 16, None, None, "", None, None] and [r["one"] for r in got] == [None, "ff"] + [None] * 6


def test_frames_of_every_kind(spark):
    log = {"address": "0x" + "A" * 40, "topics": ["0x" + "1" * 64], "data": "0x", "blockHash": "0x" + "2" * 64, "blockNumber": "0x10", "logIndex": "0x1"}
    own = lambda result: json.dumps({"params": {"subscription": "me", "result": result}})
    cases = [
        (own(log), "sound", None), (own(log | {"removed": True, "extra": 1}), "sound", None), (own(log | {"blockHash": None, "logIndex": None}), "sound", None),
        (json.dumps({"id": 1, "result": "0x1"}), "foreign", None), (json.dumps({"params": {"subscription": "you", "result": 5}}), "foreign", None), ("{}", "foreign", None),
        (own(log)[:-4], "fault", "not_json"), ("", "fault", "not_json"), (None, "fault", "not_json"), (json.dumps({"params": {"subscription": "me"}}), "fault", "missing_result"),
        (own("text"), "fault", "not_json"), (own(log | {"address": "0x12"}), "fault", "bad_address"), (own({k: v for k, v in log.items() if k != "topics"}), "fault", "bad_topics"),
        (own(log | {"topics": ["0x1"]}), "fault", "bad_topics"), (own(log | {"data": "0x1"}), "fault", "bad_data"), (own(log | {"blockHash": "0x2"}), "fault", "bad_block_hash"), (own(log | {"logIndex": "5"}), "fault", "bad_quantity"),
    ]
    df = spark.createDataFrame([(k, c[0], "clash") for k, c in enumerate(cases)], "n long, frame string, topics string")
    got = frames.classified(df, "me").orderBy("n").collect()
    assert [(r["kind"], r["reason"]) for r in got] == [c[1:] for c in cases]
    assert got[0]["log"]["address"] == "a" * 40 and int(got[0]["log"]["number"]) == 16 and got[1]["log"]["removed"] and got[3]["log"] is None
    path = folder(spark, "test_frames")
    df.repartition(2).write.parquet(path)
    parts = frames.split(spark.readStream.schema(df.schema).parquet(path), "me")
    assert {k: sorted(r["n"] for r in v.collect()) for k, v in parts.items()} == {kind: [k for k, c in enumerate(cases) if c[1] == kind] for kind in ("sound", "foreign", "fault")}
    assert {r["n"]: r["reason"] for r in parts["fault"].collect()} == {k: c[2] for k, c in enumerate(cases) if c[2]}


def test_one_bad_log_fails_its_response(spark):
    block = "2" * 64
    log = {"address": "0x" + "a" * 40, "topics": [], "data": "0x", "blockHash": "0x" + block}
    body = lambda n, logs: json.dumps({"id": n, "result": logs})
    cases = [(body(0, [log, log]), None, 2), (body(1, []), None, 0), (body(2, [log, log | {"blockHash": "0x" + "3" * 64}]), "other_block", None), (body(3, [log, {k: v for k, v in log.items() if k != "blockHash"}]), "other_block", None), (body(9, [log]), "other_id", None), (body(5, "x"), "not_a_list", None), (body(6, [log | {"data": "?"}]), "bad_data", None), (body(7, [log])[:-2], "not_json", None), (json.dumps({"id": 8, "error": {"code": 1}}), "error", None)]
    df = spark.createDataFrame([(k, block, c[0]) for k, c in enumerate(cases)], "request long, block_hash string, body string")
    got = {r["request"]: (r["fault"], None if r["logs"] is None else len(r["logs"])) for r in frames.block_logs(df).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}


def test_slices_answer_in_full_or_with_a_fault(spark):
    a, b = "0x" + "aB" * 20, "0x" + "c" * 64
    asked = [(1, 7, 0, "v3", a), (1, 7, 1, "v4", b), (1, 7, 2, "v3", a), (2, 7, 0, "v3", "0x12"), (2, 7, 1, "v3", a), (3, 8, 0, "v9", a), (4, 9, None, None, None), (5, 6, 0, "v3", a)]
    asked = spark.createDataFrame(asked, "request long, chain long, ordinal long, protocol string, id string")
    states = spark.createDataFrame([(7, "v3", "ab" * 20, "79", 5, 1000), (9, "v3", "ab" * 20, "79", 5, 1000)], "chain long, protocol string, id string, sqrt_price string, tick long, liquidity long")
    chains = spark.createDataFrame([(7, True, "f7", 3), (8, False, None, None), (9, True, "f9", None)], "chain long, anchored boolean, frontier string, behind long")
    heads, found = slices.answers(asked, states, chains)
    assert {r["request"]: (r["status"], r["block_hash"], r["confirmations"]) for r in heads.collect()} == {1: (200, "f7", 3), 2: (400, None, None), 3: (503, None, None), 4: (200, "f9", 0), 5: (503, None, None)}
    assert [(r["ordinal"], r["id"], r["completeness"], r["liquidity"]) for r in found.orderBy("ordinal").collect()] == [(0, a, "complete", 1000), (1, b, "incomplete", None), (2, a, "complete", 1000)]


def test_chain_policies(spark):
    rows = {r["slug"]: r for r in dims.chains(spark).collect()}
    assert {s for s, r in rows.items() if r["active"]} == {"ethereum", "base", "optimism", "avalanche"} and rows["polygon"]["most_pending"] == 3200 and rows["ethereum"]["refresh_at"] == 72
    ids = spark.createDataFrame([(42161,), (5,), (None,)], "n long")
    assert [r["slug"] for r in dims.by_id(ids, "n").orderBy(F.desc_nulls_last("n")).collect()] == ["arbitrum", None, None]
    emitters = spark.createDataFrame([("498581FF718922c3f8e6a244956af099b2652b2b",), ("360e68faccca8ca495c1b759fd9eee466db9fb32",), ("0" * 40,)], "address string")
    assert sorted(str(r["manager_of"]) for r in dims.is_manager(emitters, "address").collect()) == ["None", "None", "base"]
