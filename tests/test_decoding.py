"""Hashes against published values, decoding against its SQL, bloom tests against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from test_market import SF, duck, plain  # noqa: F401  (duck is a fixture)
from tidepool.functions.keccak import keccak256, topic
from tidepool.operators import decode
from tidepool.plans import catalog, decoding  # noqa: F401  (importing decoding registers its queries)


def test_keccak_equals_published_digests():
    assert keccak256([b""])[0].hex() == "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470"
    assert topic("Transfer(address,address,uint256)") == "ddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
    assert topic("Swap(address,address,int256,int256,uint160,uint128,int24)") == "c42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67"
    # The padding changes at block ends: a batch of mixed lengths gives what one value alone gives.
    values = [bytes([i % 256]) * i for i in (0, 1, 134, 135, 136, 137, 271, 272, 300)]
    assert keccak256(values) == [keccak256([v])[0] for v in values] and len(set(keccak256(values))) == len(values)


def test_pool_key_of_a_known_pool(spark):
    keys = spark.createDataFrame([("0" * 40, "a0b86991c6218b36c1d19d4a2e9eb0ce3606eb48", 500, 10, "0" * 40)], "currency0 string, currency1 string, fee long, tick_spacing long, hooks string")
    assert keys.select(decode.pool_key(keys)).first()[0] == "21c67e77068de97969ba93d4aab21826d33ca12bb9f565d8496e8fda8a82ca27"


@pytest.mark.parametrize("name", ["decoded_logs", "pool_key_outcomes", "fee_tiers", "watched_addresses"])
def test_decoding_equals_sql(spark, duck, name):  # noqa: F811
    assert plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(duck.execute(catalog.SQL[name]).df())


def test_magnitudes_of_signed_words(spark):
    numbers = [0, 1, -1, 16, -16, 255, -256, 2**127, -(2**127), -(2**128) + 1, 2**255 - 1, -(2**255)]
    rows = spark.createDataFrame([(str(n), f"{n % 2**256:064x}") for n in numbers], "n string, word string")
    assert all(int(r["m"], 16) == abs(int(r["n"])) and len(r["m"]) == 64 for r in rows.select("n", decode.magnitude(F.col("word")).alias("m")).collect())


def test_frames_without_topics_blocks_or_rows(spark):
    schema = "chain long, address string, topics array<string>, data string, block_hash string, block_number long, log_index long, removed boolean"
    rows = [(1, "aa", [], "", "b", 1, 0, False), (1, "aa", None, "", "b", 1, 0, None), (1, "aa", ["00"], "", "b", 1, 0, False), (1, None, list(decode.TOPICS)[:1], None, "b", 1, 0, False)]
    managers = spark.createDataFrame([], "address string")
    assert decode.decode(decode.admitted(spark.createDataFrame(rows, schema)), managers).count() == 0
    assert decode.decode(spark.createDataFrame([], schema), managers).count() == 0


def test_bloom_equals_all_pairs(spark):
    rng = random.Random(3)
    pattern = lambda a: {int.from_bytes(keccak256([bytes.fromhex(a)])[0][i : i + 2]) & 2047 for i in (0, 2, 4)}
    watched = [(c, f"{rng.getrandbits(160):040x}") for c in (1, 2) for _ in range(40)]
    blocks = [(c, n, None if n % 9 == 0 else sorted(set(rng.sample(range(2048), 900)) | (pattern(rng.choice(watched)[1]) if n % 4 == 0 else set()))) for c in (1, 2, 3) for n in range(60)]
    blocks.append((1, 60, []))
    got = decode.may_touch(spark.createDataFrame(blocks, "chain long, number long, bloom array<int>"), spark.createDataFrame(watched, "chain long, address string"))
    expected = {(c, n): any(c == w and (bits is None or pattern(a) <= set(bits)) for w, a in watched) for c, n, bits in blocks}
    assert {(r["chain"], r["number"]): r["may_touch"] for r in got.collect()} == expected and len(set(expected.values())) == 2


def test_a_bloom_meets_many_addresses_in_few_rows(spark):
    """5000 addresses and full blooms: blocks meet parts of them, not every address that shares a bit."""
    watched = spark.range(5000).select(F.lit(1).cast("long").alias("chain"), F.lpad(F.lower(F.hex("id")), 40, "0").alias("address"))
    blocks = spark.range(40).select(F.lit(1).cast("long").alias("chain"), F.col("id").alias("number"), F.sequence(F.lit(0), F.when(F.col("id") % 2 == 0, 2047).otherwise(0)).alias("bloom"))
    got = decode.may_touch(blocks, watched)
    assert {r["number"]: r["may_touch"] for r in got.collect()} == {n: n % 2 == 0 for n in range(40)}
    rows, todo = [], [got._jdf.queryExecution().optimizedPlan()]
    while todo:
        plan = todo.pop()
        rows.append(plan.toString().split("\n")[0])
        todo += [plan.children().apply(k) for k in range(plan.children().size())]
    assert not any("bloom#" in r and "explode(bloom" in r for r in rows)
