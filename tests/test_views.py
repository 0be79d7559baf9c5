"""Gates, views, ranges of ticks and lines of logs against their SQL and on odd inputs."""

import pytest
from pyspark.sql import functions as F

from test_market import SF, duck, plain  # noqa: F401  (duck is a fixture)
from tidepool.functions import lines, ticks
from tidepool.operators import checks, decode, registry
from tidepool.operators.ordered import numbered
from tidepool.plans import catalog, views

NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == views.__name__]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    want = duck.execute(catalog.SQL[name]).df()
    assert len(want) and plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(want)


def test_gate_names_the_first_token_that_is_not_allowed(spark):
    rows = spark.createDataFrame([(1, 10, 20, True, None), (2, 10, 30, True, None), (3, 40, 30, True, None), (4, 40, 30, False, "hooked_pool"), (5, 10, 20, None, None)], "pool_id long, token0 long, token1 long, ok boolean, failure string")
    some, none = (spark.createDataFrame([(t,) for t in ts], "token long") for ts in ((10, 20, 10), ()))
    told = lambda allowed: {r["pool_id"]: (r["outcome"], r["reason_token"]) for r in registry.gated(rows, allowed).collect()}
    passed = {4: ("hooked_pool", None), 5: ("failed", None)}
    assert told(some) == passed | {1: ("ok", None), 2: ("token_not_whitelisted", 30), 3: ("token_not_whitelisted", 40)}
    assert told(none) == passed | {k: ("token_not_whitelisted", t) for k, t in ((1, 10), (2, 10), (3, 40))} and told(None) == passed | {k: ("ok", None) for k in (1, 2, 3)}


def test_a_chain_projects_whole_or_not(spark):
    rows = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 1, 6), (2, 1, 2, 7), (2, 1, 2, None), (3, 1, 9, 8)], "chain long, token0 long, token1 long, tick long")
    got = registry.whole_chains(rows, spark.createDataFrame([(1, 6), (2, 18)], "token long, decimals int")).collect()
    assert sorted((r["chain"], r["tick"], r["decimals0"], r["decimals1"]) for r in got) == [(1, 5, 6, 18), (1, 6, 18, 6)]


def test_published_tick_ranges(spark):
    rows = [(1000, 60), (-1000, 60), (-887272, 60), (887272, 60), (887273, 60), (-887273, 60), (5, 0), (None, 60), (0, 1)]
    got = [tuple(r["r"]) for r in spark.createDataFrame(rows, "t long, s long").select(ticks.tick_range(F.col("t"), F.col("s")).alias("r")).collect()]
    assert got == [(960, 1020, None), (-1020, -960, None), (-887272, -887212, None), (887220, 887272, None), (None, None, "out_of_bounds"), (None, None, "out_of_bounds"), (None, None, "bad_spacing"), (None, None, None), (0, 1, None)]


def test_lines_of_logs(spark):
    rows = [("  a\n\tb 　c ",), ("x" * 513,), ("é" * 512,), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(lines.one_line(F.col("t"))).collect()]
    assert got == ["a b c", "x" * 512 + "…", "é" * 512, "", None]
    row = spark.range(1).select(lines.progress(F.lit("Base"), F.lit(3), F.lit(None), F.lit(7), F.lit(0), F.lit(2)))
    assert row.first()[0] == "Base: Active  pools=3  behind=?  window=7  inflight=0  ws_miss=2"


def test_slots_are_read_in_order(spark):
    a, b, c, zero = "a" * 40, "b" * 40, "c" * 40, "0" * 40
    proxy = lambda t: checks.PROXY[0] + t + checks.PROXY[1]
    word = lambda t: t.rjust(64, "0")
    rows = [(proxy(a), word(b), word(c), a), ("60", word(b), word(c), b), ("60", None, word(c), c), (None, "junk", word(c.upper()), c), ("60", word(zero), word(c), None), (proxy(zero), word(b), None, None), ("60", None, None, None)]
    df = spark.createDataFrame(rows, "code string, slot string, beacon string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", checks.slot_target(F.col("code"), F.col("slot"), F.col("beacon"))).collect())


def test_positions_over_many_tasks(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit(1).alias("position_of"))
    got = [r["position"] for r in numbered(rows, "k").orderBy("k").collect()]
    assert got == list(range(5000)) and numbered(rows.limit(0), "k").count() == 0


def test_every_subscribed_event(spark):
    assert len(decode.SUBSCRIBED) == len(set(decode.SUBSCRIBED)) == 12
    logs = spark.createDataFrame([([t],) for t in (*decode.SUBSCRIBED, "0" * 64)] + [([],), (None,)], "topics array<string>")
    assert decode.topic_filter(logs).count() == 12
