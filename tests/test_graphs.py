"""Block graphs, caches and indexer responses against their SQL and on odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from test_market import SF, duck, plain  # noqa: F401  (duck is a fixture)
from tidepool.operators import artifacts, cache, graph, indexer
from tidepool.operators.ordered import with_previous
from tidepool.plans import catalog, feeds, graphs

NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ in (graphs.__name__, feeds.__name__) and n in catalog.SQL]
NODES = "chain long, block long, parent long, number long, authority int, touched boolean"


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    want = duck.execute(catalog.SQL[name]).df()
    assert len(want) and plain(catalog.QUERIES[name](spark, SF).toPandas()) == plain(want)


def test_every_branch_has_rows(duck):  # noqa: F811
    rows = lambda name, column: set(duck.execute(f"SELECT DISTINCT {column} FROM ({catalog.SQL[name]})").df()[column])
    assert rows("block_classes", "class") == {"connected", "pending"}
    assert rows("finalized_anchors", "moved") == {True, False}
    assert rows("seeded_graph", "filler") == {True, False}
    assert {"malformed", "errors", "no_data", "bad_number"} <= rows("indexer_responses", "fault")
    assert rows("factory_checks", "outcome") == {"ok", "factory_mismatch", "unsupported_tier"}


def test_cycles_gaps_and_anchors(spark):
    # Chain 1: 10 <- 11 <- 12, a fork 13 over a gap, a cycle 20 <-> 21 and a self-parent; chain 2 has a head in a cycle; chain 3 nothing.
    nodes = spark.createDataFrame(
        [(1, 11, 10, 1, 2, True), (1, 12, 11, 2, 2, None), (1, 13, 99, 3, 2, True), (1, 20, 21, 4, 2, True), (1, 21, 20, 5, 2, True), (1, 30, 30, 6, 2, True), (2, 5, 6, 1, 0, True), (2, 6, 5, 2, 0, True)], NODES
    )
    anchors = spark.createDataFrame([(1, 10, 0), (2, 1, 0), (3, 7, 0)], "chain long, block long, number long")
    assert {tuple(r) for r in graph.connected(nodes, anchors).collect()} == {(1, 11), (1, 12)}
    heads = lambda a, b: spark.createDataFrame([(1, a), (2, b), (3, 7)], "chain long, block long")
    assert {tuple(r) for r in graph.present_path(nodes, heads(12, 5), anchors).collect()} == {(1, 12, 0), (1, 11, 1)}
    assert {tuple(r) for r in graph.present_path(nodes, heads(13, 1), anchors).collect()} == {(1, 13, 0)}
    assert not graph.anchored_path(nodes, heads(13, 5), anchors).collect()
    final = graph.finalized(nodes, heads(12, 5), anchors, heads(11, 6))
    assert {tuple(r) for r in final.collect()} == {(1, 11, 1, True), (2, 1, 0, False), (3, 7, 0, False)}
    kept = graph.rerooted(nodes, final)
    assert {(r["chain"], r["block"]) for r in kept.collect()} == {(1, 12), (2, 5), (2, 6)}
    assert {tuple(r) for r in graph.surviving_heads(heads(13, 5), kept, final).collect()} == {(1, 11), (2, 5), (3, 7)}


def test_connected_equals_a_walk(spark):
    rng = random.Random(5)
    parents = {b: rng.choice([b - 1, b - 1, b - 1, b - 2, rng.randrange(1, 400)]) for b in range(2, 400) if b % 50}
    nodes = spark.createDataFrame([(0, b, p, b, 2, True) for b, p in parents.items()], NODES)

    def home(b):
        seen = set()
        while b in parents and b not in seen:
            seen.add(b)
            b = parents[b]
        return b == 1

    got = {r["block"] for r in graph.connected(nodes, spark.createDataFrame([(0, 1, 1)], "chain long, block long, number long")).collect()}
    assert got == {b for b in parents if home(b)} and len(got) not in (0, len(parents))


def test_previous_rows_across_buckets(spark):
    rng = random.Random(1)
    numbers = {k: sorted(rng.sample(range(-300, 3000), 40)) for k in "ab"}
    rows = spark.createDataFrame([(k, n, str(n)) for k, ns in numbers.items() for n in ns], "k string, n long, v string")
    got = {(r["k"], r["n"]): r["before"] and (r["before"]["n"], r["before"]["v"]) for r in with_previous(rows, "k", "n", ["v"], 16).collect()}
    assert got == {(k, n): (ns[i - 1], str(ns[i - 1])) if i else None for k, ns in numbers.items() for i, n in enumerate(ns)}


def test_responses_of_no_json_and_empty_ones(spark):
    bodies = ["not json", "", None, "[]", "null", "{}", '{"data": null}', '{"data": {"pools": []}}', '{"data": {"pools": []}, "errors": []}', '{"errors": [{"message": "x"}]}', '{"data": {}}']
    rows = spark.createDataFrame([(1, i, b) for i, b in enumerate(bodies)], "chain long, response long, body string")
    got = {r["response"]: r["fault"] for r in indexer.pool_responses(rows, spark.createDataFrame([], "chain long, id string")).collect()}
    assert [got[i] for i in (0, 1, 2)] == ["malformed"] * 3 and got[5] == got[6] == "no_data" and got[7] is got[8] is None and got[9] == "errors" and got[10] == "malformed"
    pages = spark.createDataFrame([(1, "{}"), (2, "nope"), (3, None), (4, '{"included": []}')], "page long, body string")
    assert not indexer.popular_tokens(pages).collect()


def test_source_must_be_allowed(spark):
    bridges = spark.createDataFrame([(1, 2)], "token_in long, token_out long")
    with pytest.raises(ValueError):
        indexer.split_bridges(bridges, spark.createDataFrame([(2,)], "token long"), 1)


def test_chain_scan_reads_one_folder(spark, tmp_path):
    rows = spark.createDataFrame([(c, f"{k:04x}", 0, True, c) for c in range(3) for k in range(10)], "chain long, key string, seq long, ok boolean, v long")
    store = cache.Cache(spark, f"file://{tmp_path}/c", "v long")
    store.upsert(rows)
    scan, one = store.read(1), store.lookup(rows.where("chain = 1 and key = '0003'"))
    assert scan.count() == 10 and all("chain=1/" in f for f in scan.inputFiles())
    assert one.count() == 1 and len({f.rsplit("/", 1)[0] for f in one.inputFiles() if "bucket=" in f}) == 1
    assert spark.range(1).select(cache.cache_key(F.lit(1), F.lit("v9"), F.lit("00"))).first()[0] is None


def test_artifact_of_an_unknown_chain(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    artifacts.write_artifact(spark.createDataFrame([("base", 1, None), ("mars", 2, "M")], "chain string, token long, symbol string"), path)
    with pytest.raises(ValueError, match="mars"):
        artifacts.read_artifact(spark, path, ["base"])
    assert {tuple(r) for r in artifacts.read_artifact(spark, path, ["base", "mars"]).collect()} == {("base", 1, None), ("mars", 2, "M")}
