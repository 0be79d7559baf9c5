"""Pool logs from raw ones: admission, topics, words and signs; identity checks of pools; bloom tests.

Raw values are hex digits without a prefix.  All decoding is built-in functions; only hashes run in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.keccak import bloom_bits, keccak_hex, meets, packed_bits, topic
from tidepool.sources.market import TIERS

#: Event of each signature (fixed values): protocol, kind, topics, words of data.
EVENTS = {
    "Swap(address,address,int256,int256,uint160,uint128,int24)": ("v3", "swap", 3, 5),
    "Initialize(uint160,int24)": ("v3", "initialize", 1, 2),
    "Mint(address,address,int24,int24,uint128,uint256,uint256)": ("v3", "mint", 4, 4),
    "Burn(address,int24,int24,uint128,uint256,uint256)": ("v3", "burn", 4, 3),
    "Swap(bytes32,address,int128,int128,uint160,uint128,int24,uint24)": ("v4", "swap", 3, 6),
    "Initialize(bytes32,address,address,uint24,int24,address,uint160,int24)": ("v4", "initialize", 4, 5),
    "ModifyLiquidity(bytes32,address,int24,int24,int256,bytes32)": ("v4", "modify", 3, 4),
}
TOPICS = {topic(signature): event for signature, event in EVENTS.items()}
#: Addresses that a block's bloom is held against in one row.
PART = 512
#: Other events of pools that are subscribed to and change no state (fixed values).
STATELESS = (
    "Collect(address,address,int24,int24,uint128,uint128)", "Flash(address,address,uint256,uint256,uint256,uint256)", "IncreaseObservationCardinalityNext(uint16,uint16)",
    "SetFeeProtocol(uint8,uint8,uint8,uint8)", "CollectProtocol(address,address,uint128,uint128)",
)
SUBSCRIBED = (*TOPICS, *map(topic, STATELESS))
DYNAMIC_FEE = 0x800000
MOST_SPACING = 65535
WORD = 64


def admitted(frames: DataFrame) -> DataFrame:
    """Logs that count: not removed by a reorganisation, and attributed to a block."""
    return frames.where(~F.coalesce("removed", F.lit(False)) & F.col("block_hash").isNotNull())


def topic_filter(logs: DataFrame) -> DataFrame:
    """Logs whose first topic is one of the events that are subscribed to, whoever emits them."""
    return logs.where(F.get("topics", F.lit(0)).isin(*SUBSCRIBED))


def by_block(logs: DataFrame) -> DataFrame:
    """chain, block_number, block_hash, n_logs, first and last index of the admitted logs of ranges, by block.

    Two hashes of one number are two blocks.  The logs themselves stay rows: their order is ``log_index``.
    """
    return admitted(logs).groupBy("chain", "block_number", "block_hash").agg(F.count(F.lit(1)).alias("n_logs"), F.min("log_index").alias("first_index"), F.max("log_index").alias("last_index"))


def word(data: Column, index: int) -> Column:
    return F.substring(data, index * WORD + 1, WORD)


def signed24(digits: Column) -> Column:
    """The signed number in the last 24 bits of a word."""
    n = F.conv(F.right(digits, F.lit(6)), 16, 10).cast("long")
    return F.when(n >= 1 << 23, n - (1 << 24)).otherwise(n)


def is_negative(digits: Column) -> Column:
    return F.left(digits, F.lit(1)) >= "8"


def magnitude(digits: Column) -> Column:
    """Hex digits of a signed word's absolute value.

    Minus a number is its complement plus one: zeros at the end stay, the last other digit is taken
    from 16, all before it from 15.
    """
    body = F.rtrim(digits, F.lit("0"))
    head, last = F.left(body, F.length(body) - 1), F.right(body, F.lit(1))
    flipped = F.concat(F.translate(head, "0123456789abcdef", "fedcba9876543210"), F.translate(last, "123456789abcdef", "fedcba987654321"))
    return F.when(is_negative(digits), F.rpad(flipped, WORD, "0")).otherwise(digits)


def decode(logs: DataFrame, managers: DataFrame) -> DataFrame:
    """One row per log that changes a pool: chain, block_number, log_index, protocol, pool, kind, sqrt_price, tick, liquidity, tick_lower, tick_upper, amount.

    ``logs``: chain, address, topics, data, block_number, log_index; ``managers``: address, one for each chain, so few that they are broadcast.
    A v3 pool is its emitter, a v4 pool its id, taken only from a manager.  Dropped: logs without an
    index, unknown or too few topics, data that ends early, liquidity changes of 128 bits and more.
    Prices, liquidities and amounts stay hex digits (40, 32 and 32), as no number type holds them all.
    Extra columns are left out.
    """
    events = logs.sparkSession.createDataFrame([(t, event) for t, event in TOPICS.items()], "topic string, event struct<protocol string, kind string, topics int, words int>")
    rows = logs.where("log_index is not null and size(topics) > 0").withColumn("topic", F.get("topics", F.lit(0))).join(F.broadcast(events), "topic")
    rows = rows.where((F.size("topics") >= F.col("event.topics")) & (F.length("data") >= F.col("event.words") * WORD))
    rows = rows.join(F.broadcast(managers.select("address", F.lit(True).alias("manager")).distinct()), "address", "left").where("event.protocol = 'v3' or manager")
    data = lambda i: word(F.col("data"), i)
    at = lambda i: F.get("topics", F.lit(i))
    v3, kind = F.col("event.protocol") == "v3", F.col("event.kind")
    swap, start, modify = kind == "swap", kind == "initialize", kind == "modify"
    change = F.when(modify, magnitude(data(2))).when(kind == "mint", data(1)).when(kind == "burn", data(0))
    # Where each event keeps its price: before it stand amounts (swaps) or fee, spacing and hooks (v4 starts).
    price = F.when(swap, data(2)).when(start & v3, data(0)).when(start, data(3))
    tick = F.when(swap, data(4)).when(start & v3, data(1)).when(start, data(4))
    lower, upper = F.when(modify, data(0)).when(~swap & ~start, at(2)), F.when(modify, data(1)).when(~swap & ~start, at(3))
    if_fits = lambda digits: F.left(digits, F.lit(32)) == "0" * 32
    return rows.where(~modify | if_fits(change)).select(
        "chain", "block_number", "log_index", F.col("event.protocol").alias("protocol"), F.when(v3, F.col("address")).otherwise(at(1)).alias("pool"),
        F.when(modify, F.when(is_negative(data(2)), "burn").otherwise("mint")).otherwise(kind).alias("kind"), F.right(price, F.lit(40)).alias("sqrt_price"), signed24(tick).alias("tick"),
        F.when(swap, F.right(data(3), F.lit(32))).alias("liquidity"), signed24(lower).alias("tick_lower"), signed24(upper).alias("tick_upper"), F.right(change, F.lit(32)).alias("amount"),
    )


def tier_check(fee: Column) -> Column:
    """``supported`` for the four fees that v3 pools may have, else ``unsupported_tier``."""
    return F.when(F.coalesce(fee.isin(*TIERS), F.lit(False)), "supported").otherwise("unsupported_tier")


def pool_key(keys: DataFrame) -> Column:
    """Id of a v4 pool: the digest of currency0, currency1 (40 digits each), fee, tick_spacing and hooks as five words."""
    number = lambda c: F.lpad(F.lower(F.hex(c)), WORD, "0")
    spacing = F.when(F.col("tick_spacing") < 0, F.lpad(F.lower(F.hex("tick_spacing")), WORD, "f")).otherwise(number("tick_spacing"))
    return keccak_hex(F.concat(*(F.lpad(F.col(c), WORD, "0") for c in ("currency0", "currency1")), number("fee"), spacing, F.lpad(keys["hooks"], WORD, "0")))


def key_outcomes(keys: DataFrame) -> DataFrame:
    """``keys`` with ``outcome``: the first of dynamic fee, hooks, another id than claimed, bad spacing; else ok."""
    rows = keys.withColumn("derived", pool_key(keys))
    outcome = (
        F.when(F.col("fee").bitwiseAND(DYNAMIC_FEE) != 0, "dynamic_fee").when(F.col("hooks") != "0" * 40, "hooked_pool")
        .when(~F.col("derived").eqNullSafe(F.col("id")), "id_mismatch").when(~F.col("tick_spacing").between(1, MOST_SPACING), "bad_spacing").otherwise("ok")
    )
    return rows.withColumn("outcome", outcome)


def watched_addresses(pools: DataFrame, managers: DataFrame) -> DataFrame:
    """chain, address to watch: a v3 pool's own, and the chain's manager where it has v4 pools and a manager."""
    own = pools.where("protocol = 'v3'").select("chain", F.col("pool").alias("address"))
    shared = managers.select("chain", "address").join(pools.where("protocol = 'v4'").select("chain").distinct(), "chain", "left_semi")
    return own.union(shared).distinct()


def may_touch(blocks: DataFrame, watched: DataFrame) -> DataFrame:
    """chain, number, may_touch of every block: whether its bloom may hold a watched address.

    ``blocks``: chain, number, bloom (array of set bits, null if unknown).  Without a bloom a block may
    touch anything; where a chain watches nothing, none does.  A chain's addresses are dealt into parts of
    about ``PART``; a block meets each part once, in one row, whatever the bits that they share.
    """
    bits = watched.select("chain", bloom_bits("address").alias("pattern")).distinct()
    parts = bits.groupBy("chain").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts"))
    dealt = bits.join(F.broadcast(parts), "chain").withColumn("part", F.pmod(F.xxhash64("pattern"), "parts"))  # one row for each chain
    dealt = dealt.groupBy("chain", "part").agg(F.flatten(F.collect_list("pattern")).alias("patterns")).select("chain", "part", packed_bits("patterns").alias("patterns"))
    known = blocks.where("bloom is not null").select("chain", "number", packed_bits("bloom").alias("bloom")).join(F.broadcast(parts), "chain").select("chain", "number", "bloom", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    hit = known.join(dealt, ["chain", "part"]).where(meets("bloom", "patterns")).select("chain", "number").distinct().withColumn("hit", F.lit(True))
    rows = blocks.join(hit, ["chain", "number"], "left").join(watched.select("chain").distinct().withColumn("any", F.lit(True)), "chain", "left")
    return rows.select("chain", "number", (F.coalesce("any", F.lit(False)) & (F.col("bloom").isNull() | F.coalesce("hit", F.lit(False)))).alias("may_touch"))
