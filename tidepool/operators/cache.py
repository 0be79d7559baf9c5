"""Cached pool metadata in buckets by chain and key: keys, upserts of successes, lookups and scans of one chain."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags of protocols and the digits of their identities (fixed values).
PROTOCOLS = {"v3": (0, 40), "v4": (1, 64)}
#: Decimals of the native token, which no registry needs to hold (fixed value).
NATIVE, NATIVE_DECIMALS = "0" * 40, 18


def _byte(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 2, "0")


def cache_key(chain: Column, protocol: Column, identity: Column) -> Column:
    """Hex digits of a key: a byte of the chain, a byte of the protocol, the identity.  Null for unknown protocols or chains beyond a byte."""
    tag = F.coalesce(*(F.when(protocol == name, F.lit(f"{tag:02x}")) for name, (tag, _) in PROTOCOLS.items()))
    return F.when(chain.between(0, 255), F.concat(_byte(chain), tag, F.lower(identity)))


def decoded_key(key: Column) -> Column:
    """chain, protocol and identity of a key; null if its protocol is unknown or its identity of another length."""
    tag, identity = F.substring(key, 3, 2), F.right(key, F.greatest(F.length(key) - 4, F.lit(0)))
    fits = [F.when((tag == f"{t:02x}") & (F.length(identity) == digits), F.lit(name)) for name, (t, digits) in PROTOCOLS.items()]
    protocol = F.coalesce(*fits)
    return F.when(protocol.isNotNull(), F.struct(F.conv(F.left(key, F.lit(2)), 16, 10).cast("long").alias("chain"), protocol.alias("protocol"), identity.alias("identity")))


def upserted(cached: DataFrame, results: DataFrame, value: str) -> DataFrame:
    """chain, key and ``value`` after the results (chain, key, seq, ok, value): the last success of a key replaces what was cached; failures change nothing."""
    fresh = results.where("ok").groupBy("chain", "key").agg(F.max_by(value, "seq").alias(value))
    columns = ["chain", "key", value]
    return cached.select(*columns).join(fresh, ["chain", "key"], "left_anti").unionByName(fresh.select(*columns))


#: Buckets of a chain's keys; a change rewrites those that it touches.
BUCKETS = 16
MANIFEST = "chain long, bucket int, path string"


class Cache:
    """A cache in versions: buckets of chains as folders, and a manifest that names each bucket's folder.

    An upsert writes the touched buckets anew, then the next manifest; a writer that dies before leaves
    the old version, which readers see until a manifest is complete.  Buckets are by key hash, so a
    lookup reads the folders of the asked keys' buckets alone.  Folders that come to the driver are at
    most ``BUCKETS`` a chain.
    """

    def __init__(self, spark: SparkSession, root: str, value: str):
        self.spark, self.root, self.value = spark, root.rstrip("/"), value
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        self.files, self.manifests = path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def versions(self) -> list[int]:
        """Numbers of the complete versions, in order."""
        if not self.files.exists(self.manifests):
            return []
        names = [s.getPath().getName() for s in self.files.listStatus(self.manifests)]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and self.files.exists(self._path("manifest", n, "_SUCCESS")))

    def manifest(self) -> DataFrame:
        last = self.versions()
        if not last:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={last[-1]}")

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int"))

    def _read(self, folders: DataFrame) -> DataFrame:
        paths = [r["path"] for r in folders.select("path").distinct().collect()]  # BUCKETS a chain at most
        kind = f"key string, {self.value}"
        if not paths:
            return self.spark.createDataFrame([], f"chain long, {kind}")
        rows = self.spark.read.schema(f"{kind}, write string, chain long, bucket int").option("basePath", f"{self.root}/data").parquet(*paths)
        return rows.select("chain", "key", self.value.split()[0])

    def read(self, chain: int | None = None) -> DataFrame:
        """All entries, or those of a chain: other chains' folders are not read."""
        rows = self.manifest()
        return self._read(rows if chain is None else rows.where(F.col("chain") == chain))

    def lookup(self, asked: DataFrame) -> DataFrame:
        """Entries of the asked (chain, key), hits only."""
        wanted = self._bucketed(asked.select("chain", "key").distinct())
        near = self._read(self.manifest().join(wanted.select("chain", "bucket").distinct(), ["chain", "bucket"]))
        return near.join(wanted.select("chain", "key"), ["chain", "key"], "left_semi")

    def upsert(self, results: DataFrame) -> int:
        """Takes in the last success of each key of results (chain, key, seq, ok, value); the version after that.  Failures change nothing."""
        name, old = self.value.split()[0], self.manifest()
        fresh = self._bucketed(results.where("ok").groupBy("chain", "key").agg(F.max_by(name, "seq").alias(name)))
        touched = fresh.select("chain", "bucket").distinct()
        kept = self._read(old.join(touched, ["chain", "bucket"], "left_semi")).join(fresh, ["chain", "key"], "left_anti")
        version = (self.versions() or [0])[-1] + 1
        folder = f"{self.root}/data/write={uuid.uuid4().hex}"
        merged = self._bucketed(kept).unionByName(fresh.select("chain", "key", name, "bucket"))
        merged.repartition("chain", "bucket").write.partitionBy("chain", "bucket").parquet(folder)
        place = F.concat(F.lit(f"{folder}/chain="), "chain", F.lit("/bucket="), "bucket").alias("path")
        new = self.spark.read.parquet(folder).select(F.col("chain").cast("long"), F.col("bucket").cast("int")).distinct() if not touched.isEmpty() else self.spark.createDataFrame([], "chain long, bucket int")
        old.join(touched, ["chain", "bucket"], "left_anti").unionByName(new.select("chain", "bucket", place)).coalesce(1).write.parquet(f"{self.root}/manifest/v={version}")
        return version

    def vacuum(self) -> None:
        """Deletes what only earlier versions, or writers that died, have left; no reader may be on them."""
        last = self.versions()
        own = lambda path: path[path.rindex("/data/write=") :]  # noqa: E731  (roots may be written in more than one way)
        used = {own(r["path"]) for r in self.manifest().collect()}
        for status in self.files.globStatus(self._path("data", "*", "chain=*", "bucket=*")) or []:
            if own(status.getPath().toString()) not in used:
                self.files.delete(status.getPath(), True)
        for version in last[:-1]:
            self.files.delete(self._path("manifest", f"v={version}"), True)


def rehydrated(pools: DataFrame, decimals: DataFrame) -> DataFrame:
    """kind, chain, key: cached pools, and those of their tokens that are cached too."""
    tokens = pools.select("chain", F.explode(F.array("token0", "token1")).alias("key")).distinct().join(decimals.select("chain", F.col("token").alias("key")), ["chain", "key"], "left_semi")
    return pools.select(F.lit("pool").alias("kind"), "chain", F.col("pool_id").alias("key")).union(tokens.select(F.lit("token"), "chain", "key"))


def token_decimals(asked: DataFrame, known: DataFrame) -> DataFrame:
    """``asked`` with decimals: the registry's, 18 for the native token without a row, else null."""
    return asked.join(known.select("token", "decimals"), "token", "left").withColumn("decimals", F.coalesce("decimals", F.when(F.col("token") == NATIVE, NATIVE_DECIMALS)))
