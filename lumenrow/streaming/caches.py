"""A cache with a time to live over a stream of requests.

The state of a key is its entry; the entries of a bucket of keys are held as one value, so that a batch calls Python
and asks the state store once a bucket and not some times a key. A request within the entry's time is served by it; one that finds none, or
one too old, is fetched and becomes the entry. An event-time timer lets entries go once the watermark is past
their time, so state holds only keys that were asked for lately. Results are the same however the stream is
cut into batches, as long as no row is later than the watermark allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lumenrow.operators.tables import materialised

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Entries in a file of the store, as the cache is saved once for so many new ones.
FLUSH = 100
#: Buckets that keys are dealt to; those of a store that has begun do not change.
BUCKETS = 1_024
SERVED = "key {key}, seq long, at long, hit boolean, value string, fetched long"


class CacheEntries(StatefulProcessor):
    """Requests (id, key, seq, at, value) of a bucket of keys, served; times are microseconds."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "ids array<string>, values array<string>, fetched array<bigint>")

    def _known(self) -> dict[str, tuple[str | None, int]]:
        """The entry (value, fetched) of each key."""
        ids, values, fetched = self.entries.get() if self.entries.exists() else ((), (), ())
        return dict(zip(ids, zip(values, fetched, strict=True), strict=True))

    def _keep(self, known: dict[str, tuple[str | None, int]]) -> None:
        if known:
            self.entries.update((list(known), [value for value, _ in known.values()], [since for _, since in known.values()]))
        else:
            self.entries.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values(["id", "at", "seq"], kind="stable")
        ids, at, values = asked["id"].to_numpy(object), asked["at"].to_numpy(np.int64), asked["value"].to_numpy(object)
        fetched, served, hit = np.empty(len(at), np.int64), np.empty(len(at), object), np.ones(len(at), bool)
        known = self._known()
        bounds = np.append(np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), len(ids))
        for done, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            one, times = ids[done], at[:end]
            value, since = known.get(one, (None, None))
            while done < end:
                if since is None or at[done] - since >= self.ttl:
                    value, since, hit[done] = values[done], int(at[done]), False
                until = max(done + 1, done + int(np.searchsorted(times[done:], since + self.ttl)))
                fetched[done:until], served[done:until] = since, value
                done = until
            known[one] = value, since
        self._keep(known)
        # One timer a batch: every entry of now is past its time when the latest is.
        self.handle.registerTimer((max(since for _, since in known.values()) + self.ttl) // 1000 + 1)
        yield pd.DataFrame({"key": asked["key"].to_numpy(), "seq": asked["seq"].to_numpy(), "at": at, "hit": hit, "value": served, "fetched": fetched})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        self._keep({one: entry for one, entry in self._known().items() if entry[1] + self.ttl > now})
        return iter(())

    def close(self) -> None:
        pass


def _named(key: Column, kind: str) -> Column:
    """A key as text that tells it from all others, as grouping does."""
    if kind in ("float", "double"):
        return (key + F.lit(0.0)).cast("string")
    if kind == "timestamp":
        return F.unix_micros(key).cast("string")
    if kind == "binary":
        return F.hex(key)
    return F.to_json(F.struct(key)) if kind.startswith(("array", "struct")) else key.cast("string")


def served_stream(requests: DataFrame, time: str, ttl_seconds: int, late: str = "0 seconds") -> DataFrame:
    """Requests (key, seq, value, and a timestamp ``time``) of a stream, each with whether the cache had it, what it served and from when that is.

    Rows of null key or time, and rows ``late`` behind, are dropped; equal times go by ``seq``.
    """
    kind = dict(requests.dtypes)["key"]
    rows = requests.filter(F.col("key").isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.col(time).alias("_time"), "key", _named(F.col("key"), kind).alias("id"), F.col("seq").cast("long").alias("seq"), F.unix_micros(time).alias("at"), F.col("value").cast("string").alias("value")).withWatermark("_time", late)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int"))
    return rows.groupBy("_bucket").transformWithStateInPandas(CacheEntries(ttl_seconds * 1_000_000), SERVED.format(key=kind), "Append", "EventTime")


def cache_stream(requests: DataFrame, time: str, ttl_seconds: int, store: str, checkpoint: str, late: str = "0 seconds", flush: int = FLUSH):
    """Start a query that serves a stream of requests from a cache, and keeps what it served and each new entry under ``store``.

    A batch writes folders of its own, entries ``flush`` a file, so that a batch that is run again after a
    failure replaces what it had written.
    """
    spark = requests.sparkSession

    def save(batch: DataFrame, batch_id: int) -> None:
        served = materialised(spark, batch)
        served.write.mode("overwrite").parquet(f"{store}/served/batch={batch_id}")
        served.filter("not hit").select("key", "value", "fetched").write.mode("overwrite").option("maxRecordsPerFile", flush).parquet(f"{store}/entries/batch={batch_id}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        return served_stream(requests, time, ttl_seconds, late).writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)


def served(spark: SparkSession, store: str) -> DataFrame:
    """What a cache has served so far."""
    return spark.read.option("basePath", f"{store}/served").parquet(f"{store}/served").drop("batch")


def live_entries(spark: SparkSession, store: str, now: int, ttl_seconds: int) -> DataFrame:
    """The newest entry of each key that is still fresh at ``now``, in microseconds."""
    entries = spark.read.parquet(f"{store}/entries").groupBy("key").agg(F.max("fetched").alias("fetched"), F.max_by("value", "fetched").alias("value"))
    return entries.filter(F.col("fetched") > now - ttl_seconds * 1_000_000)
