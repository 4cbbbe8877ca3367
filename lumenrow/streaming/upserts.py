"""Streams: hidden items upserted as they come, cues from timed words, rates of events."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenrow.operators.cuebuilder import CueBuilder
from lumenrow.operators.stores import last_wins
from lumenrow.operators.tables import file_system, materialised


def _versions(spark: SparkSession, store: str, batch_id: int) -> dict[str, int]:
    """Of each bucket of a store the batch that wrote it last, as the index of ``batch_id`` tells."""
    fs, where = file_system(spark, f"{store}/index-{batch_id}.json")
    if not fs.exists(where):
        return {}
    return json.loads("".join(r[0] for r in spark.read.text(where.toString()).collect()))


def upsert_stream(events: DataFrame, store: str, checkpoint: str, keys: list[str], seq: str, buckets: int = 64):
    """Start a query that keeps the last row of each key of a stream, in Parquet files by bucket of the key under ``store``.

    A batch rewrites only the buckets it has keys of, into a folder of its own, and then an index of
    which folder holds which bucket; folders that neither it nor the last index names go. A batch
    that is run again starts from the index before it, so that retries lose and repeat nothing.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        fresh = materialised(spark, batch.withColumn("bucket", bucket))
        touched = {str(r[0]) for r in fresh.select("bucket").distinct().collect()}
        known = _versions(spark, store, batch_id - 1)
        old = [f"{store}/version={v}/bucket={b}" for b, v in known.items() if b in touched]
        rows = fresh.unionByName(spark.read.option("basePath", store).parquet(*old).select(fresh.columns)) if old else fresh
        if touched:
            last_wins(rows, [*keys, "bucket"], seq).write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/version={batch_id}")
        now = known | dict.fromkeys(touched, batch_id)
        fs, where = file_system(spark, f"{store}/index-{batch_id}.json")
        out = fs.create(where, True)
        out.write(bytearray(json.dumps(now).encode()))
        out.close()
        for v in set(_versions(spark, store, batch_id - 2).values()) - set(known.values()) - set(now.values()):
            fs.delete(file_system(spark, f"{store}/version={v}")[1], True)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, store: str) -> DataFrame:
    """The store as its newest index tells."""
    fs, folder = file_system(spark, store)
    newest = max(int(name[6:-5]) for f in fs.listStatus(folder) if (name := f.getPath().getName()).startswith("index-"))
    paths = [f"{store}/version={v}/bucket={b}" for b, v in sorted(_versions(spark, store, newest).items())]
    return spark.read.option("basePath", store).parquet(*paths).drop("version", "bucket")


def stream_cues(words: DataFrame, idle_ms: int = 60_000) -> DataFrame:
    """Cues of a stream of words (media_id, seg_no, word_no, word, start_s, end_s), each as soon as it is complete.

    A medium that is idle for ``idle_ms`` gives what still waits.
    """
    kind = dict(words.dtypes)["media_id"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, start, end, number = state.get if state.exists else ([], 0.0, 0.0, 0)
        builder = CueBuilder(list(waiting), start, end)
        found: list[tuple[float, float, str]] = []
        if state.hasTimedOut:
            found = builder.flush()
            state.remove()
        else:
            rows = pd.concat(list(frames)).sort_values(["seg_no", "word_no"])
            for word_no, word, a, b in rows[["word_no", "word", "start_s", "end_s"]].itertuples(index=False):
                found += builder.add_segment(word, a, b) if pd.isna(word_no) else builder.add(word, a, b)
            state.update((builder.waiting, builder.start, builder.end, number + len(found)))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], number + i, *c) for i, c in enumerate(found)], columns=["media_id", "cue_no", "start_s", "end_s", "text"])

    return words.groupBy("media_id").applyInPandasWithState(
        run, f"media_id {kind}, cue_no int, start_s double, end_s double, text string", "waiting array<string>, start double, end double, number int", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def event_rates(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events (ts, event_type, value) by window and type, of a stream or a table.

    Rows later than the watermark are dropped by a stream; a table has no watermark.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    rows = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
