"""Shared inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as published items: the user is the channel, the value its views."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("video_id"), F.col("user_id").alias("channel"), F.col("value").alias("view_count"),
        F.date_format("ts", "yyyyMMdd").cast("int").alias("published_sort_value"), F.col("event_id").alias("source_order"), "event_type", "ts",
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cues of their user: from their time, for a minute of each unit of value."""
    e = table(spark, sf_dir, "events")
    start = F.expr("unix_millis(cast(ts as timestamp))")
    return e.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), start.alias("start_ms"),
        (start + (F.col("value") * 60000).cast("bigint")).alias("end_ms"), F.array(F.concat_ws(" ", "event_type", F.col("event_id").cast("string"))).alias("lines"), "event_type",
    )


#: DuckDB view of :func:`items` and :func:`cues`.
ITEMS = "items as (select event_id as video_id, user_id as channel, value as view_count, strftime(ts, '%Y%m%d')::int as published_sort_value, event_id as source_order, event_type, ts from events)"
CUES = "cues as (select user_id as doc_id, event_id as ord, epoch_us(ts) // 1000 as start_ms, epoch_us(ts) // 1000 + trunc(value * 60000)::bigint as end_ms, event_type || ' ' || event_id as line, event_type from events)"
