"""Popularity reports: thresholds, dates, hidden items, ranking, limits and scan statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.functions.numbers import date_in_range


@dataclass(frozen=True)
class ReportRules:
    """Least views, and inclusive YYYYMMDD bounds on publication."""

    min_views: int = 0
    published_after: int | None = None
    published_before: int | None = None

    def enough_views(self, views: Column) -> Column:
        return F.coalesce(views, F.lit(0)) >= self.min_views

    def in_dates(self, published: Column) -> Column:
        return date_in_range(published, self.published_after, self.published_before)


def hidden_ids(*stores: DataFrame, key: str = "video_id") -> DataFrame:
    """Distinct ids of any store."""
    return reduce(DataFrame.unionByName, (s.select(key) for s in stores)).distinct()


def without_hidden(items: DataFrame, hidden: DataFrame, key: str = "video_id") -> DataFrame:
    """Items that no store hides. The join is an anti join, so ids of hidden items may repeat."""
    return items.join(hidden.select(key), key, "left_anti")


def report_order(views: str = "view_count", published: str = "published_sort_value", position: str = "source_order", *ties: str) -> list[Column]:
    return [F.desc(views), F.desc(published), F.asc(position), *map(F.asc, ties)]


def ranked(items: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """With 1-based positions in one global order.

    Rows are range-partitioned and sorted first; each partition then numbers its own rows and adds the
    rows of those before it, so that no single task holds all rows.
    """
    spark = items.sparkSession
    columns = items.columns
    cut = items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    from lumenrow.operators.tables import materialised

    held = materialised(spark, cut)
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return held.join(F.broadcast(starts), "_part").select(*columns, (F.col("_before") + F.col("_at") - F.col("_low") + 1).cast("bigint").alias(name))


def popularity_report(items: DataFrame, hidden: DataFrame, rules: ReportRules, order: list[Column], key: str = "video_id", views: str = "view_count", published: str = "published_sort_value") -> DataFrame:
    """Items that pass the rules and are not hidden, ranked; duplicates across channels stay."""
    kept = items.filter(rules.enough_views(F.col(views)) & rules.in_dates(F.col(published)))
    return ranked(without_hidden(kept, hidden, key), order)


def scan_stats(items: DataFrame, rules: ReportRules, channel: str = "channel", views: str = "view_count", published: str = "published_sort_value") -> DataFrame:
    """For each channel: rows scanned, included by both filters, dropped by date, and without a count.

    ``included`` does not know of hidden items.
    """
    enough, dated = rules.enough_views(F.col(views)), rules.in_dates(F.col(published))
    return items.groupBy(channel).agg(
        F.count("*").alias("scanned"),
        F.count_if(enough & dated).alias("included"),
        F.count_if(enough & ~dated).alias("date_filtered"),
        F.count_if(F.col(views).isNull()).alias("missing_view_count"),
    )


def report_totals(stats: DataFrame, items: DataFrame, key: str = "video_id") -> DataFrame:
    """One row: rows scanned, channels that failed, distinct items."""
    totals = stats.agg(F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned"), F.count_if(F.col("error").isNotNull() & (F.col("error") != "")).alias("failed_channels"))
    return totals.join(items.agg(F.countDistinct(key).alias("distinct_items")))


def first_per_group(items: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group; the window limit is pushed below the shuffle."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return items.withColumn("_at", at).filter(F.col("_at") <= limit).drop("_at")


def channel_preview(channels: DataFrame, items: DataFrame, limit: int | None) -> DataFrame:
    """For each channel its current count and how many a scan would read."""
    counts = items.groupBy("channel_url").agg(F.count("*").alias("video_count"))
    joined = channels.join(counts, "channel_url", "left").withColumn("video_count", F.coalesce("video_count", F.lit(0)))
    scan = F.col("video_count") if limit is None else F.least("video_count", F.lit(limit).cast("bigint"))
    return joined.withColumn("scan_size", scan)


def ordered_lookup(ids: DataFrame, details: DataFrame, key: str, seq: str | None = None) -> DataFrame:
    """Details of the ids that have any; repeated ids repeat.

    A table has no order of its own: with ``seq``, a column of ``ids``, rows get their ``place`` from 1
    in the order of it, counted over those that have details.
    """
    found = ids.join(details, key, "inner")
    return found if seq is None else ranked(found, [F.asc(seq)], "place").drop(seq)


def cached_details(items: DataFrame, cache: DataFrame, now: float, ttl_seconds: float = 30 * 86400.0) -> DataFrame:
    """Items with the metadata of cache rows that are young enough and have a view count, else null."""
    fresh = F.col("fetched_at").isNotNull() & (F.lit(now) - F.col("fetched_at") <= ttl_seconds) & F.try_element_at("metadata", F.lit("view_count")).isNotNull()
    return items.join(cache, "video_id", "left").withColumn("metadata", F.when(fresh, F.col("metadata"))).drop("fetched_at")


def merge_metadata(flat: Column, detail: Column) -> Column:
    """Two string maps in one: values of ``detail`` win where they are not empty."""
    given = F.map_filter(F.coalesce(detail, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull() & ~v.isin("", "[]", "{}"))
    rest = F.map_filter(F.coalesce(flat, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(rest, given)


#: Metadata that a cache keeps.
CACHED_KEYS = ("id", "title", "channel", "uploader", "view_count", "duration", "duration_string", "upload_date", "release_date", "timestamp", "release_timestamp", "modified_timestamp", "webpage_url", "original_url", "url", "thumbnail", "thumbnails", "availability")


def cacheable(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda k, v: k.isin(*CACHED_KEYS) & v.isNotNull() & ~v.isin("", "[]", "{}"))


def html_report(report: DataFrame, stats: DataFrame) -> DataFrame:
    """One row of HTML from a ranked report and its statistics, for tables that fit a page."""
    from lumenrow.functions.text import html_escape

    cell = lambda c: F.concat(F.lit("<td>"), html_escape(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>"))

    def body(frame: DataFrame, order: list[str]) -> DataFrame:
        row = F.concat(F.lit("<tr>"), *(cell(c) for c in frame.columns), F.lit("</tr>"))
        rows = frame.select(F.struct(*order, row.alias("row")).alias("r"))
        return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["row"]), "\n").alias("rows"))

    heads = lambda frame: "<tr>" + "".join(f"<th>{c}</th>" for c in frame.columns) + "</tr>"
    videos, channels = body(report, ["rank"]), body(stats, [stats.columns[0]]).withColumnRenamed("rows", "stat_rows")
    none = F.lit(f'<tr><td colspan="{len(report.columns)}">No videos met the configured minimum view count.</td></tr>')
    page = F.concat(F.lit(f"<table>{heads(report)}\n"), F.when(F.col("rows") == "", none).otherwise(F.col("rows")), F.lit(f"\n</table>\n<table>{heads(stats)}\n"), F.col("stat_rows"), F.lit("\n</table>\n"))
    return videos.join(channels).select(page.alias("html"))
