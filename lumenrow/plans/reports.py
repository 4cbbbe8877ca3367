"""Report, store and reconciliation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.functions.numbers import optional_boolean
from lumenrow.operators import reconcile, report, stores
from lumenrow.plans.base import ITEMS, items, table

RULES = report.ReportRules(min_views=50, published_after=20240101, published_before=20251231)


def popularity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of 50 views or more in two years that no error event hides, ranked."""
    every = items(spark, sf_dir)
    hidden = report.hidden_ids(every.filter("event_type = 'error'"), every.filter("event_type = 'signup'"))
    ranked = report.popularity_report(every, hidden, RULES, report.report_order())
    return ranked.select("video_id", "channel", "view_count", "published_sort_value", "rank")


def channel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.scan_stats(items(spark, sf_dir), RULES)


def report_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = items(spark, sf_dir)
    stats = report.scan_stats(every, RULES).withColumn("error", F.when(F.col("included") == 0, F.lit("nothing included")))
    return report.report_totals(stats, every)


def per_channel_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    limited = report.first_per_group(items(spark, sf_dir), "channel", [F.asc("ts"), F.asc("video_id")], 5)
    return limited.select("channel", "video_id", "ts")


def channel_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("channel_url"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("channel_url"))
    return report.channel_preview(customers, orders, 8)


def hidden_store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return stores.last_wins(turns, ["conv_id"], "turn")


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    changed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.max("l_returnflag").alias("title"))
    return stores.upsert(parts, changed, ["id"])


def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("part"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name").filter("p_size > 10")
    return report.ordered_lookup(lines, parts, "part", "seq")


def label_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    found = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, F.col("quality").cast("string")).otherwise(F.lit(" ")).alias("text"), F.col("doc_id").alias("seq"))
    return reconcile.reconcile(expected, found, "id")


def override_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("text"))
    opened = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderpriority").alias("text"))
    return reconcile.override(saved, opened, "id")


def fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    manual = table(spark, sf_dir, "labels").select("doc_id", F.lit("manual").alias("kind"))
    automatic = table(spark, sf_dir, "documents").select("doc_id", F.lit("automatic").alias("kind"))
    return reconcile.with_fallback(manual, automatic, "doc_id")


def outstanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.outstanding(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")), "id")


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("page"), "l_orderkey", "l_linenumber")
    ranges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("range_no"), (F.col("n_nationkey") + 1).alias("start_page"), (F.col("n_nationkey") * 2 + 2).alias("end_page"))
    joined = reconcile.in_ranges(pages, reconcile.validated_ranges(ranges, 60))
    return joined.groupBy("range_no").agg(F.count("*").alias("n_pages"), F.min("page").cast("bigint").alias("first_page"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.from_json("props", "struct<k:bigint>")["k"]
    return e.select("event_id", k.alias("k"), optional_boolean(k.cast("string")).alias("flag"))


def metadata_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    flat = F.create_map(F.lit("title"), F.col("p_name"), F.lit("channel"), F.col("p_brand"))
    detail = F.create_map(F.lit("title"), F.when(F.col("p_size") > 25, F.col("p_type")).otherwise(F.lit("")), F.lit("view_count"), F.col("p_size").cast("string"))
    m = report.merge_metadata(flat, detail)
    return p.select("p_partkey", *(F.try_element_at(m, F.lit(k)).alias(k) for k in ("title", "channel", "view_count")))


QUERIES = {
    "q01_popularity_report": popularity_report, "q02_channel_stats": channel_stats, "q03_per_channel_limit": per_channel_limit, "q04_hidden_store_merge": hidden_store_merge,
    "q05_ordered_lookup": ordered_lookup, "q06_reconcile": label_reconcile, "q24_json_props": json_props, "q31_report_totals": report_totals, "q32_channel_preview": channel_preview,
    "q33_store_upsert": store_upsert, "q34_override": override_values, "q35_fallback_union": fallback_union, "q36_outstanding": outstanding, "q37_page_ranges": page_ranges, "q38_metadata_merge": metadata_merge,
}

_DATED = "published_sort_value between 20240101 and 20251231"
_ENOUGH = "coalesce(view_count, 0) >= 50"
_STATS = f"stats as (select channel, count(*) as scanned, count(*) filter ({_ENOUGH} and {_DATED}) as included, count(*) filter ({_ENOUGH} and not ({_DATED})) as date_filtered, count(*) filter (view_count is null) as missing_view_count from items group by channel)"
ORACLES = {
    "q01_popularity_report": f"""with {ITEMS}
        select video_id, channel, view_count, published_sort_value,
               row_number() over (order by view_count desc, published_sort_value desc, source_order) as rank
        from items i where {_ENOUGH} and {_DATED}
          and not exists (select 1 from items h where h.event_type in ('error', 'signup') and h.video_id = i.video_id)""",
    "q02_channel_stats": f"with {ITEMS}, {_STATS} select * from stats",
    "q31_report_totals": f"""with {ITEMS}, {_STATS}
        select (select sum(scanned)::bigint from stats) as scanned, (select count(*) from stats where included = 0) as failed_channels,
               (select count(distinct video_id) from items) as distinct_items""",
    "q03_per_channel_limit": f"with {ITEMS} select channel, video_id, ts from items qualify row_number() over (partition by channel order by ts, video_id) <= 5",
    "q32_channel_preview": """select c_custkey as channel_url, count(o_orderkey) as video_count, least(count(o_orderkey), 8) as scan_size
        from customer left join orders on o_custkey = c_custkey group by c_custkey""",
    "q04_hidden_store_merge": "select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1",
    "q33_store_upsert": """with changed as (select l_partkey as id, max(l_returnflag) as title from lineitem group by 1)
        select id, title from changed union all select p_partkey, p_name from part where p_partkey not in (select id from changed)""",
    "q05_ordered_lookup": "select l_orderkey, l_linenumber, l_partkey as part, p_name, row_number() over (order by l_orderkey, l_linenumber, l_partkey) as place from lineitem join part on l_partkey = p_partkey where p_size > 10",
    "q06_reconcile": """with found as (select doc_id as id, case when toxic = 0 then quality::varchar else ' ' end as text, count(*) over (partition by doc_id) as n,
               row_number() over (partition by doc_id order by doc_id) as nth from labels), expected as (select distinct doc_id as id from documents)
        select coalesce(e.id, f.id) as id, case when e.id is null then 'unexpected' when f.id is null then 'missing' when n > 1 then 'duplicate' when trim(coalesce(text, '')) = '' then 'empty' else 'ok' end as status, text
        from expected e full join (select * from found where nth = 1) f on e.id = f.id""",
    "q34_override": """select coalesce(c_custkey, id) as id, coalesce(o.text, c_mktsegment) as text
        from customer full join (select o_custkey as id, min(o_orderpriority) as text from orders group by 1) o on c_custkey = id""",
    "q35_fallback_union": """select doc_id, 'manual' as kind from labels union all
        select doc_id, 'automatic' from documents where doc_id not in (select doc_id from labels)""",
    "q36_outstanding": "select c_custkey as id from customer where c_custkey not in (select o_custkey from orders)",
    "q37_page_ranges": """select n_nationkey as range_no, count(*) as n_pages, min(trunc(l_quantity)::bigint) as first_page
        from nation join lineitem on trunc(l_quantity)::int between n_nationkey + 1 and n_nationkey * 2 + 2 group by 1""",
    "q24_json_props": """select event_id, (props->>'$.k')::bigint as k, case when (props->>'$.k') = '0' then false else true end as flag from events""",
    "q38_metadata_merge": "select p_partkey, case when p_size > 25 then coalesce(nullif(p_type, ''), p_name) else p_name end as title, p_brand as channel, p_size::varchar as view_count from part",
}
