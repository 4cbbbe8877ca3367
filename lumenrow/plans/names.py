"""Queries over names, numbers and addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.functions import numbers as nm
from lumenrow.functions import text as tx
from lumenrow.functions import urls as ur
from lumenrow.operators import fileplan
from lumenrow.plans.base import table


def parse_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    form = F.when(F.col("o_orderkey") % 4 == 0, F.concat(key, F.lit("k"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit(" 1,"), key, F.lit(" views"))).when(F.col("o_orderkey") % 4 == 2, F.concat(key, F.lit(".5M"))).otherwise(F.concat(key, F.lit(" x")))
    return o.select("o_orderkey", nm.parse_count(form).alias("views"), nm.format_count(F.col("o_orderkey")).alias("shown"))


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = F.col("event_id") % 20000
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    iso = F.concat(F.lit("PT"), h.cast("string"), F.lit("H"), m.cast("string"), F.lit("M"), r.cast("string"), F.lit("S"))
    return e.select(
        "event_id", nm.clock(s).alias("clock"), nm.iso_duration(iso).alias("iso"), nm.parse_duration(nm.clock(s)).alias("seconds"), nm.parse_cut_point(s.cast("string")).alias("cut"),
        nm.ms_to_srt(s * 37).alias("srt"), nm.srt_to_ms(nm.ms_to_srt(s * 37)).alias("srt_ms"), nm.ms_to_ass(s * 37).alias("ass"), nm.ass_to_ms(nm.ms_to_ass(s * 37)).alias("ass_ms"),
    )


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-M-d")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("none"))
    limit = nm.date_limit(text)
    return o.select("o_orderkey", limit.alias("date_limit"), nm.format_date_limit(limit).alias("shown"), nm.date_in_range(F.coalesce(limit, F.lit(0)), 19950101, None).alias("inside"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    key = F.lpad(F.col("page_id").cast("string"), 11, "a")
    forms = [F.concat(F.lit("https://youtu.be/"), key, F.lit("?t=3")), F.concat(F.lit("https://www.youtube.com/watch?list=x&v="), key), F.concat(F.lit("https://m.youtube.com/shorts/"), key, F.lit("/")), F.concat(F.lit("see "), key, F.lit(" there"))]
    url = F.element_at(F.array(*forms), (F.col("page_id") % 4 + 1).cast("int"))
    look = ur.channel_lookup(F.col("url"))
    return p.select("page_id", ur.video_id(url).alias("video"), ur.watch_url(url).alias("watch"), ur.host_of(F.col("url")).alias("host"), look["parameter"].alias("parameter"), look["value"].alias("value"))


def sidecar_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as videos, suppliers as their subtitles."""
    v = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("dir"), F.concat("n_name", F.lit(".mp4")).alias("name"))
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat("n_name", F.lit("."), F.col("s_suppkey").cast("string"), F.lit(".srt"))).otherwise(F.concat("s_name", F.lit(".ass")))
    s = joined.select(F.col("s_nationkey").cast("string").alias("dir"), name.alias("name"))
    found = fileplan.sidecars(v, s)
    return found.select("dir", "video", "subtitle", F.col("tier").cast("bigint").alias("tier"), F.col("place").cast("bigint").alias("place"))


def collision_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    listing = p.select(F.col("p_brand").alias("dir"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")).alias("name"))
    plan = listing.select("dir", F.col("name").alias("source"), tx.slug(F.regexp_replace("name", r"\d", "")).alias("destination"))
    return fileplan.with_conflicts(plan, listing)


def move_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as media files: what fits half an hour in name order."""
    o = table(spark, sf_dir, "orders")
    # Hundredths are halves rounded up as the double has them: a cast would round its shortest text, and 33.495 times 100 is below a half.
    hundredths = F.floor(F.col("o_totalprice") / 200 * 100 + 0.5)
    raw = F.when(F.col("o_orderkey") % 97 == 0, F.lit("n/a")).otherwise((hundredths.cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string"))
    media = o.select(F.col("o_custkey").alias("dir"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), raw.alias("duration_raw"))
    return fileplan.move_batch(media, 1800).select("dir", "name", "seconds", "total")


def snapshot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dir"), F.col("p_name").alias("name"))
    before = table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_brand").alias("dir"), F.col("p_name").alias("name"))
    return fileplan.new_since(before, after)


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", nm.format_bytes(F.col("n_chars") * 1000).alias("bytes"), nm.spoken_seconds(F.col("n_chars")).alias("spoken"), tx.slug(F.concat("lang", F.lit(" -- "), "source")).alias("slug"), tx.safe_stem(F.concat(F.lit("."), "source", F.lit(" x:"), "lang", F.lit("_"))).alias("stem"))


QUERIES = {
    "q19_parse_counts": parse_counts, "q20_durations": durations, "q21_urls": addresses, "q25_sidecar_match": sidecar_match, "q26_collision_plan": collision_plan,
    "q49_date_limits": dates, "q50_move_batches": move_batches, "q51_snapshot_difference": snapshot_difference, "q52_sizes": sizes,
}
_S = "s as (select event_id, event_id % 20000 as s from events)"
_CLOCK = "case when s >= 3600 then format('{}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60) else format('{}:{:02d}', s // 60, s % 60) end"
ORACLES = {
    "q19_parse_counts": """select o_orderkey, case o_orderkey % 4 when 0 then o_orderkey * 1000 when 1 then ('1' || o_orderkey)::bigint when 2 then ((o_orderkey || '.5')::double * 1e6)::bigint else null end as views,
        format('{:,}', o_orderkey) as shown from orders""",
    "q20_durations": f"""with {_S} select event_id, {_CLOCK} as clock, {_CLOCK} as iso, s as seconds, s * 60.0::double as cut,
        format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', s * 37 // 3600000, s * 37 // 60000 % 60, s * 37 // 1000 % 60, s * 37 % 1000) as srt, s * 37 as srt_ms,
        format('{{}}:{{:02d}}:{{:02d}}.{{:02d}}', (s * 37 + 5) // 10 // 360000, (s * 37 + 5) // 10 // 6000 % 60, (s * 37 + 5) // 10 // 100 % 60, (s * 37 + 5) // 10 % 100) as ass, (s * 37 + 5) // 10 * 10 as ass_ms from s""",
    "q49_date_limits": """with d as (select o_orderkey, case when o_orderkey % 3 = 2 then null else strftime(o_orderdate, '%Y%m%d')::int end as date_limit from orders)
        select *, substr(date_limit::varchar, 1, 4) || '-' || substr(date_limit::varchar, 5, 2) || '-' || substr(date_limit::varchar, 7, 2) as shown, coalesce(date_limit >= 19950101, false) as inside from d""",
    "q21_urls": r"""with p as (select page_id, url, lpad(page_id::varchar, 11, 'a') as k, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host,
          list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as parts from pages)
        select page_id, k as video, case when page_id % 4 = 3 then 'see ' || k || ' there' else 'https://www.youtube.com/watch?v=' || k end as watch, host,
          case when len(parts) = 0 then null when parts[1] = 'channel' and len(parts) > 1 then 'id' when parts[1] = 'user' and len(parts) > 1 then 'forUsername' else 'forHandle' end as parameter,
          case when len(parts) = 0 then null when parts[1] in ('channel', 'user') and len(parts) > 1 then parts[2] when parts[1][1] = '@' then parts[1] else '@' || parts[1] end as value from p""",
    "q25_sidecar_match": """with v as (select n_nationkey::varchar as dir, n_name || '.mp4' as video, n_name from nation),
        s as (select s_nationkey::varchar as dir, case when s_suppkey % 3 = 0 then n_name || '.' || s_suppkey || '.srt' else s_name || '.ass' end as subtitle from supplier join nation on s_nationkey = n_nationkey),
        j as (select dir, video, subtitle, case when subtitle = n_name || '.srt' then 0 when starts_with(subtitle, n_name || '.') then 1 else 2 end::bigint as tier from v join s using (dir))
        select *, row_number() over (partition by dir, video order by tier, lower(subtitle), subtitle) as place from j""",
    "q26_collision_plan": r"""with l as (select p_brand as dir, p_name || ' ' || p_size as name from part),
        p as (select dir, name as source, coalesce(nullif(trim(regexp_replace(lower(trim(regexp_replace(name, '\d', '', 'g'))), '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'theme') as destination from l)
        select dir, source, destination, count(*) over (partition by dir, destination) > 1 or exists (select 1 from l where l.dir = p.dir and l.name = p.destination) as conflict from p""",
    "q50_move_batches": """with m as (select o_custkey as dir, o_orderkey as k, 'f' || o_orderkey as name, case when o_orderkey % 97 = 0 then null else round_even((o_totalprice / 200)::decimal(18,2)::double, 0)::bigint end as sec from orders),
        r as (select *, case when sec > 0 then sec end as seconds from m),
        t as (select *, (sum(coalesce(seconds, 0)) over w)::bigint as total, row_number() over w as pos from r window w as (partition by dir order by k)),
        z as (select *, coalesce(min(pos) filter (total > 1800) over (partition by dir), 2147483647) as stop, coalesce(min(pos) filter (seconds is null) over (partition by dir), 2147483647) as broken from t)
        select dir, name, seconds, total from z where (pos < stop and broken > stop) or (stop = 2147483647 and broken = 2147483647)""",
    "q51_snapshot_difference": "select p_brand as dir, p_name as name from part a where not exists (select 1 from part b where b.p_size <= 25 and b.p_brand = a.p_brand and b.p_name = a.p_name)",
    "q52_sizes": """with d as (select doc_id, n_chars as c, n_chars * 1000.0::double as b, lang, source from documents)
        select doc_id, case when c is null or c = 0 then '?' when b < 1024 then format('{:.1f} B', b) when b / 1024 < 1024 then format('{:.1f} KiB', b / 1024) when b / 1048576 < 1024 then format('{:.1f} MiB', b / 1048576) else format('{:.1f} GiB', b / 1073741824) end as bytes,
          case when c is null then '?' when c >= 3600 then format('{}h {:02d}m {:02d}s', c // 3600, c // 60 % 60, c % 60) when c >= 60 then format('{}m {:02d}s', c // 60, c % 60) else format('{}s', c) end as spoken,
          lang || '_' || source as slug, source || '_x_' || lang as stem from d""",
}
