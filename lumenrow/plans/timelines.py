"""Queries over intervals, sequences and layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.operators import cues as ops
from lumenrow.operators import layout
from lumenrow.operators.cuebuilder import build_cues
from lumenrow.operators.lines import gap_islands
from lumenrow.operators.sequences import BLOCK_ROWS
from lumenrow.plans.base import CUES, cues, table

DAY = 86_400_000
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


def overlap_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = ops.trim_overlaps(cues(spark, sf_dir), order=("start_ms", "ord"))
    return trimmed.select("doc_id", "ord", "start_ms", "end_ms", F.coalesce("changed", F.lit(False)).alias("changed"))


def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.overlap_counts(cues(spark, sf_dir), order=("start_ms", "ord"))


def _days(c: DataFrame) -> DataFrame:
    """Windows of two days, a day apart, over each user's cues."""
    ends = c.groupBy("doc_id").agg(F.floor(F.min("start_ms") / DAY).alias("first"), F.floor(F.max("start_ms") / DAY).alias("last"))
    days = ends.select("doc_id", F.explode(F.sequence(F.col("first"), F.col("last"))).alias("day"))
    return days.select("doc_id", F.col("day").alias("seg_no"), (F.col("day") * DAY).alias("seg_start_ms"), ((F.col("day") + 2) * DAY).alias("seg_end_ms"))


def segment_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return ops.clip(c.drop("lines", "event_type"), _days(c), bin_ms=DAY).select("doc_id", "seg_no", "ord", "start_ms", "end_ms")


def align_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    aligned = ops.align(c.filter("event_type = 'view'"), c.filter("event_type = 'click'"), nearest_ms=6 * 3_600_000, bin_ms=DAY)
    return aligned.select("doc_id", "ord", "source_text")


def prefix_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order while their quantities add up to at most 60."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    lines = table(spark, sf_dir, "lineitem").withColumn("total", F.sum("l_quantity").over(w))
    return lines.filter("total <= 60").select("l_orderkey", "l_linenumber", "l_quantity", "total")


def gap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    rows = gap_islands(c, "doc_id", [F.asc("start_ms"), F.asc("ord")], F.col("start_ms"), F.col("end_ms"), 7 * DAY, block_rows=BLOCK_ROWS)
    return rows.select("doc_id", "ord", F.col("island").cast("bigint").alias("island"))


def window_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_totalprice") / 100).alias("total_s"))
    return ops.windows(totals, 600, 60).select("doc_id", F.col("seg_no").cast("bigint").alias("seg_no"), F.col("start_s").cast("bigint").alias("start_s"), F.round("len_s", 4).alias("len_s"))


def cut_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a track of its lines, a second for each unit, cut at one minute."""
    lines = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    end = F.sum((F.col("l_quantity") * 1000).cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = lines.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(w).alias("ord"), (end - (F.col("l_quantity") * 1000).cast("bigint")).alias("start_ms"), end.alias("end_ms"))
    parts = ops.clip(c, ops.cut_segments(c, 60_000))
    return parts.select("doc_id", F.col("seg_no").cast("bigint").alias("seg_no"), F.col("ord").cast("bigint").alias("ord"), "start_ms", "end_ms")


def srt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's cues rendered, parsed again and counted, with the rendered size."""
    c = cues(spark, sf_dir).withColumn("start_ms", F.pmod("start_ms", F.lit(DAY))).withColumn("end_ms", F.col("start_ms") + 1000)
    rendered = ops.render_srt(c, order=("start_ms", "ord"))
    back = ops.parse_srt(rendered).groupBy("doc_id").agg(F.count("*").alias("n_cues"), F.sum("start_ms").alias("sum_start_ms"))
    return rendered.select("doc_id", F.length("text").cast("bigint").alias("chars")).join(back, "doc_id")


def median_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages and their lines as positioned text: dominant left edge and median of each page."""
    l = table(spark, sf_dir, "lineitem")
    rows = l.select(F.col("l_orderkey").alias("page_id"), F.concat_ws(" ", "l_returnflag", F.repeat(F.col("l_linestatus"), F.col("l_quantity").cast("int"))).alias("text"), (F.col("l_extendedprice") / 1000).alias("x"), F.col("l_discount").alias("height"))
    return layout.main_left(rows).join(rows.groupBy("page_id").agg(layout.median_or(F.col("height"), 0.0).alias("height")), "page_id").select("page_id", F.round("main_left", 6).alias("main_left"), F.round("height", 6).alias("height"))


def body_tops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' lines in two columns by line status: the first row that both have."""
    l = table(spark, sf_dir, "lineitem")
    cy = F.col("l_orderkey").cast("double")
    rows = l.select(F.col("l_suppkey").alias("page_id"), F.when(F.col("l_linestatus") == "O", F.lit("left")).otherwise(F.lit("right")).alias("column"), cy.alias("cy"), (cy - 2).alias("y0"), F.lit(4.0).alias("tolerance"))
    return layout.body_top(rows)


def cue_builder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all conversations, a third of a second each, as cues."""
    turns = table(spark, sf_dir, "conversations")
    words = turns.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_no"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("word_no", "word"))
    at = F.row_number().over(Window.partitionBy("media_id").orderBy("seg_no", "word_no"))
    return build_cues(words.withColumn("start_s", at / 3).withColumn("end_s", (at + 1) / 3))


QUERIES = {
    "q07_overlap_trim": overlap_trim, "q08_segment_clip": segment_clip, "q09_align_nearest": align_nearest, "q10_prefix_budget": prefix_budget, "q17_gap_islands": gap_groups,
    "q23_median_layout": median_layout, "q28_cue_builder": cue_builder, "q39_overlap_counts": overlap_counts, "q40_windows": window_table, "q41_cut_parts": cut_parts, "q42_srt_documents": srt_documents, "q43_body_tops": body_tops,
}
_W = "(partition by doc_id order by start_ms, ord)"
ORACLES = {
    "q07_overlap_trim": f"""with {CUES}, n as (select *, greatest(start_ms + 1, least(end_ms, coalesce(lead(start_ms) over {_W} - 1, end_ms))) as new_end from cues)
        select doc_id, ord, start_ms, new_end as end_ms, coalesce(new_end <> end_ms, false) as changed from n""",
    "q39_overlap_counts": f"with {CUES}, n as (select *, lead(start_ms) over {_W} as nxt from cues) select doc_id, count(*) filter (end_ms > nxt) as overlaps from n group by 1",
    "q08_segment_clip": f"""with {CUES}, ends as (select doc_id, min(start_ms) // {DAY} as a, max(start_ms) // {DAY} as b from cues group by 1),
        days as (select doc_id, unnest(range(a, b + 1)) as seg_no from ends)
        select c.doc_id, seg_no, ord, greatest(start_ms, seg_no * {DAY}) - seg_no * {DAY} as start_ms, least(end_ms, (seg_no + 2) * {DAY}) - seg_no * {DAY} as end_ms
        from cues c join days d on c.doc_id = d.doc_id and end_ms > seg_no * {DAY} and start_ms < (seg_no + 2) * {DAY} and end_ms > start_ms""",
    "q09_align_nearest": f"""with {CUES}, t as (select * from cues where event_type = 'view'),
        s as (select *, row_number() over (partition by doc_id order by start_ms, end_ms, ord) as k from cues where event_type = 'click'),
        hit as (select t.doc_id, t.ord, s.k, s.line from t join s on t.doc_id = s.doc_id and least(t.end_ms, s.end_ms) - greatest(t.start_ms, s.start_ms) >= 1),
        one as (select doc_id, ord, line, min(k) as k from hit group by all),
        over_text as (select doc_id, ord, string_agg(line, ' / ' order by k) as text from one group by all),
        nxt as (select t.doc_id, t.ord, min(k) as i from t join s on t.doc_id = s.doc_id and s.end_ms > t.start_ms group by all),
        cnt as (select doc_id, max(k) as n from s group by 1),
        pos as (select t.*, coalesce(i, n + 1) as i from t left join nxt using (doc_id, ord) left join cnt on cnt.doc_id = t.doc_id),
        cand as (select p.doc_id, p.ord, s.line, abs((s.start_ms + s.end_ms) // 2 - (p.start_ms + p.end_ms) // 2) as d, s.k from pos p join s on s.doc_id = p.doc_id and s.k in (p.i - 1, p.i)),
        best as (select doc_id, ord, line from cand qualify row_number() over (partition by doc_id, ord order by d, k) = 1 and d <= {6 * 3_600_000})
        select t.doc_id, t.ord, coalesce(o.text, b.line, '') as source_text from t left join over_text o using (doc_id, ord) left join best b using (doc_id, ord)""",
    "q10_prefix_budget": "select l_orderkey, l_linenumber, l_quantity, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) as total from lineitem qualify total <= 60",
    "q17_gap_islands": f"""with {CUES}, g as (select *, case when start_ms - lag(end_ms) over {_W} > {7 * DAY} then 1 else 0 end as new from cues)
        select doc_id, ord, sum(new) over {_W}::bigint as island from g""",
    "q40_windows": """with t as (select o_orderkey as doc_id, o_totalprice / 100 as total_s from orders), s as (select *, unnest(range(0, floor(total_s)::bigint, 540)) as start_s from t where floor(total_s) >= 1)
        select doc_id, start_s // 540 as seg_no, start_s, round(least(600.0::double, total_s - start_s), 4) as len_s from s""",
    "q41_cut_parts": """with c as (select l_orderkey as doc_id, row_number() over w as ord, trunc(l_quantity * 1000)::bigint as len, (sum(trunc(l_quantity * 1000)) over (w rows unbounded preceding))::bigint as end_ms from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity)),
        cue as (select doc_id, ord, end_ms - len as start_ms, end_ms from c), l as (select doc_id, greatest(max(end_ms), 60001) as z from cue group by 1),
        seg as (select doc_id, 0::bigint as seg_no, 0::bigint as a, 60000::bigint as b from l union all select doc_id, 1, 60000, z from l)
        select c.doc_id, seg_no, ord, greatest(start_ms, a) - a as start_ms, least(end_ms, b) - a as end_ms from cue c join seg s on c.doc_id = s.doc_id and end_ms > a and start_ms < b and end_ms > start_ms""",
    "q42_srt_documents": f"""with {CUES}, c as (select doc_id, line, start_ms % {DAY} as start_ms, ord, row_number() over (partition by doc_id order by start_ms % {DAY}, ord) as k from cues)
        select doc_id, sum(length(k::varchar) + length(line) + 29 + 4)::bigint - 1 as chars, count(*) as n_cues, sum(start_ms)::bigint as sum_start_ms from c group by 1""",
    "q23_median_layout": """with r as (select l_orderkey as page_id, length(trim(l_returnflag || ' ' || repeat(l_linestatus, trunc(l_quantity)::int))) as n, l_extendedprice / 1000 as x, l_discount as height from lineitem)
        select page_id, round(coalesce(median(x) filter (n >= 24), median(x) filter (n > 0)), 6) as main_left, round(median(height), 6) as height from r group by 1""",
    "q43_body_tops": """with r as (select l_suppkey as page_id, l_linestatus = 'O' as is_left, l_orderkey::double as cy from lineitem)
        select l.page_id, min(least(l.cy, r.cy) - 2) as body_top from (select distinct * from r where is_left) l join (select distinct * from r where not is_left) r on l.page_id = r.page_id and abs(l.cy - r.cy) <= 4 group by 1""",
}
