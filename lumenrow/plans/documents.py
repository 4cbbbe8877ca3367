"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.functions import text as tx
from lumenrow.functions.patterns import strip
from lumenrow.operators import cues as ops
from lumenrow.operators import fuzzy
from lumenrow.operators import lines as ln
from lumenrow.operators.chunking import chunk_by_length
from lumenrow.operators.cleaning import clean_documents
from lumenrow.plans.base import table

BUDGET = 4000


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents with ids and chunks of 150."""
    lines = ln.explode_lines(_texts(spark, sf_dir))
    cues = lines.select("doc_id", F.col("n").alias("ord"), F.array("line").alias("lines"))
    chunks = ops.fixed_chunks(ops.text_lines(cues), 150)
    return chunks.groupBy("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no")).agg(F.count("*").alias("n_lines"), F.min("line_id").alias("first_id"), F.sum(F.length("text")).alias("chars"))


def learn_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that first lines of documents, with a page number before them, and repeated lines, behind page markers, have at least twice in all."""
    lines = ln.explode_lines(_texts(spark, sf_dir))
    repeated = ln.nonblank(lines).groupBy("doc_id", "line").agg(F.min("n").alias("n"), F.count("*").alias("times")).filter("times >= 2")
    first = ln.nonblank(lines).groupBy("doc_id").agg(F.min_by(F.struct("n", "line"), "n").alias("f")).select("doc_id", "f.n", "f.line")
    candidates = first.unionByName(repeated.select("doc_id", "n", "line")).dropDuplicates(["doc_id", "n"])
    marker = candidates.select("doc_id", (2 * F.col("n")).alias("n"), F.lit("### Page 7").alias("line"))
    numbered = candidates.select("doc_id", (2 * F.col("n") + 1).alias("n"), F.concat(F.lit("7. "), "line").alias("line"))
    return ln.learned_titles_of_all(marker.unionByName(numbered))


def sentence_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ln.sentence_islands(ln.explode_lines(_texts(spark, sf_dir)))


def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_by_length(_texts(spark, sf_dir), BUDGET)
    return chunks.select("doc_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "text", "tokens")


def useful_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).select("doc_id", tx.useful_text(F.col("text")).alias("useful"))


def noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with reader noise put behind them, and the noise taken out again."""
    lines = ln.nonblank(ln.explode_lines(_texts(spark, sf_dir)))
    noisy = F.concat(F.col("line"), F.lit(" 12 mins left in chapter 4"), F.when(F.col("n") % 2 == 0, F.lit(" 33 %")).otherwise(F.lit("")))
    return lines.select("doc_id", F.col("n").cast("bigint").alias("n"), tx.strip_reader_noise(noisy).alias("clean"))


def template_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    body = F.concat(F.lit("As {{ role }}: {{text}} ({{ unknown }})"))
    values = F.create_map(F.lit("role"), F.col("role"), F.lit("text"), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", tx.render_template(body, values).alias("prompt"), F.array_join(tx.template_variables(body), ",").alias("variables"))


def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir)
    return d.select("doc_id", F.md5(tx.html_escape(F.col("text")).cast("binary")).alias("html"), F.md5(tx.ass_escape(F.concat(F.col("text"), F.lit("\\{}"))).cast("binary")).alias("ass"))


def word_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _texts(spark, sf_dir)
    return d.select("doc_id", tx.token_count(F.col("text")).alias("tokens"), F.size(tx.sentences(F.col("text"))).cast("bigint").alias("n_sentences"), tx.ends_sentence(F.col("text")).alias("closed"))


def compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", tx.compose_prompt(F.concat("p_name", F.lit("  ")), F.when(F.col("p_size") > 20, F.col("p_type")), "divider").alias("prompt"), tx.join_fragments(F.concat("p_brand", F.when(F.col("p_size") % 2 == 0, F.lit("-")).otherwise(F.lit(""))), F.col("p_type")).alias("joined"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as paged books: every fifth line gets a page marker, number and running title before it."""
    lines = ln.explode_lines(_texts(spark, sf_dir))
    page = F.floor(F.col("n") / 5) + 20
    marked = F.when(F.col("n") % 5 == 0, F.concat(F.lit("### Page "), page.cast("string"), F.lit("\n\n"), page.cast("string"), F.lit(". The Running Title\n"), F.col("line"))).otherwise(F.col("line"))
    paged = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", marked.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    done = clean_documents(paged)
    return done.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.contains(F.col("text"), F.lit("### Page")).alias("has_marker"), F.contains(F.col("text"), F.lit("The Running Title")).alias("has_title"), "edits", "blanks", "changed")


def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines of documents, all of them, against those that repeat."""
    keys = ln.nonblank(ln.explode_lines(_texts(spark, sf_dir))).select(tx.header_key(F.col("line")).alias("title_key"))
    return fuzzy.near_titles(keys.groupBy("title_key").agg(F.lit(True).alias("candidate"), (F.count("*") >= 2).alias("learned")))


def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, kept by a stream over the events table."""
    from lumenrow.operators.tables import shared_path
    from lumenrow.streaming.upserts import latest_version, upsert_stream

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/[e]vents.parquet")
    store, checkpoint = shared_path(spark, "stream-store"), shared_path(spark, "stream-checkpoint")
    upsert_stream(stream.select("user_id", "event_id", "event_type", "value"), store, checkpoint, ["user_id"], "event_id").awaitTermination()
    return latest_version(spark, store)


CACHE_SECONDS = 5 * 86_400


def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests for their users' entries, streamed decade by decade of days through a cache of five days."""
    from lumenrow.operators.tables import shared_path
    from lumenrow.streaming.caches import cache_stream, served

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"), F.col("ts").cast("timestamp").alias("at"))
    landed, store, checkpoint = (shared_path(spark, name) for name in ("requests", "cache", "cache-checkpoint"))
    decade = F.floor(F.unix_seconds("at") / 864_000)
    for r in e.select(decade.alias("d")).distinct().orderBy("d").collect():  # as many as the stream has batches
        e.filter(decade == r["d"]).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(e.schema).parquet(landed)
        cache_stream(stream, "at", CACHE_SECONDS, store, checkpoint).awaitTermination()  # goes on where it ended
    return served(spark, store).select(F.col("key").alias("user_id"), F.col("seq").alias("event_id"), "hit", "value", "fetched")


def vector_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sizes of documents by language and source, with all subtotals."""
    d = table(spark, sf_dir, "documents")
    return d.cube("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().cast("bigint").alias("level"))


def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: events by day and type."""
    from lumenrow.streaming.upserts import event_rates as rates

    r = rates(table(spark, sf_dir, "events"), "1 day")
    return r.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def last_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of lines that are not blank."""
    n = ln.neighbours_nonblank(ln.explode_lines(_texts(spark, sf_dir)))
    return n.select("doc_id", F.col("n").cast("bigint").alias("n"), F.md5(F.col("next_text").cast("binary")).alias("next_text"), F.md5(F.col("last_text").cast("binary")).alias("last_text"))


def natural_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenrow.operators.fileplan import natural_rank

    return natural_rank(table(spark, sf_dir, "documents"), "source")


def rtl(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.concat(F.lit("  "), F.when(F.col("c_nationkey") % 2 == 0, F.lit("مرحبا ")).otherwise(F.lit("")), F.col("c_name"))
    return c.select("c_custkey", tx.force_rtl(text).alias("shown"), strip(text).alias("bare"))


QUERIES = {
    "q11_fixed_chunks": fixed_chunks, "q12_learn_titles": learn_titles, "q13_islands_sentences": sentence_islands, "q14_chunk_pack": chunk_pack, "q15_useful_text": useful_text, "q16_noise_strip": noise_strip,
    "q18_natural_sort_rank": natural_names, "q22_template_render": template_render, "q27_clean_text": clean_text, "q29_fuzzy_titles": fuzzy_titles, "q30_stream_upsert": stream_upsert,
    "q107_ttl_cache": ttl_cache,
    "q44_escapes": escapes, "q45_word_stats": word_stats, "q46_compose": compose, "q47_line_neighbours": last_lines, "q48_rtl": rtl, "ext_cube": vector_rollup, "ext_event_rates": event_rates,
}
_LINES = "lines as (select doc_id, unnest(generate_series(0, len(p) - 1)) as n, unnest(p) as line from (select doc_id, case when p[-1] = '' then p[:-2] else p end as p from (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents)))"
ENDS = r"[.!?؟。！？…][''\")\]]*$"


def _pack(pieces: str, joiner: str) -> str:
    """DuckDB for a greedy packing of a list of texts: a struct of what is done and what is open."""
    return (
        f"list_reduce(list_transform({pieces}, lambda p: {{'done': []::varchar[], 'cur': p}}), lambda a, b: "
        f"case when length(a.cur) + length({joiner}) + length(b.cur) <= {BUDGET} then {{'done': a.done, 'cur': a.cur || {joiner} || b.cur}} else {{'done': list_append(a.done, a.cur), 'cur': b.cur}} end)"
    )


#: DuckDB views up to c (doc_id, blocks): texts of one block each, split where they are beyond the budget.
SPLIT = f"""s as (select doc_id, trim(text) as block, list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?؟。！？…])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') as sentences from SOURCE where trim(coalesce(text, '')) <> ''),
        w as (select doc_id, block, flatten(list_transform(sentences, lambda s: case when length(s) > {BUDGET} then list_transform([{_pack("regexp_extract_all(s, '[^ \\t\\n\\r]+')", "' '")}], lambda z: list_append(z.done, z.cur))[1] else [s] end)) as parts from s),
        b as (select doc_id, case when length(block) <= {BUDGET} then {{'done': []::varchar[], 'cur': block}} else {_pack("parts", "' '")} end as z from w),
        c as (select doc_id, list_append(z.done, z.cur) as blocks from b)"""


ORACLES = {
    "q11_fixed_chunks": f"""with {_LINES}, k as (select *, row_number() over (partition by doc_id order by n) as r from lines)
        select doc_id, (r - 1) // 150 as chunk_no, count(*) as n_lines, 'L' || lpad(min(r)::varchar, 6, '0') as first_id, sum(length(line))::bigint as chars from k group by 1, 2""",
    "q12_learn_titles": f"""with {_LINES}, shown as (select * from lines where trim(line) <> ''), f as (select doc_id, min(n) as n, arg_min(line, n) as line from shown group by 1),
        r as (select doc_id, min(n) as n, line from shown group by doc_id, line having count(*) >= 2), c as (select doc_id, n, any_value(line) as line from (select * from f union all select * from r) group by 1, 2),
        t as (select trim(regexp_replace(line, '\\s+', ' ', 'g')) as title from c where length(trim(line)) between 2 and 90 and regexp_matches(line, '\\p{{L}}')),
        k as (select replace(lower(regexp_replace(title, '^[\\s\\p{{P}}\\p{{S}}]+|[\\s\\p{{P}}\\p{{S}}]+$', '', 'g')), 'ß', 'ss') as title_key from t)
        select title_key, count(*) as n from k where length(title_key) >= 2 group by 1 having count(*) >= 2 union all select 'page', count(distinct doc_id) from c having count(distinct doc_id) >= 2""",
    "q13_islands_sentences": f"""with {_LINES}, c as (select *, trim(line) = '' as blank, coalesce(lag((regexp_matches(rtrim(line), '{ENDS}') or trim(line) = '')::int) over (partition by doc_id order by n), 0) as closed from lines),
        g as (select *, sum(closed) over (partition by doc_id order by n) as grp from c), t as (select doc_id, grp, string_agg(trim(line), ' ' order by n) as text from g where not blank group by all)
        select doc_id, row_number() over (partition by doc_id order by grp) - 1 as group_no, text from t""",
    "q14_chunk_pack": f"""with {SPLIT.replace("SOURCE", "documents")}, d as (select doc_id, {_pack("blocks", "(chr(10) || chr(10))")} as z from c),
        e as (select doc_id, unnest(generate_series(0, len(z.done))) as chunk_no, unnest(list_append(z.done, z.cur)) as text from d)
        select *, length(text) as tokens from e""",
    "q15_useful_text": r"""with c as (select doc_id, text, length(regexp_replace(text, '\s+', '', 'g')) as n, length(text) as size, length(regexp_replace(text, '\P{L}+', '', 'g')) as letters,
          length(regexp_replace(text, '[^\p{C}]+', '', 'g')) - length(regexp_replace(text, '[^\n\r\t]+', '', 'g')) as controls from documents)
        select doc_id, n >= 20 and controls / size <= 0.02 and (size - controls) / size >= 0.90 and letters >= 10 and letters / n >= 0.25 as useful from c""",
    "q16_noise_strip": f"""with {_LINES} select doc_id, n, trim(regexp_replace(line, '\\s+', ' ', 'g')) as clean from lines where trim(line) <> ''""",
    "q18_natural_sort_rank": "with s as (select distinct source from documents) select source, row_number() over (order by regexp_extract(source, '\\d+')::int, source) as rank from s",
    "q22_template_render": "select conv_id, turn, 'As ' || role || ': ' || coalesce(text, '') || ' ({{ unknown }})' as prompt, 'role,text,unknown' as variables from conversations",
    "q30_stream_upsert": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "q107_ttl_cache": f"""with recursive r as (select user_id, event_id, event_type, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
        w as (select user_id, event_id, k, false as hit, event_type as value, t as fetched from r where k = 1
          union all select r.user_id, r.event_id, r.k, t - fetched < {CACHE_SECONDS}000000, case when t - fetched < {CACHE_SECONDS}000000 then value else event_type end, case when t - fetched < {CACHE_SECONDS}000000 then fetched else t end
          from w join r on r.user_id = w.user_id and r.k = w.k + 1)
        select user_id, event_id, hit, value, fetched from w""",
    "q44_escapes": """select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) as html,
        md5(replace(replace(replace(text || '\\{}', '\\', '\\\\'), '{', '\\{'), '}', '\\}')) as ass from documents""",
    "q45_word_stats": rf"""select doc_id, len(regexp_extract_all(text, '\S+')) as tokens,
        len(list_filter(string_split(regexp_replace(text, '([.!?؟。！？…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')) as n_sentences, regexp_matches(rtrim(text), '{ENDS}') as closed from documents""",
    "q46_compose": """select p_partkey, p_name || chr(10) || chr(10) || '---' || chr(10) || chr(10) || case when p_size > 20 then p_type else 'See the attached files.' end as prompt,
        case when p_size % 2 = 0 then p_brand || '-' || p_type else p_brand || ' ' || p_type end as joined from part""",
    "q47_line_neighbours": f"""with {_LINES}, t as (select *, nullif(trim(line), '') as shown from lines)
        select doc_id, n, md5(coalesce(first_value(shown ignore nulls) over (partition by doc_id order by n rows between 1 following and unbounded following), '')) as next_text,
        md5(coalesce(last_value(shown ignore nulls) over (partition by doc_id order by n rows between unbounded preceding and 1 preceding), '')) as last_text from t""",
    "q48_rtl": """select c_custkey, case when c_nationkey % 2 = 0 then '  ' || chr(8207) || chr(8235) || 'مرحبا ' || c_name || chr(8236) else '  ' || c_name end as shown,
        case when c_nationkey % 2 = 0 then 'مرحبا ' || c_name else c_name end as bare from customer""",
    "ext_cube": "select lang, source, count(*) as n, sum(n_chars)::bigint as chars, grouping(lang, source)::bigint as level from documents group by cube (lang, source)",
    "ext_event_rates": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2",
}
