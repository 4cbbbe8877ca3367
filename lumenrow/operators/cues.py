"""Subtitle cues as intervals: parsing, trimming, clipping, alignment and rendering.

A cue table has doc_id, ord, start_ms, end_ms (bigint) and lines (array of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.functions.numbers import middle_ms, ms_to_ass, ms_to_srt, srt_to_ms
from lumenrow.functions.patterns import pattern, physical_lines, rstrip, strip
from lumenrow.functions.text import ass_escape, ass_lines, combined_text, flat_text

STAMP = r"(\d{2}:\d{2}:\d{2},\d{3})"
TIME_LINE = rf"\s*{STAMP}\s*-->\s*{STAMP}\s*"
MODES = ("strict", "search", "lenient_sorted")


def unix_lines(text: Column) -> Column:
    """Line ends as ``\\n``, without a byte order mark at the start."""
    return F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\\A﻿+", "")


def parse_srt(documents: DataFrame, mode: str = "strict") -> DataFrame:
    """Cues of (doc_id, text) in file order.

    ``strict``: in each block between blank lines the first line that is a time range, whole; lines
    before it go, and so do blocks without one. ``search``: text may stand around the range.
    ``lenient_sorted``: after blank lines one line, the cue number, is skipped whatever it is, the next
    time line begins a cue that runs to a blank line, and cues come by start and end.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == "lenient_sorted":
        return _parse_by_line(documents)
    time_line = pattern((r"\A{}\z" if mode == "strict" else "{}").format(TIME_LINE))
    blocks = F.split(strip(unix_lines(F.col("text"))), pattern(r"\n\s*\n"))
    rows = documents.select("doc_id", F.posexplode(blocks).alias("block_no", "block"))
    lines = physical_lines(F.col("block"))
    rows = rows.withColumn("block_lines", lines)
    timed = F.filter(F.transform("block_lines", lambda x, i: F.when(x.rlike(time_line), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("at", F.get(timed, F.lit(0))).filter("at is not null")
    line = F.get("block_lines", F.col("at"))
    stamps = [srt_to_ms(F.regexp_extract(line, pattern(TIME_LINE), g)) for g in (1, 2)]
    rest = F.slice("block_lines", F.col("at") + 2, F.size("block_lines"))
    rows = rows.select("doc_id", "block_no", stamps[0].alias("start_ms"), stamps[1].alias("end_ms"), rest.alias("lines"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no")) - 1
    return rows.select("doc_id", order.cast("int").alias("ord"), "start_ms", "end_ms", "lines")


def _parse_by_line(documents: DataFrame) -> DataFrame:
    """The lenient parser: a fold over a document's lines, in one row."""
    is_time = lambda x: x.rlike(pattern(rf"\A{TIME_LINE}\z"))
    cue = "struct<start_ms:bigint,end_ms:bigint,lines:array<string>>"
    #: state: what is expected (number, time, text), the cue being read, cues that are complete
    start = F.struct(F.lit("number").alias("want"), F.lit(None).cast(cue).alias("cue"), F.array().cast(f"array<{cue}>").alias("done"))

    def close(s: Column) -> Column:
        return F.when(s["cue"].isNotNull(), F.array_append(s["done"], s["cue"])).otherwise(s["done"])

    def step(s: Column, x: Column) -> Column:
        blank = strip(x) == ""
        opened = F.struct(*(srt_to_ms(F.regexp_extract(x, pattern(TIME_LINE), g)).alias(n) for g, n in ((1, "start_ms"), (2, "end_ms"))), F.array().cast("array<string>").alias("lines"))
        longer = F.struct(s["cue"]["start_ms"].alias("start_ms"), s["cue"]["end_ms"].alias("end_ms"), F.array_append(s["cue"]["lines"], x).alias("lines"))
        state = lambda want, c, done: F.struct(F.lit(want).alias("want"), c.alias("cue"), done.alias("done"))
        none = F.lit(None).cast(cue)
        return (
            F.when((s["want"] == "number") & blank, s)
            .when(s["want"] == "number", state("time", none, s["done"]))
            .when((s["want"] == "time") & is_time(x), state("text", opened, s["done"]))
            .when(s["want"] == "time", s)
            .when(blank, state("number", none, close(s)))
            .otherwise(state("text", longer, s["done"]))
        )

    done = F.aggregate(physical_lines(F.col("text")), start, step, close)
    rows = documents.select("doc_id", F.posexplode(F.array_sort(done, lambda a, b: F.when(a["start_ms"] != b["start_ms"], a["start_ms"] - b["start_ms"]).otherwise(a["end_ms"] - b["end_ms"]).cast("int"))).alias("ord", "cue"))
    return rows.select("doc_id", "ord", "cue.start_ms", "cue.end_ms", "cue.lines")


def text_lines(cues: DataFrame) -> DataFrame:
    """(doc_id, line_id, text): each text line of the cues with the id L000001 and so on, by document; ids of more digits follow L999999."""
    rows = cues.select("doc_id", "ord", F.posexplode("lines").alias("pos", "text"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "pos"))
    return rows.select("doc_id", F.format_string("L%06d", number).alias("line_id"), "text")


def line_number(line_id: Column) -> Column:
    """The number that a line id has behind its letter; ids are ordered by it, as their texts are not beyond six digits."""
    return F.substring(line_id, 2, 18).cast("bigint")


def fixed_chunks(lines: DataFrame, size: int = 150) -> DataFrame:
    """With chunk_no from 0: every ``size`` lines of a document, by the number of line_id."""
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(line_number(F.col("line_id"))))
    return lines.withColumn("chunk_no", F.floor((number - 1) / size).cast("int"))


def trim_overlaps(cues: DataFrame, gap_ms: int = 1, min_cue_ms: int = 1, by: str = "doc_id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Cues whose ends stop before the next one starts; ``changed`` tells which did."""
    follows = F.lead("start_ms").over(Window.partitionBy(by).orderBy(*order))
    new_end = F.greatest(F.col("start_ms") + min_cue_ms, F.least("end_ms", follows - gap_ms))
    return cues.withColumn("_new_end", new_end).withColumn("changed", F.col("_new_end") != F.col("end_ms")).withColumn("end_ms", F.col("_new_end")).drop("_new_end")


def overlap_counts(cues: DataFrame, by: str = "doc_id", order: tuple[str, ...] = ("ord",)) -> DataFrame:
    """Cues that end after the next one starts, by document."""
    follows = F.lead("start_ms").over(Window.partitionBy(by).orderBy(*order))
    return cues.withColumn("_over", F.col("end_ms") > follows).groupBy(by).agg(F.count_if("_over").alias("overlaps"))


def renumber(cues: DataFrame, order: tuple[str, ...] = ("ord",)) -> DataFrame:
    return cues.withColumn("number", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)))


def windows(totals: DataFrame, duration: int, overlap: int) -> DataFrame:
    """(doc_id, seg_no, start_s, len_s) that cover ``total_s`` seconds in steps of duration less overlap."""
    if duration <= overlap:
        raise ValueError("the duration must be longer than the overlap")
    starts = F.sequence(F.lit(0), F.floor("total_s").cast("int") - 1, F.lit(duration - overlap))
    rows = totals.filter(F.floor("total_s") >= 1).select("doc_id", "total_s", F.posexplode(starts).alias("seg_no", "start_s"))
    return rows.select("doc_id", "seg_no", "start_s", F.least(F.lit(float(duration)), F.col("total_s") - F.col("start_s")).alias("len_s"))


def clip(cues: DataFrame, segments: DataFrame, on: list[str] | None = None, bin_ms: int = 600_000) -> DataFrame:
    """Cues of each segment (seg_no, seg_start_ms, seg_end_ms), clipped and counted from the segment's start.

    A cue that crosses a border is in both segments; parts of no length go. The range join is an
    equi-join on the bins of time that both touch, kept once where the later of both starts.
    """
    on = on or ["doc_id"]
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_ms), F.floor(F.greatest(b - 1, a) / bin_ms)))
    left = cues.filter("end_ms > start_ms").withColumn("_bin", bins(F.col("start_ms"), F.col("end_ms")))
    right = segments.filter("seg_end_ms > seg_start_ms").withColumn("_bin", bins(F.col("seg_start_ms"), F.col("seg_end_ms")))
    first = F.floor(F.greatest("start_ms", "seg_start_ms") / bin_ms) == F.col("_bin")
    joined = left.join(right, [*on, "_bin"]).filter((F.col("end_ms") > F.col("seg_start_ms")) & (F.col("start_ms") < F.col("seg_end_ms")) & first)
    start = F.greatest("start_ms", "seg_start_ms") - F.col("seg_start_ms")
    end = F.least("end_ms", "seg_end_ms") - F.col("seg_start_ms")
    return joined.withColumn("_start", start).withColumn("_end", end).withColumn("start_ms", F.col("_start")).withColumn("end_ms", F.col("_end")).drop("_bin", "_start", "_end", "seg_start_ms", "seg_end_ms")


def cut_segments(cues: DataFrame, cut_ms: int) -> DataFrame:
    """The two segments of each document cut at ``cut_ms``; the second ends with the last cue."""
    last = cues.groupBy("doc_id").agg(F.greatest(F.max("end_ms"), F.lit(cut_ms + 1).cast("bigint")).alias("last"))
    parts = F.array(F.struct(F.lit(0).alias("seg_no"), F.lit(0).cast("bigint").alias("a"), F.lit(cut_ms).cast("bigint").alias("b")), F.struct(F.lit(1).alias("seg_no"), F.lit(cut_ms).cast("bigint").alias("a"), F.col("last").alias("b")))
    return last.select("doc_id", F.explode(parts).alias("p")).select("doc_id", "p.seg_no", F.col("p.a").alias("seg_start_ms"), F.col("p.b").alias("seg_end_ms"))


def align(targets: DataFrame, sources: DataFrame, joiner: str = " / ", min_overlap_ms: int = 1, nearest_ms: int = 400, on: str = "doc_id", bin_ms: int = 60_000) -> DataFrame:
    """Each target cue with ``source_text``: what the source cues that overlap it say, else the nearest one.

    Texts of overlapping cues come in order, once each. Without any, of the first source that ends
    after the target starts and the one before it, the one with the nearer centre counts, within
    ``nearest_ms``, the earlier on ties. Both tracks are taken by (start, end, ord).
    """
    order = Window.partitionBy(on).orderBy("start_ms", "end_ms", "ord")
    src = sources.select(on, F.row_number().over(order).alias("s_at"), F.col("start_ms").alias("s_start"), F.col("end_ms").alias("s_end"), flat_text(F.col("lines")).alias("s_text"))
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_ms), F.floor(F.greatest(b, a) / bin_ms)))
    t = targets.select(on, "ord", "start_ms", "end_ms").withColumn("_bin", bins(F.col("start_ms"), F.col("end_ms")))
    s = src.withColumn("_bin", bins(F.col("s_start"), F.col("s_end")))
    overlap = F.least("end_ms", "s_end") - F.greatest("start_ms", "s_start")
    once = F.floor(F.greatest("start_ms", "s_start") / bin_ms) == F.col("_bin")
    hits = t.join(s, [on, "_bin"]).filter(once & (overlap >= min_overlap_ms) & (F.col("s_text") != ""))
    texts = hits.groupBy(on, "ord").agg(F.array_sort(F.collect_list(F.struct("s_at", "s_text"))).alias("hits"))
    text = F.array_join(F.array_distinct(F.transform("hits", lambda h: h["s_text"])), joiner)
    found = targets.join(texts.select(on, "ord", text.alias("_overlapping")), [on, "ord"], "left")

    #: the first source that ends after a target's start, by merging both tracks on time
    reach = src.withColumn("reach", F.max("s_end").over(Window.partitionBy(on).orderBy("s_at").rowsBetween(Window.unboundedPreceding, 0)))
    centre = middle_ms(F.col("s_start"), F.col("s_end"))
    cue = F.struct("s_at", centre.alias("centre"), F.col("s_text").alias("text"))
    before = F.lag(cue).over(Window.partitionBy(on).orderBy("s_at"))
    marks = reach.select(on, F.col("reach").alias("time"), F.lit(1).alias("kind"), "s_at", F.struct(before.alias("prev"), cue.alias("next")).alias("pair"), F.lit(None).cast("int").alias("ord"))
    last = src.groupBy(on).agg(F.max_by(cue, "s_at").alias("final"))
    asks = targets.select(on, F.col("start_ms").alias("time"), F.lit(0).alias("kind"), F.lit(None).cast("int").alias("s_at"), F.lit(None).cast(dict(marks.dtypes)["pair"]).alias("pair"), "ord")
    ahead = Window.partitionBy(on).orderBy(F.desc("time"), F.asc("kind"), F.desc("s_at")).rowsBetween(Window.unboundedPreceding, 0)
    merged = asks.unionByName(marks).withColumn("pair", F.last("pair", ignorenulls=True).over(ahead)).filter("kind = 0").select(on, "ord", "pair")
    near = found.join(merged, [on, "ord"], "left").join(last, on, "left")
    mine = middle_ms(F.col("start_ms"), F.col("end_ms"))
    prev, nxt = F.when(F.col("pair").isNull(), F.col("final")).otherwise(F.col("pair.prev")), F.col("pair.next")
    far = lambda c: F.abs(c["centre"] - mine)
    nearer = F.when(prev.isNotNull() & (nxt.isNull() | (far(prev) <= far(nxt))), prev).otherwise(nxt)
    fallback = F.when(F.lit(nearest_ms > 0) & (far(nearer) <= nearest_ms), nearer["text"])
    return near.withColumn("source_text", F.coalesce("_overlapping", fallback, F.lit(""))).drop("_overlapping", "pair", "final")


def render_srt(cues: DataFrame, order: tuple[str, ...] = ("ord",), bom: bool = False) -> DataFrame:
    """(doc_id, text): cues numbered from 1, a blank line behind each, one line end at the close."""
    shown = F.when(F.size("lines") > 0, F.array_join("lines", "\n")).otherwise(F.lit(""))
    row = F.concat_ws("\n", F.concat_ws(" --> ", ms_to_srt(F.col("start_ms")), ms_to_srt(F.col("end_ms"))), shown, F.lit(""))
    rows = cues.select("doc_id", F.struct(*order, row.alias("row")).alias("r"))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r, i: F.concat_ws("\n", (i + 1).cast("string"), r["row"])), "\n")
    return listed.select("doc_id", F.concat(F.lit("﻿" if bom else ""), rstrip(text), F.lit("\n")).alias("text"))


#: The head of an ASS document with a default and a banner style.
ASS_HEAD = (
    "[Script Info]\nScriptType: v4.00+\nCollisions: Normal\nScaledBorderAndShadow: yes\nPlayResX: 1920\nPlayResY: 1080\nWrapStyle: 0\n\n"
    "[V4+ Styles]\nFormat: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    "Style: Default,Arial,84,&H00FF00B4,&H00FF00B4,&H00000000,&H00000000,1,0,0,0,100,100,0,0,1,6,0,2,70,70,55,1\n"
    "Style: ModelTop,Arial,84,&H0000D5FF,&H0000D5FF,&H00000000,&H00000000,1,0,0,0,100,100,0,0,1,6,0,8,70,70,55,1\n\n"
    "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
)


def render_ass(cues: DataFrame, model_text: str = "", tail_ms: int = 60_000, empty_end_ms: int = 1) -> DataFrame:
    """(doc_id, text): one dialogue for each cue with text, and a banner over the last minute.

    Cues with a source_text column show it below the target. Where no cue has text the banner ends at
    ``empty_end_ms``.
    """
    body = combined_text(F.col("lines"), F.col("source_text")) if "source_text" in cues.columns else ass_lines(F.col("lines"))
    line = F.concat(F.lit("Dialogue: 0,"), ms_to_ass(F.col("start_ms")), F.lit(","), ms_to_ass(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), body)
    shown = cues.withColumn("_text", ass_lines(F.col("lines")))
    rows = shown.select("doc_id", F.when(F.col("_text") != "", F.struct("start_ms", "end_ms", "ord", line.alias("line"))).alias("r"))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rows"), F.coalesce(F.max("r.end_ms"), F.lit(0)).alias("last"))
    last = F.when(F.col("last") <= 0, F.lit(empty_end_ms).cast("bigint")).otherwise(F.col("last"))
    banner = F.concat(F.lit("Dialogue: 10,"), ms_to_ass(F.greatest(F.lit(0).cast("bigint"), last - tail_ms)), F.lit(","), ms_to_ass(last), F.lit(",ModelTop,,0,0,0,,"), ass_escape(F.lit(model_text.strip())))
    lines = F.transform("rows", lambda r: r["line"])
    lines = F.array_append(lines, banner) if model_text.strip() else lines
    return listed.select("doc_id", F.concat(F.lit(ASS_HEAD), F.array_join(lines, "\n"), F.lit("\n")).alias("text"))


def rebuild(lines: DataFrame, translations: DataFrame) -> DataFrame:
    """Lines with the k-th translation of their document in place of the k-th text; null where there are too few."""
    at = Window.partitionBy("doc_id")
    numbered = lines.withColumn("_k", F.row_number().over(at.orderBy(line_number(F.col("line_id")))))
    given = translations.select("doc_id", F.row_number().over(at.orderBy("seq")).alias("_k"), F.col("text").alias("translation"))
    return numbered.join(given, ["doc_id", "_k"], "left").drop("_k")
