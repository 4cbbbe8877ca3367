"""Reading order of positioned lines: margins, columns, blocks.

Lines of scans have page_id, text, x, top, bottom, height, in page units with y upward; lines of PDF
pages have page_id, page_width, page_height, text, x0, y0, x1, y1, in points with y downward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.functions.numbers import middle, span
from lumenrow.functions.patterns import strip
from lumenrow.functions.text import clean_line, join_fragments, numbered_header, useful_text
from lumenrow.operators.lines import gap_islands
from lumenrow.operators.tables import materialised

#: Fixed values, in widths or heights of a page: how far left of the main edge margins are; what a column is narrower, a full line wider than, and
#: between what edges a full line begins and ends; how far columns begin apart; the least gap between blocks, in points and heights.
MARGIN, NARROW, WIDE, WIDE_LEFT, WIDE_RIGHT, COLUMNS_APART, LEAST_GAP, GAP = 0.045, 0.58, 0.68, 0.18, 0.82, 0.20, 18.0, 0.045
#: Fixed values, in heights of a line but for the least: gaps between paragraphs of scans, in margins and in the main column.
MARGIN_GAP, MAIN_GAP, LEAST_SCAN_GAP = 3.25, 1.65, 0.025


def _page():
    return Window.partitionBy("page_id")


def main_left(lines: DataFrame) -> DataFrame:
    """(page_id, main_left): median x of lines of 24 characters or more, else of all that are not blank."""
    size = F.length(strip(F.col("text")))
    return lines.groupBy("page_id").agg(F.coalesce(F.median(F.when(size >= 24, F.col("x"))), F.median(F.when(size > 0, F.col("x")))).alias("main_left"))


def pdf_main_left(lines: DataFrame) -> DataFrame:
    """As :func:`main_left` for PDF lines, where long lines are also wide and not in the far left."""
    size = F.length(strip(F.col("text")))
    wide = (size >= 24) & (span(F.col("x0"), F.col("x1")) >= 0.25 * F.col("page_width")) & (F.col("x0") >= 0.12 * F.col("page_width"))
    return lines.groupBy("page_id").agg(F.coalesce(F.median(F.when(wide, F.col("x0"))), F.median(F.when(size > 0, F.col("x0")))).alias("main_left"))


def median_or(value: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(F.median(value), F.lit(fallback))


def scan_paragraphs(lines: DataFrame) -> DataFrame:
    """(page_id, text): margin and main lines in separate blocks, by height on the page, a blank line between."""
    shown = lines.filter(strip(F.col("text")) != "").join(main_left(lines), "page_id")
    zone = F.when(F.col("x") < F.col("main_left") - MARGIN, F.lit("margin")).otherwise(F.lit("main"))
    shown = shown.withColumn("zone", zone).withColumn("_h", F.median("height").over(_page())).withColumn("_group", F.concat_ws(":", "page_id", "zone"))
    threshold = F.greatest(F.col("_h") * F.when(F.col("zone") == "margin", MARGIN_GAP).otherwise(MAIN_GAP), F.lit(LEAST_SCAN_GAP))
    order = [F.desc("top"), F.asc("x")]
    rows = gap_islands(shown, "_group", order, -F.col("top"), -F.col("bottom"), threshold, "block")
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy("_group").orderBy(*order)))
    blocks = rows.groupBy("page_id", "zone", "block").agg(F.max("top").alias("top"), F.min("x").alias("x"), F.array_sort(F.collect_list(F.struct("_at", clean_line(F.col("text")).alias("t")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["t"]), " ")
    key = F.struct(-F.bround("top", 3), F.when(F.col("zone") == "margin", 0).otherwise(1), F.col("x"), text.alias("t"))
    return blocks.select("page_id", key.alias("b")).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["t"]), "\n\n").alias("text"))


def is_top_header(lines: DataFrame) -> Column:
    """Whether a PDF line is a numbered running title at the top of its page."""
    return (F.col("y1") <= F.greatest(F.lit(32.0), 0.07 * F.col("page_height"))) & numbered_header(F.col("text")).isNotNull()


def column_of(width: Column) -> Column:
    """``left``, ``right`` or null for a PDF line on a page of this width."""
    w = span(F.col("x0"), F.col("x1"))
    cx = middle(F.col("x0"), F.col("x1"))
    narrow = (w > 0) & (w <= NARROW * width)
    return F.when(narrow & (F.col("x1") <= 0.60 * width) & (cx <= 0.48 * width), F.lit("left")).when(narrow & (F.col("x0") >= 0.40 * width) & (cx >= 0.52 * width), F.lit("right"))


def is_full_width(width: Column) -> Column:
    return (span(F.col("x0"), F.col("x1")) >= WIDE * width) | ((F.col("x0") <= WIDE_LEFT * width) & (F.col("x1") >= WIDE_RIGHT * width))


def body_top(lines: DataFrame) -> DataFrame:
    """(page_id, body_top): the top of the first row on which both columns have a line, by page.

    ``lines`` has column, cy, y0 and tolerance. Lines meet in bins of the tolerance, so pairs of far
    rows are never made.
    """
    side = lambda name: lines.filter(F.col("column") == name)
    left = side("left").select("page_id", "tolerance", F.col("cy").alias("l_cy"), F.col("y0").alias("l_y0"), F.explode(F.array(*(F.floor(F.col("cy") / F.col("tolerance")) + d for d in (-1, 0, 1)))).alias("_bin"))
    right = side("right").select("page_id", F.col("cy").alias("r_cy"), F.col("y0").alias("r_y0"), F.floor(F.col("cy") / F.col("tolerance")).alias("_bin"))
    met = left.join(right, ["page_id", "_bin"]).filter(F.abs(F.col("l_cy") - F.col("r_cy")) <= F.col("tolerance"))
    return met.groupBy("page_id").agg(F.min(F.least("l_y0", "r_y0")).alias("body_top"))


def two_column_text(lines: DataFrame, least_lines: int = 3) -> DataFrame:
    """(page_id, text) of pages in two columns: what is above them, the left one, the right one, each by height.

    A page counts if both columns have enough lines at least a fifth of its width apart, and rows in
    common. Other pages have no row.
    """
    rows = lines.filter(strip(F.col("text")) != "").withColumn("column", column_of(F.col("page_width"))).withColumn("cy", middle(F.col("y0"), F.col("y1"))).withColumn("cx", middle(F.col("x0"), F.col("x1")))
    rows = rows.withColumn("tolerance", F.greatest(F.lit(4.0), 0.90 * F.median(span(F.col("y0"), F.col("y1"))).over(_page())))
    rows = materialised(lines.sparkSession, rows)
    sides = rows.groupBy("page_id").agg(F.count_if(F.col("column") == "left").alias("l"), F.count_if(F.col("column") == "right").alias("r"), F.median(F.when(F.col("column") == "left", F.col("cx"))).alias("lx"), F.median(F.when(F.col("column") == "right", F.col("cx"))).alias("rx"), F.max("page_width").alias("w"))
    pages = sides.filter((F.col("l") >= least_lines) & (F.col("r") >= least_lines) & (F.col("rx") - F.col("lx") >= COLUMNS_APART * F.col("w"))).select("page_id")
    placed = rows.join(pages, "page_id").join(body_top(rows), "page_id")
    above = F.col("cy") < F.col("body_top")
    bucket = F.when(above, 0).when(is_full_width(F.col("page_width")) | F.col("column").isNull(), 3).when(F.col("column") == "left", 1).otherwise(2)
    placed = placed.withColumn("bucket", bucket)
    listed = placed.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("bucket", "y0", "x0", clean_line(F.col("text")).alias("t")))).alias("parts"))
    #: within the columns an unfinished line runs on into the next, also across the column break
    def join(s: Column, p: Column) -> Column:
        open_line = ~s["t"].rlike(r"[.!?…:][\"')\]]*\z") & (s["t"] != "")
        runs_on = open_line & (p["bucket"] > 0) & (s["b"] > 0) & F.substr(p["t"], F.lit(1), F.lit(1)).rlike(r"\p{Ll}")
        text = F.when(s["t"] == "", p["t"]).when(runs_on, join_fragments(s["t"], p["t"])).otherwise(F.concat(s["t"], F.lit("\n"), p["t"]))
        return F.struct(p["bucket"].alias("b"), text.alias("t"))

    folded = F.aggregate("parts", F.struct(F.lit(0).alias("b"), F.lit("").alias("t")), join, lambda s: s["t"])
    return listed.select("page_id", folded.alias("text")).filter(useful_text(F.col("text")))


def page_layout(lines: DataFrame) -> DataFrame:
    """(page_id, text): two columns where there are, else main lines in order with captions of the left margin last.

    The lines, and the pages in columns, are computed once, as each is read for several sides of joins.
    """
    spark = lines.sparkSession
    kept = materialised(spark, lines.filter((strip(F.col("text")) != "") & ~F.coalesce(is_top_header(lines), F.lit(False))))
    columns = materialised(spark, two_column_text(kept))
    rows = kept.join(columns.select("page_id"), "page_id", "left_anti").join(pdf_main_left(kept), "page_id")
    cutoff = F.col("main_left") - MARGIN * F.col("page_width")
    side = (F.col("x0") < cutoff) & (span(F.col("x0"), F.col("x1")) < 0.45 * F.col("page_width"))
    rows = rows.withColumn("zone", side.cast("int")).withColumn("_group", F.concat_ws(":", "page_id", "zone"))
    rows = gap_islands(rows, "_group", [F.asc("y0"), F.asc("x0")], F.col("y0"), F.col("y1"), F.greatest(F.lit(LEAST_GAP), GAP * F.col("page_height")), "block")
    item = F.struct("zone", F.when(F.col("zone") == 1, F.col("block")).otherwise(0), "y0", "x0", clean_line(F.col("text")).alias("t"))
    single = rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda p: p["t"]), "\n").alias("text"))
    return columns.unionByName(single)


def needs_ocr(text: Column, images: Column, spans: Column, page_area: Column) -> Column:
    """Whether a page goes to OCR: no useful text, or a large image under an invisible or synthetic text layer.

    ``images`` is an array of areas; ``spans`` of structs (alpha, font).
    """
    large = F.exists(images, lambda a: a >= 0.60 * page_area)
    hidden = F.size(F.filter(spans, lambda s: (s["alpha"] <= 0.01) | F.lower(s["font"]).rlike("glyphless|ocr")))
    return ~F.coalesce(useful_text(text), F.lit(False)) | (large & (F.size(spans) > 0) & (hidden >= 0.80 * F.size(spans)))


def choose_page_text(pages: DataFrame) -> DataFrame:
    """Pages with ``text`` and ``source``: layout text if useful, else direct text; OCR where it was asked and gave any."""
    direct = F.when(F.coalesce(useful_text(F.col("layout_text")), F.lit(False)), F.col("layout_text")).otherwise(F.col("direct_text"))
    by_ocr = F.col("ocr_wanted") & (F.coalesce(strip(F.col("ocr_text")), F.lit("")) != "")
    return pages.withColumn("text", F.when(by_ocr, F.col("ocr_text")).otherwise(direct)).withColumn("source", F.when(by_ocr, F.lit("ocr")).otherwise(F.lit("direct")))
