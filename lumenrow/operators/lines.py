"""Lines and paragraphs of documents: islands, look-ahead, learned running titles.

A line table has doc_id, n (from 0) and line.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenrow.functions.patterns import matches, physical_lines, strip
from lumenrow.functions.text import ends_sentence, header_key, is_page_marker, numbered_header
from lumenrow.operators.report import ranked
from lumenrow.operators.sequences import BLOCK_ROWS, handed_on, in_blocks
from lumenrow.operators.tables import materialised


def _by_line():
    """A document's lines in order."""
    return Window.partitionBy("doc_id").orderBy("n")


def explode_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, n, line) of (doc_id, text)."""
    return documents.select("doc_id", F.posexplode(physical_lines(F.coalesce("text", F.lit("")))).alias("n", "line"))


def nonblank(lines: DataFrame) -> DataFrame:
    return lines.filter(matches(F.col("line"), r"\S"))


def neighbours_nonblank(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """With the text of the next and the last line that is not blank; a document may be any number of blocks of lines."""
    shown = F.when(strip(F.col("line")) != "", strip(F.col("line")))
    held = materialised(lines.sparkSession, in_blocks(lines, "n", block_rows).withColumn("_shown", shown))
    rows = handed_on(held, "doc_id", lasts={"last_text": F.col("_shown")}, firsts={"next_text": F.col("_shown")})
    return rows.select(*lines.columns, F.coalesce("next_text", F.lit("")).alias("next_text"), F.coalesce("last_text", F.lit("")).alias("last_text"))


def first_after_marker(lines: DataFrame, marker: Column | None = None) -> DataFrame:
    """The first line that is not blank behind each page marker, even if it is a marker itself."""
    is_marker = is_page_marker(F.col("line")) if marker is None else marker
    kept = nonblank(lines).withColumn("_marker", is_marker)
    return kept.withColumn("_after", F.lag("_marker").over(_by_line())).filter("_after").drop("_marker", "_after")


def titled(lines: DataFrame) -> DataFrame:
    """With page, title and the title's key for the lines that look like a numbered running title."""
    rows = lines.withColumn("_header", numbered_header(F.col("line"))).filter(F.col("_header").isNotNull())
    rows = rows.withColumn("page", F.col("_header.page")).withColumn("title", F.col("_header.title")).drop("_header")
    return rows.withColumn("title_key", header_key(F.col("title"))).filter(F.length("title_key") >= 2)


def learned_titles(lines: DataFrame, least: int = 2) -> DataFrame:
    """(doc_id, title_key, n): titles that at least ``least`` pages of one document begin with."""
    return titled(first_after_marker(lines)).groupBy("doc_id", "title_key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def learned_titles_of_all(lines: DataFrame, least: int = 2) -> DataFrame:
    """(title_key, n): titles that pages, or documents, begin with at least ``least`` times in all."""
    head = nonblank(lines).withColumn("_first", F.row_number().over(_by_line())).filter("_first = 1").drop("_first")
    candidates = first_after_marker(lines).unionByName(head).dropDuplicates(["doc_id", "n"])
    return titled(candidates).groupBy("title_key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def sentence_islands(lines: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, group_no, text): lines joined by spaces up to each that ends a sentence, or to a blank line.

    A line that is shown begins a group where the line before it ends one. What ended before a block of lines
    and how many groups began there is handed on from block to block. Lines and what is said of each are computed
    once, as every block is read for both and for what it hands on.
    """
    seen = in_blocks(lines, "n", block_rows).select("doc_id", "n", "_block", strip(F.col("line")).alias("line"), ends_sentence(F.col("line")).alias("_ends"))
    held = materialised(lines.sparkSession, seen)
    shown = F.col("line") != ""
    ended = handed_on(held, "doc_id", lasts={"_ended": F.col("_ends") | ~shown})
    begins = (shown & F.coalesce("_ended", F.lit(True))).cast("int")
    rows = handed_on(ended.withColumn("_begins", begins), "doc_id", sums={"_before": F.col("_begins")})
    rows = rows.filter(shown).withColumn("group_no", F.col("_before") + F.col("_begins") - 1)
    listed = rows.groupBy("doc_id", "group_no").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("parts"))
    return listed.select("doc_id", "group_no", F.array_join(F.transform("parts", lambda p: p["line"]), " ").alias("text"))


def paragraphs(text: Column) -> Column:
    """Stripped pieces between blank lines, without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined_up_to(pieces: Column, ends: Column, joiner: str) -> Column:
    """Texts of the pieces up to each of ``ends``, counted from 1, from the one before; each piece is read once."""
    first = lambda es, k: F.when(k == 0, F.lit(0)).otherwise(F.get(es, k - 1))
    return let(ends, lambda es: F.transform(es, lambda e, k: F.array_join(F.slice(pieces, first(es, k) + 1, e - first(es, k)), joiner)))


def safe_blocks(text: Column) -> Column:
    """Paragraphs joined until one ends a sentence; what is left open at the end joins the last block."""

    def blocks(ps: Column) -> Column:
        closes = F.filter(F.transform(ps, lambda p, i: F.when(ends_sentence(p), i + 1)), lambda i: i.isNotNull())
        n = F.size(ps)
        ends = let(closes, lambda c: F.when(n == 0, F.array().cast("array<int>")).otherwise(F.concat(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.array(n))))
        return joined_up_to(ps, ends, "\n\n")

    return let(paragraphs(text), blocks)


def gap_islands(rows: DataFrame, by: str, order: list[Column], at: Column, end: Column, threshold: Column | float, name: str = "island", block_rows: int | None = None) -> DataFrame:
    """With island numbers from 0: a new one wherever the gap from the end before passes the threshold.

    Each ``by`` is one window, right for pages and media; with ``block_rows`` rows are ranked in one
    global order first, and islands are counted in blocks of it, so that a ``by`` may hold any number.
    """
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    if block_rows is None:
        w = Window.partitionBy(by).orderBy(*order)
        return rows.withColumn("_new", F.when(at - F.lag(end).over(w) > limit, 1).otherwise(0)).withColumn(name, F.sum("_new").over(w)).drop("_new")
    placed = in_blocks(ranked(rows, [F.asc(by), *order], "_place"), "_place", block_rows)
    gaps = handed_on(placed.withColumns({"_at": at, "_end": end, "_limit": limit}), by, lasts={"_before": F.col("_end")}, number="_place")
    new = F.when(F.col("_at") - F.col("_before") > F.col("_limit"), 1).otherwise(0)
    counted = handed_on(gaps.withColumn("_new", new), by, sums={"_islands": F.col("_new")}, number="_place")
    return counted.select(*rows.columns, (F.col("_islands") + F.col("_new")).alias(name))


def learned_titles_of_folders(documents: DataFrame, least: int = 2) -> DataFrame:
    """(folder, titles): the keys that pages or documents of each folder begin with at least ``least`` times, longest first.

    ``documents`` has folder, doc_id and text; a folder without such titles has no row.
    """
    lines = documents.select(F.struct("folder", "doc_id").alias("doc_id"), F.posexplode(physical_lines(F.coalesce("text", F.lit("")))).alias("n", "line"))
    head = nonblank(lines).withColumn("_first", F.row_number().over(_by_line())).filter("_first = 1").drop("_first")
    found = titled(first_after_marker(lines).unionByName(head).dropDuplicates(["doc_id", "n"]))
    titles = found.groupBy("doc_id.folder", "title_key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    longest_first = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.when(a < b, -1).when(a > b, 1).otherwise(0))
    return titles.groupBy("folder").agg(F.array_sort(F.collect_set("title_key"), longest_first).cast(T.ArrayType(T.StringType())).alias("titles"))
