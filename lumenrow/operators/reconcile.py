"""Reconciliation of what was expected with what came."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.functions.patterns import strip
from lumenrow.operators.report import ranked
from lumenrow.operators.tables import materialised


def reconcile(expected: DataFrame, found: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, status, text) of every key of either side: ok, missing, unexpected, duplicate or empty.

    Of duplicates the first by ``seq`` gives the text.
    """
    w = Window.partitionBy(key).orderBy("seq")
    first = found.withColumn("_n", F.count("*").over(Window.partitionBy(key))).withColumn("_at", F.row_number().over(w)).filter("_at = 1").select(key, F.col(text).alias("text"), "_n")
    both = expected.select(key, F.lit(True).alias("_expected")).distinct().join(first, key, "full_outer")
    status = (
        F.when(F.col("_expected").isNull(), F.lit("unexpected"))
        .when(F.col("_n").isNull(), F.lit("missing"))
        .when(F.col("_n") > 1, F.lit("duplicate"))
        .when(F.coalesce(strip(F.col("text")), F.lit("")) == "", F.lit("empty"))
        .otherwise(F.lit("ok"))
    )
    return both.select(key, status.alias("status"), "text")


def may_rebuild(reconciled: DataFrame) -> DataFrame:
    """One row: counts by status, and whether nothing is missing, unexpected or empty."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    counts = reconciled.agg(*(n(s) for s in ("ok", "missing", "unexpected", "duplicate", "empty")))
    return counts.withColumn("allowed", (F.col("missing") + F.col("unexpected") + F.col("empty")) == 0)


def order_differs(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys of both sides whose rank among the common ones differs, by ``seq``."""
    common = expected.select(key, F.col("seq").alias("e_seq")).join(found.select(key, F.col("seq").alias("f_seq")), key)
    e = ranked(common.select(key, "e_seq"), [F.asc("e_seq"), F.asc(key)], "e_rank")
    f = ranked(common.select(key, "f_seq"), [F.asc("f_seq"), F.asc(key)], "f_rank")
    return e.join(f, key).filter("e_rank <> f_rank").select(key, "e_rank", "f_rank")


def first_ids(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ids in order, as one array, for messages."""
    return rows.select(key).orderBy(key).limit(limit).agg(F.array_sort(F.collect_list(key)).alias("ids"))


def override(saved: DataFrame, opened: DataFrame, key: str, value: str = "text") -> DataFrame:
    """Values of both maps, those of ``opened`` first."""
    a, b = saved.select(key, F.col(value).alias("_saved")), opened.select(key, F.col(value).alias("_open"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_open", "_saved").alias(value))


def outstanding(expected: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    return expected.join(completed.select(key).distinct(), key, "left_anti")


def with_fallback(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Rows of ``first``, and those of ``second`` for keys it lacks."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def in_ranges(pages: DataFrame, ranges: DataFrame, width: int = 64) -> DataFrame:
    """Pages of each inclusive range (range_no, start_page, end_page); pages of overlapping ranges repeat.

    Ranges meet pages in bins of ``width`` pages.
    """
    bins = F.explode(F.sequence(F.floor(F.col("start_page") / width), F.floor(F.col("end_page") / width)))
    spread = ranges.filter("start_page <= end_page").withColumn("_bin", bins)
    return spread.join(pages.withColumn("_bin", F.floor(F.col("page") / width)), "_bin").filter(F.col("page").between(F.col("start_page"), F.col("end_page"))).drop("_bin")


def validated_ranges(ranges: DataFrame, total_pages: int) -> DataFrame:
    """The ranges, if all lie in 1 to ``total_pages`` and none ends before it starts; else the query fails."""
    bad = (F.col("start_page") < 1) | (F.col("start_page") > F.col("end_page")) | (F.col("end_page") > total_pages)
    return ranges.withColumn("start_page", F.when(bad, F.raise_error(F.lit("a page range is invalid")).cast("int")).otherwise(F.col("start_page")))


def all_or_nothing(plan: DataFrame, bad: Column) -> DataFrame:
    """The plan, or no rows of it if any row is bad."""
    flag = plan.agg(F.coalesce(F.max(bad.cast("int")), F.lit(0)).alias("_bad")).filter("_bad = 0")
    return plan.join(flag, how="inner").drop("_bad")


def retried(rows: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], key: str, rounds: int = 3, error: str = "error") -> DataFrame:
    """Results of ``attempt`` (rows, round) in at most so many rounds, each over what failed in the one before.

    Every round is computed once and kept; what still fails after the last one stays with its error.
    ``round`` tells when a row came.
    """
    results, left = None, rows
    for turn in range(rounds):
        done = materialised(rows.sparkSession, attempt(left, turn).withColumn("round", F.lit(turn)))
        good, bad = split_errors(done, error)
        results = good if results is None else results.unionByName(good)
        if turn + 1 == rounds or not bad.limit(1).count():
            return results.unionByName(bad)
        left = rows.join(bad.select(key), key, "left_semi")
    return rows.limit(0)


def split_errors(rows: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without and with an error."""
    failed = F.coalesce(F.col(error), F.lit("")) != ""
    return rows.filter(~failed), rows.filter(failed)
