"""Rounds of asking for what is still missing, with an inventory that survives the run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.operators.tables import file_system


def committed_rounds(spark: SparkSession, inventory: str) -> list[int]:
    """Rounds whose answers were written whole."""
    fs, where = file_system(spark, inventory)
    if not fs.exists(where):
        return []
    named = (found.getPath() for found in fs.listStatus(where) if found.getPath().getName().startswith("round="))
    return sorted(int(path.getName()[6:]) for path in named if fs.exists(file_system(spark, f"{path.toString()}/_SUCCESS")[1]))


def answers(spark: SparkSession, inventory: str) -> DataFrame | None:
    """All answers of committed rounds with their ``round``; None before the first."""
    paths = [f"{inventory}/round={n}" for n in committed_rounds(spark, inventory)]
    return spark.read.option("basePath", inventory).parquet(*paths) if paths else None


def run_rounds(expected: DataFrame, ask: Callable[[DataFrame, int], DataFrame], inventory: str, key: str, rounds: int = 3) -> DataFrame:
    """The last answer for each key of ``expected`` (key, .., error, round), asked for in up to ``rounds`` rounds in all runs.

    A round asks for the keys that no committed round has answered without ``error``, and is committed when all its
    answers are written. A run that is killed leaves at most one round without its mark; the next
    run asks that round again, and nothing that was answered. Keys are distinct and not null.
    """
    spark = expected.sparkSession
    for turn in range(rounds):
        if turn in committed_rounds(spark, inventory):
            continue
        known = answers(spark, inventory)
        left = expected if known is None else expected.join(known.filter("error is null").select(key), key, "left_anti")
        if left.isEmpty():
            break
        ask(left, turn).write.mode("overwrite").parquet(f"{inventory}/round={turn}")
    known = answers(spark, inventory)
    if known is None:
        return ask(expected, 0).withColumn("round", F.lit(0)).limit(0)
    last = known.groupBy(key).agg(F.max_by(F.struct(*(c for c in known.columns if c != key)), "round").alias("last"))
    return last.select(key, "last.*")
