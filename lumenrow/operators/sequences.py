"""Long sequences without a task that holds one: running sums over a global order, blocks of one sequence, and chains.

A global order is a range partition; what its parts add up to is a small table. A sequence whose rows are
numbered is cut into blocks by number, and what a block hands on is one row. Chains in which each
row knows only the next are walked by pointer doubling, in as many rounds as their length has bits.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.operators.tables import materialised

#: Rows of one sequence in a block.
BLOCK_ROWS = 8_192
_BEFORE = (Window.unboundedPreceding, -1)
_AFTER = (1, Window.unboundedFollowing)


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``sums``, its sum over all rows before this one in one global order.

    Rows that ``order`` does not tell apart are in any order, but the same for all sums.
    """
    columns = [c for c in rows.columns if c not in sums]
    values = {f"_sum_{name}": F.coalesce(value, F.lit(0)).cast("bigint") for name, value in sums.items()}
    sorted_ = rows.withColumns(values).repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialised(rows.sparkSession, sorted_.select(*columns, *values, F.spark_partition_id().alias("_running_part"), F.monotonically_increasing_id().alias("_running_at")))
    parts = held.groupBy("_running_part").agg(*(F.sum(v).alias(v) for v in values))
    over_parts = Window.orderBy("_running_part").rowsBetween(*_BEFORE)
    starts = parts.select("_running_part", *(F.coalesce(F.sum(v).over(over_parts), F.lit(0)).alias(f"{v}_start") for v in values))
    within = Window.partitionBy("_running_part").orderBy("_running_at").rowsBetween(*_BEFORE)
    inside = held.select(*columns, "_running_part", *(F.coalesce(F.sum(v).over(within), F.lit(0)).alias(v) for v in values))
    return inside.join(F.broadcast(starts), "_running_part").select(*columns, *((F.col(f"_sum_{name}") + F.col(f"_sum_{name}_start")).alias(name) for name in sums))


def in_blocks(rows: DataFrame, number: str = "n", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` with ``_block``, by their ``number`` in their sequence."""
    return rows.withColumn("_block", F.floor(F.col(number) / block_rows).cast("bigint"))


def handed_on(rows: DataFrame, by: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None, number: str = "n") -> DataFrame:
    """``rows`` (with ``_block``) with sums of the rows before, the last value before, and the first value behind that is not null.

    All are of the row's own sequence ``by``, whatever blocks they come from; a sum over none is 0. Windows
    are over a block or over the blocks of one sequence.
    """
    sums, lasts, firsts = sums or {}, lasts or {}, firsts or {}
    block = Window.partitionBy(by, "_block").orderBy(number)
    last = lambda value: F.last(value, ignorenulls=True)
    first = lambda value: F.first(value, ignorenulls=True)
    inside = rows.withColumns(
        {f"_{k}": F.sum(v).over(block.rowsBetween(*_BEFORE)) for k, v in sums.items()} | {f"_{k}": last(v).over(block.rowsBetween(*_BEFORE)) for k, v in lasts.items()} | {f"_{k}": first(v).over(block.rowsBetween(*_AFTER)) for k, v in firsts.items()}
    )
    shown = lambda value: F.when(value.isNotNull(), F.col(number))
    whole = rows.groupBy(by, "_block").agg(
        *(F.sum(v).alias(k) for k, v in sums.items()), *(F.max_by(v, shown(v)).alias(k) for k, v in lasts.items()), *(F.min_by(v, shown(v)).alias(k) for k, v in firsts.items()), F.lit(0).alias("_none")
    )
    blocks = Window.partitionBy(by).orderBy("_block")
    carried = whole.select(
        by, "_block", *(F.sum(k).over(blocks.rowsBetween(*_BEFORE)).alias(f"_{k}_far") for k in sums),
        *(last(k).over(blocks.rowsBetween(*_BEFORE)).alias(f"_{k}_far") for k in lasts), *(first(k).over(blocks.rowsBetween(*_AFTER)).alias(f"_{k}_far") for k in firsts),
    )
    both = inside.join(carried, [by, "_block"])
    zero = F.lit(0)
    return both.select(
        *rows.columns, *((F.coalesce(f"_{k}", zero) + F.coalesce(f"_{k}_far", zero)).alias(k) for k in sums), *(F.coalesce(f"_{k}", f"_{k}_far").alias(k) for k in [*lasts, *firsts])
    )


def walked(links: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, root, step) of all ids that ``starts`` (id) reach over ``links`` (id, next), themselves at step 0.

    Each round doubles how far all ids look ahead and how far the starts have come, so there are as many
    rounds as the longest walk has bits, each of equi-joins on unique ids; nothing is walked one step at a time. Ids
    of ``links`` are distinct and not null; a walk ends at an id that is none of them, or where it comes
    to itself again.
    """
    spark = links.sparkSession
    jump = materialised(spark, links.filter("next is not null").select("id", "next"))
    here = starts.select("id", F.col("id").alias("root"), F.lit(0).cast("bigint").alias("step"))
    reach, total, found = 1, jump.count() + 1, [here]
    while reach <= total:
        # Where a walk has ended, nothing is ahead at any longer reach either: such ids are done and joined no more.
        moved = materialised(spark, here.join(jump, "id").select("id", "root", "step", "next"))
        if moved.isEmpty():
            break
        on = moved.select(F.col("next").alias("id"), "root", (F.col("step") + reach).alias("step"))
        found.append(on)
        here = moved.drop("next").unionByName(on)
        far = jump.select(F.col("id").alias("next"), F.col("next").alias("_far"))
        jump = materialised(spark, jump.join(far, "next").select("id", F.col("_far").alias("next")))
        reach *= 2
    return functools.reduce(DataFrame.unionByName, found).groupBy("id", "root").agg(F.min("step").alias("step"))
