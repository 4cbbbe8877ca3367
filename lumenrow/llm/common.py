"""What the operators of this subpackage share."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.operators.tables import materialised, shared_path

#: A word is a run of characters other than the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
ASCII_SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(frame: DataFrame) -> DataFrame:
    """``frame`` computed once and read back from the shared folder, so that lost executors lose nothing."""
    return materialised(frame.sparkSession, frame)


#: Tables in hand are in so few parts that each has about so many rows, but in LEAST_PARTS at least.
PART_ROWS, LEAST_PARTS = 4_000, 16


def fewer(frame: DataFrame, rows: int) -> DataFrame:
    """``frame``, of at most ``rows`` rows, in no more parts than these fill, by joining parts without a shuffle.

    Each part of a small table costs files in every shuffle of it and every table made of it, many times its rows.
    Large tables stay in the parts they have. What an Arrow function computes is to be cut or shuffled before: joined in
    one task, each part keeps a page of memory for such a function's input until all are done.
    """
    return frame.coalesce(max(LEAST_PARTS, math.ceil(rows / PART_ROWS)))


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` as a table in the shared folder, read again; its size is known to the planner then."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def fresh_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, name)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that was written with :func:`fresh_path`."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod ``folds`` is ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


#: A key with more than one in HOT_SHARE of the rows, and more than HOT_ROWS, is split; at most HOT_SHARE keys are.
HOT_SHARE, HOT_ROWS = 200, 200


def hot_keys(counted: DataFrame, on: str, n: str | None = None) -> dict:
    """Salts for each key that more than one in HOT_SHARE of the rows have, from computed rows, or keys with their rows in ``n``."""
    rows = F.count("*") if n is None else F.sum(n)
    total = counted.agg(rows).first()[0] or 0
    found = counted.filter(F.col(on).isNotNull()).groupBy(on).agg(rows.alias("rows")).filter(F.col("rows") > max(total / HOT_SHARE, HOT_ROWS)).collect()
    return {bytes(r[0]) if isinstance(r[0], bytearray) else r[0]: math.ceil(r[1] * HOT_SHARE / total) for r in found}


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "inner", salt_by: str | Column | None = None, counted: DataFrame | None = None, hot: dict | None = None) -> DataFrame:
    """Join rows to a table of one row a key, where a few keys may have much of ``left``.

    Rows of such keys are dealt to salts, about one for each HOT_SHARE-th of all rows, and their rows
    of ``right`` are there once for each salt: no task gets a whole key, and nothing is broadcast for it.
    Salts are hashes of the whole row, or of ``salt_by``. Hot keys are found by counting
    ``left``, which is computed then, or a computed table ``counted`` with its keys, or are given.
    """
    hot = hot_keys(left if counted is None else counted, on) if hot is None else hot
    if not hot:
        return left.join(right, on, how)
    salts = F.create_map(*(F.lit(v) for pair in hot.items() for v in pair))
    n = F.coalesce(F.try_element_at(salts, F.col(on)), F.lit(1))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*(left.columns if salt_by is None else [salt_by])), n).cast("int"))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.join(spread, [on, "_salt"], how).drop("_salt")


#: Rows that are Python objects at a time.
SLICE_ROWS = 1_000


def in_slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of Arrow batches, without copies, so that few rows at a time become Python objects."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def values_of(column: pa.Array, rows: int = SLICE_ROWS) -> Iterator:
    """The Python values of a column, made a part at a time."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()
