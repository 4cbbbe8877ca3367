"""Mixing of sources to target weights.

Sizes are summed per source, caps and weights give each source a target by water-filling, and the
ratio of target to size is the rate at which its documents repeat: floor(rate) whole copies and one
more by a coin that is a hash of seed, id, text and, among equal rows, number, so that every run
tosses alike.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.llm.common import cut, join_hot, table, word_count
from lumenrow.operators.report import ranked

WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEAT = 3
SEED = "mix-1"
#: Above so many sources, or bytes of their names, the target table is joined by shuffle, not broadcast.
BROADCAST_SOURCES = 50_000
BROADCAST_BYTES = 8 << 20


def coin(doc_id: Column, text: Column, number: Column, seed: str = SEED) -> Column:
    """A double in [0, 1) from the first 52 bits of an MD5 over seed, id and text, and from the second equal row on its number."""
    again = F.when(number > 1, number.cast("string"))
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), again)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Sources in code point order, null last, take the weights in turn. A target never passes
    ``max_repeat`` times the size of its source; what is cut there is shared again by weight, round
    by round until no source is above. Sources of no words get target and rate 0. Sources are ranked
    and summed in parts, so that any number of them may be.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = ranked(sums, [F.asc(F.col("source").isNull()), F.asc("source")], "place")
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    rows = cut(rows.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("fill", F.col("cap") / F.col("weight")))
    level, closed = float("-inf"), -1
    while True:
        open_ = F.col("fill") >= F.lit(level)
        total, capped, weight, now = rows.agg(F.sum("source_size"), F.sum(F.when(~open_, F.col("cap")).otherwise(0.0)), F.sum(F.when(open_, F.col("weight")).otherwise(0.0)), F.count_if(~open_)).first()
        if now == closed or not weight:
            break
        closed, level = now, (total - capped) / weight
    rows = rows.withColumn("target", F.least("cap", F.col("weight") * F.lit(level if weight else float("inf"))))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    return rows.select("source", "source_size", "target", rate.alias("rate"))


def _equal(columns: list[str]) -> Column:
    """Whether columns equal those of another table that have ``_of`` behind their names; nulls are equal."""
    return functools.reduce(operator.and_, (F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in columns))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, number) of each row: 1, and on among rows of equal id, text and source.

    Only such rows are moved: they are numbered within each part of the table, and each part behind
    those before it, so that rows that repeat very often are no single task.
    """
    rows = docs.select(F.struct("*").alias("doc"))
    same = [F.col("doc.doc_id").alias("_id"), F.md5(F.coalesce("doc.text", F.lit("")).cast("binary")).alias("_text"), F.col("doc.source").alias("_source")]
    repeated = cut(rows.select(*same).groupBy("_id", "_text", "_source").count().filter("count > 1").drop("count"))
    n = repeated.count()
    if not n:
        return rows.withColumn("number", F.lit(1).cast("long"))
    keyed = rows.select("doc", *same, F.spark_partition_id().alias("_part"))
    known = repeated.select(*(F.col(c).alias(f"{c}_of") for c in repeated.columns))
    known = F.broadcast(known) if n <= BROADCAST_SOURCES else known
    key = repeated.columns
    again = cut(keyed.join(known, _equal(key), "left_semi"))
    within = F.row_number().over(Window.partitionBy(*key, "_part").orderBy(F.xxhash64(F.to_json("doc"))))
    parts = again.groupBy(*key, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*(F.col(c).alias(f"{c}_of") for c in [*key, "_part"]), before.alias("_before"))
    second = again.withColumn("_within", within).join(starts, _equal([*key, "_part"])).select("doc", (F.col("_before") + F.col("_within")).alias("number"))
    return keyed.join(known, _equal(key), "left_anti").select("doc", F.lit(1).cast("long").alias("number")).unionByName(second)


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """For each document (doc, size, source_size, target, copies); ``doc`` is the whole input row as a struct.

    A null text has size 0. Rows that repeat id, text and source toss a coin each. Any further
    columns of the input, whatever their names, stay inside ``doc``. An empty table gives no rows.
    """
    targets = cut(source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, max_repeat))
    bound = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    rows = numbered(docs).select("doc", word_count(F.col("doc.text")).alias("size"), coin(F.col("doc.doc_id"), F.col("doc.text"), F.col("number"), seed).alias("coin"))
    key = lambda source: F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    if bound[0] <= BROADCAST_SOURCES and bound[1] <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(targets), F.col("doc.source").eqNullSafe(F.col("source")), "inner")
    else:
        joined = join_hot(rows.withColumn("_key", key(F.col("doc.source"))), targets.withColumn("_key", key(F.col("source"))), "_key", salt_by="coin")
    copies = F.floor("rate") + F.when(F.col("coin") < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return joined.select("doc", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The documents of the mix, each as often as its copies say, with the columns of the input."""
    planned = mix_plan(docs, **options).filter(F.col("copies") > 0)
    return planned.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`mix_plan` over all documents."""
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select(F.col("doc.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


ORACLE = r"""
with counted as (
  select *, row_number() over (partition by doc_id, coalesce(text, ''), source) as number from documents
), sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, '')) || case when number > 1 then ':' || number else '' end), 1, 13))::bigint::double / 4503599627370496.0 as coin
  from counted
), sums as (
  select source, sum(size)::bigint as source_size from sized group by source
), placed as (
  select *, row_number() over (order by source is null, source) as place from sums
), weighed as (
  select *, ((place - 1) % 3 + 1)::double as weight, source_size * 3.0::double as cap from placed
), filled as (
  select *, cap / weight as fill from weighed
), levels as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from filled window before as (order by fill, place rows between unbounded preceding and 1 preceding)
), chosen as (
  select (select arg_min(level, (fill, place)) from levels where fill >= level) as final
), targets as (
  select source, source_size, least(cap, coalesce(weight * final, cap)) as target from levels, chosen
), rates as (
  select *, case when source_size > 0 then least(target / source_size, 3.0::double) else 0.0::double end as rate from targets
)
select doc_id, size, r.source_size, r.target,
       (size * (floor(rate) + case when coin < rate - floor(rate) then 1 else 0 end))::bigint as taken,
       (floor(rate) + case when coin < rate - floor(rate) then 1 else 0 end)::bigint as copies
from sized s join rates r on s.source is not distinct from r.source
"""
