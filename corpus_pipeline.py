"""From raw documents to packed training sequences, in five stages.

Every stage works on all that the one before it kept, and its result is written as Parquet and read
again by the next. Rows of null id, repeated rows and rows that repeat an id go through all stages;
columns beside those of documents, whatever their names, are kept up to the last stage; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from lumenrow.llm.common import drop_path, fresh_path, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base test and the rules learned from the labels keep; null and empty texts fail the base test."""
    rules = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).filter("kept").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id; rows of null id all stay, and so does one row of each wordless text's id."""
    return near_dedup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind in brackets and n_chars counted anew where that changed a text."""
    found = secret_scan.scan_secrets(docs)
    text = F.coalesce(F.col("redacted"), F.col("doc.text"))
    length = F.when(F.col("redacted").isNotNull(), F.length("redacted").cast("long")).otherwise(F.col("doc.n_chars").cast("long"))
    new = {"text": text, "n_chars": length}
    return found.select(*(new.get(c, F.col("doc").getField(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the targets of their sources, null one of them, say; equal rows toss a coin each."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, of null and empty texts too, with the sequence and the place in it where each goes."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", filter_quality),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Weighted sampling and the tokenizer have no SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last is not None:
            drop_path(spark, last)
        last = path
    return docs
