"""Where results go: JSON manifests, texts by chunk, record stores, plans."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.operators.tables import file_system

#: The version of the form of a record store.
STORE_VERSION = 1


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Texts in folders by document and chunk, each ended by one line end."""
    rows = chunks.select("doc_id", F.format_string("%03d", F.col("chunk_no") + 1).alias("chunk"), F.trim("text").alias("value"))
    rows.write.mode("overwrite").partitionBy("doc_id", "chunk").text(path)


def write_store(records: DataFrame, path: str, order: list[str]) -> None:
    """Replace a record store at once: readers see all of the old records or all of the new ones.

    Records are sorted JSON lines in a folder of their own; the store is a small file ``store.json`` that tells the
    version and the folder, and is put in place by one rename once all records are written. A write that fails
    leaves the store as it was; folders that no store names go with the next write that succeeds.
    """
    spark = records.sparkSession
    fs, store = file_system(spark, path)
    data = f"data-{uuid.uuid4().hex}"
    records.sortWithinPartitions(*order).write.json(f"{path}/{data}")
    _, fresh = file_system(spark, f"{path}/store-{data}.json")
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps({"version": STORE_VERSION, "videos": data}).encode()))
    out.close()
    _replace(spark, fresh, file_system(spark, f"{path}/store.json")[1])
    for found in fs.listStatus(store):
        if (name := found.getPath().getName()).startswith("data-") and name != data:
            fs.delete(found.getPath(), True)


def _replace(spark: SparkSession, fresh: object, name: object) -> None:
    """Rename a file over another, which is there or not, in one step."""
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, name, options)


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The records of a store; none where there is no store or it has another version."""
    fs, where = file_system(spark, f"{path}/store.json")
    told = json.loads("".join(r[0] for r in spark.read.text(where.toString()).collect())) if fs.exists(where) else {}
    if told.get("version") != STORE_VERSION:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(f"{path}/{told['videos']}")


def append_log(messages: DataFrame, path: str, run: str, skip: tuple[str, ...] = ("Fetching detailed view counts for entries missing counts...",)) -> None:
    """Key messages of a run, without blank and known noisy ones."""
    noisy = F.lit(False)
    for part in skip:
        noisy = noisy | F.col("message").contains(part)
    messages.filter((F.trim("message") != "") & ~noisy).withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").json(path)


def write_changed(done: DataFrame, path: str) -> None:
    """Cleaned documents that differ from their originals, to a new folder."""
    done.filter("changed").write.mode("overwrite").parquet(path)
