"""Folders, texts and subtitle documents as DataFrames."""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECODED = T.StructType([T.StructField("text", T.StringType()), T.StructField("encoding", T.StringType())])
ASS_DOCUMENT = T.StructType([
    T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("newline", T.StringType()), T.StructField("trailing_newline", T.BooleanType()),
    T.StructField("encoding", T.StringType()), T.StructField("bom", T.BinaryType()),
])
#: Documents that are Python objects at a time.
SLICE = 64
#: Byte order marks and the encodings they announce.
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))


def listing(spark: SparkSession, folder: str, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """(path, dir, name, size, is_dir, modified) of the files of a folder; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder).select("path", "length", "modificationTime")
    part = lambda g: F.regexp_extract("path", r"\A(.*)/([^/]*)\z", g)
    return rows.select("path", part(1).alias("dir"), part(2).alias("name"), F.col("length").alias("size"), F.lit(False).alias("is_dir"), F.col("modificationTime").alias("modified"))


def decode_any(content: bytes) -> tuple[str, str]:
    """Text of UTF-8, with or without a mark, else of code page 1252, else of Latin-1."""
    for encoding in ("utf-8-sig", "cp1252"):
        try:
            return content.decode(encoding), "utf-8" if encoding == "utf-8-sig" else encoding
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1"), "latin-1"


def decoded(content: Column, strict: bool = False) -> Column:
    """A struct (text, encoding); in strict mode only UTF-8 counts, a mark stays, and other bytes give null."""

    @F.arrow_udf(DECODED)
    def run(values: pa.Array) -> pa.Array:
        rows = []
        for value in values.to_pylist():
            try:
                found = None if value is None else (codecs.decode(value, "utf-8"), "utf-8") if strict else decode_any(value)
            except UnicodeDecodeError:
                found = None
            rows.append(None if found is None else {"text": found[0], "encoding": found[1]})
        return pa.array(rows, pa.struct([("text", pa.string()), ("encoding", pa.string())]))

    return run(content)


def texts(spark: SparkSession, folder: str, glob: str = "*.[tT][xX][tT]", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(name, text, encoding) of readable texts, and (name, error) of the others."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    rows = rows.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("name"), decoded(F.col("content"), strict).alias("d"))
    return rows.filter("d is not null").select("name", "d.text", "d.encoding"), rows.filter("d is null").select("name", F.lit("it is not UTF-8").alias("error"))


def subtitles(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, text) of the SRT files of a folder, in any encoding."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][rR][tT]").load(folder)
    return rows.select(F.regexp_extract("path", r"([^/]*)\z", 1).alias("doc_id"), decoded(F.col("content"))["text"].alias("text"))


def read_ass(content: bytes) -> dict:
    bom, encoding = next(((m, e) for m, e in MARKS if content.startswith(m)), (b"", ""))
    body = content[len(bom) :]
    if not encoding:
        for encoding in ("utf-8", "cp1252", "latin-1"):
            try:
                body.decode(encoding)
                break
            except UnicodeDecodeError:
                continue
    text = body.decode(encoding)
    ends = re.search(r"\r\n|\n|\r", text)
    return {"lines": text.splitlines(), "newline": ends[0] if ends else "\n", "trailing_newline": text.endswith(("\n", "\r")), "encoding": encoding, "bom": bom}


def in_slices(run: Callable[..., list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """``run`` over SLICE values of each column at a time, put together, so that few documents are Python objects at once."""
    starts = range(0, max(1, len(columns[0])), SLICE)
    return pa.concat_arrays([pa.array(run(*(c.slice(at, SLICE).to_pylist() for c in columns)), kind) for at in starts])


def ass_documents(content: Column) -> Column:
    """A struct of lines, line end, last line end, encoding and mark, from which the bytes can be made again."""

    @F.arrow_udf(ASS_DOCUMENT)
    def run(values: pa.Array) -> pa.Array:
        kind = pa.struct([("lines", pa.list_(pa.string())), ("newline", pa.string()), ("trailing_newline", pa.bool_()), ("encoding", pa.string()), ("bom", pa.binary())])
        return in_slices(lambda some: [None if v is None else read_ass(v) for v in some], kind, values)

    return run(content)


def ass_bytes(document: Column, lines: Column | None = None) -> Column:
    """The bytes of a document, with other lines if given."""

    def written(d: dict | None, text: list[str]) -> bytes | None:
        return None if d is None else d["bom"] + (d["newline"].join(text) + (d["newline"] if d["trailing_newline"] else "")).encode(d["encoding"])

    @F.arrow_udf(T.BinaryType())
    def run(documents: pa.Array, shown: pa.Array) -> pa.Array:
        return in_slices(lambda some, texts: list(map(written, some, texts)), pa.binary(), documents, shown)

    return run(document, document["lines"] if lines is None else lines)
