"""Events of ASS documents: parsed by the format line they declare, clipped and written back."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Kinds of events, and the fields of one where no format line says otherwise.
KINDS = frozenset(("dialogue", "comment", "picture", "sound", "movie", "command"))
FIELDS = ("Layer", "Start", "End", "Style", "Name", "MarginL", "MarginR", "MarginV", "Effect", "Text")
#: Lines of a document that are rows at a time.
LINES = 4_096
_TIME = re.compile(r"\s*(\d+):(\d{1,2}):(\d{1,2})[.](\d{1,3})\s*")
EVENTS = "doc_id {}, line_no int, kind string, line string, lead string, fields map<string,string>, field_order array<string>, start_ms long, end_ms long"


def to_ms(stamp: str) -> int:
    m = _TIME.fullmatch(stamp)
    if not m:
        raise ValueError(f"{stamp!r} is no time")
    return (int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3])) * 1000 + int(m[4].ljust(3, "0"))


def to_stamp(ms: int) -> str:
    c = (max(ms, 0) + 5) // 10
    return f"{c // 360_000}:{c // 6000 % 60:02d}:{c // 100 % 60:02d}.{c % 100:02d}"


def events_in(lines: list[str]) -> Iterator[dict]:
    """One row for each line: an event with its fields, or a line that passes as it is."""
    inside, order = False, list(FIELDS)
    for n, line in enumerate(lines, 1):
        row = {"line_no": n, "kind": "line", "line": line, "lead": None, "fields": None, "field_order": None, "start_ms": None, "end_ms": None}
        text = line.strip()
        head, colon, rest = line.partition(":")
        kind = head.strip().casefold()
        if text[:1] == "[" and text[-1:] == "]":
            inside, order = text.casefold() == "[events]", list(FIELDS)
        elif inside and colon and kind == "format":
            named = [f.strip() for f in rest.split(",")]
            if {"start", "end"} <= {f.casefold() for f in named}:
                order = named
        elif inside and colon and kind in KINDS:
            lead = head + ":" + rest[: len(rest) - len(rest.lstrip())]
            values = rest.lstrip().split(",", len(order) - 1)
            keys = [f.casefold() for f in order]
            try:
                if len(values) != len(order):
                    raise ValueError(f"{len(order)} fields are due, {len(values)} are there")
                at = dict(zip(keys, values, strict=True))
                row |= {"kind": kind, "lead": lead, "fields": at, "field_order": keys, "start_ms": to_ms(at["start"]), "end_ms": to_ms(at["end"])}
            except (ValueError, KeyError) as wrong:
                raise ValueError(f"line {n}: {wrong}") from wrong
        yield row


def parse_events(documents: DataFrame) -> DataFrame:
    """Rows of (doc_id, lines): all lines in order, events with fields and times; a broken event fails the query."""
    kind = dict(documents.dtypes)["doc_id"]
    schema = pa.schema([("line_no", pa.int32()), ("kind", pa.string()), ("line", pa.string()), ("lead", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("field_order", pa.list_(pa.string())), ("start_ms", pa.int64()), ("end_ms", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                events = events_in(batch["lines"][at].as_py() or [])
                while rows := list(itertools.islice(events, LINES)):
                    for row in rows:
                        row["fields"] = None if row["fields"] is None else list(row["fields"].items())
                    found = pa.RecordBatch.from_pylist(rows, schema)
                    ids = pa.repeat(batch["doc_id"][at], len(rows))
                    yield pa.RecordBatch.from_arrays([ids, *found.columns], ["doc_id", *schema.names])

    return documents.select("doc_id", "lines").mapInArrow(run, EVENTS.format(kind))


def clip_events(events: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, seg_no, lines) of each segment: its events clipped and counted from its start, all other lines as they are.

    ``segments`` has doc_id, seg_no, seg_start_ms and seg_end_ms. A document without events fails the query.
    """
    from pyspark.sql import functions as F

    from lumenrow.functions.numbers import ms_to_ass

    joined = events.join(segments, "doc_id")
    start = F.greatest("start_ms", "seg_start_ms") - F.col("seg_start_ms")
    end = F.least("end_ms", "seg_end_ms") - F.col("seg_start_ms")
    event = F.col("kind") != "line"
    inside = ~event | ((F.col("end_ms") > F.col("seg_start_ms")) & (F.col("start_ms") < F.col("seg_end_ms")) & (end > start))
    value = lambda k: F.when(k == "start", ms_to_ass(start)).when(k == "end", ms_to_ass(end)).otherwise(F.try_element_at("fields", k))
    line = F.when(event, F.concat("lead", F.array_join(F.transform("field_order", value), ","))).otherwise(F.col("line"))
    rows = joined.select("doc_id", "seg_no", F.when(inside, F.struct("line_no", line.alias("line"))).alias("r"), event.alias("e"))
    listed = rows.groupBy("doc_id", "seg_no").agg(F.array_sort(F.collect_list("r")).alias("rows"), F.count_if("e").alias("events"))
    lines = F.when(F.col("events") == 0, F.raise_error(F.lit("the document has no timed events")).cast("array<string>")).otherwise(F.transform("rows", lambda r: r["line"]))
    return listed.select("doc_id", "seg_no", lines.alias("lines"))
