"""Chat formatting by incremental black-box rendering.

A template only has to render a list of turns to a string. Rendering each successive prefix and
comparing it with the one before locates the characters each turn adds; a render that does not start
with the former one shows that the template rewrites history. Loss spans and texts are then read back
from the rendered string alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.llm.common import in_slices, table

Turn = tuple[str, str]

#: What opens and closes a turn, and the strings that need a backslash inside texts and roles.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before each ``\\``, ``#``, ``<`` and ``:``, so that no control string is left whole."""
    return _CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render_marked(turns: Iterable[Turn]) -> str:
    """``### role: text</turn>`` and a line break for each turn, role and text escaped."""
    return "".join(f"{OPEN}{escape(role)}{MIDDLE}{escape(text)}{CLOSE}" for role, text in turns)


def read_marked(span: str) -> tuple[str, int, int] | None:
    """(role, text start, text end) inside the span of one turn, None if it is not one marked turn."""
    middle = span.find(MIDDLE, len(OPEN))
    while middle > 0 and (len(span[:middle]) - len(span[:middle].rstrip("\\"))) % 2:
        middle = span.find(MIDDLE, middle + 1)
    if not span.startswith(OPEN) or not span.endswith(CLOSE) or middle < 0:
        return None
    return unescape(span[len(OPEN) : middle]), middle + len(MIDDLE), len(span) - len(CLOSE)


@dataclass(frozen=True)
class Template:
    """A renderer, and a reader that finds role and text in one turn's span of its output."""

    render: Callable[[list[Turn]], str] = render_marked
    read: Callable[[str], tuple[str, int, int] | None] = read_marked
    unescape: Callable[[str], str] = unescape


MARKED = Template()


@dataclass
class Located:
    """One conversation rendered: the output, each turn's span, and the first turn that rewrote what came before."""

    output: str
    spans: list[tuple[int, int]]
    rewrites_at: int | None


class Incremental:
    """Renders a conversation prefix by prefix as its turns come."""

    def __init__(self, render: Callable[[list[Turn]], str]) -> None:
        self.render = render
        self.turns: list[Turn] = []
        self.located = Located(render([]), [], None)

    def add(self, turn: Turn) -> None:
        self.turns.append(turn)
        was, now = self.located.output, self.render(self.turns)
        start = len(was)
        if not now.startswith(was):
            start = next((i for i, (a, b) in enumerate(zip(was, now, strict=False)) if a != b), min(len(was), len(now)))
            if self.located.rewrites_at is None:
                self.located.rewrites_at = len(self.turns) - 1
        self.located.spans.append((start, len(now)))
        self.located.output = now


def locate(render: Callable[[list[Turn]], str], turns: Iterable[Turn]) -> Located:
    run = Incremental(render)
    for turn in turns:
        run.add(turn)
    return run.located


FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(pa.list_(pa.int64()))),
    ("loss_spans", pa.list_(pa.list_(pa.int64()))), ("rewrites_at", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
])
FORMATTED_DDL = "conv_id long, n_turns long, formatted string, spans array<array<long>>, loss_spans array<array<long>>, rewrites_at long, turns_sha256 string, loss_chars long, loss_sha256 string"


def summarise(template: Template, conv_id: int | None, located: Located, loss_role: str) -> dict:
    """Roles, texts and loss spans of one conversation, read back from its output.

    Spans of a template that rewrites history are reported, but its turns cannot be read back: digests
    are null then.
    """
    row = {"conv_id": conv_id, "n_turns": len(located.spans), "formatted": located.output, "spans": [list(s) for s in located.spans], "rewrites_at": located.rewrites_at}
    if located.rewrites_at is not None:
        return row | {"loss_spans": [], "turns_sha256": None, "loss_chars": None, "loss_sha256": None}
    every, loss, spans, chars = hashlib.sha256(), hashlib.sha256(), [], 0
    for start, end in located.spans:
        read = template.read(located.output[start:end])
        if read is None:
            raise ValueError(f"the turn at {start} to {end} of conversation {conv_id} can't be read back")
        role, first, last = read
        text = template.unescape(located.output[start + first : start + last])
        every.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if role == loss_role:
            spans.append([start + first, start + last])
            loss.update(text.encode("utf-8", "surrogatepass"))
            chars += len(text)
    return row | {"loss_spans": spans, "turns_sha256": every.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest()}


def format_conversations(conversations: DataFrame, template: Template = MARKED, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: output, spans of turns and loss, digests of what was read back.

    Turns come by turn, then role and text where turns tie; repeated rows are repeated turns. Null
    roles and texts are empty; rows of null conv_id form one conversation. Rows stream sorted through
    each task, which holds one conversation at a time. Further columns are left out; an empty table
    gives no rows.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        at, going, done, size = none, None, [], 0
        for batch in in_slices(batches):
            for conv, role, body in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
                if conv != at or going is None:
                    if going is not None:
                        done.append(summarise(template, at, going.located, loss_role))
                        size += len(done[-1]["formatted"])
                    at, going = conv, Incremental(template.render)
                going.add((role, body))
                if size > 4_000_000:
                    yield pa.RecordBatch.from_pylist(done, FORMATTED)
                    done, size = [], 0
        if going is not None:
            done.append(summarise(template, at, going.located, loss_role))
        if done:
            yield pa.RecordBatch.from_pylist(done, FORMATTED)

    return dealt.mapInArrow(run, FORMATTED_DDL)


#: Fixed value: the text of the extra conversation, which holds control strings.
PROBE_TEXT = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`format_conversations` over all conversations and the probe, -7."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE_TEXT), (-7, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    done = format_conversations(rows.unionByName(probe))
    return done.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, length(regexp_replace(role, '[\\#<:]', '\\\0', 'g')) + length(regexp_replace(text, '[\\#<:]', '\\\0', 'g')) + 14 as chars from turns
)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""
