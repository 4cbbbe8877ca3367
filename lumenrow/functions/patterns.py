"""Regular expressions with Unicode classes and ``\\n`` as the only line end, as the semantics ask for."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: d: only \n ends a line; U: Unicode \d \s \w \b.
UNICODE = "(?dU)"
#: Line ends but ``\n``; texts without them are cut without a regular expression.
OTHER_LINE_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


def pattern(body: str, ignore_case: bool = False) -> str:
    return ("(?dUi)" if ignore_case else UNICODE) + body


def matches(column: Column, body: str, ignore_case: bool = False) -> Column:
    return column.rlike(pattern(body, ignore_case))


def full_match(column: Column, body: str, ignore_case: bool = False) -> Column:
    return column.rlike(pattern(rf"\A(?:{body})\z", ignore_case))


def extract(column: Column, body: str, group: int = 1, ignore_case: bool = False) -> Column:
    return F.regexp_extract(column, pattern(body, ignore_case), group)


def strip(column: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(column, pattern(r"\A\s+|\s+\z"), "")


def rstrip(column: Column) -> Column:
    return F.regexp_replace(column, pattern(r"\s+\z"), "")


def lstrip(column: Column) -> Column:
    return F.regexp_replace(column, pattern(r"\A\s+"), "")


def squeeze(column: Column) -> Column:
    """Stripped, with each run of white space one space."""
    return strip(F.regexp_replace(column, pattern(r"\s+"), " "))


def nullif_empty(column: Column) -> Column:
    return F.when(column != "", column)


def literal(text: str) -> str:
    """``text`` as a regular expression that matches itself."""
    return re.sub(r"([^\w\s])", r"\\\1", text)


def physical_lines(text: Column) -> Column:
    """Lines as by Python's splitlines: all Unicode line ends, no last empty piece."""
    other = functools.reduce(operator.or_, (F.contains(text, F.lit(end)) for end in OTHER_LINE_ENDS))
    pieces = F.when(other, F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)).otherwise(F.split(text, "\n", -1))
    kept = once(pieces, lambda ps: F.when(F.element_at(ps, -1) == "", F.slice(ps, 1, F.size(ps) - 1)).otherwise(ps))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(kept)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once a row, however often ``then`` names it.

    Expressions that are written out again in each branch of a CASE are computed again in each.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))
