"""Secret scans with one combined automaton.

All rules are compiled to a single minimal automaton over bytes, which passes once over each text and
marks where the beginning of a rule's match ends. From such a mark a backward automaton finds where the
match begins and a forward one how far it reaches, which gives the leftmost, longest, non-overlapping
matches of each rule; matches that miss a rule's length are dropped, though what they span stays taken.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrow.llm import automata
from lumenrow.llm.common import table, values_of


@dataclass(frozen=True)
class SecretRule:
    """``short`` is how every match begins, up to the byte that marks it; ``whole`` is a whole match.

    A match counts if it is at least ``least`` long and, from the last byte of ``short`` on,
    at least ``least_value``.
    """

    kind: str
    short: str
    whole: str
    least: int = 1
    least_value: int = 1


#: The base rules, in the order that ties take.
_NAMES = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_ASSIGN = _NAMES + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=\\-]"
BASE_RULES = (
    SecretRule("assign", _ASSIGN, _ASSIGN + "[A-Za-z0-9+/_.=\\-]*", least_value=6),
    SecretRule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", least=20),
    SecretRule("hex", "[0-9a-f]{24}", "[0-9a-f]{24,}"),
)
#: Public formats of further secrets. A private key goes to its END line, or where that is missing to its last long line.
_NO_DASH = "[\\x00-\\x2c\\x2e-\\xff]"
_KEY_BODY = "(" + "|".join("-" * n + _NO_DASH for n in range(5)) + ")*"
_KEY_END = "(" + _KEY_BODY + "-----END [A-Z ]*PRIVATE KEY-----|(\\x0d?\\x0a[A-Za-z0-9+/=]{16,})*)"
MORE_RULES = (
    SecretRule("github", "gh[pousr]_[A-Za-z0-9]", "gh[pousr]_[A-Za-z0-9]+", least=40),
    SecretRule("slack", "xox[abpr]-[0-9]", "xox[abpr]-[0-9]+-[0-9A-Za-z\\-]+", least=20),
    SecretRule("stripe", "[sr]k_live_[0-9A-Za-z]", "[sr]k_live_[0-9A-Za-z]+", least=24),
    SecretRule("pem", "-----BEGIN ", "-----BEGIN [A-Z ]*PRIVATE KEY-----" + _KEY_END),
)
RULES = BASE_RULES + MORE_RULES

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType([T.StructField("spans", T.ArrayType(SPAN)), T.StructField("redacted", T.StringType())])
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_ARROW_FOUND = pa.struct([("spans", pa.list_(_ARROW_SPAN)), ("redacted", pa.string())])


class SecretScanner:
    def __init__(self, rules: tuple[SecretRule, ...] = RULES) -> None:
        self.rules = rules
        self.scanner = automata.Scanner(automata.combined([(r.short, False) for r in rules]))
        if not self.scanner.resets[10]:
            raise ValueError("a rule spans lines")
        self.ahead = [automata.forward(r.whole) for r in rules]
        self.behind = [automata.backward(r.short) for r in rules]

    def spans(self, data: bytes, marks: Iterable[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and rule, from a text's (end, rule bits) marks."""
        taken, found = [0] * len(self.rules), []
        for end, bits in marks:
            for i, rule in enumerate(self.rules):
                if not bits >> i & 1 or end <= taken[i]:
                    continue
                start = automata.leftmost(self.behind[i], data, end, taken[i])
                if start is None:
                    continue
                taken[i] = automata.longest(self.ahead[i], data, start)
                if taken[i] - start >= rule.least and taken[i] - end + 1 >= rule.least_value:
                    found.append((start, i, taken[i]))
        return sorted(found)

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Spans of each text, all texts in one pass of the automaton."""
        buffer = np.frombuffer(b"\n".join(texts), np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        ends, bits = self.scanner.scan(buffer)
        owner = np.searchsorted(starts, ends - 1, "right") - 1
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k in np.unique(owner):
            mine = slice(*np.searchsorted(owner, [k, k + 1]))
            out[k] = self.spans(texts[k], zip((ends[mine] - starts[k]).tolist(), bits[mine].tolist(), strict=True))
        return out


@functools.cache
def _scanner(rules: tuple[SecretRule, ...]) -> SecretScanner:
    return SecretScanner(rules)


def char_offsets(data: bytes, places: Iterable[int]) -> dict[int, int]:
    """How many characters of UTF-8 ``data`` begin before each of some places in bytes."""
    begins, found, last, n = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80, {}, 0, 0
    for place in sorted(set(places)):
        n += int(np.count_nonzero(begins[last:place]))
        found[place], last = n, place
    return found


def _redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        if end > at:
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join([*out, text[at:]])


def secrets_in(text: Column, rules: tuple[SecretRule, ...] = RULES, slice_bytes: int = 16_000_000) -> Column:
    """A struct of ``spans`` (kind, start, end in code points, end exclusive) by start and rule order, and
    ``redacted``: the text with each stretch of overlapping spans replaced by the kind of its first, null
    where there is no span. Null and empty texts have no spans."""

    @F.arrow_udf(FOUND)
    def find(values: pa.Array) -> pa.Array:
        scanner, out, texts, size = _scanner(rules), [], [], 0

        def flush() -> None:
            for data, spans in zip(texts, scanner.scan(texts), strict=True):
                if not spans:
                    out.append({"spans": [], "redacted": None})
                    continue
                at = char_offsets(data, [p for a, _, b in spans for p in (a, b)])
                named = [(at[a], at[b], rules[i].kind) for a, i, b in spans]
                out.append({"spans": [{"kind": k, "start": a, "end": b} for a, b, k in named], "redacted": _redact(data.decode(), named)})
            texts.clear()

        for data in values_of(values.cast(pa.binary())):
            texts.append(data or b"")
            size += len(texts[-1])
            if size > slice_bytes:
                flush()
                size = 0
        flush()
        return pa.array(out, _ARROW_FOUND)

    return find(text)


def scan_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES) -> DataFrame:
    """(doc, spans, redacted) for each row; ``doc`` is the whole input row, extra columns included.

    Rows are scanned one by one, whole; an empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("doc"), secrets_in(F.col("text"), rules).alias("found"))
    return rows.select("doc", "found.spans", "found.redacted")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`scan_secrets` over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", secrets_in(F.col("text")).alias("found")).select("doc_id", "found.spans")
    base = [r.kind for r in BASE_RULES]
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    of = lambda *kinds: F.filter("spans", lambda x: x["kind"].isin(*kinds))
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
