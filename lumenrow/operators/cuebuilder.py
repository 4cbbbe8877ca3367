"""Timed words to subtitle cues: a small state machine, in batch and as the core of the stream."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_CHARS, MAX_SECONDS = 84, 6.5
MIN_SECONDS, MIN_CHARS = 1.2, 18
LEAST_SHOWN = 0.10
ENDINGS = (".", "!", "?", "…", "؟", "。", "！", "？", ",", ";", ":", "،")


@dataclass
class CueBuilder:
    """Words wait until the next would be too much, or one ends a phrase that is long enough."""

    waiting: list[str] = field(default_factory=list)
    start: float = 0.0
    end: float = 0.0

    def flush(self) -> list[tuple[float, float, str]]:
        text = " ".join(self.waiting).strip()
        out = [(self.start, max(self.end, self.start + LEAST_SHOWN), text)] if text else []
        self.waiting = []
        return out

    def add(self, word: str, start: float, end: float) -> list[tuple[float, float, str]]:
        word = (word or "").strip()
        if not word:
            return []
        out = []
        longer = len(" ".join([*self.waiting, word]))
        if self.waiting and (longer > MAX_CHARS or end - self.start > MAX_SECONDS):
            out = self.flush()
        if not self.waiting:
            self.start = start
        self.waiting.append(word)
        self.end = end
        long_enough = self.end - self.start >= MIN_SECONDS and len(" ".join(self.waiting)) >= MIN_CHARS
        return out + (self.flush() if word.endswith(ENDINGS) and long_enough else [])

    def add_segment(self, text: str, start: float, end: float) -> list[tuple[float, float, str]]:
        """A segment without word times closes what waits and is a cue of its own."""
        out = self.flush()
        self.waiting, self.start, self.end = [(text or "").strip()], start, end
        return out + self.flush()


def build_cues(words: DataFrame) -> DataFrame:
    """(media_id, cue_no, start_s, end_s, text) of words (media_id, seg_no, word_no, word, start_s, end_s).

    A null word_no marks a segment without word times. State crosses segments; rows stream sorted
    through a task, so a medium of any length needs one cue of memory.
    """
    kind = dict(words.dtypes)["media_id"]
    dealt = words.select("media_id", "seg_no", "word_no", "word", "start_s", "end_s").repartition("media_id").sortWithinPartitions("media_id", "seg_no", "word_no")
    columns = ["media_id", "cue_no", "start_s", "end_s", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        media, builder, number, key = None, None, 0, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = (key, pa.int32(), pa.float64(), pa.float64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], columns)

        for batch in batches:
            key, rows = batch["media_id"].type, []
            for m, word_no, word, start, end in zip(*(batch[c].to_pylist() for c in ("media_id", "word_no", "word", "start_s", "end_s")), strict=True):
                if builder is None or m != media:
                    if builder is not None:
                        rows += [(media, number + i, *c) for i, c in enumerate(builder.flush())]
                    media, builder, number = m, CueBuilder(), 0
                found = builder.add_segment(word, start, end) if word_no is None else builder.add(word, start, end)
                rows += [(media, number + i, *c) for i, c in enumerate(found)]
                number += len(found)
            yield made(rows)
        if builder is not None:
            yield made([(media, number + i, *c) for i, c in enumerate(builder.flush())])

    return dealt.mapInArrow(run, f"media_id {kind}, cue_no int, start_s double, end_s double, text string")
