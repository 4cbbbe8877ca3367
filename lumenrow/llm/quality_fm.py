"""Quality by a factorisation machine.

Hashed words, binned structure statistics and metadata are the features; the machine has a weight and
a short factor for each, and all pairwise interactions are scored in linear time as half the square of
the factors' sum less the sum of their squares. It is trained by AdaGrad on a bounded labelled sample.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.llm.common import held_out, in_slices, table, values_of

#: At most so many labelled rows, first by a hash of their ids, are collected to train.
MAX_LABELLED = 8_000
WORD_BUCKETS = 1 << 15
FACTORS = 8
BINS = 24
CACHE_WORDS = 300_000
SYMBOLS = "#*$%&|<>"
#: Structure statistics of the text, and the metadata column n_chars, each one-hot over BINS bins.
STATISTICS = ("length", "chars", "distinct", "symbols", "upper", "lines", "marks", "word_length", "endings", "n_chars")
WIDTH = WORD_BUCKETS + BINS * len(STATISTICS)


def _level(share: float) -> int:
    """0 for none, then a bin for each halving below one, finer near one."""
    if share <= 0:
        return 0
    return min(BINS - 1, 1 + int(min(1.0, share) * 10)) if share >= 0.1 else max(12, BINS - 1 + int(math.log2(share)))


def statistics_of(text: str, words: list[str], distinct: int, n_chars: int | None) -> list[int]:
    """The bin of each statistic of a whole text, and of what its row says its length is, the last where that is null."""
    n, chars = len(words), len(text)
    lines = [line for line in text.split("\n") if line.strip()]
    values = (
        min(BINS - 1, n.bit_length()),
        min(BINS - 1, chars.bit_length()),
        _level(distinct / n) if n else 0,
        _level(sum(map(text.count, SYMBOLS)) / n) if n else 0,
        _level(sum(map(str.isupper, words)) / n) if n else 0,
        _level(1 - len(set(lines)) / len(lines)) if lines else 0,
        _level(text.count("!") / n) if n else 0,
        min(BINS - 1, chars // n) if n else 0,
        _level(text.count(".") / n) if n else 0,
        BINS - 1 if n_chars is None else min(BINS - 2, max(0, n_chars).bit_length()),
    )
    return [WORD_BUCKETS + BINS * i + v for i, v in enumerate(values)]


class _Buckets(dict):
    """The bucket of each word, kept while few are."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (WORD_BUCKETS - 1)
        return found


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    _buckets: _Buckets | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_buckets": None}

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores before the logistic of rows whose features begin at ``starts``; no row may be empty."""
        v = self.factors[index] * value[:, None]
        pairs = np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)
        return self.bias + np.add.reduceat(self.linear[index] * value, starts) + 0.5 * pairs.sum(1)

    def scores(self, texts: Iterable[str | None], n_chars: Iterable[int | None] | None = None) -> np.ndarray:
        """Scores of whole texts, 0 to 1, a bounded number of features at a time; without ``n_chars`` these are null."""
        if self._buckets is None:
            self._buckets = _Buckets()
        out, rows, size = [np.empty(0)], [], 0
        for text, stated in zip(texts, n_chars, strict=True) if n_chars is not None else ((t, None) for t in texts):
            rows.append(features(text, stated, self._buckets))
            size += len(rows[-1][0])
            if size > 200_000:
                out.append(self._score(rows))
                rows, size = [], 0
        return np.concatenate([*out, self._score(rows)] if rows else out)

    def _score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        lengths = np.array([len(r[0]) for r in rows])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        z = self.margins(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def features(text: str | None, n_chars: int | None, buckets: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values): one for each distinct word, of unit length together, and 1 for each bin of a statistic or of metadata."""
    text = text or ""
    words = text.split()
    distinct = set(words)
    index = list(map(buckets.__getitem__, distinct))
    bins = statistics_of(text, words, len(distinct), n_chars)
    value = np.ones(len(index) + len(bins), np.float32)
    if index:
        value[: len(index)] = 1 / math.sqrt(len(index))
    return np.array(index + bins, np.int32), value


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, rate: float = 0.1, l2: float = 1e-5, batch: int = 128, seed: int = 7) -> FactorisationMachine:
    """A machine fitted to labels ``y``; without both labels it scores all rows by their share of ones."""
    rng = np.random.default_rng(seed)
    base = (float(y.sum()) + 0.5) / (len(y) + 1)
    machine = FactorisationMachine(math.log(base / (1 - base)), np.zeros(WIDTH, np.float32), (0.03 * rng.standard_normal((WIDTH, FACTORS))).astype(np.float32))
    if not 0 < y.sum() < len(y):
        machine.factors[:] = 0
        return machine
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, FACTORS), 1e-6, np.float32), 1e-6
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    weight = np.sqrt(weight)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            lengths = np.array([len(rows[i][0]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            index, value = np.concatenate([rows[i][0] for i in chosen]), np.concatenate([rows[i][1] for i in chosen])
            v = machine.factors[index] * value[:, None]
            sums = np.add.reduceat(v, starts)
            z = machine.bias + np.add.reduceat(machine.linear[index] * value, starts) + 0.5 * (sums**2 - np.add.reduceat(v * v, starts)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[chosen]) * weight[chosen] / len(chosen)
            each = np.repeat(error, lengths).astype(np.float32) * value
            touched, place = np.unique(index, return_inverse=True)
            g_w = np.bincount(place, each, len(touched)).astype(np.float32) + l2 * machine.linear[touched]
            g_v = np.stack([np.bincount(place, each * (np.repeat(sums[:, f], lengths) - v[:, f]), len(touched)) for f in range(FACTORS)], 1).astype(np.float32) + l2 * machine.factors[touched]
            seen_w[touched] += g_w**2
            seen_v[touched] += g_v**2
            machine.linear[touched] -= rate * g_w / np.sqrt(seen_w[touched])
            machine.factors[touched] -= 0.3 * rate * g_v / np.sqrt(seen_v[touched])
            g_b = float(error.sum())
            seen_b += g_b**2
            machine.bias -= rate * g_b / math.sqrt(seen_b)
    return machine


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> FactorisationMachine:
    """A machine from at most ``max_labelled`` labelled documents (doc_id, text, n_chars).

    Of a repeated id the lowest label and the least text and n_chars count; null ids and labels do not.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(known), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("n_chars").alias("n_chars"), F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in in_slices(batches):
            rows = [features(text, n, buckets) for text, n in zip(batch["text"].to_pylist(), batch["n_chars"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"].cast(pa.int64()), batch["quality"].cast(pa.int32()), pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1][:1] for r in rows], pa.list_(pa.float32()))], ["doc_id", "quality", "index", "first"])

    got = sample.mapInArrow(run, "doc_id long, quality int, index array<int>, first array<float>").toArrow().sort_by("doc_id")
    y = np.array([q == 1 for q in got["quality"].to_pylist()], float)
    rows = []
    for index, first in zip(got["index"], got["first"], strict=True):
        at = index.values.to_numpy()
        value = np.ones(len(at), np.float32)
        value[: len(at) - len(STATISTICS)] = first.values[0].as_py()
        rows.append((at, value))
    return train(rows, y)


def quality(machine: FactorisationMachine) -> Callable:
    """A function of two columns, text and n_chars: the score, 0 to 1, of each whole text.

    Null texts count as empty, and null n_chars have a bin of their own; rows are scored one by one,
    so repeated ones score alike, an empty table gives no rows, and other columns are not read.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array, n_chars: pa.Array) -> pa.Array:
        return pa.array(machine.scores(values_of(texts), values_of(n_chars)).astype(float), pa.float64())

    return lambda text, n_chars: score(text, n_chars.cast("long"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: every document scored by a machine of the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").filter(~held_out(F.col("doc_id"), 3, 1))
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), quality(fit(docs, labels))(F.col("text"), F.col("n_chars")).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
