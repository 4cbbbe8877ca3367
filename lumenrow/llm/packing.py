"""Best-fit packing of token sequences by patterns of lengths.

Documents become pieces of at most one sequence. All patterns of two to eight lengths, in 64ths of a
sequence, that fill one are enumerated; repeat counts are fitted to the histogram of piece lengths by
non-negative least squares and rounded by largest remainder; each repeat takes pieces whose exact
lengths fill the sequence; and what patterns leave is packed best-fit into their gaps and new sequences.
All of that works on the histogram, whose size is that of a sequence and not that of the corpus; the
resulting plan says for the k-th piece of each length where it goes, and pieces learn their k from counts.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.llm.common import cut, in_slices, table

CAPACITY = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Lengths are counted in so many units a sequence, and patterns have at most so many documents.
UNITS, MOST_DOCUMENTS = 64, 8
#: Tokens by which a pattern's sequence may fall short; each is tried.
WASTES = (0, 4, 32, CAPACITY)
#: Parts of texts whose ids a worker keeps at most.
CACHE_PARTS = 400_000
#: Pieces of one length are numbered in separate runs, one for each million pieces within these bounds, so that a
#: common length is no single task.
MIN_SALTS, MAX_SALTS, ROWS_A_SALT = 64, 1024, 1_000_000


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if it is visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in visible)
    letters = {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class _Parts(dict):
    """The ids of each part: those of the last half of ``CACHE_PARTS`` new parts, and of the half before."""

    def __init__(self, ids: Callable[[str], bytes]) -> None:
        self.ids, self.older = ids, {}

    def __missing__(self, part: str) -> bytes:
        found = self.older.get(part) or self.ids(part)
        if len(self) >= CACHE_PARTS // 2:
            self.older = dict(self)
            self.clear()
        self[part] = found
        return found


class WordTokenizer:
    """Ids of texts under the word vocabulary, part by part with a bounded cache.

    The vocabulary drops white space, lower-cases and cuts texts into parts (runs of letters, single
    digits, runs of other signs) whose ids do not depend on what stands around them. Texts of ASCII
    and Latin-1 letters are cut here and only new parts are merged by the vocabulary's model; other
    texts go through the tokenizer whole.
    """

    _PLAIN = re.compile(r"[\x09-\x0d\x20-\x7e\xc0-\xff]*")
    _PART = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~\xd7\xf7]+")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = _byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.merge, self.parts = self.tokenizer.model.tokenize, _Parts(self._ids)

    def _ids(self, part: str) -> bytes:
        return b"".join(t.id.to_bytes(4, "little") for t in self.merge(part.translate(self.letters)))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if "<|" in text or not self._PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.parts.__getitem__, self._PART.findall(text.lower())))


@functools.cache
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document: its ids, then ``end_id``, cut at ``capacity``.

    Null and empty texts are the end id alone. ``path`` is looked up on each executor unless given.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path or vocabulary_path())
        for batch in in_slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = tokenizer.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


@functools.cache
def enumerate_patterns(units: int = UNITS, most: int = MOST_DOCUMENTS) -> np.ndarray:
    """Rows of at least two and up to ``most`` lengths in units, longest first and 0 for none, that together fill a sequence of ``units``."""
    found: list[tuple[int, ...]] = []

    def fill(left: int, top: int, parts: tuple[int, ...]) -> None:
        if not left:
            found.append(parts + (0,) * (most - len(parts)))
        elif len(parts) < most:
            for part in range(min(top, left), -(-left // (most - len(parts))) - 1, -1):
                fill(left - part, part, (*parts, part))

    fill(units, units - 1, ())
    return np.array(found, np.int64).reshape(-1, most)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts of ``patterns`` that come nearest ``histogram``, by length in units, in least squares.

    Lawson and Hanson's active set, so that no more patterns have a count than there are lengths. Errors
    count relative to the root of how many pieces a length has.
    """
    scale = 1 / np.sqrt(np.maximum(histogram, 1))
    matrix = np.zeros((len(patterns), len(histogram)), np.float32)
    for column in patterns.T:
        matrix[np.arange(len(patterns)), column] += 1
    matrix[:, 0] = 0
    matrix *= scale.astype(np.float32)
    target = np.where(np.arange(len(histogram)) > 0, histogram * scale, 0.0)
    counts, rest = np.zeros(len(patterns)), target
    active: list[int] = []
    useless: list[int] = []
    solve = lambda chosen: np.linalg.lstsq(matrix[chosen].T.astype(float), target, rcond=None)[0]
    for _ in range(20 * len(histogram)):
        slope = matrix @ rest.astype(np.float32)
        slope[active + useless] = -np.inf
        entering = int(np.argmax(slope)) if len(slope) else -1
        if entering < 0 or slope[entering] <= 1e-4:
            break
        solved = solve([*active, entering])
        if solved[-1] <= 1e-9:
            useless.append(entering)
            continue
        active, useless = [*active, entering], []
        while active and solved.min() <= 1e-9:
            now, falls = counts[active], solved <= 1e-9
            now = now + np.min(now[falls] / np.maximum(now[falls] - solved[falls], 1e-300)) * (solved - now)
            counts[active] = np.where(now > 1e-9, now, 0)
            active = [p for p in active if counts[p]]
            solved = solve(active) if active else solved
        counts[active] = solved[: len(active)]
        rest = target - (matrix[active].T.astype(float) @ counts[active] if active else 0)
    return counts


def rounded(counts: np.ndarray, patterns: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts: rounded down, and up by largest remainder where ``histogram`` has the pieces."""
    whole = np.floor(counts + 1e-6).astype(np.int64)
    size = len(histogram)
    used = sum(np.bincount(column, whole, size) for column in patterns.T) if len(patterns) else np.zeros(size)
    for k in np.argsort(whole - counts, kind="stable")[: np.count_nonzero(counts)]:
        one = np.bincount(patterns[k], minlength=size)
        if counts[k] - whole[k] > 1e-6 and np.all((used + one)[1:] <= histogram[1:]):
            whole[k] += 1
            used += one
    return whole


class Stock:
    """How many pieces of each length are left; ``lengths`` lists, ascending, those of which there are any."""

    def __init__(self, counts: np.ndarray, least: int) -> None:
        self.counts = [int(n) for n in counts]
        self.lengths = [length for length in range(max(1, least), len(self.counts)) if self.counts[length]]

    def take(self, length: int, n: int = 1) -> None:
        self.counts[length] -= n
        if not self.counts[length]:
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def give(self, length: int) -> None:
        if not self.counts[length]:
            bisect.insort(self.lengths, length)
        self.counts[length] += 1

    def nearest(self, length: int) -> int:
        """The length nearest to ``length``, 0 if none is left."""
        at = bisect.bisect_left(self.lengths, length)
        return min(self.lengths[max(0, at - 1) : at + 1], key=lambda x: abs(x - length), default=0)

    def pair(self, room: int, first: int, reach: int) -> tuple[int, int, int] | None:
        """(waste, a, b): the two lengths that fill ``room`` best, a within ``reach`` of ``first``."""
        best = None
        near = self.lengths[bisect.bisect_left(self.lengths, first - reach) : bisect.bisect_right(self.lengths, first + reach)]
        for a in sorted(near, key=lambda x: abs(x - first)):
            at = bisect.bisect_right(self.lengths, room - a) - 1
            if at >= 0 and self.lengths[at] == a and self.counts[a] < 2:
                at -= 1
            if at >= 0:
                found = (room - a - self.lengths[at], a, self.lengths[at])
                best = found if best is None or found[0] < best[0] else best
                if not found[0]:
                    break
        return best


def realise(stock: Stock, pattern: list[int], unit: float, capacity: int, waste: int) -> list[int] | None:
    """Lengths of pieces in ``stock`` for a pattern: each nearest to what keeps the sum on course, the last two the pair that fits best.

    None if no pair comes within ``waste`` of a full sequence.
    """
    room, rest, slots = capacity, float(capacity), []
    for part in pattern[:-2]:
        rest -= part * unit
        length = stock.nearest(round(room - rest))
        if not 0 < length < room:
            break
        stock.take(length)
        slots.append(length)
        room -= length
    pair = stock.pair(room, round(room - pattern[-1] * unit), max(1, round(unit))) if len(slots) == len(pattern) - 2 else None
    for length in slots:
        stock.give(length)
    return [*slots, *pair[1:]] if pair and pair[0] <= waste else None


@dataclass
class Plan:
    """Runs of equal sequences: ``count`` sequences from ``first`` on, each of the same lengths in ``slots``.

    ``used`` and ``place`` tell, for a slot of length L, the rank of its first piece among those of
    length L and its offset in the sequence; the r-th sequence of the run takes rank + r.
    """

    length: np.ndarray
    rank: np.ndarray
    count: np.ndarray
    first: np.ndarray
    offset: np.ndarray
    sequences: int
    #: Pieces that fitted patterns hold.
    in_patterns: int = 0

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the rank-th pieces of the lengths."""
        key = self.length.astype(np.int64) << 44 | self.rank
        at = np.searchsorted(key, length.astype(np.int64) << 44 | rank, "right") - 1
        return self.first[at] + rank - self.rank[at], self.offset[at]


def pattern_sequences(histogram: np.ndarray, capacity: int, waste: int) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of the sequences that fitted patterns fill to within ``waste``.

    Lengths are counted in units of a 64th of a sequence, rounded to the nearest; pieces of under one
    and a half units are kept back to fill gaps.
    """
    units = min(UNITS, capacity)
    unit = capacity / units
    filler = int(1.5 * unit)
    counts = histogram[:capacity].copy()
    counts[:filler] = 0
    coarse = np.bincount(np.round(np.arange(capacity) / unit).astype(np.int64), counts, units + 1)[:units]
    patterns = enumerate_patterns(units)
    patterns = patterns[((coarse > 0) | (np.arange(units) == 0))[patterns].all(1)]
    whole = rounded(fit_counts(patterns, coarse), patterns, coarse)
    stock, made = Stock(histogram[:capacity], filler), []
    for k in sorted(np.flatnonzero(whole), key=lambda k: (np.count_nonzero(patterns[k]), -whole[k], k)):
        n, pattern = int(whole[k]), [int(v) for v in patterns[k] if v]
        while n and (slots := realise(stock, pattern, unit, capacity, waste)):
            many = min(n, *(stock.counts[v] // slots.count(v) for v in slots))
            for v in slots:
                stock.take(v, many)
            made.append((many, tuple(slots)))
            n -= many
    return made


def pack_histogram(histogram: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """A plan for ``histogram[L]`` pieces of each length L; the same histogram always gives the same plan.

    Sequences of fitted patterns come first, then what they leave goes best-fit into their gaps and
    into new ones. Of several bounds on a pattern's gap the one of fewest sequences is taken.
    """
    alone = [(int(histogram[capacity]), (capacity,))] if histogram[capacity] else []
    plans = []
    for waste in WASTES:
        made = pattern_sequences(histogram, capacity, waste)
        left = histogram.astype(np.int64).copy()
        left[capacity] = 0
        for n, slots in made:
            for v in slots:
                left[v] -= n
        packed = best_fit_decreasing(left, capacity, made)
        plans.append((sum(n for n, _ in packed), -sum(n * len(slots) for n, slots in made), packed))
    fewest, in_patterns, packed = min(plans, key=lambda p: p[:2])
    rows, taken, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for n, slots in alone + packed:
        offset = 0
        for v in slots:
            rows.append((v, taken[v], n, sequence, offset))
            taken[v] += n
            offset += v
        sequence += n
    table_ = np.array(rows, np.int64).reshape(-1, 5)
    table_ = table_[np.lexsort((table_[:, 1], table_[:, 0]))]
    return Plan(*table_.T, sequences=sequence, in_patterns=-in_patterns)


def best_fit_decreasing(left: np.ndarray, capacity: int, begun: Iterable[tuple[int, tuple[int, ...]]] = ()) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over counts, into the gaps of the sequences ``begun`` and into new ones.

    Equal sequences move together, so the work does not grow with the counts.
    """
    rooms: list[int] = []
    bins: dict[int, list[list]] = {}

    def put(room: int, n: int, slots: tuple[int, ...]) -> None:
        if room not in bins:
            bins[room] = []
            bisect.insort(rooms, room)
        bins[room].append([n, slots])

    for n, slots in begun:
        put(capacity - sum(slots), n, slots)
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                group = bins[room][-1]
                moved = min(n, group[0])
                slots = (*group[1], length)
                group[0] -= moved
                if not group[0]:
                    bins[room].pop()
                    if not bins[room]:
                        del bins[room]
                        rooms.pop(at)
                put(room - length, moved, slots)
                n -= moved
            else:
                each = capacity // length
                whole, rest = divmod(n, each)
                if whole:
                    put(capacity - each * length, whole, (length,) * each)
                if rest:
                    put(capacity - rest * length, 1, (length,) * rest)
                n = 0
    return [(n, slots) for room in sorted(bins) for n, slots in bins[room]]


def place(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut_pieces`` with sequence_id and offset, from their lengths; repeated rows are separate pieces.

    Rows must be computed already (cut), as their lengths are counted and then numbered: within a
    salted run of their length, behind the rows of the runs before it. Only the histogram, a row a
    length, comes to the driver.
    """
    salts = min(MAX_SALTS, max(MIN_SALTS, cut_pieces.count() // ROWS_A_SALT))
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    runs = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = runs.groupBy("length").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros(capacity + 1, np.int64)
    histogram[counts["length"].to_numpy()] = counts["n"].to_numpy()
    plan = pack_histogram(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select(F.col("length").alias("of"), F.col("salt").alias("run"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = salted.withColumn("within", within).join(starts, (F.col("length") == F.col("of")) & (F.col("salt") == F.col("run")))
    ranked = numbered.withColumn("rank", F.col("before") + F.col("within"))

    @F.arrow_udf("sequence_id long, offset long")
    def seat(length: pa.Array, rank: pa.Array) -> pa.Array:
        sequence, offset = plan.look_up(*(x.to_numpy(zero_copy_only=False) for x in (length, rank)))
        return pa.StructArray.from_arrays([pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["sequence_id", "offset"])

    seated = ranked.withColumn("seat", seat("length", "rank"))
    return seated.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seat.sequence_id").alias("sequence_id"), F.col("seat.offset").alias("offset"))


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with the sequence and the place in it that each goes to.

    An empty table gives no rows; null ids and repeated rows are packed like any others; columns other
    than doc_id and text are left out.
    """
    return place(cut(pieces(docs, path, capacity)), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract result of :func:`pack` over all documents."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
