"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document's features are its distinct five-word shingles, weighted by how often it has them and how
rare they are. Each sketch value is an improved consistent weighted sample (Ioffe 2010): equal for two
documents with the probability of their weighted Jaccard similarity. Sketches are banded, members of a
band's bucket are verified by exact weighted Jaccard similarity against leaders of the bucket, then all
members that are not yet in one class against each other, and verified links are joined to classes.
Exact copies share one representative from the start, so a large group of copies costs one row.

Document frequencies are counted over all documents in hashed form, as is usual for hashed TF-IDF: a
shingle has the count of its bucket of 2**18. The inverse frequency moves a weight by a quarter at
most. Without a bound the similarity of two texts would fall with every further copy of them, as what
they share grows common and what they don't stays rare; with it, texts of plain Jaccard similarity J
have at least J / (J + 1.25 (1 - J)) in any corpus, which is 0.8 from J = 0.834 on.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenrow.llm.common import cut, drop_path, fewer, fresh_path, hot_keys, in_slices, join_hot, table, values_of
from lumenrow.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 3
SAMPLES = BANDS * ROWS
IDF_BITS = 18
IDF_SPAN = 0.25
#: Ratio of documents to document frequency at which the whole span is reached.
IDF_FULL = 1024.0
#: Sketches that agree in fewer samples are not compared: at the threshold that has a chance below 1e-5.
LEAST_AGREED = 17
CACHE_WORDS = 300_000
#: The least of a document is above so many times what it is on average with a chance of exp(-LIKELY).
LIKELY = 7.0
#: Up to so many ids, or pairs of nodes, are broadcast; more are joined by shuffle.
BROADCAST_IDS = 200_000
#: Pairs of buckets up to so large are rows; those of larger ones are made in blocks of about so many rows and bytes of text.
PAIRED_ROWS = 32
BLOCK_ROWS, BLOCK_BYTES = 2_000, 8_000_000
#: Shingles that so few pairs of two blocks share are added up pair by pair, others by products of so many columns.
FEW_PAIRS = 100
PAIRS_AT_ONCE = 500_000
COLUMNS = 2_048

_WORD = re.compile(r"\w+")
_P = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _WordIds(dict):
    """64-bit ids of words, kept while few are."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall((text or "").lower())


def shingles(words: list[str], ids: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles as sorted 64-bit hashes, and how often each occurs.

    Fewer than five words are one shingle; no words are none.
    """
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    x = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(x))
    y = x[: len(x) - width + 1].copy()
    for j in range(1, width):
        y = y * _P + x[j : len(x) - width + 1 + j]
    return np.unique(_mix(y + np.uint64(width)), return_counts=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Counts of documents by shingle bucket, and of documents that have shingles; 2**18 numbers whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, n = _WordIds(), np.zeros(1 << IDF_BITS, np.int64), 0
        for batch in in_slices(batches):
            for text in batch["text"].to_pylist():
                found, _ = shingles(words_of(text), ids)
                if len(found):
                    n += 1
                    np.add.at(counts, (found >> np.uint64(64 - IDF_BITS)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(counts[at], n), pa.int64())], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts, total = np.zeros(1 << IDF_BITS, np.int64), 0
    for bucket, n in zip(rows["bucket"].to_pylist(), rows["n"].to_pylist(), strict=True):
        if bucket < 0:
            total = n
        else:
            counts[bucket] = n
    return counts, total


def idf_table(counts: np.ndarray, total: int) -> np.ndarray:
    """1 for a bucket of all documents, up to 1.25 for a rare one."""
    ratio = max(1, total) / np.maximum(1, counts)
    return (1 + IDF_SPAN * np.clip(np.log(ratio) / math.log(IDF_FULL), 0, 1)).astype(np.float32)


def weigh(found: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF weights: one more than the log of the count, times the bucket's inverse frequency."""
    return ((1 + np.log(times)) * idf[(found >> np.uint64(64 - IDF_BITS)).astype(np.int64)]).astype(np.float32)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of the lesser over sum of the greater weights of two (sorted shingles, weights); 0 if both are empty."""
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    shared = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=float))
    whole = float(a[1].sum(dtype=float) + b[1].sum(dtype=float)) - shared
    return shared / whole if whole > 0 else 0.0


def _gamma_quantiles(size: int) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, at the middles of ``size`` equal parts, by bisection."""
    p = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - np.exp(-middle) * (1 + middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


class WeightedSampler:
    """SAMPLES improved consistent weighted samples of many documents at a time.

    A shingle's draws for sample k come from one 64-bit hash of both: 16 bits pick r, 16 are beta, 32
    pick c. The least of a document is about 1 in its sum of weights, and a value is at least what the first
    bits of r and c say; only shingles of which these don't say that they are above are computed, and all
    of a document whose least then is not below. So the samples are those of all shingles.
    """

    def __init__(self, samples: int = SAMPLES, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.salts = rng.integers(0, 1 << 63, samples, dtype=np.uint64)
        self.odds = rng.integers(0, 1 << 63, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        r = _gamma_quantiles(1 << 16)
        self.r, self.per_r = r.astype(np.float32), (1 / r).astype(np.float32)
        log_c = np.log(r)
        self.log_c, self.log_c_step = log_c.astype(np.float32), np.append(np.diff(log_c), 0).astype(np.float32)
        # By the first 8 bits of r and of c, the least that a value of weight 1 can be.
        self.least = self._level(log_c[None, ::256] - r[255::256, None]).ravel()

    @staticmethod
    def _level(x: np.ndarray) -> np.ndarray:
        """Values from -12 to 3.9 in sixteenths, rounded down."""
        return np.clip(np.floor((x + 12) * 16), 0, 255).astype(np.uint8)

    def _values(self, x: np.ndarray, log_w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithms that are to be least, and the quantised weights, of hashes and weights."""
        low, scale = np.uint64(0xFFFF), np.float32(1 / 65536)
        i = (x & low).astype(np.int32)
        beta = ((x >> np.uint64(16)) & low).astype(np.float32) * scale
        c = (x >> np.uint64(48)).astype(np.int32)
        part = ((x >> np.uint64(32)) & low).astype(np.float32) * scale
        r = self.r[i]
        t = np.floor(log_w * self.per_r[i] + beta)
        return self.log_c[c] + self.log_c_step[c] * part - r * (t - beta) - r, t

    def sample(self, found: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """An array (documents, samples) of 64-bit sample ids; each document has at least one shingle."""
        ends = np.append(starts[1:], len(found))
        log_w = np.log(weights).astype(np.float32)
        likely = np.log(LIKELY / np.add.reduceat(weights, starts, dtype=float))
        limit = self._level(np.repeat(likely, ends - starts) + log_w)
        out = np.empty((len(starts), len(self.salts)), np.uint64)
        high = np.uint64(0xFF00)
        for k, (salt, odd) in enumerate(zip(self.salts, self.odds, strict=True)):
            x = (found ^ salt) * odd
            x ^= x >> np.uint64(32)
            near = np.flatnonzero(self.least[((x & high) | (x >> np.uint64(56))).view(np.int64)] <= limit)
            value, t = self._values(x[near], log_w[near])
            first = np.searchsorted(near, starts)
            sizes = np.diff(np.append(first, len(near)))
            some = sizes > 0
            best = np.full(len(starts), np.inf, np.float32)
            best[some] = np.minimum.reduceat(value, first[some])
            at = np.flatnonzero(value == np.repeat(best, sizes))
            at = at[np.searchsorted(at, first[some])]
            out[some, k] = _mix(found[near[at]] + t[at].astype(np.int64).astype(np.uint64) * _P + salt)
            # What was left out is above ``likely``, but for rounding.
            for d in np.flatnonzero(best > likely - 0.01):
                mine = slice(starts[d], ends[d])
                value, t = self._values(x[mine], log_w[mine])
                one = np.argmin(value)
                out[d, k] = _mix(found[mine][one : one + 1] + t[one : one + 1].astype(np.int64).astype(np.uint64) * _P + salt)[0]
        return out


def sketches(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """(doc_id, digest, samples, bands) of every row; the last three are null for texts without words.

    ``digest`` is of the words in turn, equal for exact copies; ``samples`` has 32 bits of each
    sample; ``bands`` a key for each band.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("samples", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sampler = _WordIds(), WeightedSampler()

        def made(rows: list[tuple]) -> pa.RecordBatch:
            starts = np.cumsum([0, *(len(r[2]) for r in rows[:-1])])
            found = sampler.sample(np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows]), starts)
            keys = found[:, ::ROWS].copy()
            for j in range(1, ROWS):
                keys = _mix(keys * _P + found[:, j::ROWS])
            keys = (keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)
            short = (found >> np.uint64(32)).astype("<u4")
            columns = ([r[0] for r in rows], [r[1] for r in rows], [s.tobytes() for s in short], list(keys))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        rows, bare, size = [], [], 0
        for batch in in_slices(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = words_of(text)
                found, times = shingles(words, ids)
                if not len(found):
                    bare.append(doc_id)
                    continue
                rows.append((doc_id, digest_of(words), found, weigh(found, times, idf)))
                size += len(found)
                if size > 40_000:
                    yield made(rows)
                    rows, size = [], 0
            if bare:
                yield pa.RecordBatch.from_pylist([{"doc_id": b} for b in bare], schema)
                bare = []
        if rows:
            yield made(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, digest binary, samples binary, bands array<long>")


def digest_of(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def features_of(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """(digest, found, weights) of texts: their digest, their shingles as sorted 64-bit hashes, and a 32-bit weight for each."""
    names = ["digest", "found", "weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _WordIds()
        for batch in in_slices(batches, 200):
            rows = []
            for text in batch["text"].to_pylist():
                words = words_of(text)
                found, times = shingles(words, ids)
                rows.append((digest_of(words), found.astype("<u8").tobytes(), weigh(found, times, idf).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(3)], names)

    return texts.select("text").mapInArrow(run, "digest binary, found binary, weights binary")


def _features(found: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(found, "<u8"), np.frombuffer(weights, "<f4")


@F.arrow_udf(T.IntegerType())
def _agreed(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.int32())
    x, y = (np.frombuffer(b"".join(v.to_pylist()), "<u4").reshape(len(v), -1) for v in (a, b))
    return pa.array((x == y).sum(1), pa.int32())


@F.arrow_udf(T.DoubleType())
def _similar(found_a: pa.Array, weights_a: pa.Array, found_b: pa.Array, weights_b: pa.Array) -> pa.Array:
    rows = zip(*(values_of(c, 100) for c in (found_a, weights_a, found_b, weights_b)), strict=True)
    return pa.array([weighted_jaccard(_features(a, u), _features(b, v)) for a, u, b, v in rows], pa.float64())


def verified(pairs: DataFrame, reps: DataFrame, features: DataFrame, threshold: float) -> DataFrame:
    """The (a, b) of ``pairs`` (computed, distinct) of at least ``threshold`` weighted Jaccard similarity.

    Up to BROADCAST_IDS pairs go to the rows of b, which then move once, to those of a; more are joined by shuffle.
    """

    def joined(found: DataFrame, n: int, rows: DataFrame, columns: list[str]) -> DataFrame:
        side = lambda name: rows.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))
        if n > BROADCAST_IDS:
            return join_hot(join_hot(found, side("b"), "b"), side("a"), "a", salt_by="b", counted=found)
        firsts = cut(fewer(found.select("a").distinct(), n))
        return join_hot(side("b").join(F.broadcast(found), "b"), side("a").join(F.broadcast(firsts), "a", "left_semi"), "a", salt_by="b", counted=found)

    if not (n := pairs.count()):
        return pairs
    near = fewer(cut(joined(pairs, n, reps, ["samples"]).filter(_agreed("samples_a", "samples_b") >= LEAST_AGREED).select("a", "b")), n)
    n = near.count()
    whole = joined(near, n, features, ["found", "weights"])
    return cut(fewer(whole.filter(_similar("found_a", "weights_a", "found_b", "weights_b") >= threshold).select("a", "b").distinct(), n))


def _bounds(a: list[tuple[np.ndarray, np.ndarray]], b: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """At least the weighted Jaccard similarity of each of ``a`` with each of ``b``.

    The geometric mean of two weights is at least the lesser, and equal to it for equal weights.
    """
    x, y = (np.concatenate([f[0] for f in side]) for side in (a, b))
    u, v = (np.sqrt(np.concatenate([f[1] for f in side])) for side in (a, b))
    i, j = (np.repeat(np.arange(len(side)), [len(f[0]) for f in side]) for side in (a, b))
    both = np.intersect1d(x, y)
    shared = np.zeros((len(a), len(b)))
    if len(both):
        parts = []
        for h, w, row in ((x, u, i), (y, v, j)):
            at = np.searchsorted(both, h)
            at[at == len(both)] = 0
            mine = both[at] == h
            order = np.argsort(at[mine], kind="stable")
            parts.append((at[mine][order], w[mine][order], row[mine][order]))
        (ca, wa, ra), (cb, wb, rb) = parts
        na, nb = np.bincount(ca, minlength=len(both)), np.bincount(cb, minlength=len(both))
        few = na * nb <= FEW_PAIRS
        start = np.cumsum(nb) - nb
        sparse = np.flatnonzero(few[ca])
        for part in np.array_split(sparse, int(nb[ca[sparse]].sum()) // PAIRS_AT_ONCE + 1):
            each = nb[ca[part]]
            at = np.repeat(start[ca[part]] - np.cumsum(each) + each, each) + np.arange(each.sum())
            left = np.repeat(part, each)
            shared += np.bincount(ra[left] * len(b) + rb[at], wa[left] * wb[at], shared.size).reshape(shared.shape)
        place = np.cumsum(~few) - 1
        many_a, many_b = ~few[ca], ~few[cb]
        for low in range(0, int((~few).sum()), COLUMNS):
            dense = []
            for c, w, r, many, n in ((ca, wa, ra, many_a, len(a)), (cb, wb, rb, many_b, len(b))):
                here = many & (place[c] >= low) & (place[c] < low + COLUMNS)
                m = np.zeros((n, COLUMNS), np.float32)
                m[r[here], place[c[here]] - low] = w[here]
                dense.append(m)
            shared += dense[0] @ dense[1].T
    whole = np.array([f[1].sum(dtype=float) for f in a])[:, None] + np.array([f[1].sum(dtype=float) for f in b])[None, :] - shared
    return np.where(whole > 0, shared / np.maximum(whole, 1e-30), 1.0)


def _block_links(threshold: float):
    """A function of two blocks of a bucket: links between rows of theirs that are of different roots.

    A pair is compared in the first band it shares. Of pairs that others already join, none is given.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (x, ids_x, root_x), (y, ids_y, root_y) = ((np.frombuffer(b"".join(t["samples"].to_pylist()), "<u4").reshape(t.num_rows, -1), t["node"].to_pylist(), t["root"].to_pylist()) for t in (left, right))
        number = {k: i for i, k in enumerate(sorted({*ids_x, *ids_y, *root_x, *root_y}))}
        of = lambda names: np.array([number[k] for k in names])
        band, agreed, earlier = left["band"][0].as_py(), np.zeros((len(x), len(y)), np.uint8), np.zeros((len(x), len(y)), bool)
        for k in range(0, SAMPLES, ROWS):
            same = [x[:, j, None] == y[None, :, j] for j in range(k, k + ROWS)]
            for each in same:
                agreed += each
            if k // ROWS < band:
                earlier |= np.logical_and.reduce(same)
        open_ = (agreed >= LEAST_AGREED) & ~earlier & (of(root_x)[:, None] != of(root_y)[None, :])
        if left["i"][0].as_py() == left["j"][0].as_py():
            open_ &= of(ids_x)[:, None] < of(ids_y)[None, :]
        rows, columns = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(rows):
            return schema.empty_table()
        features = lambda t, at: list(map(_features, *(t[c].take(pa.array(at)).to_pylist() for c in ("found", "weights"))))
        a, b = features(left, rows), features(right, columns)
        open_ = open_[np.ix_(rows, columns)] & (_bounds(a, b) >= threshold - 1e-4)
        up: dict[bytes, bytes] = {}

        def top(node: bytes) -> bytes:
            while (above := up.get(node, node)) != node:
                up[node] = node = up.get(above, above)
            return node

        out = []
        for i, j in zip(*np.nonzero(open_), strict=True):
            one, other = top(root_x[rows[i]]), top(root_y[columns[j]])
            if one != other and weighted_jaccard(a[i], b[j]) >= threshold:
                up[max(one, other)] = min(one, other)
                out.append(sorted((ids_x[rows[i]], ids_y[columns[j]])))
        return pa.table({"a": [p[0] for p in out], "b": [p[1] for p in out]}, schema)

    return run


def rest_links(slots: DataFrame, roots: DataFrame, reps: DataFrame, features: DataFrame, threshold: float, tried: DataFrame) -> DataFrame:
    """Verified links (a, b) between members of a bucket that have different roots: all pairs of each bucket.

    Pairs of small buckets are rows. In larger ones, the members of another root than the bucket's
    first are dealt to blocks, and each block is compared with each of them and of the others.
    """
    spark = features.sparkSession
    n = slots.count()
    rooted = cut(fewer(slots.select("node", "key", "band").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), n))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.min(F.struct("node", "root")).getField("root").alias("first_root"), F.count("*").alias("n")).filter("least <> most")
    rooted = cut(fewer(join_hot(rooted, mixed.select("key", "first_root", "n"), "key"), n))
    if not rooted.limit(1).count():
        return tried.limit(0)
    small = rooted.filter(F.col("n") <= PAIRED_ROWS)
    side = lambda name: small.select("key", F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
    pairs = side("a").join(side("b"), "key").filter("a < b and a_root <> b_root").select("a", "b").distinct()
    links = verified(cut(pairs.join(tried, ["a", "b"], "left_anti")), reps, features, threshold)

    large = rooted.filter(F.col("n") > PAIRED_ROWS)
    if not large.limit(1).count():
        return links
    large = _small(large.withColumn("open", F.col("root") != F.col("first_root")).drop("first_root", "n"))
    large = features.join(reps.select("node", "samples").join(large, "node"), "node")
    path = fresh_path(spark, "near-blocks")
    large.write.parquet(path)
    blocks = lambda rows: F.greatest(F.ceil(F.count(F.when(rows, 1)) / BLOCK_ROWS), F.ceil(F.coalesce(F.sum(F.when(rows, F.octet_length("found"))), F.lit(0)) / BLOCK_BYTES)).cast("int")
    dealt = cut(spark.read.parquet(path).groupBy("key").agg(blocks(F.col("open")).alias("n_open"), blocks(~F.col("open")).alias("n_closed")))
    hashed, last = F.xxhash64("node", F.lit(7)), F.col("n_open") + F.col("n_closed") - 1
    block = F.when(F.col("open"), F.pmod(hashed, F.col("n_open"))).otherwise(F.col("n_open") + F.pmod(hashed, F.greatest("n_closed", F.lit(1)))).cast("int")
    of = lambda: join_hot(spark.read.parquet(path), dealt, "key").withColumn("block", block)
    columns = ["key", "i", "j", "node", "root", "band", "samples", "found", "weights"]
    left = of().filter("open").select("*", F.col("block").alias("i"), F.explode(F.sequence("block", last)).alias("j")).select(columns)
    right = of().select("*", F.col("block").alias("j"), F.explode(F.sequence(F.lit(0), F.least("block", F.col("n_open") - 1))).alias("i")).select(columns)
    cell = ["key", "i", "j"]
    found = cut(left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_block_links(threshold), "a binary, b binary").distinct())
    drop_path(spark, path)
    return links.unionByName(found)


def _small(rows: DataFrame) -> DataFrame:
    """``rows`` computed, and broadcast where they are few."""
    side = cut(rows)
    return F.broadcast(side) if side.count() <= BROADCAST_IDS else side


def _texts_of(docs: DataFrame, sketched: DataFrame, nodes: DataFrame) -> DataFrame:
    """(text) of at least one row for each of ``nodes`` (least); equal rows once."""
    ids = _small(nodes.select(F.col("least").alias("doc_id")).distinct())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = docs.join(ids, "doc_id", "left_semi")
    without = ids.filter("doc_id is null").limit(1).count()
    if without:
        texts = texts.unionByName(docs.filter("doc_id is null"))
    repeated = sketched.count() > sketched.select("doc_id").distinct().count()
    return texts.select("text").distinct() if repeated or without else texts.select("text")


def near_links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node), one for each of ``docs``, and links (a, b) between nodes; a node is all rows of equal words.

    Nodes are ordered by their least ids. Each is first compared with the least it shares a bucket
    with. Members of large buckets that this leaves in different classes are compared with the
    bucket's least member and with another by hash, and all pairs of a bucket that are still in
    different classes with each other. Nothing in a bucket is left out by its size.
    """
    idf = idf_table(*document_frequencies(docs))
    sketched = cut(sketches(docs, idf))
    rows = sketched.count()
    sketched = fewer(sketched, rows)
    grouped = sketched.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("samples").alias("samples"), F.first("bands").alias("bands"))
    order = F.unhex(F.lpad(F.hex(F.coalesce("least", F.lit((1 << 63) - 1)).bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))
    reps = cut(fewer(grouped.select(F.concat(order, "digest").alias("node"), "digest", "least", "samples", "bands"), rows))
    keyed = reps.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = cut(fewer(keyed.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1"), BANDS * rows))
    slots = cut(fewer(join_hot(keyed, buckets, "key", hot=hot_keys(buckets, "key", "n")), BANDS * rows))
    members = join_hot(sketched.select("doc_id", "digest"), reps.select("digest", "node"), "digest", "left").select("doc_id", "node")
    if not (n := slots.count()):
        return members, slots.select(F.col("node").alias("a"), F.col("node").alias("b"))
    path = fresh_path(docs.sparkSession, "near-features")
    slots = fewer(slots, n)
    wanted = cut(fewer(reps.join(slots.select("node").distinct(), "node", "left_semi"), n).select("digest", "node", "least"))
    known = features_of(_texts_of(docs, sketched, wanted), idf)
    known.join(_small(wanted.select("digest", "node")), "digest").drop("digest").write.parquet(path)
    features = docs.sparkSession.read.parquet(path)

    tried = cut(fewer(slots.filter("node <> first").groupBy(F.col("node").alias("b")).agg(F.min("first").alias("a")).select("a", "b"), n))
    links = verified(tried, reps, features, threshold)
    roots = cut(connected_components(links))
    crowded = cut(slots.filter(F.col("n") > PAIRED_ROWS))
    if crowded.limit(1).count():
        others = crowded.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node")).getField("node").alias("other"))
        large = fewer(join_hot(crowded, others, "key"), n).select("node", F.explode(F.array("first", "other")).alias("lead")).filter("node <> lead").distinct()
        root = lambda rows, side: join_hot(rows, roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
        apart = fewer(root(cut(fewer(root(cut(fewer(large, 2 * n)), "node"), 2 * n)), "lead"), 2 * n).filter("node_root <> lead_root")
        more = cut(fewer(apart.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), 2 * n))
        links, tried = links.unionByName(verified(more, reps, features, threshold)), tried.unionByName(more)
        roots = cut(connected_components(links))
    rest = rest_links(slots, roots, reps, features, threshold, tried)
    links = cut(fewer(roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(rest), 2 * n))
    drop_path(docs.sparkSession, path)
    return members, links


def _classed(docs: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, node, root, class_id) of every row; ``root`` is the node that stands for a class, null without words."""
    members, links = near_links(docs, threshold)
    roots = cut(connected_components(links))
    members = cut(members)
    rooted = cut(fewer(join_hot(members, roots, "node", "left").withColumn("root", F.coalesce("root", "node")), members.count()))
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return join_hot(rooted, least, "root", "left").select("doc_id", "node", "root", F.coalesce("class_id", "doc_id").alias("class_id"))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of every row; the class id is the least id of its class.

    Null, empty and wordless texts are classes of their own, under their ids. A row of null id joins
    a class like any other; its class is null where no member has an id. Rows that repeat an id are
    classed by their texts, apart where these differ. Columns other than doc_id and text are left
    out; an empty table gives no rows.
    """
    return _classed(docs, threshold).select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the document of least id.

    Among rows that repeat that id the least by a hash of the whole row stays, so reruns agree; of
    rows without words, one of each id. Rows of null id all stay. All columns of the input are kept.
    """
    classes = cut(_classed(docs.select("doc_id", "text"), threshold).filter("doc_id is not null"))
    per_id = classes.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    gone = cut(per_id.filter("class_id <> doc_id or n > 1").select(F.col("doc_id").alias("gone_id"), (F.col("n") > 1).alias("repeats")))
    side = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rows = docs.select(F.struct("*").alias("doc")).join(side, F.col("doc.doc_id") == F.col("gone_id"), "left")
    alone = rows.filter("gone_id is null").select("doc.*")
    if not gone.filter("repeats").limit(1).count():
        return alone
    roots = classes.join(gone.filter("repeats"), F.col("doc_id") == F.col("gone_id"), "left_semi").select("doc_id", F.substring("node", 9, 16).alias("known_digest"), "root", "class_id").distinct()
    known = roots.withColumnRenamed("doc_id", "known_id")
    again = rows.filter("repeats").select("doc", "gone_id", _digest(F.col("doc.text")).alias("digest"))
    rank = F.struct(F.xxhash64(F.to_json("doc")), F.to_json("doc"))
    again = again.groupBy("gone_id", "digest").agg(F.min_by("doc", rank).alias("doc"))
    again = again.join(known, (F.col("gone_id") == F.col("known_id")) & F.col("digest").eqNullSafe(F.col("known_digest"))).filter("class_id = gone_id")
    one = again.groupBy("gone_id", "root").agg(F.min_by("doc", rank).alias("doc"))
    return alone.unionByName(one.select("doc.*"))


@F.arrow_udf(T.BinaryType())
def _digest(texts: pa.Array) -> pa.Array:
    return pa.array([digest_of(words) if (words := words_of(t)) else None for t in values_of(texts, 200)], pa.binary())


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its class and whether it is the one that stays, over all documents."""
    classes = near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
