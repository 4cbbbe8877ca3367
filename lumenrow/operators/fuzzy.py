"""Pairs of titles that read almost alike and share their first and last words.

What two texts match in order is a common subsequence, so a similarity says how many letters of each may be
missing. That bounds how far from its like a matched letter can be, and how many three-letter grams of a text may
be absent from the other near their places. Titles that share their words with many others are dealt to blocks,
where the grams of all are looked up at once; the bit-parallel length of the longest common subsequence bounds
what is left, before the ratio itself is taken.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenrow.operators.tables import materialised

GRAM = 3
#: Titles of either side in a block, and their letters; a longer title is one of a block's.
BLOCK_TITLES, BLOCK_LETTERS = 2_048, 1 << 21
#: Titles whose lengths fit are looked up in so many bands of lengths at most, of so many titles at least.
BANDS, BAND_TITLES = 8, 16
LEAST_LETTERS, LEAST_WORDS = 8, 2
#: First and last words with more pairs of titles than this are compared in blocks.
DIRECT_PAIRS = 50
#: Beyond so many pairs of letters the longest common subsequence takes longer than it saves.
MOST_LETTER_PAIRS = 10**8
#: Letters after which a subsequence is looked at again, whether it can still be long enough.
CHECKED_LETTERS = 16


def least_matched(n: int | np.ndarray, m: int | np.ndarray, least: float) -> int | np.ndarray:
    """Letters that texts of ``n`` and ``m`` letters match if their ratio is at least ``least``."""
    return np.ceil(least * (n + m) / 2 - 1e-9).astype(np.int64)


def _letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths of texts, where each begins among the letters of all, and for each letter a hash of the gram that begins there."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer(("".join(texts) + "\0" * (GRAM - 1)).encode("utf-32-le"), np.uint32)
    grams = np.zeros(len(codes) - GRAM + 1, np.uint32)
    for k in range(GRAM):
        grams = (grams ^ codes[k : k + len(grams)]) * np.uint32(0x9E3779B1)
        grams ^= grams >> np.uint32(15)
    return sizes, np.cumsum(sizes) - sizes, grams


def near_grams(left: list[str], right: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of two lists, of texts that are not empty, whose lengths fit and whose grams lie near enough to be alike.

    Where ``least_matched`` letters match, x of the left text and y of the right are missing. The like of a letter at
    place i is from i - x to i + y, and at most GRAM * x + (GRAM - 1) * y of the left grams have none there. Places are
    told apart by steps and grams by a hash, so that some may seem to have a like, but none to lack one.
    """
    left_order, right_order = (np.argsort([len(t) for t in texts], kind="stable") for texts in (left, right))
    n, starts, grams = _letters([left[i] for i in left_order])
    m, own_starts, own_grams = _letters([right[k] for k in right_order])
    place = np.arange(len(grams)) - np.repeat(starts, n)
    whole = place <= np.repeat(n, n) - GRAM
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    # Longer texts are cut into longer steps, and hashed to more values, as more grams are near a place.
    for step, group in itertools.groupby(range(len(m)), lambda k: max(4, int(m[k]).bit_length() - 6)):
        group, bits = list(group), min(8 + step, 18)
        low, high = np.searchsorted(n, least * m[group[0]] / (2 - least) - 1), np.searchsorted(n, m[group[-1]] * (2 - least) / least + 1)
        if low == high:
            continue
        begin, end = starts[low], starts[high - 1] + n[high - 1]
        slots = np.where(whole[begin:end], ((place[begin:end] >> step) << bits | grams[begin:end] >> np.uint32(32 - bits)) + 1, 0)
        last_step = (n[high - 1] - 1) >> step
        absent = np.ones(((last_step + 1) << bits) + 1, np.uint8)
        absent[0] = 0
        for k in group:
            own = own_grams[own_starts[k] : own_starts[k] + max(m[k] - GRAM + 1, 0)] >> np.uint32(32 - bits)
            fit = low + np.flatnonzero(2.0 * np.minimum(n[low:high], m[k]) >= least * (n[low:high] + m[k]))  # neighbours, as lengths are in order
            for band in np.array_split(fit, min(max(len(fit) // BAND_TITLES, 1), BANDS)) if len(fit) else ():
                matched = least_matched(n[band], m[k], least)
                x, y = n[band] - matched, m[k] - matched
                far, at = int(x.max()), np.arange(len(own))
                first = np.maximum(at - int(y.max()), 0) >> step
                steps = first[:, None] + np.arange(((far + int(y.max())) >> step) + 2)
                near = steps <= np.minimum((at + far) >> step, last_step)[:, None]
                near = (steps << bits | own[:, None])[near] + 1
                absent[near] = 0
                gone = np.add.reduceat(absent[slots[starts[band[0]] - begin : starts[band[-1]] + n[band[-1]] - begin]], starts[band] - starts[band[0]], dtype=np.int32)
                absent[near] = 1
                alike = band[gone <= GRAM * x + (GRAM - 1) * y]
                found.append((left_order[alike], np.full(len(alike), right_order[k])))
    return tuple(np.concatenate(side) for side in zip(*found, strict=True))


def letter_places(text: str) -> dict[str, int]:
    """For each letter of a text the bits of its places."""
    places: dict[str, int] = {}
    for i, letter in enumerate(text):
        places[letter] = places.get(letter, 0) | 1 << i
    return places


def common_subsequence(a: str, b: str, due: int = 0, places: dict[str, int] | None = None) -> int:
    """The length of the longest common subsequence, a bit for each letter of ``a``; some number below ``due`` if it is less than that."""
    if due > min(len(a), len(b)):
        return 0
    places = letter_places(a) if places is None else places
    whole = (1 << len(a)) - 1
    row = whole
    for j, letter in enumerate(b, 1):
        met = row & places.get(letter, 0)
        row = (row + met | row - met) & whole
        if due and j % CHECKED_LETTERS == 0:
            # Letters of ``a`` beyond this have their like further on in ``b``, if enough are matched.
            reach = min(j + len(a) - due, len(a))
            matched = reach - (row & (1 << reach) - 1).bit_count()
            if matched + len(b) - j < due:
                return matched
    return len(a) - row.bit_count()


def may_reach(a: str, b: str, least: float, places: dict[str, int] | None = None) -> bool:
    """Whether the letters that two texts have in common, in order but for very long ones, let them be similar; ``places`` are those of ``a``."""
    due = math.ceil(least * (len(a) + len(b)) / 2 - 1e-9)
    if len(a) * len(b) > MOST_LETTER_PAIRS:
        return (Counter(a) & Counter(b)).total() >= due
    return common_subsequence(a, b, due, places) >= due


def _near_in_blocks(least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left["title_key"].combine_chunks(), right["learned_key"].combine_chunks()
        titles, others, kept, at, places = a.to_pylist(), b.to_pylist(), [], None, {}
        for i, k in zip(*near_grams(titles, others, least), strict=True) if len(a) and len(b) else ():  # by k
            if titles[i] != others[k]:
                at, places = (k, places) if k == at else (k, letter_places(others[k]))
                if may_reach(others[k], titles[i], least, places):
                    kept.append((i, k))
        i, k = zip(*kept, strict=True) if kept else ((), ())
        return pa.table({"title_key": a.take(pa.array(i, pa.int64())), "learned_key": b.take(pa.array(k, pa.int64()))})

    return run


def bounded_ratio(a: Column, b: Column, least: float) -> Column:
    """Ratcliff-Obershelp similarity of two texts, null where it is surely below ``least``.

    To the planner it is not deterministic: a filter on it is else computed below the exchange that deals out its
    pairs, and the column again above.
    """
    import difflib

    @F.arrow_udf("double")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        pairs = zip(x.to_pylist(), y.to_pylist(), strict=True)
        return pa.array([1.0 if p == q else difflib.SequenceMatcher(None, p, q).ratio() if may_reach(p, q, least) else None for p, q in pairs], pa.float64())

    return run.asNondeterministic()(a, b)


def fuzzy_titles(candidates: DataFrame, learned: DataFrame, least: float = 0.88, direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """Pairs (title_key, learned_key, ratio) that are at least so similar and share their first and last words.

    Both sides need LEAST_LETTERS and LEAST_WORDS; null keys take no part, and each pair is given once.
    """
    side = lambda titles, candidate: titles.select("title_key", F.lit(candidate).alias("candidate"), F.lit(not candidate).alias("learned"))
    both = side(candidates, True).unionByName(side(learned, False))
    return near_titles(both.groupBy("title_key").agg(F.bool_or("candidate").alias("candidate"), F.bool_or("learned").alias("learned")), least, direct_pairs)


def near_titles(titles: DataFrame, least: float = 0.88, direct_pairs: int = DIRECT_PAIRS) -> DataFrame:
    """:func:`fuzzy_titles` of distinct keys (title_key) that say whether they are ``candidate`` and whether ``learned``.

    First and last words with more than ``direct_pairs`` pairs are compared in blocks of BLOCK_TITLES by BLOCK_TITLES.
    """
    spark, key = titles.sparkSession, F.col("title_key")
    rows = titles.filter((F.length(key) >= LEAST_LETTERS) & (F.length(key) - F.length(F.replace(key, F.lit(" "), F.lit(""))) >= LEAST_WORDS - 1))
    rows = materialised(spark, rows.select("title_key", "candidate", "learned", F.concat_ws(" ", F.substring_index(key, " ", 1), F.substring_index(key, " ", -1)).alias("_words")))
    # Both come from one table: columns of new names are new columns.
    a, b = rows.filter("candidate").select("title_key", "_words"), rows.filter("learned").select("title_key", "_words").toDF("learned_key", "_words")
    of = lambda side: (F.count_if(side), F.coalesce(F.sum(F.when(F.col(side), F.length(key))), F.lit(0)))
    blocks = lambda n, letters: F.greatest(F.ceil(n / BLOCK_TITLES), F.ceil(letters / BLOCK_LETTERS))
    (n, n_letters), (m, m_letters) = of("candidate"), of("learned")
    crowd = rows.groupBy("_words").agg((n * m).alias("_pairs"), blocks(n, n_letters).alias("_of_a"), blocks(m, m_letters).alias("_of_b"))
    crowd = materialised(spark, crowd.filter(F.col("_pairs") > direct_pairs).drop("_pairs"))
    # Lengths that can reach the ratio are at most one step apart.
    step = lambda c: F.floor(F.log(F.length(c).cast("double")) / math.log((2 - least) / least)).cast("int")
    crowded = not crowd.isEmpty()
    # What pairs cost is not seen in their bytes, by which partitions would be made fewer.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    # Crowds are few, as each has many titles; joined by a shuffle, all titles would be written again for either side.
    crowd = F.broadcast(crowd)
    few = [x.join(crowd, "_words", "left_anti") if crowded else x for x in (a, b)]
    near = few[0].withColumn("_step", step(F.col("title_key"))).join(few[1].withColumn("_step", F.explode(F.array(*(step(F.col("learned_key")) + d for d in (-1, 0, 1))))), ["_words", "_step"])
    met = near.select("title_key", "learned_key")
    if crowded:
        own = lambda name, of: F.pmod(F.xxhash64(name), F.col(of)).alias(f"{of}_no")
        every = lambda of: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(of) - 1)).alias(f"{of}_no")
        left = a.join(crowd, "_words").select("title_key", "_words", own("title_key", "_of_a"), every("_of_b"))
        right = b.join(crowd, "_words").select("learned_key", "_words", own("learned_key", "_of_b"), every("_of_a"))
        block = ["_words", "_of_a_no", "_of_b_no"]
        left, right = (x.repartition(tasks, *block) for x in (left, right))
        met = met.unionByName(left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(_near_in_blocks(least), "title_key string, learned_key string"))
    n, m = F.length("title_key"), F.length("learned_key")
    fits = (2.0 * F.least(n, m) >= least * (n + m)) & (F.col("title_key") != F.col("learned_key"))
    met = met.filter(fits).repartition(tasks, "title_key", "learned_key").withColumn("ratio", bounded_ratio(F.col("title_key"), F.col("learned_key"), least)).filter(F.col("ratio") >= least)
    same = rows.filter("candidate and learned").select("title_key", key.alias("learned_key"), F.lit(1.0).alias("ratio"))
    return met.unionByName(same)
