"""Learned decision lists over text statistics.

Statistics of a text are built-in expressions of one row. From those of labelled documents,
sequential covering grows conjunctions of thresholds by FOIL gain on two thirds of the rows, prunes
them on the rest, and keeps a rule while it is precise there. The list becomes one ordered CASE
expression, so that judging a corpus is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.llm.common import ASCII_SPACE, GAP_PATTERN, let, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: At most so many labelled rows, first by a hash of their ids, are collected to learn the rules.
MAX_LABELLED = 20_000
FEATURES = ("n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "mark_share")


def _repeated(words: Column, n: Column) -> Column:
    """Words inside windows of 8 that occur at least twice among ``words``; windows meet by hash, and are equal if their words are."""

    def covered(found: Column) -> Column:
        gaps = F.transform(found, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get(found, k + 1), at + WINDOW) - at))
        return F.aggregate(gaps, F.lit(0), lambda total, gap: total + gap)

    def twins(ranked: Column) -> Column:
        window = lambda x: F.slice(words, x["i"] + 1, WINDOW)
        same = lambda a, b: F.coalesce((a["h"] == b["h"]) & (window(a) == window(b)), F.lit(False))
        kept = F.transform(ranked, lambda a, k: F.when(same(a, F.get(ranked, k + 1)) | F.when(k > 0, same(a, F.get(ranked, k - 1))).otherwise(F.lit(False)), a["i"]))
        return F.sort_array(F.filter(kept, lambda i: i.isNotNull()))

    def counted(hashes: Column) -> Column:
        ranked = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(let(ranked, twins), covered))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WINDOW))))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(n <= WINDOW, F.lit(0)).otherwise(let(hashes, counted))


def text_statistics(text: Column) -> Column:
    """A struct of whole-text counts; a null text counts as empty, where all are 0.

    n_words, word_chars (code points in words), n_symbols (of ``#*$%&|<>``), n_lines and n_dup_lines
    (lines that hold a word, and those of them equal to an earlier one), n_repeat_words (words in
    8-word windows found twice or more), n_distinct words, n_upper letters, n_marks (``!``).
    """
    text = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(text, F.lit(ASCII_SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP_PATTERN))
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(ASCII_SPACE)) != "")

    def counts(ws: Column) -> Column:
        return let(
            F.struct(ws.alias("ws"), F.size(ws).alias("n")),
            lambda x: F.struct(
                x["n"].cast("long").alias("n_words"),
                F.length(F.array_join(x["ws"], "")).cast("long").alias("word_chars"),
                F.size(F.array_distinct(x["ws"])).cast("long").alias("n_distinct"),
                _repeated(x["ws"], x["n"]).cast("long").alias("n_repeat_words"),
            ),
        )

    def joined(c: Column) -> Column:
        line_counts = let(lines, lambda ls: F.struct(F.size(ls).alias("n"), F.size(F.array_distinct(ls)).alias("d")))
        return let(
            line_counts,
            lambda ls: F.struct(
                *(c[k].alias(k) for k in ("n_words", "word_chars", "n_distinct", "n_repeat_words")),
                F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
                ls["n"].cast("long").alias("n_lines"),
                (ls["n"] - ls["d"]).cast("long").alias("n_dup_lines"),
                F.regexp_count(text, F.lit("\\p{Lu}")).cast("long").alias("n_upper"),
                F.regexp_count(text, F.lit("!")).cast("long").alias("n_marks"),
            ),
        )

    return let(let(words, counts), joined)


def features(s: Column) -> dict[str, Column]:
    """The numbers that rules are learned on, from a statistics struct; 0 where a text has no words."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    return dict(
        zip(
            FEATURES,
            (
                s["n_words"].cast("double"),
                share(s["word_chars"], s["n_words"]),
                share(s["n_symbols"], s["n_words"]),
                share(s["n_dup_lines"], s["n_lines"]),
                share(s["n_repeat_words"], s["n_words"]),
                share(s["n_distinct"], s["n_words"]),
                share(s["n_upper"], s["word_chars"]),
                share(s["n_marks"], s["n_words"]),
            ),
            strict=True,
        )
    )


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass(frozen=True)
class Rule:
    """Documents that meet every (feature, is_at_least, threshold) are rejected."""

    terms: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def condition(self, values: dict[str, Column]) -> Column:
        met = F.lit(True)
        for name, at_least, threshold in self.terms:
            met = met & (values[name] >= threshold if at_least else values[name] <= threshold)
        return met


def learn_rules(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = FEATURES, max_rules: int = 12, max_terms: int = 4, min_precision: float = 0.9, min_covered: int = 5) -> list[Rule]:
    """Ordered rules that pick the rows where ``bad`` is true; none where one class is missing.

    A rule is kept if, on the pruning third, it is at least ``min_precision`` precise and, over all
    rows not covered before, it covers at least ``min_covered`` bad ones.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    prune = np.arange(len(bad)) % 3 == 2
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 129))) if len(x) else np.empty(0) for f in range(len(names))]

    def met(terms: list[tuple[int, bool, float]], rows: np.ndarray) -> np.ndarray:
        ok = rows.copy()
        for f, at_least, t in terms:
            ok &= x[:, f] >= t if at_least else x[:, f] <= t
        return ok

    while len(rules) < max_rules and (bad & left).any() and (~bad & left).any():
        terms: list[tuple[int, bool, float]] = []
        rows = left & ~prune
        while len(terms) < max_terms and (rows & ~bad).any() and (rows & bad).any():
            p0, n0 = (rows & bad).sum(), rows.sum()
            best = (0.0, None)
            for f, cut in enumerate(cuts):
                v = x[rows, f]
                order = np.argsort(v, kind="stable")
                seen = np.concatenate([[0], np.cumsum(bad[rows][order])])
                below = np.searchsorted(v[order], cut, "right")
                under = np.searchsorted(v[order], cut, "left")
                for at_least, p, n in ((False, seen[below], below), (True, seen[-1] - seen[under], len(v) - under)):
                    gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - np.log2(p0 / n0)), 0)
                    if (k := int(np.argmax(gain))) >= 0 and gain[k] > best[0] + 1e-9:
                        best = (float(gain[k]), (f, at_least, float(cut[k])))
            if best[1] is None:
                break
            terms.append(best[1])
            rows = met(terms, left & ~prune)
        if not terms:
            break

        def worth(t: list[tuple[int, bool, float]]) -> float:
            got = met(t, left & prune)
            p, n = (got & bad).sum(), (got & ~bad).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
            terms = terms[:-1]
        tested, every = met(terms, left & prune), met(terms, left)
        precision = ((tested & bad).sum() + 1e-12) / (tested.sum() + 1e-12) if tested.any() else (every & bad).sum() / max(1, every.sum())
        if precision < min_precision or (every & bad).sum() < min_covered:
            break
        rules.append(Rule(tuple((names[f], a, t) for f, a, t in terms), float(precision), int(every.sum())))
        left &= ~every
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules from at most ``max_labelled`` labelled documents; the lowest label of a repeated id counts."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    texts = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    stats = texts.select("doc_id", "quality", text_statistics(F.col("text")).alias("s"))
    rows = stats.select("doc_id", "quality", *(v.alias(k) for k, v in features(F.col("s")).items())).orderBy(F.xxhash64("doc_id")).limit(max_labelled).collect()
    x = np.array([[r[k] for k in FEATURES] for r in rows], float).reshape(-1, len(FEATURES))
    return learn_rules(x, np.array([r["quality"] == 0 for r in rows], bool))


def keeps(rules: list[Rule], s: Column) -> Column:
    """The list as one conditional expression: the first rule a document meets rejects it."""
    values = features(s)
    verdict = F.when(base_failed(s), F.lit(False))
    for rule in rules:
        verdict = verdict.when(rule.condition(values), F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc, stats, base_failed, kept) for each row; ``doc`` is the whole input row, extra columns included.

    Null and empty texts fail the base test (no words). Rows are judged one by one, so repeated rows
    get equal verdicts and an empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("doc"), text_statistics(F.col("text")).alias("stats"))
    return rows.select("doc", "stats", base_failed(F.col("stats")).alias("base_failed"), keeps(rules, F.col("stats")).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`judge` over all documents with rules from all labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = judge(docs, fit(docs, table(spark, sf_dir, "labels")))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select(F.col("doc.doc_id").alias("doc_id"), *(F.col(f"stats.{k}").alias(k) for k in counts), "base_failed", "kept")
