"""Toxicity by a learned lexicon, matched through Levenshtein automata, and context windows.

Labelled documents give a lexicon of words and word stems whose counts, by the log-likelihood ratio,
stand out in toxic texts. The lexicon is a trie; its product with the Levenshtein automaton of
distance one is determinised as words are read, so that a word costs one step a character. Each hit is
scored in its window: quotation marks and reporting words around it count it as quoted. A small
logistic model over the log-odds of plain, quoted and misspelled hits gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.llm.common import cut, held_out, in_slices, table, values_of

#: At most so many labelled rows, first by a hash of their ids, are used to learn.
MAX_LABELLED = 20_000
MIN_G2 = 22.0
MIN_DOCUMENTS = 4
#: The lexicon is learned in so many rounds, each from the toxic documents that the last ones miss.
ROUNDS = 3
#: Entries are at least so many times likelier in toxic than in clean documents.
MIN_LIFT = 4.0
#: Log-odds from which an entry is all but sure, and of plain hits that are enough for a document.
PURE = 3.4
ENOUGH = 5.0
STEM_LENGTHS = (4, 5, 6, 7, 8, 9)
MIN_FUZZY = 4
#: The share of a word's toxic uses that is taken to be misspelled, and odds too small to count.
MISSPELLED = 0.02
TRACE = 1e-9
WINDOW = 6
CACHE_WORDS = 300_000
MAX_STATES = 20_000
_TOKEN = re.compile(r"\w+|[\"“”„«»‹›]")
QUOTES = frozenset('"“”„«»‹›')
#: Words that report speech.
REPORTING = frozenset("said says say wrote writes quote quoted quotes called reported according term word slur insult dit écrit citation selon sagte schrieb zitat laut dijo escribió cita según".split())


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


class LexiconAutomaton:
    """The trie of a lexicon crossed with the automaton of at most ``edits`` insertions, deletions and substitutions.

    States are sets of (trie node, edits so far), determinised on demand; each knows which entries it
    accepts. Words match whole, stems whatever they begin. Entries in ``loose`` of at least
    ``MIN_FUZZY`` letters match within ``edits``, others without any.
    """

    def __init__(self, words: Iterable[str], stems: Iterable[str], loose: Iterable[str] | None = None, edits: int = 1) -> None:
        entries = [(w, w) for w in words] + [(s, s + "*") for s in stems]
        loose = {entry for _, entry in entries} if loose is None else set(loose)
        self.children: list[dict[str, int]] = [{}]
        #: The words and stems that end at each node.
        self.ends: list[list[str]] = [[]]
        self.edits = edits
        for text, entry in entries:
            node = 0
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(entry)
        self.loose = {entry for text, entry in entries if len(text) >= MIN_FUZZY and entry in loose}
        self._forget()

    def _forget(self) -> None:
        """Begin to determinise anew, so that what many words have left takes bounded memory."""
        self.sets: dict[tuple, int] = {}
        self.pairs: list[frozenset[tuple[int, int]]] = []
        self.begun: list[frozenset[tuple[str, int]]] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[tuple[str, ...], tuple[str, ...]]] = []
        self.start = self._state({(0, 0)}, frozenset())

    def _state(self, pairs: set[tuple[int, int]], begun: frozenset[tuple[str, int]]) -> int:
        """The number of the deterministic state for ``pairs``, what deletions add to them, and the stems ``begun`` with their edits."""
        left, closed = list(pairs), set(pairs)
        while left:
            node, used = left.pop()
            if used < self.edits:
                for child in self.children[node].values():
                    if (child, used + 1) not in closed:
                        closed.add((child, used + 1))
                        left.append((child, used + 1))
        best: dict[int, int] = {}
        for node, used in closed:
            best[node] = min(used, best.get(node, used))
        ended = [(entry, used) for node, used in best.items() for entry in self.ends[node] if not used or entry in self.loose]
        least: dict[str, int] = dict(begun)
        for entry, used in ended:
            if entry.endswith("*"):
                least[entry] = min(used, least.get(entry, used))
        begun = frozenset(least.items())
        key = (frozenset(best.items()), begun)
        if key not in self.sets:
            self.sets[key] = len(self.pairs)
            self.pairs.append(key[0])
            self.begun.append(begun)
            self.steps.append({})
            found = sorted({(entry, used) for entry, used in ended if not entry.endswith("*")} | begun)
            self.accepts.append((tuple(e for e, used in found if not used), tuple(e for e, used in found if used)))
        return self.sets[key]

    def _step(self, state: int, c: str) -> int:
        reached: set[tuple[int, int]] = set()
        for node, used in self.pairs[state]:
            child = self.children[node].get(c)
            if child is not None:
                reached.add((child, used))
            if used < self.edits:
                reached.add((node, used + 1))
                reached.update((x, used + 1) for x in self.children[node].values())
        to = self._state(reached, self.begun[state]) if reached or self.begun[state] else -1
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """The entries that a lower-cased word has exactly, and those it has within edits; stems end with ``*``."""
        if len(self.pairs) > MAX_STATES:
            self._forget()
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return (), ()
        return self.accepts[state]


@dataclass
class ToxicityModel:
    """``words`` and ``stems`` have the log-odds of each entry; a word that has no entry takes that of its longest stem."""

    words: dict[str, float]
    stems: dict[str, float]
    clean_words: frozenset[str] = frozenset()
    #: Log-odds of a misspelling of a word, and of a word that a misspelled stem begins, under its ``*``.
    loose: dict[str, float] = field(default_factory=dict)
    #: For 1 and the features of :meth:`features`.
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0, 0.0)
    _automaton: LexiconAutomaton | None = field(default=None, repr=False)
    _cache: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None, "_cache": {}}

    @property
    def entries(self) -> dict[str, float]:
        """The log-odds of all entries, stems under their ``*``."""
        return self.words | {s + "*": odds for s, odds in self.stems.items()}

    @property
    def pure(self) -> dict[str, float]:
        """Entries that are all but sure and long enough to be known misspelled."""
        return {e: odds for e, odds in self.entries.items() if odds >= PURE and len(e.rstrip("*")) >= MIN_FUZZY}

    def match(self, word: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        if self._automaton is None:
            self._automaton = LexiconAutomaton(self.words, self.stems, self.pure)
        return self._automaton.match(word)

    def code(self, word: str) -> float:
        """The log-odds of a word that the lexicon has, the negative of those of a misspelling, else 0."""
        exact, near = self.match(word)
        if exact:
            found = self.words.get(word) or self.stems[max(exact, key=len).rstrip("*")]
        elif near and word not in self.clean_words:
            found = -self.loose.get(self.meant(word), TRACE)
        else:
            found = 0.0
        if len(self._cache) >= CACHE_WORDS:
            self._cache.clear()
        self._cache[word] = found
        return found

    def meant(self, word: str) -> str:
        """The likeliest of the entries that the product automaton finds within an edit of ``word``; empty if there is none."""
        odds = lambda e: self.stems[e[:-1]] if e.endswith("*") else self.words[e]
        return max(self.match(word)[1], key=lambda e: (odds(e), e), default="")

    def evidence(self, text: str | None) -> tuple[list[float], set[str]]:
        """Sums over the hits of a whole text, and its misspelled words.

        The sums: log-odds of plain hits, misspellings included; of hits that are quoted; of plain
        hits that are all but sure; plain hits for each 100 words. All hits count, a word's k-th by 1 / k.
        """
        words, get, code = tokens(text), self._cache.get, self.code
        odds = [code(w) if (k := get(w)) is None else k for w in words]
        plain = quoted = sure = 0.0
        spelled, times = set(), Counter()
        for at, found in enumerate(odds) if any(odds) else ():
            if found:
                times[words[at]] += 1
                share, weight = quotation(words, at), abs(found) / times[words[at]]
                if found < 0:
                    spelled.add(words[at])
                plain += (1 - share) * weight
                quoted += share * weight
                sure += (1 - share) * weight * (abs(found) >= PURE)
        return [plain, quoted, sure, 100 * plain / (len(words) + 100)], spelled

    @staticmethod
    def features(sums: list[float]) -> list[float]:
        return [1.0, *map(math.log1p, sums)]

    def score(self, text: str | None) -> float:
        z = sum(w * x for w, x in zip(self.weights, self.features(self.evidence(text)[0]), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def quotation(words: list[str], at: int) -> float:
    """How surely the word at ``at`` is quoted, 0 to 1: quotation marks on both sides of it in its window, or words that report."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    marked = any(w in QUOTES for w in before) and any(w in QUOTES for w in after)
    reported = any(w in REPORTING for w in before) or any(w in REPORTING for w in after)
    return min(1.0, 0.7 * marked + 0.3 * reported)


def _labelled(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return cut(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))


def _term_counts(sample: DataFrame, known: ToxicityModel) -> DataFrame:
    """(term, toxic, clean): documents with each word, and each stem marked by ``*``, summed in tasks before the shuffle.

    Toxic documents in which ``known`` finds enough are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}

        def out() -> pa.RecordBatch:
            terms = list(seen[True].keys() | seen[False].keys())
            made = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[True][t] for t in terms], pa.int64()), pa.array([seen[False][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])
            seen[True].clear()
            seen[False].clear()
            return made

        for batch in in_slices(batches):
            for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
                if toxic == 1 and known.evidence(text)[0][0] >= ENOUGH:
                    continue
                words = {w for w in tokens(text) if w not in QUOTES}
                seen[toxic == 1].update(words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) > n})
                if len(seen[False]) > 400_000:
                    yield out()
        yield out()

    return sample.mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _lexicon(rows: list[tuple[str, float, int, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """Words with their log-odds, and stems that gather clearly more than any one word they begin.

    ``rows`` has (term, log-odds, toxic documents, log-likelihood ratio). Of stems that begin each
    other the one of the highest ratio stays.
    """
    words = {t: odds for t, odds, _, _ in rows if not t.endswith("*")}
    counts = {t: n for t, _, n, _ in rows}
    stems: dict[str, float] = {}
    for term, odds, n, _ in sorted((r for r in rows if r[0].endswith("*")), key=lambda r: (-r[3], r[0])):
        stem = term[:-1]
        most = max((counts[w] for w in words if w.startswith(stem)), default=0)
        if n >= 1.4 * most and not any(stem.startswith(s) or s.startswith(stem) for s in stems):
            stems[stem] = odds
    return words, stems


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Weights that fit ``y`` by Newton's method, drawn to ``prior`` by ``ridge``."""
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), gradient)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """A model from at most ``max_labelled`` labelled documents.

    Of a repeated id the highest label and the least text count; null ids and labels do not. Without toxic or without clean rows the lexicon is empty and every text gets the share of toxic ones.
    """
    sample = _labelled(docs, labels, max_labelled)
    n_toxic, n = sample.agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)), F.lit(0)), F.count("*")).first()
    base = (n_toxic + 0.5) / (n + 1)
    if not 0 < n_toxic < n:
        return ToxicityModel({}, {}, weights=(math.log(base / (1 - base)), 0.0, 0.0, 0.0, 0.0))
    model = ToxicityModel({}, {})
    for _ in range(ROUNDS):
        missed = sum(y and sums[0] < ENOUGH for y, sums, _ in _collect_evidence(sample, model))
        words, stems = _lexicon(_outstanding(sample, model, missed, n - n_toxic)) if missed else ({}, {})
        if not words.keys() - model.words.keys() and not stems.keys() - model.stems.keys():
            break
        model = ToxicityModel(words | model.words, stems | model.stems)
    found = _collect_evidence(sample, model)
    clean = Counter(w for y, _, spelled in found if not y for w in spelled)
    #: A word near the lexicon that another clean text has is no misspelling; one that no other has may be, as it may be in texts to come.
    novel = [{w: model.meant(w) for w in spelled if clean[w] - (not y) <= 0} for y, _, spelled in found]
    near = Counter(meant for (y, _, _), words in zip(found, novel, strict=True) if not y for meant in set(words.values()))
    loose = {e: _misspelled(odds, near[e] / (n - n_toxic), 1 / (n - n_toxic)) for e, odds in model.pure.items()}
    for (_, sums, _), words in zip(found, novel, strict=True):
        sums[0] += sum(loose[m] for m in words.values())
        sums[2] += sum(loose[m] for m in words.values() if loose[m] >= PURE)
    x = np.array([model.features(sums) for _, sums, _ in found])
    y = np.array([float(r[0]) for r in found])
    prior = np.array([math.log(base / (1 - base)) - 1, 1.0, 0.3, 1.0, 0.5])
    weights = _logistic(x, y, prior, np.array([0.01, 0.3, 0.3, 0.3, 0.3]))
    return ToxicityModel(model.words, model.stems, frozenset(clean), loose, tuple(float(w) for w in np.maximum(weights, [-np.inf, 0, 0, 0, 0])))


def _misspelled(odds: float, seen: float, one: float) -> float:
    """Log-odds of a misspelling of a word: MISSPELLED of its toxic uses against what clean texts have near it.

    ``seen`` is the share of clean texts with a word near it that no other clean text has, ``one`` the
    share of a single text. A word's clean share is what its odds leave of its toxic one.
    """
    return min(odds, max(TRACE, math.log(MISSPELLED * math.exp(odds) * one / (seen + 0.5 * one))))


def _outstanding(sample: DataFrame, known: ToxicityModel, n_toxic: int, n_clean: int) -> list[tuple[str, float, int, float]]:
    """(term, log-odds, toxic documents, log-likelihood ratio) of what stands out in toxic documents that ``known`` misses."""
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    expected = (t + c) * (n_toxic / (n_toxic + n_clean))
    part = lambda k, e: F.when(k > 0, k * F.ln(k / e)).otherwise(F.lit(0.0))
    rows = _term_counts(sample, known).withColumn("ratio", 2 * (part(t, expected) + part(c, (t + c) - expected)))
    rows = rows.withColumn("lift", (t + 0.2) / (n_toxic + 0.2) * (n_clean + 1.0) / (c + 0.5))
    #: Each has MIN_DOCUMENTS toxic documents of the bounded sample at least, so these are bounded with it.
    chosen = rows.filter((t >= MIN_DOCUMENTS) & (F.col("lift") >= MIN_LIFT) & (F.col("ratio") >= MIN_G2)).collect()
    return [(r["term"], min(9.0, math.log(r["lift"])), r["toxic"], r["ratio"]) for r in chosen]


def _collect_evidence(sample: DataFrame, model: ToxicityModel) -> list[tuple[bool, list[float], list[str]]]:
    """Label, sums and misspelled words, each once, of every row of the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = [model.evidence(text) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["toxic"].cast(pa.int32()), pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([sorted(r[1]) for r in rows], pa.list_(pa.string()))], ["toxic", "sums", "spelled"])

    return [(r["toxic"] == 1, r["sums"], r["spelled"]) for r in sample.mapInArrow(run, "toxic int, sums array<double>, spelled array<string>").collect()]


def toxicity(model: ToxicityModel) -> Callable:
    """A column function: the score, 0 to 1, of each whole text.

    Null, empty and wordless texts get that of no hits; rows are scored one by one, so repeated ones
    score alike, an empty table gives no rows, and other columns, whatever their names, are not read.
    """

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in values_of(texts)], pa.float64())

    return score


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest: every document scored by a model of the labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id"), 5, 0))
    scored = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), toxicity(fit(docs, labels))(F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))
