"""The corpus pipeline, stage by stage, against plain sequential steps over the same rows."""

import hashlib
import re
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenrow.llm import near_dedup, packing, quality_rules
from tests.llm.test_corpus_operators import brute_classes, fill
from tests.llm.test_filters_and_scores import WORD, base_spans, brute_statistics

MORE = (
    rb"gh[pousr]_[A-Za-z0-9]+",
    rb"xox[abpr]-[0-9]+-[0-9A-Za-z\-]+",
    rb"[sr]k_live_[0-9A-Za-z]+",
)
LEAST = (40, 20, 24)


@pytest.fixture(scope="module")
def documents(spark, sf):
    """Documents with nulls, empty and long texts, exact copies, repeated rows and ids, and a secret."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    long = " ".join(f"word{i}" for i in range(30_000)) + "."
    good = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").join(d, "doc_id").filter("n_chars between 400 and 2000").orderBy("doc_id").limit(3).collect()
    plain, other, third = (r.text + f" password=abcdef12{i} end." for i, r in enumerate(good))
    rows = [(-1, None, None, None, None), (-2, "", "en", "web", 0), (None, plain, "en", None, len(plain)), (-3, long, "en", "web", len(long)), (-4, long.upper(), "en", "web", len(long))]
    rows += [(-5, other, "en", None, 1), (-5, other, "en", None, 1), (-5, third, "en", None, 1)]
    return d.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*(F.col(c).cast(t) for c, t in d.dtypes)))


def keeps(rules, text):
    text = text or ""
    n, chars, symbols, dup, repeat = brute_statistics(text)
    if n < 20 or 100 * repeat > 30 * n:
        return False
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    share = lambda a, b: a / b if b else 0.0
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    values = dict(zip(quality_rules.FEATURES, (n, share(chars, n), share(symbols, n), share(dup, len(lines)), share(repeat, n), share(len(set(words)), n), share(upper, chars), share(text.count("!"), n)), strict=True))
    return not any(all(values[f] >= t if at_least else values[f] <= t for f, at_least, t in rule.terms) for rule in rules)


def redacted(text):
    data = text.encode()
    spans = [(a, k, b) for a, k, b in base_spans(data)]
    spans += sorted((m.start(), 3 + i, m.end()) for i, (rule, least) in enumerate(zip(MORE, LEAST, strict=True)) for m in re.finditer(rule, data) if m.end() - m.start() >= least)
    names = ("assign", "access", "hex", "github", "slack", "stripe")
    out, at = b"", 0
    for a, k, b in sorted(spans):
        if b > at:
            out += data[at:a] + f"[{names[k]}]".encode() if a >= at else b""
            at = b
    return (out + data[at:]).decode()


def test_stages_equal_plain_steps(spark, sf, documents):
    stages, columns = dict(corpus_pipeline.STAGES), documents.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "secret_scan", "source_mixing", "best_fit_packing"]
    key = lambda r: tuple(map(str, r))

    def stage(name, docs):
        out = stages[name](spark, docs, sf)
        rows = out.collect()
        return rows, spark.createDataFrame(rows, out.schema)

    rules = quality_rules.fit(documents, spark.read.parquet(f"{sf}/labels.parquet"))
    kept, docs = stage("quality_rules", documents)
    assert docs.columns == columns and sorted(kept, key=key) == sorted((r for r in documents.collect() if keeps(rules, r.text)), key=key) and len(kept) < documents.count()

    texts = {}
    for r in kept:
        texts.setdefault((r.doc_id, r.text), r)
    classes = brute_classes(dict(enumerate(t for _, t in texts)), *near_dedup.document_frequencies(docs))
    ids, due = [i for i, _ in texts], []
    for root in set(classes.values()):
        members = [ids[k] for k in classes if classes[k] == root]
        least = min((i for i in members if i is not None), default=None)
        due += [None] * members.count(None) if least is None else [least] + [None] * members.count(None)
    unique, docs = stage("near_dedup", docs)
    assert docs.columns == columns and Counter(r.doc_id for r in unique) == Counter(due) and set(unique) <= set(kept)

    clean, docs = stage("secret_scan", docs)
    due = [(r.doc_id, redacted(r.text), r.lang, r.source, len(redacted(r.text)) if redacted(r.text) != r.text else r.n_chars) for r in unique]
    assert docs.columns == columns and sorted(map(key, clean)) == sorted(map(key, due)) and any("[assign]" in r.text for r in clean)

    sizes = Counter()
    for r in clean:
        sizes[r.source] += len(WORD.findall(r.text))
    targets, due = fill(dict(sizes)), Counter()
    for r in clean:
        rate = targets[r.source] / sizes[r.source]
        digest = hashlib.md5(f"mix-1:{'' if r.doc_id is None else r.doc_id}:{hashlib.md5(r.text.encode()).hexdigest()}".encode()).hexdigest()
        due[key(r)] += int(rate) + (int(digest[:13], 16) / 16**13 < rate - int(rate))
    mixed, docs = stage("source_mixing", docs)
    assert docs.columns == columns and Counter(map(key, mixed)) == +due

    mine, due = packing.WordTokenizer(packing.vocabulary_path()), Counter()
    for r in mixed:
        data = mine.encode(r.text) + (1).to_bytes(4, "little")
        for k, at in enumerate(range(0, len(data), 4 * 4096)):
            due[(r.doc_id, k, at // 4, len(data[at : at + 16384]) // 4, zlib.crc32(data[at : at + 16384]))] += 1
    packed = stages["best_fit_packing"](spark, docs, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == due
    ends = Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096 and len(ends) <= -(-sum(r.length for r in packed) // 4096) + 1


def test_run_gives_every_stage_the_rows_of_the_one_before(spark, sf, monkeypatch):
    seen = []

    def watched(name, function):
        def run(spark, docs, sf_dir):
            out = function(spark, docs, sf_dir)
            seen.append((name, docs.count()))
            return out

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*stage) for stage in corpus_pipeline.STAGES])
    out = corpus_pipeline.run(spark, sf)
    counts = [n for _, n in seen]
    assert counts[0] == spark.read.parquet(f"{sf}/documents.parquet").count() and counts[0] > counts[1] > counts[2] == counts[3] and out.count() >= counts[4] > 0


def test_stages_of_empty_tables_and_clashing_columns(spark, sf, documents):
    clashing = documents.limit(60).withColumn("doc", F.lit(1)).withColumn("kept", F.lit(2)).withColumn("digest", F.lit("x")).withColumn("map", F.create_map(F.lit("k"), F.col("source")))
    clashing = clashing.unionByName(clashing.filter("doc_id = 7"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, clashing, sf).columns == clashing.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), sf).count() == 0
