"""SentencePiece by chunk tables and the audit of sources."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenrow.llm import registry, sentence_pieces, source_divergence
from tests.test_queries import normal

ODD = ["", " ", "   ", "▁", " ▁ a", "a ", "\x00", "a　b c", "😀  😀x ", "<s> </s> ▁▁▁▁▁x", "é ​", "\t\n a\r\n"]

# ---- sentence pieces ----


@pytest.fixture(scope="module")
def chunk_table():
    return sentence_pieces.ChunkTable(sentence_pieces.model_path())


def ids(found):
    return [np.frombuffer(x, "<u4").tolist() for x in found]


def due_ids(chunk_table, texts):
    return chunk_table.model.encode(texts, add_bos=True, add_eos=True)


def test_chunks_of_odd_texts_give_the_librarys_ids(chunk_table):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(" ▁ab\n\té漢😀<s>0") for _ in range(rng.randrange(80))) for _ in range(3000)]
    assert chunk_table.apart
    assert ids(chunk_table.encode(texts)) == due_ids(chunk_table, texts)


def test_tables_begun_anew_and_long_texts_in_stretches_change_nothing(chunk_table, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(9))) for _ in range(n)) for n in (0, 1, 5000, 3, 700)] + ["x" * 5000, "a" + " " * 3000 + "b"]
    monkeypatch.setattr(sentence_pieces, "STRETCH", 101)
    monkeypatch.setattr(sentence_pieces, "MOST_CHUNKS", 40)
    assert max(sum(1 for _ in sentence_pieces.stretches_of(t)) for t in texts) > 100
    assert ids(chunk_table.encode(texts)) == due_ids(chunk_table, texts)


def test_each_distinct_chunk_is_segmented_once_a_table():
    fresh = sentence_pieces.ChunkTable(sentence_pieces.model_path())
    fresh.encode(["one two two", "two three  three"] * 50)
    assert fresh.segmented == len({" one", " two", " three", "  three"})


def test_a_vocabulary_whose_pieces_cross_markers_segments_whole_texts(chunk_table, monkeypatch):
    monkeypatch.setattr(chunk_table, "apart", False)
    assert ids(chunk_table.encode(ODD)) == due_ids(chunk_table, ODD)


def test_sentence_pieces_query_equals_the_library(spark, sf, chunk_table):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = registry.QUERIES["op11_sentence_pieces"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        due = due_ids(chunk_table, [texts[r.doc_id]])[0]
        assert (r.n_tokens, r.ids_sha256) == (len(due), hashlib.sha256(np.array(due, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(chunk_table.model.decode(due).encode()).hexdigest()


def test_sentence_pieces_of_odd_rows(spark, chunk_table):
    rows = [(1, None, "a", {"k": 1}), (1, None, "a", {"k": 1}), (None, "two  words", "b", None), (2, "", None, {}), (3, "word " * 40_000, "c", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, doc map<string,int>")
    got = sentence_pieces.decode(sentence_pieces.encode(docs)).collect()
    both = sentence_pieces.encode(docs, decode=True).collect()
    assert sorted((r.ids, r.decoded) for r in both) == sorted((r.ids, r.decoded) for r in got)
    assert sorted((r.doc.ids or "", r.decoded) for r in got) == sorted((i or "", t or "") for _, t, i, _ in rows)
    assert ids([next(r.ids for r in got if r.doc.doc_id == 3)]) == due_ids(chunk_table, ["word " * 40_000])
    assert sentence_pieces.encode(docs.limit(0)).count() == 0


# ---- source divergence ----


def walked(rows, least, top):
    """Plain loops over (text, lang, source)."""
    counts, held, groups = {}, Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        held.update({(lang, t) for t in terms})
        counts.setdefault((lang, source), Counter()).update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in held.items() if x == lang and n >= least]
        own = {s: counts[lang, s] for x, s in groups if x == lang}
        whole = sum(own.values(), Counter())

        def share(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        shares, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s, p in shares.items():
            pairs = sorted((-sum(apart(p[t], o[t]) for t in kept), x.encode(), x) for x, o in shares.items() if x != s)
            terms = sorted((-apart(p[t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[t] > q[t])
            out += [(lang, s, "pair", x, -v, k) for k, (v, _, x) in enumerate(pairs, 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(terms[:top], 1)]
    return sorted(out)


def test_source_divergence_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = normal(registry.QUERIES["op13_source_divergence"](spark, sf).toPandas())
    due = normal(con.sql(registry.ORACLES["op13_source_divergence"]).df())
    assert len(got) > 100 and got.equals(due)


def test_source_divergence_equals_plain_loops_with_ties_and_odd_rows(spark):
    rng = random.Random(5)
    words = ["Aa", "aa", "É", "é", "b_c", "x1y", "漢字", "ﬁ", "zz", "Zz", "q"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(12))), rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s2", "S1", None, "é"])) for _ in range(160)]
    rows += rows[:40] + [(None, "en", "none"), ("", "xx", "y"), ("", "xx", "z"), ("rare", "yy", None), ("same " * 50_000, "en", "long")]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows], "text string, lang string, source string, term string, n int")
    for least, top in ((10, 10), (2, 3)):
        got = source_divergence.divergence(docs, least, top).collect()
        assert sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in got) == walked(rows, least, top)
    assert {(r["source"], r["value"]) for r in source_divergence.divergence(docs).filter("lang = 'xx'").collect()} == {("y", 0), ("z", 0)}
    assert source_divergence.divergence(docs.limit(0)).count() == 0


def test_shares_are_exact_beyond_a_long(spark):
    row = spark.range(1).select(source_divergence._share(F.lit(3 * 10**13), F.lit(9 * 10**13), F.lit(7)).alias("p")).first()
    assert row.p == 1 + 10**9 * (3 * 10**13 + 2) // (9 * 10**13 + 14)
