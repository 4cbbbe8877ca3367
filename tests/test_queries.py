"""Every registered query of the library against its DuckDB SQL, and the entry module's contract."""

import os
import re

import duckdb
import pandas as pd
import pytest

from lumenrow.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame({c: frame[c] for c in sorted(frame.columns)})
    for c in out:
        if out[c].dtype.kind == "f":
            out[c] = out[c].round(6)
        out[c] = out[c].map(lambda v: "null" if v is None or v is pd.NaT or v is pd.NA or v != v else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = normal(catalog.QUERIES[name](spark, sf).toPandas())
    due = normal(duck.sql(catalog.ORACLES[name]).df())
    assert list(got.columns) == list(due.columns)
    assert len(got) == len(due)
    differ = (got != due).any(axis=1)
    assert not differ.any(), f"{int(differ.sum())} rows differ, first {got[differ].head(1).to_string()[:300]} and {due[differ].head(1).to_string()[:300]}"


def test_move_batches_equal_their_sql_where_a_price_is_half_a_hundredth(spark, tmp_path):
    """Prices of which a 200th ends in half a hundredth and decides the second, alone and in orders that repeat."""
    con = duckdb.connect()
    prices = "select c as o_custkey, c * 97 + 1 as o_orderkey, c / 100.0::double as o_totalprice from (select unnest(generate_series(669900, 30000000, 20000)) c)"
    con.sql(f"copy (select * from ({prices}), range(2) t(i) where i = 0 or o_custkey % 3 = 0) to '{tmp_path}/orders.parquet'")
    con.sql(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    assert normal(catalog.QUERIES["q50_move_batches"](spark, str(tmp_path)).toPandas()).equals(normal(con.sql(catalog.ORACLES["q50_move_batches"]).df()))


def test_queries_without_sql_are_those_that_are_walked_below():
    assert catalog.QUERIES.keys() - catalog.ORACLES.keys() == {"q27_clean_text", "q28_cue_builder", "q29_fuzzy_titles"}


def test_clean_text_equals_a_plain_walk(spark, sf):
    """Pages of five lines: markers, numbers and titles go, and pages are sewn where a line flows on."""
    got = {r.doc_id: r for r in catalog.QUERIES["q27_clean_text"](spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert got.keys() == {d for d, t in texts.items() if t} | {d for d, t in texts.items() if not t and d in got} and not any(r.has_marker or r.has_title for r in got.values())
    plain = 0
    for doc_id, text in texts.items():
        lines = (text or "").split("\n")
        lines = lines[:-1] if lines[-1] == "" else lines
        if not lines or not all(re.fullmatch(r"[^\W\d_][^#%0-9\"“”]*[.!?]", x) and x[0].isupper() and x == " ".join(x.split()) for x in lines) or any("opposite" in x or "above" in x or "below" in x for x in lines):
            continue
        #: Lines that are sentences stay as they are; pages are paragraphs apart.
        pages = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)]
        assert got[doc_id].chars == len("\n\n".join(pages)), doc_id
        plain += 1
    assert plain >= 10


def test_cue_builder_equals_a_plain_walk(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    due = []
    for conv in sorted({r.conv_id for r in turns}):
        words = [w for r in sorted((r for r in turns if r.conv_id == conv), key=lambda r: r.turn) for w in re.split(r"\s+", r.text or "")]
        timed, cues, cue = [((i + 1) / 3, (i + 2) / 3, w) for i, w in enumerate(words)], [], []
        for start, end, word in timed:
            if not word:
                continue
            if cue and (len(" ".join(w for *_, w in cue)) + 1 + len(word) > 84 or end - cue[0][0] > 6.5):
                cues, cue = [*cues, cue], []
            cue.append((start, end, word))
            if word[-1] in ".!?…,;:" and end - cue[0][0] >= 1.2 and len(" ".join(w for *_, w in cue)) >= 18:
                cues, cue = [*cues, cue], []
        cues += [cue] if cue else []
        due += [(conv, n, round(c[0][0], 6), round(c[-1][1], 6), " ".join(w for *_, w in c)) for n, c in enumerate(cues)]
    got = [(r.media_id, r.cue_no, round(r.start_s, 6), round(r.end_s, 6), r.text) for r in catalog.QUERIES["q28_cue_builder"](spark, sf).collect()]
    assert sorted(got) == sorted(due) and len(due) > 50


def test_fuzzy_titles_equal_a_plain_walk(spark, sf):
    """Lines of documents that repeat, and lines that read almost like them."""
    import difflib
    import unicodedata
    from collections import Counter

    def key(line):
        text = " ".join(unicodedata.normalize("NFKC", line).replace("_", " ").split())
        while text and (text[0].isspace() or unicodedata.category(text[0])[0] in "PS"):
            text = text[1:]
        while text and (text[-1].isspace() or unicodedata.category(text[-1])[0] in "PS"):
            text = text[:-1]
        return text.casefold()

    counts = Counter(key(x) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text for x in r.text.split("\n") if x.strip())
    fit = [k for k in counts if len(k) >= 8 and len(k.split(" ")) >= 2]
    blocks: dict = {}
    for k in fit:
        blocks.setdefault((k.split(" ")[0], k.split(" ")[-1]), []).append(k)
    due = set()
    for b in (k for k in fit if counts[k] >= 2):
        for a in blocks[b.split(" ")[0], b.split(" ")[-1]]:
            if difflib.SequenceMatcher(None, a, b).ratio() >= 0.88:
                due.add((a, b))
    got = {(r.title_key, r.learned_key) for r in catalog.QUERIES["q29_fuzzy_titles"](spark, sf).collect()}
    assert got == due and len(due) >= 3


def test_entry_has_rows_and_every_oracle_a_query(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("left", [(), ("lumenrow/llm",), ("lumenrow/llm", "lumenrow/llm/__pycache__"), ("corpus_pipeline.py",)])
def test_entry_imports_without_the_training_data_package(tmp_path, left):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/lumenrow", tmp_path / "lumenrow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for path in left:
        if path.endswith(".py"):
            shutil.copy(f"{root}/{path}", tmp_path)
        else:
            (tmp_path / path).mkdir()
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'q01_popularity_report' in e.queries(); e.oracle_sql()"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
