"""Running sums, blocks that hand on, chains, combined corpora in chunks and landed pages, against plain walks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lumenrow.operators import chunking, layout, lines, sequences
from lumenrow.sources import paged_api


def test_running_sums_over_a_global_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(5), rng.choice([None, 1, 7])) for i in range(3000)]
    frame = spark.createDataFrame(rows, "k int, _at int, v int").repartition(7)
    got = sequences.running(frame, [F.desc("k")], {"no": F.lit(1), "total": F.col("v")}).orderBy(F.desc("k")).collect()
    total = 0
    for place, (r, (k, at, v)) in enumerate(zip(got, reversed(rows), strict=True)):
        assert (r.k, r["_at"], r.v, r.no, r.total) == (k, at, v, place, total)
        total += v or 0
    assert sequences.running(frame.limit(0), [F.asc("k")], {"no": F.lit(1)}).count() == 0


def test_walks_over_chains_of_any_length_forks_and_cycles(spark):
    nexts = {f"a{i}": f"a{i + 1}" for i in range(130)} | {"x1": "a100", "c1": "c2", "c2": "c3", "c3": "c1", "lone": "nowhere"}
    links = spark.createDataFrame(list(nexts.items()) + [("a130", None)], "id string, next string")
    starts = ["a0", "x1", "lone", "a130", "unknown", "c2"]
    due = set()
    for start in starts:
        at, step, seen = start, 0, set()
        while at is not None and at not in seen:
            due.add((at, start, step))
            seen.add(at)
            at, step = nexts.get(at), step + 1
    assert {tuple(r) for r in sequences.walked(links, spark.createDataFrame([(s,) for s in starts], "id string")).collect()} == due
    assert sequences.walked(links, links.limit(0).select("id")).count() == 0


WORDS = ["Word ", "end. ", "x", "\n\n", "\n \n", "Why? ", "longlonglong "]


@pytest.mark.parametrize("budget, stretch", [(40, 2), (77, 64)])
def test_a_combined_corpus_in_chunks_is_that_of_one_text(spark, monkeypatch, budget, stretch):
    rng = random.Random(budget)
    docs = [(f"d{i}", "".join(rng.choice(WORDS) for _ in range(rng.randrange(40)))) for i in range(200)] + [("d5", "again."), ("d7", ""), ("open", "what never ends")]
    frame = spark.createDataFrame(docs, "name string, text string").repartition(5)
    monkeypatch.setattr(chunking, "STRETCH_BUDGETS", stretch)
    got = sorted(tuple(r) for r in chunking.combined_chunks(frame, budget).collect())
    assert got == sorted(tuple(r) for r in chunking.chunk_by_length(chunking.combined_corpus(frame), budget).collect()) and len(got) > 200


@pytest.mark.parametrize("closing", [0, 0.02, 0.3, 1])
def test_a_combined_corpus_in_many_parts_is_that_of_one_text(spark, closing):
    """texts stay in their parts; blocks and chunks go on over parts, of which some hold no end of a sentence, and the last is open."""
    rng = random.Random(str(closing))
    body = lambda: "\n\n".join(" ".join(rng.choice(WORDS).strip().strip(".?") or "x" for _ in range(rng.randrange(12))) + ("." if rng.random() < closing else "") for _ in range(rng.randrange(5)))
    docs = [(f"page {i}", body()) for i in range(120)] + [("page 7", "again"), ("page 7", "again"), ("page 999", "what never ends")]
    frame = spark.createDataFrame(docs, "name string, text string").repartition(3)
    due = sorted(tuple(r) for r in chunking.chunk_by_length(chunking.combined_corpus(frame), 60).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert sorted(tuple(r) for r in chunking.combined_chunks(frame, 60).collect()) == due and len(due) > 50
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_combined_corpus_is_checkpointed_once(spark):
    """seven checkpoints held all texts, and as many shuffles."""
    from lumenrow.operators.tables import shared_folder

    rng = random.Random(6)
    docs = [(f"page {i}", " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=9)) for _ in range(400)) + ".") for i in range(400)]
    frame = spark.createDataFrame(docs, "name string, text string")
    folder = shared_folder(spark).removeprefix("file:")
    size = lambda: sum(os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(folder) for f in fs)
    before = size()
    assert chunking.combined_chunks(frame, 3000).count() > 400
    assert size() - before < 2 * sum(len(t) for _, t in docs)


def test_odd_combined_corpora(spark):
    empty = spark.createDataFrame([], "name string, text string")
    assert chunking.combined_chunks(empty, 40).count() == 0
    one = spark.createDataFrame([("a", "no end")], "name string, text string")
    assert [tuple(r) for r in chunking.combined_chunks(one, 40).collect()] == [("all", 0, "### Source image: a\n\nno end", 27)]
    with pytest.raises(Exception, match="longer than the budget"):
        chunking.combined_chunks(spark.createDataFrame([("a", "x" * 50)], "name string, text string"), 40).collect()


def test_packing_goes_as_a_plain_loop_does(spark, monkeypatch):
    monkeypatch.setattr(chunking, "STRETCH_BUDGETS", 2)
    rng = random.Random(9)
    texts = ["y" * rng.choice([1, 2, 3, 9, 10]) for _ in range(600)]
    due = [texts[0]]
    for t in texts[1:]:
        if len(due[-1]) + 1 + len(t) <= 10:
            due[-1] += f" {t}"
        else:
            due.append(t)
    got = chunking.packed(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), [F.col("i")], 10, " ")
    assert [r.text for r in got.orderBy("chunk_no").collect()] == due


def test_blocks_of_lines_change_nothing(spark):
    """One document of a third of all lines, in blocks of five lines and of all."""
    rng = random.Random(2)
    rows = [(0 if i % 3 == 0 else i % 7, i, rng.choice(["", " ", "Open", "closed.", "  Why? ", "and"])) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id int, n int, line string")
    for f in (lines.neighbours_nonblank, lines.sentence_islands):
        assert sorted(map(tuple, f(frame, 5).collect())) == sorted(map(tuple, f(frame, 10**6).collect()))
    due, open_ = {}, {}
    for doc, _, line in rows:
        text = line.strip()
        if not text:
            open_.pop(doc, None)
            continue
        if doc not in open_:
            due.setdefault(doc, []).append(text)
            open_[doc] = True
        else:
            due[doc][-1] += f" {text}"
        if text[-1] in ".?":
            open_.pop(doc)
    got = lines.sentence_islands(frame, 5).collect()
    assert sorted((r.doc_id, r.group_no, r.text) for r in got) == sorted((d, k, t) for d, ts in due.items() for k, t in enumerate(ts))
    spans = spark.createDataFrame([(i % 3 % 2, i, float(i * i % 97), float(i * i % 97 + 3)) for i in range(400)], "page int, i int, top double, bottom double")
    islands = lambda b: sorted(map(tuple, lines.gap_islands(spans, "page", [F.asc("top"), F.asc("i")], F.col("top"), F.col("bottom"), 1.0, block_rows=b).collect()))
    assert islands(7) == islands(None)


def landed(spark, pages, details, channels=None):
    channels = channels or [("https://y.com/@a", {"items": [{"id": "UC1", "snippet": {"title": "A"}, "contentDetails": {"relatedPlaylists": {"uploads": "P"}}}]})]
    ids = lambda vs: [{"contentDetails": {"videoId": v}} for v in vs]
    uploads = [("P", token, json.dumps({"items": ids(vs)} | ({"nextPageToken": n} if n is not None else {}))) for token, vs, n in pages]
    videos = [(json.dumps({"items": [{"id": v, "statistics": {"viewCount": "3"}, "snippet": {"title": f"t {v}"}} for v in vs]}),) for vs in details]
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return frame([(u, json.dumps(a)) for u, a in channels], "channel_url string, answer string"), frame(uploads, "playlist_id string, page_token string, answer string"), frame(videos, "answer string")


def test_landed_pages_are_read_in_the_order_of_their_tokens(spark):
    pages = [("t9", ["v5", "v6"], ""), (None, ["v1", "v2"], "t7"), ("t7", ["v3", None, "v4"], "t9"), ("t7", ["v3", None, "v4"], "t9"), ("stray", ["v9"], "t7")]
    tables = landed(spark, pages, [["v1", "v3"], ["v4", "v5", "v9", "v1"]])
    got = paged_api.landed_scan(*tables).orderBy("pos").collect()
    assert [(r.channel_url, r.channel_id, r.channel_title, r.pos, r.video_id) for r in got] == [("https://y.com/@a", "UC1", "A", k, v) for k, v in enumerate(["v1", "v3", "v4", "v5"])]
    assert json.loads(got[1].detail) == {"id": "v3", "statistics": {"viewCount": "3"}, "snippet": {"title": "t v3"}}
    assert [r.video_id for r in paged_api.landed_scan(*tables, most=2).orderBy("pos").collect()] == ["v1", "v3"]
    assert [r.view_count for r in paged_api.videos_of(paged_api.landed_scan(*tables)).collect()] == [3] * 4


def test_landed_scans_end_where_pages_are_empty_missing_or_broken(spark):
    for pages, due in (
        ([(None, ["a"], "t1"), ("t1", [], "t2"), ("t2", ["b"], None)], ["a"]), ([(None, ["a"], "t1"), ("t2", ["b"], None)], ["a"]), ([(None, ["a"], "t1"), ("t1", ["b"], "t1")], ["a", "b"]), ([(None, [], "t1"), ("t1", ["b"], None)], []),
    ):
        assert [r.video_id for r in paged_api.landed_scan(*landed(spark, pages, [["a", "b"]])).orderBy("pos").collect()] == due
    channels, uploads, videos = landed(spark, [(None, ["a"], None)], [["a"]], [("https://y.com/@a", {"items": []}), ("https://y.com/@b", {})])
    assert paged_api.landed_scan(channels, uploads, videos).count() == 0
    broken = uploads.unionByName(spark.createDataFrame([("P", None, "no json"), (None, None, None)], uploads.schema))
    assert paged_api.landed_scan(channels, broken.limit(0), videos.limit(0)).count() == 0 and paged_api.landed_scan(channels, broken, videos).count() == 0


def test_walks_that_have_ended_are_not_joined_again(spark, monkeypatch):
    """each round joined all ids the walks had come to, so that one long walk made all short ones cost its bits."""
    held = []
    monkeypatch.setattr(sequences, "materialised", lambda s, frame: (held.append(frame.count()), frame.localCheckpoint())[1])
    links = [(f"s{i}", f"e{i}") for i in range(500)] + [(f"l{i}", f"l{i + 1}") for i in range(100)]
    starts = spark.createDataFrame([(f"s{i}",) for i in range(500)] + [("l0",)], "id string")
    got = sequences.walked(spark.createDataFrame(links, "id string, next string"), starts)
    assert got.count() == 1000 + 101 and {(r.id, r.step) for r in got.collect() if r.root == "l0"} == {(f"l{i}", i) for i in range(101)}
    assert sum(held) < 2_500


def test_a_scan_holds_no_details_before_its_last_join(spark, monkeypatch):
    """details were kept, and dealt three times more, for each list that names their video."""
    held = []
    keep = paged_api.materialised
    monkeypatch.setattr(paged_api, "materialised", lambda s, frame: (held.extend(frame.columns), keep(s, frame))[1])
    rows = paged_api.landed_scan(*landed(spark, [(None, ["a", "b"], "t"), ("t", ["c"], None)], [["a", "b", "c"]])).orderBy("pos").collect()
    assert [(r.pos, r.video_id) for r in rows] == [(0, "a"), (1, "b"), (2, "c")] and held and "detail" not in held


# ---- what is computed once ----


def counting(spark):
    """A function of texts that gives them back, and how many it has been given."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(text):
        seen.add(1)
        return text

    return same, seen


def test_lines_of_islands_are_computed_once(spark):
    """F8: windows and what blocks hand on read lines that are computed."""
    same, seen = counting(spark)
    rows = spark.createDataFrame([(d, n, "One line" if n % 3 else "It ends.") for d in range(4) for n in range(10)], "doc_id long, n int, line string")
    found = lines.sentence_islands(rows.withColumn("line", same("line")), 4).collect()
    assert len(found) == 16 and seen.value == rows.count()


def test_lines_of_pages_are_computed_once(spark):
    """columns, their tops and pages of one column read lines that are computed."""
    same, seen = counting(spark)
    rows = spark.createDataFrame([(p, 612.0, 792.0, f"Line {k} is here.", 60.0 + 270 * (k % 2), 100.0 + 20 * (k // 2), 280.0 + 270 * (k % 2), 110.0 + 20 * (k // 2)) for p in range(3) for k in range(8)], "page_id long, page_width double, page_height double, text string, x0 double, y0 double, x1 double, y1 double")
    found = layout.page_layout(rows.withColumn("text", same("text"))).collect()
    assert len(found) == 3 and seen.value <= 2 * rows.count()


def test_blocks_are_split_once(spark, monkeypatch):
    """a range partition samples what it deals out, so blocks are split before it."""
    same, seen = counting(spark)
    monkeypatch.setattr(chunking, "split_block", lambda text, budget: F.array(same(text)))
    pages = spark.createDataFrame([(f"page {i}", f"Text {i} ends.") for i in range(50)], "name string, text string")
    assert chunking.combined_chunks(pages, 100).count() > 10
    assert seen.value == 50
