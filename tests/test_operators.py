"""Operators on small tables, against short sequential versions where order matters."""

import random

import pytest
from pyspark.sql import functions as F

from lumenrow.functions.text import flat_text
from lumenrow.operators import chunking, cleaning, cues, fileplan, fuzzy, layout, lines, reconcile, report, stores
from lumenrow.operators.cuebuilder import CueBuilder, build_cues

SRT = "1\n00:00:01,000 --> 00:00:02,500\nHello\nthere\n\n2\n00:00:03,000 --> 00:00:04,000\n\n\nno time here\n\n3\nx 00:00:05,000 --> 00:00:06,000 y\nLast\n"


def test_srt_parsers_differ(spark):
    d = spark.createDataFrame([("a", "﻿" + SRT.replace("\n", "\r\n"))], "doc_id string, text string")
    strict = cues.parse_srt(d).orderBy("ord").collect()
    assert [(r.start_ms, r.end_ms, r.lines) for r in strict] == [(1000, 2500, ["Hello", "there"]), (3000, 4000, [])]
    assert cues.parse_srt(d, "search").count() == 3
    lenient = cues.parse_srt(d, "lenient_sorted").orderBy("ord").collect()
    assert [r.start_ms for r in lenient] == [1000, 3000]


def test_srt_round_trip(spark):
    rows = [("a", 0, 0, 1000, ["x", "y"]), ("a", 1, 2000, 3000, [])]
    c = spark.createDataFrame(rows, "doc_id string, ord int, start_ms long, end_ms long, lines array<string>")
    assert cues.render_srt(c).first().text == "1\n00:00:00,000 --> 00:00:01,000\nx\ny\n\n2\n00:00:02,000 --> 00:00:03,000\n"
    ass = cues.render_ass(c, "used M").first().text
    assert "Dialogue: 0,0:00:00.00,0:00:01.00,Default,,0,0,0,,x\\Ny" in ass and "Dialogue: 10,0:00:00.00,0:00:01.00,ModelTop" in ass


def _tracks(spark, seed):
    rng = random.Random(seed)

    def track(n):
        out, at = [], 0
        for i in range(n):
            at += rng.randint(0, 900)
            out.append(("d", i, at, at + rng.randint(1, 900), [rng.choice("abcd")]))
        return out

    return track(25), track(20)


def _pointer(targets, sources, nearest=400):
    """The sequential rule: a pointer that never moves back."""
    out, i = [], 0
    for _, ord_, start, end, _ in targets:
        while i < len(sources) and sources[i][3] <= start:
            i += 1
        hits, j = [], i
        while j < len(sources) and sources[j][2] < end:
            if min(end, sources[j][3]) - max(start, sources[j][2]) >= 1 and sources[j][4][0] not in hits:
                hits.append(sources[j][4][0])
            j += 1
        text = " / ".join(hits)
        if not hits:
            near = [(abs((s[2] + s[3]) // 2 - (start + end) // 2), k, s[4][0]) for k, s in enumerate(sources) if k in (i - 1, i)]
            text = min(near)[2] if near and min(near)[0] <= nearest else ""
        out.append((ord_, text))
    return out


def test_alignment_equals_the_pointer(spark):
    schema = "doc_id string, ord int, start_ms long, end_ms long, lines array<string>"
    for seed in range(3):
        t, s = _tracks(spark, seed)
        s.sort(key=lambda x: (x[2], x[3], x[1]))
        s = [(d, i, a, b, x) for i, (d, _, a, b, x) in enumerate(s)]
        got = cues.align(spark.createDataFrame(t, schema), spark.createDataFrame(s, schema), bin_ms=1000).orderBy("ord").collect()
        assert [(r.ord, r.source_text) for r in got] == _pointer(t, s)


def test_clip_keeps_border_cues_in_both(spark):
    c = spark.createDataFrame([("d", 0, 500, 1500), ("d", 1, 1500, 1500), ("d", 2, 2500, 9000)], "doc_id string, ord int, start_ms long, end_ms long")
    got = cues.clip(c, cues.cut_segments(c, 1000), bin_ms=700).orderBy("seg_no", "ord").collect()
    assert [(r.seg_no, r.ord, r.start_ms, r.end_ms) for r in got] == [(0, 0, 500, 1000), (1, 0, 0, 500), (1, 2, 1500, 8000)]


def test_trim_and_windows(spark):
    c = spark.createDataFrame([("d", 0, 0, 10), ("d", 1, 5, 5), ("d", 2, 5, 9)], "doc_id string, ord int, start_ms long, end_ms long")
    assert [(r.end_ms, bool(r.changed)) for r in cues.trim_overlaps(c).orderBy("ord").collect()] == [(4, True), (6, True), (9, False)]
    w = cues.windows(spark.createDataFrame([("d", 25.5)], "doc_id string, total_s double"), 10, 2).orderBy("seg_no").collect()
    assert [(r.start_s, r.len_s) for r in w] == [(0, 10.0), (8, 10.0), (16, 9.5), (24, 1.5)]


def test_titles_are_learned_and_matched_loosely(spark):
    text = "### Page 1\n\n9. On Some Things\nbody\n### Page 2\ng. On Some Things\nmore\n"
    d = spark.createDataFrame([("a", text)], "doc_id string, text string")
    found = lines.learned_titles(lines.explode_lines(d)).collect()
    assert [(r.title_key, r.n) for r in found] == [("on some things", 2)]
    near = fuzzy.fuzzy_titles(spark.createDataFrame([("on sume things",), ("off some things",)], "title_key string"), spark.createDataFrame([("on some things",)], "title_key string"))
    assert [r.title_key for r in near.collect()] == ["on sume things"]


@pytest.mark.parametrize("least", [0.88, 0.8, 0.95])
def test_fuzzy_titles_of_crowded_words_go_through_the_index(spark, least):
    """Titles of one first and last word: by grams as by all pairs."""
    import difflib
    import random

    rng = random.Random(7)
    middle = lambda: "".join(rng.choice("abc é") for _ in range(rng.randrange(3, 30))).strip()
    titles = list({" ".join(f"the {middle()} end".split()) for _ in range(70)})
    for t in list(titles):
        at = rng.randrange(4, len(t) - 4) if len(t) > 8 else 4
        titles += [t[:at] + rng.choice(["", "a", "xy"]) + t[at + rng.randrange(2) :]]
    titles = [t for t in set(titles) if len(t) >= 8]
    due = {(a, b) for a in titles for b in titles if a.split(" ")[-1] == b.split(" ")[-1] and a.split(" ")[0] == b.split(" ")[0] and difflib.SequenceMatcher(None, a, b).ratio() >= least}
    frame = spark.createDataFrame([(t,) for t in titles] * 2 + [(None,)], "title_key string")
    for direct in (0, 10**9):
        got = [(r.title_key, r.learned_key) for r in fuzzy.fuzzy_titles(frame, frame, least, direct).collect()]
        assert len(got) == len(set(got)) and set(got) == due and len(due) > len(titles) + 20


def test_grams_in_blocks_leave_only_titles_that_are_near():
    """Long titles of one crowd share common grams; counting them leaves the near pairs, and none is lost."""
    import difflib
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices("etaoinshrdlucm", k=rng.randint(2, 6))) for _ in range(300)]
    texts = ["the " + " ".join(rng.choices(words, k=rng.choice((2, 30, 60)))) + " end" for _ in range(60)]
    texts += [t.replace("e", "o", 3) for t in texts[:20]] + ["the the the end", "aaaaaaaaa end"]
    i, k = fuzzy.near_grams(texts, texts, 0.88)
    got = set(zip(i.tolist(), k.tolist(), strict=True))
    assert len(got) == len(i)
    due = {(x, y) for x, a in enumerate(texts) for y, b in enumerate(texts) if difflib.SequenceMatcher(None, a, b).ratio() >= 0.88}
    assert due <= got and len(got) < 3 * len(due)


def syllables(rng, n):
    """A long title that shares nearly all its grams with others of its kind."""
    parts = "th er ing on re st ed an ti es ent ou ha ly ble in wh or nd at ea sh of to is it as by en le".split()
    return "the " + " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)) + " the"


def test_grams_far_from_their_like_do_not_count():
    """titles of one language share their grams, but not near the same places; none of the near ones is lost."""
    import difflib
    import random

    rng = random.Random(11)
    texts = [syllables(rng, rng.choice((30, 60, 90))) for _ in range(60)]
    for t in texts[:10]:
        at = rng.randrange(10, len(t) - 30)
        texts += [t[:at] + t[at + rng.randrange(1, len(t) // 10) :], t[:at] + "unrelated " + t[at:], t.replace("er", "r", 4)]
    i, k = fuzzy.near_grams(texts, texts, 0.88)
    got = set(zip(i.tolist(), k.tolist(), strict=True))
    due = {(x, y) for x, a in enumerate(texts) for y, b in enumerate(texts) if difflib.SequenceMatcher(None, a, b).ratio() >= 0.88}
    assert len(got) == len(i) and due <= got and len(got) < 4 * len(due)


def test_ratios_are_computed_once_behind_the_exchange_of_pairs(spark):
    """a filter on the ratio went below the exchange, and the ratio was computed again above."""
    import random

    rng = random.Random(12)
    frame = spark.createDataFrame([(syllables(rng, 12),) for _ in range(30)], "title_key string")
    found = fuzzy.fuzzy_titles(frame, frame)
    assert found.count() == frame.distinct().count()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_a_subsequence_is_given_up_only_where_it_is_too_short():
    import random

    rng = random.Random(13)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 120)))
        b = a if rng.random() < 0.1 else "".join(c for c in a if rng.random() < 0.9) + "".join(rng.choice("ab") for _ in range(rng.randrange(9)))
        length = fuzzy.common_subsequence(a, b)
        for due in (1, length - 1, length, length + 1, len(a)):
            assert (fuzzy.common_subsequence(a, b, max(due, 0)) >= due) == (length >= due)


def test_the_longest_common_subsequence_by_bits():
    import random

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, was = [0], row
            for j, y in enumerate(b):
                row.append(was[j] + 1 if x == y else max(was[j + 1], row[j]))
        return row[-1]

    rng = random.Random(8)
    for _ in range(200):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randrange(90))) for _ in "ab")
        assert fuzzy.common_subsequence(a, b) == plain(a, b)


def test_lines_beyond_six_digits_go_by_number(spark):
    """A document of 1,000,300 lines: chunks hold neighbours, and translations meet their lines."""
    rows = spark.range(1_000_300).select(F.lit("d").alias("doc_id"), F.format_string("L%06d", F.col("id") + 1).alias("line_id"), F.col("id").cast("string").alias("text"))
    chunks = cues.fixed_chunks(rows).groupBy("chunk_no").agg(F.min(F.col("text").cast("int")).alias("a"), F.max(F.col("text").cast("int")).alias("b"), F.count("*").alias("n"))
    assert chunks.filter("a <> 150 * chunk_no or b <> a + n - 1").count() == 0 and chunks.count() == 6669
    given = spark.range(1_000_300).select(F.lit("d").alias("doc_id"), F.col("id").alias("seq"), F.col("id").cast("string").alias("text"))
    assert cues.rebuild(rows, given).filter("translation is null or translation <> text").count() == 0


def test_fuzzy_titles_of_whole_lines_equal_brute_force(spark, tmp_path):
    import difflib
    from collections import Counter

    from lumenrow.plans import documents

    long = "of the many things that were said " * 4
    texts = ["head alone\nthe " + long + "north end\nthe joy of cooking", "the " + long + "south end\nthe loy of cooking\n\nthe joy of cooking", "the " + long + "north end\nthe " + long + "end", "short\nshort\ntwo words", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter(line for t in texts if t for line in t.split("\n") if line)
    fit = lambda k: len(k) >= 8 and len(k.split()) >= 2
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    due = {(a, b, ratio(a, b)) for a in counts for b in counts if fit(a) and fit(b) and counts[b] >= 2 and a.split()[0] == b.split()[0] and a.split()[-1] == b.split()[-1] and ratio(a, b) >= 0.88}
    assert len(due) >= 5 and {tuple(r) for r in documents.fuzzy_titles(spark, str(tmp_path)).select("title_key", "learned_key", "ratio").collect()} == due


def test_cleaner_sews_pages():
    assert cleaning.clean("first part of the text and,\n\n### Page 2\n\nI went home.\n")[0] == "first part of the text and, I went home.\n"
    assert cleaning.clean('He said "we are\n\n### Page 11\n\n44 going" home.\n')[0] == 'He said "we are going" home.\n'
    assert cleaning.clean("All is said.\n### Page 3\nNew words.\n")[0] == "All is said.\n\nNew words.\n"
    assert cleaning.clean("A long line that goes up to the border of the page, 77\n### Page 78\nand beyond it.\n")[0] == "A long line that goes up to the border of the page, and beyond it.\n"
    assert cleaning.clean("Room 12\n### Page 3\nNew words.\n")[0] == "Room 12\n\nNew words.\n"
    assert cleaning.clean("12\n")[0] == "12\n"
    assert cleaning.clean("Words of a body.\n\n14\n") == ("Words of a body.\n", 1, 0)
    assert cleaning.clean("")[0] == ""


def test_cleaner_takes_titles_and_numbers_from_page_heads():
    both = cleaning.clean("### Page 1\n\n9. Of Ships And Tides\nThe harbour lay still.\n### Page 2\n\ng. Of Ships And Tides\nNobody came ashore.\n")[0]
    assert both == "The harbour lay still.\n\nNobody came ashore.\n"
    scanned = cleaning.clean("### Page 30\nOf Shlps And Tides 30-\nThe harbour lay still.\n", titles={"of ships and tides"})[0]
    assert scanned == "The harbour lay still.\n"
    assert cleaning.clean("Chapter 5\n\n### Page 2\nText.\n")[0].startswith("Chapter 5\n")
    assert cleaning.clean("### Page 1\n\n61 Chapter 4 Anna came late.\n")[0] == "Chapter 4 Anna came late.\n"
    assert cleaning.clean("### Page 2\n\n208 I knew then that it was over.\n")[0] == "I knew then that it was over.\n"
    assert cleaning.clean("The road,\n\n### Page 2\n\nI took it the next day.\n")[0] == "The road, I took it the next day.\n"
    pages = "".join(f"### Page {i}\n\n{200 + i} {head}\n\n" for i, head in enumerate(["My second house was small.", "My second garden was not.", "All roads were closed.", "All right, we may go."]))
    assert [x for x in cleaning.clean(pages)[0].split("\n") if x] == ["My second house was small.", "My second garden was not.", "All roads were closed.", "All right, we may go."]
    run_in = cleaning.clean("### Page 40\nOf Ships And Tides 40. the harbour lay still, and nobody came ashore.\n", titles={"of ships and tides"})[0]
    assert run_in == "the harbour lay still, and nobody came ashore.\n"


def test_cleaner_takes_noise_literals_and_the_users_title():
    assert cleaning.clean("a\nAD\nb AD c\n", literal="AD")[0] == "a\nb c\n"
    assert cleaning.clean("x\r\nAD\r\nON\r\ny\r\n", literal="AD\nON\n") == ("x\r\ny\r\n", 1, 0)
    assert cleaning.clean("Tides And Men  8 They are right.\n", header="Tides  And Men")[0] == "They are right.\n"
    assert cleaning.clean("one\n### Source PDF: x.pdf\n\n33 % 2 hrs 5 mins left in chapter 9\ntwo Page 3 of 80\nthree 14 %\n") == ("one\ntwo\nthree\n", 4, 1)
    assert cleaning.clean("### Source PDF: x.pdf\n\n### Page 1\n\n208 I knew then.\n")[0] == "I knew then.\n"


def test_page_tokens_and_titles():
    assert cleaning.page_token("1O") == (10, True) and cleaning.page_token("g") == (9, False) and cleaning.page_token("٣٤") == (34, True)
    assert cleaning.page_token("123456") is None and cleaning.page_token("x1") is None
    read = lambda line: (t := cleaning.whole_title(line)) and (t.page, t.text, t.key)
    assert read("g. Of Ships") == (9, "Of Ships", "of ships") and read("Of Ships 55-") == (55, "Of Ships", "of ships") and read("12 • Of Ships ") == (12, "Of Ships", "of ships")
    assert read("I went") is None and read("12 the") is None and read("12 34") is None and read("9 " + "x" * 91) is None and read("no number") is None


def test_side_notes_move_behind_their_paragraph():
    text = "we heard the bells of the\nTOWN HALL opposite The square in spring\nold town ring.\nThen it rained.\n"
    assert cleaning.relocate_captions(text) == ("we heard the bells of the old town ring.\nTOWN HALL opposite The square in spring\nThen it rained.\n", 1)
    apart = "We heard the bells of\n\nTOWN HALL opposite The square\n\nthe old town.\n\nThen it rained."
    assert cleaning.relocate_captions(apart) == ("We heard the bells of the old town.\n\nTOWN HALL opposite The square\n\nThen it rained.", 1)
    before = "TOWN HALL opposite The square\n\nWe heard the bells of\n\nthe old town.\n"
    assert cleaning.relocate_captions(before) == ("We heard the bells of the old town.\n\nTOWN HALL opposite The square\n", 1)
    summed = "All was well.\n\nTHE BRIDGE above An iron bridge crosses the river\n\nThe iron bridge crosses the river near the mill.\n\nThe end."
    assert cleaning.relocate_captions(summed)[0].split("\n\n")[1] == "The iron bridge crosses the river near the mill.\nTHE BRIDGE above An iron bridge crosses the river"
    for calm in ("", "Plain.\n\nthe picture opposite is small\n\nmore.", "One line"):
        assert cleaning.relocate_captions(calm) == (calm, 0)


def test_titles_of_a_folder_clean_its_documents(spark):
    rows = [("f", 1, "30 Of Ships And Tides\nthe harbour lay still, and nobody came ashore.\n"), ("f", 2, "31 Of Ships And Tides\nIt rained, and the day was long there.\n"), ("g", 3, "9 Of Ships And Tides\nIt rained, and the day was long there.\n")]
    d = spark.createDataFrame(rows, "folder string, doc_id int, text string")
    of_folders = lines.learned_titles_of_folders(d)
    assert {r.folder: r.titles for r in of_folders.collect()} == {"f": ["of ships and tides"]}
    got = {r.doc_id: r.text for r in cleaning.clean_documents(d, titles=of_folders).collect()}
    assert got == {1: "the harbour lay still, and nobody came ashore.\n", 2: "It rained, and the day was long there.\n", 3: rows[2][2]}


def test_clean_documents(spark):
    d = spark.createDataFrame([(1, "### Page 1\nText.\n"), (2, "same\n"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: (r.text, r.changed) for r in cleaning.clean_documents(d).collect()}
    assert got == {1: ("Text.\n", True), 2: ("same\n", False), 3: (None, False)}


def test_chunks_by_length_equal_chunks_by_measure(spark):
    rng = random.Random(4)
    text = "\n\n".join(" ".join("w" * rng.randint(1, 9) + rng.choice(["", ".", "!"]) for _ in range(rng.randint(1, 60))) for _ in range(12))
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    a = [tuple(r) for r in chunking.chunk_by_length(d, 80).orderBy("doc_id", "chunk_no").collect()]
    b = [tuple(r) for r in chunking.chunk_by_measure(d, 80, len).orderBy("doc_id", "chunk_no").collect()]
    assert a == b and all(r[3] <= 80 for r in a)
    assert chunking.manifest(chunking.chunk_by_length(d, 80)).count() == 1


def test_layout(spark):
    left = [("p", 612.0, 792.0, f"left {i} goes on", 60.0, 100.0 + 20 * i, 280.0, 110.0 + 20 * i) for i in range(4)]
    right = [("p", 612.0, 792.0, f"right {i} goes on", 330.0, 100.0 + 20 * i, 550.0, 110.0 + 20 * i) for i in range(4)]
    head = [("p", 612.0, 792.0, "A head", 60.0, 60.0, 300.0, 70.0)]
    schema = "page_id string, page_width double, page_height double, text string, x0 double, y0 double, x1 double, y1 double"
    text = layout.two_column_text(spark.createDataFrame(right + left + head, schema)).first().text
    assert text.index("A head") < text.index("left 0") < text.index("left 3") < text.index("right 0")
    assert layout.two_column_text(spark.createDataFrame(left, schema)).count() == 0
    assert layout.page_layout(spark.createDataFrame(left, schema)).first().text.startswith("left 0")


def test_scan_paragraphs(spark):
    rows = [("p", "main line of the text here", 0.3, 0.9, 0.88, 0.02), ("p", "goes on in a second line", 0.3, 0.87, 0.85, 0.02), ("p", "note", 0.1, 0.89, 0.87, 0.02), ("p", "far below it is another one", 0.3, 0.5, 0.48, 0.02)]
    got = layout.scan_paragraphs(spark.createDataFrame(rows, "page_id string, text string, x double, top double, bottom double, height double")).first().text
    assert got == "main line of the text here goes on in a second line\n\nnote\n\nfar below it is another one"


def test_reconcile(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    f = spark.createDataFrame([("a", "x", 1), ("b", " ", 2), ("c", "1", 3), ("c", "2", 4), ("z", "q", 5)], "id string, text string, seq int")
    got = reconcile.reconcile(e, f, "id")
    assert {r.id: r.status for r in got.collect()} == {"a": "ok", "b": "empty", "c": "duplicate", "d": "missing", "z": "unexpected"}
    assert reconcile.may_rebuild(got).first().allowed is False
    swapped = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3)], "id string, seq int")
    ordered = spark.createDataFrame([("a", 1), ("b", 2), ("c", 9), ("x", 0)], "id string, seq int")
    assert {(r.id, r.e_rank, r.f_rank) for r in reconcile.order_differs(ordered, swapped, "id").collect()} == {("a", 1, 2), ("b", 2, 1)}
    assert reconcile.all_or_nothing(e, F.col("id") == "a").count() == 0


def test_file_plans(spark):
    listing = spark.createDataFrame([("d", n, 1, False) for n in ("b2.mp4", "b10.mp4", "a.srt", "a.en.srt", "01 - x.mp4", "é.txt")], "dir string, name string, size long, is_dir boolean")
    assert [r.name for r in fileplan.media_files(listing).collect()] == ["01 - x.mp4", "b10.mp4", "b2.mp4"]
    assert [r.name for r in fileplan.files_with(listing, "mp4").collect()] == ["01 - x.mp4", "b2.mp4", "b10.mp4"]
    assert [(r.base, r.lang) for r in fileplan.tagged_subtitles(listing).collect()] == [("a", "en")]
    assert fileplan.completed_indices(listing, ("mp4",)).collect()[0]["index"] == 1
    assert [r.destination for r in fileplan.index_rename_plan(listing, 3).collect()] == ["001 - x.mp4"]
    wanted = spark.createDataFrame([("d", "b", ".mp4", 1), ("d", "b", ".mp4", 2), ("d", "a", ".srt", 3)], "dir string, base string, ext string, seq int")
    taken = spark.createDataFrame([("d", "b.mp4"), ("d", "b_3.mp4")], "dir string, name string")
    assert [r.name for r in fileplan.numbered_names(wanted, taken).orderBy("seq").collect()] == ["b_2.mp4", "b_4.mp4", "a.srt"]
    name = fileplan.sidecar_name(F.lit("x_part1.mp4"), F.lit("x.mp4"), F.lit("x.en.srt"), F.lit(2))
    assert spark.range(1).select(name.alias("n")).first().n == "x_part1.en.srt"


def test_move_batch_takes_files_of_one_name_together(spark):
    rows = [("a", "f1", "700"), ("a", "f2", "500"), ("a", "f2", "500"), ("a", "f3", "200"), ("b", "f1", "1000"), ("b", "f2", "500"), ("b", "f2", "500")]
    got = fileplan.move_batch(spark.createDataFrame(rows, "dir string, name string, duration_raw string"), 1800).collect()
    assert sorted((r.dir, r.name, r.total) for r in got) == [("a", "f1", 700), ("a", "f2", 1700), ("a", "f2", 1700), ("b", "f1", 1000)]


def test_move_batch_stops_at_the_first_overflow(spark):
    rows = [("d", f"f{i}", s) for i, s in enumerate(["100", "200.5", "1600", "1"])] + [("e", "f1", "n/a"), ("e", "f2", "1")]
    got = fileplan.move_batch(spark.createDataFrame(rows, "dir string, name string, duration_raw string"), 1800).collect()
    assert sorted(r.name for r in got) == ["f0", "f1"] and {r.dir for r in got} == {"d"}


def test_stores(spark):
    texts = [("a", '{"videos": {"k1": {"title": "x", "video_id": "id1"}}}'), ("b", '{"k2": {"title": "y"}}'), ("c", '[{"id": "k3"}, {"id": "k3", "title": "z"}]'), ("d", "broken")]
    got = stores.records_of(spark.createDataFrame(texts, "store string, text string")).collect()
    assert {(r.store, r.video_id) for r in got} == {("a", "id1"), ("b", "k2"), ("c", "k3")}
    assert {r.store: r.record.get("title") for r in got}["c"] == "z"
    themes = stores.themes_of(spark.createDataFrame([('{"themes": [{"name": "t", "min_views": "5k", "date_after": "2020-01-01", "channels": ["u1", {"url": "u2", "enabled": "off"}]}]}',)], "text string"))
    row = themes.first()
    assert (row.theme, row.published_after, [tuple(c) for c in row.channels]) == ("t", "2020-01-01", [("u1", True), ("u2", False)])
    assert [r.url for r in stores.enabled_channels(themes).collect()] == ["u1"]
    prompts = stores.prompts_of(spark.createDataFrame([('{"projects": {" a  b ": [{"title": "T"}, null]}}',)], "text string"))
    assert [(r.project, r.title, bool(r.id)) for r in prompts.collect()] == [("a b", "T", True)]


def test_report(spark):
    items = spark.createDataFrame([("v1", "c1", 100, 20200101, 0), ("v2", "c1", 10, 20200101, 1), ("v3", "c2", None, 0, 0), ("v1", "c2", 100, 20200101, 5), ("v4", "c2", 300, 20210101, 1)], "video_id string, channel string, view_count long, published_sort_value int, source_order long")
    rules = report.ReportRules(50, 20200101, 20201231)
    hidden = spark.createDataFrame([("v9",)], "video_id string")
    ranked = report.popularity_report(items, hidden, rules, report.report_order("view_count", "published_sort_value", "source_order", "channel")).orderBy("rank").collect()
    assert [(r["rank"], r.video_id, r.channel) for r in ranked] == [(1, "v1", "c1"), (2, "v1", "c2")]
    stats = {r.channel: (r.scanned, r.included, r.date_filtered, r.missing_view_count) for r in report.scan_stats(items, rules).collect()}
    assert stats == {"c1": (2, 1, 0, 0), "c2": (3, 1, 1, 1)}
    html = report.html_report(spark.createDataFrame([(1, "<x>")], "rank int, title string"), spark.createDataFrame([("c", 1)], "channel string, n int")).first().html
    assert "&lt;x&gt;" in html


def test_cue_builder_in_tables_equals_the_machine(spark):
    rng = random.Random(2)
    words, at = [], 0.0
    for i in range(400):
        words.append(("m", i // 40, i % 40, rng.choice(["word", "longer-one", "end.", "a,"]), at, at + 0.3))
        at += rng.choice([0.3, 0.3, 2.0])
    words.append(("m", 99, None, "a segment of its own", at, at + 1))
    got = build_cues(spark.createDataFrame(words, "media_id string, seg_no int, word_no int, word string, start_s double, end_s double")).orderBy("cue_no").collect()
    b, due = CueBuilder(), []
    for _, _, n, w, a, z in words:
        due += b.add_segment(w, a, z) if n is None else b.add(w, a, z)
    due += b.flush()
    assert [(r.start_s, r.end_s, r.text) for r in got] == due
    assert all(len(t) <= 84 for _, _, t in due)


def test_flat_text(spark):
    assert spark.range(1).select(flat_text(F.array(F.lit(" a "), F.lit(" "), F.lit("b"))).alias("t")).first().t == "a b"


def test_inventories_and_filters(spark):
    rows = [("a", None, None, [("3",), None, (None,)]), ("b", 7, None, [])]
    got = {r.list_id: (r.length, r.indices) for r in fileplan.inventory(spark.createDataFrame(rows, "list_id string, n_entries int, playlist_count int, items array<struct<index:string>>")).collect()}
    assert got == {"a": (2, [3, 3]), "b": (7, [])}
    one = spark.range(1)
    value = lambda c: one.select(c.alias("v")).first().v
    assert value(fileplan.contains_any(F.lit("Sign IN please"), ("sign in", "captcha"))) is True
    assert value(fileplan.in_index_range(F.lit(3), F.lit(5), F.lit(2))) is True
    assert value(fileplan.in_index_range(F.lit(3), F.lit(None).cast("int"), F.lit(2))) is False
    paths = spark.createDataFrame([("d/a.mp4",), ("d/a.mp4",), ("d/b.txt",), ("d/c.mp4",)], "path string")
    assert [r.path for r in fileplan.supported_new(paths, spark.createDataFrame([("d/c.mp4",)], "path string"), ("mp4",)).collect()] == ["d/a.mp4"]
    plan, done = spark.createDataFrame([("x",), ("y",)], "target string"), spark.createDataFrame([("x", 1), ("y", 0)], "path string, size int")
    assert [r.target for r in fileplan.without_outputs(plan, done).collect()] == ["y"]
    assert tuple(fileplan.result_counts(spark.createDataFrame([("failed",), ("completed",)], "status string")).first()) == (1, 0, 1)


def test_cleaning_keeps_line_ends():
    for text in ("Alpha beta is here.\r\nGamma is there.\r\n", "A b.\rC d.", "A\x0cB\x85C.\u2028D.\n", "", "\r\n" * 0):
        assert cleaning.clean(text) == (text, 0, 0)
    assert cleaning.clean("One.\r\n### Page 30\r\n30. Some Title\r\nTwo.") == ("One.\r\n\r\nTwo.", 2, 0)
    assert cleaning.clean("We saw the\r\nTOWN HALL opposite The square\r\nold town.\r\n")[0] == "We saw the old town.\r\nTOWN HALL opposite The square\r\n"
    assert cleaning.clean("a ## b\r\nx\r\n## c", literal="b\nx") == ("a ##\r\n## c", 1, 0)


def test_free_names_of_very_many_claims(spark):
    taken = [("d", "a.txt", 0), ("d", "a_3.txt", 0), ("d", "a_3.txt", 0), ("d", "a_4.txt", 0), ("d", "a_0.txt", 0), ("d", "a_90000.txt", 0), ("e", "b_2.txt", 0)]
    taken = spark.createDataFrame(taken, "dir string, name string, size int")
    plan = spark.range(100_000).select(F.lit("d").alias("dir"), F.lit("a").alias("base"), F.lit(".txt").alias("ext"), F.col("id").alias("seq"))
    plan = plan.unionByName(spark.createDataFrame([("e", "b", ".txt", 1), ("e", "b", ".txt", 2), ("f", "b", ".txt", 3)], "dir string, base string, ext string, seq long"))
    got = {(r.dir, r.seq): r.name for r in fileplan.numbered_names(plan, taken).collect()}
    free = (n for n in range(1, 200_000) if n not in (1, 3, 4, 90_000))
    assert got == {("d", k): f"a_{n}.txt" for k, n in zip(range(100_000), free)} | {("e", 1): "b.txt", ("e", 2): "b_3.txt", ("f", 3): "b.txt"}


def test_plain_texts_are_cleaned_without_a_look_for_what_they_cannot_hold(monkeypatch):
    """each text was searched line by line for side notes, and for learned titles where none were learned."""

    def never(*_):
        raise AssertionError("not needed")

    monkeypatch.setattr(cleaning, "settled", never)
    monkeypatch.setattr(cleaning, "title_before_body", never)
    assert cleaning.clean("Order 7  went out.\r\nAll is\twell.\r\n") == ("Order 7 went out.\r\nAll is\twell.\r\n", 1, 0)
    monkeypatch.undo()
    assert cleaning.clean("All is well.\nlearning reading ſpeed\nAll iſ well.\n")[:2] == ("All is well.\nAll iſ well.\n", 1)  # noise in letters other than ASCII
    assert cleaning.clean("We saw the\nTOWN HALL oppoſite The square\nold town.\nIt rained.\n")[0].startswith("We saw the")
