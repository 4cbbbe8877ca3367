"""Scalar functions on literal rows."""

import pytest
from pyspark.sql import functions as F

from lumenrow.functions import numbers as nm
from lumenrow.functions import text as tx
from lumenrow.functions import urls as ur


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "due"), [("50k", 50000), ("1.2m", 1200000), ("1,234 views", 1234), ("3_000", 3000), (" 7 ", 7), ("2b", 2 * 10**9), ("x", None), ("", None), ("-1", None), ("1.15k", 1150)])
def test_parse_count(spark, text, due):
    assert value(spark, nm.parse_count(F.lit(text))) == due


@pytest.mark.parametrize(("text", "due"), [("1:02", 62), ("1:00:05", 3605), ("90", 90), ("1h2m3s", 3723), ("2m", 120), ("", None), ("abc", None)])
def test_parse_duration(spark, text, due):
    assert value(spark, nm.parse_duration(F.lit(text))) == due


def test_cut_point_counts_minutes(spark):
    assert value(spark, nm.parse_cut_point(F.lit("1.5"))) == 90.0
    assert value(spark, nm.parse_cut_point(F.lit("1:30"))) == 90.0


@pytest.mark.parametrize(("text", "due"), [("PT1H2M3S", "1:02:03"), ("PT59S", "0:59"), ("P1DT1S", "24:00:01"), ("bad", "")])
def test_iso_duration(spark, text, due):
    assert value(spark, nm.iso_duration(F.lit(text))) == due


def test_stamps(spark):
    assert value(spark, nm.srt_to_ms(F.lit("01:02:03,004"))) == 3723004
    assert value(spark, nm.ms_to_srt(F.lit(-5))) == "00:00:00,000"
    assert value(spark, nm.ms_to_srt(F.lit(400 * 3600 * 1000))) == "400:00:00,000"
    assert value(spark, nm.ass_to_ms(F.lit("0:00:01.5"))) == 1500
    assert value(spark, nm.ms_to_ass(F.lit(1005))) == "0:00:01.01"
    assert value(spark, nm.seconds_to_srt(F.lit(0.0005))) == "00:00:00,000"


def test_dates(spark):
    assert value(spark, nm.date_limit(F.lit("2026-6-1"))) == 20260601
    assert value(spark, nm.date_limit(F.lit("20260601"))) == 20260601
    assert value(spark, nm.date_limit(F.lit("null"))) is None
    assert value(spark, nm.date_in_range(F.lit(0), 1, None, True)) is True
    assert value(spark, nm.date_in_range(F.lit(0), None, None)) is True
    assert value(spark, nm.date_in_range(F.lit(20200101), 20200101, 20200101)) is True


def test_coercions(spark):
    assert value(spark, nm.optional_boolean(F.lit(" Off "))) is False
    assert value(spark, nm.optional_boolean(F.lit("maybe"))) is True
    assert value(spark, nm.optional_text(F.lit(" None "))) is None
    assert value(spark, nm.optional_positive(F.lit("0"))) is None
    assert value(spark, nm.padded_index(F.lit(7), F.lit(3))) == "007"
    assert value(spark, nm.format_bytes(F.lit(0))) == "?"


@pytest.mark.parametrize(
    ("url", "due"),
    [("https://youtu.be/abcdefghijk?t=1", "abcdefghijk"), ("https://www.youtube.com/watch?a=1&v=abcdefghijk", "abcdefghijk"), ("https://youtube.com/shorts/abcdefghijk/x", "abcdefghijk"), ("see abcdefghijk.", "abcdefghijk"), ("https://example.org/", ""), ("", "")],
)
def test_video_id(spark, url, due):
    assert value(spark, ur.video_id(F.lit(url))) == due


@pytest.mark.parametrize(("url", "due"), [("https://y.com/@name/videos", ("forHandle", "@name")), ("https://y.com/channel/UC1", ("id", "UC1")), ("https://y.com/user/u", ("forUsername", "u")), ("https://y.com/name", ("forHandle", "@name"))])
def test_channel_lookup(spark, url, due):
    assert tuple(value(spark, ur.channel_lookup(F.lit(url)))) == due
    assert value(spark, ur.channel_lookup(F.lit("https://y.com/"))) is None


def test_template_fills_once(spark):
    m = F.create_map(F.lit("a"), F.lit("{{ b }}"), F.lit("b c"), F.lit("x"))
    assert value(spark, tx.render_template(F.lit("{{a}}-{{ b  c }}-{{ z }}"), m)) == "{{ b }}-x-{{ z }}"
    assert value(spark, tx.template_variables(F.lit("{{ b  c }} {{a}} {{b c}}"))) == ["b c", "a"]


def test_names(spark):
    assert value(spark, tx.slug(F.lit(" Hello, World! "))) == "hello_world"
    assert value(spark, tx.slug(F.lit("?"))) == "theme"
    assert value(spark, tx.safe_stem(F.lit("..a b__."))) == "a_b"
    assert value(spark, tx.artifact_base(F.lit("T.f137.mp4.part"))) == "T"
    assert value(spark, tx.artifact_base(F.lit("T.txt"))) is None
    assert value(spark, tx.portable_artifact(F.lit("01 - Où: là.mp4"))) == "01 - Ou_la.mp4"
    assert value(spark, tx.portable_artifact(F.lit("02 - مرحبا بك.en.srt"))) == "02 - مرحبا_بك.en.srt"
    assert value(spark, tx.ascii_base(F.lit("Tom & Zoë"))) == "Tom and Zoe"


def test_headers(spark):
    assert tuple(value(spark, tx.numbered_header(F.lit("g. On Things")))) == (9, "On Things")
    assert tuple(value(spark, tx.numbered_header(F.lit("Starters 55-")))) == (55, "Starters")
    assert value(spark, tx.numbered_header(F.lit("plain text"))) is None
    assert value(spark, tx.header_key(F.lit(" ＴＨＥ  Straße - "))) == "the strasse"


def test_lines_and_marks(spark):
    assert value(spark, tx.clean_line(F.lit("a b , c ( d )"))) == "a b, c (d)"
    assert value(spark, tx.force_rtl(F.lit(" مر "))) == " ‏‫مر‬ "
    assert value(spark, tx.ass_escape(F.lit("\\{x}"))) == "\\\\\\{x\\}"
    assert value(spark, tx.html_escape(F.lit("<a href='x'>&"))) == "&lt;a href=&#x27;x&#x27;&gt;&amp;"
    assert value(spark, tx.wrapped(F.lit("word " * 30))).count("\n") == 1
    assert value(spark, tx.join_fragments(F.lit("well-"), F.lit(" known"))) == "well-known"
    assert value(spark, tx.strip_reader_noise(F.lit("real text 1 min left in chapter 6%"))) == "real text"
    assert tuple(value(spark, tx.remove_literal(F.lit("a\r\nb-a\nb"), "a\nb"))) == ("-", 2)


def test_natural_order(spark):
    names = ["a10", "a2", "A1", "b", "a02x", "²"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(tx.natural_key(F.col("n")), "n").collect()
    got = [r.n for r in rows]
    assert got.index("A1") < got.index("a2") < got.index("a10") < got.index("b")


def test_useful_text(spark):
    assert value(spark, tx.useful_text(F.lit("plain words that are long enough"))) is True
    assert value(spark, tx.useful_text(F.lit("12 34 56 78 90 12 34 56 78 90"))) is False


def test_a_number_is_read_from_a_text_that_is_cleaned_once(spark):
    """the text was cleaned again in each branch that names it."""
    rows = spark.createDataFrame([(" 1.2M views",), ("3_000",), ("x",), (None,)], "v string")
    read = rows.select(nm.parse_count(F.col("v")).alias("n"), nm.iso_duration(F.col("v")).alias("d"))
    assert [tuple(r) for r in read.collect()] == [(1_200_000, ""), (3_000, ""), (None, ""), (None, "")]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("views") == 1
