"""Features of sales against their SQL: whole and in slices, over the given tables and odd rows."""

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenrow.llm import registry, sale_features
from tests.test_queries import normal

NAMES = ("sales", "clicks", "sale_lines")
START = datetime(2024, 1, 1)
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def due(tables):
    con = duckdb.connect()
    for name, found in tables.items():
        con.register(name, found) if not isinstance(found, str) else con.execute(f"create view {name} as select * from '{found}'")
    return normal(con.sql(sale_features.ORACLE).select("* replace (last_click_id::varchar as last_click_id)").df())


def same(got, wanted):
    got = normal(got.withColumn("last_click_id", F.col("last_click_id").cast("string")).toPandas())
    assert list(got.columns) == list(wanted.columns) and len(got) == len(wanted)
    differ = (got != wanted).any(axis=1)
    assert not differ.any(), f"{got[differ].head(2).to_string()}\n{wanted[differ].head(2).to_string()}"


@pytest.mark.parametrize("slice_rows", [sale_features.SLICE_ROWS, 40])
def test_features_equal_sql_whole_and_in_slices(spark, sf, slice_rows):
    """With 40 rows a slice hundreds of slices carry balances, in several runs."""
    paths = {name: f"{sf}/{name}.parquet" for name in NAMES}
    if slice_rows == sale_features.SLICE_ROWS:
        got = registry.QUERIES["op12_sale_features"](spark, sf)
    else:
        got = sale_features.features(*(spark.read.parquet(p) for p in paths.values()), slice_rows=slice_rows, bucket_rows=500)
    same(got, due(paths))


def odd_tables():
    """Nulls everywhere, repeats, ties, late and far rows, one client of many rows, items that overlap in a client's sales."""
    at = lambda minutes: START + timedelta(minutes=minutes)
    sales = [(i, 7 if i % 3 else i % 5, "done", [10.005, None, -3.0, float("nan"), 1e300, float("inf")][i % 6], at(i * 317 % 40_000), None if i % 11 == 0 else at(i * 317 % 40_000 + i * 97 % 9_000), 1) for i in range(220)]
    sales += [(None, 7, None, 1.0, at(5), at(6), None), (None, None, None, 1.0, at(5), at(6), None), (300, 7, None, 1.0, None, at(6), None), (301, 8, "x", 2.5, at(10), at(0), 2), (5, 9, "again", 4.0, at(900), at(900), 1), (302, 7, "far", 1.0, datetime(1965, 5, 5, 5, 5, 5, 123456), datetime(1965, 5, 5), 1)]
    clicks = [(None if i % 13 == 0 else i // 2, at(i * 211 % 40_000 // 7 * 7), None if i % 17 == 0 else at(i * 211 % 40_000 + i * 53 % 30_000), 7 if i % 3 else i % 5, ["purchase", "view", None][i % 4 % 3], [2.675, None, float("nan"), 7.0][i % 4], None if i % 5 else '{"k": 1}') for i in range(500)]
    clicks += clicks[:60] + [(1, None, at(1), 7, "view", 1.0, None), (1, at(1), at(1), None, "view", 1.0, None), (2, datetime(2999, 1, 1), at(1), 7, "purchase", 1.0, "x" * 100_000)]
    lines = [(i % 230, i % 3, None if i % 19 == 0 else i % 4, 1, 1, [0.005, None, 9.99][i % 3], 0.0, "f", None if i % 23 == 0 else at(i * 173 % 60_000)) for i in range(900)]
    lines += lines[:40] + [(6, 1, i % 7, 1, 1, 1.0, 0.0, "hot", at(2_000 + i % 50)) for i in range(400)] + [(None, 1, 1, 1, 1, 1.0, 0.0, "f", at(1))]
    return sales, clicks, lines


@pytest.mark.parametrize("slice_rows", [10**9, 60])
def test_features_of_odd_rows(spark, slice_rows, tmp_path):
    frames = [spark.createDataFrame(rows, ddl) for rows, ddl in zip(odd_tables(), (SALES, CLICKS, LINES), strict=True)]
    for name, frame in zip(NAMES, frames, strict=True):
        frame.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    clashing = [f.withColumn("width", F.lit("w")).withColumn("log", F.create_map(F.lit("k"), F.lit(1))).withColumn("slice", F.lit(None).cast("string")) for f in frames]
    same(sale_features.features(*clashing, slice_rows=slice_rows, bucket_rows=300), due({name: f"{tmp_path}/{name}/*.parquet" for name in NAMES}))


def test_clicks_that_differ_in_another_column_are_not_one(spark):
    sales, clicks, _ = odd_tables()
    one = [c for c in clicks if c[3] == 7 and c[2] and c[1]][0]
    frame = spark.createDataFrame([one, one], CLICKS).withColumn("n", F.monotonically_increasing_id())
    assert sale_features.known_clicks(frame).count() == 2 and sale_features.known_clicks(frame.drop("n")).count() == 1


def test_features_of_empty_tables(spark):
    frames = [spark.createDataFrame(rows, ddl) for rows, ddl in zip(odd_tables(), (SALES, CLICKS, LINES), strict=True)]
    assert sale_features.features(frames[0].limit(0), *frames[1:]).count() == 0
    got = sale_features.features(frames[0], frames[1].limit(0), frames[2].limit(0)).collect()
    assert len(got) == 2 * (220 + 4) and not any(r.n_clicks or r.n_lines or r.last_click_id for r in got) and any(r.n_sales for r in got)


def test_times_without_a_zone_are_utc_in_any_session(spark):
    frame = spark.createDataFrame([(datetime(2024, 3, 31, 2, 30, 1, 5), datetime(1969, 12, 31, 23, 59, 59, 999999))], "a timestamp_ntz, b timestamp_ntz")
    due_ = [int((x - datetime(1970, 1, 1)) / timedelta(microseconds=1)) for x in frame.first()]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "Europe/Berlin", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert list(frame.select(*(sale_features.micros(frame, c) for c in "ab")).first()) == due_
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
