"""Sources on temporary folders, streams over them."""

import json

import pytest
from pyspark.sql import functions as F

from lumenrow.sources import ass, files, paged_api, sinks
from lumenrow.streaming import caches, rounds
from lumenrow.streaming.upserts import event_rates, latest_version, stream_cues, upsert_stream

ASS = "[Script Info]\r\nTitle: x\r\n[Events]\r\nFormat: Layer, Start, End, Text\r\nDialogue: 0,0:00:08.00,0:00:12.00,{\\i1}Hi, you\r\nComment: 0,0:00:11.00,0:00:13.00,c\r\nDialogue: 0,0:00:30.00,0:00:31.00,late\r\n"


def client(resource, parameters):
    """Three answers of a channel with three uploads, one without details."""
    if resource == "channels":
        return {"items": [{"id": "UC1", "snippet": {"title": "T"}, "contentDetails": {"relatedPlaylists": {"uploads": "UU1"}}}]}
    if resource == "playlistItems":
        return {"items": [{"contentDetails": {"videoId": f"v{i}"}} for i in range(3)]} if "pageToken" in parameters else {"items": [{"contentDetails": {"videoId": "v9"}}], "nextPageToken": "n"}
    return {"items": [{"id": v, "snippet": {"title": v, "publishedAt": "2026-01-02T00:00:00Z"} if v != "v1" else {"title": v}, "statistics": {"viewCount": "12"}, "contentDetails": {"duration": "PT1H1S"}} for v in parameters["id"].split(",") if v != "v9"]}


def test_texts_and_listings(spark, tmp_path):
    (tmp_path / "a.TXT").write_bytes("é".encode())
    (tmp_path / "b.txt").write_bytes(b"\xe9")
    good, bad = files.texts(spark, str(tmp_path))
    assert [r.text for r in good.collect()] == ["é"] and [r.name for r in bad.collect()] == ["b.txt"]
    loose, _ = files.texts(spark, str(tmp_path), strict=False)
    assert {(r.text, r.encoding) for r in loose.collect()} == {("é", "utf-8"), ("é", "cp1252")}
    assert sorted(r.name for r in files.listing(spark, str(tmp_path)).collect()) == ["a.TXT", "b.txt"]


@pytest.mark.parametrize(("mark", "encoding"), [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"", "utf-8")])
def test_ass_windows_and_bytes(spark, mark, encoding):
    content = mark + ASS.encode(encoding)
    d = spark.createDataFrame([("a", content)], "doc_id string, content binary").select("doc_id", files.ass_documents(F.col("content")).alias("d"))
    assert bytes(d.select(files.ass_bytes(F.col("d")).alias("b")).first().b) == content
    events = ass.parse_events(d.select("doc_id", "d.lines"))
    segments = spark.createDataFrame([("a", 0, 10_000, 20_000)], "doc_id string, seg_no int, seg_start_ms long, seg_end_ms long")
    lines = ass.clip_events(events, segments).first().lines
    assert lines[4:] == ["Dialogue: 0,0:00:00.00,0:00:02.00,{\\i1}Hi, you", "Comment: 0,0:00:01.00,0:00:03.00,c"]
    with pytest.raises(ValueError, match="line 3"):
        list(ass.events_in(["[Events]", "Format: Start, End, Text", "Dialogue: x,0:00:01.00,t"]))


def test_paged_channels(spark):
    paged_api.register(spark)
    rows = spark.read.format("paged_channels").option("channels", json.dumps(["https://y.com/@a"])).option("client", "tests.test_sources_and_streams:client").load()
    got = paged_api.videos_of(rows).orderBy("source_order").collect()
    assert [(r.video_id, r.view_count, r.duration, r.published_sort_value) for r in got] == [("v0", 12, "1:00:01", 20260102), ("v1", 12, "1:00:01", 0), ("v2", 12, "1:00:01", 20260102)]
    assert paged_api.lookup("https://y.com/channel/UC1") == ("id", "UC1")


def test_upsert_stream_keeps_the_last_row(spark, tmp_path):
    source, store, schema = str(tmp_path / "in"), str(tmp_path / "store"), "k int, n int, v string"
    for batch in ([(1, 1, "a"), (2, 1, "b")], [(1, 3, "c"), (1, 2, "x")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp"), ["k"], "n").awaitTermination()
    assert sorted((r.k, r.v) for r in latest_version(spark, store).collect()) == [(1, "c"), (2, "b")]


def test_upserts_rewrite_only_the_buckets_they_touch(spark, tmp_path):
    source, store, schema, due = str(tmp_path / "in"), str(tmp_path / "store"), "k int, n int, v string", {}
    for n, keys in enumerate([range(40), [3, 7], [], [3], range(30, 50)]):
        rows = [(k, n, f"{k}-{n}") for k in keys]
        due |= {k: v for k, _, v in rows}
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        upsert_stream(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "cp"), ["k"], "n", buckets=16).awaitTermination()
        assert {r.k: r.v for r in latest_version(spark, store).collect()} == due
    folders = {p.name: {b.name for b in p.glob("bucket=*")} for p in (tmp_path / "store").glob("version=*")}
    assert len(folders["version=1"]) <= 2 and len(folders) < 5


def plain_cache(rows, ttl):
    """Plain loop over (key, seq, at, value)."""
    entry, out = {}, set()
    for key, seq, at, value in sorted(rows, key=lambda r: (r[2], r[1])):
        hit = key in entry and at - entry[key][1] < ttl
        if not hit:
            entry[key] = (value, at)
        out.add((key, seq, at, hit, *entry[key]))
    return out, entry


def test_a_cache_refreshes_what_is_too_old_in_any_batches(spark, tmp_path):
    import random
    from datetime import datetime, timedelta, timezone

    rng, start = random.Random(1), datetime(2026, 1, 1, tzinfo=timezone.utc)
    hours = sorted(rng.randrange(2000) for _ in range(400))
    rows = [(rng.choice("abcdefgh"), i, start + timedelta(hours=h), None if i % 9 == 0 else f"v{i}") for i, h in enumerate(hours)]
    micros = lambda t: int((t - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))
    due, entries = plain_cache([(k, i, micros(t), v) for k, i, t, v in rows], 72 * 3_600_000_000)
    schema = "key string, seq long, asked timestamp, value string"
    for n, cuts in enumerate(([400], [150, 151, 300, 400])):
        source, store = str(tmp_path / f"in{n}"), str(tmp_path / f"store{n}")
        for a, b in zip([0, *cuts], cuts, strict=False):
            odd = [(None, 1, start, "x"), ("a", 2, None, "y")]
            spark.createDataFrame(rows[a:b] + odd, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            caches.cache_stream(stream, "asked", 72 * 3600, store, str(tmp_path / f"cp{n}"), flush=10).awaitTermination()
        got = caches.served(spark, store)
        assert {tuple(r) for r in got.collect()} == due and got.count() == len(due)
        now = max(e[1] for e in entries.values())
        live = {r.key: r.value for r in caches.live_entries(spark, store, now, 72 * 3600).collect()}
        assert live == {k: v for k, (v, at) in entries.items() if at > now - 72 * 3_600_000_000}
    files = [f for f in (tmp_path / "store0" / "entries").glob("batch=*/*.parquet")]
    assert len(files) >= sum(not r[3] for r in due) // 10


def test_rounds_ask_for_what_is_left(spark, tmp_path):
    """A killed run's round is asked again, answered keys never are."""
    ids, asked, inventory = spark.range(10).withColumnRenamed("id", "k"), [], str(tmp_path / "inventory")

    def ask(rows, turn):
        asked.append(sorted(r.k for r in rows.collect()))
        if turn == 1 and len(asked) == 2:
            return rows.withColumn("error", F.when(F.col("k") == 9, F.raise_error(F.lit("killed"))))
        return rows.withColumn("error", F.when(F.col("k") % 4 > turn, F.lit("no")))

    with pytest.raises(Exception, match="killed"):
        rounds.run_rounds(ids, ask, inventory, "k", 3)
    assert rounds.committed_rounds(spark, inventory) == [0]
    got = {r.k: (r.error, r.round) for r in rounds.run_rounds(ids, ask, inventory, "k", 3).collect()}
    left = [k for k in range(10) if k % 4]
    assert asked == [list(range(10)), left, left, [k for k in range(10) if k % 4 > 1]]
    assert got == {k: ("no" if k % 4 > 2 else None, min(k % 4, 2)) for k in range(10)}
    assert rounds.run_rounds(ids.limit(0), ask, str(tmp_path / "none"), "k").count() == 0


def test_a_store_that_fails_to_be_written_stays_as_it_was(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "k long, v string"
    assert sinks.read_store(spark, path, schema).count() == 0
    sinks.write_store(spark.range(5).selectExpr("id as k", "'old' as v"), path, ["k"])
    with pytest.raises(Exception, match="broken"):
        sinks.write_store(spark.range(5).select(F.col("id").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("broken"))).alias("v")), path, ["k"])
    assert {r.v for r in sinks.read_store(spark, path, schema).collect()} == {"old"}
    sinks.write_store(spark.range(2).selectExpr("id as k", "'new' as v"), path, ["k"])
    assert [tuple(r) for r in sinks.read_store(spark, path, schema).orderBy("k").collect()] == [(0, "new"), (1, "new")]
    assert len(list((tmp_path / "store").glob("data-*"))) == 1 and not list((tmp_path / "store").glob("store-*"))


def test_cue_stream_and_rates(spark, tmp_path):
    words = [("m", 0, i, "word." if i % 5 == 4 else "word", i * 0.4, i * 0.4 + 0.4) for i in range(50)]
    schema = "media_id string, seg_no int, word_no int, word string, start_s double, end_s double"
    spark.createDataFrame(words, schema).coalesce(1).write.parquet(str(tmp_path / "w"))
    stream = stream_cues(spark.readStream.schema(schema).parquet(str(tmp_path / "w")))
    query = stream.writeStream.format("memory").queryName("cues_out").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("cues_out").count() == 10 or not query.isActive:
                break
            query.awaitTermination(1)
    finally:
        query.stop()
    assert spark.table("cues_out").count() == 10
    e = spark.sql("select timestamp_ntz'2026-01-01 00:10:00' ts, 'a' event_type, 1.0D value")
    assert [(r.n, r.total) for r in event_rates(e).collect()] == [(1, 1.0)]


def test_sinks(spark, tmp_path):
    chunks = spark.createDataFrame([("d", 0, " text ")], "doc_id string, chunk_no int, text string")
    sinks.write_chunks(chunks, str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).first().value == "text"
    sinks.append_log(spark.createDataFrame([("m",), (" ",)], "message string"), str(tmp_path / "l"), "r1")
    assert spark.read.json(str(tmp_path / "l")).count() == 1
    records = spark.createDataFrame([("b", 1), ("a", 2)], "id string, n int").coalesce(1)
    sinks.write_store(records, str(tmp_path / "s"), ["id"])
    assert [json.loads(line)["id"] for f in (tmp_path / "s").glob("data-*/*.json") for line in f.read_text().splitlines()] == ["a", "b"]
    sinks.write_changed(spark.createDataFrame([(1, "x", True), (2, "y", False)], "doc_id int, text string, changed boolean"), str(tmp_path / "t"))
    assert [r.doc_id for r in spark.read.parquet(str(tmp_path / "t")).collect()] == [1]
    sinks.write_manifest(spark.createDataFrame([("d", 3)], "doc_id string, tokens int"), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().tokens == 3


def test_ass_documents_are_few_python_objects_at_once():
    import pyarrow as pa

    from lumenrow.sources import files

    sizes = []
    values = pa.array([f"line {k}" for k in range(3 * files.SLICE + 1)])
    got = files.in_slices(lambda some: sizes.append(len(some)) or [x + "!" for x in some], pa.string(), values)
    assert got.to_pylist() == [f"line {k}!" for k in range(3 * files.SLICE + 1)] and max(sizes) == files.SLICE
    assert files.in_slices(lambda some: some, pa.string(), values.slice(0, 0)).to_pylist() == []


def test_a_bucket_of_a_cache_asks_its_state_once_a_batch(monkeypatch):
    """each key of a batch was a call of Python with requests to the state store of its own."""
    import random
    import types

    import pandas as pd

    class State:
        held, asked = None, 0

        def exists(self):
            return self.held is not None

        def get(self):
            self.asked += 1
            return self.held

        def update(self, value):
            self.held = value

        def clear(self):
            self.held = None

    state, timers, rng = State(), [], random.Random(2)
    entries = caches.CacheEntries(50)
    entries.init(types.SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.append))
    rows = [(rng.choice("abcdefghij"), i, i * 3, f"v{i}") for i in range(300)]
    due, last = plain_cache(rows, 50)
    got = set()
    for at in (0, 100, 200):
        frame = pd.DataFrame([(k, k, i, t, v) for k, i, t, v in rows[at : at + 100]], columns=["id", "key", "seq", "at", "value"])
        for served in entries.handleInputRows((0,), iter([frame]), None):
            got |= {(r.key, r.seq, r.at, bool(r.hit), r.value, r.fetched) for r in served.itertuples()}
    assert got == due and state.asked == 2 and len(timers) == 3
    assert dict(zip(state.held[0], zip(state.held[1], state.held[2], strict=True), strict=True)) == last
    now = sorted(at for _, at in last.values())[4] + 50
    list(entries.handleExpiredTimer((0,), None, types.SimpleNamespace(getExpiryTimeInMs=lambda: now / 1000)))
    assert set(state.held[0]) == {k for k, (_, at) in last.items() if at + 50 > now}
    list(entries.handleExpiredTimer((0,), None, types.SimpleNamespace(getExpiryTimeInMs=lambda: 10**9)))
    assert state.held is None
