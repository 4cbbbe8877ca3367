"""Queries over landed stores, listings, subtitles, paged texts and positioned lines, made from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.functions import numbers as nm
from lumenrow.functions import text as tx
from lumenrow.functions import urls as ur
from lumenrow.operators import chunking, cleaning, cues, fileplan, layout, reconcile, report, sequences, stores
from lumenrow.operators import lines as ln
from lumenrow.operators.tables import file_system, shared_path
from lumenrow.plans import documents
from lumenrow.plans.base import cues as cue_table
from lumenrow.plans.base import table
from lumenrow.sources import ass, files, paged_api, sinks
from lumenrow.streaming import rounds

DAY = 86_400_000


def _joined(rows: DataFrame, by: str, order: str, part: Column, joiner: str) -> DataFrame:
    """(by, text): parts of each group in order."""
    listed = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, part.alias("t")))).alias("parts"))
    return listed.select(by, F.array_join(F.transform("parts", lambda p: p["t"]), joiner).alias("text"))


def clean_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as the pages of a book with a running title: markers, titles and numbers go, pages stay apart."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    page = F.format_string("### Page %d\n\n%d. Of Orders And Parts\nOrder %d was sent, and nothing came back.\n", F.col("k"), F.col("k"), F.col("o_orderkey"))
    return cleaning.clean_documents(_joined(o, "o_custkey", "k", page, "")).select("o_custkey", "text", "edits", "blanks", "changed")


def folder_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as documents of their region's folder: titles that several begin with go from all of them."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    title = F.format_string("%d Of %s\n", F.col("n_nationkey"), F.initcap("r_name"))
    text = F.concat(title, F.lit("The people of "), F.col("n_name"), F.lit(" live there, and all of them are well.\n"))
    d = n.select(F.col("n_regionkey").alias("folder"), F.col("n_nationkey").alias("doc_id"), text.alias("text"))
    return cleaning.clean_documents(d, titles=ln.learned_titles_of_folders(d)).select("folder", "doc_id", "text", "edits")


def running_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles that at least two pages of a customer's orders begin with, by priority."""
    o = table(spark, sf_dir, "orders")
    part = F.format_string("### Page %d\n\n%d. The %s Chapter\nwords\n", F.col("o_orderkey"), F.col("o_orderkey") % 999 + 1, F.substring("o_orderpriority", 3, 20))
    books = _joined(o, "o_custkey", "o_orderkey", part, "").withColumnRenamed("o_custkey", "doc_id")
    return ln.learned_titles(ln.explode_lines(books))


def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation as a record store in one of its three shapes."""
    c = table(spark, sf_dir, "customer")
    record = F.create_map(F.lit("title"), F.col("c_name"), F.lit("video_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.lit(" ")))
    rows = c.groupBy("c_nationkey").agg(F.collect_list(F.struct(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"), record.alias("value"))).alias("rows"))
    bare, listed = F.to_json(F.map_from_entries("rows")), F.to_json(F.transform("rows", lambda r: F.map_concat(r["value"], F.create_map(F.lit("id"), r["key"]))))
    shape = F.when(F.col("c_nationkey") % 3 == 0, F.concat(F.lit('{"videos": '), bare, F.lit("}"))).when(F.col("c_nationkey") % 3 == 1, bare).otherwise(listed)
    found = stores.records_of(rows.select(F.col("c_nationkey").alias("store"), shape.alias("text")))
    return found.select("store", "video_id", F.try_element_at("record", F.lit("title")).alias("title"))


def cached_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders looked up in a cache that each customer's text holds: young entries with a count give what a cache keeps."""
    o = table(spark, sf_dir, "orders")
    entry = F.struct(F.col("o_orderkey").cast("double").alias("fetched_at"), F.create_map(F.lit("view_count"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey").cast("string")), F.lit("title"), F.col("o_orderpriority"), F.lit("secret"), F.lit("x")).alias("metadata"))
    texts = o.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderkey").cast("string"), entry))).alias("m"))
    cache = stores.cache_of(texts.select(F.to_json(F.struct(F.col("m").alias("videos"))).alias("text")))
    found = report.cached_details(o.select(F.col("o_orderkey").cast("string").alias("video_id")), cache, now=3000.0, ttl_seconds=2500.0)
    kept = report.cacheable(F.col("metadata"))
    return found.select("video_id", *(F.try_element_at(kept, F.lit(k)).alias(k) for k in ("title", "view_count", "secret")))


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as themes of a configuration and their nations as channels, some of them switched off."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    channel = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit('"'), F.col("n_name"), F.lit('"'))).otherwise(F.concat(F.lit('{"url": "'), F.col("n_name"), F.lit('", "enabled": "'), F.when(F.col("n_nationkey") % 3 == 1, F.lit("off")).otherwise(F.lit("yes")), F.lit('"}')))
    theme = F.concat(F.lit('{"theme": "'), F.col("r_name"), F.lit('", "min_views": "5k", "date_after": "2020-01-01", "channels": ['), F.array_join(F.transform("channels", lambda c: c["c"]), ", "), F.lit("]}"))
    listed = n.groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", channel.alias("c")))).alias("channels")).select(theme.alias("t"))
    texts = listed.agg(F.concat(F.lit('{"themes": ['), F.array_join(F.array_sort(F.collect_list("t")), ", "), F.lit("]}")).alias("text"))
    found = stores.unique_names(stores.themes_of(texts), "theme")
    channels = stores.enabled_channels(found).withColumn("pos", F.col("pos").cast("bigint"))
    return channels.join(found.select("theme", nm.parse_count(F.col("min_views")).alias("min_views"), nm.date_limit(F.col("published_after")).alias("after")), "theme")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as prompts of their segment's project: one is moved, a project renamed, one deleted; each with its place."""
    c = table(spark, sf_dir, "customer")
    one = F.struct(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.lower("c_name")).alias("title"), F.lit("t").alias("created_at"), F.lit("u").alias("updated_at"))
    texts = c.groupBy("c_mktsegment").agg(F.collect_list(one).alias("prompts"))
    text = F.to_json(F.struct(F.map_from_arrays(F.array(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit("  x "))), F.array("prompts")).alias("projects")))
    found = stores.prompts_of(texts.select(text.alias("text")))
    moved = stores.removed(stores.moved(found, "1", "FURNITURE x", "now"), "id", "2")
    named = moved.withColumn("project", F.when(F.col("project") == "MACHINERY x", F.lit("new")).otherwise(F.col("project")))
    place = F.row_number().over(Window.partitionBy("project").orderBy(*stores.prompt_order())).cast("bigint")
    return named.select("project", "id", "title", "updated_at", place.alias("place"))


def renamed_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions under a new name for one of them; names stay unique."""
    return stores.renamed(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_name", "ASIA", "Asia Minor")


def best_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation with most customers, the last by name on ties, if it has more than two."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return stores.best_store(c.select(F.concat(F.lit("/"), F.col("n_name")).alias("path")), 2)


def channel_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of all nations in one bag, counted; entries of the same name stay."""
    rows = stores.union_all(*(table(spark, sf_dir, t).select(F.col(f"{t[0]}_nationkey").alias("nation"), F.lit(1).alias("one")) for t in ("customer", "supplier", "supplier")))
    return rows.groupBy("nation").agg(F.count("*").alias("entries"))


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' cues within a day, a second long."""
    c = cue_table(spark, sf_dir).withColumn("start_ms", F.pmod("start_ms", F.lit(DAY)))
    return c.withColumn("end_ms", F.col("start_ms") + 1000).drop("event_type")


def _parsed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.col("ord").cast("bigint").alias("ord"), "start_ms", "end_ms", F.array_join("lines", "|").alias("text"))


def srt_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered tracks with words around their times: the searching parser finds them all, the strict one none."""
    text = cues.render_srt(_tracks(spark, sf_dir)).withColumn("text", F.regexp_replace("text", r"(\d\d:\d\d:\d\d,\d{3} --> \d\d:\d\d:\d\d,\d{3})", "at $1 on"))
    strict = cues.parse_srt(text).withColumn("ord", F.col("ord") - 1)
    return _parsed(cues.parse_srt(text, "search").unionByName(strict))


def srt_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks rendered in file order: the line-wise parser gives them by time, numbered anew."""
    found = cues.renumber(cues.parse_srt(cues.render_srt(_tracks(spark, sf_dir)), "lenient_sorted"), ("start_ms", "end_ms", "ord"))
    return found.select("doc_id", F.col("number").cast("bigint").alias("number"), "start_ms")


def ass_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as ASS documents, to bytes and back, parsed by their format line."""
    text = cues.render_ass(_tracks(spark, sf_dir), "used M")
    read = text.select("doc_id", files.ass_documents(F.encode("text", "UTF-8")).alias("d"))
    again = read.select("doc_id", files.ass_documents(files.ass_bytes(F.col("d")))["lines"].alias("lines"))
    events = ass.parse_events(again).filter("kind = 'dialogue'")
    field = lambda k: F.try_element_at("fields", F.lit(k))
    return events.select("doc_id", "start_ms", "end_ms", field("layer").alias("layer"), field("style").alias("style"), field("text").alias("text"))


def ass_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ASS tracks cut at noon: events of each half, counted from its start."""
    text = cues.render_ass(_tracks(spark, sf_dir))
    events = ass.parse_events(text.select("doc_id", F.split("text", "\n").alias("lines")))
    halves = text.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("seg_no"), F.lit(k * DAY // 2).cast("bigint").alias("seg_start_ms"), F.lit((k + 1) * DAY).cast("bigint").alias("seg_end_ms")) for k in (0, 1)))).alias("s")).select("doc_id", "s.*")
    clipped = ass.clip_events(events, halves).select("doc_id", F.col("seg_no").cast("bigint").alias("seg_no"), F.explode(F.filter("lines", lambda x: x.startswith("Dialogue:"))).alias("line"))
    return clipped.select("doc_id", "seg_no", nm.ass_to_ms(F.split("line", ",")[1]).alias("start_ms"), F.split("line", ",")[9].alias("text"))


def rebuilt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of users' cues with translations in their order; the last line of each has none."""
    lines = cues.text_lines(_tracks(spark, sf_dir))
    last = F.row_number().over(Window.partitionBy("doc_id").orderBy(cues.line_number(F.col("line_id")).desc())) == 1
    given = lines.withColumn("_last", last).filter("not _last").select("doc_id", cues.line_number(F.col("line_id")).alias("seq"), F.upper("text").alias("text"))
    return cues.rebuild(lines, given).select("doc_id", "line_id", "translation")


def _media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of their brand's folder."""
    p = table(spark, sf_dir, "part")
    name = F.concat(F.format_string("%d - ", F.col("p_size")), F.col("p_name"), F.lit(" & Co, "), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 3 == 0, F.lit(".mp4")).when(F.col("p_partkey") % 3 == 1, F.lit(".en.srt")).otherwise(F.lit(".Mp3")))
    return p.select("p_partkey", F.col("p_brand").alias("dir"), name.alias("name"), (F.col("p_partkey") % 5).cast("bigint").alias("size"), F.lit(False).alias("is_dir"))


def media_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of brands' folders that each scan finds, by name."""
    m = _media(spark, sf_dir)
    found = [fileplan.files_with(m, "mp4", "mp3").select("dir", "name", F.lit("audio").alias("scan")), fileplan.media_files(m).select("dir", "name", F.lit("media").alias("scan")), fileplan.tagged_subtitles(m).select("dir", F.col("base").alias("name"), F.col("lang").alias("scan"))]
    return stores.union_all(*found)


def index_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices of finished downloads, padded to the width of the longest of all."""
    m = _media(spark, sf_dir)
    return fileplan.completed_indices(m, ("mp4",)).join(fileplan.index_width(m)).select(F.col("index").cast("bigint").alias("index"), nm.padded_index(F.col("index"), F.col("width")).alias("shown"))


def index_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames that pad the indices of files to four digits."""
    return fileplan.index_rename_plan(_media(spark, sf_dir), 4).select("dir", "source", "destination", "conflict")


def portable_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames of downloads to portable names, and to ASCII words."""
    m = _media(spark, sf_dir)
    portable = fileplan.portable_rename_plan(m).withColumn("plan", F.lit("portable"))
    plain = fileplan.ascii_rename_plan(m).withColumn("plan", F.lit("ascii"))
    return portable.unionByName(plain).select("plan", "dir", "source", "destination", "conflict")


def refused_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames of a plan with a conflict, none of which is done, beside one without any."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dir"), F.col("p_type").alias("source"), F.lower("p_type").alias("destination"), (F.col("p_size") > 1000).alias("never"), (F.col("p_partkey") == 3).alias("once"))
    return reconcile.all_or_nothing(p, F.col("never")).unionByName(reconcile.all_or_nothing(p, F.col("once"))).groupBy("dir").agg(F.count("*").alias("renames"))


def free_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names for each brand's parts of a type; where a supplier's file has the name already, the next number."""
    wanted = table(spark, sf_dir, "part").select(F.col("p_brand").alias("dir"), F.col("p_type").alias("base"), F.lit(".txt").alias("ext"), F.col("p_partkey").alias("seq"))
    taken = table(spark, sf_dir, "part").filter("p_size > 45").select(F.col("p_brand").alias("dir"), F.concat("p_type", F.lit("_2.txt")).alias("name")).distinct()
    return fileplan.numbered_names(wanted, taken).select("dir", "seq", "name")


def wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders named for downloads, with the downloads that belong into them."""
    m = _media(spark, sf_dir)
    folders = m.filter("p_partkey % 2 = 0").select(F.concat(tx.artifact_base(F.col("name")), F.lit(". #")).alias("name"))
    return fileplan.wrapper_matches(folders.filter("name is not null"), m)


def first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part's title the file of the first known extension."""
    m = _media(spark, sf_dir)
    return fileplan.first_existing(m.select("dir", fileplan.stem(F.col("name")).alias("base")), m)


def durations_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as media: how many, how long in all, which can't be read, which are long."""
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 11 == 0, F.lit("N/A")).otherwise((F.col("o_orderkey") * 7 % 4000).cast("string"))
    return fileplan.duration_report(o.select(raw.alias("duration_raw")))


def inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as playlists: length, indices within bounds, and whether a message tells of a sign-in."""
    o = table(spark, sf_dir, "orders")
    items = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: F.struct(F.when(k % 2 == 0, (k % 50).cast("string")).alias("index")))
    lists = o.groupBy(F.col("o_custkey").alias("list_id")).agg(items.alias("items")).select("list_id", F.when(F.col("list_id") % 2 == 0, F.lit(99)).alias("n_entries"), F.lit(None).cast("int").alias("playlist_count"), "items")
    found = fileplan.inventory(lists)
    inside = F.filter("indices", lambda i: fileplan.in_index_range(i, F.lit(30), F.lit(2)))
    message = F.when(F.col("list_id") % 3 == 0, F.lit("Please Sign In to go on")).otherwise(F.lit("done"))
    return found.select("list_id", F.col("length").cast("bigint").alias("length"), nm.index_list(inside).alias("indices"), fileplan.contains_any(message, ("sign in", "captcha")).alias("asked"))


def result_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as results of a batch, and the first failed ones as a sample."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", F.lit("failed")).when(F.col("o_orderstatus") == "O", F.lit("skipped")).otherwise(F.lit("completed"))
    rows = o.select("o_orderkey", status.alias("status"), F.when(status == "failed", F.col("o_orderpriority")).alias("error"))
    _, wrong = reconcile.split_errors(rows)
    return fileplan.result_counts(rows).join(reconcile.first_ids(wrong, "o_orderkey", 5)).select("completed", "skipped", "failed", F.array_join("ids", ",").alias("sample"))


def new_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are supported, not known yet and have no output that holds anything."""
    m = _media(spark, sf_dir)
    paths = m.select(F.concat("dir", F.lit("/"), "name").alias("path"), "size", "p_partkey")
    fresh = fileplan.supported_new(paths.unionByName(paths), paths.filter("p_partkey % 4 = 0"), ("mp4", "srt"))
    return fileplan.without_outputs(fresh.withColumnRenamed("path", "target"), paths.select("path", "size")).select("target")


def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as lines of a page in two columns by parity, below a title: the left one is read first."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    left, y = F.col("k") % 2 == 0, 100.0 + 20.0 * F.floor(F.col("k") / 2)
    rows = o.select(F.col("o_custkey").alias("page_id"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"), F.format_string("Order %d went out on time.", F.col("o_orderkey")).alias("text"), F.when(left, 60.0).otherwise(330.0).alias("x0"), y.alias("y0"), F.when(left, 280.0).otherwise(550.0).alias("x1"), (y + 10).alias("y1"))
    head = rows.select("page_id", "page_width", "page_height", F.lit("12. Of Orders").alias("text"), F.lit(60.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(550.0).alias("x1"), F.lit(30.0).alias("y1")).distinct()
    return layout.page_layout(rows.unionByName(head))


def scanned_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders as scanned lines: far ones and notes in the margin are blocks of their own."""
    o = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    top = 0.95 - 0.03 * F.col("k") - F.when(F.col("k") >= 5, 0.2).otherwise(0.0)
    rows = o.select(F.col("o_custkey").alias("page_id"), F.format_string("Order %d is a line of its own.", F.col("o_orderkey")).alias("text"), F.lit(0.3).alias("x"), top.alias("top"), (top - 0.02).alias("bottom"), F.lit(0.02).alias("height"))
    notes = o.filter("k = 0").select(F.col("o_custkey").alias("page_id"), F.lit("note").alias("text"), F.lit(0.1).alias("x"), F.lit(0.99).alias("top"), F.lit(0.97).alias("bottom"), F.lit(0.02).alias("height"))
    return layout.scan_paragraphs(rows.unionByName(notes))


def page_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: which go to OCR, and whose text is taken from where."""
    d = table(spark, sf_dir, "documents")
    direct = F.when(F.col("doc_id") % 5 == 0, F.lit("x")).otherwise(F.col("text"))
    images = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit(70.0))).otherwise(F.array(F.lit(10.0)))
    spans = F.array(F.struct(F.lit(0.0).alias("alpha"), F.lit("GlyphLessFont").alias("font")))
    wanted = layout.needs_ocr(direct, images, spans, F.lit(100.0))
    pages = d.select("doc_id", direct.alias("direct_text"), F.when(F.col("doc_id") % 2 == 0, F.lit("short")).alias("layout_text"), wanted.alias("ocr_wanted"), F.when(F.col("doc_id") % 10 != 0, F.lit("read by OCR")).alias("ocr_text"))
    done = layout.choose_page_text(pages)
    return done.select("doc_id", "ocr_wanted", "source", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines of a paged text: what kind each is, and its words without reader noise and stray blanks."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 5
    line = F.when(k == 0, F.lit("### Source PDF: x.pdf")).when(k == 1, F.format_string(" ### page %d", F.col("o_orderkey"))).when(k == 2, (F.col("o_orderkey") % 99999).cast("string")).when(k == 3, F.lit("( so , it is ) !")).otherwise(F.lit("12 mins left in book 33 %"))
    return o.select("o_orderkey", tx.is_metadata_line(line).alias("metadata"), tx.is_page_marker(line).alias("marker"), tx.is_page_number(line).alias("number"), tx.clean_line(line).alias("clean"), tx.strip_reader_noise(line).alias("quiet"))


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of publication, coercions, percentages, thumbnails, banners and wrapped subtitles of orders."""
    o = table(spark, sf_dir, "orders")
    thumb = lambda name, w, h: F.struct(F.lit(name).alias("url"), w.cast("int").alias("width"), h.cast("int").alias("height"))
    thumbs = F.array(thumb("a", F.lit(10), F.lit(10)), thumb("b", F.col("o_orderkey") % 30, F.lit(10)), thumb("", F.lit(99), F.lit(99)))
    day = F.col("o_orderdate").cast("date")
    return o.select(
        "o_orderkey", nm.published_value(F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyyMMdd")).otherwise(F.lit("soon")), F.when(F.col("o_orderkey") % 3 == 0, F.lit(86400))).alias("published"),
        nm.optional_positive(F.concat(F.lit(" "), (F.col("o_orderkey") - 100).cast("string"))).alias("positive"), nm.optional_text(F.when(F.col("o_orderkey") % 2 == 0, F.lit(" None ")).otherwise(F.col("o_orderpriority"))).alias("given"),
        nm.percent(F.col("o_orderkey").cast("double"), F.lit(2000.0)).cast("bigint").alias("done"), ur.largest_thumbnail(thumbs).alias("thumbnail"), F.substring(tx.banner("M", day), 1, 10).alias("banner"),
        tx.wrapped(F.concat_ws(" ", F.lit("the order of"), "o_orderpriority", F.lit("came in time and went out again on a day"))).alias("wrapped"), nm.span(F.col("o_totalprice"), F.lit(1e5)).alias("span"), nm.compact_clock(F.col("o_orderkey") + 0.5).alias("clock"),
    )


def chunk_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of half a reader's capacity of documents, as files with their sizes."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = chunking.manifest(chunking.chunk_by_length(d, chunking.chunk_budget(8000)))
    return found.select("doc_id", F.size("outputs").cast("bigint").alias("files"), F.get("outputs", F.lit(0))["file"].alias("first_file"), "tokens")


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as pages of one combined text, by natural order of their names."""
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("text of "), F.col("n_name")).alias("text"))
    return chunking.combined_corpus(n).select("doc_id", "text")


def html_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as a ranked report and nations by region as its statistics, on one page."""
    r = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("rank"), F.concat(F.lit("<"), "r_name", F.lit(">")).alias("title"))
    return report.html_report(r, table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count("*").alias("n")))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a small file dealt to all cores, as what follows takes long a row."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def side_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts with side notes: labelled before or behind their cue, in capitals or mixed, breaking a sentence or summing up the next."""
    k = F.col("o_orderkey")
    breaks = F.format_string("We saw order %d of the\nTOWN HALL opposite The square and its trees\nold town and left.\nThen it rained.\n", k)
    sums_up = F.format_string("They saw order %d come.\noverleaf GREAT RIVER BRIDGE The bridge of order %d was built by many hands\nThe great river bridge was built by many hands over years.\nIt stands still.\n", k, k)
    mixed = F.format_string("We saw order %d of the old\nthe old TOWN HALL opposite The square\ntown and left.\nThen it rained.\n", k)
    plain = F.format_string("We saw order %d opposite the old town.\nThe square lies below it.\n", k)
    text = F.when(k % 4 == 0, breaks).when(k % 4 == 1, sums_up).when(k % 4 == 2, mixed).otherwise(plain)
    return cleaning.clean_documents(_dealt(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")))).select("o_orderkey", "text")


def line_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts of four line ends, every third in pages that a running title begins: lines that stay keep their ends."""
    k = F.col("o_orderkey")
    end = F.element_at(F.array(F.lit("\n"), F.lit("\r\n"), F.lit("\r"), F.lit("\u0085")), (k % 4 + 1).cast("int"))
    lines = F.when(k % 3 == 0, F.array(F.lit("### Page 21"), F.lit("21. Of Old Orders"), F.format_string("Order %d went", k), F.lit("### Page 22"), F.lit("22. Of Old Orders"), F.lit("out at last."), F.lit("All is well.")))
    text = F.array_join(F.transform(F.coalesce(lines, F.array(F.format_string("Order %d went out.", k), F.lit("All is well."))), lambda x: F.concat(x, end)), "")
    done = cleaning.clean_documents(_dealt(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))))
    return done.select("o_orderkey", F.hex("text").alias("text"), "edits", "changed")


def cleaned_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents, with noise in every third, were scanned and changed, and how many edits that took."""
    o = table(spark, sf_dir, "orders")
    text = F.format_string("Order %d is here.\n", F.col("o_orderkey"))
    noisy = F.when(F.col("o_orderkey") % 3 == 0, F.concat(text, F.lit("Page 3 of 80\n\n"))).otherwise(text)
    return cleaning.clean_totals(cleaning.clean_documents(o.select("o_orderkey", noisy.alias("text"))))


def rebuild_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether orders of customers may stand in for the customers, and how many of both would change places."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("seq"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("seq"), F.min("o_orderpriority").alias("text"))
    return reconcile.may_rebuild(reconcile.reconcile(c, o, "id")).join(reconcile.order_differs(c, o, "id").agg(F.count("*").alias("moved")))


def sidecar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of subtitles beside the parts of cut videos, unfinished downloads aside, and the folder that is next."""
    m = _media(spark, sf_dir)
    base = fileplan.stem(F.col("name"))
    subtitle = F.when(F.col("p_partkey") % 2 == 0, F.concat(base, F.lit(".fr.srt"))).otherwise(F.lit("other.ass"))
    shown = fileplan.sidecar_name(F.concat(base, F.lit("_part1.mp4")), F.col("name"), subtitle, F.lit(2))
    folders = table(spark, sf_dir, "nation").select(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("name"), F.lit(True).alias("is_dir"))
    rows = m.filter("p_partkey % 3 = 0").withColumn("download", F.when(F.col("p_partkey") % 2 == 0, F.concat("name", F.lit(".part"))).otherwise(F.col("name")))
    return rows.filter(~fileplan.is_residue(F.col("download"))).select("p_partkey", shown.alias("sidecar")).join(fileplan.next_batch_folder(folders)).withColumn("next", F.col("next").cast("bigint"))


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries whose id is their own, or what their address names; others go."""
    o = table(spark, sf_dir, "orders")
    key = F.lpad(F.col("o_orderkey").cast("string"), 11, "v")
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), key)).otherwise(F.lit("x")).alias("id"), F.when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("https://youtu.be/"), key)).alias("url"), F.concat(F.lit(" "), "o_orderpriority").alias("title"))
    return stores.normalised_record(rows).select("o_orderkey", "video_id", "title")


def literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' texts without a literal of two lines, in any line end, and prompts without the fence they came in."""
    o = table(spark, sf_dir, "orders")
    text = F.concat(F.lit("a AD\r\nON b "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("AD\nON")).otherwise(F.lit("")))
    gone = tx.remove_literal(text, "AD\nON")
    fenced = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("```text\n"), "o_orderpriority", F.lit("\n```"))).otherwise(F.concat(F.lit(" "), F.col("o_orderpriority")))
    return o.select("o_orderkey", gone["text"].alias("text"), gone["removed"].alias("removed"), tx.without_code_fence(fenced).alias("prompt"), nm.seconds_to_srt(F.col("o_orderkey") / 4).alias("stamp"), nm.iso_utc(F.col("o_orderdate").cast("timestamp")).alias("moment"))


def bilingual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks with a second language below each line, as ASS, read back as events."""
    both = _tracks(spark, sf_dir).withColumn("source_text", F.when(F.col("ord") % 2 == 0, F.upper(F.get("lines", F.lit(0)))))
    text = cues.render_ass(both)
    events = ass.parse_events(text.select("doc_id", F.split("text", "\n").alias("lines"))).filter("kind = 'dialogue'")
    return events.select("doc_id", "start_ms", F.try_element_at("fields", F.lit("text")).alias("text"))


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names with accents as bytes of two encodings, read with a fallback and without."""
    c = table(spark, sf_dir, "customer")
    name = F.concat("c_name", F.lit(" é ü"))
    content = F.when(F.col("c_custkey") % 2 == 0, F.encode(name, "UTF-8")).otherwise(F.encode(name, "ISO-8859-1"))
    loose, strict = files.decoded(content), files.decoded(content, strict=True)
    return c.select("c_custkey", loose["text"].alias("text"), loose["encoding"].alias("encoding"), strict["text"].alias("strict"))


def landed_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as landed answers of a paged API: a channel of each customer in pages of three uploads, and one of all in pages of fifty.

    Tokens tell nothing of a page's place. Every fifth order has no details; a stray page leads nowhere.
    """
    o = table(spark, sf_dir, "orders")
    customer = Window.partitionBy("o_custkey")
    page, last = F.floor((F.row_number().over(customer.orderBy("o_orderkey")) - 1) / 3), F.floor((F.count("*").over(customer) - 1) / 3)
    own = o.select("o_orderkey", F.concat(F.lit("U"), F.col("o_custkey").cast("string")).alias("playlist_id"), page.alias("page"), last.alias("last"))
    own = own.withColumn("previous", F.when(F.col("page") > 0, F.col("page") - 1)).withColumn("following", F.when(F.col("page") < F.col("last"), F.col("page") + 1)).drop("last")
    every = o.select("o_orderkey", F.lit("UA").alias("playlist_id"), F.floor(F.col("o_orderkey") / 50).alias("page"))
    # One channel has pages as many as there are orders: what stands beside each is found in blocks.
    beside = sequences.handed_on(sequences.in_blocks(every.select("playlist_id", "page").distinct(), "page"), "playlist_id", lasts={"previous": F.col("page")}, firsts={"following": F.col("page")}, number="page")
    video = lambda: F.concat(F.lit("v"), F.col("o_orderkey").cast("string"))
    item = F.struct(F.struct(video().alias("videoId")).alias("contentDetails"))
    items = F.array_sort(F.collect_list(F.struct("o_orderkey", item.alias("item")))).alias("items")
    pages = own.groupBy("playlist_id", "page", "previous", "following").agg(items).unionByName(every.groupBy("playlist_id", "page").agg(items).join(beside.drop("_block"), ["playlist_id", "page"]))
    token = lambda page: F.md5(F.concat_ws("/", "playlist_id", page.cast("string")).cast("binary"))
    answer = F.to_json(F.struct(F.transform("items", lambda x: x["item"]).alias("items"), F.when(F.col("following").isNotNull(), token(F.col("following"))).alias("nextPageToken")))
    tokens = F.when(F.col("previous").isNotNull(), F.array(token(F.col("page")))).otherwise(F.array(F.lit(None), F.lit("stray")))
    uploads = pages.select("playlist_id", tokens.alias("tokens"), answer.alias("answer")).select("playlist_id", F.explode("tokens").alias("page_token"), "answer")
    channel = F.struct(F.array(F.struct(F.concat(F.lit("C"), "playlist_id").alias("id"), F.struct(F.concat(F.lit("Channel "), "playlist_id").alias("title")).alias("snippet"), F.struct(F.struct(F.col("playlist_id").alias("uploads")).alias("relatedPlaylists")).alias("contentDetails"))).alias("items"))
    channels = own.select("playlist_id").unionByName(every.select("playlist_id")).distinct().select(F.concat(F.lit("https://y.com/@"), "playlist_id").alias("channel_url"), F.to_json(channel).alias("answer"))
    count = F.col("o_orderkey").cast("string")
    detail = F.struct(video().alias("id"), F.struct(F.concat(F.lit("Video "), count).alias("title"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishedAt")).alias("snippet"), F.struct(count.alias("viewCount")).alias("statistics"), F.struct(F.concat(F.lit("PT"), (F.col("o_orderkey") % 3000).cast("string"), F.lit("S")).alias("duration")).alias("contentDetails"))
    batches = o.filter("o_orderkey % 5 <> 0").groupBy(F.floor(F.col("o_orderkey") / 50)).agg(F.collect_list(detail).alias("items"))
    return channels, uploads.repartition("playlist_id", "page_token"), batches.select(F.to_json(F.struct("items")).alias("answer"))


def paged_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos of :func:`landed_pages`, in the order of their channels."""
    rows = paged_api.landed_scan(*landed_pages(spark, sf_dir))
    return paged_api.videos_of(rows).select("video_id", "title", "view_count", "channel", "duration", "published_sort_value", "source_order")


def written_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' texts in chunks of 48 characters, written by document and chunk, and read back."""
    n = table(spark, sf_dir, "nation")
    d = n.select(F.col("n_nationkey").alias("doc_id"), F.concat_ws(" ", "n_name", F.lit("is a land of its own, they say. All of it is far. None of it is small.")).alias("text"))
    path = shared_path(spark, "chunks")
    sinks.write_chunks(chunking.chunk_by_measure(d, 48, len), path)
    return spark.read.text(path).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("chunk").cast("bigint").alias("chunk"), F.col("value").alias("text"))


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' priorities as messages of two runs, appended to a log without blank and noisy ones, and read back."""
    path = shared_path(spark, "log")
    message = F.when(F.col("o_orderkey") % 3 == 0, F.lit(" ")).when(F.col("o_orderkey") % 3 == 1, F.lit("Fetching detailed view counts for entries missing counts...")).otherwise(F.col("o_orderpriority"))
    for run in ("r1", "r2"):
        sinks.append_log(table(spark, sf_dir, "orders").select(message.alias("message")), path, run)
    return spark.read.json(path).groupBy("run", "message").agg(F.count("*").alias("n"))


def duration_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as media, in a plain report of how long they are."""
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 11 == 0, F.lit("N/A")).otherwise((F.col("o_orderkey") * 7 % 4000).cast("string"))
    return fileplan.duration_text(o.select(F.col("o_custkey").alias("dir"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), raw.alias("duration_raw")))


def long_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as media of half an hour or more."""
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 11 == 0, F.lit("N/A")).otherwise((F.col("o_orderkey") * 7 % 4000).cast("string"))
    return fileplan.long_media(o.select("o_orderkey", raw.alias("duration_raw"))).select("o_orderkey", "seconds")


def theme_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as themes with their nations as channels: one is added, two channels are switched, all are saved as JSON."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    channel = F.struct("n_nationkey", F.col("n_name").alias("url"), (F.col("n_nationkey") % 2 == 0).alias("enabled"))
    listed = n.groupBy(F.col("r_name").alias("theme")).agg(F.array_sort(F.collect_list(channel)).alias("c"))
    empty = F.lit(None).cast("string")
    rows = listed.select("theme", F.lit("5k").alias("min_views"), empty.alias("published_after"), empty.alias("published_before"), F.transform("c", lambda c: F.struct(c["url"].alias("url"), c["enabled"].alias("enabled"))).alias("channels"))
    new = rows.limit(1).select(F.lit("Atlantis").alias("theme"), "min_views", "published_after", "published_before", F.slice("channels", 1, 0).alias("channels"))
    return stores.themes_json(stores.toggled(stores.added(rows, new, "theme"), ("NATION_3", "NATION_4")))


def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as projects by name without case, one added and one gone."""
    c = table(spark, sf_dir, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", F.lit("building")).otherwise(F.col("c_mktsegment")).alias("project")).distinct()
    names = stores.removed(stores.added(c, c.limit(1).select(F.lit("Garden").alias("project")), "project"), "project", "MACHINERY")
    return report.ranked(names, stores.name_order("project"), "place")


def combined_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pages of one book, every seventh unreadable: one combined text in chunks, and what could not be read."""
    d = table(spark, sf_dir, "documents")
    pages = d.select(F.concat(F.lit("page "), F.col("doc_id").cast("string")).alias("name"), F.when(F.col("doc_id") % 7 != 3, F.col("text")).alias("text"))
    chunks, errors = chunking.corpus_chunks(pages, 2 * documents.BUDGET, "image")
    return chunks.select("doc_id", "chunk_no", "text", F.lit(None).cast("string").alias("error")).unionByName(errors.select(F.col("name").alias("doc_id"), F.lit(-1).cast("bigint").alias("chunk_no"), F.lit("").alias("text"), "error"))


def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders asked for in three rounds; each round fails for those whose key, modulo five, is beyond its number."""
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    ask = lambda rows, turn: rows.withColumn("error", F.when(F.col("o_orderkey") % 5 > turn, F.lit("not yet")))
    return reconcile.retried(o, ask, "o_orderkey").withColumn("round", F.col("round").cast("bigint"))


def resumed_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders asked for in rounds by three runs: one ends after its round, one is killed before its round is committed, one goes on; an order that is asked again says so."""
    o, inventory = table(spark, sf_dir, "orders").select("o_orderkey"), shared_path(spark, "inventory")

    def ask(rows: DataFrame, turn: int) -> DataFrame:
        return rows.withColumn("error", F.when(F.col("o_orderkey") % 5 > turn, F.lit("not yet"))).withColumn("asked", F.lit(turn + 1).cast("bigint"))

    rounds.run_rounds(o, ask, inventory, "o_orderkey", 1)
    rounds.run_rounds(o, lambda rows, turn: ask(rows, 99), inventory, "o_orderkey", 2)
    fs, mark = file_system(spark, f"{inventory}/round=1/_SUCCESS")
    fs.delete(mark, False)
    done = rounds.run_rounds(o, ask, inventory, "o_orderkey")
    return done.select("o_orderkey", "error", "asked", F.col("round").cast("bigint").alias("round"))


def replaced_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a record store that is replaced twice: once by a write that fails, which leaves it, and once whole."""
    c, path = table(spark, sf_dir, "customer"), shared_path(spark, "records")
    schema = "video_id string, title string"
    records = c.select(F.col("c_custkey").cast("string").alias("video_id"), F.col("c_name").alias("title"))
    sinks.write_store(records.filter("cast(video_id as bigint) % 3 = 0"), path, ["video_id"])
    broken = records.withColumn("title", F.when(F.col("video_id") == "7", F.raise_error(F.lit("broken off"))).otherwise(F.col("title")))
    try:
        sinks.write_store(broken, path, ["video_id"])
    except Exception as wrong:
        if "broken off" not in str(wrong):
            raise
    kept = sinks.read_store(spark, path, schema).groupBy().agg(F.count("*").alias("n")).first()["n"]
    sinks.write_store(records, path, ["video_id"])
    return sinks.read_store(spark, path, schema).withColumn("before", F.lit(kept).cast("bigint"))


def written_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' texts, noise in every third, cleaned; those that changed are written and read back."""
    text = F.format_string("Order %d is here.\n", F.col("o_orderkey"))
    o = _dealt(table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.concat(text, F.lit("Page 3 of 80\n\n"))).otherwise(text).alias("text")))
    path = shared_path(spark, "changed")
    sinks.write_changed(cleaning.clean_documents(o), path)
    return spark.read.parquet(path).select("o_orderkey", "text", "edits")


def due_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as programs that last ran on their day: which are to run again, and how far a batch has come."""
    o = table(spark, sf_dir, "orders")
    last = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate"))
    done = nm.overall_percent(F.col("o_orderkey") % 7, (F.col("o_orderkey") % 3) / 2.0, F.lit(8)).cast("bigint")
    return o.select("o_orderkey", nm.is_due(last, F.lit("1997-06-15 00:00:00").cast("timestamp")).alias("due"), done.alias("done"))


QUERIES = {
    "q53_clean_books": clean_books, "q54_folder_titles": folder_titles, "q55_running_headers": running_headers, "q56_store_records": store_records, "q57_cached_metadata": cached_metadata, "q58_themes": themes,
    "q59_prompts": prompts, "q60_renamed_projects": renamed_projects, "q61_best_store": best_store, "q62_channel_bag": channel_bag, "q63_srt_search": srt_search, "q64_srt_lenient": srt_lenient,
    "q65_ass_events": ass_events, "q66_ass_clips": ass_clips, "q67_rebuilt_lines": rebuilt_lines, "q68_media_listing": media_listing, "q69_index_widths": index_widths, "q70_index_renames": index_renames,
    "q71_portable_renames": portable_renames, "q72_refused_renames": refused_renames, "q73_free_names": free_names, "q74_wrappers": wrappers, "q75_first_files": first_files, "q76_durations_of_all": durations_of_all,
    "q77_inventories": inventories, "q78_result_totals": result_totals, "q79_new_inputs": new_inputs, "q80_two_columns": two_columns, "q81_scanned_pages": scanned_pages, "q82_page_choice": page_choice,
    "q83_line_kinds": line_kinds, "q84_scalars": scalars, "q85_chunk_manifest": chunk_manifest, "q86_combined": combined, "q87_html_page": html_page,
    "q88_side_notes": side_notes, "q89_cleaned_totals": cleaned_totals, "q90_rebuild_checks": rebuild_checks, "q91_sidecar_names": sidecar_names, "q92_normalised": normalised, "q93_literals": literals,
    "q94_bilingual": bilingual, "q95_decoded_texts": decoded_texts, "q96_paged_channels": paged_channels, "q97_written_chunks": written_chunks, "q98_run_log": run_log,
    "q99_duration_lines": duration_lines, "q100_long_media": long_media, "q101_theme_changes": theme_changes, "q102_project_list": project_list, "q103_combined_chunks": combined_chunks, "q104_retry_rounds": retry_rounds, "q105_due_updates": due_updates, "q106_line_ends": line_ends, "q108_resumed_rounds": resumed_rounds, "q109_replaced_store": replaced_store, "q110_written_changes": written_changes,
}

_K = "k as (select *, row_number() over (partition by o_custkey order by o_orderkey) as k, count(*) over (partition by o_custkey) as n from orders)"
_CUE = f"cue as (select user_id as doc_id, event_id as ord, (epoch_us(ts) // 1000) % {DAY} as start_ms, event_type || ' ' || event_id as text from events)"
_MEDIA = "m as (select p_partkey, p_brand as dir, p_size || ' - ' || p_name || ' & Co, ' || p_partkey || case p_partkey % 3 when 0 then '.mp4' when 1 then '.en.srt' else '.Mp3' end as name, p_partkey % 5 as size, p_size, p_name from part)"
_USEFUL = r"""length(regexp_replace(t, '\s+', '', 'g')) >= 20 and length(regexp_replace(t, '\P{L}+', '', 'g')) >= 10 and length(regexp_replace(t, '\P{L}+', '', 'g')) / length(regexp_replace(t, '\s+', '', 'g')) >= 0.25
          and (length(regexp_replace(t, '[^\p{C}]+', '', 'g')) - length(regexp_replace(t, '[^\n\r\t]+', '', 'g'))) / length(t) <= 0.02"""
ORACLES = {
    "q53_clean_books": f"""with {_K} select o_custkey, case when max(n) = 1 then '1. Of Orders And Parts' || chr(10) else '' end || string_agg('Order ' || o_orderkey || ' was sent, and nothing came back.', chr(10) || chr(10) order by k) || chr(10) as text,
        case when max(n) = 1 then 1 else 2 * max(n) end as edits, max(n) as blanks, true as changed from k group by 1""",
    "q54_folder_titles": """select n_regionkey as folder, n_nationkey as doc_id, 'The people of ' || n_name || ' live there, and all of them are well.' || chr(10) as text, 1::bigint as edits from nation""",
    "q55_running_headers": """select o_custkey as doc_id, lower('the ' || substr(o_orderpriority, 3) || ' chapter') as title_key, count(*) as n from orders group by 1, 2 having count(*) >= 2""",
    "q56_store_records": """select c_nationkey as store, case when c_custkey % 2 = 0 then c_custkey::varchar else 'k' || c_custkey end as video_id, c_name as title from customer""",
    "q57_cached_metadata": """select o_orderkey::varchar as video_id, case when fresh then o_orderpriority end as title, case when fresh then o_custkey::varchar end as view_count, null::varchar as secret
        from (select *, 3000 - o_orderkey <= 2500 and o_orderkey % 3 <> 0 as fresh from orders)""",
    "q58_themes": """with c as (select r_name as theme, n_name as url, n_nationkey, row_number() over (partition by r_name order by n_nationkey) - 1 as pos from nation join region on n_regionkey = r_regionkey)
        select theme, pos, url, 5000::bigint as min_views, 20200101 as after from c where n_nationkey % 3 <> 1""",
    "q59_prompts": """with p as (select case when c_custkey = 1 then 'FURNITURE x' when c_mktsegment = 'MACHINERY' then 'new' else c_mktsegment || ' x' end as project, c_custkey::varchar as id, case when c_custkey % 7 <> 0 then lower(c_name) else '' end as title, case when c_custkey = 1 then 'now' else 'u' end as updated_at from customer where c_custkey <> 2)
        select project, id, title, updated_at, row_number() over (partition by project order by case when title = '' then '(untitled)' else title end, id) as place from p""",
    "q60_renamed_projects": "select r_regionkey, case when r_name = 'ASIA' then 'Asia Minor' else r_name end as r_name from region",
    "q61_best_store": "select '/' || n_name as path, count(*) as prompts from customer join nation on c_nationkey = n_nationkey group by 1 having count(*) > 2 order by 2 desc, lower(path) desc limit 1",
    "q62_channel_bag": "select nation, count(*) as entries from (select c_nationkey as nation from customer union all select s_nationkey from supplier union all select s_nationkey from supplier) group by 1",
    "q63_srt_search": f"with {_CUE} select doc_id, row_number() over (partition by doc_id order by ord) - 1 as ord, start_ms, start_ms + 1000 as end_ms, text from cue",
    "q64_srt_lenient": f"with {_CUE} select doc_id, row_number() over (partition by doc_id order by start_ms, ord) as number, start_ms from cue",
    "q65_ass_events": f"""with {_CUE}, r as (select doc_id, (start_ms + 5) // 10 * 10 as start_ms, (start_ms + 1005) // 10 * 10 as end_ms, '0' as layer, 'Default' as style, text from cue), l as (select doc_id, max(start_ms) + 1000 as z from cue group by 1)
        select * from r union all select doc_id, (greatest(0, z - 60000) + 5) // 10 * 10, (z + 5) // 10 * 10, '10', 'ModelTop', 'used M' from l""",
    "q66_ass_clips": f"""with {_CUE}, r as (select doc_id, (start_ms + 5) // 10 * 10 as a, (start_ms + 1005) // 10 * 10 as b, text from cue)
        select doc_id, 0::bigint as seg_no, a as start_ms, text from r where a < {DAY} union all select doc_id, 1, greatest(a - {DAY // 2}, 0), text from r where b > {DAY // 2}""",
    "q67_rebuilt_lines": f"""with {_CUE}, r as (select *, row_number() over (partition by doc_id order by ord) as k, count(*) over (partition by doc_id) as n from cue)
        select doc_id, 'L' || lpad(k::varchar, 6, '0') as line_id, case when k < n then upper(text) end as translation from r""",
    "q68_media_listing": f"""with {_MEDIA} select dir, name, 'audio' as scan from m where p_partkey % 3 in (0, 2) union all select dir, name, 'media' from m where p_partkey % 3 in (0, 2)
        union all select dir, regexp_replace(name, '\\.en\\.srt$', ''), 'en' from m where p_partkey % 3 = 1""",
    "q69_index_widths": f"""with {_MEDIA}, w as (select greatest(2, max(length(p_size::varchar))) as width from m) select distinct p_size::bigint as index, lpad(p_size::varchar, greatest(width, length(p_size::varchar))::int, '0') as shown from m, w where p_partkey % 3 = 0 and size > 0""",
    "q70_index_renames": f"""with {_MEDIA} select dir, name as source, lpad(p_size::varchar, 4, '0') || substr(name, length(p_size::varchar) + 1) as destination, false as conflict from m""",
    "q71_portable_renames": f"""with {_MEDIA} select 'portable' as plan, dir, name as source, p_size || ' - ' || replace(p_name, ' ', '_') || '_Co_' || p_partkey || case p_partkey % 3 when 0 then '.mp4' when 1 then '.en.srt' else '.Mp3' end as destination, false as conflict from m
        union all select 'ascii', dir, name, p_size || ' ' || p_name || ' and Co ' || p_partkey || case p_partkey % 3 when 0 then '.mp4' when 1 then '.en.srt' else '.Mp3' end, false from m""",
    "q72_refused_renames": "select p_brand as dir, count(*) as renames from part group by 1",
    "q73_free_names": """with w as (select p_brand as dir, p_type as base, p_partkey as seq, row_number() over (partition by p_brand, p_type order by p_partkey) as k, max(p_size) over (partition by p_brand, p_type) > 45 as taken from part)
        select dir, seq, base || case when k = 1 then '' else '_' || (k + case when taken then 1 else 0 end) end || '.txt' as name from w""",
    "q74_wrappers": f"""with {_MEDIA}, b as (select *, regexp_replace(name, '(\\.mp4|\\.Mp3|\\.en\\.srt)$', '') as base from m) select f.base || '. #' as folder, a.name as artifact from b f join b a on f.base = a.base where f.p_partkey % 2 = 0""",
    "q75_first_files": f"""with {_MEDIA} select dir, regexp_replace(name, '\\.[^.]*$', '') as base, case when p_partkey % 3 = 0 then name end as name from m""",
    "q76_durations_of_all": """select count(*) as files, coalesce(sum(case when o_orderkey % 11 <> 0 then o_orderkey * 7 % 4000 end), 0)::bigint as seconds, count(*) filter (o_orderkey % 11 = 0) as unreadable, count(*) filter (o_orderkey % 11 <> 0 and o_orderkey * 7 % 4000 >= 1800) as long_files from orders""",
    "q77_inventories": f"""with {_K}, i as (select o_custkey as list_id, n, case when o_orderkey % 2 = 0 then o_orderkey % 50 else k end as i from k)
        select list_id, case when list_id % 2 = 0 then 99 else max(n) end::bigint as length, coalesce(array_to_string(list_sort(list_distinct(list(i) filter (i between 2 and 30))), ','), '') as indices, list_id % 3 = 0 as asked from i group by 1""",
    "q78_result_totals": """select count(*) filter (o_orderstatus not in ('F', 'O')) as completed, count(*) filter (o_orderstatus = 'O') as skipped, count(*) filter (o_orderstatus = 'F') as failed,
        (select string_agg(k::varchar, ',' order by k) from (select o_orderkey as k from orders where o_orderstatus = 'F' order by 1 limit 5)) as sample from orders""",
    "q79_new_inputs": f"with {_MEDIA} select dir || '/' || name as target from m where p_partkey % 3 in (0, 1) and p_partkey % 4 <> 0 and size = 0",
    "q80_two_columns": f"""with {_K}, t as (select o_custkey, k - 1 as i, n, 'Order ' || o_orderkey || ' went out on time.' as text from k)
        select o_custkey as page_id, string_agg(text, chr(10) order by case when n >= 6 then i % 2 else 1 - i % 2 end, i) as text from t group by 1""",
    "q81_scanned_pages": f"""with {_K}, t as (select o_custkey, k, 'Order ' || o_orderkey || ' is a line of its own.' as text from k),
        b as (select o_custkey, k > 5 as far, string_agg(text, ' ' order by k) as text from t group by all)
        select o_custkey as page_id, 'note' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) order by far) as text from b group by 1""",
    "q82_page_choice": f"""with d as (select doc_id, case when doc_id % 5 = 0 then 'x' else text end as t from documents), u as (select *, coalesce({_USEFUL}, false) as useful from d), o as (select *, not useful or doc_id % 7 = 0 as ocr_wanted from u)
        select doc_id, ocr_wanted, case when ocr_wanted and doc_id % 10 <> 0 then 'ocr' else 'direct' end as source, md5(case when ocr_wanted and doc_id % 10 <> 0 then 'read by OCR' else coalesce(t, '') end) as digest from o""",
    "q83_line_kinds": """with k as (select o_orderkey, o_orderkey % 5 as k from orders)
        select o_orderkey, k in (0, 1) as metadata, k = 1 as marker, k = 2 as number, case k when 0 then '### Source PDF: x.pdf' when 1 then '### page ' || o_orderkey when 2 then (o_orderkey % 99999)::varchar when 3 then '(so, it is)!' else '12 mins left in book 33%' end as clean,
          case k when 0 then '### Source PDF: x.pdf' when 1 then '### page ' || o_orderkey when 2 then (o_orderkey % 99999)::varchar when 3 then '( so , it is ) !' else '' end as quiet from k""",
    "q84_scalars": """with o as (select *, round_even(o_orderkey + 0.5, 0)::bigint as s from orders)
        select o_orderkey, case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y%m%d')::int when o_orderkey % 3 = 0 then 19700102 else 0 end as published, case when o_orderkey > 100 then o_orderkey - 100 end as positive,
          case when o_orderkey % 2 = 1 then o_orderpriority end as given, floor(least(1.0::double, o_orderkey::double / 2000.0::double) * 100)::bigint as done, case when o_orderkey % 30 > 10 then 'b' else 'a' end as thumbnail, 'used M on ' as banner,
          'the order of ' || o_orderpriority || ' came in time' || case when length(o_orderpriority) <= 7 then ' and went' || chr(10) || 'out' when length(o_orderpriority) <= 12 then ' and' || chr(10) || 'went out' else chr(10) || 'and went out' end || ' again on a day' as wrapped,
          greatest(0, 1e5::double - o_totalprice) as span, case when s >= 3600 then format('{}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60) else format('{}:{:02d}', s // 60, s % 60) end as clock from o""",
    "q85_chunk_manifest": f"""with c as ({documents.ORACLES["q14_chunk_pack"]})
        select doc_id, count(*) as files, doc_id || case when count(*) = 1 then '.txt' else '_chunk_001.txt' end as first_file, sum(tokens)::bigint as tokens from c group by 1""",
    "q86_combined": "select 'all' as doc_id, string_agg('### Source image: ' || n_name || chr(10) || chr(10) || 'text of ' || n_name, chr(10) || chr(10) order by regexp_extract(n_name, '\\d+')::int) as text from nation",
    "q87_html_page": """select '<table><tr><th>rank</th><th>title</th></tr>' || chr(10) || (select string_agg('<tr><td>' || (r_regionkey + 1) || '</td><td>&lt;' || r_name || '&gt;</td></tr>', chr(10) order by r_regionkey) from region)
        || chr(10) || '</table>' || chr(10) || '<table><tr><th>n_regionkey</th><th>n</th></tr>' || chr(10) || (select string_agg('<tr><td>' || k || '</td><td>' || n || '</td></tr>', chr(10) order by k) from (select n_regionkey as k, count(*) as n from nation group by 1)) || chr(10) || '</table>' || chr(10) as html""",
    "q88_side_notes": """select o_orderkey, case o_orderkey % 4 when 0 then 'We saw order ' || o_orderkey || ' of the old town and left.' || chr(10) || 'TOWN HALL opposite The square and its trees' || chr(10) || 'Then it rained.'
        when 1 then 'They saw order ' || o_orderkey || ' come.' || chr(10) || 'The great river bridge was built by many hands over years.' || chr(10) || 'overleaf GREAT RIVER BRIDGE The bridge of order ' || o_orderkey || ' was built by many hands' || chr(10) || 'It stands still.'
        when 2 then 'We saw order ' || o_orderkey || ' of the old town and left.' || chr(10) || 'the old TOWN HALL opposite The square' || chr(10) || 'Then it rained.'
        else 'We saw order ' || o_orderkey || ' opposite the old town.' || chr(10) || 'The square lies below it.' end || chr(10) as text from orders""",
    "q89_cleaned_totals": "select count(*) as scanned, count(*) filter (o_orderkey % 3 = 0) as changed, count(*) filter (o_orderkey % 3 = 0) as edits, count(*) filter (o_orderkey % 3 = 0) as blanks from orders",
    "q90_rebuild_checks": """with o as (select o_custkey as id, min(o_orderkey) as seq from orders group by 1), b as (select id, row_number() over (order by id) as e, row_number() over (order by seq, id) as f from o join customer on id = c_custkey),
        m as (select (select count(*) from customer where c_custkey not in (select id from o)) as missing, (select count(*) from o where id not in (select c_custkey from customer)) as unexpected)
        select (select count(*) from b) as ok, missing, unexpected, 0::bigint as duplicate, 0::bigint as empty, missing + unexpected = 0 as allowed, (select count(*) from b where e <> f) as moved from m""",
    "q91_sidecar_names": f"""with {_MEDIA} select p_partkey, regexp_replace(name, '\\.mp4$', '') || '_part1' || case when p_partkey % 2 = 0 then '.fr.srt' else '.subtitle2.ass' end as sidecar, (select max(n_nationkey) + 1 from nation)::bigint as next from m where p_partkey % 3 = 0 and p_partkey % 2 = 1""",
    "q92_normalised": "select o_orderkey, lpad(o_orderkey::varchar, 11, 'v') as video_id, o_orderpriority as title from orders where o_orderkey % 3 <> 2",
    "q93_literals": """select o_orderkey, 'a  b ' || o_orderkey as text, (1 + (o_orderkey % 2 = 0)::int)::bigint as removed, o_orderpriority as prompt,
        format('{:02d}:{:02d}:{:02d},{:03d}', o_orderkey * 250 // 3600000, o_orderkey * 250 // 60000 % 60, o_orderkey * 250 // 1000 % 60, o_orderkey * 250 % 1000) as stamp, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') as moment from orders""",
    "q94_bilingual": f"""with {_CUE} select doc_id, (start_ms + 5) // 10 * 10 as start_ms, text || case when ord % 2 = 0 then '\\N{{\\fs63\\bord6\\c&H00D5FF&\\3c&H000000&}}' || upper(text) || '{{\\r}}' else '' end as text from cue""",
    "q95_decoded_texts": "select c_custkey, c_name || ' é ü' as text, case when c_custkey % 2 = 0 then 'utf-8' else 'cp1252' end as encoding, case when c_custkey % 2 = 0 then c_name || ' é ü' end as strict from customer",
    "q96_paged_channels": """with v as (select *, 'U' || o_custkey as u from orders union all select *, 'UA' from orders)
        select 'v' || o_orderkey as video_id, 'Video ' || o_orderkey as title, o_orderkey as view_count, 'Channel ' || u as channel, format('{}:{:02d}', o_orderkey % 3000 // 60, o_orderkey % 60) as duration,
          strftime(o_orderdate, '%Y%m%d')::int as published_sort_value, row_number() over (partition by u order by o_orderkey) - 1 as source_order from v where o_orderkey % 5 <> 0""",
    "q97_written_chunks": """select n_nationkey as doc_id, c as chunk, case c when 1 then n_name || ' is a land of its own, they say.' else 'All of it is far. None of it is small.' end as text from nation, (select unnest([1, 2]) as c)""",
    "q98_run_log": "select run, o_orderpriority as message, count(*) as n from orders, (select unnest(['r1', 'r2']) as run) where o_orderkey % 3 = 2 group by all",
    "q99_duration_lines": """with m as (select o_custkey as dir, o_orderkey as k, case when o_orderkey % 11 <> 0 then o_orderkey * 7 % 4000 end as s from orders), c as (select dir, coalesce(sum(s), 0)::bigint as t, count(*) as n,
          string_agg(case when s is null then '?' when s >= 3600 then format('{}:{:02d}:{:02d}', s // 3600, s // 60 % 60, s % 60) else format('{}:{:02d}', s // 60, s % 60) end || ' | f' || k, chr(10) order by k) as lines from m group by 1)
        select dir, 'Durations' || chr(10) || lines || chr(10) || n || ' files, ' || case when t >= 3600 then format('{}:{:02d}:{:02d}', t // 3600, t // 60 % 60, t % 60) else format('{}:{:02d}', t // 60, t % 60) end || chr(10) as text from c""",
    "q100_long_media": "select o_orderkey, (o_orderkey * 7 % 4000)::double as seconds from orders where o_orderkey % 11 <> 0 and o_orderkey * 7 % 4000 >= 1800",
    "q101_theme_changes": """select r_name as theme, '{"name":"' || r_name || '","min_views":"5k","channels":[' || string_agg('{"url":"' || n_name || '","enabled":' || case when (n_nationkey % 2 = 0) <> (n_nationkey in (3, 4)) then 'true' else 'false' end || '}', ',' order by n_nationkey) || ']}' as text
        from nation join region on n_regionkey = r_regionkey group by r_name union all select 'Atlantis', '{"name":"Atlantis","min_views":"5k","channels":[]}'""",
    "q102_project_list": """with p as (select distinct case when c_mktsegment = 'BUILDING' then 'building' else c_mktsegment end as project from customer union all select 'Garden')
        select project, row_number() over (order by lower(project), project) as place from p where project <> 'MACHINERY'""",
    "q103_combined_chunks": f"""with read as (select *, doc_id % 7 <> 3 and text is not null as readable from documents), d as (select row_number() over (order by doc_id, text) as k, '### Source image: page ' || doc_id as head, trim(text) as body from read where readable),
        p as (select 2 * k as n, head as t from d union all select 2 * k + 1, body from d where body <> ''), e as (select *, regexp_matches(rtrim(t), '{documents.ENDS}')::int as closes from p),
        o as (select *, coalesce(sum(closes) over (order by n rows between unbounded preceding and 1 preceding), 0) as open, sum(closes) over () as total from e),
        k as (select case when open = total and total > 0 then open - 1 else open end as doc_id, string_agg(t, chr(10) || chr(10) order by n) as text from o group by 1),
        {documents.SPLIT.replace("SOURCE", "k")}, z as (select doc_id as block, unnest(generate_series(1, len(blocks))) as piece, unnest(blocks) as text from c),
        r as (select list_reduce(list_transform(list(length(text) order by block, piece), lambda x: {{'size': x, 'no': 0, 'nos': [0]}}),
          lambda a, b: case when a.size + 2 + b.size <= {documents.BUDGET} then {{'size': a.size + 2 + b.size, 'no': a.no, 'nos': list_append(a.nos, a.no)}} else {{'size': b.size, 'no': a.no + 1, 'nos': list_append(a.nos, a.no + 1)}} end).nos as nos from z),
        m as (select *, row_number() over (order by block, piece) as place from z)
        select 'all' as doc_id, nos[place]::bigint as chunk_no, string_agg(text, chr(10) || chr(10) order by place) as text, null as error from m, r group by 2
        union all select 'page ' || doc_id, -1, '', 'it could not be read' from read where not readable""",
    "q104_retry_rounds": "select o_orderkey, case when o_orderkey % 5 > 2 then 'not yet' end as error, least(o_orderkey % 5, 2) as round from orders",
    "q105_due_updates": """select o_orderkey, o_orderkey % 4 = 0 or epoch(timestamp '1997-06-15') - epoch(o_orderdate) >= 86400 as due, floor(least(1.0::double, (o_orderkey % 7 + least(1.0::double, o_orderkey % 3 / 2.0::double)) / 8) * 100)::bigint as done from orders""",
    "q108_resumed_rounds": "select o_orderkey, case when o_orderkey % 5 > 2 then 'not yet' end as error, least(o_orderkey % 5, 2) + 1 as asked, least(o_orderkey % 5, 2) as round from orders",
    "q109_replaced_store": "select c_custkey::varchar as video_id, c_name as title, (select count(*) from customer where c_custkey % 3 = 0) as before from customer",
    "q110_written_changes": "select o_orderkey, 'Order ' || o_orderkey || ' is here.' || chr(10) as text, 1::bigint as edits from orders where o_orderkey % 3 = 0",
    "q106_line_ends": """with o as (select o_orderkey, [chr(10), chr(13) || chr(10), chr(13), chr(133)][o_orderkey % 4 + 1] as e from orders)
        select o_orderkey, hex(encode(case when o_orderkey % 3 = 0 then 'Order ' || o_orderkey || ' went out at last.' else 'Order ' || o_orderkey || ' went out.' end || e || 'All is well.' || e)) as text,
          case when o_orderkey % 3 = 0 then 4 else 0 end::bigint as edits, o_orderkey % 3 = 0 as changed from o""",
}
