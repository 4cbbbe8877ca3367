"""Record stores, prompts, themes: landed JSON as tables, and changes as new tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.functions.numbers import optional_boolean
from lumenrow.functions.patterns import nullif_empty, squeeze, strip
from lumenrow.functions.text import casefold
from lumenrow.functions.urls import entry_video_id, video_id

RECORD = "map<string,string>"


def records_of(stores: DataFrame) -> DataFrame:
    """(store, video_id, record) of store texts (store, text) in any of three shapes.

    ``{"videos": {id: record}}``, ``{id: record}`` or ``[record]``. The id is the record's, else the
    key, else what its address names; records without one go. A text that is no such JSON gives no
    rows; of repeated ids the last counts.
    """
    wrapped = F.from_json("text", f"struct<videos:map<string,{RECORD}>>")["videos"]
    bare = F.from_json("text", f"map<string,{RECORD}>")
    listed = F.from_json("text", f"array<{RECORD}>")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("record"))
    by_key = lambda m: F.transform(F.map_entries(m), lambda e: entry(e["key"], e["value"]))
    from_list = F.transform(listed, lambda r: entry(F.lit(None).cast("string"), r))
    is_list = strip(F.col("text")).startswith("[")
    rows = stores.withColumn("_all", F.when(is_list, from_list).otherwise(F.coalesce(by_key(wrapped), by_key(bare))))
    rows = rows.select("store", F.posexplode("_all").alias("seq", "e"))
    value = lambda k: nullif_empty(strip(F.try_element_at("e.record", F.lit(k))))
    key = F.coalesce(value("video_id"), value("id"), F.col("e.key"), nullif_empty(video_id(F.coalesce(value("url"), F.lit("")))))
    rows = rows.select("store", "seq", key.alias("video_id"), F.col("e.record").alias("record")).filter("video_id is not null and record is not null")
    return last_wins(rows, ["store", "video_id"], "seq").drop("seq")


def last_wins(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of each key the row of the highest ``seq``; the aggregate combines before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return latest.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest)).select(*rows.columns)


def upsert(store: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The store with changed rows in place of those of their keys."""
    return store.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def normalised_record(entries: DataFrame) -> DataFrame:
    """Trimmed records with an id from the entry or its address; entries without an id go."""
    t = lambda c: strip(F.coalesce(F.col(c), F.lit("")))
    key = nullif_empty(entry_video_id(t("id"), t("url")))
    return entries.withColumn("video_id", key).filter("video_id is not null").withColumn("title", t("title")).withColumn("url", t("url"))


def cache_of(texts: DataFrame) -> DataFrame:
    """(video_id, fetched_at, metadata) of cache texts; other shapes give no rows."""
    cache = F.from_json("text", f"struct<videos:map<string,struct<fetched_at:double,metadata:{RECORD}>>>")["videos"]
    rows = texts.select(F.explode(cache).alias("video_id", "v"))
    return rows.select("video_id", "v.fetched_at", "v.metadata").filter("metadata is not null")


def themes_of(texts: DataFrame) -> DataFrame:
    """(theme, min_views, published_after, published_before, channels) of configuration texts.

    Themes are a list or an object by name; channels are addresses or objects; old key names count.
    """
    theme = "struct<name:string,theme:string,min_views:string,published_after:string,date_after:string,uploaded_after:string,published_before:string,date_before:string,uploaded_before:string,channels:array<string>>"
    listed = F.from_json(F.get_json_object("text", "$.themes"), f"array<{theme}>")
    named = F.from_json(F.get_json_object("text", "$.themes"), f"map<string,{theme}>")
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("t"))
    is_list = F.get_json_object("text", "$.themes").startswith("[")
    all_themes = F.when(is_list, F.transform(listed, lambda t: entry(F.lit(None).cast("string"), t))).otherwise(F.transform(F.map_entries(named), lambda e: entry(e["key"], e["value"])))
    rows = texts.select(F.explode(all_themes).alias("e"))
    channel = lambda c: F.struct(
        F.when(c.startswith("{"), F.get_json_object(c, "$.url")).otherwise(c).alias("url"),
        F.when(c.startswith("{"), optional_boolean(F.get_json_object(c, "$.enabled"))).otherwise(F.lit(True)).alias("enabled"),
    )
    t = F.col("e.t")
    return rows.select(
        F.coalesce(t["name"], t["theme"], F.col("e.key")).alias("theme"),
        t["min_views"].alias("min_views"),
        F.coalesce(t["published_after"], t["date_after"], t["uploaded_after"]).alias("published_after"),
        F.coalesce(t["published_before"], t["date_before"], t["uploaded_before"]).alias("published_before"),
        F.transform(F.coalesce(t["channels"], F.array().cast("array<string>")), channel).alias("channels"),
    )


def enabled_channels(themes: DataFrame) -> DataFrame:
    """(theme, pos, url) of enabled channels, in order."""
    return themes.select("theme", F.posexplode("channels").alias("pos", "c")).filter("c.enabled").select("theme", "pos", "c.url")


def unique_names(rows: DataFrame, name: str) -> DataFrame:
    """The rows, if no name repeats or is empty; else the query fails."""
    n = F.count("*").over(Window.partitionBy(name))
    bad = (n > 1) | (F.coalesce(strip(F.col(name)), F.lit("")) == "")
    return rows.withColumn(name, F.when(bad, F.raise_error(F.lit("names must be unique and not empty"))).otherwise(F.col(name)))


def renamed(rows: DataFrame, name: str, old: str, new: str) -> DataFrame:
    return unique_names(rows.withColumn(name, F.when(F.col(name) == old, F.lit(new)).otherwise(F.col(name))), name)


def removed(rows: DataFrame, name: str, value: str) -> DataFrame:
    return rows.filter(~F.col(name).eqNullSafe(F.lit(value)))


def added(rows: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """The rows and the new ones; names stay unique and not empty, or the query fails."""
    return unique_names(rows.unionByName(new), name)


def toggled(themes: DataFrame, urls: tuple[str, ...]) -> DataFrame:
    """Themes whose channels of these addresses are switched, on or off."""
    switch = lambda c: F.struct(c["url"].alias("url"), F.when(c["url"].isin(*urls), ~c["enabled"]).otherwise(c["enabled"]).alias("enabled"))
    return themes.withColumn("channels", F.transform("channels", switch))


def themes_json(themes: DataFrame) -> DataFrame:
    """(theme, text): each theme as the JSON that a configuration holds; settings that are null are left out."""
    settings = ["min_views", "published_after", "published_before"]
    return themes.select("theme", F.to_json(F.struct(F.col("theme").alias("name"), *settings, "channels")).alias("text"))


def name_order(name: str) -> list[Column]:
    """By a name without case, then by the name."""
    return [casefold(F.col(name)), F.asc(name)]


def prompts_of(texts: DataFrame) -> DataFrame:
    """(project, id, title, content, created_at, updated_at) of prompt stores; names squeezed, missing ids made."""
    prompt = "struct<id:string,title:string,content:string,created_at:string,updated_at:string>"
    rows = texts.select(F.explode(F.from_json("text", f"struct<projects:map<string,array<{prompt}>>>")["projects"]).alias("project", "prompts"))
    rows = rows.select(squeeze(F.col("project")).alias("project"), F.explode("prompts").alias("p")).filter("p is not null")
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return rows.select("project", F.coalesce(nullif_empty(F.col("p.id")), F.uuid()).alias("id"), F.coalesce("p.title", F.lit("")).alias("title"), F.coalesce("p.content", F.lit("")).alias("content"), F.coalesce(nullif_empty(F.col("p.created_at")), now).alias("created_at"), F.coalesce(nullif_empty(F.col("p.updated_at")), now).alias("updated_at"))


def prompt_order() -> list[Column]:
    """By title without case, untitled as such, then raw title, creation and id."""
    title = F.when(strip(F.col("title")) == "", F.lit("(untitled)")).otherwise(F.col("title"))
    return [casefold(title), title, F.col("created_at"), F.col("id")]


def moved(prompts: DataFrame, prompt_id: str, project: str, now: str) -> DataFrame:
    """A prompt in another project: id and creation stay."""
    mine = F.col("id") == prompt_id
    return prompts.withColumn("project", F.when(mine, F.lit(project)).otherwise(F.col("project"))).withColumn("updated_at", F.when(mine, F.lit(now)).otherwise(F.col("updated_at")))


def best_store(stores: DataFrame, current: int) -> DataFrame:
    """The store of most prompts, then of the greatest lower-cased path, if it has more than the current one."""
    n = stores.groupBy("path").agg(F.count("*").alias("prompts"))
    return n.filter(F.col("prompts") > current).orderBy(F.desc("prompts"), F.desc(F.lower("path"))).limit(1)


def union_all(*frames: DataFrame) -> DataFrame:
    """A bag union: repeated rows stay."""
    return reduce(DataFrame.unionByName, frames)
