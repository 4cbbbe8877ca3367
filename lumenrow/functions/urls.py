"""Video and channel addresses, and nested metadata, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrow.functions.patterns import nullif_empty, strip

#: The form of a video id, and where thumbnails are looked for first.
VIDEO_ID = "[A-Za-z0-9_-]{11}"
THUMBNAILS = ("maxres", "standard", "high", "medium", "default")
WATCH = "https://www.youtube.com/watch?v="


def _whole_id(value: Column) -> Column:
    return F.when(value.rlike(rf"\A{VIDEO_ID}\z"), value)


def video_id(url: Column) -> Column:
    """The video an address names: short link, ``v=``, shorts, embed or live; else any lone 11-character token; else empty."""
    host = F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)
    short = F.when(host.endswith("youtu.be"), _whole_id(F.regexp_extract(path, r"\A/*([^/]*)", 1)))
    watch = _whole_id(F.regexp_extract(query, r"(?:\A|&)v=([^&]*)", 1))
    marked = reduce(lambda a, b: F.coalesce(a, b), (_whole_id(F.regexp_extract(path, rf"(?:\A|/){m}/+([^/]+)", 1)) for m in ("shorts", "embed", "live")))
    on_site = F.when(host.contains("youtube.com"), F.coalesce(watch, marked))
    lone = nullif_empty(F.regexp_extract(url, rf"(?<![A-Za-z0-9_-])({VIDEO_ID})(?![A-Za-z0-9_-])", 1))
    return F.coalesce(short, on_site, lone, F.lit(""))


def entry_video_id(raw_id: Column, url: Column) -> Column:
    return F.coalesce(_whole_id(raw_id), video_id(url))


def watch_url(url: Column) -> Column:
    """The watch address of a video address; anything else, trimmed."""
    text = strip(F.coalesce(url, F.lit("")))
    forms = (rf"youtube\.com/watch\?[^\s#]*?v=({VIDEO_ID})", rf"youtu\.be/({VIDEO_ID})", rf"youtube\.com/shorts/({VIDEO_ID})", rf"youtube\.com/embed/({VIDEO_ID})")
    found = F.coalesce(*(nullif_empty(F.regexp_extract(text, form, 1)) for form in forms))
    return F.coalesce(F.concat(F.lit(WATCH), found), text)


def channel_lookup(url: Column) -> Column:
    """A struct (parameter, value) that looks a channel up; null for an address without a path."""
    path = F.regexp_extract(url, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    pair = lambda k, v: F.struct(F.lit(k).alias("parameter"), v.alias("value"))
    return (
        F.when(first.isNull(), F.lit(None))
        .when((first == "channel") & second.isNotNull(), pair("id", second))
        .when((first == "user") & second.isNotNull(), pair("forUsername", second))
        .otherwise(pair("forHandle", F.when(first.startswith("@"), first).otherwise(F.concat(F.lit("@"), first))))
    )


def api_thumbnail(thumbnails: Column) -> Column:
    """The address of the best named thumbnail of a map of structs; empty if there is none."""
    return F.coalesce(*(nullif_empty(F.try_element_at(thumbnails, F.lit(name))["url"]) for name in THUMBNAILS), F.lit(""))


def largest_thumbnail(thumbnails: Column) -> Column:
    """The address of the first of the largest thumbnails, by area, of an array of structs."""
    area = lambda t: F.coalesce(t["width"], F.lit(0)).cast("bigint") * F.coalesce(t["height"], F.lit(0))
    named = F.filter(thumbnails, lambda t: F.coalesce(t["url"], F.lit("")) != "")
    ranked = F.transform(named, lambda t, i: F.struct((-area(t)).alias("a"), i.alias("i"), t["url"].alias("url")))
    return F.coalesce(F.get(F.array_sort(ranked), F.lit(0))["url"], F.lit(""))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"\A[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
