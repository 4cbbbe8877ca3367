"""Numbers, counts, durations, dates and geometry as column expressions.

Input that does not parse gives null, where the desktop semantics raise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenrow.functions.patterns import extract, full_match, nullif_empty, once, strip

#: Multipliers of count suffixes.
COUNT_UNITS = {"": 1.0, "k": 1e3, "m": 1e6, "b": 1e9}


def parse_count(value: Column) -> Column:
    """``50k``, ``1.2m``, ``1,234 views`` or ``3_000`` as a bigint, truncated; null where it is none."""
    bare = F.regexp_replace(F.lower(strip(value.cast("string"))), "[,_]", "")
    body = r"([0-9]+(?:\.[0-9]+)?)\s*([kmb]?)"

    def scale(unit: Column) -> Column:
        found = F.lit(None).cast("double")
        for name, factor in COUNT_UNITS.items():
            found = F.when(unit == name, F.lit(factor)).otherwise(found)
        return found

    def counted(text: Column) -> Column:
        number = nullif_empty(extract(text, rf"\A{body}\z", 1)).try_cast("double")
        return F.when(full_match(text, body), (number * once(extract(text, rf"\A{body}\z", 2), scale)).cast("bigint"))

    return once(strip(F.regexp_replace(bare, r"views\z", "")), counted)


def format_count(value: Column) -> Column:
    return F.format_number(value, 0)


def optional_text(value: Column) -> Column:
    """Trimmed text; null for empty text and the words none, null and false."""
    text = strip(value.cast("string"))
    return F.when((text != "") & ~F.lower(text).isin("none", "null", "false"), text)


def optional_positive(value: Column) -> Column:
    number = strip(value.cast("string")).try_cast("bigint")
    return F.when(number > 0, number)


def optional_boolean(value: Column, default: bool = True) -> Column:
    text = F.lower(strip(value.cast("string")))
    return F.when(text.isin("1", "true", "yes", "y", "on", "enabled"), F.lit(True)).when(text.isin("0", "false", "no", "n", "off", "disabled"), F.lit(False)).otherwise(F.lit(default))


def clock(seconds: Column) -> Column:
    """``h:mm:ss``, or ``m:ss`` below an hour, of whole seconds."""
    s = seconds.cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(hours > 0, F.format_string("%d:%02d:%02d", hours, minutes, rest)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), rest))


def compact_clock(seconds: Column) -> Column:
    """:func:`clock` of seconds rounded half to even."""
    return clock(F.bround(seconds.cast("double"), 0).cast("bigint"))


def spoken_seconds(seconds: Column) -> Column:
    """``1h 02m 03s``, ``2m 03s`` or ``3s``; ``?`` for null."""
    s = seconds.cast("bigint")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    text = F.when(hours > 0, F.format_string("%dh %02dm %02ds", hours, minutes, rest)).when(s >= 60, F.format_string("%dm %02ds", minutes, rest)).otherwise(F.format_string("%ds", rest))
    return F.coalesce(text, F.lit("?"))


def format_bytes(size: Column) -> Column:
    """Binary units to one decimal, halves to even; ``?`` for null and 0."""
    n = size.cast("double")
    text = F.format_string("%.1f TiB", F.bround(n / 1024.0**4, 1))
    for power, unit in reversed(list(enumerate(("B", "KiB", "MiB", "GiB")))):
        text = F.when(n / 1024.0**power < 1024, F.format_string(f"%.1f {unit}", F.bround(n / 1024.0**power, 1))).otherwise(text)
    return F.when(n.isNull() | (n == 0), F.lit("?")).otherwise(text)


def parse_duration(value: Column) -> Column:
    """Seconds of ``m:ss``, ``h:mm:ss``, plain seconds, or ``1h2m3s``; null where it is none of them."""
    raw = F.lower(strip(value))
    number = lambda body, group: F.coalesce(nullif_empty(extract(raw, body, group)).try_cast("bigint"), F.lit(0).cast("bigint"))
    three, two = r"\A(\d+):(\d{1,2}):(\d{1,2})\z", r"\A(\d+):(\d{1,2})\z"
    units = r"\A(?:(\d+)h)?\s*(?:(\d+)m)?\s*(?:(\d+)s?)?\z"
    by_units = number(units, 1) * 3600 + number(units, 2) * 60 + number(units, 3)
    return (
        F.when(raw == "", F.lit(None).cast("bigint"))
        .when(raw.rlike(three), number(three, 1) * 3600 + number(three, 2) * 60 + number(three, 3))
        .when(raw.rlike(two), number(two, 1) * 60 + number(two, 2))
        .when(raw.rlike(r"\A[0-9]+\z"), raw.try_cast("bigint"))
        .when(raw.rlike(units), by_units)
    )


def parse_cut_point(value: Column) -> Column:
    """Seconds of a cut point, where a plain number counts minutes."""
    raw = F.lower(strip(value))
    return F.when(raw.rlike(r"\A\d+(\.\d+)?\z"), raw.try_cast("double") * 60).otherwise(parse_duration(value).cast("double"))


def iso_duration(value: Column) -> Column:
    """The clock of an ISO-8601 duration of days to seconds; empty where it is none."""
    body = r"\AP(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?\z"

    def shown(text: Column) -> Column:
        total = F.lit(0).cast("bigint")
        for group, scale in ((1, 86400), (2, 3600), (3, 60), (4, 1)):
            total = total + F.coalesce(once(F.regexp_extract(text, body, group), nullif_empty).try_cast("bigint"), F.lit(0).cast("bigint")) * scale
        return F.when(text.rlike(body), once(total, clock)).otherwise(F.lit(""))

    return once(value, shown)


def srt_to_ms(stamp: Column) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm``, or with a point; null where it is none."""
    body = r"\A\s*(\d+):(\d+):(\d+)[,.](\d+)\s*\z"
    part = lambda g: F.regexp_extract(stamp, body, g).try_cast("bigint")
    return (part(1) * 3600 + part(2) * 60 + part(3)) * 1000 + part(4)


def ms_to_srt(ms: Column) -> Column:
    """``HH:MM:SS,mmm``; negative times are zero and hours may pass 99."""
    t = F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint"))
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, t % 1000)


def seconds_to_srt(seconds: Column) -> Column:
    return ms_to_srt(F.bround(seconds * 1000, 0).cast("bigint"))


def ass_to_ms(stamp: Column) -> Column:
    """Milliseconds of ``H:MM:SS.f`` with one to three decimals."""
    body = r"\A\s*(\d+):(\d{1,2}):(\d{1,2})[.](\d{1,3})\s*\z"
    part = lambda g: F.regexp_extract(stamp, body, g)
    return (part(1).try_cast("bigint") * 3600 + part(2).try_cast("bigint") * 60 + part(3).try_cast("bigint")) * 1000 + F.rpad(part(4), 3, "0").try_cast("bigint")


def ms_to_ass(ms: Column) -> Column:
    """``H:MM:SS.cc``, to the nearest hundredth, halves up."""
    c = F.floor((F.greatest(ms.cast("bigint"), F.lit(0).cast("bigint")) + 5) / 10)
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360_000), F.floor(c / 6000) % 60, F.floor(c / 100) % 60, c % 100)


def date_limit(value: Column) -> Column:
    """YYYYMMDD as an int of ``Y-M-D`` or ``YYYYMMDD``; null where it is none."""
    text = optional_text(value)
    day = F.when(text.rlike(r"\A\d{4}-\d{1,2}-\d{1,2}\z"), F.try_to_date(text, "y-M-d")).when(text.rlike(r"\A\d{8}\z"), F.try_to_date(text, "yyyyMMdd"))
    return F.date_format(day, "yyyyMMdd").cast("int")


def format_date_limit(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.rlike(r"\A\d{8}\z"), F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)))


def date_in_range(value: Column, after: int | None, before: int | None, unknown_matches: bool = False) -> Column:
    """Inclusive bounds on YYYYMMDD ints; 0 is unknown. Without bounds all pass."""
    if after is None and before is None:
        return F.lit(True)
    inside = F.lit(True)
    if after is not None:
        inside = inside & (value >= after)
    if before is not None:
        inside = inside & (value <= before)
    return F.when(F.coalesce(value, F.lit(0)) == 0, F.lit(unknown_matches)).otherwise(inside)


def published_value(upload_date: Column, epoch: Column) -> Column:
    """YYYYMMDD of an eight-digit date, else of epoch seconds in the session's zone, else 0."""
    by_epoch = F.date_format(F.timestamp_seconds(epoch), "yyyyMMdd").cast("int")
    return F.coalesce(F.when(upload_date.rlike(r"\A\d{8}\z"), upload_date.try_cast("int")), by_epoch, F.lit(0))


def span(low: Column, high: Column) -> Column:
    """A width or height, never negative."""
    return F.greatest(F.lit(0.0), high - low)


def middle(low: Column, high: Column) -> Column:
    return (low + high) / 2


def middle_ms(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2)


def padded_index(index: Column, width: Column) -> Column:
    """An index zero-padded to at least two digits."""
    text = index.cast("string")
    return F.lpad(text, F.greatest(width, F.lit(2), F.length(text)), F.lit("0"))


def index_list(indices: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(indices)), ",")


def percent(done: Column, total: Column) -> Column:
    """A clamped whole percentage."""
    return F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total)) * 100).cast("int")


def overall_percent(done_files: Column, fraction: Column, files: Column) -> Column:
    """A clamped whole percentage of several files, one of them at a fraction."""
    return percent(done_files + F.least(F.lit(1.0), F.greatest(F.lit(0.0), fraction)), F.greatest(files, F.lit(1)))


def is_due(last: Column, now: Column, hours: float = 24) -> Column:
    """Whether something that last ran at a time, or never, is to run again."""
    return last.isNull() | (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last.cast("timestamp")) >= hours * 3600)


def iso_utc(moment: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
