"""Features of sales as they were known at a time, from cumulative change logs.

What a window counts of a client at a time t came in at some instant and goes out at another, so a count
is what has come in by t less what has gone out by t. Clicks, sales and lines become rows of change logs
(client, log, at) with sums: one log of entries, one of expiries for each window, the latest click as a
running maximum, and the instants of sales for the label. Distinct items are the union of the spans in
which lines of the item count, as disjoint spans. Rows of one instant are summed before they are moved.

Logs of clients with many rows are cut into slices of time; what earlier slices left is an opening row of
each later one (for the label, the next sale is a closing row), so slices need nothing of each other.
Slices are dealt to buckets of bounded size, in which pandas' merge_asof finds each sale's place in each
log, for all clients of the bucket at once, and the features meet again by sale.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.llm.common import hot_keys, join_hot, table, written

DAY = 86_400_000_000
DAYS, HORIZON_DAYS, DELAY_MINUTES, SPREAD_SECONDS = (2, 14), 7, 240, 259_200
#: Clients of more rows than SLICE_ROWS are cut into slices of about so many; a bucket holds slices of about BUCKET_ROWS rows of logs.
SLICE_ROWS, BUCKET_ROWS = 16_384, 40_000
#: Slices that are carried forward in one task; runs of so many are then carried among themselves.
RUN = 256
#: Amounts of so much and more, and those that are no number, count as none.
MOST_AMOUNT = 1e13

#: The logs. The expiries of window k are in CLICK_OUT + k and SALE_OUT + k.
CLICK_IN, SALE_IN, SOLD, CLICK_OUT, SALE_OUT = 0, 1, 2, 100, 200
#: The sums of the logs of clicks and of sales; those of sales go on with one for each window in entries, and one in expiries: its items.
CLICK_SUMS, SALE_SUMS = ("n_clicks", "n_purchases", "click_cents"), ("n_sales", "sale_cents", "n_lines", "line_cents")


def micros(frame: DataFrame, name: str) -> Column:
    """The instant of a time, one without a zone being UTC, in microseconds of the epoch, whatever the session's zone."""
    at = F.col(name)
    if dict(frame.dtypes)[name] != "timestamp_ntz":
        return F.unix_micros(at)
    seconds = F.unix_date(at.cast("date")).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.expr(f"extract(second from `{name}`)") * 1_000_000).cast("long")


def cents(amount: Column) -> Column:
    """floor(100 x + 0.5), 0 for null, what is no number and MOST_AMOUNT or more."""
    return F.when(F.abs(amount) < MOST_AMOUNT, F.floor(amount * 100 + 0.5)).otherwise(0).cast("long")


def known_sales(sales: DataFrame, delay_minutes: int = DELAY_MINUTES, spread_seconds: int = SPREAD_SECONDS) -> DataFrame:
    """(sale_id, client_id, sold, known, t, cents): sales of a client and a time; ``known`` is null for those that never arrive."""
    sold, arrived = micros(sales, "sold_at"), micros(sales, "arrived_at") + delay_minutes * 60_000_000
    spread = F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit("")).cast("binary")) % spread_seconds * 1_000_000
    rows = sales.filter("client_id is not null and sold_at is not null")
    known = F.when(arrived.isNotNull(), F.greatest(sold, arrived))
    return rows.select("sale_id", "client_id", sold.alias("sold"), known.alias("known"), (sold + spread).alias("t"), cents(F.col("total")).alias("cents"))


def known_clicks(clicks: DataFrame, delay_minutes: int = DELAY_MINUTES) -> DataFrame:
    """(click_id, client_id, ts, known, purchase, cents) of distinct rows, whatever columns they have, with a client and both times."""
    own = ["click_id", "ts", "arrived_at", "client_id", "kind", "value"]
    others = [c for c in clicks.columns if c not in own]
    rows = clicks.filter("client_id is not null and ts is not null and arrived_at is not null")
    plain = len(others) == 1 and dict(clicks.dtypes)[others[0]] == "string"
    rest = (F.col(others[0]) if plain else F.to_json(F.struct(*others), {"ignoreNullFields": "false"})) if others else F.lit(None)
    rows = rows.select(*own, rest.alias("_rest")).distinct()
    known = F.greatest(micros(rows, "ts"), micros(rows, "arrived_at") + delay_minutes * 60_000_000)
    purchase = F.coalesce((F.col("kind") == "purchase").cast("long"), F.lit(0))
    return rows.select("click_id", "client_id", micros(rows, "ts").alias("ts"), known.alias("known"), purchase.alias("purchase"), cents(F.col("value")).alias("cents"))


def known_lines(lines: DataFrame, sales: DataFrame, most_days: int) -> DataFrame:
    """(client_id, item_id, sold, known, n, cents): equal shipments of an item in a sale as one row, from when they count.

    ``sales`` are those of :func:`known_sales`. Lines that are not shipped, or first count after
    ``most_days``, are left out. A sale of very many lines is dealt to salts.
    """
    rows = lines.filter("sale_id is not null and shipped_at is not null").select("sale_id", "item_id", micros(lines, "shipped_at").alias("shipped"), cents(F.col("amount")).alias("cents"))
    summed = rows.groupBy("sale_id", "item_id", "shipped").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    into = sales.filter("known is not null and sale_id is not null").select("sale_id", "client_id", "sold", F.col("known").alias("sale_known"))
    hot = hot_keys(lines.select("sale_id"), "sale_id")
    found = join_hot(summed, into, "sale_id", hot=hot).withColumn("known", F.greatest("sale_known", "shipped"))
    return found.filter(F.col("known") < F.col("sold") + most_days * DAY).select("client_id", "item_id", "sold", "known", "n", "cents")


def slice_widths(rows: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """(client_id, width): a slice's microseconds for each client of more than ``slice_rows`` of ``rows`` (client_id, at); None if there are none.

    A client's rows of a day are taken to be its rows by the days that have any, so that single rows
    at odd times change nothing.
    """
    days = rows.groupBy("client_id", F.floor(F.col("at") / DAY).alias("day")).agg(F.count("*").alias("n"))
    busy = days.groupBy("client_id").agg(F.sum("n").alias("n"), F.count("*").alias("days")).filter(F.col("n") > slice_rows)
    width = F.greatest(F.floor(F.lit(float(slice_rows * DAY)) * F.col("days") / F.col("n")), F.lit(1)).cast("long")
    widths = written(busy.select("client_id", width.alias("width")), "widths")
    return None if widths.isEmpty() else widths


def with_width(rows: DataFrame, widths: DataFrame | None) -> DataFrame:
    """``rows`` with their client's ``width``, null where it is not cut into slices."""
    if widths is None:
        return rows.withColumn("width", F.lit(None).cast("long"))
    return rows.join(widths, "client_id", "left")


def slice_of(at: Column, width: Column) -> Column:
    """The first instant of the slice that holds ``at``; 0 for clients that are not cut."""
    return F.coalesce(at - F.pmod(at, width), F.lit(0))


def carried(totals: DataFrame, by: list[str], sums: list[str], maxima: list[str], back: bool = False) -> DataFrame:
    """For each row of ``totals`` (``by``, slice, width, values), the sums and maxima of the rows of its ``by`` in earlier slices.

    ``back`` takes later slices instead. Sums are 0 and maxima null where there are none. Slices are
    carried in runs of RUN, and runs among themselves.
    """
    order = (lambda name: F.desc(name)) if back else (lambda name: F.asc(name))
    earlier = lambda *keys, by_: Window.partitionBy(*keys).orderBy(order(by_)).rowsBetween(Window.unboundedPreceding, -1)
    rows = totals.withColumn("run", slice_of(F.col("slice"), F.col("width") * RUN))
    runs = rows.groupBy(*by, "run").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in maxima))
    over_runs = earlier(*by, by_="run")
    runs = runs.select(*by, "run", *(F.sum(c).over(over_runs).alias(f"{c}_run") for c in sums), *(F.max(c).over(over_runs).alias(f"{c}_run") for c in maxima))
    within = earlier(*by, "run", by_="slice")
    rows = rows.select(*by, "run", "slice", "width", *(F.sum(c).over(within).alias(c) for c in sums), *(F.max(c).over(within).alias(c) for c in maxima))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in [*by, "run"]]
    both = rows.alias("r").join(runs.alias("o"), same)
    added = (F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_run", F.lit(0)) for c in sums)
    return both.select(*(F.col(f"r.{c}") for c in by), "slice", "width", *(x.alias(c) for x, c in zip(added, sums, strict=True)), *(F.greatest(c, f"{c}_run").alias(c) for c in maxima))


def item_spans(lines: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """``lines`` (with width) and until when earlier lines of their client and item, by when they count, already do: ``before_k`` for window k."""
    ends = lines.withColumns({f"end_{k}": F.greatest("known", F.col("sold") + d * DAY) for k, d in enumerate(days)}).withColumn("slice", slice_of(F.col("known"), F.col("width")))
    names = [f"end_{k}" for k in range(len(days))]
    cut_ = ends.filter("width is not null").groupBy("client_id", "item_id", "slice", "width").agg(*(F.max(c).alias(c) for c in names))
    opening = carried(cut_, ["client_id", "item_id"], [], names).filter(" or ".join(f"{c} is not null" for c in names))
    # Openings are rows before all others of their slice, so that they take part in the windows without a join.
    rows = ends.withColumn("own", F.lit(True)).unionByName(opening.withColumns({"known": F.col("slice") - 1, "own": F.lit(False)}), allowMissingColumns=True)
    earlier = Window.partitionBy("client_id", "item_id", "slice").orderBy("known", "sold").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({f"before_{k}": F.max(c).over(earlier) for k, c in enumerate(names)}).filter("own").drop("own")


def change_logs(sales: DataFrame, clicks: DataFrame, lines: DataFrame, days: tuple[int, ...]) -> DataFrame:
    """(client_id, slice, width, log, at, v0 .., last): the logs of clients, rows of one instant summed; all inputs have a width."""
    n_values = len(SALE_SUMS) + len(days)
    null_last = F.lit(None).cast("struct<ts:long,has_id:boolean,id:long>")

    def row(log: int, at: Column, *values: Column | int, last: Column = null_last) -> Column:
        each = [F.lit(v).cast("long") if isinstance(v, int) else v for v in values]
        each += [F.lit(0).cast("long")] * (n_values - len(each))
        return F.struct(F.lit(log).alias("log"), at.alias("at"), *(v.alias(f"v{i}") for i, v in enumerate(each)), last.alias("last"))

    known, sold = F.col("known"), F.col("sold")
    until = lambda start, d: F.greatest(known, start + d * DAY)
    latest = F.struct(F.col("ts").alias("ts"), F.col("click_id").isNotNull().alias("has_id"), F.col("click_id").cast("long").alias("id"))
    click = (F.lit(1).cast("long"), F.col("purchase"), F.col("cents"))
    of_clicks = [row(CLICK_IN, known, *click, last=latest), *(row(CLICK_OUT + k, until(F.col("ts"), d), *click) for k, d in enumerate(days))]
    sale = (F.lit(1).cast("long"), F.col("cents"))
    counts = known.isNotNull() & (known < sold + max(days) * DAY)
    of_sales = [row(SOLD, sold), F.when(counts, row(SALE_IN, known, *sale)), *(F.when(counts, row(SALE_OUT + k, until(sold, d), *sale)) for k, d in enumerate(days))]
    ends, befores = ([F.col(f"{x}_{k}") for k in range(len(days))] for x in ("end", "before"))
    adds = [F.col("item_id").isNotNull() & (b.isNull() | (e > b)) for e, b in zip(ends, befores, strict=True)]
    late = [a & (b > known) for a, b in zip(adds, befores, strict=True)]
    late = [F.coalesce(x, F.lit(False)) for x in late]
    line = (0, 0, F.col("n"), F.col("cents"))
    one = [(0,) * k for k in range(len(days))]
    of_lines = [
        row(SALE_IN, known, *line, *((a & ~b).cast("long") for a, b in zip(adds, late, strict=True))),
        *(F.when(b, row(SALE_IN, befores[k], 0, 0, 0, 0, *one[k], 1)) for k, b in enumerate(late)),
        *(row(SALE_OUT + k, e, *line, adds[k].cast("long")) for k, e in enumerate(ends)),
    ]
    clicks = clicks.filter(known < F.col("ts") + max(days) * DAY)
    parts = [rows.select("client_id", "width", F.explode(F.filter(F.array(*of), lambda x: x.isNotNull())).alias("row")) for rows, of in ((clicks, of_clicks), (sales, of_sales), (lines, of_lines))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).select("client_id", "width", "row.*")
    values = [f"v{i}" for i in range(n_values)]
    summed = rows.groupBy("client_id", "width", "log", "at").agg(*(F.sum(v).alias(v) for v in values), F.max("last").alias("last"))
    return summed.select("client_id", slice_of(F.col("at"), F.col("width")).alias("slice"), "width", "log", "at", *values, "last")


def balances(logs: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows for ``logs``: what earlier slices of each log leave, at the first instant of every slice of ``asked``, and the next sale of later slices."""
    values = [c for c in logs.columns if c[0] == "v"]
    sliced = logs.filter("width is not null")
    totals = sliced.groupBy("client_id", "log", "slice", "width").agg(*(F.sum(v).alias(v) for v in values), F.max("last").alias("last"), F.min("at").alias("first"))
    codes = written(sliced.select("client_id", "log").distinct(), "logs")
    empty = asked.filter("width is not null").select("client_id", "slice", "width").distinct().join(codes, "client_id")
    both = totals.unionByName(empty, allowMissingColumns=True).groupBy("client_id", "log", "slice", "width").agg(*(F.sum(v).alias(v) for v in values), F.max("last").alias("last"), F.min("first").alias("first"))
    both = written(both, "totals")
    by = ["client_id", "log"]
    opening = carried(both.filter(F.col("log") != SOLD).drop("first"), by, values, ["last"]).withColumn("at", F.col("slice"))
    closing = carried(both.filter(F.col("log") == SOLD).withColumn("soon", -F.col("first")), by, [], ["soon"], back=True)
    closing = closing.filter("soon is not null").withColumn("at", -F.col("soon")).drop("soon")
    return opening.unionByName(closing, allowMissingColumns=True).select(*logs.columns)


OUT = pa.schema(
    [("sale_id", pa.int64()), ("d", pa.int32()), ("t_us", pa.int64()), ("label", pa.bool_()), ("n_clicks", pa.int64()), ("n_purchases", pa.int64()), ("click_cents", pa.int64())]
    + [("last_click_id", pa.int64())] + [(x, pa.int64()) for x in ("n_sales", "sale_cents", "n_lines", "n_items", "line_cents")]
)
OUT_DDL = "sale_id long, d int, t_us long, label boolean, n_clicks long, n_purchases long, click_cents long, last_click_id long, n_sales long, sale_cents long, n_lines long, n_items long, line_cents long"


def looked_up(days: tuple[int, ...], horizon_days: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function of the asked sales and the logs of a bucket that gives the features of each sale and window."""

    def run(asked: pa.Table, logs: pa.Table) -> pa.Table:
        whole = lambda column: column.combine_chunks().to_numpy(zero_copy_only=False)
        slices = pd.MultiIndex.from_arrays([np.concatenate([whole(asked[c]), whole(logs[c])]) for c in ("client_id", "slice")])
        of = pd.factorize(slices)[0]
        sales = pd.DataFrame({"of": of[: asked.num_rows], "t": whole(asked["t"]), "row": np.arange(asked.num_rows)}).sort_values("t", kind="stable")
        rows = pd.DataFrame({"of": of[asked.num_rows :], "log": whole(logs["log"]), "at": whole(logs["at"])} | {c: whole(logs[c]) for c in logs.column_names if c[0] == "v"})
        rows = rows.assign(**{c: whole(pc.struct_field(logs["last"], c).fill_null(none)) for c, none in (("ts", 0), ("has_id", False), ("id", 0))})
        by_log = {log: part.reset_index(drop=True) for log, part in rows.sort_values("at", kind="stable").groupby("log")}
        sold_row = sales["row"].to_numpy()
        t = whole(asked["t"])

        def place(log: int, **how: object) -> np.ndarray:
            """For each sale, the row of a log that it meets, or -1."""
            found, part = np.full(asked.num_rows, -1, np.int64), by_log.get(log)
            if part is not None:
                right = pd.DataFrame({"of": part["of"], "t": part["at"], "place": np.arange(len(part))})
                found[sold_row] = pd.merge_asof(sales, right, on="t", by="of", **how)["place"].fillna(-1).astype(np.int64)
            return found

        def sums(log: int, n: int) -> list[np.ndarray]:
            """For each sale, the first ``n`` sums of a log so far."""
            at = place(log)
            if log not in by_log:
                return [np.zeros(asked.num_rows, np.int64)] * n
            so_far = by_log[log].groupby("of")[[f"v{i}" for i in range(n)]].cumsum().to_numpy(np.int64)
            return list(np.where(at < 0, 0, so_far[at].T))

        ahead, sold = place(SOLD, direction="forward", allow_exact_matches=False), by_log.get(SOLD)
        label = np.zeros(asked.num_rows, bool) if sold is None else (ahead >= 0) & (sold["at"].to_numpy()[ahead] - t <= horizon_days * DAY)
        click_in, sale_in = sums(CLICK_IN, len(CLICK_SUMS)), sums(SALE_IN, len(SALE_SUMS) + len(days))
        seen, latest, has_id, click_id = place(CLICK_IN), np.zeros(asked.num_rows, np.int64), np.zeros(asked.num_rows, bool), np.zeros(asked.num_rows, np.int64)
        if CLICK_IN in by_log:
            part = by_log[CLICK_IN]
            order = np.lexsort((part["id"], part["has_id"], part["ts"]))
            rank = np.empty(len(part), np.int64)
            rank[order] = np.arange(len(part))
            top = order[pd.Series(rank).groupby(part["of"]).cummax().to_numpy()][seen]
            latest, has_id, click_id = (part[c].to_numpy()[top] for c in ("ts", "has_id", "id"))
        tables = []
        for k, d in enumerate(days):
            click = [a - b for a, b in zip(click_in, sums(CLICK_OUT + k, len(CLICK_SUMS)), strict=True)]
            *sale, items = [a - b for a, b in zip([*sale_in[: len(SALE_SUMS)], sale_in[len(SALE_SUMS) + k]], sums(SALE_OUT + k, len(SALE_SUMS) + 1), strict=True)]
            none = (seen < 0) | ~has_id | (latest <= t - d * DAY)
            columns = [asked["sale_id"].combine_chunks(), np.full(asked.num_rows, d, np.int32), t, label, *click, pa.array(click_id, mask=none), sale[0], sale[1], sale[2], items, sale[3]]
            tables.append(pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=OUT))
        return pa.concat_tables(tables)

    return run


def features(sales: DataFrame, clicks: DataFrame, lines: DataFrame, days: tuple[int, ...] = DAYS, horizon_days: int = HORIZON_DAYS, slice_rows: int = SLICE_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """A row for each sale with a client and a time, and each window of ``days``.

    Sales of null client or time, and clicks and lines that can count nowhere, are left out. Fully equal clicks
    are one; rows that repeat a sale or a line are sales and lines of their own, and each sale of an id has
    the id's lines. What never arrives never counts, though a sale may be the next of another. A null sale_id
    is spread as empty text and has no lines. Null amounts, and those that are no number, are 0. Of clicks at
    one time a null id is least, and null if it is alone. Texts are not read but to tell equal clicks; other
    columns of any name are left out, but tell clicks apart. Empty tables give zeros, and no sales no rows.
    """
    sold = known_sales(sales)
    shipped = written(known_lines(lines, sold, max(days)), "lines")
    clicked = written(known_clicks(clicks), "clicks")
    at = lambda rows, name: rows.select("client_id", F.col(name).alias("at"))
    widths = slice_widths(at(sold, "sold").unionByName(at(clicked, "ts")).unionByName(at(shipped, "known")), slice_rows)
    sold = written(with_width(sold, widths), "sales")
    shipped = with_width(shipped, None) if widths is None else written(with_width(shipped, widths), "lines")
    logs = written(change_logs(sold, with_width(clicked, widths), item_spans(shipped, days), days), "logs")
    asked = sold.select("sale_id", "client_id", "t", slice_of(F.col("t"), F.col("width")).alias("slice"), "width")
    n_buckets = max(1, -(-logs.count() // bucket_rows))
    if widths is not None:
        logs = logs.unionByName(balances(logs, asked))
    bucket = F.pmod(F.xxhash64("client_id", "slice"), F.lit(n_buckets)).alias("bucket")
    left = asked.select(F.col("sale_id").cast("long").alias("sale_id"), "client_id", "slice", "t", bucket)
    right = logs.select("client_id", "slice", "log", "at", *(F.coalesce(c, F.lit(0)).alias(c) for c in logs.columns if c[0] == "v"), "last", bucket)
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(looked_up(days, horizon_days), OUT_DDL)


def op12_sale_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract result of :func:`features` over all sales."""
    return features(*(table(spark, sf_dir, name) for name in ("sales", "clicks", "sale_lines")))


ORACLE = r"""
with crc as (
  select list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as bytes
), s as (
  select row_number() over () as row_id, sale_id, client_id, epoch_us(sold_at) as sold, greatest(epoch_us(sold_at), epoch_us(arrived_at) + 14400000000) as late,
         arrived_at is not null as arrives, case when abs(total) < 1e13 then floor(100 * total + 0.5)::bigint else 0 end as cents,
         epoch_us(sold_at) + 1000000 * (xor(list_reduce(list_concat([4294967295], list_transform(list_filter(string_split(coalesce(sale_id::varchar, ''), ''), lambda x: x <> ''), lambda x: ascii(x)::bigint)),
           lambda a, b: xor(a >> 8, bytes[(xor(a, b) & 255) + 1])), 4294967295) % 259200) as t
  from sales, crc where client_id is not null and sold_at is not null
), c as (
  select client_id, click_id, epoch_us(ts) as ts, greatest(epoch_us(ts), epoch_us(arrived_at) + 14400000000) as known, coalesce(kind = 'purchase', false) as bought,
         case when abs(value) < 1e13 then floor(100 * value + 0.5)::bigint else 0 end as cents
  from (select distinct * from clicks) where client_id is not null and ts is not null and arrived_at is not null
), l as (
  select s.client_id, s.sold, greatest(s.late, epoch_us(shipped_at)) as known, item_id, case when abs(amount) < 1e13 then floor(100 * amount + 0.5)::bigint else 0 end as cents
  from sale_lines join s using (sale_id) where shipped_at is not null and s.arrives
), q as (
  select row_id, sale_id, client_id, t, d, t - d * 86400000000 as since from s, (select unnest([2, 14])::int as d)
), labels as (
  select a.row_id, count(*) > 0 as label from s a join s b on a.client_id = b.client_id and a.t < b.sold and b.sold <= a.t + 7 * 86400000000 group by all
), by_click as (
  select row_id, d, count(*) as n_clicks, count(*) filter (bought) as n_purchases, sum(cents)::bigint as click_cents, arg_max_null(click_id, {'ts': ts, 'id': coalesce(click_id, -9223372036854775807)}) as last_click_id
  from q join c on q.client_id = c.client_id and since < ts and ts <= t and known <= t group by all
), by_sale as (
  select q.row_id, d, count(*) as n_sales, sum(cents)::bigint as sale_cents
  from q join s on q.client_id = s.client_id and since < s.sold and s.sold <= q.t and s.arrives and s.late <= q.t group by all
), by_line as (
  select row_id, d, count(*) as n_lines, count(distinct item_id) as n_items, sum(cents)::bigint as line_cents
  from q join l on q.client_id = l.client_id and since < l.sold and l.sold <= t and known <= t group by all
)
select sale_id, d, t as t_us, coalesce(label, false) as label, coalesce(n_clicks, 0) as n_clicks, coalesce(n_purchases, 0) as n_purchases, coalesce(click_cents, 0) as click_cents, last_click_id,
       coalesce(n_sales, 0) as n_sales, coalesce(sale_cents, 0) as sale_cents, coalesce(n_lines, 0) as n_lines, coalesce(n_items, 0) as n_items, coalesce(line_cents, 0) as line_cents
from q left join labels using (row_id) left join by_click using (row_id, d) left join by_sale using (row_id, d) left join by_line using (row_id, d)
"""
