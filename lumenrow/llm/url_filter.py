"""URL filter: host and path rules first, a character language-model ratio for the rest.

Two smoothed variable-order Markov models, of URLs that rules allow and of those they block, are
counted over all distinct URLs: a context of three characters backs off, by Dirichlet smoothing, to
two, one and none. A URL is judged, whole, by the mean difference of log-likelihood a character against
a threshold calibrated on the URLs that rules decide. Characters are numbers and grams of four are
integers, so the model is a table of at most the alphabet's fourth power.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.llm.common import cut, hot_keys, join_hot, let, table

ORDER = 3
#: Prior weight of the next shorter context.
PRIOR = 4.0
#: The characters of the models; after lower-casing A-Z, digits count as ``0`` and others as ``?``.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0-._~/%+:@&=,;?#"
#: Characters, and marks of the start and the end; a gram of four is a number below the fourth power of it.
SYMBOLS = len(ALPHABET) + 2
#: Characters of distinct URLs that one task cuts to grams.
CHARS_A_TASK = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """``verdict`` for a host, all its subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Rules as (host, path, verdict).
RULES = (
    HostRule("net", "/", "block"),
    HostRule("example.net", "/en/", "allow"),
    HostRule("example.com", "/de/", "block"),
    HostRule("org", "/fr/", "allow"),
)


def url_host(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[HostRule, ...]) -> Column:
    """A struct (rule, verdict) of the longest fitting rule, null where none fits."""
    chosen = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen


def url_key(url: Column) -> Column:
    """The whole url as the models read it."""
    return F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)


def _grams(key: Column) -> Column:
    """The numbers of the 4-character windows of ``key`` with three start marks before and an end mark behind."""
    plain = F.regexp_replace(F.regexp_replace(key, "[0-9]", "0"), "[^" + ALPHABET.replace("-", "\\-") + "]", "?")
    start, end = F.lit(len(ALPHABET)), F.lit(len(ALPHABET) + 1)
    spelled = F.when(plain == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(plain, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1))
    codes = F.concat(F.array_repeat(start, ORDER), spelled, F.array(end))

    def windows(cs: Column) -> Column:
        place = lambda i, k: F.get(cs, i + k)
        number = lambda i: functools.reduce(lambda n, k: n * SYMBOLS + place(i, k), range(1, ORDER + 1), place(i, 0))
        return F.transform(F.sequence(F.lit(0), F.size(cs) - (ORDER + 1)), number)

    return let(codes, windows)


def gram_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio): log P(last character | first three) for allowed less that for blocked URLs.

    ``grams`` has (gram, verdict, n). Every gram of any URL is there; a class never seen gives the
    uniform distribution. The rows are bounded by the alphabet, not by the corpus.
    """
    classes = ("allow", "block")
    rows = cut(grams.groupBy("gram").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).cast("double").alias(v) for v in classes)))
    totals = rows.agg(*(F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in classes)).first()
    suffix = lambda order: F.col("gram") % SYMBOLS ** (order + 1)
    context = lambda order: F.floor(suffix(order) / SYMBOLS)
    found = {("n", ORDER, v): F.col(v) for v in classes} | {("c", 0, v): F.lit(totals[v]) for v in classes}
    for name, part, orders in (("n", suffix, range(ORDER)), ("c", context, range(1, ORDER + 1))):
        for order in orders:
            w = Window.partitionBy(part(order))
            rows = rows.select("*", *(F.sum(v).over(w).alias(f"{name}{order}_{v}") for v in classes))
            found |= {(name, order, v): F.col(f"{name}{order}_{v}") for v in classes}
    p = {v: functools.reduce(lambda back, order: (found["n", order, v] + PRIOR * back) / (found["c", order, v] + PRIOR), range(ORDER + 1), F.lit(1.0 / SYMBOLS)) for v in classes}
    return rows.select("gram", (F.ln(p["allow"]) - F.ln(p["block"])).alias("ratio"))


def calibrated_threshold(scored: DataFrame) -> float:
    """The score that best separates allowed from blocked URLs by balanced accuracy, to 0.01; 0 without both."""
    bins = scored.filter(F.col("verdict").isNotNull()).groupBy(F.floor(F.col("score") * 100).alias("bin"))
    bins = bins.agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")))
    rest, every = Window.orderBy("bin").rowsBetween(Window.currentRow, Window.unboundedFollowing), Window.partitionBy()
    kept = F.sum("allow").over(rest) / F.sum("allow").over(every)
    passed = F.sum("block").over(rest) / F.sum("block").over(every)
    both = (F.sum("allow").over(every) > 0) & (F.sum("block").over(every) > 0)
    best = bins.select("bin", F.when(both, kept - passed).alias("gain")).filter("gain is not null").orderBy(F.desc("gain"), F.asc("bin")).first()
    return best["bin"] / 100 if best else 0.0


def judge_urls(pages: DataFrame, rules: tuple[HostRule, ...] = RULES) -> DataFrame:
    """(page, host, path, rule, verdict, score) for each row; ``page`` is the whole input row.

    Null urls and urls without ``://`` have empty host and path and fit no rule; null ones are scored
    as the empty string. Counts weigh each distinct URL by its rows, so repeated rows cost one line
    of the model's input. An empty table gives no rows.
    """
    url = F.col("url")
    rows = pages.select(F.struct("*").alias("page"), url_host(url).alias("host"), url_path(url).alias("path"))
    rows = rows.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules))
    name = F.concat(F.hex(F.xxhash64("key")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), "key")))
    rows = rows.withColumn("key", url_key(F.col("page.url"))).withColumn("key_name", name)
    keys = cut(rows.groupBy("key_name", F.col("fit.verdict").alias("verdict")).agg(F.first("key").alias("key"), F.count("*").alias("n")))
    chars = keys.agg(F.sum(F.length("key") + 1)).first()[0] or 0
    grams = keys.repartition(int(chars) // CHARS_A_TASK + 1, "key_name").select("key_name", "verdict", "n", F.explode(_grams(F.col("key"))).alias("gram"))
    ratios = cut(gram_ratios(grams))
    scored = grams.join(F.broadcast(ratios), "gram").groupBy("key_name", "verdict", "n").agg(F.avg("ratio").alias("score"))
    scored = cut(scored)
    threshold = calibrated_threshold(scored)
    by_key = scored.groupBy("key_name").agg(F.first("score").alias("score"))
    judged = join_hot(rows.drop("key"), by_key, "key_name", salt_by=F.to_json("page"), hot=hot_keys(keys, "key_name", "n"))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return judged.select("page", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "score")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`judge_urls` over all pages."""
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select(F.col("page.page_id").alias("page_id"), "host", "path", "rule", "verdict")


_UPPER_SQL = f"translate(%s, '{UPPER}', '{LOWER}')"
ORACLE = f"""
with parsed as (
  select page_id, coalesce(url, '') as url, {_UPPER_SQL % "regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's')"} as host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages
), ruled as (
  select *, {_UPPER_SQL % "url"} as key,
         case {" ".join(f"when (host = '{r.host}' or host like '%.{r.host}') and starts_with(path, '{r.path}') then '{r.text}:{r.verdict}'" for r in sorted(RULES, key=lambda r: -len(r.text)))} end as fit from parsed
), verdicts as (
  select *, split_part(fit, ':', 1) as rule, split_part(fit, ':', 2) as known from ruled
), keys as (
  select key, known, count(*) as n, '^^^' || regexp_replace(regexp_replace(key, '[0-9]', '0', 'g'), '[^{ALPHABET.replace("-", chr(92) + "-")}]', '?', 'g') || '$' as padded from verdicts group by all
), grams as (
  select key, known, n, unnest(list_transform(generate_series(1, length(padded) - 3), lambda i: padded[i:i + 3])) as gram from keys
), counts as (
  select gram, sum(case when known = 'allow' then n else 0 end)::double as a, sum(case when known = 'block' then n else 0 end)::double as b from grams group by gram
), sums as (
  select gram, {", ".join(f"{v} as {v}3, " + ", ".join(f"sum({v}) over (partition by gram[{4 - k}:4]) as {v}{k}, sum({v}) over (partition by gram[{3 - k}:3]) as c{v}{k + 1}" for k in range(3)) + f", sum({v}) over () as c{v}0" for v in "ab")} from counts
), ratios as (
  select gram, {" - ".join("ln(" + functools.reduce(lambda back, k: f"(({v}{k} + {PRIOR} * {back}) / (c{v}{k} + {PRIOR}))", range(4), f"{1.0 / SYMBOLS!r}::double") + ")" for v in "ab")} as ratio from sums
), scored as (
  select key, known, n, avg(ratio) as score from grams join ratios using (gram) group by all
), bins as (
  select floor(score * 100) as bin, sum(case when known = 'allow' then n else 0 end) as a, sum(case when known = 'block' then n else 0 end) as b from scored where known is not null group by 1
), gains as (
  select bin, sum(a) over rest / sum(a) over () - sum(b) over rest / sum(b) over () as gain, sum(a) over () > 0 and sum(b) over () > 0 as labelled
  from bins window rest as (order by bin rows between current row and unbounded following)
), threshold as (
  select coalesce((select bin / 100 from gains where labelled order by gain desc, bin limit 1), 0) as least
), each as (
  select key, any_value(score) as score from scored group by key
)
select page_id, host, path, rule, coalesce(known, case when score >= (select least from threshold) then 'allow' else 'block' end) as verdict from verdicts join each using (key)
"""
