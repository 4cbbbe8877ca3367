"""Audit of how the sources of each language differ in their words.

Terms are counted in each text, exploded and counted by language and source with the documents that hold them;
terms in few of a language's documents go. Groups, the sources and the whole language, are crossed with
the language's kept vocabulary, so that each has a smoothed share of every kept term, zeros too. The
dense table joined to itself by language and term gives each pair of sources the sum of a symmetric
chi-square-like distance; the terms that stand out in a source are ranked against the whole language.
All numbers are integers: shares are in parts of ``SCALE``, products are decimals of 38 digits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.llm.common import in_slices, join_hot, table, written

#: Terms are the longest runs of what is not in gaps.
GAP_PATTERN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, TOP = 10, 10
#: Shares are integers in parts of SCALE, with PRIOR occurrences added to each kept term.
SCALE, PRIOR = 1_000_000_000, 2
EXACT = "decimal(38,0)"


def terms_of(text: Column) -> Column:
    """The distinct terms of each text with how often they occur in it."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [_counted(part["text"]) for part in in_slices([pa.RecordBatch.from_arrays([texts], ["text"])])]
        return pa.concat_arrays(parts) if parts else pa.array([], TERMS)

    return F.arrow_udf(run, "array<struct<term:string,n:long>>")(text)


TERMS = pa.list_(pa.struct([("term", pa.string()), ("n", pa.int64())]))


def _counted(texts: pa.Array) -> pa.Array:
    """An array of TERMS: words are numbered over all texts, and pairs of text and word counted by sorting their numbers."""
    split = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=GAP_PATTERN)
    words, of = pc.list_flatten(split).dictionary_encode(), pc.list_parent_indices(split).to_numpy()
    known = len(words.dictionary)
    pairs, n = np.unique(of * max(1, known) + words.indices.to_numpy(), return_counts=True)
    of, word = np.divmod(pairs, max(1, known))
    real = word != pc.index(words.dictionary, "").as_py()  # what stands before a first gap and behind a last one
    of, word, n = of[real], word[real], n[real]
    offsets = np.searchsorted(of, np.arange(len(texts) + 1))
    each = pa.StructArray.from_arrays([words.dictionary.take(pa.array(word)), pa.array(n, pa.int64())], ["term", "n"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), each).cast(TERMS)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, held): occurrences of each term in each group and the documents that hold it.

    Each row of ``docs`` is a document. Its matches are counted by Arrow before they are exploded, as
    telling the distinct terms of a document from all its terms takes the JVM twice the time of the rest.
    """
    terms = docs.select(*_groups(), F.inline(terms_of(F.coalesce("text", F.lit("")))))
    return terms.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.count("*").alias("held"))


def _groups() -> list[Column]:
    return [F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")]


def _share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept))."""
    exact = lambda x: x.cast(EXACT)
    above = exact(exact(n + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"))
    return F.call_function("div", above, exact(total + F.lit(PRIOR) * kept)) + F.lit(1)


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so all products fit a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def shares(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source) and their dense table (lang, term, source, n, p, q), computed and read again.

    ``q`` is the share of the term in the whole language. The table has a row for each kept term of a
    language and each of its sources.
    """
    counts = written(term_counts(docs), "terms")
    groups = written(docs.select(*_groups()).distinct(), "groups")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("held").alias("in_docs")).filter(F.col("in_docs") >= least_documents)
    kept = written(kept.select("lang", "term", "all_n"), "kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("all_n").alias("all_total"))
    found = written(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"), "found")
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = groups.join(sizes, "lang").join(totals, ["lang", "source"], "left")
    # A language's sources and totals in one row: they are few, as the result has a row for each pair of them.
    sources = known.groupBy("lang", "kept", "all_total").agg(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total"))).alias("sources"))
    dense = join_hot(kept, sources, "lang", salt_by="term", counted=kept).select("lang", "term", "all_n", "kept", "all_total", F.inline("sources"))
    dense = dense.join(found, ["lang", "term", "source"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p, q = _share(F.col("n"), F.col("total"), F.col("kept")), _share(F.col("all_n"), F.col("all_total"), F.col("kept"))
    return groups, written(dense.select("lang", "term", "source", "n", p.alias("p"), q.alias("q")), "dense")


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) of ``docs``.

    Part ``pair`` has the distance to each other source of the language, 0 where it keeps no term;
    part ``term`` the ``top`` terms whose share is above the language's, by how far. Ranks are by value
    descending, then by item in byte order. Null texts, languages and sources are empty ones;
    repeated rows and ids are documents of their own; texts of any length and other columns of any name
    are fine; an empty table gives no rows.
    """
    groups, dense = shares(docs, least_documents)
    one = dense.select("lang", "term", "source", "p")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"))
    summed = one.join(other, ["lang", "term"]).filter("source <> item").groupBy("lang", "source", "item").agg(F.sum(_apart(F.col("p"), F.col("q"))).alias("value"))
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").filter("source <> item")
    pairs = pairs.join(summed, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    terms = dense.filter((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract result of :func:`divergence` over all documents."""
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE = r"""
with docs as (
  select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
), words as (
  select row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs
), kept as (
  select lang, term, count(*)::hugeint as n from words group by lang, term having count(distinct row_id) >= 10
), languages as (
  select lang, count(*)::hugeint as v, sum(n)::hugeint as total from kept group by lang
), groups as (
  select distinct lang, source from docs
), counts as (
  select lang, source, term, count(*)::hugeint as n from words semi join kept using (lang, term) group by all
), totals as (
  select lang, source, sum(n)::hugeint as total from counts group by all
), dense as (
  select lang, source, term, coalesce(c.n, 0) as n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * l.v) as p,
         1 + (1000000000 * (k.n + 2)) // (l.total + 2 * l.v) as q
  from groups join kept k using (lang) join languages l using (lang)
  left join totals t using (lang, source) left join counts c using (lang, source, term)
), summed as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) as value
  from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join summed s on s.lang = a.lang and s.source = a.source and s.item = b.source
), terms as (
  select lang, source, 'term' as part, term as item, (((p - q) * (p - q)) // (p + q))::bigint as value from dense where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (from pairs union all from terms)
)
from ranked where part = 'pair' or rank <= 10
"""
