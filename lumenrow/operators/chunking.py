"""Chunks of bounded measure, with manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenrow.functions.text import ends_sentence, natural_key, sentences, words
from lumenrow.operators.lines import joined_up_to, let, paragraphs, safe_blocks
from lumenrow.operators.sequences import running, walked
from lumenrow.operators.tables import materialised

#: Pieces of a corpus are packed in stretches of so many budgets, two at least, so that a chunk begins in each.
STRETCH_BUDGETS = 64


def pack_pieces(pieces: Column, budget: int, joiner: str) -> Column:
    """Pieces joined greedily while the joined text has at most ``budget`` characters.

    The fold is over lengths and keeps where chunks end; each text is joined once, from its slice.
    """

    def ends(ps: Column) -> Column:
        state = lambda size, cuts: F.struct(size.alias("size"), cuts.alias("cuts"))
        sized = F.transform(ps, lambda p, i: F.struct(F.length(p).alias("n"), i.alias("i")))

        def step(s: Column, p: Column) -> Column:
            longer = s["size"] + len(joiner) + p["n"]
            return F.when(p["i"] == 0, state(p["n"], s["cuts"])).when(longer <= budget, state(longer, s["cuts"])).otherwise(state(p["n"], F.array_append(s["cuts"], p["i"])))

        return F.aggregate(sized, state(F.lit(0), F.array().cast("array<int>")), step, lambda s: F.when(F.size(ps) > 0, F.array_append(s["cuts"], F.size(ps))).otherwise(s["cuts"]))

    return let(pieces, lambda ps: joined_up_to(ps, ends(ps), joiner))


def split_block(block: Column, budget: int) -> Column:
    """A block that is too long as its sentences, those that are too long as packed words."""
    parts = F.flatten(F.transform(sentences(block), lambda s: F.when(F.length(s) > budget, pack_pieces(words(s), budget, " ")).otherwise(F.array(s))))
    return F.when(F.length(block) > budget, pack_pieces(parts, budget, " ")).otherwise(F.array(block))


def chunk_by_length(documents: DataFrame, budget: int) -> DataFrame:
    """(doc_id, chunk_no, text, tokens): blocks of whole sentences packed to ``budget`` characters.

    A single word beyond the budget fails the query when its row is computed.
    """
    blocks = F.flatten(F.transform(safe_blocks(F.coalesce("text", F.lit(""))), lambda b: split_block(b, budget)))
    rows = documents.select("doc_id", F.posexplode(pack_pieces(blocks, budget, "\n\n")).alias("chunk_no", "text"))
    fits = F.when(F.length("text") > budget, F.raise_error(F.lit("a word is longer than the budget"))).otherwise(F.col("text"))
    return rows.select("doc_id", "chunk_no", fits.alias("text"), F.length("text").cast("bigint").alias("tokens"))


def chunk_by_measure(documents: DataFrame, budget: int, measure: Callable[[str], int]) -> DataFrame:
    """As :func:`chunk_by_length` for any measure of text; the measure of a joined text need not be a sum."""
    staged = documents.select("doc_id", safe_blocks(F.coalesce("text", F.lit(""))).alias("blocks"))

    def packed(pieces: list[str], joiner: str) -> list[str]:
        done: list[str] = []
        for piece in pieces:
            if done and measure(done[-1] + joiner + piece) <= budget:
                done[-1] += joiner + piece
            else:
                done.append(piece)
        return done

    def parts(block: str) -> list[str]:
        import re

        if measure(block) <= budget:
            return [block]
        found: list[str] = []
        for sentence in re.split(r"(?<=[.!?؟。！？…])\s+", block):
            found += packed(sentence.split(), " ") if measure(sentence) > budget else [sentence.strip()] if sentence.strip() else []
        return packed(found, " ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, blocks in zip(batch["doc_id"], batch["blocks"], strict=True):
                for n, text in enumerate(packed([p for b in blocks for p in parts(b)], "\n\n")):
                    size = measure(text)
                    if size > budget:
                        raise ValueError(f"a word of document {doc_id} is longer than the budget")
                    rows.append((doc_id, n, text, size))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_no", "text", "tokens"])

    kind = dict(documents.dtypes)["doc_id"]
    return staged.mapInPandas(run, f"doc_id {kind}, chunk_no int, text string, tokens long")


def chunk_budget(capacity: int) -> int:
    return capacity // 2


def manifest(chunks: DataFrame, prefix: str = "chunk") -> DataFrame:
    """One row for each document: its files with their tokens, in order; one chunk has no number in its name."""
    many = F.count("*").over(Window.partitionBy("doc_id")) > 1
    name = F.when(many, F.format_string(f"%s_{prefix}_%03d.txt", F.col("doc_id").cast("string"), F.col("chunk_no") + 1)).otherwise(F.format_string("%s.txt", F.col("doc_id").cast("string")))
    rows = chunks.withColumn("file", name)
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "file", "tokens"))).alias("outputs"), F.sum("tokens").alias("tokens"))


def corpus_chunks(documents: DataFrame, capacity: int, combined: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of half a reader's capacity of (name, text), and (name, error) of texts that could not be read.

    Texts are chunked each for itself, under their names, or, where ``combined`` names their kind, as
    one text under headers, whose name is ``all``.
    """
    errors = documents.filter("text is null").select("name", F.lit("it could not be read").alias("error"))
    read = documents.filter("text is not null")
    if combined is not None:
        return combined_chunks(read, chunk_budget(capacity), combined), errors
    return chunk_by_length(read.select(F.col("name").alias("doc_id"), "text"), chunk_budget(capacity)), errors


def headed(kind: str) -> Column:
    """A text under the header of its name."""
    return F.concat(F.lit(f"### Source {kind}: "), F.col("name"), F.lit("\n\n"), F.col("text"))


#: Texts of one name are dealt to parts by so many letters of theirs.
TIE_LETTERS = 32
#: Where pieces stand in a part of the corpus: the block that may go on what was open before, blocks, the last closed one, what is open.
HEAD, WHOLE, LAST, TAIL = range(4)


def combined_chunks(documents: DataFrame, budget: int, kind: str = "image") -> DataFrame:
    """:func:`chunk_by_length` of all texts (name, text) as one under headers, by natural name order, named ``all``.

    The combined text is never made. Texts are range-partitioned by name, those of one name by their text, and stay in
    their parts from there on: the blocks of a part are cut and split in it, once, but for those at its ends, which may
    be joined with those of other parts. All pieces are numbered by their lengths alone (:func:`chunk_numbers`), and each part joins the
    chunks that are whole in it. So texts are written twice, once to be sorted and once in pieces; what
    parts hand on is a few blocks and the beginnings of two chunks each.
    """
    spark = documents.sparkSession
    parts = documents.select("name", headed(kind).alias("part"), F.substring("text", 1, TIE_LETTERS).alias("first"))
    order = [natural_key(F.col("name")), F.asc("name")]
    # A range partition gathers what it samples of its keys: whole texts would be too much.
    rows = parts.repartitionByRange(*order, F.asc("first")).sortWithinPartitions(*order, F.asc("part")).select(F.explode(paragraphs(F.col("part"))).alias("text"))
    rows = rows.select(F.spark_partition_id().cast("bigint").alias("part"), "text", ends_sentence(F.col("text")).alias("ends"))
    blocks = rows.mapInArrow(_blocks, "part long, no long, text string, head string, last string, tail string")
    fits = F.when(F.length("text") > budget, F.raise_error(F.lit("a word is longer than the budget"))).otherwise(F.col("text")).alias("text")
    pieces = blocks.select("part", "no", "head", "last", "tail", F.posexplode(split_block(F.col("text"), budget)).alias("piece", "text"))
    ends = (F.when(F.col("piece") == 0, F.col(c)).alias(c) for c in ("head", "last", "tail"))
    held = materialised(spark, pieces.select("part", "no", "piece", fits, *ends))

    places = {"head": HEAD, "last": LAST, "tail": TAIL}
    listed = F.explode(F.array(*(F.struct(F.lit(place).alias("place"), F.col(c).alias("text")) for c, place in places.items()))).alias("end")
    ends = held.filter("head is not null or last is not null or tail is not null").select("part", listed).select("part", "end.place", "end.text").filter("text is not null")
    ends = materialised(spark, ends.withColumn("closes", (F.col("place") != TAIL).cast("int")))
    closed = ends.agg(F.coalesce(F.sum("closes"), F.lit(0))).first()[0]
    runs = running(ends.drop("text"), [F.col("part"), F.col("place")], {"run": F.col("closes")})
    # What is left open at the end joins the last block, where there is one.
    run = F.when((F.col("run") == closed) & (F.col("run") > 0), F.col("run") - 1).otherwise(F.col("run"))
    joined = ends.join(runs.select("part", "place", run.alias("run")), ["part", "place"]).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("part", "place", "text"))).alias("rows"))
    joined = joined.select(F.col("rows")[0]["part"].alias("part"), F.col("rows")[0]["place"].alias("place"), F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("text"))
    edges = materialised(spark, joined.select("part", "place", F.posexplode(split_block(F.col("text"), budget)).alias("piece", "text")).select("part", "place", "piece", fits))

    inner = held.filter("text is not null").select("part", F.lit(WHOLE).alias("place"), "no", "piece", F.length("text").cast("bigint").alias("n"))
    sizes = inner.unionByName(edges.select("part", "place", F.lit(0).cast("bigint").alias("no"), "piece", F.length("text").cast("bigint").alias("n")))
    numbers = materialised(spark, chunk_numbers(sizes, [F.col(c) for c in ("part", "place", "no", "piece")], budget, 2).select("part", "place", "no", "piece", "begins", "chunk_no"))
    entries = numbers.filter(F.col("place") == WHOLE).groupBy("part").agg(F.min("chunk_no").alias("chunk"), F.min(F.when(F.col("begins"), F.struct("no", "piece"))).alias("entry"))
    entries = entries.select("part", "chunk", F.col("entry.no").alias("entry_no"), F.col("entry.piece").alias("entry_piece"))
    entered = held.filter("text is not null").select("part", "no", "piece", "text").join(F.broadcast(entries), "part")
    whole, cut = (entered.mapInArrow(_joined(budget, "\n\n", of), "chunk_no long, part long, place int, no long, piece int, text string") for of in (True, False))
    rest = cut.unionByName(edges.join(numbers.filter(F.col("place") != WHOLE), ["part", "place", "piece"]).select(*cut.columns))
    rest = rest.groupBy("chunk_no").agg(F.array_sort(F.collect_list(F.struct("part", "place", "no", "piece", "text"))).alias("rows"))
    chunks = whole.select("chunk_no", "text").unionByName(rest.select("chunk_no", F.array_join(F.transform("rows", lambda r: r["text"]), "\n\n").alias("text")))
    return chunks.select(F.lit("all").alias("doc_id"), "chunk_no", "text", F.length("text").cast("bigint").alias("tokens"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paragraphs of a part joined until one ends a sentence.

    The first block, if it is not of the first part, the last closed one and what is left open are not rows of their own, as they may belong
    to blocks of other parts; the part's last row has them beside its text.
    """
    part, no, closed, head, last, held, ready = 0, 0, False, None, None, [], []

    def rows(texts: list[str | None], *ends: str | None) -> pa.RecordBatch:
        ends = [[None] * (len(texts) - 1) + [end] for end in ends or (None,) * 3]
        columns = [pa.array([part] * len(texts), pa.int64()), pa.array(range(no, no + len(texts)), pa.int64()), *(pa.array(c, pa.string()) for c in (texts, *ends))]
        return pa.RecordBatch.from_arrays(columns, ["part", "no", "text", "head", "last", "tail"])

    for batch in batches:
        for part, text, ends in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            held.append(text)
            if not ends:
                continue
            block, held = "\n\n".join(held), []
            if part and not closed:
                head = block
            else:
                ready += [] if last is None else [last]
                last = block
            closed = True
        if len(ready) > 1:
            yield rows(ready[:-1])
            no, ready = no + len(ready) - 1, ready[-1:]
    if closed or held:
        yield rows(ready or [None], head, last, "\n\n".join(held) if held else None)


def _joined(budget: int, joiner: str, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Chunks of a part's pieces, which come in order: those that begin and end in it, or the others, of which there are two at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, begun, size, held = None, None, False, 0, []

        def table(found: list[tuple[int, str]]) -> pa.RecordBatch:
            # The one that goes on from another part comes before the one that goes on in another.
            values = [[c for c, _ in found], [part] * len(found), [WHOLE] * len(found), [c for c, _ in found], [0] * len(found), [t for _, t in found]]
            kinds = {"chunk_no": pa.int64(), "part": pa.int64(), "place": pa.int32(), "no": pa.int64(), "piece": pa.int32(), "text": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds.values(), strict=True)], list(kinds))

        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("part", "no", "piece", "text", "chunk", "entry_no", "entry_piece"))
            for part, no, piece, text, first, entry_no, entry_piece in zip(*columns, strict=True):
                chunk = first if chunk is None else chunk
                if size + len(joiner) + len(text) > budget if begun else (no, piece) == (entry_no, entry_piece):
                    if held:
                        found += [(chunk, joiner.join(held))] if begun == whole else []
                        chunk += 1
                    begun, size, held = True, len(text), [text]
                else:
                    size += len(joiner) + len(text)
                    held.append(text)
            yield table(found)
        if held and not whole:
            yield table([(chunk, joiner.join(held))])

    return run


def packed(pieces: DataFrame, order: list[Column], budget: int, joiner: str) -> DataFrame:
    """(chunk_no, text): pieces (text) of one order joined greedily while a chunk has at most ``budget`` characters."""
    numbered = chunk_numbers(pieces.withColumn("n", F.length("text").cast("bigint")), order, budget, len(joiner))
    listed = numbered.groupBy("chunk_no").agg(F.array_sort(F.collect_list(F.struct("_no", "text"))).alias("parts"))
    return listed.select("chunk_no", F.array_join(F.transform("parts", lambda p: p["text"]), joiner).alias("text"))


def chunk_numbers(pieces: DataFrame, order: list[Column], budget: int, gap: int) -> DataFrame:
    """``pieces`` of lengths ``n`` with their numbers (_no), which chunk each is of (chunk_no) and whether it ``begins`` it.

    Pieces are packed greedily, ``gap`` characters apart, while a chunk has at most ``budget``. Where each piece
    begins is a running sum, so that the piece that begins the chunk behind one begun here is
    the first that ends more than a budget further on. Stretches of STRETCH_BUDGETS find, for each piece that
    may be the first to begin a chunk in them, the last one that then does; these links from stretch to
    stretch are walked by pointer doubling from the first piece, which tells each stretch where it begins.
    """
    spark = pieces.sparkSession
    placed = running(pieces, order, {"_at": F.col("n") + gap, "_no": F.lit(1)})
    placed = materialised(spark, placed.withColumn("_stretch", F.floor(F.col("_at") / (STRETCH_BUDGETS * budget)).cast("bigint")))
    sizes = placed.select(F.col("_stretch").alias("stretch"), F.col("_no").alias("no"), F.col("_at").alias("at"), "n")
    ways = materialised(spark, sizes.groupBy("stretch").applyInArrow(_ways(budget, gap), "stretch long, no long, ends long, until long"))
    heads = ways.groupBy("stretch").agg(F.array_sort(F.collect_list(F.struct("ends", "no"))).alias("heads"))
    over = ways.select((F.col("stretch") + 1).alias("stretch"), F.col("no").alias("id"), "until").join(heads, "stretch", "left")
    entered = F.get(F.filter("heads", lambda h: h["ends"] > F.col("until")), F.lit(0))["no"]
    begun = walked(over.select("id", entered.alias("next")), ways.filter("no = 0").select(F.col("no").alias("id"))).select(F.col("id").alias("entry"))
    entries = ways.join(begun, F.col("no") == F.col("entry")).select("stretch", "entry")
    chosen = sizes.groupBy("stretch").cogroup(entries.groupBy("stretch")).applyInArrow(_chosen(budget), "_stretch long, _no long, begins boolean")
    numbered = running(placed.join(chosen, ["_stretch", "_no"]), [F.col("_no")], {"_before": F.col("begins").cast("int")})
    return numbered.withColumn("chunk_no", F.col("_before") + F.col("begins").cast("bigint") - 1)


def _next_begun(pieces: pa.Table, budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers, places and ends of a stretch's pieces, by number, and for each the index of the piece that begins the next chunk if it begins one."""
    no, at, n = (pieces[c].combine_chunks().to_numpy() for c in ("no", "at", "n"))
    order = np.argsort(no)
    no, at, ends = no[order], at[order], (at + n)[order]
    return no, at, ends, np.maximum(np.searchsorted(ends, at + budget, side="right"), np.arange(len(no)) + 1)


def _ways(budget: int, gap: int) -> Callable[[pa.Table], pa.Table]:
    """For each piece that may be the first of a stretch to begin a chunk: where it ends, and until where the last chunk begun in the stretch then reaches."""

    def run(pieces: pa.Table) -> pa.Table:
        no, at, ends, following = _next_begun(pieces, budget)
        last = np.arange(len(no))
        for i in range(len(no) - 1, -1, -1):
            if following[i] < len(no):
                last[i] = last[following[i]]
        heads = np.flatnonzero(at <= at[0] + budget + gap) if no[0] else np.array([0])
        stretch = np.full(len(heads), pieces["stretch"][0].as_py())
        return pa.table({"stretch": stretch, "no": no[heads], "ends": ends[heads], "until": at[last[heads]] + budget})

    return run


def _chosen(budget: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Whether each piece of a stretch begins a chunk, from the first that does."""

    def run(pieces: pa.Table, entry: pa.Table) -> pa.Table:
        no, _, _, following = _next_begun(pieces, budget)
        begins = np.zeros(len(no), bool)
        at = int(np.searchsorted(no, entry["entry"][0].as_py())) if entry.num_rows else len(no)
        while at < len(no):
            begins[at] = True
            at = following[at]
        return pa.table({"_stretch": np.full(len(no), pieces["stretch"][0].as_py()), "_no": no, "begins": begins})

    return run


def combined_corpus(documents: DataFrame, kind: str = "image") -> DataFrame:
    """One document of all texts under headers of their names, by natural name order.

    Meant for a folder of pages of one book: the result is a single text. :func:`combined_chunks` chunks any
    number of texts.
    """
    listed = documents.agg(F.array_sort(F.collect_list(F.struct(natural_key(F.col("name")).alias("k"), "name", headed(kind).alias("t")))).alias("parts"))
    return listed.select(F.lit("all").alias("doc_id"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("text"))
