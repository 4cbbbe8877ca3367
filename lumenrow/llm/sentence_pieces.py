"""SentencePiece encoding and decoding by tables of distinct chunks.

The library writes a marker for each space and one before the text. Where no piece of the vocabulary has a
marker behind another sign, no merge crosses from a sign to the marker after it, so that each chunk, a run of
markers and the signs up to the next, is segmented alike wherever it stands. A block of texts is cut into
chunks, the distinct ones that the table lacks are segmented once by the library, and the ids of all are
joined back by position with one gather. Under a vocabulary of other kind whole texts are segmented.

A table serves the blocks of a worker until it holds ``MOST_CHUNKS``; one table for the whole corpus would
move a row for each occurrence of a word twice, several times the input, and give the same ids.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrow.llm.common import in_slices, table

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
#: A table is begun anew beyond so many chunks, or characters in them; texts are cut at chunks into stretches of about so many characters,
#: and a block holds stretches of as many.
MOST_CHUNKS, MOST_CHARS, STRETCH = 200_000, 1 << 24, 1 << 19

_CHUNK = re.compile(f"[ {MARKER}]+[^ {MARKER}]*")
_BORDER = re.compile(f"(?<=[^ {MARKER}])[ {MARKER}]")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkTable:
    """Ids of texts under one model, with those of the distinct chunks seen."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        marked = all(MARKER not in piece.lstrip(MARKER) for piece in pieces)
        self.apart = marked and MARKER in pieces and self.model.normalize("  a ﬁ b ") == f"{MARKER * 3}a ﬁ{MARKER}b{MARKER}"
        self.lone = [self.model.piece_to_id(MARKER)]
        self.segmented = 0
        self._begin()

    def _begin(self) -> None:
        self.codes: dict[str, int] = {}
        self.ids, self.sizes, self.chars = np.empty(0, np.int32), np.empty(0, np.int64), 0

    def _learn(self, chunks: list[str]) -> None:
        """Segment ``chunks``, which the table lacks. The library puts the first marker itself, but not before nothing."""
        rest = [chunk[1:] for chunk in chunks]
        found = [ids if text else self.lone for text, ids in zip(rest, self.model.encode(rest, num_threads=1), strict=True)]
        self.codes.update(zip(chunks, range(len(self.codes), len(self.codes) + len(chunks)), strict=True))
        self.sizes = np.append(self.sizes, np.fromiter(map(len, found), np.int64, len(found)))
        self.ids = np.append(self.ids, np.fromiter(itertools.chain.from_iterable(found), np.int32))
        self.chars += sum(map(len, chunks))
        self.segmented += len(chunks)

    def _block(self, stretches: list[str]) -> list[bytes]:
        """The ids of each of ``stretches``, which begin with a marker, as little-endian unsigned 32-bit numbers."""
        found = [_CHUNK.findall(stretch) for stretch in stretches]
        flat = list(itertools.chain.from_iterable(found))
        if new := set(flat).difference(self.codes):
            self._learn(list(new))
        codes = np.fromiter(map(self.codes.__getitem__, flat), np.int64, len(flat))
        sizes = self.sizes[codes]
        ends = np.cumsum(sizes)
        first = np.cumsum(self.sizes) - self.sizes
        ids = self.ids[np.repeat(first[codes] - ends + sizes, sizes) + np.arange(sizes.sum())].astype("<u4")
        last = np.append(0, ends)[np.cumsum([len(chunks) for chunks in found])]
        if len(self.codes) > MOST_CHUNKS or self.chars > MOST_CHARS:
            self._begin()
        return [ids[a:b].tobytes() for a, b in zip([0, *last[:-1]], last, strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, begin and end ids too, as little-endian unsigned 32-bit numbers."""
        begin, end = (np.array([i], "<u4").tobytes() for i in (self.model.bos_id(), self.model.eos_id()))
        if not self.apart:
            return [begin + np.array(ids, "<u4").tobytes() + end for ids in self.model.encode(texts, num_threads=1)]
        out: list[list[bytes]] = [[] for _ in texts]
        block, owners, held = [], [], 0
        for k, text in enumerate(texts):
            for stretch in stretches_of(f" {text}") if text else ():
                block.append(stretch)
                owners.append(k)
                held += len(stretch)
                if held >= STRETCH:
                    for owner, ids in zip(owners, self._block(block), strict=True):
                        out[owner].append(ids)
                    block, owners, held = [], [], 0
        if block:
            for owner, ids in zip(owners, self._block(block), strict=True):
                out[owner].append(ids)
        return [b"".join([begin, *parts, end]) for parts in out]

    def decode(self, ids: bytes) -> str:
        """The library's text of ``ids``."""
        return self.model.decode(np.frombuffer(ids, "<u4").tolist())


def stretches_of(text: str) -> Iterator[str]:
    """``text`` in parts of about STRETCH characters, each of whole chunks."""
    start = 0
    while len(text) - start > STRETCH and (border := _BORDER.search(text, start + STRETCH)):
        yield text[start : border.start()]
        start = border.start()
    yield text[start:]


@functools.cache
def _chunk_table(path: str) -> ChunkTable:
    return ChunkTable(path)


def _in_worker(path: str | None, work: Callable[[ChunkTable, list], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """A function of an Arrow array that applies ``work`` to few values at a time with the worker's table."""

    def run(values: pa.Array) -> pa.Array:
        chunk_table = _chunk_table(path or model_path())
        parts = in_slices([pa.RecordBatch.from_arrays([values], ["x"])])
        return pa.concat_arrays([work(chunk_table, part["x"].to_pylist()) for part in parts] or [work(chunk_table, [])])

    return run


def pieces_of(text: Column, path: str | None = None, decode: bool = False) -> Column:
    """A struct of the ids of ``text`` with begin and end ids, as little-endian unsigned 32-bit numbers, and of what they decode to if ``decode``.

    A null text is an empty one. Both come from one worker, which then need not be sent the ids.
    """

    def work(chunk_table: ChunkTable, texts: list[str]) -> pa.Array:
        ids = chunk_table.encode(texts)
        decoded = [chunk_table.decode(x) if decode else None for x in ids]
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["ids", "decoded"])

    def run(texts: pa.Array) -> pa.Array:
        return _in_worker(path, work)(texts)

    return F.arrow_udf(run, "struct<ids:binary,decoded:string>")(F.coalesce(text, F.lit("")))


def text_of(ids: Column, path: str | None = None) -> Column:
    """The text that the library decodes ``ids`` to."""

    def run(values: pa.Array) -> pa.Array:
        return _in_worker(path, lambda chunk_table, each: pa.array([chunk_table.decode(x) for x in each], pa.string()))(values)

    return F.arrow_udf(run, "string")(ids)


def encode(docs: DataFrame, path: str | None = None, decode: bool = False) -> DataFrame:
    """(doc, ids) of every row of ``docs``, and ``decoded`` if ``decode``: the row as a struct, and what :func:`pieces_of` gives for its whole text.

    Null and empty texts are begin and end id alone. Texts of any length are cut into chunks a stretch at a
    time. Repeated rows and ids are encoded like any others; columns of any name stay in ``doc``; an empty
    table gives no rows. ``path`` of the model is looked up on each executor unless given.
    """
    rows = docs.select(F.struct("*").alias("doc")).withColumn("pieces", pieces_of(F.col("doc.text"), path, decode))
    return rows.select("doc", "pieces.ids", *(["pieces.decoded"] if decode else []))


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ids."""
    return encoded.withColumn("decoded", text_of(F.col("ids"), path))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of :func:`encode` and :func:`decode` over all documents."""
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), decode=True)
    return rows.select(
        F.col("doc.doc_id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
