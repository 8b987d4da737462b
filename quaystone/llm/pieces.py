"""SentencePiece encoding by tables of distinct chunks, and decoding.

A chunk is a run of whitespace markers and what follows up to the next one.  Where no piece of a vocabulary crosses from
other characters to a marker, merges never cross a chunk's edge, so a text's ids are those of its chunks in a row, and
distinct chunks are segmented in place of occurrences:

1. Frequent chunks (found twice or more in a bounded sample of texts, ``TABLE`` at most) are segmented once, by Spark, and
   go to the executors as a table of bounded size.
2. Chunks outside it are rare: a task keeps a table of its own for them, each segmented once where the task first meets
   it.  A chunk that only one text has is so segmented once in all.
3. A text is the numbers of its chunks in both tables, and its ids are taken from the tables by position.

Texts are read once and never shuffled.  Which chunks are in which table changes the work alone, never the ids.
Vocabularies whose pieces do cross markers, or whose normalisation looks beyond a chunk, are encoded by whole texts in
place of chunks, by the same steps.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import chunks, id_out, ranges, with_ids

#: Texts that frequent chunks are looked for in, about; chunks in the table; characters of a chunk in it; at most.
SAMPLE, TABLE, TABLE_CHARS = 50_000, 2**19, 48
#: Distinct chunks of the sample that a task holds before it hands their counts over.
HELD = 150_000
#: Texts and chunks taken at a time; chunks in a task's own table; bytes of ids and decoded text handed over at a time, about.
ROWS, CHUNKS, OWN, BYTES = 256, 20_000, 60_000, 2_000_000
MARKER = "▁"
_RUNS = re.compile(" *[^ ]+| +")
#: Texts whose ids must be those of their chunks, or a model isn't taken to be separable.
_PROBES = ("a b", "a  b", " a", "a ", "  ", "one, two\n three", "éﬁ ½你 好", "x▁y", "\x00 \U0001f600 z")


class Segmenter:
    """A model of the sentencepiece library, from its bytes."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_proto=model)
        one = self.library.encode("a")
        self.lone = self.library.encode("a ")[len(one) :]  # a marker that nothing follows

    def separable(self) -> bool:
        """Whether the ids of a text are those of its chunks."""
        crosses = re.compile(f"[^{MARKER}]{MARKER}")
        if any(crosses.search(self.library.id_to_piece(i)) for i in range(self.library.vocab_size())):
            return False
        return all(sum(self.segment(split(t, True)), []) == self.library.encode(t) for t in _PROBES)

    def segment(self, found: list[str]) -> list[list[int]]:
        """Ids of chunks, each written without its first marker."""
        out = self.library.encode(found, num_threads=1) if found else []
        return [ids if chunk else list(self.lone) for chunk, ids in zip(found, out, strict=True)]


def split(text: str, separable: bool) -> list[str]:
    """Chunks of a text, each without its first marker; a text that is no whitespace-marked sequence is one chunk."""
    if not text:
        return []
    if not separable:
        return [text]
    text = text.replace(MARKER, " ")
    if text[0] == " " or text[-1] == " " or "  " in text:
        return [chunk[1:] for chunk in _RUNS.findall(" " + text)]
    return text.split(" ")


def _frequent(batches, separable: bool):
    """Chunks of a part of the sample with their numbers of occurrences."""

    def rows(n):
        short = [c for c in n if len(c) <= TABLE_CHARS]
        return pa.RecordBatch.from_pydict({"chunk": pa.array(short, pa.string()), "n": pa.array([n[c] for c in short], pa.int64())})

    n: dict[str, int] = {}
    for batch in chunks(batches, ROWS):
        for text in batch.column("text").to_pylist():
            for chunk in split(text, separable):
                n[chunk] = n.get(chunk, 0) + 1
        if len(n) > HELD:
            yield rows(n)
            n = {}
    yield rows(n)


def _segment(batches, model):
    """``chunk`` to its ids."""
    segmenter = Segmenter(model.value)
    for batch in chunks(batches, CHUNKS):
        ids = [np.array(x, np.int32).tobytes() for x in segmenter.segment(batch.column("chunk").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("n"), pa.array(ids, pa.binary())], ["chunk", "n", "ids"])


class _Tables:
    """The shared table of chunks, and one of a task's own that grows behind it."""

    def __init__(self, shared, segmenter: Segmenter):
        self.known, self.flat, self.starts, self.lengths = shared
        self.segmenter, self.shared = segmenter, shared
        self.own: dict[str, int] = {}

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Each text's chunks as numbers in the tables; new ones are segmented, once each."""
        if len(self.own) > OWN:
            self.__init__(self.shared, self.segmenter)
        known, own = self.known, self.own
        new = [c for c in dict.fromkeys(c for found in texts for c in found if c not in known) if c not in own]
        if new:
            own.update(zip(new, range(len(known) + len(own), len(known) + len(own) + len(new)), strict=True))
            ids = self.segmenter.segment(new)
            lengths = np.array([len(x) for x in ids], np.int64)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, np.array([i for x in ids for i in x], np.int32)])
        get = lambda c: i if (i := known.get(c)) is not None else own[c]
        return [np.fromiter(map(get, found), np.int64, len(found)) for found in texts]

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        return self.flat[ranges(self.starts[numbers], self.lengths[numbers])]


def _encode(batches, table, model, separable: bool):
    segmenter = Segmenter(model.value)
    tables = _Tables(table.value, segmenter)
    end = np.array([segmenter.library.eos_id()], np.int32)
    for batch in chunks(batches, ROWS):
        doc_ids, texts = batch.column("doc_id").to_pylist(), [split(t, separable) for t in batch.column("text").to_pylist()]
        out_id, out_ids, out_text, held = [], [], [], 0
        for doc, numbers in zip(doc_ids, tables.numbers(texts), strict=True):
            ids = np.concatenate([tables.ids(numbers), end])
            out_id.append(doc)
            out_ids.append(ids)
            out_text.append(segmenter.library.decode(ids.tolist()))
            held += 4 * len(ids) + len(out_text[-1])
            if held > BYTES:
                yield _rows(out_id, out_ids, out_text)
                out_id, out_ids, out_text, held = [], [], [], 0
        if out_id:
            yield _rows(out_id, out_ids, out_text)


def _rows(doc_ids: list, ids: list, texts: list) -> pa.RecordBatch:
    offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.ListArray.from_arrays(offsets, np.concatenate(ids)), "decoded": pa.array(texts, pa.string())})


def frequent_chunks(docs: DataFrame, model, separable: bool, sample: int = SAMPLE, most: int = TABLE):
    """({chunk: number}, ids in a row, their starts and lengths): at most ``most`` chunks."""
    share = min(1.0, sample / max(docs.count(), 1))
    text = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**40)) < F.lit(int(share * 2**40))).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = text.mapInArrow(lambda bs: _frequent(bs, separable), "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    n = n.where("n > 1").orderBy(F.desc("n"), "chunk").limit(most)
    rows = n.mapInArrow(lambda bs: _segment(bs, model), "chunk string, n long, ids binary").toArrow()  # bounded by ``most`` and TABLE_CHARS
    words, ids = rows.column("chunk").to_pylist(), [np.frombuffer(x.as_py(), np.int32) for x in rows.column("ids")]
    lengths = np.array([len(x) for x in ids], np.int64)
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return dict(zip(words, range(len(words)), strict=True)), flat, np.cumsum(lengths) - lengths, lengths


def encode_pieces(docs: DataFrame, model: str, sample: int = SAMPLE, most: int = TABLE) -> DataFrame:
    """doc_id, ids (array<int>, the end id last), decoded (the library's decoding of the ids) for every row of ``docs``.

    ``model`` is the path of a model file on the driver.  A null text is empty: it has the end id alone and decodes to
    nothing.  A U+2581 in a text is a marker, as in the library, and decodes to a space.  Repeated rows, and rows of a null
    doc_id, are encoded each; a text of any length is one row.  Other columns are ignored.
    """
    spark = docs.sparkSession
    with open(model, "rb") as f:
        proto = f.read()
    separable = Segmenter(proto).separable()
    sent = spark.sparkContext.broadcast(proto)
    table = spark.sparkContext.broadcast(frequent_chunks(docs, sent, separable, sample, most))
    rows = with_ids(docs, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = rows.mapInArrow(lambda bs: _encode(bs, table, sent, separable), "doc_id long, ids array<int>, decoded string")
    return out.select(id_out(), "ids", "decoded")
