"""Benchmark items inside documents, by size-partitioned MinHash containment search.

Items are partitioned by size (powers of two of their number of shingles).  An item's sketch is the shingles that
attain its minimum hashes; a document that contains 75 % of an item's shingles contains any one of them with
probability 0.75 or more, however long the document is, so ``hashes`` of them miss it with probability
0.25**hashes (5e-20 at 32).  Items of no more than ``hashes`` shingles are their own sketch.  Only size partitions that
a document is large enough for are searched.  A hit is verified: the item's shingles in the document are counted
exactly.

An item of fewer than five words is one shingle of all its words; documents are asked for their runs of so many words as
well, for each such length that an item has, so short items are found inside longer documents.

Sketches and sets are made by the executors.  While all items have at most ``INDEX_SHINGLES`` shingles they go to the
executors as one index and documents are read once, never shuffled; beyond that, documents' shingles are joined with
the sketches, and candidate pairs with the shingles of both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import NULL_ID, Scratch, WordHashes, chunks, free_name, grams, id_out, shingles, signed, with_ids
from quaystone.llm.minhash_forest import _multipliers

HASHES = 32
#: Shingles of all items, of 8 bytes each, that are sent to the executors at most; shares that a common shingle is dealt over.
INDEX_SHINGLES, SALTS = 8_000_000, 16


def sketch(items: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The items that attain the minima of the hash functions; all, if they are no more than these."""
    if len(items) <= len(multipliers):
        return items
    hashed = items[None, :] * multipliers[:, None]
    hashed ^= hashed >> np.uint64(32)
    return np.unique(items[hashed.argmin(1)])


#: Words of a shingle.
WORDS = 5


def asked_shingles(words: list[bytes], hashes: WordHashes, short: tuple[int, ...]) -> np.ndarray:
    """Sorted distinct hashes of a document's shingles and of its runs of each length in ``short``."""
    own = shingles(words, hashes, WORDS)
    runs = [grams(hashes.of(words), k) for k in short if len(words) > k] if words else []
    return np.unique(np.concatenate([own, *runs])) if runs else own


def _items(batches, hashes: int):
    """item_id, number of words if fewer than a shingle has, n, set and sketch of every item that has words."""
    words, multipliers = WordHashes(), _multipliers(hashes)
    for batch in chunks(batches):
        rows = []
        for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            split = (text or b"").lower().split()
            if len(own := shingles(split, words, WORDS)):
                rows.append((i, min(len(split), WORDS), len(own), signed(own), signed(sketch(own, multipliers))))
        ids, k, n, own, some = zip(*rows, strict=True) if rows else ([],) * 5
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(ids, pa.int64()), "words": pa.array(k, pa.int32()), "n": pa.array(n, pa.int64()), "items": pa.array(own, pa.list_(pa.int64())), "sketch": pa.array(some, pa.list_(pa.int64()))})


class ItemIndex:
    """Sketches by size partition and full shingle sets of items (id, set, sketch)."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], percent: int):
        items = sorted(items, key=lambda x: x[0])
        self.ids = np.array([i for i, *_ in items], np.int64)
        self.sets = [s for _, s, _ in items]
        self.sizes = np.array([len(s) for s in self.sets], np.int64)
        self.needs = -(-percent * self.sizes // 100)  # shingles that make the threshold
        self.partitions = []
        classes = np.floor(np.log2(np.maximum(self.sizes, 1))).astype(int)
        for c in np.unique(classes):
            members = np.flatnonzero(classes == c)
            sketches = [items[m][2] for m in members]
            owner = np.repeat(members, [len(s) for s in sketches])
            values = np.concatenate(sketches)
            order = np.argsort(values, kind="stable")
            self.partitions.append((int(self.needs[members].min()), values[order], owner[order]))

    def search(self, items: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, shingles in common, shingles of the item) for items contained in the sorted set ``items``."""
        found = []
        for least, values, owner in self.partitions:
            if len(items) < least:
                continue  # too small for any item of this size
            at = np.minimum(np.searchsorted(items, values), len(items) - 1)
            for m in np.unique(owner[items[at] == values]):
                own = self.sets[m]
                at_own = np.minimum(np.searchsorted(items, own), len(items) - 1)
                common = int((items[at_own] == own).sum())
                if common >= self.needs[m]:
                    found.append((int(self.ids[m]), common, int(self.sizes[m])))
        return found


def _search(batches, shared, short: tuple[int, ...], hits_only: bool, texts: str = "_bytes"):
    index, words = cloudpickle.loads(shared.value), WordHashes()
    for batch in chunks(batches):
        hits, clean = [], []
        ids = batch.column("doc_id").to_pylist() if hits_only else [None] * batch.num_rows
        for doc, text in zip(ids, batch.column(texts).to_pylist(), strict=True):
            found = index.search(own) if len(own := asked_shingles((text or b"").lower().split(), words, short)) else []
            clean.append(not found)
            hits += [(doc, *x) for x in sorted(found)]
        if not hits_only:
            yield batch.filter(pa.array(clean, pa.bool_())).drop_columns([texts])
        elif hits:
            columns = zip(("doc_id", "item_id", "common", "item_shingles"), zip(*hits, strict=True), strict=True)
            yield pa.RecordBatch.from_pydict({name: pa.array(values, pa.int64()) for name, values in columns})


def _values(batches, short: tuple[int, ...]):
    """doc_id, _h, size of the set, and the set, one shingle a row."""
    words = WordHashes()
    for batch in chunks(batches, 256):
        sets = [asked_shingles((t or b"").lower().split(), words, short) for t in batch.column("_bytes").to_pylist()]
        n = np.array([len(s) for s in sets], np.int64)
        ids, h = (np.repeat(batch.column(c).to_numpy(), n) for c in ("doc_id", "_h"))
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids), "_h": pa.array(h), "size": pa.array(np.repeat(n, n)), "value": pa.array(signed(values))})


def _joined(scratch: Scratch, rows: DataFrame, items: DataFrame, short: tuple[int, ...], percent: int) -> DataFrame:
    """doc_id, _h, key (of the item), common for every pair of a text and an item that it contains, by joins alone."""
    values = scratch.keep(rows.select("doc_id", "_h", "_bytes").mapInArrow(lambda bs: _values(bs, short), "doc_id long, _h long, size long, value long").distinct(), "values")
    need = F.ceil(F.col("n") * percent / 100)
    asked = items.select("key", need.alias("need"), F.explode("sketch").alias("value")).select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = values.withColumn("salt", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(SALTS)).cast("int"))
    pairs = scratch.keep(salted.join(asked.hint("merge"), ["value", "salt"]).where("size >= need").select("doc_id", "_h", "key").distinct(), "pairs")
    wanted = pairs.join(items.select("key", F.explode("items").alias("value")), "key")
    common = wanted.join(values.select("doc_id", "_h", "value"), ["doc_id", "_h", "value"]).groupBy("doc_id", "_h", "key").agg(F.count(F.lit(1)).alias("common"))
    return common.join(items.select("key", "item_id", "n"), "key").where(F.col("common") * 100 >= F.col("n") * percent)


def _prepare(scratch: Scratch, benchmark: DataFrame, hashes: int, percent: int, index_shingles: int):
    """The items as a stored table with a key for each row, the lengths of items shorter than a shingle, and the index of
    the items as a broadcast if it is small enough."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NULL_ID)).alias("item_id"), F.col("text").cast("binary").alias("text"))
    made = rows.mapInArrow(lambda bs: _items(bs, hashes), "item_id long, words int, n long, items array<long>, sketch array<long>")
    items = scratch.keep(made.withColumn("key", F.monotonically_increasing_id()), "items")
    facts = items.agg(F.sum("n").alias("n"), F.sort_array(F.collect_set(F.when(F.col("words") < WORDS, F.col("words")))).alias("short")).first()
    short = tuple(facts["short"])
    if (facts["n"] or 0) > index_shingles:
        return items, short, None
    t = items.select("item_id", "items", "sketch").toArrow()  # bounded by ``index_shingles``
    unsigned = lambda c: [x.values.to_numpy().view(np.uint64) for x in t.column(c)]
    index = ItemIndex(list(zip(t.column("item_id").to_pylist(), unsigned("items"), unsigned("sketch"), strict=True)), percent)
    return items, short, scratch.spark.sparkContext.broadcast(cloudpickle.dumps(index))


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 75, hashes: int = HASHES, index_shingles: int = INDEX_SHINGLES) -> DataFrame:
    """A row for each document and benchmark item whose distinct 5-word shingles it contains to at least ``percent``:
    doc_id, item_id, common, item_shingles, containment.

    A-Z is lower-cased; words are runs of other characters than \\x20 and \\x09-\\x0D.  An item with fewer than five words is one
    shingle, and is contained in a document that has these words in a row.  Null or empty texts and items match nothing.  Repeated rows, of documents or items, give repeated
    rows.  An empty benchmark or an empty table of documents gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    items, short, shared = _prepare(scratch, benchmark, hashes, percent, index_shingles)
    if shared is not None:
        rows = with_ids(docs, F.col("text").cast("binary").alias("_bytes"))
        out = rows.mapInArrow(lambda bs: _search(bs, shared, short, True), "doc_id long, item_id long, common long, item_shingles long")
    else:
        rows = with_ids(docs, F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("_bytes"))
        found = scratch.keep(_joined(scratch, rows, items, short, percent), "found")
        out = rows.select("doc_id", "_h").join(found, ["doc_id", "_h"]).select("doc_id", "item_id", "common", F.col("n").alias("item_shingles"))
    return out.select(id_out(), id_out("item_id"), "common", "item_shingles", (F.col("common") / F.col("item_shingles")).alias("containment"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, percent: int = 75, hashes: int = HASHES, index_shingles: int = INDEX_SHINGLES) -> DataFrame:
    """Rows of ``docs``, all columns, whatever their names, without those that ``contaminated`` marks."""
    scratch = Scratch(docs.sparkSession)
    items, short, shared = _prepare(scratch, benchmark, hashes, percent, index_shingles)
    name, key, h = (free_name(docs.columns, c) for c in ("_bytes", "_key", "_hash"))
    if shared is not None:
        fields = docs.schema
        return docs.withColumn(name, F.col("text").cast("binary")).mapInArrow(lambda bs: _search(bs, shared, short, False, name), fields)
    rows = with_ids(docs, F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("_bytes"))
    found = scratch.keep(_joined(scratch, rows, items, short, percent).select(F.col("doc_id").alias(key), F.col("_h").alias(h)).distinct(), "found")
    match = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)) == found[key]) & (F.xxhash64(docs["text"]) == found[h])
    return docs.join(found.hint("shuffle_hash"), match, "left_anti")
