"""Near duplicates by an LSH forest.

Each document's set of 5-word shingles gets ``trees * depth`` minimum hashes.  Tree t orders the documents by the
signature turned to start at its own ``depth`` values; documents with that prefix in common form a region.  In a region
neighbours of the sorted order, which have the longest prefixes in common, are compared first, then what they leave
apart; documents whose signatures agree in ``loose`` of all places are tied into candidate groups.

The depth adapts by region: documents of a region over ``region_docs`` descend to longer prefixes, in orders of permuted
places of their own, in place of that region; those whose regions are still too large descend again, level by level of
``DESCENT``, with more orders the longer the prefix.  A region that is over the bound at the last level is one candidate
group, whole.  Nothing is cut.  Candidate groups are linked exactly, on full shingle sets (``linking``).

At a similarity of 0.75 the probabilities to miss a pair add up: 3e-8 that no tree holds it, 4e-8 that its signatures
agree in too few places (the same signature serves all trees), and for a pair that meets only in regions over the bound
3e-8 that no order of the first level holds it, 1e-6 at the second.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch, WordHashes, chunks, id_out, mix, salted_left_join, shingles, signed, with_ids
from quaystone.llm.components import connected_components
from quaystone.llm.linking import BLOCK, BLOCK_ITEMS, deal, link_groups
from quaystone.llm.runs import shared_members

TREES, DEPTH = 32, 3
#: Orders and places of their prefixes at each level that the documents of a large region descend to.
DESCENT = ((64, 5), (128, 8))
#: Share of signature places (one byte each) that candidates agree in, at least: 5.7 deviations below 0.75.
LOOSE = 0.5
#: Documents that one task ties at a time.
REGION_DOCS = 2048


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def min_hashes(items: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over the items."""
    best = np.full(len(multipliers), 2**64 - 1, np.uint64)
    for at in range(0, len(items), 4096):
        part = items[None, at : at + 4096] * multipliers[:, None]
        part ^= part >> np.uint64(32)
        np.minimum(best, part.min(1), out=best)
    return best


def _signatures(batches, trees: int, depth: int):
    hashes, multipliers = WordHashes(), _multipliers(trees * depth)
    place = np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for batch in chunks(batches):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            items = shingles((text or b"").lower().split(), hashes)
            if not len(items):
                rows.append((doc, 0, 0, 0, None, None))
                continue
            best = min_hashes(items, multipliers)
            own = best.reshape(trees, depth)
            key = place.copy()
            for j in range(depth):
                key = mix(key ^ own[:, j])
            # the set itself, in 128 bits
            d1, d2 = int(mix(items).sum(dtype=np.uint64)), int(mix(items ^ np.uint64(0x5BF0A8B1457695C3)).sum(dtype=np.uint64))
            rows.append((doc, len(items), d1 - 2**63, d2 - 2**63, signed(key), mix(best).astype(np.uint8).tobytes()))
        doc, n, k1, k2, keys, signature = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(doc, pa.int64()), "n": pa.array(n, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()),
                "keys": pa.array(keys, pa.list_(pa.int64())), "signature": pa.array(signature, pa.binary()),
            }
        )


def _ties(bits: np.ndarray, loose: float) -> list[tuple[int, int]]:
    """A spanning forest of rows that agree in ``loose`` of their places.  Neighbours of the order come first; then every
    row outside the largest group is compared with all others."""
    n, least = len(bits), loose * bits.shape[1]
    near = np.flatnonzero((bits[1:] == bits[:-1]).sum(1) >= least)
    ties = [(int(i), int(i) + 1) for i in near]
    start = np.ones(n, bool)
    start[near + 1] = False
    group = np.cumsum(start) - 1
    done = np.zeros(n, bool)
    while True:
        sizes = np.bincount(group, minlength=n)
        todo = np.flatnonzero(~done & (group != sizes.argmax() if sizes.max() > 1 or done.any() else True))
        if not len(todo):
            return ties
        i = int(todo[0])
        done[i] = True
        near = np.flatnonzero(((bits == bits[i]).sum(1) >= least) & (group != group[i]))
        for g in np.unique(group[near]):
            ties.append((i, int(near[group[near] == g][0])))
            group[group == g] = group[i]


def _regions(batches, loose: float):
    """Ties (a, b) between documents of a region, from rows sorted by (key, signature); a region is bounded."""
    key, docs, bits = None, [], []

    def flush():
        found = _ties(np.frombuffer(b"".join(bits), np.uint8).reshape(len(docs), -1), loose)
        return pa.RecordBatch.from_pydict({"a": pa.array([docs[i] for i, _ in found], pa.int64()), "b": pa.array([docs[j] for _, j in found], pa.int64())})

    for batch in batches:
        for k, doc, signature in zip(batch.column("k1").to_pylist(), batch.column("doc").to_pylist(), batch.column("signature").to_pylist(), strict=True):
            if k != key:
                if len(docs) > 1:
                    yield flush()
                key, docs, bits = k, [], []
            docs.append(doc)
            bits.append(signature)
    if len(docs) > 1:
        yield flush()


def _deeper(batches, orders: int, depth: int, level: int):
    """The keys of a level's orders: the first ``depth`` places of ``orders`` permutations of the signature."""
    picks = None
    place = np.arange(1, orders + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
    for batch in chunks(batches):
        keys = []
        for signature in batch.column("signature").to_pylist():
            bits = np.frombuffer(signature, np.uint8).astype(np.uint64)
            if picks is None:
                r = np.random.RandomState(29 + level)
                picks = np.array([r.permutation(len(bits))[:depth] for _ in range(orders)])
            key = place
            for j in range(picks.shape[1]):
                key = mix(key ^ bits[picks[:, j]])
            keys.append(signed(key))
        yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "keys": pa.array(keys, pa.list_(pa.int64()))})


def _split(scratch: Scratch, name: str, keys: DataFrame, region_docs: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows (k1, doc, first) of regions of two documents or more, from (doc, keys): those within the bound, and those over it."""
    places = scratch.keep(keys.select(F.explode("keys").alias("k1"), F.lit(0).cast("long").alias("k2"), "doc"), f"{name}-places")
    active = shared_members(scratch, f"{name}-active", places).select("k1", "doc", "first")
    over = scratch.keep(active.groupBy("k1").count().where(F.col("count") > region_docs).select("k1", F.lit(True).alias("over")), f"{name}-over")
    if not over.take(1):
        return active, None
    active = scratch.keep(salted_left_join(active, over, "k1", "doc"), f"{name}-split")
    return active.where("over is null").drop("over"), active.where("over").drop("over")


def _tied(rows: DataFrame, signatures: DataFrame, loose: float) -> DataFrame:
    rows = rows.select("k1", "doc").join(signatures, "doc")
    # the key stands for a region's own places; what follows starts at another place in each region
    at = F.pmod(F.col("k1"), F.octet_length("signature")).cast("int")
    turned = F.concat(F.substring("signature", at + 1, F.octet_length("signature")), F.substring("signature", F.lit(1), at))
    rows = rows.select("k1", "doc", turned.alias("signature")).repartition("k1").sortWithinPartitions("k1", "signature", "doc")
    return rows.mapInArrow(lambda bs: _regions(bs, loose), "a long, b long")


def candidate_groups(scratch: Scratch, reps: DataFrame, loose: float = LOOSE, region_docs: int = REGION_DOCS) -> DataFrame:
    """doc, grp for every document tied to another, from a stored table of doc, keys, signature."""
    signatures = reps.select("doc", "signature")
    fit, over = _split(scratch, "trees", reps.select("doc", "keys"), region_docs)
    ties = [_tied(fit, signatures, loose)]
    for level, (orders, depth) in enumerate(DESCENT):
        if over is None:
            break
        deep = signatures.join(over.select("doc").distinct(), "doc", "left_semi")
        deep = deep.mapInArrow(lambda bs, o=orders, d=depth, n=level: _deeper(bs, o, d, n), "doc long, keys array<long>")
        fit, over = _split(scratch, f"level-{level}", deep, region_docs)
        ties.append(_tied(fit, signatures, loose))
    if over is not None:
        ties.append(over.select(F.col("doc").alias("a"), F.col("first").alias("b")))
    every = ties[0]
    for t in ties[1:]:
        every = every.unionByName(t)
    return connected_components(scratch, "candidates", every).select(F.col("node").alias("doc"), F.col("component").alias("grp"))


def _sets(batches):
    hashes = WordHashes()
    for batch in chunks(batches, 256):
        sets = [shingles(t.lower().split(), hashes) for t in batch.column("text").to_pylist()]
        keep = pa.array([len(s) > 0 for s in sets])
        cols = {c: batch.column(c) for c in ("grp", "doc", "block", "blocks")}
        yield pa.RecordBatch.from_pydict(cols | {"n": pa.array([len(s) for s in sets], pa.int64()), "items": pa.array([s.tobytes() for s in sets], pa.binary())}).filter(keep)


def near_duplicates(docs: DataFrame, percent: int = 75, trees: int = TREES, depth: int = DEPTH, region_docs: int = REGION_DOCS, block: int = BLOCK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    A-Z is lower-cased; words are runs of other characters than \\x20 and \\x09-\\x0D; a document's set has its distinct
    5-word shingles (by 64-bit hash), or its whole sequence if it has fewer words.  Documents with
    100 * common >= percent * union are linked; component_id is the smallest doc_id reachable, kept if it is the
    document's own.  Documents without words (null texts too) are linked with nothing.  A null doc_id is smaller than
    any other.  Rows of one doc_id are one document and get the same component; if their texts differ, links of each
    count, and n_shingles is the row's own.
    """
    scratch = Scratch(docs.sparkSession)
    rows = with_ids(docs, F.col("text").cast("binary").alias("text"))
    table = rows.mapInArrow(lambda bs: _signatures(bs, trees, depth), "doc_id long, n long, k1 long, k2 long, keys array<long>, signature binary")
    table = scratch.keep(table, "signatures")
    # equal sets: the smallest document stands for all
    full = table.where("n > 0")
    repeated = bool(full.groupBy("doc_id").count().where("count > 1").take(1))
    same = shared_members(scratch, "same", full.select("k1", "k2", F.col("doc_id").alias("doc")), later_only=True)
    same = scratch.keep(same.select("k1", "k2", F.col("doc").alias("doc_id"), "first").distinct(), "copies")
    # by row: another text under a copy's doc_id keeps its own links
    reps = full.join(same, ["k1", "k2", "doc_id"], "left_anti")
    if repeated:
        reps, rows = reps.dropDuplicates(["k1", "k2", "doc_id"]), rows.dropDuplicates(["doc_id", "text"])
    reps = scratch.keep(reps.select(F.col("doc_id").alias("doc"), "n", "keys", "signature"), "reps")
    groups = scratch.keep(candidate_groups(scratch, reps, LOOSE, region_docs), "groups")
    sized = deal(groups.join(reps.select("doc", "n"), "doc"), "block", block, block_items).select(F.col("doc").alias("doc_id"), "grp", "block", "blocks")
    if repeated:
        sized = sized.distinct()
    texts = rows.where("text is not null").join(sized.hint("shuffle_hash"), "doc_id").withColumnRenamed("doc_id", "doc")
    sets = scratch.keep(texts.mapInArrow(_sets, "grp long, doc long, block int, blocks int, n long, items binary"), "sets")
    linked = link_groups(scratch, sets, percent, block, block_items)
    linked = scratch.keep(linked.groupBy(F.col("doc").alias("first")).agg(F.min("tied").alias("least")), "linked")
    scratch.drop("reps", "groups", "sets")
    copies = same.groupBy("doc_id").agg(F.min("first").alias("first"))
    if repeated:
        # a document with several texts ties what each of them is tied to
        edges = linked.select(F.col("first").alias("a"), F.col("least").alias("b")).unionByName(same.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
        linked = scratch.keep(connected_components(scratch, "texts", edges).select(F.col("node").alias("first"), F.col("component").alias("least")), "linked-texts")
    out = table.select("doc_id", "n").join(copies, "doc_id", "left").withColumn("first", F.coalesce("first", "doc_id"))
    out = salted_left_join(out, linked, "first", "doc_id").withColumn("component", F.coalesce("least", "first"))
    return out.select(id_out(), F.col("n").alias("n_shingles"), id_out("component", "component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
