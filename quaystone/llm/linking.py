"""Exact links inside candidate groups of any size, by dealt blocks.

Every group is dealt into blocks of bounded size, most groups into one.

1. Each block is linked within.
2. The document of each block that had the most links is compared with every document of its group.
3. What then lies outside its group's largest component is compared with every document of its group.

A document that was compared with its whole group has all its links, so in the end only links inside the largest
component can be unknown, and those change nothing.  Steps 2 and 3 are one job each: a unit of work is a block of such
documents with a block of the group's rows, so no task holds a group.  A group of many documents with few links costs
its size times the number of its documents outside the largest component: spread over all tasks, and never cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch, chunks, ranges, salted_left_join
from quaystone.llm.components import connected_components

#: Documents and shingles of a block, about; an exceeding document is a block's share alone.
BLOCK, BLOCK_ITEMS = 128, 500_000


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, int]:
    """Group number of each set, by exact links of 100 * common >= percent * union, and the set that had the most links
    of those compared.

    A set that is compared with all others has all its links; once those outside the largest group are done, no link
    between groups can be missing."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    items, code = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)[:-1]]
    mark = np.zeros(len(items), np.int32)
    group, done, hub, most = np.arange(n), np.zeros(n, bool), 0, 0
    while True:
        count = np.bincount(group, minlength=n)
        todo = np.flatnonzero(~done & (group != count.argmax() if count.max() > 1 or done.any() else True))
        if not len(todo):
            return group, hub
        i = int(todo[0])
        done[i] = True
        own = code[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[code], starts)
        mark[own] = 0
        link = 100 * common >= percent * (sizes + sizes[i] - common)
        if link.sum() > most:
            hub, most = i, int(link.sum())
        for g in np.unique(group[link & (group != group[i])]):
            group[group == g] = group[i]


def _within(batches, percent: int):
    """doc, tied (the smallest document of its component in the block), hub, from rows sorted by group and block."""
    at, docs, sets = None, [], []

    def flush():
        group, hub = linked(sets, percent)
        seen = {}
        for g, d in zip(group.tolist(), docs, strict=True):  # rows of one doc_id are one document
            if (h := seen.setdefault(d, g)) != g:
                group[group == g] = h
                seen = {x: h if y == g else y for x, y in seen.items()}
        least = {}
        for g, d in zip(group, docs, strict=True):
            least[g] = min(d, least.get(g, d))
        hubs = np.arange(len(docs)) == hub
        return pa.RecordBatch.from_pydict({"doc": pa.array(docs, pa.int64()), "tied": pa.array([least[g] for g in group], pa.int64()), "hub": pa.array(hubs)})

    for batch in chunks(batches, 256):
        for g, b, doc, items in zip(*(batch.column(c).to_pylist() for c in ("grp", "block", "doc", "items")), strict=True):
            if (g, b) != at and docs:
                yield flush()
                docs, sets = [], []
            at = (g, b)
            docs.append(doc)
            sets.append(np.frombuffer(items, np.uint64))
    if docs:
        yield flush()


def _probe(batches, percent: int):
    """Links (a, b) of a unit's rows to its pivots, which come first; pivots that a row ties are tied to each other once."""
    unit, pivots, index, over = None, [], None, {}

    def find(x):
        while over.setdefault(x, x) != x:
            x = over[x]
        return x

    for batch in chunks(batches, 256):
        a, b = [], []
        for g, p, k, row, doc, items in zip(*(batch.column(c).to_pylist() for c in ("grp", "pivots", "block", "is_row", "doc", "items")), strict=True):
            if (g, p, k) != unit:
                unit, pivots, index, over = (g, p, k), [], None, {}
            own = np.frombuffer(items, np.uint64)
            if not row:
                pivots.append((doc, own))
                continue
            if index is None:
                values = np.concatenate([s for _, s in pivots] or [own[:0]])
                owner = np.repeat(np.arange(len(pivots)), [len(s) for _, s in pivots])
                order = np.argsort(values, kind="stable")
                index = values[order], owner[order], np.array([len(s) for _, s in pivots], np.int64)
            values, owner, sizes = index
            lo = np.searchsorted(values, own)
            common = np.bincount(owner[ranges(lo, np.searchsorted(values, own, "right") - lo)], minlength=len(sizes))
            links = [pivots[i][0] for i in np.flatnonzero(100 * common >= percent * (sizes + len(own) - common))]
            links = [d for d in links if d != doc]
            if links:
                a.append(doc)
                b.append(links[0])
            for other in links[1:]:
                if (x := find(links[0])) != (y := find(other)):
                    over[y] = x
                    a.append(other)
                    b.append(links[0])
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def deal(rows: DataFrame, block: str, docs: int, items: int) -> DataFrame:
    """``rows`` (grp, doc, n, ...) with ``block``, and ``block``s, their number in the group."""
    n = F.greatest(F.ceil(F.count(F.lit(1)) / docs), F.ceil(F.sum("n") / items), F.lit(1)).cast("int")
    rows = salted_left_join(rows, rows.groupBy("grp").agg(n.alias(f"{block}s")), "grp", "doc")
    return rows.withColumn(block, F.pmod(F.xxhash64("doc", F.lit(5)), F.col(f"{block}s")).cast("int"))


def _compare(rows: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of pivots (grp, doc, items, pivot, pivots) to all rows (grp, doc, items, block, blocks) of their groups."""
    units = pivots.groupBy("grp").agg(F.max("pivots").alias("_n"))
    blocks = rows.groupBy("grp").agg(F.max("blocks").alias("_n"))
    count = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    every = salted_left_join(rows, units, "grp", "doc").where("_n is not null").select("grp", count.alias("pivots"), "block", F.lit(1).alias("is_row"), "doc", "items")
    some = salted_left_join(pivots, blocks, "grp", "doc").select("grp", F.col("pivot").alias("pivots"), count.alias("block"), F.lit(0).alias("is_row"), "doc", "items")
    dealt = every.unionByName(some).repartition("grp", "pivots", "block").sortWithinPartitions("grp", "pivots", "block", "is_row", "doc")
    return dealt.mapInArrow(lambda bs: _probe(bs, percent), "a long, b long")


def link_groups(scratch: Scratch, rows: DataFrame, percent: int, block: int = BLOCK, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """doc, tied for every row of ``rows``: a stored table of grp, doc, n, items (sorted uint64s), block and blocks as
    ``deal`` gives them.  ``tied`` is the smallest document that links reach from doc inside its group."""
    dealt = rows.select("grp", "block", "doc", "items").repartition("grp", "block").sortWithinPartitions("grp", "block", "doc")
    first = scratch.keep(dealt.mapInArrow(lambda bs: _within(bs, percent), "doc long, tied long, hub boolean"), "within")
    many = rows.where("blocks > 1")
    if not many.take(1):
        return first.select("doc", "tied")
    hubs = first.where("hub").select("doc")
    pivots = deal(many.join(hubs, "doc", "left_semi").select("grp", "doc", "n", "items"), "pivot", block, block_items)
    links = first.select(F.col("doc").alias("a"), F.col("tied").alias("b"))
    large = links.join(many.select(F.col("doc").alias("a")), "a", "left_semi")
    large = scratch.keep(large.unionByName(_compare(many, pivots, percent)), "links-hubs")
    label = connected_components(scratch, "hubs", large)
    label = many.select("grp", "doc").join(label.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    label = scratch.keep(label, "labels")
    largest = label.groupBy("grp", "component").count().groupBy("grp").agg(F.max_by("component", F.struct("count", "component")).alias("top"))
    rest = scratch.keep(salted_left_join(label, largest, "grp", "doc").where("component != top").select("doc"), "rest")
    if rest.take(1):
        pivots = deal(many.join(rest, "doc", "left_semi").select("grp", "doc", "n", "items"), "pivot", block, block_items)
        large = scratch.keep(large.unionByName(_compare(many, pivots, percent)), "links-rest")
    label = connected_components(scratch, "links", large).select(F.col("node").alias("doc"), F.col("component").alias("tied"))
    small = first.join(many.select("doc"), "doc", "left_anti").select("doc", "tied")
    alone = many.select("doc").join(label, "doc", "left_anti").select("doc", F.col("doc").alias("tied"))
    return small.unionByName(label).unionByName(alone)
