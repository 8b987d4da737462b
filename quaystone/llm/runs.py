"""Members of shared keys, by sorted runs.

Rows (k1, k2, doc) are range-partitioned and sorted by all three, so a key that holds a third of the rows is spread
over many tasks.  Each task streams its rows and knows the runs that lie wholly inside it; of its first and last run
it returns a summary, and the few summaries (two for each task) decide the runs that cross tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch

MEMBER, UNDECIDED, SUMMARY = 0, 1, 2
#: Rows of a run that a task holds while it has too few documents; a longer run is decided by its summary.
HELD_ROWS = 50_000


def _stream(batches, min_docs: int, payload: list[str], later_only: bool):
    """Yields member, undecided and summary rows of one sorted partition."""
    open_key = None  # of the run that the next batch may continue
    first_doc = last_doc = n_docs = 0
    is_first, held = True, []  # held: rows of the open run while it has under min_docs documents

    def table(batch, keep, first, kind, n=0):
        part = batch.filter(pa.array(keep)) if keep is not None else batch
        size = part.num_rows
        as_col = lambda v, t: pa.array(np.broadcast_to(np.asarray(v, t), (size,)))
        firsts = first[keep] if isinstance(first, np.ndarray) and keep is not None else first
        cols = {name: part.column(name) for name in ["k1", "k2", "doc", *payload]}
        cols |= {"first": as_col(firsts, np.int64), "kind": as_col(kind, np.int32), "n": as_col(n, np.int64)}
        return pa.RecordBatch.from_pydict(cols)

    def summary(key, first, n):
        cols = {"k1": pa.array([key[0]], pa.int64()), "k2": pa.array([key[1]], pa.int64()), "doc": pa.array([first], pa.int64())}
        cols |= {p: pa.nulls(1, types[p]) for p in payload}
        cols |= {"first": pa.array([first], pa.int64()), "kind": pa.array([SUMMARY], pa.int32()), "n": pa.array([n], pa.int64())}
        return pa.RecordBatch.from_pydict(cols)

    types = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        types = types or {p: batch.schema.field(p).type for p in payload}
        k1, k2, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k1", "k2", "doc"))
        starts = np.flatnonzero(np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        ends = np.r_[starts[1:], len(k1)]
        new_doc = np.r_[True, doc[1:] != doc[:-1]]
        new_doc[starts] = True
        docs_in = np.add.reduceat(new_doc.astype(np.int64), starts)
        firsts = doc[starts]
        begin = 0
        if open_key is not None and open_key == (k1[0], k2[0]):
            begin = 1
            piece = batch.slice(0, ends[0])
            before = n_docs
            n_docs += int(docs_in[0]) - int(doc[0] == last_doc)
            last_doc = int(doc[ends[0] - 1])
            if is_first:
                yield table(piece, None, first_doc, UNDECIDED)
            elif n_docs >= min_docs:
                if before < min_docs:
                    for b in held:
                        yield from _later(table(b, None, first_doc, MEMBER), later_only)
                    held = []
                yield from _later(table(piece, None, first_doc, MEMBER), later_only)
            else:
                held.append(piece)
                if sum(b.num_rows for b in held) > HELD_ROWS:  # one document may repeat a key any number of times
                    for b in held:
                        yield table(b, None, first_doc, UNDECIDED)
                    is_first, held = True, []
        if begin == len(starts):
            continue
        if open_key is not None:  # the open run is closed
            if is_first:
                yield summary(open_key, first_doc, n_docs)
            is_first, held = False, []
        # runs that begin and end in this batch
        lo = begin
        if open_key is None:  # the first run of the partition
            lo = begin + 1
            piece = batch.slice(0, ends[0])
            yield table(piece, None, int(firsts[0]), UNDECIDED)
            if len(starts) > 1:
                yield summary((k1[0], k2[0]), int(firsts[0]), int(docs_in[0]))
                is_first = False
        hi = len(starts) - 1
        if hi > lo:
            ok = docs_in[lo:hi] >= min_docs
            length = (ends - starts)[lo:hi]
            keep = np.zeros(len(k1), bool)
            keep[starts[lo] : ends[hi - 1]] = np.repeat(ok, length)
            row_first = np.zeros(len(k1), np.int64)
            row_first[starts[lo] : ends[hi - 1]] = np.repeat(firsts[lo:hi], length)
            if later_only:
                keep &= doc > row_first
            if keep.any():
                yield table(batch, keep, row_first, MEMBER)
        # the last run stays open
        open_key = (int(k1[-1]), int(k2[-1]))
        first_doc, last_doc, n_docs = int(firsts[hi]), int(doc[-1]), int(docs_in[hi])
        if hi >= lo:
            piece = batch.slice(starts[hi], ends[hi] - starts[hi])
            if n_docs >= min_docs:
                yield from _later(table(piece, None, first_doc, MEMBER), later_only)
            else:
                held = [piece]
    if open_key is not None:
        for b in held:
            yield table(b, None, first_doc, UNDECIDED)
        yield summary(open_key, first_doc, n_docs)


def _later(batch, later_only):
    if later_only:
        batch = batch.filter(pa.array(batch.column("doc").to_numpy() > batch.column("first").to_numpy()))
    if batch.num_rows:
        yield batch


def shared_members(scratch: Scratch, name: str, rows: DataFrame, min_docs: int = 2, payload: tuple[str, ...] = (), later_only: bool = False, then: tuple[str, ...] = ()) -> DataFrame:
    """Rows of keys (k1, k2) that occur in at least ``min_docs`` different documents, with ``first``, the smallest
    document of the key.  ``later_only`` leaves out the rows of that document.  ``rows`` has non-null longs k1, k2 and
    doc, and the payload; rows of a document come in the order of the columns ``then``.  It is read twice (range bounds
    come from a sample), so pass a stored table."""
    payload = list(payload)
    rows = rows.select("k1", "k2", "doc", *payload, *then)
    # no number of partitions: Spark joins neighbouring small ones
    ordered = rows.repartitionByRange("k1", "k2", "doc").sortWithinPartitions("k1", "k2", "doc", *then)
    fields = ", ".join(f"{c} {t}" for c, t in rows.dtypes if c not in then) + ", first long, kind int, n long"
    out = scratch.keep(ordered.mapInArrow(lambda bs: _stream(bs, min_docs, payload, later_only), fields), name)
    whole = out.where(F.col("kind") == SUMMARY).groupBy("k1", "k2").agg(F.min("first").alias("_first"), F.sum("n").alias("_n")).where(F.col("_n") >= min_docs)
    # at most two summaries for each task of the shuffle: bounded by the number of partitions, not by rows
    late = out.where(F.col("kind") == UNDECIDED).drop("first").join(F.broadcast(whole), ["k1", "k2"]).withColumnRenamed("_first", "first")
    columns = ["k1", "k2", "doc", *payload, "first"]
    late = late.where(F.col("doc") > F.col("first")) if later_only else late
    return out.where(F.col("kind") == MEMBER).select(columns).unionByName(late.select(columns))
