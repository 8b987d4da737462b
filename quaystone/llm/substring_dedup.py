"""Repeated passages by a log-structured index of window fingerprints.

A window is ``window`` consecutive words.  Of the ``window - gram + 1`` hashed word grams in a window the smallest is
its fingerprint (winnowing), so equal windows have equal fingerprints and neighbouring windows mostly share theirs:
the index holds about one entry for twenty words, and loses no repeat.

``FingerprintLog`` keeps sorted immutable runs of (fingerprint, document) of past batches, bucketed by fingerprint with
bounds that never change, so a new batch is dealt to the buckets and merge-joined with each run where the run lies.  Runs
are compacted, ``COMPACT`` at a time, into one; at a path they are there for a later session.

Documents that share a fingerprint are candidates.  Candidates are verified: every one of their windows under a shared
fingerprint is hashed in 128 bits (of 64-bit word hashes), and the windows of equal hash are found in a second sorted
merge.  A document then looks its windows up in its own list by the first 64 of these bits.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import NULL_ID, Scratch, WordHashes, children, chunks, grams, id_out, signed, with_ids
from quaystone.llm.runs import shared_members

GRAM = 8
#: Shares that one fingerprint's documents are dealt over, and runs that are compacted into one.
SALTS, COMPACT = 16, 4
SECOND = np.uint64(0xA24BAED4963EE407)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    if len(h) < width:
        return h[:0]
    size, m = 1, h
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - size :][: len(h) - width + 1])


def fingerprints(h: np.ndarray, window: int) -> np.ndarray:
    """The fingerprint of every window of a document, from its word hashes."""
    gram = min(GRAM, window)
    return _sliding_min(grams(h, gram), window - gram + 1) if len(h) >= window else np.zeros(0, np.uint64)


def _survey(batches, window: int, with_text: bool):
    hashes = WordHashes()
    for batch in chunks(batches):
        rows = []
        for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
            words = (text or b"").split()
            prints = np.unique(fingerprints(hashes.of(words), window)) if len(words) >= window else np.zeros(0, np.uint64)
            plain = b" ".join(words)
            digest = hashlib.sha256(plain)
            k = np.frombuffer(digest.digest()[:16], np.int64)
            rows.append((doc, h, len(words), digest.hexdigest(), int(k[0]), int(k[1]), signed(prints), plain if with_text else None))
        doc, h, n, sha, k1, k2, prints, plain = zip(*rows, strict=True)
        yield pa.RecordBatch.from_pydict(
            {"doc_id": pa.array(doc, pa.int64()), "h": pa.array(h, pa.int64()), "n_words": pa.array(n, pa.int64()), "sha": pa.array(sha, pa.string()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64()), "prints": pa.array(prints, pa.list_(pa.int64())), "plain": pa.array(plain, pa.binary())}
        )


def _windows(batches, window: int):
    """128-bit hashes of the distinct windows whose fingerprint is shared."""
    hashes = WordHashes()
    for batch in chunks(batches, 256):
        k1, k2, docs = [], [], []
        for doc, text, shared in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("shared"), strict=True):
            h = hashes.of(text.split())
            at = np.isin(fingerprints(h, window), shared.values.to_numpy().view(np.uint64))
            both = np.stack([grams(h, window)[at], grams(h, window, SECOND)[at]], 1)
            both = np.unique(both, axis=0) if len(both) > 1 else both
            k1.append(both[:, 0])
            k2.append(both[:, 1])
            docs.append(np.full(len(both), doc, np.int64))
        if k1:
            yield pa.RecordBatch.from_pydict({"k1": pa.array(signed(np.concatenate(k1))), "k2": pa.array(signed(np.concatenate(k2))), "doc": pa.array(np.concatenate(docs))})


def _cover(batches, window: int, with_text: bool):
    hashes = WordHashes()
    for batch in chunks(batches, 256):
        rows = []
        for doc, key, text, seen in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), batch.column("seen"), strict=True):
            words = text.split()
            at = np.isin(grams(hashes.of(words), window), seen.values.to_numpy().view(np.uint64))
            edges = np.zeros(len(words) + 1, np.int32)
            starts = np.flatnonzero(at)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + window, -1)
            gone = np.cumsum(edges[:-1]) > 0
            kept = b" ".join([w for w, g in zip(words, gone, strict=True) if not g])
            rows.append((doc, key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept))
        doc, key, n, sha, kept = zip(*rows, strict=True) if rows else ([],) * 5
        cols = {"doc_id": pa.array(doc, pa.int64()), "h": pa.array(key, pa.int64()), "n_removed": pa.array(n, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        yield pa.RecordBatch.from_pydict(cols | ({"kept": pa.array(kept, pa.binary())} if with_text else {}))


class FingerprintLog:
    """Sorted immutable runs of (k1 = fingerprint, salt, doc) as bucketed tables in a folder shared by the cluster.

    With a ``path`` the runs are there, and a later session that names the same path goes on with them; without one they
    are scratch of this object.  One session at a time may write a path.  A new run has ``buckets`` buckets, as many as the
    session has shuffle partitions if none are given; a run keeps its own number.
    """

    def __init__(self, scratch: Scratch, path: str | None = None, buckets: int | None = None):
        self.scratch, self.spark = scratch, scratch.spark
        self.buckets = buckets or int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
        self.path = path or f"{scratch.base}/log"
        self.runs = {name: self._open(name) for name in children(self.spark, self.path) if name.startswith("run-")}

    def _open(self, name: str) -> str:
        """The run as a table of this session's catalog."""
        table, buckets = f"quaystone_{uuid.uuid4().hex}", name.split("-")[2]
        self.spark.sql(f"CREATE TABLE {table} (k1 BIGINT, salt INT, doc BIGINT) USING parquet CLUSTERED BY (k1, salt) SORTED BY (k1, salt, doc) INTO {buckets} BUCKETS LOCATION '{self.path}/{name}'")
        return table

    def _append(self, rows: DataFrame) -> None:
        name = f"run-{max((int(n.split('-')[1]) for n in self.runs), default=0) + 1:08d}-{self.buckets}"
        table = self._open(name)
        rows.repartition(self.buckets, "k1", "salt").write.insertInto(table)
        self.runs[name] = table

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {self.runs.pop(name)}")
            self.scratch.remove(f"{self.path}/{name}")

    def table(self) -> DataFrame:
        """All runs."""
        out = self.spark.createDataFrame([], "k1 long, salt int, doc long")
        for t in self.runs.values():
            out = out.unionByName(self.spark.table(t))
        return out

    def judged(self) -> DataFrame | None:
        """doc_id, h of every row that entered the log, with or without a window of its own; None before the first."""
        if "judged" not in children(self.spark, self.path):
            return None
        return self.spark.read.schema("doc_id long, h long").parquet(f"{self.path}/judged")

    def mark(self, rows: DataFrame) -> None:
        """These rows (doc_id, h) are in the log now.  Their run is there before, so a batch that failed in between is
        taken anew, and its fingerprints twice, which changes nothing."""
        rows.select("doc_id", "h").write.mode("append").parquet(f"{self.path}/judged")

    def later_holders(self, batch: DataFrame, label: str) -> DataFrame:
        """Past documents (doc) that share a fingerprint with a smaller document of the batch (k1, doc)."""
        least = batch.groupBy("k1").agg(F.min("doc").alias("least"))
        keys = least.select("k1", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        keys, out = self.scratch.keep(keys, f"least-{label}"), None
        for t in self.runs.values():
            found = self.spark.table(t).join(keys.hint("merge"), ["k1", "salt"]).where("doc > least").select("doc")
            out = found if out is None else out.unionByName(found)
        return self.scratch.keep((out if out is not None else batch.where("false")).select("doc").distinct(), f"again-{label}")

    def merge(self, batch: DataFrame, label: str, again: DataFrame | None = None) -> DataFrame:
        """Adds a batch (k1, doc), a stored table, as a new run; rows (doc, k1) of fingerprints that it shares within
        itself or with past runs, past documents included.  ``again`` has rows of past documents, which are looked up as
        the batch's are and not added."""
        added, batch = batch, batch if again is None else self.scratch.keep(batch.unionByName(again), f"asked-{label}")
        own = batch.select("k1", F.lit(0).cast("long").alias("k2"), "doc")
        shared = shared_members(self.scratch, f"merged-{label}", own).select("doc", "k1")
        if self.runs:
            # the batch's distinct fingerprints go to the buckets of the runs; a run is neither moved nor sorted
            keys = batch.select("k1").distinct().select("k1", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            keys = self.scratch.keep(keys, f"keys-{label}")
            past = None
            for t in self.runs.values():
                found = self.holders(t, keys)
                past = found if past is None else past.unionByName(found)
            past = self.scratch.keep(past, f"past-{label}")
            known = past.select("k1").distinct()
            known = known.select("k1", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            asked = self.salted(batch).join(known.hint("merge"), ["k1", "salt"], "left_semi").select("doc", "k1")
            shared = shared.unionByName(past).unionByName(asked)
        self._append(self.salted(added))
        if len(self.runs) >= COMPACT:
            self.compact()
        return shared

    def holders(self, table: str, keys: DataFrame) -> DataFrame:
        """Rows (doc, k1) of a run whose (k1, salt) is among ``keys``: a merge join in the run's buckets."""
        return self.spark.table(table).join(keys.hint("merge"), ["k1", "salt"], "left_semi").select("doc", "k1")

    @staticmethod
    def salted(batch: DataFrame) -> DataFrame:
        return batch.select("k1", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"), "doc")

    def compact(self) -> None:
        """One run in place of all; the next batch is merged with it."""
        old = list(self.runs)
        self._append(self.table())
        self._forget(old)

    def detach(self) -> None:
        """Takes the runs' tables out of this session's catalog; their files stay for a later one."""
        for name in list(self.runs):
            self.spark.sql(f"DROP TABLE {self.runs.pop(name)}")

    def close(self) -> None:
        """Removes the runs."""
        self._forget(list(self.runs))


def substring_dedup(docs: DataFrame, window: int = 50, batches: int = 2, with_text: bool = False, log: FingerprintLog | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept text) for every row of ``docs``.

    Words are runs of other characters than \\x20 and \\x09-\\x0D, unchanged; a null text has none.  Each word covered by
    a window that also starts in a document with a smaller doc_id is removed; windows within one document alone are no
    repeats.  A null doc_id is smaller than any other.  Repeated rows of one doc_id are one document; rows of one
    doc_id with different texts are each judged by their own windows.  The table enters the index in ``batches`` parts by doc_id.

    With a ``log``, rows that it holds are known by doc_id and text, so batches come in any order of ids.  New rows are
    fingerprinted, judged and returned; so are past rows whose windows may also start in a smaller new document, with their
    verdict of now.  The latest verdicts of all rows are those of one run over the whole table.  ``docs`` still has the
    earlier rows, whose texts are read where a fingerprint is shared.
    """
    scratch = Scratch(docs.sparkSession)
    own, log = log is None, log or FingerprintLog(scratch)
    past = log.judged()
    rows = with_ids(docs, F.xxhash64("text").alias("h"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    new = rows if past is None else rows.join(past.distinct().hint("shuffle_hash"), ["doc_id", "h"], "left_anti")
    survey_of = lambda r: r.mapInArrow(lambda bs: _survey(bs, window, with_text), "doc_id long, h long, n_words long, sha string, k1 long, k2 long, prints array<long>, plain binary")
    survey = fresh = scratch.keep(survey_of(new), "survey")
    prints_of = lambda r: r.select(F.explode("prints").alias("k1"), F.col("doc_id").alias("doc")).distinct()
    again = None
    if past is not None:
        late = log.later_holders(scratch.keep(prints_of(fresh), "fresh"), "late")
        back = rows.join(late.select(F.col("doc").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi").join(past.distinct().hint("shuffle_hash"), ["doc_id", "h"], "left_semi")
        back = scratch.keep(survey_of(back), "back")
        again = scratch.keep(prints_of(back), "again")
        survey = fresh.unionByName(back)
    # copies of a whole text: the first stands for all; every window of a later one starts in the first
    whole = survey.where(F.col("n_words") >= window).select("k1", "k2", F.col("doc_id").alias("doc"), "h")
    copies = shared_members(scratch, "copies", whole, payload=("h",), later_only=True).select(F.col("doc").alias("doc_id"), "h").distinct()
    copies = scratch.keep(copies, "later")
    firsts = fresh.join(copies, ["doc_id", "h"], "left_anti")
    prints = scratch.keep(prints_of(firsts), "prints")
    span = fresh.agg(F.min(F.when(F.col("doc_id") > NULL_ID, F.col("doc_id"))), F.max("doc_id")).first()
    lo, hi = (span[0] or 0), (span[1] or 0)
    shared = None
    bounds = [lo + (hi + 1 - lo) * b // batches for b in range(1, batches)]
    for b in range(batches):
        part = prints
        if b:
            part = part.where(F.col("doc") >= bounds[b - 1])
        if b < batches - 1:
            part = part.where(F.col("doc") < bounds[b])
        # past documents are looked up once all new ones are in the log
        found = log.merge(part, str(b), again if b == batches - 1 else None)
        shared = found if shared is None else shared.unionByName(found)
    shared = shared.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("k1").alias("shared"))
    suspects = scratch.keep(rows.join(shared.hint("shuffle_hash"), "doc_id"), "suspects")
    scratch.drop(*(f"{t}-{b}" for t in ("merged", "asked", "keys", "past") for b in range(batches)), "copies", "prints", "fresh", "again")
    if own:
        log.close()
    else:
        log.mark(fresh)
    windows = suspects.mapInArrow(lambda bs: _windows(bs, window), "k1 long, k2 long, doc long")
    windows = scratch.keep(windows, "windows")
    seen = shared_members(scratch, "seen", windows, later_only=True)
    scratch.drop("windows")
    seen = seen.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_set("k1").alias("seen"))
    fields = "doc_id long, h long, n_removed long, kept_sha256 string" + ", kept binary" * with_text
    covered = suspects.join(seen.hint("shuffle_hash"), "doc_id").mapInArrow(lambda bs: _cover(bs, window, with_text), fields)
    # repeated rows have one verdict
    covered = scratch.keep(covered.dropDuplicates(["doc_id", "h"]), "covered")
    gone = copies.select("doc_id", "h", F.lit(True).alias("_copy"))
    out = survey.select("doc_id", "h", "n_words", "sha", "plain").join(covered, ["doc_id", "h"], "left").join(gone, ["doc_id", "h"], "left")
    columns = [
        id_out(),
        "n_words",
        F.when(F.col("_copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("_copy"), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    ]
    if with_text:
        columns.append(F.when(F.col("_copy"), F.lit("")).otherwise(F.coalesce("kept", "plain").cast("string")).alias("kept"))
    return out.select(columns)
