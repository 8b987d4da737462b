"""Secrets in versioned texts, by an incremental blob ledger.

Every version of every path is addressed by its content.  The ledger knows which (blob, rule version) pairs have been
scanned and what was found; a run scans only unseen pairs and joins the findings of all blobs back to all paths.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch, children, chunks, id_out, salted_left_join, with_ids

#: Pattern, group whose length counts, least length; in the order in which kinds are listed.
RULES = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.IGNORECASE),
    "access": (r"AKIA[A-Z0-9]+", 0, 20, 0),
    "hex": (r"[0-9a-f]+", 0, 24, 0),
    "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, 0),
}
BASE = ("assign", "access", "hex")
RULE_VERSIONS = {"assign": 1, "access": 1, "hex": 1, "pem": 1}
#: Unseen blobs, of about 150 bytes each, that are sent to the texts at most.
FEW = 10_000
_COMPILED = {k: (re.compile(p, f | re.ASCII), g, n) for k, (p, g, n, f) in RULES.items()}


def find_spans(text: str, kinds: tuple[str, ...] = tuple(RULES)) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; leftmost non-overlapping per kind, code points."""
    order = {k: i for i, k in enumerate(RULES)}
    found = []
    for kind in kinds:
        pattern, group, least = _COMPILED[kind]
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda x: (x[0], order[x[2]]))


def _scan(batches):
    for batch in chunks(batches):
        blobs, spans, rules = [], [], []
        for blob, text, want in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True):
            # the row says which versions it wants of which kinds
            version = {k: int(v) for k, v in (w.split(":") for w in want)}
            blobs.append(blob)
            rules.append(sorted(want))
            spans.append([{"start": a, "end": b, "kind": k, "version": version[k]} for a, b, k in find_spans(text, tuple(k for k in RULES if k in version))])
        span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("version", pa.int64())])
        yield pa.RecordBatch.from_pydict({"blob": pa.array(blobs, pa.string()), "rules": pa.array(rules, pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(span))})


class BlobLedger:
    """blob, rules (kind:version scanned), spans (each with its rule's version); append-only parquet in a shared folder.

    With a ``path`` the ledger is there, and a later run that names the same path goes on with it; without one it is a
    scratch table of this object.  One run at a time may update a path.
    """

    SPANS = "array<struct<start: long, end: long, kind: string, version: long>>"
    SCHEMA = f"blob string, rules array<string>, spans {SPANS}"

    def __init__(self, scratch: Scratch, path: str | None = None):
        self.scratch, self.path, self.parts, self.runs, self.rules = scratch, path, [], 0, dict(RULE_VERSIONS)
        if path and children(scratch.spark, path):
            self.parts = [self._stored()]

    def _stored(self) -> DataFrame:
        return self.scratch.spark.read.schema(self.SCHEMA).parquet(self.path)

    def _append(self, rows: DataFrame) -> None:
        if self.path:
            rows.write.mode("append").parquet(self.path)
            self.parts = [self._stored()]
        else:
            self.parts.append(self.scratch.keep(rows, f"ledger{self.runs}"))

    def table(self) -> DataFrame:
        out = self.scratch.spark.createDataFrame([], self.SCHEMA)
        for p in self.parts:
            out = out.unionByName(p)
        return out

    def update(self, versions: DataFrame, rules: dict[str, int] | None = None) -> DataFrame:
        """Scans the blobs of ``versions`` (row, text) for rule versions not yet in the ledger; returns (row, blob).
        ``findings`` then shows these versions."""
        self.rules = rules = dict(rules or RULE_VERSIONS)
        if unknown := rules.keys() - RULES.keys():
            raise ValueError(f"no such rules: {sorted(unknown)}")
        self.runs += 1
        wanted = F.array(*[F.lit(f"{k}:{v}") for k, v in rules.items()])
        paths = self.scratch.keep(versions.select("row", F.sha2("text", 256).alias("blob")), f"paths{self.runs}")
        # one row stands for each blob; the partial minimum makes a blob of a third of all rows one row a task
        first = paths.groupBy("blob").agg(F.min("row").alias("row"))
        if self.parts:
            known = self.table().select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("known"))
            first = first.join(known, "blob", "left")
            missing = F.array_except(wanted, F.coalesce("known", F.array().cast("array<string>")))
        else:
            missing = wanted
        unseen = self.scratch.keep(first.select("row", "blob", missing.alias("rules")).where(F.size("rules") > 0), f"unseen{self.runs}")
        # few unseen blobs, as in most runs after the first, are sent to the texts; else texts are dealt to them
        unseen = F.broadcast(unseen) if unseen.count() <= FEW else unseen.hint("shuffle_hash")
        texts = versions.select("row", "text", F.sha2("text", 256).alias("blob")).join(unseen, ["row", "blob"])
        self._append(texts.mapInArrow(_scan, self.SCHEMA))
        return paths

    def findings(self, paths: DataFrame) -> DataFrame:
        """row, spans of every path, by the rule versions of the last update; blobs with findings are few, and a blob that many paths hold is salted."""
        current = F.array(*[F.lit(f"{k}:{v}") for k, v in self.rules.items()])
        own = F.filter("spans", lambda s: F.array_contains(current, F.concat_ws(":", s["kind"], s["version"])))
        found = self.table().where(F.size("spans") > 0).withColumn("spans", own).where(F.size("spans") > 0).groupBy("blob").agg(F.flatten(F.collect_set("spans")).alias("spans"))
        return salted_left_join(paths, found, "blob", "row").select("row", "blob", F.coalesce("spans", F.array().cast(self.SPANS)).alias("spans"))


def scan_secrets(docs: DataFrame, ledger: BlobLedger | None = None, rules: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined), blob for every row.

    A document is a path with one version; a null text is empty.  Spans are by start, then by kind as listed, in code
    points, end exclusive.  Repeated rows and equal texts are one blob, scanned once, and reported for every row.  Pass a
    ledger to scan only what it has not seen; ``rules`` are the versions of the kinds, RULE_VERSIONS if none are given.
    """
    ledger = ledger or BlobLedger(Scratch(docs.sparkSession))
    rows = with_ids(docs, F.coalesce("text", F.lit("")).alias("text")).withColumnRenamed("doc_id", "row")
    found = ledger.findings(ledger.update(rows, rules))
    rank = F.array(*[F.lit(k) for k in RULES])
    spans = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    shown = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("_s", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("_s", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    out = found.withColumn("_s", spans)
    return out.select(id_out("row", "doc_id"), *[count(k) for k in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown("_s").alias("spans"), "blob")
