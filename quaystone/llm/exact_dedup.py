"""Exact duplicates by a tree merge of sorted digest runs, with DataFrame functions alone.

Every leaf holds a run, sorted by digest: the smallest (or largest) identifier and a count for each digest of its rows.
In each round groups of ``2**bits`` neighbouring runs exchange parts: a part is the range of the next ``bits`` of the
digest, the runs' pieces of a part are dealt to one task, merged in digest order and reduced, so the number of runs,
and with it the parallelism, stays the same while every run covers more leaves and a narrower digest range.  After the
last round a digest has one row.  A digest of a third of all rows is one row for each leaf from the first level on; the
way back down joins it to one row for each leaf, then to rows within a leaf.  ``2**(rounds * bits)`` runs are the most
tasks that work at once: take a further round for tens of terabytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import Scratch, id_out, with_ids


def _merged(rows: DataFrame, keys: tuple[str, ...], keep: str) -> DataFrame:
    """Pieces dealt by ``keys``, in digest order, reduced to one row a digest: the identifier is taken from a struct,
    which Spark reduces over sorted rows, not by hash."""
    best = {"min": F.min, "max": F.max}[keep]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "digest")
    out = dealt.groupBy(*keys, "digest").agg(best(F.struct("keep_id")).alias("_best"), F.sum("group_size").alias("group_size"))
    return out.select(*keys, "digest", F.col("_best.keep_id").alias("keep_id"), "group_size")


def merge_runs(rows: DataFrame, rounds: int = 3, bits: int = 3, keep: str = "min") -> tuple[DataFrame, DataFrame]:
    """(leaves, merged): rows (leaf, digest) and rows (digest, keep_id, group_size).  ``rows``: id, digest, leaf with
    leaf in [0, 2**(rounds*bits)).  ``digest`` is hexadecimal text with the length of what it stands for; identifiers
    are retained only among rows whose digest and length agree."""
    leaves = _merged(rows.select("leaf", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size")), ("leaf",), keep)
    # leading bits of the digest: the part of the digest range that a run holds after each round
    lead = F.conv(F.substring("digest", 1, 12), 16, 10).cast("long")
    run = leaves.withColumnRenamed("leaf", "run")
    for done in range(1, rounds + 1):
        part = F.shiftright(lead, 48 - done * bits).cast("int")
        run = _merged(run.select(F.shiftright("run", bits).alias("run"), part.alias("part"), "digest", "keep_id", "group_size"), ("run", "part"), keep).drop("part")
    return leaves.select("leaf", "digest"), run.drop("run")


def exact_duplicates(docs: DataFrame, keep: str = "max", rounds: int = 3, bits: int = 3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty.  Of equal texts the row with the largest
    (``keep="min"``: smallest) doc_id stays; a null doc_id is smaller than any other.  Repeated rows of the doc_id that
    stays are all marked kept and all count in group_size.  An empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = with_ids(docs, text.alias("text")).select(
        F.col("doc_id").alias("id"),
        F.concat_ws("-", F.sha2("text", 256), F.octet_length("text"), F.hex(F.xxhash64("text"))).alias("digest"),
    )
    # texts are read and hashed once; what is merged and joined are these narrow rows
    leaf = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(2 ** (rounds * bits))).cast("int")
    rows = Scratch(docs.sparkSession).keep(rows.withColumn("leaf", leaf), "digests")
    leaves, merged = merge_runs(rows, rounds, bits, keep)
    down = leaves.join(merged, "digest")
    return rows.join(down, ["leaf", "digest"]).select(
        id_out("id", "doc_id"),
        id_out("keep_id"),
        "group_size",
        (F.col("id") == F.col("keep_id")).alias("kept"),
        F.substring("digest", 1, 64).alias("text_sha256"),
    )
