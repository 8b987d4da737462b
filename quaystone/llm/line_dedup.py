"""Lines that many documents share.

Key hashes are range-partitioned with a secondary sort by document and position; a stream over each sorted partition
finds the keys of at least ``min_docs`` documents and their first occurrence (``runs.shared_members``).  What comes back
is a compressed bitmap of the lines to keep for each document that loses any, never text; it is then applied to the text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.llm.common import BLANKS, Scratch, chunks, id_out, with_ids
from quaystone.llm.runs import shared_members


def line_key(line: bytes) -> bytes:
    """The line without blanks at both ends, A-Z lower-cased."""
    return line.strip(BLANKS).lower()


def _keys(batches, min_chars: int):
    """A row for each key of a text: its hash, the lines that have it, and the first of them."""
    for batch in chunks(batches):
        k1, docs, hs, total, places, first = [], [], [], [], [], []
        for doc, h, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_h", "_bytes")), strict=True):
            at: dict[bytes, list[int]] = {}
            lines = (text or b"").split(b"\n")
            for i, line in enumerate(lines):
                at.setdefault(line_key(line), []).append(i)
            for key, own in at.items():
                if len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars):
                    k1.append(xxhash.xxh3_128_digest(key))
                    docs.append(doc)
                    hs.append(h)
                    total.append(len(lines))
                    first.append(own[0])
                    places.append(np.array(own, np.int32).tobytes())
        halves = np.frombuffer(b"".join(k1), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_pydict(
            {
                "k1": pa.array(halves[:, 0]), "k2": pa.array(halves[:, 1]), "doc": pa.array(docs, pa.int64()), "h": pa.array(hs, pa.int64()),
                "at": pa.array(first, pa.int32()), "n_lines": pa.array(total, pa.int32()), "lines": pa.array(places, pa.binary()),
            }
        )


def _bitmaps(batches):
    for batch in chunks(batches):
        out, dropped = [], []
        for n, drop in zip(batch.column("n_lines").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[np.frombuffer(b"".join(drop), np.int32)] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "_h": batch.column("_h"), "_dropped": pa.array(dropped, pa.int64()), "_bitmap": pa.array(out, pa.binary())})


def keep_bitmaps(scratch: Scratch, rows: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """doc_id, _h, _dropped, _bitmap (zlib over packed bits, first line first) for every (doc_id, _h) of ``rows`` that
    loses lines.  ``rows``: doc_id, _h (a hash of the text) and _bytes."""
    fields = "k1 long, k2 long, doc long, h long, at int, n_lines int, lines binary"
    keys = scratch.keep(rows.select("doc_id", "_h", "_bytes").mapInArrow(lambda bs: _keys(bs, min_chars), fields), "keys")
    shared = shared_members(scratch, "shared", keys, min_docs, ("h", "n_lines", "lines"), then=("at",))
    lines = F.col("lines")
    if keep_first:  # the first line of the first document stays
        lines = F.when(F.col("doc") == F.col("first"), F.substring("lines", 5, 2**31 - 1)).otherwise(lines)
    drops = shared.groupBy(F.col("doc").alias("doc_id"), F.col("h").alias("_h")).agg(F.max("n_lines").alias("n_lines"), F.collect_set(lines).alias("drop"))
    return drops.mapInArrow(_bitmaps, "doc_id long, _h long, _dropped long, _bitmap binary")


def _apply(batches, with_text: bool):
    for batch in chunks(batches):
        rows = []
        for text, bitmap in zip(batch.column("_bytes").to_pylist(), batch.column("_bitmap").to_pylist(), strict=True):
            lines = (text or b"").split(b"\n")
            if bitmap is None:
                keep, kept = np.ones(len(lines), np.uint8), text or b""
            else:
                keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))[: len(lines)]
                kept = b"\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])
            bitmap = zlib.compress(np.packbits(keep).tobytes(), 1) if bitmap is None else bitmap
            rows.append((len(lines), hashlib.sha256(kept).hexdigest(), bitmap, hashlib.sha256((keep + 48).tobytes()).hexdigest(), kept))
        n, sha, bitmap, bits, kept = zip(*rows, strict=True) if rows else ([],) * 5
        cols = {"_n_lines": pa.array(n, pa.int64()), "_sha": pa.array(sha, pa.string()), "_bitmap": pa.array(bitmap, pa.binary()), "_bits": pa.array(bits, pa.string())}
        if with_text:
            cols["_kept"] = pa.array(kept, pa.binary())
        others = {c: batch.column(c) for c in batch.schema.names if c not in ("_bytes", "_h", *cols)}
        yield pa.RecordBatch.from_pydict(others | cols)


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, with_text: bool = False, carry: tuple[str, ...] = (), keep_first: bool = False) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, keep_bitmap (zlib over packed bits, first line first), keep_sha256 (of the
    bits as a text of 0 and 1), the columns of ``carry``, and with ``with_text`` the kept text.

    A text is split at \\n; null or empty is one empty line.  Lines whose key has at least ``min_chars`` code points
    and occurs in at least ``min_docs`` documents are dropped from all, or with ``keep_first`` from all but the first
    place in the document of the smallest doc_id.  Repeated rows of one doc_id count as one document; rows of one doc_id
    with different texts are each judged by their own lines.  Empty lines stay.  A carried column may have any name
    but those of the result.
    """
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256", "keep_bitmap", "keep_sha256", *(["text"] if with_text else []))
    if clash := set(carry) & set(names):
        raise ValueError(f"columns of the result can't be carried: {sorted(clash)}")
    scratch = Scratch(docs.sparkSession)
    carried = [F.col(c).alias(f"_carry{i}") for i, c in enumerate(carry)]
    rows = with_ids(docs, F.xxhash64("text").alias("_h"), F.col("text").cast("binary").alias("_bytes"), *carried)
    maps = keep_bitmaps(scratch, rows, min_docs, min_chars, keep_first)
    # the narrow side is built as hash tables, partition by partition; texts are dealt once and never sorted
    joined = rows.join(maps.hint("shuffle_hash"), ["doc_id", "_h"], "left")
    fields = ["doc_id long", *(f"{c} {t}" for c, t in rows.dtypes if c.startswith("_carry")), "_dropped long", "_n_lines long", "_sha string", "_bitmap binary", "_bits string"]
    out = joined.mapInArrow(lambda bs: _apply(bs, with_text), ", ".join(fields + ["_kept binary"] * with_text))
    shown = [id_out(), F.col("_n_lines").alias("n_lines"), F.coalesce("_dropped", F.lit(0)).alias("n_dropped"), F.col("_sha").alias("kept_sha256"), F.col("_bitmap").alias("keep_bitmap"), F.col("_bits").alias("keep_sha256")]
    return out.select(*shown, *[F.col(f"_carry{i}").alias(c) for i, c in enumerate(carry)], *([F.col("_kept").cast("string").alias("text")] if with_text else []))
