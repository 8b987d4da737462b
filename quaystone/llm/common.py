"""Shared pieces of the training-data operators.

Ids: a null ``doc_id`` is carried as ``NULL_ID`` inside an operator and becomes null again in its result, so that
no row is lost in a join.  Only the columns an operator names are read; other columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.sources import scratch

#: Stands for a null doc_id.
NULL_ID = -(2**63)
#: The bytes that separate words.
BLANKS = b" \t\n\x0b\x0c\r"
#: Words kept in a worker's hash cache before it starts anew.
CACHE_WORDS = 100_000
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


#: Rows that go to a Python worker at a time while an intermediate table is made, at most: whole texts may be long.
ARROW_ROWS, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


class Scratch(scratch.Scratch):
    """Intermediate tables of operators on texts.  A result that is not stored goes by the session's own settings."""

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        before = self.spark.conf.get(ARROW_ROWS)
        if 0 < int(before) <= MOST_ROWS:
            return super().keep(df, name)
        self.spark.conf.set(ARROW_ROWS, str(MOST_ROWS))
        try:
            return super().keep(df, name)
        finally:
            self.spark.conf.set(ARROW_ROWS, before)


def free_name(taken: list[str], name: str) -> str:
    """``name``, or it with underscores before it, whichever no column has."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_ids(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as a long that is never null, and the named columns."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), *columns)


def id_out(name: str = "doc_id", alias: str | None = None):
    """The id as it came: NULL_ID is null again."""
    return F.when(F.col(name) != F.lit(NULL_ID), F.col(name)).alias(alias or name)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system Spark knows; none if it isn't there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


class WordHashes(dict):
    """64-bit hashes of words, computed once per worker and word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def grams(h: np.ndarray, k: int, multiplier: np.uint64 = MULTIPLIER) -> np.ndarray:
    """One hash for every k consecutive word hashes."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n, out, done = len(h) - k + 1, None, 0
    power, size, width = h, 1, k
    mult = int(multiplier)
    # binary doubling: grams of 1, 2, 4, ... words combine to k
    while True:
        if width & 1:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(mult, size, 2**64)) + part
            done += size
        width >>= 1
        if not width:
            return mix(out)
        power = power[:-size] * np.uint64(pow(mult, size, 2**64)) + power[size:]
        size *= 2


def shingles(words: list[bytes], hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; of the whole sequence if there are fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(grams(hashes.of(words), min(k, len(words))))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each length in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, salts: int = 16) -> DataFrame:
    """left join of a unique, narrow right side, where a key may hold a third of the left rows: its rows are dealt over
    ``salts`` tasks by ``spread_by`` and the right side is repeated so many times.  It is merged, never broadcast: Spark
    would judge its size before the repetition."""
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    return left.join(right.hint("merge"), [key, "_salt"], "left").drop("_salt")


def chunks(batches: Iterable, rows: int = 1024) -> Iterator:
    """Smaller record batches, so that a worker's lists stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
