"""Bloom filters as columns: keys of a large table that a smaller one can't ask for are left out before any shuffle.

A filter is one array of 64-bit words of a size that its parameter fixes, whatever the tables hold.  It is summed in the
tasks that read the smaller table and reaches the scan of the large one as a scalar; no row of either is sent.  A filter too small for its keys lets more
through, and never loses a key: what passes is joined as it would have been.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter (1 MB; one other key in 37 passes by chance at a million keys), and bits that a key sets.
BITS, HASHES = 2**23, 3


def _positions(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bloom(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """One row, ``words``: the filter of the keys.  Words are summed within tasks before the shuffle, which has at most
    bits / 64 rows a task."""
    place = keys.select(F.explode(F.array(*_positions(key, bits))).alias("p"))
    hit = place.select(F.floor(F.col("p") / 64).alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bits"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = hit.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return words.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w")).select(F.transform("w", lambda w: w["bits"]).alias("words"))


def may_hold(rows: DataFrame, key: Column, asked: DataFrame, asked_key: Column, bits: int = BITS) -> DataFrame:
    """``rows`` whose key may be one of ``asked``'s; all whose key is are among them."""
    words = bloom(asked, asked_key, bits).scalar()
    passes = None
    for p in _positions(key, bits):
        bit = F.getbit(F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1
        passes = bit if passes is None else passes & bit
    return rows.where(passes)
