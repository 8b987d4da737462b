"""Exact distinct counts of surrogate keys by bitmaps that can be merged.

A bitmap of 4 KB holds 32,768 neighbouring keys.  Bitmaps of a day are one row for each part of the key range that the
day touches; they add up to a month's, or any other grain's, without another scan of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bitmaps(rows: DataFrame, key: str, by: list[str | Column]) -> DataFrame:
    """by..., bucket, bits for the non-null keys (long) of each group; summed before the shuffle."""
    rows = rows.where(F.col(key).isNotNull())
    return rows.groupBy(*by, F.bitmap_bucket_number(F.col(key)).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col(key))).alias("bits"))


def rolled_up(maps: DataFrame, by: list[str | Column]) -> DataFrame:
    """Bitmaps of a coarser grain from finer ones."""
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def counted(maps: DataFrame, by: list[str | Column], name: str) -> DataFrame:
    """by..., the number of distinct keys."""
    return maps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def distinct_by_grain(rows: DataFrame, key: str, fine: str, coarse: Column, name: str) -> DataFrame:
    """grain (``fine``, ``coarse``, ``all``), group, distinct keys: three grains from one scan of the rows."""
    day = bitmaps(rows, key, [F.col(fine).alias("_fine")]).withColumn("_coarse", coarse)
    # coarser grains come from the bitmaps, as grouping sets of them
    sets = day.groupingSets([["_fine", "bucket"], ["_coarse", "bucket"], ["bucket"]], "_fine", "_coarse", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.grouping_id().alias("_grain"))
    grain = F.when(F.col("_fine").isNotNull(), "fine").when(F.col("_coarse").isNotNull(), "coarse").otherwise("all")
    group = F.coalesce(F.col("_fine").cast("string"), F.col("_coarse").cast("string"), F.lit("all"))
    return sets.groupBy(grain.alias("grain"), group.alias("group")).agg(F.sum(F.bitmap_count("bits")).alias(name))
