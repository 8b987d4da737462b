"""Exact percentiles by narrowing, without a sort of the values.

A first aggregate keeps a mergeable summary of each group: its size, ends, and approximate percentiles of known error.
Two of these enclose each percentile.  A second aggregate counts the values under the enclosure and each value inside it;
the rank is then looked up among these, a few ten-thousandths of the group.  Both aggregates are summed before they are
shuffled, so a group of any size costs a task its summary alone, and nothing is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions.exprs import finite

#: An approximate percentile is off by one part of so many of its group, at most.
ACCURACY = 10_000


def percentiles(rows: DataFrame, column: str, at: tuple[float, ...], by: tuple[str, ...] = (), accuracy: int = ACCURACY) -> DataFrame:
    """by..., q, value: exact percentiles, interpolated between neighbours, for each group and each q of ``at``.

    Nulls, NaN and infinities count for nothing; a group without finite values has no rows.  A null key is a group.
    """
    at = tuple(float(q) for q in at)
    x = rows.select(*by, F.col(column).cast("double").alias("_x")).where(finite(F.col("_x")))
    ends = [e for q in at for e in (max(q - 2 / accuracy, 0.0), min(q + 2 / accuracy, 1.0))]
    sketch = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_least"), F.max("_x").alias("_most"), F.percentile_approx("_x", ends, accuracy).alias("_ends")).where("_n > 0")
    # in a group so small the error is no whole row: it is its own enclosure
    small = F.col("_n") <= 4 * accuracy
    bounds = F.array(*[
        F.struct(F.lit(q).alias("q"), (F.lit(q) * (F.col("_n") - 1)).alias("at"), F.when(small, F.col("_least")).otherwise(F.col("_ends")[2 * i]).alias("lo"), F.when(small, F.col("_most")).otherwise(F.col("_ends")[2 * i + 1]).alias("hi"))
        for i, q in enumerate(at)
    ])
    bounds = sketch.select(*[F.col(c).alias(f"_by_{i}") for i, c in enumerate(by)], bounds.alias("_bounds"))
    if by:
        on = [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]
        joined = x.join(bounds, on)
    else:
        joined = x.crossJoin(F.broadcast(bounds))  # one row
    near = joined.select(*by, "_x", F.explode(F.filter("_bounds", lambda b: F.col("_x") <= b["hi"])).alias("_b"))
    # values under the enclosure are counted together, as null
    counted = near.groupBy(*by, F.col("_b.q").alias("q"), F.col("_b.at").alias("_at"), F.when(F.col("_x") >= F.col("_b.lo"), F.col("_x")).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "q").orderBy(F.col("_x").asc_nulls_first()))
    ranked = counted.withColumn("_upto", upto)
    holds = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_x")))
    found = ranked.groupBy(*by, "q", "_at").agg(holds(F.floor("_at")).alias("_lo"), holds(F.ceil("_at")).alias("_hi"))
    part = F.col("_at") - F.floor("_at")
    return found.select(*by, "q", F.when(part == 0, F.col("_lo")).otherwise(F.col("_lo") * (1 - part) + F.col("_hi") * part).alias("value"))
