"""Slices of time: the history of one key in parts of bounded span, so that no key is one task.

Slices are whole numbers of days since 1970.  A row belongs to its own slice; it is also context of later ones, as far
as a frame may reach back, or a version that began in an earlier slice is carried into each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows that a task is to hold at most, where it sorts them several times.
TASK_ROWS = 250_000


def tasks_for(rows: DataFrame, each: int = TASK_ROWS) -> int:
    """Tasks of some ``each`` rows for ``rows``, and at least one for every core.  The rows are counted, so they should be
    read from files, whose footers say it."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each))


def long_keys(*tables: DataFrame, key: str, most: int) -> DataFrame:
    """_long: the keys of more than ``most`` rows in all ``tables`` together, so at most one for every ``most`` rows."""
    ids = None
    for df in tables:
        one = df.select(F.col(key).alias("_long"))
        ids = one if ids is None else ids.unionByName(one)
    return ids.groupBy("_long").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select("_long")


def slice_of(time: Column | str, days: int) -> Column:
    return F.floor(F.datediff(F.col(time) if isinstance(time, str) else time, F.lit("1970-01-01").cast("date")) / F.lit(days)).cast("long")


def with_context(rows: DataFrame, time: str, days: int, back: int, needed: list[str]) -> DataFrame:
    """Every row in its own slice (_own) and, with the columns ``needed`` alone, in the ``back`` slices after it; ``_slice``
    is where it stands.  Frames that reach back over at most ``days`` times ``back`` are whole in a slice."""
    out = rows.withColumn("_later", F.explode(F.array(*[F.lit(i) for i in range(back + 1)])))
    own = F.col("_later") == 0
    columns = [F.col(c) if c in needed else F.when(own, F.col(c)).alias(c) for c in rows.columns]
    return out.select(*columns, (slice_of(time, days) + F.col("_later")).alias("_slice"), own.alias("_own"))


def as_of(rows: DataFrame, versions: DataFrame, key: str, time: str, columns: list[str], days: int = 7, asked: DataFrame | None = None, long_keys: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``columns`` of the version of their key that is valid at their time, null where none is.

    ``versions``: key, valid_from, valid_to and the columns, half-open and without overlaps in a key; versions of no
    length match nothing.  Rows and versions of a slice are sorted together once, and the last version goes on from row to
    row; the version that was valid when a slice began is carried into it.  So a key with any number of rows and versions
    is as many tasks as it has slices, and no row meets more than one version.  A null key or time matches nothing.

    The keys and slices of ``rows`` are read apart from them; ``asked``, a table with the key and the time of every row and
    perhaps of others, spares their second evaluation.

    ``long_keys``, a table of few keys in ``_long``, are those with too many rows and versions for one task.  If it is given,
    all other keys are one slice each: nothing is carried into that, and no slices are asked for.
    """
    k, t = F.col(key).alias("_k"), F.col(time)
    whole = F.lit(0).cast("long")

    def cut(df: DataFrame, at: str) -> tuple[DataFrame, Column]:
        """The rows and their slice; rows of a null key match nothing and are dealt by their time."""
        if long_keys is None:
            return df, slice_of(at, days)
        own = F.when(F.col("_long").isNotNull(), slice_of(at, days)).when(F.col(key).isNull(), F.pmod(F.xxhash64(at), F.lit(1009)))
        return df.join(F.broadcast(long_keys), F.col(key) == F.col("_long"), "left"), own.otherwise(whole)

    begun, place = cut(versions.where("valid_from < valid_to"), "valid_from")
    v = begun.select(k, place.alias("_slice"), F.col("valid_from").alias("_t"), F.struct("valid_to", *columns).alias("_v"))
    present, old = (rows if asked is None else asked).where(F.col(key).isNotNull() & t.isNotNull()), v
    if long_keys is not None:
        present = present.join(F.broadcast(long_keys), F.col(key) == F.col("_long"), "left_semi")
        old = v.join(F.broadcast(long_keys), F.col("_k") == F.col("_long"), "left_semi")
    present = present.select(k, slice_of(time, days).alias("_slice")).distinct()
    last = old.groupBy("_k", "_slice").agg(F.max_by("_v", "_t").alias("_v"))
    # a row for each slice of a key
    grid = present.select("*", F.lit(None).cast(dict(last.dtypes)["_v"]).alias("_v"), F.lit(True).alias("_asked")).unionByName(last.withColumn("_asked", F.lit(False)))
    grid = grid.groupBy("_k", "_slice").agg(F.first("_v", ignorenulls=True).alias("_v"), F.max("_asked").alias("_asked"))
    before = Window.partitionBy("_k").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.select("_k", "_slice", F.last("_v", ignorenulls=True).over(before).alias("_v"), "_asked").where("_asked and _v is not null")
    none = lambda df, c: F.lit(None).cast(dict(df.dtypes)[c]).alias(c)
    names = rows.columns
    rows, place = cut(rows, time)
    rows = rows.select(k, place.alias("_slice"), t.alias("_t"), F.lit(2).alias("_kind"), F.struct(*[F.col(c) for c in names]).alias("_row"))
    stream = rows.withColumn("_v", none(v, "_v"))
    stream = stream.unionByName(v.select("_k", "_slice", F.col("_t").cast(dict(rows.dtypes)["_t"]).alias("_t"), F.lit(1).alias("_kind"), none(rows, "_row"), "_v"))
    stream = stream.unionByName(carried.select("_k", "_slice", none(rows, "_t"), F.lit(0).alias("_kind"), none(rows, "_row"), "_v"))
    so_far = Window.partitionBy("_k", "_slice").orderBy(F.col("_t").asc_nulls_first(), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = stream.withColumn("_v", F.last("_v", ignorenulls=True).over(so_far)).where("_kind = 2")
    valid = F.col("_k").isNotNull() & (F.col("_t") < F.col("_v.valid_to"))
    return found.select("_row.*", *[F.when(valid, F.col("_v")[c]).alias(c) for c in columns])
