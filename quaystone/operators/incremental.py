"""Layers kept up to date batch by batch: duplicate groups of transactions, and the versions of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.exprs import flag, strip
from quaystone.operators.dims import customer_versions
from quaystone.sources import sinks

#: Buckets of ids or customers that a state is dealt over.
BUCKETS = 64


def bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class DuplicateState:
    """transaction_id, n, survivor of every id so far, as a published table in buckets.

    A batch is reduced to its own ids first; of the state, only the ids that the batch touches are read again by a later
    step.  A batch that is taken twice under one name counts once: the state knows the names of its batches, and both are
    swapped in with one pointer.  One session at a time may write a path."""

    def __init__(self, spark, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _exists(self) -> bool:
        fs, make = sinks._hadoop(self.spark, self.path)
        return fs.exists(make(f"{self.path}/{sinks.POINTER}"))

    def table(self) -> DataFrame:
        """All ids: transaction_id, n, survivor; empty before the first batch."""
        if not self._exists():
            return self.spark.createDataFrame([], "transaction_id string, n long, survivor long")
        return sinks.published(self.spark, self.path).where("transaction_id <> ''").select("transaction_id", "n", "survivor")

    def batches(self) -> list[str]:
        if not self._exists():
            return []
        # a row for each batch
        return [r["batch"] for r in sinks.published(self.spark, self.path).where("bucket = -1 and batch is not null").select("batch").distinct().collect()]

    def add(self, rows: DataFrame, batch: str) -> DataFrame:
        """Takes a batch of typed transactions; returns transaction_id, n, survivor of the ids it touched that are on
        several rows now, in this batch or over all."""
        own = rows.where("transaction_id <> ''").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"), F.min("source_row_number").alias("survivor"))
        done = self.batches()
        if batch not in done:
            whole = self.table().unionByName(own).groupBy("transaction_id").agg(F.sum("n").alias("n"), F.min("survivor").alias("survivor"))
            whole = whole.select("*", bucket("transaction_id", self.buckets).alias("bucket"), F.lit(None).cast("string").alias("batch"))
            names = self.spark.createDataFrame([("", 0, None, -1, b) for b in [*done, batch]], "transaction_id string, n long, survivor long, bucket int, batch string")
            sinks.publish(whole.unionByName(names).repartition(self.buckets, "bucket"), self.path, ("bucket",))
        touched = own.select("transaction_id")
        return self.table().join(touched, "transaction_id", "left_semi").where("n > 1")


def reflagged(rows: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows of touched groups with _is_duplicate_survivor and _dq_duplicate as they are now; no other row is read on."""
    groups = touched.select(F.col("transaction_id").alias("_dup_id"), F.col("survivor").alias("_first"))
    joined = rows.join(groups, F.col("transaction_id") == F.col("_dup_id"))
    survivor = flag(F.col("source_row_number") == F.col("_first"))
    return joined.withColumns({"_is_duplicate_survivor": survivor, "_dq_duplicate": ~survivor}).drop("_dup_id", "_first")


def apply_changes(path: str, customers: DataFrame, events: DataFrame, new_events: DataFrame, locations: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Brings the stored versions of customers (``customer_versions``, in buckets) up to date with new change events.

    Customers that a new event names, late or tied as it may be, get their versions anew from all their events; only the
    buckets that hold them are written again, and of these the other customers' rows as they are.  Returns the touched
    customers.  ``events`` has all events, the new ones too."""
    spark = customers.sparkSession
    touched = new_events.select(strip("customer_id").alias("customer_id")).distinct()
    ids = customers.select("customer_id").join(touched, "customer_id", "left_semi").distinct().withColumn("bucket", bucket("customer_id", buckets))
    its_events = events.join(touched.withColumnRenamed("customer_id", "_touched"), strip("customer_id") == F.col("_touched"), "left_semi")
    anew = customer_versions(customers.join(touched, "customer_id", "left_semi"), its_events, locations).withColumn("bucket", bucket("customer_id", buckets))
    old = spark.read.parquet(path)
    hit = F.broadcast(ids.select("bucket").distinct())  # at most ``buckets`` rows
    rest = old.join(hit, "bucket", "left_semi").join(ids.select("customer_id"), "customer_id", "left_anti")
    merged = rest.select(*old.columns).unionByName(anew.select(*old.columns))
    # partitions that are read are written: the rows are on disk before they take their place
    staged = f"{path.rstrip('/')}__staged"
    sinks.replace_table(merged.repartition("bucket"), staged, ("bucket",))
    sinks.replace_partitions(spark.read.schema(merged.schema).parquet(staged), path, "bucket")
    fs, make = sinks._hadoop(spark, staged)
    fs.delete(make(staged), True)
    spark.catalog.refreshByPath(path)
    return ids.select("customer_id")


def store_versions(versions: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Versions of customers as a table in buckets, for ``apply_changes``."""
    sinks.replace_table(versions.withColumn("bucket", bucket("customer_id", buckets)).repartition("bucket"), path, ("bucket",))
