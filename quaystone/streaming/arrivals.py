"""Extension: streams of transactions.  Batches measure lateness as a column; a stream has to bound it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quaystone.functions.exprs import finite
from quaystone.operators.silver import rule_flags, typed


def read_raw(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def flagged(bronze: DataFrame) -> DataFrame:
    """Typed rows with the flags that need the row alone; duplicates and keys need state and tables."""
    return typed(bronze).withColumns(rule_flags())


def without_repeats(rows: DataFrame, lateness: str = "5 days") -> DataFrame:
    """First arrival of each id, remembered for as long as rows may be late."""
    timed = rows.where("event_time is not null").withColumn("event_time", F.col("event_time").cast("timestamp"))
    return timed.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["transaction_id"])


def activity(rows: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "5 days") -> DataFrame:
    """Count, failures and sum of each channel in windows of event time; windows close once they are too late."""
    timed = rows.where(finite(F.col("amount_original"))).withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", lateness)
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    out = timed.groupBy(window, "channel").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).alias("failed_count"), F.sum("amount_original").alias("amount")
    )
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "channel", "txn_count", "failed_count", "amount")


def bursts(rows: DataFrame, gap: str = "10 minutes", least: int = 5, lateness: str = "1 day") -> DataFrame:
    """Sessions of a customer without a pause longer than ``gap``, with at least ``least`` transactions."""
    timed = rows.withColumn("event_time", F.col("event_time").cast("timestamp")).withWatermark("event_time", lateness)
    out = timed.groupBy(F.session_window("event_time", gap).alias("w"), "customer_id").agg(F.count(F.lit(1)).alias("txn_count"))
    return out.where(F.col("txn_count") >= least).select("customer_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "txn_count")


def write(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is final to parquet, takes all that is there, and stops; run it again for what came since."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
