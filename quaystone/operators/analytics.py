"""Ad-hoc queries and statistics on raw or flagged transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions.exprs import count_if, finite, lenient_double, lenient_timestamp, ratio
from quaystone.operators.selection import percentiles


def defensive(bronze: DataFrame) -> DataFrame:
    """The raw transactions with a finite amount and a time, or nulls; no other column changes."""
    amount = lenient_double(F.col("amount"))
    return bronze.withColumns({"amount": F.when(finite(amount), amount), "event_time": lenient_timestamp(F.col("transaction_time"))})


def quality_peek(bronze: DataFrame) -> DataFrame:
    """Rows, amounts that are no finite number (negative ones are), times that do not parse, and empty ids."""
    return bronze.agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_if(~finite(lenient_double(F.col("amount")))).alias("bad_amount"),
        count_if(lenient_timestamp(F.col("transaction_time")).isNull()).alias("bad_timestamp"),
        count_if(F.col("transaction_id") == "").alias("empty_txn_id"),
    )


def daily_running_total(tx: DataFrame, days: int | None = 15) -> DataFrame:
    """Daily count and sum, and the running sum of the unrounded daily sums; the first ``days`` days."""
    daily = tx.where("amount > 0 and event_time is not null").groupBy(F.to_date("event_time").alias("txn_date"))
    daily = daily.agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("_sum"))
    out = daily.select("txn_date", "txn_count", F.round("_sum").alias("total_amount_vnd"), F.round(F.sum("_sum").over(Window.orderBy("txn_date"))).alias("running_total_vnd")).orderBy("txn_date")
    return out if days is None else out.limit(days)


def channel_share(tx: DataFrame) -> DataFrame:
    out = tx.where("amount > 0").groupBy("channel").agg(F.count(F.lit(1)).alias("txn_count"), F.round(F.sum("amount")).alias("total_amount_vnd"))
    share = F.round(100.0 * F.col("txn_count") / F.sum("txn_count").over(Window.partitionBy(F.lit(1))), 2)
    return out.withColumn("pct_of_txn", share).orderBy(F.desc("txn_count"), "channel")


def top_merchants(tx: DataFrame, merchants: DataFrame, limit: int = 10) -> DataFrame:
    """Merchants by revenue; transactions are summed by merchant before the names are joined."""
    sums = tx.where("amount > 0 and merchant_id <> ''").groupBy("merchant_id").agg(F.count(F.lit(1)).alias("txn_count"), F.sum("amount").alias("_sum"))
    named = sums.join(merchants.select("merchant_id", "merchant_name", "category"), "merchant_id")
    # every merchant ahead of one of the first ``limit`` is among them, so ranks need these rows alone
    named = named.orderBy(F.desc("_sum"), "merchant_id").limit(limit).withColumn("rnk", F.rank().over(Window.orderBy(F.desc("_sum"))))
    return named.select("rnk", "merchant_id", "merchant_name", "category", "txn_count", F.round("_sum").alias("total_amount_vnd")).orderBy("rnk", "merchant_id")


def amount_outliers(tx: DataFrame, least_z: float = 4, least_count: int = 10, limit: int | None = 15) -> DataFrame:
    """Amounts far above the customer's own average."""
    w = Window.partitionBy("customer_id")
    z = F.try_divide(F.col("amount") - F.avg("amount").over(w), F.nullif(F.stddev_samp("amount").over(w), F.lit(0.0)))
    rows = tx.where("amount > 0").select("customer_id", "transaction_id", "transaction_type", "amount", z.alias("z"), F.count(F.lit(1)).over(w).alias("n"))
    out = rows.where((F.col("z") > least_z) & (F.col("n") >= least_count)).orderBy(F.desc("z"), "transaction_id")
    out = out.select("customer_id", "transaction_id", "transaction_type", F.round("amount").alias("amount_vnd"), F.round("z", 2).alias("amount_zscore"))
    return out if limit is None else out.limit(limit)


def failure_by_category(tx: DataFrame, merchants: DataFrame) -> DataFrame:
    """Share of failed transactions for each merchant category, whatever the amount."""
    sums = tx.where("merchant_id <> ''").groupBy("merchant_id").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("status") == "failed").alias("failed"))
    out = sums.join(merchants.select("merchant_id", "category"), "merchant_id").groupBy("category")
    out = out.agg(F.sum("n").alias("txn_count"), F.round(100.0 * ratio(F.sum("failed"), F.sum("n")), 2).alias("fail_pct"))
    return out.orderBy(F.desc("fail_pct"), "category")


# -- statistics


def lag_statistics(rows: DataFrame, lag: str = "ingestion_lag_seconds", late_after: int = 3600) -> DataFrame:
    """p50, p95, p99 (truncated), maximum and share of late rows."""
    names = {0.5: "p50", 0.95: "p95", 0.99: "p99"}
    p = percentiles(rows, lag, tuple(names)).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).cast("long").alias(n) for q, n in names.items()])
    one = rows.where(F.col(lag).isNotNull()).agg(F.max(lag).alias("max_lag"), F.round(F.avg((F.col(lag) > late_after).cast("int")), 6).alias("late_share"))
    return p.withColumn("_one", F.lit(1)).join(one.withColumn("_one", F.lit(1)), "_one").drop("_one")  # one row each


def log_amount_statistics(rows: DataFrame, by: str, amount: str = "amount_vnd") -> DataFrame:
    """Mean and deviation of log(1 + amount) by group, over finite amounts above 0."""
    x = F.log1p(F.col(amount))
    good = rows.where(finite(F.col(amount)) & (F.col(amount) > 0))
    return good.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean_log"), F.round(F.stddev_samp(x), 6).alias("std_log"))


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """Every value, null too, with its count and share."""
    out = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.round(F.col("n") / rows.agg(F.count(F.lit(1))).scalar(), 6))


def quantiles(rows: DataFrame, column: str, at: tuple[float, ...] = (0.5, 0.95, 0.99, 0.999)) -> DataFrame:
    return percentiles(rows, column, at).withColumn("value", F.round("value", 6))


def null_shares(rows: DataFrame) -> DataFrame:
    """column, null_share of every column, from one scan."""
    one = rows.agg(*[F.round(F.avg(F.col(f"`{c}`").isNull().cast("int")), 6).alias(c) for c in rows.columns])
    return one.unpivot([], one.columns, "column", "null_share")


def median_by(rows: DataFrame, by: str, column: str) -> DataFrame:
    """Median of the finite values of every group; null for a group without any."""
    found = percentiles(rows, column, (0.5,), (by,)).select(F.col(by).alias("_by"), F.round("value", 6).alias("median"))
    return rows.select(by).distinct().join(found, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "median")


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1..bins, 0 and bins + 1 outside) and rows in it; infinities lie outside, null and NaN in none."""
    b: Column = F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins))
    return rows.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def calibration(rows: DataFrame, by: str = "type", amount: str = "amount", fraud: str = "is_fraud", scale: float = 1.0, types: tuple[str, ...] = ()) -> DataFrame:
    """What a generator wants of the amounts of each type, over finite amounts times ``scale``: n, share of all rows, log-normal
    mu and sigma, cap (the 0.999 quantile as a whole number, 1 at least), mean; the same mu and sigma of fraud alone, its
    rows and rate.  Types of ``types`` without rows have n, share and rate 0; a sigma of one row is null."""
    rows = rows.where(finite(F.col(amount))).select(F.col(by).alias("_by"), (F.col(amount) * F.lit(scale)).alias("_x"), (F.coalesce(F.col(fraud), F.lit(0)) == 1).alias("_fraud"))
    log, bad = F.log(F.col("_x") + 1), F.when(F.col("_fraud"), F.log(F.col("_x") + 1))
    sums = rows.groupBy("_by").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(log), 6).alias("mu"), F.round(F.stddev_samp(log), 6).alias("sigma"), F.round(F.avg("_x"), 4).alias("mean"),
        count_if(F.col("_fraud")).alias("fraud_n"), F.round(F.avg(bad), 6).alias("fraud_mu"), F.round(F.stddev_samp(bad), 6).alias("fraud_sigma"),
    )
    tail = percentiles(rows, "_x", (0.999,), ("_by",)).select(F.col("_by").alias("_type"), F.greatest(F.lit(1.0), "value").cast("long").alias("cap"))
    out = sums.join(tail, F.col("_by").eqNullSafe(F.col("_type")), "left").drop("_type")
    if types:
        listed = rows.sparkSession.createDataFrame([(t,) for t in types], "_type string")
        out = out.join(F.broadcast(listed), F.col("_by").eqNullSafe(F.col("_type")), "full").withColumn("_by", F.coalesce("_by", "_type")).na.fill(0, ["n", "fraud_n"])
    share = F.round(F.coalesce(ratio(F.col("n"), F.sum("n").over(Window.partitionBy(F.lit(1)))), F.lit(0.0)), 6)  # a row for each type
    rate = F.round(F.coalesce(ratio(F.col("fraud_n"), F.col("n")), F.lit(0.0)), 6)
    return out.select(F.col("_by").alias(by), "n", share.alias("share"), "mu", "sigma", "cap", "mean", "fraud_n", rate.alias("fraud_rate"), "fraud_mu", "fraud_sigma")
