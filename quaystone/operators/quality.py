"""Quality checks on the flagged transactions: rates, integrity, and recall of injected errors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.exprs import count_if, ratio
from quaystone.operators.checks import Check
from quaystone.operators.silver import BUCKETS, FLAGS

#: Highest share of rows for each flag.
RATE_LIMITS = {
    "_dq_null_transaction_id": 0.003,
    "_dq_invalid_amount": 0.010,
    "_dq_invalid_timestamp": 0.0075,
    "_dq_invalid_currency": 0.003,
    "_dq_invalid_channel": 0.003,
    "_dq_invalid_type": 0.001,
    "_dq_invalid_status": 0.001,
    "_dq_invalid_location": 0.003,
    "_dq_duplicate": 0.005,
    "_dq_fk_customer": 0.010,
    "_dq_fk_account": 0.010,
    "_dq_fk_merchant": 0.010,
}
LEAST_VALID, LEAST_COVERAGE = 0.95, 0.99
#: Columns that a Silver table must have.
REQUIRED = [
    "transaction_id", "customer_id", "account_id", "merchant_id", "device_id", "card_id", "transaction_type", "channel", "status", "currency", "amount_original", "exchange_rate", "amount_vnd",
    "country", "city", "location_id", "event_time", "event_date", "ingestion_time", "ingestion_lag_seconds", "source_system", "batch_id", "file_name", "source_row_number",
]
#: Flag that should catch each injected error.
EXPECTED_FLAG = {
    "null_transaction_id": "_dq_null_transaction_id",
    "duplicate_transaction_id": "_dq_duplicate",
    "invalid_amount": "_dq_invalid_amount",
    "invalid_timestamp": "_dq_invalid_timestamp",
    "orphan_customer": "_dq_fk_customer",
    "orphan_account": "_dq_fk_account",
    "orphan_merchant": "_dq_fk_merchant",
    "invalid_currency": "_dq_invalid_currency",
    "invalid_channel": "_dq_invalid_channel",
    "invalid_location": "_dq_invalid_location",
}


def flag_rates(silver: DataFrame) -> DataFrame:
    """flag, n, rate: one scan, one row for each flag and for valid rows."""
    names = [*FLAGS, "_is_valid"]
    once = silver.agg(F.count(F.lit(1)).alias("_rows"), *[count_if(F.col(f)).alias(f) for f in names])
    long = once.unpivot("_rows", names, "flag", "n")
    return long.select("flag", "n", F.round(F.coalesce(F.try_divide(F.col("n").cast("double"), F.col("_rows").cast("double")), F.lit(0.0)), 6).alias("rate"))


def rates_by_month(silver: DataFrame, month: str = "_partition_month") -> DataFrame:
    return silver.groupBy(month).agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(F.col(f).cast("int")), 6).alias(f"rate{f}") for f in FLAGS])


def buckets_by_month(silver: DataFrame, month: str = "_partition_month") -> DataFrame:
    """A row for each month, a column for each bucket and one for valid rows, 0 where there are none."""
    return silver.groupBy(month).agg(count_if(F.col("_dq_bucket") == "").alias("valid"), *[count_if(F.col("_dq_bucket") == b).alias(b) for b in BUCKETS])


def rates_by_grain(silver: DataFrame, month: str = "_partition_month") -> DataFrame:
    """grain (``month`` or ``total``), month, rows, a count for each flag and bucket, valid rows and their rate: both grains
    from one scan, as grouping sets."""
    sets = silver.groupingSets([[month], []], month)
    out = sets.agg(
        F.when(F.grouping_id() == 0, "month").otherwise("total").alias("grain"), F.count(F.lit(1)).alias("rows"), *[count_if(F.col(f)).alias(f"n{f}") for f in FLAGS],
        *[count_if(F.col("_dq_bucket") == b).alias(b) for b in BUCKETS], count_if(F.col("_is_valid")).alias("valid"),
    )
    return out.withColumn("valid_rate", F.round(ratio(F.col("valid"), F.col("rows")), 6)).withColumnRenamed(month, "month")


def top_error_codes(silver: DataFrame, limit: int | None = None) -> DataFrame:
    """error_code, n by frequency; soft codes of valid rows count as well."""
    out = silver.where("_dq_errors <> ''").select(F.explode(F.split("_dq_errors", ",")).alias("error_code")).groupBy("error_code").agg(F.count(F.lit(1)).alias("n"))
    out = out.orderBy(F.desc("n"), "error_code")
    return out if limit is None else out.limit(limit)


def integrity(silver: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Counts of broken rules, in one row."""
    valid = F.col("_is_valid")
    day = F.col("event_date")
    rules = silver.agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(valid & F.col("amount_vnd").isNull()).alias("amount_vnd_notnull_when_valid"),
        count_if(valid & F.col("exchange_rate").isNull()).alias("exchange_rate_notnull_when_valid"),
        count_if(valid != (F.col("_dq_bucket") == "")).alias("bucket_consistency"),
        count_if(valid & (day.isNull() | (day < F.lit(start)) | (day > F.lit(end)))).alias("event_date_in_window"),
    )
    named = silver.where("transaction_id <> ''").groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_is_duplicate_survivor").cast("int")).alias("survivors"), F.sum(valid.cast("int")).alias("valid")
    )
    groups = named.agg(count_if((F.col("n") > 1) & (F.col("survivors") != 1)).alias("exactly_one_survivor_per_group"), count_if(F.col("valid") > 1).alias("no_dup_among_valid"))
    return rules.crossJoin(groups)  # one row each


def manifest_coverage(silver: DataFrame, manifest: DataFrame) -> DataFrame:
    """error_type, injected, caught, coverage: whether the rows named in an error manifest carry the expected flag.  A
    duplicate is caught if its row is in a duplicate group, survivor or not."""
    caught = F.lit(False)
    for kind, name in EXPECTED_FLAG.items():
        hit = F.col(name) | F.col("_is_duplicate_survivor") if kind == "duplicate_transaction_id" else F.col(name)
        caught = F.when(F.col("error_type") == kind, hit).otherwise(caught)
    wanted = manifest.select(F.col("row_index").cast("long").alias("_row"), "error_type").where(F.col("error_type").isin(*EXPECTED_FLAG))
    joined = wanted.join(silver, F.col("_row") == F.col("source_row_number"), "left")
    out = joined.groupBy("error_type").agg(F.count(F.lit(1)).alias("injected"), count_if(F.coalesce(caught, F.lit(False))).alias("caught"))
    return out.withColumn("coverage", F.round(F.col("caught").cast("double") / F.col("injected"), 6))


def run_checks(silver: DataFrame, bronze_rows: int, start: dt.date, end: dt.date, manifest: DataFrame | None = None) -> list[Check]:
    """The 22 checks, from four aggregates."""
    rates = {r["flag"]: r for r in flag_rates(silver).collect()}
    checks = [Check(f"rate{f.removeprefix('_dq')}", "rate", "WARNING", rates[f]["rate"], limit, "<=", f"{rates[f]['n']} rows") for f, limit in RATE_LIMITS.items()]
    checks.append(Check("valid_rate", "rate", "WARNING", rates["_is_valid"]["rate"], LEAST_VALID, ">=", f"{rates['_is_valid']['n']} rows"))
    found = integrity(silver, start, end).first().asDict()
    checks.append(Check("rowcount_silver_eq_bronze", "integrity", "ERROR", found.pop("rows") - bronze_rows, 0, "=="))
    missing = sorted(set(REQUIRED) - set(silver.columns))
    checks.append(Check("schema_conformance", "integrity", "ERROR", len(missing), 0, "==", ", ".join(missing)))
    checks += [Check(name, "integrity", "ERROR", n, 0, "==") for name, n in found.items()]
    if manifest is None:
        return [*checks, Check("manifest_coverage", "reconciliation", "ERROR", 1.0, LEAST_COVERAGE, ">=", "no manifest")]
    covered = manifest_coverage(silver, manifest).collect()  # ten rows at most
    least = min((r["coverage"] for r in covered), default=1.0)
    return [*checks, Check("manifest_coverage", "reconciliation", "ERROR", least, LEAST_COVERAGE, ">=", ", ".join(f"{r['error_type']} {r['coverage']}" for r in covered))]
