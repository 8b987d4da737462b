"""Split of the flagged transactions into clean rows and reason-coded buckets, and the gates on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.exprs import count_if
from quaystone.operators.checks import Gate
from quaystone.operators.silver import BUCKETS, COLUMNS

#: Columns of the clean table.
CLEAN_COLUMNS = [c for c in COLUMNS if not c.startswith(("_dq_", "_is_"))] + ["_dq_errors", "_is_valid", "_is_duplicate_survivor", "_dq_run_id"]


def clean(silver: DataFrame) -> DataFrame:
    return silver.where("_is_valid").select(*CLEAN_COLUMNS, *[c for c in ("_partition_month",) if c in silver.columns])


def quarantine(silver: DataFrame, run_id: str, at: str) -> DataFrame:
    """All rejected rows, led by bucket, reason, time and run; write with partitionBy("quarantine_bucket") or by
    ``buckets``."""
    lead = [F.col("_dq_bucket").alias("quarantine_bucket"), F.col("_dq_errors").alias("quarantine_reason"), F.lit(at).alias("quarantined_at"), F.lit(run_id).alias("quarantine_run_id")]
    return silver.where("not _is_valid").select(*lead, *silver.columns)


def buckets(quarantined: DataFrame) -> dict[str, DataFrame]:
    """One table for each bucket, empty ones included."""
    return {name: quarantined.where(F.col("quarantine_bucket") == name) for name in BUCKETS}


def bucket_counts(rows: DataFrame, column: str = "_dq_bucket") -> dict[str, int]:
    """Rows of every bucket, 0 where there are none."""
    found = {r[0]: r[1] for r in rows.groupBy(column).count().collect()}  # five rows at most
    return {name: found.get(name, 0) for name in BUCKETS}


def verify(silver: DataFrame, clean_rows: DataFrame, quarantined: DataFrame) -> list[Gate]:
    """Conservation, purity and uniqueness of the split."""
    total = silver.agg(F.count(F.lit(1)).alias("n"), count_if(F.col("_is_valid")).alias("valid")).first()
    kept = clean_rows.agg(F.count(F.lit(1)).alias("n"), count_if(~F.col("_is_valid")).alias("bad")).first()
    q = quarantined.agg(
        F.count(F.lit(1)).alias("n"),
        count_if(F.col("_is_valid")).alias("valid"),
        count_if(F.coalesce("quarantine_reason", F.lit("")) == "").alias("no_reason"),
        count_if(F.col("quarantine_bucket") != F.col("_dq_bucket")).alias("mixed"),
    ).first()
    twice = clean_rows.where("transaction_id <> ''").groupBy("transaction_id").count().where("count > 1").count()
    expected, found = bucket_counts(silver.where("not _is_valid")), bucket_counts(quarantined, "quarantine_bucket")
    return [
        Gate("conservation_sum_eq_silver", kept["n"] + q["n"], total["n"], f"{kept['n']} + {q['n']} vs {total['n']}"),
        Gate("clean_eq_valid", kept["n"], total["valid"], f"{kept['n']} vs {total['valid']}"),
        Gate("buckets_match_report", sum(expected[b] != found[b] for b in BUCKETS), 0, f"{found} vs {expected}"),
        Gate("no_valid_in_quarantine", q["valid"] + kept["bad"], 0, f"{q['valid']}, {kept['bad']}"),
        Gate("reason_non_empty", q["no_reason"]),
        Gate("bucket_purity", q["mixed"]),
        Gate("transaction_id_unique_in_clean", twice),
    ]
