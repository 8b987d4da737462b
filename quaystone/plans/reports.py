"""Summaries as JSON and Markdown: quality of a Silver table, ad-hoc queries on raw transactions, distributions."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.operators import analytics, checks, quality
from quaystone.sources import sinks


def quality_report(silver: DataFrame, found: list[checks.Check], folder: str, strict: bool = False) -> dict:
    """Writes quality.json and quality.md: verdict, checks, buckets by month, error codes, soft orphans."""
    spark = silver.sparkSession
    soft = silver.where(F.col("_is_valid") & (F.col("_dq_errors") != "")).agg(F.count(F.lit(1)).alias("valid_with_soft_errors"))
    run = silver.select("_dq_run_id").limit(1).collect()
    summary = {
        "verdict": checks.verdict(found, strict),
        "silver_run_id": run[0][0] if run else None,
        "checks": [{"name": c.name, "severity": c.severity, "observed": c.observed, "threshold": c.threshold, "comparator": c.comparator, "passed": c.passed} for c in found],
        "soft": soft.first().asDict(),
    }
    month = "_partition_month" if "_partition_month" in silver.columns else None
    parts = {"Checks": checks.as_table(spark, found), "Top error codes": quality.top_error_codes(silver), "Soft errors": soft}
    if month:
        parts |= {"Buckets by month": quality.buckets_by_month(silver, month).orderBy(month), "Rates by month": quality.rates_by_month(silver, month).orderBy(month)}
    sinks.write_json(Path(folder) / "quality.json", summary)
    sinks.write_markdown(Path(folder) / "quality.md", f"Quality: {summary['verdict']}", parts)
    return summary


def analytics_report(bronze: DataFrame, merchants: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Writes analytics.md with the six ad-hoc queries; returns them by name."""
    tx = analytics.defensive(bronze)
    results = {
        "Q0 quality peek": analytics.quality_peek(bronze),
        "Q1 daily totals": analytics.daily_running_total(tx),
        "Q2 channel share": analytics.channel_share(tx),
        "Q3 top merchants": analytics.top_merchants(tx, merchants),
        "Q4 amount outliers": analytics.amount_outliers(tx),
        "Q5 failure by category": analytics.failure_by_category(tx, merchants),
    }
    sinks.write_markdown(Path(folder) / "analytics.md", "Transactions", results)
    return results


def exploration_report(silver: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Writes exploration.md: null shares, rows a day, medians by type, status shares, a histogram of log amounts, lags."""
    good = silver.where("_is_valid")
    log = good.select(F.log1p("amount_vnd").alias("log_amount"))
    results = {
        "Null shares": analytics.null_shares(silver),
        "Rows a day": silver.groupBy("event_date").agg(F.count(F.lit(1)).alias("rows")).orderBy("event_date"),
        "Median amount by type": analytics.median_by(good, "transaction_type", "amount_vnd"),
        "Status": analytics.value_shares(silver, "status"),
        "Log amounts": analytics.histogram(log, "log_amount", 0.0, 25.0, 25).orderBy("bin"),
        "Log amounts by type": analytics.log_amount_statistics(good, "transaction_type"),
        "Lag": analytics.lag_statistics(silver),
    }
    sinks.write_markdown(Path(folder) / "exploration.md", "Exploration", results)
    return results
