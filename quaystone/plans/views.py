"""The driver's tables as payment data: all-text transactions with known faults, and their reference tables.

The texts below are read by Spark and by DuckDB alike; what differs between them is a parameter.  They make inputs, and
hold no operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"iso": "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss\")", "day": "date_format({0}, 'yyyy-MM-dd')", "month": "date_format({0}, 'yyyy-MM')"}
DUCKDB = {"iso": "strftime({0}, '%Y-%m-%dT%H:%M:%S')", "day": "strftime({0}, '%Y-%m-%d')", "month": "strftime({0}, '%Y-%m')"}

TABLES = {
    "raw_transactions": """
SELECT CASE WHEN event_id % 307 = 0 THEN '' WHEN event_id % 211 = 0 THEN 'txn_' || CAST(event_id - 1 AS STRING) ELSE 'txn_' || CAST(event_id AS STRING) || ' ' END AS transaction_id,
    CASE WHEN event_id % 131 = 0 THEN 'cus_x' ELSE ' cus_' || CAST(user_id AS STRING) END AS customer_id,
    CASE WHEN event_id % 137 = 0 THEN 'acc_x' ELSE 'acc_' || CAST(user_id AS STRING) END AS account_id,
    CASE WHEN event_id % 139 = 0 THEN 'mer_x' WHEN event_type IN ('purchase', 'click', 'error') THEN 'mer_' || CAST(event_id % 100 AS STRING) ELSE '' END AS merchant_id,
    'dev_' || CAST(user_id * 3 + event_id % 3 AS STRING) AS device_id, '' AS card_id,
    CASE WHEN event_id % 97 = 0 THEN 'NaN' WHEN event_id % 101 = 0 THEN 'amount_unknown' WHEN event_id % 103 = 0 THEN '-5.00' WHEN event_id % 109 = 0 THEN 'inf'
        ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS STRING) END AS amount,
    CASE WHEN event_id % 113 = 0 THEN 'XXX' WHEN event_id % 10 = 0 THEN ' usd' WHEN event_id % 15 = 1 THEN 'EUR' ELSE 'VND' END AS currency,
    CASE event_type WHEN 'purchase' THEN 'payment' WHEN 'click' THEN 'Transfer' WHEN 'view' THEN 'topup' WHEN 'signup' THEN 'withdrawal' ELSE 'debit' END AS transaction_type,
    CASE WHEN event_id % 127 = 0 THEN 'foo' WHEN user_id % 5 = 0 THEN 'Mobile' WHEN user_id % 5 = 1 THEN 'qr' WHEN user_id % 5 = 2 THEN 'pos' WHEN user_id % 5 = 3 THEN 'web' ELSE 'atm' END AS channel,
    CASE WHEN event_id % 89 = 0 THEN 'not_a_timestamp' WHEN event_id % 83 = 0 THEN '2099-12-31T23:59:59' ELSE {iso_ts} END AS transaction_time,
    'vn' AS country, 'City ' || CAST(user_id % 25 AS STRING) AS city,
    CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 17 = 0 THEN 'PENDING' ELSE 'success' END AS status,
    CASE WHEN event_id % 149 = 0 THEN 'loc_bad_record' ELSE 'loc_' || CAST((user_id + event_id % 4) % 25 AS STRING) END AS location_id,
    CASE WHEN event_id % 40 = 0 THEN {iso_late} ELSE {iso_soon} END AS ingestion_time,
    'core_banking' AS source_system, 'b1' AS batch_id, 'txn.csv' AS file_name, CAST(event_id AS STRING) AS source_row_number, {month_ts} AS _partition_month
FROM events""",
    "raw_customers": """
SELECT 'cus_' || CAST(c_custkey AS STRING) AS customer_id, c_name AS full_name, 'x@y' AS email, 'p' || CAST(c_custkey AS STRING) AS phone, '1980-01-02' AS dob, '2020-02-03' AS signup_date,
    'City ' || CAST(c_nationkey AS STRING) AS home_city, 'C' || CAST(c_nationkey % 7 AS STRING) AS home_country, c_mktsegment AS risk_tier, 'full' AS kyc_level FROM customer""",
    "raw_scd_events": """
SELECT 'e' || CAST(event_id AS STRING) AS event_id, 'cus_' || CAST(user_id AS STRING) AS customer_id, {iso_ts} AS change_time,
    CASE event_id % 3 WHEN 0 THEN 'risk_tier' WHEN 1 THEN 'home_city' ELSE 'phone' END AS attribute_name,
    CASE event_id % 3 WHEN 0 THEN 'T' || CAST(event_id % 5 AS STRING) WHEN 1 THEN 'City ' || CAST(event_id % 31 AS STRING) ELSE 'old' || CAST(event_id AS STRING) END AS old_value,
    '' AS new_value, 'core_banking' AS source_system FROM events""",
    "raw_accounts": """
SELECT 'acc_' || CAST(c_custkey AS STRING) AS account_id, 'cus_' || CAST(c_custkey AS STRING) AS customer_id, 'current' AS account_type, '2020-01-01' AS opened_date, 'open' AS status,
    'VND' AS currency, '1.5' AS current_balance FROM customer""",
    "raw_merchants": """
SELECT 'mer_' || CAST(s_suppkey AS STRING) AS merchant_id, s_name AS merchant_name, 'Cat ' || CAST(s_suppkey % 6 AS STRING) AS category, 'City ' || CAST(s_nationkey AS STRING) AS city, 'VN' AS country,
    '2019-01-01' AS onboarded_date, '0.5' AS risk_score, '0.1' AS base_failure_rate FROM supplier""",
    "raw_devices": """
SELECT 'dev_' || CAST(p_partkey AS STRING) AS device_id, 'cus_' || CAST(p_partkey % 150 AS STRING) AS customer_id, p_type AS device_type, p_brand AS os, '1.0' AS app_version, '2021-01-01' AS first_seen,
    CASE WHEN p_size % 2 = 0 THEN 'True' ELSE 'no' END AS is_trusted FROM part""",
    "raw_locations": """
SELECT 'loc_' || CAST(n_nationkey AS STRING) AS location_id, 'C' || CAST(n_nationkey % 7 AS STRING) AS country, 'City ' || CAST(n_nationkey AS STRING) AS city, n_name AS region, '10.5' AS lat, '106.5' AS lon,
    'UTC' AS timezone FROM nation""",
    "raw_rates": """
SELECT d AS date, '1' AS rate_vnd, CAST(24000 + CAST(substr(d, 9, 2) AS INT) AS STRING) AS rate_usd, CAST(26000 + 2 * CAST(substr(d, 9, 2) AS INT) AS STRING) AS rate_eur FROM (SELECT DISTINCT {day_ts} AS d FROM events)""",
    "raw_labels": """
SELECT 'txn_' || CAST(event_id - event_id % 3 AS STRING) AS transaction_id, CASE WHEN event_id % 23 = 0 THEN '1' ELSE '0' END AS is_fraud,
    CASE WHEN event_id % 23 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'amount_spike' ELSE 'card_testing' END ELSE '' END AS fraud_pattern FROM events""",
    "raw_manifest": """
SELECT CAST(event_id AS STRING) AS row_index, CASE WHEN event_id % 307 = 0 THEN 'null_transaction_id' WHEN event_id % 97 = 0 THEN 'invalid_amount' WHEN event_id % 89 = 0 THEN 'invalid_timestamp'
    WHEN event_id % 113 = 0 THEN 'invalid_currency' WHEN event_id % 131 = 0 THEN 'orphan_customer' ELSE 'duplicate_transaction_id' END AS error_type
FROM events WHERE event_id % 307 = 0 OR event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 113 = 0 OR event_id % 131 = 0 OR event_id % 211 = 0""",
}


def text(name: str, dialect: dict[str, str]) -> str:
    return TABLES[name].format(
        iso_ts=dialect["iso"].format("ts"), iso_late=dialect["iso"].format("ts + INTERVAL 7200 SECOND"), iso_soon=dialect["iso"].format("ts + INTERVAL 45 SECOND"),
        month_ts=dialect["month"].format("ts"), day_ts=dialect["day"].format("ts"),
    ).strip()


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Inputs over a folder of the driver's tables, each of which is opened once.  Source tables go in as arguments of
    the queries, so no view is left in the session."""
    opened: dict[str, DataFrame] = {}
    out = []
    for name in names:
        source, used = text(name, SPARK), {}
        for t in ("events", "customer", "supplier", "part", "nation"):
            if f"FROM {t}" in source:
                used[t] = opened[t] = opened[t] if t in opened else spark.read.parquet(f"{sf_dir}/{t}.parquet")
                source = source.replace(f"FROM {t}", f"FROM {{{t}}}")
        out.append(spark.sql(source, **used))
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables(spark, sf_dir, name)[0]
