"""DuckDB SQL for the registered queries: written on its own, from the rules, over the same inputs."""

from __future__ import annotations

from quaystone.plans.views import DUCKDB, text


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


_INPUTS = {name: name for name in ("raw_transactions", "raw_customers", "raw_scd_events", "raw_accounts", "raw_merchants", "raw_devices", "raw_locations", "raw_rates", "raw_labels", "raw_manifest")}
_FLAGS = [
    "null_transaction_id", "duplicate", "invalid_amount", "invalid_timestamp", "invalid_currency", "invalid_channel", "invalid_type", "invalid_status", "invalid_location", "fk_customer", "fk_account", "fk_merchant",
]
_CODE = {f: f for f in _FLAGS} | {"duplicate": "duplicate_transaction_id", "fk_customer": "fk_customer_orphan", "fk_account": "fk_account_orphan", "fk_merchant": "fk_merchant_orphan"}

#: name -> (inputs it needs, text)
_STEPS: dict[str, tuple[tuple[str, ...], str]] = {
    "tx": (
        ("raw_transactions",),
        """SELECT * REPLACE (CASE WHEN isfinite(TRY_CAST(amount AS DOUBLE)) THEN TRY_CAST(amount AS DOUBLE) END AS amount), TRY_CAST(transaction_time AS TIMESTAMP) AS event_time FROM raw_transactions""",
    ),
    "typed": (
        ("raw_transactions",),
        f"""SELECT {", ".join(f"{_strip(c)} AS {c}" for c in ("transaction_id", "customer_id", "account_id", "merchant_id", "device_id", "card_id", "city", "location_id", "source_system", "batch_id", "file_name"))},
    upper({_strip('currency')}) AS currency, upper({_strip('country')}) AS country, lower({_strip('transaction_type')}) AS transaction_type, lower({_strip('channel')}) AS channel, lower({_strip('status')}) AS status,
    TRY_CAST(amount AS DOUBLE) AS amount_original, TRY_CAST(transaction_time AS TIMESTAMP) AS event_time, TRY_CAST(ingestion_time AS TIMESTAMP) AS ingestion_time, CAST(source_row_number AS BIGINT) AS source_row_number, _partition_month
FROM raw_transactions""",
    ),
    "flagged": (
        ("typed", "raw_customers", "raw_accounts", "raw_merchants", "raw_locations", "raw_rates"),
        """SELECT t.*, g.n > 1 AS in_group, coalesce(g.n > 1 AND source_row_number = g.least, FALSE) AS _is_duplicate_survivor,
    t.transaction_id = '' AS _dq_null_transaction_id, coalesce(g.n > 1 AND source_row_number <> g.least, FALSE) AS _dq_duplicate,
    NOT (amount_original IS NOT NULL AND isfinite(amount_original) AND amount_original > 0) AS _dq_invalid_amount,
    event_time IS NULL OR year(event_time) >= 2099 AS _dq_invalid_timestamp,
    currency NOT IN ('VND', 'USD', 'EUR') AS _dq_invalid_currency, channel NOT IN ('mobile', 'qr', 'pos', 'web', 'atm') AS _dq_invalid_channel,
    transaction_type NOT IN ('payment', 'transfer', 'withdrawal', 'topup', 'debit') AS _dq_invalid_type, status NOT IN ('success', 'failed', 'pending') AS _dq_invalid_status,
    location_id NOT IN (SELECT location_id FROM raw_locations) AS _dq_invalid_location, customer_id NOT IN (SELECT customer_id FROM raw_customers) AS _dq_fk_customer,
    account_id NOT IN (SELECT account_id FROM raw_accounts) AS _dq_fk_account, merchant_id <> '' AND merchant_id NOT IN (SELECT merchant_id FROM raw_merchants) AS _dq_fk_merchant,
    CAST(CASE currency WHEN 'VND' THEN r.rate_vnd WHEN 'USD' THEN r.rate_usd WHEN 'EUR' THEN r.rate_eur END AS DOUBLE) AS exchange_rate
FROM typed t LEFT JOIN (SELECT transaction_id, count(*) AS n, min(source_row_number) AS least FROM typed WHERE transaction_id <> '' GROUP BY 1) g ON g.transaction_id = t.transaction_id
LEFT JOIN raw_rates r ON r.date = strftime(t.event_time, '%Y-%m-%d')""",
    ),
    "silver": (
        ("flagged",),
        f"""SELECT *, amount_original * exchange_rate AS amount_vnd, CAST(event_time AS DATE) AS event_date, date_diff('second', event_time, ingestion_time) AS ingestion_lag_seconds,
    concat_ws(',', {", ".join(f"CASE WHEN _dq_{f} THEN '{_CODE[f]}' END" for f in _FLAGS)}) AS _dq_errors,
    CASE WHEN _dq_duplicate THEN 'quarantine_duplicate_transactions' WHEN _dq_invalid_timestamp THEN 'quarantine_invalid_timestamp' WHEN _dq_invalid_amount THEN 'quarantine_invalid_amount'
        WHEN _dq_null_transaction_id OR _dq_invalid_currency OR _dq_invalid_channel OR _dq_invalid_type OR _dq_invalid_status OR _dq_invalid_location THEN 'quarantine_bad_records' ELSE '' END AS _dq_bucket,
    _dq_bucket = '' AS _is_valid, 'run' AS _dq_run_id FROM flagged""",
    ),
    "clean": (("silver",), "SELECT * FROM silver WHERE _is_valid"),
    "scd_events": (("raw_scd_events",), "SELECT event_id, customer_id, CAST(change_time AS TIMESTAMP) AS change_time, attribute_name, old_value FROM raw_scd_events"),
    "versions": (
        ("scd_events", "raw_customers", "raw_locations"),
        """SELECT c.customer_id, full_name, email,
    coalesce((SELECT old_value FROM scd_events x WHERE x.customer_id = c.customer_id AND x.attribute_name = 'phone' AND (x.change_time, x.event_id) >= (e.change_time, e.event_id) ORDER BY x.change_time, x.event_id LIMIT 1), phone) AS phone,
    CAST(dob AS DATE) AS dob, CAST(signup_date AS DATE) AS signup_date,
    coalesce((SELECT old_value FROM scd_events x WHERE x.customer_id = c.customer_id AND x.attribute_name = 'home_city' AND (x.change_time, x.event_id) >= (e.change_time, e.event_id) ORDER BY x.change_time, x.event_id LIMIT 1), home_city) AS home_city,
    coalesce((SELECT l.country FROM scd_events x JOIN raw_locations l ON l.city = x.old_value WHERE x.customer_id = c.customer_id AND x.attribute_name = 'home_city' AND (x.change_time, x.event_id) >= (e.change_time, e.event_id) ORDER BY x.change_time, x.event_id LIMIT 1), home_country) AS home_country,
    coalesce((SELECT old_value FROM scd_events x WHERE x.customer_id = c.customer_id AND x.attribute_name = 'risk_tier' AND (x.change_time, x.event_id) >= (e.change_time, e.event_id) ORDER BY x.change_time, x.event_id LIMIT 1), risk_tier) AS risk_tier,
    kyc_level, coalesce(lag(e.change_time) OVER (PARTITION BY e.customer_id ORDER BY e.change_time, e.event_id), TIMESTAMP '1900-01-01') AS valid_from, e.change_time AS valid_to, FALSE AS is_current
FROM scd_events e JOIN raw_customers c ON c.customer_id = e.customer_id
UNION ALL SELECT c.customer_id, full_name, email, phone, CAST(dob AS DATE), CAST(signup_date AS DATE), home_city, home_country, risk_tier, kyc_level,
    coalesce((SELECT max(change_time) FROM scd_events e WHERE e.customer_id = c.customer_id), TIMESTAMP '1900-01-01'), TIMESTAMP '9999-12-31', TRUE FROM raw_customers c""",
    ),
    "dim_customer": (
        ("versions",),
        """SELECT row_number() OVER (ORDER BY customer_id, valid_from, valid_to) AS customer_sk, * FROM versions
UNION ALL SELECT -1, 'UNKNOWN', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TIMESTAMP '1900-01-01', TIMESTAMP '9999-12-31', TRUE""",
    ),
    "dim_merchant": (
        ("raw_merchants",),
        """SELECT row_number() OVER (ORDER BY merchant_id) AS merchant_sk, merchant_id, merchant_name, category, city, country, CAST(onboarded_date AS DATE) AS onboarded_date, CAST(risk_score AS DOUBLE) AS risk_score FROM raw_merchants
UNION ALL SELECT -1, 'UNKNOWN', NULL, NULL, NULL, NULL, NULL, NULL""",
    ),
    "dim_account": (
        ("raw_accounts",),
        """SELECT row_number() OVER (ORDER BY account_id) AS account_sk, account_id, customer_id, account_type, CAST(opened_date AS DATE) AS opened_date, status, currency FROM raw_accounts
UNION ALL SELECT -1, 'UNKNOWN', NULL, NULL, NULL, NULL, NULL""",
    ),
    "dim_device": (
        ("raw_devices",),
        """SELECT row_number() OVER (ORDER BY device_id) AS device_sk, device_id, customer_id, device_type, os, app_version, CAST(first_seen AS DATE) AS first_seen, lower(is_trusted) = 'true' AS is_trusted FROM raw_devices
UNION ALL SELECT -1, 'UNKNOWN', NULL, NULL, NULL, NULL, NULL, NULL""",
    ),
    "dim_location": (
        ("raw_locations",),
        """SELECT row_number() OVER (ORDER BY location_id) AS location_sk, location_id, country, city, region, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, timezone FROM raw_locations
UNION ALL SELECT -1, 'UNKNOWN', NULL, NULL, NULL, NULL, NULL, NULL""",
    ),
    "labels": (("raw_labels",), "SELECT transaction_id, max(CAST(is_fraud AS INT)) AS is_fraud, max(nullif(fraud_pattern, '')) AS fraud_pattern FROM raw_labels GROUP BY 1"),
    "fact": (
        ("clean", "dim_customer", "dim_account", "dim_merchant", "dim_device", "dim_location", "labels"),
        """SELECT t.transaction_id, CAST(strftime(event_date, '%Y%m%d') AS INT) AS date_key, coalesce(c.customer_sk, -1) AS customer_sk, coalesce(a.account_sk, -1) AS account_sk, coalesce(m.merchant_sk, -1) AS merchant_sk,
    coalesce(d.device_sk, -1) AS device_sk, coalesce(l.location_sk, -1) AS location_sk, channel, transaction_type, t.status, t.currency, f.fraud_pattern, amount_original, exchange_rate, amount_vnd,
    coalesce(f.is_fraud, 0) AS is_fraud, event_time, ingestion_time, ingestion_lag_seconds
FROM clean t ASOF LEFT JOIN (SELECT customer_id, valid_from, max(customer_sk) AS customer_sk FROM dim_customer WHERE customer_sk <> -1 AND valid_from < valid_to GROUP BY ALL) c ON c.customer_id = t.customer_id AND t.event_time >= c.valid_from
LEFT JOIN dim_account a ON a.account_id = t.account_id LEFT JOIN dim_merchant m ON m.merchant_id = t.merchant_id LEFT JOIN dim_device d ON d.device_id = t.device_id LEFT JOIN dim_location l ON l.location_id = t.location_id
LEFT JOIN labels f ON f.transaction_id = t.transaction_id""",
    ),
    "dim_date": (
        (),
        """SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_key, CAST(d AS DATE) AS full_date, CAST(year(d) AS INT) AS year, CAST(quarter(d) AS INT) AS quarter, CAST(month(d) AS INT) AS month, monthname(d) AS month_name,
    CAST(day(d) AS INT) AS day, CAST(isodow(d) AS INT) AS day_of_week, dayname(d) AS day_name, isodow(d) >= 6 AS is_weekend, day(d) IN (1, 2, 14, 15) AS is_payday
FROM (SELECT unnest(generate_series((SELECT date_trunc('month', min(ts)) FROM events), (SELECT date_trunc('day', last_day(max(ts))) FROM events), INTERVAL 1 DAY)) AS d)""",
    ),
    "base": (
        ("fact", "dim_customer", "dim_location"),
        """SELECT f.transaction_id, c.customer_id, c.home_country, l.country AS txn_country, f.device_sk, f.merchant_sk, f.event_time, f.amount_vnd, f.status, f.is_fraud, f.fraud_pattern
FROM fact f JOIN dim_customer c ON c.customer_sk = f.customer_sk LEFT JOIN dim_location l ON l.location_sk = f.location_sk WHERE f.customer_sk <> -1""",
    ),
    "gaps": (
        ("base",),
        """SELECT *, row_number() OVER (PARTITION BY customer_id, device_sk ORDER BY event_time, transaction_id) = 1 AS new_device, row_number() OVER (PARTITION BY customer_id, txn_country ORDER BY event_time, transaction_id) = 1 AS new_place,
    coalesce(event_time - lag(event_time) OVER (PARTITION BY customer_id, merchant_sk ORDER BY event_time, transaction_id) > INTERVAL 24 HOUR, TRUE) AS new_merchant,
    coalesce(event_time - lag(event_time) OVER (PARTITION BY customer_id, device_sk ORDER BY event_time, transaction_id) > INTERVAL 7 DAY, TRUE) AS new_dev FROM base""",
    ),
    "features": (
        ("gaps",),
        """SELECT *, avg(amount_vnd) OVER week AS a, stddev_samp(amount_vnd) OVER week AS s, count(*) OVER hr AS n1, count(*) OVER dy AS n24, CAST(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER dy AS BIGINT) AS f24,
    CAST(sum(CAST(new_merchant AS INT)) OVER dy AS BIGINT) AS um, CAST(sum(CAST(new_dev AS INT)) OVER week AS BIGINT) AS ud, count(DISTINCT merchant_sk) OVER dy AS umx, count(DISTINCT device_sk) OVER week AS udx
FROM gaps WINDOW hr AS (PARTITION BY customer_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), dy AS (PARTITION BY customer_id ORDER BY event_time RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW),
    week AS (PARTITION BY customer_id ORDER BY event_time RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""",
    ),
    "mart_features": (
        ("features",),
        """SELECT transaction_id, customer_id, event_time, is_fraud, fraud_pattern, amount_vnd AS txn_amount, round(a, 2) AS avg_amount_7d, coalesce((amount_vnd - a) / nullif(s, 0), 0) AS z, round(z, 4) + 0.0 AS amount_zscore, n1 AS txn_count_1h,
    n24 AS txn_count_24h, um AS unique_merchants_24h, ud AS unique_devices_7d, CAST(new_device AS INT) AS is_new_device, CAST(new_place AS INT) AS is_new_location, f24 AS failed_txn_count_24h,
    CASE WHEN hour(event_time) <= 5 THEN 1 ELSE 0 END AS night_transaction_flag, CASE WHEN amount_vnd > 46000000 THEN 1 ELSE 0 END AS high_amount_flag, CASE WHEN txn_country IS DISTINCT FROM home_country THEN 1 ELSE 0 END AS cross_country_flag,
    round(0.5 * least(CAST(n24 AS DOUBLE) / 10, 3) + 0.4 * least(greatest(z, 0), 5) + 0.1 * least(CAST(f24 AS DOUBLE), 10), 3) AS velocity_risk_score FROM features""",
    ),
}


def with_steps(select: str, *needed: str) -> str:
    """The select with the steps it needs, and theirs, before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in _STEPS[name][0] if name in _STEPS else ():
            visit(n)
        order.append(name)

    for n in needed:
        visit(n)
    steps = ",\n".join(f"{n} AS MATERIALIZED ({_STEPS[n][1] if n in _STEPS else text(n, DUCKDB)})" for n in order)
    return f"WITH {steps}\n{select}"


_SILVER = (
    "transaction_id, customer_id, account_id, merchant_id, device_id, card_id, transaction_type, channel, status, currency, amount_original, exchange_rate, amount_vnd, country, city, location_id, event_time, event_date, "
    "ingestion_time, ingestion_lag_seconds, source_system, batch_id, file_name, source_row_number, " + ", ".join(f"_dq_{f}" for f in _FLAGS) + ", _dq_errors, _dq_bucket, _is_valid, _is_duplicate_survivor, _dq_run_id"
)
_FACT_COLUMNS = "transaction_id, date_key, customer_sk, account_sk, merchant_sk, device_sk, location_sk, channel, transaction_type, status, currency, fraud_pattern, amount_original, exchange_rate, amount_vnd, is_fraud, event_time, ingestion_time, ingestion_lag_seconds"
#: Limits of the rates.
_LIMITS = {
    "null_transaction_id": 0.003, "invalid_amount": 0.01, "invalid_timestamp": 0.0075, "invalid_currency": 0.003, "invalid_channel": 0.003, "invalid_type": 0.001, "invalid_status": 0.001,
    "invalid_location": 0.003, "duplicate": 0.005, "fk_customer": 0.01, "fk_account": 0.01, "fk_merchant": 0.01,
}
_BUCKETS = ["quarantine_duplicate_transactions", "quarantine_invalid_timestamp", "quarantine_invalid_amount", "quarantine_bad_records"]
_SKS = ["customer_sk", "account_sk", "merchant_sk", "device_sk", "location_sk"]
_BIT = "CAST(sum(CASE WHEN {0} THEN 1 ELSE 0 END) AS BIGINT)"


def _n(condition: str) -> str:
    return _BIT.format(condition)


def _gates(*rows: tuple[str, str, str]) -> str:
    """gate, observed, expected, passed from scalar queries."""
    union = " UNION ALL ".join(f"SELECT '{name}' AS gate, CAST(coalesce(({a}), 0) AS DOUBLE) AS observed, CAST(coalesce(({b}), 0) AS DOUBLE) AS expected" for name, a, b in rows)
    return f"SELECT *, abs(observed - expected) <= CASE gate WHEN 'amount_vnd_sum_conserved' THEN 1 ELSE 0 END AS passed FROM ({union})"


def _twice(table: str, key: str = "transaction_id", having: str = "count(*) > 1", where: str = "TRUE") -> str:
    return f"SELECT count(*) FROM (SELECT {key} FROM {table} WHERE {where} GROUP BY 1 HAVING {having})"


def _checks_sql() -> str:
    rate = lambda f: f"(SELECT round({_n(f)} / count(*), 6) FROM silver)"
    rows = [(f"rate_{f}", "rate", "WARNING", rate(f"_dq_{f}"), limit, "<=") for f, limit in _LIMITS.items()]
    rows.append(("valid_rate", "rate", "WARNING", rate("_is_valid"), 0.95, ">="))
    counts = {
        "rowcount_silver_eq_bronze": "SELECT (SELECT count(*) FROM silver) - (SELECT count(*) FROM raw_transactions)",
        "schema_conformance": "SELECT 0",
        "amount_vnd_notnull_when_valid": "SELECT count(*) FROM clean WHERE amount_vnd IS NULL",
        "exchange_rate_notnull_when_valid": "SELECT count(*) FROM clean WHERE exchange_rate IS NULL",
        "bucket_consistency": "SELECT count(*) FROM silver WHERE _is_valid <> (_dq_bucket = '')",
        "event_date_in_window": "SELECT count(*) FROM clean WHERE NOT coalesce(event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31', FALSE)",
        "exactly_one_survivor_per_group": _twice("silver", having="count(*) > 1 AND sum(CAST(_is_duplicate_survivor AS INT)) <> 1", where="transaction_id <> ''"),
        "no_dup_among_valid": _twice("clean", where="transaction_id <> ''"),
    }
    rows += [(name, "integrity", "ERROR", f"({q})", 0, "==") for name, q in counts.items()]
    rows.append(("manifest_coverage", "reconciliation", "ERROR", "(SELECT min(round(CAST(caught AS DOUBLE) / injected, 6)) FROM covered)", 0.99, ">="))
    union = " UNION ALL ".join(f"""SELECT '{n}' AS name, '{g}' AS "group", '{s}' AS severity, CAST({q} AS DOUBLE) AS observed, CAST({t} AS DOUBLE) AS threshold, '{c}' AS comparator""" for n, g, s, q, t, c in rows)
    return f"SELECT *, CASE comparator WHEN '<=' THEN observed <= threshold WHEN '>=' THEN observed >= threshold ELSE observed = threshold END AS passed FROM ({union})"


_COVERED = """SELECT error_type, count(*) AS injected, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS caught, round(sum(CAST(hit AS INT)) / count(*), 6) AS coverage FROM (
    SELECT error_type, coalesce(CASE error_type WHEN 'null_transaction_id' THEN _dq_null_transaction_id WHEN 'invalid_amount' THEN _dq_invalid_amount WHEN 'invalid_timestamp' THEN _dq_invalid_timestamp WHEN 'invalid_currency' THEN _dq_invalid_currency
        WHEN 'orphan_customer' THEN _dq_fk_customer WHEN 'duplicate_transaction_id' THEN _dq_duplicate OR _is_duplicate_survivor END, FALSE) AS hit
    FROM raw_manifest LEFT JOIN silver ON source_row_number = CAST(row_index AS BIGINT)) GROUP BY 1"""
_STEPS["covered"] = (("raw_manifest", "silver"), _COVERED)
_STEPS["mart_daily"] = (("fact",), "SELECT date_key, count(*) AS txn_count, sum(is_fraud) AS fraud_count FROM fact GROUP BY 1")
_STEPS["mart_customer"] = (
    ("fact", "dim_customer"),
    "SELECT c.customer_id, count(*) AS txn_count, sum(is_fraud) AS fraud_count, sum(is_fraud) / count(*) AS fraud_rate, sum(CASE WHEN f.status = 'failed' THEN 1 ELSE 0 END) / count(*) AS failed_rate FROM fact f JOIN dim_customer c ON c.customer_sk = f.customer_sk GROUP BY 1",
)
_STEPS["mart_merchant"] = (("fact", "dim_merchant"), "SELECT m.merchant_id, count(*) AS txn_count FROM fact f JOIN dim_merchant m ON m.merchant_sk = f.merchant_sk WHERE f.merchant_sk <> -1 GROUP BY 1")

_COUNT = "SELECT count(*) FROM"
_QUARANTINE_GATES = (
    ("conservation_sum_eq_silver", f"SELECT ({_COUNT} clean) + ({_COUNT} silver WHERE NOT _is_valid)", f"{_COUNT} silver"),
    ("clean_eq_valid", f"{_COUNT} clean", f"{_COUNT} silver WHERE _is_valid"),
    ("buckets_match_report", f"{_COUNT} (SELECT _dq_bucket FROM silver WHERE NOT _is_valid AND _dq_bucket NOT IN ({', '.join(f"'{b}'" for b in _BUCKETS)}))", "0"),
    ("no_valid_in_quarantine", f"{_COUNT} clean WHERE NOT _is_valid", "0"),
    ("reason_non_empty", f"{_COUNT} silver WHERE NOT _is_valid AND coalesce(_dq_errors, '') = ''", "0"),
    ("bucket_purity", "0", "0"),
    ("transaction_id_unique_in_clean", _twice("clean", where="transaction_id <> ''"), "0"),
)
_GOLD_GATES = (
    ("fact_rowcount_eq_clean", f"{_COUNT} fact", f"{_COUNT} clean"),
    ("no_null_sk", f"SELECT {' + '.join(_n(f'{k} IS NULL') for k in [*_SKS, 'date_key'])} FROM fact", "0"),
    ("all_sk_resolve_to_dim", "SELECT " + " + ".join(f"({_COUNT} fact WHERE {k} NOT IN (SELECT {k} FROM dim_{k.removesuffix('_sk')}))" for k in _SKS), "0"),
    ("date_key_in_dim_date", f"{_COUNT} fact WHERE date_key NOT IN (SELECT date_key FROM dim_date)", "0"),
    ("fraud_pattern_consistency", f"{_COUNT} fact WHERE (is_fraud = 1) <> (fraud_pattern IS NOT NULL)", "0"),
    ("transaction_id_unique", _twice("fact"), "0"),
    ("one_is_current_per_customer", _twice("dim_customer", "customer_id", "sum(CAST(is_current AS INT)) <> 1"), "0"),
    ("amount_vnd_sum_conserved", "SELECT round((SELECT sum(amount_vnd) FROM fact) - (SELECT sum(amount_vnd) FROM clean), 2) + 0.0", "0"),
    ("unknown_usage", f"SELECT {' + '.join(_n(f'{k} = -1') for k in _SKS)} FROM fact", f"SELECT {' + '.join(_n(f'{k} = -1') for k in _SKS)} FROM fact"),
    ("is_fraud_total", "SELECT sum(is_fraud) FROM fact", f"{_COUNT} clean WHERE transaction_id IN (SELECT transaction_id FROM labels WHERE is_fraud = 1)"),
)
_MART_GATES = (
    ("daily_sum_txn", "SELECT sum(txn_count) FROM mart_daily", f"{_COUNT} fact"),
    ("daily_rowcount", f"{_COUNT} mart_daily", "SELECT count(DISTINCT date_key) FROM fact"),
    ("daily_fraud", "SELECT sum(fraud_count) FROM mart_daily", "SELECT sum(is_fraud) FROM fact"),
    ("customer_sum_txn", "SELECT sum(txn_count) FROM mart_customer", f"{_COUNT} fact"),
    ("customer_rowcount", f"{_COUNT} mart_customer", "SELECT count(DISTINCT customer_id) FROM fact f JOIN dim_customer c ON c.customer_sk = f.customer_sk"),
    ("customer_fraud", "SELECT sum(fraud_count) FROM mart_customer", "SELECT sum(is_fraud) FROM fact"),
    ("customer_rate_bounds", f"{_COUNT} mart_customer WHERE NOT (fraud_rate BETWEEN 0 AND 1 AND failed_rate BETWEEN 0 AND 1)", "0"),
    ("merchant_rowcount", f"{_COUNT} mart_merchant", "SELECT count(DISTINCT merchant_sk) FROM fact WHERE merchant_sk <> -1"),
    ("merchant_sum_txn", "SELECT sum(txn_count) FROM mart_merchant", f"{_COUNT} fact WHERE merchant_sk <> -1"),
    ("fraud_features_rowcount", f"{_COUNT} mart_features", f"{_COUNT} fact WHERE customer_sk <> -1"),
    ("fraud_features_is_fraud", "SELECT sum(is_fraud) FROM mart_features", "SELECT sum(is_fraud) FROM fact WHERE customer_sk <> -1"),
    ("fraud_features_zscore_not_null", f"{_COUNT} mart_features WHERE amount_zscore IS NULL", "0"),
    ("fraud_features_count_monotonic", f"{_COUNT} mart_features WHERE txn_count_1h > txn_count_24h", "0"),
    ("fraud_features_txn_unique", _twice("mart_features"), "0"),
)

ORACLES = {
    "dq_checks": with_steps(_checks_sql(), "silver", "clean", "raw_transactions", "covered"),
    "quarantine_gates": with_steps(_gates(*_QUARANTINE_GATES), "silver", "clean"),
    "gold_gates": with_steps(_gates(*_GOLD_GATES), "clean", "fact", "dim_date"),
    "mart_gates": with_steps(_gates(*_MART_GATES), "fact", "dim_customer", "mart_daily", "mart_customer", "mart_merchant", "mart_features"),
    "generator_invariants": """
WITH c AS (SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(*) FROM supplier) AS merchants, (SELECT count(*) FROM orders) AS n, CAST(round_even((SELECT count(*) FROM orders) * 0.007, 0) AS BIGINT) AS fraud),
mix AS (SELECT * FROM (VALUES (1, 'velocity_burst', 0.25), (2, 'amount_spike', 0.20), (3, 'new_device_location', 0.20), (4, 'cross_country', 0.15), (5, 'night_high_amount', 0.12), (6, 'card_testing', 0.08)) m(nth, pattern, share)),
part AS (SELECT nth, pattern, fraud, CAST(floor(round(fraud * share, 9)) AS BIGINT) AS whole, round(fraud * share, 9) - whole AS rest FROM mix, c),
given AS (SELECT pattern, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, nth) <= fraud - sum(whole) OVER () THEN 1 ELSE 0 END AS n FROM part)
SELECT 'fraud: ' || pattern AS "check", CAST(n AS BIGINT) AS n FROM given UNION ALL SELECT 'fraud_labels', fraud FROM c UNION ALL SELECT 'transactions', n FROM c
UNION ALL SELECT unnest(['errors on fraud', 'empty ids not injected', 'ids not of their row', 'outside the window', 'not in the file of their month', 'bad locations not injected', 'unexpected_orphans', 'unexpected_faults', 'unexpected_duplicates']), 0
UNION ALL SELECT 'customers', customers FROM c UNION ALL SELECT 'merchants', merchants FROM c UNION ALL SELECT 'accounts', CAST(round_even(customers * 1.2, 0) AS BIGINT) FROM c UNION ALL SELECT 'devices', CAST(round_even(customers * 1.5, 0) AS BIGINT) FROM c
UNION ALL SELECT 'cards', CAST(round_even(customers * 0.8, 0) AS BIGINT) FROM c UNION ALL SELECT 'rate days', date_diff('day', DATE '2025-12-13', DATE '2026-06-10') + 1 UNION ALL SELECT 'customer events', CAST(greatest(customers, round_even(customers * 2.5, 0)) AS BIGINT) FROM c""",
    "landing_csv": with_steps("SELECT *, '2024-01-01T00:00:00' AS _ingested_at, 'merchants.csv' AS _source_file, 'merchant_csv' AS _source_system, 'b1' AS _batch_id FROM raw_merchants", "raw_merchants"),
    "landing_transactions": with_steps("SELECT *, 'txn_month=' || _partition_month AS _source_file FROM raw_transactions", "raw_transactions"),
    "landing_rates_json": with_steps(
        """SELECT date, 'VND' AS base_currency, 'VND' AS quote, rate_vnd, rate_usd, rate_eur, 'fx_api' AS source_system, CAST(row_number() OVER (PARTITION BY substr(date, 1, 7) ORDER BY date) - 1 AS INT) AS _row,
    '2024-01-01T00:00:00' AS _ingested_at, 'rates.json' AS _source_file, 'mock_fx_api' AS _source_system, '2024-01-01T00:00:00' AS generated_at, 'b1' AS _batch_id FROM raw_rates""",
        "raw_rates",
    ),
    "replaced_partitions": "SELECT event_id, event_type, CASE WHEN event_type = 'click' THEN value + 1 ELSE value END AS value FROM events",
    "ctas_mart": "SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
    "footer_rows": "SELECT count(*) AS rows FROM orders",
    "schema_only": "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM events)",
    "sql_script": "SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice > 1000 GROUP BY 1",
    "q0_quality_peek": with_steps(
        f"SELECT count(*) AS total_rows, {_n('NOT coalesce(isfinite(TRY_CAST(amount AS DOUBLE)), FALSE)')} AS bad_amount, {_n('TRY_CAST(transaction_time AS TIMESTAMP) IS NULL')} AS bad_timestamp, {_n(chr(39).join(['transaction_id = ', '', '']))} AS empty_txn_id FROM raw_transactions",
        "raw_transactions",
    ),
    "q1_daily_running_total": with_steps(
        "SELECT CAST(event_time AS DATE) AS txn_date, count(*) AS txn_count, round(sum(amount)) AS total_amount_vnd, round(sum(sum(amount)) OVER (ORDER BY CAST(event_time AS DATE))) AS running_total_vnd FROM tx WHERE amount > 0 AND event_time IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 15",
        "tx",
    ),
    "q2_channel_share": with_steps("SELECT channel, count(*) AS txn_count, round(sum(amount)) AS total_amount_vnd, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct_of_txn FROM tx WHERE amount > 0 GROUP BY 1", "tx"),
    "q3_top_merchants": with_steps(
        "SELECT CAST(rank() OVER (ORDER BY sum(t.amount) DESC) AS INT) AS rnk, t.merchant_id, m.merchant_name, m.category, count(*) AS txn_count, round(sum(t.amount)) AS total_amount_vnd FROM tx t JOIN raw_merchants m ON m.merchant_id = t.merchant_id WHERE t.amount > 0 AND t.merchant_id <> '' GROUP BY 2, 3, 4 ORDER BY 1, 2 LIMIT 10",
        "tx", "raw_merchants",
    ),
    "q4_amount_outliers": with_steps(
        """SELECT customer_id, transaction_id, transaction_type, round(amount) AS amount_vnd, round(z, 2) AS amount_zscore FROM (
    SELECT *, (amount - avg(amount) OVER (PARTITION BY customer_id)) / nullif(stddev_samp(amount) OVER (PARTITION BY customer_id), 0) AS z, count(*) OVER (PARTITION BY customer_id) AS n FROM tx WHERE amount > 0)
WHERE z > 3 AND n >= 10 ORDER BY z DESC, transaction_id LIMIT 15""",
        "tx",
    ),
    "q5_failure_by_category": with_steps("SELECT m.category, count(*) AS txn_count, round(100.0 * sum(CASE WHEN t.status = 'failed' THEN 1 ELSE 0 END) / count(*), 2) AS fail_pct FROM tx t JOIN raw_merchants m ON m.merchant_id = t.merchant_id WHERE t.merchant_id <> '' GROUP BY 1", "tx", "raw_merchants"),
    "silver_transactions": with_steps(f"SELECT {_SILVER}, _partition_month FROM silver", "silver"),
    "silver_duplicate_survivors": with_steps("SELECT transaction_id, count(*) AS n, min(source_row_number) AS survivor FROM typed WHERE transaction_id <> '' GROUP BY 1 HAVING count(*) > 1", "typed"),
    "silver_fx_conversion": with_steps("SELECT event_date, currency, count(*) AS n, min(exchange_rate) AS low_rate, max(exchange_rate) AS high_rate, round(sum(CASE WHEN isfinite(amount_vnd) THEN amount_vnd END), 2) AS amount_vnd FROM silver GROUP BY 1, 2", "silver"),
    "silver_dimension_casts": with_steps("SELECT device_id, customer_id, device_type, os, app_version, CAST(first_seen AS DATE) AS first_seen, lower(is_trusted) = 'true' AS is_trusted FROM raw_devices", "raw_devices"),
    "fx_unpivot": with_steps("SELECT date AS _rate_date, _rate_currency, CAST(r AS DOUBLE) AS exchange_rate FROM (SELECT date, unnest(['VND', 'USD', 'EUR']) AS _rate_currency, unnest([rate_vnd, rate_usd, rate_eur]) AS r FROM raw_rates)", "raw_rates"),
    "bronze_lineage": with_steps("SELECT *, '2024-01-01T00:00:00' AS _ingested_at, 'merchants.csv' AS _source_file, 'merchant_csv' AS _source_system, 'b1' AS _batch_id FROM raw_merchants", "raw_merchants"),
    "json_flatten": "SELECT event_id, CAST(props ->> 'k' AS BIGINT) AS k, '{\"k\":\"' || (props ->> 'k') || '\"}' AS metadata FROM events",
    "quarantine_rows": with_steps("SELECT _dq_bucket AS quarantine_bucket, _dq_errors AS quarantine_reason, source_row_number, transaction_id FROM silver WHERE NOT _is_valid", "silver"),
    "clean_rows": with_steps("SELECT transaction_id, amount_vnd, _dq_errors FROM clean", "clean"),
    "fk_left_anti": with_steps("SELECT transaction_id, customer_id FROM typed t WHERE NOT EXISTS (SELECT 1 FROM raw_customers c WHERE c.customer_id = t.customer_id)", "typed", "raw_customers"),
    "orphans_prefiltered": with_steps("SELECT source_row_number, transaction_id, _dq_fk_customer, _dq_fk_account, _dq_fk_merchant, _dq_invalid_location FROM silver", "silver"),
    "dq_flag_rates": with_steps(
        "\nUNION ALL ".join(f"SELECT '{f}' AS flag, {_n(f)} AS n, round({_n(f)} / count(*), 6) AS rate FROM silver" for f in [*[f"_dq_{x}" for x in _FLAGS], "_is_valid"]), "silver"
    ),
    "dq_rates_by_month": with_steps(f"SELECT _partition_month, count(*) AS rows, {', '.join(f'round(avg(CAST(_dq_{f} AS INT)), 6) AS rate_dq_{f}' for f in _FLAGS)} FROM silver GROUP BY 1", "silver"),
    "dq_buckets_by_month": with_steps(
        "SELECT _partition_month, " + _n("_dq_bucket = ''") + " AS valid, " + ", ".join(_n(f"_dq_bucket = '{b}'") + f" AS {b}" for b in ("quarantine_duplicate_transactions", "quarantine_invalid_timestamp", "quarantine_invalid_amount", "quarantine_bad_records")) + " FROM silver GROUP BY 1",
        "silver",
    ),
    "dq_top_error_codes": with_steps("SELECT error_code, count(*) AS n FROM (SELECT unnest(string_split(_dq_errors, ',')) AS error_code FROM silver WHERE _dq_errors <> '') GROUP BY 1", "silver"),
    "dq_integrity": with_steps(
        f"""SELECT count(*) AS rows, {_n('_is_valid AND amount_vnd IS NULL')} AS amount_vnd_notnull_when_valid, {_n('_is_valid AND exchange_rate IS NULL')} AS exchange_rate_notnull_when_valid, {_n("_is_valid <> (_dq_bucket = '')")} AS bucket_consistency,
    {_n("_is_valid AND NOT coalesce(event_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20', FALSE)")} AS event_date_in_window,
    (SELECT count(*) FROM (SELECT transaction_id FROM silver WHERE transaction_id <> '' GROUP BY 1 HAVING count(*) > 1 AND sum(CAST(_is_duplicate_survivor AS INT)) <> 1)) AS exactly_one_survivor_per_group,
    (SELECT count(*) FROM (SELECT transaction_id FROM clean WHERE transaction_id <> '' GROUP BY 1 HAVING count(*) > 1)) AS no_dup_among_valid FROM silver""",
        "silver", "clean",
    ),
    "dq_manifest_coverage": with_steps("SELECT * FROM covered", "covered"),
    "dim_date": with_steps("SELECT * FROM dim_date", "dim_date"),
    "dim_account": with_steps("SELECT * FROM dim_account", "dim_account"),
    "dim_merchant": with_steps("SELECT * FROM dim_merchant", "dim_merchant"),
    "dim_device": with_steps("SELECT * FROM dim_device", "dim_device"),
    "dim_location": with_steps("SELECT * FROM dim_location", "dim_location"),
    "dim_customer_scd2": with_steps("SELECT * REPLACE (strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to) FROM dim_customer", "dim_customer"),
    "fraud_label_per_id": with_steps("SELECT transaction_id AS _key, is_fraud, fraud_pattern FROM labels", "labels"),
    "fact_transactions": with_steps(f"SELECT {_FACT_COLUMNS} FROM fact", "fact"),
    "asof_orders": """
WITH v AS (SELECT o_custkey AS k, o_orderdate AS valid_from, max(o_orderkey) AS sk FROM orders GROUP BY 1, 2)
SELECT o.o_orderkey, coalesce(v.sk, -1) AS customer_sk FROM orders o ASOF LEFT JOIN v ON v.k = o.o_custkey AND o.o_orderdate >= v.valid_from""",
    "constraints": with_steps(
        """SELECT 'unique(transaction_id)' AS "constraint", CAST(coalesce((SELECT sum(n) FROM (SELECT count(*) AS n FROM typed GROUP BY transaction_id HAVING count(*) > 1)), 0) AS BIGINT) AS rows
UNION ALL SELECT 'not_null(event_time)', count(*) FROM typed WHERE event_time IS NULL UNION ALL SELECT 'not_null(amount_original)', count(*) FROM typed WHERE amount_original IS NULL
UNION ALL SELECT 'foreign(customer_id)', count(*) FROM typed WHERE customer_id NOT IN (SELECT customer_id FROM raw_customers) UNION ALL SELECT 'foreign(location_id)', count(*) FROM typed WHERE location_id NOT IN (SELECT location_id FROM raw_locations)""",
        "typed", "raw_customers", "raw_locations",
    ),
    "mart_daily": with_steps(
        f"""SELECT d.date_key, full_date, year, month, is_weekend, is_payday, txn_count, total_amount_vnd, success_count, failed_count, pending_count, success_amount_vnd, fraud_count, fraud_amount_vnd, distinct_customers, avg_amount_vnd,
    round(sum(total_amount_vnd) OVER (ORDER BY d.date_key), 2) AS running_total_vnd FROM (
    SELECT date_key, count(*) AS txn_count, round(sum(amount_vnd), 2) AS total_amount_vnd, {_n("status = 'success'")} AS success_count, {_n("status = 'failed'")} AS failed_count, {_n("status = 'pending'")} AS pending_count,
    round(sum(CASE WHEN status = 'success' THEN amount_vnd ELSE 0 END), 2) AS success_amount_vnd, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, round(sum(CASE WHEN is_fraud = 1 THEN amount_vnd ELSE 0 END), 2) AS fraud_amount_vnd,
    count(DISTINCT customer_sk) AS distinct_customers, round(avg(amount_vnd), 2) AS avg_amount_vnd FROM fact GROUP BY 1) x JOIN dim_date d ON d.date_key = x.date_key""",
        "fact", "dim_date",
    ),
    "mart_customer_risk": with_steps(
        f"""SELECT a.*, c.risk_tier, c.home_city, c.home_country, coalesce(fraud_count > 0 OR fraud_rate >= 0.05 OR max_amount_zscore >= 4 OR max_txn_count_1h >= 3 OR distinct_devices >= 5, FALSE) AS watchlist_flag FROM (
    SELECT customer_id, count(*) AS txn_count, round(sum(amount_vnd), 2) AS total_amount_vnd, round(avg(amount_vnd), 2) AS avg_amount_vnd, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, round(sum(is_fraud) / count(*), 4) AS fraud_rate,
    count(DISTINCT device_sk) AS distinct_devices, count(DISTINCT location_sk) AS distinct_locations, {_n("status = 'failed'")} AS failed_count, round(sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) / count(*), 4) AS failed_rate,
    round(max(z), 2) + 0.0 AS max_amount_zscore, max(n1) AS max_txn_count_1h FROM (
        SELECT c.customer_id, f.*, (amount_vnd - avg(amount_vnd) OVER (PARTITION BY c.customer_id)) / nullif(stddev_samp(amount_vnd) OVER (PARTITION BY c.customer_id), 0) AS z,
        count(*) OVER (PARTITION BY c.customer_id ORDER BY event_time RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n1 FROM fact f JOIN dim_customer c ON c.customer_sk = f.customer_sk) GROUP BY 1) a
LEFT JOIN dim_customer c ON c.customer_id = a.customer_id AND c.is_current""",
        "fact", "dim_customer",
    ),
    "mart_merchant_risk": with_steps(
        f"""SELECT merchant_id, merchant_name, category, city, m.country, risk_score, count(*) AS txn_count, round(sum(amount_vnd), 2) AS total_amount_vnd, {_n("f.status = 'failed'")} AS failed_count,
    round(sum(CASE WHEN f.status = 'failed' THEN 1 ELSE 0 END) / count(*), 4) AS failed_rate, CAST(sum(is_fraud) AS BIGINT) AS fraud_count, round(sum(is_fraud) / count(*), 4) AS fraud_rate, count(DISTINCT customer_sk) AS distinct_customers
FROM fact f JOIN dim_merchant m ON m.merchant_sk = f.merchant_sk WHERE f.merchant_sk <> -1 GROUP BY 1, 2, 3, 4, 5, 6""",
        "fact", "dim_merchant",
    ),
    "mart_fraud_features": with_steps("SELECT * EXCLUDE (z) FROM mart_features", "mart_features"),
    "exact_distinct_window": with_steps("SELECT transaction_id, um AS unique_merchants_24h, umx AS unique_merchants_24h_exact, ud AS unique_devices_7d, udx AS unique_devices_7d_exact FROM features", "features"),
    "feature_separation": with_steps(
        """SELECT coalesce(fraud_pattern, 'legit') AS pattern, count(*) AS n, round(avg(amount_zscore), 2) + 0.0 AS avg_zscore, round(avg(txn_count_1h), 2) AS avg_txn_1h, round(avg(txn_count_24h), 2) AS avg_txn_24h, round(avg(is_new_device), 2) AS avg_new_device,
    round(avg(cross_country_flag), 2) AS avg_cross_country, round(avg(night_transaction_flag), 2) AS avg_night, round(avg(velocity_risk_score), 3) AS avg_velocity FROM mart_features GROUP BY 1""",
        "mart_features",
    ),
    "velocity_trailing_counts": """
SELECT event_id, count(*) OVER h AS n_1h, count(*) OVER d AS n_24h, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER d AS BIGINT) AS errors_24h, round(avg(value) OVER w, 6) AS avg_7d, round(stddev_samp(value) OVER w, 6) AS std_7d FROM events
WINDOW h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW),
    w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""",
    "ingestion_lag_stats": """
SELECT CAST(trunc(quantile_cont(lag, 0.5)) AS BIGINT) AS p50, CAST(trunc(quantile_cont(lag, 0.95)) AS BIGINT) AS p95, CAST(trunc(quantile_cont(lag, 0.99)) AS BIGINT) AS p99, max(lag) AS max_lag, round(avg(CASE WHEN lag > 3600 THEN 1 ELSE 0 END), 6) AS late_share
FROM (SELECT date_diff('second', o_orderdate, l_shipdate) AS lag FROM lineitem JOIN orders ON o_orderkey = l_orderkey)""",
    "log_amount_stats": "SELECT event_type, count(*) AS n, round(avg(ln(1 + value)), 6) AS mean_log, round(stddev_samp(ln(1 + value)), 6) AS std_log FROM events WHERE value > 0 GROUP BY 1",
    "value_shares": "SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1",
    "quantiles": "SELECT unnest([0.5, 0.95, 0.99, 0.999]::DOUBLE[]) AS q, unnest([round(quantile_cont(value, 0.5), 6), round(quantile_cont(value, 0.95), 6), round(quantile_cont(value, 0.99), 6), round(quantile_cont(value, 0.999), 6)]) AS value FROM events",
    "null_shares": with_steps("SELECT unnest(['amount_original', 'event_time', 'exchange_rate', 'amount_vnd']) AS \"column\", unnest([round(avg(CAST(amount_original IS NULL AS INT)), 6), round(avg(CAST(event_time IS NULL AS INT)), 6), round(avg(CAST(exchange_rate IS NULL AS INT)), 6), round(avg(CAST(amount_vnd IS NULL AS INT)), 6)]) AS null_share FROM silver", "silver"),
    "median_by_type": "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY 1",
    "histogram": "SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 200 THEN 21 ELSE floor(value / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1",
    "calibration": with_steps(
        """SELECT t.type, coalesce(n, 0) AS n, coalesce(round(CAST(n AS DOUBLE) / sum(n) OVER (), 6), 0) AS share, mu, sigma, cap, mean, coalesce(fraud_n, 0) AS fraud_n, coalesce(round(CAST(fraud_n AS DOUBLE) / n, 6), 0) AS fraud_rate, fraud_mu, fraud_sigma
FROM (SELECT unnest(['payment', 'transfer', 'withdrawal', 'topup', 'debit', 'refund']) AS type) t LEFT JOIN (
    SELECT transaction_type, count(*) AS n, round(avg(ln(x + 1)), 6) AS mu, round(stddev_samp(ln(x + 1)), 6) AS sigma, CAST(trunc(greatest(1, quantile_cont(x, 0.999))) AS BIGINT) AS cap, round(avg(x), 4) AS mean,
        CAST(sum(bad) AS BIGINT) AS fraud_n, round(avg(CASE WHEN bad = 1 THEN ln(x + 1) END), 6) AS fraud_mu, round(stddev_samp(CASE WHEN bad = 1 THEN ln(x + 1) END), 6) AS fraud_sigma
    FROM (SELECT transaction_type, amount_original * 20 AS x, coalesce(is_fraud, 0) AS bad FROM typed t LEFT JOIN labels l ON l.transaction_id = t.transaction_id WHERE isfinite(amount_original) AND amount_original > 0) GROUP BY 1) a ON a.transaction_type = t.type""",
        "typed", "labels",
    ),
    "raw_amount_statistics": with_steps(
        """SELECT a.*, p50, p95, p50 AS median FROM (SELECT transaction_type, count(*) AS n, round(avg(ln(1 + x)), 6) AS mean_log, round(stddev_samp(ln(1 + x)), 6) AS std_log FROM (SELECT transaction_type, amount_original AS x FROM typed WHERE isfinite(amount_original) AND amount_original > 0) GROUP BY 1) a
JOIN (SELECT transaction_type, round(quantile_cont(amount_original, 0.5), 4) AS p50, round(quantile_cont(amount_original, 0.95), 4) AS p95 FROM typed WHERE isfinite(amount_original) GROUP BY 1) b ON b.transaction_type = a.transaction_type""",
        "typed",
    ),
    "landing_reordered": with_steps(
        """SELECT * REPLACE (CASE WHEN CAST(substr(merchant_id, 5) AS BIGINT) % 2 = 1 THEN '' ELSE city END AS city), '2024-01-01T00:00:00' AS _ingested_at, 'merchant_csv' AS _source_system, 'b1' AS _batch_id FROM raw_merchants""", "raw_merchants"
    ),
    "landing_rejects": with_steps(
        """SELECT CASE WHEN n % 10 = 3 THEN 'missing_fields' ELSE 'extra_fields' END AS reason, merchant_id || ',' || merchant_name || ',' || category || ',' || city || ',' || country || ',' || onboarded_date || ',' || risk_score
    || CASE WHEN n % 10 = 7 THEN ',' || base_failure_rate || ',more' ELSE '' END AS record FROM (SELECT *, CAST(substr(merchant_id, 5) AS BIGINT) AS n FROM raw_merchants) WHERE n % 10 IN (3, 7)
UNION ALL SELECT 'landed', CAST((SELECT count(*) FROM raw_merchants WHERE CAST(substr(merchant_id, 5) AS BIGINT) % 10 NOT IN (3, 7)) AS VARCHAR)""",
        "raw_merchants",
    ),
    "duplicate_batches": with_steps("SELECT transaction_id, count(*) AS n, min(source_row_number) AS survivor FROM typed WHERE transaction_id <> '' GROUP BY 1 HAVING count(*) > 1", "typed"),
    "asof_events": """
WITH v AS (SELECT user_id AS k, ts AS valid_from, max(event_id) AS sk FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT e.event_id, coalesce(v.sk, -1) AS customer_sk FROM events e ASOF LEFT JOIN v ON v.k = e.user_id AND e.ts >= v.valid_from""",
    "scd2_by_delta": with_steps("SELECT * REPLACE (strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to) FROM versions", "versions"),
    "dq_by_grain": with_steps(
        "\nUNION ALL ".join(
            f"SELECT '{grain}' AS grain, {month} AS month, count(*) AS rows, {', '.join(_n(f'_dq_{f}') + f' AS n_dq_{f}' for f in _FLAGS)}, {', '.join(_n(f'_dq_bucket = {chr(39)}{b}{chr(39)}') + f' AS {b}' for b in _BUCKETS)}, "
            f"{_n('_is_valid')} AS valid, round({_n('_is_valid')} / count(*), 6) AS valid_rate FROM silver{group}"
            for grain, month, group in (("month", "_partition_month", " GROUP BY _partition_month"), ("total", "NULL", ""))
        ),
        "silver",
    ),
    "published_versions": "SELECT event_id, event_type, value FROM events WHERE event_type <> 'click'",
    "known_members": with_steps("SELECT * FROM dim_merchant WHERE merchant_sk <> -1", "dim_merchant"),
    "empty_buckets": "SELECT unnest(['quarantine_duplicate_transactions', 'quarantine_invalid_timestamp', 'quarantine_invalid_amount', 'quarantine_bad_records']) AS bucket, CAST(0 AS BIGINT) AS rows, CAST(46 AS BIGINT) AS columns",
    "labels_from_csv": with_steps("SELECT transaction_id AS _key, is_fraud, fraud_pattern FROM labels", "labels"),
    "raw_validation": with_steps(
        """, named AS (SELECT DISTINCT row_index FROM raw_manifest), r AS (SELECT t.*, m.row_index IS NULL AS unnamed, TRY_CAST(amount AS DOUBLE) AS x FROM raw_transactions t LEFT JOIN named m ON m.row_index = t.source_row_number)
SELECT 'rows' AS "check", count(*) AS n FROM r
UNION ALL SELECT 'unexpected_orphans', count(*) FROM r WHERE unnamed AND (customer_id NOT IN (SELECT customer_id FROM raw_customers) OR account_id NOT IN (SELECT account_id FROM raw_accounts) OR (merchant_id <> '' AND merchant_id NOT IN (SELECT merchant_id FROM raw_merchants)))
UNION ALL SELECT 'unexpected_faults', count(*) FROM r WHERE unnamed AND (x IS NULL OR isnan(x) OR x <= 0 OR currency NOT IN ('VND', 'USD', 'EUR') OR channel NOT IN ('mobile', 'qr', 'pos', 'web', 'atm'))
UNION ALL SELECT 'unexpected_duplicates', count(*) FROM (SELECT transaction_id FROM raw_transactions WHERE transaction_id IN (SELECT transaction_id FROM raw_transactions WHERE transaction_id <> '' GROUP BY 1 HAVING count(*) > 1)
    AND source_row_number NOT IN (SELECT row_index FROM raw_manifest WHERE error_type = 'duplicate_transaction_id') GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'fraud_labels', CAST((SELECT sum(CAST(is_fraud AS INT)) FROM raw_labels) AS BIGINT)""",
        "raw_transactions", "raw_manifest", "raw_labels", "raw_customers", "raw_accounts", "raw_merchants",
    ),
    "distinct_rollup": with_steps(
        "\nUNION ALL ".join(
            f"SELECT '{k}' AS key, '{grain}' AS grain, {group} AS \"group\", count(DISTINCT {k}) AS n FROM fact{by}"
            for k in ("customer_sk", "merchant_sk", "device_sk")
            for grain, group, by in (("fine", "CAST(date_key AS VARCHAR)", " GROUP BY date_key"), ("coarse", "CAST(date_key // 100 AS VARCHAR)", " GROUP BY date_key // 100"), ("all", "'all'", ""))
        ),
        "fact",
    ),
    "weekly_features": """
WITH b AS (SELECT *, event_id % 7 AS device, event_id % 11 AS merchant, event_id % 5 AS place FROM events),
g AS (SELECT *, row_number() OVER (PARTITION BY user_id, device ORDER BY ts, CAST(event_id AS VARCHAR)) = 1 AS new_device, row_number() OVER (PARTITION BY user_id, place ORDER BY ts, CAST(event_id AS VARCHAR)) = 1 AS new_place,
    coalesce(ts - lag(ts) OVER (PARTITION BY user_id, merchant ORDER BY ts, CAST(event_id AS VARCHAR)) > INTERVAL 24 HOUR, TRUE) AS fresh_merchant,
    coalesce(ts - lag(ts) OVER (PARTITION BY user_id, device ORDER BY ts, CAST(event_id AS VARCHAR)) > INTERVAL 7 DAY, TRUE) AS fresh_device FROM b)
SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(new_device AS INT) AS is_new_device, CAST(new_place AS INT) AS is_new_location, count(*) OVER h AS txn_count_1h, count(*) OVER d AS txn_count_24h,
    CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER d AS BIGINT) AS failed_txn_count_24h, CAST(sum(CAST(fresh_merchant AS INT)) OVER d AS BIGINT) AS unique_merchants_24h, CAST(sum(CAST(fresh_device AS INT)) OVER w AS BIGINT) AS unique_devices_7d,
    round(avg(value) OVER w, 8) AS avg_7d, round(stddev_samp(value) OVER w, 6) AS std_7d FROM g
WINDOW h AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), d AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW),
    w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW)""",
}
ORACLES["mart_files"] = ORACLES["mart_merchant_risk"]
