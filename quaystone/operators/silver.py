"""Typed, flagged transactions: nothing is dropped, every rule leaves a flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystone.functions.exprs import codes, finite, flag, is_true, lenient_date, lenient_double, lenient_long, lenient_timestamp, strip
from quaystone.operators.prefilter import may_hold

#: Domains and the year from which a time is junk.
TYPES = ("payment", "transfer", "withdrawal", "topup", "debit")
CHANNELS = ("mobile", "qr", "pos", "web", "atm")
CURRENCIES = ("VND", "USD", "EUR")
STATUSES = ("success", "failed", "pending")
JUNK_YEAR = 2099
#: Error code of each flag, in report order.
ERROR_CODES = [
    ("_dq_null_transaction_id", "null_transaction_id"),
    ("_dq_duplicate", "duplicate_transaction_id"),
    ("_dq_invalid_amount", "invalid_amount"),
    ("_dq_invalid_timestamp", "invalid_timestamp"),
    ("_dq_invalid_currency", "invalid_currency"),
    ("_dq_invalid_channel", "invalid_channel"),
    ("_dq_invalid_type", "invalid_type"),
    ("_dq_invalid_status", "invalid_status"),
    ("_dq_invalid_location", "invalid_location"),
    ("_dq_fk_customer", "fk_customer_orphan"),
    ("_dq_fk_account", "fk_account_orphan"),
    ("_dq_fk_merchant", "fk_merchant_orphan"),
]
FLAGS = [name for name, _ in ERROR_CODES]
#: Buckets by priority, with the flags that lead to them.
BUCKETS = {
    "quarantine_duplicate_transactions": ("_dq_duplicate",),
    "quarantine_invalid_timestamp": ("_dq_invalid_timestamp",),
    "quarantine_invalid_amount": ("_dq_invalid_amount",),
    "quarantine_bad_records": ("_dq_null_transaction_id", "_dq_invalid_currency", "_dq_invalid_channel", "_dq_invalid_type", "_dq_invalid_status", "_dq_invalid_location"),
}
#: Output columns.
COLUMNS = [
    "transaction_id", "customer_id", "account_id", "merchant_id", "device_id", "card_id", "transaction_type", "channel", "status", "currency", "amount_original", "exchange_rate", "amount_vnd", "country", "city",
    "location_id", "event_time", "event_date", "ingestion_time", "ingestion_lag_seconds", "source_system", "batch_id", "file_name", "source_row_number",
    *FLAGS, "_dq_errors", "_dq_bucket", "_is_valid", "_is_duplicate_survivor", "_dq_run_id",
]
UPPER, LOWER = ("currency", "country"), ("transaction_type", "channel", "status")
STRIPPED = ["transaction_id", "customer_id", "account_id", "merchant_id", "device_id", "card_id", "city", "location_id", "source_system", "batch_id", "file_name"]


def typed(bronze: DataFrame) -> DataFrame:
    """Stripped and case-folded text, lenient numbers and times; other columns as they are."""
    text = {c: strip(c) for c in STRIPPED} | {c: F.upper(strip(c)) for c in UPPER} | {c: F.lower(strip(c)) for c in LOWER}
    return bronze.withColumns(text).withColumns(
        {
            "amount_original": lenient_double(F.col("amount")),
            "event_time": lenient_timestamp(F.col("transaction_time")),
            "ingestion_time": lenient_timestamp(F.col("ingestion_time")),
            "source_row_number": lenient_long(F.col("source_row_number")),
        }
    )


def duplicate_groups(rows: DataFrame) -> DataFrame:
    """transaction_id, n, survivor (smallest source_row_number) of ids on several rows; empty ids form no group.  Two narrow
    columns are shuffled, not the rows."""
    group = rows.where("transaction_id <> ''").groupBy("transaction_id")
    return group.agg(F.count(F.lit(1)).alias("n"), F.min("source_row_number").alias("survivor")).where("n > 1")


def with_duplicates(rows: DataFrame) -> DataFrame:
    """_is_duplicate_survivor and _dq_duplicate, over the whole table (duplicates cross months)."""
    groups = duplicate_groups(rows).select(F.col("transaction_id").alias("_dup_id"), "survivor")
    # a row for each id: its part is hashed, and the wide rows are not sorted
    joined = rows.join(groups.hint("shuffle_hash"), F.col("transaction_id") == F.col("_dup_id"), "left")
    survivor = flag(F.col("source_row_number") == F.col("survivor"))
    return joined.withColumns({"_is_duplicate_survivor": F.col("_dup_id").isNotNull() & survivor, "_dq_duplicate": F.col("_dup_id").isNotNull() & ~survivor}).drop("_dup_id", "survivor")


def known(rows: DataFrame, ids: DataFrame, column: str, hit: str, asked: DataFrame | None = None) -> DataFrame:
    """A boolean column: whether the id is in a reference table.  Spark sends the ids along if they are few.  With ``asked``,
    rows that hold every id of ``rows``, ids that it can't ask for are left out before they are shuffled."""
    once = ids.select(strip(column).alias(f"_{hit}_id"))
    if asked is not None:
        once = may_hold(once, F.col(f"_{hit}_id"), asked, F.col(column))
    once = once.distinct().withColumn(hit, F.lit(True))
    return rows.join(once, F.col(column) == F.col(f"_{hit}_id"), "left").drop(f"_{hit}_id").withColumn(hit, flag(F.col(hit)))


def rates_by_date(rates: DataFrame) -> DataFrame:
    """_rate_date and a column for each currency, in VND; of several records for a date the last one counts: the latest payload's,
    by its time and then its file, and in that the last."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("generated_at", "_payload") if c in rates.columns]
    order = F.struct(*parts, *([F.col("_row")] if "_row" in rates.columns else []), *[F.col(f"rate_{c.lower()}").cast("string") for c in CURRENCIES])
    return rates.groupBy(F.col("date").cast("string").alias("_rate_date")).agg(
        *[F.max_by(lenient_double(F.col(f"rate_{c.lower()}").cast("string")), order).alias(c) for c in CURRENCIES]
    )


def daily_rates(rates: DataFrame) -> DataFrame:
    """_rate_date, _rate_currency, exchange_rate in VND, of ``rates_by_date``."""
    return rates_by_date(rates).unpivot("_rate_date", list(CURRENCIES), "_rate_currency", "exchange_rate")


def with_rates(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """exchange_rate and amount_vnd by the event's date and currency; null where no rate is known.  Dates and currencies are few
    keys for any number of rows, so the rows are not shuffled by them.  A date has one row, so Spark leaves the join out where no
    one asks for an amount in VND."""
    named = {c: f"_rate_{c.lower()}" for c in CURRENCIES}
    # a row for each date
    wide = F.broadcast(rates_by_date(rates).withColumnsRenamed(named))
    joined = rows.join(wide, F.date_format("event_time", "yyyy-MM-dd") == F.col("_rate_date"), "left")
    rate = F.coalesce(*[F.when(F.col("currency") == c, F.col(n)) for c, n in named.items()])
    return joined.withColumn("exchange_rate", rate).drop("_rate_date", *named.values()).withColumn("amount_vnd", F.col("amount_original") * F.col("exchange_rate"))


def bucket() -> Column:
    """The first bucket one of whose flags holds, else empty."""
    out = None
    for name, flags in BUCKETS.items():
        any_of = F.lit(False)
        for f in flags:
            any_of = any_of | F.col(f)
        out = F.when(any_of, name) if out is None else out.when(any_of, name)
    return out.otherwise("")


def rule_flags() -> dict[str, Column]:
    """Flags that need the row alone."""
    outside = lambda c, domain: ~F.col(c).isin(*domain)
    return {
        "_dq_null_transaction_id": F.col("transaction_id") == "",
        "_dq_invalid_amount": ~finite(F.col("amount_original")) | flag(F.col("amount_original") <= 0),
        "_dq_invalid_timestamp": F.col("event_time").isNull() | flag(F.year("event_time") >= JUNK_YEAR),
        "_dq_invalid_currency": outside("currency", CURRENCIES),
        "_dq_invalid_channel": outside("channel", CHANNELS),
        "_dq_invalid_type": outside("transaction_type", TYPES),
        "_dq_invalid_status": outside("status", STATUSES),
    }


def silver_transactions(bronze: DataFrame, *, customers: DataFrame, accounts: DataFrame, merchants: DataFrame, locations: DataFrame, rates: DataFrame, run_id: str, large: tuple[str, ...] = ()) -> DataFrame:
    """41 typed columns for every Bronze row.  The duplicate survivor is chosen before any other rule, so an id may lose
    all its rows; orphan keys are soft flags and leave a row valid.

    ``large`` names the id columns whose reference tables are far larger than the rows, as for a day's batch against all
    customers: such a table is filtered by the batch's ids first, for one more scan of that column of the batch."""
    base = typed(bronze)
    rows = with_rates(with_duplicates(base), rates)
    for ids, column, hit in ((customers, "customer_id", "_has_customer"), (accounts, "account_id", "_has_account"), (merchants, "merchant_id", "_has_merchant"), (locations, "location_id", "_has_location")):
        rows = known(rows, ids, column, hit, base if column in large else None)
    lag = F.timestamp_diff("SECOND", F.col("event_time"), F.col("ingestion_time"))
    rows = rows.withColumns(rule_flags()).withColumns(
        {
            "_dq_invalid_location": ~F.col("_has_location"),
            "_dq_fk_customer": ~F.col("_has_customer"),
            "_dq_fk_account": ~F.col("_has_account"),
            "_dq_fk_merchant": (F.col("merchant_id") != "") & ~F.col("_has_merchant"),
            "event_date": F.col("event_time").cast("date"),
            "ingestion_lag_seconds": lag.cast("long"),
            "_dq_run_id": F.lit(run_id),
        }
    )
    rows = rows.withColumns({"_dq_errors": codes(ERROR_CODES), "_dq_bucket": bucket()})
    rows = rows.withColumn("_is_valid", F.col("_dq_bucket") == "")
    return rows.select(*COLUMNS, *[c for c in ("_partition_month",) if c in bronze.columns])


#: Typed columns of the dimension tables; all others stay text.
DIM_TYPES = {
    "customers": {"dob": "date", "signup_date": "date"},
    "accounts": {"opened_date": "date", "current_balance": "double"},
    "merchants": {"onboarded_date": "date", "risk_score": "double", "base_failure_rate": "double"},
    "devices": {"first_seen": "date", "is_trusted": "boolean"},
    "locations": {"lat": "double", "lon": "double"},
    "customer_scd_events": {"change_time": "timestamp"},
    "exchange_rates": {"rate_vnd": "double", "rate_usd": "double", "rate_eur": "double"},
}
_CASTS = {"date": lenient_date, "double": lenient_double, "boolean": is_true, "timestamp": lenient_timestamp}


def silver_dimension(bronze: DataFrame, table: str) -> DataFrame:
    """A dimension with its columns cast leniently; lineage columns go."""
    casts = DIM_TYPES.get(table, {})
    return bronze.select(*[_CASTS[casts[c]](F.col(c)).alias(c) if c in casts else F.col(c) for c in bronze.columns if not c.startswith("_")])
