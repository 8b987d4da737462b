"""Registered queries: every operator of the engine over the driver's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.exprs import ntz
from quaystone.operators import analytics, checks, dims, distinct, fact, incremental, marts, quality, quarantine, silver, synth
from quaystone.plans.star import Star
from quaystone.plans.views import table, tables
from quaystone.sources import landing, sinks
from quaystone.sources.scratch import Scratch

STAMP = "2024-01-01T00:00:00"
RAW = {
    "transactions": "raw_transactions", "customers": "raw_customers", "customer_scd_events": "raw_scd_events", "accounts": "raw_accounts", "merchants": "raw_merchants",
    "devices": "raw_devices", "locations": "raw_locations", "exchange_rates": "raw_rates", "fraud_labels": "raw_labels",
}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def star(spark: SparkSession, sf_dir: str) -> Star:
    return Star(spark, dict(zip(RAW, tables(spark, sf_dir, *RAW.values()), strict=True)), "run", dims.calendar_of(driver(spark, sf_dir, "events"), "ts"))


def driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def defensive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.defensive(table(spark, sf_dir, "raw_transactions"))


# -- ad-hoc queries


@query
def q0_quality_peek(spark, sf_dir):
    return analytics.quality_peek(table(spark, sf_dir, "raw_transactions"))


@query
def q1_daily_running_total(spark, sf_dir):
    return analytics.daily_running_total(defensive(spark, sf_dir))


@query
def q2_channel_share(spark, sf_dir):
    return analytics.channel_share(defensive(spark, sf_dir))


@query
def q3_top_merchants(spark, sf_dir):
    return analytics.top_merchants(defensive(spark, sf_dir), table(spark, sf_dir, "raw_merchants"))


@query
def q4_amount_outliers(spark, sf_dir):
    return analytics.amount_outliers(defensive(spark, sf_dir), least_z=3)


@query
def q5_failure_by_category(spark, sf_dir):
    return analytics.failure_by_category(defensive(spark, sf_dir), table(spark, sf_dir, "raw_merchants"))


# -- landing


@query
def bronze_lineage(spark, sf_dir):
    return landing.stamp(table(spark, sf_dir, "raw_merchants"), "merchants.csv", "merchant_csv", "b1", STAMP)


def written(spark, sf_dir, name: str) -> str:
    """A driver table's rows as a raw file of ``name`` in the scratch folder, to be landed."""
    base, s = Scratch(spark).base, lambda c: F.col(c).cast("string").alias(c)
    if name == "merchants.csv":
        rows = table(spark, sf_dir, "raw_merchants").select(*landing.CSV_SOURCES["merchants"][0])
        rows.write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(f"{base}/{name}")
    elif name == "transactions":
        rows = table(spark, sf_dir, "raw_transactions").withColumnRenamed("_partition_month", "txn_month")
        rows.write.partitionBy("txn_month").options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(f"{base}/{name}")
    elif name == "rates.json":  # a document for each month
        r = table(spark, sf_dir, "raw_rates")
        rates = F.struct(F.col("rate_vnd").alias("VND"), F.col("rate_usd").alias("USD"), F.col("rate_eur").alias("EUR"))
        record = F.struct("date", F.lit("VND").alias("base_currency"), F.lit("VND").alias("quote"), rates.alias("rates"), F.lit("fx_api").alias("source_system"))
        months = r.groupBy(F.substring("date", 1, 7)).agg(F.sort_array(F.collect_list(record)).alias("records"))
        months.select(F.to_json(F.struct(F.lit("fx").alias("api_name"), F.lit(STAMP).alias("generated_at"), "records"))).write.text(f"{base}/{name}")
    else:  # a document for each user and day
        e = driver(spark, sf_dir, "events").withColumn("metadata", F.from_json("props", "map<string, string>"))
        record = F.struct(s("event_id"), F.col("user_id").cast("string").alias("customer_id"), "event_type", F.col("ts").cast("string").alias("event_time"), "metadata")
        users = e.groupBy("user_id", F.to_date("ts")).agg(F.collect_list(record).alias("records"))
        users.select(F.to_json(F.struct("records"))).write.text(f"{base}/{name}")
    return f"{base}/{name}"


@query
def json_flatten(spark, sf_dir):
    rows = landing.land_customer_events(spark, written(spark, sf_dir, "events.json"), "b1", STAMP, one_document=False)
    return rows.select(F.col("event_id").cast("long").alias("event_id"), F.get_json_object("metadata", "$.k").cast("long").alias("k"), "metadata")


@query
def landing_csv(spark, sf_dir):
    return landing.land_csv(spark, written(spark, sf_dir, "merchants.csv"), "merchants", "b1", STAMP)


@query
def landing_reordered(spark, sf_dir):
    """Merchants from two files whose columns stand in another order; one has a column more, one lacks one."""
    base, columns = Scratch(spark).base, landing.CSV_SOURCES["merchants"][0]
    rows = table(spark, sf_dir, "raw_merchants").withColumns({"n": F.substring("merchant_id", 5, 9).cast("long"), "note": F.lit("x")})
    write = lambda part, names, name: part.select(*names).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, emptyValue="").csv(f"{base}/{name}")
    write(rows.where("n % 2 = 0"), [*reversed(columns), "note"], "merchants-0.csv")
    write(rows.where("n % 2 = 1"), [c for c in columns if c != "city"], "merchants-1.csv")
    return landing.land_csv(spark, f"{base}/merchants-*.csv", "merchants", "b1", STAMP).drop("_source_file")


@query
def landing_rejects(spark, sf_dir):
    """Records of merchants that are a field short or one too long."""
    base, columns = Scratch(spark).base, landing.CSV_SOURCES["merchants"][0]
    rows = table(spark, sf_dir, "raw_merchants").withColumn("n", F.substring("merchant_id", 5, 9).cast("long"))
    line = F.when(F.col("n") % 10 == 3, F.concat_ws(",", *columns[:-1])).when(F.col("n") % 10 == 7, F.concat_ws(",", *columns, F.lit("more"))).otherwise(F.concat_ws(",", *columns))
    # one file: a header and a line for each merchant
    head = spark.range(1).select(F.lit(0).alias("o"), F.lit(",".join(columns)).alias("value"))
    head.unionByName(rows.select(F.lit(1).alias("o"), line.alias("value"))).coalesce(1).sortWithinPartitions("o").select("value").write.text(f"{base}/merchants.csv")
    found = landing.rejected_csv(spark, f"{base}/merchants.csv", columns).select("reason", "record")
    good = landing.read_csv(spark, f"{base}/merchants.csv", columns)
    return found.unionByName(good.agg(F.count(F.lit(1)).alias("n")).select(F.lit("landed").alias("reason"), F.col("n").cast("string").alias("record")))


@query
def landing_transactions(spark, sf_dir):
    rows = landing.land_transactions(spark, f"{written(spark, sf_dir, 'transactions')}/txn_month=*", "b1", STAMP)
    return rows.select(*landing.TRANSACTION_COLUMNS, "_partition_month", "_source_file")


@query
def landing_rates_json(spark, sf_dir):
    return landing.land_exchange_rates(spark, written(spark, sf_dir, "rates.json"), "b1", STAMP, one_document=False).drop("_payload")


@query
def replaced_partitions(spark, sf_dir):
    path = f"{Scratch(spark).base}/events"
    rows = driver(spark, sf_dir, "events").select("event_id", "event_type", "value")
    sinks.replace_table(rows.limit(0), path, ("event_type",))  # what the folder held before
    sinks.replace_table(rows, path, ("event_type",))
    sinks.replace_partitions(rows.where("event_type = 'click'").withColumn("value", F.col("value") + 1), path, "event_type")
    return spark.read.schema("event_id long, value double, event_type string").parquet(path)


@query
def published_versions(spark, sf_dir):
    """A published table after a second version took the place of the first."""
    path, rows = f"{Scratch(spark).base}/published", driver(spark, sf_dir, "events").select("event_id", "event_type", "value")
    sinks.publish(rows.where("event_type = 'click'"), path)
    sinks.publish(rows.where("event_type <> 'click'"), path, ("event_type",))
    sinks.forget_versions(spark, path)
    return sinks.published(spark, path).select("event_id", "event_type", "value")


@query
def known_members(spark, sf_dir):
    """The rows of a dimension without its Unknown member, as a load into a table of declared keys takes them."""
    path = f"{Scratch(spark).base}/merchants"
    sinks.replace_table(star(spark, sf_dir).dim_merchant, path)
    return spark.read.parquet(path).where(F.col("merchant_sk") != dims.UNKNOWN_SK)


@query
def mart_files(spark, sf_dir):
    """A mart written to parquet and read again."""
    path = f"{Scratch(spark).base}/mart_merchant_risk"
    sinks.replace_table(star(spark, sf_dir).mart_merchant_risk, path)
    return spark.read.parquet(path)


@query
def empty_buckets(spark, sf_dir):
    """Rows and columns of the quarantine's tables on disk where no row is rejected: each has its schema."""
    base, rows = Scratch(spark).base, star(spark, sf_dir).silver.where("_is_valid")
    out = None
    for name, part in quarantine.buckets(quarantine.quarantine(rows, "run", STAMP)).items():
        sinks.replace_table(part, f"{base}/{name}")
        back = spark.read.parquet(f"{base}/{name}")
        one = back.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("bucket"), "rows", F.lit(len(back.columns)).cast("long").alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def labels_from_csv(spark, sf_dir):
    """Labels landed from CSV by three of their columns, one for each transaction."""
    base = Scratch(spark).base
    table(spark, sf_dir, "raw_labels").withColumn("label_source", F.lit("rules")).write.options(header=True, emptyValue="").csv(f"{base}/fraud_labels.csv")
    return fact.label_per_id(landing.read_csv(spark, f"{base}/fraud_labels.csv", ["transaction_id", "is_fraud", "fraud_pattern"]))


@query
def raw_validation(spark, sf_dir):
    """Faults of the raw transactions that the manifest does not name."""
    names = ("raw_transactions", "raw_manifest", "raw_labels", "raw_customers", "raw_accounts", "raw_merchants")
    return synth.validate_raw(*tables(spark, sf_dir, *names))


@query
def ctas_mart(spark, sf_dir):
    scratch = Scratch(spark)
    name = f"quaystone_{scratch.base.rsplit('/', 1)[-1]}"
    select = f"SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM parquet.`{sf_dir}/orders.parquet` GROUP BY 1"
    return sinks.create_table_as(spark, name, select, f"{scratch.base}/mart")


@query
def footer_rows(spark, sf_dir):
    return landing.rows_by_file(spark, f"{sf_dir}/orders.parquet").agg(F.sum("rows").alias("rows"))


@query
def schema_only(spark, sf_dir):
    return landing.schema_of(spark, f"{sf_dir}/events.parquet").select("name")


@query
def sql_script(spark, sf_dir):
    script = f"""
-- orders over 1000; the view is this script's own
CREATE OR REPLACE TEMPORARY VIEW quaystone_orders AS SELECT o_orderpriority, o_totalprice FROM parquet.`{sf_dir}/orders.parquet` WHERE o_totalprice > 1000;
-- name: by_priority
SELECT o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM quaystone_orders GROUP BY 1;
DROP VIEW quaystone_orders;
"""
    return sinks.run_script(spark, script)["by_priority"]


# -- typed and flagged layer


@query
def silver_transactions(spark, sf_dir):
    return star(spark, sf_dir).silver


@query
def silver_duplicate_survivors(spark, sf_dir):
    return silver.duplicate_groups(silver.typed(table(spark, sf_dir, "raw_transactions")))


@query
def duplicate_batches(spark, sf_dir):
    """Duplicate groups from batches that come one after another, with the last one taken twice."""
    rows = silver.typed(table(spark, sf_dir, "raw_transactions"))
    state = incremental.DuplicateState(spark, f"{Scratch(spark).base}/duplicates", 8)
    for i in range(3):
        state.add(rows.where(F.pmod("source_row_number", F.lit(3)) == i), f"part {i}")
    state.add(rows.where(F.pmod("source_row_number", F.lit(3)) == 2), "part 2")
    return state.table().where("n > 1")


@query
def silver_fx_conversion(spark, sf_dir):
    amount = F.when(~F.isnan("amount_vnd") & (F.abs("amount_vnd") != float("inf")), F.col("amount_vnd"))
    rows = star(spark, sf_dir).silver.groupBy("event_date", "currency")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("exchange_rate").alias("low_rate"), F.max("exchange_rate").alias("high_rate"), F.round(F.sum(amount), 2).alias("amount_vnd"))


@query
def silver_dimension_casts(spark, sf_dir):
    return silver.silver_dimension(table(spark, sf_dir, "raw_devices"), "devices")


@query
def fx_unpivot(spark, sf_dir):
    return silver.daily_rates(table(spark, sf_dir, "raw_rates"))


@query
def quarantine_rows(spark, sf_dir):
    return quarantine.quarantine(star(spark, sf_dir).silver, "run", STAMP).select("quarantine_bucket", "quarantine_reason", "source_row_number", "transaction_id")


@query
def clean_rows(spark, sf_dir):
    return star(spark, sf_dir).clean.select("transaction_id", "amount_vnd", "_dq_errors")


@query
def fk_left_anti(spark, sf_dir):
    rows = silver.typed(table(spark, sf_dir, "raw_transactions")).select("transaction_id", "customer_id")
    return rows.join(landing.distinct_ids(table(spark, sf_dir, "raw_customers"), "customer_id"), "customer_id", "left_anti")


@query
def orphans_prefiltered(spark, sf_dir):
    """The four reference flags of every transaction, the reference tables filtered by its ids first."""
    s = star(spark, sf_dir)
    s.large = ("customer_id", "account_id", "merchant_id", "location_id")
    return s.silver.select("source_row_number", "transaction_id", "_dq_fk_customer", "_dq_fk_account", "_dq_fk_merchant", "_dq_invalid_location")


# -- quality


@query
def dq_flag_rates(spark, sf_dir):
    return quality.flag_rates(star(spark, sf_dir).silver)


@query
def dq_rates_by_month(spark, sf_dir):
    return quality.rates_by_month(star(spark, sf_dir).silver)


@query
def dq_by_grain(spark, sf_dir):
    return quality.rates_by_grain(star(spark, sf_dir).silver)


@query
def dq_buckets_by_month(spark, sf_dir):
    return quality.buckets_by_month(star(spark, sf_dir).silver)


@query
def dq_top_error_codes(spark, sf_dir):
    return quality.top_error_codes(star(spark, sf_dir).silver)


@query
def dq_integrity(spark, sf_dir):
    return quality.integrity(star(spark, sf_dir).silver, dt.date(2024, 1, 1), dt.date(2024, 1, 20))


@query
def dq_manifest_coverage(spark, sf_dir):
    return quality.manifest_coverage(star(spark, sf_dir).silver, table(spark, sf_dir, "raw_manifest"))


@query
def constraints(spark, sf_dir):
    rows = silver.typed(table(spark, sf_dir, "raw_transactions"))
    foreign = {"customer_id": (table(spark, sf_dir, "raw_customers"), "customer_id"), "location_id": (table(spark, sf_dir, "raw_locations"), "location_id")}
    return fact.broken_constraints(rows, unique=("transaction_id",), not_null=("event_time", "amount_original"), foreign=foreign)


# -- star schema


@query
def dim_date(spark, sf_dir):
    return star(spark, sf_dir).dim_date


@query
def dim_account(spark, sf_dir):
    return star(spark, sf_dir).dim_account


@query
def dim_merchant(spark, sf_dir):
    return star(spark, sf_dir).dim_merchant


@query
def dim_device(spark, sf_dir):
    return star(spark, sf_dir).dim_device


@query
def dim_location(spark, sf_dir):
    return star(spark, sf_dir).dim_location


@query
def dim_customer_scd2(spark, sf_dir):
    # validity as text: the open end lies beyond what nanosecond clients can hold
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("valid_from", "valid_to")}
    return star(spark, sf_dir).dim_customer.withColumns(shown)


@query
def fraud_label_per_id(spark, sf_dir):
    return fact.label_per_id(table(spark, sf_dir, "raw_labels"))


@query
def fact_transactions(spark, sf_dir):
    return star(spark, sf_dir).fact


@query
def asof_orders(spark, sf_dir):
    orders = driver(spark, sf_dir, "orders").withColumn("customer_id", F.col("o_custkey"))
    at = F.col("valid_from")
    changes = orders.groupBy("customer_id", F.col("o_orderdate").alias("valid_from")).agg(F.max("o_orderkey").alias("customer_sk"))
    after = F.lead(at).over(dims.Window.partitionBy("customer_id").orderBy("valid_from"))
    versions = changes.withColumn("valid_to", F.coalesce(after, ntz(dims.FOREVER)))
    return fact.with_customer_version(orders, versions, "o_orderdate").select("o_orderkey", "customer_sk")


@query
def asof_events(spark, sf_dir):
    """Every event with the last signup of its user up to it, from all events."""
    e = driver(spark, sf_dir, "events").withColumn("customer_id", F.col("user_id"))
    changes = e.where("event_type = 'signup'").groupBy("customer_id", F.col("ts").alias("valid_from")).agg(F.max("event_id").alias("customer_sk"))
    after = F.lead("valid_from").over(dims.Window.partitionBy("customer_id").orderBy("valid_from"))
    versions = changes.withColumn("valid_to", F.coalesce(after, ntz(dims.FOREVER)))
    return fact.with_customer_version(e, versions, "ts").select("event_id", "customer_sk")


@query
def scd2_by_delta(spark, sf_dir):
    """The customers' versions of all change events, reached by batches of which later ones hold earlier times."""
    s, path = star(spark, sf_dir), f"{Scratch(spark).base}/versions"
    customers, events, locations = (s.dimension(n) for n in ("customers", "customer_scd_events", "locations"))
    part = lambda *which: events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)).isin(*which))
    incremental.store_versions(dims.customer_versions(customers, part(0), locations), path, 8)
    incremental.apply_changes(path, customers, part(0, 1), part(1), locations, 8)
    incremental.apply_changes(path, customers, events, part(2), locations, 8)
    shown = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("valid_from", "valid_to")}
    return spark.read.parquet(path).drop("bucket").withColumns(shown)


# -- marts


@query
def mart_daily(spark, sf_dir):
    return star(spark, sf_dir).mart_daily


@query
def mart_customer_risk(spark, sf_dir):
    return star(spark, sf_dir).mart_customer_risk({"txn_1h": 3})


@query
def mart_merchant_risk(spark, sf_dir):
    return star(spark, sf_dir).mart_merchant_risk


@query
def mart_fraud_features(spark, sf_dir):
    return star(spark, sf_dir).mart_fraud_features()


@query
def exact_distinct_window(spark, sf_dir):
    out = star(spark, sf_dir).distinct_counts()
    exact = [F.col(c).cast("long").alias(c) for c in ("unique_merchants_24h_exact", "unique_devices_7d_exact")]
    return out.select("transaction_id", "unique_merchants_24h", exact[0], "unique_devices_7d", exact[1])


@query
def distinct_rollup(spark, sf_dir):
    """Distinct customers, merchants and devices by day, by month and over all, from the bitmaps of the days."""
    rows, out = star(spark, sf_dir).fact_of(["date_key", "customer_sk", "merchant_sk", "device_sk"]), None
    for key in ("customer_sk", "merchant_sk", "device_sk"):
        one = distinct.distinct_by_grain(rows, key, "date_key", F.floor(F.col("_fine") / 100).cast("int"), "n").select(F.lit(key).alias("key"), "grain", "group", "n")
        out = one if out is None else out.unionByName(one)
    return out


@query
def weekly_features(spark, sf_dir):
    """The trailing features of events, every user's history cut into weeks."""
    e = driver(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").otherwise("success")
    rows = e.select(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("customer_id"), F.col("ts").alias("event_time"), F.col("value").alias("amount_vnd"), status.alias("status"),
        (F.col("event_id") % 7).alias("device_sk"), (F.col("event_id") % 11).alias("merchant_sk"), (F.col("event_id") % 5).cast("string").alias("txn_country"),
    )
    out = marts.behaviour(rows, heavy=0)
    return out.select(
        "transaction_id", "is_new_device", "is_new_location", "txn_count_1h", "txn_count_24h", "failed_txn_count_24h", "unique_merchants_24h", "unique_devices_7d",
        F.round("_avg", 8).alias("avg_7d"), F.round("_std", 6).alias("std_7d"),
    )


@query
def feature_separation(spark, sf_dir):
    return marts.feature_separation(mart_fraud_features(spark, sf_dir))


@query
def velocity_trailing_counts(spark, sf_dir):
    over = lambda sql, interval: marts.trailing(sql, interval, "user_id", "ts")
    return driver(spark, sf_dir, "events").select(
        "event_id", over("count(*)", marts.HOUR).alias("n_1h"), over("count(*)", marts.DAY).alias("n_24h"),
        over("sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)", marts.DAY).alias("errors_24h"),
        F.round(over("avg(value)", marts.WEEK), 6).alias("avg_7d"), F.round(over("stddev_samp(value)", marts.WEEK), 6).alias("std_7d"),
    )


# -- statistics


@query
def ingestion_lag_stats(spark, sf_dir):
    orders, lines = driver(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), driver(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    lag = F.timestamp_diff("SECOND", F.col("o_orderdate"), F.col("l_shipdate"))
    return analytics.lag_statistics(lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select(lag.alias("lag")), "lag")


@query
def log_amount_stats(spark, sf_dir):
    return analytics.log_amount_statistics(driver(spark, sf_dir, "events"), "event_type", "value")


@query
def value_shares(spark, sf_dir):
    return analytics.value_shares(driver(spark, sf_dir, "orders"), "o_orderpriority")


@query
def quantiles(spark, sf_dir):
    return analytics.quantiles(driver(spark, sf_dir, "events"), "value")


@query
def null_shares(spark, sf_dir):
    return analytics.null_shares(star(spark, sf_dir).silver.select("amount_original", "event_time", "exchange_rate", "amount_vnd"))


@query
def median_by_type(spark, sf_dir):
    return analytics.median_by(driver(spark, sf_dir, "events"), "event_type", "value")


@query
def histogram(spark, sf_dir):
    return analytics.histogram(driver(spark, sf_dir, "events"), "value", 0.0, 200.0, 20)


def labelled_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw amounts, some of them no number, NaN or infinite, with a label where one is known."""
    rows = silver.typed(table(spark, sf_dir, "raw_transactions")).select("transaction_id", "transaction_type", F.col("amount_original").alias("amount"))
    return fact.with_labels(rows, table(spark, sf_dir, "raw_labels"))


@query
def calibration(spark, sf_dir):
    return analytics.calibration(labelled_amounts(spark, sf_dir).where("amount > 0"), "transaction_type", scale=20.0, types=(*silver.TYPES, "refund")).withColumnRenamed("transaction_type", "type")


@query
def raw_amount_statistics(spark, sf_dir):
    """Statistics of raw amounts by type, where some are NaN, infinite or no number: finite ones count."""
    rows = labelled_amounts(spark, sf_dir)
    by = "transaction_type"
    logs = analytics.log_amount_statistics(rows, by, "amount")
    tail = analytics.percentiles(rows, "amount", (0.5, 0.95), (by,)).groupBy(by).agg(*[F.round(F.max(F.when(F.col("q") == q, F.col("value"))), 4).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))])
    return logs.join(tail, by).join(analytics.median_by(rows, by, "amount"), by)


# -- checks and gates


def stored(spark: SparkSession, sf_dir: str) -> Star:
    """The star with its layers stored, as gates read them many times."""
    s, scratch = star(spark, sf_dir), Scratch(spark)
    s.silver = scratch.keep(s.silver, "silver")
    s.fact = scratch.keep(s.fact, "fact")
    return s


def gates(spark: SparkSession, found: list) -> DataFrame:
    return checks.gates_as_table(spark, found).select("gate", F.round("observed", 2).alias("observed"), "expected", "passed")


@query
def dq_checks(spark, sf_dir):
    s = stored(spark, sf_dir)
    found = quality.run_checks(s.silver, table(spark, sf_dir, "raw_transactions").count(), dt.date(2024, 1, 1), dt.date(2024, 1, 31), table(spark, sf_dir, "raw_manifest"))
    return checks.as_table(spark, found).drop("detail")


@query
def quarantine_gates(spark, sf_dir):
    rows = stored(spark, sf_dir).silver
    return gates(spark, quarantine.verify(rows, quarantine.clean(rows), quarantine.quarantine(rows, "run", STAMP)))


@query
def gold_gates(spark, sf_dir):
    s = stored(spark, sf_dir)
    others = {k: getattr(s, f"dim_{k}") for k in ("account", "merchant", "device", "location")}
    return gates(spark, fact.verify(s.fact, s.clean, others, s.dim_date, s.dim_customer, s.raw["fraud_labels"]))


@query
def mart_gates(spark, sf_dir):
    s = stored(spark, sf_dir)
    built = [s.mart_daily, s.mart_customer_risk(), s.mart_merchant_risk, s.mart_fraud_features()]
    return gates(spark, marts.verify(s.fact, *built, s.dim_customer))


# -- generator


def small(spark: SparkSession, sf_dir: str) -> synth.GeneratorConfig:
    """As many customers and merchants as the driver has, and a transaction for each order."""
    n = {t: driver(spark, sf_dir, t).count() for t in ("customer", "supplier", "orders")}
    return synth.GeneratorConfig(n_customers=n["customer"], n_merchants=n["supplier"], n_transactions=n["orders"])


@query
def generator_transactions(spark, sf_dir):
    return synth.raw_transactions(spark, small(spark, sf_dir)).select(*landing.TRANSACTION_COLUMNS)


@query
def generator_manifest(spark, sf_dir):
    return synth.error_manifest(synth.raw_transactions(spark, small(spark, sf_dir)))


@query
def generator_customer_changes(spark, sf_dir):
    return synth.customer_changes(spark, small(spark, sf_dir)).drop("id", "k")


@query
def generator_validation(spark, sf_dir):
    cfg = small(spark, sf_dir)
    raw = synth.raw_transactions(spark, cfg)
    return synth.validate_raw(raw.select(*landing.TRANSACTION_COLUMNS), synth.error_manifest(raw), synth.fraud_labels(raw), synth.customers(spark, cfg), synth.accounts(spark, cfg), synth.merchants(spark, cfg))


@query
def generator_invariants(spark, sf_dir):
    return synth.invariants(spark, small(spark, sf_dir))
