"""Marts on the star schema, and the gates on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystone.functions.exprs import count_if, ratio
from quaystone.operators.checks import Gate
from quaystone.operators.dims import UNKNOWN, UNKNOWN_SK
from quaystone.operators.slices import tasks_for, with_context

#: Watchlist limits, high amount, score weights and caps.
WATCH = {"fraud_rate": 0.05, "zscore": 4, "txn_1h": 10, "devices": 5}
HIGH_AMOUNT = 46_000_000
NIGHT = (0, 5)
#: Rows of a customer beyond which its history is cut into weeks.
HEAVY = 1_000_000
HOUR, DAY, WEEK = "INTERVAL '1' HOUR", "INTERVAL '1' DAY", "INTERVAL '7' DAY"
#: Just longer than a day, a week: the nearest time outside of the trailing interval.
PAST_DAY, PAST_WEEK = "INTERVAL '1 00:00:00.000001' DAY TO SECOND", "INTERVAL '7 00:00:00.000001' DAY TO SECOND"


#: Columns of the fact that each mart reads.
DAILY_COLUMNS = ["date_key", "amount_vnd", "status", "is_fraud", "customer_sk"]
CUSTOMER_COLUMNS = ["customer_sk", "device_sk", "location_sk", "event_time", "amount_vnd", "status", "is_fraud"]
MERCHANT_COLUMNS = ["merchant_sk", "customer_sk", "amount_vnd", "status", "is_fraud"]
FEATURE_COLUMNS = ["transaction_id", "customer_sk", "device_sk", "merchant_sk", "location_sk", "event_time", "amount_vnd", "status", "is_fraud", "fraud_pattern"]
DISTINCT_COLUMNS = ["transaction_id", "customer_sk", "device_sk", "merchant_sk", "event_time"]
DISTINCT_COUNTS = ["unique_merchants_24h", "unique_merchants_24h_exact", "unique_devices_7d", "unique_devices_7d_exact"]


def trailing(spark_sql: str, interval: str, key: str = "customer_id", time: str = "event_time") -> Column:
    """An aggregate over the key's rows of the trailing interval; rows of the same time are in."""
    return F.expr(f"{spark_sql} OVER (PARTITION BY {key} ORDER BY {time} RANGE BETWEEN {interval} PRECEDING AND CURRENT ROW)")


def mart_daily(fact: DataFrame, dim_date: DataFrame) -> DataFrame:
    """A row for each day; the running total adds up the rounded daily totals.  Days are aggregated before the calendar
    join, and the running window sees one row a day."""
    amount, status = F.col("amount_vnd"), F.col("status")
    daily = fact.groupBy("date_key").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.round(F.sum(amount), 2).alias("total_amount_vnd"),
        *[count_if(status == s).alias(f"{s}_count") for s in ("success", "failed", "pending")],
        F.round(F.sum(F.when(status == "success", amount).otherwise(0.0)), 2).alias("success_amount_vnd"),
        F.sum("is_fraud").cast("long").alias("fraud_count"),
        F.round(F.sum(F.when(F.col("is_fraud") == 1, amount).otherwise(0.0)), 2).alias("fraud_amount_vnd"),
        F.countDistinct("customer_sk").alias("distinct_customers"),
        F.round(F.avg(amount), 2).alias("avg_amount_vnd"),
    )
    running = F.round(F.sum("total_amount_vnd").over(Window.orderBy("date_key")), 2)
    out = daily.join(dim_date.select("date_key", "full_date", "year", "month", "is_weekend", "is_payday"), "date_key").withColumn("running_total_vnd", running)
    lead = ["date_key", "full_date", "year", "month", "is_weekend", "is_payday"]
    return out.select(*lead, *[c for c in out.columns if c not in lead])


def busiest_hour(rows: DataFrame, time: str = "event_time", by: tuple[str, ...] = ()) -> DataFrame:
    """by..., max_txn_count_1h: the most rows in a trailing hour, of rows too many for one window.  A row counts in its own
    hour of the clock and goes as context to the next, so a task holds two hours of a group's rows at most."""
    hour = F.date_trunc("hour", time)
    own = rows.select(*by, F.col(time).alias("_t"), hour.alias("_hour"), F.lit(True).alias("_own"))
    context = rows.select(*by, F.col(time).alias("_t"), (hour + F.expr(HOUR)).alias("_hour"), F.lit(False).alias("_own"))
    counted = own.unionByName(context).withColumn("_n", trailing("count(*)", HOUR, ", ".join([*by, "_hour"]), "_t"))
    return counted.where("_own").groupBy(*by).agg(F.max("_n").alias("max_txn_count_1h"))


def mart_customer_risk(fact: DataFrame, dim_customer: DataFrame, limits: dict | None = None, heavy: int = HEAVY) -> DataFrame:
    """A row for each customer, all versions together; Unknown is one of them.

    One shuffle by customer serves the window and the aggregate of known customers; distinct devices and locations are first
    sightings, so no row is expanded for them.  Unknown and customers of more than ``heavy`` rows may hold any share of the
    rows: they are aggregated apart, by partial sums and by hours of the clock, so none is one task.  The largest z-score is that of the largest amount.

    A fact with ``customer_id``, null for Unknown, instead of customer_sk is not joined for it; of ``dim_customer`` only the
    current rows are read then."""
    limit = WATCH | (limits or {})
    total = F.count(F.lit(1))
    failed = count_if(F.col("status") == "failed")
    z = F.try_divide(F.max("amount_vnd") - F.avg("amount_vnd"), F.nullif(F.stddev_samp("amount_vnd"), F.lit(0.0)))

    def figures(devices: Column, locations: Column, busiest: Column) -> list[Column]:
        return [
            total.alias("txn_count"),
            F.round(F.sum("amount_vnd"), 2).alias("total_amount_vnd"),
            F.round(F.avg("amount_vnd"), 2).alias("avg_amount_vnd"),
            F.sum("is_fraud").cast("long").alias("fraud_count"),
            F.round(ratio(F.sum("is_fraud"), total), 4).alias("fraud_rate"),
            devices.alias("distinct_devices"),
            locations.alias("distinct_locations"),
            failed.alias("failed_count"),
            F.round(ratio(failed, total), 4).alias("failed_rate"),
            F.round(z, 2).alias("max_amount_zscore"),
            busiest.alias("max_txn_count_1h"),
        ]

    first = lambda c: (F.row_number().over(Window.partitionBy("customer_id", c).orderBy(c)) == 1) & F.col(c).isNotNull()
    columns = ["customer_id", *[c for c in CUSTOMER_COLUMNS if c != "customer_sk"]]
    if "customer_id" in fact.columns:
        every, lost = fact.where(F.col("customer_id").isNotNull()).select(*columns), fact.where(F.col("customer_id").isNull())
    else:
        ids = dim_customer.where(F.col("customer_sk") != UNKNOWN_SK).select("customer_sk", "customer_id")
        every, lost = fact.join(ids, "customer_sk").select(*columns), fact.where(F.col("customer_sk") == UNKNOWN_SK)
    # at most one customer for every ``heavy`` rows
    long_ones = F.broadcast(every.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy).select(F.col("customer_id").alias("_long")))
    match = F.col("customer_id") == F.col("_long")
    rows = every.join(long_ones, match, "left_anti").repartition("customer_id").select(
        "customer_id", "amount_vnd", "is_fraud", "status", first("device_sk").alias("_device"), first("location_sk").alias("_location"), trailing("count(*)", HOUR).alias("n_1h"),
    )
    known = rows.groupBy("customer_id").agg(*figures(count_if(F.col("_device")), count_if(F.col("_location")), F.max("n_1h")))
    lost = lost.withColumn("customer_id", F.lit(UNKNOWN)).select(*columns)
    apart = every.join(long_ones, match, "left_semi").unionByName(lost)
    sums = apart.groupBy("customer_id").agg(*figures(F.countDistinct("device_sk"), F.countDistinct("location_sk"), F.lit(0)))
    # a row for each of them
    sums = sums.drop("max_txn_count_1h").join(busiest_hour(apart, by=("customer_id",)), "customer_id")
    agg = known.unionByName(sums.select(known.columns))
    now = dim_customer.where("is_current").select("customer_id", "risk_tier", "home_city", "home_country")
    watch = (
        (F.col("fraud_count") > 0) | (F.col("fraud_rate") >= limit["fraud_rate"]) | (F.col("max_amount_zscore") >= limit["zscore"])
        | (F.col("max_txn_count_1h") >= limit["txn_1h"]) | (F.col("distinct_devices") >= limit["devices"])
    )
    return agg.join(now, "customer_id", "left").withColumn("watchlist_flag", F.when(watch, True).otherwise(False))


MERCHANT = ["merchant_id", "merchant_name", "category", "city", "country", "risk_score"]


def mart_merchant_risk(fact: DataFrame, dim_merchant: DataFrame) -> DataFrame:
    """A row for each merchant with transactions; Unknown is left out.  Aggregated by merchant and customer version, then by
    merchant, each version being one row of the former; attributes are joined to the merchants' rows.  A dimension has one
    row for a key and a merchant's id.  A fact may have a version's ``customer_id`` and ``since`` instead of customer_sk."""
    version = ["customer_id", "since"] if "since" in fact.columns else ["customer_sk"]
    known = fact.where(F.col("merchant_sk") != UNKNOWN_SK)
    pairs = known.groupBy("merchant_sk", *version).agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_vnd").alias("amount"), count_if(F.col("status") == "failed").alias("failed"), F.sum("is_fraud").cast("long").alias("fraud")
    )
    total = F.sum("n")
    figures = pairs.groupBy("merchant_sk").agg(
        total.alias("txn_count"),
        F.round(F.sum("amount"), 2).alias("total_amount_vnd"),
        F.sum("failed").alias("failed_count"),
        F.round(ratio(F.sum("failed"), total), 4).alias("failed_rate"),
        F.sum("fraud").alias("fraud_count"),
        F.round(ratio(F.sum("fraud"), total), 4).alias("fraud_rate"),
        F.count("customer_sk" if "customer_sk" in version else F.lit(1)).alias("distinct_customers"),
    )
    return figures.join(dim_merchant.select("merchant_sk", *MERCHANT), "merchant_sk").select(*MERCHANT, *figures.columns[1:])


def behaviour(rows: DataFrame, exact_distinct: bool = False, heavy: int = HEAVY, tasks: int | None = None) -> DataFrame:
    """Trailing, first-seen and gap features of transactions (transaction_id, customer_id, event_time, amount_vnd, status,
    device_sk, merchant_sk, txn_country).  Rows may have device_id and merchant_id instead of the keys; features of an amount,
    status or country are left out where rows have none.

    All windows of a customer are over one shuffle by customer.  A customer of more than ``heavy`` rows is cut into weeks
    instead, each with the two weeks before it as context: as far as a trailing week of rows whose own freshness looks back
    a week.  What a frame can't say, which row was a device's or country's first, comes from an aggregate.

    unique_merchants_24h and unique_devices_7d add up, over the trailing interval, the rows whose previous sighting is
    none or longer ago than the interval: they may be lower than the number of distinct values.  ``exact_distinct``
    adds that number in columns of its own: sightings that began a stay in the interval, less those that were not renewed
    and have left it, both as running sums, so no frame holds a set.

    A task sorts its rows several times over, so the tasks' number follows the rows' (``tasks_for``): what one holds stays the
    same at any size.  ``tasks`` is for rows that are costly to count."""
    tasks = tasks or tasks_for(rows)
    match = F.col("customer_id") == F.col("_long")
    at = ["event_time", "transaction_id"]
    device, merchant = sighted(rows)
    new = {n: c for n, c in (("is_new_device", device), ("is_new_location", "txn_country")) if c in rows.columns}
    if heavy > 0:
        # at most one customer for every ``heavy`` rows
        long_ones = F.broadcast(rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > heavy).select(F.col("customer_id").alias("_long")))
        short, cut = rows.join(long_ones, match, "left_anti"), rows.join(long_ones, match, "left_semi")
    else:  # all customers are long
        short, cut = rows.where("customer_id is null"), rows.where("customer_id is not null")
    first = lambda c: F.when(F.row_number().over(Window.partitionBy("customer_id", c).orderBy(*at)) == 1, 1).otherwise(0)
    # partitioned by customer alone, which serves the windows by customer and device, country or merchant as well
    short = _trailing_features(short.repartition(tasks, "customer_id"), ["customer_id"], exact_distinct, {n: first(c) for n, c in new.items()})
    firsts = None
    for name, c in new.items():
        one = cut.groupBy("customer_id", c).agg(F.min(F.struct(*at)).alias("_f")).select("customer_id", "_f.*", *[F.lit(int(n == name)).alias(n) for n in new])
        firsts = one if firsts is None else firsts.unionByName(one)
    firsts = firsts.groupBy("customer_id", *at).agg(*[F.max(n).alias(n) for n in new])
    on = (cut["transaction_id"] == firsts["transaction_id"]) & (cut["customer_id"] == firsts["customer_id"]) & (cut["event_time"] == firsts["event_time"])
    cut = cut.join(firsts, on, "left").select(cut["*"], *[F.coalesce(firsts[n], F.lit(0)).alias(n) for n in new])
    cut = with_context(cut, "event_time", 7, 2, ["customer_id", *at, "amount_vnd", "status", device, merchant]).repartition(tasks, "customer_id", "_slice")
    cut = _trailing_features(cut, ["customer_id", "_slice"], exact_distinct).where("_own").drop("_own", "_slice")
    return short.unionByName(cut)


def sighted(rows: DataFrame) -> tuple[str, str]:
    """The columns that tell devices and merchants: their ids where rows have them, else their keys."""
    return tuple(f"{k}_id" if f"{k}_id" in rows.columns else f"{k}_sk" for k in ("device", "merchant"))


def _trailing_features(rows: DataFrame, by: list[str], exact_distinct: bool, firsts: dict[str, Column] | None = None) -> DataFrame:
    """``firsts``: more columns over the same windows by device or country, which are sorted for once."""
    at, keys = ["event_time", "transaction_id"], ", ".join(by)
    device, merchant = sighted(rows)
    gap = lambda c: F.col("event_time") - F.lag("event_time").over(Window.partitionBy(*by, c).orderBy(*at))
    fresh = lambda c, iv: F.when(gap(c).isNull() | (gap(c) > F.expr(iv)), 1).otherwise(0)
    sightings = {**(firsts or {}), "_fresh_merchant": fresh(merchant, DAY), "_fresh_device": fresh(device, WEEK)}
    if exact_distinct:
        wait = lambda c: F.lead("event_time").over(Window.partitionBy(*by, c).orderBy(*at)) - F.col("event_time")
        left = lambda c, iv: F.when(wait(c).isNull() | (wait(c) > F.expr(iv)), 1).otherwise(0)
        sightings |= {"_left_merchant": left(merchant, DAY), "_left_device": left(device, WEEK)}
    amounts = {"_avg": trailing("avg(amount_vnd)", WEEK, keys), "_std": trailing("stddev_samp(amount_vnd)", WEEK, keys)}
    failed = {"failed_txn_count_24h": trailing("sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)", DAY, keys)}
    features = {
        **(amounts if "amount_vnd" in rows.columns else {}),
        "txn_count_1h": trailing("count(*)", HOUR, keys),
        "txn_count_24h": trailing("count(*)", DAY, keys),
        **(failed if "status" in rows.columns else {}),
        "unique_merchants_24h": trailing("sum(_fresh_merchant)", DAY, keys),
        "unique_devices_7d": trailing("sum(_fresh_device)", WEEK, keys),
    }
    if exact_distinct:
        present = lambda c, over: F.expr(
            f"sum(_fresh_{c}) OVER (PARTITION BY {keys} ORDER BY event_time RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - "
            f"coalesce(sum(_left_{c}) OVER (PARTITION BY {keys} ORDER BY event_time RANGE BETWEEN UNBOUNDED PRECEDING AND {over} PRECEDING), 0)"
        )
        features |= {"unique_merchants_24h_exact": present("merchant", PAST_DAY), "unique_devices_7d_exact": present("device", PAST_WEEK)}
    return rows.withColumns(sightings).withColumns(features).drop("_fresh_merchant", "_fresh_device", "_left_merchant", "_left_device")


def mart_fraud_features(fact: DataFrame, dim_customer: DataFrame | None, dim_location: DataFrame, high_amount: float = HIGH_AMOUNT, exact_distinct: bool = False, heavy: int = HEAVY) -> DataFrame:
    """A row for each transaction of a known customer.  The home country is that of the customer's version at the time.  A
    fact may have ``customer_id``, null for Unknown, and home_country instead of customer_sk; no customers are read then.  It may
    have the ids of devices, merchants and locations instead of their keys."""
    if "home_country" in fact.columns:
        rows = fact.where(F.col("customer_id").isNotNull())
    else:
        rows = fact.where(F.col("customer_sk") != UNKNOWN_SK).join(dim_customer.select("customer_sk", "customer_id", "home_country"), "customer_sk")
    place = "location_id" if "location_id" in fact.columns else "location_sk"
    rows = rows.join(dim_location.select(place, F.col("country").alias("txn_country")), place, "left")
    z = F.coalesce(F.try_divide(F.col("amount_vnd") - F.col("_avg"), F.nullif("_std", F.lit(0.0))), F.lit(0.0))
    score = (
        F.least(F.col("txn_count_24h") / 10.0, F.lit(3.0)) * 0.5
        + F.least(F.greatest(z, F.lit(0.0)), F.lit(5.0)) * 0.4
        + F.least(F.col("failed_txn_count_24h").cast("double"), F.lit(10.0)) * 0.1
    )
    bit = lambda c: F.when(c, 1).otherwise(0)
    exact = ["unique_merchants_24h_exact", "unique_devices_7d_exact"] if exact_distinct else []
    return behaviour(rows, exact_distinct, heavy, tasks_for(fact)).select(
        "transaction_id", "customer_id", "event_time", "is_fraud", "fraud_pattern", F.col("amount_vnd").alias("txn_amount"),
        F.round("_avg", 2).alias("avg_amount_7d"), F.round(z, 4).alias("amount_zscore"), "txn_count_1h", "txn_count_24h",
        "unique_merchants_24h", "unique_devices_7d", "is_new_device", "is_new_location", "failed_txn_count_24h",
        bit(F.hour("event_time").between(*NIGHT)).alias("night_transaction_flag"),
        bit(F.col("amount_vnd") > high_amount).alias("high_amount_flag"),
        bit(~F.col("txn_country").eqNullSafe(F.col("home_country"))).alias("cross_country_flag"),
        F.round(score, 3).alias("velocity_risk_score"), *exact,
    )


def distinct_counts(rows: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """transaction_id and the feature mart's numbers of merchants and devices, exact ones too, for rows (transaction_id,
    customer_id, device_id, merchant_id, event_time) of known customers."""
    return behaviour(rows, True, heavy, tasks_for(rows)).select("transaction_id", *DISTINCT_COUNTS)


def feature_separation(features: DataFrame) -> DataFrame:
    """Average features for each fraud pattern, ``legit`` for none."""
    return features.groupBy(F.coalesce("fraud_pattern", F.lit("legit")).alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("amount_zscore"), 2).alias("avg_zscore"),
        F.round(F.avg("txn_count_1h"), 2).alias("avg_txn_1h"),
        F.round(F.avg("txn_count_24h"), 2).alias("avg_txn_24h"),
        F.round(F.avg("is_new_device"), 2).alias("avg_new_device"),
        F.round(F.avg("cross_country_flag"), 2).alias("avg_cross_country"),
        F.round(F.avg("night_transaction_flag"), 2).alias("avg_night"),
        F.round(F.avg("velocity_risk_score"), 3).alias("avg_velocity"),
    )


def verify(fact: DataFrame, daily: DataFrame, customer: DataFrame, merchant: DataFrame, features: DataFrame, dim_customer: DataFrame) -> list[Gate]:
    """Sums and counts of the marts against the fact table they were made from."""
    f = fact.agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("fraud"), F.countDistinct("date_key").alias("days"),
        count_if(F.col("merchant_sk") != UNKNOWN_SK).alias("with_merchant"), count_if(F.col("customer_sk") != UNKNOWN_SK).alias("known"),
        F.sum(F.when(F.col("customer_sk") != UNKNOWN_SK, F.col("is_fraud")).otherwise(0)).alias("known_fraud"),
    ).first()
    d = daily.agg(F.count(F.lit(1)).alias("rows"), F.sum("txn_count").alias("n"), F.sum("fraud_count").alias("fraud")).first()
    in_unit = lambda c: F.col(c).between(0, 1)
    c = customer.agg(F.count(F.lit(1)).alias("rows"), F.sum("txn_count").alias("n"), F.sum("fraud_count").alias("fraud"), count_if(~(in_unit("fraud_rate") & in_unit("failed_rate"))).alias("off")).first()
    ids = fact.join(dim_customer.select("customer_sk", "customer_id"), "customer_sk").agg(F.countDistinct("customer_id")).first()[0]
    m = merchant.agg(F.count(F.lit(1)).alias("rows"), F.sum("txn_count").alias("n")).first()
    keys = fact.where(F.col("merchant_sk") != UNKNOWN_SK).agg(F.countDistinct("merchant_sk")).first()[0]
    x = features.agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_fraud").alias("fraud"), count_if(F.col("amount_zscore").isNull()).alias("null_z"),
        count_if(F.col("txn_count_1h") > F.col("txn_count_24h")).alias("not_monotonic"),
    ).first()
    twice = features.groupBy("transaction_id").count().where("count > 1").count()
    eq = lambda name, a, b: Gate(name, a or 0, b or 0, f"{a} vs {b}")
    return [
        eq("daily_sum_txn", d["n"], f["n"]), eq("daily_rowcount", d["rows"], f["days"]), eq("daily_fraud", d["fraud"], f["fraud"]),
        eq("customer_sum_txn", c["n"], f["n"]), eq("customer_rowcount", c["rows"], ids), eq("customer_fraud", c["fraud"], f["fraud"]), eq("customer_rate_bounds", c["off"], 0),
        eq("merchant_rowcount", m["rows"], keys), eq("merchant_sum_txn", m["n"], f["with_merchant"]),
        eq("fraud_features_rowcount", x["n"], f["known"]), eq("fraud_features_is_fraud", x["fraud"], f["known_fraud"]), eq("fraud_features_zscore_not_null", x["null_z"], 0),
        eq("fraud_features_count_monotonic", x["not_monotonic"], 0), eq("fraud_features_txn_unique", twice, 0),
    ]
