"""Dimensions: calendar, one-version tables with surrogate keys, and the versioned customer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.functions.exprs import ntz, strip
from quaystone.sources.scratch import Scratch

#: Fixed values.
UNKNOWN_SK, UNKNOWN = -1, "UNKNOWN"
BEGINNING, FOREVER = dt.datetime(1900, 1, 1), dt.datetime(9999, 12, 31)
CALENDAR = (dt.date(2025, 12, 1), dt.date(2026, 7, 31))
PAYDAYS = (1, 2, 14, 15)
#: Columns kept of each dimension.
KEEP = {
    "account": ["account_id", "customer_id", "account_type", "opened_date", "status", "currency"],
    "merchant": ["merchant_id", "merchant_name", "category", "city", "country", "onboarded_date", "risk_score"],
    "device": ["device_id", "customer_id", "device_type", "os", "app_version", "first_seen", "is_trusted"],
    "location": ["location_id", "country", "city", "region", "lat", "lon", "timezone"],
}
CUSTOMER = ["full_name", "email", "phone", "dob", "signup_date", "home_city", "home_country", "risk_tier", "kyc_level"]

#: Attributes whose changes end a version.
CHANGING = ("risk_tier", "home_city", "phone")


def calendar(spark: SparkSession, start: dt.date = CALENDAR[0], end: dt.date = CALENDAR[1]) -> DataFrame:
    return _calendar(spark.range(1).select(F.lit(start).alias("first"), F.lit(end).alias("last")))


def calendar_of(rows: DataFrame, time: str) -> DataFrame:
    """All days of the months that the rows' times lie in, and of those between; no day for no rows."""
    day = F.to_date(time)
    return _calendar(rows.agg(F.min(F.trunc(day, "month")).alias("first"), F.max(F.last_day(day)).alias("last")))


def _calendar(span: DataFrame) -> DataFrame:
    days = span.where("first is not null").select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("full_date"))
    d = F.col("full_date")
    weekday = F.weekday(d) + 1
    return days.select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"), "full_date", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month"),
        F.date_format(d, "MMMM").alias("month_name"), F.dayofmonth(d).alias("day"), weekday.alias("day_of_week"), F.date_format(d, "EEEE").alias("day_name"),
        (weekday >= 6).alias("is_weekend"), F.dayofmonth(d).isin(*PAYDAYS).alias("is_payday"),
    )


def with_surrogate_key(df: DataFrame, name: str, keys: list[str], scratch: Scratch | None = None) -> DataFrame:
    """1..n in key order.  Range partitions make the order global: each task sorts and numbers its own part, and the sizes of
    the parts before it (one row a task) are added, so no task holds the whole table.  The numbers are stored with the parts:
    their bounds come from a sample, which a second evaluation might draw anew, and a reader has nothing to sort.  They are
    in ``scratch``, whose owner frees them."""
    order = [F.col(k).asc_nulls_first() for k in keys]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    parts = (scratch or Scratch(df.sparkSession)).keep(placed, name)
    # the id has the task's number in its upper bits, the place in the task's rows in the lower 33
    part, nth = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit(2**33 - 1)) + 1
    sizes = parts.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    # one row for each task of the range partition
    out = parts.withColumn("_part", part).join(F.broadcast(before), "_part")
    return out.select((F.col("_before") + nth).cast("long").alias(name), *df.columns)


def with_unknown(df: DataFrame, sk: str, key: str, **values) -> DataFrame:
    """The table and its Unknown member; other columns of that are null unless given."""
    known = {sk: F.lit(UNKNOWN_SK), key: F.lit(UNKNOWN)} | {k: ntz(v) if isinstance(v, dt.datetime) else F.lit(v) for k, v in values.items()}
    row = df.sparkSession.range(1).select(*[(known[c] if c in known else F.lit(None)).cast(t).alias(c) for c, t in df.dtypes])
    return row.unionByName(df)


def keep_first(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row for each key: the first by ``source_row_number``, the row's place in its file, where rows have it; rows of
    the same place, or of none, by their other columns."""
    rest = F.struct(*[c for c in columns if c != key])
    place = F.col("source_row_number").cast("long") if "source_row_number" in rows.columns else F.lit(0).cast("long")
    return rows.groupBy(key).agg(F.min_by(rest, F.struct(F.coalesce(place, F.lit(2**63 - 1)).alias("p"), rest.alias("r"))).alias("_r")).select(key, "_r.*").select(*columns)


def one_version(silver: DataFrame, kind: str, scratch: Scratch | None = None) -> DataFrame:
    """A dimension without history: one row for each key, numbered, with the Unknown member; of several rows of a key the
    first, as ``keep_first`` says."""
    key, columns = f"{kind}_id", KEEP[kind]
    once = keep_first(silver, key, columns)
    return with_unknown(with_surrogate_key(once, f"{kind}_sk", [key], scratch), f"{kind}_sk", key)


def customer_versions(customers: DataFrame, events: DataFrame, locations: DataFrame) -> DataFrame:
    """Versions of every customer from the latest snapshot and the change events, undone backwards.

    The version that ends with change k has, for every attribute, the old value of the first change of it at or after
    k, else the snapshot's.  An undone city sets the country by lookup where the city is known, else the country stays
    that of the next later version.  Validity is half-open; customers without events have one version.
    """
    order = ["change_time", "event_id"]
    city = locations.groupBy("city").agg(F.max_by("country", "location_id").alias("_country")).withColumnRenamed("city", "_city")
    changes = changes_of(events, *CHANGING)
    changes = changes.join(city, (F.col("attribute_name") == "home_city") & (F.col("old_value") == F.col("_city")), "left")
    # from the last change to the first: what a later change says runs on to the earlier ones
    by = Window.partitionBy("customer_id").orderBy(*[F.col(c).desc() for c in order])
    later = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    old = lambda a, v="old_value": F.last(F.when(F.col("attribute_name") == a, F.struct(F.col(v).alias("v"))), ignorenulls=True).over(later)
    # a change of a city that no lookup knows leaves the country to later changes
    country = F.last(F.when(F.col("attribute_name") == "home_city", F.col("_country")), ignorenulls=True).over(later)
    undone = changes.select(
        "customer_id", F.col("change_time").alias("_to"), F.lead("change_time").over(by).alias("_from"), F.lag("change_time").over(by).isNull().alias("_newest"),
        old("risk_tier").alias("_tier"), old("home_city").alias("_home"), old("phone").alias("_phone"), country.alias("_land"),
    )
    snapshot = keep_first(customers, "customer_id", ["customer_id", *CUSTOMER])
    # a version ends with each change, and the newest change, or a customer without any, begins the current one
    versions = F.when(F.col("_to").isNull(), F.array(F.lit(True))).when(F.col("_newest"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = snapshot.join(undone, "customer_id", "left").withColumn("is_current", F.explode(versions))
    now = F.col("is_current")
    merged = {"risk_tier": "_tier", "home_city": "_home", "phone": "_phone"}
    return rows.select(
        "customer_id",
        *[
            F.when(~now & F.col(merged[c]).isNotNull(), F.col(merged[c])["v"]).otherwise(F.col(c)).alias(c) if c in merged
            else F.when(~now & F.col("_land").isNotNull(), F.col("_land")).otherwise(F.col(c)).alias(c) if c == "home_country" else F.col(c)
            for c in CUSTOMER
        ],
        F.coalesce(F.when(now, F.col("_to")).otherwise(F.col("_from")), ntz(BEGINNING)).alias("valid_from"),
        F.when(now, ntz(FOREVER)).otherwise(F.col("_to")).alias("valid_to"), "is_current",
    )


def known_customers(customers: DataFrame, early: DataFrame, whole: bool = True) -> DataFrame:
    """A row for each customer, as the snapshot has it, with known_from: versions follow on each other from then to the open
    end, so a row before that end has one if its time is not before known_from.  That is the calendar's beginning, or the
    first change if it is earlier.  ``early``: the change events before the beginning, and perhaps others.  Not ``whole``:
    customer_id and known_from alone, for which no snapshot is chosen."""
    is_change = (F.col("change_time") < ntz(BEGINNING)) & F.col("attribute_name").isin(*CHANGING)
    first = early.where(is_change).groupBy(strip("customer_id").alias("_early")).agg(F.min("change_time").alias("_first"))
    snapshot = keep_first(customers, "customer_id", ["customer_id", *CUSTOMER]) if whole else customers.select("customer_id").distinct()
    out = snapshot.join(first, F.col("customer_id") == F.col("_early"), "left")
    return out.withColumn("known_from", F.coalesce("_first", ntz(BEGINNING))).drop("_early", "_first")


def changes_of(events: DataFrame, *attributes: str) -> DataFrame:
    """customer_id, event_id, change_time, attribute_name, old_value of the changes that end a version."""
    valid = F.col("attribute_name").isin(*attributes) & F.col("change_time").isNotNull()
    return events.where(valid).select(strip("customer_id").alias("customer_id"), "event_id", "change_time", "attribute_name", "old_value")


def version_starts(events: DataFrame) -> DataFrame:
    """customer_id, valid_from, valid_to, since: since which change a version has held, for the last start up to a time; a
    customer's first version has no row."""
    at = F.col("change_time")
    return changes_of(events, *CHANGING).select("customer_id", at.alias("valid_from"), ntz(FOREVER).alias("valid_to"), at.alias("since"))


def home_countries(events: DataFrame, locations: DataFrame) -> DataFrame:
    """customer_id, valid_from, valid_to, country_then: the country until each change from a city that the lookup knows, as
    ``customer_versions`` undoes them; after the last of them it is the snapshot's.  Only these changes are ordered."""
    city = locations.groupBy("city").agg(F.max_by("country", "location_id").alias("country_then")).where("country_then is not null")
    moves = changes_of(events, "home_city").join(city, F.col("old_value") == F.col("city"))
    before = F.lag("change_time").over(Window.partitionBy("customer_id").orderBy("change_time", "event_id"))
    return moves.select("customer_id", F.coalesce(before, F.lit("0000-01-01 00:00:00").cast("timestamp_ntz")).alias("valid_from"), F.col("change_time").alias("valid_to"), "country_then")


def dim_customer(customers: DataFrame, events: DataFrame, locations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Numbered versions and the Unknown member."""
    versions = customer_versions(customers, events, locations)
    numbered = with_surrogate_key(versions, "customer_sk", ["customer_id", "valid_from", "valid_to"], scratch)
    return with_unknown(numbered, "customer_sk", "customer_id", valid_from=BEGINNING, valid_to=FOREVER, is_current=True)
