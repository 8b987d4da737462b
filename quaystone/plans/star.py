"""From raw tables to marts, as one lazy plan; and the same as a batch with tables on disk between the layers."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystone.functions.exprs import strip
from quaystone.operators import checks, dims, fact, marts, quality, quarantine, slices
from quaystone.operators.silver import silver_dimension, silver_transactions
from quaystone.sources import landing, sinks
from quaystone.sources.scratch import Scratch


@dataclass
class Star:
    """Layers over raw tables by name: transactions, customers, customer_scd_events, accounts, merchants, devices,
    locations, exchange_rates, fraud_labels."""

    spark: SparkSession
    raw: dict[str, DataFrame]
    run_id: str = "run"
    #: first and last day, or a calendar itself
    calendar: tuple[dt.date, dt.date] | DataFrame = dims.CALENDAR
    #: id columns whose reference tables are filtered by the transactions' ids before they are shuffled
    large: tuple[str, ...] = ()
    _ids: dict[str, DataFrame] = field(default_factory=dict, repr=False)

    @cached_property
    def silver(self) -> DataFrame:
        r = self.raw
        return silver_transactions(r["transactions"], customers=r["customers"], accounts=r["accounts"], merchants=r["merchants"], locations=r["locations"], rates=r["exchange_rates"], run_id=self.run_id, large=self.large)

    @cached_property
    def clean(self) -> DataFrame:
        return quarantine.clean(self.silver)

    def dimension(self, name: str) -> DataFrame:
        return silver_dimension(self.raw[name], name)

    @cached_property
    def dim_date(self) -> DataFrame:
        return self.calendar if isinstance(self.calendar, DataFrame) else dims.calendar(self.spark, *self.calendar)

    @cached_property
    def scratch(self) -> Scratch:
        """Holds the numbered parts of the dimensions until ``close``."""
        return Scratch(self.spark)

    def close(self) -> None:
        """Frees what the dimensions hold; nothing that reads them is readable after it."""
        if "scratch" in self.__dict__:
            self.scratch.close()

    def __enter__(self) -> Star:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    @cached_property
    def dim_customer(self) -> DataFrame:
        return dims.dim_customer(self.dimension("customers"), self.dimension("customer_scd_events"), self.dimension("locations"), self.scratch)

    @cached_property
    def dim_account(self) -> DataFrame:
        return dims.one_version(self.dimension("accounts"), "account", self.scratch)

    @cached_property
    def dim_merchant(self) -> DataFrame:
        return dims.one_version(self.dimension("merchants"), "merchant", self.scratch)

    @cached_property
    def dim_device(self) -> DataFrame:
        return dims.one_version(self.dimension("devices"), "device", self.scratch)

    @cached_property
    def dim_location(self) -> DataFrame:
        return dims.one_version(self.dimension("locations"), "location", self.scratch)

    @cached_property
    def fact(self) -> DataFrame:
        return self.fact_of(fact.COLUMNS)

    def fact_of(self, columns: list[str]) -> DataFrame:
        """The fact's ``columns``, of the stored fact if there is one; else only the dimensions that these need are built and
        joined."""
        if "fact" in self.__dict__:
            return self.__dict__["fact"].select(*columns)
        kinds = [k for k in ("customer", "account", "merchant", "device", "location") if f"{k}_sk" in columns]
        # each dimension stores its numbered parts; the small jobs run side by side
        with ThreadPoolExecutor(5) as pool:
            built = dict(zip(kinds, pool.map(lambda kind: getattr(self, f"dim_{kind}"), kinds), strict=True))
        # the clean rows' customers and times are among those of all rows, which need none of the lookups
        return fact.fact_transactions(self.clean, built, self.raw["fraud_labels"], columns, asked=self.silver.select("customer_id", "event_time"))

    @property
    def mart_daily(self) -> DataFrame:
        return marts.mart_daily(self.fact_of(marts.DAILY_COLUMNS), self.dim_date)

    def _known_customers(self, whole: bool) -> DataFrame:
        # the texts of times before 1900 are below this one, so few events are parsed
        early = self.raw["customer_scd_events"].where(strip("change_time") < "1900")
        return dims.known_customers(self.dimension("customers"), silver_dimension(early, "customer_scd_events"), whole)

    @cached_property
    def known_customers(self) -> DataFrame:
        return self._known_customers(True)

    def _ids_of(self, kind: str) -> DataFrame:
        """The ids of a dimension, stored."""
        if kind not in self._ids:
            self._ids[kind] = self.scratch.keep(self.dimension(f"{kind}s").select(f"{kind}_id").distinct(), f"{kind}-ids")
        return self._ids[kind]

    def _known_to(self, columns: list[str], *more: str, ids: tuple[str, ...] = ()) -> DataFrame:
        """The fact's ``columns`` with customer_id, null for Unknown, instead of customer_sk, and columns ``more`` of the
        snapshot.  A mart shows no key of a version, so no version is numbered or looked up for it; nor are the dimensions
        ``ids``, whose own ids stand instead of their keys, null for Unknown."""
        names = {f"{k}_sk": f"{k}_id" for k in ("customer", *ids)}
        rows = self.fact_of([*dict.fromkeys([names.get(c, c) for c in columns] + ["event_time"])])
        if ids:
            self.scratch  # noqa: B018 - made before the threads
            with ThreadPoolExecutor(len(ids)) as pool:
                for kind, known in zip(ids, pool.map(self._ids_of, ids), strict=True):
                    rows = fact.with_known_id(rows, known, kind)
        return fact.with_known_customer(rows, self.known_customers if more else self._known_customers(False), *more)

    def _as_of(self, rows: DataFrame, versions: DataFrame, column: str) -> DataFrame:
        """``rows`` with the ``column`` of their customers' versions; only the history of customers with very many rows or
        changes is cut into slices."""
        ids, events = (self.raw[t].select(strip("customer_id").alias("customer_id")) for t in ("transactions", "customer_scd_events"))
        many = slices.long_keys(ids, events, key="customer_id", most=marts.HEAVY)
        return slices.as_of(rows, versions, "customer_id", "event_time", [column], asked=self.silver.select("customer_id", "event_time"), long_keys=many)

    def mart_customer_risk(self, limits: dict | None = None) -> DataFrame:
        if "fact" in self.__dict__:
            return marts.mart_customer_risk(self.fact, self.dim_customer, limits)
        rows = self.scratch.keep(self._known_to(marts.CUSTOMER_COLUMNS), "fact-customer")
        current = self.known_customers.withColumn("is_current", F.lit(True))
        return marts.mart_customer_risk(rows, dims.with_unknown(current, "customer_sk", "customer_id", is_current=True), limits)

    @property
    def mart_merchant_risk(self) -> DataFrame:
        if "fact" in self.__dict__:
            return marts.mart_merchant_risk(self.fact, self.dim_merchant)
        rows = self._as_of(self._known_to(marts.MERCHANT_COLUMNS), dims.version_starts(self.dimension("customer_scd_events")), "since")
        return marts.mart_merchant_risk(rows, self.dim_merchant)

    def mart_fraud_features(self, exact_distinct: bool = False) -> DataFrame:
        if "fact" in self.__dict__:
            return marts.mart_fraud_features(self.fact, self.dim_customer, self.dim_location, exact_distinct=exact_distinct)
        countries = dims.home_countries(self.dimension("customer_scd_events"), self.dimension("locations"))
        columns = [c if c != "location_sk" else "location_id" for c in marts.FEATURE_COLUMNS]
        rows = self._as_of(self._known_to(columns, "home_country", ids=("device", "merchant")), countries, "country_then")
        rows = rows.withColumn("home_country", F.coalesce("country_then", "home_country")).drop("country_then")
        places = self.scratch.keep(dims.keep_first(self.dimension("locations"), "location_id", dims.KEEP["location"]), "places")
        return marts.mart_fraud_features(self.scratch.keep(rows, "fact-features"), None, places, exact_distinct=exact_distinct)

    def distinct_counts(self) -> DataFrame:
        """transaction_id and the feature mart's numbers of merchants and devices.  Labels, amounts, places and home countries,
        which these do not need, are neither looked up nor stored."""
        if "fact" in self.__dict__:
            return self.mart_fraud_features(exact_distinct=True).select("transaction_id", *marts.DISTINCT_COUNTS)
        rows = self._known_to(marts.DISTINCT_COLUMNS, ids=("device", "merchant")).where(F.col("customer_id").isNotNull())
        return marts.distinct_counts(self.scratch.keep(rows, "fact-distinct"))


def land(spark: SparkSession, raw_dir: str, bronze_dir: str, batch_id: str, at: str, one_document: bool = False) -> None:
    """Raw files to Bronze tables of text."""
    sinks.replace_table(landing.land_transactions(spark, f"{raw_dir}/transactions/txn_*", batch_id, at), f"{bronze_dir}/transactions", ("_partition_month",))
    for name in landing.CSV_SOURCES:
        sinks.replace_table(landing.land_csv(spark, f"{raw_dir}/{name}.csv", name, batch_id, at), f"{bronze_dir}/{name}")
    sinks.replace_table(landing.land_exchange_rates(spark, f"{raw_dir}/exchange_rates.json", batch_id, at, one_document), f"{bronze_dir}/exchange_rates")
    sinks.replace_table(landing.land_customer_events(spark, f"{raw_dir}/customer_events.json", batch_id, at, one_document), f"{bronze_dir}/customer_events")


def run_batch(spark: SparkSession, raw_dir: str, out_dir: str, *, start: dt.date, end: dt.date, run_id: str = "run", at: str = "1970-01-01T00:00:00") -> dict:
    """Lands, flags, checks, splits, builds the star and the marts, each layer written and reread; returns a summary with
    every check and gate."""
    bronze, silver_dir, gold, mart_dir = (f"{out_dir}/{x}" for x in ("bronze", "silver", "gold", "marts"))
    land(spark, raw_dir, bronze, run_id, at)
    names = ["transactions", *[n for n in landing.CSV_SOURCES if n != "cards"], "exchange_rates"]
    raw = {n: spark.read.parquet(f"{bronze}/{n}") for n in names}
    raw["fraud_labels"] = spark.read.option("header", True).schema("transaction_id string, is_fraud string, fraud_pattern string, label_source string, label_time string").csv(f"{raw_dir}/fraud_labels.csv")
    star = Star(spark, raw, run_id)
    sinks.replace_table(star.silver, f"{silver_dir}/transactions", ("_partition_month",))
    silver = star.silver = spark.read.parquet(f"{silver_dir}/transactions")
    manifest = spark.read.option("header", True).csv(f"{raw_dir}/error_manifest.csv")
    found = quality.run_checks(silver, raw["transactions"].count(), start, end, manifest)
    sinks.replace_table(quarantine.clean(silver), f"{silver_dir}/clean", ("_partition_month",))
    for name, rows in quarantine.buckets(quarantine.quarantine(silver, run_id, at)).items():
        sinks.replace_table(rows, f"{silver_dir}/{name}")
    star.clean = spark.read.parquet(f"{silver_dir}/clean")
    rejected = None
    for name in quarantine.BUCKETS:
        part = spark.read.parquet(f"{silver_dir}/{name}")
        rejected = part if rejected is None else rejected.unionByName(part)
    gates = {"quarantine": quarantine.verify(silver, star.clean, rejected)}
    for name in ("dim_date", "dim_customer", "dim_account", "dim_merchant", "dim_device", "dim_location", "fact"):
        sinks.replace_table(getattr(star, name), f"{gold}/{name}")
        setattr(star, name, spark.read.parquet(f"{gold}/{name}"))
    # the keys that the star schema declares; the gates below report the same and more
    keys = {f"{k}_sk": (getattr(star, f"dim_{k}"), f"{k}_sk") for k in ("customer", "account", "merchant", "device", "location")}
    fact.enforce(star.fact, unique=("transaction_id",), not_null=("transaction_id", "date_key", *keys), foreign=keys | {"date_key": (star.dim_date, "date_key")})
    others = {k: getattr(star, f"dim_{k}") for k in ("account", "merchant", "device", "location")}
    gates["gold"] = fact.verify(star.fact, star.clean, others, star.dim_date, star.dim_customer, raw["fraud_labels"])
    star.close()  # all its tables are in the lake now
    built = {"mart_daily": star.mart_daily, "mart_customer_risk": star.mart_customer_risk(), "mart_merchant_risk": star.mart_merchant_risk, "mart_fraud_features": star.mart_fraud_features()}
    for name, df in built.items():
        sinks.replace_table(df, f"{mart_dir}/{name}")
        built[name] = spark.read.parquet(f"{mart_dir}/{name}")
    gates["marts"] = marts.verify(star.fact, built["mart_daily"], built["mart_customer_risk"], built["mart_merchant_risk"], built["mart_fraud_features"], star.dim_customer)
    return {
        "verdict": checks.verdict(found),
        "checks": {c.name: (c.observed, c.passed) for c in found},
        "gates": {layer: {g.name: (g.passed, g.detail) for g in gs} for layer, gs in gates.items()},
        "rows": {"fact": star.fact.count(), **{n: d.count() for n, d in built.items()}},
        "buckets": quarantine.bucket_counts(silver),
        "error_codes": {r["error_code"]: r["n"] for r in quality.top_error_codes(silver).collect()},
        "separation": [r.asDict() for r in marts.feature_separation(built["mart_fraud_features"]).orderBy(F.col("pattern")).collect()],
    }
