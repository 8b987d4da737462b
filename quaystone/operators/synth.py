"""Synthetic raw data: every value is a function of the row's number, the seed and a salt.

Rows need no other rows, so any partitioning gives the same data and a lost task is made again as it was.  Distributions
and invariants are fixed below; rows of other generators are not reproduced.
"""

from __future__ import annotations

import datetime as dt
import math
import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystone.functions.exprs import ntz
from quaystone.operators.silver import CHANNELS, CURRENCIES
from quaystone.sources.landing import CSV_SOURCES, TRANSACTION_COLUMNS

# Mixes, distribution parameters and reference records.
TYPE_MIX = {"payment": 0.33814608, "transfer": 0.08375622, "withdrawal": 0.35166331, "topup": 0.21992261, "debit": 0.00651178}
CURRENCY_MIX = {"VND": 0.960, "USD": 0.025, "EUR": 0.015}
CHANNEL_MIX = {
    "payment": {"mobile": 0.42, "qr": 0.30, "pos": 0.20, "web": 0.08},
    "debit": {"mobile": 0.42, "qr": 0.30, "pos": 0.20, "web": 0.08},
    "transfer": {"mobile": 0.86, "web": 0.14},
    "withdrawal": {"atm": 0.82, "mobile": 0.18},
    "topup": {"mobile": 0.72, "atm": 0.18, "web": 0.10},
}
#: Mu, sigma, cap in VND of amounts.
AMOUNT = {
    "debit": (10.900768, 1.201596, 3584168),
    "payment": (11.968131, 1.184834, 1794028),
    "topup": (14.643535, 1.076588, 14555827),
    "transfer": (15.965576, 1.300404, 496810249),
    "withdrawal": (14.675281, 1.076981, 17293528),
}
FRAUD_FLOOR = {"transfer": (15.920044, 1.861425), "withdrawal": (15.843907, 2.101312)}
OTHER_FLOOR = (14.0, 0.85)
PER_UNIT = {"VND": 1.0, "USD": 25_400.0, "EUR": 27_300.0}
#: Share of each hour, and how fraud is made.
HOURS = (
    0.010, 0.006, 0.004, 0.004, 0.005, 0.008, 0.018, 0.040, 0.058, 0.067, 0.070, 0.071,
    0.072, 0.070, 0.068, 0.066, 0.065, 0.067, 0.069, 0.065, 0.052, 0.036, 0.024, 0.015,
)
FRAUD_MIX = {"velocity_burst": 0.25, "amount_spike": 0.20, "new_device_location": 0.20, "cross_country": 0.15, "night_high_amount": 0.12, "card_testing": 0.08}
FRAUD_GROUP = {"velocity_burst": 7, "cross_country": 2, "card_testing": 6}
FRAUD_FACTOR = {"velocity_burst": (3.0, 7.0), "amount_spike": (9.0, 24.0), "new_device_location": (4.0, 12.0), "cross_country": (3.0, 9.0), "night_high_amount": (6.0, 18.0)}
FRAUD_TYPES = {
    "velocity_burst": {"transfer": 0.65, "payment": 0.35},
    "amount_spike": {"transfer": 0.52, "withdrawal": 0.28, "payment": 0.20},
    "new_device_location": {"transfer": 0.58, "payment": 0.42},
    "cross_country": {"transfer": 0.62, "payment": 0.38},
    "night_high_amount": {"transfer": 0.72, "withdrawal": 0.28},
    "card_testing": {"payment": 1.0},
}
FRAUD_CHANNELS = {
    "velocity_burst": {"mobile": 1.0},
    "new_device_location": {"mobile": 0.82, "web": 0.18},
    "cross_country": {"mobile": 1.0},
    "night_high_amount": {"mobile": 0.72, "web": 0.28},
    "card_testing": {"pos": 0.35, "web": 0.65},
}
SPIKE_CAP = 400_000_000
#: Share of rows with each error, and the bucket that should catch it.
ERROR_RATES = {
    "null_transaction_id": 0.0010,
    "duplicate_transaction_id": 0.0020,
    "invalid_amount": 0.0035,
    "invalid_timestamp": 0.0025,
    "orphan_customer": 0.0015,
    "orphan_account": 0.0015,
    "orphan_merchant": 0.0010,
    "invalid_currency": 0.0010,
    "invalid_channel": 0.0010,
    "invalid_location": 0.0010,
}
EXPECTED_BUCKET = {
    "null_transaction_id": "quarantine_bad_records",
    "duplicate_transaction_id": "quarantine_duplicate_transactions",
    "invalid_amount": "quarantine_invalid_amount",
    "invalid_timestamp": "quarantine_invalid_timestamp",
}
#: Reference locations.
LOCATIONS = [
    ("loc_vn_hcm", "VN", "Ho Chi Minh City", "South", "10.7769", "106.7009", "Asia/Ho_Chi_Minh"),
    ("loc_vn_hn", "VN", "Hanoi", "North", "21.0278", "105.8342", "Asia/Ho_Chi_Minh"),
    ("loc_vn_dn", "VN", "Da Nang", "Central", "16.0544", "108.2022", "Asia/Ho_Chi_Minh"),
    ("loc_vn_hp", "VN", "Hai Phong", "North", "20.8449", "106.6881", "Asia/Ho_Chi_Minh"),
    ("loc_vn_ct", "VN", "Can Tho", "Mekong Delta", "10.0452", "105.7469", "Asia/Ho_Chi_Minh"),
    ("loc_vn_bd", "VN", "Binh Duong", "South", "11.3254", "106.4770", "Asia/Ho_Chi_Minh"),
    ("loc_vn_dnai", "VN", "Dong Nai", "South", "11.0686", "107.1676", "Asia/Ho_Chi_Minh"),
    ("loc_vn_qn", "VN", "Quang Ninh", "North", "21.0064", "107.2925", "Asia/Ho_Chi_Minh"),
    ("loc_vn_kh", "VN", "Khanh Hoa", "Central", "12.2585", "109.0526", "Asia/Ho_Chi_Minh"),
    ("loc_vn_lam_dong", "VN", "Lam Dong", "Central Highlands", "11.9404", "108.4583", "Asia/Ho_Chi_Minh"),
    ("loc_vn_nghe_an", "VN", "Nghe An", "North Central", "19.2342", "104.9200", "Asia/Ho_Chi_Minh"),
    ("loc_vn_thua_thien_hue", "VN", "Hue", "Central", "16.4637", "107.5909", "Asia/Ho_Chi_Minh"),
    ("loc_sg_singapore", "SG", "Singapore", "Singapore", "1.3521", "103.8198", "Asia/Singapore"),
    ("loc_th_bangkok", "TH", "Bangkok", "Bangkok", "13.7563", "100.5018", "Asia/Bangkok"),
    ("loc_us_san_francisco", "US", "San Francisco", "California", "37.7749", "-122.4194", "America/Los_Angeles"),
    ("loc_jp_tokyo", "JP", "Tokyo", "Kanto", "35.6762", "139.6503", "Asia/Tokyo"),
    ("loc_au_sydney", "AU", "Sydney", "New South Wales", "-33.8688", "151.2093", "Australia/Sydney"),
]
DOMESTIC, FOREIGN = 12, 5
RISK = {"low": 0.78, "medium": 0.18, "high": 0.04}
KYC = {"basic": 0.22, "standard": 0.62, "enhanced": 0.16}
CATEGORIES = ("grocery", "food", "transport", "ecommerce", "utilities", "travel", "gaming", "fashion", "electronics", "education")
DEVICE_KINDS = (("ios_phone", "iOS"), ("android_phone", "Android"), ("tablet", "Android"), ("desktop", "Windows"))
ISO = "yyyy-MM-dd'T'HH:mm:ss"


@dataclass(frozen=True)
class GeneratorConfig:
    seed: int = 20260610
    n_customers: int = 20_000
    n_transactions: int = 2_000_000
    n_merchants: int = 2_000
    date_start: dt.date = dt.date(2025, 12, 13)
    date_end: dt.date = dt.date(2026, 6, 10)
    fraud_rate: float = 0.007

    @property
    def days(self) -> int:
        return (self.date_end - self.date_start).days + 1


#: Environment variables that override a setting.
ENVIRONMENT = {"seed": "GEN_SEED", "n_customers": "GEN_N_CUSTOMERS", "n_transactions": "GEN_N_TXN", "n_merchants": "GEN_N_MERCHANTS", "date_start": "GEN_DATE_START", "date_end": "GEN_DATE_END", "fraud_rate": "GEN_FRAUD_RATE"}


def configure(**given) -> GeneratorConfig:
    """Defaults, then the environment, then what is given and not None."""
    read = {int: lambda v: int(v.replace("_", "")), float: float, dt.date: dt.date.fromisoformat}
    base = GeneratorConfig()
    env = {f.name: read[type(getattr(base, f.name))](os.environ[ENVIRONMENT[f.name]]) for f in fields(base) if os.environ.get(ENVIRONMENT[f.name])}
    return replace(base, **env | {k: v for k, v in given.items() if v is not None})


class Draws:
    """Random columns of one table."""

    def __init__(self, cfg: GeneratorConfig, table: str, row: str = "id"):
        self.seed, self.table, self.row = cfg.seed, table, row

    def uniform(self, salt: str, row: Column | None = None) -> Column:
        h = F.xxhash64(F.col(self.row) if row is None else row, F.lit(f"{self.seed}:{self.table}:{salt}"))
        return F.shiftrightunsigned(h, 11).cast("double") / float(2**53)

    def between(self, salt: str, low: float, high: float, row: Column | None = None) -> Column:
        return self.uniform(salt, row) * (high - low) + low

    def integer(self, salt: str, n: int, row: Column | None = None) -> Column:
        """0..n-1."""
        return F.least(F.floor(self.uniform(salt, row) * n), F.lit(n - 1)).cast("long")

    def normal(self, salt: str) -> Column:
        radius = F.sqrt(-2.0 * F.log(1.0 - self.uniform(f"{salt}:r")))
        return radius * F.cos(2 * math.pi * self.uniform(f"{salt}:a"))

    def choice(self, salt: str, mix: dict[str, float]) -> Column:
        u, total, at, out = self.uniform(salt) * sum(mix.values()), 0.0, list(mix), None
        for value in at[:-1]:
            total += mix[value]
            out = F.when(u < total, value) if out is None else out.when(u < total, value)
        return F.lit(at[-1]) if out is None else out.otherwise(at[-1])

    def zipf(self, salt: str, n: int, exponent: float) -> Column:
        """0..n-1 by a power law: the inverse of its continuous distribution function, with no table of weights."""
        e = 1.0 - exponent
        x = F.pow(self.uniform(salt) * (float(n + 1) ** e - 1.0) + 1.0, F.lit(1.0 / e))
        return F.least(F.floor(x) - 1, F.lit(n - 1)).cast("long")

    def scattered(self, index: Column, n: int) -> Column:
        """A fixed permutation-like spread of ranks over 0..n-1, so that the heaviest keys are not the first."""
        return F.pmod(index * 7919 + self.seed % n, F.lit(n)).cast("long")

    def date(self, salt: str, start: dt.date, end: dt.date) -> Column:
        return F.date_format(F.date_add(F.lit(start), self.integer(salt, max((end - start).days, 1)).cast("int")), "yyyy-MM-dd")


def _id(prefix: str, width: int, n: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0"))


def locations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOCATIONS, ", ".join(f"{c} string" for c in CSV_SOURCES["locations"][0]))


def _place(index: Column, field: int) -> Column:
    return F.element_at(F.array(*[F.lit(x[field]) for x in LOCATIONS]), (index + 1).cast("int"))


def _home(d: Draws, customer: Column) -> Column:
    """Home location of a customer, mostly domestic, as of the start."""
    h = Draws.__new__(Draws)
    h.seed, h.table, h.row = d.seed, "customers", d.row
    return F.when(h.uniform("abroad", customer) < 0.03, DOMESTIC + h.integer("where", FOREIGN, customer)).otherwise(h.integer("where", DOMESTIC, customer))


def customer_changes(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    """One or two changes for a tenth of the customers, in time order, each old value being the one before it."""
    d = Draws(cfg, "scd")
    base = spark.range(cfg.n_customers).where(d.uniform("changes") < 0.10)
    n = F.when(d.uniform("count") < 0.82, 1).otherwise(2)
    span = cfg.days * 86_400
    times = F.array_sort(F.array(d.integer("t0", span), d.integer("t1", span)))
    kind = d.choice("kind", {"risk_tier": 0.45, "home_city": 0.25, "phone": 0.30})
    steps = base.withColumns({"_n": n, "_t": times, "attribute_name": kind}).select("*", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("k"))
    tier = lambda k: F.element_at(F.array(*[F.lit(x) for x in RISK]), (F.pmod(d.integer("tier", 3) + k, F.lit(3)) + 1).cast("int"))
    city = lambda k: F.when(k == 0, _place(_home(d, F.col("id")), 2)).otherwise(_place(F.pmod(_home(d, F.col("id")) + k * 5, F.lit(DOMESTIC)), 2))
    phone = lambda k: F.concat(F.lit("+8490"), F.lpad(F.pmod(F.col("id") * 31 + k * 977, F.lit(10_000_000)).cast("string"), 7, "0"))
    value = lambda k: F.when(F.col("attribute_name") == "risk_tier", tier(k)).when(F.col("attribute_name") == "home_city", city(k)).otherwise(phone(k))
    second = F.element_at("_t", F.when(F.col("_n") == 1, 1).otherwise(F.col("k") + 1)).cast("int")
    at = ntz(dt.datetime.combine(cfg.date_start, dt.time())) + F.make_dt_interval(secs=second)
    return steps.select(
        _id("scd_", 9, F.col("id") * 2 + F.col("k")).alias("event_id"), "id", "k", _id("cus_", 6, F.col("id")).alias("customer_id"), F.date_format(at, ISO).alias("change_time"), "attribute_name",
        value(F.col("k")).alias("old_value"), value(F.col("k") + 1).alias("new_value"), F.lit("customer_profile_service").alias("source_system"),
    )


def customers(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    """The latest snapshot: attributes at the start, overwritten by the last change."""
    d = Draws(cfg, "customers")
    home = _home(d, F.col("id"))
    last = customer_changes(spark, cfg).groupBy("id").agg(F.max_by(F.struct("attribute_name", "new_value"), "k").alias("c"))
    new = lambda a: F.when(F.col("c.attribute_name") == a, F.col("c.new_value"))
    city = F.coalesce(new("home_city"), _place(home, 2))
    country = F.when(new("home_city").isNotNull(), "VN").otherwise(_place(home, 1))
    signup = dt.date(cfg.date_start.year - 3, 1, 1)
    return spark.range(cfg.n_customers).join(last, "id", "left").select(
        _id("cus_", 6, F.col("id")).alias("customer_id"), F.concat(F.lit("Customer "), F.col("id")).alias("full_name"), F.concat(F.lit("c"), F.col("id"), F.lit("@example.com")).alias("email"),
        F.coalesce(new("phone"), F.concat(F.lit("+8490"), F.lpad(F.pmod(F.col("id") * 31, F.lit(10_000_000)).cast("string"), 7, "0"))).alias("phone"),
        d.date("dob", dt.date(cfg.date_end.year - 70, 1, 1), dt.date(cfg.date_end.year - 18, 1, 1)).alias("dob"), d.date("signup", signup, cfg.date_start).alias("signup_date"),
        city.alias("home_city"), country.alias("home_country"), F.coalesce(new("risk_tier"), d.choice("tier", RISK)).alias("risk_tier"), d.choice("kyc", KYC).alias("kyc_level"),
    )


def _owner(d: Draws, n_customers: int) -> Column:
    """The first n_customers rows belong to a customer each, the rest to anyone."""
    return F.when(F.col("id") < n_customers, F.col("id")).otherwise(d.integer("owner", n_customers))


def accounts(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    d = Draws(cfg, "accounts")
    balance = F.least(F.exp(d.normal("balance") * 1.35 + 14.2), F.lit(2e9))
    return spark.range(round(cfg.n_customers * 1.2)).select(
        _id("acc_", 7, F.col("id")).alias("account_id"), _id("cus_", 6, _owner(d, cfg.n_customers)).alias("customer_id"), d.choice("type", {"wallet": 0.45, "checking": 0.40, "savings": 0.15}).alias("account_type"),
        d.date("opened", dt.date(cfg.date_start.year - 3, 1, 1), cfg.date_start).alias("opened_date"), d.choice("status", {"active": 0.965, "frozen": 0.025, "closed": 0.010}).alias("status"),
        F.lit("VND").alias("currency"), F.format_string("%.2f", balance).alias("current_balance"),
    )


def merchants(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    d = Draws(cfg, "merchants")
    where = d.integer("where", DOMESTIC)
    return spark.range(cfg.n_merchants).select(
        _id("mer_", 6, F.col("id")).alias("merchant_id"), F.concat(F.lit("Merchant "), F.col("id")).alias("merchant_name"),
        F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]), (d.integer("category", len(CATEGORIES)) + 1).cast("int")).alias("category"), _place(where, 2).alias("city"), _place(where, 1).alias("country"),
        d.date("onboarded", dt.date(cfg.date_start.year - 3, 1, 1), cfg.date_start).alias("onboarded_date"), F.format_string("%.4f", d.uniform("risk")).alias("risk_score"),
        F.format_string("%.4f", _failure(d, F.col("id"))).alias("base_failure_rate"),
    )


def _failure(d: Draws, merchant: Column) -> Column:
    m = Draws.__new__(Draws)
    m.seed, m.table, m.row = d.seed, "merchants", d.row
    return m.between("failure", 0.002, 0.035, merchant)


def devices(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    d = Draws(cfg, "devices")
    kind = (d.integer("kind", len(DEVICE_KINDS)) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in DEVICE_KINDS]), kind)
    return spark.range(round(cfg.n_customers * 1.5)).select(
        _id("dev_", 7, F.col("id")).alias("device_id"), _id("cus_", 6, _owner(d, cfg.n_customers)).alias("customer_id"), pick(0).alias("device_type"), pick(1).alias("os"),
        F.format_string("%d.%d", d.integer("major", 9) + 1, d.integer("minor", 10)).alias("app_version"), d.date("seen", dt.date(cfg.date_start.year - 2, 1, 1), cfg.date_start).alias("first_seen"),
        F.when(d.uniform("trust") < 0.9, "true").otherwise("false").alias("is_trusted"),
    )


def cards(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    d = Draws(cfg, "cards")
    return spark.range(round(cfg.n_customers * 0.8)).select(
        _id("card_", 7, F.col("id")).alias("card_id"), _id("acc_", 7, F.col("id")).alias("account_id"), _id("cus_", 6, F.col("id")).alias("customer_id"),
        d.choice("network", {"visa": 0.4, "mastercard": 0.3, "napas": 0.3}).alias("network"), d.choice("type", {"debit": 0.6, "credit": 0.3, "prepaid": 0.1}).alias("card_type"),
        F.lpad(d.integer("last4", 10_000).cast("string"), 4, "0").alias("last4"), d.date("issued", dt.date(cfg.date_start.year - 3, 1, 1), cfg.date_start).alias("issue_date"),
        F.format_string("%d-%02d", F.lit(cfg.date_end.year + 1) + d.integer("year", 4), d.integer("month", 12) + 1).alias("expiry_year_month"), F.lit("active").alias("status"),
    )


def _step(u: Column, weights: list[float]) -> Column:
    """Index of the weight that a uniform draw falls on, from an array of cumulative weights."""
    total, cumulative, at = sum(weights), [], 0.0
    for w in weights[:-1]:
        at += w / total
        cumulative.append(at)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cumulative]), lambda c: c <= u))


def _day_weights(cfg: GeneratorConfig) -> list[float]:
    """Fewer on weekends, a monthly wave, more around paydays."""
    out = []
    for i in range(cfg.days):
        weekend = 0.78 if (cfg.date_start + dt.timedelta(days=i)).weekday() >= 5 else 1.0
        out.append(weekend * (1.0 + 0.10 * math.sin(2 * math.pi * i / 30.5)) * (1.16 if i % 30 in (0, 1, 14, 15) else 1.0))
    return out


def largest_remainder(total: int, mix: dict[str, float]) -> dict[str, int]:
    """Whole parts of ``total`` by share: rounded down, and what is left goes to the largest remainders, the earlier name first."""
    exact = {name: round(total * share / sum(mix.values()), 9) for name, share in mix.items()}
    parts = {name: math.floor(x) for name, x in exact.items()}
    for name in sorted(mix, key=lambda n: parts[n] - exact[n])[: total - sum(parts.values())]:
        parts[name] += 1
    return parts


def invariants(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    """check, n: counts that hold for every seed, with 0 for faults: sizes of all tables, fraud by pattern, ids and errors."""
    raw = raw_transactions(spark, cfg)
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    is_ = lambda e: F.coalesce(F.col("_error") == e, F.lit(False))
    month = F.date_format("_at", "yyyy-MM")
    once = raw.agg(
        F.count(F.lit(1)).alias("transactions"),
        *[bad(F.col("pattern") == p).alias(f"fraud: {p}") for p in FRAUD_MIX],
        bad(F.col("pattern").isNotNull() & F.col("_error").isNotNull()).alias("errors on fraud"),
        bad((F.col("transaction_id") == "") != is_("null_transaction_id")).alias("empty ids not injected"),
        bad((F.col("transaction_id") != F.col("_id")) & ~is_("null_transaction_id") & ~is_("duplicate_transaction_id")).alias("ids not of their row"),
        bad((F.to_date("_at") < F.lit(cfg.date_start)) | (F.to_date("_at") > F.lit(cfg.date_end))).alias("outside the window"),
        bad(F.col("file_name") != F.concat(F.lit("txn_"), month, F.lit(".csv"))).alias("not in the file of their month"),
        bad((F.col("location_id") == "loc_bad_record") != is_("invalid_location")).alias("bad locations not injected"),
    )
    sizes = {"customers": customers, "accounts": accounts, "merchants": merchants, "devices": devices, "cards": cards}
    out = once.unpivot([], once.columns, "check", "n")
    for name, make in sizes.items():
        out = out.unionByName(make(spark, cfg).agg(F.countDistinct(CSV_SOURCES[name][0][0]).alias("n")).select(F.lit(name).alias("check"), "n"))
    faults = validate_raw(raw.select(*TRANSACTION_COLUMNS), error_manifest(raw), fraud_labels(raw), customers(spark, cfg), accounts(spark, cfg), merchants(spark, cfg))
    out = out.unionByName(faults.where("check <> 'rows'"))
    rates = exchange_rates(spark, cfg).select(F.size("records").cast("long").alias("n")).select(F.lit("rate days").alias("check"), "n")
    events = customer_events(spark, cfg).agg(F.sum(F.size("records")).cast("long").alias("n")).select(F.lit("customer events").alias("check"), "n")
    return out.unionByName(rates).unionByName(events)


def clean_transactions(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    """Typed transactions with fraud, before any error: ``pattern`` is null for legitimate ones.

    The rows with the smallest hash share of ``fraud_rate`` are fraud; a pattern's rows are grouped by number, and a
    group takes customer, merchant and base time from its own number."""
    d = Draws(cfg, "transactions")
    n = cfg.n_transactions
    fraud_rows = round(n * cfg.fraud_rate)
    # fraud rows are spread evenly: every (n / fraud_rows)-th row, shifted by the seed
    stride = max(n // max(fraud_rows, 1), 1)
    nth = F.when((F.pmod(F.col("id"), F.lit(stride)) == cfg.seed % stride) & (F.floor(F.col("id") / stride) < fraud_rows), F.floor(F.col("id") / stride))
    edge, pattern = 0, None
    for name, rows_of in largest_remainder(fraud_rows, FRAUD_MIX).items():
        edge += rows_of
        pattern = F.when(nth < edge, name) if pattern is None else pattern.when(nth < edge, name)
    group = F.lit(None).cast("long")
    for name, size in FRAUD_GROUP.items():
        group = F.when(F.col("pattern") == name, F.floor(F.col("nth") / size)).otherwise(group)
    rows = spark.range(n).withColumn("nth", nth).withColumn("pattern", pattern).withColumn("grp", group)
    is_ = lambda *names: F.coalesce(F.col("pattern").isin(*names), F.lit(False))
    by_pattern = lambda table, salt, otherwise: _by(F.col("pattern"), {p: d.choice(f"{salt}:{p}", mix) for p, mix in table.items()}, otherwise)
    kind = by_pattern(FRAUD_TYPES, "fraud type", d.choice("type", TYPE_MIX))
    rows = rows.withColumn("kind", kind)
    usual = _by(F.col("kind"), {k: d.choice(f"channel:{k}", mix) for k, mix in CHANNEL_MIX.items()}, F.lit("mobile"))
    own = d.scattered(d.zipf("customer", cfg.n_customers, 1.10), cfg.n_customers)
    customer = F.when(F.col("grp").isNotNull(), d.integer("group customer", cfg.n_customers, F.col("grp"))).otherwise(own)
    rows = rows.withColumns(
        {
            "channel": by_pattern(FRAUD_CHANNELS, "fraud channel", usual),
            "currency": F.when(F.col("pattern").isNotNull(), "VND").otherwise(d.choice("currency", CURRENCY_MIX)),
            "customer": customer,
        }
    )
    has_merchant = F.col("kind").isin("payment", "debit") | is_("card_testing")
    merchant = F.when(is_("card_testing"), d.integer("group merchant", cfg.n_merchants, F.col("grp"))).otherwise(d.scattered(d.zipf("merchant", cfg.n_merchants, 1.08), cfg.n_merchants))
    second = F.when(d.uniform("second device") < 0.12, F.pmod(F.col("customer") * 3 + cfg.n_customers, F.lit(round(cfg.n_customers * 1.5)))).otherwise(F.col("customer"))
    abroad = is_("new_device_location") | (is_("cross_country") & (F.pmod("nth", F.lit(2)) == 1))
    away = DOMESTIC + d.integer("abroad", FOREIGN)
    rows = rows.withColumns(
        {
            "merchant": F.when(has_merchant, merchant),
            "device": F.when(is_("new_device_location"), d.integer("new device", round(cfg.n_customers * 1.5))).otherwise(second),
            "location": F.when(abroad, away).otherwise(_home(d, F.col("customer"))),
        }
    )
    day = _step(d.uniform("day", F.coalesce(-1 - F.col("grp"), F.col("id"))), _day_weights(cfg))
    hour = _step(d.uniform("hour", F.coalesce(-1 - F.col("grp"), F.col("id"))), list(HOURS))
    within = (
        F.when(is_("velocity_burst"), d.integer("burst", 3600)).when(is_("card_testing"), d.integer("test", 1500))
        .when(is_("cross_country"), F.pmod("nth", F.lit(2)) * 2400).otherwise(d.integer("second", 3600))
    )
    clock = F.when(is_("night_high_amount"), 7200 + d.integer("night", 9000)).otherwise(hour * 3600 + within)
    lag = (
        F.when(F.col("pattern").isNotNull(), 30 + d.integer("fraud lag", 1770))
        .when(d.uniform("lag mode") < 0.962, F.greatest(F.lit(5), (-F.log(1 - d.uniform("lag a")) * 96 - F.log(1 - d.uniform("lag b")) * 80).cast("long")))
        .when(d.uniform("lag mode") < 0.992, 3600 + d.integer("lag medium", 11 * 3600)).otherwise(43_200 + d.integer("lag late", 5 * 86_400 - 43_200))
    )
    amount = _by(F.col("kind"), {k: F.least(F.exp(d.normal("amount") * s + m), F.lit(float(cap))) for k, (m, s, cap) in AMOUNT.items()}, F.lit(1.0))
    floor = _by(F.col("kind"), {k: F.exp(d.normal("floor") * s + m) for k, (m, s) in FRAUD_FLOOR.items()}, F.exp(d.normal("floor") * OTHER_FLOOR[1] + OTHER_FLOOR[0]))
    raised = _by(F.col("pattern"), {p: F.greatest(F.col("plain") * d.between(f"factor:{p}", *lo_hi), F.col("floor")) for p, lo_hi in FRAUD_FACTOR.items()}, F.col("plain"))
    raised = F.when(is_("card_testing"), d.between("test amount", 5_000, 95_000)).when(is_("amount_spike"), F.least(raised, F.lit(float(SPIKE_CAP)))).otherwise(raised)
    unit = _by(F.col("currency"), {k: F.lit(v) for k, v in PER_UNIT.items()}, F.lit(1.0))
    fail = 0.010 + F.when(F.col("merchant").isNotNull(), _failure(d, F.col("merchant"))).otherwise(0.0) + F.when(F.col("channel") == "web", 0.006).when(F.col("channel") == "atm", 0.004).otherwise(0.0)
    draw = d.uniform("status")
    status = F.when(draw < fail, "failed").when(draw < fail + 0.006, "pending").otherwise("success")
    last_test = F.pmod("nth", F.lit(FRAUD_GROUP["card_testing"])) == FRAUD_GROUP["card_testing"] - 1
    status = F.when(is_("card_testing"), F.when(last_test, "success").otherwise("failed")).otherwise(status)
    source = _by(F.col("channel"), {k: F.lit(v) for k, v in {"mobile": "mobile_wallet", "qr": "merchant_gateway", "pos": "card_processor", "web": "merchant_gateway", "atm": "atm_switch"}.items()}, F.lit("core_banking"))
    source = F.when(F.col("kind").isin("transfer", "topup") & (d.uniform("core") < 0.22), "core_banking").otherwise(source)
    start = ntz(dt.datetime.combine(cfg.date_start, dt.time()))
    rows = rows.withColumns({"plain": amount, "floor": floor})
    return rows.withColumns(
        {
            "amount": F.greatest(F.round(raised / unit, 2), F.lit(0.01)),
            "status": status,
            "source": source,
            "event_time": start + F.make_dt_interval(days=day, secs=clock.cast("int")),
            "lag": lag,
        }
    ).drop("plain", "floor")


def _by(key: Column, table: dict[str, Column], otherwise: Column) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return otherwise if out is None else out.otherwise(otherwise)


def _error(cfg: GeneratorConfig) -> Column:
    """Error of a row, null for most: disjoint ranges of one draw, so a row has one error; fraud rows have none."""
    u, at, out = Draws(cfg, "errors").uniform("kind"), 0.0, None
    for name, rate in ERROR_RATES.items():
        at += rate
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return F.when(F.col("pattern").isNull(), out)


def raw_transactions(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    """The 20 raw text columns, with errors, and _month and _error beside them."""
    d = Draws(cfg, "errors")
    rows = clean_transactions(spark, cfg).withColumn("_error", _error(cfg))
    e = lambda name: F.coalesce(F.col("_error") == name, F.lit(False))
    tid = lambda n: _id("txn_", 12, n)
    other = F.pmod(F.col("id") + 1 + d.integer("twin", max(cfg.n_transactions - 1, 1)), F.lit(cfg.n_transactions))
    kind = F.when(e("orphan_merchant"), "payment").otherwise(F.col("kind"))
    third = d.integer("third", 3)
    amount = F.format_string("%.2f", F.col("amount"))
    bad_amount = F.when(third == 0, F.concat(F.lit("-"), amount)).when(third == 1, "NaN").otherwise("amount_unknown")
    bad_time = F.when(d.uniform("half") < 0.5, "2099-12-31T23:59:59").otherwise("not_a_timestamp")
    out = {
        "transaction_id": F.when(e("null_transaction_id"), "").when(e("duplicate_transaction_id"), tid(other)).otherwise(tid(F.col("id"))),
        "customer_id": F.when(e("orphan_customer"), "cus_999999").otherwise(_id("cus_", 6, F.col("customer"))),
        "account_id": F.when(e("orphan_account"), "acc_9999999").otherwise(_id("acc_", 7, F.col("customer"))),
        "merchant_id": F.when(e("orphan_merchant"), "mer_999999").when(F.col("merchant").isNotNull(), _id("mer_", 6, F.col("merchant"))).otherwise(""),
        "device_id": _id("dev_", 7, F.col("device")),
        "card_id": F.when(kind.isin("payment", "debit") & (F.col("customer") < round(cfg.n_customers * 0.8)), _id("card_", 7, F.col("customer"))).otherwise(""),
        "amount": F.when(e("invalid_amount"), bad_amount).otherwise(amount),
        "currency": F.when(e("invalid_currency"), "XXX").otherwise(F.col("currency")),
        "transaction_type": kind,
        "channel": F.when(e("invalid_channel"), "foo").otherwise(F.col("channel")),
        "transaction_time": F.when(e("invalid_timestamp"), bad_time).otherwise(F.date_format("event_time", ISO)),
        "country": F.when(e("invalid_location"), "ZZ").otherwise(_place(F.col("location"), 1)),
        "city": F.when(e("invalid_location"), "Unknown City").otherwise(_place(F.col("location"), 2)),
        "status": F.col("status"),
        "location_id": F.when(e("invalid_location"), "loc_bad_record").otherwise(_place(F.col("location"), 0)),
        "ingestion_time": F.date_format(F.col("event_time") + F.make_dt_interval(secs=F.col("lag").cast("int")), ISO),
        "source_system": F.col("source"),
        "batch_id": F.concat(F.lit("batch_"), F.date_format("event_time", "yyyyMM")),
        "file_name": F.concat(F.lit("txn_"), F.date_format("event_time", "yyyy-MM"), F.lit(".csv")),
        "source_row_number": F.col("id").cast("string"),
    }
    assert list(out) == list(TRANSACTION_COLUMNS)
    return rows.select(*[v.alias(k) for k, v in out.items()], F.date_format("event_time", "yyyy-MM").alias("_month"), "_error", tid(F.col("id")).alias("_id"), "pattern", F.col("event_time").alias("_at"))


def error_manifest(raw: DataFrame) -> DataFrame:
    """A row for each injected error."""
    bucket = _by(F.col("_error"), {k: F.lit(v) for k, v in EXPECTED_BUCKET.items()}, F.lit("quarantine_bad_records"))
    field = {
        "null_transaction_id": "transaction_id", "duplicate_transaction_id": "transaction_id", "invalid_amount": "amount", "invalid_timestamp": "transaction_time", "orphan_customer": "customer_id",
        "orphan_account": "account_id", "orphan_merchant": "merchant_id", "invalid_currency": "currency", "invalid_channel": "channel", "invalid_location": "location_id",
    }
    return raw.where("_error is not null").select(
        F.col("source_row_number").alias("row_index"), F.col("_id").alias("original_transaction_id"), F.col("_error").alias("error_type"), bucket.alias("expected_bucket"),
        _by(F.col("_error"), {k: F.lit(v) for k, v in field.items()}, F.lit("")).alias("corrupted_field"), _by(F.col("_error"), {k: F.col(v) for k, v in field.items()}, F.lit("")).alias("corrupted_value"),
        F.concat(F.lit("injected "), F.col("_error")).alias("notes"),
    )


def fraud_labels(raw: DataFrame) -> DataFrame:
    """A label for every row's own id."""
    return raw.select(
        F.col("_id").alias("transaction_id"), F.when(F.col("pattern").isNotNull(), "1").otherwise("0").alias("is_fraud"), F.coalesce("pattern", F.lit("")).alias("fraud_pattern"),
        F.lit("synthetic").alias("label_source"), F.date_format(F.col("_at") + F.expr("interval 2 days"), ISO).alias("label_time"),
    )


def exchange_rates(spark: SparkSession, cfg: GeneratorConfig) -> DataFrame:
    """One payload: daily rates that walk at random from a start value."""
    d = Draws(cfg, "rates")
    upto = Window.orderBy("id")  # one row a day
    walk = lambda salt, start, s: F.round(F.exp(F.sum(F.log1p(d.normal(salt) * s)).over(upto)) * start, 4)
    day = F.date_format(F.date_add(F.lit(cfg.date_start), F.col("id").cast("int")), "yyyy-MM-dd")
    rows = spark.range(cfg.days).select(
        "id",
        F.struct(
            day.alias("date"), F.lit("VND").alias("base_currency"), F.lit("VND per 1 unit of currency").alias("quote"),
            F.struct(F.lit(1.0).alias("VND"), walk("usd", 25_350.0, 0.0018).alias("USD"), walk("eur", 27_450.0, 0.0022).alias("EUR")).alias("rates"), F.lit("mock_fx_api").alias("source_system"),
        ).alias("r"),
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("id", "r"))), lambda x: x["r"])
    return rows.groupBy().agg(F.lit("exchange_rates").alias("api_name"), F.lit(f"{cfg.date_end}T00:00:00").alias("generated_at"), ordered.alias("records"))


def customer_events(spark: SparkSession, cfg: GeneratorConfig, page: int = 5_000) -> DataFrame:
    """Payloads of up to ``page`` events each, with typed metadata."""
    d = Draws(cfg, "activity")
    kind = d.choice("kind", {"login": 0.72, "add_device": 0.10, "password_change": 0.08, "add_beneficiary": 0.10})
    who = d.scattered(d.zipf("who", cfg.n_customers, 1.05), cfg.n_customers)
    n = max(cfg.n_customers, round(cfg.n_customers * 2.5))
    rows = spark.range(n).withColumns({"kind": kind, "who": who})
    abroad = F.col("kind").isin("login", "add_device") & (d.uniform("away") < 0.035)
    place = F.when(abroad, DOMESTIC + d.integer("abroad", FOREIGN)).otherwise(_home(d, F.col("who")))
    start = ntz(dt.datetime.combine(cfg.date_start, dt.time()))
    at = start + F.make_dt_interval(days=d.integer("day", cfg.days).cast("int"), secs=(_step(d.uniform("hour"), list(HOURS)) * 3600 + d.integer("second", 3600)).cast("int"))
    mode = d.uniform("mode")
    lag = F.when(mode < 0.92, 3 + d.integer("fast", 417)).when(mode < 0.98, 900 + d.integer("medium", 27_900)).otherwise(43_200 + d.integer("late", 302_400))
    meta = _by(
        F.col("kind"),
        {
            "login": F.create_map(F.lit("auth_result"), d.choice("auth", {"success": 0.965, "failed": 0.035})),
            "add_device": F.create_map(F.lit("trust_decision"), d.choice("trust", {"approved": 0.90, "review": 0.10})),
            "password_change": F.create_map(F.lit("initiated_by"), d.choice("by", {"customer": 0.94, "risk_engine": 0.06})),
        },
        F.create_map(F.lit("beneficiary_bank"), d.choice("bank", dict.fromkeys(("VCB", "TCB", "ACB", "BIDV", "MB", "VPB"), 1.0))),
    )
    record = F.struct(
        _id("evt_", 10, F.col("id") + 1).alias("event_id"), _id("cus_", 6, F.col("who")).alias("customer_id"), F.col("kind").alias("event_type"), F.date_format(at, ISO).alias("event_time"),
        F.date_format(at + F.make_dt_interval(secs=lag.cast("int")), ISO).alias("ingestion_time"), _id("dev_", 7, F.col("who")).alias("device_id"), _place(place, 1).alias("country"),
        _place(place, 2).alias("city"), F.lit("customer_activity_api").alias("source_system"), meta.alias("metadata"),
    )
    paged = rows.groupBy(F.floor(F.col("id") / page).alias("_page")).agg(F.collect_list(record).alias("records"))
    return paged.select(F.lit("customer_events").alias("api_name"), F.lit(f"{cfg.date_end}T00:00:00").alias("generated_at"), "records")


def write_raw(spark: SparkSession, cfg: GeneratorConfig, out_dir: str) -> None:
    """The raw folder that ``plans.star.run_batch`` reads: a CSV folder for each month (``txn_month=...``) and table, JSON payloads (one a
    line), labels and the error manifest."""
    raw = raw_transactions(spark, cfg)
    csv = lambda df, path: df.write.mode("overwrite").option("header", True).csv(path)
    monthly = raw.select(*TRANSACTION_COLUMNS, F.col("_month").alias("txn_month"))
    monthly.write.mode("overwrite").option("header", True).partitionBy("txn_month").csv(f"{out_dir}/transactions")
    tables = {"customers": customers, "customer_scd_events": customer_changes, "accounts": accounts, "merchants": merchants, "devices": devices, "cards": cards}
    for name, make in tables.items():
        csv(make(spark, cfg).select(*CSV_SOURCES[name][0]), f"{out_dir}/{name}.csv")
    csv(locations(spark), f"{out_dir}/locations.csv")
    csv(fraud_labels(raw), f"{out_dir}/fraud_labels.csv")
    csv(error_manifest(raw), f"{out_dir}/error_manifest.csv")
    exchange_rates(spark, cfg).write.mode("overwrite").json(f"{out_dir}/exchange_rates.json")
    customer_events(spark, cfg).write.mode("overwrite").json(f"{out_dir}/customer_events.json")


def validate_raw(raw: DataFrame, manifest: DataFrame, labels: DataFrame, customers: DataFrame, accounts: DataFrame, merchants: DataFrame) -> DataFrame:
    """check, n: rows with a fault that the manifest does not name, missing fraud, and counts, from joins with the
    reference ids (no iteration over rows)."""
    named = manifest.select(F.col("row_index").alias("source_row_number"), F.lit(True).alias("_named")).distinct()
    rows = raw.join(named, "source_row_number", "left")
    for ids, key in ((customers, "customer_id"), (accounts, "account_id"), (merchants, "merchant_id")):
        rows = rows.join(ids.select(key).distinct().withColumn(f"_{key}", F.lit(True)), key, "left")
    bad = lambda c: F.sum(F.when(c & F.col("_named").isNull(), 1).otherwise(0)).cast("long")
    amount = F.col("amount").try_cast("double")
    once = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        bad(F.col("_customer_id").isNull() | F.col("_account_id").isNull() | (F.col("_merchant_id").isNull() & (F.col("merchant_id") != ""))).alias("unexpected_orphans"),
        bad(amount.isNull() | F.isnan(amount) | (amount <= 0) | ~F.col("currency").isin(*CURRENCIES) | ~F.col("channel").isin(*CHANNELS)).alias("unexpected_faults"),
    )
    twice = raw.where("transaction_id <> ''").groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("source_row_number").alias("r")).where("n > 1")
    named_rows = manifest.where("error_type = 'duplicate_transaction_id'").select("row_index").distinct()
    unnamed = twice.select("transaction_id", F.explode("r").alias("row_index")).join(named_rows, "row_index", "left_anti").groupBy("transaction_id").count().where("count > 1")
    out = once.unpivot([], once.columns, "check", "n")
    out = out.unionByName(unnamed.agg(F.count(F.lit(1)).alias("n")).select(F.lit("unexpected_duplicates").alias("check"), "n"))
    return out.unionByName(labels.agg(F.sum(F.col("is_fraud").cast("long")).alias("n")).select(F.lit("fraud_labels").alias("check"), "n"))
