"""Fact table: surrogate keys by lookup, the customer version of the time, and labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystone.functions.exprs import count_if
from quaystone.operators.checks import Gate
from quaystone.operators.dims import UNKNOWN_SK
from quaystone.operators.slices import as_of

#: Columns in order.
COLUMNS = [
    "transaction_id", "date_key", "customer_sk", "account_sk", "merchant_sk", "device_sk", "location_sk", "channel", "transaction_type", "status", "currency", "fraud_pattern",
    "amount_original", "exchange_rate", "amount_vnd", "is_fraud", "event_time", "ingestion_time", "ingestion_lag_seconds",
]


def with_key(rows: DataFrame, dim: DataFrame, kind: str) -> DataFrame:
    """The surrogate key of a business key, Unknown where there is none."""
    key, sk = f"{kind}_id", f"{kind}_sk"
    keys = dim.where(F.col(sk) != UNKNOWN_SK).select(F.col(key).alias("_key"), F.col(sk))
    return rows.join(keys, F.col(key) == F.col("_key"), "left").drop("_key").withColumn(sk, F.coalesce(sk, F.lit(UNKNOWN_SK).cast("long")))


def with_known_id(rows: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """The business key itself where ``ids`` has it, null for Unknown: for marts that show no surrogate key, so none is
    numbered.  ``ids`` has a row for each key and is a stored table: Spark cuts the rows of a very frequent key, such as none
    at all, into several tasks only where nothing stands between the join and the shuffles."""
    key = f"{kind}_id"
    ids = ids.select(F.col(key).alias("_key"))
    return rows.join(ids, F.col(key) == F.col("_key"), "left").withColumn(key, F.col("_key")).drop("_key")


def with_customer_version(rows: DataFrame, dim_customer: DataFrame, time: str = "event_time", asked: DataFrame | None = None) -> DataFrame:
    """As-of join on half-open validity, in one sorted pass over rows and versions (``slices.as_of``): a time equal to
    valid_from belongs to the new version, and versions of no length match nothing."""
    versions = dim_customer.where(F.col("customer_sk") != UNKNOWN_SK).select("customer_id", "customer_sk", "valid_from", "valid_to")
    return as_of(rows, versions, "customer_id", time, ["customer_sk"], asked=asked).withColumn("customer_sk", F.coalesce("customer_sk", F.lit(UNKNOWN_SK).cast("long")))


def with_known_customer(rows: DataFrame, customers: DataFrame, *columns: str) -> DataFrame:
    """``customer_id`` where the customer has a version at the time of the row, null elsewhere, and ``columns`` of
    ``dims.known_customers``: who it was, by one join with the customers, where no one asks for the version."""
    keys = customers.select(F.col("customer_id").alias("_key"), "known_from", *columns)
    joined = rows.join(keys.hint("shuffle_hash"), F.col("customer_id") == F.col("_key"), "left")
    return joined.withColumn("customer_id", F.when(F.col("event_time") >= F.col("known_from"), F.col("_key"))).drop("_key", "known_from")


def label_per_id(labels: DataFrame) -> DataFrame:
    """One label for each id: fraud wins over none."""
    is_fraud = F.coalesce(F.col("is_fraud").try_cast("double").cast("int"), F.lit(0))
    pattern = F.when(F.col("fraud_pattern") != "", F.col("fraud_pattern"))
    best = labels.select(F.col("transaction_id").alias("_key"), F.struct(is_fraud.alias("is_fraud"), pattern.alias("fraud_pattern")).alias("_l"))
    return best.groupBy("_key").agg(F.max("_l").alias("_l")).select("_key", "_l.is_fraud", "_l.fraud_pattern")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    joined = rows.join(label_per_id(labels).hint("shuffle_hash"), F.col("transaction_id") == F.col("_key"), "left").drop("_key")
    return joined.withColumn("is_fraud", F.coalesce("is_fraud", F.lit(0)))


def fact_transactions(clean: DataFrame, dims: Mapping[str, DataFrame], labels: DataFrame, columns: list[str] | None = None, asked: DataFrame | None = None) -> DataFrame:
    """The fact table, or the ``columns`` of it that are asked for: a dimension is joined, and taken from ``dims`` at all, only
    if its key is among them, and labels likewise.  Labels go first, as duplicates before them were looked up by the same id.
    ``asked``: as for ``slices.as_of``."""
    columns = columns or COLUMNS
    rows = clean.withColumn("date_key", F.date_format("event_date", "yyyyMMdd").cast("int"))
    if "is_fraud" in columns or "fraud_pattern" in columns:
        rows = with_labels(rows, labels)
    for kind in ("account", "merchant", "device", "location"):
        if f"{kind}_sk" in columns:
            rows = with_key(rows, dims[kind], kind)
    if "customer_sk" in columns:
        rows = with_customer_version(rows.select(*[c for c in rows.columns if c in columns or c in ("customer_id", "event_time", "transaction_id")]), dims["customer"], asked=asked)
    return rows.select(*columns)


def verify(fact: DataFrame, clean: DataFrame, dims: dict[str, DataFrame], dim_date: DataFrame, dim_customer: DataFrame, labels: DataFrame | None = None) -> list[Gate]:
    """Row counts, keys and sums of the star.  Spark enforces no constraints, so these stand for the primary and foreign
    keys."""
    sks = ["customer_sk", *[f"{k}_sk" for k in dims]]
    f = fact.agg(
        F.count(F.lit(1)).alias("n"),
        *[count_if(F.col(c).isNull()).alias(f"null_{c}") for c in [*sks, "date_key"]],
        F.coalesce(F.sum("is_fraud"), F.lit(0)).alias("fraud"),
        count_if((F.col("is_fraud") == 1) != F.col("fraud_pattern").isNotNull()).alias("pattern"),
        F.coalesce(F.sum("amount_vnd"), F.lit(0.0)).alias("amount"),
        *[count_if(F.col(c) == UNKNOWN_SK).alias(f"unknown_{c}") for c in sks],
    ).first()
    c = clean.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("amount_vnd"), F.lit(0.0)).alias("amount")).first()
    # every key is looked up in one pass: a key that its dimension lacks has no mark
    marked = fact.select(*sks, "date_key")
    for k, d in (dims | {"customer": dim_customer, "date": dim_date}).items():
        key = "date_key" if k == "date" else f"{k}_sk"
        marked = marked.join(d.select(F.col(key).alias("_key")).distinct().withColumn(f"_{k}", F.lit(True)), F.col(key) == F.col("_key"), "left").drop("_key")
    lost = marked.agg(*[count_if(F.col(f"_{k}").isNull()).alias(k) for k in (*dims, "customer", "date")]).first().asDict()
    days = lost.pop("date")
    orphans = lost
    twice = fact.groupBy("transaction_id").count().where("count > 1").count()
    current = dim_customer.groupBy("customer_id").agg(F.sum(F.col("is_current").cast("int")).alias("n")).where("n <> 1").count()
    nulls = sum(f[f"null_{x}"] for x in [*sks, "date_key"])
    gates = [
        Gate("fact_rowcount_eq_clean", f["n"], c["n"], f"{f['n']} vs {c['n']}"),
        Gate("no_null_sk", nulls),
        Gate("all_sk_resolve_to_dim", sum(orphans.values()), 0, str(orphans)),
        Gate("date_key_in_dim_date", days),
        Gate("fraud_pattern_consistency", f["pattern"]),
        Gate("transaction_id_unique", twice),
        Gate("one_is_current_per_customer", current),
        Gate("amount_vnd_sum_conserved", f["amount"] - c["amount"], 0, f"{f['amount']} vs {c['amount']}", within=1.0),
        # reported, never broken
        Gate("unknown_usage", used := sum(f[f"unknown_{x}"] for x in sks), used, str({x: f[f"unknown_{x}"] for x in sks})),
    ]
    if labels is not None:
        expected = clean.select("transaction_id").join(label_per_id(labels).where("is_fraud = 1"), F.col("transaction_id") == F.col("_key"), "left_semi").count()
        gates.append(Gate("is_fraud_total", f["fraud"], expected, f"{f['fraud']} vs {expected}"))
    return gates


def broken_constraints(table: DataFrame, *, unique: tuple[str, ...] = (), not_null: tuple[str, ...] = (), foreign: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """constraint, rows: how many rows break each declared constraint."""
    parts = []
    if unique:
        parts.append(table.groupBy(*unique).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("rows")).select(F.lit(f"unique({', '.join(unique)})").alias("constraint"), "rows"))
    if not_null:
        once = table.agg(*[count_if(F.col(c).isNull()).alias(f"not_null({c})") for c in not_null])
        parts.append(once.unpivot([], once.columns, "constraint", "rows"))
    for column, (target, key) in (foreign or {}).items():
        keys = target.select(F.col(key).alias("_key")).distinct()
        miss = table.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")
        parts.append(miss.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(f"foreign({column})").alias("constraint"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class ConstraintError(ValueError):
    """Declared keys that the rows break."""


def enforce(table: DataFrame, **constraints) -> DataFrame:
    """``table`` itself, if it breaks none of the constraints (as for ``broken_constraints``), so that a table is written only
    with its keys in order, as a database would have it."""
    broken = {r["constraint"]: r["rows"] for r in broken_constraints(table, **constraints).where("rows > 0").collect()}  # a row for each constraint
    if broken:
        raise ConstraintError(f"rows that break constraints: {broken}")
    return table
