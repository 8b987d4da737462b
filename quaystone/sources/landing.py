"""Raw files to all-text tables with lineage columns.

Business columns stay text and are never inferred; an empty field is the empty text, not null.  CSV columns are found by
the names in each file's header; records that don't have as many fields as their header are no rows but rejects.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaystone.functions.exprs import strip

#: Raw columns of each source, and the source system that its lineage names.
TRANSACTION_COLUMNS = [
    "transaction_id", "customer_id", "account_id", "merchant_id", "device_id", "card_id", "amount", "currency", "transaction_type", "channel",
    "transaction_time", "country", "city", "status", "location_id", "ingestion_time", "source_system", "batch_id", "file_name", "source_row_number",
]
CSV_SOURCES = {
    "customers": (["customer_id", "full_name", "email", "phone", "dob", "signup_date", "home_city", "home_country", "risk_tier", "kyc_level"], "profile_csv"),
    "customer_scd_events": (["event_id", "customer_id", "change_time", "attribute_name", "old_value", "new_value", "source_system"], "customer_profile_service"),
    "accounts": (["account_id", "customer_id", "account_type", "opened_date", "status", "currency", "current_balance"], "core_banking_csv"),
    "merchants": (["merchant_id", "merchant_name", "category", "city", "country", "onboarded_date", "risk_score", "base_failure_rate"], "merchant_csv"),
    "devices": (["device_id", "customer_id", "device_type", "os", "app_version", "first_seen", "is_trusted"], "device_registry_csv"),
    "cards": (["card_id", "account_id", "customer_id", "network", "card_type", "last4", "issue_date", "expiry_year_month", "status"], "card_csv"),
    "locations": (["location_id", "country", "city", "region", "lat", "lon", "timezone"], "reference_csv"),
}


def text_schema(columns: list[str] | tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def stamp(df: DataFrame, source_file: str, source_system: str, batch_id: str, ingested_at: str) -> DataFrame:
    """Lineage columns; the time is an argument, so a rerun gives the same table.  A source's own source_system is
    a business column and stays beside them."""
    return df.withColumns({"_ingested_at": F.lit(ingested_at), "_source_file": F.lit(source_file), "_source_system": F.lit(source_system), "_batch_id": F.lit(batch_id)})


#: Columns of a scanned file that no source has: the text of a record that doesn't fit, and where a row is from.
_BROKEN, _FILE = "_broken_record", "_file_path"
#: Records that fit their header.  Spark wants a column of the file read beside the broken text, so one has to be looked at.
_WHOLE, _REJECTED = (f"{_BROKEN} is {what} and length(coalesce(_last, '')) >= 0" for what in ("null", "not null"))
#: Separators outside quotes.
_SEPARATOR = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _matches(spark: SparkSession, path: str) -> list[str]:
    """Files and folders that a path or glob names, in order."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found or ())


def headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Column names of each CSV that a path or glob names.  The part files of a folder have one header; no row is read."""
    return {f: spark.read.option("header", True).option("escape", '"').csv(f).columns for f in _matches(spark, path)}


def scan_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """Text columns by the names in the headers, whatever their order; _broken_record is the text of a record with too few
    or too many fields, null for all others.  A column that a header lacks is empty; columns that no one asked for are left
    in the file.  A record is a line, so that large files are split; with ``multi_line`` quoted fields may hold line breaks.
    Files of one header are one scan."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file, names in headers(spark, path).items():
        by_header.setdefault(tuple(names), []).append(file)
    if not by_header:
        raise FileNotFoundError(path)
    out = None
    for names, files in by_header.items():
        schema = text_schema([*names, _BROKEN])
        reader = spark.read.schema(schema).options(header=True, escape='"', multiLine=multi_line, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        part = reader.options(columnNameOfCorruptRecord=_BROKEN, columnPruning=False).csv(files)
        known = {n.lower(): n for n in names}
        wanted = [F.col(f"`{known[c.lower()]}`").alias(c) if c.lower() in known else F.lit("").alias(c) for c in columns]
        part = part.select(*wanted, _BROKEN, F.col(f"`{names[-1]}`").alias("_last"), F.lit(len(names)).alias("_fields"), F.col("_metadata.file_path").alias(_FILE))
        out = part if out is None else out.unionByName(part)
    return out


def read_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """Rows of CSV files with a header, by column name, white space kept, empty fields as empty text; rejects left out."""
    return scan_csv(spark, path, columns, multi_line).where(_WHOLE).select(*columns).na.fill("")


def rejected_csv(spark: SparkSession, path: str, columns: list[str], multi_line: bool = False) -> DataFrame:
    """_source_file, reason (``missing_fields``, ``extra_fields``), record: what ``read_csv`` leaves out."""
    rows = scan_csv(spark, path, columns, multi_line).where(_REJECTED)
    name = F.regexp_extract(_FILE, r"([^/]+)$", 1)
    found = F.regexp_count(_BROKEN, F.lit(_SEPARATOR)) + 1
    return rows.select(name.alias("_source_file"), F.when(found < F.col("_fields"), "missing_fields").otherwise("extra_fields").alias("reason"), F.col(_BROKEN).alias("record"))


def header_faults(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """file, fault (``missing``, ``extra``), column for the headers that differ from a source's columns; a row for each
    fault of a file, so bounded by their number."""
    found = []
    for file, names in headers(spark, path).items():
        has, wants = {n.lower() for n in names}, {c.lower() for c in columns}
        found += [(file.rsplit("/", 1)[-1], "missing", c) for c in sorted(wants - has)] + [(file.rsplit("/", 1)[-1], "extra", c) for c in sorted(has - wants)]
    return spark.createDataFrame(found, "file string, fault string, column string")


def land_csv(spark: SparkSession, path: str, table: str, batch_id: str, ingested_at: str, multi_line: bool = False) -> DataFrame:
    columns, system = CSV_SOURCES[table]
    return stamp(read_csv(spark, path, columns, multi_line), path.rsplit("/", 1)[-1], system, batch_id, ingested_at)


def land_transactions(spark: SparkSession, glob: str, batch_id: str, ingested_at: str, multi_line: bool = False) -> DataFrame:
    """Monthly files ``txn_YYYY-MM.csv``, or folders of part files of that name or ``txn_month=YYYY-MM``; the month is the file's, not the event's."""
    rows = scan_csv(spark, glob, TRANSACTION_COLUMNS, multi_line).where(_WHOLE)
    name = F.regexp_extract(_FILE, r"(txn_(?:month=)?[0-9]{4}-[0-9]{2}[^/]*)", 1)
    month = F.regexp_extract(_FILE, r"txn_(?:month=)?([0-9]{4}-[0-9]{2})", 1)
    rows = rows.select(*TRANSACTION_COLUMNS, name.alias("_source_file"), month.alias("_partition_month")).na.fill("", TRANSACTION_COLUMNS)
    return rows.withColumns({"_batch_id": F.lit(batch_id), "_bronze_ingested_at": F.lit(ingested_at)})


RATES_SCHEMA = (
    "api_name string, generated_at string, records array<struct<date: string, base_currency: string, quote: string, "
    "rates: struct<VND: string, USD: string, EUR: string>, source_system: string>>"
)
EVENTS_SCHEMA = (
    "records array<struct<event_id: string, customer_id: string, event_type: string, event_time: string, ingestion_time: string, "
    "device_id: string, country: string, city: string, source_system: string, metadata: map<string, string>>>"
)


def land_exchange_rates(spark: SparkSession, path: str, batch_id: str, ingested_at: str, one_document: bool = True) -> DataFrame:
    """One row for each record of the payload, its rates flat; generated_at, _payload and _row (time and file of the
    payload, place in it) say which of several records of a date is the last.  A file is one
    document, or with ``one_document=False`` a document a line, which Spark can split."""
    raw = spark.read.schema(RATES_SCHEMA).option("multiLine", one_document).json(path)
    r = raw.select(F.col("_metadata.file_path").alias("_payload"), "generated_at", F.posexplode("records").alias("_row", "r"))
    out = r.select(
        "r.date", "r.base_currency", "r.quote", F.col("r.rates.VND").alias("rate_vnd"), F.col("r.rates.USD").alias("rate_usd"),
        F.col("r.rates.EUR").alias("rate_eur"), "r.source_system", "_payload", "generated_at", "_row",
    )
    return stamp(out, path.rsplit("/", 1)[-1], "mock_fx_api", batch_id, ingested_at)


def land_customer_events(spark: SparkSession, path: str, batch_id: str, ingested_at: str, one_document: bool = True) -> DataFrame:
    """One row for each record; the nested metadata becomes JSON text, ``{}`` where it is missing."""
    raw = spark.read.schema(EVENTS_SCHEMA).option("multiLine", one_document).json(path).select(F.explode("records").alias("r"))
    out = raw.select("r.*").withColumn("metadata", F.coalesce(F.to_json("metadata"), F.lit("{}")))
    return stamp(out, path.rsplit("/", 1)[-1], "customer_activity_api", batch_id, ingested_at)


def rows_by_file(spark: SparkSession, path: str) -> DataFrame:
    """file_name, rows of a parquet folder, with no column read."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file_name")).agg(F.count(F.lit(1)).alias("rows"))


def schema_of(spark: SparkSession, path: str) -> DataFrame:
    """name, type of a parquet table's columns, from its footers alone."""
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in spark.read.parquet(path).schema], "name string, type string")


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    """The stripped ids of a table, once each."""
    return df.select(strip(column).alias(column)).distinct()
