"""Landing, typed layer, quarantine, dimensions, fact, marts on hand-made rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quaystone.functions import exprs
from quaystone.operators import analytics, checks, dims, fact, marts, quality, quarantine, silver
from quaystone.sources import landing, sinks

T = landing.TRANSACTION_COLUMNS
GOOD = {
    "transaction_id": "t1", "customer_id": "c1", "account_id": "a1", "merchant_id": "m1", "device_id": "d1", "card_id": "", "amount": "10", "currency": "VND", "transaction_type": "payment", "channel": "mobile",
    "transaction_time": "2026-01-02T03:04:05", "country": "VN", "city": "Hanoi", "status": "success", "location_id": "l1", "ingestion_time": "2026-01-02T03:05:05", "source_system": "s", "batch_id": "b", "file_name": "f", "source_row_number": "0",
}


def bronze(spark, *changes):
    rows = [{**GOOD, "transaction_id": f"t{i}", "source_row_number": str(i)} | c for i, c in enumerate(changes)]
    return spark.createDataFrame([tuple(r[c] for c in T) for r in rows], ", ".join(f"{c} string" for c in T))


def to_silver(spark, *changes):
    one = lambda c, *v: spark.createDataFrame([(x,) for x in v], f"{c} string")
    rates = spark.createDataFrame([("2026-01-02", "1", "24000", "26000", 0), ("2026-01-02", "1", "25000", "27000", 1)], "date string, rate_vnd string, rate_usd string, rate_eur string, _row int")
    return silver.silver_transactions(bronze(spark, *changes), customers=one("customer_id", "c1", " c2 "), accounts=one("account_id", "a1"), merchants=one("merchant_id", "m1"), locations=one("location_id", "l1"), rates=rates, run_id="r")


CASES = [
    ({}, "", ""),
    ({"amount": "NaN"}, "quarantine_invalid_amount", "invalid_amount"),
    ({"amount": "amount_unknown"}, "quarantine_invalid_amount", "invalid_amount"),
    ({"amount": "-5.00"}, "quarantine_invalid_amount", "invalid_amount"),
    ({"amount": "0"}, "quarantine_invalid_amount", "invalid_amount"),
    ({"amount": "inf"}, "quarantine_invalid_amount", "invalid_amount"),
    ({"amount": "1.0d"}, "quarantine_invalid_amount", "invalid_amount"),
    ({"amount": None}, "quarantine_invalid_amount", "invalid_amount"),
    ({"transaction_time": "2099-12-31T23:59:59"}, "quarantine_invalid_timestamp", "invalid_timestamp"),
    ({"transaction_time": "not_a_timestamp"}, "quarantine_invalid_timestamp", "invalid_timestamp"),
    ({"transaction_time": "2026-02-30T00:00:00"}, "quarantine_invalid_timestamp", "invalid_timestamp"),
    ({"transaction_time": "2026-01-02"}, "quarantine_invalid_timestamp", "invalid_timestamp"),
    ({"transaction_id": " "}, "quarantine_bad_records", "null_transaction_id"),
    ({"currency": "XXX"}, "quarantine_bad_records", "invalid_currency"),
    ({"channel": "foo"}, "quarantine_bad_records", "invalid_channel"),
    ({"location_id": "loc_bad_record"}, "quarantine_bad_records", "invalid_location"),
    ({"status": None, "transaction_type": "x"}, "quarantine_bad_records", "invalid_type,invalid_status"),
    ({"currency": " vnd ", "channel": "Mobile"}, "", ""),
    ({"customer_id": "cus_999999"}, "", "fk_customer_orphan"),
    ({"customer_id": "\tc2", "merchant_id": ""}, "", ""),
    ({"account_id": "x", "merchant_id": "x"}, "", "fk_account_orphan,fk_merchant_orphan"),
    ({"amount": "NaN", "transaction_time": ""}, "quarantine_invalid_timestamp", "invalid_amount,invalid_timestamp"),
]


def test_flags_and_buckets(spark):
    rows = {r["source_row_number"]: r for r in to_silver(spark, *[c for c, _, _ in CASES]).collect()}
    for i, (_, bucket, codes) in enumerate(CASES):
        assert (rows[i]["_dq_bucket"], rows[i]["_dq_errors"], rows[i]["_is_valid"]) == (bucket, codes, bucket == ""), CASES[i]
    assert list(rows[0].asDict()) == silver.COLUMNS and len(silver.COLUMNS) == 41
    assert rows[0]["ingestion_lag_seconds"] == 60 and rows[0]["amount_vnd"] == 10


def test_last_rate_of_a_day_counts(spark):
    row = to_silver(spark, {"currency": "usd", "amount": "2"}, {"currency": "EUR", "transaction_time": "2026-01-03T00:00:00"}).collect()
    by = {r["source_row_number"]: r for r in row}
    assert by[0]["amount_vnd"] == 50_000 and by[1]["exchange_rate"] is None


def test_duplicates(spark):
    rows = to_silver(
        spark, {"transaction_id": "a", "source_row_number": "9"}, {"transaction_id": "a ", "source_row_number": "5"}, {"transaction_id": "", "source_row_number": "1"}, {"transaction_id": "", "source_row_number": "2"},
        {"transaction_id": "b", "source_row_number": "3", "amount": "NaN"}, {"transaction_id": "b", "source_row_number": "4", "amount": "x"},
    )
    by = {r["source_row_number"]: (r["_is_duplicate_survivor"], r["_dq_bucket"], r["_dq_errors"]) for r in rows.collect()}
    assert by[5] == (True, "", "") and by[9] == (False, "quarantine_duplicate_transactions", "duplicate_transaction_id")
    assert by[1][1] == by[2][1] == "quarantine_bad_records"
    assert by[3] == (True, "quarantine_invalid_amount", "invalid_amount") and by[4][1:] == ("quarantine_duplicate_transactions", "duplicate_transaction_id,invalid_amount")


def test_quarantine_gates_and_checks(spark, tmp_path):
    rows = to_silver(spark, *[c for c, _, _ in CASES]).persist()
    good, bad = quarantine.clean(rows), quarantine.quarantine(rows, "q", "now")
    assert all(g.passed for g in quarantine.verify(rows, good, bad))
    assert len(good.columns) == 28 and bad.columns[:4] == ["quarantine_bucket", "quarantine_reason", "quarantined_at", "quarantine_run_id"]
    broken = {g.name: g.passed for g in quarantine.verify(rows, good.limit(1), bad)}
    assert not broken["conservation_sum_eq_silver"] and not broken["clean_eq_valid"]
    for name, part in quarantine.buckets(bad).items():
        sinks.replace_table(part, f"{tmp_path}/{name}")
        assert spark.read.parquet(f"{tmp_path}/{name}").columns == bad.columns  # empty buckets keep their schema
    manifest = spark.createDataFrame([("1", "invalid_amount"), ("8", "invalid_timestamp"), ("0", "invalid_amount")], "row_index string, error_type string")
    found = quality.run_checks(rows, len(CASES), dt.date(2026, 1, 1), dt.date(2026, 1, 31), manifest)
    assert len(found) == 22 and checks.verdict(found) == "FAIL"
    by = {c.name: c for c in found}
    assert by["manifest_coverage"].observed == 0.5 and by["rowcount_silver_eq_bronze"].passed and not by["rate_invalid_amount"].passed
    clean_only = [c for c in quality.run_checks(to_silver(spark, {}, {}), 2, dt.date(2026, 1, 1), dt.date(2026, 1, 31))]
    assert checks.verdict(clean_only) == "PASS" and checks.as_table(spark, clean_only).count() == 22
    assert checks.verdict([checks.Check("x", "g", "WARNING", 1, 0, "<=")]) == "PASS_WITH_WARNINGS" and checks.verdict([checks.Check("x", "g", "WARNING", 1, 0, "<=")], strict=True) == "FAIL"
    rows.unpersist()


def test_lenient_casts(spark):
    df = spark.createDataFrame([(" 1e3 ",), ("1_000",), ("",), (None,), ("-inf",), (".5",)], "x string")
    found = [r[0] for r in df.select(exprs.lenient_double(F.col("x"))).collect()]
    assert found == [1000.0, None, None, None, float("-inf"), 0.5]
    assert [r[0] for r in spark.createDataFrame([("TRUE ",), ("1",), (None,)], "x string").select(exprs.is_true(F.col("x"))).collect()] == [True, False, False]


SNAP = "customer_id full_name email phone dob signup_date home_city home_country risk_tier kyc_level".split()


def versions(spark, events, cities=(("Hue", "VN"), ("Rome", "IT"))):
    snap = spark.createDataFrame([(c, "n", "e", "p0", None, None, "Rome", "IT", "high", "k") for c in ("c0", "c1", "c2", "c3")], ", ".join(f"{c} string" for c in SNAP))
    ev = spark.createDataFrame([(f"e{i}", c, dt.datetime.fromisoformat(t), a, o) for i, (c, t, a, o) in enumerate(events)], "event_id string, customer_id string, change_time timestamp_ntz, attribute_name string, old_value string")
    loc = spark.createDataFrame([(f"l{i}", c, k) for i, (c, k) in enumerate(cities)], "location_id string, city string, country string")
    return dims.dim_customer(snap, ev, loc)


EVENTS = [
    ("c1", "2026-01-10T00:00:00", "risk_tier", "low"),
    ("c2", "2026-01-10T00:00:00", "risk_tier", "low"),
    ("c2", "2026-02-10T00:00:00", "risk_tier", "medium"),
    ("c3", "2026-01-05T00:00:00", "home_city", "Hue"),
    ("c3", "2026-03-05T00:00:00", "home_city", "Atlantis"),
    ("nobody", "2026-03-05T00:00:00", "phone", "x"),
]


def test_scd2_versions(spark):
    rows = versions(spark, EVENTS).collect()
    of = lambda c: [(str(r["valid_from"])[:10], str(r["valid_to"])[:10], r["risk_tier"], r["home_city"], r["home_country"], r["is_current"]) for r in sorted(rows, key=lambda r: r["valid_from"]) if r["customer_id"] == c]
    assert of("c0") == [("1900-01-01", "9999-12-31", "high", "Rome", "IT", True)]
    assert of("c1") == [("1900-01-01", "2026-01-10", "low", "Rome", "IT", False), ("2026-01-10", "9999-12-31", "high", "Rome", "IT", True)]
    assert [x[2] for x in of("c2")] == ["low", "medium", "high"]
    # the unknown city keeps the later country; the older version has its own
    assert [x[3:5] for x in of("c3")] == [("Hue", "VN"), ("Atlantis", "IT"), ("Rome", "IT")]
    assert of("nobody") == []
    assert sorted(r["customer_sk"] for r in rows) == [-1, *range(1, 10)]


def test_as_of_boundary_and_unknown(spark):
    d = versions(spark, EVENTS)
    sk = {(r["customer_id"], str(r["valid_from"])[:10]): r["customer_sk"] for r in d.collect()}
    rows = spark.createDataFrame([("c1", dt.datetime(2026, 1, 10)), ("c1", dt.datetime(2026, 1, 9, 23, 59, 59)), ("c9", dt.datetime(2026, 1, 1))], "customer_id string, event_time timestamp_ntz")
    found = {(r["customer_id"], r["event_time"].day): r["customer_sk"] for r in fact.with_customer_version(rows, d).collect()}
    assert found == {("c1", 10): sk["c1", "2026-01-10"], ("c1", 9): sk["c1", "1900-01-01"], ("c9", 1): -1}


def test_surrogate_keys_are_global(spark):
    df = spark.range(1000).select(F.xxhash64("id").cast("string").alias("k"), "id").repartition(7)
    rows = dims.with_surrogate_key(df, "sk", ["k"]).collect()
    assert [r["sk"] for r in sorted(rows, key=lambda r: r["k"])] == list(range(1, 1001))
    one = dims.one_version(spark.createDataFrame([("l2", "A"), ("l1", "B"), ("l2", "A")], "location_id string, country string").withColumns({c: F.lit("") for c in ("city", "region", "lat", "lon", "timezone")}), "location").collect()
    assert sorted((r["location_sk"], r["location_id"], r["country"]) for r in one) == [(-1, "UNKNOWN", None), (1, "l1", "B"), (2, "l2", "A")]


def test_labels_prefer_fraud(spark):
    labels = spark.createDataFrame([("a", "0", ""), ("a", "1", "card_testing"), ("b", "x", ""), ("c", "0", "")], "transaction_id string, is_fraud string, fraud_pattern string")
    rows = {r["transaction_id"]: (r["is_fraud"], r["fraud_pattern"]) for r in fact.with_labels(spark.createDataFrame([("a",), ("b",), ("z",)], "transaction_id string"), labels).collect()}
    assert rows == {"a": (1, "card_testing"), "b": (0, None), "z": (0, None)}


FACT = "transaction_id string, customer_sk long, merchant_sk long, device_sk long, location_sk long, date_key int, event_time timestamp_ntz, amount_vnd double, status string, is_fraud int, fraud_pattern string"


def facts(spark, rows):
    return spark.createDataFrame([(f"t{i}", c, m, d, loc, int(t[:10].replace("-", "")), dt.datetime.fromisoformat(t), float(a), s, int(f is not None), f) for i, (c, m, d, loc, t, a, s, f) in enumerate(rows)], FACT)


def test_fraud_features(spark):
    cust = spark.createDataFrame([(1, "c1", "VN", True), (2, "c1", None, False), (3, "c2", "VN", True), (-1, "UNKNOWN", None, True)], "customer_sk long, customer_id string, home_country string, is_current boolean")
    loc = spark.createDataFrame([(1, "VN"), (2, "SG"), (-1, None)], "location_sk long, country string")
    f = facts(spark, [
        (1, 7, 1, 1, "2026-01-01T00:00:00", 10, "success", None), (2, 7, 1, 2, "2026-01-01T20:00:00", 20, "failed", "x"), (1, 8, 2, -1, "2026-01-02T06:00:00", 30, "success", None),
        (3, 7, 1, 1, "2026-01-01T12:00:00", 5e7, "success", None), (3, 7, 1, 1, "2026-01-01T12:00:00", 5, "success", None), (-1, 7, 1, 1, "2026-01-01T12:00:00", 5, "success", None),
    ])
    rows = {r["transaction_id"]: r for r in marts.mart_fraud_features(f, cust, loc, exact_distinct=True).collect()}
    assert set(rows) == {"t0", "t1", "t2", "t3", "t4"}
    assert rows["t2"]["unique_merchants_24h"] == 1 and rows["t2"]["unique_merchants_24h_exact"] == 2  # the gap rule counts less
    assert rows["t3"]["txn_count_1h"] == rows["t4"]["txn_count_1h"] == 2  # rows of the same second see each other
    assert [rows[t]["is_new_device"] for t in ("t0", "t1", "t2", "t3", "t4")] == [1, 0, 1, 1, 0]
    assert rows["t0"]["amount_zscore"] == 0 and rows["t3"]["high_amount_flag"] == 1 and rows["t0"]["night_transaction_flag"] == 1
    assert [rows[t]["cross_country_flag"] for t in ("t0", "t1", "t2")] == [0, 1, 1]
    risk = {r["customer_id"]: r for r in marts.mart_customer_risk(f, cust.withColumns({"risk_tier": F.lit("r"), "home_city": F.lit("h")})).collect()}
    assert set(risk) == {"c1", "c2", "UNKNOWN"} and risk["UNKNOWN"]["max_amount_zscore"] is None and risk["c1"]["watchlist_flag"] and not risk["UNKNOWN"]["watchlist_flag"]
    days = dims.calendar(spark, dt.date(2026, 1, 1), dt.date(2026, 1, 31))
    daily = {r["date_key"]: r for r in marts.mart_daily(f, days).collect()}
    assert daily[20260102]["running_total_vnd"] == 50_000_070.0 and daily[20260101]["is_payday"]
    merchant = spark.createDataFrame([(7, "m7", "n", "g", "c", "VN", 0.5), (8, "m8", "n", "g", "c", "VN", 0.5), (-1, "UNKNOWN", None, None, None, None, None)], "merchant_sk long, merchant_id string, merchant_name string, category string, city string, country string, risk_score double")
    by = {r["merchant_id"]: (r["txn_count"], r["failed_rate"], r["distinct_customers"]) for r in marts.mart_merchant_risk(f, merchant).collect()}
    assert by == {"m7": (5, 0.2, 4), "m8": (1, 0.0, 1)}


def test_adhoc(spark):
    b = bronze(spark, {"amount": "NaN"}, {"amount": "-1"}, {"transaction_id": ""}, {"transaction_time": "x"}, {"amount": "5", "channel": "web"})
    assert tuple(analytics.quality_peek(b).first()) == (5, 1, 1, 1)
    tx = analytics.defensive(b)
    assert {r["channel"]: r["pct_of_txn"] for r in analytics.channel_share(tx).collect()} == {"mobile": 66.67, "web": 33.33}
    assert [tuple(r)[1:] for r in analytics.daily_running_total(tx).collect()] == [(2, 15.0, 15.0)]
    assert analytics.amount_outliers(tx).count() == 0


def test_landing(spark, tmp_path):
    (tmp_path / "txn_2026-01.csv").write_text(",".join(T) + "\n" + ",".join(GOOD[c] if c != "city" else '" x, ""y"" "' for c in T) + "\n")
    (tmp_path / "txn_2026-02.csv").write_text(",".join(T) + "\n" + ",".join(GOOD[c] for c in T) + "\n")
    rows = landing.land_transactions(spark, f"{tmp_path}/txn_*.csv", "b1", "now").collect()
    assert {r["city"] for r in rows} == {"Hanoi", ' x, "y" '}
    assert sorted(r["_partition_month"] for r in rows) == ["2026-01", "2026-02"] and all(r["card_id"] == "" for r in rows)
    assert {r["_source_file"] for r in rows} == {"txn_2026-01.csv", "txn_2026-02.csv"}
    (tmp_path / "fx.json").write_text(json.dumps({"api_name": "a", "records": [{"date": "2026-01-01", "base_currency": "VND", "quote": "q", "rates": {"VND": 1.0, "USD": 25.5, "EUR": 3}, "source_system": "s"}]}, indent=1))
    r = landing.land_exchange_rates(spark, f"{tmp_path}/fx.json", "b", "now").first()
    assert (r["rate_vnd"], r["rate_usd"], r["_source_file"]) == ("1.0", "25.5", "fx.json")
    (tmp_path / "ev.json").write_text(json.dumps({"records": [{"event_id": "e1", "metadata": {"auth": "ok"}}, {"event_id": "e2"}]}))
    assert [x["metadata"] for x in landing.land_customer_events(spark, f"{tmp_path}/ev.json", "b", "now").orderBy("event_id").collect()] == ['{"auth":"ok"}', "{}"]


def test_sinks(spark, tmp_path):
    found = sinks.statements("-- a; b\nCREATE TEMP VIEW v AS SELECT ';' AS x;\n-- name: Q1 - one\nSELECT * FROM v; ")
    assert [n for n, _ in found] == ["", "Q1 - one"] and len(found) == 2
    out = sinks.run_script(spark, "CREATE OR REPLACE TEMP VIEW v AS SELECT ';' AS x;\n-- name: Q1\nSELECT * FROM v;")
    assert out["Q1"].first()["x"] == ";"
    sinks.write_markdown(tmp_path / "r.md", "T", {"one": spark.createDataFrame([(1, "a|b"), (None, "c")], "n int, t string")})
    assert "| 1 | a\\|b |" in (tmp_path / "r.md").read_text() and "|  | c |" in (tmp_path / "r.md").read_text()
    sinks.write_json(tmp_path / "s.json", {"at": dt.date(2026, 1, 1)})
    assert json.loads((tmp_path / "s.json").read_text()) == {"at": "2026-01-01"}
    df = spark.createDataFrame([("a", 1), ("b", 2)], "p string, x int")
    sinks.replace_partitions(df, f"{tmp_path}/t", "p")
    sinks.replace_partitions(df.where("p = 'a'").withColumn("x", F.lit(9)), f"{tmp_path}/t", "p")
    assert sorted((r["p"], r["x"]) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [("a", 9), ("b", 2)]
    assert sum(r["rows"] for r in landing.rows_by_file(spark, f"{tmp_path}/t").collect()) == 2


def test_constraints(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "z")], "k int, f string")
    found = fact.broken_constraints(df, unique=("k",), not_null=("f",), foreign={"f": (spark.createDataFrame([("a",)], "id string"), "id")}).collect()
    assert {r["constraint"]: r["rows"] for r in found} == {"unique(k)": 2, "not_null(f)": 1, "foreign(f)": 1}


@pytest.mark.parametrize("empty", ["silver", "marts"])
def test_empty_tables(spark, empty):
    if empty == "silver":
        rows = to_silver(spark, {}).limit(0)
        assert quality.flag_rates(rows).count() == 13 and quarantine.clean(rows).count() == 0 and quality.top_error_codes(rows).count() == 0
    else:
        f = facts(spark, [(1, 7, 1, 1, "2026-01-01T00:00:00", 10, "success", None)]).limit(0)
        assert marts.mart_daily(f, dims.calendar(spark)).count() == 0 and dims.calendar(spark).count() == 243


def test_percentiles_of_groups_with_ties_and_nulls(spark):
    import random

    import numpy as np

    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([1.0, 1.0, 2.5, r.random() * 100])) for _ in range(400)] + [("a", None), ("only null", None), ("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    by = {}
    for k, x in rows:
        if x is not None:
            by.setdefault(k, []).append(x)
    at = (0.0, 0.25, 0.5, 0.999, 1.0)
    found = {(x["k"], x["q"]): x["value"] for x in analytics.percentiles(df, "x", at, ("k",)).collect()}
    assert found.keys() == {(k, q) for k in by for q in at}
    assert all(abs(v - np.quantile(by[k], q)) < 1e-9 for (k, q), v in found.items())
    assert {x["k"]: x["median"] for x in analytics.median_by(df, "k", "x").collect()}["only null"] is None
    assert analytics.quantiles(df.limit(0), "x").count() == 0


def test_exact_distinct_counts_and_busiest_hour(spark):
    import random

    r = random.Random(8)
    base, day = dt.datetime(2024, 1, 1), 86_400
    seconds = sorted([0, day, day, day + 1, 7 * day, 7 * day + 1, *(r.choice([r.randrange(9 * day), r.randrange(9) * day]) for _ in range(120))])
    rows = [(f"t{i:03}", r.choice(["c1", "c2"]), base + dt.timedelta(seconds=t), 1.0, "success", r.randrange(3), r.randrange(4), "VN") for i, t in enumerate(seconds)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, event_time timestamp_ntz, amount_vnd double, status string, device_sk long, merchant_sk long, txn_country string")
    found = {x["transaction_id"]: x for x in marts.behaviour(df, exact_distinct=True).collect()}
    near = lambda row, span: [o for o in rows if o[1] == row[1] and 0 <= (row[2] - o[2]).total_seconds() <= span]
    for row in rows:
        assert found[row[0]]["unique_merchants_24h_exact"] == len({o[6] for o in near(row, day)})
        assert found[row[0]]["unique_devices_7d_exact"] == len({o[5] for o in near(row, 7 * day)})
    times = [base + dt.timedelta(seconds=r.randrange(40_000)) for _ in range(300)]
    times += [times[0] + dt.timedelta(hours=1)] * 3
    expected = max(sum(0 <= (t - o).total_seconds() <= 3600 for o in times) for t in times)
    assert marts.busiest_hour(spark.createDataFrame([(t,) for t in times], "event_time timestamp_ntz")).first()[0] == expected
    assert marts.busiest_hour(df.limit(0)).first()[0] is None


def test_keep_first(spark):
    rows = [("k", "b", "2"), ("k", "a", "3"), ("k", "c", "2"), ("m", "z", None), ("m", "y", "9")]
    df = spark.createDataFrame(rows, "k string, v string, source_row_number string")
    assert sorted(map(tuple, dims.keep_first(df, "k", ["k", "v"]).collect())) == [("k", "b"), ("m", "y")]
    assert sorted(map(tuple, dims.keep_first(df.drop("source_row_number"), "k", ["k", "v"]).collect())) == [("k", "a"), ("m", "y")]


def test_scratch_is_owned(spark):
    from types import SimpleNamespace

    from quaystone.sources.scratch import Scratch, scratch_dir

    with Scratch(spark) as s:
        assert s.keep(spark.range(3), "x").count() == 3
        path = f"{s.base}/x"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    assert not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError):
        scratch_dir(cluster)


def test_keys_are_enforced(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (2, None)], "id int, k string")
    keys = spark.createDataFrame([("a",)], "k string")
    assert fact.enforce(t, not_null=("id",)) is t
    with pytest.raises(fact.ConstraintError, match="unique.*foreign"):
        fact.enforce(t, unique=("id",), not_null=("id",), foreign={"k": (keys, "k")})


def test_largest_remainder():
    from quaystone.operators.synth import FRAUD_MIX, largest_remainder

    for n in (0, 1, 7, 10, 105, 14_000):
        parts = largest_remainder(n, FRAUD_MIX)
        assert sum(parts.values()) == n and all(abs(parts[k] - n * v) < 1 for k, v in FRAUD_MIX.items())
