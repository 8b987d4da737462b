"""What holds at any size: percentiles without a sort, slices of time, bitmaps, layers kept up batch by batch, tables that
are whole at every moment."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaystone.operators import analytics, dims, distinct, fact, incremental, marts, prefilter, quality, selection, silver, slices
from quaystone.plans import queries
from quaystone.sources import landing, sinks
from quaystone.sources.scratch import Scratch

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def there(spark, path):
    fs, make = sinks._hadoop(spark, path)
    return fs.exists(make(path))


# -- percentiles


def test_one_group_of_all_rows_is_narrowed(spark):
    """A small accuracy makes enclosures of parts of the group; ties of a third of all rows lie in one of them."""
    r = np.random.RandomState(5)
    values = np.r_[r.lognormal(3, 2, 6000), np.full(3000, 20.25), [1e300, -1e300, 0.0]]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").repartition(7)
    at = (0.0, 0.001, 0.3333, 0.5, 0.95, 0.999, 1.0)
    out = selection.percentiles(df, "x", at, accuracy=100)
    assert {x["q"]: x["value"] for x in out.collect()} == pytest.approx({q: float(np.quantile(values, q)) for q in at}, rel=1e-12)
    # no sort of the values and no range partitions: only what was counted inside the enclosures is ordered
    text = plan(out)
    assert "rangepartitioning" not in text and text.count("percentile_approx") >= 1


def test_statistics_are_of_finite_values(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", float("nan")), ("a", float("inf")), ("a", float("-inf")), ("a", None), ("b", float("nan")), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, x double")
    assert {(x["k"], x["q"]): x["value"] for x in analytics.percentiles(df, "x", (0.5, 1.0), ("k",)).collect()} == {("a", 0.5): 2.0, ("a", 1.0): 3.0, (None, 0.5): 5.0, (None, 1.0): 5.0}
    assert {x["k"]: x["median"] for x in analytics.median_by(df, "k", "x").collect()} == {"a": 2.0, "b": None, None: 5.0}
    logs = {x["k"]: (x["n"], x["mean_log"]) for x in analytics.log_amount_statistics(df, "k", "x").collect()}
    assert logs == {"a": (3, round(float(np.log1p([1, 2, 3]).mean()), 6)), None: (1, round(float(np.log1p(5)), 6))}
    assert {x["bin"]: x["n"] for x in analytics.histogram(df, "x", 0.0, 4.0, 4).collect()} == {0: 1, 2: 1, 3: 1, 4: 1, 5: 2}
    cal = {x["type"]: x for x in analytics.calibration(df.withColumns({"type": F.col("k"), "amount": F.col("x"), "is_fraud": F.when(F.col("x") == 2, 1)}), types=("a", "z")).collect()}
    assert cal["a"]["n"] == 3 and cal["a"]["fraud_n"] == 1 and cal["a"]["fraud_sigma"] is None and cal["a"]["cap"] == 2 and cal["a"]["share"] == 0.75
    assert (cal["z"]["n"], cal["z"]["share"], cal["z"]["fraud_rate"], cal["z"]["mu"]) == (0, 0.0, 0.0, None)


# -- slices


def test_as_of_over_many_slices(spark):
    """One key with a third of all rows and long histories, gaps, versions of no length, ties, null keys and times."""
    r = random.Random(9)
    day = lambda d, s=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, seconds=s)
    versions, sk = [], 0
    for key in ("hot", "b", "c"):
        times = sorted(r.sample(range(0, 400), 12))
        for a, b in zip(times, [*times[1:], 9999], strict=True):
            sk += 1
            versions.append((key, sk, day(a), day(b - 3) if sk % 4 == 0 and b - 3 > a else day(b)))
        versions.append((key, -sk, day(times[3]), day(times[3])))
    versions.append((None, 999, day(0), day(9999)))
    rows = [(i, r.choice(["hot", "hot", "b", "c", "none", None]), r.choice([day(r.randrange(-20, 450), r.choice([0, 1, 86_399])), None, *[v[2] for v in versions], *[v[3] for v in versions if v[3] < day(500)]])) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, customer_id string, t timestamp_ntz").repartition(5)
    v = spark.createDataFrame(versions, "customer_id string, sk long, valid_from timestamp_ntz, valid_to timestamp_ntz")
    expected = {i: next((s for c, s, a, b in versions if c == k and k is not None and t is not None and a <= t < b), None) for i, k, t in rows}
    for days in (1, 7, 100):
        out = slices.as_of(df, v, "customer_id", "t", ["sk"], days)
        assert out.columns == ["id", "customer_id", "t", "sk"]
        assert {x["id"]: x["sk"] for x in out.collect()} == expected
    # no join of rows and versions
    assert "Join" not in plan(slices.as_of(df, v, "customer_id", "t", ["sk"]))
    assert slices.as_of(df.limit(0), v, "customer_id", "t", ["sk"]).count() == 0
    assert {x["sk"] for x in slices.as_of(df, v.limit(0), "customer_id", "t", ["sk"]).collect()} == {None}


def test_a_long_history_is_cut(spark):
    """Customers over the bound by weeks, the others whole: the same features, exact distinct counts too."""
    r = random.Random(8)
    base, day = dt.datetime(2024, 1, 1), 86_400
    seconds = sorted([0, day, day, day + 1, 7 * day, 7 * day + 1, 14 * day, 21 * day, *(r.choice([r.randrange(40 * day), r.randrange(40) * day]) for _ in range(400))])
    rows = [(f"t{i:03}", r.choice(["hot", "hot", "c2"]), base + dt.timedelta(seconds=t), r.choice([1.0, 7.25, 100.0]), r.choice(["success", "failed"]), r.randrange(6), r.randrange(9), r.choice(["VN", None, "SG"]), "extra") for i, t in enumerate(seconds)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, event_time timestamp_ntz, amount_vnd double, status string, device_sk long, merchant_sk long, txn_country string, other string")
    shown = lambda out: sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in x) for x in out.select(sorted(out.columns)).collect())
    whole = shown(marts.behaviour(df, exact_distinct=True))
    for heavy in (0, 200):
        assert shown(marts.behaviour(df, exact_distinct=True, heavy=heavy)) == whole
    assert "_slice" in plan(marts.behaviour(df, heavy=0))
    parts = slices.with_context(df, "event_time", 7, 2, ["event_time"]).groupBy("customer_id", "_slice").count().where("customer_id = 'hot'").collect()
    assert len(parts) >= 7 and max(x["count"] for x in parts) < len(rows) / 2


# -- bitmaps and grains


def test_bitmaps_count_distinct_keys(spark):
    r = random.Random(2)
    rows = [(r.choice([20240130, 20240131, 20240201]), r.choice([None, -1, 1, 2, 32_768, 32_769, 10**9, *range(50)])) for _ in range(500)]
    df = spark.createDataFrame(rows, "d int, k long")
    out = {(x["grain"], x["group"]): x["n"] for x in distinct.distinct_by_grain(df, "k", "d", F.floor(F.col("_fine") / 100).cast("int"), "n").collect()}
    count = lambda f: len({k for d, k in rows if k is not None and f(d)})
    assert out == {("fine", str(d)): count(lambda x, d=d: x == d) for d in (20240130, 20240131, 20240201)} | {("coarse", m): count(lambda x, m=m: x // 100 == int(m)) for m in ("202401", "202402")} | {("all", "all"): count(lambda x: True)}
    maps = distinct.bitmaps(df, "k", ["d"])
    assert distinct.counted(distinct.rolled_up(maps, []), [], "n").first()["n"] == count(lambda x: True)
    assert distinct.counted(distinct.bitmaps(df.limit(0), "k", ["d"]), ["d"], "n").count() == 0


def test_grains_are_one_scan(spark):
    s = queries.star(spark, SF).silver
    text = plan(quality.rates_by_grain(s))
    assert text.count("Expand") >= 1
    total = {x["grain"]: x["rows"] for x in quality.rates_by_grain(s).groupBy("grain").agg(F.sum("rows").alias("rows")).collect()}
    assert total["month"] == total["total"] == 1000


# -- batch by batch


def typed_rows(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, source_row_number long")


def test_duplicates_by_batches(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice(["", *[f"t{i}" for i in range(40)]]), i) for i in range(120)]
    r.shuffle(rows)
    state = incremental.DuplicateState(spark, f"file://{tmp_path}/d", 4)
    for i in range(0, 120, 30):
        part = rows[i : i + 30]
        touched = state.add(typed_rows(spark, part), f"b{i}")
        ids = {t for t, _ in part if t}
        groups = {t: [n for x, n in rows[: i + 30] if x == t] for t in ids}
        assert {(x["transaction_id"], x["n"], x["survivor"]) for x in touched.collect()} == {(t, len(n), min(n)) for t, n in groups.items() if len(n) > 1}
        flags = incremental.reflagged(typed_rows(spark, rows[: i + 30]), touched)
        assert {(x["transaction_id"], x["source_row_number"]): x["_dq_duplicate"] for x in flags.collect()} == {(t, n): n != min(g) for t, g in groups.items() if len(g) > 1 for n in g}
        assert state.add(typed_rows(spark, part), f"b{i}").count() == touched.count()  # taken twice, counted once
    expected = silver.duplicate_groups(typed_rows(spark, rows)).collect()
    again = incremental.DuplicateState(spark, f"file://{tmp_path}/d", 4)
    assert sorted(map(tuple, again.table().where("n > 1").collect())) == sorted(map(tuple, expected))
    assert sorted(again.batches()) == ["b0", "b30", "b60", "b90"]


def test_versions_by_delta_touch_their_buckets_alone(spark, tmp_path):
    snap = spark.createDataFrame([(f"c{i}", "n", "e", "p0", None, None, "Rome", "IT", "high", "k") for i in range(30)], ", ".join(f"{c} string" for c in ["customer_id", *dims.CUSTOMER])).withColumns({c: F.col(c).cast("date") for c in ("dob", "signup_date")})
    locations = spark.createDataFrame([("l1", "Hue", "VN"), ("l2", "Rome", "IT")], "location_id string, city string, country string")
    at = lambda d: dt.datetime(2026, 1, d)
    events = [("e1", "c1", at(5), "risk_tier", "low"), ("e2", "c2", at(6), "home_city", "Hue"), ("e3", " c1", at(2), "phone", "p9"), ("e0", "c1", at(5), "home_city", "Hue"), ("e4", "nobody", at(1), "phone", "x")]
    frame = lambda rows: spark.createDataFrame(rows, "event_id string, customer_id string, change_time timestamp_ntz, attribute_name string, old_value string")
    path = f"file://{tmp_path}/v"
    incremental.store_versions(dims.customer_versions(snap, frame(events[:2]), locations), path, 8)
    before = {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("v/bucket=*/*.parquet")}
    touched = incremental.apply_changes(path, snap, frame(events), frame(events[2:]), locations, 8)
    assert [x["customer_id"] for x in touched.collect()] == ["c1"]
    columns = ["customer_id", *dims.CUSTOMER, "valid_from", "valid_to", "is_current"]
    shown = lambda df: sorted(map(str, df.withColumns({c: F.col(c).cast("string") for c in ("valid_from", "valid_to")}).select(columns).collect()))
    assert shown(spark.read.parquet(path)) == shown(dims.customer_versions(snap, frame(events), locations))
    after = {str(p): p.stat().st_mtime_ns for p in tmp_path.glob("v/bucket=*/*.parquet")}
    changed = {p.parent.name for p in tmp_path.glob("v/bucket=*/*.parquet") if before.get(str(p)) != after[str(p)]}
    assert len(changed) == 1 and len(before.keys() - after.keys()) == 1


# -- tables


def failing(spark):
    return spark.range(5).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))


def test_a_failed_job_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_table(spark.range(3), path)
    with pytest.raises(Exception, match="lost"):
        sinks.replace_table(failing(spark), path)
    assert spark.read.parquet(path).count() == 3
    assert [p.name for p in tmp_path.iterdir()] == ["t"]
    sinks.replace_table(spark.read.parquet(path).where("id > 0"), path)  # from itself
    assert sorted(x["id"] for x in spark.read.parquet(path).collect()) == [1, 2]


def test_published_tables_swap_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    first = sinks.publish(spark.range(3), path)
    old = sinks.published(spark, path)
    with pytest.raises(Exception, match="lost"):
        sinks.publish(failing(spark), path)
    assert sinks.current_version(spark, path) == first and sinks.published(spark, path).count() == 3
    sinks.publish(spark.range(10), path)
    assert sinks.published(spark, path).count() == 10 and old.count() == 3
    assert sinks.forget_versions(spark, path) == 2 and sinks.published(spark, path).count() == 10


def test_csv_is_read_by_name(spark, tmp_path):
    columns = landing.CSV_SOURCES["locations"][0]
    (tmp_path / "locations.csv").write_text("timezone,lon,LAT,extra,city,country,location_id\nUTC,106.5,10.5,x, Hue ,VN,l1\n,,,,,,\nUTC,1\nUTC,1,2,3,4,5,6,7\n\"a,\"\"b\",1,2,3,4,5,l3\n")
    rows = landing.land_csv(spark, f"{tmp_path}/locations.csv", "locations", "b", "now")
    assert [tuple(r)[:7] for r in rows.orderBy("location_id").collect()] == [("",) * 7, ("l1", "VN", " Hue ", "", "10.5", "106.5", "UTC"), ("l3", "5", "4", "", "2", "1", 'a,"b')]
    assert rows.count() == 3 and rows.select("country").count() == 3 and rows.first()["_source_system"] == "reference_csv"
    rejects = landing.rejected_csv(spark, f"{tmp_path}/locations.csv", columns)
    assert {(r["_source_file"], r["reason"], r["record"]) for r in rejects.collect()} == {("locations.csv", "missing_fields", "UTC,1"), ("locations.csv", "extra_fields", "UTC,1,2,3,4,5,6,7")}
    assert {(r["fault"], r["column"]) for r in landing.header_faults(spark, f"{tmp_path}/locations.csv", columns).collect()} == {("missing", "region"), ("extra", "extra")}
    with pytest.raises(FileNotFoundError):
        landing.read_csv(spark, f"{tmp_path}/none.csv", columns)


def test_line_breaks_in_fields_and_empty_files(spark, tmp_path):
    (tmp_path / "locations.csv").write_text('location_id,country,city,region,lat,lon,timezone\nl1,VN,"Ha\nNoi",n,1,2,UTC\n')
    columns = landing.CSV_SOURCES["locations"][0]
    assert landing.read_csv(spark, f"{tmp_path}/locations.csv", columns, multi_line=True).first()["city"] == "Ha\nNoi"
    assert landing.read_csv(spark, f"{tmp_path}/locations.csv", columns).count() == 0 and landing.rejected_csv(spark, f"{tmp_path}/locations.csv", columns).count() == 2
    (tmp_path / "empty.csv").write_text("location_id,country,city,region,lat,lon,timezone\n")
    assert landing.read_csv(spark, f"{tmp_path}/empty.csv", columns).count() == 0


def test_months_with_their_own_column_order(spark, tmp_path):
    t = landing.TRANSACTION_COLUMNS
    value = {c: f"{c[:3]}{i}" for i, c in enumerate(t)}
    for month, names in (("2026-01", t), ("2026-02", [*reversed(t)])):
        (tmp_path / f"txn_{month}.csv").write_text(",".join(names) + "\n" + ",".join(value[c] for c in names) + "\n")
    rows = landing.land_transactions(spark, f"{tmp_path}/txn_*.csv", "b", "now").collect()
    assert [r["_partition_month"] for r in sorted(rows, key=lambda r: r["_partition_month"])] == ["2026-01", "2026-02"]
    assert all(r[c] == value[c] for r in rows for c in t)


def test_the_last_rate_is_of_the_last_payload(spark):
    rates = spark.createDataFrame([("2026-01-02", "1", "24000", "26000", "2026-02-01", "b", 0), ("2026-01-02", "1", "25000", "27000", "2026-01-01", "c", 5), ("2026-01-02", "1", "23000", "1", "2026-02-01", "a", 9)], "date string, rate_vnd string, rate_usd string, rate_eur string, generated_at string, _payload string, _row int")
    for df in (rates, rates.orderBy("_row"), rates.repartition(3)):
        assert {r["_rate_currency"]: r["exchange_rate"] for r in silver.daily_rates(df).collect()} == {"VND": 1.0, "USD": 24000.0, "EUR": 26000.0}


def test_an_owner_frees_what_others_made(spark):
    from quaystone.sources.scratch import owned

    with owned() as made:
        n = queries.QUERIES["mart_merchant_risk"](spark, SF).count()
        bases = [x.base for x in made]
        assert n > 0 and bases and all(there(spark, b) for b in bases)
    assert not any(there(spark, b) for b in bases)
    free = Scratch(spark)
    assert free.keep(spark.range(2), "x").count() == 2 and there(spark, free.base)
    free.close()


# -- the star


def test_marts_join_what_they_read(spark):
    with queries.star(spark, SF) as s:
        daily = s.mart_daily
        assert {"dim_account", "dim_merchant", "dim_device", "dim_location"}.isdisjoint(s.__dict__) and there(spark, s.scratch.base)
        assert daily.count() > 0
        assert s.mart_merchant_risk.count() > 0 and "dim_device" not in s.__dict__
        base = s.scratch.base
    assert not there(spark, base)


def test_a_stored_fact_is_read(spark):
    s = queries.star(spark, SF)
    s.fact = spark.createDataFrame([(20240101, 5.0, "success", 0, 7)], "date_key int, amount_vnd double, status string, is_fraud int, customer_sk long")
    assert s.mart_daily.first()["distinct_customers"] == 1 and "scratch" not in s.__dict__


def test_gates_see_a_lost_key(spark):
    s = queries.stored(spark, SF)
    others = {k: getattr(s, f"dim_{k}") for k in ("account", "merchant", "device", "location")}
    others["device"] = others["device"].where("device_sk <> 3")
    found = {g.name: g for g in fact.verify(s.fact, s.clean, others, s.dim_date.where("date_key <> 20240103"), s.dim_customer)}
    assert not found["all_sk_resolve_to_dim"].passed and not found["date_key_in_dim_date"].passed and found["no_null_sk"].passed


def test_reports_say_what_was_found(spark, tmp_path):
    import json

    from quaystone.plans import reports

    s = queries.star(spark, SF).silver
    good = Scratch(spark).keep(s, "silver")
    found = quality.run_checks(good, 1000, dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    summary = reports.quality_report(good, found, f"{tmp_path}")
    stored, text = json.loads((tmp_path / "quality.json").read_text()), (tmp_path / "quality.md").read_text()
    assert stored["verdict"] == summary["verdict"] and len(stored["checks"]) == 22 and stored["silver_run_id"] == "run"
    assert {c["name"]: c["observed"] for c in stored["checks"]}["rowcount_silver_eq_bronze"] == 0
    top = quality.top_error_codes(good).first()
    assert f"| {top['error_code']} | {top['n']} |" in text and text.startswith(f"# Quality: {summary['verdict']}")


# -- filters of large reference tables


def test_a_filter_loses_no_key_and_stays_of_its_size(spark):
    """Null, empty, repeated and long keys; a filter far too small for its keys lets all through, and loses none."""
    keys = spark.createDataFrame([("a",), ("",), (None,), ("a",), ("x" * 70_000,), *[(f"k{i}",) for i in range(500)]], "k string")
    rows = spark.range(60_000).select(F.concat(F.lit("k"), "id").alias("k")).unionByName(keys)
    for bits, most in ((prefilter.BITS, 520), (2**14, 9000), (64, 10**9)):
        kept = prefilter.may_hold(rows, F.col("k"), keys, F.col("k"), bits)
        assert keys.exceptAll(kept).count() == 0  # both sets of repeats are there
        assert kept.where(F.col("k").startswith("k")).distinct().count() <= most
        assert len(prefilter.bloom(keys, F.col("k"), bits).first()["words"]) == bits // 64
    none = prefilter.may_hold(rows, F.col("k"), keys.limit(0), F.col("k"))
    assert none.count() == 0 and prefilter.may_hold(rows.limit(0), F.col("k"), keys, F.col("k")).count() == 0


def test_reference_ids_are_filtered_before_they_are_shuffled(spark):
    rows = spark.createDataFrame([("c1",), ("c2",), ("c2",), ("",), ("gone",)], "customer_id string")
    ids = spark.range(50_000).select(F.concat(F.lit(" c"), "id").alias("customer_id"))
    plain, out = silver.known(rows, ids, "customer_id", "hit"), silver.known(rows, ids, "customer_id", "hit", rows)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect())) == [("", False), ("c1", True), ("c2", True), ("c2", True), ("gone", False)]
    text = out._jdf.queryExecution().optimizedPlan().toString()
    # the filter stands under the ids' distinct, on the scan
    assert text.index("Aggregate") < text.index("getbit") and "scalar-subquery" in text


def test_customers_of_any_size_are_no_task_of_their_own(spark):
    """Every customer, or some, taken as heavy: the mart is the same."""
    with queries.star(spark, SF) as s:
        rows, customers = s.fact_of(marts.CUSTOMER_COLUMNS), s.dim_customer
        read = lambda heavy: {r["customer_id"]: r.asDict() for r in marts.mart_customer_risk(rows, customers, {"txn_1h": 3}, heavy).collect()}
        plain = read(marts.HEAVY)
        assert len(plain) > 10 and marts.UNKNOWN in plain
        for heavy in (0, sorted(r["txn_count"] for r in plain.values())[len(plain) // 2]):
            n = read(heavy)
            assert set(n) == set(plain)
            for k, row in n.items():
                for c, v in row.items():  # sums of another order may round to another cent
                    w = plain[k][c]
                    assert v == w or (isinstance(v, float) and abs(v - w) <= 0.011 + 1e-9 * abs(w)), (k, c, v, w)


# -- the star's shared steps


def test_fact_evaluates_its_rows_once_and_deals_them_by_no_date(spark):
    """Rates go to the rows, slices are asked of the raw rows alone, labels stand beside the duplicates' lookup."""
    text = plan(queries.star(spark, SF).fact)
    assert "hashpartitioning(date_format" not in text
    # the rule flags stand where the rows are filtered: once, not once more for the slices that are asked for
    assert text.count("IN (mobile") == 1


def test_versions_run_over_each_customer_once(spark):
    """A frame to the end of a partition is evaluated anew for each row: the square of a customer's changes."""
    s = queries.star(spark, SF)
    versions = dims.customer_versions(s.dimension("customers"), s.dimension("customer_scd_events"), s.dimension("locations"))
    assert "unboundedfollowing" not in plan(versions).lower().replace(" ", "").replace("$()", "")


def test_numbers_are_stored_with_the_parts(spark):
    ids = spark.createDataFrame([(f"k{i * 7919 % 10007}",) for i in range(5000)] + [(None,)], "key string").repartition(6)
    out = dims.with_surrogate_key(ids, "sk", ["key"], Scratch(spark))
    # a reader sorts the parts' sizes, not their rows
    assert "row_number" not in plan(out)
    got = [r["key"] for r in out.orderBy("sk").collect()]
    assert got == [None, *sorted(k for k in got if k is not None)] and sorted(r["sk"] for r in out.collect()) == list(range(1, 5002))


def test_tasks_of_trailing_features_follow_the_rows(spark, monkeypatch):
    """A task sorts its rows several times over: what it holds must not grow with the input."""
    monkeypatch.setattr(slices, "TASK_ROWS", 50, raising=False)
    monkeypatch.setattr(slices.tasks_for, "__defaults__", (50,)) if hasattr(slices, "tasks_for") else None
    e = spark.read.parquet(f"{SF}/events.parquet").limit(500)
    rows = e.select(
        F.col("event_id").cast("string").alias("transaction_id"), F.col("user_id").cast("string").alias("customer_id"), F.col("ts").alias("event_time"), F.col("value").alias("amount_vnd"), F.lit("success").alias("status"),
        F.lit(1).alias("device_sk"), F.lit(2).alias("merchant_sk"), F.lit("C").alias("txn_country"),
    )
    text = plan(marts.behaviour(rows, heavy=0))
    assert "_slice#" in text and ", 10), REPARTITION_BY_NUM" in text


def odd_star(spark):
    """A star whose rows and changes also lie before the first calendar year, at its very beginning, and at equal times."""
    s = queries.star(spark, SF)
    nth, at = F.col("source_row_number").cast("long"), F.col("transaction_time")
    s.raw["transactions"] = s.raw["transactions"].withColumn("transaction_time", F.when(nth % 7 == 0, "1850-06-01T00:00:00").when(nth % 7 == 1, "1900-01-01T00:00:00").when(nth % 7 == 2, "1899-12-31T23:59:59").otherwise(at))
    e, last = F.col("change_time"), F.substring("event_id", -1, 1)
    early = F.when(last == "1", "1800-01-01T00:00:00").when(last == "3", " 1860-01-01T00:00:00").when(last == "5", "1900-01-01T00:00:00").when(last == "7", "2024-01-10T00:00:00").when(last == "8", "x")
    s.raw["customer_scd_events"] = s.raw["customer_scd_events"].where("customer_id <> 'cus_3'").withColumn("change_time", early.otherwise(e))
    return s


def same_rows(found, wanted, key):
    read = lambda df: {r[key]: r.asDict() for r in df.collect()}
    a, b = read(found), read(wanted)
    assert set(a) == set(b) and len(a) >= 10
    for k, row in a.items():
        for c, v in row.items():  # sums of another order may round to another cent
            w = b[k][c]
            assert v == w or (isinstance(v, float) and abs(v - w) <= 0.011 + 1e-9 * abs(w)), (k, c, v, w)


def test_customer_mart_looks_up_no_versions(spark):
    """The same rows as from the fact with its keys, without a version numbered, stored or looked up."""
    with queries.star(spark, SF) as s:
        text = plan(s.mart_customer_risk({"txn_1h": 3}))
        assert "dim_customer" not in s.__dict__ and "_slice" not in text
    with odd_star(spark) as natural, odd_star(spark) as keyed:
        assert keyed.fact.where("customer_sk = -1 and event_time < '1900-01-01'").count() > 0 < keyed.fact.where("customer_sk > 0 and event_time < '1900-01-01'").count()
        same_rows(natural.mart_customer_risk({"txn_1h": 3}), keyed.mart_customer_risk({"txn_1h": 3}), "customer_id")


@pytest.mark.parametrize("heavy", [marts.HEAVY, 20])
def test_marts_look_up_only_what_they_show(spark, monkeypatch, heavy):
    """Versions by their starts, home countries by the moves: the same rows as from the fact with its keys, whether no
    customer's history is cut into slices or most are."""
    monkeypatch.setattr(marts, "HEAVY", heavy)
    with odd_star(spark) as natural, odd_star(spark) as keyed:
        assert keyed.fact.count() > 0
        same_rows(natural.mart_merchant_risk, keyed.mart_merchant_risk, "merchant_id")
        features = natural.mart_fraud_features(exact_distinct=True)
        assert "dim_customer" not in natural.__dict__
        same_rows(features, keyed.mart_fraud_features(exact_distinct=True), "transaction_id")


def test_wide_rows_are_not_sorted_for_their_labels(spark):
    with queries.star(spark, SF) as s:
        assert "SortMergeJoin" not in plan(fact.with_labels(s.clean.select("transaction_id"), s.raw["fraud_labels"]))


def lossy_star(spark):
    """The same, and some devices and merchants of the rows are in no table."""
    s = odd_star(spark)
    for name in ("device", "merchant"):
        s.raw[f"{name}s"] = s.raw[f"{name}s"].where(~F.col(f"{name}_id").rlike("[1-4]$"))
    return s


@pytest.mark.parametrize("heavy", [marts.HEAVY, 20])
def test_distinct_counts_need_ids_and_times_alone(spark, monkeypatch, heavy):
    """The feature mart's counts without its labels, amounts, places, home countries and numbered dimensions: unknown devices
    and merchants are one each, as by their keys."""
    from quaystone.sources.scratch import owned

    monkeypatch.setattr(marts.distinct_counts, "__defaults__", (heavy,)) if hasattr(marts, "distinct_counts") else None
    natural = lossy_star(spark)
    with lossy_star(spark) as keyed, owned() as made:
        keyed.fact = Scratch(spark).keep(keyed.fact, "fact")
        assert keyed.fact.where("device_sk = -1").count() > 0 < keyed.fact.where("merchant_sk = -1").count()
        kept = len(made)
        monkeypatch.setattr(queries, "star", lambda *_: natural)
        found = queries.exact_distinct_window(spark, SF)
        same_rows(found, keyed.mart_fraud_features(exact_distinct=True).select(found.columns), "transaction_id")
        fs, make = sinks._hadoop(spark, made[0].base)
        stored = sorted(sorted(spark.read.parquet(str(f.getPath())).columns) for x in made[kept:] for f in fs.listStatus(make(x.base)))
        assert stored == [["customer_id", "device_id", "event_time", "merchant_id", "transaction_id"], ["device_id"], ["merchant_id"]]


def test_rows_of_no_merchant_are_several_tasks(spark):
    """Two thirds of the rows have one id: Spark cuts them up, however many merchants there are."""
    sizes = {"autoBroadcastJoinThreshold": "-1", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(f"spark.sql.{k}", None) for k in sizes}
    with queries.star(spark, SF) as s:
        try:
            for k, v in sizes.items():
                spark.conf.set(f"spark.sql.{k}", v)
            rows = spark.range(0, 60_000, 1, 8).select("id", F.when(F.col("id") % 3 > 0, "").otherwise(F.concat(F.lit("mer_"), F.col("id") % 200)).alias("merchant_id"))
            known = {r["merchant_id"] for r in s.raw["merchants"].select("merchant_id").collect()}
            out = fact.with_known_id(rows, s._ids_of("merchant"), "merchant")
            assert all(m == (f"mer_{i % 200}" if i % 3 == 0 and f"mer_{i % 200}" in known else None) for i, m in out.collect())
            assert "skew=true" in plan(out)
        finally:
            for k, v in before.items():
                spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def test_rates_are_joined_only_for_amounts(spark):
    with queries.star(spark, SF) as s:
        assert "_rate_date" in plan(s.clean.select("amount_vnd")) and "_rate_date" not in plan(s.clean.select("transaction_id", "amount_original"))
