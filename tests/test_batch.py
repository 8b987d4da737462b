"""Generator, batch and streams end to end."""

import datetime as dt

from pyspark.sql import functions as F

from quaystone.operators import quality, synth
from quaystone.plans import reports, star
from quaystone.sources.landing import TRANSACTION_COLUMNS
from quaystone.streaming import arrivals


def test_generated_data_through_all_layers(spark, tmp_path):
    cfg = synth.configure(n_customers=400, n_transactions=8000, n_merchants=50, date_end=dt.date(2026, 1, 20))
    synth.write_raw(spark, cfg, f"{tmp_path}/raw")
    out = star.run_batch(spark, f"{tmp_path}/raw", f"{tmp_path}/lake", start=cfg.date_start, end=cfg.date_end)
    failed = [(layer, g) for layer, gates in out["gates"].items() for g, (ok, _) in gates.items() if not ok]
    assert not failed and sum(len(g) for g in out["gates"].values()) == 7 + 10 + 14
    assert out["checks"]["manifest_coverage"][0] > 0.9
    assert out["rows"]["fact"] + sum(out["buckets"].values()) == 8000
    assert {s["pattern"] for s in out["separation"]} == {"legit", *synth.FRAUD_MIX}
    by = {s["pattern"]: s for s in out["separation"]}
    assert by["night_high_amount"]["avg_night"] > 0.9 and by["new_device_location"]["avg_cross_country"] > 0.9
    bronze = spark.read.parquet(f"{tmp_path}/lake/bronze/transactions")
    reports.analytics_report(bronze, spark.read.parquet(f"{tmp_path}/lake/bronze/merchants"), f"{tmp_path}/r")
    silver = spark.read.parquet(f"{tmp_path}/lake/silver/transactions")
    summary = reports.quality_report(silver, quality.run_checks(silver, 8000, cfg.date_start, cfg.date_end), f"{tmp_path}/r")
    reports.exploration_report(silver, f"{tmp_path}/r")
    assert summary["verdict"] != "FAIL" and {p.name for p in (tmp_path / "r").iterdir()} >= {"analytics.md", "quality.md", "quality.json", "exploration.md"}
    assert {t for c, t in bronze.dtypes if c in TRANSACTION_COLUMNS} == {"string"}


def test_generator_invariants(spark):
    cfg = synth.configure(n_customers=500, n_transactions=20_000, n_merchants=40)
    raw = synth.raw_transactions(spark, cfg).persist()
    assert raw.where("pattern is not null").count() == round(20_000 * cfg.fraud_rate) and raw.where("pattern is not null and _error is not null").count() == 0
    again = synth.raw_transactions(spark, cfg).repartition(3)
    assert raw.exceptAll(again).count() == 0
    checked = {r["check"]: r["n"] for r in synth.validate_raw(raw.select(*TRANSACTION_COLUMNS), synth.error_manifest(raw), synth.fraud_labels(raw), synth.customers(spark, cfg), synth.accounts(spark, cfg), synth.merchants(spark, cfg)).collect()}
    assert checked == {"rows": 20_000, "unexpected_orphans": 0, "unexpected_faults": 0, "unexpected_duplicates": 0, "fraud_labels": 140}
    changes = synth.customer_changes(spark, cfg)
    chained = changes.alias("a").join(changes.alias("b"), (F.col("a.id") == F.col("b.id")) & (F.col("a.k") == F.col("b.k") - 1))
    assert chained.where("a.new_value <> b.old_value or a.change_time > b.change_time").count() == 0
    last = changes.groupBy("customer_id").agg(F.max_by(F.struct("attribute_name", "new_value"), "k").alias("c"))
    snap = synth.customers(spark, cfg).join(last, "customer_id").where("c.attribute_name = 'risk_tier' and c.new_value <> risk_tier")
    assert snap.count() == 0
    heavy = raw.groupBy("customer_id").count().agg(F.max("count")).first()[0]
    assert heavy > 5 * 20_000 / 500
    raw.unpersist()


def test_streams(spark, tmp_path):
    cfg = synth.configure(n_customers=50, n_transactions=3000, n_merchants=10, date_end=dt.date(2025, 12, 20))
    raw = synth.raw_transactions(spark, cfg).select(*TRANSACTION_COLUMNS)
    raw.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = arrivals.flagged(arrivals.read_raw(spark, f"{tmp_path}/in", raw.schema)).where("not _dq_invalid_timestamp")
    arrivals.write(arrivals.activity(stream, lateness="1 hour"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    batch = arrivals.flagged(raw).where("not _dq_invalid_timestamp and amount_original is not null and not isnan(amount_original)")
    found = spark.read.parquet(f"{tmp_path}/out")
    whole = batch.groupBy(F.window(F.col("event_time").cast("timestamp"), "1 hour").alias("w"), "channel").count().select(F.col("w.start").alias("start"), "channel", "count")
    joined = found.join(whole, ["start", "channel"])
    assert found.count() > 0 and joined.count() == found.count() and joined.where("txn_count <> count").count() == 0
    once = arrivals.without_repeats(stream.where("transaction_id <> ''"))
    arrivals.write(once.select("transaction_id"), f"{tmp_path}/ids", f"{tmp_path}/check2").awaitTermination()
    ids = spark.read.parquet(f"{tmp_path}/ids")
    assert ids.count() == ids.distinct().count() == batch.sparkSession.read.parquet(f"{tmp_path}/ids").count()
    quiet = arrivals.bursts(arrivals.flagged(raw).where("not _dq_invalid_timestamp"), "30 minutes", 2)
    assert quiet.where("txn_count < 2").count() == 0
