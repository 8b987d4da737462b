"""Registered queries against DuckDB on the smallest tables, and the package without its optional part."""

import datetime
import decimal
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if x != x else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return "~" if x is None else str(x)


@pytest.mark.parametrize("name", sorted(k for k in ORACLES if not k.startswith("op")))
def test_oracle(spark, duck, name):
    a, b = QUERIES[name](spark, SF), duck.execute(ORACLES[name]).to_arrow_table()
    columns = sorted(b.column_names)
    assert set(columns) <= set(a.columns)
    rows = sorted(tuple(plain(v) for v in r) for r in a.select(*[f"`{c}`" for c in columns]).collect())
    assert rows == sorted(zip(*[[plain(v) for v in b.column(c).to_pylist()] for c in columns], strict=True))


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if k.startswith("generator")))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name,n", [("quarantine_gates", 7), ("gold_gates", 10), ("mart_gates", 14)])
def test_gates_hold(spark, name, n):
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == n and all(r["passed"] for r in rows), rows


def test_checks(spark):
    rows = QUERIES["dq_checks"](spark, SF).collect()
    assert len(rows) == 22 and all(r["passed"] for r in rows if r["group"] == "integrity")


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_training_data_package(tmp_path):
    for p in ("__spark_entry__.py", "quaystone"):
        (shutil.copytree if (REPO / p).is_dir() else shutil.copy)(REPO / p, tmp_path / p)
    shutil.rmtree(tmp_path / "quaystone/llm", ignore_errors=True)
    code = f"""
import __spark_entry__ as e
from quaystone.session import build_session
assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries()) and len(e.oracle_sql()) > 40
spark = build_session('copy', 'local[2]', **{{'spark.sql.shuffle.partitions': '2', 'spark.ui.enabled': 'false'}})
assert e.queries()['q2_channel_share'](spark, '{SF}').count() > 0 and e.queries()['mart_daily'](spark, '{SF}').count() > 0
"""
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
