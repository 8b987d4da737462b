"""Tables, SQL files and reports as outputs."""

from __future__ import annotations

import json
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path and a maker of its paths."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def replace_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Parquet in place of whatever the folder held; an empty table still leaves its schema.  The new files are written
    beside the old ones and take their place when they are whole, so a job that fails leaves the old table as it was, and
    ``df`` may read what it replaces."""
    spark = df.sparkSession
    fs, make = _hadoop(spark, path)
    path = path.rstrip("/")
    staged, old = (f"{path}__{what}_{uuid.uuid4().hex}" for what in ("staged", "old"))
    try:
        (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(staged)
    except BaseException:
        fs.delete(make(staged), True)
        raise
    fs.mkdirs(make(path).getParent())
    if fs.exists(make(path)):
        fs.rename(make(path), make(old))
    fs.rename(make(staged), make(path))
    fs.delete(make(old), True)
    spark.catalog.refreshByPath(path)


POINTER = "CURRENT"


def publish(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """A new version of a published table: a folder of its own, then a pointer that is swapped in one step.  Readers see the
    old version or the new one, never a part; a failed job leaves no trace but an unnamed folder.  Returns the version."""
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(f"{path}/{version}")
    _, make = _hadoop(spark, path)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, staged = make(f"{path}/{POINTER}"), make(f"{path}/{POINTER}.{version}")
    stream = staged.getFileSystem(conf).create(staged, True)
    stream.write(bytearray(version.encode()))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(staged, target, options)
    return version


def current_version(spark: SparkSession, path: str) -> str:
    """The version that the pointer names."""
    return spark.read.text(f"{path}/{POINTER}").first()[0]


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a published table; it stays readable when a later one is published."""
    return spark.read.parquet(f"{path}/{current_version(spark, path)}")


def forget_versions(spark: SparkSession, path: str) -> int:
    """Removes all versions but the current one, failed ones too; returns how many."""
    fs, make = _hadoop(spark, path)
    keep = {current_version(spark, path), POINTER}
    old = [f.getPath() for f in fs.listStatus(make(path)) if f.getPath().getName() not in keep and not f.getPath().getName().endswith(".crc")]
    for p in old:
        fs.delete(p, True)
    return len(old)


def replace_partitions(df: DataFrame, path: str, *columns: str) -> None:
    """Parquet in place of the partitions that ``df`` has rows for; other partitions stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


def create_table_as(spark: SparkSession, table: str, select: str, path: str | None = None) -> DataFrame:
    """CREATE TABLE AS in place of a table of that name; with ``path`` its files are there and outlive the session."""
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    location = f"LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE {table} USING parquet {location} AS {select}")
    return spark.table(table)


def statements(sql: str) -> list[tuple[str, str]]:
    """(name, statement) of a SQL script: split at semicolons outside quotes and comments; the name comes from the last
    ``-- name: ...`` line before the statement."""
    out, part, name, quote, i = [], [], "", "", 0
    while i < len(sql):
        c = sql[i]
        if quote:
            part.append(c)
            quote = "" if c == quote else quote
        elif sql.startswith("--", i):
            end = sql.find("\n", i)
            end = len(sql) if end < 0 else end
            label = sql[i + 2 : end].strip()
            if label.lower().startswith("name:"):
                name = label[5:].strip()
            i = end
            part.append("\n")
        elif c == ";":
            out.append((name, "".join(part).strip()))
            part, name = [], ""
        else:
            quote = c if c in "'\"`" else ""
            part.append(c)
        i += 1
    out.append((name, "".join(part).strip()))
    return [(n, s) for n, s in out if s]


def run_script(spark: SparkSession, sql: str) -> dict[str, DataFrame]:
    """Runs a script; results of its SELECT and WITH statements by name (or number)."""
    results = {}
    for i, (name, statement) in enumerate(statements(sql)):
        df = spark.sql(statement)
        if statement.split(None, 1)[0].upper() in ("SELECT", "WITH", "FROM", "VALUES"):
            results[name or str(i)] = df
    return results


def write_json(path: str | Path, summary: dict[str, Any]) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(summary, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


def markdown_table(df: DataFrame, limit: int = 50) -> str:
    """A report table of the first rows."""
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = f"| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    return head + "".join(f"| {' | '.join(show(v) for v in row)} |\n" for row in df.limit(limit).collect())


def write_markdown(path: str | Path, title: str, parts: dict[str, DataFrame]) -> None:
    text = f"# {title}\n\n" + "\n".join(f"## {name}\n\n{markdown_table(df)}" for name, df in parts.items())
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")
