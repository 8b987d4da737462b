"""Spark session with the settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC makes text times and zone-less timestamps agree; ANSI makes a bad cast an error where no lenient cast is meant.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # the JVM never compiles a method of over 8000 bytes; wide stages run faster operator by operator than interpreted
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(app: str = "quaystone", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
