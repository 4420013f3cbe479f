"""Spark session of the engine: UTC, ANSI, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(name: str = "ledgermill", master: str | None = None, settings: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | (settings or {}))
    return (builder.master(master) if master else builder).getOrCreate()
