"""Counts per minute, service and level that are kept beside the logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylog.operators.enrich import minute_bucket
from tallylog.schema import ROLLUP_KEYS


def minute_counts(logs: DataFrame, *also: str) -> DataFrame:
    """Count rows by (minute, service, level) and, where given, further columns.

    Every task counts its own rows first, so a hot service sends one row per task and minute.
    """
    minute = minute_bucket(F.col("timestamp")).alias("bucket_start")
    return (
        logs.groupBy(minute, "service", "level", *also)
        .agg(F.count("*").alias("count"))
        .withColumn("event_date", F.to_date("bucket_start"))
    )


def build_rollup(logs: DataFrame) -> DataFrame:
    """The whole rollup from the logs."""
    return minute_counts(logs)


def merge_rollup(existing: DataFrame, delta: DataFrame) -> DataFrame:
    """Add the counts of ``delta`` to those of ``existing``, key by key."""
    both = existing.select(*ROLLUP_KEYS, "count").unionByName(delta.select(*ROLLUP_KEYS, "count"))
    return (
        both.groupBy(*ROLLUP_KEYS)
        .agg(F.sum("count").alias("count"))
        .withColumn("event_date", F.to_date("bucket_start"))
    )


def verify_rollup(logs: DataFrame, rollup: DataFrame) -> DataFrame:
    """Keys whose stored count differs from the rows; empty when both agree."""
    counted = minute_counts(logs).select(*ROLLUP_KEYS, F.col("count").alias("rows"))
    stored = rollup.groupBy(*ROLLUP_KEYS).agg(F.sum("count").alias("stored"))
    return counted.join(stored, ROLLUP_KEYS, "full_outer").where(
        ~F.col("rows").eqNullSafe(F.col("stored"))
    )
