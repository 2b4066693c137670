"""Counts per time bucket."""

from __future__ import annotations

import dataclasses
import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.fixed import BUCKETS
from tallylog.functions.timestamps import argument_micros, micros_canonical, timestamp_text
from tallylog.operators.filters import (
    LogFilters,
    all_of,
    check_aggregation,
    day_column,
    time_clauses,
    where_matching,
)


MINUTE_MICROS = 60_000_000


def group_value(group_by: str | None) -> Column:
    """The grouping column, or a typed null when there is none."""
    return F.lit(None).cast("string") if group_by is None else F.col(group_by)


def _per_bucket(df: DataFrame, time: str, bucket: str, group_by: str | None, count: Column):
    keys = [F.window(time, BUCKETS[bucket])["start"].alias("bucket_start")]
    if group_by is not None:
        keys.append(F.col(group_by).alias("group"))
    counted = df.groupBy(*keys).agg(count.alias("count"))
    if group_by is None:
        counted = counted.withColumn("group", group_value(None))
    return counted.select("bucket_start", "group", "count")


def bucket_count(
    logs: DataFrame, filters: LogFilters, bucket: str, group_by: str | None = None
) -> DataFrame:
    """Rows per UTC bucket, ``(bucket_start, group, count)``; buckets without rows are absent."""
    check_aggregation(filters, bucket, group_by)
    matching = where_matching(logs, filters)
    return _per_bucket(matching, "timestamp", bucket, group_by, F.count("*"))


def can_use_rollup(filters: LogFilters) -> bool:
    """The rollup knows neither messages nor attributes."""
    return filters.q is None and not filters.attributes


def rollup_bucket_count(
    rollup: DataFrame, filters: LogFilters, bucket: str, group_by: str | None = None
) -> DataFrame:
    """The same from minute counts. Bounds select whole minutes by their start."""
    check_aggregation(filters, bucket, group_by)
    if not can_use_rollup(filters):
        raise ValueError("the minute counts can be filtered by service, level and time only")
    clauses = time_clauses(filters, "bucket_start", day_column(rollup))
    if filters.service is not None:
        clauses.append(F.col("service") == F.lit(filters.service))
    if filters.level is not None:
        clauses.append(F.col("level") == F.lit(filters.level))
    return _per_bucket(
        rollup.where(all_of(clauses)), "bucket_start", bucket, group_by, F.sum("count")
    )


def whole_minutes(filters: LogFilters) -> tuple[LogFilters | None, list[LogFilters]]:
    """The range's whole minutes, None if it has none, and what its ends cut off minutes."""
    low, high = argument_micros(filters.since), argument_micros(filters.until)
    first, last = -(-low // MINUTE_MICROS) * MINUTE_MICROS, high // MINUTE_MICROS * MINUTE_MICROS
    if first >= last:
        return None, [filters]
    part = lambda since, until: dataclasses.replace(
        filters, since=micros_canonical(since), until=micros_canonical(until)
    )
    return part(first, last), [part(a, b) for a, b in ((low, first), (last, high)) if a < b]


def aggregate(
    logs: DataFrame,
    rollup: DataFrame,
    filters: LogFilters,
    bucket: str,
    group_by: str | None = None,
    exact: bool = False,
) -> DataFrame:
    """Bucket counts from the rollup where it can answer, else from the logs.

    With bounds inside a minute the rollup includes or leaves out that minute as a whole.
    ``exact=True`` takes the whole minutes between the bounds from the rollup and counts the logs of
    the minutes that the bounds cut, two at most; a range with no whole minute is counted from the
    logs alone.
    """
    check_aggregation(filters, bucket, group_by)
    if not can_use_rollup(filters):
        return bucket_count(logs, filters, bucket, group_by)
    if not exact:
        return rollup_bucket_count(rollup, filters, bucket, group_by)
    whole, ends = whole_minutes(filters)
    parts = [bucket_count(logs, end, bucket, group_by) for end in ends]
    if whole is not None:
        parts.append(rollup_bucket_count(rollup, whole, bucket, group_by))
    if len(parts) == 1:
        return parts[0]
    # a bucket has one row of each part at most
    counts = functools.reduce(DataFrame.unionByName, parts)
    return counts.groupBy("bucket_start", "group").agg(F.sum("count").alias("count"))


def order_buckets(counts: DataFrame) -> DataFrame:
    """Oldest bucket first, then groups in binary order."""
    return counts.orderBy("bucket_start", "group")


def format_buckets(counts: DataFrame) -> DataFrame:
    """``(start, group, count)`` with the start as canonical text, in bucket order."""
    return order_buckets(counts).select(
        timestamp_text(F.col("bucket_start")).alias("start"), "group", "count"
    )


def buckets_json(counts: DataFrame) -> DataFrame:
    """One JSON text per bucket, in bucket order; nulls are written out."""
    return format_buckets(counts).select(
        F.to_json(F.struct("start", "group", "count"), {"ignoreNullFields": "false"}).alias("json")
    )


def count_matching(logs: DataFrame, filters: LogFilters) -> DataFrame:
    """How many rows ``filters`` select."""
    return where_matching(logs, filters).agg(F.count("*").alias("count"))


def count_by_marker(logs: DataFrame, key: str, value: str) -> DataFrame:
    """How many rows carry one attribute value."""
    return count_matching(logs, LogFilters(attributes={key: value}))
