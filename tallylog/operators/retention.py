"""Day partitions, and what expires when.

A day partition is named ``logs_YYYYMMDD`` and covers one UTC day. Rows of any other day belong
to ``logs_default``. Whole days go when their end is not after the cutoff; default rows go when
they are older than the cutoff itself.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.fixed import (
    DEFAULT_PARTITION,
    DELETE_BATCH_SIZE,
    DELETE_CALL_LIMIT,
    MAX_DELETE_BATCH_SIZE,
    MAX_RETENTION_DAYS,
    PARTITION_NAME,
    RETENTION,
)
from tallylog.functions.timestamps import argument_micros, day_name, instant_literal
from tallylog.operators.paging import oldest_first

_DAY_MICROS = 86400000000


def _day_number(now: str) -> int:
    return argument_micros(now) // _DAY_MICROS


def check_retention_days(days: int) -> int:
    if not isinstance(days, int) or isinstance(days, bool) or not 1 <= days <= MAX_RETENTION_DAYS:
        raise ValueError(RETENTION["plan"])
    return days


def check_retention_args(
    now: str,
    day_start: str | None = None,
    cutoff: str | None = None,
    batch_size: int | None = None,
) -> None:
    """Limits of a maintenance step: which day may be made, how far back, how many rows."""
    at = argument_micros(now)
    if day_start is not None:
        start, today = argument_micros(day_start), at // _DAY_MICROS * _DAY_MICROS
        midnight = start % _DAY_MICROS == 0
        if not midnight or not today - _DAY_MICROS <= start <= today + 2 * _DAY_MICROS:
            raise ValueError(RETENTION["start"])
    if cutoff is not None:
        if not at - (MAX_RETENTION_DAYS + 1) * _DAY_MICROS <= argument_micros(cutoff) <= at:
            raise ValueError(RETENTION["cutoff"])
    if batch_size is not None and not 1 <= batch_size <= MAX_DELETE_BATCH_SIZE:
        raise ValueError(RETENTION["batch_size"])


def _days(spark: SparkSession, first_day: int, count: int) -> DataFrame:
    day = F.date_from_unix_date((F.col("id") + first_day).cast("int"))
    return spark.range(count).select(
        day_name(day).alias("name"),
        day.cast("timestamp").alias("start"),
        F.date_add(day, 1).cast("timestamp").alias("end"),
    )


def partition_plan(spark: SparkSession, now: str, days: int) -> DataFrame:
    """``(name, start, end)`` of the days from today − ``days`` to today + 2."""
    check_retention_days(days)
    return _days(spark, _day_number(now) - days, days + 3)


def upcoming_days(spark: SparkSession, now: str) -> DataFrame:
    """The days each maintenance run makes sure of: today, tomorrow, the day after."""
    return _days(spark, _day_number(now), 3)


def valid_partitions(listing: DataFrame) -> DataFrame:
    """Rows of ``(name, start, end)`` whose name is a real day and whose bounds are that day's."""
    day = F.when(
        F.col("name").rlike(PARTITION_NAME),
        F.try_to_date(F.substring("name", 6, 8), "yyyyMMdd"),
    )
    return listing.where(
        (day_name(day) == F.col("name"))
        & (F.col("start") == day.cast("timestamp"))
        & (F.col("end") == F.date_add(day, 1).cast("timestamp"))
    )


def route_partition(logs: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``partition_name``: the planned day of a row, else ``logs_default``.

    A plan has at most 3653 rows, so Spark sees from its size that it can be broadcast.
    """
    days = plan.select(
        F.to_date("start").alias("_day"), F.col("name").alias("_name"), F.col("end").alias("_end")
    )
    return (
        logs.withColumn("_day", F.to_date("timestamp"))
        .join(days, "_day", "left")
        .withColumn("partition_name", F.coalesce("_name", F.lit(DEFAULT_PARTITION)))
        .drop("_day", "_name", "_end")
    )


def missing_partitions(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Planned days that do not exist yet."""
    return plan.join(existing.select("name"), "name", "left_anti").select("name", "start", "end")


def days_with_default_rows(plan: DataFrame, default_rows: DataFrame) -> DataFrame:
    """Planned days on which default rows lie. Days are made distinct before they are matched."""
    days = default_rows.select(F.to_date("timestamp").alias("_day")).distinct()
    planned = plan.withColumn("_day", F.to_date("start"))
    return planned.join(days, "_day", "left_semi").drop("_day")


def rows_for_new_days(default_rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Default rows that fall on a planned day, with that day's ``name``."""
    days = plan.select(F.to_date("start").alias("_day"), "name")
    return default_rows.withColumn("_day", F.to_date("timestamp")).join(days, "_day").drop("_day")


def _within(start: str) -> Column:
    first = instant_literal(start)
    return (F.col("timestamp") >= first) & (
        F.col("timestamp") < first + F.make_dt_interval(days=F.lit(1))
    )


def move_default_rows(default_rows: DataFrame, day_start: str) -> tuple[DataFrame, DataFrame]:
    """(rows that become the day's partition, rows that stay in default), all columns kept."""
    moved = default_rows.where(_within(day_start))
    if "event_date" in default_rows.columns:  # reads that day's folder only
        moved = moved.where(F.col("event_date") == F.to_date(instant_literal(day_start)))
    return moved, default_rows.where(~_within(day_start))


def retention_cutoff(now: str, days: int) -> str:
    """now − days × 24 h, as canonical text."""
    check_retention_days(days)
    millis = argument_micros(now) // 1000 - days * 86400000
    at = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=millis)
    return at.isoformat(timespec="milliseconds") + "Z"


def all_expired_partitions(partitions: DataFrame, cutoff: str) -> DataFrame:
    """Valid days whose end is not after the cutoff."""
    return valid_partitions(partitions).where(F.col("end") <= instant_literal(cutoff))


def expired_partitions(
    partitions: DataFrame, cutoff: str, limit: int | None = None
) -> DataFrame:
    """The expired days; with ``limit`` the oldest so many."""
    expired = all_expired_partitions(partitions, cutoff)
    return expired if limit is None else expired.orderBy("end").limit(limit)


def oldest_expired_partition(partitions: DataFrame, cutoff: str) -> DataFrame:
    """The one day a single drop step removes."""
    return expired_partitions(partitions, cutoff, 1)


def expired_default_rows(default_rows: DataFrame, cutoff: str) -> DataFrame:
    """Default rows strictly before the cutoff. Rows that carry their day are bounded by it, too,
    so folders of later days are not read."""
    at = instant_literal(cutoff)
    expired = default_rows.where(F.col("timestamp") < at)
    if "event_date" in default_rows.columns:
        expired = expired.where(F.col("event_date") <= F.to_date(at))
    return expired


def expire_default_rows(
    default_rows: DataFrame,
    cutoff: str,
    batch_size: int | None = None,
    calls: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(survivors, victims): default rows from the cutoff on, and all before it.

    With ``batch_size`` or ``calls`` a run has a budget: the oldest expired rows are victims, the
    product of both at most. ``calls`` is at most 10 and ``batch_size`` at most 10 000, so at most
    100 000 keys of victims are broadcast.
    """
    if batch_size is None and calls is None:
        expired = F.col("timestamp") < instant_literal(cutoff)
        return default_rows.where(~expired), expired_default_rows(default_rows, cutoff)
    batch_size = DELETE_BATCH_SIZE if batch_size is None else batch_size
    calls = DELETE_CALL_LIMIT if calls is None else calls
    check_retention_args(cutoff, batch_size=batch_size)
    if not 1 <= calls <= DELETE_CALL_LIMIT:
        raise ValueError(RETENTION["calls"])
    victims = oldest_first(expired_default_rows(default_rows, cutoff), batch_size * calls)
    keys = F.broadcast(victims.select("timestamp", "id"))
    return default_rows.join(keys, ["timestamp", "id"], "left_anti"), victims


def retention_report(
    partitions: DataFrame,
    default_rows: DataFrame,
    now: str,
    days: int,
    drop_limit: int | None = None,
    delete_limit: int | None = None,
) -> DataFrame:
    """One row: what a maintenance run at ``now`` finds to make, drop and delete.

    Calls are those of a run in steps: one day a drop, DELETE_BATCH_SIZE rows a delete, and one
    more that finds nothing left. The limits are a run's budgets; without them nothing is clipped.
    """
    spark = partitions.sparkSession
    cutoff = retention_cutoff(now, days)
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(
        *(
            (F.col("n") if name == part else F.lit(0).cast("long")).alias(part)
            for part in ("missing", "expired", "old_rows")
        )
    )
    parts = [
        counted(missing_partitions(upcoming_days(spark, now), partitions), "missing"),
        counted(all_expired_partitions(partitions, cutoff), "expired"),
        counted(expired_default_rows(default_rows, cutoff), "old_rows"),
    ]
    together = parts[0].unionByName(parts[1]).unionByName(parts[2])
    sums = together.agg(*(F.sum(c).alias(c) for c in ("missing", "expired", "old_rows")))
    long = lambda n: F.lit(n).cast("long")
    clip = lambda c, limit: c if limit is None else F.least(c, long(limit))
    reached = lambda c, limit: F.lit(False) if limit is None else F.col(c) >= limit
    batches = None if delete_limit is None else -(-delete_limit // DELETE_BATCH_SIZE)
    return sums.select(
        F.lit("completed").alias("status"),
        long(3).alias("ensure_calls"),
        F.col("missing").alias("created"),
        clip(F.col("expired") + 1, drop_limit).alias("drop_calls"),
        clip(F.col("expired"), drop_limit).alias("dropped"),
        clip(
            F.floor(F.col("old_rows") / DELETE_BATCH_SIZE).cast("long") + 1, batches
        ).alias("delete_calls"),
        clip(F.col("old_rows"), delete_limit).alias("deleted"),
        reached("expired", drop_limit).alias("drop_budget_reached"),
        reached("old_rows", delete_limit).alias("delete_budget_reached"),
    )


def retained(
    logs: DataFrame, now: str, days: int, partitions: DataFrame | None = None
) -> DataFrame:
    """The rows left once nothing more expires.

    Only the day of the cutoff needs a look at single rows: a day partition keeps all of it,
    default rows must not be older than the cutoff. ``partitions`` lists the existing days; by
    default all days of the plan exist.
    """
    spark = logs.sparkSession
    cutoff = instant_literal(retention_cutoff(now, days))
    boundary = F.to_date(cutoff)
    existing = partition_plan(spark, now, days) if partitions is None else partitions
    kept = logs.where(F.to_date("timestamp") >= boundary)
    if "event_date" in logs.columns:
        kept = kept.where(F.col("event_date") >= boundary)
    routed = route_partition(kept, existing)
    return routed.where(
        (F.col("partition_name") != DEFAULT_PARTITION) | (F.col("timestamp") >= cutoff)
    ).drop("partition_name")


def retained_rollup(
    rollup: DataFrame, now: str, days: int, expire_rollup: bool = False
) -> DataFrame:
    """Minute counts after a run: all of them, or with ``expire_rollup`` those of kept days."""
    if not expire_rollup:
        return rollup
    boundary = F.to_date(instant_literal(retention_cutoff(now, days)))
    return rollup.where(F.to_date("bucket_start") >= boundary)


def count_deleted(victims: DataFrame) -> DataFrame:
    """How many rows a delete step removes."""
    return victims.agg(F.count("*").cast("int").alias("deleted"))
