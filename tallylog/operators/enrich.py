"""What accepted entries gain before they are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.functions.attributes import normalize_attributes
from tallylog.schema import LOG_SCHEMA


def uuid_from_digest(digest: Column) -> Column:
    """A version-4-shaped id from the hex digits of an md5 digest."""
    part = lambda start, length: F.substring(digest, start, length)
    return F.concat(
        part(1, 8),
        F.lit("-"),
        part(9, 4),
        F.lit("-4"),
        part(14, 3),
        F.lit("-8"),
        part(18, 3),
        F.lit("-"),
        part(21, 12),
    )


def assign_log_id(df: DataFrame, namespace: str = "") -> DataFrame:
    """Add ``id``, the same on every attempt of a task: a digest of where the entry came from.

    ``namespace`` keeps separate ingest runs apart when their batch ids repeat.
    """
    place = F.concat_ws(":", F.lit(namespace), F.col("batch_id"), F.col("index"))
    return df.withColumn("id", uuid_from_digest(F.md5(place.cast("binary"))))


def with_created_at(df: DataFrame) -> DataFrame:
    """Add ``created_at``: the start of the query that stores the rows."""
    return df.withColumn("created_at", F.current_timestamp())


def with_event_date(df: DataFrame) -> DataFrame:
    """Add ``event_date``: the UTC day a row belongs to."""
    return df.withColumn("event_date", F.to_date("timestamp"))


def minute_bucket(ts: Column) -> Column:
    """Start of the minute, also before 1970."""
    return F.date_trunc("minute", ts)


def to_log_rows(accepted: DataFrame, namespace: str = "", *also: str) -> DataFrame:
    """Accepted entries in the layout of the log table, with further columns of theirs."""
    rows = normalize_attributes(assign_log_id(accepted, namespace))
    rows = with_event_date(with_created_at(rows))
    columns = {name: F.col(name) for name in LOG_SCHEMA.fieldNames()}
    columns["attributes"] = F.to_json("attributes").alias("attributes")
    return rows.select(*columns.values(), *also)
