"""Checks on stored rows and on results. Counting checks make one pass; row checks list offenders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.fixed import GROUPS, LEVELS, MAX_SAFE_COUNT, UUID_V4
from tallylog.functions.timestamps import parse_timestamp
from tallylog.schema import LOG_KEYS


def _broken(rule: Column) -> Column:
    """A rule that is not clearly met counts as broken."""
    return ~F.coalesce(rule, F.lit(False))


def _count_broken(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.agg(*(F.count_if(_broken(rule)).alias(name) for name, rule in rules.items()))


def audit_constraints(logs: DataFrame) -> DataFrame:
    """One row: how many log rows break each stored-row rule."""
    attributes = F.try_parse_json("attributes")
    return _count_broken(
        logs,
        {
            "bad_timestamp": F.col("timestamp").isNotNull(),
            "bad_id": F.col("id").isNotNull(),
            "bad_level": F.col("level").isin(*LEVELS),
            "bad_service": F.length("service") > 0,
            "bad_message": F.length("message") > 0,
            "bad_attributes": F.schema_of_variant(attributes).startswith("OBJECT"),
            "bad_search": F.col("attributes_search").isNotNull(),
        },
    )


def audit_rollup_constraints(rollup: DataFrame) -> DataFrame:
    """One row: how many rollup rows break each rule."""
    return _count_broken(
        rollup,
        {
            "bad_bucket": F.col("bucket_start").isNotNull(),
            "bad_service": F.length("service") > 0,
            "bad_level": F.col("level").isin(*LEVELS),
            "bad_count": F.col("count") >= 0,
        },
    )


def find_duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once. Counts are combined per task before the shuffle."""
    return df.groupBy(*keys).agg(F.count("*").alias("count")).where("count > 1")


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """Refuse a batch that holds a key twice."""
    if not find_duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"duplicate key in batch: {', '.join(keys)}")


# Bits of the key filter: 2048 bitmaps of 4096 bytes, so 8 MB at most are broadcast.
KEY_FILTER_BITS = 1 << 26


def may_hold(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``stored`` whose key may be one of ``batch``: a bit for each key's hash, set by the
    batch. Rows without their bit go before any shuffle; a bit set by another key lets a row pass,
    as it would in any such filter, so the keys are compared after it."""
    place = F.pmod(F.xxhash64(*keys), F.lit(KEY_FILTER_BITS))
    bucket, at = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    bits = batch.select(bucket.alias("_bucket"), at.alias("_at")).groupBy("_bucket")
    maps = bits.agg(F.bitmap_construct_agg("_at").alias("_bits"))
    probed = stored.select("*", bucket.alias("_bucket"), at.cast("int").alias("_at"))
    byte = F.conv(F.hex(F.substring("_bits", F.expr("_at div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("int")
    found = probed.join(F.broadcast(maps), "_bucket").where(F.getbit(byte, F.col("_at") % 8) == 1)
    return found.select(*stored.columns)


def already_stored(df: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``df`` whose key the log table has. The day is matched too, so that only the day
    folders ``df`` touches are read, and stored keys that the batch cannot have go before the
    shuffle."""
    keys = ["event_date", *LOG_KEYS]
    return df.join(may_hold(stored.select(*keys), df, keys), keys, "left_semi")


def audit_result_rows(rows: DataFrame) -> DataFrame:
    """Rows of a page that must not be shown: bad id, level, timestamp, service or message.

    ``timestamp`` is the canonical text.
    """
    valid = (
        F.col("id").rlike(UUID_V4)
        & F.col("level").isin(*LEVELS)
        & parse_timestamp(F.col("timestamp")).isNotNull()
        & F.col("service").isNotNull()
        & F.col("message").isNotNull()
    )
    return rows.where(_broken(valid))


def require_result_rows(rows: DataFrame) -> DataFrame:
    """The same rows; reading a bad one fails the query."""
    valid = F.col("id").rlike(UUID_V4) & F.col("level").isin(*LEVELS)
    checked = F.when(F.coalesce(valid, F.lit(False)), F.col("id")).otherwise(
        F.raise_error("a stored log row is invalid").cast("string")
    )
    return rows.withColumn("id", checked)


def audit_bucket_rows(counts: DataFrame, group_by: str | None) -> DataFrame:
    """Bucket rows that must not be shown: bad start, count or group."""
    if group_by is None:
        group = F.col("group").isNull()
    elif group_by == "level":
        group = F.col("group").isin(*LEVELS)
    elif group_by in GROUPS:
        group = F.col("group").isNotNull()
    else:
        raise ValueError("unknown group")
    valid = (
        parse_timestamp(F.col("start")).isNotNull()
        & F.col("count").between(1, MAX_SAFE_COUNT)
        & group
    )
    return counts.where(_broken(valid))


def validate_bucket_body(bodies: DataFrame) -> DataFrame:
    """Add ``valid`` to JSON texts ``{"buckets": [{start, group, count}]}`` in column ``body``."""
    buckets = F.from_json(
        "body", "struct<buckets:array<struct<start:variant,group:variant,count:variant>>>"
    )["buckets"]
    kind = F.schema_of_variant
    whole = lambda b: F.try_variant_get(b["count"], "$", "double")
    good = lambda b: (
        F.coalesce(kind(b["start"]) == "STRING", F.lit(False))
        & parse_timestamp(F.try_variant_get(b["start"], "$", "string")).isNotNull()
        & F.coalesce(kind(b["group"]).isin("STRING", "VOID"), F.lit(False))
        & F.coalesce(kind(b["count"]).isin("BIGINT", "DOUBLE") | kind(b["count"]).startswith("DECIMAL"), F.lit(False))
        & F.coalesce((whole(b) >= 0) & (whole(b) <= MAX_SAFE_COUNT), F.lit(False))
        & F.coalesce(whole(b) == F.floor(whole(b)), F.lit(False))
    )
    return bodies.withColumn("valid", F.coalesce(F.forall(buckets, good), F.lit(False)))
