"""Bucket counts from the logs and from the minute counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    DAY,
    MONTH,
    UNALIGNED,
    WITH_LOGS,
    between,
    canonical,
    documents,
    logs,
)
from tallylog.fixed import BUCKETS
from tallylog.functions.timestamps import timestamp_text
from tallylog.operators import aggregate as agg
from tallylog.operators import audit, rollup
from tallylog.operators.filters import LogFilters

_INTERVAL = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}


def _raw(filters, bucket, group_by):
    def run(spark, sf_dir):
        return agg.format_buckets(agg.bucket_count(logs(spark, sf_dir), filters, bucket, group_by))

    return run


def _stored(filters, bucket, group_by):
    def run(spark, sf_dir):
        counts = rollup.build_rollup(logs(spark, sf_dir))
        return agg.format_buckets(agg.rollup_bucket_count(counts, filters, bucket, group_by))

    return run


def _routed(filters, bucket, group_by, exact=False):
    def run(spark, sf_dir):
        rows = logs(spark, sf_dir)
        counts = rollup.build_rollup(rows)
        return agg.format_buckets(
            agg.aggregate(rows, counts, filters, bucket, group_by, exact=exact)
        )

    return run


def _sql(condition, bucket, group_by, time="timestamp"):
    group = group_by or "CAST(NULL AS VARCHAR)"
    start = f"time_bucket(INTERVAL '{_INTERVAL[bucket]}', {time}, TIMESTAMP '1970-01-01 00:00:00')"
    return (
        f"{WITH_LOGS}, counted AS (SELECT {start} AS bucket, {group} AS grouped, count(*) AS n "
        f"FROM logs WHERE {condition} GROUP BY 1, 2) "
        f'SELECT {canonical("bucket")} AS start, grouped AS "group", n AS count FROM counted'
    )


# The minute of an instant decides, not the instant.
_MINUTE = "date_trunc('minute', timestamp)"

QUERIES, ORACLES = {}, {}

for _bucket in BUCKETS:
    for _group in (None, "service", "level"):
        _name = f"{_bucket}" + (f"_by_{_group}" if _group else "")
        _month = LogFilters(**MONTH)
        QUERIES[f"bucket_count_{_name}"] = _raw(_month, _bucket, _group)
        ORACLES[f"bucket_count_{_name}"] = _sql(between(MONTH), _bucket, _group)
        QUERIES[f"rollup_count_{_name}"] = _stored(_month, _bucket, _group)
        ORACLES[f"rollup_count_{_name}"] = _sql(between(MONTH), _bucket, _group)

_CASES = {
    # name: (filters, SQL on the logs, SQL on their minutes or None where only logs can answer)
    "unaligned": (UNALIGNED, between(UNALIGNED), between(UNALIGNED, _MINUTE)),
    "one_service": (
        {"service": "service-007", **MONTH},
        f"service = 'service-007' AND {between(MONTH)}",
        f"service = 'service-007' AND {between(MONTH)}",
    ),
    "one_level": (
        {"level": "error", **MONTH},
        f"level = 'error' AND {between(MONTH)}",
        f"level = 'error' AND {between(MONTH)}",
    ),
    "by_text": (
        {"q": "needle_%", **MONTH},
        f"contains(lower(message), 'needle_%') AND {between(MONTH)}",
        None,
    ),
    "by_attribute": (
        {"attributes": {"k": "69"}, **MONTH},
        f"k = '69' AND {between(MONTH)}",
        None,
    ),
}

for _case, (_arguments, _on_logs, _on_minutes) in _CASES.items():
    _filters = LogFilters(**_arguments)
    QUERIES[f"bucket_count_{_case}"] = _raw(_filters, "1h", "level")
    ORACLES[f"bucket_count_{_case}"] = _sql(_on_logs, "1h", "level")
    QUERIES[f"aggregate_{_case}"] = _routed(_filters, "1h", "level")
    ORACLES[f"aggregate_{_case}"] = _sql(_on_minutes or _on_logs, "1h", "level")

# Ranges whose whole minutes come from the minute counts and whose cut minutes from the logs.
_EXACT = {
    "cut_since": ({"since": "2024-01-04T23:59:59.75Z", "until": "2024-01-09T06:00:00Z"}, "5m", "service"),
    "cut_until": ({"since": "2024-01-04T00:00:00Z", "until": "2024-01-09T06:30:00.000001Z"}, "1d", None),
    "one_level": ({"level": "warn", **UNALIGNED}, "1m", "service"),
}
for _case, (_arguments, _bucket, _group) in _EXACT.items():
    _level = "level = 'warn' AND " if "level" in _arguments else ""
    QUERIES[f"aggregate_exact_{_case}"] = _routed(LogFilters(**_arguments), _bucket, _group, exact=True)
    ORACLES[f"aggregate_exact_{_case}"] = _sql(_level + between(_arguments), _bucket, _group)

QUERIES["aggregate_unaligned_exact"] = _routed(LogFilters(**UNALIGNED), "1h", "level", exact=True)
ORACLES["aggregate_unaligned_exact"] = _sql(between(UNALIGNED), "1h", "level")


def primary_buckets(spark, sf_dir):
    """24 hours in 5-minute buckets by service: the standing question."""
    filters = LogFilters(**DAY)
    return agg.format_buckets(agg.bucket_count(logs(spark, sf_dir), filters, "5m", "service"))


def documents_per_hour(spark, sf_dir):
    """Long texts searched and counted."""
    filters = LogFilters(q="the", since="2024-01-01T00:00:00Z", until="9999-12-31T00:00:00Z")
    counts = agg.bucket_count(documents(spark, sf_dir), filters, "1h", "service")
    return agg.format_buckets(counts)


def build_rollup(spark, sf_dir):
    counts = rollup.build_rollup(logs(spark, sf_dir))
    return counts.select(
        timestamp_text(F.col("bucket_start")).alias("bucket_start"), "service", "level", "count"
    )


def buckets_json(spark, sf_dir):
    filters = LogFilters(**MONTH)
    return agg.buckets_json(agg.bucket_count(logs(spark, sf_dir), filters, "1d", "level"))


def count_matching(spark, sf_dir):
    return agg.count_matching(logs(spark, sf_dir), LogFilters(level="error", **MONTH))


def count_by_marker(spark, sf_dir):
    return agg.count_by_marker(logs(spark, sf_dir), "k", "69")


def audited_buckets(spark, sf_dir):
    """Rows with a level no bucket may have."""
    filters = LogFilters(**MONTH)
    rows = logs(spark, sf_dir)
    traced = rows.withColumn(
        "level", F.when(F.col("level") == "debug", F.lit("trace")).otherwise(F.col("level"))
    )
    counts = agg.format_buckets(agg.bucket_count(traced, filters, "1h", "level"))
    return audit.audit_bucket_rows(counts, "level")


def bucket_bodies(spark, sf_dir):
    """Bodies with the buckets of one day each; days with debug counts get a broken one."""
    counts = agg.bucket_count(logs(spark, sf_dir), LogFilters(**MONTH), "1h", "level")
    start = F.date_format("bucket_start", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    half = F.when(
        (F.col("group") == "debug") & (F.hour("bucket_start") == 3), F.col("count") + 0.5
    ).otherwise(F.col("count"))
    item = F.struct(start.alias("start"), "group", half.alias("count"))
    bodies = counts.groupBy(F.date_format("bucket_start", "yyyy-MM-dd").alias("day")).agg(
        F.to_json(F.struct(F.collect_list(item).alias("buckets"))).alias("body")
    )
    return audit.validate_bucket_body(bodies).select("day", "valid")


QUERIES.update(
    {
        f.__name__: f
        for f in (
            primary_buckets,
            documents_per_hour,
            build_rollup,
            buckets_json,
            count_matching,
            count_by_marker,
            audited_buckets,
            bucket_bodies,
        )
    }
)

ORACLES.update(
    {
        "primary_buckets": _sql(between(DAY), "5m", "service"),
        "documents_per_hour": f"""WITH counted AS (
            SELECT time_bucket(INTERVAL '1 hour',
              TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 60)) AS bucket,
            source AS grouped, count(*) AS n FROM documents
            WHERE contains(lower(text), 'the') GROUP BY 1, 2)
            SELECT {canonical("bucket")} AS start, grouped AS "group", n AS count FROM counted""",
        "build_rollup": f"""{WITH_LOGS} SELECT {canonical(_MINUTE)} AS bucket_start, service,
            level, count(*) AS count FROM logs GROUP BY ALL""",
        "buckets_json": f"""{WITH_LOGS}, counted AS (
            SELECT date_trunc('day', timestamp) AS day, level, count(*) AS n FROM logs GROUP BY 1, 2)
            SELECT '{{"start":"' || strftime(day, '%Y-%m-%dT00:00:00.000Z') || '","group":"' ||
            level || '","count":' || n || '}}' AS json FROM counted""",
        "count_matching": f"""{WITH_LOGS} SELECT count(*) AS count FROM logs
            WHERE level = 'error' AND {between(MONTH)}""",
        "count_by_marker": f"{WITH_LOGS} SELECT count(*) AS count FROM logs WHERE k = '69'",
        "audited_buckets": f"""WITH buckets AS ({_sql(between(MONTH), "1h", "level")})
            SELECT start, 'trace' AS "group", count FROM buckets WHERE "group" = 'debug'""",
        "bucket_bodies": f"""{WITH_LOGS}
            SELECT strftime(timestamp, '%Y-%m-%d') AS day,
            count(*) FILTER (WHERE level = 'debug' AND hour(timestamp) = 3) = 0 AS valid
            FROM logs GROUP BY 1""",
    }
)
