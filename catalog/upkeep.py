"""Day partitions and expiry."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    NOW,
    RETENTION_DAYS,
    WITH_LOGS,
    canonical,
    logs,
    shown,
    sql_time,
)
from tallylog.functions.timestamps import day_name, timestamp_text
from tallylog.operators import retention, rollup
from tallylog.plans import maintenance
from tallylog.session import fresh_path
from tallylog.sources import tables

CUTOFF = retention.retention_cutoff(NOW, RETENTION_DAYS)
MOVED_DAY = "2024-01-15T00:00:00Z"


def _plan(spark):
    return retention.partition_plan(spark, NOW, RETENTION_DAYS)


def _listing(spark, sf_dir):
    """A partition for every day with logs; names of the days with the 3 in it are spoilt."""
    day = F.to_date("timestamp")
    days = logs(spark, sf_dir).select(day.alias("day")).distinct()
    start = F.col("day").cast("timestamp")
    name = day_name(F.col("day"))
    return days.select(
        F.when(F.day("day") == 3, F.lit("logs_20240230"))
        .when(F.day("day") == 13, F.concat(name, F.lit("x")))
        .otherwise(name)
        .alias("name"),
        start.alias("start"),
        F.when(F.day("day") == 23, start + F.make_dt_interval(hours=F.lit(23)))
        .otherwise(F.date_add("day", 1).cast("timestamp"))
        .alias("end"),
    )


def _default_rows(spark, sf_dir):
    routed = retention.route_partition(logs(spark, sf_dir), _plan(spark))
    return routed.where("partition_name = 'logs_default'").drop("partition_name")


def _bounds(df):
    return shown(
        df.withColumns({c: timestamp_text(F.col(c)) for c in ("start", "end")}),
        "name",
        "start",
        "end",
    )


def planned_days(spark, sf_dir):
    """The plan, with the rows each of its days has."""
    rows = logs(spark, sf_dir).groupBy(day_name(F.col("timestamp")).alias("name")).agg(
        F.count("*").alias("rows")
    )
    plan = _bounds(_plan(spark)).join(rows, "name", "left")
    return plan.select("name", "start", "end", F.coalesce("rows", F.lit(0)).alias("rows"))


def route_partition(spark, sf_dir):
    routed = retention.route_partition(logs(spark, sf_dir), _plan(spark))
    return routed.groupBy("partition_name").agg(F.count("*").alias("rows"))


def valid_partitions(spark, sf_dir):
    return _bounds(retention.valid_partitions(_listing(spark, sf_dir)))


def missing_partitions(spark, sf_dir):
    return _bounds(retention.missing_partitions(_plan(spark), _listing(spark, sf_dir)))


def missing_upcoming_days(spark, sf_dir):
    upcoming = retention.upcoming_days(spark, "2024-01-30T23:59:59.999Z")
    return _bounds(retention.missing_partitions(upcoming, _listing(spark, sf_dir)))


def days_with_default_rows(spark, sf_dir):
    wide = retention.partition_plan(spark, NOW, 40)
    rows = _default_rows(spark, sf_dir)
    return _bounds(retention.days_with_default_rows(wide, rows))


def rows_for_new_days(spark, sf_dir):
    wide = retention.partition_plan(spark, NOW, 25)
    rows = retention.rows_for_new_days(_default_rows(spark, sf_dir), wide)
    return rows.groupBy("name").agg(F.count("*").alias("rows"))


def move_default_rows(spark, sf_dir):
    moved, _ = retention.move_default_rows(logs(spark, sf_dir), MOVED_DAY)
    return shown(moved)


def stay_default_rows(spark, sf_dir):
    _, staying = retention.move_default_rows(logs(spark, sf_dir), MOVED_DAY)
    return shown(staying)


def expired_partitions(spark, sf_dir):
    return _bounds(retention.expired_partitions(_listing(spark, sf_dir), CUTOFF))


def oldest_expired_partition(spark, sf_dir):
    return _bounds(retention.oldest_expired_partition(_listing(spark, sf_dir), CUTOFF))


def expired_rows(spark, sf_dir):
    return shown(retention.expired_default_rows(logs(spark, sf_dir), CUTOFF), "id", "timestamp")


def expire_victims(spark, sf_dir):
    _, victims = retention.expire_default_rows(_default_rows(spark, sf_dir), CUTOFF)
    return shown(victims, "id", "timestamp")


def expire_survivors(spark, sf_dir):
    """Every third day is no partition, so default rows lie on both sides of the cutoff."""
    plan = _plan(spark).where(F.dayofmonth("start") % 3 != 0)
    routed = retention.route_partition(logs(spark, sf_dir), plan)
    default_rows = routed.where("partition_name = 'logs_default'").drop("partition_name")
    survivors, _ = retention.expire_default_rows(default_rows, CUTOFF)
    return shown(survivors, "id", "timestamp")


def count_deleted(spark, sf_dir):
    _, victims = retention.expire_default_rows(_default_rows(spark, sf_dir), CUTOFF)
    return retention.count_deleted(victims)


def retention_report(spark, sf_dir):
    return retention.retention_report(
        _listing(spark, sf_dir), _default_rows(spark, sf_dir), NOW, RETENTION_DAYS
    )


def retained(spark, sf_dir):
    return shown(retention.retained(logs(spark, sf_dir), NOW, RETENTION_DAYS), "id", "timestamp")


def retained_without_boundary_day(spark, sf_dir):
    """The cutoff's day is no partition, so its rows are cut at the instant."""
    later = _plan(spark).where(F.col("name") != day_name(F.lit(CUTOFF).cast("timestamp")))
    rows = retention.retained(logs(spark, sf_dir), NOW, RETENTION_DAYS, later)
    return shown(rows, "id", "timestamp")


def retained_rollup(spark, sf_dir):
    counts = rollup.build_rollup(logs(spark, sf_dir))
    kept = retention.retained_rollup(counts, NOW, RETENTION_DAYS, expire_rollup=True)
    return kept.select(
        timestamp_text(F.col("bucket_start")).alias("bucket_start"), "service", "level", "count"
    )


def drop_expired_days(spark, sf_dir):
    """Day folders are deleted; what is read afterwards."""
    path = fresh_path(spark, "logs")
    tables.append_logs(logs(spark, sf_dir), path)
    maintenance.drop_expired_days(spark, path, NOW, RETENTION_DAYS)
    kept = tables.scan_logs(spark, path)
    return kept.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("rows")
    )


def delete_rows(spark, sf_dir):
    """The expired default rows leave the stored table."""
    path = fresh_path(spark, "logs")
    tables.append_logs(logs(spark, sf_dir), path)
    stored = tables.scan_logs(spark, path)
    routed = retention.route_partition(stored, _plan(spark))
    default_rows = routed.where("partition_name = 'logs_default'")
    _, victims = retention.expire_default_rows(default_rows, CUTOFF)
    maintenance.delete_rows(spark, path, victims)
    return shown(tables.scan_logs(spark, path), "id", "timestamp")


def _two_batches(spark, sf_dir):
    """Committed tables of two batches, with what a third one left that died before its commit."""
    out = tables.LogTables(fresh_path(spark, "tables"))
    rows = logs(spark, sf_dir)
    odd = F.minute("timestamp") % 2 == 1
    for number, part in enumerate((rows.where(odd), rows.where(~odd))):
        tables.write_batch(part, number, out.logs, out.rollup, out.commits)
    tables._write_part(rows, out.logs, "batch", 2)
    return out


def _days_beside_counts(spark, out):
    """Rows by day, with the sum of the day's minute counts."""
    day = F.date_format("event_date", "yyyy-MM-dd").alias("day")
    stored = tables.scan_logs(spark, out.logs, out.commits)
    counts = tables.scan_rollup(spark, out.rollup, out.commits)
    return stored.groupBy(day).agg(F.count("*").alias("rows")).join(
        counts.groupBy(day).agg(F.sum("count").alias("counted")), "day", "full_outer"
    )


def run_upkeep_committed(spark, sf_dir):
    """What is left of committed tables and their counts; the cutoff's day is no partition."""
    out = _two_batches(spark, sf_dir)
    boundary = day_name(F.lit(CUTOFF).cast("timestamp"))
    plan = retention.partition_plan(spark, NOW, RETENTION_DAYS + 3).where(F.col("name") != boundary)
    maintenance.ensure_days(spark, out, plan)
    maintenance.run_upkeep(spark, out, NOW, RETENTION_DAYS, expire_rollup=True)
    return _days_beside_counts(spark, out)


def upkeep_report(spark, sf_dir):
    """What that run says it has done."""
    out = _two_batches(spark, sf_dir)
    boundary = day_name(F.lit(CUTOFF).cast("timestamp"))
    plan = retention.partition_plan(spark, NOW, RETENTION_DAYS + 3).where(F.col("name") != boundary)
    maintenance.ensure_days(spark, out, plan)
    return maintenance.run_upkeep(spark, out, NOW, RETENTION_DAYS)


def compact_live(spark, sf_dir):
    """Committed tables after a compaction, a batch that came while it ran, and another one."""
    out = tables.LogTables(fresh_path(spark, "tables"))
    rows = logs(spark, sf_dir)
    part = F.minute("timestamp") % 4
    add = lambda n: tables.write_batch(rows.where(part == n), n, out.logs, out.rollup, out.commits)
    add(0)
    add(1)
    maintenance.compact_tables(spark, out)
    add(2)
    maintenance.compact_tables(spark, out, whole=True)
    add(3)
    return _days_beside_counts(spark, out)


def write_batch_retry(spark, sf_dir):
    """A batch whose first attempt had more days and rows than the one that is committed."""
    out = tables.LogTables(fresh_path(spark, "tables"))
    rows = logs(spark, sf_dir)
    for path, part in ((out.logs, rows), (out.rollup, rollup.minute_counts(rows))):
        tables._write_part(part, path, "batch", 0)
    again = rows.where((F.dayofmonth("timestamp") % 2 == 0) & (F.hour("timestamp") < 12))
    tables.write_batch(again, 0, out.logs, out.rollup, out.commits)
    return _days_beside_counts(spark, out)


QUERIES = {
    f.__name__: f
    for f in (
        run_upkeep_committed,
        upkeep_report,
        compact_live,
        write_batch_retry,
        planned_days,
        route_partition,
        valid_partitions,
        missing_partitions,
        missing_upcoming_days,
        days_with_default_rows,
        rows_for_new_days,
        move_default_rows,
        stay_default_rows,
        expired_partitions,
        oldest_expired_partition,
        expired_rows,
        expire_victims,
        expire_survivors,
        count_deleted,
        retention_report,
        retained,
        retained_without_boundary_day,
        retained_rollup,
        drop_expired_days,
        delete_rows,
    )
}

_CUT = sql_time(CUTOFF)
_CUT_DAY = f"CAST({_CUT} AS DATE)"
_NOW_DAY = f"CAST({sql_time(NOW)} AS DATE)"


def _days_sql(first: str, last: str, name: str) -> str:
    return (
        f"{name} AS (SELECT 'logs_' || strftime(d, '%Y%m%d') AS name, CAST(d AS DATE) AS day "
        f"FROM generate_series(CAST({first} AS TIMESTAMP), CAST({last} AS TIMESTAMP), "
        "INTERVAL 1 DAY) AS g(d))"
    )


def _plan_sql(days: int, name: str = "plan") -> str:
    return _days_sql(f"{_NOW_DAY} - {days}", f"{_NOW_DAY} + 2", name)


_BOUNDS = (
    "strftime({day}, '%Y-%m-%dT00:00:00.000Z') AS start, "
    "strftime({day} + 1, '%Y-%m-%dT00:00:00.000Z') AS \"end\""
)
_DAY_BOUNDS = _BOUNDS.format(day="day")
_PLAN = _plan_sql(RETENTION_DAYS)
_DEFAULT = (
    "default_rows AS (SELECT * FROM logs WHERE CAST(timestamp AS DATE) NOT IN "
    "(SELECT day FROM plan))"
)
# Days 3, 13 and 23 are spoilt in the listing; 3 and 13 by their names.
_NAMED = (
    "named AS (SELECT DISTINCT CAST(timestamp AS DATE) AS day, "
    "'logs_' || strftime(timestamp, '%Y%m%d') AS name FROM logs "
    "WHERE day(timestamp) NOT IN (3, 13))"
)
_VALID = "valid AS (SELECT * FROM named WHERE day(day) <> 23)"
_VICTIMS = (
    f"victims AS (SELECT * FROM default_rows WHERE timestamp < {_CUT})"
)
_ID_TIME = f"id, {canonical('timestamp')} AS timestamp"
_PUBLIC = f"id, {canonical('timestamp')} AS timestamp, level, service, message, attributes"

ORACLES = {
    "planned_days": f"""{WITH_LOGS}, {_PLAN}, counts AS (
        SELECT CAST(timestamp AS DATE) AS day, count(*) AS n FROM logs GROUP BY 1)
        SELECT name, {_DAY_BOUNDS}, coalesce(n, 0) AS rows FROM plan LEFT JOIN counts USING (day)""",
    "route_partition": f"""{WITH_LOGS}, {_PLAN}
        SELECT coalesce(name, 'logs_default') AS partition_name, count(*) AS rows
        FROM logs LEFT JOIN plan ON CAST(timestamp AS DATE) = day GROUP BY 1""",
    "valid_partitions": f"{WITH_LOGS}, {_NAMED}, {_VALID} SELECT name, {_DAY_BOUNDS} FROM valid",
    "missing_partitions": f"""{WITH_LOGS}, {_PLAN}, {_NAMED} SELECT name, {_DAY_BOUNDS}
        FROM plan WHERE name NOT IN (SELECT name FROM named)""",
    "missing_upcoming_days": f"""{WITH_LOGS}, {_NAMED},
        {_days_sql("DATE '2024-01-30'", "DATE '2024-02-01'", "upcoming")}
        SELECT name, {_DAY_BOUNDS} FROM upcoming WHERE name NOT IN (SELECT name FROM named)""",
    "days_with_default_rows": f"""{WITH_LOGS}, {_PLAN}, {_plan_sql(40, "wide")}, {_DEFAULT}
        SELECT name, {_DAY_BOUNDS} FROM wide
        WHERE day IN (SELECT CAST(timestamp AS DATE) FROM default_rows)""",
    "rows_for_new_days": f"""{WITH_LOGS}, {_PLAN}, {_plan_sql(25, "wide")}, {_DEFAULT}
        SELECT name, count(*) AS rows FROM default_rows
        JOIN wide ON CAST(timestamp AS DATE) = day GROUP BY name""",
    "move_default_rows": f"""{WITH_LOGS} SELECT {_PUBLIC} FROM logs
        WHERE CAST(timestamp AS DATE) = DATE '2024-01-15'""",
    "stay_default_rows": f"""{WITH_LOGS} SELECT {_PUBLIC} FROM logs
        WHERE CAST(timestamp AS DATE) <> DATE '2024-01-15'""",
    "expired_partitions": f"""{WITH_LOGS}, {_NAMED}, {_VALID}
        SELECT name, {_DAY_BOUNDS} FROM valid WHERE day + 1 <= {_CUT}""",
    "oldest_expired_partition": f"""{WITH_LOGS}, {_NAMED}, {_VALID}
        SELECT name, {_DAY_BOUNDS} FROM valid WHERE day + 1 <= {_CUT} ORDER BY day LIMIT 1""",
    "expired_rows": f"{WITH_LOGS} SELECT {_ID_TIME} FROM logs WHERE timestamp < {_CUT}",
    "expire_victims": f"""{WITH_LOGS}, {_PLAN}, {_DEFAULT}, {_VICTIMS}
        SELECT {_ID_TIME} FROM victims""",
    "expire_survivors": f"""{WITH_LOGS}, {_PLAN}
        SELECT {_ID_TIME} FROM logs WHERE timestamp >= {_CUT}
        AND CAST(timestamp AS DATE) NOT IN (SELECT day FROM plan WHERE day(day) % 3 <> 0)""",
    "count_deleted": f"""{WITH_LOGS}, {_PLAN}, {_DEFAULT}, {_VICTIMS}
        SELECT CAST(count(*) AS INTEGER) AS deleted FROM victims""",
    "retention_report": f"""{WITH_LOGS}, {_PLAN}, {_DEFAULT}, {_NAMED}, {_VALID},
        {_days_sql(_NOW_DAY, f"{_NOW_DAY} + 2", "upcoming")},
        n AS (SELECT
          (SELECT count(*) FROM upcoming WHERE name NOT IN (SELECT name FROM named)) AS missing,
          (SELECT count(*) FROM valid WHERE day + 1 <= {_CUT}) AS expired,
          (SELECT count(*) FROM default_rows WHERE timestamp < {_CUT}) AS old_rows)
        SELECT 'completed' AS status, CAST(3 AS BIGINT) AS ensure_calls, missing AS created,
        expired + 1 AS drop_calls, expired AS dropped,
        CAST(floor(old_rows / 1000) AS BIGINT) + 1 AS delete_calls, old_rows AS deleted,
        FALSE AS drop_budget_reached, FALSE AS delete_budget_reached FROM n""",
    "retained": f"""{WITH_LOGS} SELECT {_ID_TIME} FROM logs
        WHERE CAST(timestamp AS DATE) >= {_CUT_DAY}""",
    "retained_without_boundary_day": f"""{WITH_LOGS} SELECT {_ID_TIME} FROM logs
        WHERE timestamp >= {_CUT}""",
    "retained_rollup": f"""{WITH_LOGS}
        SELECT {canonical("date_trunc('minute', timestamp)")} AS bucket_start, service, level,
        count(*) AS count FROM logs WHERE CAST(timestamp AS DATE) >= {_CUT_DAY} GROUP BY ALL""",
    "delete_rows": f"""{WITH_LOGS}, {_PLAN}, {_DEFAULT}, {_VICTIMS}
        SELECT {_ID_TIME} FROM logs WHERE id NOT IN (SELECT id FROM victims)""",
    "run_upkeep_committed": f"""{WITH_LOGS}
        SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS rows,
        CAST(count(*) AS BIGINT) AS counted FROM logs WHERE timestamp >= {_CUT} GROUP BY 1""",
    "upkeep_report": f"""{WITH_LOGS}, {_plan_sql(RETENTION_DAYS + 3)}
        SELECT 'completed' AS status, CAST(0 AS BIGINT) AS created, CAST(0 AS BIGINT) AS moved,
        (SELECT count(*) FROM plan WHERE day + 1 <= {_CUT}) AS dropped,
        (SELECT count(*) FROM logs WHERE timestamp < {_CUT} AND (CAST(timestamp AS DATE) = {_CUT_DAY}
            OR CAST(timestamp AS DATE) NOT IN (SELECT day FROM plan))) AS deleted,
        FALSE AS drop_budget_reached""",
    "compact_live": f"""{WITH_LOGS}
        SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS rows,
        CAST(count(*) AS BIGINT) AS counted FROM logs GROUP BY 1""",
    "write_batch_retry": f"""{WITH_LOGS}
        SELECT strftime(timestamp, '%Y-%m-%d') AS day, count(*) AS rows,
        CAST(count(*) AS BIGINT) AS counted FROM logs
        WHERE day(timestamp) % 2 = 0 AND hour(timestamp) < 12 GROUP BY 1""",
    "drop_expired_days": f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows FROM events
        WHERE CAST(ts AS DATE) >= {_CUT_DAY} GROUP BY 1""",
}
