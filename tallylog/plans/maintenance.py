"""Upkeep of a stored, day-partitioned log table. Run it as often as wanted; one run at a time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylog.functions.timestamps import argument_micros, day_name, instant_literal
from tallylog.operators.retention import (
    all_expired_partitions,
    check_retention_args,
    expired_partitions,
    retention_cutoff,
    upcoming_days,
)
from tallylog.operators.rollup import minute_counts
from tallylog.schema import COMMIT_FIELDS, LOG_KEYS, LOG_SCHEMA, ROLLUP_KEYS, ROLLUP_SCHEMA
from tallylog.session import configure, materialize, remove_folder
from tallylog.sources.tables import (
    LogTables,
    clustered,
    commit_states,
    day_folders,
    file_system,
    remove_attempt,
    scan_logs,
    scan_tagged,
    write_commit,
    write_part,
)

_DAYS = "name string, start timestamp, end timestamp"
_AS_DAY = "%Y-%m-%d"


def stored_partitions(spark: SparkSession, path: str) -> DataFrame:
    """``(name, start, end)`` of the day folders of a table; one folder name each, no data read."""
    days = [(day,) for day in day_folders(spark, path)]
    day = F.try_to_date("day")
    listed = spark.createDataFrame(days, "day string").where(day.isNotNull())
    return listed.select(
        day_name(day).alias("name"),
        day.cast("timestamp").alias("start"),
        F.date_add(day, 1).cast("timestamp").alias("end"),
    )


def drop_expired_days(
    spark: SparkSession,
    path: str,
    now: str,
    days: int,
    limit: int | None = None,
    partitions: DataFrame | None = None,
) -> list[str]:
    """Delete the expired day folders, with ``limit`` the oldest so many; returns their names.

    Whole folders go, so nothing is rewritten. A day whose end is after the cutoff stays whole.
    ``partitions`` lists the days to look at, by default every folder there is.
    """
    cutoff = retention_cutoff(now, days)
    check_retention_args(now, cutoff=cutoff)
    stored = stored_partitions(spark, path)
    if partitions is not None:
        stored = stored.join(partitions.select("name"), "name", "left_semi")
    expired = expired_partitions(stored, cutoff, limit)
    oldest = expired.orderBy("end").select("name", F.to_date("start").alias("day"))
    root, fs = file_system(spark, path)
    dropped = []
    for row in oldest.collect():  # names of day folders
        folder = spark._jvm.org.apache.hadoop.fs.Path(root, f"event_date={row['day']}")
        fs.delete(folder, True)
        dropped.append(row["name"])
    return dropped


def delete_rows(spark: SparkSession, path: str, victims: DataFrame, committed: bool = False) -> int:
    """Delete the rows with the keys of ``victims`` and rewrite only the folders they lie in.

    The remaining rows of those folders are written aside first; the folders are then overwritten,
    and one left without rows is removed. Started again after a failure, the job ends at the same
    rows. What was written aside is removed in the end.
    ``committed`` tells that the table has writer and batch folders below its days. Returns the
    number of deleted rows.
    """
    configure(spark)
    inner = COMMIT_FIELDS if committed else []
    folders = ["event_date", *(f.name for f in inner)]
    stored = spark.read.schema(T.StructType(LOG_SCHEMA.fields + inner)).parquet(path)
    # Written once, so that all steps below speak of the same rows, and Spark knows their size.
    keys, keys_at = materialize(victims.select("event_date", *LOG_KEYS), "victims")
    hit = stored.select(*folders, *LOG_KEYS).join(keys, ["event_date", *LOG_KEYS], "left_semi")
    # One row per touched folder, so no more than there are victims.
    counts = hit.groupBy(*folders).agg(F.count("*").alias("deleted")).collect()
    if not counts:
        remove_folder(spark, keys_at)
        return 0
    touched = spark.createDataFrame(
        [tuple(row[c] for c in folders) for row in counts],
        T.StructType([f for f in stored.schema.fields if f.name in folders]),
    )
    rest, rest_at = materialize(
        stored.join(touched, folders, "left_semi").join(
            keys, ["event_date", *LOG_KEYS], "left_anti"
        ),
        "remaining",
    )
    (
        rest.hint("rebalance", *folders)
        .sortWithinPartitions(*folders, "service", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(path)
    )
    root, fs = file_system(spark, path)
    for row in touched.join(rest.select(*folders).distinct(), folders, "left_anti").collect():
        name = "/".join(f"{c}={row[c]}" for c in folders)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(root, name), True)
    for folder in (keys_at, rest_at):
        remove_folder(spark, folder)
    return sum(row["deleted"] for row in counts)


def compact_commits(spark: SparkSession, commits_path: str) -> int:
    """Replace the many small commit files by one with each writer's state.

    Readers use the highest numbers per writer, so they may look at any moment: the new file is
    there before the files it sums up go, and later commits are not touched. Returns how many
    files went.
    """
    root, fs = file_system(spark, commits_path)
    old = [status.getPath() for status in fs.listStatus(root) if status.isFile()]
    states = commit_states(spark, commits_path)
    if not states:
        return 0
    write_commit(
        spark,
        commits_path,
        [(w, last, merged if merged >= 0 else None) for w, (merged, last) in sorted(states.items())],
    )
    for path in old:
        fs.delete(path, False)
    return len(old)


#: The writer under whose name merged batches lie.
MERGED = "_merged"


def compact_tables(spark: SparkSession, tables: LogTables, whole: bool = False) -> int:
    """Merge the committed batches into one, for logs and minute counts; how many writers' were.

    Only batches since the last compaction are read and written, so a run costs what has come
    since; with ``whole`` the earlier merged batches are merged, too. The merged batch becomes
    visible, and the others stop to be, with one commit file. Ingest may go on: a batch that is
    committed meanwhile has a higher number and stays visible. Folders of merged batches are
    removed by the next run, so readers that have begun find their files. Minute counts are
    summed up to one row per key of the merged batches.
    """
    configure(spark)
    states = commit_states(spark, tables.commits)
    merged, last = states.get(MERGED, (-1, -1))
    for path in (tables.logs, tables.rollup):
        _finish_replacing(spark, path)
        _remove_merged(spark, path, states)
    names = {w: s for w, s in states.items() if s[0] < s[1] and (whole or w != MERGED)}
    if not names:
        return 0
    chosen = F.col("writer").isin(sorted(names))
    number = last + 1
    for path in (tables.logs, tables.rollup):
        remove_attempt(spark, path, MERGED, number)

    def rows(path, schema):
        return scan_tagged(spark, path, schema, tables.commits, states).where(chosen)

    logs = rows(tables.logs, LOG_SCHEMA).select(*LOG_SCHEMA.fieldNames())
    write_part(clustered(logs, "service", "timestamp"), tables.logs, MERGED, number)
    counts = rows(tables.rollup, ROLLUP_SCHEMA).groupBy("event_date", *ROLLUP_KEYS)
    summed = counts.agg(F.sum("count").alias("count")).select(*ROLLUP_SCHEMA.fieldNames())
    write_part(clustered(summed, *ROLLUP_KEYS), tables.rollup, MERGED, number)
    done = [(w, s[1], s[1]) for w, s in sorted(names.items()) if w != MERGED]
    keep = last if whole else merged
    write_commit(
        spark, tables.commits, [*done, (MERGED, number, keep if keep >= 0 else None)]
    )
    return len(names)


def _remove_merged(spark: SparkSession, path: str, states: dict[str, tuple[int, int]]) -> None:
    """Remove the folders of batches that were merged; names only, no data is read."""
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    _, fs = file_system(spark, path)
    for day in day_folders(spark, path).values():
        for writer in [status.getPath() for status in fs.listStatus(day) if status.isDirectory()]:
            name = unescape(writer.getName().removeprefix("writer="))
            merged, _ = states.get(name, (-1, -1))
            if merged < 0:
                continue
            for batch in [status.getPath() for status in fs.listStatus(writer)]:
                if int(batch.getName().removeprefix("batch_id=")) <= merged:
                    fs.delete(batch, True)


def _write_days(spark: SparkSession, tables: LogTables, days: DataFrame) -> None:
    rows = days.orderBy("start").collect()  # one short row per day
    spark.createDataFrame(rows, _DAYS).coalesce(1).write.mode("overwrite").parquet(tables.days)


def listed_days(spark: SparkSession, tables: LogTables) -> DataFrame:
    """``(name, start, end)`` of the day partitions that exist."""
    root, fs = file_system(spark, tables.days)
    if not fs.exists(root):
        return spark.createDataFrame([], _DAYS)
    return spark.read.schema(_DAYS).parquet(tables.days)


def ensure_days(spark: SparkSession, tables: LogTables, days: DataFrame) -> tuple[list[str], int]:
    """Make day partitions that are missing; (their names, default rows moved into them).

    Rows lie by day whether a partition is listed or not, so a row moves with the list: from now
    on it goes with its whole day and not by its own time. Only the new days' folders are read.
    """
    configure(spark)
    existing = listed_days(spark, tables)
    new = days.join(existing.select("name"), "name", "left_anti").select("name", "start", "end")
    made = new.orderBy("start").collect()  # one short row per day
    if not made:
        return [], 0
    dates = [row["start"].date() for row in made]
    moved = scan_logs(spark, tables.logs, tables.commits) if day_folders(spark, tables.logs) else None
    count = 0 if moved is None else moved.where(F.col("event_date").isin(dates)).count()
    _write_days(spark, tables, existing.unionByName(spark.createDataFrame(made, _DAYS)))
    return [row["name"] for row in made], count


_ASIDE = "_replace"


def _finish_replacing(spark: SparkSession, path: str) -> None:
    """Put folders written aside in their places, or drop them if their writing did not end.

    Each day's folder goes and the new one is moved in, by name only. Started again after a
    failure this ends at the same folders, as a day that is in place is no longer aside.
    """
    _, fs = file_system(spark, path)
    new = lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join(parts))
    aside = new(path, _ASIDE)
    if not fs.exists(aside):
        return
    if fs.exists(new(path, _ASIDE, "_SUCCESS")):
        for day, folder in day_folders(spark, f"{path}/{_ASIDE}").items():
            target = new(path, f"event_date={day}")
            fs.delete(target, True)
            fs.rename(folder, target)
    fs.delete(aside, True)


def _replace_days(spark: SparkSession, path: str, rows: DataFrame, days: list[str]) -> None:
    """Replace whole days by the given rows, which carry their writer and batch folders."""
    _finish_replacing(spark, path)
    folders = ["event_date", *(f.name for f in COMMIT_FIELDS)]
    rows.write.mode("overwrite").partitionBy(*folders).parquet(f"{path}/{_ASIDE}")
    _, fs = file_system(spark, path)
    for day in days:  # a day without rows becomes an empty folder
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_ASIDE}/event_date={day}"))
    _finish_replacing(spark, path)


def run_upkeep(
    spark: SparkSession,
    tables: LogTables,
    now: str,
    days: int,
    expire_rollup: bool = False,
    max_days: int | None = None,
) -> DataFrame:
    """One maintenance run on committed tables; one row that says what it did.

    The coming days are made. Listed days whose end is not after the cutoff go whole. Rows of
    days that are not listed are default rows: days before the cutoff's go whole, the cutoff's own
    day is written anew without the rows before the cutoff, and with it go what dead attempts have
    left there. Nothing is limited unless ``max_days`` gives a run a budget of listed days.
    ``expire_rollup`` does the same to the minute counts. Ingest may go on meanwhile, as long as
    it adds no rows to unlisted days up to the cutoff's.
    """
    configure(spark)
    cutoff = retention_cutoff(now, days)
    check_retention_args(now, cutoff=cutoff)
    for path in (tables.logs, tables.rollup):
        _finish_replacing(spark, path)
    created, moved = ensure_days(spark, tables, upcoming_days(spark, now))

    listed = listed_days(spark, tables)
    expired = {r["start"].date() for r in expired_partitions(listed, cutoff, max_days).collect()}
    named = {r["start"].date() for r in listed.select("start").collect()}
    instant = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=argument_micros(cutoff))
    stored = {dt.datetime.strptime(d, _AS_DAY).date() for d in day_folders(spark, tables.logs)}
    old_days = sorted(d for d in stored - named if d < instant.date())
    boundary = instant.date() if instant.date() in stored - named else None

    before = F.col("timestamp") < instant_literal(cutoff)
    looked = [*old_days, *([boundary] if boundary else [])]
    deleted = 0
    if looked:
        rows = scan_tagged(spark, tables.logs, LOG_SCHEMA, tables.commits)
        deleted = rows.where(F.col("event_date").isin(looked) & before).count()
    if boundary and not rows.where((F.col("event_date") == F.lit(boundary)) & before).isEmpty():
        left = rows.where((F.col("event_date") == F.lit(boundary)) & ~before)
        name = boundary.strftime(_AS_DAY)
        if expire_rollup:  # first, as it reads what the next step replaces
            tags = [f.name for f in COMMIT_FIELDS]
            counts = minute_counts(left, *tags)
            _replace_days(spark, tables.rollup, clustered(counts, "bucket_start"), [name])
        _replace_days(spark, tables.logs, clustered(left, "service", "timestamp"), [name])

    gone = [*sorted(expired), *old_days]
    for path in (tables.logs, *([tables.rollup] if expire_rollup else [])):
        folders = day_folders(spark, path)
        _, fs = file_system(spark, path)
        for day in gone:
            if (folder := folders.get(day.strftime(_AS_DAY))) is not None:
                fs.delete(folder, True)
    if expired:
        _write_days(spark, tables, listed.where(~F.to_date("start").isin(sorted(expired))))
    left_over = all_expired_partitions(listed_days(spark, tables), cutoff).count()
    report = [("completed", len(created), moved, len(expired), deleted, left_over > 0)]
    return spark.createDataFrame(
        report,
        "status string, created long, moved long, dropped long, deleted long, "
        "drop_budget_reached boolean",
    )
