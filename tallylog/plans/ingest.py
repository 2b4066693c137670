"""Batch ingest: bodies to stored logs, minute counts and accounts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylog.operators.enrich import to_log_rows
from tallylog.operators.rollup import minute_counts
from tallylog.operators.validate import (
    batch_accounting,
    split_valid,
    validate_entries,
)
from tallylog.schema import LOG_SCHEMA
from tallylog.session import configure
from tallylog.sources.batches import explode_entries
from tallylog.sources.tables import (
    LogTables,
    clustered,
    committed_positions,
    file_system,
    read_batch,
    remove_attempt,
    run_all,
    write_commit,
    write_part,
)


def judge(batches: DataFrame, reference_time: Column | None = None) -> DataFrame:
    """All entries of parsed batches with their reason; a batch without entries keeps one row."""
    return validate_entries(explode_entries(batches, keep_empty=True), reference_time)


def accepted_rows(
    batches: DataFrame, namespace: str = "", reference_time: Column | None = None
) -> DataFrame:
    """Log rows of the accepted entries of parsed batches."""
    accepted, _ = split_valid(validate_entries(explode_entries(batches), reference_time))
    return to_log_rows(accepted, namespace)


def judged_rows(judged: DataFrame, namespace: str = "") -> DataFrame:
    """Judged entries in the layout of the log table, with the columns that accounts need.

    Rejected entries and batches without entries have no log values.
    """
    return to_log_rows(judged, namespace, "batch_id", "index", "reason", "bad_batch")


def _write_judged(
    rows: DataFrame, batch_id: int, tables: LogTables, writer: str, by_day: bool
) -> None:
    """Write judged rows once: accepted ones to the logs, the others, which have no day, aside.

    A log row also keeps the name of its body; readers of the logs do not ask for it.
    """
    accepted = F.col("index").isNotNull() & F.col("reason").isNull()
    tagged = rows.withColumnRenamed("batch_id", "body").withColumns(
        {
            "table": F.when(accepted, F.lit("logs")).otherwise(F.lit("rejects")),
            "index": F.when(~accepted, F.col("index")),
            "writer": F.lit(writer),
            "batch_id": F.lit(batch_id).cast("long"),
        }
    )
    folders = ["table", "event_date", "writer", "batch_id"]
    placed = tagged.hint("rebalance", "event_date") if by_day else tagged
    (
        placed.sortWithinPartitions(*folders, "service", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(tables.root)
    )
    logs, fs = file_system(rows.sparkSession, tables.logs)
    fs.mkdirs(logs)  # readers find a table also where nothing was accepted yet


def store_judged(
    judged: DataFrame,
    batch_id: int,
    tables: LogTables,
    writer: str,
    by_day: bool = True,
) -> bool:
    """Store one (micro-)batch of judged entries; False when it was stored before.

    One job judges and writes the rows; no executor keeps any. Minute counts and accounts are then
    made side by side from the few columns of the written files that they need, and the commit row
    follows when both are written. So a batch may have any size, and a lost executor costs the
    tasks it ran.
    """
    spark = configure(judged.sparkSession)
    if batch_id <= committed_positions(spark, tables.commits).get(writer, -1):
        return False
    for path in (tables.logs, tables.rollup, tables.rejects):
        remove_attempt(spark, path, writer, batch_id)
    _write_judged(judged_rows(judged, f"{writer}:{batch_id}"), batch_id, tables, writer, by_day)

    body = T.StructField("body", judged.schema["batch_id"].dataType)
    stored = lambda path, *fields: read_batch(
        spark, path, T.StructType([*LOG_SCHEMA.fields, body, *fields]), writer, batch_id
    )
    logs = stored(tables.logs)
    others = stored(tables.rejects, *[judged.schema[name] for name in ("index", "reason", "bad_batch")])
    accounts = batch_accounting(
        others.select(F.col("body").alias("batch_id"), "index", "reason", "bad_batch").unionByName(
            logs.select(F.col("body").alias("batch_id"), F.lit(0).alias("index")),
            allowMissingColumns=True,
        )
    )
    counts = clustered(minute_counts(logs), "bucket_start", "service", "level")
    part = f"{tables.accounts}/writer={writer}/part={batch_id}"
    run_all(
        spark,
        [
            lambda: accounts.write.mode("overwrite").parquet(part),
            lambda: write_part(counts, tables.rollup, writer, batch_id),
        ],
    )
    remove_attempt(spark, tables.rejects, writer, batch_id)  # the accounts have them now
    write_commit(spark, tables.commits, [(writer, batch_id, None)])
    return True


def ingest(
    batches: DataFrame,
    batch_id: int,
    tables: LogTables,
    writer: str = "batch",
    reference_time: Column | None = None,
    by_day: bool = True,
) -> bool:
    """Validate and store parsed batches as one unit.

    Without ``reference_time`` the time of this call counts, for all writes alike.
    """
    if reference_time is None:
        reference_time = F.lit(dt.datetime.now(dt.timezone.utc))
    judged = judge(batches, reference_time)
    return store_judged(judged, batch_id, tables, writer, by_day)
