"""The stored tables: logs by UTC day, minute counts by UTC day, and the list of commits.

Layout below a root folder::

    table=logs/event_date=…/writer=…/batch_id=…/*.parquet
    rollup/event_date=…/writer=…/batch_id=…/*.parquet
    commits/*.parquet

A batch writes its logs and its minute counts, then one commit row. A writer's batches are
numbered upwards and run one after another, so the highest committed number per writer tells
readers what to see: everything up to it. Compaction (``plans.maintenance.compact_tables``) merges
batches into one of its own and commits both at once, the merged batch and up to where the
others are merged. So there are two small values per writer, however many batches there were,
they select folders rather than rows, and folders and writers to read stay few.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallylog.operators.audit import already_stored, require_unique
from tallylog.operators.rollup import minute_counts
from tallylog.schema import (
    COMMIT_FIELDS,
    COMMIT_SCHEMA,
    LOG_KEYS,
    LOG_SCHEMA,
    ROLLUP_SCHEMA,
    promoted_column,
)
from tallylog.session import configure, remove_folder


@dataclass(frozen=True)
class LogTables:
    """Paths of one set of tables."""

    root: str

    @property
    def logs(self) -> str:
        return f"{self.root}/table=logs"

    @property
    def rejects(self) -> str:
        """Entries on their way to the accounts; one partitioned write fills this and the logs."""
        return f"{self.root}/table=rejects"

    @property
    def rollup(self) -> str:
        return f"{self.root}/rollup"

    @property
    def commits(self) -> str:
        return f"{self.root}/commits"

    @property
    def accounts(self) -> str:
        return f"{self.root}/accounts"

    @property
    def days(self) -> str:
        """The list of day partitions that exist; rows of other days are default rows."""
        return f"{self.root}/days"


def file_system(spark: SparkSession, path: str):
    """(Hadoop path, its file system), for steps on folders and their names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def day_folders(spark: SparkSession, path: str) -> dict[str, object]:
    """Folders of a day-partitioned table by day text; names only, no data is read."""
    root, fs = file_system(spark, path)
    if not fs.exists(root):
        return {}
    paths = [status.getPath() for status in fs.listStatus(root) if status.isDirectory()]
    prefix = "event_date="
    return {p.getName().removeprefix(prefix): p for p in paths if p.getName().startswith(prefix)}


def batch_folders(spark: SparkSession, path: str, writer: str, batch_id: int) -> list[str]:
    """Folders of what a writer's batch has written to a table, on whatever days; names only."""
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    own = f"writer={escape(writer)}/batch_id={batch_id}"
    _, fs = file_system(spark, path)
    found = [spark._jvm.org.apache.hadoop.fs.Path(d, own) for d in day_folders(spark, path).values()]
    return [folder.toString() for folder in found if fs.exists(folder)]


def remove_attempt(spark: SparkSession, path: str, writer: str, batch_id: int) -> None:
    """Remove what an attempt at a batch that was never committed has left."""
    for folder in batch_folders(spark, path, writer, batch_id):
        remove_folder(spark, folder)


def read_batch(
    spark: SparkSession, path: str, schema: T.StructType, writer: str, batch_id: int
) -> DataFrame:
    """What a writer's batch has written to a table, committed or not. Lists its folders only."""
    folders = batch_folders(spark, path, writer, batch_id)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders)


def clustered(df: DataFrame, *inner: str, by_day: bool = True) -> DataFrame:
    """Bring each day together, but let a large day keep many tasks.

    REBALANCE shuffles by day and then, from the real sizes, splits what is too large and merges
    what is too small. Sorting inside a task gives row groups narrow ranges to skip by.
    ``by_day=False`` saves the shuffle where the input already comes day by day; a task then
    writes one file for each day it holds.
    """
    placed = df.hint("rebalance", "event_date") if by_day else df
    return placed.sortWithinPartitions("event_date", *inner)


def with_promoted(df: DataFrame, promoted: Iterable[str]) -> DataFrame:
    """Log rows with a text column for each of these attributes, null where a row has none."""
    own = {promoted_column(key): F.element_at("attributes_search", F.lit(key)) for key in promoted}
    return df.withColumns(own) if own else df


def bloom_options(promoted: Iterable[str]) -> dict[str, str]:
    """Writer options that give the columns of these attributes Bloom filters. Parquet writes one
    where a row group has too many values for a dictionary, which serves as well."""
    return {f"parquet.bloom.filter.enabled#{promoted_column(key)}": "true" for key in promoted}


def append_logs(df: DataFrame, path: str, by_day: bool = True, promoted: Iterable[str] = ()) -> None:
    """Append log rows to a plain day-partitioned table (no commits).

    ``promoted`` attributes get a column each, with a Bloom filter per row group, so that equality
    on them is pushed down and skips row groups. A table has the same ones in all its files.
    """
    configure(df.sparkSession)
    promoted = list(promoted)
    rows = clustered(with_promoted(df, promoted), "service", "timestamp", by_day=by_day)
    writer = rows.write.mode("append").partitionBy("event_date").options(**bloom_options(promoted))
    writer.parquet(path)


def write_part(df: DataFrame, path: str, writer: str, batch_id: int) -> None:
    """Write a batch's folders of one table; nobody sees them before the batch is committed."""
    _write_part(df, path, writer, batch_id)


def _write_part(df: DataFrame, path: str, writer: str, batch_id: int) -> None:
    tagged = df.withColumn("writer", F.lit(writer)).withColumn(
        "batch_id", F.lit(batch_id).cast("long")
    )
    (
        tagged.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date", "writer", "batch_id")
        .parquet(path)
    )


def commit_states(spark: SparkSession, commits_path: str) -> dict[str, tuple[int, int]]:
    """(highest merged, highest committed) batch per writer; one row per writer reaches the
    driver. Batches between the two are to be read."""
    try:
        commits = spark.read.schema(COMMIT_SCHEMA).parquet(commits_path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    rows = commits.groupBy("writer").agg(
        F.coalesce(F.max("retired"), F.lit(-1)).alias("retired"), F.max("batch_id").alias("batch_id")
    )
    return {row["writer"]: (row["retired"], row["batch_id"]) for row in rows.collect()}


def committed_positions(spark: SparkSession, commits_path: str) -> dict[str, int]:
    """Highest committed batch per writer."""
    return {writer: last for writer, (_, last) in commit_states(spark, commits_path).items()}


def write_commit(spark: SparkSession, commits_path: str, rows: list[tuple[str, int, int | None]]) -> None:
    """Commit (writer, batch, merged up to) rows together: one file, so all of them or none."""
    made = spark.createDataFrame(rows, "writer string, batch_id long, retired long").select(
        "writer", "batch_id", F.current_timestamp().alias("committed_at"), "retired"
    )
    made.coalesce(1).write.mode("append").parquet(commits_path)


def run_all(spark: SparkSession, jobs: list[Callable[[], None]]) -> None:
    """Run Spark jobs from one thread each and raise what any of them raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
        for job in started:
            job.result()


def write_batch(
    df: DataFrame,
    batch_id: int,
    logs_path: str,
    rollup_path: str,
    commits_path: str,
    writer: str = "batch",
    check_keys: bool = False,
    by_day: bool = True,
) -> bool:
    """Store log rows and their minute counts as one unit; False when already committed.

    Whatever an earlier attempt at the batch has written goes first, on all days, so its commit
    shows the rows of one attempt. Readers see neither part before the commit row exists.
    ``batch_id`` must grow from batch to batch of a writer.

    ``check_keys`` refuses the batch when a (timestamp, id) occurs twice in it or is stored
    already. Ids from ``assign_log_id`` cannot clash, so this is for rows that bring their own.
    ``by_day`` is that of :func:`clustered`.
    """
    spark = configure(df.sparkSession)
    if batch_id <= committed_positions(spark, commits_path).get(writer, -1):
        return False
    if check_keys:
        require_unique(df, LOG_KEYS)
        if committed_positions(spark, commits_path):
            stored = scan_logs(spark, logs_path, commits_path)
            days = [r["event_date"] for r in df.select("event_date").distinct().collect()]
            stored = stored.where(F.col("event_date").isin(days))  # reads the batch's days only
            if not already_stored(df, stored).isEmpty():
                raise ValueError("a key of the batch is stored already")
    for path in (logs_path, rollup_path):
        remove_attempt(spark, path, writer, batch_id)
    counts = clustered(minute_counts(df), "bucket_start", "service", "level")
    rows = clustered(df, "service", "timestamp", by_day=by_day)
    # Independent jobs, side by side; the commit row follows only when all are done.
    run_all(
        spark,
        [
            lambda: _write_part(rows, logs_path, writer, batch_id),
            lambda: _write_part(counts, rollup_path, writer, batch_id),
        ],
    )
    write_commit(spark, commits_path, [(writer, batch_id, None)])
    return True


def _is_committed(states: dict[str, tuple[int, int]]) -> Column:
    """Whether a row is to be read. Writers all of whose batches are merged need no term."""
    visible = [
        (F.col("writer") == F.lit(writer))
        & (F.col("batch_id") > F.lit(merged))
        & (F.col("batch_id") <= F.lit(last))
        for writer, (merged, last) in sorted(states.items())
        if merged < last
    ]
    return functools.reduce(operator.or_, visible) if visible else F.lit(False)


def scan_tagged(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    commits_path: str,
    states: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Committed rows with the writer and the batch they came with; ``states`` are those of
    :func:`commit_states` to read by, the present ones unless given."""
    configure(spark)
    tagged = T.StructType(schema.fields + COMMIT_FIELDS)
    rows = spark.read.schema(tagged).parquet(path)
    return rows.where(_is_committed(states or commit_states(spark, commits_path)))


def _scan(spark: SparkSession, path: str, schema: T.StructType, commits_path: str | None):
    configure(spark)
    if commits_path is None:
        return spark.read.schema(schema).parquet(path)
    return scan_tagged(spark, path, schema, commits_path).drop("writer", "batch_id")


def scan_logs(
    spark: SparkSession, path: str, commits_path: str | None = None, promoted: Iterable[str] = ()
) -> DataFrame:
    """The log table; with ``commits_path`` only what is committed. ``promoted`` are the attributes
    that :func:`append_logs` gave a column in all files of the table."""
    own = [T.StructField(promoted_column(key), T.StringType()) for key in promoted]
    return _scan(spark, path, T.StructType(LOG_SCHEMA.fields + own), commits_path)


def scan_rollup(spark: SparkSession, path: str, commits_path: str | None = None) -> DataFrame:
    """The minute counts as stored: a key may have several rows, to be summed by the reader."""
    return _scan(spark, path, ROLLUP_SCHEMA, commits_path)


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of several log sources as one; columns are matched by name."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def compact_rollup(rollup: DataFrame, path: str) -> None:
    """Write the summed counts to another folder, replacing the days it writes."""
    summed = (
        rollup.groupBy("event_date", "bucket_start", "service", "level")
        .agg(F.sum("count").alias("count"))
        .select(*ROLLUP_SCHEMA.fieldNames())
    )
    (
        clustered(summed, "bucket_start", "service", "level")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )


def compact_logs(logs: DataFrame, path: str, promoted: Iterable[str] = ()) -> None:
    """Rewrite log rows of many small batches into few files per day in another folder, with columns
    for ``promoted`` attributes (which a table can gain in this way)."""
    promoted = list(promoted)
    rows = with_promoted(logs.select(*LOG_SCHEMA.fieldNames()), promoted)
    (
        clustered(rows, "service", "timestamp")
        .write.mode("overwrite")
        .options(**bloom_options(promoted))
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date")
        .parquet(path)
    )
