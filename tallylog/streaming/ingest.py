"""Continuous ingest of body files into the stored tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallylog.plans.ingest import judge, store_judged
from tallylog.session import configure
from tallylog.sources.batches import numbered_bodies, parse_batches, text_lines
from tallylog.sources.tables import LogTables


def read_body_stream(
    spark: SparkSession,
    in_dir: str,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
) -> DataFrame:
    """Bodies of files as they arrive, with ``received_at``, the start of their micro-batch.

    Spark keeps that time in the checkpoint, so a repeated micro-batch sees the same one. The
    limits size the micro-batches.
    """
    reader = configure(spark).readStream.format("text")
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if max_bytes_per_trigger is not None:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    lines = text_lines(reader.load(in_dir))
    return lines.withColumn("received_at", F.current_timestamp())


def drop_replays(bodies: DataFrame, within: str) -> DataFrame:
    """Leave out a body that came before, byte for byte, within the given time.

    Spark reads a file once, but the same file may be delivered again under another name. Bodies
    carry no key, so this also drops a batch that was meant to be sent twice. What is left is named
    by its digest in ``batch_id``: it is shuffled on the way, and a place in a shuffle is another
    one when a lost executor's part is made again.
    """
    return (
        bodies.withWatermark("received_at", within)
        .withColumn("batch_id", F.sha2("body", 256))
        .dropDuplicatesWithinWatermark(["batch_id"])
        .drop("file")
    )


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id Spark keeps with a checkpoint; a new checkpoint numbers its batches from 0 again."""
    lines = spark.read.text(f"{checkpoint}/metadata").collect()
    return json.loads("".join(row["value"] for row in lines))["id"]


def stream_ingest(
    spark: SparkSession,
    in_dir: str,
    out: str,
    checkpoint: str | None = None,
    processing_time: str | None = None,
    max_files_per_trigger: int | None = None,
    max_bytes_per_trigger: int | None = None,
    replays_within: str | None = None,
) -> StreamingQuery:
    """Validate and store every body file of ``in_dir`` below ``out``, each exactly once.

    Without ``processing_time`` the query stores what is there and stops, which also drains a
    stopped stream. Entries are judged against the start of their micro-batch, so a repeated one
    accepts the same entries. A failed micro-batch stays invisible and is repeated as a whole.
    Late rows are simply added to their minute. ``replays_within`` (say "1 hour") leaves out
    bodies delivered a second time, see :func:`drop_replays`.
    """
    tables = LogTables(out)
    checkpoint = checkpoint or f"{out}/checkpoint"
    bodies = read_body_stream(spark, in_dir, max_files_per_trigger, max_bytes_per_trigger)
    if replays_within is not None:
        bodies = drop_replays(bodies, replays_within)

    def store(batch: DataFrame, batch_id: int) -> None:
        source = _query_id(batch.sparkSession, checkpoint)
        named = batch if "batch_id" in batch.columns else numbered_bodies(batch)
        judged = judge(parse_batches(named), F.col("received_at"))
        store_judged(judged, batch_id, tables, source)

    writer = bodies.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    if processing_time is None:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=processing_time).start()


def drain(query: StreamingQuery) -> None:
    """Wait until everything that had arrived is stored; raises what the query raised."""
    query.awaitTermination()


def stream_minute_counts(logs: DataFrame, late_after: str | None = None) -> DataFrame:
    """Minute counts of a stream of log rows, for update mode.

    With ``late_after`` (say "1 day") a minute is forgotten once rows that much later have come,
    and rows behind that are left out, so the state stays bounded. Without it no row is late and
    the state keeps every key, as the stored counts do. ``stream_ingest`` needs no state: it
    appends each batch's own counts.
    """
    if late_after is not None:
        logs = logs.withWatermark("timestamp", late_after)
    minute = F.window("timestamp", "1 minute")
    counts = logs.groupBy(minute, "service", "level").agg(F.count("*").alias("count"))
    return counts.select(F.col("window.start").alias("bucket_start"), "service", "level", "count")
