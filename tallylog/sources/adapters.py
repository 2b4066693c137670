"""Other tables seen as logs, ingest bodies, request records, ticks and resource samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.sources.synthetic import MARKER_MESSAGE

# --- fixed values -----------------------------------------------------------
LEVEL_BY_EVENT = {
    "error": "error",
    "purchase": "warn",
    "click": "info",
    "signup": "info",
    "view": "debug",
}
OUTCOME_BY_EVENT = {
    "error": "http",
    "purchase": "success",
    "click": "success",
    "signup": "timeout",
    "view": "transport",
}
BODY_ENTRIES = 50
# --- end of fixed values ----------------------------------------------------


def _lookup(column: str, table: dict[str, str]) -> Column:
    chain = F
    for key, value in table.items():
        chain = chain.when(F.col(column) == key, F.lit(value))
    return chain


def _event_id() -> Column:
    return F.concat(
        F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("event_id").cast("string"), 12, "0")
    )


def _service() -> Column:
    return F.concat(
        F.lit("service-"), F.lpad((F.col("user_id") % 100).cast("string"), 3, "0")
    )


def _message() -> Column:
    plain = F.concat(F.lit("ordinary message "), F.col("event_id").cast("string"))
    return F.when(F.col("event_id") % 100 == 0, F.lit(MARKER_MESSAGE)).otherwise(plain)


def events_as_logs(events: DataFrame) -> DataFrame:
    """The log columns of an ``events`` table.

    ``props`` is the attributes object. Its numbers are whole, so their JSON text is already the
    searchable one, and filters on it stay within built-in expressions.
    """
    instant = F.col("ts").cast("timestamp")
    logs = events.select(
        instant.alias("timestamp"),
        _event_id().alias("id"),
        _lookup("event_type", LEVEL_BY_EVENT).alias("level"),
        _service().alias("service"),
        _message().alias("message"),
        F.col("props").alias("attributes"),
        F.from_json("props", "map<string,string>").alias("attributes_search"),
        instant.alias("created_at"),
    )
    return logs.withColumn("event_date", F.to_date("timestamp"))


def documents_as_logs(documents: DataFrame) -> DataFrame:
    """Long texts as messages: one log per document, the whole text each time."""
    return documents.select(
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("timestamp"),
        F.concat(
            F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("doc_id").cast("string"), 12, "0")
        ).alias("id"),
        F.lit("info").alias("level"),
        F.col("source").alias("service"),
        F.col("text").alias("message"),
        F.to_json(F.struct("lang", "n_chars")).alias("attributes"),
        F.create_map(
            F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string")
        ).alias("attributes_search"),
    )


def _entry_json() -> Column:
    """An ingest entry per event; every seventh is broken in one of 21 ways."""
    text = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    listed = lambda column: F.to_json(F.array(column))
    q = lambda column: F.substr(listed(column), F.lit(2), F.length(listed(column)) - 2)
    field = lambda name, value: F.concat(F.lit(f'"{name}":'), value)
    time = field("timestamp", q(text))
    level = field("level", q(_lookup("event_type", LEVEL_BY_EVENT)))
    service = field("service", q(_service()))
    message = field("message", q(_message()))
    attributes = field("attributes", F.col("props"))
    build = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    raw = lambda name, json: F.lit(f'"{name}":{json}')
    good = build(time, level, service, message, attributes)
    bare = build(time, level, service, message)
    broken = [
        F.lit("null"),
        build(level, service, message, attributes),
        build(raw("timestamp", "17"), level, service, message),
        build(raw("timestamp", '"2024-01-15 12:00:00Z"'), level, service, message),
        build(raw("timestamp", '"2024-02-30T12:00:00Z"'), level, service, message),
        build(raw("timestamp", '"2999-01-01T00:00:00Z"'), level, service, message),
        build(time, service, message),
        build(time, raw("level", "null"), service, message),
        build(time, raw("level", '"fatal"'), service, message),
        build(time, level, message),
        build(time, level, raw("service", "{}"), message),
        build(time, level, raw("service", '""'), message),
        build(time, level, raw("service", '"a\\u0000b"'), message),
        build(time, level, service),
        build(time, level, service, raw("message", "[]")),
        build(time, level, service, raw("message", '""')),
        build(time, level, service, raw("message", '"\\u0000"')),
        build(time, level, service, message, raw("attributes", "null")),
        build(time, level, service, message, raw("attributes", '{"a\\u0000":1}')),
        build(time, level, service, message, raw("attributes", '{"ok":1,"bad":{"x":1}}')),
        build(time, level, service, message, raw("attributes", '{"s":"x\\u0000"}')),
    ]
    which = (F.floor(F.col("event_id") / 7) % len(broken)).cast("int")
    chosen = F
    for i, text_of in enumerate(broken):
        chosen = chosen.when(which == i, text_of)
    return (
        F.when(F.col("event_id") % 7 == 0, chosen)
        .when(F.col("event_id") % 11 == 0, bare)
        .otherwise(good)
    )


def events_as_bodies(events: DataFrame) -> DataFrame:
    """``(batch_id, body)``: 50 consecutive events make one ingest body, in event order."""
    entry = F.struct(F.col("event_id"), _entry_json().alias("json"))
    batch = F.floor(F.col("event_id") / BODY_ENTRIES).cast("string")
    gathered = events.groupBy(batch.alias("batch_id")).agg(
        F.sort_array(F.collect_list(entry)).alias("entries")
    )
    texts = F.array_join(F.transform("entries", lambda e: e["json"]), ",")
    return gathered.select(
        "batch_id", F.concat(F.lit('{"logs":['), texts, F.lit("]}")).alias("body")
    )


def logs_as_bodies(logs: DataFrame, size: int) -> DataFrame:
    """Stored logs as ingest bodies again, ``size`` entries each, for load runs."""
    quoted = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        "level",
        "service",
        "message",
        F.parse_json("attributes").alias("attributes"),
    )
    place = F.floor(F.monotonically_increasing_id() / size).cast("string")
    entries = logs.select(place.alias("batch_id"), quoted.alias("entry"))
    gathered = entries.groupBy("batch_id").agg(F.collect_list("entry").alias("logs"))
    return gathered.select("batch_id", F.to_json(F.struct("logs")).alias("body"))


def events_as_requests(events: DataFrame) -> DataFrame:
    """Request records: outcome by event type, latency from ``value``."""
    outcome = _lookup("event_type", OUTCOME_BY_EVENT)
    rows = F.lit(50).cast("long")
    success = outcome == "success"
    started = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    rejected = F.when(success, F.col("event_id") % 3).cast("long")
    return events.select(
        F.concat(F.lit("run-"), (F.col("user_id") % 5).cast("string")).alias("run"),
        F.when(F.col("event_id") % 10 == 0, F.lit("warmup"))
        .otherwise(F.lit("measured"))
        .alias("phase"),
        F.col("event_id").alias("ordinal"),
        outcome.alias("outcome"),
        F.when(success, F.lit(200)).when(outcome == "http", F.lit(503)).alias("status"),
        rows.alias("rows"),
        F.when(success, rows - rejected).alias("accepted"),
        rejected.alias("rejected"),
        started.alias("started_ms"),
        (started + F.col("value")).alias("completed_ms"),
        F.col("value").alias("latency_ms"),
    )


def events_as_ticks(events: DataFrame) -> DataFrame:
    """Scheduled ticks: views are missed, sign-ups never come back."""
    due = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    started = F.when(F.col("event_type") != "view", due + F.col("value"))
    return events.select(
        F.concat(F.lit("run-"), (F.col("user_id") % 5).cast("string")).alias("run"),
        due.alias("deadline_ms"),
        started.alias("started_ms"),
        F.when(F.col("event_type") != "signup", started + 1).alias("completed_ms"),
        F.when(
            ~F.col("event_type").isin("signup", "view"), _lookup("event_type", OUTCOME_BY_EVENT)
        ).alias("outcome"),
        F.col("value").alias("lag_ms"),
    )


def events_as_resources(events: DataFrame) -> DataFrame:
    """Resource samples: one per event, metrics from its columns."""
    return events.select(
        F.concat(F.lit("run-"), (F.col("user_id") % 5).cast("string")).alias("run"),
        F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("elapsed_ms"),
        F.col("value").alias("app_cpu_percent"),
        (F.col("event_id") * 1024).alias("app_memory_bytes"),
        (F.col("value") / 2).alias("postgres_cpu_percent"),
        (F.col("user_id") * 1024).alias("postgres_memory_bytes"),
    )


def events_as_probes(events: DataFrame) -> DataFrame:
    """Freshness observations: dispatched at ``ts``, acknowledged and seen some time later."""
    dispatch = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    acknowledged = F.when(F.col("event_type") != "error", dispatch + F.col("value"))
    return events.select(
        F.col("event_id"),
        dispatch.alias("dispatch_ms"),
        acknowledged.alias("ack_ms"),
        F.when(
            F.col("event_type") != "view", dispatch + F.col("value") * (F.col("user_id") % 100)
        ).alias("visible_ms"),
    )
