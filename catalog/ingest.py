"""Reading bodies, judging entries, preparing and storing rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    PUBLIC,
    WITH_ENTRIES,
    WITH_LOGS,
    bodies,
    canonical,
    events,
    logs,
    shown,
)
from tallylog.functions.attributes import normalize_attributes, parse_attributes
from tallylog.functions.timestamps import canonical_timestamp, timestamp_text
from tallylog.operators import audit, enrich, rollup, validate
from tallylog.plans.ingest import accepted_rows, ingest, judge
from tallylog.session import fresh_path
from tallylog.sources import batches as source
from tallylog.sources import tables
from tallylog.streaming.ingest import drain, stream_ingest, stream_minute_counts


def _parsed(spark, sf_dir):
    return source.parse_batches(bodies(spark, sf_dir))


def _judged(spark, sf_dir):
    return judge(_parsed(spark, sf_dir))


def _body_files(spark, sf_dir, with_bad=False):
    """All bodies as text files, one per line; optionally some that are refused as a whole."""
    path = fresh_path(spark, "bodies")
    made = bodies(spark, sf_dir)
    if with_bad:
        number = F.col("batch_id").cast("long") % 8
        made = made.withColumn(
            "body",
            F.when(number == 1, F.concat("body", F.lit(" x")))
            .when(number == 3, F.lit('{"logs":{}}'))
            .when(number == 5, F.concat(F.lit("["), "body", F.lit("]")))
            .when(number == 2, F.concat("body", F.lit(',"x":1')))
            .when(number == 4, F.concat(F.lit('null,"body":'), "body"))
            .when(number == 6, F.regexp_replace("body", r"\}$", r',"l\\u006fgs":{}}'))
            .when(number == 7, F.concat("body", "body"))
            .otherwise(F.col("body")),
        )
    made.select("body").write.text(path)
    return path


def read_log_batches(spark, sf_dir):
    read = source.read_log_batches(spark, _body_files(spark, sf_dir, with_bad=True))
    return read.groupBy(F.size("logs").alias("entries")).agg(F.count("*").alias("batches"))


def bad_batches(spark, sf_dir):
    read = source.read_log_batches(spark, _body_files(spark, sf_dir, with_bad=True))
    return source.bad_batches(read).groupBy("error").agg(F.count("*").alias("batches"))


def explode_entries(spark, sf_dir):
    exploded = source.explode_entries(_parsed(spark, sf_dir))
    return exploded.select("batch_id", "index")


def zip_arrays(spark, sf_dir):
    batch = F.floor(F.col("event_id") / 50).cast("long")
    row = F.struct("event_id", "event_type", "value")
    gathered = events(spark, sf_dir).groupBy(batch.alias("batch")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    )
    arrays = gathered.select(
        "batch", *(F.col("rows")[c].alias(c) for c in ("event_id", "event_type", "value"))
    )
    return source.zip_arrays(arrays, ["event_id", "event_type", "value"])


def validate_entries(spark, sf_dir):
    judged = validate.validate_entries(source.explode_entries(_parsed(spark, sf_dir)))
    return judged.select("batch_id", "index", "reason")


def reason_counts(spark, sf_dir):
    _, rejected = validate.split_valid(_judged(spark, sf_dir))
    return rejected.groupBy("reason").agg(F.count("*").alias("count"))


def split_valid(spark, sf_dir):
    accepted, _ = validate.split_valid(_judged(spark, sf_dir))
    return shown(accepted, "batch_id", "index", "timestamp", "level", "service", "message")


def _items(column):
    return F.array_join(
        F.transform(
            column, lambda r: F.concat(r["index"].cast("string"), F.lit(":"), r["reason"])
        ),
        "|",
    )


def batch_accounting(spark, sf_dir):
    accounts = validate.batch_accounting(_judged(spark, sf_dir))
    return accounts.select(
        "batch_id", "attempted", "accepted", _items("rejected").alias("rejected"), "outcome"
    )


def check_accounting(spark, sf_dir):
    checked = validate.check_accounting(validate.batch_accounting(_judged(spark, sf_dir)))
    return checked.groupBy("outcome", "consistent").agg(
        F.count("*").alias("batches"), F.sum("accepted").alias("accepted")
    )


def accepted_log_rows(spark, sf_dir):
    rows = accepted_rows(_parsed(spark, sf_dir), "check")
    return shown(rows, "id", "timestamp", "level", "service", "message", "attributes").withColumn(
        "attributes", F.regexp_replace("attributes", " ", "")
    )


def accepted_search_attributes(spark, sf_dir):
    rows = accepted_rows(_parsed(spark, sf_dir), "check")
    return rows.select("id", F.element_at("attributes_search", F.lit("k")).alias("k"))


def canonical_timestamps(spark, sf_dir):
    """Every event time written with a moving offset and fraction length, then made canonical."""
    hours = (F.col("event_id") % 27 - 13).cast("int")
    local = F.col("ts").cast("timestamp") + F.make_dt_interval(hours=hours)
    offset = F.concat(
        F.when(hours < 0, F.lit("-")).otherwise(F.lit("+")),
        F.lpad(F.abs(hours).cast("string"), 2, "0"),
        F.lit(":00"),
    )
    zeros = F.repeat(F.lit("0"), (F.col("event_id") % 5).cast("int"))
    text = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zeros, offset)
    return events(spark, sf_dir).select(
        "event_id", canonical_timestamp(text).alias("canonical")
    )


def number_texts(spark, sf_dir):
    """Doubles with few and with many digits, as searchable text."""
    numbers = F.to_json(
        F.struct(
            F.col("value").alias("plain"),
            (F.col("value") / 3).alias("long"),
            (F.col("value") * 1000003 / 7).alias("large"),
        )
    )
    rows = events(spark, sf_dir).select("event_id", parse_attributes(numbers).alias("attributes"))
    search = normalize_attributes(rows)
    return search.select(
        "event_id",
        *(F.element_at("attributes_search", F.lit(k)).alias(k) for k in ("plain", "long", "large")),
    )


def normalized_attributes(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumn("attributes", parse_attributes(F.col("attributes")))
    search = normalize_attributes(rows)
    return search.select("id", F.element_at("attributes_search", F.lit("k")).alias("k"))


def log_ids(spark, sf_dir):
    batch = F.floor(F.col("event_id") / 50).cast("string")
    placed = events(spark, sf_dir).select(
        "event_id", batch.alias("batch_id"), (F.col("event_id") % 50).alias("index")
    )
    return enrich.assign_log_id(placed, "run-1").select("event_id", "id")


def event_dates(spark, sf_dir):
    dated = enrich.with_event_date(enrich.with_created_at(logs(spark, sf_dir).drop("event_date")))
    return dated.groupBy(F.col("event_date").cast("string").alias("event_date")).agg(
        F.count("created_at").alias("count")
    )


def minute_counts(spark, sf_dir):
    counts = rollup.minute_counts(logs(spark, sf_dir))
    return counts.select(
        timestamp_text(F.col("bucket_start")).alias("bucket_start"), "service", "level", "count"
    )


def _day_counts(rows, count=None):
    day = F.date_format("event_date", "yyyy-MM-dd").alias("day")
    total = F.count("*") if count is None else F.sum(count)
    return rows.groupBy(day, "level").agg(total.alias("count"))


def append_and_scan(spark, sf_dir):
    path = fresh_path(spark, "logs")
    tables.append_logs(logs(spark, sf_dir), path)
    return _day_counts(tables.scan_logs(spark, path))


def _stored(spark, sf_dir):
    """All logs in two committed batches, one of them sent twice, and a batch never committed."""
    out = tables.LogTables(fresh_path(spark, "tables"))
    rows = logs(spark, sf_dir)
    errors, others = rows.where("level = 'error'"), rows.where("level <> 'error'")
    write = lambda df, n: tables.write_batch(df, n, out.logs, out.rollup, out.commits)
    write(errors, 0)
    write(others, 1)
    write(others, 1)
    elsewhere = f"{out.root}/elsewhere"
    tables.write_batch(errors, 2, out.logs, out.rollup, elsewhere)
    return out


def write_batch_logs(spark, sf_dir):
    out = _stored(spark, sf_dir)
    return _day_counts(tables.scan_logs(spark, out.logs, out.commits))


def write_batch_rollup(spark, sf_dir):
    out = _stored(spark, sf_dir)
    return _day_counts(tables.scan_rollup(spark, out.rollup, out.commits), "count")


def compact_rollup(spark, sf_dir):
    out = _stored(spark, sf_dir)
    compacted = fresh_path(spark, "compact")
    tables.compact_rollup(tables.scan_rollup(spark, out.rollup, out.commits), compacted)
    counts = tables.scan_rollup(spark, compacted)
    return counts.select(
        timestamp_text(F.col("bucket_start")).alias("bucket_start"), "service", "level", "count"
    )


def merge_rollup(spark, sf_dir):
    """Errors are counted in both parts, so their counts double."""
    rows = logs(spark, sf_dir)
    merged = rollup.merge_rollup(
        rollup.build_rollup(rows.where("level = 'error'")), rollup.build_rollup(rows)
    )
    return merged.select(
        timestamp_text(F.col("bucket_start")).alias("bucket_start"), "service", "level", "count"
    )


def verify_rollup(spark, sf_dir):
    """Against a rollup that lacks the errors: exactly their minutes differ."""
    rows = logs(spark, sf_dir)
    wrong = rollup.verify_rollup(rows, rollup.build_rollup(rows.where("level <> 'error'")))
    return wrong.select(
        timestamp_text(F.col("bucket_start")).alias("bucket_start"),
        "service",
        "level",
        "rows",
        "stored",
    )


def ingest_batches(spark, sf_dir):
    out = tables.LogTables(fresh_path(spark, "ingest"))
    ingest(_parsed(spark, sf_dir), 0, out)
    return _day_counts(tables.scan_logs(spark, out.logs, out.commits))


def ingest_streaming(spark, sf_dir):
    """Files through the stream, which is then started again and finds nothing new."""
    path = _body_files(spark, sf_dir)
    out = tables.LogTables(fresh_path(spark, "stream"))
    for _ in range(2):
        drain(stream_ingest(spark, path, out.root, max_files_per_trigger=4))
    return _day_counts(tables.scan_logs(spark, out.logs, out.commits))


def ingest_streaming_rollup(spark, sf_dir):
    path = _body_files(spark, sf_dir)
    out = tables.LogTables(fresh_path(spark, "stream"))
    drain(stream_ingest(spark, path, out.root))
    return _day_counts(tables.scan_rollup(spark, out.rollup, out.commits), "count")


def streaming_minute_counts(spark, sf_dir):
    """The stateful form: one micro-batch over all rows gives each key its final count."""
    path, result = fresh_path(spark, "logs"), fresh_path(spark, "counts")
    stored = logs(spark, sf_dir).select("timestamp", "service", "level")
    stored.write.parquet(path)
    counts = stream_minute_counts(spark.readStream.schema(stored.schema).parquet(path))
    query = (
        counts.writeStream.outputMode("update")
        .option("checkpointLocation", fresh_path(spark, "checkpoint"))
        .foreachBatch(lambda df, _: df.write.mode("append").parquet(result))
        .trigger(availableNow=True)
        .start()
    )
    drain(query)
    return spark.read.parquet(result).select(
        timestamp_text(F.col("bucket_start")).alias("bucket_start"), "service", "level", "count"
    )


def audit_constraints(spark, sf_dir):
    """Rows with some of their values taken away."""
    rows = logs(spark, sf_dir)
    damaged = rows.withColumns(
        {
            "level": F.when(F.col("level") == "debug", F.lit("trace")).otherwise(F.col("level")),
            "message": F.when(F.col("message").startswith("Load"), F.lit("")).otherwise(
                F.col("message")
            ),
            "attributes": F.when(F.col("service") == "service-007", F.lit("[1]")).otherwise(
                F.col("attributes")
            ),
        }
    )
    return audit.audit_constraints(damaged)


def audit_rollup_constraints(spark, sf_dir):
    counts = rollup.build_rollup(logs(spark, sf_dir))
    damaged = counts.withColumn(
        "count", F.when(F.col("level") == "error", -F.col("count")).otherwise(F.col("count"))
    )
    return audit.audit_rollup_constraints(damaged)


def duplicate_keys(spark, sf_dir):
    rows = logs(spark, sf_dir).withColumn(
        "hour", timestamp_text(F.date_trunc("hour", "timestamp"))
    )
    return audit.find_duplicate_keys(rows, ["hour", "service", "level"])


def already_stored(spark, sf_dir):
    """Rows of a batch that repeats the purchases and shifts everything else by a second."""
    rows = logs(spark, sf_dir)
    moved = F.when(F.col("level") == "warn", F.col("timestamp")).otherwise(
        F.col("timestamp") + F.make_dt_interval(secs=F.lit(1))
    )
    batch = enrich.with_event_date(rows.withColumn("timestamp", moved))
    return shown(audit.already_stored(batch, rows))


def union_sources(spark, sf_dir):
    rows = logs(spark, sf_dir).drop("created_at")
    parts = [rows.where(F.col("level") == name) for name in ("error", "warn", "info", "debug")]
    return _day_counts(tables.union_sources(*parts))


QUERIES = {
    f.__name__: f
    for f in (
        read_log_batches,
        bad_batches,
        explode_entries,
        zip_arrays,
        validate_entries,
        reason_counts,
        split_valid,
        batch_accounting,
        check_accounting,
        accepted_log_rows,
        accepted_search_attributes,
        canonical_timestamps,
        number_texts,
        normalized_attributes,
        log_ids,
        event_dates,
        minute_counts,
        append_and_scan,
        write_batch_logs,
        write_batch_rollup,
        compact_rollup,
        merge_rollup,
        verify_rollup,
        ingest_batches,
        ingest_streaming,
        ingest_streaming_rollup,
        streaming_minute_counts,
        audit_constraints,
        audit_rollup_constraints,
        duplicate_keys,
        already_stored,
        union_sources,
    )
}

_MINUTE = canonical("date_trunc('minute', timestamp)")


def _grouped_minutes(count: str, where: str = "TRUE") -> str:
    return (
        f"{WITH_LOGS} SELECT {_MINUTE} AS bucket_start, service, level, {count} "
        f"FROM logs WHERE {where} GROUP BY ALL"
    )


_DAY_COUNTS = (
    "SELECT strftime(timestamp, '%Y-%m-%d') AS day, level, count(*) AS count "
    "FROM {rows} GROUP BY ALL"
)
_BATCH_SIZES = (
    "sizes AS (SELECT CAST(floor(event_id / 50) AS BIGINT) AS batch, "
    "CAST(count(*) AS INTEGER) AS n FROM events GROUP BY 1)"
)
_BAD = "batch % 8 <> 0"
_STORED_ID = (
    "substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-4' || substr(d, 14, 3) || '-8' || "
    "substr(d, 18, 3) || '-' || substr(d, 21, 12)"
)


def _shortest(x: str) -> str:
    return f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"


ORACLES = {
    "read_log_batches": f"""WITH {_BATCH_SIZES}
        SELECT CASE WHEN {_BAD} THEN NULL ELSE n END AS entries, count(*) AS batches
        FROM sizes GROUP BY ALL""",
    "bad_batches": f"""WITH {_BATCH_SIZES}
        SELECT 'Invalid ingestion request.' AS error, count(*) AS batches FROM sizes
        WHERE {_BAD} GROUP BY ALL""",
    "explode_entries": f"""{WITH_ENTRIES}
        SELECT CAST(batch AS VARCHAR) AS batch_id, "index" FROM entries""",
    "zip_arrays": """SELECT CAST(floor(event_id / 50) AS BIGINT) AS batch, event_id, event_type,
        value FROM events""",
    "validate_entries": f"""{WITH_ENTRIES}
        SELECT CAST(batch AS VARCHAR) AS batch_id, "index", reason FROM entries""",
    "reason_counts": f"""{WITH_ENTRIES}
        SELECT reason, count(*) AS count FROM entries WHERE reason IS NOT NULL GROUP BY reason""",
    "split_valid": f"""{WITH_ENTRIES}
        SELECT CAST(batch AS VARCHAR) AS batch_id, "index", {canonical("timestamp")} AS timestamp,
        level, service, message FROM entries WHERE reason IS NULL""",
    "batch_accounting": f"""{WITH_ENTRIES}
        SELECT CAST(batch AS VARCHAR) AS batch_id, count(*) AS attempted,
        count(*) FILTER (WHERE reason IS NULL) AS accepted,
        coalesce(string_agg("index" || ':' || reason, '|' ORDER BY "index")
          FILTER (WHERE reason IS NOT NULL), '') AS rejected,
        CASE WHEN count(*) FILTER (WHERE reason IS NULL) > 0 THEN 'ok' ELSE 'rejected' END
          AS outcome
        FROM entries GROUP BY batch""",
    "check_accounting": f"""{WITH_ENTRIES},
        batches AS (SELECT batch, count(*) FILTER (WHERE reason IS NULL) AS accepted
          FROM entries GROUP BY batch)
        SELECT CASE WHEN accepted > 0 THEN 'ok' ELSE 'rejected' END AS outcome,
        true AS consistent, count(*) AS batches, CAST(sum(accepted) AS BIGINT) AS accepted
        FROM batches GROUP BY 1, 2""",
    "accepted_log_rows": f"""{WITH_ENTRIES},
        digests AS (SELECT *, md5('check:' || batch || ':' || "index") AS d FROM entries
          WHERE reason IS NULL)
        SELECT {_STORED_ID} AS id, {canonical("timestamp")} AS timestamp, level, service, message,
        CASE WHEN event_id % 11 = 0 THEN '{{}}' ELSE replace(attributes, ' ', '') END
          AS attributes
        FROM digests""",
    "accepted_search_attributes": f"""{WITH_ENTRIES},
        digests AS (SELECT *, md5('check:' || batch || ':' || "index") AS d FROM entries
          WHERE reason IS NULL)
        SELECT {_STORED_ID} AS id, CASE WHEN event_id % 11 <> 0 THEN k END AS k FROM digests""",
    "canonical_timestamps": f"SELECT event_id, {canonical('ts')} AS canonical FROM events",
    "number_texts": f"""SELECT event_id, {_shortest("value")} AS plain,
        {_shortest("value / 3")} AS "long", {_shortest("value * 1000003 / 7")} AS "large"
        FROM events""",
    "normalized_attributes": f"{WITH_LOGS} SELECT id, k FROM logs",
    "log_ids": f"""WITH digests AS (SELECT event_id,
        md5('run-1:' || CAST(floor(event_id / 50) AS BIGINT) || ':' || (event_id % 50)) AS d
        FROM events) SELECT event_id, {_STORED_ID} AS id FROM digests""",
    "event_dates": """SELECT strftime(ts, '%Y-%m-%d') AS event_date, count(*) AS count
        FROM events GROUP BY 1""",
    "minute_counts": _grouped_minutes("count(*) AS count"),
    "append_and_scan": WITH_LOGS + _DAY_COUNTS.format(rows="logs"),
    "write_batch_logs": WITH_LOGS + _DAY_COUNTS.format(rows="logs"),
    "write_batch_rollup": WITH_LOGS + _DAY_COUNTS.format(rows="logs"),
    "compact_rollup": _grouped_minutes("count(*) AS count"),
    "merge_rollup": _grouped_minutes(
        "CAST(sum(CASE WHEN level = 'error' THEN 2 ELSE 1 END) AS BIGINT) AS count"
    ),
    "verify_rollup": _grouped_minutes(
        "count(*) AS rows, CAST(NULL AS BIGINT) AS stored", "level = 'error'"
    ),
    "ingest_batches": WITH_ENTRIES + _DAY_COUNTS.format(rows="entries WHERE reason IS NULL"),
    "ingest_streaming": WITH_ENTRIES + _DAY_COUNTS.format(rows="entries WHERE reason IS NULL"),
    "ingest_streaming_rollup": WITH_ENTRIES
    + _DAY_COUNTS.format(rows="entries WHERE reason IS NULL"),
    "streaming_minute_counts": _grouped_minutes("count(*) AS count"),
    "audit_constraints": f"""{WITH_LOGS}
        SELECT CAST(0 AS BIGINT) AS bad_timestamp, CAST(0 AS BIGINT) AS bad_id,
        count(*) FILTER (WHERE level = 'debug') AS bad_level, CAST(0 AS BIGINT) AS bad_service,
        count(*) FILTER (WHERE message LIKE 'Load%') AS bad_message,
        count(*) FILTER (WHERE service = 'service-007') AS bad_attributes,
        CAST(0 AS BIGINT) AS bad_search FROM logs""",
    "audit_rollup_constraints": f"""{WITH_LOGS},
        counts AS (SELECT date_trunc('minute', timestamp), service, level FROM logs GROUP BY ALL)
        SELECT CAST(0 AS BIGINT) AS bad_bucket, CAST(0 AS BIGINT) AS bad_service,
        CAST(0 AS BIGINT) AS bad_level, count(*) FILTER (WHERE level = 'error') AS bad_count
        FROM counts""",
    "duplicate_keys": f"""{WITH_LOGS}
        SELECT {canonical("date_trunc('hour', timestamp)")} AS hour, service, level,
        count(*) AS count FROM logs GROUP BY ALL HAVING count(*) > 1""",
    "already_stored": f"{WITH_LOGS} SELECT {PUBLIC} FROM logs WHERE level = 'warn'",
    "union_sources": WITH_LOGS + _DAY_COUNTS.format(rows="logs"),
}
