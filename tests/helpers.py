"""Small builders the tests share."""

import contextlib
import datetime as dt
import io
import json

from pyspark.sql import functions as F

from tallylog.functions.timestamps import parse_timestamp
from tallylog.operators.enrich import with_event_date
from tallylog.operators.validate import validate_entries
from tallylog.sources.batches import explode_entries, parse_batches

REFERENCE = "2026-01-15T12:00:00.000Z"
DROP = object()


def log_id(n):
    return f"00000000-0000-4000-8000-{n:012d}"


def log_frame(spark, rows):
    """Rows of (id number, timestamp text, level, service, message, search attributes)."""
    made = [
        (log_id(n), at, level, service, message, json.dumps(found), found)
        for n, at, level, service, message, found in rows
    ]
    schema = (
        "id string, at string, level string, service string, message string, "
        "attributes string, attributes_search map<string,string>"
    )
    df = spark.createDataFrame(made, schema)
    df = df.withColumn("timestamp", parse_timestamp(F.col("at"))).drop("at")
    return with_event_date(df.withColumn("created_at", F.col("timestamp")))


def entry(**changes):
    base = {
        "timestamp": "2026-01-15T12:00:00.000Z",
        "level": "info",
        "service": "checkout",
        "message": "payment accepted",
    }
    return {k: v for k, v in (base | changes).items() if v is not DROP}


def judge_bodies(spark, bodies, reference=REFERENCE):
    """Judged rows of body texts, keyed by (batch, index)."""
    numbered = [(str(i), body) for i, body in enumerate(bodies)]
    batches = parse_batches(spark.createDataFrame(numbered, "batch_id string, body string"))
    at = F.lit(dt.datetime.fromisoformat(reference.replace("Z", "+00:00"))).cast("timestamp")
    return validate_entries(explode_entries(batches, keep_empty=True), at)


def reasons(spark, texts, reference=REFERENCE):
    """Reason per entry text, all entries in one body."""
    body = '{"logs":[' + ",".join(texts) + "]}"
    rows = judge_bodies(spark, [body], reference).select("index", "reason").collect()
    return [reason for _, reason in sorted((r["index"], r["reason"]) for r in rows)]


def plan_text(df):
    """The physical plan with full argument lists."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()
