"""Inputs and SQL parts the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.fixed import REASON
from tallylog.functions.timestamps import timestamp_text
from tallylog.session import configure
from tallylog.sources import adapters

DAY = {"since": "2024-01-29T00:00:00Z", "until": "2024-01-30T00:00:00Z"}
WEEK = {"since": "2024-01-23T00:00:00Z", "until": "2024-01-30T00:00:00Z"}
MONTH = {"since": "2024-01-01T00:00:00Z", "until": "2024-02-01T00:00:00Z"}
# Bounds inside a minute.
UNALIGNED = {"since": "2024-01-10T10:00:30.5Z", "until": "2024-01-12T15:07:12.25Z"}

NOW = "2024-02-03T10:30:00Z"
RETENTION_DAYS = 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events_as_logs(events(spark, sf_dir))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.documents_as_logs(table(spark, sf_dir, "documents"))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.events_as_bodies(events(spark, sf_dir))


def shown(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows with the timestamp as canonical text, so both sides compare one spelling."""
    names = columns or ("id", "timestamp", "level", "service", "message", "attributes")
    text = lambda c: timestamp_text(F.col(c)).alias(c) if c == "timestamp" else F.col(c)
    return rows.select(*(text(c) for c in names))


# --- SQL --------------------------------------------------------------------


def canonical(ts: str) -> str:
    """Canonical text of a DuckDB timestamp expression."""
    return (
        f"regexp_replace(strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') || 'Z', "
        r"'(\.[0-9]{3}[0-9]*?)0*Z$', '\1Z')"
    )


def sql_time(text: str) -> str:
    """An ISO text ending in Z as a DuckDB literal."""
    return f"TIMESTAMP '{text.removesuffix('Z').replace('T', ' ')}'"


def between(bounds: dict[str, str], column: str = "timestamp") -> str:
    return (
        f"{column} >= {sql_time(bounds['since'])} AND {column} < {sql_time(bounds['until'])}"
    )


LOGS = r"""logs AS (
  SELECT ts AS timestamp,
    '00000000-0000-4000-8000-' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS id,
    CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn'
      WHEN 'click' THEN 'info' WHEN 'signup' THEN 'info' WHEN 'view' THEN 'debug' END AS level,
    'service-' || lpad(CAST(user_id % 100 AS VARCHAR), 3, '0') AS service,
    CASE WHEN event_id % 100 = 0 THEN 'Load Needle_%\Path marker'
      ELSE 'ordinary message ' || event_id END AS message,
    props AS attributes,
    json_extract_string(props, '$.k') AS k,
    event_id, event_type, user_id, value
  FROM events)"""

WITH_LOGS = f"WITH {LOGS} "

PUBLIC = f"id, {canonical('timestamp')} AS timestamp, level, service, message, attributes"

# Entry validity as built by events_as_bodies: every seventh entry is broken in turn.
REASONS = list(REASON.values())

ENTRIES = (
    "entries AS (SELECT *, CAST(floor(event_id / 50) AS BIGINT) AS batch, "
    "CAST(row_number() OVER (PARTITION BY floor(event_id / 50) ORDER BY event_id) - 1 AS INTEGER) "
    'AS "index", CASE WHEN event_id % 7 = 0 THEN (['
    + ", ".join(f"'{r}'" for r in REASONS)
    + "])[CAST(floor(event_id / 7) AS BIGINT) % 21 + 1] END AS reason FROM logs)"
)

WITH_ENTRIES = f"WITH {LOGS}, {ENTRIES} "
