"""Column layouts of the stored tables and of the sample records."""

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("attributes", T.StringType()),
        T.StructField("attributes_search", T.MapType(T.StringType(), T.StringType())),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("event_date", T.DateType()),
    ]
)

def promoted_column(key: str) -> str:
    """Column of its own that a stored table may have for one attribute."""
    return f"attribute_{key}"


LOG_COLUMNS = [f.name for f in LOG_SCHEMA.fields if f.name != "event_date"]

PUBLIC_COLUMNS = ["id", "timestamp", "level", "service", "message", "attributes"]

ROLLUP_SCHEMA = T.StructType(
    [
        T.StructField("bucket_start", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("count", T.LongType()),
        T.StructField("event_date", T.DateType()),
    ]
)

LOG_KEYS = ["timestamp", "id"]

ROLLUP_KEYS = ["bucket_start", "service", "level"]

# Added by batch commits: who wrote the rows and in which of its batches.
COMMIT_FIELDS = [T.StructField("writer", T.StringType()), T.StructField("batch_id", T.LongType())]

# ``retired`` says that the writer's batches up to that number have been merged into others.
COMMIT_SCHEMA = T.StructType(
    COMMIT_FIELDS
    + [
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("retired", T.LongType()),
    ]
)

REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("rows", T.LongType()),
        T.StructField("accepted", T.LongType()),
        T.StructField("rejected", T.LongType()),
        T.StructField("started_ms", T.DoubleType()),
        T.StructField("completed_ms", T.DoubleType()),
        T.StructField("latency_ms", T.DoubleType()),
    ]
)
