"""Names, texts, patterns and limits that callers rely on letter by letter."""

# --- fixed values -----------------------------------------------------------

LEVELS = ("debug", "info", "warn", "error")

BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}

GROUPS = ("service", "level")

REASON = {
    "entry_object": "log entry must be a non-null object",
    "timestamp_required": "timestamp is required",
    "timestamp_string": "timestamp must be a string",
    "timestamp_grammar": "timestamp must be a timezone-bearing ISO 8601 date-time",
    "timestamp_components": "timestamp contains an invalid calendar date or time",
    "timestamp_future": "timestamp must not be more than five minutes in the future",
    "level_required": "level is required",
    "level_string": "level must be a string",
    "level_value": "level must be one of debug, info, warn, or error",
    "service_required": "service is required",
    "service_string": "service must be a string",
    "service_empty": "service must be non-empty",
    "service_nul": "service must not contain U+0000",
    "message_required": "message is required",
    "message_string": "message must be a string",
    "message_empty": "message must be non-empty",
    "message_nul": "message must not contain U+0000",
    "attributes_object": "attributes must be a non-null object",
    "attribute_key_nul": "attribute keys must not contain U+0000",
    "attribute_value": "attribute values must be strings, finite numbers, or booleans",
    "attribute_string_nul": "string attribute values must not contain U+0000",
}

BAD_BATCH = "Invalid ingestion request."

ARGUMENT = {
    "service_string": "Query parameter 'service' must be a string.",
    "service_nul": "Query parameter 'service' must not contain U+0000.",
    "level_string": "Query parameter 'level' must be a string.",
    "level_value": "Query parameter 'level' must be one of debug, info, warn, or error.",
    "since_timestamp": "Query parameter 'since' must be a valid timezone-bearing ISO 8601 date-time.",
    "until_timestamp": "Query parameter 'until' must be a valid timezone-bearing ISO 8601 date-time.",
    "range": "Query parameter 'until' must not be earlier than 'since'.",
    "attribute_key": "Attribute query parameters must include a non-empty key after 'attr.'.",
    "attribute_duplicate": "Each attribute query key must appear at most once.",
    "attribute_string": "Attribute query parameter values must be strings.",
    "attribute_key_nul": "Attribute query keys must not contain U+0000.",
    "attribute_value_nul": "Attribute query values must not contain U+0000.",
    "q_string": "Query parameter 'q' must be a string.",
    "q_nul": "Query parameter 'q' must not contain U+0000.",
    "limit_value": "Query parameter 'limit' must be a base-10 integer from 1 to 1000.",
    "cursor_value": "Query parameter 'cursor' must be a non-empty string.",
    "cursor_invalid": "Query parameter 'cursor' is invalid.",
    "since_required": "Query parameter 'since' is required.",
    "until_required": "Query parameter 'until' is required.",
    "bucket_required": "Query parameter 'bucket' is required.",
    "bucket_value": "Query parameter 'bucket' must be one of 1m, 5m, 1h, or 1d.",
    "group_by_value": "Query parameter 'group_by' must be one of service or level.",
}

RETENTION = {
    "plan": "The UTC partition plan is invalid.",
    "start": "Retention partition start is invalid.",
    "cutoff": "Retention cutoff is invalid.",
    "batch_size": "Retention batch size is invalid.",
    "calls": "Retention call count is invalid.",
}

DEFAULT_LIMIT = 100
MAX_LIMIT = 1000
MAX_SAFE_COUNT = 9007199254740991
FUTURE_TOLERANCE_SECONDS = 300

UUID_V4 = r"^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"
TIMESTAMP_GRAMMAR = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:[0-9]{2})\z"
)
PARTITION_NAME = r"^logs_[0-9]{8}\z"
DEFAULT_PARTITION = "logs_default"

MAX_RETENTION_DAYS = 3650
DROP_CALL_LIMIT = 32
DELETE_CALL_LIMIT = 10
DELETE_BATCH_SIZE = 1000
MAX_DELETE_BATCH_SIZE = 10000

TARGET_ROWS_PER_SECOND = 15000
TARGET_AGGREGATION_P95_MS = 1000
TARGET_MEASURED_ROWS = 1000000
TARGET_FRESHNESS_MS = 20000

# --- end of fixed values ----------------------------------------------------
