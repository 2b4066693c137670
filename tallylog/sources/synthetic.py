"""A repeatable log data set of any size for measurements, made on the executors.

Every property of a row is drawn from a hash of its number and the seed, so rows can be made in any
order on any number of tasks. A third of the rows come from one service and most rows fall into
busy minutes, so that counts per minute are far fewer than rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.functions.timestamps import instant_literal
from tallylog.operators.enrich import uuid_from_digest, with_created_at, with_event_date
from tallylog.schema import LOG_SCHEMA

DAYS = 30
SERVICES, TENANTS, BUSY_MINUTES_OF_HOUR = 100, 1000, 6
HOT_SERVICE, HOT_TENANT = 7, 123
MARKER_MESSAGE = "Load Needle_%\\Path marker"


def synthetic_logs(spark: SparkSession, rows: int, seed: int, reference_ts: str) -> DataFrame:
    """``rows`` logs in the 30 days before ``reference_ts``; same arguments, same rows."""
    number = F.col("id")

    def draw(what: str, below: int) -> Column:
        return F.pmod(F.xxhash64(number, F.lit(seed), F.lit(what)), F.lit(below))

    second = draw("hour", DAYS * 24) * 3600 + draw("second", 60)
    busy = F.when(draw("busy", 10) < 9, draw("minute", BUSY_MINUTES_OF_HOUR) * 10)
    age = second + F.coalesce(busy, draw("any minute", 60)) * 60
    micros = age * 1000000 + draw("micros", 1000000) + 1
    service = F.when(draw("hot", 3) == 0, F.lit(HOT_SERVICE)).otherwise(draw("service", SERVICES))
    level = F.when(draw("level", 20) == 0, "error").when(draw("level", 20) < 4, "warn")
    found = F.create_map(
        F.lit("tenant_id"),
        F.format_string("tenant-%06d", draw("tenant", TENANTS)),
        F.lit("attempt"),
        draw("attempt", 5).cast("string"),
    )
    made = spark.range(rows).select(
        F.timestamp_micros(F.unix_micros(instant_literal(reference_ts)) - micros).alias("timestamp"),
        uuid_from_digest(F.md5(F.concat_ws("/", F.lit(str(seed)), number).cast("binary"))).alias("id"),
        F.coalesce(level, F.when(draw("debug", 4) == 0, "debug").otherwise("info")).alias("level"),
        F.format_string("service-%03d", service).alias("service"),
        F.when(draw("marker", 1000) == 0, F.lit(MARKER_MESSAGE))
        .otherwise(F.concat(F.lit("ordinary message "), number.cast("string")))
        .alias("message"),
        F.to_json(found).alias("attributes"),
        found.alias("attributes_search"),
    )
    return with_event_date(with_created_at(made)).select(*LOG_SCHEMA.fieldNames())
