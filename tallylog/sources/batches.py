"""Ingest bodies: one JSON object ``{"logs": [...]}`` per text line or per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylog.fixed import BAD_BATCH
from tallylog.functions.binding import built_once
from tallylog.session import configure

# Plain JSON, without the relaxations Spark allows by default.
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _end_is_reached() -> Column:
    """True where a body between two fields of an object leaves the second field readable."""
    wrapped = F.concat(F.lit('{"body":'), F.col("body"), F.lit(',"end":1}'))
    return F.from_json(wrapped, "struct<end:int>", _STRICT)["end"] == 1


def _one_element(kind: str, path: str) -> Column:
    """What is at ``path`` of a body, as ``kind``; null unless the body is one JSON value.

    Parsers stop where a value ends, so two frames bear witness. As the only element of an array
    the body cannot have brought a comma or a brace of its own; in front of the last field of an
    object it cannot have closed the array. Of repeated keys, escaped or not, the last counts.
    """
    framed = F.try_parse_json(F.concat(F.lit("["), F.col("body"), F.lit("]")))
    alone = F.try_variant_get(framed, "$[1]", "variant").isNull()
    return F.when(alone & _end_is_reached(), F.try_variant_get(framed, path, kind))


@built_once
def _entries() -> Column:
    """The values in ``logs``; null for a body that is no object or has no array there."""
    return _one_element("array<variant>", "$[0].logs")


@built_once
def _entry_texts() -> Column:
    """The texts of the entries, only where a body holds U+0000."""
    wrapped = F.concat(F.lit('{"body":'), F.col("body"), F.lit(',"end":1}'))
    texts = F.from_json(wrapped, "struct<body:struct<logs:array<string>>>", _STRICT)["body"]["logs"]
    return F.when(F.contains("body", F.lit("\\u0000")), texts).otherwise(
        F.array().cast("array<string>")
    )


def parse_batches(bodies: DataFrame) -> DataFrame:
    """``(batch_id, body)`` to ``(batch_id, logs)``; ``logs`` is null for a bad body.

    Elements are ``(entry, entry_text)``. The text is only taken where the body holds U+0000,
    the one case in which the order of an entry's keys decides its reason.
    """
    configure(bodies.sparkSession)
    return (
        bodies.withColumns({"entry": _entries(), "entry_text": _entry_texts()})
        .withColumn("logs", F.arrays_zip("entry", "entry_text"))
        .drop("body", "entry", "entry_text")
    )


def text_lines(lines: DataFrame) -> DataFrame:
    """``(file, body)`` of a text source. Blank lines are no bodies."""
    return lines.where(F.trim("value") != "").select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("body")
    )


def numbered_bodies(lines: DataFrame) -> DataFrame:
    """Give each line a ``batch_id`` from its file and its place in the split.

    A repeated task attempt reads the same split and gives the same number.
    """
    number = F.monotonically_increasing_id().cast("string")
    return lines.withColumn("batch_id", F.concat_ws("#", "file", number)).drop("file")


def read_log_batches(spark: SparkSession, path: str) -> DataFrame:
    """Parsed batches of all bodies below ``path``, one body per line."""
    configure(spark)
    return parse_batches(numbered_bodies(text_lines(spark.read.text(path))))


def bad_batches(batches: DataFrame) -> DataFrame:
    """Batches refused as a whole."""
    return batches.where(F.col("logs").isNull()).select(
        "batch_id", F.lit(BAD_BATCH).alias("error")
    )


def explode_entries(batches: DataFrame, keep_empty: bool = False) -> DataFrame:
    """One row per entry with its zero-based ``index``.

    ``keep_empty`` keeps a batch that gives no entries as one row with a null index, for
    accounting; ``bad_batch`` tells a refused body from an empty list. Filtering refused bodies
    before the explode would parse every body a second time.
    """
    kept = [c for c in batches.columns if c != "logs"]
    exploded = batches.select(
        *kept,
        F.col("logs").isNull().alias("bad_batch"),
        F.posexplode_outer("logs").alias("index", "_item"),
    )
    entries = exploded.select(
        *kept,
        "bad_batch",
        "index",
        F.col("_item.entry").alias("entry"),
        F.col("_item.entry_text").alias("entry_text"),
    )
    return entries if keep_empty else entries.where(F.col("index").isNotNull()).drop("bad_batch")


def zip_arrays(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parallel array columns to rows: the n-th row holds the n-th element of each array."""
    kept = [c for c in df.columns if c not in columns]
    zipped = df.select(*kept, F.explode(F.arrays_zip(*columns)).alias("_row"))
    return zipped.select(*kept, *(F.col("_row")[c].alias(c) for c in columns))
