"""Entry rules. The first rule an entry breaks gives its reason; no reason means accepted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.fixed import FUTURE_TOLERANCE_SECONDS, LEVELS, REASON
from tallylog.functions.attributes import NUL, as_text, first_bad_attribute, variant_type
from tallylog.functions.binding import built_once, computed_once
from tallylog.functions.timestamps import (
    fraction_digits,
    is_after,
    matches_grammar,
    whole_second,
    with_fraction,
)

_FIELDS = (
    "struct<timestamp:variant,level:variant,service:variant,message:variant,attributes:variant>"
)


def _reason(name: str) -> Column:
    return F.lit(REASON[name])


def _is_string(value: Column) -> Column:
    return F.coalesce(variant_type(value) == "STRING", F.lit(False))


def _text_rules(name: str) -> list[tuple[Column, str]]:
    """Present, a string, not empty, free of U+0000 — in this order."""
    raw, text = F.col(f"_fields.{name}"), F.col(f"_{name}")
    return [
        (raw.isNull(), f"{name}_required"),
        (~_is_string(raw), f"{name}_string"),
        (F.length(text) == 0, f"{name}_empty"),
        (F.contains(text, F.lit(NUL)), f"{name}_nul"),
    ]


@built_once
def _fields() -> dict[str, Column]:
    """Typed views of the five fields; null where the JSON type is another."""
    raw_time, raw_level = F.col("_fields.timestamp"), F.col("_fields.level")
    attributes = F.col("_fields.attributes")
    nothing = F.create_map().cast("map<string,variant>")
    return {
        "_timestamp": F.when(_is_string(raw_time), as_text(raw_time)),
        "_level": F.when(_is_string(raw_level), as_text(raw_level)),
        "_service": as_text(F.col("_fields.service")),
        "_message": as_text(F.col("_fields.message")),
        "_attributes": F.when(attributes.isNull(), nothing).otherwise(
            F.try_variant_get(attributes, "$", "map<string,variant>")
        ),
    }


@built_once
def _time_parts() -> dict[str, Column]:
    text, valid = F.col("_timestamp"), F.col("_grammar")
    return {
        "_second": F.when(valid, whole_second(text)),
        "_fraction": F.when(valid, fraction_digits(text)),
    }


@built_once
def _first_reason() -> Column:
    """The rules in order; the first broken one counts."""
    raw_time, raw_level = F.col("_fields.timestamp"), F.col("_fields.level")
    rules = [
        (F.col("_fields").isNull(), "entry_object"),
        (raw_time.isNull(), "timestamp_required"),
        (F.col("_timestamp").isNull(), "timestamp_string"),
        (~F.col("_grammar"), "timestamp_grammar"),
        (F.col("_second").isNull(), "timestamp_components"),
        (is_after(F.col("_second"), F.col("_fraction"), F.col("_limit")), "timestamp_future"),
        (raw_level.isNull(), "level_required"),
        (F.col("_level").isNull(), "level_string"),
        (~F.col("_level").isin(*LEVELS), "level_value"),
        *_text_rules("service"),
        *_text_rules("message"),
        (F.col("_attributes").isNull(), "attributes_object"),
    ]
    return F.coalesce(
        *(F.when(broken, _reason(name)) for broken, name in rules),
        first_bad_attribute(F.col("_attributes"), F.col("entry_text")),
    )


@built_once
def _accepted() -> list[Column]:
    accepted = lambda column: F.when(F.col("reason").isNull(), column)
    return [
        accepted(with_fraction(F.col("_second"), F.col("_fraction"))).alias("timestamp"),
        *(
            accepted(F.col(f"_{name}")).alias(name)
            for name in ("second", "fraction", "level", "service", "message", "attributes")
        ),
    ]


def validate_entries(entries: DataFrame, reference_time: Column | None = None) -> DataFrame:
    """Judge each ``entry`` (a JSON value) and take its fields apart.

    Adds ``reason`` and, for accepted rows, ``timestamp``, ``second``, ``fraction``, ``level``,
    ``service``, ``message`` and ``attributes`` (``map<string,variant>``). All entries of a batch
    are judged against one ``reference_time``, by default the start of the query.
    """
    now = F.current_timestamp() if reference_time is None else reference_time
    limit = now + F.make_dt_interval(secs=F.lit(FUTURE_TOLERANCE_SECONDS))
    if "entry_text" not in entries.columns:
        entries = entries.withColumn("entry_text", F.lit(None).cast("string"))
    judged = (
        entries.withColumns(
            {"_limit": limit, "_fields": F.try_variant_get("entry", "$", _FIELDS)}
        )
        .withColumns(_fields())
        .withColumn("_grammar", matches_grammar(F.col("_timestamp")))
        .withColumns(_time_parts())
        .withColumn("reason", _first_reason())
    )
    kept = [c for c in entries.columns if c not in ("entry", "entry_text")]
    return computed_once(judged.select(*kept, "reason", *_accepted()))


def split_valid(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected rows with index and reason)."""
    entry = F.col("index").isNotNull()
    accepted = judged.where(entry & F.col("reason").isNull()).drop("reason", "bad_batch")
    rejected = judged.where(entry & F.col("reason").isNotNull())
    return accepted, rejected.select("batch_id", "index", "reason")


def batch_accounting(judged: DataFrame) -> DataFrame:
    """One row per batch: accepted count, rejected items by index, and the outcome.

    ``judged`` must keep batches without entries (a null index); refused bodies are left out. A
    group is one request body, so its list of rejects is never longer than that body.
    """
    entry = F.col("index").isNotNull()
    rejected = F.when(F.col("reason").isNotNull() & entry, F.struct("index", "reason"))
    return (
        judged.groupBy("batch_id")
        .agg(
            F.count_if(entry).alias("attempted"),
            F.count_if(entry & F.col("reason").isNull()).alias("accepted"),
            F.sort_array(F.collect_list(rejected)).alias("rejected"),
            F.coalesce(F.max("bad_batch"), F.lit(False)).alias("bad_batch"),
        )
        .where(~F.col("bad_batch"))
        .drop("bad_batch")
        .withColumn("outcome", batch_outcome(F.col("accepted")))
    )


def batch_outcome(accepted: Column) -> Column:
    """A batch is ok when at least one entry was accepted."""
    return F.when(accepted > 0, F.lit("ok")).otherwise(F.lit("rejected"))


def check_accounting(accounts: DataFrame) -> DataFrame:
    """Add ``consistent``: counts add up, and reject indexes are unique and in range."""
    indexes = F.transform("rejected", lambda r: r["index"])
    consistent = (
        (F.col("accepted") >= 0)
        & (F.col("accepted") + F.size("rejected") == F.col("attempted"))
        & (F.size(F.array_distinct(indexes)) == F.size(indexes))
        & F.forall(indexes, lambda i: (i >= 0) & (i < F.col("attempted")))
    )
    return accounts.withColumn("consistent", consistent)
