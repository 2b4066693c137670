"""Attribute objects: JSON values of any key, and their searchable text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.fixed import REASON
from tallylog.functions.binding import built_once, let
from tallylog.functions.numbers import EXACT_INTEGERS, exact_number_texts, number_text

NUL = "\u0000"


def variant_type(value: Column) -> Column:
    """Type name of a JSON value: STRING, BOOLEAN, BIGINT, DECIMAL(p,s), DOUBLE, VOID, …"""
    return F.schema_of_variant(value)


def is_number(kind: Column) -> Column:
    return kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def attribute_reason(key: Column, value: Column) -> Column:
    """Why one attribute is not acceptable; null when it is."""

    def judge(kind: Column) -> Column:
        finite = is_number(kind) & (F.abs(as_double(value)) < F.lit(float("inf")))
        return F.when(
            ~F.coalesce(kind.isin("STRING", "BOOLEAN") | finite, F.lit(False)),
            F.lit(REASON["attribute_value"]),
        ).when(
            (kind == "STRING") & F.contains(as_text(value), F.lit(NUL)),
            F.lit(REASON["attribute_string_nul"]),
        )

    return F.when(F.contains(key, F.lit(NUL)), F.lit(REASON["attribute_key_nul"])).otherwise(
        let(variant_type(value), judge)
    )


def key_order(keys: Column) -> Column:
    """Keys in the order objects list them: array indexes ascending, then first appearance."""
    is_index = lambda k: k.rlike(r"^(?:0|[1-9][0-9]{0,9})\z") & (
        k.try_cast("long") < F.lit(4294967295)
    )
    ranked = F.transform(
        F.array_distinct(keys),
        lambda k, i: F.struct(
            F.when(is_index(k), F.lit(0)).otherwise(F.lit(1)).alias("kind"),
            F.when(is_index(k), k.try_cast("long")).otherwise(i.cast("long")).alias("place"),
            k.alias("key"),
        ),
    )
    return F.transform(F.array_sort(ranked), lambda r: r["key"])


def plainly_good(attributes: Column) -> Column:
    """True where all values are texts, booleans or exact numbers and no text holds U+0000.

    Two cheap looks at the whole object decide nearly every entry; false only means that each
    attribute has to be judged. JSON text shows U+0000 as its escape.
    """
    exact = lambda kind: kind.isin("STRING", "BOOLEAN", "BIGINT") | kind.startswith("DECIMAL")
    plain = F.forall(F.map_values(attributes), lambda value: exact(variant_type(value)))
    return plain & ~F.contains(F.to_json(attributes), F.lit("\\u0000"))


def first_bad_attribute(attributes: Column, entry_text: Column) -> Column:
    """Reason of the first bad attribute in object order; null when all are good.

    Two attributes can only fail for different reasons when one of them holds U+0000. Only then
    is the entry's own text at hand, and only then does the order of its keys matter.
    """
    found = F.filter(
        F.transform(F.map_entries(attributes), lambda e: attribute_reason(e["key"], e["value"])),
        lambda r: r.isNotNull(),
    )
    keys = F.map_keys(F.from_json(entry_text, "struct<attributes:map<string,string>>")["attributes"])
    in_order = F.filter(
        F.transform(
            key_order(keys), lambda k: attribute_reason(k, F.element_at(attributes, k))
        ),
        lambda r: r.isNotNull(),
    )
    several = (F.size(F.array_distinct(found)) > 1) & entry_text.isNotNull()
    first = F.when(several, F.get(in_order, F.lit(0))).otherwise(F.get(found, F.lit(0)))
    return F.when(~F.coalesce(plainly_good(attributes), F.lit(False)), first)


def normalize_value(value: Column) -> Column:
    """Searchable text of one acceptable value; null for a number that needs the exact way."""
    kind, whole = variant_type(value), F.try_variant_get(value, "$", "long")
    text = F.when(kind.isin("STRING", "BOOLEAN"), as_text(value))
    text = text.when((kind == "BIGINT") & whole.between(-EXACT_INTEGERS, EXACT_INTEGERS), as_text(value))
    return text.otherwise(let(as_double(value), number_text))


@built_once
def _plain_texts() -> Column:
    return F.transform_values("_source", lambda _, value: normalize_value(value))


@built_once
def _doubtful_numbers() -> Column:
    """The doubles whose text is still missing, in map order; an empty array if there are none."""
    missing = F.exists(F.map_values("_texts"), lambda text: text.isNull())
    doubles = F.transform(
        F.map_entries("_texts"),
        lambda e: F.when(e["value"].isNull(), as_double(F.element_at("_source", e["key"]))),
    )
    return F.when(missing, doubles).otherwise(F.array().cast("array<double>"))


@built_once
def _all_texts() -> Column:
    pairs = F.arrays_zip(F.map_values("_texts").alias("plain"), F.col("_exact").alias("exact"))
    texts = F.transform(pairs, lambda pair: F.coalesce(pair["plain"], pair["exact"]))
    filled = F.map_from_arrays(F.map_keys("_texts"), texts)
    return F.when(F.col("_exact").isNull(), F.col("_texts")).otherwise(filled)


def normalize_attributes(
    df: DataFrame, source: str = "attributes", target: str = "attributes_search"
) -> DataFrame:
    """Add ``target``: a ``map<string,string>`` of the ``map<string,variant>`` column ``source``.

    Strings stay, booleans become true/false, numbers get their ECMAScript text. Only numbers
    that built-in expressions are not sure of visit Python, a batch of rows at a time.
    """
    return (
        df.withColumn("_source", F.col(source))
        .withColumn("_texts", _plain_texts())
        .withColumn("_exact", exact_number_texts(_doubtful_numbers()))
        .withColumn(target, _all_texts())
        .drop("_source", "_texts", "_exact")
    )


def parse_attributes(text: Column) -> Column:
    """A stored attributes text as ``map<string,variant>``."""
    return F.try_variant_get(F.try_parse_json(text), "$", "map<string,variant>")


def merge_attributes(base: Column, patch: Column) -> Column:
    """The pairs of two attribute maps; where both have a key, the second counts. Null with null."""
    only = F.map_filter(base, lambda key, _: ~F.array_contains(F.map_keys(patch), key))
    return F.map_concat(only, patch)
