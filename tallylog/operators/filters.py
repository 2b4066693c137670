"""Filter arguments and the predicate they stand for."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallylog.fixed import ARGUMENT, BUCKETS, DEFAULT_LIMIT, GROUPS, LEVELS, MAX_LIMIT
from tallylog.functions.timestamps import (
    argument_canonical,
    argument_instant,
    date_literal,
    instant_literal,
    last_day_before,
)
from tallylog.schema import promoted_column

NUL = "\u0000"


def code_units(text: str) -> bytes:
    """Sort key that orders by UTF-16 code unit."""
    return text.encode("utf-16-be", "surrogatepass")


def _require(condition: bool, message: str) -> None:
    if not condition:
        raise ValueError(ARGUMENT[message])


@dataclass(frozen=True)
class LogFilters:
    """Which logs to look at; every given part must hold. Checked on construction."""

    service: str | None = None
    level: str | None = None
    since: str | None = None
    until: str | None = None
    attributes: Mapping[str, str] | Iterable[tuple[str, str]] = ()
    q: str | None = None

    def __post_init__(self) -> None:
        if self.service is not None:
            _require(isinstance(self.service, str), "service_string")
            _require(NUL not in self.service, "service_nul")
        if self.level is not None:
            _require(isinstance(self.level, str), "level_string")
            _require(self.level in LEVELS, "level_value")
        bounds = {}
        for name in ("since", "until"):
            text = getattr(self, name)
            if text is not None:
                parsed = argument_instant(text) if isinstance(text, str) else None
                _require(parsed is not None, f"{name}_timestamp")
                bounds[name] = parsed
                object.__setattr__(self, name, argument_canonical(text))
        if len(bounds) == 2:
            _require(bounds["until"] >= bounds["since"], "range")
        given = self.attributes
        pairs = list(given.items()) if isinstance(given, Mapping) else [tuple(p) for p in given]
        pairs.sort(key=lambda pair: code_units(pair[0]))
        seen = set()
        for key, value in pairs:
            _require(len(key) > 0, "attribute_key")
            _require(NUL not in key, "attribute_key_nul")
            _require(key not in seen, "attribute_duplicate")
            _require(isinstance(value, str), "attribute_string")
            _require(NUL not in value, "attribute_value_nul")
            seen.add(key)
        object.__setattr__(self, "attributes", tuple(pairs))
        if self.q is not None:
            _require(isinstance(self.q, str), "q_string")
            _require(NUL not in self.q, "q_nul")
            if not self.q:
                object.__setattr__(self, "q", None)


def check_limit(limit: int = DEFAULT_LIMIT) -> int:
    """A page holds 1 to 1000 rows."""
    valid = isinstance(limit, int) and not isinstance(limit, bool) and 1 <= limit <= MAX_LIMIT
    _require(valid, "limit_value")
    return limit


def check_aggregation(filters: LogFilters, bucket: str | None, group_by: str | None) -> None:
    """A bucket count needs both bounds and a known bucket; grouping is optional."""
    _require(filters.since is not None, "since_required")
    _require(filters.until is not None, "until_required")
    _require(bucket is not None, "bucket_required")
    _require(bucket in BUCKETS, "bucket_value")
    _require(group_by is None or group_by in GROUPS, "group_by_value")


def all_of(clauses: Iterable[Column]) -> Column:
    """Conjunction; TRUE when there is nothing to check."""
    clauses = list(clauses)
    return functools.reduce(operator.and_, clauses) if clauses else F.lit(True)


def contains_ignoring_case(text: Column, part: str) -> Column:
    """Literal substring test; ``%``, ``_`` and ``\\`` mean themselves."""
    return F.contains(F.lower(text), F.lower(F.lit(part)))


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def attribute_equals(key: str, value: str, columns: Iterable[str] = ()) -> Column:
    """By the attribute's own column where there is one: that reaches the Parquet files."""
    own = promoted_column(key)
    if own in columns:
        return quoted(own) == F.lit(value)
    return F.element_at("attributes_search", F.lit(key)) == F.lit(value)


def time_clauses(
    filters: LogFilters, column: str = "timestamp", day: str | None = None
) -> list[Column]:
    """Half-open range on the instant, and the same range in whole days where ``day`` exists.

    Spark cannot derive the day folder from the instant, so the day bounds are what prunes them.
    """
    clauses = []
    if filters.since is not None:
        clauses.append(F.col(column) >= instant_literal(filters.since))
        if day:
            clauses.append(F.col(day) >= date_literal(filters.since))
    if filters.until is not None:
        clauses.append(F.col(column) < instant_literal(filters.until))
        if day:
            clauses.append(F.col(day) <= last_day_before(filters.until))
    return clauses


def build_predicate(
    filters: LogFilters, day: str | None = None, columns: Iterable[str] = ()
) -> Column:
    """AND of all given parts. Pass ``day="event_date"`` for day-partitioned tables, and the table's
    columns where some attributes have their own."""
    clauses = []
    if filters.service is not None:
        clauses.append(F.col("service") == F.lit(filters.service))
    if filters.level is not None:
        clauses.append(F.col("level") == F.lit(filters.level))
    clauses += time_clauses(filters, day=day)
    clauses += [attribute_equals(key, value, columns) for key, value in filters.attributes]
    if filters.q is not None:
        clauses.append(contains_ignoring_case(F.col("message"), filters.q))
    return all_of(clauses)


def day_column(df: DataFrame) -> str | None:
    return "event_date" if "event_date" in df.columns else None


def where_matching(logs: DataFrame, filters: LogFilters) -> DataFrame:
    """Rows of ``logs`` that ``filters`` select."""
    return logs.where(build_predicate(filters, day_column(logs), logs.columns))


def before_position(timestamp: str, id_: str, day: str | None = None) -> Column:
    """Rows after a position in newest-first order: (timestamp, id) < (t, i).

    The first term is implied by the second; it alone reaches the Parquet statistics.
    """
    at = instant_literal(timestamp)
    ts = F.col("timestamp")
    clauses = [ts <= at, (ts < at) | ((ts == at) & (F.col("id") < F.lit(id_)))]
    if day:
        clauses.append(F.col(day) <= date_literal(timestamp))
    return all_of(clauses)
