"""Timestamp texts as Spark expressions.

Accepted form: ``YYYY-MM-DDThh:mm:ss[.digits](Z|+hh:mm|-hh:mm)`` with any number of fraction
digits. Instants are kept to the microsecond; digits beyond that are cut, never rounded, so a row
and its minute count always agree.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallylog.fixed import TIMESTAMP_GRAMMAR
from tallylog.functions.binding import let


def matches_grammar(text: Column) -> Column:
    return text.rlike(TIMESTAMP_GRAMMAR)


def zone_offset_seconds(text: Column) -> Column:
    """Seconds east of UTC; null when the offset is out of range (beyond 14:00)."""
    hours = F.substring(text, -5, 2).try_cast("int")
    minutes = F.substring(text, -2, 2).try_cast("int")
    total = hours * 3600 + minutes * 60
    return F.when(text.endswith("Z"), F.lit(0)).when(
        (minutes <= 59) & (total <= 14 * 3600),
        F.when(F.substring(text, -6, 1) == "-", -total).otherwise(total),
    )


def whole_second(text: Column) -> Column:
    """UTC instant without its fraction; null when a calendar, clock or offset part is invalid.

    The first 19 characters have fixed positions, so the cast only judges the numbers.
    """
    local = F.concat(F.substring(text, 1, 19), F.lit("Z")).try_cast("timestamp")
    return F.timestamp_seconds(F.unix_seconds(local) - zone_offset_seconds(text))


def fraction_digits(text: Column) -> Column:
    """Digits after the decimal point, '' when there are none."""
    tail = F.when(text.endswith("Z"), F.lit(1)).otherwise(F.lit(6))
    return F.when(
        F.substring(text, 20, 1) == ".",
        F.substr(text, F.lit(21), F.length(text) - 20 - tail),
    ).otherwise(F.lit(""))


def with_fraction(second: Column, fraction: Column) -> Column:
    """Instant to the microsecond."""
    micros = F.rpad(F.substring(fraction, 1, 6), 6, "0").cast("long")
    return F.timestamp_micros(F.unix_micros(second) + micros)


def fraction_after(left: Column, right: Column) -> Column:
    """Compare two fractions of any length: without trailing zeros text order is number order."""
    zero = F.lit("0")
    return F.rtrim(left, zero) > F.rtrim(right, zero)


def is_after(second: Column, fraction: Column, limit: Column) -> Column:
    """True when (second, fraction) lies after ``limit``, which counts in whole milliseconds."""
    limit_ms = F.unix_millis(limit)
    limit_second = F.timestamp_seconds(F.floor(limit_ms / F.lit(1000)).cast("long"))
    limit_fraction = F.lpad(F.pmod(limit_ms, F.lit(1000)).cast("string"), 3, "0")
    return (second > limit_second) | (
        (second == limit_second) & fraction_after(fraction, limit_fraction)
    )


def _year_text(second: Column) -> Column:
    year = F.year(second)
    six = F.lpad(F.abs(year).cast("string"), 6, "0")
    return (
        F.when(year.between(0, 9999), F.lpad(year.cast("string"), 4, "0"))
        .when(year < 0, F.concat(F.lit("-"), six))
        .otherwise(F.concat(F.lit("+"), six))
    )


def canonical_parts(second: Column, fraction: Column) -> Column:
    """Canonical text: UTC, at least three fraction digits, no other trailing zeros."""
    padded = F.rpad(fraction, 3, "0")
    padded = F.when(F.length(fraction) < 3, padded).otherwise(fraction)
    trimmed = F.concat(
        F.substring(padded, 1, 3),
        F.rtrim(F.substr(padded, F.lit(4), F.length(padded)), F.lit("0")),
    )
    return F.concat(
        _year_text(second),
        F.date_format(second, "-MM-dd'T'HH:mm:ss"),
        F.lit("."),
        trimmed,
        F.lit("Z"),
    )


def _of_valid(text: Column, make) -> Column:
    """``make(second, fraction)`` of a text in the grammar, each part computed once."""

    def parts(t: Column) -> Column:
        both = F.struct(
            whole_second(t).alias("second"), fraction_digits(t).alias("fraction")
        )
        return F.when(matches_grammar(t), both)

    return let(text, lambda t: let(parts(t), lambda p: make(p["second"], p["fraction"])))


def canonical_timestamp(text: Column) -> Column:
    """Canonical UTC text of a timestamp text; null when it is not a valid timestamp."""
    return _of_valid(text, canonical_parts)


def parse_timestamp(text: Column) -> Column:
    """Instant of a timestamp text to the microsecond; null when it is not valid."""
    return _of_valid(text, with_fraction)


def timestamp_text(ts: Column) -> Column:
    """Canonical text of a stored instant."""
    micros = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.regexp_replace(micros, r"(\.[0-9]{3}[0-9]*?)0*Z$", "$1Z")


def day_name(day: Column) -> Column:
    """``logs_YYYYMMDD`` for a date or instant."""
    return F.concat(F.lit("logs_"), F.date_format(day, "yyyyMMdd"))


# --- the same rules for one Python argument ---------------------------------

_GRAMMAR = re.compile(
    r"([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})"
    r"(?:\.([0-9]+))?(?:Z|([+-])([0-9]{2}):([0-9]{2}))"
)
_EPOCH = dt.date(1970, 1, 1).toordinal()
_DAYS_IN_400_YEARS = 146097
_DAY_MICROS = 86400000000


def argument_instant(text: str) -> tuple[int, str] | None:
    """(epoch second, fraction without trailing zeros) of an argument, None when invalid.

    The pair orders like the instants on all digits.
    """
    match = _GRAMMAR.fullmatch(text)
    if match is None:
        return None
    year, month, day, hour, minute, second = (int(part) for part in match.groups()[:6])
    cycle = 0 if year else 1  # datetime has no year 0; the calendar repeats every 400 years
    try:
        ordinal = dt.date(year + 400 * cycle, month, day).toordinal()
        dt.time(hour, minute, second)
    except ValueError:
        return None
    east = 0
    if match[8]:
        oh, om = int(match[9]), int(match[10])
        if om > 59 or oh * 60 + om > 14 * 60:
            return None
        east = (oh * 3600 + om * 60) * (1 if match[8] == "+" else -1)
    days = ordinal - cycle * _DAYS_IN_400_YEARS - _EPOCH
    return days * 86400 + hour * 3600 + minute * 60 + second - east, (match[7] or "").rstrip("0")


def argument_micros(text: str) -> int:
    """Epoch microseconds of a valid argument text."""
    second, fraction = argument_instant(text)
    return second * 1000000 + int(fraction[:6].ljust(6, "0"))


def argument_canonical(text: str) -> str:
    """Canonical UTC text of a valid argument text."""
    return _canonical(*argument_instant(text))


def micros_canonical(micros: int) -> str:
    """Canonical UTC text of epoch microseconds."""
    second, rest = divmod(micros, 1000000)
    return _canonical(second, f"{rest:06d}".rstrip("0"))


def _canonical(second: int, fraction: str) -> str:
    days, rest = divmod(second, 86400)
    ordinal = days + _EPOCH
    cycle = 0 if ordinal >= 1 else 1
    if ordinal > dt.date.max.toordinal():
        cycle = -1
    date = dt.date.fromordinal(ordinal + cycle * _DAYS_IN_400_YEARS)
    year = date.year - 400 * cycle
    year_text = f"{year:04d}" if 0 <= year <= 9999 else f"{'-' if year < 0 else '+'}{abs(year):06d}"
    clock = f"{rest // 3600:02d}:{rest % 3600 // 60:02d}:{rest % 60:02d}"
    return f"{year_text}-{date:%m-%d}T{clock}.{fraction.ljust(3, '0')}Z"


def instant_literal(text: str) -> Column:
    """A TIMESTAMP literal for a valid argument text; folded to a constant, so it pushes down."""
    return F.timestamp_micros(F.lit(argument_micros(text)))


def date_literal(text: str) -> Column:
    """The UTC day of a valid argument text."""
    return F.date_from_unix_date(F.lit(argument_micros(text) // _DAY_MICROS))


def last_day_before(text: str) -> Column:
    """The UTC day of the last instant before an argument: midnight belongs to the next day."""
    return F.date_from_unix_date(F.lit((argument_micros(text) - 1) // _DAY_MICROS))
