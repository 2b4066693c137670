"""Newest-first pages with stable continuation."""

from __future__ import annotations

import base64
import binascii
import dataclasses
import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallylog.fixed import ARGUMENT, DEFAULT_LIMIT
from tallylog.functions.binding import let
from tallylog.functions.timestamps import (
    argument_canonical,
    argument_instant,
    argument_micros,
    canonical_timestamp,
    micros_canonical,
    timestamp_text,
)
from tallylog.operators.aggregate import MINUTE_MICROS, can_use_rollup, rollup_bucket_count
from tallylog.operators.filters import (
    LogFilters,
    before_position,
    check_limit,
    code_units,
    day_column,
    where_matching,
)
from tallylog.schema import PUBLIC_COLUMNS
from tallylog.session import settle

# Names the order a token continues. Sources that must exchange tokens agree on one text.
SEMANTICS = "timestamp-desc-id-desc.v1"
TOKEN_VERSION = 1


def newest_first(logs: DataFrame) -> DataFrame:
    """Timestamp descending, then id descending."""
    return logs.orderBy(F.desc("timestamp"), F.desc("id"))


def oldest_first(logs: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` oldest rows: timestamp, then id, ascending."""
    return logs.orderBy("timestamp", "id").limit(limit)


def find_page(
    logs: DataFrame,
    filters: LogFilters = LogFilters(),
    limit: int = DEFAULT_LIMIT,
    position: tuple[str, str] | None = None,
) -> DataFrame:
    """The next ``limit + 1`` public rows after ``position`` (timestamp text, id).

    The extra row only tells whether there is more. Each task keeps its own newest rows, so no
    full sort takes place.
    """
    return _page_rows(logs, filters, limit, position, PUBLIC_COLUMNS)


def _page_rows(logs, filters, limit, position, columns) -> DataFrame:
    check_limit(limit)
    rows = where_matching(logs, filters)
    if position is not None:
        rows = rows.where(before_position(*position, day=day_column(logs)))
    return newest_first(rows.select(*columns)).limit(limit + 1)


# Any instant; for bounds that are not given.
_EARLIEST, _LATEST = "0001-01-01T00:00:00.000Z", "9999-12-31T00:00:00.000Z"


def page_floor(
    rollup: DataFrame,
    filters: LogFilters,
    limit: int = DEFAULT_LIMIT,
    position: tuple[str, str] | None = None,
) -> int | None:
    """Epoch microseconds of the minute from which on a page surely is full, by the minute counts;
    None where fewer rows than that are counted.

    Whole minutes before the upper bound are summed up newest first. Each has a row at least, so the
    newest ``limit + 1`` of them are enough, and no more reach the driver. Counts may outlive rows
    only where all older rows are gone, too (as in retention by days).
    """
    check_limit(limit)
    uppers = [argument_micros(text) for text in (filters.until, position and position[0]) if text]
    high = (min(uppers) if uppers else argument_micros(_LATEST)) // MINUTE_MICROS * MINUTE_MICROS
    low = argument_micros(filters.since or _EARLIEST)
    if low >= high:
        return None
    window = dataclasses.replace(filters, since=filters.since or _EARLIEST, until=micros_canonical(high))
    minutes = rollup_bucket_count(rollup, window, "1m").where("count > 0")
    newest = minutes.orderBy(F.desc("bucket_start")).limit(limit + 1)
    total = 0
    for row in newest.select(F.unix_micros("bucket_start").alias("at"), "count").collect():
        total += row["count"]
        if total > limit:
            return row["at"]
    return None


def _rows_from(logs: DataFrame, micros: int) -> DataFrame:
    """Rows from an instant on, in whole days, too, where the rows have their day."""
    low = F.timestamp_micros(F.lit(micros))
    rows = logs.where(F.col("timestamp") >= low)
    return rows.where(F.col("event_date") >= F.to_date(low)) if day_column(logs) else rows


def newest_page(
    logs: DataFrame,
    filters: LogFilters,
    limit: int = DEFAULT_LIMIT,
    position: tuple[str, str] | None = None,
    first_days: int = 1,
    rollup: DataFrame | None = None,
) -> DataFrame:
    """The rows of :func:`find_page`, read with as little as possible.

    With minute counts, and filters they know, one small read of these says how far back the page
    reaches (:func:`page_floor`), and the logs are read from there on, once.

    Without them, first only the ordering and filter columns are read, of the newest ``first_days`` day folders,
    then of twice as many, and so on until the page is full or ``since`` is reached. That settles
    how old the page's last row is, and messages and attributes are read from there on only.
    Needs an ``event_date`` column, ``since``, and ``until`` or a position.
    """
    if rollup is not None and can_use_rollup(filters):
        floor = page_floor(rollup, filters, limit, position)
        return find_page(logs if floor is None else _rows_from(logs, floor), filters, limit, position)
    if filters.since is None or (filters.until is None and position is None):
        raise ValueError("a page over day folders needs 'since' and 'until' or a position")
    uppers = [text for text in (filters.until, position and position[0]) if text]
    day_of = lambda text: argument_micros(text) // 86400000000
    newest, oldest = min(day_of(text) for text in uppers), day_of(filters.since)
    days = first_days
    while True:
        low = max(oldest, newest - days + 1)
        recent = logs.where(F.col("event_date") >= F.date_from_unix_date(F.lit(low)))
        keys = _page_rows(recent, filters, limit, position, ("timestamp", "id"))
        found = keys.agg(
            F.count("*").alias("rows"), F.unix_micros(F.min("timestamp")).alias("last")
        ).first()
        if low == oldest or found["rows"] > limit:
            break
        days *= 2
    if found["last"] is not None:
        recent = _rows_from(recent, found["last"])
    return find_page(recent, filters, limit, position)


def page_position(page: DataFrame, limit: int) -> DataFrame:
    """(timestamp, id) of the last row a page shows: the smallest of its first ``limit`` rows."""
    shown = newest_first(page.select("timestamp", "id")).limit(limit)
    return shown.agg(F.min(F.struct("timestamp", "id")).alias("last")).select(
        "last.timestamp", "last.id"
    )


# --- continuation tokens ----------------------------------------------------


def filter_json(filters: LogFilters, semantics: str = SEMANTICS) -> str:
    """Canonical JSON of a filter set: fixed key order, null for absent, attributes sorted."""
    pairs = sorted(filters.attributes, key=lambda p: (code_units(p[0]), code_units(p[1])))
    fields = {
        "semantics": semantics,
        "service": filters.service,
        "level": filters.level,
        "since": filters.since,
        "until": filters.until,
        "q": filters.q,
        "attributes": [list(pair) for pair in pairs],
    }
    return json.dumps(fields, ensure_ascii=False, separators=(",", ":"))


def filter_fingerprint(filters: LogFilters, semantics: str = SEMANTICS) -> str:
    """SHA-256 of the canonical JSON. The page size is not part of it."""
    return hashlib.sha256(filter_json(filters, semantics).encode("utf-8")).hexdigest()


def fingerprint_column(
    service: Column, level: Column, since: Column, until: Column, semantics: str = SEMANTICS
) -> Column:
    """The fingerprint of many filter sets at once, one per row (no q, no attributes)."""
    fields = F.struct(
        F.lit(semantics).alias("semantics"),
        service.alias("service"),
        level.alias("level"),
        since.alias("since"),
        until.alias("until"),
        F.lit(None).cast("string").alias("q"),
        F.array().cast("array<array<string>>").alias("attributes"),
    )
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def base64url(text: Column) -> Column:
    """Base64 with ``-_`` and without padding or line breaks."""
    return F.translate(F.base64(F.encode(text, "utf-8")), "+/=\r\n", "-_")


def unbase64url(token: Column) -> Column:
    """Text of a base64url token; null when it is not one."""
    filled = F.concat(
        F.translate(token, "-_", "+/"),
        F.repeat(F.lit("="), F.pmod(-F.length(token), F.lit(4))),
    )
    decoded = F.try_to_binary(filled, F.lit("base64")).cast("string")
    return F.when(token.rlike(r"^[A-Za-z0-9_-]+\z"), decoded)


def encode_token(timestamp_text_: Column, id_: Column, fingerprint: Column | str) -> Column:
    """Token of a position: base64url JSON with version, timestamp, id and fingerprint."""
    mark = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint
    payload = F.concat(
        F.lit(f'{{"version":{TOKEN_VERSION},"timestamp":"'),
        timestamp_text_,
        F.lit('","id":"'),
        id_,
        F.lit('","filterFingerprint":"'),
        mark,
        F.lit('"}'),
    )
    return base64url(payload)


_PAYLOAD = (
    r'^\{"version":1,"timestamp":"([0-9TZ:.+-]+)",'
    r'"id":"([0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12})",'
    r'"filterFingerprint":"([0-9a-f]{64})"\}'
)


def decode_token(token: Column, fingerprint: Column | str) -> Column:
    """``struct<timestamp:string,id:string>``, or null for any token not made for this filter."""
    mark = F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint
    pattern = _PAYLOAD + r"\z"

    def position(text: Column) -> Column:
        timestamp = F.regexp_extract(text, pattern, 1)
        valid = (
            text.rlike(pattern)
            & (F.regexp_extract(text, pattern, 3) == mark)
            & (canonical_timestamp(timestamp) == timestamp)
            & (base64url(text) == token)
        )
        found = F.struct(
            timestamp.alias("timestamp"), F.regexp_extract(text, pattern, 2).alias("id")
        )
        return F.when(valid, found)

    return let(unbase64url(token), position)


def decode_cursor(token: str, filters: LogFilters) -> tuple[str, str]:
    """Position of one token argument; ValueError when it does not belong to ``filters``."""
    if not token:
        raise ValueError(ARGUMENT["cursor_value"])
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
        text = raw.decode("utf-8")
    except (binascii.Error, ValueError):
        raise ValueError(ARGUMENT["cursor_invalid"]) from None
    match = re.fullmatch(_PAYLOAD, text)
    same_text = base64.urlsafe_b64encode(raw).decode().rstrip("=") == token
    if (
        not same_text
        or match is None
        or argument_instant(match[1]) is None
        or argument_canonical(match[1]) != match[1]
        or match[3] != filter_fingerprint(filters)
    ):
        raise ValueError(ARGUMENT["cursor_invalid"])
    return match[1], match[2]


def format_page(page: DataFrame, filters: LogFilters, limit: int) -> DataFrame:
    """One row ``(logs, next_cursor)`` from the ``limit + 1`` rows of :func:`find_page`.

    ``logs`` is newest first; ``next_cursor`` is null on the last page. At most 1001 rows are
    gathered, because :func:`find_page` stops there.
    """
    row = F.struct(
        "timestamp", "id", *(c for c in PUBLIC_COLUMNS if c not in ("timestamp", "id"))
    )
    gathered = page.agg(F.sort_array(F.collect_list(row), asc=False).alias("rows"))
    public = lambda r: F.struct(
        r["id"].alias("id"),
        timestamp_text(r["timestamp"]).alias("timestamp"),
        *(r[c].alias(c) for c in ("level", "service", "message", "attributes")),
    )
    shown = gathered.select(
        F.transform(F.slice("rows", 1, limit), public).alias("logs"),
        (F.size("rows") > limit).alias("has_more"),
    )
    last = F.element_at("logs", -1)
    token = encode_token(last["timestamp"], last["id"], filter_fingerprint(filters))
    return shown.select("logs", F.when(F.col("has_more"), token).alias("next_cursor"))


def list_logs(
    logs: DataFrame,
    filters: LogFilters = LogFilters(),
    limit: int = DEFAULT_LIMIT,
    cursor: str | None = None,
    rollup: DataFrame | None = None,
) -> DataFrame:
    """One page ``(logs, next_cursor)``, continued from ``cursor`` when given.

    With minute counts that can answer the filters, or where the rows carry their day and the page
    has both bounds, logs are read only as far back as the page needs.
    """
    position = decode_cursor(cursor, filters) if cursor is not None else None
    if rollup is not None and can_use_rollup(filters):
        return format_page(newest_page(logs, filters, limit, position, rollup=rollup), filters, limit)
    bounded = filters.since is not None and (filters.until is not None or position is not None)
    read = newest_page if bounded and "event_date" in logs.columns else find_page
    return format_page(read(logs, filters, limit, position), filters, limit)


def page_json(formatted: DataFrame) -> DataFrame:
    """A formatted page as one JSON text; attributes become objects again."""
    item = lambda r: F.struct(
        *(r[c].alias(c) for c in ("id", "timestamp", "level", "service", "message")),
        F.parse_json(r["attributes"]).alias("attributes"),
    )
    return formatted.select(
        F.to_json(
            F.struct(F.transform("logs", item).alias("logs"), "next_cursor"),
            {"ignoreNullFields": "false"},
        ).alias("json")
    )


# --- all pages at once ------------------------------------------------------

_INDEX_BITS = 33


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``position`` (from 0) and ``total`` in a total order, without sorting in one task.

    Rows are range-partitioned by the order and written once, so that a row's partition and its
    place therein are settled. Partition sizes (one row per shuffle partition, so small enough to
    broadcast) then give the offsets. Large groups should not tie: ranges split between keys.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    placed = settle(placed)
    part = F.shiftright("_at", _INDEX_BITS)
    index = F.col("_at").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    by_part = Window.orderBy("_part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    all_parts = by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select(
        "_part",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        F.sum("_size").over(all_parts).alias("total"),
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn("position", F.col("_offset") + index)
        .drop("_at", "_part", "_offset")
    )


def page_all(logs: DataFrame, filters: LogFilters, page_size: int) -> DataFrame:
    """Every matching row with its ``position`` and ``page`` (from 1), newest first.

    The pages are those a reader gets by following continuation tokens on unchanged data.
    """
    check_limit(page_size)
    # rows are dealt out once and numbered where they land
    rows = numbered(where_matching(logs, filters), F.desc("timestamp"), F.desc("id"))
    return rows.withColumn("page", F.floor(F.col("position") / page_size).cast("long") + 1)


def page_index(logs: DataFrame, filters: LogFilters, page_size: int) -> DataFrame:
    """One row per page: rows, its last position and the token that continues after it.

    The last page has no token. Only the ordering columns are sorted and written.
    """
    keys = where_matching(logs, filters).select("timestamp", "id")
    pages = (
        page_all(keys, LogFilters(), page_size)
        .groupBy("page")
        .agg(
            F.count("*").alias("rows"),
            F.min(F.struct("timestamp", "id")).alias("last"),
            (F.max("position") + 1 < F.max("total")).alias("has_more"),
        )
    )
    text = timestamp_text(F.col("last.timestamp"))
    token = encode_token(text, F.col("last.id"), filter_fingerprint(filters))
    return pages.select(
        "page",
        "rows",
        text.alias("last_timestamp"),
        F.col("last.id").alias("last_id"),
        F.when(F.col("has_more"), token).alias("token"),
    )
