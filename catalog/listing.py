"""Filters and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    DAY,
    MONTH,
    PUBLIC,
    WEEK,
    WITH_LOGS,
    between,
    canonical,
    documents,
    logs,
    shown,
    sql_time,
    table,
)
from tallylog.functions.timestamps import timestamp_text
from tallylog.operators import audit, paging
from tallylog.operators.filters import LogFilters, where_matching
from tallylog.operators.rollup import build_rollup
from tallylog.plans.scenarios import scenarios
from tallylog.session import fresh_path
from tallylog.sources.tables import append_logs, scan_logs

NEEDLE = "nEeDlE_%\\pAtH"
SCENARIOS = scenarios(DAY["since"], WEEK["since"], DAY["until"], attribute=("k", "69"), q=NEEDLE)
PAGE_LIMIT = 100
POSITION = ("2024-01-26T12:00:00.000Z", "00000000-0000-4000-8000-000000005000")


def _filtered(**arguments):
    filters = LogFilters(**arguments)

    def run(spark, sf_dir):
        return shown(where_matching(logs(spark, sf_dir), filters))

    return run


def _filter_sql(condition: str) -> str:
    return f"{WITH_LOGS} SELECT {PUBLIC} FROM logs WHERE {condition}"


_FILTERS = {
    "filter_none": ({}, "TRUE"),
    "filter_service": ({"service": "service-042"}, "service = 'service-042'"),
    "filter_empty_service": ({"service": ""}, "service = ''"),
    "filter_level": ({"level": "warn"}, "level = 'warn'"),
    "filter_since": (
        {"since": "2024-01-20T06:30:00.25+02:00"},
        f"timestamp >= {sql_time('2024-01-20T04:30:00.25Z')}",
    ),
    "filter_until": (
        {"until": "2024-01-05T12:00:00Z"},
        f"timestamp < {sql_time('2024-01-05T12:00:00Z')}",
    ),
    "filter_equal_bounds": (
        {"since": "2024-01-05T12:00:00Z", "until": "2024-01-05T12:00:00Z"},
        "FALSE",
    ),
    "filter_attribute": ({"attributes": {"k": "69"}}, "k = '69'"),
    "filter_no_attribute": ({"attributes": {"k": "69", "other": "1"}}, "FALSE"),
    "filter_attribute_and_level": (
        {"attributes": {"k": "69"}, "level": "info"},
        "k = '69' AND level = 'info'",
    ),
    "filter_text": ({"q": NEEDLE}, r"contains(lower(message), 'needle_%\path')"),
    "filter_text_percent": ({"q": "%"}, "contains(message, '%')"),
    "filter_all_parts": (
        {
            "service": "service-007",
            "level": "info",
            "attributes": {"k": "12"},
            "q": "ORDINARY",
            **MONTH,
        },
        "service = 'service-007' AND level = 'info' AND k = '12' "
        f"AND contains(lower(message), 'ordinary') AND {between(MONTH)}",
    ),
}


def search_documents(spark, sf_dir):
    """Whole documents as messages."""
    found = where_matching(documents(spark, sf_dir), LogFilters(q="The"))
    return found.select("id", F.length("message").alias("length"))


def search_documents_percent(spark, sf_dir):
    found = where_matching(documents(spark, sf_dir), LogFilters(q="%"))
    return found.select("id", F.length("message").alias("length"))


def _scenario_page(name):
    def run(spark, sf_dir):
        page = SCENARIOS[name].run(logs(spark, sf_dir))
        return shown(page)

    return run


def continued_page(spark, sf_dir):
    return shown(paging.find_page(logs(spark, sf_dir), LogFilters(), PAGE_LIMIT, POSITION))


def _hourly(spark, sf_dir):
    """Times cut to the hour, so that ids must break ties."""
    rows = logs(spark, sf_dir)
    return rows.withColumn("timestamp", F.date_trunc("hour", "timestamp"))


def tied_page(spark, sf_dir):
    return shown(paging.find_page(_hourly(spark, sf_dir), LogFilters(**WEEK), PAGE_LIMIT))


def widening_page(spark, sf_dir):
    """The page that looks back only as far as it must gives the rows of a full scan."""
    filters = LogFilters(service="service-007", **MONTH)
    return shown(paging.newest_page(logs(spark, sf_dir), filters, PAGE_LIMIT))


def _guided_page(filters, position=None):
    """A page that minute counts bound."""

    def run(spark, sf_dir):
        rows = logs(spark, sf_dir)
        counts = build_rollup(rows)
        return shown(paging.newest_page(rows, filters, PAGE_LIMIT, position, rollup=counts))

    return run


_GUIDED = ("recent_page", "service_page", "level_page")


def promoted_attribute_page(spark, sf_dir):
    """The attribute page on a stored table that keeps the attribute in a column of its own."""
    path = fresh_path(spark, "promoted")
    append_logs(logs(spark, sf_dir), path, promoted=["k"])
    return shown(SCENARIOS["attribute_page"].run(scan_logs(spark, path, promoted=["k"])))


def filter_two_attributes(spark, sf_dir):
    """Two attributes that rows have: the given one and one that repeats the level."""
    rows = logs(spark, sf_dir)
    more = F.map_concat("attributes_search", F.create_map(F.lit("severity"), F.col("level")))
    found = where_matching(rows.withColumn("attributes_search", more), LogFilters(attributes={"k": "69", "severity": "error"}))
    return shown(found)


def formatted_page(spark, sf_dir):
    filters = LogFilters(**WEEK)
    page = paging.list_logs(logs(spark, sf_dir), filters, PAGE_LIMIT)
    return page.select("next_cursor", F.inline("logs"))


def next_page(spark, sf_dir):
    """The page behind a token."""
    filters = LogFilters(**WEEK)
    token = (
        spark.range(1)
        .select(
            paging.encode_token(
                F.lit(POSITION[0]), F.lit(POSITION[1]), paging.filter_fingerprint(filters)
            ).alias("t")
        )
        .first()["t"]
    )
    page = paging.list_logs(logs(spark, sf_dir), filters, PAGE_LIMIT, cursor=token)
    return page.select(F.inline("logs"))


def page_positions(spark, sf_dir):
    page = paging.find_page(_hourly(spark, sf_dir), LogFilters(**WEEK), PAGE_LIMIT)
    return shown(paging.page_position(page, PAGE_LIMIT), "timestamp", "id")


def page_all(spark, sf_dir):
    rows = paging.page_all(_hourly(spark, sf_dir), LogFilters(), PAGE_LIMIT)
    return rows.select("id", timestamp_text(F.col("timestamp")).alias("timestamp"), "page")


def page_index(spark, sf_dir):
    return paging.page_index(logs(spark, sf_dir), LogFilters(**MONTH), PAGE_LIMIT)


def decoded_tokens(spark, sf_dir):
    """Tokens of all rows; every fifth is made for another filter and must not be accepted."""
    mine, other = (paging.filter_fingerprint(LogFilters(service=s)) for s in ("a", "b"))
    mark = F.when(F.substring("id", -1, 1).isin("0", "5"), F.lit(other)).otherwise(F.lit(mine))
    tokens = logs(spark, sf_dir).select(
        F.col("id").alias("row_id"),
        paging.encode_token(timestamp_text(F.col("timestamp")), F.col("id"), mark).alias("token"),
    )
    position = paging.decode_token(F.col("token"), mine)
    return tokens.select(
        "row_id", position["timestamp"].alias("timestamp"), position["id"].alias("id")
    )


def fingerprints(spark, sf_dir):
    pairs = logs(spark, sf_dir).select("service", "level").distinct()
    return pairs.select(
        "service",
        "level",
        paging.fingerprint_column(
            F.col("service"), F.col("level"), F.lit("2024-01-01T00:00:00.000Z"), F.lit(None)
        ).alias("fingerprint"),
    )


def oldest_batch(spark, sf_dir):
    return shown(paging.oldest_first(_hourly(spark, sf_dir), 1000), "timestamp", "id")


def audited_rows(spark, sf_dir):
    rows = shown(logs(spark, sf_dir))
    bad_id = F.when(F.col("level") == "error", F.lit("not-an-id")).otherwise(F.col("id"))
    return audit.audit_result_rows(rows.withColumn("id", bad_id)).select("message", "id")


def conversation_search(spark, sf_dir):
    """Turns of conversations as messages."""
    turns = table(spark, sf_dir, "conversations")
    messages = turns.select(
        "conv_id", "turn", "role", F.col("text").alias("message")
    )
    return where_matching(messages, LogFilters(q="The ")).select("conv_id", "turn", "role")


QUERIES = {name: _filtered(**arguments) for name, (arguments, _) in _FILTERS.items()}
QUERIES.update({f"scenario_{n}": _scenario_page(n) for n, s in SCENARIOS.items() if not s.bucket})
QUERIES.update({f"guided_{n}": _guided_page(SCENARIOS[n].filters) for n in _GUIDED})
QUERIES["guided_continued_page"] = _guided_page(LogFilters(service="service-007"), POSITION)
QUERIES.update(
    {
        f.__name__: f
        for f in (
            search_documents,
            search_documents_percent,
            continued_page,
            tied_page,
            widening_page,
            promoted_attribute_page,
            filter_two_attributes,
            formatted_page,
            next_page,
            page_positions,
            page_all,
            page_index,
            decoded_tokens,
            fingerprints,
            oldest_batch,
            audited_rows,
            conversation_search,
        )
    }
)

_NEWEST = "ORDER BY timestamp DESC, id DESC"
_HOURLY = f"{WITH_LOGS}, hourly AS (SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp) FROM logs)"


def _page_sql(condition: str, limit: int = PAGE_LIMIT + 1) -> str:
    return (
        f"{WITH_LOGS}, page AS (SELECT * FROM logs WHERE {condition} {_NEWEST} LIMIT {limit}) "
        f"SELECT {PUBLIC} FROM page"
    )


def _token_sql(timestamp: str, id_: str, fingerprint: str) -> str:
    payload = (
        f"""'{{"version":1,"timestamp":"' || {timestamp} || '","id":"' || {id_} || """
        f"""'","filterFingerprint":"' || {fingerprint} || '"}}'"""
    )
    return f"rtrim(translate(to_base64(encode({payload})), '+/', '-_'), '=')"


def _fingerprint_sql(filters: LogFilters) -> str:
    return f"sha256('{paging.filter_json(filters)}')"


_AFTER = (
    f"(timestamp < {sql_time(POSITION[0])} OR "
    f"(timestamp = {sql_time(POSITION[0])} AND id < '{POSITION[1]}'))"
)

ORACLES = {name: _filter_sql(condition) for name, (_, condition) in _FILTERS.items()}
ORACLES.update(
    {
        "search_documents": """SELECT
            '00000000-0000-4000-8000-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id,
            CAST(length(text) AS INTEGER) AS length FROM documents
            WHERE contains(lower(text), 'the')""",
        "search_documents_percent": """SELECT
            '00000000-0000-4000-8000-' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS id,
            CAST(length(text) AS INTEGER) AS length FROM documents WHERE contains(text, '%')""",
        "conversation_search": """SELECT conv_id, turn, role FROM conversations
            WHERE contains(lower(text), 'the ')""",
        "scenario_recent_page": _page_sql(between(DAY)),
        "scenario_service_page": _page_sql(f"service = 'service-007' AND {between(WEEK)}"),
        "scenario_level_page": _page_sql(f"level = 'error' AND {between(WEEK)}"),
        "scenario_attribute_page": _page_sql(f"k = '69' AND {between(WEEK)}"),
        "scenario_search_page": _page_sql(
            r"contains(lower(message), 'needle_%\path') AND " + between(WEEK)
        ),
        "continued_page": _page_sql(_AFTER),
        "guided_continued_page": _page_sql(f"service = 'service-007' AND {_AFTER}"),
        "promoted_attribute_page": _page_sql(f"k = '69' AND {between(WEEK)}"),
        "filter_two_attributes": _filter_sql("k = '69' AND level = 'error'"),
        "tied_page": f"""{_HOURLY},
            page AS (SELECT * FROM hourly WHERE {between(WEEK)} {_NEWEST} LIMIT 101)
            SELECT {PUBLIC} FROM page""",
        "widening_page": _page_sql(f"service = 'service-007' AND {between(MONTH)}"),
        "formatted_page": f"""{WITH_LOGS},
            page AS (SELECT * FROM logs WHERE {between(WEEK)} {_NEWEST} LIMIT 100),
            total AS (SELECT count(*) AS n FROM logs WHERE {between(WEEK)}),
            last AS (SELECT {canonical("timestamp")} AS t, id AS i FROM page
              ORDER BY timestamp, id LIMIT 1)
            SELECT CASE WHEN n > 100 THEN
              {_token_sql("t", "i", _fingerprint_sql(LogFilters(**WEEK)))} END AS next_cursor,
            {PUBLIC} FROM page, last, total""",
        "next_page": _page_sql(f"{between(WEEK)} AND {_AFTER}", PAGE_LIMIT),
        "page_positions": f"""{_HOURLY},
            page AS (SELECT * FROM hourly WHERE {between(WEEK)} {_NEWEST} LIMIT 100)
            SELECT {canonical("timestamp")} AS timestamp, id FROM page
            QUALIFY row_number() OVER (ORDER BY page.timestamp, page.id) = 1""",
        "page_all": f"""{_HOURLY}, numbered AS (SELECT *,
              row_number() OVER ({_NEWEST}) - 1 AS n FROM hourly)
            SELECT id, {canonical("timestamp")} AS timestamp, CAST(n // 100 + 1 AS BIGINT) AS page
            FROM numbered""",
        "page_index": f"""{WITH_LOGS}, numbered AS (SELECT *,
              (row_number() OVER ({_NEWEST}) - 1) // 100 + 1 AS page FROM logs
              WHERE {between(MONTH)}),
            pages AS (SELECT CAST(page AS BIGINT) AS page, count(*) AS rows,
              arg_min({canonical("timestamp")}, (timestamp, id)) AS last_timestamp,
              arg_min(id, (timestamp, id)) AS last_id FROM numbered GROUP BY 1)
            SELECT page, rows, last_timestamp, last_id,
            CASE WHEN page < (SELECT max(page) FROM pages) THEN
              {_token_sql("last_timestamp", "last_id", _fingerprint_sql(LogFilters(**MONTH)))}
              END AS token FROM pages""",
        "decoded_tokens": f"""{WITH_LOGS}
            SELECT id AS row_id,
            CASE WHEN right(id, 1) NOT IN ('0', '5') THEN {canonical("timestamp")} END
              AS timestamp,
            CASE WHEN right(id, 1) NOT IN ('0', '5') THEN id END AS id FROM logs""",
        "fingerprints": f"""{WITH_LOGS}, pairs AS (SELECT DISTINCT service, level FROM logs)
            SELECT service, level, sha256('{{"semantics":"{paging.SEMANTICS}","service":"' || service
            || '","level":"' || level || '","since":"2024-01-01T00:00:00.000Z","until":null,'
            || '"q":null,"attributes":[]}}') AS fingerprint FROM pairs""",
        "oldest_batch": f"""{_HOURLY},
            page AS (SELECT * FROM hourly ORDER BY timestamp, id LIMIT 1000)
            SELECT {canonical("timestamp")} AS timestamp, id FROM page""",
        "audited_rows": f"""{WITH_LOGS} SELECT message, 'not-an-id' AS id FROM logs
            WHERE level = 'error'""",
    }
)
ORACLES.update({f"guided_{n}": ORACLES[f"scenario_{n}"] for n in _GUIDED})
