import base64
import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from helpers import log_frame, log_id, plan_text
from tallylog.operators import paging
from tallylog.operators.filters import LogFilters
from tallylog.operators.rollup import build_rollup
from tallylog.sources.tables import append_logs, scan_logs, scan_rollup

# Two rows of one instant, one a microsecond older, one whose fraction ends in zeros, two on other hours.
ROWS = [
    (6, "2025-11-02T04:15:07.654321Z", "warn", "ledger", "Refund REFUSED for 100% of a_b \\ c", {"tries": "2", "dry": "false"}),
    (5, "2025-11-02T04:15:07.654321Z", "info", "ledger", "of the same instant, with a smaller id", {"tries": "2", "dry": "true"}),
    (4, "2025-11-02T04:15:07.654320Z", "debug", "mailer", "a microsecond before", {"tries": "02"}),
    (3, "2025-11-02T04:15:07.654300Z", "debug", "ledger", "zeros at the end of the fraction", {}),
    (2, "2025-11-02T03:45:00.000000Z", "info", "crawler", "some time before", {"zero": "-0"}),
    (1, "2025-11-02T02:00:00.000000Z", "error", "mailer", "the oldest one", {"dry": "false"}),
]
ALL = LogFilters()


@pytest.fixture(scope="module")
def logs(spark):
    return log_frame(spark, ROWS).repartition(4).cache()


def _walk(logs, filters, limit):
    pages, cursor = [], None
    while True:
        page = paging.list_logs(logs, filters, limit, cursor).first()
        pages.append([int(r["id"][-3:]) for r in page["logs"]])
        cursor = page["next_cursor"]
        if cursor is None:
            return pages


def test_pages_follow_on(logs):
    assert _walk(logs, ALL, 2) == [[6, 5], [4, 3], [2, 1]]
    assert _walk(logs, ALL, 4) == [[6, 5, 4, 3], [2, 1]]
    assert _walk(logs, ALL, 6) == [[6, 5, 4, 3, 2, 1]]
    assert _walk(logs, LogFilters(service="missing"), 2) == [[]]


def test_all_pages_at_once_are_the_same(logs):
    for size in (1, 2, 4, 1000):
        rows = paging.page_all(logs, ALL, size).orderBy("position").collect()
        pages = {}
        for r in rows:
            pages.setdefault(r["page"], []).append(int(r["id"][-3:]))
        assert list(pages.values()) == _walk(logs, ALL, size)
        assert [r["position"] for r in rows] == list(range(6))


def test_page_index_tokens_continue(logs):
    index = paging.page_index(logs, ALL, 2).orderBy("page").collect()
    assert [(r["page"], r["rows"], int(r["last_id"][-3:])) for r in index] == [
        (1, 2, 5),
        (2, 2, 3),
        (3, 2, 1),
    ]
    assert index[2]["token"] is None
    page = paging.list_logs(logs, ALL, 2, index[0]["token"]).first()
    assert [int(r["id"][-3:]) for r in page["logs"]] == [4, 3]
    assert page["next_cursor"] == index[1]["token"]


def test_public_columns_and_texts(logs):
    page = paging.list_logs(logs, ALL, 4).first()["logs"]
    assert list(page[0].asDict()) == ["id", "timestamp", "level", "service", "message", "attributes"]
    assert [r["timestamp"][20:] for r in page] == ["654321Z", "654321Z", "65432Z", "6543Z"]
    text = json.loads(paging.page_json(paging.list_logs(logs, ALL, 1)).first()["json"])
    assert text["logs"][0]["attributes"] == {"tries": "2", "dry": "false"}
    assert set(text) == {"logs", "next_cursor"}


def test_combined_filters(logs):
    filters = LogFilters(
        service="ledger",
        level="warn",
        since="2025-11-02T04:15:07.654321Z",
        until="2025-11-02T04:15:07.654322Z",
        attributes={"tries": "2", "dry": "false"},
        q="refund refused",
    )
    assert _walk(logs, filters, 10) == [[6]]


def test_continuation_while_rows_come_and_go(spark):
    at = "2026-08-09T11:00:00.000Z"
    rows = [(n, at, "info", "s", f"original {n}", {}) for n in (1, 2, 3, 4)]
    filters = LogFilters(service="s")
    first = paging.list_logs(log_frame(spark, rows), filters, 2).first()
    assert [int(r["id"][-3:]) for r in first["logs"]] == [4, 3]
    changed = [r for r in rows if r[0] != 2] + [(5, "2026-08-09T11:30:00Z", "info", "s", "new", {})]
    second = paging.list_logs(log_frame(spark, changed), filters, 2, first["next_cursor"]).first()
    assert [int(r["id"][-3:]) for r in second["logs"]] == [1]
    assert second["next_cursor"] is None


def test_page_position(logs):
    page = paging.find_page(logs, ALL, 2)
    assert paging.page_position(page, 2).first()["id"] == log_id(5)


def test_top_rows_without_a_full_sort(logs):
    plan = plan_text(paging.find_page(logs, ALL, 2, ("2025-11-02T04:15:07.500Z", log_id(3))))
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


def test_widening_page(spark):
    rows = [
        (n, f"2026-08-{day:02d}T10:00:00Z", "info", "s", "m", {})
        for n, day in enumerate((1, 2, 2, 9, 20, 20, 20), start=1)
    ]
    logs = log_frame(spark, rows)
    for limit in (1, 2, 3, 4, 100):
        for since, until in (("01", "21"), ("02", "20"), ("20", "20"), ("09", "21")):
            filters = LogFilters(
                since=f"2026-08-{since}T00:00:00Z", until=f"2026-08-{until}T00:00:00Z"
            )
            whole = paging.find_page(logs, filters, limit).collect()
            assert paging.newest_page(logs, filters, limit).collect() == whole
    position = ("2026-08-20T10:00:00.000Z", log_id(6))
    wide = LogFilters(since="2026-08-01T00:00:00Z")
    assert (
        paging.newest_page(logs, wide, 2, position).collect()
        == paging.find_page(logs, wide, 2, position).collect()
    )


def jobs_of(spark, action):
    """What an action gives, and how many Spark jobs it started."""
    context, group = spark.sparkContext, f"count-{id(action)}"
    context.setJobGroup(group, group)
    try:
        return action(), len(context.statusTracker().getJobIdsForGroup(group))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def test_page_by_minute_counts(spark):
    rnd = random.Random(8)
    minute = lambda m: f"2025-11-{1 + m // 1440:02d}T{m // 60 % 24:02d}:{m % 60:02d}"
    rows = [
        (n, f"{minute(rnd.choice([3, 4, 4, 5, 1441, 4000, 4001]))}:{rnd.randint(0, 59):02d}.{rnd.randint(0, 9)}00Z",
         rnd.choice(["info", "warn"]), rnd.choice(["a", "b"]), "m", {})
        for n in range(1, 90)
    ]
    logs = log_frame(spark, rows).cache()
    rollup = build_rollup(logs).cache()
    filters = [
        LogFilters(),
        LogFilters(service="a", since="2025-11-01T00:03:30Z", until="2025-11-03T18:41:20.5Z"),
        LogFilters(level="warn", until="2025-11-03T18:40:00Z"),
        LogFilters(service="none"),
        LogFilters(since="2025-11-01T00:04:10Z", until="2025-11-01T00:04:20Z"),
    ]
    positions = [None, ("2025-11-03T18:40:30.100Z", log_id(50)), ("2025-11-01T00:04:00.000Z", log_id(1))]
    for f in filters:
        for limit in (1, 7, 1000):
            for position in positions:
                page = paging.newest_page(logs, f, limit, position, rollup=rollup)
                assert page.collect() == paging.find_page(logs, f, limit, position).collect()
    floor = paging.page_floor(rollup, LogFilters(), 5)
    assert floor is not None and paging.page_floor(rollup, LogFilters(), 1000) is None
    held = rollup.groupBy("bucket_start").agg(F.sum("count").alias("n")).orderBy(F.desc("bucket_start")).collect()
    enough = next(i for i in range(len(held)) if sum(r["n"] for r in held[: i + 1]) > 5)
    assert floor == int(held[enough]["bucket_start"].replace(tzinfo=dt.timezone.utc).timestamp()) * 1000000
    walked, cursor = [], None
    while True:
        page = paging.list_logs(logs, LogFilters(service="a"), 9, cursor, rollup=rollup).first()
        walked += [r["id"] for r in page["logs"]]
        cursor = page["next_cursor"]
        if cursor is None:
            break
    assert walked == [r["id"] for r in paging.newest_first(logs.where("service = 'a'")).collect()]


def test_one_small_read_bounds_the_page(spark, tmp_path):
    rows = [(n, f"2025-11-{1 + n % 20:02d}T10:{n % 60:02d}:00Z", "info", "s", "m", {}) for n in range(1, 400)]
    append_logs(log_frame(spark, rows), str(tmp_path / "logs"))
    logs = scan_logs(spark, str(tmp_path / "logs"))
    build_rollup(logs).write.partitionBy("event_date").parquet(str(tmp_path / "rollup"))
    rollup = scan_rollup(spark, str(tmp_path / "rollup"))
    filters = LogFilters(since="2025-11-01T00:00:00Z", until="2025-11-21T00:00:00Z")
    page, jobs = jobs_of(spark, lambda: paging.newest_page(logs, filters, 10, rollup=rollup))
    assert jobs <= 2  # one action; its last shuffle makes a job of its own
    plan = plan_text(page)
    assert "PartitionFilters" in plan and "event_date#" in plan
    scanned = page.inputFiles()
    assert len(scanned) and len(page.collect()) == 11
    partitions = re.search(r"PartitionFilters: \[(.*)\]", plan)[1]
    assert "2025-11-20" in partitions


def test_all_pages_deal_rows_out_once(logs):
    plan = plan_text(paging.page_all(logs, ALL, 2))
    assert "SortMergeJoin" not in plan and "rangepartitioning" not in plan  # the written rows are only read


def test_fingerprints():
    one = LogFilters(service="s", since="2026-08-10T14:00:00+02:00", q="")
    two = LogFilters(service="s", since="2026-08-10T07:00:00-05:00")
    assert paging.filter_fingerprint(one) == paging.filter_fingerprint(two)
    a = LogFilters(attributes=[("z", "1"), ("a", "2")])
    b = LogFilters(attributes={"a": "2", "z": "1"})
    assert paging.filter_fingerprint(a) == paging.filter_fingerprint(b)
    different = [ALL, one, a, LogFilters(q="x"), LogFilters(level="info"), LogFilters(service="")]
    assert len({paging.filter_fingerprint(f) for f in different}) == len(different)
    # Astral characters sort before U+FFFF, by code unit.
    astral = LogFilters(attributes={"￿": "1", "\U0001f600": "2"})
    assert [k for k, _ in astral.attributes] == ["\U0001f600", "￿"]


def test_fingerprints_of_a_column(spark):
    rows = [("checkout", "error"), (None, "info"), ('quote"\\', None)]
    df = spark.createDataFrame(rows, "service string, level string")
    since = "2026-08-10T12:00:00.000Z"
    got = df.select(
        paging.fingerprint_column(F.col("service"), F.col("level"), F.lit(since), F.lit(None))
    ).collect()
    expected = [
        paging.filter_fingerprint(LogFilters(service=s, level=lv, since=since)) for s, lv in rows
    ]
    assert [r[0] for r in got] == expected


def _payload(**changes):
    base = {
        "version": 1,
        "timestamp": "2026-08-10T12:30:00.000Z",
        "id": log_id(1),
        "filterFingerprint": paging.filter_fingerprint(ALL),
    }
    return json.dumps(base | changes, separators=(",", ":"))


def _encode(text):
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def test_token_decoding(spark):
    good = _encode(_payload())
    bad = [
        "",
        "!",
        good + "=",
        good[:-1],
        good + "A",
        _encode(_payload(version=2)),
        _encode(_payload(version="1")),
        _encode(_payload(id=log_id(1).upper().replace("4000", "5000"))),
        _encode(_payload(timestamp="2026-08-10T12:30:00Z")),
        _encode(_payload(timestamp="2026-02-30T12:30:00.000Z")),
        _encode(_payload(timestamp=5)),
        _encode(_payload(filterFingerprint="0" * 64)),
        _encode(_payload(extra=1)),
        _encode(_payload().replace(",", ", ")),
        _encode("[]"),
        _encode("null"),
        base64.urlsafe_b64encode(b"\xff\xfe").decode().rstrip("="),
    ]
    df = spark.createDataFrame([(t,) for t in [good, *bad]], "token string")
    decoded = [
        r[0]
        for r in df.select(
            paging.decode_token(F.col("token"), paging.filter_fingerprint(ALL))
        ).collect()
    ]
    assert tuple(decoded[0]) == ("2026-08-10T12:30:00.000Z", log_id(1))
    assert decoded[1:] == [None] * len(bad)
    assert paging.decode_cursor(good, ALL) == ("2026-08-10T12:30:00.000Z", log_id(1))
    for token in bad:
        with pytest.raises(ValueError, match="'cursor'"):
            paging.decode_cursor(token, ALL)
    with pytest.raises(ValueError, match="'cursor' is invalid"):
        paging.decode_cursor(good, LogFilters(level="info"))


def test_encoded_token(spark):
    df = spark.range(1).select(
        paging.encode_token(
            F.lit("2026-08-10T12:30:00.000Z"), F.lit(log_id(1)), paging.filter_fingerprint(ALL)
        )
    )
    assert df.first()[0] == _encode(_payload())


def test_numbering_spreads_a_hot_timestamp(spark):
    """Most rows share one instant; their ids must spread them over the partitions."""
    hot = spark.range(20000).select(
        F.when(F.col("id") % 10 < 8, F.lit(1785578400))
        .otherwise(F.lit(1785578400) + F.col("id"))
        .cast("timestamp")
        .alias("timestamp"),
        F.md5(F.col("id").cast("string")).alias("id"),
    )
    order = [F.desc("timestamp"), F.desc("id")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = hot.repartitionByRange(4, *order).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 20000 / 2
    rows = paging.numbered(hot, *order).orderBy("position").collect()
    assert [r["position"] for r in rows] == list(range(20000))
    keys = [(r["timestamp"], r["id"]) for r in rows]
    assert keys == sorted(keys, reverse=True)
    assert {r["total"] for r in rows} == {20000}
