import random

import pytest
from pyspark.sql import functions as F

from helpers import log_frame, plan_text
from tallylog.operators import aggregate as agg
from tallylog.operators.filters import LogFilters
from tallylog.operators.rollup import build_rollup, merge_rollup, minute_counts, verify_rollup
from tallylog.sources.tables import append_logs, scan_logs

ROWS = [
    (1, "2026-08-09T10:00:00.000000Z", "error", "checkout", "Payment DECLINED literal % _ \\ path", {"retries": "3", "enabled": "true", "toString": "to-string"}),
    (2, "2026-08-09T10:00:59.999999Z", "error", "checkout", "same first minute", {"retries": "3", "enabled": "false"}),
    (3, "2026-08-09T10:01:00.000000Z", "info", "auth", "next minute", {"retries": "03"}),
    (4, "2026-08-09T10:04:59.999999Z", "warn", "checkout", "last instant of five minutes", {"retries": "3"}),
    (5, "2026-08-09T10:05:00.000000Z", "debug", "worker", "next five minutes", {}),
    (6, "2026-08-09T11:00:00.000000Z", "info", "__proto__", "a service of any name", {}),
    (7, "2026-08-09T12:00:00.000000Z", "error", "exclusive", "upper bound", {}),
    (8, "1969-12-31T23:59:59.999999Z", "info", "epoch", "before epoch", {}),
    (9, "1970-01-01T00:00:00.000000Z", "info", "epoch", "at epoch", {}),
    (10, "2026-03-29T00:59:59.999999Z", "info", "dst", "before a clock change", {}),
    (11, "2026-03-29T01:00:00.000000Z", "info", "dst", "after a clock change", {}),
]
RANGE = {"since": "2026-08-09T10:00:00Z", "until": "2026-08-09T12:00:00Z"}


@pytest.fixture(scope="module")
def logs(spark):
    return log_frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def rollup(logs):
    return build_rollup(logs).cache()


def _rows(counts):
    return [tuple(r) for r in agg.format_buckets(counts).collect()]


def _both(logs, rollup, filters, bucket, group_by=None):
    raw = _rows(agg.bucket_count(logs, filters, bucket, group_by))
    assert raw == _rows(agg.rollup_bucket_count(rollup, filters, bucket, group_by))
    return raw


@pytest.mark.parametrize(
    ("bucket", "expected"),
    [
        ("1m", [("10:00", 2), ("10:01", 1), ("10:04", 1), ("10:05", 1), ("11:00", 1)]),
        ("5m", [("10:00", 4), ("10:05", 1), ("11:00", 1)]),
        ("1h", [("10:00", 5), ("11:00", 1)]),
        ("1d", [("00:00", 6)]),
    ],
)
def test_buckets(logs, rollup, bucket, expected):
    got = _both(logs, rollup, LogFilters(**RANGE), bucket)
    assert got == [(f"2026-08-09T{at}:00.000Z", None, n) for at, n in expected]


@pytest.mark.parametrize(
    ("group", "expected"),
    [
        ("service", [("auth", 1), ("checkout", 3), ("worker", 1)]),
        ("level", [("debug", 1), ("error", 2), ("info", 1), ("warn", 1)]),
    ],
)
def test_groups(logs, rollup, group, expected):
    filters = LogFilters(since="2026-08-09T10:00:00Z", until="2026-08-09T11:00:00Z")
    got = _both(logs, rollup, filters, "1h", group)
    assert [r[1:] for r in got] == expected


def test_edges(logs, rollup):
    one = LogFilters(since="2026-08-09T10:00:00Z", until="2026-08-09T10:01:00Z")
    assert _both(logs, rollup, one, "1m") == [("2026-08-09T10:00:00.000Z", None, 2)]
    none = LogFilters(since="2026-08-09T10:00:00Z", until="2026-08-09T10:00:00Z")
    assert _both(logs, rollup, none, "1m") == []
    epoch = LogFilters(service="epoch", since="1969-12-31T23:59:00Z", until="1970-01-01T00:01:00Z")
    assert [r[0] for r in _both(logs, rollup, epoch, "1m")] == [
        "1969-12-31T23:59:00.000Z",
        "1970-01-01T00:00:00.000Z",
    ]
    change = LogFilters(
        service="dst", since="2026-03-29T01:00:00+01:00", until="2026-03-29T04:00:00+02:00"
    )
    assert [(r[0][11:13], r[2]) for r in _both(logs, rollup, change, "1h")] == [("00", 1), ("01", 1)]


def test_all_filters_together(logs):
    filters = LogFilters(
        service="checkout",
        level="error",
        attributes={"retries": "3", "enabled": "true", "toString": "to-string"},
        q="% _ \\",
        **RANGE,
    )
    got = _rows(agg.bucket_count(logs, filters, "1h", "service"))
    assert got == [("2026-08-09T10:00:00.000Z", "checkout", 1)]
    text = LogFilters(attributes={"retries": "03"}, **RANGE)
    assert [r[0] for r in _rows(agg.bucket_count(logs, text, "1m"))] == ["2026-08-09T10:01:00.000Z"]


def test_rollup_counts_whole_minutes(logs, rollup):
    inside = LogFilters(since="2026-08-09T10:00:30Z", until="2026-08-09T10:04:30Z")
    total = lambda exact: sum(
        r["count"] for r in agg.aggregate(logs, rollup, inside, "1h", exact=exact).collect()
    )
    assert total(exact=True) == 2  # rows 2 and 3
    assert total(exact=False) == 2  # minute 10:00 is left out, 10:04 is included


def test_exact_counts_of_any_range(logs, rollup):
    rnd = random.Random(2)
    instant = lambda: f"2026-08-09T{rnd.choice([10, 11])}:0{rnd.randint(0, 5)}:{rnd.choice([0, 0, 30, 59]):02d}.{rnd.choice(['0', '5', '999999'])}Z"
    for _ in range(25):
        since, until = sorted((instant(), instant()))
        filters = LogFilters(service=rnd.choice([None, "checkout"]), since=since, until=until)
        bucket, group = rnd.choice(["1m", "5m", "1h"]), rnd.choice([None, "level"])
        got = _rows(agg.aggregate(logs, rollup, filters, bucket, group, exact=True))
        assert got == _rows(agg.bucket_count(logs, filters, bucket, group))


def test_range_parts():
    part = lambda since, until: agg.whole_minutes(LogFilters(since=f"2025-05-01T{since}Z", until=f"2025-05-01T{until}Z"))
    ends = lambda parts: [(p.since[11:], p.until[11:]) for p in parts]
    whole, cut = part("10:00:30.5", "10:04:12.25")
    assert ends([whole, *cut]) == [("10:01:00.000Z", "10:04:00.000Z"), ("10:00:30.500Z", "10:01:00.000Z"), ("10:04:00.000Z", "10:04:12.250Z")]
    whole, cut = part("10:00:00", "10:04:00.000001")
    assert ends([whole, *cut]) == [("10:00:00.000Z", "10:04:00.000Z"), ("10:04:00.000Z", "10:04:00.000001Z")]
    for since, until in (("10:00:10", "10:00:50"), ("10:00:30", "10:01:20"), ("10:00:30", "10:01:00"), ("10:00:00", "10:00:00")):
        whole, cut = part(since, until)
        assert whole is None and len(cut) == 1


def test_exact_counts_read_logs_of_two_minutes(spark, tmp_path):
    rows = [(n, f"2025-05-{1 + n % 9:02d}T10:{n % 60:02d}:{n % 50:02d}Z", "info", "s", "m", {}) for n in range(300)]
    append_logs(log_frame(spark, rows), str(tmp_path / "logs"))
    logs = scan_logs(spark, str(tmp_path / "logs"))
    filters = LogFilters(since="2025-05-02T10:01:30Z", until="2025-05-08T10:07:20Z")
    plan = plan_text(agg.aggregate(logs, build_rollup(log_frame(spark, rows)), filters, "1d", exact=True))
    scans = [part for part in plan.split("\n\n") if "Scan parquet" in part and "PushedFilters" in part]
    assert len(scans) == 2
    for scan, day, low, high in zip(sorted(scans, key=lambda x: "2025-05-08" in x), ("02", "08"), ("10:01:30.0", "10:07:00.0"), ("10:02:00.0", "10:07:20.0")):
        assert f"GreaterThanOrEqual(timestamp,2025-05-{day} {low})" in scan and f"LessThan(timestamp,2025-05-{day} {high})" in scan
        assert "PartitionFilters" in scan and "event_date" in scan.split("PartitionFilters")[1]


def test_routing(logs, rollup):
    plain, text = LogFilters(**RANGE), LogFilters(q="path", **RANGE)
    by_rollup = plan_text(agg.aggregate(logs, rollup, plain, "1h"))
    assert "sum(" in by_rollup
    by_logs = plan_text(agg.aggregate(logs, rollup, text, "1h"))
    assert "count(1)" in by_logs
    with pytest.raises(ValueError):
        agg.rollup_bucket_count(rollup, text, "1h")


def test_minute_counts_of_two_records(spark):
    rows = [
        (1, "2026-08-08T10:00:00.000Z", "warn", "checkout", "first", {}),
        (2, "2026-08-08T11:00:00.000Z", "error", "billing", "second", {}),
    ]
    counts = minute_counts(log_frame(spark, rows)).orderBy("bucket_start").collect()
    assert [(r["service"], r["level"], r["count"]) for r in counts] == [
        ("checkout", "warn", 1),
        ("billing", "error", 1),
    ]


def test_merge_and_verify(logs, rollup):
    doubled = merge_rollup(rollup, rollup)
    assert doubled.agg(F.sum("count")).first()[0] == 2 * len(ROWS)
    assert verify_rollup(logs, rollup).isEmpty()
    # Unmerged parts of one key count as their sum.
    part = rollup.withColumn("count", F.col("count") - 1)
    rest = rollup.withColumn("count", F.lit(1).cast("long"))
    assert verify_rollup(logs, part.unionByName(rest)).isEmpty()
    assert verify_rollup(logs, doubled).count() == rollup.count()


def test_counting_starts_before_the_shuffle(logs):
    plan = plan_text(agg.bucket_count(logs, LogFilters(**RANGE), "5m", "service"))
    assert plan.count("Exchange hashpartitioning") <= 1
    assert "partial_count(1)" in plan
