import pytest

from helpers import log_frame, plan_text
from tallylog.fixed import ARGUMENT
from tallylog.operators.filters import (
    LogFilters,
    check_aggregation,
    check_limit,
    where_matching,
)
from tallylog.sources.tables import append_logs, compact_logs, scan_logs

ROWS = [
    (1, "2025-03-01T06:00:00Z", "debug", "mailer", "Queue drained: 0% left", {"shard": "7", "dry_run": "false"}),
    (2, "2025-03-01T06:20:00Z", "warn", "mailer", "slow_query took 3 s", {"shard": "7", "dry_run": "true", "ключ": "значение"}),
    (3, "2025-03-01T06:40:00Z", "error", "indexer", "cannot open C:\\data\\a_b", {"shard": "07", "a b": "", "constructor": "x"}),
    (4, "2025-03-01T07:00:00Z", "error", "mailer", "QUEUE full", {}),
]

CASES = [
    ({}, [1, 2, 3, 4]),
    # service and level: whole and as written
    ({"service": "mailer"}, [1, 2, 4]),
    ({"service": "Mailer"}, []),
    ({"service": ""}, []),
    ({"service": "%"}, []),
    ({"service": "mailer' --"}, []),
    ({"level": "error"}, [3, 4]),
    ({"level": "info"}, []),
    # since counts, until does not; digits beyond microseconds are cut
    ({"since": "2025-03-01T06:40:00Z"}, [3, 4]),
    ({"since": "2025-03-01T06:40:00.0000004Z"}, [3, 4]),
    ({"since": "2025-03-01T06:40:00.000001Z"}, [4]),
    ({"until": "2025-03-01T06:40:00Z"}, [1, 2]),
    ({"since": "2025-03-01T08:20:00+02:00", "until": "2025-03-01T03:40:00-03:00"}, [2]),
    ({"since": "2025-03-01T07:00:00Z", "until": "2025-03-01T07:00:00Z"}, []),
    # attributes: all pairs, as texts
    ({"attributes": {"shard": "7"}}, [1, 2]),
    ({"attributes": {"shard": "07"}}, [3]),
    ({"attributes": {"a b": ""}}, [3]),
    ({"attributes": {"constructor": "x", "shard": "07"}}, [3]),
    ({"attributes": {"ключ": "значение"}}, [2]),
    ({"attributes": [("shard", "7"), ("dry_run", "true")]}, [2]),
    ({"attributes": {"shard": "7", "none": "7"}}, []),
    # text: anywhere, in any case, no wildcards
    ({"q": "queue"}, [1, 4]),
    ({"q": "0%"}, [1]),
    ({"q": "%"}, [1]),
    ({"q": "w_q"}, [2]),
    ({"q": "_"}, [2, 3]),
    ({"q": "\\DATA\\"}, [3]),
    ({"q": ""}, [1, 2, 3, 4]),
    ({"q": "queue left"}, []),
    # all together
    (
        {
            "q": "TOOK",
            "level": "warn",
            "service": "mailer",
            "attributes": {"dry_run": "true"},
            "since": "2025-03-01T06:00:00Z",
            "until": "2025-03-01T07:00:00Z",
        },
        [2],
    ),
]


@pytest.mark.parametrize(("arguments", "expected"), CASES)
def test_predicates(spark, arguments, expected):
    found = where_matching(log_frame(spark, ROWS), LogFilters(**arguments)).select("id").collect()
    assert sorted(int(r["id"][-3:]) for r in found) == expected


@pytest.mark.parametrize(
    ("arguments", "message"),
    [
        ({"service": 5}, "service_string"),
        ({"service": "a\0"}, "service_nul"),
        ({"level": "INFO"}, "level_value"),
        ({"level": 1}, "level_string"),
        ({"since": "2026-01-15"}, "since_timestamp"),
        ({"since": 5}, "since_timestamp"),
        ({"until": "2026-01-15T12:00:60Z"}, "until_timestamp"),
        ({"since": "2026-01-15T12:00:00.0000001Z", "until": "2026-01-15T12:00:00Z"}, "range"),
        ({"attributes": {"": "x"}}, "attribute_key"),
        ({"attributes": {"a\0": "x"}}, "attribute_key_nul"),
        ({"attributes": {"a": "x\0"}}, "attribute_value_nul"),
        ({"attributes": {"a": 3}}, "attribute_string"),
        ({"attributes": [("a", "1"), ("a", "2")]}, "attribute_duplicate"),
        ({"q": "\0"}, "q_nul"),
        ({"q": 5}, "q_string"),
        # Earlier parts are checked first.
        ({"service": "\0", "level": "x"}, "service_nul"),
        ({"level": "x", "q": "\0"}, "level_value"),
    ],
)
def test_refused_arguments(arguments, message):
    with pytest.raises(ValueError) as error:
        LogFilters(**arguments)
    assert str(error.value) == ARGUMENT[message]


def test_limits():
    assert check_limit() == 100
    assert check_limit(1) == 1 and check_limit(1000) == 1000
    for bad in (0, 1001, -1, "10", 1.5, True):
        with pytest.raises(ValueError, match="'limit'"):
            check_limit(bad)


def test_aggregation_arguments():
    bounds = {"since": "2026-01-01T00:00:00Z", "until": "2026-01-02T00:00:00Z"}
    check_aggregation(LogFilters(**bounds), "5m", "service")
    for arguments, bucket, group, message in [
        ({"until": bounds["until"]}, "5m", None, "since_required"),
        ({"since": bounds["since"]}, "5m", None, "until_required"),
        (bounds, None, None, "bucket_required"),
        (bounds, "2m", None, "bucket_value"),
        (bounds, "5m", "message", "group_by_value"),
    ]:
        with pytest.raises(ValueError) as error:
            check_aggregation(LogFilters(**arguments), bucket, group)
        assert str(error.value) == ARGUMENT[message]


def test_bounds_reach_the_scan(spark, tmp_path):
    """Day folders are pruned and the instant is checked against Parquet statistics."""
    
    path = str(tmp_path / "logs")
    append_logs(log_frame(spark, ROWS), path)
    filters = LogFilters(service="indexer", since="2025-03-01T06:10:00Z", until="2025-03-01T06:50:00Z")
    found = where_matching(scan_logs(spark, path), filters).select("id")
    plan = plan_text(found)
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "GreaterThanOrEqual(timestamp,2025-03-01 06:10:00.0)" in plan
    assert "EqualTo(service,indexer)" in plan
    assert "ReadSchema: struct<timestamp:timestamp,id:string,service:string>" in plan
    assert found.count() == 1


def test_promoted_attributes_reach_the_files(spark, tmp_path):
    odd = "tick` and.dot"
    rows = [(n, f"2025-07-0{1 + n % 3}T00:00:{n % 60:02d}Z", "info", "s", "m", {"tenant": f"t{n % 50}", odd: f"v{n % 7}"} if n % 4 else {}) for n in range(400)]
    frame, path = log_frame(spark, rows), str(tmp_path / "logs")
    append_logs(frame.where("id < '00000000-0000-4000-8000-000000000200'"), path, promoted=["tenant", odd])
    append_logs(frame.where("id >= '00000000-0000-4000-8000-000000000200'"), path, promoted=["tenant", odd])
    stored = scan_logs(spark, path, promoted=["tenant", odd])
    for pairs in ({"tenant": "t7"}, {"tenant": "t7", odd: "v0"}, {odd: "v3"}, {"tenant": "none"}, {"other": "x"}):
        filters = LogFilters(attributes=pairs, since="2025-07-01T00:00:00Z", until="2025-07-04T00:00:00Z")
        ids = lambda df: sorted(r["id"] for r in where_matching(df, filters).collect())
        assert ids(stored) == ids(frame)
    plan = plan_text(where_matching(stored, LogFilters(attributes={"tenant": "t7"})).select("id"))
    assert "EqualTo(attribute_tenant,t7)" in plan and "attributes_search" not in plan
    compact_logs(scan_logs(spark, path), str(tmp_path / "again"), promoted=["tenant"])
    again = scan_logs(spark, str(tmp_path / "again"), promoted=["tenant"])
    found = where_matching(again, LogFilters(attributes={"tenant": "t7"})).count()
    assert found == where_matching(frame, LogFilters(attributes={"tenant": "t7"})).count() > 0
