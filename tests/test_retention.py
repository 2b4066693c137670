import pytest
from pyspark.sql import functions as F

from helpers import log_frame
from tallylog.functions.timestamps import timestamp_text
from tallylog.operators import retention as r


def names(df):
    return [row["name"] for row in df.orderBy("name").collect()]


def numbers(df):
    return sorted(int(row["id"][-6:]) for row in df.select("id").collect())


def frame(spark, *times):
    return log_frame(spark, [(n, at, "info", "s", "m", {}) for n, at in enumerate(times, start=1)])


def test_plan(spark):
    plan = r.partition_plan(spark, "2031-05-17T18:45:12.030Z", 2)
    got = plan.select("name", *(timestamp_text(F.col(c)).alias(c) for c in ("start", "end")))
    assert [tuple(x) for x in got.orderBy("name").collect()] == [
        (f"logs_203105{d:02d}", f"2031-05-{d:02d}T00:00:00.000Z", f"2031-05-{d + 1:02d}T00:00:00.000Z")
        for d in range(15, 20)
    ]
    # over the ends of a leap February, of a common one, of a century's and of a year
    for now, kept, first, last in [
        ("2028-03-01T00:00:00.000Z", 2, "logs_20280228", "logs_20280303"),
        ("2027-03-01T09:30:00.000Z", 1, "logs_20270228", "logs_20270303"),
        ("2100-02-28T23:00:00.000Z", 3, "logs_21000225", "logs_21000302"),
        ("2029-01-01T00:00:00.001Z", 5, "logs_20281227", "logs_20290103"),
    ]:
        days = names(r.partition_plan(spark, now, kept))
        assert (days[0], days[-1], len(days)) == (first, last, kept + 3)
    assert names(r.upcoming_days(spark, "2030-06-29T23:59:59Z")) == ["logs_20300629", "logs_20300630", "logs_20300701"]
    for bad in (0, 3651, True, 1.0):
        with pytest.raises(ValueError):
            r.partition_plan(spark, "2031-05-17T00:00:00Z", bad)


def test_routing(spark):
    kept = {
        "2030-12-30T23:59:59.999999Z": "logs_default",  # a microsecond before the first day
        "2030-12-31T00:00:00.000Z": "logs_20301231",
        "2031-01-01T12:34:56.789Z": "logs_20310101",
        "2031-01-03T23:59:59.999999Z": "logs_20310103",
        "2031-01-04T00:00:00.000Z": "logs_default",
        "1969-12-31T23:59:59.000Z": "logs_default",
    }
    logs = frame(spark, *kept)
    routed = r.route_partition(logs, r.partition_plan(spark, "2031-01-01T05:00:00Z", 1)).collect()
    of = {numbers_of: name for numbers_of, name in zip(range(1, 7), kept.values())}
    assert {int(x["id"][-6:]): x["partition_name"] for x in routed} == of
    assert set(routed[0].asDict()) == set(logs.columns) | {"partition_name"}


def listing(spark, *rows):
    return spark.createDataFrame(rows, "name string, s string, e string").select(
        "name", F.to_timestamp("s").alias("start"), F.to_timestamp("e").alias("end")
    )


def test_valid_partitions(spark):
    found = listing(
        spark,
        ("logs_20260807", "2026-08-07 00:00:00", "2026-08-08 00:00:00"),
        ("logs_20260230", "2026-03-02 00:00:00", "2026-03-03 00:00:00"),
        ("logs_20260808", "2026-08-08 01:00:00", "2026-08-09 00:00:00"),
        ("logs_20260809", "2026-08-09 00:00:00", "2026-08-10 01:00:00"),
        ("logs_2026080", "2026-08-09 00:00:00", "2026-08-10 00:00:00"),
        ("xlogs_20260809", "2026-08-09 00:00:00", "2026-08-10 00:00:00"),
        ("logs_default", "2026-08-09 00:00:00", "2026-08-10 00:00:00"),
        (None, "2026-08-09 00:00:00", "2026-08-10 00:00:00"),
    )
    assert names(r.valid_partitions(found)) == ["logs_20260807"]


def days(spark, first, count):
    return r._days(spark, r._day_number(first), count)


def test_expired_days(spark):
    stored = days(spark, "2026-07-01T00:00:00Z", 40)
    end = lambda text: names(r.expired_partitions(stored, text))
    assert end("2026-07-03T00:00:00.000Z") == ["logs_20260701", "logs_20260702"]
    assert end("2026-07-02T23:59:59.999Z") == ["logs_20260701"]
    assert end("2026-07-01T23:59:59.999Z") == []
    assert len(end("2026-09-01T00:00:00Z")) == 40
    assert names(r.expired_partitions(stored, "2026-09-01T00:00:00Z", 2)) == ["logs_20260701", "logs_20260702"]
    oldest = r.oldest_expired_partition(stored, "2026-09-01T00:00:00Z")
    assert names(oldest) == ["logs_20260701"]


def test_missing_and_moved(spark):
    plan = r.partition_plan(spark, "2026-08-08T12:00:00Z", 1)
    existing = days(spark, "2026-08-07T00:00:00Z", 2)
    missing = r.missing_partitions(plan, existing)
    assert names(missing) == ["logs_20260809", "logs_20260810"]
    logs = frame(spark, "2026-08-08T23:59:59.999Z", "2026-08-09T00:00:00Z", "2026-08-10T00:00:00Z", "2026-08-11T00:00:00Z")
    assert names(r.days_with_default_rows(missing, logs)) == ["logs_20260809", "logs_20260810"]
    assert numbers(r.rows_for_new_days(logs, missing)) == [2, 3]
    moved, staying = r.move_default_rows(logs, "2026-08-09T00:00:00Z")
    assert numbers(moved) == [2] and numbers(staying) == [1, 3, 4]
    assert moved.columns == logs.columns
    assert moved.first() == logs.where("id like '%2'").first()


CUTOFF = "2026-08-01T12:00:00.000Z"


def test_default_rows_are_cut_at_the_instant(spark):
    logs = frame(spark, "2026-08-01T11:59:59.999Z", CUTOFF, "2026-08-01T12:00:00.001Z")
    survivors, victims = r.expire_default_rows(logs, CUTOFF)
    assert numbers(victims) == [1] and numbers(survivors) == [2, 3]
    assert r.count_deleted(victims).first()["deleted"] == 1


def test_bounded_delete_takes_the_oldest(spark):
    logs = frame(spark, "2026-07-03T00:00:00Z", "2026-07-01T00:00:00Z", "2026-07-01T00:00:00Z", CUTOFF)
    survivors, victims = r.expire_default_rows(logs, CUTOFF, batch_size=1, calls=2)
    assert numbers(victims) == [2, 3] and numbers(survivors) == [1, 4]
    for arguments in ({"batch_size": 0}, {"batch_size": 10001}, {"calls": 11}):
        with pytest.raises(ValueError):
            r.expire_default_rows(logs, CUTOFF, **arguments)


def test_cutoff():
    assert r.retention_cutoff("2026-08-31T12:00:00.5Z", 30) == "2026-08-01T12:00:00.500Z"
    assert r.retention_cutoff("2024-03-01T00:00:00Z", 1) == "2024-02-29T00:00:00.000Z"


def test_arguments():
    now = "2026-08-08T12:00:00Z"
    for start in ("2026-08-07T00:00:00Z", "2026-08-10T00:00:00Z"):
        r.check_retention_args(now, day_start=start)
    for start in ("2026-08-06T00:00:00Z", "2026-08-11T00:00:00Z", "2026-08-08T00:00:00.001Z"):
        with pytest.raises(ValueError, match="start"):
            r.check_retention_args(now, day_start=start)
    r.check_retention_args(now, cutoff=now)
    for cutoff in ("2026-08-08T12:00:00.001Z", "2016-08-01T00:00:00Z"):
        with pytest.raises(ValueError, match="cutoff"):
            r.check_retention_args(now, cutoff=cutoff)
    with pytest.raises(ValueError, match="batch"):
        r.check_retention_args(now, batch_size=0)


def test_retained(spark):
    """Cutoff 2026-08-01T12:00: its day stays whole as a partition, not as default rows."""
    now, kept_days = "2026-08-31T12:00:00Z", 30
    logs = frame(
        spark,
        "2026-07-31T23:59:59.999Z",
        "2026-08-01T00:00:00Z",
        "2026-08-01T11:59:59.999Z",
        CUTOFF,
        "2026-08-20T00:00:00Z",
        "2030-01-01T00:00:00Z",
    )
    assert numbers(r.retained(logs, now, kept_days)) == [2, 3, 4, 5, 6]
    assert numbers(r.retained(logs, now, kept_days, days(spark, "2026-08-02T00:00:00Z", 3))) == [4, 5, 6]


def report(spark, stored, logs, **limits):
    return r.retention_report(stored, logs, "2026-08-31T12:00:00Z", 30, **limits).first().asDict()


def test_report(spark):
    quiet = report(spark, days(spark, "2026-08-31T00:00:00Z", 3), frame(spark, CUTOFF))
    assert quiet == {
        "status": "completed",
        "ensure_calls": 3,
        "created": 0,
        "drop_calls": 1,
        "dropped": 0,
        "delete_calls": 1,
        "deleted": 0,
        "drop_budget_reached": False,
        "delete_budget_reached": False,
    }
    base = frame(spark, "2026-07-01T00:00:00Z")
    many = lambda n: base.drop("id").crossJoin(spark.range(n).select(F.col("id").cast("string").alias("id")))
    some = report(spark, days(spark, "2026-07-01T00:00:00Z", 31), many(2000))
    assert (some["created"], some["dropped"], some["drop_calls"]) == (3, 31, 32)
    assert (some["deleted"], some["delete_calls"], some["delete_budget_reached"]) == (2000, 3, False)
    assert not some["drop_budget_reached"]
    whole = report(spark, days(spark, "2026-06-01T00:00:00Z", 40), many(12345))
    assert (whole["dropped"], whole["drop_calls"], whole["drop_budget_reached"]) == (40, 41, False)
    assert (whole["deleted"], whole["delete_calls"], whole["delete_budget_reached"]) == (12345, 13, False)
    budgets = {"drop_limit": 32, "delete_limit": 10000}
    full = report(spark, days(spark, "2026-06-01T00:00:00Z", 40), many(12345), **budgets)
    assert (full["dropped"], full["drop_calls"], full["drop_budget_reached"]) == (32, 32, True)
    assert (full["deleted"], full["delete_calls"], full["delete_budget_reached"]) == (10000, 10, True)


def test_rollup_outlives_rows_unless_told(spark):
    from tallylog.operators.rollup import build_rollup

    counts = build_rollup(frame(spark, "2026-07-31T23:59:59Z", "2026-08-01T00:00:00Z"))
    now = "2026-08-31T12:00:00Z"
    assert r.retained_rollup(counts, now, 30).count() == 2
    assert r.retained_rollup(counts, now, 30, expire_rollup=True).count() == 1
