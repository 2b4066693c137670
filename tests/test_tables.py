import hashlib
import json

import pytest
from pyspark.sql import functions as F

from helpers import entry, log_frame, plan_text
from tallylog.operators import audit, retention
from tallylog.operators.metrics import storage_summary
from tallylog.operators.rollup import minute_counts, verify_rollup
from tallylog.plans import maintenance
from tallylog.plans.ingest import ingest
from tallylog.plans.maintenance import (
    compact_commits,
    delete_rows,
    drop_expired_days,
    ensure_days,
    listed_days,
    run_upkeep,
    stored_partitions,
)
from tallylog.schema import LOG_SCHEMA
from tallylog.sources import tables as t
from tallylog.sources.batches import read_log_batches, zip_arrays
from tallylog.streaming.ingest import drain, stream_ingest, stream_minute_counts


def rows(day, numbers, level="info"):
    return [(n, f"2026-08-{day:02d}T10:00:{n % 60:02d}Z", level, f"s{n % 3}", "m", {}) for n in numbers]


def write(df, n, out, writer="batch"):
    return t.write_batch(df, n, out.logs, out.rollup, out.commits, writer)


def ids(spark, out):
    return sorted(int(r["id"][-6:]) for r in t.scan_logs(spark, out.logs, out.commits).collect())


def test_batches_become_visible_as_a_whole(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    first, second = log_frame(spark, rows(1, range(5))), log_frame(spark, rows(2, range(5, 9)))
    assert write(first, 0, out)
    # An attempt that dies before its commit row: logs are there, nobody sees them.
    t._write_part(second, out.logs, "batch", 1)
    assert ids(spark, out) == [0, 1, 2, 3, 4]
    assert write(second, 1, out)
    assert ids(spark, out) == list(range(9))
    # A repeated batch changes nothing.
    assert not write(second, 1, out) and not write(first, 0, out)
    assert ids(spark, out) == list(range(9))
    logs = t.scan_logs(spark, out.logs, out.commits)
    assert verify_rollup(logs, t.scan_rollup(spark, out.rollup, out.commits)).isEmpty()


def test_writers_do_not_disturb_each_other(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    assert write(log_frame(spark, rows(1, [1])), 3, out, "a")
    assert write(log_frame(spark, rows(1, [2])), 0, out, "b")
    assert t.committed_positions(spark, out.commits) == {"a": 3, "b": 0}
    assert ids(spark, out) == [1, 2]


def test_commit_files_are_summed_up(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    for n in range(3):
        write(log_frame(spark, rows(1, [n])), n, out, "a")
    write(log_frame(spark, rows(1, [7])), 4, out, "b")
    files = lambda: list((tmp_path / "t" / "commits").glob("*.parquet"))
    assert len(files()) == 4
    assert compact_commits(spark, out.commits) >= 4
    assert len(files()) == 1
    assert t.committed_positions(spark, out.commits) == {"a": 2, "b": 4}
    assert ids(spark, out) == [0, 1, 2, 7]
    assert not write(log_frame(spark, rows(1, [9])), 2, out, "a")
    assert write(log_frame(spark, rows(1, [9])), 3, out, "a")
    assert ids(spark, out) == [0, 1, 2, 7, 9]


def folders(tmp_path, table="table=logs"):
    return sorted("/".join(p.parts[-2:]) for p in (tmp_path / "t" / table).glob("*/*/*"))


def test_live_compaction(spark, tmp_path, monkeypatch):
    out = t.LogTables(str(tmp_path / "t"))
    for n in range(3):
        write(log_frame(spark, rows(1, [n])), n, out, "a b")
    write(log_frame(spark, rows(1, [7])), 0, out, "c")
    real = maintenance.write_commit

    def meanwhile(*arguments):  # a batch is committed while the compaction runs
        assert ids(spark, out) == [0, 1, 2, 7]
        write(log_frame(spark, rows(1, [8])), 3, out, "a b")
        assert ids(spark, out) == [0, 1, 2, 7, 8]
        real(*arguments)

    agree = lambda: verify_rollup(
        t.scan_logs(spark, out.logs, out.commits), t.scan_rollup(spark, out.rollup, out.commits)
    ).isEmpty()
    begun = t.scan_logs(spark, out.logs, out.commits)
    begun.count()
    monkeypatch.setattr(maintenance, "write_commit", meanwhile)
    assert maintenance.compact_tables(spark, out) == 2
    monkeypatch.setattr(maintenance, "write_commit", real)
    assert ids(spark, out) == [0, 1, 2, 7, 8] and agree()
    assert begun.count() == 4  # its files are still there
    assert t.commit_states(spark, out.commits) == {"a b": (2, 3), "c": (0, 0), "_merged": (-1, 0)}
    # the next run removes what was merged before, and merges what has come since
    assert maintenance.compact_tables(spark, out) == 1
    assert folders(tmp_path) == ["writer=_merged/batch_id=0", "writer=_merged/batch_id=1", "writer=a b/batch_id=3"]
    assert ids(spark, out) == [0, 1, 2, 7, 8] and agree()
    # numbers go on, a merged batch is not written again, commits can be summed up
    assert not write(log_frame(spark, rows(1, [9])), 2, out, "a b")
    compact_commits(spark, out.commits)
    assert write(log_frame(spark, rows(2, [9])), 4, out, "a b")
    assert maintenance.compact_tables(spark, out, whole=True) == 2
    assert maintenance.compact_tables(spark, out) == 0
    assert folders(tmp_path) == ["writer=_merged/batch_id=2", "writer=_merged/batch_id=2"]
    assert folders(tmp_path, "rollup") == folders(tmp_path)
    assert ids(spark, out) == [0, 1, 2, 7, 8, 9] and agree()
    stored = t.scan_rollup(spark, out.rollup, out.commits)
    assert stored.groupBy("bucket_start", "service", "level").count().where("count > 1").isEmpty()


def test_nothing_committed_yet(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    t._write_part(log_frame(spark, rows(1, [1])), out.logs, "batch", 0)
    assert ids(spark, out) == []


def test_committed_reads_prune_folders(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    write(log_frame(spark, rows(1, [1])), 0, out)
    plan = plan_text(t.scan_logs(spark, out.logs, out.commits))
    filters = next(line for line in plan.splitlines() if "PartitionFilters" in line)
    assert "writer" in filters and "batch_id" in filters


def test_compaction_keeps_counts(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    for n in range(3):
        write(log_frame(spark, rows(1, range(4)) + rows(2, [5])), n, out)
    stored = t.scan_rollup(spark, out.rollup, out.commits)
    t.compact_rollup(stored, str(tmp_path / "rollup"))
    compact = t.scan_rollup(spark, str(tmp_path / "rollup"))
    assert compact.count() < stored.count()
    assert compact.agg(F.sum("count")).first()[0] == 15
    t.compact_logs(t.scan_logs(spark, out.logs, out.commits), str(tmp_path / "logs"))
    assert t.scan_logs(spark, str(tmp_path / "logs")).count() == 15


def test_storage_summary(spark, tmp_path):
    path = str(tmp_path / "logs")
    t.append_logs(log_frame(spark, rows(1, range(4)) + rows(2, [5])), path)
    t.append_logs(log_frame(spark, rows(1, [9])), path)
    found = {str(r["event_date"]): r for r in storage_summary(spark, path).collect()}
    assert {d: (r["rows"], r["files"]) for d, r in found.items()} == {
        "2026-08-01": (5, 2),
        "2026-08-02": (1, 1),
    }
    size = sum(f.stat().st_size for f in (tmp_path / "logs").rglob("*.parquet"))
    assert sum(r["bytes"] for r in found.values()) == size


def test_a_hot_day_is_written_by_several_tasks(spark, tmp_path):
    """One day holds almost everything; its rows must not all pass one task."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20KB")
    try:
        many = spark.range(0, 40000, 1, 8).select(
            F.timestamp_seconds(F.lit(1785578400) + F.col("id") % 80000).alias("timestamp"),
            F.md5(F.col("id").cast("string")).alias("id"),
            F.lit("info").alias("level"),
            F.lit("s").alias("service"),
            F.sha2(F.col("id").cast("string"), 256).alias("message"),
            F.lit("{}").alias("attributes"),
            F.create_map().cast("map<string,string>").alias("attributes_search"),
            F.current_timestamp().alias("created_at"),
        )
        path = str(tmp_path / "logs")
        t.append_logs(many.withColumn("event_date", F.to_date("timestamp")), path)
        files = {str(r["event_date"]): r["files"] for r in storage_summary(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert max(files.values()) > 1
    assert t.scan_logs(spark, path).count() == 40000


def test_zip_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [], [])], "k int, n array<int>, s array<string>")
    assert sorted(map(tuple, zip_arrays(df, ["n", "s"]).collect())) == [(1, 1, "a"), (1, 2, "b")]


BODIES = [
    {"logs": [entry(timestamp="2026-01-10T12:00:00Z"), entry(message=""), entry(attributes={"n": 1.50})]},
    {"logs": []},
    {"logs": [entry(timestamp="2020-02-29T00:00:30Z")]},
    {"no": "logs"},
    {"logs": [entry(timestamp="2999-01-01T00:00:00Z"), entry(level="error")]},
]


def body_files(path, copies=1):
    path.mkdir()
    for n in range(copies):
        for i, body in enumerate(BODIES):
            (path / f"part-{n}-{i}.ndjson").write_text(json.dumps(body) + "\n\n")
    return str(path)


def _content(spark, out):
    logs = t.scan_logs(spark, out.logs, out.commits)
    found = logs.select("timestamp", "level", "service", "message", "attributes").collect()
    return sorted(map(str, found))


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    source = body_files(tmp_path / "in")
    streamed, batched = (t.LogTables(str(tmp_path / name)) for name in ("stream", "batch"))
    drain(stream_ingest(spark, source, streamed.root, max_files_per_trigger=1))
    assert ingest(read_log_batches(spark, source), 0, batched)
    assert _content(spark, streamed) == _content(spark, batched)
    assert len(_content(spark, streamed)) == 4
    for out in (streamed, batched):
        logs = t.scan_logs(spark, out.logs, out.commits)
        assert verify_rollup(logs, t.scan_rollup(spark, out.rollup, out.commits)).isEmpty()
        assert logs.select("id").distinct().count() == 4
        accounts = spark.read.parquet(out.accounts)
        total = accounts.agg(F.sum("attempted"), F.sum("accepted"), F.count("*")).first()
        assert tuple(total) == (6, 4, 4)
    # Old rows are as welcome as new ones.
    assert any("2020" in row for row in _content(spark, streamed))


def test_files_may_come_day_by_day(spark, tmp_path):
    source = body_files(tmp_path / "in")
    kept, passed = (t.LogTables(str(tmp_path / name)) for name in ("kept", "passed"))
    ingest(read_log_batches(spark, source), 0, kept)
    ingest(read_log_batches(spark, source), 0, passed, by_day=False)
    assert _content(spark, kept) == _content(spark, passed)
    logs = t.scan_logs(spark, passed.logs, passed.commits)
    assert verify_rollup(logs, t.scan_rollup(spark, passed.rollup, passed.commits)).isEmpty()


def test_restart_adds_nothing_and_new_files_are_found(spark, tmp_path):
    source = body_files(tmp_path / "in")
    out = t.LogTables(str(tmp_path / "stream"))
    for _ in range(2):
        drain(stream_ingest(spark, source, out.root))
        assert len(_content(spark, out)) == 4
    (tmp_path / "in" / "later.ndjson").write_text(json.dumps({"logs": [entry()]}))
    drain(stream_ingest(spark, source, out.root))
    assert len(_content(spark, out)) == 5


def test_a_failed_micro_batch_is_repeated_whole(spark, tmp_path, monkeypatch):
    source = body_files(tmp_path / "in")
    out = t.LogTables(str(tmp_path / "stream"))
    real, calls = t._write_part, []

    def failing(df, path, writer, batch_id):
        calls.append(path)
        if len(calls) == 1:  # logs are written, the minute counts are not
            raise OSError("lost")
        real(df, path, writer, batch_id)

    monkeypatch.setattr(t, "_write_part", failing)
    with pytest.raises(Exception):
        drain(stream_ingest(spark, source, out.root))
    assert t.committed_positions(spark, out.commits) == {}
    drain(stream_ingest(spark, source, out.root))
    assert len(_content(spark, out)) == 4
    logs = t.scan_logs(spark, out.logs, out.commits)
    assert verify_rollup(logs, t.scan_rollup(spark, out.rollup, out.commits)).isEmpty()


def test_replayed_files_can_be_left_out(spark, tmp_path):
    source = body_files(tmp_path / "in", copies=2)
    twice, once = (t.LogTables(str(tmp_path / name)) for name in ("twice", "once"))
    drain(stream_ingest(spark, source, twice.root))
    assert len(_content(spark, twice)) == 8
    drain(
        stream_ingest(
            spark, source, once.root, max_bytes_per_trigger=700, replays_within="1 hour"
        )
    )
    assert t.committed_positions(spark, once.commits).popitem()[1] > 0  # several micro-batches
    assert len(_content(spark, once)) == 4


def test_keys_can_be_checked(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    add = lambda df, n: t.write_batch(
        df, n, out.logs, out.rollup, out.commits, check_keys=True
    )
    first = log_frame(spark, rows(1, [1, 2]))
    with pytest.raises(ValueError, match="duplicate key in batch"):
        add(first.union(first), 0)
    assert add(first, 0)
    with pytest.raises(ValueError, match="stored already"):
        add(log_frame(spark, rows(1, [2, 3])), 1)
    assert add(log_frame(spark, rows(1, [3])), 1)
    assert ids(spark, out) == [1, 2, 3]


def test_stateful_minute_counts(spark, tmp_path):
    logs = log_frame(spark, rows(1, range(90)) + rows(2, range(10)))
    logs.select("timestamp", "service", "level").write.parquet(str(tmp_path / "in"))
    stream = stream_minute_counts(
        spark.readStream.schema("timestamp timestamp, service string, level string").parquet(
            str(tmp_path / "in")
        )
    )
    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    drain(query)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert verify_rollup(logs, got).isEmpty()
    assert got.count() == minute_counts(logs).count()


def test_replays_are_named_by_their_bodies(spark, tmp_path):
    from tallylog.streaming.ingest import drop_replays, read_body_stream

    source = body_files(tmp_path / "in", copies=2)
    kept = drop_replays(read_body_stream(spark, source), "1 hour")
    seen = []
    query = (
        kept.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect()))
        .option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True)
        .start()
    )
    drain(query)
    digest = lambda body: hashlib.sha256(body.encode()).hexdigest()
    assert seen and all(r["batch_id"] == digest(r["body"]) for r in seen)
    assert len({r["batch_id"] for r in seen}) == len(seen)


def test_late_minutes_are_left_out(spark, tmp_path):
    source = tmp_path / "in"
    stream = lambda: spark.readStream.schema("timestamp timestamp, service string, level string").parquet(str(source))
    seen = []

    def run():
        query = (
            stream_minute_counts(stream(), "1 hour")
            .writeStream.outputMode("update")
            .foreachBatch(lambda df, _: seen.extend(df.collect()))
            .option("checkpointLocation", str(tmp_path / "c"))
            .trigger(availableNow=True)
            .start()
        )
        drain(query)

    add = lambda made: log_frame(spark, made).select("timestamp", "service", "level").write.mode("append").parquet(str(source))
    add(rows(2, range(3)))
    run()
    add(rows(1, range(5)))  # a day late
    run()
    assert sum(r["count"] for r in seen) == 3


def test_dropping_expired_days(spark, tmp_path):
    path = str(tmp_path / "logs")
    t.append_logs(log_frame(spark, [r for d in range(1, 8) for r in rows(d, [d])]), path)
    listed = sorted(r["name"] for r in stored_partitions(spark, path).collect())
    assert listed == [f"logs_2026080{d}" for d in range(1, 8)]
    now = "2026-08-10T05:00:00Z"
    assert drop_expired_days(spark, path, now, 6, limit=2) == ["logs_20260801", "logs_20260802"]
    assert drop_expired_days(spark, path, now, 6) == ["logs_20260803"]
    assert drop_expired_days(spark, path, now, 6) == []
    assert sorted(int(r["id"][-3:]) for r in t.scan_logs(spark, path).collect()) == [4, 5, 6, 7]


def test_deleting_rows_rewrites_their_folders_only(spark, tmp_path):
    path = str(tmp_path / "logs")
    t.append_logs(log_frame(spark, [r for d in (1, 2, 3) for r in rows(d, [d, d + 10])]), path)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "logs" / "event_date=2026-08-03").iterdir()}
    stored = t.scan_logs(spark, path)
    victims = stored.where(F.substring("id", -3, 3).isin("001", "011", "002"))
    assert delete_rows(spark, path, victims) == 3
    assert sorted(int(r["id"][-3:]) for r in t.scan_logs(spark, path).collect()) == [3, 12, 13]
    assert not (tmp_path / "logs" / "event_date=2026-08-01").exists()
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "logs" / "event_date=2026-08-03").iterdir()}
    assert before == after
    gone = log_frame(spark, rows(1, [1]))
    assert delete_rows(spark, path, gone) == 0


def test_deleting_rows_of_committed_tables(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    write(log_frame(spark, rows(1, [1, 2])), 0, out)
    write(log_frame(spark, rows(1, [3, 4])), 1, out)
    victims = t.scan_logs(spark, out.logs, out.commits).where("id like '%1' or id like '%2' or id like '%3'")
    assert delete_rows(spark, out.logs, victims, committed=True) == 3
    assert ids(spark, out) == [4]
    assert write(log_frame(spark, rows(1, [5])), 2, out)
    assert ids(spark, out) == [4, 5]


NOW = "2026-08-10T12:00:00Z"


def at(n, when):
    return (n, when, "info", "s", "m", {})


def day_list(spark, first, count):
    return retention._days(spark, retention._day_number(first), count)


def test_upkeep_of_committed_tables(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    made = [
        at(1, "2026-07-01T00:00:00Z"),  # a default row, expired
        at(2, "2026-08-01T23:00:00Z"),  # an expired partition
        at(3, "2026-08-02T11:59:59Z"),  # the cutoff's day
        at(4, "2026-08-02T12:00:01Z"),
        at(5, "2026-08-09T00:00:00Z"),
        at(6, "2026-08-12T00:00:00Z"),  # moves into a day that the run makes
        at(7, "2027-01-01T00:00:00Z"),  # a default row of the future
    ]
    write(log_frame(spark, made[::2]), 0, out)
    write(log_frame(spark, made[1::2]), 1, out)
    dead = log_frame(spark, [at(50, "2026-07-03T00:00:00Z"), at(51, "2026-08-02T13:00:00Z")])
    t._write_part(dead, out.logs, "batch", 2)
    assert ensure_days(spark, out, day_list(spark, "2026-08-01T00:00:00Z", 9))[1] == 4
    first = run_upkeep(spark, out, NOW, 8, expire_rollup=True).first()
    assert ids(spark, out) == [3, 4, 5, 6, 7]
    # the dead attempt's day goes, too, but its row never counted
    assert tuple(first) == ("completed", 3, 1, 1, 1, False)
    agree = lambda: verify_rollup(
        t.scan_logs(spark, out.logs, out.commits), t.scan_rollup(spark, out.rollup, out.commits)
    ).isEmpty()
    assert agree()
    # without the cutoff's day in the list its rows are cut at the instant
    left = listed_days(spark, out).where("name <> 'logs_20260802'").collect()
    spark.createDataFrame(left).write.mode("overwrite").parquet(out.days)
    again = run_upkeep(spark, out, NOW, 8, expire_rollup=True).first()
    assert (again["created"], again["deleted"], again["dropped"]) == (0, 1, 0)
    assert ids(spark, out) == [4, 5, 6, 7] and agree()
    assert spark.read.parquet(out.logs).where("writer = 'batch' and batch_id = 2").isEmpty()
    assert write(log_frame(spark, [at(8, "2026-08-09T01:00:00Z")]), 2, out)
    assert ids(spark, out) == [4, 5, 6, 7, 8] and agree()
    quiet = run_upkeep(spark, out, NOW, 8, expire_rollup=True).first()
    assert tuple(quiet) == ("completed", 0, 0, 0, 0, False)


def test_upkeep_has_no_budget_of_its_own(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    base = log_frame(spark, [at(1, "2026-01-05T00:00:00Z")])
    many = base.drop("id").crossJoin(spark.range(12000).select(F.col("id").cast("string").alias("id")))
    write(many.select(base.columns), 0, out)
    write(log_frame(spark, [at(d, f"2026-02-{d:02d}T00:00:00Z") for d in range(1, 29)]), 1, out)
    write(log_frame(spark, [at(40 + d, f"2026-03-{d:02d}T00:00:00Z") for d in range(1, 21)]), 2, out)
    ensure_days(spark, out, day_list(spark, "2026-02-01T00:00:00Z", 48))
    some = run_upkeep(spark, out, NOW, 30, max_days=3).first()
    assert (some["dropped"], some["deleted"], some["drop_budget_reached"]) == (3, 12000, True)
    rest = run_upkeep(spark, out, NOW, 30).first()
    assert (rest["dropped"], rest["deleted"], rest["drop_budget_reached"]) == (45, 0, False)


def test_a_stopped_replacement_is_finished(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    write(log_frame(spark, [at(1, "2026-08-02T01:00:00Z"), at(2, "2026-08-02T13:00:00Z")]), 0, out)
    ensure_days(spark, out, day_list(spark, "2026-08-03T00:00:00Z", 10))
    kept = t.scan_tagged(spark, out.logs, LOG_SCHEMA, out.commits).where("hour(timestamp) > 12")
    aside = f"{out.logs}/_replace"
    kept.write.partitionBy("event_date", "writer", "batch_id").parquet(aside)
    assert ids(spark, out) == [1, 2]  # readers do not see what lies aside
    run_upkeep(spark, out, NOW, 8)
    assert ids(spark, out) == [2] and not (tmp_path / "t" / "logs" / "_replace").exists()


def test_a_retry_shows_its_own_rows_only(spark, tmp_path):
    out = t.LogTables(str(tmp_path / "t"))
    first = log_frame(spark, rows(1, range(5)) + rows(2, range(5, 9)))
    t._write_part(first, out.logs, "a b=c", 0)
    t._write_part(minute_counts(first), out.rollup, "a b=c", 0)
    assert write(log_frame(spark, rows(1, [1, 2])), 0, out, "a b=c")
    assert ids(spark, out) == [1, 2]
    logs = t.scan_logs(spark, out.logs, out.commits)
    assert verify_rollup(logs, t.scan_rollup(spark, out.rollup, out.commits)).isEmpty()


def test_audits(spark):
    logs = log_frame(spark, rows(1, range(4)))
    assert set(audit.audit_constraints(logs).first()) == {0}
    broken = logs.withColumn("level", F.lit("loud")).withColumn("message", F.lit(""))
    found = audit.audit_constraints(broken).first().asDict()
    assert found["bad_level"] == 4 and found["bad_message"] == 4 and found["bad_service"] == 0
    assert audit.find_duplicate_keys(logs, ["timestamp", "id"]).isEmpty()
    with pytest.raises(ValueError, match="duplicate key"):
        audit.require_unique(logs.union(logs), ["timestamp", "id"])
    audit.require_unique(logs, ["timestamp", "id"])
    page = logs.withColumn("timestamp", F.lit("2026-08-01T10:00:00.000Z"))
    assert audit.audit_result_rows(page).isEmpty()
    assert audit.audit_result_rows(page.withColumn("id", F.lit("x"))).count() == 4
    assert audit.require_result_rows(page).count() == 4
    with pytest.raises(Exception, match="stored log row is invalid"):
        audit.require_result_rows(page.withColumn("level", F.lit("loud"))).collect()


def test_bucket_bodies(spark):
    good = '{"start":"2026-08-01T10:00:00.000Z","group":null,"count":0}'
    cases = {
        f'{{"buckets":[{good}]}}': True,
        '{"buckets":[]}': True,
        '{"buckets":{}}': False,
        "{}": False,
        "null": False,
        f'{{"buckets":[{good.replace("0}", "-1}")}]}}': False,
        f'{{"buckets":[{good.replace("0}", "1.5}")}]}}': False,
        f'{{"buckets":[{good.replace("null", "7")}]}}': False,
        f'{{"buckets":[{good.replace("2026", "x")}]}}': False,
        f'{{"buckets":[{good.replace("0}", "9007199254740992}")}]}}': False,
    }
    df = spark.createDataFrame([(c,) for c in cases], "body string")
    got = {r["body"]: r["valid"] for r in audit.validate_bucket_body(df).collect()}
    assert got == cases


def test_nothing_is_kept_or_left_aside(spark, tmp_path):
    source = body_files(tmp_path / "in")
    out = t.LogTables(str(tmp_path / "out"))
    held = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert ingest(read_log_batches(spark, source), 0, out)
    assert not ingest(read_log_batches(spark, source), 0, out)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == held
    assert t.batch_folders(spark, out.rejects, "batch", 0) == []
    assert "__HIVE_DEFAULT_PARTITION__" not in t.day_folders(spark, out.logs)
    logs = t.scan_logs(spark, out.logs, out.commits)
    assert logs.columns == LOG_SCHEMA.fieldNames()


def test_a_batch_of_rejects_only_has_accounts_and_no_rows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "bad").write_text('{"logs":[{"level":"info"},7]}\n')
    out = t.LogTables(str(tmp_path / "out"))
    assert ingest(read_log_batches(spark, str(tmp_path / "in")), 0, out)
    (account,) = spark.read.parquet(out.accounts).collect()
    assert (account["attempted"], account["accepted"], account["outcome"]) == (2, 0, "rejected")
    assert [r["index"] for r in account["rejected"]] == [0, 1]
    assert t.scan_logs(spark, out.logs, out.commits).isEmpty()
    assert t.scan_rollup(spark, out.rollup, out.commits).isEmpty()


def test_what_a_dead_attempt_left_is_not_counted(spark, tmp_path, monkeypatch):
    from tallylog.plans import ingest as plan

    source, longer = body_files(tmp_path / "in"), body_files(tmp_path / "longer", copies=2)
    clean, after = (t.LogTables(str(tmp_path / name)) for name in ("clean", "after"))
    assert ingest(read_log_batches(spark, source), 0, clean)

    def dies(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(plan, "write_commit", dies)
        with pytest.raises(OSError):
            ingest(read_log_batches(spark, longer), 0, after)
    assert ingest(read_log_batches(spark, source), 0, after)
    accounts = lambda out: sorted(map(str, spark.read.parquet(out.accounts).collect()))
    assert accounts(after) == accounts(clean)
    assert _content(spark, after) == _content(spark, clean)
