import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import plan_text
from tallylog.operators import metrics as m
from tallylog.schema import REQUEST_SCHEMA
from tallylog.sources.synthetic import synthetic_logs


def summary(spark, samples):
    df = spark.createDataFrame([(float(s),) for s in samples], "x double")
    return tuple(m.latency_summary(df, "x").first())


def nearest_rank(samples, p):
    return sorted(samples)[max(0, math.ceil(p * len(samples) / 100) - 1)]


def test_percentiles(spark):
    golden = [10, 2, 4, 1, 8, 5, 3, 9, 6, 7]
    assert summary(spark, golden) == (10, 5, 10, 10)
    assert summary(spark, []) == (0, None, None, None)
    assert summary(spark, [7]) == (1, 7, 7, 7)


def test_keys_without_samples(spark):
    df = spark.createDataFrame([("a", None), ("a", 1.0), ("b", None)], "k string, x double")
    got = {r["k"]: tuple(r)[1:] for r in m.latency_summary(df, "x", ["k"]).collect()}
    assert got == {"a": (1, 1.0, 1.0, 1.0), "b": (0, None, None, None)}


def test_percentiles_of_skewed_groups(spark):
    """One key has most samples, one sample value has most of those."""
    rng = random.Random(3)
    groups = {
        "hot": [0.5] * 3000 + [rng.random() for _ in range(2000)],
        "flat": [1.0] * 100,
        "two": [1.0, 2.0],
        None: [rng.expovariate(1) for _ in range(77)],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(8)
    got = {r["k"]: tuple(r)[1:] for r in m.latency_summary(df, "x", ["k"]).collect()}
    assert got == {
        k: (len(xs), *(nearest_rank(xs, p) for p in (50, 95, 99))) for k, xs in groups.items()
    }


@pytest.mark.parametrize("cells", [50_000, 300, 2])
def test_percentiles_of_close_and_far_samples(spark, monkeypatch, cells):
    """Samples that share a cell, one cell with all ranks, zeros, tiny and huge ones; also refined by
    bins, and with more cells than the driver takes."""
    monkeypatch.setattr(m, "LOCAL_CELLS", cells)
    if cells == 300:
        monkeypatch.setattr(m, "CELLS_PER_E", 1)
    rng = random.Random(5)
    groups = {
        "close": [1000 + rng.random() * 1e-6 for _ in range(900)],
        "steps": [math.nextafter(3.0, 4) if i % 3 else 3.0 for i in range(50)],
        "zeros": [0.0] * 60 + [-0.0] * 5 + [5e-324, 1e-300, 1.7e308],
        "spread": [10 ** rng.uniform(-12, 12) for _ in range(500)],
        None: [float(i) for i in range(1, 101)],
        "none": [None],
    }
    rows = [(k, x) for k, xs in groups.items() for x in xs]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double").repartition(5)
    got = {r["k"]: tuple(r)[1:] for r in m.latency_summary(df, "x", ["k"]).collect()}
    full = {k: [x for x in xs if x is not None] for k, xs in groups.items()}
    assert got == {k: (len(xs), *(nearest_rank(xs, p) if xs else None for p in (50, 95, 99))) for k, xs in full.items()}


def test_percentiles_sort_and_write_nothing(spark, monkeypatch):
    monkeypatch.setattr(m, "settle", None)
    df = spark.range(5000).select((F.col("id") % 977 / 7).alias("x"), (F.col("id") % 3).alias("k"))
    context = spark.sparkContext
    context.setJobGroup("percentiles", "percentiles")
    try:
        found = {r["k"]: tuple(r)[1:] for r in m.latency_summary(df, "x", ["k"]).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    groups = {k: [i % 977 / 7 for i in range(5000) if i % 3 == k] for k in range(3)}
    assert found == {k: (len(xs), *(nearest_rank(xs, p) for p in (50, 95, 99))) for k, xs in groups.items()}
    assert len(context.statusTracker().getJobIdsForGroup("percentiles")) <= 8  # two rounds and the result, stage by stage


@pytest.mark.parametrize("bad", [-1.0, float("nan"), float("inf")])
def test_bad_samples(spark, bad):
    df = spark.createDataFrame([(1.0,), (bad,)], "x double")
    assert m.invalid_samples(df, "x").count() == 1
    with pytest.raises(Exception, match="finite and non-negative"):
        m.latency_summary(df, "x").collect()


def test_rates(spark):
    cases = [(5, 2000.0, 2.5), (0, 10.0, 0.0), (5, 0.0, None), (5, -1.0, None), (-1, 5.0, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "n long, ms double")
    got = [r[0] for r in df.select(m.rate_per_second(F.col("n"), F.col("ms"))).collect()]
    assert got == [c[2] for c in cases]


def requests(spark):
    rows = [
        ("r", "measured", 0, "success", 200, 2, 1, 1, 0.0, 10.0, 10.0),
        ("r", "measured", 1, "http", 503, 2, None, None, 10.0, 20.0, 10.0),
        ("r", "measured", 2, "timeout", None, 2, None, None, 20.0, 30.0, 10.0),
        ("r", "measured", 3, "transport", None, 2, None, None, 30.0, 40.0, 10.0),
        ("r", "measured", 4, "invalid-response", 200, 2, None, None, 40.0, 50.0, 10.0),
    ]
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def test_outcomes(spark):
    got = m.outcome_accounting(requests(spark), ["run", "phase"]).first().asDict()
    assert {k: got[k] for k in ("scheduled", "started", "completed", "not_started")} == {
        "scheduled": 5,
        "started": 5,
        "completed": 5,
        "not_started": 0,
    }
    assert (got["rows_scheduled"], got["rows_attempted"], got["rows_not_attempted"]) == (10, 10, 0)
    assert (got["rows_accepted"], got["rows_rejected"], got["rows_indeterminate"]) == (1, 1, 8)
    assert (got["timeouts"], got["transport_failures"], got["invalid_responses"]) == (1, 1, 1)
    assert got["requests_hold"] and got["rows_hold"] and got["outcomes_hold"]
    codes = {r["status"]: r["count"] for r in m.status_histogram(requests(spark), ["run"]).collect()}
    assert codes == {200: 2, 503: 1}
    speed = m.throughput(requests(spark), ["run"]).first()
    assert (speed["duration_ms"], speed["accepted_per_second"]) == (50.0, 20.0)
    assert speed["attempted_per_second"] == 200.0


def test_work_not_attempted(spark):
    rows = [
        ("r", "measured", 0, "success", 200, 2, 2, 0, 0.0, 10.0, 10.0),
        ("r", "measured", 1, None, None, 2, None, None, None, None, None),
        ("r", "measured", 2, None, None, 2, None, None, 5.0, None, None),
    ]
    df = spark.createDataFrame(rows, REQUEST_SCHEMA)
    got = m.outcome_accounting(df, ["run"]).first().asDict()
    assert (got["not_started"], got["unresolved"], got["rows_not_attempted"]) == (1, 1, 2)
    assert got["requests_hold"] and got["rows_hold"] and got["outcomes_hold"]
    wrong = df.withColumn("accepted", F.lit(1).cast("long"))
    assert not m.outcome_accounting(wrong, ["run"]).first()["outcomes_hold"]


def test_first_probe(spark):
    probe = m.first_probe(requests(spark)).first()
    assert (probe["ordinal"], probe["probe_accepted"]) == (0, False)


def test_freshness(spark):
    rows = [(1, 0.0, 10.0, 100.0), (2, 0.0, 10.0, 20000.0), (3, 0.0, 10.0, 20001.0), (4, 0.0, 10.0, None), (5, 0.0, None, 100.0)]
    df = spark.createDataFrame(rows, "n int, dispatch_ms double, ack_ms double, visible_ms double")
    got = {r["n"]: tuple(r)[4:] for r in m.freshness(df).collect()}
    assert got == {
        1: ("visible", 100.0, 90.0),
        2: ("visible", 20000.0, 19990.0),
        3: ("deadline-exceeded", None, None),
        4: ("deadline-exceeded", None, None),
        5: ("probe-not-accepted", None, None),
    }


def test_resources(spark):
    rows = [("a", 0.0, 5.0, 10, 1.0, 7), ("a", 1000.0, 3.0, 30, 2.0, 5), ("a", 3000.0, 4.0, 20, 0.0, 6), ("b", 50.0, 1.0, 1, 1.0, 1)]
    columns = "run string, elapsed_ms double, app_cpu_percent double, app_memory_bytes long, postgres_cpu_percent double, postgres_memory_bytes long"
    df = spark.createDataFrame(rows, columns).repartition(3)
    peaks = {r["run"]: tuple(r)[1:] for r in m.resource_peaks(df, ["run"]).collect()}
    assert peaks["a"] == (3, 3000.0, 5.0, 30, 2.0, 7, 2000 / 3000)
    assert peaks["b"] == (1, None, 1.0, 1, 1.0, 1, None)
    steps = m.sample_intervals(df).select("run", "elapsed_ms", "interval_ms").collect()
    assert sorted(map(tuple, steps)) == [
        ("a", 0.0, None),
        ("a", 1000.0, 1000.0),
        ("a", 3000.0, 2000.0),
        ("b", 50.0, None),
    ]


def test_intervals_across_ranges_and_ties(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]) if i % 3 else "hot", float(rng.randint(0, 300)), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "run string, elapsed_ms double, note long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = m.sample_intervals(df)
        got = sorted(map(tuple, found.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, before = [], None
    for row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2])):
        expected.append((*row, None if before is None or before[0] != row[0] else row[1] - before[1]))
        before = row
    assert got == sorted(expected, key=str)
    assert "Join" not in plan_text(found) and found.columns == ["run", "elapsed_ms", "note", "interval_ms"]
    assert m.sample_intervals(df.where("note < 0")).collect() == []


def test_ticks(spark):
    rows = [
        ("r", 1.0, 5.0, "success", 1.0),
        ("r", None, None, None, 3.0),
        ("r", 2.0, None, None, 2.0),
        ("r", 3.0, 4.0, "http", 2.0),
        ("all", 1.0, 2.0, "success", 1.0),
        ("odd", 1.0, 2.0, "mystery", 1.0),
    ]
    df = spark.createDataFrame(rows, "run string, started_ms double, completed_ms double, outcome string, lag_ms double")
    counted = m.tick_accounting(df, ["run"])
    got = {r["run"]: r for r in counted.withColumn("complete", m.aggregation_complete()).collect()}
    r = got["r"]
    assert [r[c] for c in ("scheduled", "started", "missed", "completed", "unresolved")] == [4, 3, 1, 2, 1]
    assert [r[c] for c in m.OUTCOME_COUNTS.values()] == [1, 1, 0, 0, 0]
    assert r["schedule_holds"] and r["terminal_holds"] and r["outcomes_hold"] and not r["complete"]
    assert (r["lag_p50"], r["lag_p99"]) == (2.0, 3.0)
    assert got["all"]["complete"] and got["all"]["outcomes_hold"]
    assert not got["odd"]["outcomes_hold"] and not got["odd"]["complete"]


def test_complete_ingestion(spark):
    names = "run string, outcome string, rows long, accepted long, rejected long, started_ms double"
    rows = [
        ("whole", "success", 5, 5, 0, 1.0),
        ("some", "success", 5, 4, 1, 1.0),
        ("http", "http", 5, None, None, 1.0),
        ("unsent", None, 5, None, None, None),
        ("lost", None, 5, None, None, 1.0),
    ]
    counted = m.outcome_accounting(spark.createDataFrame(rows, names), ["run"])
    got = {r["run"]: r["complete"] for r in counted.withColumn("complete", m.ingestion_complete()).collect()}
    assert got == {"whole": True, "some": False, "http": False, "unsent": False, "lost": False}


def test_reconcile_and_compare(spark):
    df = spark.createDataFrame([(0, 5, 5), (1, 5, 5), (0, 5, 4)], "pre_existing int, expected int, observed int")
    assert [r["passed"] for r in m.reconcile(df).collect()] == [True, False, False]
    a = spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], "k string, value int")
    b = spark.createDataFrame([("x", 1), ("y", None), ("w", 3)], "k string, value int")
    got = {r["k"]: r["matches"] for r in m.compare_metrics(a, b, ["k"]).collect()}
    assert got == {"x": True, "y": True, "z": False, "w": False}


def test_targets(spark):
    columns = (
        "run string, run_kind string, warmup_complete boolean, measured_complete boolean, "
        "aggregation_complete boolean, reconciled boolean, rows_per_second double, "
        "aggregation_p95_ms double, freshness_outcome string, freshness_ms double, "
        "configured_rows long, run_rows long, expected_rows long"
    )
    base = ["good", "baseline", True, True, True, True, 15000.0, 999.9, "visible", 20000.0, 1000000, 1010000, 1010000]
    slow = ["slow", "baseline", True, True, True, True, 14999.9, 1000.0, "visible", 20000.1, 999999, 5, 5]
    smoke = ["smoke", "smoke", *base[2:]]
    empty = ["empty", "baseline", True, True, True, True, None, None, "aborted", None, 1000000, 5, 6]
    df = spark.createDataFrame([base, slow, smoke, empty], columns)
    got = {}
    for r in m.assess_targets(df).collect():
        got.setdefault(r["run"], {})[r["target"]] = r["status"]
    assert set(got["good"].values()) == {"verified"}
    assert set(got["smoke"].values()) == {"not-evaluated"}
    assert got["slow"] == {
        "reliable": "verified",
        "ingest_rate": "not-verified",
        "aggregation_p95": "not-verified",
        "aggregation_during_ingest": "not-verified",
        "measured_rows": "not-verified",
        "freshness": "not-verified",
    }
    assert got["empty"]["ingest_rate"] == got["empty"]["measured_rows"] == "not-verified"


def test_checksums(spark):
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("s"))
    for portable in (False, True):
        one = m.result_checksum(df, portable).first()
        assert one == m.result_checksum(df.repartition(7).orderBy("s"), portable).first()
        assert one != m.result_checksum(df.where("id <> 5"), portable).first()
        changed = df.withColumn("s", F.when(F.col("id") == 5, "6").otherwise(F.col("s")))
        assert one != m.result_checksum(changed, portable).first()


def test_synthetic_logs_repeat(spark):
    make = lambda n: synthetic_logs(spark, n, 3, "2026-08-10T12:00:00.000Z")
    one, other = make(5000), make(5000).repartition(7)
    plain = lambda df: m.result_checksum(df.drop("created_at", "attributes_search")).first()
    assert plain(one) == plain(other)
    assert one.select("id").distinct().count() == 5000
    assert plain(make(100)) == plain(one.join(make(100).select("id"), "id", "left_semi").select(one.columns))
    profile = m.dataset_profile(one, "service-007", "attempt", "0", "Load Needle_%\\Path marker").first()
    assert 1500 < profile["service_rows"] < 1900 and profile["empty_attributes"] == 0
    assert 150 < profile["error_rows"] < 350 and profile["message_rows"] < 30
    assert profile["partition_count"] in (30, 31)
