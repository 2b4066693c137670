"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  folder of the tables       (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores                (default 8)
    BENCH_ROWS    rows of the synthetic set  (default 1000000)

The events become a stored, day-partitioned log table with its minute counts, as a user has them;
the six standing queries run on that table and on a synthetic one. Ingest is timed from JSON
bodies to committed rows. Each query runs once to warm up and then three times; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tallylog.operators import metrics, paging  # noqa: E402
from tallylog.operators.aggregate import format_buckets  # noqa: E402
from tallylog.operators.filters import LogFilters, where_matching  # noqa: E402
from tallylog.operators.rollup import build_rollup  # noqa: E402
from tallylog.operators.validate import split_valid, validate_entries  # noqa: E402
from tallylog.operators.enrich import to_log_rows  # noqa: E402
from tallylog.plans.ingest import ingest  # noqa: E402
from tallylog.plans.scenarios import scenarios  # noqa: E402
from tallylog.session import configure, fresh_path  # noqa: E402
from tallylog.sources import adapters, batches, tables  # noqa: E402
from tallylog.sources.synthetic import synthetic_logs  # noqa: E402
from tallylog.streaming.ingest import drain, stream_ingest  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
ROWS = int(os.environ.get("BENCH_ROWS", "1000000"))
REFERENCE_TS = "2026-08-10T12:00:00.000Z"


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        # The tables are small: let a rebalanced write still use all cores.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2MB")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action, repeat: int = 3, warm: int = 1) -> float:
    for _ in range(warm):
        action()
    seconds = []
    for _ in range(repeat):
        started = time.perf_counter()
        action()
        seconds.append(time.perf_counter() - started)
    return statistics.median(seconds)


def store(spark, logs, label, attribute):
    out = tables.LogTables(fresh_path(spark, label))
    tables.append_logs(logs, out.logs, promoted=[attribute])
    stored = tables.scan_logs(spark, out.logs, promoted=[attribute])
    build_rollup(stored).write.partitionBy("event_date").parquet(out.rollup)
    return stored, tables.scan_rollup(spark, out.rollup)


def run_scenarios(times, prefix, logs, counts, named):
    for name, scenario in named.items():
        if scenario.bucket is None:
            times[prefix + name] = timed(lambda s=scenario: s.run(logs).collect())
        else:
            raw = lambda s=scenario: noop(format_buckets(s.run(logs)))
            times[prefix + name] = timed(raw)
            routed = lambda s=scenario: noop(format_buckets(s.run(logs, counts)))
            times[prefix + name + "_rollup"] = timed(routed)


def main() -> None:
    spark = session()
    times: dict[str, float] = {}
    rates: dict[str, float] = {}

    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    logs, counts = store(spark, adapters.events_as_logs(events), "events", "k")
    named = scenarios(
        "2024-01-29T00:00:00Z",
        "2024-01-23T00:00:00Z",
        "2024-01-30T00:00:00Z",
        attribute=("k", "69"),
    )
    run_scenarios(times, "", logs, counts, named)
    month = LogFilters(since="2024-01-01T00:00:00Z", until="2024-02-01T00:00:00Z")
    times["page_index"] = timed(lambda: noop(paging.page_index(logs, month, 100)), 1)
    requests = adapters.events_as_requests(events)
    times["latency_by_run"] = timed(
        lambda: noop(metrics.latency_summary(requests, "latency_ms", ["run"])), 1
    )
    documents = adapters.documents_as_logs(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    times["search_documents"] = timed(
        lambda: where_matching(documents, LogFilters(q="the")).agg(F.count("*")).collect()
    )

    # Ingest: JSON bodies to validated, committed rows with their minute counts.
    path = fresh_path(spark, "bodies")
    adapters.events_as_bodies(events).select("body").repartition(CPUS).write.text(path)
    entries = events.count()
    parsed = lambda: batches.read_log_batches(spark, path)
    judged = lambda: validate_entries(batches.explode_entries(parsed()))
    times["validate"] = timed(lambda: noop(judged()))
    times["validate_normalize"] = timed(lambda: noop(to_log_rows(split_valid(judged())[0], "b")))
    target = lambda: tables.LogTables(fresh_path(spark, "ingest"))
    times["ingest"] = timed(lambda: ingest(parsed(), 0, target()))
    times["stream_ingest"] = timed(lambda: drain(stream_ingest(spark, path, target().root)), 1)
    for name in ("validate", "validate_normalize", "ingest", "stream_ingest"):
        rates[f"{name}_rows_per_sec"] = entries / times[name]

    made, made_counts = store(
        spark, synthetic_logs(spark, ROWS, 20260810, REFERENCE_TS), "synthetic", "tenant_id"
    )
    windows = ("2026-08-09T12:00:00.000Z", "2026-08-03T12:00:00.000Z", REFERENCE_TS)
    run_scenarios(times, "synthetic_", made, made_counts, scenarios(*windows))
    load = fresh_path(spark, "load")
    adapters.logs_as_bodies(made, 250).select("body").repartition(CPUS).write.text(load)
    read = lambda: batches.read_log_batches(spark, load)
    times["synthetic_validate"] = timed(
        lambda: noop(validate_entries(batches.explode_entries(read()))), 1
    )
    rates["synthetic_validate_rows_per_sec"] = ROWS / times["synthetic_validate"]
    times["synthetic_ingest"] = timed(lambda: ingest(read(), 0, target()), 1)
    rates["synthetic_ingest_rows_per_sec"] = ROWS / times["synthetic_ingest"]
    times["synthetic_newest_page"] = timed(
        lambda: paging.newest_page(
            made, LogFilters(since="2026-07-11T12:00:00Z", until=REFERENCE_TS)
        ).collect()
    )
    times["synthetic_append"] = timed(
        lambda: tables.append_logs(made, fresh_path(spark, "append")), 1
    )
    rates["synthetic_append_rows_per_sec"] = ROWS / times["synthetic_append"]

    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": {k: round(v, 4) for k, v in times.items()},
                "rates": {k: round(v) for k, v in rates.items()},
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "synthetic_rows": ROWS,
                "cpus": CPUS,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
