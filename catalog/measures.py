"""Profiles, percentiles, rates, accounts and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import LOGS, WITH_LOGS, canonical, events, logs, shown
from tallylog.functions import attributes
from tallylog.operators import metrics, rollup
from tallylog.session import fresh_path
from tallylog.sources import adapters, tables



def _requests(spark, sf_dir):
    return adapters.events_as_requests(events(spark, sf_dir))


def profile_comparison(spark, sf_dir):
    """Rows per service by the minute counts of all logs beside those found in a part of them."""
    rows = logs(spark, sf_dir)
    of = lambda df, value: df.groupBy("service").agg(value.alias("value"))
    expected = of(rollup.minute_counts(rows), F.sum("count"))
    observed = of(rows.where("not (level = 'warn' and service < 'service-050')"), F.count("*"))
    return metrics.compare_metrics(expected, observed, ["service"])


def log_profile(spark, sf_dir):
    return metrics.dataset_profile(
        logs(spark, sf_dir), "service-007", "k", "69", "Load Needle_%\\Path marker"
    )


def reconciliation(spark, sf_dir):
    """Per level: rows found against rows sent, where one level lacks a service."""
    rows = logs(spark, sf_dir)
    sent = rows.groupBy("level").agg(F.count("*").alias("expected"))
    kept = rows.where(~((F.col("level") == "warn") & (F.col("service") == "service-007")))
    found = kept.groupBy("level").agg(F.count("*").alias("observed"))
    counts = sent.join(found, "level").withColumn(
        "pre_existing", F.when(F.col("level") == "debug", F.lit(1)).otherwise(F.lit(0))
    )
    return metrics.reconcile(counts).select("level", "delta", "passed")


def latency_by_run(spark, sf_dir):
    return metrics.latency_summary(_requests(spark, sf_dir), "latency_ms", ["run", "phase"])


def latency_overall(spark, sf_dir):
    return metrics.latency_summary(_requests(spark, sf_dir), "latency_ms")


def latency_by_outcome(spark, sf_dir):
    return metrics.latency_summary(_requests(spark, sf_dir), "latency_ms", ["run", "outcome"])


def latency_of_nothing(spark, sf_dir):
    none = _requests(spark, sf_dir).where(F.col("latency_ms") < 0)
    return metrics.latency_summary(none, "latency_ms")


def invalid_samples(spark, sf_dir):
    shifted = _requests(spark, sf_dir).withColumn("latency_ms", F.col("latency_ms") - 20)
    return metrics.invalid_samples(shifted, "latency_ms").select("ordinal")


def request_rates(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    return requests.select(
        "ordinal", metrics.rate_per_second(F.col("accepted"), F.col("latency_ms")).alias("rate")
    )


def throughput(spark, sf_dir):
    return metrics.throughput(_requests(spark, sf_dir), ["run", "phase"])


def outcome_accounting(spark, sf_dir):
    return metrics.outcome_accounting(_requests(spark, sf_dir), ["run", "phase"])


def status_histogram(spark, sf_dir):
    return metrics.status_histogram(_requests(spark, sf_dir), ["run"])


def first_probe(spark, sf_dir):
    probe = metrics.first_probe(_requests(spark, sf_dir))
    return probe.select("run", "ordinal", "outcome", "probe_accepted")


def tick_accounting(spark, sf_dir):
    return metrics.tick_accounting(adapters.events_as_ticks(events(spark, sf_dir)), ["run"])


def freshness(spark, sf_dir):
    seen = metrics.freshness(adapters.events_as_probes(events(spark, sf_dir)), 2000)
    return seen.select(
        "event_id", "freshness", "dispatch_to_visible_ms", "ack_to_visible_ms"
    )


def resource_peaks(spark, sf_dir):
    return metrics.resource_peaks(adapters.events_as_resources(events(spark, sf_dir)), ["run"])


def sample_intervals(spark, sf_dir):
    samples = metrics.sample_intervals(adapters.events_as_resources(events(spark, sf_dir)))
    return samples.select("run", "elapsed_ms", "interval_ms")


def sample_intervals_tied(spark, sf_dir):
    """Times cut to the minute, so that many samples of a run share one; their numbers order them."""
    rows = events(spark, sf_dir)
    samples = adapters.events_as_resources(rows.withColumn("ts", F.date_trunc("minute", "ts")))
    tied = samples.select("run", (F.floor(F.col("elapsed_ms") / 3600000) * 3600000).cast("double").alias("elapsed_ms"))
    found = metrics.sample_intervals(tied)
    return found.groupBy("run", "elapsed_ms", "interval_ms").agg(F.count("*").alias("samples"))


def assess_targets(spark, sf_dir):
    """Each run's own figures against the targets. Two runs are left without failed requests and
    one without failed ticks, so verdicts differ."""
    faultless = (F.col("outcome") == "success") & (F.col("rejected") == 0)
    requests = _requests(spark, sf_dir).where(~F.col("run").isin("run-1", "run-2") | faultless)
    ticks = adapters.events_as_ticks(events(spark, sf_dir))
    ticks = ticks.where((F.col("run") != "run-1") | (F.col("outcome") == "success"))
    accounts = metrics.outcome_accounting(requests, ["run", "phase"])
    complete = metrics.ingestion_complete()
    phase = lambda name: accounts.where(F.col("phase") == name)
    measured = phase("measured").select(
        "run", complete.alias("measured_complete"), "rows_accepted", "rows_scheduled"
    )
    warmup = phase("warmup").select("run", complete.alias("warmup_complete"))
    aggregation = metrics.tick_accounting(ticks, ["run"]).select(
        "run", metrics.aggregation_complete().alias("aggregation_complete")
    )
    kept = requests.where("phase = 'measured'")
    rates = metrics.throughput(kept, ["run"]).select("run", "accepted_per_second")
    latency = metrics.latency_summary(kept, "latency_ms", ["run"])
    together = measured.join(warmup, "run").join(aggregation, "run").join(rates, "run")
    figures = together.join(latency, "run").select(
        "run",
        F.when(F.col("run") == "run-4", F.lit("smoke")).otherwise(F.lit("baseline")).alias(
            "run_kind"
        ),
        "warmup_complete",
        "measured_complete",
        "aggregation_complete",
        (F.col("rows_accepted") == F.col("rows_scheduled")).alias("reconciled"),
        (F.col("accepted_per_second") * 1000000).alias("rows_per_second"),
        F.col("p95").alias("aggregation_p95_ms"),
        F.lit("visible").alias("freshness_outcome"),
        (F.col("p50") * 500).alias("freshness_ms"),
        F.col("rows_scheduled").alias("configured_rows"),
        F.col("rows_accepted").alias("run_rows"),
        F.col("rows_scheduled").alias("expected_rows"),
    )
    return metrics.assess_targets(figures).select("run", "target", "status")


def merged_attributes(spark, sf_dir):
    """Attributes with every row's level, and on every second row another k."""
    rows = logs(spark, sf_dir)
    level = F.create_map(F.lit("level"), F.col("level"))
    both = F.map_concat(level, F.create_map(F.lit("k"), F.lit("new")))
    even = F.minute("timestamp") % 2 == 0
    merged = attributes.merge_attributes(F.col("attributes_search"), F.when(even, both).otherwise(level))
    value = lambda key: F.element_at("merged", F.lit(key)).alias(key)
    return rows.select("id", merged.alias("merged")).select("id", value("k"), value("level"))


def result_checksum(spark, sf_dir):
    rows = shown(logs(spark, sf_dir), "id", "timestamp", "level", "service", "message")
    return metrics.result_checksum(rows, portable=True)


def result_checksum_order(spark, sf_dir):
    """The checksum of the same rows in another placement."""
    rows = shown(logs(spark, sf_dir), "id", "timestamp", "level")
    a = metrics.result_checksum(rows)
    b = metrics.result_checksum(rows.repartition("id"))
    return a.unionByName(b).agg(
        F.max("rows").alias("rows"), F.count_distinct("checksum").alias("checksums")
    )


def storage_summary(spark, sf_dir):
    path = fresh_path(spark, "logs")
    tables.append_logs(logs(spark, sf_dir), path)
    stored = metrics.storage_summary(spark, path)
    return stored.select(
        F.date_format("event_date", "yyyy-MM-dd").alias("day"),
        "rows",
        (F.col("bytes") > 0).alias("has_bytes"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        profile_comparison,
        log_profile,
        reconciliation,
        latency_by_run,
        latency_overall,
        latency_by_outcome,
        latency_of_nothing,
        invalid_samples,
        request_rates,
        throughput,
        outcome_accounting,
        status_histogram,
        first_probe,
        tick_accounting,
        freshness,
        resource_peaks,
        sample_intervals,
        sample_intervals_tied,
        assess_targets,
        merged_attributes,
        result_checksum,
        result_checksum_order,
        storage_summary,
    )
}

_REQUESTS = """requests AS (
  SELECT 'run-' || (user_id % 5) AS run,
    CASE WHEN event_id % 10 = 0 THEN 'warmup' ELSE 'measured' END AS phase,
    event_id AS ordinal,
    CASE event_type WHEN 'error' THEN 'http' WHEN 'purchase' THEN 'success'
      WHEN 'click' THEN 'success' WHEN 'signup' THEN 'timeout' WHEN 'view' THEN 'transport' END
      AS outcome,
    CASE event_type WHEN 'purchase' THEN 200 WHEN 'click' THEN 200 WHEN 'error' THEN 503 END
      AS status,
    CAST(50 AS BIGINT) AS rows,
    CASE WHEN event_type IN ('purchase', 'click') THEN 50 - event_id % 3 END AS accepted,
    CASE WHEN event_type IN ('purchase', 'click') THEN event_id % 3 END AS rejected,
    CAST(epoch_us(ts) // 1000 AS DOUBLE) AS started_ms,
    CAST(epoch_us(ts) // 1000 AS DOUBLE) + value AS completed_ms,
    value AS latency_ms
  FROM events)"""

_RANKS = ", ".join(f"quantile_disc({{x}}, {p / 100}) AS {{name}}p{p}" for p in (50, 95, 99))


def _ranks(x: str, name: str = "") -> str:
    return _RANKS.format(x=x, name=name)


def _rate(count: str, ms: str) -> str:
    return f"CASE WHEN {ms} > 0 AND {count} >= 0 THEN CAST({count} AS DOUBLE) * 1000 / {ms} END"


_THROUGHPUT = f"""sums AS (SELECT {{keys}},
    CAST(coalesce(sum(accepted) FILTER (WHERE outcome = 'success'), 0) AS BIGINT)
      AS accepted_rows,
    CAST(sum(rows) AS BIGINT) AS attempted_rows,
    max(completed_ms) - min(started_ms) AS duration_ms
  FROM requests {{where}} GROUP BY ALL),
  rates AS (SELECT *, {_rate("accepted_rows", "duration_ms")} AS accepted_per_second,
    {_rate("attempted_rows", "duration_ms")} AS attempted_per_second FROM sums)"""

ORACLES = {
    "profile_comparison": f"""{WITH_LOGS}, counted AS (SELECT service, count(*) AS expected,
          nullif(count(*) FILTER (WHERE NOT (level = 'warn' AND service < 'service-050')), 0)
          AS observed FROM logs GROUP BY service)
        SELECT *, expected IS NOT DISTINCT FROM observed AS matches FROM counted""",
    "log_profile": f"""{WITH_LOGS} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS empty_attributes,
        count(*) FILTER (WHERE service = 'service-007') AS service_rows,
        count(*) FILTER (WHERE level = 'error') AS error_rows,
        count(*) FILTER (WHERE k = '69') AS marker_rows,
        count(*) FILTER (WHERE message LIKE 'Load%') AS message_rows,
        CAST(0 AS BIGINT) AS default_partition_rows,
        {canonical("min(timestamp)")} AS first_timestamp,
        {canonical("max(timestamp)")} AS last_timestamp,
        count(DISTINCT CAST(timestamp AS DATE)) AS partition_count FROM logs""",
    "reconciliation": f"""{WITH_LOGS}, deltas AS (SELECT level,
          -count(*) FILTER (WHERE level = 'warn' AND service = 'service-007') AS delta
          FROM logs GROUP BY level)
        SELECT level, delta, delta = 0 AND level <> 'debug' AS passed FROM deltas""",
    "latency_by_run": f"""WITH {_REQUESTS} SELECT run, phase, count(latency_ms) AS sample_count,
        {_ranks("latency_ms")} FROM requests GROUP BY run, phase""",
    "latency_overall": f"""WITH {_REQUESTS} SELECT count(latency_ms) AS sample_count,
        {_ranks("latency_ms")} FROM requests""",
    "latency_by_outcome": f"""WITH {_REQUESTS} SELECT run, outcome,
        count(latency_ms) AS sample_count, {_ranks("latency_ms")}
        FROM requests GROUP BY run, outcome""",
    "latency_of_nothing": f"""WITH {_REQUESTS} SELECT count(latency_ms) AS sample_count,
        {_ranks("latency_ms")} FROM requests WHERE latency_ms < 0""",
    "invalid_samples": "SELECT event_id AS ordinal FROM events WHERE value - 20 < 0",
    "request_rates": f"""WITH {_REQUESTS}
        SELECT ordinal, {_rate("accepted", "latency_ms")} AS rate FROM requests""",
    "throughput": f"""WITH {_REQUESTS}, {_THROUGHPUT.format(keys="run, phase", where="")}
        SELECT run, phase, accepted_rows, attempted_rows, duration_ms, accepted_per_second,
        attempted_per_second FROM rates""",
    "outcome_accounting": f"""WITH {_REQUESTS}
        SELECT run, phase, count(*) AS scheduled, count(*) AS started, count(*) AS completed,
        count(*) FILTER (WHERE outcome = 'success') AS successes,
        count(*) FILTER (WHERE outcome = 'http') AS http_failures,
        count(*) FILTER (WHERE outcome = 'timeout') AS timeouts,
        count(*) FILTER (WHERE outcome = 'transport') AS transport_failures,
        CAST(0 AS BIGINT) AS invalid_responses,
        CAST(sum(rows) AS BIGINT) AS rows_scheduled, CAST(sum(rows) AS BIGINT) AS rows_attempted,
        CAST(0 AS BIGINT) AS rows_not_attempted,
        CAST(coalesce(sum(accepted), 0) AS BIGINT) AS rows_accepted,
        CAST(coalesce(sum(rejected), 0) AS BIGINT) AS rows_rejected,
        CAST(coalesce(sum(rows) FILTER (WHERE outcome <> 'success'), 0) AS BIGINT)
          AS rows_indeterminate,
        CAST(0 AS BIGINT) AS not_started, CAST(0 AS BIGINT) AS unresolved,
        true AS requests_hold, true AS rows_hold, true AS outcomes_hold
        FROM requests GROUP BY run, phase""",
    "status_histogram": f"""WITH {_REQUESTS} SELECT run, status, count(*) AS count
        FROM requests WHERE status IS NOT NULL GROUP BY run, status""",
    "first_probe": f"""WITH {_REQUESTS}, ranked AS (SELECT *,
          row_number() OVER (PARTITION BY run, phase ORDER BY ordinal) AS n FROM requests)
        SELECT run, ordinal, outcome, coalesce(outcome = 'success' AND accepted = rows, false)
        AS probe_accepted FROM ranked WHERE n = 1 AND phase = 'measured'""",
    "tick_accounting": f"""SELECT 'run-' || (user_id % 5) AS run, count(*) AS scheduled,
        count(*) FILTER (WHERE event_type <> 'view') AS started,
        count(*) FILTER (WHERE event_type = 'view') AS missed,
        count(*) FILTER (WHERE event_type NOT IN ('view', 'signup')) AS completed,
        count(*) FILTER (WHERE event_type = 'signup') AS unresolved,
        count(*) FILTER (WHERE event_type IN ('purchase', 'click')) AS successes,
        count(*) FILTER (WHERE event_type = 'error') AS http_failures,
        CAST(0 AS BIGINT) AS timeouts, CAST(0 AS BIGINT) AS transport_failures,
        CAST(0 AS BIGINT) AS invalid_responses,
        true AS schedule_holds, true AS terminal_holds, true AS outcomes_hold,
        {_ranks("value", "lag_")}
        FROM events GROUP BY 1""",
    "freshness": """WITH observed AS (SELECT event_id,
          CAST(epoch_us(ts) // 1000 AS DOUBLE) AS dispatched,
          CASE WHEN event_type <> 'error' THEN CAST(epoch_us(ts) // 1000 AS DOUBLE) + value END AS acked,
          CASE WHEN event_type <> 'view'
            THEN CAST(epoch_us(ts) // 1000 AS DOUBLE) + value * (user_id % 100) END AS visible
          FROM events),
        judged AS (SELECT *, coalesce(acked IS NOT NULL AND visible - dispatched <= 2000, false)
          AS seen FROM observed)
        SELECT event_id, CASE WHEN acked IS NULL THEN 'probe-not-accepted'
          WHEN seen THEN 'visible' ELSE 'deadline-exceeded' END AS freshness,
        CASE WHEN seen THEN visible - dispatched END AS dispatch_to_visible_ms,
        CASE WHEN seen THEN visible - acked END AS ack_to_visible_ms FROM judged""",
    "resource_peaks": f"""WITH samples AS (SELECT 'run-' || (user_id % 5) AS run, *,
          CAST(epoch_us(ts) // 1000 AS DOUBLE) AS elapsed FROM events),
        peaks AS (SELECT run, count(*) AS sample_count,
          CASE WHEN count(*) >= 2 THEN max(elapsed) - min(elapsed) END AS span_ms,
          max(value) AS max_app_cpu_percent, max(event_id * 1024) AS max_app_memory_bytes,
          max(value / 2) AS max_postgres_cpu_percent,
          max(user_id * 1024) AS max_postgres_memory_bytes FROM samples GROUP BY run)
        SELECT *, {_rate("(sample_count - 1)", "span_ms")} AS samples_per_second FROM peaks""",
    "sample_intervals": """WITH samples AS (SELECT 'run-' || (user_id % 5) AS run,
          CAST(epoch_us(ts) // 1000 AS DOUBLE) AS elapsed_ms FROM events)
        SELECT run, elapsed_ms, elapsed_ms - lag(elapsed_ms)
          OVER (PARTITION BY run ORDER BY elapsed_ms) AS interval_ms FROM samples""",
    "sample_intervals_tied": """WITH samples AS (SELECT 'run-' || (user_id % 5) AS run,
          CAST(epoch_us(ts) // 3600000000 * 3600000 AS DOUBLE) AS elapsed_ms FROM events),
        steps AS (SELECT run, elapsed_ms, elapsed_ms - lag(elapsed_ms)
          OVER (PARTITION BY run ORDER BY elapsed_ms) AS interval_ms FROM samples)
        SELECT run, elapsed_ms, interval_ms, count(*) AS samples FROM steps GROUP BY ALL""",
    "assess_targets": f"""WITH {_REQUESTS.replace("requests AS", "every AS", 1)},
        requests AS (SELECT * FROM every WHERE run NOT IN ('run-1', 'run-2')
          OR (outcome = 'success' AND rejected = 0)),
        {_THROUGHPUT.format(keys="run", where="WHERE phase = 'measured'")},
        ranks AS (SELECT run, {_ranks("latency_ms")} FROM requests
          WHERE phase = 'measured' GROUP BY run),
        complete AS (SELECT run,
          bool_and(coalesce(accepted, 0) = rows) FILTER (WHERE phase = 'warmup') AS warm,
          bool_and(coalesce(accepted, 0) = rows) FILTER (WHERE phase = 'measured') AS done,
          sum(rows) FILTER (WHERE phase = 'measured') AS scheduled FROM requests GROUP BY run),
        figures AS (SELECT *, done AND accepted_per_second * 1000000 >= 15000 AS fast,
          p95 < 1000 AS quick, p50 * 500 <= 20000 AS fresh,
          done AND scheduled = 1000000 AS million, run = 'run-1' AS agg
          FROM rates JOIN ranks USING (run) JOIN complete USING (run)),
        verdicts AS (SELECT run, unnest([
          {{'target': 'reliable', 'met': warm AND done}}, {{'target': 'ingest_rate', 'met': fast}},
          {{'target': 'aggregation_p95', 'met': agg AND quick}},
          {{'target': 'aggregation_during_ingest', 'met': done AND agg AND quick}},
          {{'target': 'measured_rows', 'met': million}}, {{'target': 'freshness', 'met': fresh}}
          ]) AS v FROM figures)
        SELECT run, v.target AS target, CASE WHEN run = 'run-4' THEN 'not-evaluated'
          WHEN v.met THEN 'verified' ELSE 'not-verified' END AS status FROM verdicts""",
    "merged_attributes": f"""{WITH_LOGS} SELECT id,
        CASE WHEN minute(timestamp) % 2 = 0 THEN 'new' ELSE k END AS k, level FROM logs""",
    "result_checksum": f"""{WITH_LOGS} SELECT count(*) AS rows,
        CAST(sum(CAST(CAST('0x' || substr(md5(id || chr(31) || level || chr(31) || message ||
          chr(31) || service || chr(31) || {canonical("timestamp")}), 1, 15) AS BIGINT)
          AS HUGEINT)) AS VARCHAR) AS checksum FROM logs""",
    "result_checksum_order": """SELECT count(*) AS rows, CAST(1 AS BIGINT) AS checksums
        FROM events""",
    "storage_summary": """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows,
        true AS has_bytes FROM events GROUP BY 1""",
}
