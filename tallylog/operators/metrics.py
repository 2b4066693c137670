"""Counts, rates and percentiles over requests, ticks, samples and stored rows."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallylog.fixed import (
    DEFAULT_PARTITION,
    TARGET_AGGREGATION_P95_MS,
    TARGET_FRESHNESS_MS,
    TARGET_MEASURED_ROWS,
    TARGET_ROWS_PER_SECOND,
)
from tallylog.functions.timestamps import timestamp_text
from tallylog.schema import LOG_SCHEMA
from tallylog.session import settle

PERCENTILES = (50, 95, 99)


# --- percentiles and rates --------------------------------------------------


def is_sample(x: Column) -> Column:
    """A sample is finite and not negative."""
    return (x >= 0) & (x < F.lit(float("inf"))) & ~F.isnan(x)


def invalid_samples(df: DataFrame, column: str) -> DataFrame:
    """Rows whose sample may not enter a summary."""
    x = F.col(column).cast("double")
    return df.where(x.isNotNull() & ~is_sample(x))


def _checked(column: str) -> Column:
    x = F.col(column).cast("double")
    error = F.raise_error("Latency samples must be finite and non-negative.").cast("double")
    return F.when(x.isNull() | is_sample(x), x).otherwise(error)


def _same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


# Cells of the first histogram for each factor of e; a cell is 1.6 % wide.
CELLS_PER_E = 64
# Cells and bins that the driver takes of a histogram.
LOCAL_CELLS = 50_000
# Bins of a refined cell.
FEWEST_BINS, MOST_BINS = 64, 4096


def _cell(x: Column) -> Column:
    """A number that never falls as the sample grows; the logarithm never does."""
    return F.when(x == 0, F.lit(-(1 << 40))).otherwise(F.floor(F.log(x) * CELLS_PER_E)).cast("long")


def _counted() -> list[Column]:
    return [F.count("_x").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high")]


def _holding(cells: list, wanted: list[tuple[int, int]]) -> list[tuple[int, int, float, float, int]]:
    """(p, rank inside, low, high, n) of the cells, in order, that hold the wanted (p, rank)s."""
    found, before = [], 0
    for cell in cells:
        n = cell["n"]
        found += [(p, at - before, cell["low"], cell["high"], n) for p, at in wanted if before < at <= before + n]
        before += n
    return found


def latency_summary(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """Sample count and nearest-rank p50, p95, p99 per key; never interpolated.

    A histogram in order-preserving cells is counted per key, with partial counts, so one key with
    most of the samples sends a row per task and cell. Running totals name the cells that hold the
    ranks; these are cut into bins between their least and greatest sample and counted again, until
    a bin holds one value or what is left can be counted by value. Each round reads the samples once
    and shuffles counts only; nothing is sorted or written, and the driver gets LOCAL_CELLS counts at
    most. Where more keys than that allows have samples, the cells stay distributed
    (:func:`_many_keys`). Without samples the percentiles are null. (``percentile_disc`` gives the same numbers but keeps all samples of a key
    in one buffer.)
    """
    keys = list(keys or [])
    by = [*keys, "_all"]
    # adding zero makes a negative zero a plain one
    x = (_checked(column) + F.lit(0.0)).alias("_x")
    samples = df.select(*keys, F.lit(0).alias("_all"), x)
    # A key without samples keeps a cell that counts nothing.
    cells = samples.groupBy(*by, _cell(F.col("_x")).alias("_cell")).agg(*_counted())
    few = cells.orderBy(*by, "_cell").limit(LOCAL_CELLS + 1).collect()
    if len(few) > LOCAL_CELLS:
        return _many_keys(samples.withColumn("_cell", _cell(F.col("_x"))), cells, keys)
    groups: dict[tuple, list] = {} if keys else {(): []}
    for row in few:
        groups.setdefault(tuple(row[: len(keys)]), []).append(row)
    totals = {key: sum(row["n"] for row in rows) for key, rows in groups.items()}
    # ceil(p * n / 100) in whole numbers
    ranks = {key: [(p, (p * n + 99) // 100) for p in PERCENTILES if n] for key, n in totals.items()}
    open_ = [(key, *hit) for key, rows in groups.items() for hit in _holding(rows, ranks[key])]
    known: dict[tuple, float] = {}
    key_fields = [df.schema[k] for k in keys]
    while True:
        known.update({(key, p): low for key, p, _, low, high, _ in open_ if low == high})
        parts: dict[tuple, list[tuple[int, int]]] = {}
        for key, p, at, low, high, n in open_:
            if low != high:
                parts.setdefault((key, low, high, n), []).append((p, at))
        if not parts:
            break
        bins = max(FEWEST_BINS, min(MOST_BINS, LOCAL_CELLS // len(parts)))
        fields = [*key_fields, *(T.StructField(n, t) for n, t in (("_all", T.IntegerType()), ("_part", T.IntegerType()), ("_low", T.DoubleType()), ("_high", T.DoubleType())))]
        rows = [(*key, 0, i, low, high) for i, (key, low, high, _) in enumerate(parts)]
        frame = F.broadcast(df.sparkSession.createDataFrame(rows, T.StructType(fields)))
        inside = (samples["_x"] >= frame["_low"]) & (samples["_x"] <= frame["_high"])
        met = samples.join(frame, _same(samples, frame, by) & inside)
        place = (F.col("_x") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins
        # what is left of few samples is counted by value
        few_left = sum(n for _, _, _, n in parts) <= LOCAL_CELLS
        bin_ = F.col("_x") if few_left else F.least(F.floor(place), F.lit(bins - 1)).cast("double")
        counted = met.groupBy("_part", bin_.alias("_bin")).agg(*_counted())
        found: dict[int, list] = {}
        for row in sorted(counted.collect(), key=lambda r: (r["_part"], r["_bin"])):
            found.setdefault(row["_part"], []).append(row)
        open_ = [(key, *hit) for i, ((key, *_), want) in enumerate(parts.items()) for hit in _holding(found[i], want)]
    out = [(*key, n, *(known.get((key, p)) for p in PERCENTILES)) for key, n in totals.items()]
    fields = [T.StructField("sample_count", T.LongType()), *(T.StructField(f"p{p}", T.DoubleType()) for p in PERCENTILES)]
    return df.sparkSession.createDataFrame(out, T.StructType([*key_fields, *fields]))


def _many_keys(samples: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """The summary of more keys than the driver takes cells of. The samples of a cell that holds a
    rank are counted by value, and the rank is taken from these counts."""
    by = [*keys, "_all"]
    whole = Window.partitionBy(*by)
    running = cells.select(
        "*",
        (F.sum("n").over(whole.orderBy("_cell")) - F.col("n")).alias("_before"),
        F.sum("n").over(whole).alias("sample_count"),
    )
    rank = lambda p: F.expr(f"({p} * sample_count + 99) div 100") - F.col("_before")
    ranks = F.array(*(F.struct(F.lit(p).alias("p"), rank(p).alias("at")) for p in PERCENTILES))
    held = F.filter(ranks, lambda r: (r["at"] > 0) & (r["at"] <= F.col("n")))
    found = settle(
        running.withColumn("_ranks", held)
        .where((F.size("_ranks") > 0) | (F.col("sample_count") == 0))
        .select(*by, "_cell", "low", "high", "sample_count", "_ranks")
    )
    values = found.where("low = high").select(*by, F.explode("_ranks.p").alias("p"), F.col("low").alias("_x"))
    wanted = found.where("low < high")
    hit = samples.alias("s").join(wanted.alias("w"), _same(samples, wanted, [*by, "_cell"]))
    counted = hit.groupBy(*(F.col(f"s.{c}").alias(c) for c in [*by, "_cell", "_x"])).agg(
        F.count("*").alias("n"), F.first("w._ranks").alias("_ranks")
    )
    upto = F.sum("n").over(Window.partitionBy(*by, "_cell").orderBy("_x"))
    inside = lambda r: (r["at"] > F.col("_upto") - F.col("n")) & (r["at"] <= F.col("_upto"))
    picked = counted.withColumn("_upto", upto).select(
        *by, F.explode(F.transform(F.filter("_ranks", inside), lambda r: r["p"])).alias("p"), "_x"
    )
    named = values.unionByName(picked).groupBy(*by).agg(
        *(F.max(F.when(F.col("p") == p, F.col("_x"))).alias(f"p{p}") for p in PERCENTILES)
    )
    totals = found.groupBy(*by).agg(F.max("sample_count").alias("sample_count"))
    return totals.alias("t").join(named.alias("h"), _same(totals, named, by), "left").select(
        *(F.col(f"t.{k}") for k in keys), "sample_count", *(f"p{p}" for p in PERCENTILES)
    )


def rate_per_second(count: Column, milliseconds: Column) -> Column:
    """count × 1000 / ms; null when no time has passed or an input is not usable."""
    usable = (count >= 0) & (milliseconds > 0) & (milliseconds < F.lit(float("inf")))
    return F.when(usable, count.cast("double") * 1000 / milliseconds.cast("double"))


# --- requests ---------------------------------------------------------------

_SUCCESS = "success"


def throughput(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Confirmed and attempted rows per second between the first start and the last end."""
    started = F.col("started_ms").isNotNull()
    accepted = F.when(F.col("outcome") == _SUCCESS, F.col("accepted"))
    return (
        requests.groupBy(*keys)
        .agg(
            F.coalesce(F.sum(accepted), F.lit(0)).alias("accepted_rows"),
            F.coalesce(F.sum(F.when(started, F.col("rows"))), F.lit(0)).alias("attempted_rows"),
            (F.max("completed_ms") - F.min("started_ms")).alias("duration_ms"),
        )
        .withColumn(
            "accepted_per_second", rate_per_second(F.col("accepted_rows"), F.col("duration_ms"))
        )
        .withColumn(
            "attempted_per_second", rate_per_second(F.col("attempted_rows"), F.col("duration_ms"))
        )
    )


#: What a request came back with, and the column that counts it.
OUTCOME_COUNTS = {
    _SUCCESS: "successes",
    "http": "http_failures",
    "timeout": "timeouts",
    "transport": "transport_failures",
    "invalid-response": "invalid_responses",
}


def outcome_accounting(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests by outcome, rows by what is known of them, and whether the identities hold.

    A request without ``started_ms`` was not sent; one without ``outcome`` has not come back.
    Rows of anything but a success are indeterminate.
    """
    outcome, rows = F.col("outcome"), F.col("rows")
    started, completed = F.col("started_ms").isNotNull(), outcome.isNotNull()
    success = F.coalesce(outcome == _SUCCESS, F.lit(False))
    total = lambda condition, value: F.coalesce(F.sum(F.when(condition, value)), F.lit(0))
    counted = requests.groupBy(*keys).agg(
        F.count("*").alias("scheduled"),
        F.count_if(started).alias("started"),
        F.count_if(completed).alias("completed"),
        *(F.count_if(outcome == kind).alias(name) for kind, name in OUTCOME_COUNTS.items()),
        total(F.lit(True), rows).alias("rows_scheduled"),
        total(started, rows).alias("rows_attempted"),
        total(~started, rows).alias("rows_not_attempted"),
        total(success, F.col("accepted")).alias("rows_accepted"),
        total(success, F.col("rejected")).alias("rows_rejected"),
        total(started & ~success, rows).alias("rows_indeterminate"),
    )
    c = F.col
    by_kind = sum((c(k) for k in OUTCOME_COUNTS.values()), F.lit(0))
    return counted.select(
        "*",
        (c("scheduled") - c("started")).alias("not_started"),
        (c("started") - c("completed")).alias("unresolved"),
        ((c("started") >= c("completed")) & (c("completed") == by_kind)).alias("requests_hold"),
        (c("rows_scheduled") == c("rows_attempted") + c("rows_not_attempted")).alias("rows_hold"),
        (
            c("rows_attempted")
            == c("rows_accepted") + c("rows_rejected") + c("rows_indeterminate")
        ).alias("outcomes_hold"),
    )


def status_histogram(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Requests per status code; requests that got none are not counted."""
    answered = requests.where(F.col("status").isNotNull())
    return answered.groupBy(*keys, "status").agg(F.count("*").alias("count"))


def first_probe(requests: DataFrame) -> DataFrame:
    """The freshness probe: the earliest request of each run's measured phase.

    ``probe_accepted`` tells whether all its rows were accepted. The earliest is found as a
    minimum, which every task computes for itself first; a window would bring all requests of a
    run into one task.
    """
    others = [c for c in requests.columns if c not in ("run", "phase", "ordinal")]
    first = (
        requests.where(F.col("phase") == "measured")
        .groupBy("run", "phase")
        .agg(F.min(F.struct("ordinal", *others)).alias("first"))
        .select("run", "phase", "first.*")
    )
    accepted = (F.col("outcome") == _SUCCESS) & (F.col("accepted") == F.col("rows"))
    return first.withColumn("probe_accepted", F.coalesce(accepted, F.lit(False)))


def tick_accounting(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Scheduled ticks against started, missed, completed and unresolved ones, with their lag.

    Completed ticks are counted by ``outcome``, too; three identities have to hold.
    """
    started = F.col("started_ms").isNotNull()
    completed = F.col("completed_ms").isNotNull()
    counted = ticks.groupBy(*keys).agg(
        F.count("*").alias("scheduled"),
        F.count_if(started).alias("started"),
        F.count_if(~started).alias("missed"),
        F.count_if(started & completed).alias("completed"),
        F.count_if(started & ~completed).alias("unresolved"),
        F.count_if(~started & completed).alias("_stray"),
        *(
            F.count_if(completed & (F.col("outcome") == kind)).alias(name)
            for kind, name in OUTCOME_COUNTS.items()
        ),
    )
    by_outcome = sum((F.col(name) for name in OUTCOME_COUNTS.values()), F.lit(0))
    counted = counted.select(
        *(c for c in counted.columns if c != "_stray"),
        (F.col("scheduled") == F.col("started") + F.col("missed")).alias("schedule_holds"),
        (
            (F.col("started") == F.col("completed") + F.col("unresolved"))
            & (F.col("_stray") == 0)
        ).alias("terminal_holds"),
        (F.col("completed") == by_outcome).alias("outcomes_hold"),
    )
    lag = latency_summary(ticks, "lag_ms", keys).select(
        *keys, *(F.col(f"p{p}").alias(f"lag_p{p}") for p in PERCENTILES)
    )
    left, right = counted.alias("c"), lag.alias("l")
    return left.join(right, _same(counted, lag, keys)).select(
        "c.*", *(f"lag_p{p}" for p in PERCENTILES)
    )


def freshness(events: DataFrame, deadline_ms: int = TARGET_FRESHNESS_MS) -> DataFrame:
    """Time from dispatch and from acknowledgement until visible, null when not seen in time.

    Needs ``dispatch_ms``, ``ack_ms`` (null when not accepted) and ``visible_ms`` (null when
    never seen).
    """
    accepted = F.col("ack_ms").isNotNull()
    waited = F.col("visible_ms") - F.col("dispatch_ms")
    seen = F.coalesce(accepted & (waited <= deadline_ms), F.lit(False))
    return events.select(
        "*",
        F.when(~accepted, F.lit("probe-not-accepted"))
        .when(seen, F.lit("visible"))
        .otherwise(F.lit("deadline-exceeded"))
        .alias("freshness"),
        F.when(seen, waited).alias("dispatch_to_visible_ms"),
        F.when(seen, F.col("visible_ms") - F.col("ack_ms")).alias("ack_to_visible_ms"),
    )


# --- resource samples -------------------------------------------------------

RESOURCES = (
    "app_cpu_percent",
    "app_memory_bytes",
    "postgres_cpu_percent",
    "postgres_memory_bytes",
)


def resource_peaks(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Peak of each metric, observed span and achieved sampling rate."""
    span = F.max("elapsed_ms") - F.min("elapsed_ms")
    return (
        samples.groupBy(*keys)
        .agg(
            F.count("*").alias("sample_count"),
            F.when(F.count("*") >= 2, span).alias("span_ms"),
            *(F.max(c).alias(f"max_{c}") for c in RESOURCES),
        )
        .withColumn(
            "samples_per_second", rate_per_second(F.col("sample_count") - 1, F.col("span_ms"))
        )
    )


def sample_intervals(samples: DataFrame, key: str = "run") -> DataFrame:
    """Time since the previous sample of the same run; null for its first one.

    Samples are dealt out once, by ranges of run and time, so a run with very many samples is not
    sorted in one task as a window over it would be. Within a range each sample looks at the one
    before it; the first one looks at the last one of the range before, of which there is one per
    range. Samples of one time go by their other columns (those that have an order).
    """
    names = samples.columns
    ordered = (T.AtomicType, T.NullType)
    rest = [f.name for f in samples.schema if f.name not in (key, "elapsed_ms") and isinstance(f.dataType, ordered)]
    order = [F.col(c) for c in (key, "elapsed_ms", *rest)]
    placed = settle(
        samples.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    )
    last = placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(
        F.max_by(F.struct(F.col(key).alias("k"), F.col("elapsed_ms").alias("e")), "_at").alias("last")
    )
    ends = last.orderBy("part").collect()  # one row per range
    before = {row["part"]: (end["last"]["k"], end["last"]["e"]) for end, row in zip(ends, ends[1:])}
    where, when = names.index(key), names.index("elapsed_ms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, times, at = batch.column(where), batch.column(when), batch.column(len(names))
            if carried is None:
                first = before.get(at[0].as_py() >> 33)
                some = (None, None) if first is None else first
                carried = pa.array([some[0]], keys.type), pa.array([some[1]], times.type)
                alone = first is None
            earlier = pa.concat_arrays([carried[0], keys.slice(0, len(keys) - 1)])
            both_null = pc.and_(pc.is_null(keys), pc.is_null(earlier))
            same = pc.or_(pc.fill_null(pc.equal(keys, earlier), False), both_null)
            steps = pc.subtract(times, pa.concat_arrays([carried[1], times.slice(0, len(times) - 1)]))
            if alone:  # the very first sample of all
                same = pa.concat_arrays([pa.array([False]), same.slice(1)])
                alone = False
            carried = keys.slice(len(keys) - 1), times.slice(len(times) - 1)
            steps = pc.if_else(same, steps, pa.scalar(None, steps.type)).cast(pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], steps], [*names, "interval_ms"])

    schema = T.StructType([*samples.schema.fields, T.StructField("interval_ms", T.DoubleType())])
    return placed.mapInArrow(run, schema)


# --- verdicts and comparisons -----------------------------------------------


def ingestion_complete() -> Column:
    """Whether, by the counters of :func:`outcome_accounting`, every row was sent and confirmed.
    HTTP failures show in the rows: theirs are indeterminate."""
    none = (
        "not_started", "unresolved", "transport_failures", "timeouts", "invalid_responses",
        "rows_rejected", "rows_indeterminate", "rows_not_attempted",
    )
    return functools.reduce(
        lambda a, b: a & b,
        (F.col(c) == 0 for c in none),
        F.col("rows_accepted") == F.col("rows_scheduled"),
    )


def aggregation_complete() -> Column:
    """Whether, by the counters of :func:`tick_accounting`, every tick ran and succeeded."""
    failures = [name for kind, name in OUTCOME_COUNTS.items() if kind != _SUCCESS]
    return functools.reduce(
        lambda a, b: a & b,
        (F.col(c) == 0 for c in ("missed", "unresolved", *failures)),
        (F.col("scheduled") > 0) & (F.col("successes") == F.col("scheduled")),
    )


def assess_targets(metrics: DataFrame) -> DataFrame:
    """One row per target: value, threshold and whether it is met.

    ``metrics`` has one row per run: ``run_kind``, ``warmup_complete``, ``measured_complete``,
    ``aggregation_complete``, ``reconciled``, ``rows_per_second``, ``aggregation_p95_ms``,
    ``freshness_outcome``, ``freshness_ms``, ``configured_rows``, ``run_rows``, ``expected_rows``.
    """
    c = F.col
    targets = [
        (
            "reliable",
            c("run_rows"),
            c("expected_rows"),
            c("warmup_complete") & c("measured_complete") & c("reconciled"),
        ),
        (
            "ingest_rate",
            c("rows_per_second"),
            F.lit(TARGET_ROWS_PER_SECOND),
            c("measured_complete")
            & c("reconciled")
            & (c("rows_per_second") >= TARGET_ROWS_PER_SECOND),
        ),
        (
            "aggregation_p95",
            c("aggregation_p95_ms"),
            F.lit(TARGET_AGGREGATION_P95_MS),
            c("aggregation_complete") & (c("aggregation_p95_ms") < TARGET_AGGREGATION_P95_MS),
        ),
        (
            "aggregation_during_ingest",
            c("aggregation_p95_ms"),
            F.lit(TARGET_AGGREGATION_P95_MS),
            c("measured_complete")
            & c("aggregation_complete")
            & (c("aggregation_p95_ms") < TARGET_AGGREGATION_P95_MS),
        ),
        (
            "measured_rows",
            c("configured_rows"),
            F.lit(TARGET_MEASURED_ROWS),
            (c("configured_rows") == TARGET_MEASURED_ROWS)
            & c("reconciled")
            & (c("run_rows") == c("expected_rows")),
        ),
        (
            "freshness",
            c("freshness_ms"),
            F.lit(TARGET_FRESHNESS_MS),
            (c("freshness_outcome") == "visible") & (c("freshness_ms") <= TARGET_FRESHNESS_MS),
        ),
    ]
    rows = F.array(
        *(
            F.struct(
                F.lit(name).alias("target"),
                value.cast("double").alias("value"),
                threshold.cast("double").alias("threshold"),
                F.when(c("run_kind") != "baseline", F.lit("not-evaluated"))
                .when(F.coalesce(met, F.lit(False)), F.lit("verified"))
                .otherwise(F.lit("not-verified"))
                .alias("status"),
            )
            for name, value, threshold, met in targets
        )
    )
    return metrics.select("run", F.inline(rows))


def reconcile(counts: DataFrame) -> DataFrame:
    """Add ``delta`` and ``passed`` to rows of ``pre_existing``, ``expected``, ``observed``."""
    delta = F.col("observed") - F.col("expected")
    return counts.withColumn("delta", delta).withColumn(
        "passed", (F.col("pre_existing") == 0) & (delta == 0)
    )


def compare_metrics(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected beside observed ``value`` per key, and whether they agree (null equals null)."""
    left = expected.withColumnRenamed("value", "expected")
    right = observed.withColumnRenamed("value", "observed")
    return left.join(right, keys, "full_outer").withColumn(
        "matches", F.col("expected").eqNullSafe(F.col("observed"))
    )


def result_checksum(df: DataFrame, portable: bool = False) -> DataFrame:
    """One row: row count and a checksum that does not depend on row order.

    Hashes of all columns are added up, so each task sends one number. ``portable=True`` takes
    the first 60 bits of an md5 over the texts, which other systems can compute as well.
    """
    if portable:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in sorted(df.columns)]
        digest = F.md5(F.concat_ws("\u001f", *parts).cast("binary"))
        value = F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")
    else:
        value = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(value).cast("string"), F.lit("0")).alias("checksum"),
    )


# --- stored rows ------------------------------------------------------------


def dataset_profile(
    logs: DataFrame,
    service: str,
    marker_key: str,
    marker_value: str,
    message: str,
    partition: Column | None = None,
) -> DataFrame:
    """Row counts by several conditions, time range and number of days, in one pass."""
    where = F.to_date("timestamp").cast("string") if partition is None else partition
    return logs.agg(
        F.count("*").alias("rows"),
        F.count_if(F.size("attributes_search") == 0).alias("empty_attributes"),
        F.count_if(F.col("service") == service).alias("service_rows"),
        F.count_if(F.col("level") == "error").alias("error_rows"),
        F.count_if(
            F.element_at("attributes_search", F.lit(marker_key)) == F.lit(marker_value)
        ).alias("marker_rows"),
        F.count_if(F.col("message") == F.lit(message)).alias("message_rows"),
        F.count_if(where == F.lit(DEFAULT_PARTITION)).alias("default_partition_rows"),
        timestamp_text(F.min("timestamp")).alias("first_timestamp"),
        timestamp_text(F.max("timestamp")).alias("last_timestamp"),
        F.count_distinct(where).alias("partition_count"),
    )


def storage_summary(spark: SparkSession, path: str) -> DataFrame:
    """Rows, files and bytes per day of a stored log table.

    Reads no column, only file footers; each file's size counts once however many tasks read it.
    """
    stored = spark.read.schema(LOG_SCHEMA).parquet(path)
    per_file = stored.groupBy(
        "event_date",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_size").alias("_bytes"),
    ).agg(F.count("*").alias("_rows"))
    return per_file.groupBy("event_date").agg(
        F.sum("_rows").alias("rows"),
        F.count("*").alias("files"),
        F.sum("_bytes").alias("bytes"),
    )
