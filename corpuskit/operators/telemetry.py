"""Run telemetry: log parsing, stage durations, resource samples and limits.

The in-process monitor of the reference (timed stages, before/after resource
lines, limit checks with throttle delays) is re-aimed at tables: logs and
resource samples are data, analysed with regex extraction, windows and
aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.segments import ROWS_PER_BUCKET, order_bucket, range_bucket, with_neighbour
from corpuskit.sources.runlog import parse_log  # noqa: F401  (re-export)

# Message layouts of the stage and resource log lines.
START_RE = r"^Starting (.+)\.\.\.$"
DONE_RE = r"^\S* ?Completed (.+) in ([0-9.]+)s$"
FAIL_RE = r"^\S* ?Failed during (.+) after ([0-9.]+)s: (.*)$"
RES_RE = (r"^(.*?) ?Resources - CPU: ([0-9.]+)%, RAM: ([0-9.]+)/([0-9.]+) GB \(([0-9.]+)%\), "
          r"GPU: ([0-9.]+)% \(([0-9.]+)(?:/([0-9.]+))? GB\)$")
# Default limits of the batch trainer's monitor (ratios) and the delay factor.
CPU_MAX, RAM_MAX, GPU_MAX = 0.5, 0.33, 0.5
DELAY_PER_UNIT = 0.1


def stage_events(parsed: DataFrame) -> DataFrame:
    """Stage boundary events: ``kind`` in (start, completed, failed) with the
    stage name and the reported seconds of end events."""
    m = F.col("message")
    kind = F.when(m.rlike(START_RE), "start").when(m.rlike(DONE_RE), "completed") \
        .when(m.rlike(FAIL_RE), "failed")
    stage = F.when(m.rlike(START_RE), F.regexp_extract(m, START_RE, 1)) \
        .when(m.rlike(DONE_RE), F.regexp_extract(m, DONE_RE, 1)) \
        .when(m.rlike(FAIL_RE), F.regexp_extract(m, FAIL_RE, 1))
    secs = F.when(m.rlike(DONE_RE), F.regexp_extract(m, DONE_RE, 2)) \
        .when(m.rlike(FAIL_RE), F.regexp_extract(m, FAIL_RE, 2)).cast("double")
    return parsed.select("*", kind.alias("kind"), stage.alias("stage"), secs.alias("reported_seconds")) \
        .where(F.col("kind").isNotNull())


def stage_durations(parsed: DataFrame, run_cols=(), order_col: str = "line_no", bucket_rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per stage run: start/end time, status, reported seconds and wall
    seconds.  Each start is paired, in line order, with the next event of the
    same stage if that is an end; a start without one is ``unfinished`` (no end,
    no seconds).  A stage's lines are spread over buckets of the line order, so
    one that holds most lines isn't one task."""
    ev = stage_events(parsed)
    ev = with_neighbour(ev, [*run_cols, "stage"], order_col, ["kind", "ts", "reported_seconds"], order_bucket(ev, order_col, bucket_rows))
    ev = ev.select("*", F.col("_next.kind").alias("_next_kind"), F.col("_next.ts").alias("_next_ts"), F.col("_next.reported_seconds").alias("_next_secs"))
    done = F.coalesce(F.col("_next_kind").isin("completed", "failed"), F.lit(False))
    wall = (F.unix_micros(F.col("_next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return ev.where(F.col("kind") == "start").select(
        *run_cols, "stage", F.col(order_col).alias("start_line"), F.col("ts").alias("start_ts"), F.when(done, F.col("_next_ts")).alias("end_ts"),
        F.when(done, F.col("_next_kind")).otherwise(F.lit("unfinished")).alias("status"),
        F.when(done, F.col("_next_secs")).alias("reported_seconds"), F.when(done, F.round(wall, 3)).alias("wall_seconds"))


def resource_samples(parsed: DataFrame) -> DataFrame:
    """Resource lines as samples (percent fields as ratios, sizes in GB);
    ``phase`` Before/After and ``stage`` come from the line prefix."""
    m = F.col("message")
    x = lambda i: F.regexp_extract(m, RES_RE, i)
    prefix = x(1)
    pm = r"^(Before|After) (.+)$"
    return parsed.where(m.rlike(RES_RE)).select(
        "*",
        F.when(prefix.rlike(pm), F.regexp_extract(prefix, pm, 1)).alias("phase"),
        F.when(prefix.rlike(pm), F.regexp_extract(prefix, pm, 2)).otherwise(prefix).alias("stage"),
        (x(2).cast("double") / 100).alias("cpu_usage"),
        x(3).cast("double").alias("ram_usage_gb"),
        x(4).cast("double").alias("ram_total_gb"),
        (x(5).cast("double") / 100).alias("ram_ratio"),
        (x(6).cast("double") / 100).alias("gpu_usage"),
        x(7).cast("double").alias("gpu_memory_gb"))


def stage_resource_delta(samples: DataFrame, run_cols=(), order_col: str = "line_no", bucket_rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """After minus before per run of a stage: each Before sample is paired with
    the next sample of its stage, in line order, if that is an After.  Lines are
    spread over buckets as in :func:`stage_durations`."""
    fields = ("cpu_usage", "ram_usage_gb", "ram_ratio", "gpu_usage")
    s = samples.where(F.col("phase").isNotNull())
    s = with_neighbour(s, [*run_cols, "stage"], order_col, ["phase", *fields], order_bucket(s, order_col, bucket_rows), "_row")
    s = s.select("*", F.col("_row.phase").alias("_next"), *[F.col(f"_row.{c}").alias(f"_{c}") for c in fields])
    names = ("cpu_delta", "ram_gb_delta", "ram_ratio_delta", "gpu_delta")
    return s.where((F.col("phase") == "Before") & (F.col("_next") == "After")).select(
        *run_cols, "stage", F.col(order_col).alias("before_line"),
        *[F.round(F.col(f"_{c}") - F.col(c), 6).alias(n) for c, n in zip(fields, names)])


def span_seconds(df: DataFrame, key_cols, start_col: str, end_col: str, digits: int = 2) -> DataFrame:
    """Latency per key: seconds from ``start_col`` to ``end_col``, rounded
    (the ``end - start`` timing of a stage, an answer, a task)."""
    secs = (F.unix_micros(F.col(end_col).cast("timestamp")) - F.unix_micros(F.col(start_col).cast("timestamp"))) / 1e6
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    return df.select(*keys, start_col, end_col, F.round(secs, digits).alias("seconds"))


def first_last_delta(samples: DataFrame, key_col: str, order_col: str, tie_col: str, value_cols) -> DataFrame:
    """Per key: value at the last sample minus value at the first ("after -
    before"), by ``max_by``/``min_by`` aggregation (map-side combinable)."""
    vals = [value_cols] if isinstance(value_cols, str) else list(value_cols)
    order = F.struct(F.col(order_col), F.col(tie_col))
    aggs = []
    for v in vals:
        aggs.append(F.round(F.max_by(F.col(v), order) - F.min_by(F.col(v), order), 6).alias(f"{v}_delta"))
    return samples.groupBy(key_col).agg(F.count(F.lit(1)).alias("n_samples"), *aggs)


def ram_ratio(used, total) -> Column:
    """used / total, NULL when total is 0 (no division error)."""
    u = F.col(used) if isinstance(used, str) else used
    t = F.col(total) if isinstance(total, str) else total
    return F.try_divide(u, t)


def bytes_to_gb(c) -> Column:
    x = F.col(c) if isinstance(c, str) else c
    return x / F.lit(1024 ** 3)


def with_limits(samples: DataFrame, cpu_max: float = CPU_MAX, ram_max: float = RAM_MAX,
                gpu_max: float = GPU_MAX) -> DataFrame:
    """Per sample: ``within_limits`` (all three ratios at or below the limit),
    the individual breach flags and the recommended CPU throttle delay."""
    cpu, ram, gpu = F.col("cpu_usage"), F.col("ram_ratio"), F.col("gpu_usage")
    return samples.select(
        "*",
        F.coalesce((cpu <= cpu_max) & (ram <= ram_max) & (gpu <= gpu_max), F.lit(False)).alias("within_limits"),
        F.coalesce(cpu > cpu_max, F.lit(False)).alias("cpu_breach"),
        F.coalesce(ram > ram_max, F.lit(False)).alias("ram_breach"),
        F.coalesce(gpu > gpu_max, F.lit(False)).alias("gpu_breach"),
        (F.greatest(cpu - F.lit(cpu_max), F.lit(0.0)) * DELAY_PER_UNIT).alias("throttle_delay"))


def limit_breaches(samples: DataFrame, by=None, **limits) -> DataFrame:
    """Breach counts and total recommended delay (per ``by`` group)."""
    s = with_limits(samples, **limits)
    aggs = [F.count(F.lit(1)).alias("n_samples"),
            F.count_if(~F.col("within_limits")).alias("n_breaches"),
            F.count_if("cpu_breach").alias("cpu_breaches"),
            F.count_if("ram_breach").alias("ram_breaches"),
            F.count_if("gpu_breach").alias("gpu_breaches"),
            F.round(F.sum("throttle_delay"), 6).alias("total_delay")]
    return (s.groupBy(by) if by else s).agg(*aggs)


def tumbling_breaches(samples: DataFrame, ts_col: str = "ts", width: str = "1 hour", **limits) -> DataFrame:
    """Batch twin of the streaming monitor: per tumbling window, sample count,
    mean/max CPU and breach count."""
    s = with_limits(samples, **limits)
    g = s.groupBy(F.window(F.col(ts_col), width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.round(F.avg("cpu_usage"), 6).alias("avg_cpu"),
        F.round(F.max("cpu_usage"), 6).alias("max_cpu"),
        F.count_if(~F.col("within_limits")).alias("n_breaches"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "n_samples", "avg_cpu", "max_cpu", "n_breaches")


def level_counts(parsed: DataFrame, level_col: str = "level") -> DataFrame:
    return parsed.groupBy(level_col).agg(F.count(F.lit(1)).alias("n_messages"))


def event_gaps(events: DataFrame, key_col: str, ts_col: str, id_col: str, bucket: Column | None = None) -> DataFrame:
    """Seconds since the previous event of the same key (NULL for the first).

    ``lag`` as a segmented scan: windows are partitioned by (key, bucket of the
    time), so a hot key is spread over its buckets; the first event of a bucket
    takes the last one of the key's previous bucket from a carry table.  Buckets
    hold about equally many events of all keys (quantiles of the time), whatever
    the times' distribution; ``bucket`` may give others that follow the time.
    """
    b = range_bucket(events, ts_col) if bucket is None else bucket
    d = with_neighbour(events, [key_col], [ts_col, id_col], [F.col(ts_col).alias("ts")], b, "_prev", back=True)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return d.withColumn("gap_seconds", F.round((micros(F.col(ts_col)) - micros(F.col("_prev.ts"))) / 1e6, 6)).drop("_prev")


__all__ = ["parse_log", "stage_events", "stage_durations", "resource_samples", "stage_resource_delta",
           "span_seconds", "first_last_delta", "ram_ratio", "bytes_to_gb", "with_limits", "limit_breaches", "tumbling_breaches",
           "level_counts", "event_gaps"]
