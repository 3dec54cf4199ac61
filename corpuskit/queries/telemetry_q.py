"""Telemetry queries over ``events`` read as resource samples / messages:
cpu = value / 500, ram ratio = props.k / 100, gpu = 0."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import functions as F

from corpuskit.operators import telemetry as tm
from corpuskit.queries.common import table
from corpuskit.session import ensure_checkpoint_dir
from corpuskit.streaming.monitor import monitor_stream


def samples_of(e):
    """Events read as resource samples (works on batch and streaming frames)."""
    return e.select("event_id", "event_type", "user_id", F.col("ts").cast("timestamp").alias("ts"),
                    (F.col("value") / 500).alias("cpu_usage"),
                    (F.get_json_object("props", "$.k").cast("double") / 100).alias("ram_ratio"),
                    F.lit(0.0).alias("gpu_usage"))


def samples(spark, d):
    return samples_of(table(spark, d, "events"))


def q_stream_monitor(spark, d):
    """The Structured Streaming monitor over the events file (file source,
    availableNow); equals its batch twin."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    name = "stream_monitor_" + uuid.uuid4().hex[:12]
    ck = ensure_checkpoint_dir(spark).rstrip("/") + "/" + name
    # Each trigger replaces the windows' table in the shared folder.
    put = lambda batch, _: batch.write.mode("overwrite").parquet(f"{ck}/out")
    q = monitor_stream(samples_of(stream), "ts", "1 hour", "1 day").writeStream.foreachBatch(put) \
        .outputMode("complete").option("checkpointLocation", f"{ck}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{ck}/out")


def q_stream_late_rows(spark, d):
    """The monitor in append mode over three files, one a micro-batch.  A batch
    drops rows that the watermark of the batch before last had closed, so rows of
    the third file whose window the first file's watermark passed come too late."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/stream_late_" + uuid.uuid4().hex[:12]
    events = table(spark, d, "events")
    for k in (0, 1, 2):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.parquet(f"{base}/src/part={k}")
        time.sleep(1.1)  # files are read in the order of their times
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src/part=*")
    out = monitor_stream(samples_of(stream), "ts", "1 hour", "1 day")
    q = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck") \
        .outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("avg_cpu")  # a mean over batches may differ in its last digit


def q_limit_breaches(spark, d):
    return tm.limit_breaches(samples(spark, d), by="event_type")


def q_memory_shares(spark, d):
    """Sizes in bytes as gigabytes, and used over total (NULL where the total is 0)."""
    e = table(spark, d, "events").select("event_id", (F.col("value") * 1e9).alias("used"), ((F.col("event_id") % 5) * 1e11).alias("total"))
    return e.select("event_id", F.round(tm.bytes_to_gb("used"), 6).alias("used_gb"), F.round(tm.ram_ratio("used", "total"), 6).alias("ratio"))


def q_tumbling_breaches(spark, d):
    return tm.tumbling_breaches(samples(spark, d), "ts", "1 hour")


def q_level_counts(spark, d):
    return tm.level_counts(table(spark, d, "events"), "event_type")


def q_event_gaps(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return tm.event_gaps(e, "user_id", "ts", "event_id").select("event_id", "user_id", "gap_seconds")


def q_order_latency(spark, d):
    # Start (order placed) paired with the end of the same task (last shipment).
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("start_ts"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")) \
        .agg(F.max("l_shipdate").alias("end_ts"))
    j = o.join(li, "o_orderkey")
    return tm.span_seconds(j, "o_orderkey", "start_ts", "end_ts") \
        .select("o_orderkey", F.date_format("start_ts", "yyyy-MM-dd HH:mm:ss").alias("start_ts"),
                F.date_format("end_ts", "yyyy-MM-dd HH:mm:ss").alias("end_ts"), "seconds")


def q_sample_deltas(spark, d):
    return tm.first_last_delta(samples(spark, d), "user_id", "ts", "event_id", ["cpu_usage", "ram_ratio"])


def log_lines(spark, d):
    """Events rendered as log lines ``(user_id, line_no, value)``, four per event
    of a user's log: a stage (the event type) starts, is sampled before and
    after, and completes, fails (1 in 10) or is cut off (1 in 10: no end line)."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    n, took = F.col("event_id") % 10, F.col("event_id") % 100
    at = lambda ts, level: F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(f" - {level} - [monitor] - "))
    end = F.timestamp_micros(F.unix_micros("ts") + took * 10_000)
    secs = F.format_string("%.2fs", took / 100)
    res = lambda phase, cpu, gb: F.concat(at(F.col("ts"), "INFO"), F.format_string(
        phase + " %s Resources - CPU: %d.0%%, RAM: %d.0/64.0 GB (%d.0%%), GPU: 0.0%% (0.0/8.0 GB)", "event_type", cpu, gb, gb))
    lines = F.array(
        F.concat(at(F.col("ts"), "INFO"), F.lit("Starting "), F.col("event_type"), F.lit("...")),
        res("Before", F.col("event_id") % 50, F.col("event_id") % 30), res("After", F.col("event_id") % 50 + F.col("event_id") % 7, F.col("event_id") % 30 + 2),
        F.when(n == 0, F.lit(None)).when(n == 1, F.concat(at(end, "ERROR"), F.lit("❌ Failed during "), F.col("event_type"), F.lit(" after "), secs, F.lit(": lost")))
        .otherwise(F.concat(at(end, "INFO"), F.lit("✅ Completed "), F.col("event_type"), F.lit(" in "), secs)))
    return e.select("event_id", "user_id", F.posexplode(lines).alias("k", "value")).where(F.col("value").isNotNull()) \
        .select("user_id", (F.col("event_id") * 4 + F.col("k")).alias("line_no"), "value")


def q_parse_log(spark, d):
    p = tm.parse_log(log_lines(spark, d))
    return p.select("line_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"), "level", "logger", "message", "parsed")


def q_resource_samples(spark, d):
    s = tm.resource_samples(tm.parse_log(log_lines(spark, d)))
    return s.select("line_no", "phase", "stage", "cpu_usage", "ram_usage_gb", "ram_total_gb", "ram_ratio", "gpu_usage", "gpu_memory_gb")


def q_stage_durations(spark, d):
    out = tm.stage_durations(tm.parse_log(log_lines(spark, d)), ["user_id"])
    return out.select("user_id", "stage", "start_line", "status", "reported_seconds", "wall_seconds")


def q_stage_resource_delta(spark, d):
    s = tm.resource_samples(tm.parse_log(log_lines(spark, d)))
    return tm.stage_resource_delta(s, ["user_id"])


QUERIES = {
    "stream_monitor": q_stream_monitor,
    "stream_late_rows": q_stream_late_rows,
    "order_latency": q_order_latency,
    "sample_deltas": q_sample_deltas,
    "parse_log": q_parse_log,
    "resource_samples": q_resource_samples,
    "stage_durations": q_stage_durations,
    "stage_resource_delta": q_stage_resource_delta,
    "limit_breaches": q_limit_breaches,
    "memory_shares": q_memory_shares,
    "tumbling_breaches": q_tumbling_breaches,
    "level_counts": q_level_counts,
    "event_gaps": q_event_gaps,
}

SAMPLES = """s AS (SELECT event_id, event_type, ts, value / 500 AS cpu, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS ram,
                   0.0 AS gpu FROM events),
l AS (SELECT *, coalesce(cpu <= 0.5 AND ram <= 0.33 AND gpu <= 0.5, false) AS within_limits,
             greatest(cpu - 0.5, 0.0) * 0.1 AS delay FROM s)"""

LOG = """l AS (SELECT event_id, user_id, event_type, ts, event_id % 10 AS n, event_id % 100 AS took FROM events),
lines AS (SELECT event_id * 4 AS line_no, ts, 'INFO' AS level, 'Starting ' || event_type || '...' AS message FROM l
  UNION ALL SELECT event_id * 4 + 1, ts, 'INFO', printf('Before %s Resources - CPU: %d.0%%, RAM: %d.0/64.0 GB (%d.0%%), GPU: 0.0%% (0.0/8.0 GB)',
    event_type, event_id % 50, event_id % 30, event_id % 30) FROM l
  UNION ALL SELECT event_id * 4 + 2, ts, 'INFO', printf('After %s Resources - CPU: %d.0%%, RAM: %d.0/64.0 GB (%d.0%%), GPU: 0.0%% (0.0/8.0 GB)',
    event_type, event_id % 50 + event_id % 7, event_id % 30 + 2, event_id % 30 + 2) FROM l
  UNION ALL SELECT event_id * 4 + 3, ts + to_milliseconds(took * 10), CASE WHEN n = 1 THEN 'ERROR' ELSE 'INFO' END,
    CASE WHEN n = 1 THEN '❌ Failed during ' || event_type || printf(' after %.2fs: lost', took / 100)
         ELSE '✅ Completed ' || event_type || printf(' in %.2fs', took / 100) END FROM l WHERE n > 0)"""

SQL = {
    "parse_log": f"""WITH {LOG} SELECT line_no, strftime(ts, '%Y-%m-%d %H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000 % 1000) AS VARCHAR), 3, '0') AS ts,
        level, 'monitor' AS logger, message, true AS parsed FROM lines""",
    "resource_samples": """SELECT event_id * 4 + k AS line_no, CASE k WHEN 1 THEN 'Before' ELSE 'After' END AS phase, event_type AS stage,
        (event_id % 50 + CASE k WHEN 1 THEN 0 ELSE event_id % 7 END) / 100 AS cpu_usage,
        CAST(event_id % 30 + CASE k WHEN 1 THEN 0 ELSE 2 END AS DOUBLE) AS ram_usage_gb, 64.0::DOUBLE AS ram_total_gb,
        (event_id % 30 + CASE k WHEN 1 THEN 0 ELSE 2 END) / 100 AS ram_ratio, 0.0::DOUBLE AS gpu_usage, 0.0::DOUBLE AS gpu_memory_gb
        FROM events, (SELECT unnest([1, 2]) AS k)""",
    "stage_durations": """SELECT user_id, event_type AS stage, event_id * 4 AS start_line,
        CASE event_id % 10 WHEN 0 THEN 'unfinished' WHEN 1 THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN event_id % 10 > 0 THEN (event_id % 100) / 100 END AS reported_seconds,
        CASE WHEN event_id % 10 > 0 THEN (event_id % 100) / 100 END AS wall_seconds FROM events""",
    "stage_resource_delta": """SELECT user_id, event_type AS stage, event_id * 4 + 1 AS before_line, round((event_id % 7) / 100, 6) AS cpu_delta,
        2.0::DOUBLE AS ram_gb_delta, 0.02::DOUBLE AS ram_ratio_delta, 0.0::DOUBLE AS gpu_delta FROM events""",
    "order_latency": """SELECT o.o_orderkey, strftime(o.o_orderdate, '%Y-%m-%d %H:%M:%S') AS start_ts,
        strftime(l.end_ts, '%Y-%m-%d %H:%M:%S') AS end_ts,
        round((epoch_us(l.end_ts) - epoch_us(o.o_orderdate)) / 1e6, 2) AS seconds
        FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS end_ts FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey""",
    "sample_deltas": """WITH s AS (SELECT user_id, ts, event_id, value / 500 AS cpu_usage,
                   CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS ram_ratio FROM events)
        SELECT user_id, count(*) AS n_samples,
          round(arg_max(cpu_usage, (ts, event_id)) - arg_min(cpu_usage, (ts, event_id)), 6) AS cpu_usage_delta,
          round(arg_max(ram_ratio, (ts, event_id)) - arg_min(ram_ratio, (ts, event_id)), 6) AS ram_ratio_delta
        FROM s GROUP BY user_id""",
    "memory_shares": """SELECT event_id, round(value * 1e9 / 1073741824, 6) AS used_gb,
        round(CASE WHEN event_id % 5 > 0 THEN value * 1e9 / ((event_id % 5) * 1e11) END, 6) AS ratio FROM events""",
    "limit_breaches": f"""WITH {SAMPLES} SELECT event_type, count(*) AS n_samples,
        count(*) FILTER (WHERE NOT within_limits) AS n_breaches, count(*) FILTER (WHERE cpu > 0.5) AS cpu_breaches,
        count(*) FILTER (WHERE ram > 0.33) AS ram_breaches, count(*) FILTER (WHERE gpu > 0.5) AS gpu_breaches,
        round(sum(delay), 6) AS total_delay FROM l GROUP BY event_type""",
    "tumbling_breaches": f"""WITH {SAMPLES} SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS window_start,
        count(*) AS n_samples, round(avg(cpu), 6) AS avg_cpu, round(max(cpu), 6) AS max_cpu,
        count(*) FILTER (WHERE NOT within_limits) AS n_breaches FROM l GROUP BY 1""",
    "level_counts": "SELECT event_type, count(*) AS n_messages FROM events GROUP BY event_type",
    "event_gaps": """SELECT event_id, user_id,
        round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6, 6) AS gap_seconds
        FROM events""",
}
# The stream's final windows equal the batch twin's.
SQL["stream_monitor"] = SQL["tumbling_breaches"]
# Append mode: windows that the last watermark closes, without the third file's late rows.
SQL["stream_late_rows"] = f"""WITH {SAMPLES},
        w AS (SELECT max(ts) FILTER (event_id % 3 = 0) - INTERVAL 1 day AS first, max(ts) - INTERVAL 1 day AS last FROM events),
        k AS (SELECT l.*, time_bucket(INTERVAL 1 hour, l.ts) AS h FROM l)
        SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_samples, round(max(cpu), 6) AS max_cpu,
        count(*) FILTER (WHERE NOT within_limits) AS n_breaches FROM k, w
        WHERE h + INTERVAL 1 hour <= last AND (event_id % 3 < 2 OR h + INTERVAL 1 hour > first) GROUP BY 1"""
