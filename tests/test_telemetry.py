import os

import pytest

from corpuskit.operators import telemetry as tm
from corpuskit.sources.runlog import read_run_log

# Our own log in the reference's layout.
LOG = """2025-01-05 10:00:00,000 - INFO - [__main__] - Starting loading...
2025-01-05 10:00:00,100 - INFO - [__main__] - Before loading Resources - CPU: 10.0%, RAM: 4.0/16.0 GB (25.0%), GPU: 0.0% (0.0/8.0 GB)
2025-01-05 10:00:02,100 - INFO - [__main__] - After loading Resources - CPU: 30.5%, RAM: 6.0/16.0 GB (37.5%), GPU: 50.0% (2.0/8.0 GB)
2025-01-05 10:00:02,150 - INFO - [__main__] - ✅ Completed loading in 2.15s
2025-01-05 10:00:03,000 - INFO - [__main__] - Starting tuning...
2025-01-05 10:00:03,000 - WARNING - [__main__] - something odd
2025-01-05 10:00:04,500 - ERROR - [__main__] - ❌ Failed during tuning after 1.50s: out of memory
this line does not parse
"""


@pytest.fixture(scope="module")
def log_df(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("log")
    p = os.path.join(d, "run.log")
    with open(p, "w", encoding="utf-8") as f:
        f.write(LOG)
    return read_run_log(spark, p)


def test_parse_and_levels(log_df):
    assert log_df.where("NOT parsed").count() == 1
    got = {r.level: r.n_messages for r in tm.level_counts(log_df.where("parsed")).collect()}
    assert got == {"INFO": 5, "WARNING": 1, "ERROR": 1}


def test_stage_durations(log_df):
    got = {r.stage: (r.status, r.reported_seconds, r.wall_seconds) for r in tm.stage_durations(log_df).collect()}
    assert got == {"loading": ("completed", 2.15, 2.15), "tuning": ("failed", 1.5, 1.5)}


def _parsed(spark, lines):
    from corpuskit.sources.runlog import parse_log
    return parse_log(spark.createDataFrame(list(enumerate(lines)), "line_no int, value string"))


def test_stages_are_paired_in_line_order_and_unfinished_ones_stay(spark):
    at = "2025-01-05 10:00:00,000 - INFO - [m] - "
    lines = [at + "Starting quick...", at + "✅ Completed quick in 0.00s", at + "Starting quick...", at + "Starting slow...", at + "✅ Completed quick in 0.20s"]
    got = tm.stage_durations(_parsed(spark, lines)).orderBy("start_line").collect()
    assert [(r.stage, r.start_line, r.status, r.reported_seconds) for r in got] == [
        ("quick", 0, "completed", 0.0), ("quick", 2, "completed", 0.2), ("slow", 3, "unfinished", None)]


def test_resource_deltas_are_per_run(spark):
    res = "2025-01-05 10:00:00,000 - INFO - [m] - %s load Resources - CPU: %s%%, RAM: 4.0/16.0 GB (25.0%%), GPU: 0.0%% (0.0/8.0 GB)"
    lines = [res % x for x in (("Before", "10.0"), ("After", "20.0"), ("Before", "80.0"), ("After", "20.0"), ("Before", "1.0"))]
    got = tm.stage_resource_delta(tm.resource_samples(_parsed(spark, lines))).orderBy("before_line").collect()
    assert [(r.before_line, r.cpu_delta) for r in got] == [(0, 0.1), (2, -0.6)]


def test_resources_and_delta(log_df):
    s = tm.resource_samples(log_df)
    rows = {r.phase: r for r in s.collect()}
    assert rows["After"].cpu_usage == pytest.approx(0.305) and rows["After"].gpu_memory_gb == 2.0
    d = tm.stage_resource_delta(s).first()
    assert d.stage == "loading" and d.ram_gb_delta == 2.0 and d.cpu_delta == pytest.approx(0.205)


def test_limits_at_below_above(spark):
    rows = [(0.5, 0.33, 0.5), (0.49, 0.1, 0.0), (0.51, 0.1, 0.0), (0.1, 0.34, 0.0), (0.1, 0.1, 0.6)]
    df = spark.createDataFrame(rows, "cpu_usage double, ram_ratio double, gpu_usage double")
    w = [r.within_limits for r in tm.with_limits(df).collect()]
    assert w == [True, True, False, False, False]
    b = tm.limit_breaches(df).first()
    assert (b.n_breaches, b.cpu_breaches, b.ram_breaches, b.gpu_breaches) == (3, 1, 1, 1)
    assert b.total_delay == pytest.approx(0.001)
    z = spark.createDataFrame([(1.0, 0.0)], "used double, total double").select(tm.ram_ratio("used", "total").alias("r"))
    assert z.first().r is None


def test_event_gaps_across_buckets(spark):
    rows = [(1, 7, "2024-01-01 23:59:00"), (2, 7, "2024-01-02 00:01:00"), (3, 7, "2024-01-05 00:00:00"),
            (4, 8, "2024-01-01 00:00:00"), (5, 7, "2024-01-02 00:01:00")]
    df = spark.createDataFrame(rows, "id long, k long, ts string").selectExpr("id", "k", "CAST(ts AS TIMESTAMP) ts")
    got = {r.id: r.gap_seconds for r in tm.event_gaps(df, "k", "ts", "id").collect()}
    assert got == {1: None, 2: 120.0, 5: 0.0, 3: 259_140.0, 4: None}


def test_bytes_to_gb(spark):
    r = spark.createDataFrame([(3 * 1024 ** 3,)], "b long").select(tm.bytes_to_gb("b").alias("g")).first()
    assert r.g == 3.0
