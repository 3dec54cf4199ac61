"""Segmented scans: windows over segments that hold most rows."""

import random

import pytest
from pyspark.sql import functions as F

from corpuskit.operators import evaluate as ev
from corpuskit.operators import segments as sg
from corpuskit.operators import telemetry as tm


def _rows(n=600, seed=1):
    """A third of the rows under one key, NULL keys, gaps in the order."""
    rng = random.Random(seed)
    places = rng.sample(range(5 * n), n)
    return [(p, "hot" if i % 3 == 0 else rng.choice(["a", "b", None]), i) for i, p in enumerate(places)]


@pytest.mark.parametrize("rows,back", [(7, False), (7, True), (100, False), (1 << 16, True)])
def test_neighbours_are_those_of_one_window(spark, rows, back):
    data = _rows()
    df = spark.createDataFrame(data, "place int, key string, v int")
    got = sg.with_neighbour(df, ["key"], "place", ["v", "place"], sg.order_bucket(df, "place", rows), back=back)
    assert got.columns == [*df.columns, "_next"]
    by = {}
    for p, k, v in sorted(data, reverse=back):
        by.setdefault(k, []).append((v, p))
    want = {v: nxt for own in by.values() for (v, _), nxt in zip(own, [*own[1:], None])}
    assert {r.v: tuple(r._next) if r._next else None for r in got.collect()} == want


@pytest.mark.parametrize("rows", [5, 1000])
def test_positions_are_those_of_one_window(spark, rows):
    data = _rows()
    df = spark.createDataFrame(data, "place int, key string, v int")
    got = sg.with_position(df, ["key"], "place", sg.range_bucket(df, "place", rows))
    by = {}
    for p, k, v in sorted(data):
        by.setdefault(k, []).append(v)
    assert {r.v: r._pos for r in got.collect()} == {v: i + 1 for own in by.values() for i, v in enumerate(own)}


def test_range_buckets_follow_the_order_and_are_near_equal(spark):
    df = spark.range(10_000).select((F.col("id") * F.col("id")).alias("x"), F.timestamp_seconds(F.col("id") * F.col("id")).alias("t"))
    for c in ("x", "t"):
        got = [r.b for r in df.orderBy("x").select(sg.range_bucket(df, c, 500).alias("b")).collect()]
        assert got == sorted(got) and len({*got}) == 20 and max(got.count(b) for b in {*got}) < 1000
    nulls = spark.createDataFrame([(None,), (1,), (2,), (3,)], "x int")
    assert {r.x: r.b for r in nulls.select("x", sg.range_bucket(nulls, "x", 1).alias("b")).collect()}[None] == 0
    with pytest.raises(TypeError):
        sg.range_bucket(spark.createDataFrame([("a",)], "x string"), "x", 1)


def _largest_task_share(df, keys, order_col, rows):
    """Share of all rows in the largest (segment, bucket), which is what one task must sort."""
    d = df.withColumn("_bk", sg.order_bucket(df, order_col, rows))
    return d.groupBy(*keys, "_bk").count().agg(F.max("count")).first()[0] / df.count()


def test_a_hot_stage_is_spread_and_paired_as_before(spark):
    """One run and stage holds every third line; buckets cut it, the pairs stay."""
    at = "2025-01-05 10:00:00,000 - INFO - [m] - "
    lines, want = [], []
    for i in range(300):
        stage = "hot" if i % 3 == 0 else f"s{i}"
        want.append((stage, 2 * i, "completed"))
        lines += [(2 * i, at + f"Starting {stage}..."), (2 * i + 1, at + f"✅ Completed {stage} in 0.50s")]
    lines.append((700, at + "Starting hot..."))
    want.append(("hot", 700, "unfinished"))
    from corpuskit.sources.runlog import parse_log
    parsed = parse_log(spark.createDataFrame(lines, "line_no int, value string"))
    for rows in (3, 64, 1 << 16):  # 3: starts and ends fall into different buckets
        got = tm.stage_durations(parsed, bucket_rows=rows).collect()
        assert sorted((r.stage, r.start_line, r.status) for r in got) == sorted(want)
    ev_ = tm.stage_events(parsed)
    assert _largest_task_share(ev_, ["stage"], "line_no", 1 << 16) > 0.3 > 0.05 > _largest_task_share(ev_, ["stage"], "line_no", 64)


def test_resource_deltas_over_bucket_edges(spark):
    res = "2025-01-05 10:00:00,000 - INFO - [m] - %s load Resources - CPU: %d.0%%, RAM: 4.0/16.0 GB (25.0%%), GPU: 0.0%% (0.0/8.0 GB)"
    from corpuskit.sources.runlog import parse_log
    parsed = parse_log(spark.createDataFrame([(i, res % (("Before", "After")[i % 2], i)) for i in range(100)], "line_no int, value string"))
    for rows in (1, 7, 1 << 16):
        got = tm.stage_resource_delta(tm.resource_samples(parsed), bucket_rows=rows).collect()
        assert sorted((r.before_line, r.cpu_delta) for r in got) == [(i, 0.01) for i in range(0, 100, 2)]


def test_gaps_of_a_hot_key_within_one_day(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"),
                                  F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"))
    got = {r.id: r.gap_seconds for r in tm.event_gaps(df, "k", "ts", "id", sg.range_bucket(df, "ts", 100)).collect()}
    hot = [i for i in range(3000) if i % 3 == 0 or i == 1]
    assert got == {i: None for i in range(3000)} | {b: float(b - a) for a, b in zip(hot, hot[1:])}


def test_chunks_joined_are_the_whole_list(spark):
    rows = [(("hot" if i % 3 else None) if i % 7 else "b", i, f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "category string, pos int, text string")
    whole = {r.category: list(r["items"]) for r in ev.collect_by_category(df, "category", "pos", ["text"]).collect()}
    chunks = ev.collect_chunks(df, "category", "pos", ["text"], 20, bucket_rows=33).collect()
    assert max(r.n_items for r in chunks) == 20
    got = {}
    for r in sorted(chunks, key=lambda r: r.chunk):
        assert r.chunk == len(got.setdefault(r.category, [])) // 20
        got[r.category] += r["items"]
    assert got == whole
