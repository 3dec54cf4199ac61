import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import mining

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, v int, a string, scores int"


def brute(rows, p=5, k=5, low=80, high=100):
    ok = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), l) for i, v, l in rows
          if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _, _ in ok if i % 10 == 0}:
        l, a = min((l, v) for j, v, l in ok if j == i)
        scored = sorted((-sum(x * y for x, y in zip(a, v)), j, m) for j, v, m in ok if j != i and len(v) == len(a))
        for ps, pid, _ in [x for x in scored if x[2] == l][:p]:
            found = [(-s, j) for s, j, m in scored if m != l and low * -ps <= 100 * -s <= high * -ps][:k]
            out += [(i, pid, r, j, -ps, s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, l, "i", 1, "a", 3) for i, v, l in rows], SCHEMA)
    got = mining.hard_negatives(df, F.col("vec_id") % 10 == 0, component=lambda x: F.floor(256 * x), **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def clustered(rng, n, d, labels):
    centre = [[rng.gauss(0, 0.3) for _ in range(d)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0, 0.2) for c in centre[rng.randrange(labels)]], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("tile,block,depth", [(8 << 20, 1024, 8), (2048, 3, 1)])
def test_matches_brute_force(spark, monkeypatch, tile, block, depth):
    for name, n in (("TILE_BYTES", tile), ("ANCHOR_BLOCK", block), ("DEPTH", depth)):
        monkeypatch.setattr(mining, name, n)
    rng = random.Random(3)
    rows = clustered(rng, 300, 8, 4)
    rows += [(300 + i, rows[5][1], i % 2) for i in range(40)]  # ties under two labels
    rows += [(10, rows[3][1], 2), (7, rows[7][1], 1), (7, rows[7][1], 1)]  # repeated ids, one of an anchor
    rows += [(900, [0.0] * 8, 1), (901, [0.0] * 8, 1), (902, [0.0] * 8, 2)]  # scores of 0
    rows += [(1000, None, 1), (1001, [1.0, None] * 4, 1), (1010, [float("nan")] * 8, 1), (1020, [float("inf")] * 8, 2),
             (None, [1.0] * 8, 1), (1030, rows[1][1], None)]
    rows += [(2000, [0.5, 0.5], 1), (2001, [0.5, 0.5], 1), (2002, [0.5, 0.4], 2), (2010, [], 1), (2011, [], 2), (-10, [2.0] * 8, 1), (2050, [-1.0] * 8, 0)]
    want = brute(rows)
    assert len(want) > 300
    assert run(spark, rows) == want


def test_other_windows_and_counts(spark):
    rows = clustered(random.Random(5), 200, 6, 3)
    assert run(spark, rows, positives=2, negatives=9, low=-50, high=130) == brute(rows, 2, 9, -50, 130)


def test_large_components_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 2**19 for _ in range(8)], i % 3) for i in range(60)]
    assert run(spark, rows) == brute(rows)


def test_few_rows_and_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(10, [1.0], 1)]) == [] and run(spark, [(10, [1.0], 1), (11, [1.0], 1)]) == []
    assert run(spark, [(10, [1.0], 1), (11, [1.0], 1), (12, [0.9], 2)]) == [(10, 11, 1, 12, 65536, 58880)]


def test_walk_stops_early_and_reads_ties():
    """The threshold ends the walk long before all rows are read, but not at a tie."""
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(20_000, 3)) * 100)
    a = np.array([3.0, -2.0, 1.0])
    lists = mining.Lists(np.arange(len(x)), x)
    top = [(int(s), int(i)) for s, i in sorted(zip(x @ a, range(len(x))), key=lambda y: (-y[0], y[1]))[:5]]
    assert lists.walk(-1, a, [(-10**9, 10**9)], 5) == [top]
    assert lists.read < 2_000
    same = mining.Lists(np.arange(100)[::-1].copy(), np.ones((100, 3)))
    assert same.walk(-1, a, [(0, 10)], 2) == [[(2, 0), (2, 1)]]


def test_a_label_with_most_rows_is_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(mining, "TILE_BYTES", 4096)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0.3, 0.3) for _ in range(4)], 1 if i % 5 else 2) for i in range(500)]
    assert run(spark, rows) == brute(rows)
