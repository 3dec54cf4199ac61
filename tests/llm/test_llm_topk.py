import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, id string, v int, q string, g int"


def brute(rows, k):
    ok = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i in {i for i, _ in ok if i % 50 == 0}:
        q = min(v for j, v in ok if j == i)
        best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i and len(v) == len(q))[:k]
        out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def run(spark, rows, k=5):
    df = spark.createDataFrame([(i, v, "i", 1, "q", 2) for i, v in rows], SCHEMA)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k, component=lambda x: F.floor(256 * x))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())


@pytest.mark.parametrize("blocks", [(8192, 1024, 1024), (37, 3, 16)])
def test_matches_brute_force(spark, monkeypatch, blocks):
    for name, n in zip(("VECTOR_BLOCK", "QUERY_BLOCK", "STEP"), blocks):
        monkeypatch.setattr(topk, name, n)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(12)]) for i in range(400)]
    rows += [(400 + i, rows[5][1]) for i in range(30)]  # ties
    rows += [(1000, [0.0] * 12), (1001, [0.0] * 12), (50, rows[3][1]), (7, rows[7][1])]
    rows += [(2000, None), (2001, [1.0, None] * 6), (2002, [float("nan")] * 12), (2050, [float("inf")] * 12), (None, [1.0] * 12)]
    rows += [(3000, [0.5, 0.5]), (3001, [0.25, -1.0]), (3050, []), (-50, [2.0] * 12)]
    assert run(spark, rows) == brute(rows, 5)


def test_large_components_stay_exact(spark):
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) * 2**21 for _ in range(8)]) for i in range(60)]
    assert run(spark, rows, 3) == brute(rows, 3)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    q, v = rng.normal(size=(20, 13)), rng.normal(size=(50, 13))
    for s in (1, 2, 5, 13):
        a, b = (np.hstack(topk.statistics(x, s)) for x in (q, v))
        assert (a @ b.T + 1e-9 >= q @ v.T).all()


def test_fewer_candidates_and_empty_table(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]
    assert run(spark, [(0, [1.0])]) == [] and run(spark, []) == []


def _share(x, k=5):
    """Of all pairs of queries and vectors, how many get an exact product; the results are checked, too."""
    ids, tally = np.arange(len(x)), []
    at = ids[ids % 50 == 0]
    row, vid, score = topk.best(at, x[at], ids, x, k, tally=tally)
    want = []
    for n, i in enumerate(at):
        s = (x @ x[i]).astype(np.int64)
        want += [(n, j, s[j]) for j in sorted((j for j in ids if j != i), key=lambda j: (-s[j], j))[:k]]
    assert list(zip(row, vid, score)) == want
    return sum(tally) / (len(at) * len(x))


def test_few_pairs_reach_the_exact_product():
    table = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").sort_by("vec_id")
    x = np.floor(256 * np.array(table.column("embedding").to_pylist(), dtype=np.float64))
    assert _share(x) < 0.5
    rng = np.random.default_rng(1)
    smooth = np.repeat(rng.normal(size=(3000, 8)), 8, axis=1) + rng.normal(scale=0.1, size=(3000, 64))
    assert _share(np.floor(256 * smooth)) < 0.05


def test_many_equal_vectors_and_ties():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(scale=0.2, size=(3000, 10)))
    x[rng.permutation(3000)[:1000]] = x[0]
    assert _share(x) < 1
