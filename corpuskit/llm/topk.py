"""Exact top-k inner products by multi-resolution segment statistics.

A vector is cut into equal segments at several resolutions; each segment keeps
its sum and its deviation (root of the centred sum of squares).  By
Cauchy-Schwarz within segments

    q.x <= sum over segments of (Sq Sx / m + Dq Dx),

so |q - x|^2 = |q|^2 + |x|^2 - 2 q.x has a lower bound from the statistics
alone.  First every query gets a floor: the k-th exact score of the few vectors
whose finest segment means promise most, which the k-th best score can't be
below.  Then each pair whose bound doesn't reach its query's floor is dropped,
coarse to fine; the pairs left get their exact integer inner product, and floors
rise with them.

Plan: vectors are dealt to tiles of bounded size by a hash of their id, once
per block of queries, packed many to a row; every tile holds one block of
vectors and one of queries and returns k rows per query; the best k of all
tiles win.  The work grows with queries times rows, as asked, never with a
group.

Vectors that are NULL, hold NULL or non-finite components, or have a NULL id
take no part; only vectors of equal length are compared.  Rows that share the
query's id are its own; of different vectors under one query id the smallest is
the query.  Repeated candidate rows are candidates each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_BLOCK, QUERY_BLOCK, STEP = 8192, 1024, 1024
PAIRS = 1 << 15  # multiplied one by one at a time


def resolutions(dim: int) -> tuple[int, ...]:
    """Numbers of segments, coarse to fine; the finest hold one or two components
    (up to 32 components: one each, and the bound is the score)."""
    return 2, 8, max(32, dim // 2), max(32, dim * 3 // 4)


def _valid(vector: Column) -> Column:
    d = F.transform(vector, lambda x: x.cast("double"))
    return vector.isNotNull() & F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def _packed(rows: DataFrame, cell: str, fan: DataFrame | Column) -> DataFrame:
    """Rows ``(id, v)`` of one ``cell`` packed per Arrow batch, then copied to the tiles in ``fan``."""
    def run(batches):
        for b in batches:
            ids, cells = b.column(0).to_numpy(), b.column(2).to_numpy()
            v = b.column(1)
            lens = pa.compute.list_value_length(v).to_numpy()
            flat, starts = v.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lens)))
            out = []
            for c, d in {*zip(cells.tolist(), lens.tolist())}:
                own = np.flatnonzero((cells == c) & (lens == d))
                at = starts[own][:, None] + np.arange(d)
                out.append((c, ids[own].tobytes(), flat[at].tobytes(), d))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, (pa.int32(), pa.binary(), pa.binary(), pa.int32()))],
                                  names=["cell", "ids", "data", "dim"])
    return rows.select("id", "v", cell).mapInArrow(run, "cell int, ids binary, data binary, dim int") \
        .withColumn("other", F.explode(fan))


def _matrix(table: pa.Table):
    """{dim: (ids, rows)} of packed rows."""
    out = {}
    for i, x, d in zip(*(table.column(c).to_pylist() for c in ("ids", "data", "dim"))):
        out.setdefault(d, []).append((np.frombuffer(i, np.int64), np.frombuffer(x, np.float64).reshape(len(i) // 8, d)))
    return {d: (np.concatenate([a for a, _ in p]), np.concatenate([b for _, b in p])) for d, p in out.items()}


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment: sum over root length, and deviation; inner products of both add up to the bound."""
    means, devs = [], []
    for part in np.array_split(x, min(segments, max(1, x.shape[1])), axis=1):
        m = max(1, part.shape[1])
        means.append(part.sum(1) / np.sqrt(m))
        devs.append(np.sqrt(np.maximum(((part - part.mean(1, keepdims=True)) ** 2).sum(1) if part.shape[1] else np.zeros(len(x)), 0)))
    return np.column_stack(means), np.column_stack(devs)


def _products(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of row i[n] of ``a`` with row j[n] of ``b``."""
    out = np.empty(len(i), a.dtype)
    for lo in range(0, len(i), PAIRS):
        at = slice(lo, lo + PAIRS)
        np.einsum("nd,nd->n", a[i[at]], b[j[at]], out=out[at])
    return out


def _first_k(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best of every row: higher scores first, ties to smaller ids."""
    order = np.lexsort((ids, ~score, row))
    row, ids, score = row[order], ids[order], score[order]
    own = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[own], ids[own], score[own]


def _raise(floor: np.ndarray, row: np.ndarray, score: np.ndarray, k: int) -> None:
    """A row's k-th score (of k, ordered) becomes its floor."""
    last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
    floor[row[last]] = np.maximum(floor[row[last]], score[last])


def best(qid: np.ndarray, q: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int, levels=None, tally: list | None = None):
    """(query row, vec_id, score): the k best of ``v`` for each row of ``q``; ties to smaller ids.
    ``tally`` takes the number of pairs multiplied exactly, for each step."""
    largest = np.abs(q).max(initial=0) * np.abs(v).max(initial=0) * max(1, q.shape[1])
    kind = np.float32 if largest < 2 ** 24 else np.float64 if largest < 2 ** 53 else np.int64  # sums are exact in it
    qx, vx = q.astype(kind), v.astype(kind)
    exact = lambda i, j: _products(qx, vx, i, j).astype(np.int64)
    levels = levels or resolutions(q.shape[1])
    qs, vs = ([np.hstack(statistics(x, s)) for s in levels] for x in (q, v))
    floor = np.full(len(q), np.iinfo(np.int64).min)
    steps = [slice(lo, min(lo + STEP, len(v))) for lo in range(0, len(v), STEP)]

    # The first exact pass, over the most promising vectors by segment means.
    means = qs[-1].shape[1] // 2
    guess, at = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64)
    for step in steps:
        by_means = qs[-1][:, :means] @ vs[-1][step, :means].T
        by_means[vid[step] == qid[:, None]] = -np.inf
        guess = np.hstack([guess, by_means])
        at = np.hstack([at, np.broadcast_to(np.arange(step.start, step.stop), by_means.shape)])
        if guess.shape[1] > 2 * k:
            most = np.argpartition(guess, -2 * k, axis=1)[:, -2 * k:]
            guess, at = np.take_along_axis(guess, most, 1), np.take_along_axis(at, most, 1)
    row, col = np.nonzero(guess > -np.inf)
    score = exact(row, at[row, col])
    if tally is not None:
        tally.append(len(row))
    row, _, score = _first_k(row, vid[at[row, col]], score, k)
    _raise(floor, row, score, k)

    top = (np.zeros(0, np.int64),) * 3
    for step in steps:
        left = vid[step] != qid[:, None]
        for own, x in zip(qs, (x[step] for x in vs)):  # coarse to fine
            if np.count_nonzero(left) * 8 > left.size:
                bound = own @ x.T
                left &= bound + 1e-9 * np.abs(bound) + 1e-6 >= floor[:, None]
            else:
                i, j = np.nonzero(left)
                bound = _products(own, x, i, j)
                out = bound + 1e-9 * np.abs(bound) + 1e-6 < floor[i]
                left[i[out], j[out]] = False
        row, col = np.nonzero(left)
        score = exact(row, col + step.start)
        if tally is not None:
            tally.append(len(row))
        in_reach = score >= floor[row]
        top = _first_k(*(np.concatenate(c) for c in zip(top, (row[in_reach], vid[step][col[in_reach]], score[in_reach]))), k)
        _raise(floor, top[0], top[2], k)
    return top


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", component=None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every row that meets
    ``is_query``, the k largest inner products with the other rows.

    ``component``: what a component (double) becomes; it must be integral."""
    component = component or (lambda x: x)
    rows = vectors.where(F.col(key).isNotNull() & _valid(F.col(vector))).select(
        F.col(key).alias("id"), F.transform(vector, lambda x: component(x.cast("double")).cast("double")).alias("v"), is_query.alias("q"))
    n = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    gs, hs = max(1, -(-n.n // VECTOR_BLOCK)), max(1, -(-n.q // QUERY_BLOCK))
    queries = rows.where("q").groupBy("id").agg(F.min("v").alias("v"))
    v = _packed(rows.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(gs)).cast("int")), "g", F.sequence(F.lit(0), F.lit(hs - 1)))
    q = _packed(queries.withColumn("h", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(hs)).cast("int")), "h", F.sequence(F.lit(0), F.lit(gs - 1)))
    v = v.select(F.col("cell").alias("g"), F.col("other").alias("h"), "ids", "data", "dim")
    q = q.select(F.col("other").alias("g"), F.col("cell").alias("h"), "ids", "data", "dim")

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        vs, out = _matrix(left), []
        for d, (qid, qm) in _matrix(right).items():
            if d in vs:
                at, ids, scores = best(qid, qm, *vs[d], k)
                out.append((qid[at], ids, scores))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols)})

    found = v.groupBy("g", "h").cogroup(q.groupBy("g", "h")).applyInArrow(tile, "query_id bigint, vec_id bigint, score bigint")
    return found.selectExpr("query_id", "cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS int) AS rank", "vec_id", "score") \
        .where(F.col("rank") <= k)
