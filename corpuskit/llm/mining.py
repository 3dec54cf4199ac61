"""Hard negatives for anchors by Fagin's threshold algorithm.

Candidates lie in tiles of bounded size.  A tile holds one sorted list per
dimension.  An anchor walks every list from the end that its own sign favours
(largest components where it is positive, smallest where it is negative), deeper
and deeper side by side: sorted access.  Each row met is scored at once by its
integer inner product: random access.  The products of the anchor with the last
components read add up to the threshold, which no unread row can exceed; the
walk ends once it falls strictly below the kth score of each window (or below
the window itself), so that ties by id are complete too.

Two walks: one over the rows of the anchor's label finds its positives (one
window, everything); one over the tile finds the negatives, a window per
positive score p that takes scores from ``low`` to ``high`` percent of p.

Plan: candidates are dealt to tiles by a hash of their id, copied once per block
of anchors and packed many to a row; a tile returns at most k rows per window
and the best k of all tiles win.  No label, however frequent, is one task.

Rows whose id, label or vector is NULL, or whose vector holds NULL or non-finite
components, take no part; only vectors of equal length are compared.  Rows that
share the anchor's id are its own; of different rows under one anchor id the
smallest (label, vector) is the anchor.  Repeated candidate rows are candidates
each, and a repeated positive brings its negatives once per row.  Ties go to
smaller ids.  A zero or negative positive score leaves no room (0 to 0, or an
empty window).  Scores have to fit in 64 bits.  An empty table gives an empty
result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import written

TILE_BYTES, ANCHOR_BLOCK = 8 << 20, 1024
DEPTH = 8  # ranks read per list before the first look at the threshold; doubled after each


def valid(vector: Column) -> Column:
    d = F.transform(vector, lambda x: x.cast("double"))
    return vector.isNotNull() & F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


class Lists:
    """The sorted lists of some rows; ``exact``: products stay below 2^53, so doubles hold them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        self.order = np.argsort(x, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(x.T, self.order, 1)
        self.largest = int(np.abs(x).max(initial=0))

    def walk(self, anchor_id: int, a: np.ndarray, windows, k: int, own=None):
        """For each window (least, most): up to ``k`` (score, id), best first.  ``own`` marks rows that don't count."""
        n, found = len(self.ids), [[] for _ in windows]
        out = self.ids == anchor_id
        if own is not None:
            out = out | own
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        seen, score = np.zeros(n, bool), np.zeros(n, a.dtype)
        depth, step = 0, DEPTH
        open_ = list(range(len(windows)))
        while open_ and depth < n:
            end = min(n, depth + step)
            new = seen.copy()
            new[self.order[down, depth:end].ravel()] = True
            new[self.order[up, n - end:n - depth].ravel()] = True
            if not len(up) + len(down):  # nothing to sort by: every score is 0
                new[:] = True
            at = np.flatnonzero(new & ~seen)
            score[at] = self.x[at] @ a
            seen, depth, step = new, end, 2 * step
            bound = int(self.values[down, end - 1] @ a[down] + self.values[up, n - end] @ a[up])
            rest = not seen.all()
            met = np.sort(score[seen & ~out])
            for w in list(open_):
                least, most = windows[w]
                first, last = np.searchsorted(met, [least, most + 1]) if most >= least else (0, 0)
                kth = int(met[last - k]) if last - first >= k else least
                if not rest or bound < kth:
                    open_.remove(w)
        counts = seen & ~out
        for w, (least, most) in enumerate(windows):
            at = np.flatnonzero(counts & (score >= least) & (score <= most))
            for i in at[np.lexsort((self.ids[at], -score[at]))[:k]].tolist():
                found[w].append((int(score[i]), int(self.ids[i])))
        self.read = int(seen.sum())
        return found


def _packed(rows: DataFrame, cell: str, extra: str | None, fan: Column) -> DataFrame:
    """Rows of one ``cell`` packed per Arrow batch, then copied to the tiles in ``fan``."""
    names = ["cell", "ids", "labels", "data", "dim", "extra"]

    def run(batches):
        for b in batches:
            ids, labels, cells = (b.column(i).to_numpy() for i in (0, 1, 3))
            v = b.column(2)
            lens = pa.compute.list_value_length(v).to_numpy()
            flat, starts = v.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lens)))
            more = b.column(4).to_pylist()
            out = []
            for c, d in sorted({*zip(cells.tolist(), lens.tolist())}):
                own = np.flatnonzero((cells == c) & (lens == d))
                at = starts[own][:, None] + np.arange(d)
                out.append((c, ids[own].tobytes(), labels[own].tobytes(), flat[at].tobytes(), d, [more[i] for i in own]))
            types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.list_(pa.int64())))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 6, types)], names=names)
    more = F.col(extra) if extra else F.lit(None).cast("array<bigint>")
    return rows.select("id", "label", "v", cell, more.alias("extra")) \
        .mapInArrow(run, "cell int, ids binary, labels binary, data binary, dim int, extra array<array<bigint>>") \
        .withColumn("other", F.explode(fan))


def _matrix(table: pa.Table):
    """{dim: (ids, labels, vectors, extra)} of packed rows."""
    out = {}
    for i, l, x, d, e in zip(*(table.column(c).to_pylist() for c in ("ids", "labels", "data", "dim", "extra"))):
        n = len(i) // 8
        out.setdefault(d, []).append((np.frombuffer(i, np.int64), np.frombuffer(l, np.int64), np.frombuffer(x, np.int64).reshape(n, d), e))
    return {d: (*(np.concatenate(c) for c in zip(*(p[:3] for p in parts))), [w for p in parts for w in p[3]]) for d, parts in out.items()}


def _tiles(rows: DataFrame, anchors: DataFrame, gs: int, hs: int, extra: str | None, walk, schema: str) -> DataFrame:
    cell = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    v = _packed(rows.withColumn("g", cell(gs, 0)), "g", None, F.sequence(F.lit(0), F.lit(hs - 1)))
    a = _packed(anchors.withColumn("h", cell(hs, 1)), "h", extra, F.sequence(F.lit(0), F.lit(gs - 1)))
    cols = ["ids", "labels", "data", "dim", "extra"]
    v = v.select(F.col("cell").alias("g"), F.col("other").alias("h"), *cols)
    a = a.select(F.col("other").alias("g"), F.col("cell").alias("h"), *cols)
    names = [c.split()[0] for c in schema.split(", ")]

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        candidates, out = _matrix(left), []
        for d, own in _matrix(right).items():
            if d in candidates:
                ids, labels, x, _ = candidates[d]
                most = int(np.abs(own[2]).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, d)
                kind = np.float64 if most < 2 ** 53 else np.int64
                out += walk((own[0], own[1], own[2].astype(kind), own[3]), (ids, labels, x.astype(kind)))
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*out) if out else ((),) * len(names))})

    return v.groupBy("g", "h").cogroup(a.groupBy("g", "h")).applyInArrow(tile, schema)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", component=None) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    For every row that meets ``is_anchor``: its ``positives`` best other rows of
    its label, and for each of those the ``negatives`` best rows n of other
    labels with ``low * positive_score <= 100 * n <= high * positive_score``.

    ``label``: an integral column or expression.  ``component``: what a component
    (double) becomes; it must be integral."""
    component = component or (lambda x: x)
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.where(F.col(key).isNotNull() & label.isNotNull() & valid(F.col(vector))).select(
        F.col(key).cast("bigint").alias("id"), label.cast("bigint").alias("label"),
        F.transform(vector, lambda x: component(x.cast("double")).cast("bigint")).alias("v"), is_anchor.alias("a"))
    n = rows.agg(F.count("*").alias("n"), F.count_if("a").alias("a"), F.max(F.size("v")).alias("d")).first()
    gs = max(1, -(-n.n * 8 * max(1, n.d or 1) // TILE_BYTES))
    hs = max(1, -(-n.a // ANCHOR_BLOCK))
    anchors = rows.where("a").groupBy("id").agg(F.min(F.struct("label", "v")).alias("m")).select("id", "m.label", "m.v")
    rows = rows.drop("a")

    def nearest(own, candidates):
        ids, labels, x = candidates
        (aids, alabels, a, _), out = own, []
        top = np.iinfo(np.int64)
        for value in np.unique(alabels).tolist():
            at = np.flatnonzero(labels == value)
            if len(at):
                lists = Lists(ids[at], x[at])
                for i in np.flatnonzero(alabels == value).tolist():
                    for s, j in lists.walk(int(aids[i]), a[i], [(top.min, top.max - 1)], positives)[0]:
                        out.append((int(aids[i]), j, s))
        return out

    def hardest(own, candidates):
        ids, labels, x = candidates
        lists, out = Lists(ids, x), []
        for aid, value, a, scores in zip(own[0].tolist(), own[1].tolist(), own[2], own[3]):
            windows = [(-(-low * p // 100), high * p // 100) for p in scores]
            for p, found in zip(scores, lists.walk(aid, a, windows, negatives, labels == value)):
                out += [(aid, p, j, s) for s, j in found]
        return out

    near = _tiles(rows, anchors, gs, hs, None, nearest, "anchor_id bigint, positive_id bigint, positive_score bigint")
    near = written(near.withColumn("r", F.expr("row_number() OVER (PARTITION BY anchor_id ORDER BY positive_score DESC, positive_id)"))
                   .where(F.col("r") <= positives).drop("r"), "positives")
    # At most ``positives`` scores per anchor.
    asked = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_set("positive_score").alias("scores"))
    hard = _tiles(rows, anchors.join(asked, "id"), gs, hs, "scores", hardest,
                  "anchor_id bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    hard = hard.withColumn("rank", F.expr("cast(row_number() OVER (PARTITION BY anchor_id, positive_score ORDER BY negative_score DESC, negative_id) AS int)")) \
        .where(F.col("rank") <= negatives)
    return near.join(hard, ["anchor_id", "positive_score"]) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
