"""K-d tree sharding, in DataFrame operations only.

Rows are points over metadata (log size, language, source).  A node that is to
become k shards is cut along its widest dimension at the weighted quantile
floor(k/2)/k of its bytes, until every leaf is one shard; leaves so reach the
target bytes.  Quantiles are searched with distributed histograms: all nodes of
a level share a pass that sums bytes per (node, bin), and the bin that holds
the quantile is refined until it weighs less than ``tolerance`` of the node or
holds a single point.  A point's key along a dimension is its 24-bit coordinate
(the smallest of its group of equal texts), 20 bits of text hash and 19 bits of
id hash: cuts fall inside hot values, such as a source with a third of all rows,
but a group is cut only if it weighs more than ``whole`` of a shard.

The driver holds the tree (one cut per shard) and a level's histogram (at most
``shards`` x ``BINS`` sums).  Texts are never shuffled.

NULL texts weigh 16 bytes, NULL metadata counts as its own value; rows equal in
id and text are one point and share a shard; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import written

BINS = 4096
COORD_BITS, TEXT_BITS, ID_BITS = 24, 20, 19
SLOT_ROWS = 100_000


def _points(documents: DataFrame, key: str, text: str, meta: tuple[str, ...]) -> DataFrame:
    """``(doc_id, size, text_crc32, k0, k1, ...)``: the row's key along each dimension."""
    t = F.coalesce(F.col(text), F.lit(""))
    src = documents.select(F.col(key).alias("doc_id"), F.octet_length(t).cast("bigint").alias("_bytes"), F.crc32(t.cast("binary")).alias("text_crc32"),
                           F.xxhash64(t).alias("_hash"), *[F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")).alias(f"_m{i}") for i, c in enumerate(meta)])
    src = src.withColumn("size", F.col("_bytes") + 16)
    if meta:
        # Copies take one place: written, so that AQE may split a group with a third of all rows.
        src = written(src, "shard-rows")
        groups = written(src.groupBy("_hash").agg(*[F.min(f"_m{i}").alias(f"_g{i}") for i in range(len(meta))]), "shard-groups")
        src = src.join(groups, "_hash")
    tie = F.shiftleft(F.shiftrightunsigned("_hash", 64 - TEXT_BITS), ID_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - ID_BITS))
    coords = [F.least((F.log2(F.col("size").cast("double")) / 48 * (1 << COORD_BITS)).cast("bigint"), F.lit((1 << COORD_BITS) - 1)),
              *[F.shiftrightunsigned(F.col(f"_g{i}"), 32 - COORD_BITS) for i in range(len(meta))]]
    return src.select("doc_id", "size", "text_crc32", *[F.shiftleft(c, TEXT_BITS + ID_BITS).bitwiseOR(tie).alias(f"k{j}") for j, c in enumerate(coords)])


def _place(tree: dict, node: int) -> Column:
    """The leaf or open node that a row falls to."""
    if node not in tree:
        return F.lit(node)
    dim, cut, left, right = tree[node]
    return F.when(F.col(f"k{dim}") < F.lit(cut), _place(tree, left)).otherwise(_place(tree, right))


def _cuts(placed: DataFrame, open_nodes: dict, tolerance: float, whole: float) -> dict:
    """For each node ``{node: (dim, lo, hi, weight, goal, shards)}`` the key under
    which rows go left: the bytes under it are the nearest to ``goal``.  First
    between groups of equal texts; inside a group only if it is heavy."""
    cuts, state = {}, {n: (d, ID_BITS, lo >> ID_BITS, hi >> ID_BITS, 0) for n, (d, lo, hi, *_) in open_nodes.items()}
    while state:
        widths = {n: -(-(hi - lo + 1) // BINS) for n, (_, _, lo, hi, _) in state.items()}
        bins = F.lit(None).cast("bigint")
        for n, (d, unit, lo, hi, _) in state.items():
            k = F.shiftright(F.col(f"k{d}"), unit)
            bins = F.when((F.col("node") == n) & k.between(lo, hi), F.floor((k - F.lit(lo)) / F.lit(widths[n]))).otherwise(bins)
        sums = placed.select("node", bins.alias("bin"), "size").where("bin IS NOT NULL").groupBy("node", "bin").agg(F.sum("size").alias("w")).collect()
        for n, (d, unit, lo, hi, below) in list(state.items()):
            *_, w, goal, k = open_nodes[n]
            own = sorted((r.bin, r.w) for r in sums if r.node == n)
            for b, weight in own:
                if below + weight >= goal or b == own[-1][0]:
                    break
                below += weight
            start, width = lo + b * widths[n], widths[n]
            if weight <= tolerance * w or width == 1 and (unit == 0 or weight <= whole * w / k):
                cuts[n] = (start if goal - below <= below + weight - goal else start + width) << unit
                del state[n]
            elif width == 1:
                state[n] = (d, 0, start << unit, (start + 1 << unit) - 1, below)
            else:
                state[n] = (d, unit, start, min(hi, start + width - 1), below)
    return cuts


def kd_tree(points: DataFrame, dims: int, shards: int, tolerance: float = 0.0002, whole: float = 0.01) -> dict:
    """``{node: (dim, cut, left, right)}``; nodes without an entry are shards:
    the node's number then is the shard's."""
    # Open nodes are numbered from ``shards`` on; leaves take the number of the first shard they cover.
    tree, fresh, level = {}, shards, {shards: (0, shards)} if shards > 1 else {}
    while level:
        placed = points.withColumn("node", _place(tree, shards))
        ext = {r.node: r for r in placed.where(F.col("node") >= shards).groupBy("node").agg(
            F.sum("size").alias("w"), *[F.min(f"k{j}").alias(f"lo{j}") for j in range(dims)], *[F.max(f"k{j}").alias(f"hi{j}") for j in range(dims)]).collect()}
        search = {}
        for n, (_, k) in level.items():
            if n in ext:
                e = ext[n]
                d = max(range(dims), key=lambda j: ((e[f"hi{j}"] >> TEXT_BITS + ID_BITS) - (e[f"lo{j}"] >> TEXT_BITS + ID_BITS), -j))
                search[n] = (d, e[f"lo{d}"], e[f"hi{d}"], e.w, e.w * (k // 2) / k, k)
        cuts = _cuts(placed, search, tolerance, whole)
        below = {}
        for n, (first, k) in level.items():
            sides = []
            for at, m in ((first, k // 2), (first + k // 2, k - k // 2)):
                if m == 1:
                    sides.append(at)
                else:
                    fresh += 1
                    below[fresh] = (at, m)
                    sides.append(fresh)
            tree[n] = (search[n][0] if n in search else 0, cuts.get(n, 0), *sides)
        level = below
    return tree


def shard(documents: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text", meta: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` per row; slots are gapless
    from 0 within a shard, by hash bucket, then id."""
    points = written(_points(documents, key, text, meta), "shard-points")
    tree = kd_tree(points, 1 + len(meta), shards)
    buckets = max(1, -(-points.count() // (shards * SLOT_ROWS)))
    placed = points.select("doc_id", "size", "text_crc32", (_place(tree, shards) if shards > 1 else F.lit(0)).alias("shard")) \
        .withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    placed = written(placed, "shard-placed")
    before = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).selectExpr(
        "shard", "_bucket", "coalesce(sum(_n) OVER (PARTITION BY shard ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before")
    rows = placed.selectExpr("*", "row_number() OVER (PARTITION BY shard, _bucket ORDER BY doc_id, text_crc32, size) - 1 AS _at")
    return rows.join(before, ["shard", "_bucket"]).select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_at")).cast("bigint").alias("slot"))
