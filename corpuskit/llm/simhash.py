"""SimHash near-duplicate groups with pigeonring filtering.

Fingerprints (64 bits) link at ``tau`` = 2 or fewer differing bits.  The word
is cut into a ring of three segments.  Pigeonring principle: if two words
differ in at most tau bits, some segment starts a chain whose first l segments
differ in at most floor(l * tau / 3) bits for every l.  For tau = 2 the budgets
are 0, 1, 2: the first segment is equal, and the second, having one difference
at most, has an equal half.  (segment, equal half) is the index key, about 32
bits; the chain's second budget prunes before the full Hamming check.

Keys held by more than ``hot`` distinct fingerprints never emit their pairs:
each member emits itself and itself with one bit flipped, and words that share
such a value (they differ in at most two bits) are linked to the smallest of
them.  That is exact and linear: every link of the key's members joins two
words through a common one-flip value, and all words at such a value are links.

Work is over distinct fingerprints; equal ones are one vertex with a partial
``min`` of ids, whatever their number.  Components by large-star / small-star
rounds over the links, each written to the shared folder.

Null texts are empty; texts without words have fingerprint zero and are linked
like any other; rows with a NULL id take part but never name a component
unless all its ids are NULL; repeated rows give repeated results.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import fresh, released, text_slices, texts_of, written

SEGMENTS = ((0, 21), (21, 22), (43, 21))  # (first bit, width): the ring
HOT = 64


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every k-word shingle (bytes, ASCII lower case, ASCII white space)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= k:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-k] + 1)).tolist()
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[k - 1:].tolist())], np.uint64)


def fingerprint(text: bytes, k: int) -> int:
    """Bit i is 1 if over half of the shingle hashes have it; no words: 0."""
    h = shingle_hashes(text, k)
    if not len(h):
        return 0
    ones = sum(np.unpackbits(h[i:i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
               for i in range(0, len(h), 65536))
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3) -> DataFrame:
    """``(doc_id, fp)``: one signed 64-bit fingerprint per row."""
    def run(batches):
        for b in text_slices(batches):
            fps = np.array([fingerprint(t, k) for t in texts_of(b)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), pa.array(fps)], names=["doc_id", "fp"])
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(released(run), f"doc_id {kind}, fp bigint")


def _mask(lo: int, width: int) -> int:
    m = ((1 << width) - 1) << lo
    return m - (1 << 64) if m >> 63 else m


def _chains():
    """(tag, mask of equal bits, mask of the chain's second segment) per index key."""
    for i, (lo, w) in enumerate(SEGMENTS):
        lo2, w2 = SEGMENTS[(i + 1) % 3]
        for half, (a, b) in enumerate(((lo2, w2 // 2), (lo2 + w2 // 2, w2 - w2 // 2))):
            yield 2 * i + half, _mask(lo, w) | _mask(a, b), _mask(lo2, w2), [x for x in range(64) if not lo <= x < lo + w and not a <= x < a + b]


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``fp``: all pairs within
    two bits whose index keys aren't hot, and for hot keys links that join the
    same words (see the module's text)."""
    chains = list(_chains())
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("tag"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                                 for t, m, _, _ in chains])).alias("k")).select("k.tag", "k.key", "fp")
    keyed = written(keyed, "simhash-keys")
    shared = written(keyed.groupBy("tag", "key").count().where("count > 1"), "simhash-shared")
    tight = keyed.join(shared.where(F.col("count") <= hot).drop("count"), ["tag", "key"], "left_semi")
    second = reduce(lambda c, x: c.when(F.col("tag") == x[0], F.lit(x[2])), chains, F.when(F.lit(False), F.lit(0)))
    x, y = tight.withColumnRenamed("fp", "a"), tight.withColumnRenamed("fp", "b")
    diff = F.col("a").bitwiseXOR(F.col("b"))
    pairs = x.join(y, ["tag", "key"]).where(F.col("a") < F.col("b")) \
        .where(F.bit_count(diff.bitwiseAND(second)) <= 1).where(F.bit_count(diff) <= 2).select("a", "b")
    crowd = keyed.join(shared.where(F.col("count") > hot).drop("count"), ["tag", "key"], "left_semi")
    flips = reduce(lambda c, x: c.when(F.col("tag") == x[0], F.array(F.lit(0).cast("bigint"), *[F.lit(_mask(b, 1)) for b in x[3]])),
                   chains, F.when(F.lit(False), F.array().cast("array<bigint>")))
    met = crowd.select("tag", "fp", F.explode(flips).alias("flip")) \
        .select("tag", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"), "fp")
    # At most one word per free bit and the value itself meet at a value: the lists are bounded.
    met = met.groupBy("tag", "at").agg(F.collect_set("fp").alias("w")).where(F.size("w") > 1) \
        .select(F.array_min("w").alias("a"), F.explode("w").alias("b")).where("a < b")
    return pairs.unionByName(met).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(vertex, component)`` for the vertices of ``edges (a, b)``, a < b; the
    component is its smallest vertex.  Each round reads written tables, so AQE
    can split the side of a hub; a round that changes nothing ends it."""
    e = written(edges.select("a", "b"), "cc")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-low")
        e = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        e = written(e, "cc-large")
        low = written(e.groupBy("b").agg(F.min("a").alias("m")), "cc-low")
        near = e.join(low, "b")
        e = near.where("m < a").select(F.col("m").alias("a"), F.col("a").alias("b")) \
            .unionByName(low.select(F.col("m").alias("a"), "b")).distinct()
        e = written(e, "cc-small")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("b").alias("vertex"), F.col("a").alias("component")) \
        .unionByName(e.select(F.col("a").alias("vertex"), F.col("a").alias("component"))).distinct()


def _named(fps: DataFrame, hot: int) -> DataFrame:
    """Per fingerprint: ``(fp, first)``, the first row ``(no id, doc_id, more)`` of its component."""
    words = written(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), *[c for c in fps.columns if c != "fp"])).alias("least")), "simhash-distinct")
    comp = components(links(words.select("fp"), hot))
    named = written(words.join(comp, words["fp"] == comp["vertex"], "left")
                    .select("fp", F.coalesce("component", "fp").alias("c"), "least"), "simhash-named")
    # Written before joins: one row per fingerprint, so AQE may split a hot one.
    return written(named.join(named.groupBy("c").agg(F.min("least").alias("first")), "c").select("fp", "first"), "simhash-first")


def near_groups(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, hot: int = HOT) -> DataFrame:
    """``(doc_id, fp, component_id)``: one row per input row; the component's
    id is the smallest ``doc_id`` that chains of links reach."""
    fps = written(fingerprints(documents, key, text, k), "simhash-fp")
    return fps.join(_named(fps, hot), "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_first(documents: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, hot: int = HOT) -> DataFrame:
    """``documents`` with one row of each group: the one with the smallest id
    (of equal ids, the smallest text hash; of repeated rows, any one)."""
    m, at = fresh(documents, "_mark"), fresh(documents, "_at")
    mark = documents.withColumn(m, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    fps = fingerprints(mark.select(F.struct(F.col(key).alias("doc_id"), F.col(m).alias("mark")).alias("id"), F.col(text).alias("text")), "id", "text", k)
    fps = written(fps.select("doc_id.doc_id", "doc_id.mark", "fp"), "simhash-fp")
    first = written(_named(fps, hot).select("first").distinct().select(F.col("first.doc_id").alias(at), F.col("first.mark").alias(f"{m}_of")), "simhash-kept")
    kept = mark.join(first, F.col(key).eqNullSafe(F.col(at)) & (F.col(m) == F.col(f"{m}_of")), "left_semi")
    if not fps.groupBy("doc_id", "mark").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([key, m])
    return kept.select(*documents.columns)
