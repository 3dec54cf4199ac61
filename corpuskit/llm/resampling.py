"""Target-distribution importance resampling over hashed n-grams, in Arrow kernels.

A batch of texts is lower-cased (``ascii_lower``, A-Z only), split at everything
that is no word character (``split_pattern_regex``), flattened and
``dictionary_encode``d.  Neighbouring dictionary indices make an n-gram: the
index of its first n-1 words, shifted, plus that of the last one; those codes
are dictionary-encoded again, so a CRC-32 is taken once per distinct n-gram of
the batch.  CRC modulo ``buckets`` is the bucket.  Counting adds buckets up;
scoring takes every feature's gain and sums per document's segment.

A bucket's gain is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), s of S features in
the documents and t of T in the target; a document's weight is the floored mean
of its features' gains.  Its score adds Gumbel noise from a hash of its key, so
the highest scores are a sample without replacement in proportion to
exp(weight / 1000).

Plan: two passes over the texts without shuffling them; a task sends at most
``buckets`` counts, the gains are ``buckets`` numbers (a bound, so broadcast).
The k-th score comes from a histogram of the integer scores, and only rows at or
above it are sorted, by range partitions.

NULL and empty texts have no features and weight 0.  A NULL key hashes like an
empty one and comes first among ties; rows that are equal in key, weight and
features take consecutive ranks.  Repeated rows count and are drawn each.  Empty
tables are allowed on both sides (T = 0: the gains only divide by the documents'
own counts).  A text is taken whole, however long.  Result columns whose names
the kept columns already use (in any case) raise.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.llm.common import text_slices, written
from corpuskit.operators.ordering import with_row_index_range

#: All but digits, a-z and what lies beyond ASCII.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RESULT = ("n_words", "n_features", "weight", "score", "rank")


def features(texts: pa.Array, n: int, buckets: int):
    """For k = 1 to ``n``: (document of each k-gram, its distinct k-gram, bucket of each distinct k-gram)."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=SEPARATORS)
    flat = pc.list_flatten(parts)
    filled = pc.greater(pc.binary_length(flat), 0)  # separators at either end leave an empty word
    words = flat.filter(filled).dictionary_encode()
    doc = pc.list_parent_indices(parts).filter(filled).to_numpy().astype(np.int64)
    word = words.indices.to_numpy().astype(np.int64)
    names = words.dictionary.cast(pa.binary()).to_pylist()
    tails, size = [b" " + w for w in names], max(1, len(names))
    crcs = [crc32(w) for w in names]
    first, gram = np.arange(len(word)), word  # place of the first word, distinct k-gram
    for k in range(1, n + 1):
        if k > 1:
            on = np.flatnonzero(first + k - 1 < len(word))
            on = on[doc[first[on]] == doc[first[on] + k - 1]]
            codes = pa.array(gram[on] * size + word[first[on] + k - 1]).dictionary_encode()
            first, gram = first[on], codes.indices.to_numpy().astype(np.int64)
            head, last = np.divmod(codes.dictionary.to_numpy(), size)
            crcs = [crc32(tails[w], crcs[h]) for h, w in zip(head.tolist(), last.tolist())]
        yield doc[first], gram, np.array(crcs, np.int64) % buckets


def bucket_counts(texts: DataFrame, text: str = "text", n: int = 2, buckets: int = 10_000) -> DataFrame:
    """``(bucket, n)``: features of all texts per bucket, summed in each task first."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for part in text_slices([b]):
                for _, gram, bucket in features(part.column(0), n, buckets):
                    np.add.at(total, bucket, np.bincount(gram, minlength=len(bucket)))
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])
    return texts.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "bucket int, n bigint") \
        .groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """Gain of every bucket, from the two tables of :func:`bucket_counts` (at most ``buckets`` rows each)."""
    s, t = (np.zeros(buckets) for _ in range(2))
    for own, counts in ((s, source), (t, target)):
        for r in counts.toLocalIterator():
            own[r.bucket] = r.n
    top, low = (t + 1) * (s.sum() + buckets), (s + 1) * (t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(x)) for x in (top / low).tolist()], np.int64)


def weigh(documents: DataFrame, gain: np.ndarray, keep=("doc_id",), text: str = "text", n: int = 2) -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``n_features`` and ``weight`` of each text."""
    shared = documents.sparkSession.sparkContext.broadcast(gain)
    own = documents.select(*keep)
    schema = T.StructType([*own.schema.fields, *[T.StructField(c, T.LongType()) for c in RESULT[:3]]])

    def run(batches):
        gain = shared.value
        for b in batches:
            for part in text_slices([b]):
                rows, m = part.num_rows, part.num_columns - 1
                number, total, words = (np.zeros(rows, np.int64) for _ in range(3))
                for k, (doc, gram, bucket) in enumerate(features(part.column(m), n, len(gain))):
                    count = np.bincount(doc, minlength=rows)
                    number += count
                    if not k:
                        words = count
                    if len(doc):  # documents stand in order: each is one segment
                        start = np.flatnonzero(np.diff(doc, prepend=-1))
                        total[doc[start]] += np.add.reduceat(gain[bucket].take(gram), start)
                weight = total // np.maximum(number, 1)
                yield pa.record_batch([*part.columns[:m], *(pa.array(c) for c in (words, number, weight))], names=schema.names)
    return documents.select(*keep, F.col(text).cast("string").alias("_resampling_text")).mapInArrow(run, schema)


def resample(documents: DataFrame, target: DataFrame, key: str = "doc_id", keep=None, text: str = "text", target_text: str = "text",
             percent: int = 25, least_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Every row's columns ``keep`` (the key by default; name ``text`` too to get the
    texts) with ``n_words, n_features, weight, score, rank``, all long.

    ``rank``: 1, 2, 3 ... for the floor(percent N / 100) highest scores among the N
    rows of at least ``least_words`` words, ties to the smaller key; else NULL."""
    keep = [*(keep or [key])]
    if key not in keep:
        keep.insert(0, key)
    clash = {c.lower() for c in keep} & {*RESULT}
    if clash:
        raise ValueError(f"kept columns clash with result columns: {sorted(clash)}")
    gain = gains(bucket_counts(documents, text, n, buckets), bucket_counts(target, target_text, n, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))
    rows = written(weigh(documents, gain, keep, text, n).withColumn("score", (F.col("weight") + noise).cast("bigint")), "weights")
    taking = F.col("n_words") >= least_words
    # Scores are integers within the gains and the noise, so this histogram is short.
    seen, cut = 0, None
    histogram = rows.where(taking).groupBy("score").count().orderBy(F.desc("score")).collect()
    k = percent * sum(r["count"] for r in histogram) // 100
    for r in histogram:
        if seen >= k:
            break
        seen, cut = seen + r["count"], r.score
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    high = taking & (F.col("score") >= cut)
    drawn = with_row_index_range(rows.where(high), [-F.col("score"), F.col(key), F.col("weight"), F.col("n_features")], "rank")
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))
    return drawn.unionByName(rows.where(~high).withColumn("rank", F.lit(None).cast("bigint")))
