"""Toxicity: class-conditional Kneser-Ney models.

Labelled texts give bigram counts per class.  For class c

    P_c(w | v) = (n_c(vw) - D(n_c(vw))) / n_c(v) + M_c(v) / n_c(v) * P_c(w)
    P_c(w)     = (n_c(w) - D(n_c(w))) / N_c + M_c / N_c * S(w)
    S(w)       = continuation counts: in how many kinds of bigrams w ends,
                 shared by both classes

with discounts D for counts of 1, 2 and more, and M the mass they free; so a
rare expression is smoothed through counts both classes share, and says little.
A word repeated in a row counts once.  A text's toxic and ordinary
log-likelihoods are compared per word: over the whole text, over its most toxic
passage of ``WINDOW`` words, and over its most toxic expressions; a logistic
calibration of these figures, fitted on labelled rows that the counts leave
out, gives the score.

Counts cover every word of all training rows and are gathered by shuffles on
the n-gram (words are 32-bit hashes), so they grow with the input.  A count of 1
is discounted whole (D = 1): it frees its mass for the backoff and keeps nothing
of its own.  So an n-gram seen once per class scores like one never seen, a word
seen once differs from an unseen one by a factor that both classes share, and
scoring needs only the n-grams seen twice or more in a class and the words that
precede one; nothing else is dropped, and the result is that of the whole tables.
Up to ``known`` such rows are broadcast in one piece.  Up to ``SLICES`` times as
many are broadcast in slices of ``known / 8`` rows, dealt by a hash: a worker
holds one slice at a time and looks up the distinct n-grams of a block of texts
in each.  Beyond, the texts' hashes are written in blocks and each block's distinct
n-grams are joined with the tables and grouped with it again.  All ways give the
same scores.

NULL and empty texts have no words and get the calibration's value for no
evidence.  Labels: see ``common.clean_labels``; repeated rows each count and
are each scored; without labelled rows of both classes every score is the
share of label 1 (0 without any).
"""

from __future__ import annotations

import math
import pickle
import uuid
import zlib
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpuskit.llm.common import clean_labels, release, released, text_slices, written

SEPARATORS = r"[^\p{L}]+"
WINDOW, KNOWN, SLICES = 8, 4 << 20, 64
BLOCK_WORDS, BLOCK_ROWS = 1 << 20, 1 << 16  # of texts that are looked up together in sliced tables
DISCOUNTS = (1.0, 1.2, 1.4)  # of counts 1, 2, 3 and more; the first has to be 1 (see above)
N_FIGURES = 5
CALIBRATION_SHARE, CALIBRATION_ROWS = 4, 20_000
BROADCAST_LABELS = 1_000_000  # rows (id, label) counted to be fewer are broadcast, others joined by a shuffle
START = 0


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the lower-case words of all texts in a row, and each one's text;
    a word repeated in a row counts once."""
    parts = pc.split_pattern_regex(pc.utf8_lower(texts), pattern=SEPARATORS)
    flat = pc.list_flatten(parts)
    filled = pc.greater(pc.binary_length(flat), 0)
    words = flat.filter(filled).dictionary_encode()
    doc = pc.list_parent_indices(parts).filter(filled).to_numpy().astype(np.int64)
    crcs = np.array([zlib.crc32(w) | 1 for w in words.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    word = crcs[words.indices.to_numpy()] if len(doc) else np.zeros(0, np.uint64)
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])
    return word[new], doc[new]


def discount(n):
    """The part of a count that goes to the backoff (numbers or a column name)."""
    if isinstance(n, str):
        return F.when(F.col(n) == 0, 0.0).when(F.col(n) == 1, DISCOUNTS[0]).when(F.col(n) == 2, DISCOUNTS[1]).otherwise(DISCOUNTS[2])
    return np.array((0.0, *DISCOUNTS))[np.minimum(n, 3).astype(np.int64)]


def before(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The word before each word of its text (START for the first)."""
    out = np.concatenate(([START], words[:-1])).astype(np.uint64)
    out[np.diff(doc, prepend=-1) != 0] = START
    return out


def bigrams(words: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return (before(words, doc) << np.uint64(32)) | words


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; ``x`` is sorted in place (np.unique's hash table is ten times slower here)."""
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def distinct_keys(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct bigrams, and words with START."""
    return _distinct(bigrams(words, doc)), _distinct(np.append(words, np.uint64(START)))


def bigram_counts(labelled: DataFrame) -> DataFrame:
    """``(gram, n0, n1)`` over rows ``(label, text)``; pre-aggregated per task and slice."""
    def run(batches):
        for b in text_slices(batches, 1 << 20, 8 << 20):
            words, doc = hashes(b.column(1))
            every, y = bigrams(words, doc), b.column(0).to_numpy()[doc]
            grams, at = np.unique(every, return_inverse=True)
            counts = [np.bincount(at[y == c], minlength=len(grams)) for c in (0, 1)]
            yield pa.record_batch([pa.array(grams.view(np.int64)), *map(pa.array, counts)], names=["gram", "n0", "n1"])
    return labelled.select("label", "text").mapInArrow(run, "gram bigint, n0 bigint, n1 bigint") \
        .groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


@dataclass(frozen=True)
class ClassModels:
    gram: np.ndarray  # sorted bigrams
    own: np.ndarray  # (2, bigrams) discounted counts
    word: np.ndarray  # sorted words
    context: np.ndarray  # (2, words) times the word precedes another
    mass: np.ndarray  # (2, words) what discounts free in the word's bigrams
    unigram: np.ndarray  # (2, words) P_c(w)
    rare: np.ndarray  # (2,) P_c of a word outside the table, but for a factor both classes share

    @staticmethod
    def of(gram, n, word, counts, kinds, context, mass, totals) -> ClassModels:
        """From counts: of bigrams ``n`` (2, bigrams), of words ``counts``, ``context`` and ``mass`` (2, words), in any
        order; ``totals``: (words per class, mass per class, kinds, words) of the whole tables."""
        number, freed, every_kind, vocabulary = totals
        every = every_kind + 0.5 * vocabulary + 0.5
        left = [freed[c] / number[c] for c in (0, 1)]
        g, w = np.argsort(gram), np.argsort(word)
        unigram = np.array([(counts[c] - discount(counts[c])) / number[c] + left[c] * (kinds + 0.5) / every for c in (0, 1)])
        return ClassModels(gram[g], np.array([n[c] - discount(n[c]) for c in (0, 1)])[:, g], word[w], np.array(context)[:, w], np.array(mass)[:, w],
                           unigram[:, w], np.array([left[c] * 0.5 / every for c in (0, 1)]))

    @staticmethod
    def _find(table, x):
        if not len(table):
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        at = np.minimum(np.searchsorted(table, x), len(table) - 1)
        return at, table[at] == x

    def ratios(self, words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word: log P_1 - log P_0, given the word before and alone."""
        def pick(row, at, found, none):
            return np.where(found, row[at], none) if len(row) else np.full(len(at), none, float)
        # Distinct bigrams are looked up once.
        grams, back = np.unique(bigrams(words, doc), return_inverse=True)
        g, g_in = self._find(self.gram, grams)
        w, w_in = self._find(self.word, grams & np.uint64(0xFFFFFFFF))
        v, v_in = self._find(self.word, grams >> np.uint64(32))
        given, alone = [], []
        for c in (0, 1):
            p = pick(self.unigram[c], w, w_in, self.rare[c])
            n = pick(self.context[c], v, v_in, 0)
            known = np.maximum(n, 1)
            given.append(np.log(np.where(n > 0, pick(self.own[c], g, g_in, 0) / known + pick(self.mass[c], v, v_in, 0) / known * p, p)))
            alone.append(np.log(p))
        return (given[1] - given[0])[back], (alone[1] - alone[0])[back]

    def figures(self, words: np.ndarray, doc: np.ndarray, rows: int) -> list[list[float]]:
        """Length-normalised log-likelihood differences of each text."""
        given, alone = self.ratios(words, doc)
        grams = bigrams(words, doc)
        edges = np.searchsorted(doc, np.arange(rows + 1)).tolist()
        out = []
        for lo, hi in zip(edges, edges[1:]):
            n = hi - lo
            if not n:
                out.append([0.0] * N_FIGURES)
                continue
            own, k = given[lo:hi], min(n, WINDOW)
            sums = np.concatenate(([0.0], np.cumsum(own)))
            pairs = np.sort(own[np.unique(grams[lo:hi], return_index=True)[1]])
            single = np.sort(alone[lo:hi][np.unique(words[lo:hi], return_index=True)[1]])
            out.append([float(sums[-1] / n), float((sums[k:] - sums[:-k]).max() / k), float(pairs[-5:].mean()), float(single[-3:].mean()), math.log1p(n)])
        return out


def count_tables(labelled: DataFrame):
    """(bigram counts, word counts, totals) of rows ``(label, text)``; None without words in both classes."""
    grams = written(bigram_counts(labelled), "toxicity-bigrams")
    ends = grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)).alias("word")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.count("*").alias("kinds"))
    begins = grams.groupBy(F.shiftrightunsigned("gram", 32).alias("word")).agg(
        *[F.sum(f"n{c}").alias(f"c{c}") for c in (0, 1)], *[F.sum(discount(f"n{c}")).alias(f"m{c}") for c in (0, 1)])
    words = written(ends.join(begins, "word", "full").na.fill(0), "toxicity-words")
    total = words.agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in (0, 1)], *[F.sum(discount(f"n{c}")).alias(f"m{c}") for c in (0, 1)],
                      F.sum("kinds").alias("kinds"), F.count("*").alias("v")).first()
    if not total.n0 or not total.n1:
        return None
    return grams, words, ((total.n0, total.n1), (total.m0, total.m1), total.kinds, total.v)


_COUNTS = ("n0", "n1", "kinds", "c0", "c1", "m0", "m1")


def scoring_counts(grams: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The bigrams and words that scores depend on.  The others score as unseen: their
    discounted counts are 0, and as a context they pass all their mass on."""
    return grams.where("n0 > 1 OR n1 > 1"), words.where("n0 > 1 OR n1 > 1 OR m0 <> c0 OR m1 <> c1").select("word", *_COUNTS)


def scoring_rows(grams: DataFrame, words: DataFrame) -> DataFrame:
    """Both of :func:`scoring_counts` as ``(kind, key, n0, n1, kinds, c0, c1, m0, m1)``: bigrams are kind 0, words kind 1."""
    zero = [F.lit(0).cast("double").alias(c) for c in _COUNTS[2:]]
    g = grams.select(F.lit(0).alias("kind"), F.col("gram").alias("key"), *[F.col(c).cast("double").alias(c) for c in _COUNTS[:2]], *zero)
    return g.unionByName(words.select(F.lit(1).alias("kind"), F.col("word").alias("key"), *[F.col(c).cast("double").alias(c) for c in _COUNTS]))


def fit_models(labelled: DataFrame) -> ClassModels | None:
    """The scoring tables of rows ``(label, text)`` in one piece; None without words in both classes."""
    got = count_tables(labelled)
    return None if got is None else _collected(*scoring_counts(*got[:2]), got[2])


def _collected(grams: DataFrame, words: DataFrame, totals) -> ClassModels:
    """Tables of a checked size as arrays; sorted by Spark, so that they aren't copied here."""
    def cols(df, key, names):
        t = df.select(key, *names).orderBy(key).toArrow()
        return [t.column(c).to_numpy() for c in (key, *names)]
    word, *counts = cols(words, "word", _COUNTS)
    n0, n1, kinds, c0, c1, m0, m1 = counts
    gram, *n = cols(grams, "gram", _COUNTS[:2])
    return ClassModels.of(gram.view(np.uint64), n, word.astype(np.uint64), (n0, n1), kinds, (c0, c1), (m0, m1), totals)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 30) -> np.ndarray:
    """Weights (constant first) by Newton steps; a few thousand rows at most."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(w)), x.T @ (y - p) - keep @ w)
    return w


def figures_by_broadcast(df: DataFrame, models: ClassModels, keep: str) -> DataFrame:
    """``(keep, figures)`` of rows ``(keep, text)``."""
    kind = df.schema[keep].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(tuple(getattr(models, f.name) for f in fields(models)))

    def run(batches):
        own = ClassModels(*shared.value)
        for b in text_slices(batches, 1 << 12, 4 << 20):
            words, doc = hashes(b.column(1))
            yield pa.record_batch([b.column(0), pa.array(own.figures(words, doc, b.num_rows), pa.list_(pa.float64()))], names=[keep, "figures"])
    return df.select(keep, "text").mapInArrow(released(run), f"{keep} {kind}, figures array<double>")


def _slice_of(key, n: int):
    """Which of ``n`` slices a bigram or word is dealt to (keys or a column name)."""
    if isinstance(key, str):
        both = F.shiftrightunsigned(key, 32).bitwiseXOR(F.col(key).bitwiseAND(F.lit(0xFFFFFFFF)))
        return F.pmod(F.shiftrightunsigned(both, 1), F.lit(n)).cast("int")  # the last bit of words is 1
    return (((key >> np.uint64(32)) ^ (key & np.uint64(0xFFFFFFFF))) >> np.uint64(1)) % np.uint64(n)


def _packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and each row's place among them in as few bytes as that takes."""
    values, at = np.unique(x, return_inverse=True)
    return values, at.astype(np.min_scalar_type(len(values)))


def table_slices(df: DataFrame, key: str, names: tuple[str, ...], rows: int, most: int) -> list:
    """``df`` (``rows`` rows) as broadcasts of about ``most`` rows, by :func:`_slice_of`: pickled ``(sorted keys,
    packed columns)``.  Executors pack them, so that the driver holds no more than one slice's bytes."""
    n = -(-rows // most) or 1

    def pack(t: pa.Table) -> pa.Table:
        keys = t.column(key).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        data = pickle.dumps((keys[order], [_packed(t.column(c).to_numpy()[order]) for c in names]), 5)
        return pa.table([pa.array([data], pa.binary()), t.column("slice").combine_chunks()[:1]], names=["data", "slice"])
    dealt = df.select(key, *names, _slice_of(key, n).alias("slice")).groupBy("slice").applyInArrow(pack, "data binary, slice int")
    dealt, out = written(dealt, "toxicity-slices", "slice"), []
    empty = pickle.dumps((np.zeros(0, np.uint64), [_packed(np.zeros(0, np.int64))] * len(names)), 5)
    for k in range(n):
        got = dealt.where(F.col("slice") == k).select("data").toArrow().column(0).to_pylist()
        out.append(df.sparkSession.sparkContext.broadcast(got[0] if got else empty))
        del got
        release()
    return out


def _loaded(shared):
    """A slice's tables; the worker doesn't keep the broadcast (but for an encrypted one, which has no file)."""
    value = shared.value
    if getattr(shared, "_path", None) is not None:
        del shared._value
    return pickle.loads(value)


def looked_up(slices: list, keys: np.ndarray, n_columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Those of the distinct ``keys`` that the tables have, and their columns; one slice is held at a time."""
    own, found, cols = _slice_of(keys, len(slices)), [], [[] for _ in range(n_columns)]
    for k, shared in enumerate(slices):
        wanted = keys[own == k]
        if len(wanted):
            table, packed = _loaded(shared)
            at, there = ClassModels._find(table, wanted)
            found.append(wanted[there])
            for col, (values, places) in zip(cols, packed):
                col.append(values[places[at[there]]])
            del table, packed
    return np.concatenate([np.zeros(0, np.uint64), *found]), [np.concatenate(c) if c else np.zeros(0) for c in cols]


def figures_by_slices(df: DataFrame, grams: list, words: list, totals, keep: str) -> DataFrame:
    """The same with the tables in slices (:func:`table_slices`): texts stay where they are, and a task
    holds the word hashes of one block of texts, the rows its n-grams have and one slice; figures come by 1 MB of text."""
    kind, key_type = df.schema[keep].dataType.simpleString(), to_arrow_type(df.schema[keep].dataType)

    def score(parts):
        pairs = _distinct(np.concatenate([p[3] for p in parts]))
        gram, n = looked_up(grams, pairs, 2)
        word, (n0, n1, kinds, c0, c1, m0, m1) = looked_up(words, _distinct(np.concatenate([p[4] for p in parts])), len(_COUNTS))
        models = ClassModels.of(gram, n, word, (n0, n1), kinds, (c0, c1), (m0, m1), totals)
        for keys, own, sizes, *_ in parts:
            out = models.figures(own.astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes), len(sizes))
            yield pa.record_batch([keys, pa.array(out, pa.list_(pa.float64()))], names=[keep, "figures"])

    def run(batches):
        parts, n_words, n_rows = [], 0, 0
        for b in text_slices(batches, 1 << 12, 1 << 20):
            own, doc = hashes(b.column(1))
            # Keys are copied: a slice of them would hold the whole batch.
            parts.append((b.column(0).take(pa.array(np.arange(b.num_rows))).cast(key_type), own.astype("<u4"), np.bincount(doc, minlength=b.num_rows), *distinct_keys(own, doc)))
            n_words, n_rows = n_words + len(own), n_rows + b.num_rows
            if n_words >= BLOCK_WORDS or n_rows >= BLOCK_ROWS:
                yield from score(parts)
                parts, n_words, n_rows = [], 0, 0
        if parts:
            yield from score(parts)
    return df.select(keep, "text").mapInArrow(released(run), f"{keep} {kind}, figures array<double>")


def figures_by_join(df: DataFrame, rows: DataFrame, totals, keep: str) -> DataFrame:
    """The same with :func:`scoring_rows` of any size: hashes written in blocks, each block's
    distinct bigrams and words joined with the tables (one row a key) and grouped with it, as columns."""
    kind, key_type = df.schema[keep].dataType.simpleString(), to_arrow_type(df.schema[keep].dataType)

    def pack(batches):
        for b in text_slices(batches, 1 << 12, 4 << 20):
            words, doc = hashes(b.column(1))
            yield pa.record_batch([pa.array([uuid.uuid4().hex]), pa.array([b.column(0).to_pylist()], pa.list_(key_type)), pa.array([words.astype("<u4").tobytes()], pa.binary()),
                                   pa.array([np.bincount(doc, minlength=b.num_rows).astype("<u4").tobytes()], pa.binary())], names=["block", "keys", "words", "sizes"])

    def unpack(words, sizes):
        sizes = np.frombuffer(sizes, "<u4")
        return np.frombuffer(words, "<u4").astype(np.uint64), np.repeat(np.arange(len(sizes)), sizes)

    def distinct(batches):
        for b in batches:
            for r in b.to_pylist():
                grams, own = distinct_keys(*unpack(r["words"], r["sizes"]))
                for k, keys in enumerate((grams.view(np.int64), own.view(np.int64))):
                    for lo in range(0, len(keys), 1 << 16):  # small batches for the JVM
                        part = keys[lo:lo + (1 << 16)]
                        yield pa.record_batch([pa.array([r["block"]] * len(part)), pa.array(np.full(len(part), k, np.int32)), pa.array(part)], names=["block", "kind", "key"])

    def score(block: pa.Table, got: pa.Table) -> pa.Table:
        keys = block.column("keys").combine_chunks().flatten()
        words, doc = unpack(*(block.column(c)[0].as_py() for c in ("words", "sizes")))
        g, w = (got.filter(pc.equal(got.column("kind"), k)) for k in (0, 1))
        n0, n1, kinds, c0, c1, m0, m1 = (w.column(c).to_numpy() for c in _COUNTS)
        gram, word = (t.column("key").to_numpy().view(np.uint64) for t in (g, w))
        own = ClassModels.of(gram, [g.column(c).to_numpy() for c in _COUNTS[:2]], word, (n0, n1), kinds, (c0, c1), (m0, m1), totals)
        return pa.table([keys, pa.array(own.figures(words, doc, len(keys)), pa.list_(pa.float64()))], names=[keep, "figures"])
    blocks = written(df.select(keep, "text").mapInArrow(released(pack), f"block string, keys array<{kind}>, words binary, sizes binary"), "toxicity-blocks")
    need = blocks.select("block", "words", "sizes").mapInArrow(released(distinct), "block string, kind int, key bigint")
    got = need.join(written(rows, "toxicity-tables"), ["kind", "key"]).select("block", "kind", "key", *_COUNTS)
    return blocks.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(score, f"{keep} {kind}, figures array<double>")


def classify(documents: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", known: int = KNOWN,
             calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """``(doc_id, score)`` for every row.  One in ``CALIBRATION_SHARE`` labelled
    training ids calibrates, at most ``calibration_rows`` of them by id hash."""
    docs = documents.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    lab = clean_labels(labels, label).withColumn("_h", F.xxhash64("doc_id"))
    apart = F.pmod("_h", F.lit(CALIBRATION_SHARE)) == 0
    if lab.count() <= BROADCAST_LABELS:  # texts stay where they are
        rows = docs.join(F.broadcast(lab), "doc_id").select("label", "text", "_h")
    else:
        rows = written(docs.join(lab, "doc_id").select("label", "text", "_h"), "toxicity-rows")
    counted = count_tables(rows.where(~apart))
    share = lab.agg(F.avg("label")).first()[0] or 0.0
    if counted is None:
        return docs.select("doc_id", F.lit(float(share)).alias("score"))
    tables, totals = scoring_counts(*counted[:2]), counted[2]
    sizes = [t.count() for t in tables]
    if sum(sizes) <= known:
        models = _collected(*tables, totals)
        figures = lambda df, keep: figures_by_broadcast(df, models, keep)
    elif sum(sizes) <= SLICES * known:
        names = (("gram", _COUNTS[:2]), ("word", _COUNTS))
        slices = [table_slices(t, *own, n, max(known // 8, 1)) for t, own, n in zip(tables, names, sizes)]
        figures = lambda df, keep: figures_by_slices(df, *slices, totals, keep)
    else:
        figures = lambda df, keep: figures_by_join(df, scoring_rows(*tables), totals, keep)
    held = rows.where(apart)
    n = lab.where(apart).count()
    if n > calibration_rows:  # a sample of bounded size
        held = held.where(F.pmod(F.xxhash64("_h"), F.lit(1_000_000)) < int(1_000_000 * calibration_rows / n))
    got = figures(held, "label").collect()
    x, y = np.array([r.figures for r in got], float).reshape(-1, N_FIGURES), np.array([r.label for r in got], float)
    if len(set(y.tolist())) < 2:
        weights, mean, scale = np.array([math.log((share + 1e-6) / (1 - share + 1e-6)), 1.0, 1.0, 0.5, 0.5, 0]), np.zeros(N_FIGURES), np.ones(N_FIGURES)
    else:
        order = np.lexsort((*x.T, y))  # sums don't depend on the order rows came in
        x, y = x[order], y[order]
        mean, scale = x.mean(0), x.std(0) + 1e-9
        weights = logistic((x - mean) / scale, y)
    z = F.lit(float(weights[0]))
    for k in range(N_FIGURES):
        z = z + (F.col("figures")[k] - float(mean[k])) / float(scale[k]) * float(weights[k + 1])
    z = F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))
    return figures(docs, "doc_id").select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))
