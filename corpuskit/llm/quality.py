"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a dozen document statistics (rates of symbols, capitals,
digits, repeated words and lines, ...), put through logarithms so that classes
are closer to Gaussian.  Class means and covariances are aggregated from sums
of products (one small row set per task); covariances are shrunk towards the
pooled diagonal; the Cholesky factors are computed once and travel with the
scoring function.  The score is the logistic of the difference of the class
log densities plus the log prior ratio.

A NULL or empty text has statistics like any other.  Labels: see
``common.clean_labels``; repeated document rows each count and are each scored.
Without labelled rows of both classes every score is the share of label 1 (0.5
without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import clean_labels, released, text_slices, texts_of, written

UPPER = bytes(range(65, 91))
DIGITS = b"0123456789"
MARKS = b"*&$%#@^~<>{}[]\\=_+"
N_STATS = 13


def statistics(t: bytes) -> list[float]:
    """The transformed statistics of one text."""
    words, n = t.split(), len(t) + 1.0
    lines = t.split(b"\n")
    nw, nl = len(words) + 1.0, len(lines)
    part = lambda chars: (len(t) - len(t.translate(None, chars))) / n
    log = lambda x: math.log(x + 0.003)
    return [
        math.log(n), math.log(nw / nl), math.log((sum(map(len, words)) + 1) / nw),
        log(part(MARKS)), log(part(b"|")), log(part(b"!")), log(part(UPPER)), log(part(DIGITS)), log(part(b".,")),
        math.log((len(set(words)) + 1) / nw), log(sum(map(eq, words, words[1:])) / nw),
        log(1 - len(set(lines)) / nl), log(sum(w.isupper() for w in words) / nw),
    ]


def document_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, stats)``: one row per input row."""
    def run(batches):
        for b in text_slices(batches):
            yield pa.record_batch([b.column(0), pa.array([statistics(t) for t in texts_of(b)], pa.list_(pa.float64()))], names=["doc_id", "stats"])
    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key).alias("doc_id"), F.col(text).alias("_text")).mapInArrow(released(run), f"doc_id {kind}, stats array<double>")


def moments(labelled: DataFrame, d: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Per label: count, sum and sum of outer products of ``stats``, summed over all tasks."""
    def run(batches):
        sums = {}
        for b in batches:
            y, x = b.column(0).to_numpy(zero_copy_only=False), np.array(b.column(1).to_pylist(), float).reshape(-1, d)
            for c in np.unique(y):
                z = np.column_stack([np.ones((y == c).sum()), x[y == c]])
                sums[int(c)] = sums.get(int(c), 0) + z.T @ z
        for c, s in sums.items():
            yield pa.record_batch([pa.array([c] * s.size, pa.int32()), pa.array(range(s.size), pa.int32()), pa.array(s.ravel())], names=["label", "at", "v"])
    rows = labelled.select("label", "stats").mapInArrow(released(run), "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect()
    out = {}
    for c in {r.label for r in rows}:
        s = np.zeros((d + 1) ** 2)
        for r in rows:
            if r.label == c:
                s[r.at] = r.v
        s = s.reshape(d + 1, d + 1)
        out[c] = (s[0, 0], s[0, 1:], s[1:, 1:])
    return out


@dataclass(frozen=True)
class Discriminant:
    means: tuple  # per class 0, 1
    factors: tuple  # inverses of the Cholesky factors
    offset: float  # log prior ratio and determinants; the whole score without factors

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.factors:
            return np.full(len(x), 1 / (1 + math.exp(-self.offset)))
        far = [(((x - m) @ f.T) ** 2).sum(1) for m, f in zip(self.means, self.factors)]
        return 1 / (1 + np.exp(-np.clip((far[0] - far[1]) / 2 + self.offset, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", shrink: float = 0.3, ridge: float = 0.01, d: int = N_STATS) -> Discriminant:
    """``shrink``: the pooled diagonal's part in each class covariance; ``ridge``
    is added to its variances, in units of the pooled ones."""
    rows = stats.join(clean_labels(labels, label), "doc_id").select(F.col("label").cast("int").alias("label"), "stats")
    by = moments(rows, d)
    if len(by) < 2:
        return Discriminant((), (), {0: -5.0, 1: 5.0}[next(iter(by))] if by else 0.0)
    covs, means = [], []
    for c in (0, 1):
        n, s, p = by[c]
        means.append(s / n)
        covs.append(p / n - np.outer(s / n, s / n))
    n0, n1 = by[0][0], by[1][0]
    pooled = np.diag(np.maximum((n0 * np.diag(covs[0]) + n1 * np.diag(covs[1])) / (n0 + n1), 1e-9))
    low = [np.linalg.cholesky((1 - shrink) * c + (shrink + ridge) * pooled) for c in covs]
    offset = math.log(n1 / n0) + sum(s * np.log(np.diag(f)).sum() for s, f in zip((1, -1), low))
    return Discriminant(tuple(means), tuple(np.linalg.inv(f) for f in low), float(offset))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``(doc_id, score)`` of rows ``(doc_id, stats)``."""
    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, -1)
            yield pa.record_batch([b.column(0), pa.array(model.scores(x))], names=["doc_id", "score"])
    kind = stats.schema["doc_id"].dataType.simpleString()
    return stats.select("doc_id", "stats").mapInArrow(released(run), f"doc_id {kind}, score double")


def classify(documents: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, score)`` for every row of ``documents``."""
    stats = written(document_statistics(documents, key, text), "quality-stats")
    return score(stats, fit(stats, labels, label))


def keep_good(documents: DataFrame, labels: DataFrame, least: float = 0.5, label: str = "quality", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``documents`` that score ``least`` or more; texts aren't shuffled."""
    model = fit(document_statistics(documents, key, text), labels, label)

    @F.pandas_udf("double")
    def scored(texts):
        import pandas as pd
        return pd.Series(model.scores(np.array([statistics((t or "").encode()) for t in texts], float).reshape(len(texts), -1)))

    return documents.where(scored(F.col(text)) >= least)
