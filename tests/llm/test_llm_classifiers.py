import math
import pickle
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpuskit.llm import quality, toxicity

SF = "/root/testdata/sf0.1"
DOCS = "doc_id bigint, text string, label int, stats string, score double, _h int"
LABELS = "doc_id bigint, quality int, toxic int, label string"


def held_out(spark, scores, label):
    """(labels, scores) of the held-out fold."""
    lab = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(lab[r.doc_id], r.score) for r in scores.collect() if r.doc_id in lab and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    return np.array([y for y, _ in rows]), np.array([s for _, s in rows])


def auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos]))


@pytest.mark.parametrize("module,label,least,cut,recall,wrong", [(quality, "quality", 0.99, 0.5, 0.98, 0.05), (toxicity, "toxic", 0.93, 0.7, 0.75, 0.03)])
def test_held_out_accuracy(spark, module, label, least, cut, recall, wrong):
    scores = module.classify(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    y, s = held_out(spark, scores, label)
    assert len(y) > 1000 and auc(y, s) > least
    assert (s[y == 1] >= cut).mean() > recall and (s[y == 0] >= cut).mean() < wrong


ROWS = [(1, None), (2, ""), (3, "good words stand here in a row"), (3, "good words stand here in a row"), (None, "text without an id"), (4, "!!! *** !!!"),
        (5, "x" * 300_000), (6, "w " * 100_000), (7, "bad bad idiot idiot trash"), (8, "fine day today")]


@pytest.mark.parametrize("module,label", [(quality, "quality"), (toxicity, "toxic")])
def test_edge_cases_get_scores(spark, module, label):
    docs = spark.createDataFrame([(i, t, 1, "s", 0.5, 2) for i, t in ROWS], DOCS)
    labels = spark.createDataFrame([(i, i % 2, int(i == 7), "l") for i in range(1, 40)] + [(7, 1, 1, "l"), (None, 1, 1, "l"), (3, None, None, "l"), (4, 1, 0, "l"), (4, 0, 1, "l")], LABELS)
    for lab in (labels, labels.limit(0), labels.where(f"{label} = 1")):
        got = module.classify(docs, lab, label).collect()
        assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert module.classify(docs.limit(0), labels, label).count() == 0


def test_rejected_documents_go_and_columns_stay(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.classify(docs, labels).where("score >= 0.5").collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want and 0 < len(want) < docs.count()


def test_discriminant_equals_the_densities(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (500, 3)), rng.normal(1, 2, (300, 3))])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    labels = spark.createDataFrame([(i, int(i >= 500)) for i in range(800)], "doc_id long, quality int")
    model = quality.fit(spark.createDataFrame(rows, "doc_id long, stats array<double>"), labels, shrink=0.0, ridge=0.0, d=3)
    own = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i in range(800)])
    y = np.arange(800) >= 500
    logs = []
    for c in (False, True):
        z = x[own & (y == c)]
        m, s = z.mean(0), np.cov(z.T, bias=True)
        d = x - m
        logs.append(-0.5 * ((d @ np.linalg.inv(s)) * d).sum(1) - 0.5 * np.linalg.slogdet(s)[1] + np.log(len(z)))
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(logs[0] - logs[1])))


def words_of(text):
    """Lower-case words, repeats in a row once."""
    out = []
    for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
        h = zlib.crc32(w.encode()) | 1
        if not out or out[-1] != h:
            out.append(h)
    return out


class BruteForce:
    """The whole class-conditional Kneser-Ney model in dictionaries."""

    def __init__(self, rows):
        self.gram = [Counter(), Counter()]
        for y, text in rows:
            words = words_of(text)
            self.gram[y].update(zip([0, *words], words))
        every = {*self.gram[0], *self.gram[1]}
        self.word = [Counter(), Counter()]
        for c in (0, 1):
            for (_, w), n in self.gram[c].items():
                self.word[c][w] += n
        self.kinds = Counter(w for _, w in every)
        vocabulary = {x for g in every for x in g}
        self.every = len(every) + 0.5 * len(vocabulary) + 0.5

    def p(self, c, w, v=None):
        d = lambda n: toxicity.DISCOUNTS[min(n, 3) - 1] if n else 0.0
        total = sum(self.word[c].values())
        p = (self.word[c][w] - d(self.word[c][w])) / total + sum(map(d, self.word[c].values())) / total * (self.kinds[w] + 0.5) / self.every
        after = {g: n for g, n in self.gram[c].items() if g[0] == v}
        if v is None or not after:
            return p
        n = sum(after.values())
        return (self.gram[c][v, w] - d(self.gram[c][v, w])) / n + sum(map(d, after.values())) / n * p


def toy():
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}" for i in range(26)]
    return [(int(i % 4 == 0), " ".join(rng.choice(words[:12] if i % 4 else words[6:]) for _ in range(rng.randint(0, 25)))) for i in range(60)] + [(0, None), (1, "")]


def test_log_ratios_equal_a_brute_force_kneser_ney(spark):
    """Over the whole tables, although n-grams seen once are left out of the scoring rows."""
    rows = toy()
    want, models = BruteForce(rows), toxicity.fit_models(spark.createDataFrame(rows, "label int, text string"))
    assert 0 < len(models.gram) < len({*want.gram[0], *want.gram[1]})
    texts = [t for _, t in rows[::3]] + ["wa unseen wb wz", "unseen", "wq wq wa", None, "wz wy never wa wb wc"]
    words, doc = toxicity.hashes(pa.array(texts, pa.string()))
    given, alone = models.ratios(words, doc)
    assert words.tolist() == [w for t in texts for w in words_of(t)]
    k = 0
    for t in texts:
        own = words_of(t)
        for v, w in zip([0, *own], own):
            assert given[k] == pytest.approx(math.log(want.p(1, w, v) / want.p(0, w, v)), abs=1e-9)
            assert alone[k] == pytest.approx(math.log(want.p(1, w) / want.p(0, w)), abs=1e-9)
            k += 1
    assert k == len(given)


def test_brute_force_kneser_ney_sums_to_one():
    model = BruteForce(toy())
    vocabulary = {w for c in (0, 1) for w in model.word[c]}
    for c in (0, 1):
        for v in [None, 0, *sorted(vocabulary)[:5]]:
            assert sum(model.p(c, w, v) for w in vocabulary) == pytest.approx(1, abs=0.05)  # the rest is for unseen words


def test_scores_dont_depend_on_the_size_of_the_tables(spark):
    """Broadcast tables and joined ones give the same scores, for every kind of row."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    odd = spark.createDataFrame([(10**6 + i, t) for i, (_, t) in enumerate(ROWS)], "doc_id long, text string")
    docs = docs.select("doc_id", "text").unionByName(odd)
    labels = labels.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("toxic"))  # both classes are frequent
    whole, joined = ({r.doc_id: r.score for r in toxicity.classify(docs, labels, known=k).collect()} for k in (1 << 22, 0))
    assert whole.keys() == joined.keys() and len({round(s, 6) for s in whole.values()}) > 50
    assert all(joined[i] == pytest.approx(s, abs=1e-9) for i, s in whole.items())


def test_tables_beyond_the_broadcast_bound_are_held_in_slices(spark, monkeypatch):
    """Each slice is small, workers keep none, no text moves, and the scores are those of the whole tables."""
    rng = random.Random(5)
    words = [a + b for a in "abcdefghijklmnopqrst" for b in "uvwxyz"]
    rows = [(i, " ".join(rng.choice(words[:70] if i % 3 else words[40:]) for _ in range(rng.randint(1, 40)))) for i in range(400)]
    odd = [(10**6 + i, t) for i, (_, t) in enumerate(ROWS)] + [(None, "au av aw"), (1, rows[1][1])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int")
    slices, made = [], toxicity.table_slices
    monkeypatch.setattr(toxicity, "table_slices", lambda *a: slices.append(made(*a)) or slices[-1])
    monkeypatch.setattr(toxicity, "BLOCK_WORDS", 2_000)  # several blocks a task
    whole = toxicity.classify(docs, labels)
    assert not slices
    got = toxicity.classify(docs, labels, known=400)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and plan.count("Exchange") == 1  # that of the test's repartition
    for own in slices:
        sizes = [len(pickle.loads(s.value)[0]) for s in own]
        assert len(sizes) > 1 and 0 < min(sizes) and max(sizes) < 150 and sum(sizes) > 50  # 50 a slice, dealt by a hash
    key = lambda r: (r.doc_id is None, r.doc_id, r.score)
    a, b = sorted(whole.collect(), key=key), sorted(got.collect(), key=key)
    assert [r.doc_id for r in a] == [r.doc_id for r in b] and len({round(r.score, 6) for r in a}) > 200
    assert np.allclose([r.score for r in a], [r.score for r in b], rtol=0, atol=1e-9)


def test_a_worker_drops_a_loaded_slice(spark):
    own = [spark.sparkContext.broadcast(pickle.dumps(np.arange(5) + k)) for k in (0, 1)]

    def run(batches):
        for b in batches:
            for shared in own:
                toxicity._loaded(shared)
            yield pa.record_batch([pa.array([sum("_value" in vars(s) for s in own)])], names=["kept"])
    assert [r.kept for r in spark.range(1).mapInArrow(run, "kept long").collect()] == [0]


def test_a_joined_block_is_grouped_as_columns(spark):
    """Neither a list of rows in the JVM nor a dictionary a row in Python holds a block's tables."""
    docs = spark.createDataFrame([(i, "a b c d e f"[:1 + i % 11]) for i in range(60)], "doc_id long, text string")
    got = toxicity.classify(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), known=0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "collect_list" not in plan
    assert got.count() == 60
