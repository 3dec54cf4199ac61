import hashlib
import math
import re
from zlib import crc32

import pytest

from corpuskit.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id bigint, text string, bucket int, n string, N_WORDS2 string, t string"


def grams(text, n, buckets):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=25, least=20, n=2, buckets=10_000, seed=7):
    fs, ft = ([grams(t, n, buckets) for t in x] for x in ([t for _, t in docs], target))
    s, t = ([0] * buckets for _ in range(2))
    for own, f in ((s, fs), (t, ft)):
        for _, bs in f:
            for b in bs:
                own[b] += 1
    ss, tt = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (words, bs) in zip(docs, fs):
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def run(spark, docs, target, **kw):
    d = spark.createDataFrame([(i, t, 1, "x", "y", "z") for i, t in docs], DOCS)
    b = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resampling.resample(d, b, **kw).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, got.collect()), key=str)


def corpus():
    docs = [(i, " ".join(f"w{(i * j * j + j) % 97}" + ".," [j % 2] for j in range(15 + i % 30))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(60)]  # copies
    docs += [(500, None), (501, ""), (502, " .,;"), (503, "Word"), (504, "\x00A\x7fB\x80c É É é ÉÉ İ ß 9a_Z\n日本 語"), (505, "a " * 30_000),
             (None, docs[3][1]), (None, docs[3][1]), (8, docs[8][1]), (8, docs[9][1])]
    return docs, [" ".join(f"w{(j * 3) % 20}" for j in range(40)), None, "", "W1 w2-W3 É"]


def test_matches_brute_force(spark):
    docs, target = corpus()
    want = brute(docs, target)
    assert sum(r[4] is not None for r in want) > 60
    assert run(spark, docs, target) == want


@pytest.mark.parametrize("kw", [dict(percent=50, least_words=1, n=3, buckets=50, seed=1), dict(percent=100, least_words=0, n=1), dict(percent=0)])
def test_other_parameters(spark, kw):
    docs, target = corpus()
    names = {"least_words": "least"}
    assert run(spark, docs, target, **kw) == brute(docs, target, **{names.get(k, k): v for k, v in kw.items()})


def test_small_batches_give_the_same(spark, monkeypatch):
    docs, target = corpus()
    whole = resampling.text_slices
    monkeypatch.setattr(resampling, "text_slices", lambda b: whole(b, rows=3, size=100))
    assert run(spark, docs, target) == brute(docs, target)


def test_empty_tables(spark):
    assert run(spark, [], ["a"]) == []
    docs = corpus()[0][:50]
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [(1, None)], [None]) == brute([(1, None)], [])


def test_keeps_named_columns(spark):
    docs, target = corpus()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(d, b, keep=["text", "doc_id"])
    assert got.columns == ["text", "doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(docs, key=str)
    with pytest.raises(ValueError):
        resampling.resample(d.withColumn("Score", d.doc_id), b, keep=["doc_id", "Score"])


def test_draws_what_resembles_the_target(spark):
    docs = [(i, " ".join(f"{'near' if i % 4 == 0 else 'far'}{(i + j) % 23}" for j in range(200))) for i in range(400)]
    got = run(spark, docs, [" ".join(f"near{j % 23}" for j in range(500))])
    drawn = [r[0] for r in got if r[4] is not None]
    assert len(drawn) == 100 and sum(i % 4 == 0 for i in drawn) > 90
