import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from corpuskit.llm import packing

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
DOCS = "doc_id bigint, text string, source string, _ids int, start2 int"
ODD = ["", None, "  \n ", "don't I'll we'RE 's", "x" * 5000, "É É Å Å ﬁ İstanbul ΑΣ Σ ß", "日本語 ไทย العربية", "a b c　d\x85e\x0bf\x0c\x1cg",
       "<|endoftext|> <|startoftext|>end", "½ 12345 ٣٤ 3.14 a1b2", "́ ́a e ́", "a‍b 👩‍👩‍👧 🏳️‍🌈", "''' 's's \"x\"…", "\x00 \x01 ﻿ �"]


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def corpus(n=150, seed=1):
    rng = random.Random(seed)
    topics = [[f"{c}{i}" for i in range(40)] for c in ("ba", "ko", "lu", "ze")]
    docs = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(rng.randrange(1, 120)))) for i in range(n)]
    docs += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "a b c"), (None, None), (3, "a b c"), (3, "a b c")]
    docs += [(2000, " ".join(rng.choice(topics[0]) for _ in range(3000)))]
    return docs


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], DOCS)
    return packing.pack(df, PATH, end_id=2, **kw).collect()


def check(docs, rows, window):
    """Every id in exactly one piece, sequences gapless and without padding."""
    ids = library()
    want = sorted(([*ids(t), 2] for _, t in docs), key=str)
    got, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own = np.frombuffer(r.ids, "<u4").tolist()
        assert len(own) == r.length > 0
        got[r.doc_id].append((r.start, own, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    texts = defaultdict(list)
    for i, t in docs:
        texts[i].append([*ids(t), 2])
    for i, own in texts.items():
        if len(own) == 1:
            at = 0
            for start, part, n in sorted(got[i]):
                assert start == at and part == own[0][at:at + len(part)] and n == len(own[0])
                at += len(part)
            assert at == len(own[0])
    assert sum(r.length for r in rows) == sum(map(len, want))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window and at & (at - 1) == 0
    return sequences


@pytest.mark.parametrize("window,shard", [(4096, 1 << 20), (64, 1 << 20), (64, 300), (1, 100)])
def test_pieces_hold_every_id_once(spark, window, shard):
    docs = corpus()
    check(docs, run(spark, docs, window=window, shard_tokens=shard), window)


def test_word_by_word_is_the_library():
    ids = library()
    words = packing.Words(PATH, np.uint16)
    texts = ODD + [t for _, t in corpus()] + [" ".join(t or "" for t in ODD)]
    for _ in range(2):
        flat, lens = words.encode(pa.array([t or "" for t in texts]))
        assert flat.tolist() == [i for t in texts for i in ids(t)] and lens.tolist() == [len(ids(t)) for t in texts]


def test_forgetting_words_changes_nothing(monkeypatch):
    texts = pa.array([t or "" for _, t in corpus()])
    whole = packing.Words(PATH, np.uint16).encode(texts)
    monkeypatch.setattr(packing, "KNOWN_WORDS", 3)
    words = packing.Words(PATH, np.uint16)
    parts = [words.encode(texts[i:i + 5]) for i in range(0, len(texts), 5)]
    assert np.concatenate([p[0] for p in parts]).tolist() == whole[0].tolist()


def test_scores_are_bm25():
    rng = np.random.default_rng(2)
    units = [rng.integers(0, 30, rng.integers(1, 60)) for _ in range(25)]
    df = np.bincount(np.concatenate([np.unique(u) for u in units]), minlength=30) + 3
    n, mean = 40, 33.0
    shard = packing.Shard(units, n, mean, df)
    for seed in (0, 7, 24):
        want = []
        for u in units:
            s = 0.0
            for t in {*units[seed].tolist()}:
                tf = int((u == t).sum())
                s += np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(u) / mean))
            want.append(s)
        assert np.allclose(shard.scores(seed), want)


def test_neighbours_are_taken_by_score_and_the_last_is_cut(spark):
    units = [np.array([1, 2, 3]), np.array([9, 8]), np.array([1, 2, 9]), np.array([1, 2, 3, 7, 7, 7, 7])]
    df = np.bincount(np.concatenate([np.unique(u) for u in units]), minlength=10)
    first, second = packing.Shard(units, 4, 4.0, df).sequences(8)
    assert [x[:3] for x in first] == [(0, 0, 3), (2, 0, 3), (1, 0, 2)] and [x[:3] for x in second] == [(3, 0, 7)]
    first, second = packing.Shard([units[0], *units[2:]], 4, 4.0, df).sequences(8)
    assert [x[:3] for x in first] == [(0, 0, 3), (1, 0, 3), (2, 0, 2)] and [x[:3] for x in second] == [(2, 2, 5)]
    # One topic per window as long as its documents last.
    docs = [(i, " ".join(f"{'abcd'[i % 4]}x{j % 9}" for j in range(30))) for i in range(64)]
    by = defaultdict(set)
    for r in run(spark, docs, window=256):
        if r.length == r.doc_tokens:
            by[r.sequence_id].add(r.doc_id % 4)
    assert sum(len(x) == 1 for x in by.values()) >= 0.7 * len(by)


def test_statistics_count_all_documents(spark):
    df = spark.createDataFrame([(np.array(x, "<u2").tobytes(), len(x)) for x in ([5, 5, 2], [2], [7, 5, 2])] * 3, "_ids binary, _n bigint")
    n, mean, freq = packing.statistics(df.repartition(4), np.dtype("<u2"))
    assert (n, mean, freq.tolist()) == (9, pytest.approx(21 / 9), [0, 0, 9, 0, 0, 6, 0, 3])


def test_copies_in_thousands_and_empty_table(spark):
    docs = [(i, "same words here") for i in range(3000)]
    sequences = check(docs, run(spark, docs), 4096)
    assert sum(sum(n for _, n in s) for s in sequences.values()) == 3000 * (len(library()("same words here")) + 1)
    assert run(spark, []) == []


def test_key_columns_keep_type_and_clashes_raise(spark):
    df = spark.createDataFrame([("k", 1, "a b")], "name string, item smallint, text string")
    got = packing.pack(df, PATH, 2, keep=["name", "item"])
    assert got.dtypes[:2] == [("name", "string"), ("item", "smallint")] and got.first()[:3] == ("k", 1, 0)
    with pytest.raises(ValueError):
        packing.pack(df.withColumnRenamed("item", "Offset"), PATH, 2, keep=["Offset"])
