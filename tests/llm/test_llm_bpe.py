import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken

from corpuskit.llm import bpe

SCHEMA = "doc_id bigint, text string, block string, share int, words string"
ALPHABET = "ab Z9 \t\n\r\x0b\x1c\x1f\x85\xa0 ''sStTreVEmlLd.,!²½ªµ×÷éßĀɏɐΩжд٣ⅷ中の😀​　́<|endoftext|>"


def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(), special_tokens={})


def texts():
    rng = random.Random(2)
    return [None, "", " ", "a", "<|endoftext|>", "x" * 50_000, "word " * 40_000, "é" * 3000, "\n" * 500 + "end"] + \
        ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(300)]


def test_ids_equal_the_library_and_round_trip(spark, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 20_000)  # several blocks
    rows = [(i if i % 7 else None, t, "b", 1, "w") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows + rows[:5], SCHEMA)
    enc = library()
    want = sorted(((i, enc.encode_ordinary(t or "")) for i, t, *_ in rows + rows[:5]), key=str)
    got = bpe.encode(df)
    assert sorted(((r.doc_id, r.ids) for r in got.collect()), key=str) == want
    back = bpe.decode(got.where("doc_id IS NOT NULL"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t or "") for i, t, *_ in rows + rows[:5] if i is not None)


def test_digests(spark):
    df = spark.createDataFrame([(1, "Hello wörld"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df).collect()}
    ids = library().encode_ordinary("Hello wörld")
    assert got[1].n_tokens == len(ids) and got[1].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert got[1].decoded_sha256 == hashlib.sha256("Hello wörld".encode()).hexdigest()
    assert (got[2].n_tokens, got[2].ids_sha256) == (0, hashlib.sha256(b"").hexdigest())


def test_decode_of_unknown_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, [72, 10_000_000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(df).collect()} == {1: None, 2: None, 3: ""}
    assert bpe.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_any_key_type_and_no_table_left(spark):
    for kind, value in (("smallint", 3), ("string", "k"), ("date", None)):
        df = spark.createDataFrame([(value, "some words, more words")], f"name {kind}, text string")
        got = bpe.encode_and_decode(df, key="name")
        assert got.dtypes[0] == ("doc_id", kind)
        row = got.first()
        assert row.doc_id == value and row.n_tokens == len(row.ids) and row.decoded_sha256 == hashlib.sha256(b"some words, more words").hexdigest()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("bpe_blocks")]
