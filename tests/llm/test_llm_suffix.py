import hashlib
import random

import pytest
import xxhash

from corpuskit.llm import suffix_dedup as sd

SCHEMA = "doc_id bigint, text string, doc string, mark int, place string, h int"


def brute(rows):
    """Per row of (doc_id, text): (bytes, removed, runs, kept)."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 99):
            at = (-1 << 70 if i is None else i, s)
            w = b[s:s + 100]
            first[w] = min(first.get(w, at), at)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            if first[b[s:s + 100]] < (-1 << 70 if i is None else i, s):
                gone[s:s + 100] = b"\1" * 100
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), sum(1 for j in range(len(gone)) if gone[j] and not (j and gone[j - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame([(i, t, "d", 1, "p", 2) for i, t in rows], SCHEMA)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in sd.deduplicate(df).collect()), key=str)


def prose(rng, n):
    return "".join(rng.choice("abcdefgh é\n") for _ in range(n))


def test_suffix_array_by_linear_grouping():
    rng = random.Random(1)
    for _ in range(3000):
        s = bytes(rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randint(0, 30)))
        assert sd.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    s = b"mississippi" * 40 + b"\0\0" + b"ab" * 300
    assert sd.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("crowd", [256, 1])
def test_removal_matches_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(sd, "CROWD", crowd)
    rng = random.Random(7)
    passage, other = prose(rng, 180), prose(rng, 130)
    rows = [(k, prose(rng, rng.randint(0, 300)) + rng.choice([passage, passage[20:150], other, ""]) + prose(rng, rng.randint(0, 300))) for k in range(40)]
    rows += [(100 + k, rows[k][1][:250] + "!" + rows[k][1][250:]) for k in range(20)]  # near copies
    rows += [(200 + k, rows[3][1]) for k in range(30)]  # a group of copies
    rows += [(300, "ab" * 400), (301, "a" * 500), (302, "xyz " * 100), (303, None), (304, ""), (305, passage[:99]), (306, passage[:100]),
             (-5, passage), (None, other), (307, "é" * 120), (308, "x" + "é" * 90)]
    assert result(spark, rows) == brute(rows)


def test_rows_of_one_id_are_one_document(spark):
    rng = random.Random(3)
    t, u = prose(rng, 300), prose(rng, 150)
    rows = [(1, t), (1, t), (1, u + t), (2, t)]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("own", [1, None])
def test_texts_of_one_id_whose_hashes_share_18_bits(spark, own):
    rng = random.Random(11)
    passage, with_it, without = prose(rng, 150), {}, {}
    mark = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) >> 46
    while not with_it.keys() & without.keys():  # two texts whose hashes agree in their upper 18 bits
        t, u = prose(rng, 200) + passage, prose(rng, 400)
        with_it[mark(t)], without[mark(u)] = t, u
    h = (with_it.keys() & without.keys()).pop()
    rows = [(-1 if own else None, passage), (own, with_it[h]), (own, without[h])]
    want = brute(rows)
    assert any(w[2] for w in want) and result(spark, rows) == want


def test_unknown_anchors_path(spark, monkeypatch):
    monkeypatch.setattr(sd, "KNOWN", -1)  # without the broadcast
    rng = random.Random(5)
    t = prose(rng, 400)
    rows = [(1, t), (2, prose(rng, 200) + t[50:350]), (3, prose(rng, 500))]
    assert result(spark, rows) == brute(rows)


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 1000)
    rng = random.Random(9)
    t = prose(rng, 5000)
    rows = [(1, t), (2, prose(rng, 700) + t[900:3300] + prose(rng, 300)), (3, t[:2500])]
    assert result(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert sd.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0
