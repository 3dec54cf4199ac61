import random

import pytest
import xxhash

from corpuskit.llm import simhash

SCHEMA = "doc_id bigint, text string, fp string, _mark int, _at int, component_id int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "f", 1, 2, 3) for i, t in rows], SCHEMA)


def fingerprint(text, k=3):
    words, w = [], b""
    for c in (text or "").encode():
        if c == 32 or 9 <= c <= 13:
            words, w = words + [w] * bool(w), b""
        else:
            w += bytes([c + 32 if 65 <= c <= 90 else c])
    words += [w] * bool(w)
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)] * bool(words)
    hs = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    """Component of each distinct word by brute force."""
    words, parent = sorted(set(fps)), {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x
    for i, a in enumerate(words):
        for b in words[i + 1:]:
            if bin(a ^ b).count("1") <= 2:
                parent[find(b)] = find(a)
    return {w: find(w) for w in words}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("hot", [64, 1])
def test_links_join_exactly_the_brute_force_components(spark, hot):
    rng = random.Random(11)
    words = [rng.getrandbits(64) for _ in range(60)]
    for w in list(words[:25]):  # chains and stars of words one to three bits apart
        for _ in range(6):
            w ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            words.append(w)
    words += [words[30] ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)][:400]  # a crowd around one word
    words += [0, 1, 1 << 63, 3, 7]
    words = sorted(set(words))
    edges = simhash.links(spark.createDataFrame([(signed(w),) for w in words], "fp bigint"), hot)
    assert all(bin((r.a ^ r.b) & (2**64 - 1)).count("1") <= 2 for r in edges.collect())
    got = {r.vertex: r.component for r in simhash.components(edges).collect()}
    mine = groups(words)
    by_got, by_mine = {}, {}
    for w in words:
        by_got.setdefault(got.get(signed(w), signed(w)), set()).add(w)
        by_mine.setdefault(mine[w], set()).add(w)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_mine.values()))


ROWS = [(5, None), (4, ""), (9, " \n\t"), (1, "One"), (2, "one\x0b"), (3, "Two words"), (None, "one"), (7, "a b c"), (7, "a b c"), (8, "É b c\xa0d e"),
        (12, "w " * 30_000 + "end"), (11, "w " * 30_000 + "end")]


def test_groups_and_edge_cases(spark):
    got = simhash.near_groups(docs(spark, ROWS)).collect()
    comp = groups([fingerprint(t) for _, t in ROWS])
    least = {}
    for i, t in ROWS:
        if i is not None:
            c = comp[fingerprint(t)]
            least[c] = min(least.get(c, i), i)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got), key=str) == \
        sorted(((i, fingerprint(t), least[comp[fingerprint(t)]]) for i, t in ROWS), key=str)


def test_one_row_of_each_group_stays(spark):
    df = docs(spark, ROWS + [(7, "other text under an id in use")])
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id, r.text[:6] if r.text else r.text) for r in kept.collect()) == [
        (1, "One"), (3, "Two wo"), (4, ""), (7, "a b c"), (7, "other "), (8, "É b c\xa0"), (11, "w w w ")]


def test_empty_table(spark):
    assert simhash.near_groups(docs(spark, [])).count() == 0
    assert simhash.keep_first(docs(spark, [])).count() == 0
