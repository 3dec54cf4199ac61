import random

import pytest

from corpuskit.llm import decontam

DOCS = "doc_id bigint, text string, item_id int, similarity double"
ITEMS = "item_id bigint, text string, doc_id string"
SYLLABLES = "ba co du fe gi la mo nu pe ri sa to vu we xi za".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def distance(a, text):
    """Least edit distance of ``a`` and a substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_substring_distance():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(*n))) for n in ((1, 12), (0, 30)))
        assert decontam.substring_distance(a, b) == distance(a, b)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    items = [(k, prose(rng, rng.randint(5, 50))) for k in range(30)]
    rows, want = [], {}
    for i in range(240):
        text, k = prose(rng, rng.randint(0, 120)), rng.randrange(30)
        words = items[k][1].split()
        kind = i % 6
        if kind == 1:
            leak = " ".join(words).upper().replace(" ", ",  ")
        elif kind == 2:  # a tenth of the words changed
            leak = " ".join(prose(rng, 1) if rng.random() < 0.1 else w for w in words)
        elif kind == 3:  # a few letters changed
            leak = "".join(rng.choice("abc") if c != " " and rng.random() < 0.05 else c for c in " ".join(words))
        elif kind == 4:  # words lost or added
            leak = " ".join(w if rng.random() > 0.08 else w + " " + prose(rng, 1) for w in words if rng.random() > 0.05)
        elif kind == 5:  # half an item isn't a leak
            leak = " ".join(words[:len(words) // 2])
        else:
            leak = ""
        rows.append((i, f"{text} {leak} {prose(rng, 30)}"))
    for i, t in rows:
        norm = " ".join(decontam.words_of(t))
        for k, x in items:
            own = " ".join(decontam.words_of(x))
            d = decontam.substring_distance(own, norm) if i % 6 else 99 if own not in norm else 0
            if d <= 0.2 * len(own):
                want[(i, k)] = d
    return items, rows, want


def test_recall_and_exact_verification(spark, cases):
    items, rows, want = cases
    docs = spark.createDataFrame([(i, t, 1, 0.5) for i, t in rows], DOCS)
    bench = spark.createDataFrame([(k, t, "d") for k, t in items], ITEMS)
    for size in (256 << 20, 1 << 18):
        got = {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(docs, bench, index_bytes=size).collect()}
        assert all(want.get(x) is not None and d >= want[x] for x, d in got.items())  # nothing clean is reported
        assert len(got) >= 0.97 * len(want) and all(got[x] == 0 for x, d in want.items() if d == 0)
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in got}


def test_edge_cases(spark):
    bench = spark.createDataFrame([(1, None, "d"), (2, "", "d"), (3, "too few", "d"), (None, "one two three four five six", "d"), (4, "one two three four five six", "d"),
                                   (4, "one two three four five six", "d")], ITEMS)
    docs = spark.createDataFrame([(1, None, 1, 0.5), (2, "", 1, 0.5), (None, "x ONE two, three four five six", 1, 0.5), (3, "one two three four five six", 1, 0.5),
                                  (3, "one two three four five six", 1, 0.5), (4, "two " * 50_000, 1, 0.5), (5, "one two three", 1, 0.5)], DOCS)
    got = decontam.leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(None, 4), (3, 4), (None, None), (3, None)}
    assert sorted(str(r.doc_id) for r in decontam.clean(docs, bench).collect()) == ["1", "2", "4", "5"]
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == 7


def noisy(rng, text, share):
    """Single letters replaced, lost or added all over the text."""
    out = []
    for c in text:
        kind = rng.randrange(3) if c != " " and rng.random() < share else 3
        out.append("" if kind == 0 else rng.choice("xyz") if kind == 1 else c + rng.choice("xyz") if kind == 2 else c)
    return "".join(out)


def test_short_items_lose_no_leak_up_to_the_budget():
    rng = random.Random(8)
    items = [(k, prose(rng, n)[:31].strip()) for k, n in enumerate([1, 2, 3, 4, 6, 10])]
    items += [(20, "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏"), (21, "ab cd"), (22, "é")]
    index = decontam.Index(items, 0.8)
    leaked = 0
    for r in range(90):
        k, item = items[r % len(items)]
        text = " ".join(decontam.words_of(f"{prose(rng, 20)} {noisy(rng, item, rng.uniform(0, 0.25))} {prose(rng, 10)}"))
        want = {i: d for i, x in items for d in [distance(x, text)] if d <= int(round(0.2 * len(x), 9))}
        assert {i: d for i, _, d in index.leaks(text)} == want
        leaked += k in want
    assert leaked > 60


@pytest.mark.parametrize("share,least", [(0.0, 1.0), (0.05, 0.99), (0.12, 0.98), (0.2, 0.9)])
def test_recall_at_letter_noise(share, least):
    """Against brute force: items of 40 to 400 characters among prose, letters replaced, lost and added."""
    rng = random.Random(int(share * 100) + 1)
    items = [(k, prose(rng, 90)[:rng.randint(40, 400)].strip()) for k in range(120)]
    index, found, leaked = decontam.Index(items, 0.8), 0, 0
    texts = [f"{prose(rng, 20)} {noisy(rng, t, share)} {prose(rng, 20)}" for _, t in items]
    for (k, item), text, got in zip(items, texts, index.leaks_of(texts)):
        norm = " ".join(decontam.words_of(text))
        far = decontam.substring_distance(item, norm)
        mine = {i: d for i, _, d in got}
        assert all(d <= 0.2 * len(items[i][1]) and d >= decontam.substring_distance(items[i][1], norm) for i, d in mine.items())
        if far <= int(round(0.2 * len(item), 9)):
            leaked += 1
            found += mine.get(k) == far
    assert leaked > 30 and found >= least * leaked, (found, leaked)


def test_long_items_and_texts_over_many_blocks(monkeypatch):
    rng = random.Random(3)
    long_item = prose(rng, 250)
    items = [(1, long_item), (2, prose(rng, 40)), (3, prose(rng, 4))]
    text = prose(rng, 1500) + " " + long_item + " " + prose(rng, 100) + " " + items[1][1] + " " + prose(rng, 900) + " " + items[2][1]
    index = decontam.Index(items, 0.8)
    want = index.leaks_of([None, text, "short", text[:9000]])
    assert [i for i, _, d in want[1] if d == 0] == [1, 2, 3] and want[0] == want[2] == []
    words = text.split()
    assert all(" ".join(words[w:]).startswith(items[i - 1][1]) for i, w, d in want[1])
    monkeypatch.setattr(decontam, "BLOCK", 8192)
    monkeypatch.setattr(decontam, "PROBES", 1000)
    assert decontam.Index.of(index.plain()).leaks_of([None, text, "short", text[:9000]]) == want


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "well one two three four five six then"), (None, "nothing")], "doc_id string, text string")
    for kind, value in (("int", 7), ("string", "x7"), ("smallint", 3), ("decimal(9,2)", None)):
        bench = spark.createDataFrame([(value, "one two three four five six")], f"item_id {kind}, text string")
        got = decontam.leaks(docs, bench)
        assert got.schema["item_id"].dataType == bench.schema["item_id"].dataType
        assert [(r.doc_id, r.item_id, r.start_word, r.distance) for r in got.collect()] == [("a", value, 1, 0)]


def test_one_letter_wrong_in_eleven_of_thirty_words():
    rng = random.Random(4)
    words = prose(rng, 30).split()
    for k in range(1, 22, 2):
        words[k] = "q" + words[k]
    item = " ".join(w.lstrip("q") for w in words)
    assert [(i, d) for i, _, d in decontam.Index([(7, item)], 0.8).leaks("Before it, " + " ".join(words))] == [(7, 11)]


def test_short_and_unspaced_items_are_found(spark):
    docs = spark.createDataFrame([(1, "said: Forty two!", 1, 0.5), (2, "他說天地玄黃宇宙洪荒日月盈昃等", 1, 0.5), (3, "nothing here", 1, 0.5)], DOCS)
    bench = spark.createDataFrame([(1, "forty two", "d"), (2, "天地玄黃宇宙洪荒日月盈昃", "d")], ITEMS)
    assert {(r.doc_id, r.item_id, r.start_word) for r in decontam.leaks(docs, bench).collect()} == {(1, 1, 1), (2, 2, 0)}
    assert [r.doc_id for r in decontam.clean(docs, bench).collect()] == [3]
