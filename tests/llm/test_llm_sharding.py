import random
import zlib

from corpuskit.llm import sharding

SCHEMA = "doc_id bigint, text string, lang string, source string, size int, shard string, k0 int, node int, _bucket int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 1, "x", 2, 3, 4) for i, t, l, s in rows], SCHEMA)


def check(rows, got, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in rows), key=str)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    return {s: sum(r["size"] for r in v) for s, v in by.items()}


def test_sizes_are_near_equal_with_a_hot_source_and_copies(spark):
    rng = random.Random(8)
    rows = [(i, "t" * rng.randint(0, 900) + str(i), rng.choice(["en", "de", None]), "hot" if rng.random() < 0.4 else f"s{rng.randrange(30)}") for i in range(4000)]
    rows += [(5000 + i, "copy " * 80, "en", f"s{i % 7}") for i in range(2000)]  # heavier than several shards
    rows += [(9000 + i, f"pair {i // 2} " * 30, "fr", f"s{i}") for i in range(400)]
    got = sharding.shard(docs(spark, rows)).collect()
    sizes = check(rows, got, 40)
    assert len(sizes) == 40 and max(sizes.values()) < 1.03 * min(sizes.values())
    pairs = {}
    for r in got:
        if r.doc_id >= 9000:
            pairs.setdefault((r.doc_id - 9000) // 2, set()).add(r.shard)
    assert all(len(s) == 1 for s in pairs.values())


def test_edge_cases(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", "en", "a"), (3, "x" * 200_000, "en", "a"), (4, "é", "en", "b"), (4, "é", "en", "b")]
    check(rows, sharding.shard(docs(spark, rows), 4).collect(), 4)
    check(rows, sharding.shard(docs(spark, rows), 1).collect(), 1)
    assert sharding.shard(docs(spark, []), 40).count() == 0


def test_main_path_has_no_python(spark):
    plan = sharding.shard(docs(spark, [(i, "t" * i, "en", "s") for i in range(30)]), 4)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
