import hashlib
import math
import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuskit.operators import ordering as od


def _keys(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key long")


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_row_index_is_sorted_position(spark, width):
    keys = [17, 3, 99, 4, 250, 1000, 5, 6, 7, 8, 42, 43, 10_001]
    df = od.with_row_index(_keys(spark, keys), "key", "idx", bucket_width=width)
    got = {r.key: r.idx for r in df.collect()}
    assert got == {k: i + 1 for i, k in enumerate(sorted(keys))}


def test_row_index_composite_and_range_variant(spark):
    rows = [("f2", 0, 1), ("f1", 10, 0), ("f1", 0, 2), ("f1", 0, 0), ("f2", 0, 0)]
    df = spark.createDataFrame(rows, "f string, b long, l long")
    exp = {r: i + 1 for i, r in enumerate(sorted(rows))}
    a = {(r.f, r.b, r.l): r.idx for r in od.with_row_index(df, ["f", "b", "l"]).collect()}
    b = {(r.f, r.b, r.l): r.idx for r in od.with_row_index_range(df, ["f", "b", "l"], num_partitions=3).collect()}
    assert a == exp and b == exp


def _permuted(x, size, key):
    """The keyed permutation of 0 .. size-1 on plain numbers."""
    a = math.ceil(math.sqrt(size))
    b = -(-size // a)
    while True:
        high, low = divmod(x, b)
        for r in range(6):
            t = ((low if r % 2 == 0 else high) + key + (r + 1) * 40503) % 2147483647
            f = (t * t % 2147483647 * 48271 + r) % 2147483647
            high, low = ((high + f) % a, low) if r % 2 == 0 else (high, (low + f) % b)
        x = high * b + low
        if x < size:
            return x


def _shuffle(keys, buffer, seed=42):
    out = {}
    for i, k in enumerate(keys):
        w = i // buffer
        size = min(buffer, len(keys) - w * buffer)
        out[k] = (w, 1 + _permuted(i - w * buffer, size, (seed * 1000003 + w * 7368787) % 2147483647))
    return out


@pytest.mark.parametrize("buffer", [1, 2, 3, 4, 5, 7, 10, 16, 17, 37, 5000])
def test_shuffle_is_a_bijection_of_every_buffer_and_can_be_undone(spark, buffer):
    """Whole buffers and the last, partial one; other seeds and windows give other orders."""
    n = 2 * buffer + buffer // 3
    df = spark.range(1, n + 1).withColumnRenamed("id", "idx")
    s = od.windowed_shuffle(df, "idx", buffer=buffer, seed=7, epoch=3)
    rows = s.select("idx", "window_id", "shuffled_idx", od.source_index("shuffled_idx", buffer, n, 7, 3).alias("back")).collect()
    assert sorted(r.shuffled_idx for r in rows) == list(range(1, n + 1))
    assert all(r.back == r.idx and (r.shuffled_idx - 1) // buffer == r.window_id == (r.idx - 1) // buffer for r in rows)
    if buffer > 30:
        moved = sum(r.shuffled_idx != r.idx for r in rows)
        assert moved > 0.9 * n
        again = {r.idx: r.shuffled_idx for r in od.windowed_shuffle(df, "idx", buffer=buffer, seed=8, epoch=3).collect()}
        assert sum(again[r.idx] == r.shuffled_idx for r in rows) < 0.1 * n + 5
        first, second = ([r.shuffled_idx % buffer for r in sorted(rows, key=lambda r: r.idx) if r.window_id == w] for w in (0, 1))
        assert sum(a == b for a, b in zip(first, second)) < 0.1 * buffer + 5
        # No run of the input survives: neighbours stay neighbours about as often as by chance.
        assert sum(abs(a - b) == 1 for a, b in zip(first, first[1:])) < 0.05 * buffer + 5


def test_shuffled_places_of_a_row_are_near_uniform(spark):
    """One row over 4,000 windows lands in each of 20 places about equally often."""
    s = od.windowed_shuffle(spark.range(1, 80_001).withColumnRenamed("id", "idx"), "idx", buffer=20)
    got = {r.shuffle_pos: r["count"] for r in s.where("idx % 20 = 7").groupBy("shuffle_pos").count().collect()}
    assert len(got) == 20 and max(abs(n - 200) for n in got.values()) < 75


@pytest.mark.parametrize("n", [0, 3, 5, 10, 11])
def test_windowed_shuffle_sizes(spark, n):
    buffer = 5
    keys = list(range(100, 100 + n))
    df = od.with_row_index(_keys(spark, keys), "key", "idx")
    s = od.windowed_shuffle(df, "idx", "key", buffer, 42)
    got = {r.key: (r.window_id, r.shuffle_pos) for r in s.collect()}
    assert got == _shuffle(keys, buffer)
    # bijection per window
    sh = sorted(r.shuffled_idx for r in s.collect())
    assert sh == list(range(1, n + 1))


def test_epochs_differ_and_micro_batches(spark):
    keys = list(range(40))
    df = od.with_row_index(_keys(spark, keys), "key", "idx")
    e = od.epoch_plan(df, "idx", "key", 2, 20).collect()
    by_epoch = {0: {}, 1: {}}
    for r in e:
        by_epoch[r.epoch][r.key] = r.shuffle_pos
    assert by_epoch[0] == {k: v[1] for k, v in _shuffle(keys, 20, 42).items()}
    assert by_epoch[1] == {k: v[1] for k, v in _shuffle(keys, 20, 43).items()}
    mb = od.micro_batches(od.windowed_shuffle(df, "idx", "key", 20), 8).collect()
    for r in mb:
        assert r.batch_id == (r.shuffle_pos - 1) // 8 and 1 <= r.pos_in_batch <= 8


@pytest.mark.parametrize("n,exp", [(1000, 0), (1001, 11), (15000, 150), (600_000, 5000)])
def test_eval_size(n, exp):
    assert od.eval_size(n) == exp


def test_train_eval_split_disjoint_complete(spark):
    df = spark.range(1001).withColumnRenamed("id", "key")
    s = od.train_eval_split(df, "key", 42)
    rows = s.collect()
    assert len(rows) == 1001
    ev = sorted(r.key for r in rows if r.split == "eval")
    exp = sorted(range(1001), key=lambda k: (hashlib.md5(f"42:{k}".encode()).hexdigest(), k))[:11]
    assert ev == sorted(exp)
    none = od.train_eval_split(spark.range(1000).withColumnRenamed("id", "key"), "key")
    assert {r.split for r in none.collect()} == {"train"}


def test_take_first_and_round_to_buffer(spark):
    df = _keys(spark, list(range(50, 0, -1)))
    assert sorted(r.key for r in od.take_first(df, 7, "key").collect()) == list(range(1, 8))
    assert od.take_first(df, 7, "key", buffer=5, round_to_buffer=True).count() == 10
    odd = spark.createDataFrame([("b",), (None,), ("a",), ("a",), ("a",)], "key string")
    assert [sorted(str(r.key) for r in od.take_first(odd, n, "key").collect()) for n in (1, 2, 3, 5, 9)] == [
        ["None"], ["None", "a"], ["None", "a", "a"], ["None", "a", "a", "a", "b"], ["None", "a", "a", "a", "b"]]


def _numbered_files(spark, folder, files=10, lines=40):
    for f in range(files):
        with open(os.path.join(folder, f"part {f:02d}.jsonl"), "w") as out:
            for i in range(lines):
                k = f * lines + i
                out.write('{"text": "' + ("word " * 30 + str(k)) + '"}\n' if k % 4 else "broken {\n")
    from corpuskit.sources import read_jsonl_lines
    return read_jsonl_lines(spark, folder)


def test_prefix_scan_leaves_later_files_unread(spark, tmp_dir):
    from corpuskit.operators import extract as ex
    from corpuskit.operators.prefix import first_rows
    from corpuskit.plans import IngestConfig, corpus_examples
    lines = _numbered_files(spark, tmp_dir)
    accept = lambda rows: ex.extract_text(rows, letters="x")
    every = [k for k in range(400) if k % 4]
    for f in range(3, 10):  # the scan knows them, reading one would fail
        os.remove(os.path.join(tmp_dir, f"part {f:02d}.jsonl"))
    for n in (0, 1, 29, 30, 31, 60):
        got = first_rows(lines, n, accept)
        assert sorted((r.idx, int(r.text.split()[-1])) for r in got.collect()) == [(i + 1, k) for i, k in enumerate(every[:n])]
        assert ex.count_valid(lines, max_samples=n or None, letters="x").first().n_valid == n if n else True
    assert sorted(int(r.text.split()[-1]) for r in od.take_first(lines, 45, accept=accept).collect()) == every[:45]
    cfg = IngestConfig(letters="x", max_samples=50, buffer=20, max_seq_length=8, vocab_size=50)
    ex_ = corpus_examples(lines, None, cfg)
    assert sorted(r.idx for r in ex_["examples"].collect()) == list(range(1, 51))
    assert sorted((r.idx, int(r.text.split()[-1])) for r in ex_["accepted"].collect()) == [(i + 1, k) for i, k in enumerate(every[:50])]
    with pytest.raises(Exception, match="FAILED_READ_FILE|does not exist|FileNotFound"):
        first_rows(lines, 200, accept).collect()


def test_prefix_scan_equals_the_whole_scan(spark, tmp_dir):
    from corpuskit.operators import extract as ex
    from corpuskit.operators.prefix import first_rows
    lines = _numbered_files(spark, tmp_dir, files=7, lines=23)
    accept = lambda rows: ex.extract_text(rows, letters="x")
    whole = sorted((r.idx, r.text) for r in od.with_input_index(accept(lines)).collect())
    for n in (5, 50, len(whole), 10_000):
        assert sorted((r.idx, r.text) for r in first_rows(lines, n, accept).collect()) == whole[:n]
        assert ex.count_valid(lines, max_samples=n, letters="x").first().n_valid == min(n, len(whole))
    assert ex.count_valid(lines.select("line"), max_samples=9, letters="x").first().n_valid == 9
    none = lambda rows: rows.where("false")
    assert first_rows(lines, 5, none).count() == 0


def test_range_index_is_the_position_with_payload_and_many_rows(spark):
    n = 400_000
    df = spark.range(n).select((F.xxhash64("id") % 1000).alias("a"), F.col("id").alias("b"), F.sha2(F.col("id").cast("string"), 256).alias("payload"), F.rand(3).alias("more"))
    got = od.with_row_index_range(df, ["a", "b"], "idx", num_partitions=13)
    want = got.withColumn("pos", F.row_number().over(Window.orderBy("a", "b")))
    r = want.agg(F.count("*").alias("n"), F.count_if(F.col("idx") != F.col("pos")).alias("wrong")).first()
    assert (r.n, r.wrong) == (n, 0)


def test_null_and_duplicate_keys(spark):
    df = _keys(spark, [5, None, 3])
    assert {r.key: r.idx for r in od.with_row_index(df, "key").collect()} == {None: 1, 3: 2, 5: 3}
    twice = spark.range(3000).select((F.col("id") % 1500).alias("key"))
    split = od.train_eval_split(twice, "key").collect()
    assert len(split) == 3000 and len({(r.key, r.split) for r in split}) == 1500
    assert sum(r.split == "eval" for r in split) == 2 * od.eval_size(1500)


def test_input_index_refuses_shuffled_rows_and_survives_other_splits(spark, tmp_dir):
    from corpuskit.plans import IngestConfig, corpus_examples
    from corpuskit.sources import read_jsonl_lines
    spark.range(1000).select(F.format_string("line %04d of a file with words", "id").alias("value")).coalesce(1).write.text(tmp_dir + "/in")
    lines = read_jsonl_lines(spark, tmp_dir + "/in")
    with pytest.raises(ValueError):
        corpus_examples(lines.repartition(5), None, IngestConfig(letters="l"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        numbered = od.with_input_index(lines, "idx")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # a second scan would cut other splits
        got = sorted((r.idx, int(r.line[5:9])) for r in numbered.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i + 1, i) for i in range(1000)]


def test_assign_steps_and_plan(spark):
    df = od.with_row_index(_keys(spark, list(range(37))), "key", "idx")
    s = od.assign_steps(df, "idx", 2, 4).collect()
    assert len(s) == 32 and max(r.step for r in s) == 3
    c = spark.createDataFrame([(200_000,)], "n_valid long")
    p = od.plan_steps(c, max_samples=200_000, per_device=1, accumulation=32).first()
    assert p.max_steps == 6250 and p.effective_batch == 32
    p2 = od.plan_steps(c, per_device=1, accumulation=16).first()
    assert p2.warmup_steps == 500 and p2.max_steps == 12500


def test_progress_marks(spark):
    df = od.with_row_index(_keys(spark, list(range(250))), "key", "idx")
    assert sorted(r.idx for r in od.progress_marks(df, "idx", 100).collect()) == [100, 200]


def test_head_per_group_uses_group_limit(spark):
    rows = [("a", i) for i in range(50)] + [("b", 3), ("b", 1)]
    df = spark.createDataFrame(rows, "category string, pos int")
    h = od.head_per_group(df, "category", "pos", 2)
    assert sorted((r.category, r.pos) for r in h.collect()) == [("a", 0), ("a", 1), ("b", 1), ("b", 3)]
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_smallest_hashes_widens_until_exact(spark):
    df = spark.range(500).withColumnRenamed("id", "key")
    got = sorted(r._ek for r in od.smallest_hashes(df, "key", 7, 50, n=10 ** 9).collect())
    exp = sorted(sorted(range(500), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))[:50])
    assert got == exp
