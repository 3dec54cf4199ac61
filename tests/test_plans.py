import json
import os

from pyspark.sql import functions as F

from corpuskit.operators.ordering import with_input_index
from corpuskit.plans import IngestConfig, batch_ingest, corpus_examples
from corpuskit.sinks import write_examples, write_manifest, write_ordered_text
from corpuskit.sources.jsonl import read_jsonl_lines

FA = "این جمله برای آزمون خط لوله نوشته شده و کلمات کافی دارد"


def _corpus(d, files=3, per=40):
    os.makedirs(d, exist_ok=True)
    expected = []
    for f in range(files):
        with open(os.path.join(d, f"part-{f}.jsonl"), "w", encoding="utf-8") as fh:
            for i in range(per):
                if i % 7 == 3:
                    fh.write("{broken\n")
                    continue
                t = f"{FA} {f}-{i}"
                fh.write(json.dumps({"id": f * 1000 + i, "text": t}, ensure_ascii=False) + "\n")
                expected.append(t)
    return expected


def test_input_index_follows_file_order(spark, tmp_dir):
    src = os.path.join(tmp_dir, "c")
    exp = _corpus(src)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")  # many splits per file
    try:
        from corpuskit.operators.extract import extract_text
        acc = extract_text(read_jsonl_lines(spark, src))
        got = [r.text for r in with_input_index(acc).orderBy("idx").collect()]
        idx = sorted(r.idx for r in with_input_index(acc).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == exp and idx == list(range(1, len(exp) + 1))


def test_corpus_examples_end_to_end(spark, tmp_dir):
    src = os.path.join(tmp_dir, "c")
    exp = _corpus(src)
    cfg = IngestConfig(buffer=16, batch_size=4, max_seq_length=8, vocab_size=50, max_samples=50)
    out = corpus_examples(read_jsonl_lines(spark, src), None, cfg)
    ex = out["examples"].collect()
    assert len(ex) == 50 and all(len(r.input_ids) == 8 for r in ex)
    assert sorted(r.shuffled_idx for r in ex) == list(range(1, 51))
    assert out["quarantine"].count() == 3 * 6
    write_examples(out["examples"].withColumn("split", F.lit("train")), os.path.join(tmp_dir, "ex"))
    assert spark.read.parquet(os.path.join(tmp_dir, "ex")).count() == 50


def test_batch_ingest_and_sinks(spark, tmp_dir):
    rows = [(i, f"{FA} {i}" if i % 5 else "") for i in range(1300)]
    t = spark.createDataFrame(rows, "key long, text string")
    b = batch_ingest(t, "key", max_seq_length=6, vocab_size=40)
    counts = {r.split: r["count"] for r in b.groupBy("split").count().collect()}
    assert counts == {"train": 1029, "eval": 11}
    write_manifest(spark, {"dataset": "x.jsonl", "max_seq_length": 6}, os.path.join(tmp_dir, "m"))
    m = json.loads(spark.read.text(os.path.join(tmp_dir, "m")).first().value)
    assert m["dataset"] == "x.jsonl" and "start_time" in m
    lines = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "n int, line string")
    write_ordered_text(lines, os.path.join(tmp_dir, "t"), "n", num_partitions=2)
    files = sorted(f for f in os.listdir(os.path.join(tmp_dir, "t")) if f.startswith("part-"))
    text = "".join(open(os.path.join(tmp_dir, "t", f)).read() for f in files)
    assert text == "a\nb\nc\n"


def test_corpus_examples_two_epochs(spark, tmp_dir):
    src = os.path.join(tmp_dir, "c")
    exp = _corpus(src)
    cfg = IngestConfig(buffer=16, batch_size=4, max_seq_length=8, vocab_size=50, epochs=2)
    ex = corpus_examples(read_jsonl_lines(spark, src), None, cfg)["examples"].collect()
    assert len(ex) == 2 * len(exp)
    by_epoch = {0: {}, 1: {}}
    for r in ex:
        by_epoch[r.epoch][r.idx] = r.shuffle_pos
    assert set(by_epoch[0]) == set(by_epoch[1]) and by_epoch[0] != by_epoch[1]


def test_report_body_written_in_order(spark, tmp_dir):
    from corpuskit.operators import evaluate as ev
    res = spark.createDataFrame([("b_cat", 1, 0, "p2", "r2 <b>"), ("a_cat", 0, 1, "p1", "r1"), ("a_cat", 0, 0, "p0", "r0")],
                                "category string, cat_pos int, pos int, prompt string, response string")
    out = os.path.join(tmp_dir, "report")
    write_ordered_text(ev.report_rows(res), out, ["cat_pos", "pos"], text_col="fragment", num_partitions=2)
    files = sorted(f for f in os.listdir(out) if f.startswith("part-"))
    text = "".join(open(os.path.join(out, f), encoding="utf-8").read() for f in files)
    heads = [ln for ln in text.split("\n") if ln.startswith("<h2>")]
    assert heads == ["<h2>📂 A Cat</h2>", "<h2>📂 B Cat</h2>"]
    assert text.index("p0") < text.index("p1") < text.index("p2") and "r2 &lt;b&gt;" in text
