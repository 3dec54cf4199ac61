import json
import os

from pyspark.sql import functions as F

from corpuskit.operators.extract import extract_text
from corpuskit.sources.jsonl import read_jsonl_lines
from corpuskit.streaming import ingest_stream, monitor_stream

FA = "این یک متن آزمایشی برای جریان داده است که طول کافی دارد"


def _write(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n")


def test_stream_equals_batch_and_resumes(spark, tmp_dir):
    src = os.path.join(tmp_dir, "src")
    os.makedirs(src)
    out = os.path.join(tmp_dir, "out")
    ck = os.path.join(tmp_dir, "ck")
    _write(os.path.join(src, "a.jsonl"), [{"text": FA + " 1"}, "{bad", {"body": FA + " 2"}])
    from corpuskit.streaming import resume_point
    assert resume_point(spark, ck) is None
    q = ingest_stream(spark, src, out, ck)
    q.awaitTermination()
    first = spark.read.parquet(out).count()
    assert first == 2 and resume_point(spark, ck) == 0
    # Second run: only the new file is read; batch outputs are idempotent per batch id.
    _write(os.path.join(src, "b.jsonl"), [{"content": FA + " 3"}, {"x": 1}])
    q = ingest_stream(spark, src, out, ck)
    q.awaitTermination()
    streamed = sorted(r.text for r in spark.read.parquet(out).collect())
    batch = sorted(r.text for r in extract_text(read_jsonl_lines(spark, src)).collect())
    assert streamed == batch and len(streamed) == 3
    progress = [p for p in q.recentProgress if p.get("observedMetrics")]
    assert progress and progress[-1]["observedMetrics"]["ingest"]["accepted"] == 1


def test_monitor_drops_late_rows(spark, tmp_dir):
    src = os.path.join(tmp_dir, "samples")
    os.makedirs(src)
    rows1 = [{"ts": "2024-01-01 10:05:00", "cpu_usage": 0.9}, {"ts": "2024-01-01 10:40:00", "cpu_usage": 0.2},
             {"ts": "2024-01-01 13:00:00", "cpu_usage": 0.1}]
    rows2 = [{"ts": "2024-01-01 10:30:00", "cpu_usage": 0.95}, {"ts": "2024-01-01 15:00:00", "cpu_usage": 0.1}]
    _write(os.path.join(src, "1.json"), rows1)

    def run():
        s = spark.readStream.schema("ts timestamp, cpu_usage double").json(src) \
            .withColumn("ram_ratio", F.lit(0.1)).withColumn("gpu_usage", F.lit(0.0))
        m = monitor_stream(s, "ts", "1 hour", "10 minutes")
        out = os.path.join(tmp_dir, "mon_out")
        q = m.writeStream.format("parquet").option("path", out).outputMode("append") \
            .option("checkpointLocation", os.path.join(tmp_dir, "mck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return {r.window_start: (r.n_samples, r.n_breaches) for r in spark.read.parquet(out).collect()}

    run()
    _write(os.path.join(src, "2.json"), rows2)
    got = run()
    # The 10:00 window closed before the late 10:30 row arrived: it keeps 2 samples, 1 breach.
    assert got["2024-01-01 10:00:00"] == (2, 1)


def test_stream_with_bounded_shuffle(spark, tmp_dir):
    from corpuskit.streaming import shuffle_batches
    src = os.path.join(tmp_dir, "src2")
    os.makedirs(src)
    _write(os.path.join(src, "a.jsonl"), [{"text": f"{FA} {i}"} for i in range(23)])
    out = os.path.join(tmp_dir, "out2")
    q = ingest_stream(spark, src, out, os.path.join(tmp_dir, "ck2"),
                      batch_transform=shuffle_batches(buffer=10, batch_size=4))
    q.awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 23
    assert sorted(r.shuffled_idx for r in rows) == list(range(1, 24))
    assert {r.window_id for r in rows} == {0, 1, 2}


def test_monitor_stream_equals_batch_twin(spark, tmp_dir):
    from corpuskit.operators.telemetry import tumbling_breaches
    from corpuskit.queries.telemetry_q import samples
    d = "/root/testdata/sf0.001"
    batch = {r.window_start: tuple(r)[1:] for r in tumbling_breaches(samples(spark, d), "ts", "1 hour").collect()}
    import shutil
    src = os.path.join(tmp_dir, "events")
    os.makedirs(src)
    shutil.copy(f"{d}/events.parquet", src)  # the file source reads a directory
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    ev = spark.readStream.schema(schema).parquet(src)
    s = ev.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
                  (F.col("value") / 500).alias("cpu_usage"),
                  (F.get_json_object("props", "$.k").cast("double") / 100).alias("ram_ratio"),
                  F.lit(0.0).alias("gpu_usage"))
    q = monitor_stream(s, "ts", "1 hour", "1 day").writeStream.format("memory").queryName("mon_twin") \
        .outputMode("complete").option("checkpointLocation", os.path.join(tmp_dir, "twin")) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = {r.window_start: tuple(r)[1:] for r in spark.table("mon_twin").collect()}
    assert streamed == batch


def test_stream_training_examples_with_fixed_vocabulary(spark, tmp_dir):
    from corpuskit.operators.examples import fit_vocabulary
    from corpuskit.streaming import examples_batches
    src = os.path.join(tmp_dir, "src3")
    os.makedirs(src)
    _write(os.path.join(src, "a.jsonl"), [{"text": f"{FA} {i}"} for i in range(12)])
    vocab = fit_vocabulary(extract_text(read_jsonl_lines(spark, src)), "text", 40).checkpoint()
    out = os.path.join(tmp_dir, "out3")
    ck = os.path.join(tmp_dir, "ck3")
    t = examples_batches(vocab, max_seq_length=8, buffer=5, batch_size=2)
    ingest_stream(spark, src, out, ck, batch_transform=t).awaitTermination()
    _write(os.path.join(src, "b.jsonl"), [{"text": f"{FA} x{i}"} for i in range(3)])
    ingest_stream(spark, src, out, ck, batch_transform=t).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 15 and all(len(r.input_ids) == 8 for r in rows)
    assert {r.stream_batch for r in rows} == {0, 1}


def _windows(rows):
    return sorted((r.text, r.idx, r.window_id, r.shuffle_pos, r.shuffled_idx, r.pos_in_batch) for r in rows)


def test_windows_go_on_over_micro_batches_and_restarts(spark, tmp_dir, monkeypatch):
    from corpuskit.streaming import carried_rest, carried_shuffle, carry
    texts = [{"text": f"{FA} {i:03d}"} for i in range(47)]
    kinds = {"buffer": 10, "seed": 5, "batch_size": 4}

    def stream(name, files, failing=None):
        src, out, ck, kept = (os.path.join(tmp_dir, name, x) for x in ("src", "out", "ck", "carry"))
        os.makedirs(src)
        for k, rows in enumerate(files):  # one micro-batch each
            _write(os.path.join(src, f"{k:02d}.jsonl"), rows)
            go = carried_shuffle(kept, **kinds)
            if k == failing:  # stopped after the rest is written, before the micro-batch is committed

                def broken(batch, batch_id):
                    go(batch, batch_id)
                    raise RuntimeError("stopped")
                try:
                    ingest_stream(spark, src, out, ck, batch_transform=broken).awaitTermination()
                    raise AssertionError("the stream should have stopped")
                except Exception as e:  # noqa: BLE001
                    assert "stopped" in str(e)
            ingest_stream(spark, src, out, ck, batch_transform=go).awaitTermination()
        done = spark.read.parquet(out).collect()
        return done, carried_rest(spark, kept, ck, **kinds).collect(), kept

    full, rest, _ = stream("one", [texts])
    assert len(full) == 40 and len(rest) == 7
    whole = _windows(full + rest)
    assert [r[0] for r in sorted(whole, key=lambda r: r[1])] == [t["text"] for t in texts]
    assert sorted(r[4] for r in whole) == list(range(1, 48))
    cuts = [0, 3, 3, 14, 20, 21, 22, 45, 45, 46, 47]  # files without a row, of part of a window and of several
    parts = [texts[a:b] or [{"x": 1}] for a, b in zip(cuts, cuts[1:])]
    full, rest, kept = stream("ten", parts, failing=6)
    assert _windows(full + rest) == whole
    assert sorted(n for n in os.listdir(kept)) == ["after=8", "after=9"]
    assert carried_rest(spark, kept, os.path.join(tmp_dir, "nothing")) is None
