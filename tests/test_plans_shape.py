"""Plan-shape guards for the scale-critical operators."""

import re

from pyspark.sql import functions as F

from corpuskit.operators import examples as exm
from corpuskit.operators import ordering as od
from corpuskit.operators.extract import extract_text
from corpuskit.sources.jsonl import read_jsonl_lines


def _plan(df):
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(plan):
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))


def test_encode_looks_up_small_vocabularies_in_place(spark):
    docs = spark.createDataFrame([(i, "a b c d " * (i % 5)) for i in range(200)], "key long, text string")
    vocab = spark.createDataFrame([("a", 2), ("b", 3)], "term string, id int")
    plan = _plan(exm.encode(docs, vocab, "key", "text"))
    assert _shuffles(plan) == 0 and "Join" not in plan, plan


def test_input_index_does_not_shuffle_rows(spark, tmp_dir):
    import json
    import os
    with open(os.path.join(tmp_dir, "a.jsonl"), "w") as f:
        for i in range(50):
            f.write(json.dumps({"text": "x" * 120 + str(i)}) + "\n")
    acc = extract_text(read_jsonl_lines(spark, tmp_dir), letters="é")
    plan = _plan(od.with_input_index(acc))
    # The rows stay in their scan tasks; only the per-split table is broadcast.
    assert _shuffles(plan) == 0, plan
    assert "BroadcastExchange" in plan


def test_shuffles_and_epochs_move_no_rows(spark):
    df = spark.range(1, 105).withColumnRenamed("id", "idx")
    for out in (od.windowed_shuffle(df, "idx", None, 10), od.epoch_plan(df, "idx", None, 3, 10)):
        plan = _plan(od.micro_batches(out, 4))
        assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan, plan


def test_small_first_n_moves_only_its_rows(spark):
    plan = _plan(od.take_first(spark.range(1000).withColumnRenamed("id", "key"), 7, "key"))
    assert "TakeOrderedAndProject" in plan and _shuffles(plan) == 0, plan


def test_input_index_refuses_shuffled_input(spark):
    import pytest
    df = spark.range(10).select(F.lit("f").alias("file_path"), F.lit(0).alias("block_start"), "id").repartition(3)
    with pytest.raises(ValueError):
        od.with_input_index(df)


def test_aggregations_combine_before_the_shuffle(spark):
    from corpuskit.operators import evaluate as ev
    docs = spark.createDataFrame([(i % 5, "a b c " * 3) for i in range(50)], "key long, text string")
    plan = _plan(ev.response_metrics(docs, "text", by="key"))
    assert re.search(r"partial_count", plan), plan
    cands = spark.createDataFrame([(i % 3, i, "سلام" * 5) for i in range(30)], "pid long, template_pos int, output string")
    plan = _plan(ev.best_candidate(cands, "pid"))
    assert re.search(r"partial_max", plan), plan


def test_head_per_group_limits_before_shuffle(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)], "category string, pos int")
    plan = _plan(od.head_per_group(df, "category", "pos", 2))
    # The partial group limit sits below the exchange.
    below = plan.split("Exchange hashpartitioning(category")[1]
    assert "WindowGroupLimit" in below


def test_row_index_single_partition_exchanges_carry_no_data_columns(spark):
    df = spark.createDataFrame([(i, "payload-%d" % i) for i in range(300)], "key long, payload string")
    r = od.with_row_index(df, "key", "idx", bucket_width=16)
    r.write.format("noop").mode("overwrite").save()
    text = spark._jvm.PythonSQLUtils.explainString(r._jdf.queryExecution(), "formatted")
    blocks = re.findall(r"\(\d+\) Exchange\s*\nInput \[\d+\]: \[([^\]]*)\]\nArguments: SinglePartition", text)
    assert blocks, text
    # Only the per-bucket table (bucket id, size) is gathered in one partition.
    assert all("payload" not in b and "key" not in b for b in blocks), blocks
