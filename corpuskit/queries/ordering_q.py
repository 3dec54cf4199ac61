"""Order/limit/shuffle/batch/split/step queries over accepted corpus lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.operators import extract as ex
from corpuskit.operators import ordering as od
from corpuskit.queries.common import EXTRACT_CTE, LETTERS, documents_as_jsonl, shuffled_positions, table

BUFFER = 100  # small enough that the sf0.01 corpus spans several shuffle buffers
BATCH = 32
SEED = 42


def accepted(spark, d):
    """Accepted lines of the documents corpus with their input position."""
    acc = ex.extract_text(documents_as_jsonl(spark, d), letters=LETTERS).select("line_no")
    # The accepted keys are narrow: write them once, then count and number.
    return od.with_row_index(acc, "line_no", "idx", materialize=True)


def shuffled(spark, d):
    return od.windowed_shuffle(accepted(spark, d), "idx", "line_no", BUFFER, SEED)


def q_row_index(spark, d):
    return accepted(spark, d)


def q_take_first(spark, d):
    acc = ex.extract_text(documents_as_jsonl(spark, d), letters=LETTERS).select("line_no")
    return od.take_first(acc, 500, "line_no")


def q_windowed_shuffle(spark, d):
    return shuffled(spark, d).select("line_no", "window_id", "shuffle_pos", "shuffled_idx")


def q_shuffle_source(spark, d):
    """For each place after the shuffle, the place before: the permutation backwards."""
    acc = accepted(spark, d)
    n = acc.count()
    return acc.select(F.col("idx").alias("shuffled_idx"), od.source_index("idx", BUFFER, n, SEED).alias("idx"))


def q_micro_batches(spark, d):
    return od.micro_batches(shuffled(spark, d), BATCH).select("line_no", "window_id", "batch_id", "pos_in_batch")


def q_train_eval_split(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return od.train_eval_split(o, "o_orderkey", SEED).select("o_orderkey", "split")


def q_split_counts(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    return od.split_counts(od.train_eval_split(o, "o_orderkey", SEED))


def q_epoch_plan(spark, d):
    return od.epoch_plan(accepted(spark, d), "idx", "line_no", 2, BUFFER, SEED) \
        .select("epoch", "line_no", "window_id", "shuffle_pos")


def q_assign_steps(spark, d):
    s = shuffled(spark, d)
    return od.assign_steps(s, "shuffled_idx", 1, 16).select("line_no", "step")


def q_plan_steps(spark, d):
    c = ex.count_valid(documents_as_jsonl(spark, d), letters=LETTERS)
    return od.plan_steps(c, max_samples=500, epochs=2, per_device=1, accumulation=32)


def q_progress_marks(spark, d):
    return od.progress_marks(accepted(spark, d), "idx", 100)


def q_head_per_group(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    return od.head_per_group(docs, "source", "doc_id", 2).withColumn("rank", F.col("rank").cast("bigint"))


def q_row_index_range(spark, d):
    """A composite key with payload columns, and a leading key that is NULL for many rows."""
    li = table(spark, d, "lineitem").select(
        F.expr("nullif(l_suppkey, l_suppkey - l_suppkey % 3)").alias("supp"), "l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate")
    out = od.with_row_index_range(li, ["supp", "l_orderkey", "l_linenumber"], "idx")
    return out.select("l_orderkey", "l_linenumber", "idx")


QUERIES = {
    "row_index": q_row_index,
    "row_index_range": q_row_index_range,
    "take_first": q_take_first,
    "windowed_shuffle": q_windowed_shuffle,
    "shuffle_source": q_shuffle_source,
    "micro_batches": q_micro_batches,
    "train_eval_split": q_train_eval_split,
    "split_counts": q_split_counts,
    "epoch_plan": q_epoch_plan,
    "assign_steps": q_assign_steps,
    "plan_steps": q_plan_steps,
    "progress_marks": q_progress_marks,
    "head_per_group": q_head_per_group,
}

ACC = f"""{EXTRACT_CTE},
acc AS (SELECT line_no, row_number() OVER (ORDER BY line_no) AS idx FROM extracted WHERE text IS NOT NULL),
ws AS ({shuffled_positions('acc', SEED, BUFFER)})"""

SPLIT = """n AS (SELECT count(*) AS n FROM orders),
k AS (SELECT CASE WHEN n <= 1000 THEN 0 ELSE CAST(ceil(least(0.01, 5000.0 / n) * n) AS BIGINT) END AS k FROM n),
ranked AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r
           FROM orders),
split AS (SELECT o_orderkey, CASE WHEN r <= (SELECT k FROM k) THEN 'eval' ELSE 'train' END AS split FROM ranked)"""

SQL = {
    "row_index": f"WITH {ACC} SELECT line_no, idx FROM acc",
    "row_index_range": """SELECT l_orderkey, l_linenumber, row_number() OVER (
        ORDER BY nullif(l_suppkey, l_suppkey - l_suppkey % 3) NULLS FIRST, l_orderkey, l_linenumber) AS idx FROM lineitem""",
    "take_first": f"WITH {ACC} SELECT line_no FROM acc WHERE idx <= 500",
    "windowed_shuffle": f"WITH {ACC} SELECT line_no, window_id, shuffle_pos, window_id * {BUFFER} + shuffle_pos AS shuffled_idx FROM ws",
    "shuffle_source": f"WITH {ACC} SELECT window_id * {BUFFER} + shuffle_pos AS shuffled_idx, idx FROM ws",
    "micro_batches": f"WITH {ACC} SELECT line_no, window_id, (shuffle_pos - 1) // {BATCH} AS batch_id, "
                     f"(shuffle_pos - 1) % {BATCH} + 1 AS pos_in_batch FROM ws",
    "train_eval_split": f"WITH {SPLIT} SELECT o_orderkey, split FROM split",
    "split_counts": f"WITH {SPLIT} SELECT split, count(*) AS n_rows FROM split GROUP BY split",
    "epoch_plan": f"""WITH {ACC}, e1 AS ({shuffled_positions('acc', SEED, BUFFER, '1')})
      SELECT 0 AS epoch, line_no, window_id, shuffle_pos FROM ws UNION ALL SELECT 1, line_no, window_id, shuffle_pos FROM e1""",
    "assign_steps": f"""WITH {ACC}, s AS (SELECT line_no, window_id * {BUFFER} + shuffle_pos AS p FROM ws)
      SELECT line_no, (p - 1) // 16 AS step FROM s WHERE p <= ((SELECT count(*) FROM s) // 16) * 16""",
    "plan_steps": f"""WITH {EXTRACT_CTE}, c AS (SELECT count(text) AS n FROM extracted)
      SELECT least(n, 500) AS n_samples, 32::BIGINT AS effective_batch, 2::BIGINT AS epochs,
             CAST(floor(least(n, 500) * 2 / 32) AS BIGINT) AS max_steps,
             CAST(greatest(100, floor(500 * 2 / 32 * 0.05)) AS BIGINT) AS warmup_steps FROM c""",
    "progress_marks": f"WITH {ACC} SELECT line_no, idx FROM acc WHERE idx % 100 = 0",
    "head_per_group": """SELECT source, doc_id, rank FROM (
        SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents)
      WHERE rank <= 2""",
}
