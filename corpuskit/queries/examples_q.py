"""Vocabulary / encoding / example queries over the accepted corpus texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.functions.tokens import ids_text
from corpuskit.operators import examples as exm
from corpuskit.operators import extract as ex
from corpuskit.queries.common import EXTRACT_CTE, LETTERS, documents_as_jsonl, shuffled_positions, strip, table, tokens
from corpuskit.functions.tokens import pad_to_multiple
from corpuskit.operators.ordering import train_eval_split
from corpuskit.session import ensure_checkpoint_dir
from corpuskit.sinks import write_examples
from corpuskit.sources.jsonl import read_jsonl_lines

VOCAB = 32_000  # library default vocabulary size
SEQ = 512  # the reference trainer's max_seq_length


def corpus(spark, d):
    return ex.extract_text(documents_as_jsonl(spark, d), letters=LETTERS).select("line_no", "text")


def vocab(spark, d):
    return exm.fit_vocabulary(corpus(spark, d), "text", VOCAB)


def encoded(spark, d, max_tokens=None):
    return exm.encode(corpus(spark, d), vocab(spark, d), "line_no", "text",
                      max_tokens=max_tokens)


def q_fit_vocabulary(spark, d):
    return vocab(spark, d).withColumn("id", F.col("id").cast("bigint"))


def q_encode_ids(spark, d):
    return encoded(spark, d).select("line_no", ids_text("ids").alias("ids_text"), "n_tokens")


def q_pad_truncate(spark, d):
    e = exm.build_examples(encoded(spark, d, SEQ), SEQ)
    return e.select("line_no", ids_text("input_ids").alias("input_ids"),
                    ids_text("attention_mask").alias("attention_mask"))


def q_build_examples(spark, d):
    e = exm.build_examples(encoded(spark, d, SEQ), SEQ)
    return e.select("line_no", ids_text("input_ids").alias("input_ids"),
                    ids_text("attention_mask").alias("attention_mask"), ids_text("labels").alias("labels"))


def q_causal_labels(spark, d):
    e = exm.build_examples(encoded(spark, d, SEQ), SEQ, causal=True)
    return e.select("line_no", ids_text("labels").alias("labels"))


def q_token_stats(spark, d):
    return exm.token_stats(encoded(spark, d, SEQ), SEQ)


def q_nonempty_examples(spark, d):
    # Batch variant: truthy strings, stripped, tokenized, padded; only examples of length 0 go.
    docs = table(spark, d, "documents").where(tx.usable_string("text")) \
        .select("doc_id", tx.ustrip("text").alias("text"))
    v = exm.fit_vocabulary(docs, "text", VOCAB)
    e = exm.encode(docs, v, "doc_id", "text", max_tokens=SEQ)
    return exm.nonempty_examples(exm.build_examples(e, SEQ)).select("doc_id", "n_tokens")


def q_dataset_summary(spark, d):
    c = ex.count_valid(documents_as_jsonl(spark, d), letters=LETTERS)
    return exm.dataset_summary(c, max_seq_length=SEQ, per_device=1, accumulation=32, epochs=1, max_samples=700)


def q_training_examples(spark, d):
    """The whole streaming-trainer ingestion over the documents lines."""
    from corpuskit.plans.ingest import IngestConfig, corpus_examples
    cfg = IngestConfig(letters=LETTERS, buffer=100, batch_size=32, max_seq_length=SEQ, vocab_size=VOCAB)
    ex_ = corpus_examples(documents_as_jsonl(spark, d), "line_no", cfg)["examples"]
    return ex_.select("line_no", "window_id", "shuffle_pos", "batch_id", ids_text("input_ids").alias("input_ids"))


def q_training_examples_capped(spark, d):
    """The same from text files with ``max_samples``: only as many files are read as hold 330 accepted lines."""
    from corpuskit.plans.ingest import IngestConfig, corpus_examples
    from corpuskit.queries.jsonl_q import _written_lines
    cfg = IngestConfig(letters=LETTERS, buffer=100, batch_size=32, max_seq_length=SEQ, vocab_size=VOCAB, max_samples=330)
    ex_ = corpus_examples(read_jsonl_lines(spark, _written_lines(spark, d, "capped", files=10)), None, cfg)["examples"]
    return ex_.select("idx", "window_id", "shuffle_pos", "batch_id", ids_text("input_ids").alias("input_ids"))


def _fussy(texts):
    """A tokenizer that counts letters of words and fails on a text with a question mark."""
    if any("?" in t for t in texts):
        raise ValueError("question")
    return [[len(w) for w in t.split()] for t in texts]


def q_tolerant_encoding(spark, d):
    """A tokenizer hook that fails on some texts: failures stay as rows with their error."""
    turns = table(spark, d, "conversations").where(F.col("text").isNotNull())
    turns = turns.select(F.concat_ws(":", "conv_id", "turn").alias("key"), F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("?"))).otherwise(F.col("text")).alias("text"))
    return exm.encode_with(turns, "key", "text", _fussy).select("key", "n_tokens", "error")


def q_written_examples(spark, d):
    """Examples written by split and read back: rows, split folders and padded lengths."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/examples_" + uuid.uuid4().hex[:12]
    docs = table(spark, d, "orders").select("o_orderkey", F.lit(13).alias("n"))
    write_examples(train_eval_split(docs, "o_orderkey", 42), base)
    back = spark.read.parquet(base)
    return back.groupBy("split").agg(F.count("*").alias("n_rows"), F.max(pad_to_multiple("n", 8)).alias("padded"))


def q_batch_examples(spark, d):
    """The batch-trainer path end to end: truthy texts, stripped, encoded,
    padded, empty ones dropped, then the seeded train/eval split."""
    from corpuskit.plans.ingest import batch_ingest
    b = batch_ingest(table(spark, d, "documents"), "doc_id", max_seq_length=SEQ, vocab_size=VOCAB)
    return b.select("doc_id", "split", ids_text("input_ids").alias("input_ids"))


QUERIES = {
    "batch_examples": q_batch_examples,
    "training_examples": q_training_examples,
    "tolerant_encoding": q_tolerant_encoding,
    "written_examples": q_written_examples,
    "training_examples_capped": q_training_examples_capped,
    "fit_vocabulary": q_fit_vocabulary,
    "encode_ids": q_encode_ids,
    "pad_truncate": q_pad_truncate,
    "build_examples": q_build_examples,
    "causal_labels": q_causal_labels,
    "token_stats": q_token_stats,
    "nonempty_examples": q_nonempty_examples,
    "dataset_summary": q_dataset_summary,
}

TOK = f"""{EXTRACT_CTE},
acc AS (SELECT line_no, text FROM extracted WHERE text IS NOT NULL),
toks AS (SELECT line_no, {tokens('text')} AS toks FROM acc),
tok AS (SELECT line_no, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM toks),
vocab AS (SELECT term, freq, row_number() OVER (ORDER BY freq DESC, term) + 1 AS id
          FROM (SELECT term, count(*) AS freq FROM tok GROUP BY term ORDER BY freq DESC, term LIMIT {VOCAB - 2})),
enc AS (SELECT t.line_no, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids, count(*) AS n_tokens
        FROM tok t LEFT JOIN vocab v USING (term) GROUP BY t.line_no),
ex AS (SELECT line_no, n_tokens,
         list_concat(ids[1:{SEQ}], list_transform(range({SEQ} - len(ids[1:{SEQ}])), lambda x: 0)) AS input_ids,
         list_concat(list_transform(range(least(n_tokens, {SEQ})), lambda x: 1),
                     list_transform(range({SEQ} - least(n_tokens, {SEQ})), lambda x: 0)) AS mask
       FROM enc)"""

NONEMPTY = f"""docs AS (SELECT doc_id, {strip('text')} AS text FROM documents WHERE text IS NOT NULL AND text <> ''),
toks AS (SELECT doc_id, {tokens('text')} AS toks FROM docs)
SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens FROM toks"""

TRAIN = f"""{EXTRACT_CTE},
acc AS (SELECT line_no, text, row_number() OVER (ORDER BY line_no) AS idx FROM extracted WHERE text IS NOT NULL QUALIFY idx <= <most>),
ws AS ({shuffled_positions('acc', 42, 100)}),
toks AS (SELECT line_no, {tokens('text')} AS toks FROM acc),
tok AS (SELECT line_no, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM toks),
vocab AS (SELECT term, row_number() OVER (ORDER BY freq DESC, term) + 1 AS id
          FROM (SELECT term, count(*) AS freq FROM tok GROUP BY term ORDER BY freq DESC, term LIMIT {VOCAB - 2})),
enc AS (SELECT t.line_no, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids FROM tok t LEFT JOIN vocab v USING (term)
        GROUP BY t.line_no)"""

BATCH = f"""docs AS (SELECT doc_id, {strip('text')} AS text FROM documents WHERE text IS NOT NULL AND text <> ''),
toks AS (SELECT doc_id, {tokens('text')} AS toks FROM docs),
tok AS (SELECT doc_id, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS pos FROM toks),
vocab AS (SELECT term, row_number() OVER (ORDER BY freq DESC, term) + 1 AS id
          FROM (SELECT term, count(*) AS freq FROM tok GROUP BY term ORDER BY freq DESC, term LIMIT {VOCAB - 2})),
enc AS (SELECT t.doc_id, list(coalesce(v.id, 1) ORDER BY t.pos) AS ids FROM tok t LEFT JOIN vocab v USING (term)
        GROUP BY t.doc_id UNION ALL SELECT doc_id, [] FROM toks WHERE len(toks) = 0),
n AS (SELECT count(*) AS n FROM enc),
k AS (SELECT CASE WHEN n <= 1000 THEN 0 ELSE CAST(ceil(least(0.01, 5000.0 / n) * n) AS BIGINT) END AS k FROM n),
ranked AS (SELECT doc_id, ids, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM enc)"""

SQL = {
    "batch_examples": f"""WITH {BATCH}
        SELECT doc_id, CASE WHEN r <= (SELECT k FROM k) THEN 'eval' ELSE 'train' END AS split,
               array_to_string(list_concat(ids[1:{SEQ}], list_transform(range({SEQ} - len(ids[1:{SEQ}])), lambda x: 0)), ' ')
               AS input_ids
        FROM ranked""",
    "tolerant_encoding": f"""SELECT concat_ws(':', conv_id, turn) AS key, CASE WHEN t NOT LIKE '%?%' THEN CAST(len({tokens('t')}) AS BIGINT) END AS n_tokens,
        CASE WHEN t LIKE '%?%' THEN 'ValueError: question' END AS error
        FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || '?' ELSE text END AS t FROM conversations WHERE text IS NOT NULL)""",
    "written_examples": """WITH n AS (SELECT count(*) AS n FROM orders), k AS (SELECT CASE WHEN n <= 1000 THEN 0 ELSE CAST(ceil(least(0.01, 5000.0 / n) * n) AS BIGINT) END AS k, n FROM n)
        SELECT 'eval' AS split, k AS n_rows, 16::BIGINT AS padded FROM k WHERE k > 0 UNION ALL SELECT 'train', n - k, 16 FROM k""",
    "training_examples_capped": f"""WITH {TRAIN.replace('<most>', '330')}
        SELECT ws.idx, ws.window_id, ws.shuffle_pos, (ws.shuffle_pos - 1) // 32 AS batch_id,
               array_to_string(list_concat(ids[1:{SEQ}], list_transform(range({SEQ} - len(ids[1:{SEQ}])), lambda x: 0)), ' ')
               AS input_ids
        FROM ws JOIN enc USING (line_no)""",
    "training_examples": f"""WITH {TRAIN.replace('<most>', str(1 << 60))}
        SELECT ws.line_no, ws.window_id, ws.shuffle_pos, (ws.shuffle_pos - 1) // 32 AS batch_id,
               array_to_string(list_concat(ids[1:{SEQ}], list_transform(range({SEQ} - len(ids[1:{SEQ}])), lambda x: 0)), ' ')
               AS input_ids
        FROM ws JOIN enc USING (line_no)""",
    "fit_vocabulary": f"WITH {TOK} SELECT term, id, freq FROM vocab",
    "encode_ids": f"WITH {TOK} SELECT line_no, array_to_string(ids, ' ') AS ids_text, n_tokens FROM enc",
    "pad_truncate": f"WITH {TOK} SELECT line_no, array_to_string(input_ids, ' ') AS input_ids, "
                    f"array_to_string(mask, ' ') AS attention_mask FROM ex",
    "build_examples": f"WITH {TOK} SELECT line_no, array_to_string(input_ids, ' ') AS input_ids, "
                      f"array_to_string(mask, ' ') AS attention_mask, array_to_string(input_ids, ' ') AS labels FROM ex",
    "causal_labels": f"WITH {TOK} SELECT line_no, array_to_string(list_transform(input_ids, "
                     f"lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ') AS labels FROM ex",
    "token_stats": f"""WITH {TOK} SELECT count(*) AS n_examples, CAST(sum(least(n_tokens, {SEQ})) AS BIGINT) AS n_real_tokens,
        count(*) FILTER (WHERE n_tokens > {SEQ}) AS n_truncated,
        round(avg({SEQ} - least(n_tokens, {SEQ})) / {SEQ}, 6) AS padding_share,
        CAST(max(n_tokens) AS BIGINT) AS max_tokens FROM ex""",
    "nonempty_examples": f"WITH {NONEMPTY}",
    "dataset_summary": f"""WITH {EXTRACT_CTE}, c AS (SELECT least(count(text), 700) AS n FROM extracted)
        SELECT n AS n_samples, {SEQ}::BIGINT AS max_seq_length, 32::BIGINT AS effective_batch,
               1::BIGINT AS epochs, round(n * 1 / 32, 6) AS total_steps FROM c""",
}
