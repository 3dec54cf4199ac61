"""JSON-lines ingestion queries over ``documents`` rendered as JSON lines."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuskit.operators import extract as ex
from corpuskit.operators.prefix import first_rows
from corpuskit.queries.common import DOC_FIELD_SQL, EXTRACT_CTE, EXTRACT_PARSED_CTE, LETTERS, documents_as_jsonl, shuffled_positions
from corpuskit.session import ensure_checkpoint_dir
from corpuskit.sinks.versions import publish, read_version, versions
from corpuskit.sources.jsonl import read_json_table, read_jsonl_lines
from corpuskit.streaming.carry import carried_rest, carried_shuffle
from corpuskit.streaming.ingest import ingest_stream, shuffle_batches


def q_jsonl_quarantine(spark, d):
    _, bad = ex.quarantine_malformed(documents_as_jsonl(spark, d, malformed=True))
    return bad.select("line_no", "reason")


def q_extract_text(spark, d):
    out = ex.extract_text(documents_as_jsonl(spark, d), letters=LETTERS)
    return out.select("line_no", "source_field", "text")


def q_count_valid(spark, d):
    return ex.count_valid(documents_as_jsonl(spark, d), letters=LETTERS)


def q_extraction_breakdown(spark, d):
    return ex.extraction_breakdown(ex.classify_lines(documents_as_jsonl(spark, d, malformed=True), letters=LETTERS))


def q_profile_fields(spark, d):
    return ex.profile_fields(documents_as_jsonl(spark, d, malformed=True))


def q_sample_preview(spark, d):
    out = ex.sample_preview(documents_as_jsonl(spark, d), "line_no")
    return out.select(F.concat_ws(",", "keys").alias("keys"), "preview")


def _streamed(spark, d, name, transform=None):
    """The documents' JSON lines written as text files in id order, then read by
    the incremental ingestion (availableNow) into Parquet files."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}_" + uuid.uuid4().hex[:12]
    documents_as_jsonl(spark, d).orderBy("line_no").select("line").write.text(base + "/src")
    q = ingest_stream(spark, base + "/src", base + "/out", base + "/ck", letters=LETTERS, batch_transform=transform)
    q.awaitTermination()
    return spark.read.parquet(base + "/out").withColumn("line_no", F.get_json_object("line", "$.doc_id").cast("bigint"))


def q_stream_extract(spark, d):
    return _streamed(spark, d, "stream_extract").select("line_no", "source_field", "text")


def q_stream_shuffle(spark, d):
    """Each micro-batch shuffled inside bounded buffers of 100 rows, in batches of 32."""
    out = _streamed(spark, d, "stream_shuffle", shuffle_batches(buffer=100, seed=42, batch_size=32))
    return out.select("line_no", "idx", "window_id", "shuffle_pos", "pos_in_batch")


def q_stream_shuffle_carried(spark, d):
    """Four runs of the incremental ingestion, three new files each, on one checkpoint: windows of 100 rows go on
    over runs and files as if all were one file."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/stream_carried_" + uuid.uuid4().hex[:12]
    shuffle = {"buffer": 100, "seed": 42, "batch_size": 32}
    lines = documents_as_jsonl(spark, d)
    low, high = lines.agg(F.min("line_no"), F.max("line_no")).first()
    quarter = F.floor((F.col("line_no") - low) * 4 / (high - low + 1)) if low is not None else F.lit(0)
    for k in range(4):
        lines.where(quarter == k).repartitionByRange(3, "line_no").sortWithinPartitions("line_no").select("line") \
            .write.mode("append").text(base + "/src")
        ingest_stream(spark, base + "/src", base + "/out", base + "/ck", letters=LETTERS,
                      batch_transform=carried_shuffle(base + "/carry", **shuffle)).awaitTermination()
    rest = carried_rest(spark, base + "/carry", base + "/ck", **shuffle)
    cols = ["line", "idx", "window_id", "shuffle_pos", "pos_in_batch"]
    out = spark.read.parquet(base + "/out").select(cols).unionByName(rest.select(cols))
    return out.select(F.get_json_object("line", "$.doc_id").cast("bigint").alias("line_no"), *cols[1:])


def _written_lines(spark, d, name, malformed=False, files=None):
    """The documents' JSON lines as text files in id order; the folder they are in."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/{name}_" + uuid.uuid4().hex[:12]
    lines = documents_as_jsonl(spark, d, malformed)
    lines = lines.repartitionByRange(files, "line_no").sortWithinPartitions("line_no") if files else lines.orderBy("line_no")
    lines.select("line").write.text(base)
    return base


def q_take_first_files(spark, d):
    """The first 300 accepted lines of ten files: a prefix scan that leaves the other files unread."""
    lines = read_jsonl_lines(spark, _written_lines(spark, d, "prefix", True, 10))
    accept = lambda rows: ex.extract_text(rows, letters=LETTERS)
    out = first_rows(lines, 300, accept)
    return out.select(F.get_json_object("line", "$.doc_id").cast("bigint").alias("line_no"), "idx", "source_field", F.length("text").cast("bigint").alias("n_chars"))


def q_count_valid_capped(spark, d):
    """The count pass with a limit over ten files, stopped once it is reached."""
    return ex.count_valid(read_jsonl_lines(spark, _written_lines(spark, d, "prefix", True, 10)), max_samples=500, letters=LETTERS)


def q_json_table(spark, d):
    """The lines loaded as a table with an explicit schema; broken ones land in the corrupt column."""
    t = read_json_table(spark, _written_lines(spark, d, "json_table", True), "doc_id bigint, lang string, text string, n_chars bigint")
    return t.select("doc_id", "lang", F.length("text").cast("bigint").alias("text_chars"), "n_chars", F.col("_corrupt_record").isNotNull().alias("corrupt"))


def q_resumed_extract(spark, d):
    """The incremental ingestion stopped after half of the files and started again on its checkpoint."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/resumed_" + uuid.uuid4().hex[:12]
    lines = documents_as_jsonl(spark, d)
    for half in (0, 1):
        lines.where(F.col("line_no") % 2 == half).select("line").write.mode("append").text(base + "/src")
        ingest_stream(spark, base + "/src", base + "/out", base + "/ck", letters=LETTERS).awaitTermination()
    out = spark.read.parquet(base + "/out")
    return out.select(F.get_json_object("line", "$.doc_id").cast("bigint").alias("line_no"), "source_field", F.col("batch_id").cast("bigint").alias("batch_id"))


def q_versioned_output(spark, d):
    """Four versions published, two kept; the last is read back, with the numbers of those that are left."""
    base = ensure_checkpoint_dir(spark).rstrip("/") + "/versions_" + uuid.uuid4().hex[:12]
    rows = ex.extract_text(documents_as_jsonl(spark, d), letters=LETTERS).select("line_no", "source_field")
    for k in range(4):
        publish(rows.withColumn("version", F.lit(k).cast("bigint")), base, keep=2)
    left = ",".join(map(str, versions(spark, base)))
    return read_version(spark, base).withColumn("left", F.lit(left))


def q_jsonl_line_numbers(spark, d):
    """Lines of text files numbered in input order, without a shuffle of the lines."""
    lines = read_jsonl_lines(spark, _written_lines(spark, d, "line_numbers"), line_numbers=True)
    return lines.select(F.get_json_object("line", "$.doc_id").cast("bigint").alias("doc_id"), "line_no")


QUERIES = {
    "stream_extract": q_stream_extract,
    "stream_shuffle": q_stream_shuffle,
    "stream_shuffle_carried": q_stream_shuffle_carried,
    "jsonl_line_numbers": q_jsonl_line_numbers,
    "take_first_files": q_take_first_files,
    "count_valid_capped": q_count_valid_capped,
    "json_table": q_json_table,
    "resumed_extract": q_resumed_extract,
    "versioned_output": q_versioned_output,
    "jsonl_quarantine": q_jsonl_quarantine,
    "extract_text": q_extract_text,
    "count_valid": q_count_valid,
    "extraction_breakdown": q_extraction_breakdown,
    "profile_fields": q_profile_fields,
    "sample_preview": q_sample_preview,
}

# Windows over the whole corpus, whether one micro-batch brings it or many do.
_SHUFFLED = f"""WITH {EXTRACT_CTE},
        acc AS (SELECT line_no, row_number() OVER (ORDER BY line_no) AS idx FROM extracted WHERE text IS NOT NULL),
        ws AS ({shuffled_positions('acc', 42, 100)})
        SELECT line_no, idx, window_id, shuffle_pos, (shuffle_pos - 1) % 32 + 1 AS pos_in_batch FROM ws"""

SQL = {
    "stream_extract": f"WITH {EXTRACT_CTE} SELECT line_no, source_field, text FROM extracted WHERE text IS NOT NULL",
    "stream_shuffle": _SHUFFLED,
    "stream_shuffle_carried": _SHUFFLED,
    "jsonl_line_numbers": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS line_no FROM documents",
    "take_first_files": f"""WITH {EXTRACT_PARSED_CTE}, a AS (SELECT line_no, row_number() OVER (ORDER BY line_no) AS idx, source_field, length(text) AS n_chars
          FROM extracted WHERE text IS NOT NULL) SELECT * FROM a WHERE idx <= 300""",
    "count_valid_capped": f"WITH {EXTRACT_PARSED_CTE} SELECT least(500, count(text)) AS n_valid FROM extracted",
    "json_table": """SELECT CASE WHEN doc_id % 17 <> 0 THEN doc_id END AS doc_id, CASE WHEN doc_id % 17 <> 0 THEN lang END AS lang,
        CASE WHEN doc_id % 17 <> 0 AND doc_id % 4 = 0 THEN length(text) END AS text_chars, CASE WHEN doc_id % 17 <> 0 THEN n_chars END AS n_chars,
        doc_id % 17 = 0 AS corrupt FROM documents""",
    "resumed_extract": f"WITH {EXTRACT_CTE} SELECT line_no, source_field, line_no % 2 AS batch_id FROM extracted WHERE text IS NOT NULL",
    "versioned_output": f"WITH {EXTRACT_CTE} SELECT line_no, source_field, 3::BIGINT AS version, '2,3' AS \"left\" FROM extracted WHERE text IS NOT NULL",
    "jsonl_quarantine": "SELECT doc_id AS line_no, 'malformed' AS reason FROM documents WHERE doc_id % 17 = 0",
    "extract_text": f"WITH {EXTRACT_CTE} SELECT line_no, source_field, text FROM extracted WHERE text IS NOT NULL",
    "count_valid": f"WITH {EXTRACT_CTE} SELECT count(text) AS n_valid FROM extracted",
    "extraction_breakdown": f"""WITH {EXTRACT_PARSED_CTE}
      SELECT coalesce(source_field, 'rejected') AS bucket, count(*) AS n_lines FROM extracted GROUP BY 1
      UNION ALL SELECT 'malformed', count(*) FROM documents WHERE doc_id % 17 = 0 HAVING count(*) > 0""",
    "sample_preview": f"""SELECT 'doc_id,lang,source,' || {DOC_FIELD_SQL} || ',n_chars' AS keys,
        CASE WHEN doc_id % 4 = 0 THEN substr(text, 1, 200) || '...' END AS preview FROM documents ORDER BY doc_id LIMIT 1""",
    "profile_fields": f"""WITH ok AS (SELECT *, {DOC_FIELD_SQL} AS f FROM documents WHERE doc_id % 17 <> 0)
      SELECT 'doc_id' AS field, count(doc_id) AS n_present, count(doc_id) AS n_non_null, 0::BIGINT AS n_string FROM ok
      UNION ALL SELECT 'lang', count(lang), count(lang), count(lang) FROM ok HAVING count(lang) > 0
      UNION ALL SELECT 'source', count(source), count(source), count(source) FROM ok HAVING count(source) > 0
      UNION ALL SELECT 'n_chars', count(n_chars), count(n_chars), 0::BIGINT FROM ok HAVING count(n_chars) > 0
      UNION ALL SELECT f, count(text), count(text), count(text) FROM ok WHERE text IS NOT NULL GROUP BY f""",
}
