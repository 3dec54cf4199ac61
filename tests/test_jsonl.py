import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from corpuskit.operators import extract as ex
from corpuskit.sources.jsonl import read_json_table, read_jsonl_lines

FA = "امروز در کتابخانه یک کتاب تازه درباره تاریخ خواندم"  # our own text
LONG = "plain latin text " * 8  # > 100 chars, no script letter

LINES = [
    "",
    json.dumps({"text": FA}),
    json.dumps({"content": FA, "id": 1}),
    json.dumps({"article": FA}),
    json.dumps({"body": FA}),
    json.dumps({"paragraph": FA}),
    json.dumps({"document": FA}),
    json.dumps({"main_text": FA}),
    json.dumps({"zzz": FA}),
    json.dumps({"b": "short", "a": FA, "c": FA + " دوم"}),
    json.dumps({"text": "کوتاه", "body": FA}),
    json.dumps({"text": 12345, "n": 1.5, "f": True, "z": None, "l": [1, 2], "o": {"k": 1}, "s": FA}),
    '{"a": "%s", "a": "%s دیگر"}' % (FA, FA),
    json.dumps([FA]),
    json.dumps(FA),
    "null",
    '{"text": "%s"' % FA,
    '{"text": "%s"} trailing' % FA,
    "{'text': '%s'}" % FA,
    '{"n": NaN, "text": "%s"}' % FA,
    json.dumps({"x": "   {" + LONG}),
    json.dumps({"text": "   {" + LONG}),
    json.dumps({"note": LONG}),
    json.dumps({"note": "http " + LONG}),
    json.dumps({"text": "", "other": 0}),
]


# Outcome of each non-blank line: (outcome, text, field).
EXPECTED = [
    ("accepted", FA, "text"), ("accepted", FA, "content"), ("accepted", FA, "article"), ("accepted", FA, "body"),
    ("accepted", FA, "paragraph"), ("accepted", FA, "document"), ("accepted", FA, "main_text"), ("accepted", FA, "zzz"),
    ("accepted", FA, "a"), ("accepted", FA, "body"), ("accepted", FA, "s"), ("accepted", FA + " دیگر", "a"),
    ("not_object", None, None), ("not_object", None, None), ("not_object", None, None),
    ("malformed", None, None), ("malformed", None, None), ("malformed", None, None),
    ("accepted", FA, "text"), ("accepted", "{" + LONG.strip(), "x"), ("accepted", "{" + LONG.strip(), "text"),
    ("accepted", LONG.strip(), "note"), ("rejected", None, None), ("rejected", None, None), ("accepted", FA, "text"),
]


@pytest.fixture(scope="module")
def jsonl_path(tmp_path_factory):
    d = tmp_path_factory.mktemp("jsonl")
    p = os.path.join(d, "corpus.jsonl")
    with open(p, "wb") as f:
        for ln in LINES:
            f.write(ln.encode("utf-8") + b"\n")
        # invalid UTF-8 byte inside an otherwise valid line: dropped on decode
        f.write(b'{"text": "' + FA.encode() + b'\xff"}\n')
    return p


def test_read_lines_skips_blank_and_keeps_order(spark, jsonl_path):
    df = read_jsonl_lines(spark, jsonl_path, line_numbers=True).orderBy("line_no")
    got = [r.line for r in df.collect()]
    assert [r.line_no for r in df.collect()][:2] == [2, 3]  # the blank first line is counted
    exp = [ln.strip() for ln in LINES if ln.strip()] + ['{"text": "' + FA + '"}']
    assert got == exp


def test_missing_path_raises(spark, tmp_dir):
    with pytest.raises(AnalysisException):
        read_jsonl_lines(spark, os.path.join(tmp_dir, "missing.jsonl")).count()


def test_extraction_outcomes(spark, jsonl_path):
    cl = ex.classify_lines(read_jsonl_lines(spark, jsonl_path, line_numbers=True)).orderBy("line_no").collect()
    assert [(r.outcome, r.text, r.source_field) for r in cl] == EXPECTED


def test_quarantine_reasons(spark, jsonl_path):
    lines = read_jsonl_lines(spark, jsonl_path)
    good, bad = ex.quarantine_malformed(lines)
    reasons = {r.line: r.reason for r in bad.collect()}
    assert reasons[json.dumps([FA])] == "not_object"
    assert reasons["null"] == "not_object"
    assert reasons['{"text": "%s"' % FA] == "malformed"
    assert reasons["{'text': '%s'}" % FA] == "malformed"
    assert reasons['{"text": "%s"} trailing' % FA] == "malformed"
    # NaN is accepted, as Python's json module does.
    assert '{"n": NaN, "text": "%s"}' % FA not in reasons
    assert good.count() + bad.count() == lines.count()


def test_duplicate_key_last_value_wins(spark):
    df = spark.createDataFrame([('{"a": "x", "a": "%s"}' % FA,)], "line string")
    r = ex.extract_text(df).first()
    assert r.text == FA and r.source_field == "a"


def test_nested_duplicate_keys_are_an_object(spark):
    df = spark.createDataFrame([('{"text": "%s", "meta": {"a": 1, "a": 2}}' % FA,)], "line string")
    assert ex.extract_text(df).first().text == FA


def test_invalid_bytes_go_and_valid_replacement_characters_stay(spark, tmp_dir):
    p = os.path.join(tmp_dir, "bad.jsonl")
    with open(p, "wb") as f:
        f.write("a\ufffdb".encode() + b"\xffc\n" + "d\ufffd\n".encode() + b"\xff\n")
    assert [r.line for r in read_jsonl_lines(spark, p, line_numbers=True).orderBy("line_no").collect()] == ["a\ufffdbc", "d\ufffd"]


def test_sample_preview(spark):
    rows = [(2, '{"text": "later"}'), (1, '{"id": 1, "text": "%s"}' % ("y" * 300)), (0, "bad")]
    r = ex.sample_preview(spark.createDataFrame(rows, "n int, line string"), "n").first()
    assert r["keys"] == ["id", "text"] and r.preview == "y" * 200 + "..."


def test_count_valid_and_cap(spark, jsonl_path):
    lines = read_jsonl_lines(spark, jsonl_path)
    n = ex.count_valid(lines).first().n_valid
    assert n == 17
    assert ex.count_valid(lines, max_samples=3).first().n_valid == 3


def test_profile_fields(spark):
    df = spark.createDataFrame([('{"a": "x", "b": null}',), ('{"a": 1}',), ("bad",)], "line string")
    got = {r.field: (r.n_present, r.n_non_null, r.n_string) for r in ex.profile_fields(df).collect()}
    assert got == {"a": (2, 2, 1), "b": (1, 0, 0)}


def test_read_json_table_keeps_corrupt_lines(spark, tmp_dir):
    p = os.path.join(tmp_dir, "t.jsonl")
    with open(p, "w") as f:
        f.write('{"text": "a", "n": 1}\n{bad\n{"text": "b", "n": 2}\n')
    t = read_json_table(spark, p, "text string, n long")
    rows = t.orderBy("n").collect()
    assert [r.text for r in rows if r.text] == ["a", "b"]
    assert sum(1 for r in rows if r._corrupt_record is not None) == 1


def test_observe_accepted_counts_during_write(spark, jsonl_path, tmp_dir):
    acc = ex.extract_text(read_jsonl_lines(spark, jsonl_path))
    observed, obs = ex.observe_accepted(acc)
    observed.write.mode("overwrite").parquet(os.path.join(tmp_dir, "acc"))
    assert obs.get["n_rows"] == spark.read.parquet(os.path.join(tmp_dir, "acc")).count()


def test_extraction_is_idempotent(spark, jsonl_path):
    acc = ex.extract_text(read_jsonl_lines(spark, jsonl_path))
    again = ex.extract_text(acc.select(F.to_json(F.struct("text")).alias("line"), F.col("text").alias("first")))
    assert again.where(F.col("text") != F.col("first")).count() == 0
    # Only texts accepted through the raw-value quirk (leading blanks before a
    # brace) do not pass the gate a second time once stripped.
    lost = acc.join(again.select(F.col("first").alias("text")), "text", "left_anti").collect()
    assert len(lost) == 2 and all(r.text.startswith("{") for r in lost)


def test_column_level_extraction(spark):
    df = spark.createDataFrame([('{"body": "%s", "n": 1}' % FA,), ('{"n": 2}',)], "line string")
    text, field = ex.extract_text_col(ex.parse_object(F.col("line")))
    got = [(r.t, r.f) for r in df.select(text.alias("t"), field.alias("f")).collect()]
    assert got == [(FA, "body"), (None, None)]
