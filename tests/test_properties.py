"""Property tests: Spark column functions against plain-Python restatements."""

import json
import os

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.functions.tokens import pad_to_multiple
from corpuskit.sinks import write_run_metadata
from corpuskit.sources.suites import PLAIN_TEMPLATES, prompt_suite, template_set

ALPHABET = list("ابپسلامآكa bz{[<htp") + [" ", "\t", "\n", " ", "‌", " ", "　", "😊"]
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=140), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(TEXTS)
def test_strip_and_split_match_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    rows = df.select("id", tx.is_valid_text("text").alias("v"), tx.ustrip("text").alias("s"),
                     tx.tokens("text").alias("k"), tx.clean_input("text").alias("c")).collect()
    for r in rows:
        t = texts[r.id]
        assert r.s == t.strip() and list(r.k) == t.split()
        assert r.c == (t.strip() or None)
        # B5 is implied by the gate: an accepted text has more than 20 stripped characters.
        assert not r.v or len(t.strip()) > 20


def test_pad_to_multiple(spark):
    got = [r.p for r in spark.createDataFrame([(0,), (1,), (8,), (9,), (511,)], "n long")
           .select(pad_to_multiple("n", 8).alias("p")).collect()]
    assert got == [0, 8, 8, 16, 512]


def test_suites_keep_order(spark):
    suite = {"greetings": ["سلام", "hello"], "facts": ["q1", "q2", "q3"]}
    rows = prompt_suite(spark, suite).orderBy("pos").collect()
    assert [(r.category, r.cat_pos, r.pos, r.prompt) for r in rows] == [
        ("greetings", 0, 0, "سلام"), ("greetings", 0, 1, "hello"),
        ("facts", 1, 2, "q1"), ("facts", 1, 3, "q2"), ("facts", 1, 4, "q3")]
    t = template_set(spark).orderBy("template_pos").collect()
    assert [r.template for r in t] == list(PLAIN_TEMPLATES)


def test_write_run_metadata(spark, tmp_dir):
    p = os.path.join(tmp_dir, "meta")
    write_run_metadata(spark, {"total_steps": 6250, "final_loss": 1.25, "training_duration": "1:00:00"}, p)
    m = json.loads(spark.read.text(p).first().value)
    assert m["total_steps"] == 6250 and "completed_at" in m


FA = "امروز در کتابخانه یک کتاب"  # 25 code points
LATIN = "plain latin words " * 6  # 108 code points
# The text gate: (text, accepted).
GATE = [
    (None, False), ("", False), (" " * 40, False), (FA, True), (FA[:-1], False), ("  " + FA[:-1] + " ", False), ("آ" + "x" * 24, False), ("ب" + "x" * 24, True), ("x" * 25, False),
    ("x" * 100, False), ("x" * 101, True), (LATIN, True), ("{" + LATIN, False), ("[" + LATIN, False), ("<" + LATIN, False),
    (" {" + LATIN, True), ("see http " + LATIN, False), ("{" + LATIN + FA, True), ("http " + FA, True), ("1" * 101, True),
    ("\u00a0" + FA + "\u00a0", True), ("\u200c" + FA, True),
]


def test_text_gate(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(GATE)], "id int, text string")
    got = {r.id: r.v for r in df.select("id", tx.is_valid_text("text").alias("v")).collect()}
    assert [(GATE[i][0], v) for i, v in sorted(got.items())] == GATE


LONG_FA = "امروز در کتابخانه یک کتاب تازه درباره تاریخ خواندم"
# Field precedence: (record, text, field).
RECORDS = [
    ({"content": LONG_FA, "text": LONG_FA + " دو"}, LONG_FA + " دو", "text"),
    ({"note": LONG_FA, "body": LONG_FA + " دو"}, LONG_FA + " دو", "body"),
    ({"b": LONG_FA, "a": LONG_FA + " دو"}, LONG_FA, "b"),
    ({"text": "short", "a": " " + LONG_FA + " "}, LONG_FA, "a"),
    ({"text": None, "document": LATIN}, LATIN.strip(), "document"),
    ({"text": [LONG_FA]}, '["' + LONG_FA + '"]', "text"),
    ({"text": True, "a": 5, "b": None}, None, None),
    ({}, None, None),
]


def test_field_precedence(spark):
    from corpuskit.operators import extract as ex
    df = spark.createDataFrame([(i, json.dumps(o, ensure_ascii=False)) for i, (o, _, _) in enumerate(RECORDS)], "id int, line string")
    got = {r.id: (r.text, r.source_field) for r in ex.classify_lines(df).collect()}
    assert [got[i] for i in range(len(RECORDS))] == [(t, f) for _, t, f in RECORDS]
