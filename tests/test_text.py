import html

from pyspark.sql import functions as F

from corpuskit.functions import text as tx

FA = "سلام دنیا این یک متن فارسی است که طول کافی دارد"  # our own sentence


def _rows(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, text string")


GATE = [
    None, "", " " * 30,
    "ب" + "x" * 23,            # stripped length 24 -> false
    "ب" + "x" * 24,            # 25 -> true
    "  " + "ب" + "x" * 23 + "  ",
    "آ" * 30,                  # only alef-madda: not in the alphabet, too short for plain
    "a" * 100, "a" * 101,
    "{" + "a" * 120, "[" + "a" * 120, "<" + "a" * 120,
    "a" * 60 + "http" + "a" * 60,
    "   {" + "a" * 120,        # leading blanks defeat the brace check (raw value)
    " " + FA + "‌",
    "‌" + "a" * 30 + "‌",
    "ك" * 30 + "ي" * 5,        # Arabic kaf/yeh are not in the alphabet
]


ACCEPTED = [False, False, False, False, True, False, False, False, True, False, False, False, False, True, True, False, False]


def test_is_valid_text(spark):
    df = _rows(spark, GATE).select("id", "text", tx.is_valid_text("text").alias("v"))
    got = {r.id: r.v for r in df.collect()}
    assert [got[i] for i in range(len(GATE))] == ACCEPTED


def test_ustrip_and_tokens_match_python(spark):
    samples = ["  a b\tc\n", "　x y ", "‌z‌", "", "\x1c\x1dq\x85", "😊 a  ❤️ b"]
    df = _rows(spark, samples).select("id", tx.ustrip("text").alias("s"), tx.tokens("text").alias("t"),
                                      tx.word_count("text").alias("n"))
    for r in df.collect():
        assert r.s == samples[r.id].strip()
        assert list(r.t) == samples[r.id].split()
        assert r.n == len(samples[r.id].split())


def test_has_script_and_class(spark):
    vals = ["hello", "سلام", "mixed سلام", "آآآ", None, "١٢٣"]
    df = _rows(spark, vals).select("id", tx.has_script("text").alias("h"), tx.script_class("text").alias("c"))
    got = {r.id: (r.h, r.c) for r in df.collect()}
    want = [(False, "english"), (True, "persian"), (True, "english"), (False, "persian"), (False, "persian"), (False, "persian")]
    assert [got[i] for i in range(len(vals))] == want


def test_html_escape_title_preview(spark):
    vals = ["<a href=\"x\">Tom & Jerry's</a>", "plain", "a_b_c"]
    df = _rows(spark, vals).select("id", tx.html_escape("text").alias("e"), tx.category_title("text").alias("t"),
                                   tx.preview("text", 5).alias("p"))
    for r in df.collect():
        v = vals[r.id]
        assert r.e == html.escape(v)
        assert r.p == v[:5] + "..."
    assert df.where("id = 2").first().t == "A B C"


def test_echo_and_route(spark):
    rows = [("hi there", "hi there answer hi there"), ("q", "no echo"), ("ab", "ab"), ("", " x ")]
    df = spark.createDataFrame(rows, "prompt string, output string").select(
        "prompt", "output", tx.strip_echo_all("output", "prompt").alias("a"),
        tx.strip_echo_prefix("output", "prompt").alias("b"))
    for r in df.collect():
        exp_a = r.output.replace(r.prompt, "").strip() if r.prompt else r.output.strip()
        exp_b = r.output[len(r.prompt):].strip() if r.output.startswith(r.prompt) else r.output
        assert (r.a, r.b) == (exp_a, exp_b)
    rp = _rows(spark, ["  سلام  ", "hello"]).select(tx.route_prompt("text").alias("r")).collect()
    assert rp[0].r == tx.ROUTE_PREFIX_SCRIPT + "سلام"
    assert rp[1].r == tx.ROUTE_PREFIX_OTHER + "hello"


def test_fallback_pick_is_deterministic(spark):
    df = _rows(spark, ["p1", "p2", "p3", "p1"]).select("id", tx.fallback_response("text").alias("f"))
    got = {r.id: r.f for r in df.collect()}
    assert got[0] == got[3]
    assert set(got.values()) <= set(tx.FALLBACK_RESPONSES)


def test_percent_and_stamp(spark):
    r = spark.createDataFrame([("m", 28.571428)], "n string, v double").select(
        tx.percent_text("n", "v").alias("l")).first()
    assert r.l == "m: 28.6%"
    s = spark.sql("SELECT timestamp'2025-09-28 20:44:33' AS ts").select(tx.stamp("ts").alias("s")).first()
    assert s.s == "20250928_204433"


def test_thousands_text(spark):
    r = spark.createDataFrame([(11796480,)], "n long").select(tx.thousands_text("n").alias("t")).first()
    assert r.t == "11,796,480"
