import pytest

from corpuskit.functions import text as tx
from corpuskit.operators import evaluate as ev
from corpuskit.plans.evaluation import evaluate_candidates

FA11 = "سلامسلامسل"  # 10 code points
FA12 = "سلامسلامسلا"  # 11 code points


def test_best_candidate_cases(spark):
    rows = [
        (1, 0, FA11), (1, 1, FA12),              # 10 rejected, 11 accepted
        (2, 0, "x" * 40), (2, 1, "ب" * 20),       # no script letter rejected
        (3, 0, "ب" * 20), (3, 1, "پ" * 20),       # tie: first template wins
        (4, 0, "short"), (4, 1, "ok"),            # all rejected -> fallback
    ]
    c = spark.createDataFrame(rows, "pid long, template_pos int, output string")
    prompts = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "pid long")
    got = {r.pid: r for r in ev.best_candidate(c, "pid", prompts=prompts).collect()}
    assert (got[1].best_template_pos, got[1].response) == (1, FA12)
    assert got[2].response == "ب" * 20
    assert (got[3].best_template_pos, got[3].response) == (0, "ب" * 20)
    assert got[4].is_fallback and got[4].response in tx.FALLBACK_RESPONSES
    assert got[5].is_fallback  # no candidate at all
    plain = {r.pid: r.response for r in ev.best_candidate(c, "pid", gate=False, fallback=[tx.PLAIN_FALLBACK]).collect()}
    assert plain[2] == "x" * 40 and plain[4] == "short"


def test_echo_removal_in_plan(spark):
    prompts = spark.createDataFrame([("cat_a", 0, 0, "q1"), ("cat_a", 0, 1, "q2")],
                                    "category string, cat_pos int, pos int, prompt string")
    rendered = "### Instruction:\nq1"
    cands = spark.createDataFrame([
        (0, 0, rendered, rendered + " پاسخ خوب و کامل " + rendered),   # echo twice
        (0, 1, "User: q1", "User: q1 کوتاه"),                            # echo once, too short after strip
        (1, 0, "x", "پاسخ بدون تکرار پرسش"),                             # echo absent
    ], "pos int, template_pos int, rendered string, output string")
    out = evaluate_candidates(prompts, cands)
    res = {r.pos: r.response for r in out["results"].collect()}
    assert res[0] == "پاسخ خوب و کامل" and res[1] == "پاسخ بدون تکرار پرسش"
    assert out["report_rows"].count() == 3
    lines = [r.line for r in out["metrics_lines"].orderBy("line_no").collect()]
    assert lines[0] == ev.METRICS_TITLE and lines[3].startswith("persian_only: ")


def test_response_metrics_shares(spark):
    responses = [
        "سلام! امروز هوا خوب است",
        " ".join(["کلمه"] * 10),
        " ".join(["کلمه"] * 11),
        "just english words here",
        "ممنون ❤️",
        "❤ only heart without selector",
        "چطور؟ ... عالی 🌟",
        "دوستانه 😂",
    ]
    df = spark.createDataFrame([(r,) for r in responses], "response string")
    got = ev.response_metrics(df).first().asDict()
    want = {"persian_only": 75.0, "friendly_tone": 50.0, "helpful_content": 12.5, "creative_elements": 25.0, "emoji_usage": 37.5}
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-6), k
    assert got["n_responses"] == len(responses)
    empty = ev.response_metrics(df.limit(0)).first()
    assert empty.persian_only is None and empty.n_responses == 0


def test_metrics_by_group_rollup(spark):
    df = spark.createDataFrame([("a", "سلام"), ("a", "hi"), ("b", "hello"), (None, "hey")], "category string, response string")
    got = {(r.category, r.is_total): r.persian_only for r in ev.response_metrics(df, by="category").collect()}
    assert got == {("a", False): 50.0, ("b", False): 0.0, (None, False): 0.0, (None, True): 25.0}


def test_render_prompts_and_summary(spark):
    p = spark.createDataFrame([("q {system}",)], "prompt string")
    r = ev.render_prompts(p, "prompt").orderBy("template_pos").collect()
    assert [x.template_pos for x in r] == [0, 1, 2, 3]
    assert r[1].rendered == "User: q {system}\nAssistant:"
    res = spark.createDataFrame([("basic_talk", 0, 0, "p", "r")],
                                "category string, cat_pos int, pos int, prompt string, response string")
    lines = [x.line for x in ev.summary_lines(res).orderBy("cat_pos", "pos", "line_no").collect()]
    assert lines == [ev.SUMMARY_TITLE, "=" * 50, "", "CATEGORY: BASIC_TALK", "-" * 30, "PROMPT: p", "RESPONSE: r", "-" * 20, ""]
    plain = ev.report_rows(res, plain=True).orderBy("pos").collect()[1].fragment
    assert 'class="response english"' in plain and "<strong>Response:</strong>" in plain
    frag = ev.report_rows(res).orderBy("pos").collect()
    assert frag[0].fragment == "<h2>📂 Basic Talk</h2>"
    assert 'class="prompt english"' in frag[1].fragment


def test_collect_by_category(spark):
    df = spark.createDataFrame([("c", 2, "b"), ("c", 1, "a")], "category string, pos int, prompt string")
    r = ev.collect_by_category(df, "category", "pos", ["prompt"]).first()
    assert [x.prompt for x in r["items"]] == ["a", "b"] and r.n_items == 2


def test_metrics_file_golden_shares(spark):
    # 28 answers of our own built to the published counts 28 / 7 / 28 / 8 / 2.
    base = "این پاسخ درباره موضوع پرسیده شده است و جزئیات بیشتری هم دارد"
    rows = []
    for i in range(28):
        r = base
        if i < 7:
            r += " ممنون"
        if 7 <= i < 15:
            r += " !"
        if i in (20, 21):
            r += " 😂"
        rows.append((r,))
    df = spark.createDataFrame(rows, "response string")
    lines = [r.line for r in ev.metrics_lines(ev.response_metrics(df)).orderBy("line_no").collect()]
    assert lines[3:] == ["persian_only: 100.0%", "friendly_tone: 25.0%", "helpful_content: 100.0%",
                         "creative_elements: 28.6%", "emoji_usage: 7.1%"]


def test_personality_templates_take_system_text(spark):
    from corpuskit.sources.suites import PERSONALITY_TEMPLATES
    p = spark.createDataFrame([("پرسش {system}",)], "prompt string")
    r = ev.render_prompts(p, "prompt", PERSONALITY_TEMPLATES, system="SYS").orderBy("template_pos").collect()
    assert "SYS" in r[0].rendered and "پرسش {system}" in r[0].rendered  # prompt inserted last, verbatim
    assert "{prompt}" not in r[3].rendered and r[3].rendered.startswith("<|system|>\nSYS")


def test_plain_variant_through_the_plan(spark):
    prompts = spark.createDataFrame([("c", 0, 0, "q"), ("c", 0, 1, "r")], "category string, cat_pos int, pos int, prompt string")
    cands = spark.createDataFrame([(0, 0, "x", "short"), (0, 1, "x", "a longer english answer"), (1, 0, "x", "")],
                                  "pos int, template_pos int, rendered string, output string")
    out = evaluate_candidates(prompts, cands, gate=False, fallback=[tx.PLAIN_FALLBACK])
    got = {r.pos: r.response for r in out["results"].collect()}
    assert got == {0: "a longer english answer", 1: tx.PLAIN_FALLBACK}
