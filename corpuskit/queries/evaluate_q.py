"""Evaluation queries over ``conversations`` (user turns = prompts, assistant
turns = candidate answers), with a Latin-script profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.operators import evaluate as ev
from corpuskit.queries.common import LETTERS, contains_any, has_script, hash_pick, strip, table, tokens
from corpuskit.sources.suites import PLAIN_TEMPLATES

# Lexicons of the Latin profile (the driver tables hold no Persian text).
FRIENDLY_LATIN = ("bien", "gut", "gracias", "thank")
CREATIVE_LATIN = ("!", "?", "...", "é", "ü")
EMOJI_LATIN = ("ß", "ñ", "ç")
LEX = dict(letters=LETTERS, friendly=FRIENDLY_LATIN, creative=CREATIVE_LATIN, emoji=EMOJI_LATIN)


def _conv(spark, d):
    return table(spark, d, "conversations")


def _answers(spark, d):
    return _conv(spark, d).where(F.col("role") == "assistant")


def _turns(spark, d):
    """Every user turn with the assistant turn after it (NULL where there is none)."""
    c = _conv(spark, d)
    replies = c.where(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt")).join(replies, ["conv_id", "turn"], "left")


def _results(spark, d):
    return _turns(spark, d).select(
        F.concat(F.lit("conversation_"), F.col("conv_id").cast("string")).alias("category"),
        F.col("conv_id").alias("cat_pos"), F.col("turn").alias("pos"),
        "prompt", F.coalesce("reply", tx.fallback_response("prompt")).alias("response"))


def q_render_prompts(spark, d):
    u = _conv(spark, d).where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    r = ev.render_prompts(u, "prompt", PLAIN_TEMPLATES)
    return r.select("conv_id", "turn", F.col("template_pos").cast("bigint").alias("template_pos"), "rendered")


def q_fallback_response(spark, d):
    c = _conv(spark, d).select("conv_id").distinct()
    return c.select("conv_id", tx.fallback_response(F.col("conv_id")).alias("fallback"))


def q_best_candidate(spark, d):
    cands = _answers(spark, d).select("conv_id", F.col("turn").alias("template_pos"), F.col("text").alias("output"))
    prompts = _conv(spark, d).select("conv_id").distinct()
    return ev.best_candidate(cands, "conv_id", letters=LETTERS, prompts=prompts)


def q_response_metrics(spark, d):
    return ev.response_metrics(_answers(spark, d), "text", **LEX)


def q_response_metrics_by_role(spark, d):
    return ev.response_metrics(_conv(spark, d), "text", by="role", **LEX)


def q_response_stats(spark, d):
    return ev.response_stats(_conv(spark, d), "text", by="role")


def q_collect_by_category(spark, d):
    g = ev.collect_by_category(_conv(spark, d), "conv_id", "turn", ["role"])
    return g.select("conv_id", "n_items", F.array_join(F.transform("items", lambda x: x["role"]), ",").alias("roles"))


def q_collect_chunks(spark, d):
    """Items of each order status in rows of 500, whatever the status's size."""
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey")
    g = ev.collect_chunks(o, "o_orderstatus", "o_orderkey", [], 500, bucket_rows=2000)
    keys = F.transform("items", lambda x: x["o_orderkey"].cast("string"))
    return g.select("o_orderstatus", "chunk", "n_items", F.array_join(keys, ",").alias("keys"))


def q_report_rows(spark, d):
    return ev.report_rows(_results(spark, d))


def q_report_rows_plain(spark, d):
    return ev.report_rows(_results(spark, d), plain=True)


def q_metrics_lines(spark, d):
    return ev.metrics_lines(ev.response_metrics(_answers(spark, d), "text", **LEX))


def q_summary_lines(spark, d):
    return ev.summary_lines(_results(spark, d))


def _eval_inputs(spark, d):
    """Prompts = user turns; candidates = the lines of the following reply
    (line index as template position), rendered prompt = the user text."""
    p = _turns(spark, d)
    key = (F.col("conv_id") * (1 << 32) + F.col("turn")).alias("pos")
    prompts = p.select(F.concat(F.lit("conversation_"), F.col("conv_id").cast("string")).alias("category"),
                       F.col("conv_id").alias("cat_pos"), key, "prompt")
    cands = p.select(key, F.col("prompt").alias("rendered"),
                     F.posexplode(F.split("reply", "\n")).alias("template_pos", "output"))
    return prompts, cands


def _evaluation(spark, d):
    from corpuskit.plans.evaluation import evaluate_candidates
    prompts, cands = _eval_inputs(spark, d)
    return evaluate_candidates(prompts, cands, letters=LETTERS, friendly=FRIENDLY_LATIN,
                               creative=CREATIVE_LATIN, emoji=EMOJI_LATIN)


def q_evaluation_results(spark, d):
    r = _evaluation(spark, d)["results"]
    return r.select("cat_pos", "pos", F.col("best_template_pos").cast("bigint").alias("best_template_pos"),
                    "is_fallback", "response")


def q_evaluation_metrics(spark, d):
    return _evaluation(spark, d)["metrics_by_category"].where("is_total").drop("category", "is_total")


QUERIES = {
    "evaluation_results": q_evaluation_results,
    "evaluation_metrics": q_evaluation_metrics,
    "render_prompts": q_render_prompts,
    "fallback_response": q_fallback_response,
    "best_candidate": q_best_candidate,
    "response_metrics": q_response_metrics,
    "response_metrics_by_role": q_response_metrics_by_role,
    "response_stats": q_response_stats,
    "collect_by_category": q_collect_by_category,
    "collect_chunks": q_collect_chunks,
    "report_rows": q_report_rows,
    "report_rows_plain": q_report_rows_plain,
    "metrics_lines": q_metrics_lines,
    "summary_lines": q_summary_lines,
}


ECHO_RENDERED = "replace(output, rendered, '')"


def _sq(s: str) -> str:
    return s.replace("'", "''")


def _metric_select(x: str) -> str:
    preds = {
        "persian_only": has_script(x),
        "friendly_tone": contains_any(x, FRIENDLY_LATIN),
        "helpful_content": f"coalesce(len({tokens(x)}) > 10, false)",
        "creative_elements": contains_any(x, CREATIVE_LATIN),
        "emoji_usage": contains_any(x, EMOJI_LATIN),
        "latin_leak": "coalesce(regexp_matches(%s, '[A-Za-z]'), false)" % x,
    }
    return "count(*) AS n_responses, " + ", ".join(
        f"round(avg(CASE WHEN {p} THEN 1.0 ELSE 0.0 END) * 100, 6) AS {n}" for n, p in preds.items())


TEMPLATES_SQL = " UNION ALL ".join(
    f"SELECT {i} AS template_pos, '{_sq(b)}' AS body" for i, b in enumerate(PLAIN_TEMPLATES.values()))
FALLBACK_SQL = "[" + ", ".join(f"'{_sq(t)}'" for t in tx.FALLBACK_RESPONSES) + "]"
RESULTS_SQL = f"""results AS (SELECT 'conversation_' || CAST(u.conv_id AS VARCHAR) AS category, u.conv_id AS cat_pos, u.turn AS pos,
                   u.text AS prompt, coalesce(a.text, ({FALLBACK_SQL})[{hash_pick('u.text', 3)} + 1]) AS response
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def _esc(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
            f"'\"', '&quot;'), '''', '&#x27;')")


def _class(x: str) -> str:
    return f"CASE WHEN coalesce(regexp_matches({x}, '[A-Za-z]'), false) THEN 'english' ELSE 'persian' END"


def _item(ask: str, answer: str, answer_class: str) -> str:
    return ("'<div class=\"test-item\"><div class=\"prompt ' || " + _class("prompt") + " || '\">🗨️ <strong>" + ask + "</strong> ' || "
            + _esc("prompt") + " || '</div><div class=\"response ' || " + answer_class + " || '\">🤖 <strong>" + answer
            + "</strong>' || chr(10) || " + _esc("response") + " || '</div></div>'")


def _report(item: str) -> str:
    return f"""WITH {RESULTS_SQL}
        SELECT DISTINCT cat_pos, -1::BIGINT AS pos, '<h2>📂 ' || {TITLE_SQL} || '</h2>' AS fragment FROM results
        UNION ALL SELECT cat_pos, pos, {item} FROM results"""


TITLE_SQL = ("array_to_string(list_transform(string_split(replace(category, '_', ' '), ' '), "
             "lambda w: upper(w[1]) || lower(w[2:])), ' ')")

EVAL_SQL = f"""u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, text FROM conversations WHERE role = 'assistant'),
p AS (SELECT conv_id AS cat_pos, conv_id * 4294967296 + turn AS pos, text AS prompt FROM u),
lines AS (SELECT u.conv_id * 4294967296 + u.turn AS pos, u.text AS rendered,
                 unnest(string_split(a.text, chr(10))) AS output,
                 generate_subscripts(string_split(a.text, chr(10)), 1) - 1 AS template_pos
          FROM u JOIN a USING (conv_id, turn)),
c AS (SELECT pos, template_pos, CASE WHEN rendered IS NULL OR rendered = '' THEN {strip('output')}
                                     ELSE {strip(ECHO_RENDERED)} END AS output FROM lines),
ok AS (SELECT * FROM c WHERE coalesce(length(output) > 10, false) AND {has_script('output')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY length(output) DESC, template_pos) AS r FROM ok),
res AS (SELECT p.cat_pos, p.pos, b.template_pos AS best_template_pos, b.output IS NULL AS is_fallback,
               coalesce(b.output, ({FALLBACK_SQL})[{hash_pick('p.prompt', 3)} + 1]) AS response
        FROM p LEFT JOIN (SELECT * FROM ranked WHERE r = 1) b ON b.pos = p.pos)"""

SQL = {
    "evaluation_results": f"WITH {EVAL_SQL} SELECT * FROM res",
    "evaluation_metrics": f"WITH {EVAL_SQL} SELECT {_metric_select('response')} FROM res",
    "render_prompts": f"""WITH t AS ({TEMPLATES_SQL})
        SELECT c.conv_id, c.turn, CAST(t.template_pos AS BIGINT) AS template_pos, replace(t.body, '{{prompt}}', c.text) AS rendered
        FROM conversations c, t WHERE c.role = 'user'""",
    "fallback_response": f"SELECT conv_id, ({FALLBACK_SQL})[{hash_pick('conv_id', 3)} + 1] AS fallback "
                         f"FROM (SELECT DISTINCT conv_id FROM conversations)",
    "best_candidate": f"""WITH c AS (SELECT conv_id, turn AS template_pos, text AS output FROM conversations WHERE role = 'assistant'),
        ok AS (SELECT * FROM c WHERE coalesce(length(output) > 10, false) AND {has_script('output')}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY length(output) DESC, template_pos) AS r FROM ok),
        p AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT p.conv_id, b.template_pos AS best_template_pos,
               coalesce(b.output, ({FALLBACK_SQL})[{hash_pick('p.conv_id', 3)} + 1]) AS response,
               b.output IS NULL AS is_fallback
        FROM p LEFT JOIN (SELECT * FROM ranked WHERE r = 1) b ON b.conv_id = p.conv_id""",
    "response_metrics": f"SELECT {_metric_select('text')} FROM conversations WHERE role = 'assistant'",
    "response_metrics_by_role": f"SELECT role, grouping(role) = 1 AS is_total, {_metric_select('text')} FROM conversations GROUP BY ROLLUP (role)",
    "response_stats": "SELECT role, count(*) AS n_responses, CAST(min(length(text)) AS BIGINT) AS min_chars, "
                      "round(avg(length(text)), 6) AS avg_chars, CAST(max(length(text)) AS BIGINT) AS max_chars "
                      "FROM conversations GROUP BY role",
    "collect_by_category": "SELECT conv_id, count(*) AS n_items, string_agg(role, ',' ORDER BY turn) AS roles "
                           "FROM conversations GROUP BY conv_id",
    "collect_chunks": """WITH p AS (SELECT o_orderstatus, o_orderkey, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 500 AS chunk
          FROM orders)
        SELECT o_orderstatus, chunk, count(*) AS n_items, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys FROM p GROUP BY ALL""",
    "report_rows": _report(_item(ev.PROMPT_LABEL, ev.RESPONSE_LABEL, "'persian'")),
    "report_rows_plain": _report(_item(ev.PLAIN_PROMPT_LABEL, ev.PLAIN_RESPONSE_LABEL, _class("response"))),
    "metrics_lines": f"""WITH m AS (SELECT {_metric_select('text')} FROM conversations WHERE role = 'assistant'),
        l AS (SELECT 0 AS p, 'persian_only' AS n, persian_only AS v FROM m UNION ALL SELECT 1, 'friendly_tone', friendly_tone FROM m
              UNION ALL SELECT 2, 'helpful_content', helpful_content FROM m UNION ALL SELECT 3, 'creative_elements', creative_elements FROM m
              UNION ALL SELECT 4, 'emoji_usage', emoji_usage FROM m)
        SELECT 0::BIGINT AS line_no, '{ev.METRICS_TITLE}' AS line UNION ALL SELECT 1, '{ev.RULE}' UNION ALL SELECT 2, ''
        UNION ALL SELECT CAST(p + 3 AS BIGINT), printf('%s: %.1f%%', n, v) FROM l""",
    "summary_lines": f"""WITH {RESULTS_SQL}
        SELECT -1::BIGINT AS cat_pos, -1::BIGINT AS pos, 0::BIGINT AS line_no, '{ev.SUMMARY_TITLE}' AS line UNION ALL SELECT -1, -1, 1, '{ev.RULE}'
        UNION ALL SELECT -1, -1, 2, '' UNION ALL SELECT cat_pos, max(pos) + 1, 0, '' FROM results GROUP BY cat_pos
        UNION ALL SELECT DISTINCT cat_pos, -1, 0, 'CATEGORY: ' || upper(category) FROM results
        UNION ALL SELECT DISTINCT cat_pos, -1, 1, '{'-' * 30}' FROM results
        UNION ALL SELECT cat_pos, pos, 0, 'PROMPT: ' || prompt FROM results
        UNION ALL SELECT cat_pos, pos, 1, 'RESPONSE: ' || response FROM results
        UNION ALL SELECT cat_pos, pos, 2, '{'-' * 20}' FROM results""",
}
