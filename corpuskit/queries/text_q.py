"""Text predicates/projections over driver tables (Latin profile letters)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.functions import text as tx
from corpuskit.queries.common import LETTERS, WS, contains_any, has_script, strip, table, valid

ECHO_REPLACED = "replace(output, prompt, '')"
ROUTE_SQL_SCRIPT = tx.ROUTE_PREFIX_SCRIPT.replace("'", "''")


def q_has_script(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.has_script("text", LETTERS).alias("has_script"))


def q_valid_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.is_valid_text("text", LETTERS).alias("is_valid"))


def q_usable_string(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.usable_string("text").alias("usable"))


def q_strip_text(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", tx.ustrip("text").alias("stripped"),
                    F.length(tx.ustrip("text")).cast("bigint").alias("stripped_len"))


def q_script_class(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", tx.script_class("text").alias("script_class"))


def q_html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", tx.html_escape("html").alias("escaped"))


def q_category_title(spark, d):
    return table(spark, d, "events").select("event_id", tx.category_title("event_type").alias("title"))


def q_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.preview("text", 50).alias("preview"))


def _pairs(spark, d):
    """User turn (prompt) and the following assistant turn (reply) of a conversation."""
    c = table(spark, d, "conversations")
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    p = u.join(a, ["conv_id", "turn"])
    # A generated output echoes its prompt for even conversations.
    return p.withColumn("output", F.when(F.pmod("conv_id", F.lit(2)) == 0,
                                         F.concat("prompt", F.lit(" "), "reply"))
                        .otherwise(F.col("reply")))


PAIRS_SQL = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS reply,
         CASE WHEN u.conv_id % 2 = 0 THEN u.text || ' ' || a.text ELSE a.text END AS output
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


def q_strip_echo_all(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", tx.strip_echo_all("output", "prompt").alias("answer"))


def q_strip_echo_prefix(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", tx.strip_echo_prefix("output", "prompt").alias("answer"))


def q_route_prompt(spark, d):
    c = table(spark, d, "conversations").where(F.col("role") == "user")
    c = c.where(F.length(tx.ustrip("text")) > 0)
    return c.select("conv_id", "turn", tx.route_prompt("text", LETTERS).alias("routed"))


def q_stamp(spark, d):
    return table(spark, d, "events").select("event_id", tx.stamp("ts").alias("stamp"))


QUERIES = {
    "has_script": q_has_script,
    "valid_text": q_valid_text,
    "usable_string": q_usable_string,
    "strip_text": q_strip_text,
    "script_class": q_script_class,
    "html_escape": q_html_escape,
    "category_title": q_category_title,
    "preview": q_preview,
    "strip_echo_all": q_strip_echo_all,
    "strip_echo_prefix": q_strip_echo_prefix,
    "route_prompt": q_route_prompt,
    "stamp": q_stamp,
}

SQL = {
    "has_script": f"SELECT doc_id, {has_script('text')} AS has_script FROM documents",
    "valid_text": f"SELECT doc_id, {valid('text')} AS is_valid FROM documents",
    "usable_string": "SELECT doc_id, coalesce(text IS NOT NULL AND text <> '', false) AS usable FROM documents",
    "strip_text": f"SELECT doc_id, {strip('text')} AS stripped, CAST(length({strip('text')}) AS BIGINT) AS stripped_len FROM documents",
    "script_class": "SELECT conv_id, turn, CASE WHEN coalesce(regexp_matches(text, '[A-Za-z]'), false) "
                    "THEN 'english' ELSE 'persian' END AS script_class FROM conversations",
    "html_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), "
                   "'>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages",
    "category_title": "SELECT event_id, array_to_string(list_transform(string_split(replace(event_type, '_', ' '), ' '), "
                      "lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM events",
    "preview": "SELECT doc_id, substr(text, 1, 50) || '...' AS preview FROM documents",
    "strip_echo_all": f"WITH {PAIRS_SQL} SELECT conv_id, turn, "
                      f"CASE WHEN prompt IS NULL OR prompt = '' THEN {strip('output')} "
                      f"ELSE {strip(ECHO_REPLACED)} END AS answer FROM pairs",
    "strip_echo_prefix": f"WITH {PAIRS_SQL} SELECT conv_id, turn, "
                         f"CASE WHEN starts_with(output, prompt) THEN {strip('substr(output, length(prompt) + 1)')} "
                         f"ELSE output END AS answer FROM pairs",
    "route_prompt": f"SELECT conv_id, turn, CASE WHEN {has_script(strip('text'))} "
                    f"THEN '{ROUTE_SQL_SCRIPT}' || {strip('text')} "
                    f"ELSE '{tx.ROUTE_PREFIX_OTHER}' || {strip('text')} END AS routed "
                    f"FROM conversations WHERE role = 'user' AND length({strip('text')}) > 0",
    "stamp": "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events",
}
