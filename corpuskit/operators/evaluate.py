"""Response evaluation: prompt rendering, candidate selection, metrics and
report rows.

Selection is an aggregation (``max`` over ``struct(length, -template_pos,
output)``), so it combines map-side and a prompt with very many candidates
never lands unaggregated in one task.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.segments import ROWS_PER_BUCKET, range_bucket, with_position
from corpuskit.functions import text as tx
from corpuskit.sources.suites import PLAIN_TEMPLATES

# Labels and headings of the report and metrics outputs.
METRICS_TITLE = "شاخص‌های شخصیت مدل فارسی"
RULE = "=" * 50
PROMPT_LABEL = "پرسش:"
RESPONSE_LABEL = "پاسخ:"
PLAIN_PROMPT_LABEL = "Prompt:"
PLAIN_RESPONSE_LABEL = "Response:"
SUMMARY_TITLE = "Persian Language Model Evaluation Summary"


def render_prompts(prompts: DataFrame, prompt_col: str = "prompt",
                   templates: Mapping[str, str] = PLAIN_TEMPLATES, system: str | None = None) -> DataFrame:
    """Every prompt rendered with every template: adds ``template``,
    ``template_pos`` and ``rendered``.  The template set is a short literal
    list, expanded per row by ``explode`` (no join)."""
    arr = F.array(*[F.struct(F.lit(name).alias("template"), F.lit(i).alias("template_pos"),
                             F.lit(body).alias("body"))
                    for i, (name, body) in enumerate(templates.items())])
    r = prompts.withColumn("_t", F.explode(arr))
    rendered = tx.render_template(F.col("_t.body"), F.col(prompt_col), system)
    return r.select("*", F.col("_t.template").alias("template"),
                    F.col("_t.template_pos").alias("template_pos"), rendered.alias("rendered")).drop("_t")


def best_candidate(candidates: DataFrame, key_cols: Sequence[str] | str, output_col: str = "output",
                   pos_col: str = "template_pos", letters: str = tx.PERSIAN_LETTERS, gate: bool = True,
                   fallback: Sequence[str] | None = tx.FALLBACK_RESPONSES, fallback_key: str | None = None,
                   prompts: DataFrame | None = None) -> DataFrame:
    """Per prompt: the longest candidate (gate: longer than 10 code points and
    a script letter), the first template winning ties; when none passes, a
    fallback answer picked by md5 of ``fallback_key`` (the prompt text, as the
    reference hashes the prompt; default the first key).

    Output: keys, ``best_template_pos`` (NULL for fallback), ``response``,
    ``is_fallback``.  With ``prompts`` the keys come from that table (left
    join), so prompts without any candidate get the fallback too.
    """
    keys = [key_cols] if isinstance(key_cols, str) else list(key_cols)
    out = F.col(output_col)
    ok = tx.candidate_ok(out, letters) if gate else F.coalesce(F.length(out) > 0, F.lit(False))
    cand = F.when(ok, F.struct(F.length(out).alias("len"), (-F.col(pos_col)).alias("neg_pos"),
                               out.alias("output")))
    best = candidates.groupBy(*keys).agg(F.max(cand).alias("_best"))
    extra = [fallback_key] if fallback_key and fallback_key not in keys else []
    if prompts is not None:
        best = prompts.select(*keys, *extra).join(best, keys, "left")
    elif extra:
        raise ValueError("a fallback_key outside the keys needs the prompts table")
    fk = F.col(fallback_key or keys[0])
    if fallback is None or len(fallback) == 0:
        fb = F.lit(None).cast("string")
    elif len(fallback) == 1:
        fb = F.lit(fallback[0])
    else:
        fb = tx.fallback_response(fk, fallback)
    return best.select(
        *keys, (-F.col("_best.neg_pos")).alias("best_template_pos"),
        F.coalesce(F.col("_best.output"), fb).alias("response"),
        F.col("_best").isNull().alias("is_fallback"))


def metric_columns(response, letters: str = tx.PERSIAN_LETTERS, friendly=tx.FRIENDLY_WORDS,
                   creative=tx.CREATIVE_MARKS, emoji=tx.EMOJI_MARKS, min_words: int = 10) -> dict[str, Column]:
    """The five predicates of the metric set plus ``latin_leak`` (Latin letters
    in an answer that counts as script-only)."""
    r = tx.col_of(response)
    return {
        "persian_only": tx.has_script(r, letters),
        "friendly_tone": tx.contains_any(r, friendly),
        "helpful_content": F.coalesce(tx.word_count(r) > min_words, F.lit(False)),
        "creative_elements": tx.contains_any(r, creative),
        "emoji_usage": tx.contains_any(r, emoji),
        "latin_leak": tx.has_ascii_alpha(r),
    }


METRIC_NAMES = ("persian_only", "friendly_tone", "helpful_content", "creative_elements", "emoji_usage")


def response_metrics(df: DataFrame, response_col: str = "response", by: str | None = None,
                     **lex) -> DataFrame:
    """Share (%) of responses meeting each predicate; empty input gives NULL.

    With ``by`` the result has one row per group (NULL is a group) plus the
    overall row, told apart by ``is_total``.  The predicates are counted once per
    group; the overall row adds the counts up.
    """
    preds = metric_columns(response_col, **lex)
    hits = [F.count(F.lit(1)).alias("n_responses")] + [F.count_if(p).alias(n) for n, p in preds.items()]
    shares = [F.round(F.try_divide(F.col(n), F.col("n_responses")) * 100, 6).alias(n) for n in preds]
    if by is None:
        return df.agg(*hits).select("n_responses", *shares)
    rolled = df.groupBy(by).agg(*hits).rollup(by).agg(
        (F.grouping(by) == 1).alias("is_total"), *[F.sum(n).alias(n) for n in ("n_responses", *preds)])
    return rolled.select(by, "is_total", "n_responses", *shares)


def _line(n: int, text: Column) -> Column:
    return F.struct(F.lit(n).cast("bigint").alias("line_no"), text.cast("string").alias("line"))


def metrics_long(metrics: DataFrame, names: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """Wide metric row(s) to ``(metric_pos, metric, score)`` rows."""
    st = ", ".join(f"{i}, '{n}', `{n}`" for i, n in enumerate(names))
    return metrics.selectExpr(f"stack({len(names)}, {st}) AS (metric_pos, metric, score)")


def metrics_lines(metrics: DataFrame, title: str = METRICS_TITLE, names: Sequence[str] = METRIC_NAMES) -> DataFrame:
    """The metrics file as ordered ``(line_no, line)`` rows: title, rule,
    blank, then ``metric: xx.x%`` lines."""
    body = metrics_long(metrics, names).select(
        (F.col("metric_pos") + 3).cast("bigint").alias("line_no"),
        tx.percent_text("metric", "score").alias("line"))
    head = metrics.select(F.inline(F.array(_line(0, F.lit(title)), _line(1, F.lit(RULE)), _line(2, F.lit("")))))
    return head.unionByName(body)


def response_stats(df: DataFrame, response_col: str = "response", by: str | None = None) -> DataFrame:
    """Characters per answer: count, min/avg/max length."""
    ln = F.length(F.col(response_col))
    aggs = [F.count(F.lit(1)).alias("n_responses"), F.min(ln).cast("bigint").alias("min_chars"),
            F.round(F.avg(ln), 6).alias("avg_chars"), F.max(ln).cast("bigint").alias("max_chars")]
    return (df.groupBy(by) if by else df).agg(*aggs)


def collect_by_category(df: DataFrame, category_col: str, pos_col: str, cols: Sequence[str]) -> DataFrame:
    """Nest ordered items per category: ``items`` = array of structs sorted by
    ``pos_col``.  Meant for report-sized groups (a suite category, one
    conversation); for open-ended groups there is :func:`collect_chunks`."""
    items = F.array_sort(F.collect_list(F.struct(F.col(pos_col), *[F.col(c) for c in cols])))
    return df.groupBy(category_col).agg(items.alias("items"), F.count(F.lit(1)).alias("n_items"))


def collect_chunks(df: DataFrame, category_col: str, pos_col: str, cols: Sequence[str], size: int = 1000,
                   bucket_rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """The nested lists of :func:`collect_by_category` in rows of at most ``size``
    items: ``(category, chunk, items, n_items)``, chunks 0, 1, ... in order.  No
    category is ever one row or one task: positions come from a segmented count
    over buckets of ``pos_col`` (a number, date or timestamp, unique per category),
    and the lists are gathered by (category, chunk)."""
    placed = with_position(df.select(category_col, pos_col, *[c for c in cols if c not in (category_col, pos_col)]),
                           [category_col], pos_col, range_bucket(df, pos_col, bucket_rows), "_place")
    items = F.array_sort(F.collect_list(F.struct(F.col(pos_col), *[F.col(c) for c in cols])))
    chunk = F.floor((F.col("_place") - 1) / size).cast("bigint").alias("chunk")
    return placed.groupBy(category_col, chunk).agg(items.alias("items"), F.count(F.lit(1)).alias("n_items"))


def report_rows(results: DataFrame, category_col: str = "category", cat_pos_col: str = "cat_pos",
                pos_col: str = "pos", prompt_col: str = "prompt", response_col: str = "response",
                plain: bool = False) -> DataFrame:
    """Report body as ordered fragments ``(cat_pos, pos, fragment)``: one
    heading per category (``pos`` = -1) and one block per item with the
    prompt's script class and escaped texts.  ``plain``: the other report, with
    English labels and the response's own script class.  Write with
    ``sortWithinPartitions`` + ``write.text`` after a range partition."""
    ask, answer = (PLAIN_PROMPT_LABEL, PLAIN_RESPONSE_LABEL) if plain else (PROMPT_LABEL, RESPONSE_LABEL)
    answer_class = tx.script_class(response_col) if plain else F.lit("persian")
    heads = results.groupBy(cat_pos_col, category_col).agg(F.count(F.lit(1)).alias("_n")) \
        .select(F.col(cat_pos_col).alias("cat_pos"), F.lit(-1).cast("bigint").alias("pos"),
                F.concat(F.lit("<h2>📂 "), tx.category_title(category_col), F.lit("</h2>")).alias("fragment"))
    # The fragments of a report item.
    item = F.concat(
        F.lit('<div class="test-item"><div class="prompt '), tx.script_class(prompt_col),
        F.lit(f'">🗨️ <strong>{ask}</strong> '), tx.html_escape(prompt_col),
        F.lit('</div><div class="response '), answer_class, F.lit(f'">🤖 <strong>{answer}</strong>\n'),
        tx.html_escape(response_col), F.lit("</div></div>"))
    items = results.select(F.col(cat_pos_col).alias("cat_pos"), F.col(pos_col).cast("bigint").alias("pos"),
                           item.alias("fragment"))
    return heads.unionByName(items)


def summary_lines(results: DataFrame, category_col: str = "category", cat_pos_col: str = "cat_pos",
                  pos_col: str = "pos", prompt_col: str = "prompt", response_col: str = "response") -> DataFrame:
    """Text summary as ``(cat_pos, pos, line_no, line)``: title, rule and a blank
    line (``cat_pos`` = -1), per category a ``CATEGORY:`` line and rule
    (``pos`` = -1), per item PROMPT/RESPONSE lines and a rule, and a blank line
    after the category (``pos`` = its last one + 1)."""
    spark = results.sparkSession
    title = spark.range(1).select(F.lit(-1).cast("bigint").alias("cat_pos"), F.lit(-1).cast("bigint").alias("pos"), F.inline(F.array(
        _line(0, F.lit(SUMMARY_TITLE)), _line(1, F.lit(RULE)), _line(2, F.lit("")))))
    last = (F.max(pos_col).cast("bigint") + 1).alias("_end")
    ends = results.groupBy(cat_pos_col, category_col).agg(last).select(F.col(cat_pos_col).cast("bigint").alias("cat_pos"), category_col, "_end")
    heads = ends.select("cat_pos", F.lit(-1).cast("bigint").alias("pos"), F.inline(F.array(
        _line(0, F.concat(F.lit("CATEGORY: "), F.upper(category_col))), _line(1, F.lit("-" * 30)))))
    tails = ends.select("cat_pos", F.col("_end").alias("pos"), F.inline(F.array(_line(0, F.lit("")))))
    items = results.select(
        F.col(cat_pos_col).cast("bigint").alias("cat_pos"), F.col(pos_col).cast("bigint").alias("pos"),
        F.inline(F.array(_line(0, F.concat(F.lit("PROMPT: "), F.col(prompt_col))),
                         _line(1, F.concat(F.lit("RESPONSE: "), F.col(response_col))),
                         _line(2, F.lit("-" * 20)))))
    return title.unionByName(heads).unionByName(items).unionByName(tails)


__all__ = ["render_prompts", "best_candidate", "metric_columns", "response_metrics", "metrics_long",
           "metrics_lines", "response_stats", "collect_by_category", "collect_chunks", "report_rows", "summary_lines",
           "METRIC_NAMES", "METRICS_TITLE"]
