"""Evaluation plan: candidate answers -> echo removal -> best per prompt
(with fallback) -> metrics, report fragments, metrics lines, summary lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from corpuskit.functions import text as tx
from corpuskit.operators import evaluate as ev
from corpuskit.operators import ordering as od


def evaluate_candidates(prompts: DataFrame, candidates: DataFrame, letters: str = tx.PERSIAN_LETTERS,
                        gate: bool = True, fallback=tx.FALLBACK_RESPONSES, **lex) -> dict[str, DataFrame]:
    """``prompts(category, cat_pos, pos, prompt)``; ``candidates(pos,
    template_pos, rendered, output)`` with the raw generated output.

    The rendered prompt is removed from each output (every occurrence), the
    best candidate chosen per prompt, then metrics and report rows built.
    """
    c = candidates.withColumn("output", tx.strip_echo_all("output", "rendered"))
    best = ev.best_candidate(c, "pos", "output", "template_pos", letters=letters, gate=gate,
                             fallback=fallback, fallback_key="prompt", prompts=prompts.select("pos", "prompt"))
    results = prompts.join(best.drop("prompt"), "pos").select("category", "cat_pos", "pos", "prompt", "response",
                                               "best_template_pos", "is_fallback")
    metrics = ev.response_metrics(results, "response", letters=letters, **lex)
    return {
        "results": results,
        "metrics": metrics,
        "metrics_by_category": ev.response_metrics(results, "response", by="category", letters=letters, **lex),
        "report_rows": ev.report_rows(results),
        "metrics_lines": ev.metrics_lines(metrics),
        "summary_lines": ev.summary_lines(results),
        "preview": od.head_per_group(results, "category", "pos", 2).select(
            "category", "pos", tx.preview("prompt", 60).alias("prompt_preview"),
            tx.preview("response", 100).alias("response_preview")),
    }
