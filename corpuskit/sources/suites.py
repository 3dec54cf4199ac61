"""Literal ordered tables: prompt suites and prompt templates."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# The plain evaluation variant's four templates, in order.
PLAIN_TEMPLATES = {
    "instruction": "### Instruction:\n{prompt}\n\n### Response:\n",
    "conversational": "User: {prompt}\nAssistant:",
    "qa": "Question: {prompt}\nAnswer:",
    "creative": "### Task: {prompt}\n\n### Output:\n",
}
# The personality variant's four templates, in order; the
# system text is supplied by the caller through the {system} hole.
PERSONALITY_TEMPLATES = {
    "persian_personality": "### سیستم:\n{system}\n\n### کاربر:\n{prompt}\n\n### دستیار فارسی:\n",
    "friendly_chat": "👤 کاربر: {prompt}\n\n🤖 دستیار فارسی (دوستانه و خوش‌برخورد):",
    "creative_mode": "🎭 **حالت خلاقانه فعال شد**\n📋 دستور سیستم: {system}\n\n💬 درخواست کاربر: «{prompt}»\n\n✨ پاسخ من (به فارسی دوستانه):",
    "instruction_following": "<|system|>\n{system}\n<|user|>\n{prompt}\n<|assistant|>",
}


def prompt_suite(spark: SparkSession, suite: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(category, cat_pos, pos, prompt)`` keeping category and prompt order."""
    rows, pos = [], 0
    for cat_pos, (cat, prompts) in enumerate(suite.items()):
        for p in prompts:
            rows.append((cat, cat_pos, pos, p))
            pos += 1
    return spark.createDataFrame(rows, "category string, cat_pos int, pos int, prompt string")


def template_set(spark: SparkSession, templates: Mapping[str, str] = PLAIN_TEMPLATES) -> DataFrame:
    rows = [(name, i, body) for i, (name, body) in enumerate(templates.items())]
    return spark.createDataFrame(rows, "template string, template_pos int, body string")
