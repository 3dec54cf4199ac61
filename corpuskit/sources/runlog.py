"""Run-log source: ``yyyy-MM-dd HH:mm:ss,SSS - LEVEL - [logger] - message`` lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the log line layout written by the training scripts.
LOG_PATTERN = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - ([A-Z]+) - \[([^\]]*)\] - (.*)$"
LOG_TS_FORMAT = "yyyy-MM-dd HH:mm:ss,SSS"


def parse_log(df: DataFrame, value_col: str = "value") -> DataFrame:
    """Split log lines into ``ts, level, logger, message``; lines that do not
    match keep NULLs (``parsed = false``) so nothing is dropped silently."""
    v = F.col(value_col)
    ok = v.rlike(LOG_PATTERN)
    return df.select(
        "*",
        F.when(ok, F.to_timestamp(F.regexp_extract(v, LOG_PATTERN, 1), LOG_TS_FORMAT)).alias("ts"),
        F.when(ok, F.regexp_extract(v, LOG_PATTERN, 2)).alias("level"),
        F.when(ok, F.regexp_extract(v, LOG_PATTERN, 3)).alias("logger"),
        F.when(ok, F.regexp_extract(v, LOG_PATTERN, 4)).alias("message"),
        ok.alias("parsed"),
    )


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Read log files as a table with the input ``line_no`` of each line."""
    from corpuskit.sources.jsonl import read_jsonl_lines
    lines = read_jsonl_lines(spark, path, line_numbers=True).withColumnRenamed("line", "value")
    return parse_log(lines)
