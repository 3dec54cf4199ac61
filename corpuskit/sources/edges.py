"""Edge-list source: first line ``N M``, then ``a b`` vertex pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges ``(eid, src, dst)`` of a whitespace-separated edge file.

    The header line (``N M``) is skipped; every edge line present is read
    (the header count is not used to cut the list).  ``eid`` is the 0-based
    position of the edge among the edges of the file (blank lines don't count),
    computed without a global window.
    """
    from corpuskit.operators.ordering import with_input_index
    from corpuskit.sources.jsonl import read_jsonl_lines
    lines = with_input_index(read_jsonl_lines(spark, path), "line_no")
    parts = F.split(F.col("line"), r"\s+")
    edges = lines.where(F.col("line_no") > 1).select(
        (F.col("line_no") - 2).alias("eid"),
        parts.getItem(0).cast("bigint").alias("src"),
        parts.getItem(1).cast("bigint").alias("dst"))
    return edges
