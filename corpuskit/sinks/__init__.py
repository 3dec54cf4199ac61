"""Sinks: training examples, run manifest/metadata, ordered text outputs."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_examples(df: DataFrame, path: str, partition_by: str | None = "split",
                   mode: str = "overwrite") -> None:
    """Training examples as Parquet (optionally partitioned by split)."""
    w = df.write.mode(mode)
    if partition_by and partition_by in df.columns:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def _one_row_json(spark: SparkSession, record: Mapping, path: str) -> None:
    # A single small record: one JSON object, written as one part file.
    spark.createDataFrame([(json.dumps(dict(record), ensure_ascii=False, default=str),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)


def write_manifest(spark: SparkSession, config: Mapping, path: str, start_time: datetime | None = None,
                   flags: Mapping | None = None) -> None:
    """Run configuration: the arguments, a start time and extra flags."""
    rec = dict(config)
    rec["start_time"] = (start_time or datetime.now(timezone.utc)).isoformat()
    rec.update(flags or {})
    _one_row_json(spark, rec, path)


def write_run_metadata(spark: SparkSession, metadata: Mapping, path: str) -> None:
    """Completion record: duration, completed_at, steps, loss, parameters, history."""
    rec = dict(metadata)
    rec.setdefault("completed_at", datetime.now(timezone.utc).isoformat())
    _one_row_json(spark, rec, path)


def write_ordered_text(df: DataFrame, path: str, order_cols, text_col: str = "line",
                       num_partitions: int | None = None) -> None:
    """Write text rows in global order: range partition on the order key,
    sort inside partitions; part files are then in order (no single task)."""
    cols = [order_cols] if isinstance(order_cols, str) else list(order_cols)
    d = df.repartitionByRange(num_partitions, *cols) if num_partitions else df.repartitionByRange(*cols)
    d.sortWithinPartitions(*cols).select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


__all__ = ["write_examples", "write_manifest", "write_run_metadata", "write_ordered_text"]
