"""Watermarked resource monitor over a stream of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.telemetry import with_limits


def monitor_stream(samples: DataFrame, ts_col: str = "ts", width: str = "1 hour",
                   watermark: str = "10 minutes", **limits) -> DataFrame:
    """Per tumbling window: sample count, mean/max CPU and breach count.

    Rows later than the watermark are dropped from their (already emitted)
    window; in append mode a window is emitted once the watermark passes it.
    """
    s = with_limits(samples.withWatermark(ts_col, watermark), **limits)
    g = s.groupBy(F.window(F.col(ts_col), width).alias("w")).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.round(F.avg("cpu_usage"), 6).alias("avg_cpu"),
        F.round(F.max("cpu_usage"), 6).alias("max_cpu"),
        F.count_if(~F.col("within_limits")).alias("n_breaches"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    "n_samples", "avg_cpu", "max_cpu", "n_breaches")
