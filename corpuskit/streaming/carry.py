"""The shuffle buffer over a whole stream: windows don't end with a micro-batch.

Rows are numbered over all micro-batches in arrival order.  A micro-batch gives
out the windows that are full by then; the rows of the last, unfinished window
(fewer than one buffer) are written for the next one, with the number of rows seen.
So ten small files give the windows of one large file, wherever micro-batches end,
and a restart goes on in the middle of a window.

Micro-batch k reads only what k-1 left, and overwrites its own folder: replayed
after a failure it gives the same rows again.  The last two folders are kept.
No row passes through a single keyed state: numbering is the range row index,
the place in the window an expression over the number.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.operators import ordering as od
from corpuskit.streaming.ingest import resume_point


def _folder(carry_dir: str, batch_id: int) -> str:
    return f"{carry_dir.rstrip('/')}/after={batch_id}"


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _left(spark: SparkSession, carry_dir: str, batch_id: int) -> tuple[DataFrame, int]:
    """The unfinished window after micro-batch ``batch_id``, and the rows seen by then."""
    at = _folder(carry_dir, batch_id)
    return spark.read.parquet(at + "/rows"), spark.read.parquet(at + "/seen").first()[0]


def carried_shuffle(carry_dir: str, buffer: int = 5000, seed: int = 42, batch_size: int = 32,
                    key_col: str = "file_path") -> Callable[[DataFrame, int], DataFrame]:
    """Per micro-batch transform for :func:`ingest_stream`: the windows that are
    full after this micro-batch, shuffled and cut into batches as
    :func:`windowed_shuffle` and :func:`micro_batches` do for the whole input.
    ``idx`` and ``window_id`` count over the stream.  The rest of the rows comes
    with a later micro-batch or from :func:`carried_rest`.  ``carry_dir`` is a
    shared folder of this stream alone."""
    def transform(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        # Arrival positions are written once: the index sorts by them.
        rows = batch.withColumn("_pos", F.monotonically_increasing_id()).checkpoint(eager=True)
        rows = od.with_row_index_range(rows, [key_col, "_pos"], "idx").drop("_pos")
        before = 0
        if batch_id:
            left, before = _left(spark, carry_dir, batch_id - 1)
            rows = left.unionByName(rows.withColumn("idx", F.col("idx") + before))
        seen = max(before, rows.agg(F.max("idx")).first()[0] or 0)
        whole = seen // buffer * buffer
        at = _folder(carry_dir, batch_id)
        rows.where(F.col("idx") > whole).write.mode("overwrite").parquet(at + "/rows")
        spark.range(1).select(F.lit(seen).cast("bigint").alias("seen")).write.mode("overwrite").parquet(at + "/seen")
        _drop(spark, _folder(carry_dir, batch_id - 2))
        full = od.windowed_shuffle(rows.where(F.col("idx") <= whole), "idx", buffer=buffer, seed=seed, n=whole)
        return od.micro_batches(full, batch_size)
    return transform


def carried_rest(spark: SparkSession, carry_dir: str, checkpoint_dir: str, buffer: int = 5000, seed: int = 42,
                 batch_size: int = 32) -> DataFrame | None:
    """The last, unfinished window, shuffled: what a stream that has ended still
    holds after its last committed micro-batch.  None if it never committed one.
    Nothing is changed: if the stream goes on, these rows come again in their full window."""
    last = resume_point(spark, checkpoint_dir)
    if last is None:
        return None
    left, seen = _left(spark, carry_dir, last)
    return od.micro_batches(od.windowed_shuffle(left, "idx", buffer=buffer, seed=seed, n=seen), batch_size)
