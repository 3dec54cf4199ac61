"""Incremental JSON-lines ingestion.

The corpus directory is a file stream source (new files are picked up,
nothing is held in memory beyond a micro-batch).  Each micro-batch runs the
batch ingestion operators inside ``foreachBatch`` and overwrites its own
``batch_id=`` directory, so a batch replayed after a failure replaces its
earlier output instead of duplicating it; the checkpoint location records
which files were consumed, so a restart resumes where it stopped.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuskit.functions.text import PERSIAN_LETTERS, ustrip
from corpuskit.operators.extract import extract_text
from corpuskit.session import ensure_checkpoint_dir
from corpuskit.sources.jsonl import decode_ignore


def resume_point(spark: SparkSession, checkpoint_dir: str) -> int | None:
    """Last committed micro-batch id under a streaming checkpoint, or None when
    the query has never committed (works on any Hadoop file system)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(checkpoint_dir.rstrip("/") + "/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    ids = [int(st.getPath().getName()) for st in fs.listStatus(path) if st.getPath().getName().isdigit()]
    return max(ids) if ids else None


def stream_jsonl(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming lines ``(file_path, line)`` (decoded leniently, stripped,
    non-blank) of the files appearing under ``path``."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = r.load(path)
    return df.select(F.col("_metadata.file_path").alias("file_path"),
                     ustrip(decode_ignore(F.col("value"))).alias("line")).where(F.col("line") != "")


def accepted_count_metric(df: DataFrame, name: str = "ingest") -> DataFrame:
    """Attach a running count of rows as an observed metric (progress marks
    without a second pass); read it from ``query.lastProgress``."""
    return df.observe(name, F.count(F.lit(1)).alias("accepted"))


def shuffle_batches(buffer: int = 5000, seed: int = 42, batch_size: int = 32,
                    key_col: str = "file_path") -> Callable[[DataFrame, int], DataFrame]:
    """Per micro-batch transform: the bounded shuffle buffer of the streaming
    trainer.  Rows of a micro-batch are numbered in arrival order (file, then
    position), permuted inside windows of ``buffer`` rows with seed
    ``seed + batch_id``, and cut into batches of ``batch_size``."""
    from corpuskit.operators import ordering as od

    def _t(batch: DataFrame, batch_id: int) -> DataFrame:
        # Arrival positions are written once: the index sorts by them.
        d = batch.withColumn("_pos", F.monotonically_increasing_id()).checkpoint(eager=True)
        d = od.with_row_index_range(d, [key_col, "_pos"], "idx").drop("_pos")
        d = od.windowed_shuffle(d, "idx", "idx", buffer, seed + batch_id)
        return od.micro_batches(d, batch_size)
    return _t


def examples_batches(vocab: DataFrame, max_seq_length: int = 512,
                     buffer: int = 5000, seed: int = 42, batch_size: int = 32,
                     causal: bool = False) -> Callable[[DataFrame, int], DataFrame]:
    """Per micro-batch transform producing training examples: the batch's
    accepted texts are shuffled in bounded buffers (:func:`shuffle_batches`)
    and encoded with a vocabulary fitted beforehand (kept fixed across
    batches so ids stay stable), then padded/truncated."""
    from corpuskit.operators import examples as exm
    shuffle = shuffle_batches(buffer, seed, batch_size)

    def _t(batch: DataFrame, batch_id: int) -> DataFrame:
        d = shuffle(batch, batch_id)
        meta = d.drop("text", "line", "source_field")
        enc = exm.encode(d.select("idx", "text"), vocab, "idx", "text", max_tokens=max_seq_length)
        return exm.build_examples(enc, max_seq_length, causal=causal).join(meta, "idx") \
            .withColumn("stream_batch", F.lit(batch_id))
    return _t


def ingest_stream(spark: SparkSession, source_dir: str, output_dir: str, checkpoint_dir: str,
                  text_field: str = "text", letters: str = PERSIAN_LETTERS,
                  batch_transform: Callable[[DataFrame, int], DataFrame] | None = None,
                  available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Start the incremental extraction: lines -> objects -> text gate ->
    (optional per-batch transform, e.g. windowed shuffle + examples) ->
    Parquet under ``output_dir/batch_id=N`` (idempotent overwrite)."""
    ensure_checkpoint_dir(spark)
    lines = stream_jsonl(spark, source_dir, max_files_per_trigger)
    acc = accepted_count_metric(extract_text(lines, "line", text_field, letters=letters))

    def _write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # a transform may use it more than once; lost blocks are recomputed
        try:
            out = batch_transform(batch, batch_id) if batch_transform else batch
            out.write.mode("overwrite").parquet(f"{output_dir.rstrip('/')}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    w = acc.writeStream.foreachBatch(_write).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
