"""Helpers shared by the operators: shared work folder, folds, Arrow rows."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python are bounded by bytes, not only by rows: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def written(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder of ``spark.checkpoint.dir`` and
    read it back: cuts the lineage and survives lost executors.  With ``by`` (the
    last column) there is a folder for each of its values, read alone by a filter."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def fold(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3 (NULL id: 0, a training fold without labels)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3, F.lit(0)).cast("int")


def clean_labels(labels: DataFrame, label: str) -> DataFrame:
    """One row ``(doc_id, label)`` per labelled training id: NULLs and values
    other than 0 and 1 take no part; ids with both labels take no part; the
    held-out fold (remainder 1) is left out."""
    lab = F.col(label).cast("int")
    return labels.where(F.col("doc_id").isNotNull() & lab.isin(0, 1) & (fold("doc_id") != 1)) \
        .groupBy("doc_id").agg(F.min(lab).alias("label"), F.max(lab).alias("_hi")) \
        .where(F.col("label") == F.col("_hi")).drop("_hi")


def release() -> None:
    """What was freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def released(run):
    """``run`` for mapInArrow; what a task has freed goes back to the system when
    it ends, as Python workers stay for the stages after it."""
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            release()
    return tidy


def text_slices(batches, rows: int = 512, size: int = 8 << 20):
    """Slices of Arrow batches with at most ``rows`` rows and, but for a single
    longer row, ``size`` text bytes; the text is the last column.  Bounds the
    Python objects alive at once, whatever the texts' length."""
    for b in batches:
        t, lo, got = b.column(b.num_columns - 1), 0, 0
        lens = pa.compute.fill_null(pa.compute.binary_length(t), 0).to_pylist()
        for i, n in enumerate(lens):
            if i > lo and (got + n > size or i - lo >= rows):
                yield b.slice(lo, i - lo)
                lo, got = i, 0
            got += n
        if b.num_rows > lo:
            yield b.slice(lo)


def texts_of(batch) -> list[bytes]:
    """UTF-8 bytes of the last column (NULL: empty)."""
    return [t or b"" for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
