"""Versioned outputs: atomic publish, readers of committed versions only, retention.

A version's rows are written to a folder of their own under ``data``.  Then one
small file under ``commits``, created only if it doesn't exist, names that folder:
this makes the version visible.  A writer that dies before leaves a folder that no
reader sees; of two writers of one number the second takes the next.  After the
commit, versions beyond the last ``keep`` go: first their commit, then their rows,
so that no commit ever names missing rows; with them go folders without a commit
that are older than all kept versions.

Only Hadoop's file system interface is used (HDFS, object stores that create
files exclusively, local folders); its calls touch names and tiny files, never rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = lambda *p: jvm.org.apache.hadoop.fs.Path("/".join((path.rstrip("/"), *p)))
    return at().getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(fs, folder) -> list[str]:
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _commits(spark: SparkSession, path: str) -> dict[int, str]:
    """{version: data folder}; a commit cut off while it was written doesn't count."""
    fs, at = _files(spark, path)
    out = {}
    for name in _names(fs, at("commits")):
        if name.isdigit():
            stream = fs.open(at("commits", name))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            if text.endswith("\n"):
                out[int(name)] = text.strip()
    return out


def versions(spark: SparkSession, path: str) -> list[int]:
    """The committed versions, oldest first."""
    return sorted(_commits(spark, path))


def publish(df: DataFrame, path: str, keep: int | None = None) -> int:
    """Write ``df`` as the next version and commit it; keep the last ``keep``."""
    if keep is not None and keep < 1:
        raise ValueError("keep at least one version")
    spark = df.sparkSession
    fs, at = _files(spark, path)
    number = max((int(n) for n in _names(fs, at("commits")) if n.isdigit()), default=-1) + 1
    folder = f"{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(at("data", folder).toString())
    while True:
        try:
            out = fs.create(at("commits", f"{number:012d}"), False)
            break
        except Exception as e:  # noqa: BLE001  (py4j wraps Java's exception)
            if "FileAlreadyExists" not in str(e) and not fs.exists(at("commits", f"{number:012d}")):
                raise
            number += 1
    try:
        out.write(bytearray(f"{folder}\n".encode()))
    finally:
        out.close()
    if keep is not None:
        retain(spark, path, keep)
    return number


def retain(spark: SparkSession, path: str, keep: int) -> None:
    """Drop all but the last ``keep`` versions, and what dead writers left before them."""
    fs, at = _files(spark, path)
    own = _commits(spark, path)
    kept = sorted(own)[-keep:]
    if not kept:
        return
    for number in sorted(own):
        if number < kept[0]:
            fs.delete(at("commits", f"{number:012d}"), False)
    held = {own[n] for n in kept}
    for folder in _names(fs, at("data")):
        if folder not in held and int(folder.split("-")[0]) < kept[0]:
            fs.delete(at("data", folder), True)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a committed version (the last one by default)."""
    own = _commits(spark, path)
    if not own or (version is not None and version not in own):
        raise ValueError(f"no committed version{'' if version is None else f' {version}'} under {path}")
    _, at = _files(spark, path)
    return spark.read.parquet(at("data", own[max(own) if version is None else version]).toString())


__all__ = ["publish", "versions", "retain", "read_version"]
