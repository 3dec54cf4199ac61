"""Prefix scans: the first n accepted rows of a file scan without reading the rest.

Files are read in path order in waves.  A wave is a range of paths, which prunes
the scan's files; its accepted rows are numbered in place from per-split counts
and written once.  The share of rows accepted so far tells how many files the
next wave needs.  The scan stops when the prefix holds n rows; what the last
wave holds beyond is cut by position.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.operators.ordering import with_input_index

GROWTH = 16  # a wave has at most so many times the files of the one before


def _waves(df: DataFrame, n: int, path_col: str, first_files: int) -> Iterator[tuple[DataFrame, Callable[[int], None]]]:
    """Wave by wave: the rows of its files, and where to say how many were accepted."""
    # A path without a host is listed as scheme:///path, but file_path says scheme:/path.
    files, at, got, size = sorted(re.sub(r"^(\w+):///", r"\1:/", f) for f in df.inputFiles()), 0, 0, max(1, first_files)
    if not files:
        raise ValueError("a prefix scan needs a scan of files")
    while at < len(files) and got < n:
        own = files[at:at + size]

        def tell(found: int) -> None:
            nonlocal got
            got += found
        yield df.where((F.col(path_col) >= own[0]) & (F.col(path_col) <= own[-1])), tell
        at += len(own)
        need = -(-(n - got) * at * 11 // (10 * got)) if got else size * GROWTH
        size = min(max(1, need), size * GROWTH)


def first_rows(df: DataFrame, n: int, accept: Callable[[DataFrame], DataFrame] | None = None, name: str = "idx",
               split_cols=("file_path", "block_start"), first_files: int = 1) -> DataFrame:
    """The first ``n`` rows that ``accept`` leaves of a file scan, in input order
    (path, then place), with their position ``name``.

    ``df`` has the scan's ``split_cols`` (as ``read_jsonl_lines`` gives them);
    ``accept`` must be narrow and keep them."""
    accept = accept or (lambda x: x)
    parts, before = [], 0
    for rows, tell in _waves(df, n, split_cols[0], first_files):
        numbered = with_input_index(accept(rows), name, split_cols)
        found = numbered.count()
        parts.append(numbered.withColumn(name, (F.col(name) + before).cast("bigint")).where(F.col(name) <= n))
        before += found
        tell(found)
    if not parts:  # n = 0
        return accept(df).limit(0).withColumn(name, F.lit(None).cast("bigint"))
    return reduce(DataFrame.unionByName, parts)


def first_count(df: DataFrame, n: int, count: Callable[[DataFrame], int], path_col: str = "file_path", first_files: int = 1) -> int:
    """``min(n, accepted rows)``, counted wave by wave until it is ``n``."""
    total = 0
    for rows, tell in _waves(df, n, path_col, first_files):
        found = count(rows)
        total += found
        tell(found)
    return min(n, total)


__all__ = ["first_rows", "first_count"]
