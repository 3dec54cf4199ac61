"""Registered queries over the driver tables (Spark) and their DuckDB oracles.

Each module exposes ``QUERIES: dict[name, (spark, sf_dir) -> DataFrame]`` and
``SQL: dict[name, str]``.  Queries read whole tables (or data Spark derives
from them); column names are aliased identically on both sides.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("text_q", "jsonl_q", "ordering_q", "examples_q", "evaluate_q", "telemetry_q", "graph_q")


def _load():
    queries, sql = {}, {}
    for m in MODULES:
        mod = import_module(f"corpuskit.queries.{m}")
        queries.update(mod.QUERIES)
        sql.update(mod.SQL)
    return queries, sql


def all_queries():
    return _load()[0]


def all_sql():
    return _load()[1]
