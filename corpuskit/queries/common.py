"""Shared pieces for the registered queries: table access and SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuskit.functions.text import LATIN_ACCENT_LETTERS, PY_WHITESPACE
from corpuskit.session import spread
from corpuskit.sources.jsonl import documents_lines

LETTERS = LATIN_ACCENT_LETTERS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_jsonl(spark: SparkSession, sf_dir: str, malformed: bool = False) -> DataFrame:
    """``documents`` as JSON lines, rows of a one-file table spread over the cores."""
    return documents_lines(spread(table(spark, sf_dir, "documents")), malformed)


# --- DuckDB fragments mirroring corpuskit.functions.text -------------------
WS = "(" + " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"
WS_RE = "'[' || " + WS + " || ']+'"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def has_script(x: str, letters: str = LETTERS) -> str:
    return f"coalesce(regexp_matches({x}, '[{letters}]'), false)"


def valid(x: str, letters: str = LETTERS) -> str:
    return (f"coalesce(length({strip(x)}) >= 25 AND ({has_script(x, letters)} OR "
            f"(length({x}) > 100 AND NOT (starts_with({x}, '{{') OR starts_with({x}, '[') "
            f"OR starts_with({x}, '<')) AND NOT contains({x}, 'http'))), false)")


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {WS_RE}), lambda t: t <> '')"


def contains_any(x: str, terms) -> str:
    parts = " OR ".join("contains(%s, '%s')" % (x, t.replace("'", "''")) for t in terms)
    return f"coalesce({parts}, false)"


def hash_pick(x: str, n: int) -> str:
    return f"(('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 8))::BIGINT % {n})"


def shuffled_positions(rows: str, seed: int, buffer: int, epoch: str = "0", idx: str = "idx") -> str:
    """SELECT over the rows of table ``rows`` (a dense 1-based ``idx``) with ``window_id`` and ``shuffle_pos``: the
    keyed permutation of each buffer, rounds and cycle walking as list reductions."""
    mixed = lambda digit: f"((({digit} + key + (r + 1) * 40503) % 2147483647) * (({digit} + key + (r + 1) * 40503) % 2147483647) % 2147483647 * 48271 + r) % 2147483647"
    rounds = lambda x, s: (f"list_reduce(range(6), lambda {s}, r: CASE WHEN r % 2 = 0 THEN (({s} // b + {mixed(f'({s} % b)')}) % a) * b + {s} % b "  # noqa: E731
                           f"ELSE ({s} // b) * b + ({s} % b + {mixed(f'({s} // b)')}) % b END, {x})")
    return f"""SELECT * EXCLUDE (m, a, b, key), 1 + list_reduce(range(a * b - m), lambda s, i: CASE WHEN s < m THEN s ELSE {rounds('s', 'u')} END,
        {rounds(f'({idx} - 1 - window_id * {buffer})', 't')}) AS shuffle_pos
      FROM (SELECT *, CAST(ceil(m / a) AS BIGINT) AS b FROM (SELECT *, CAST(ceil(sqrt(m)) AS BIGINT) AS a FROM (
        SELECT *, ({idx} - 1) // {buffer} AS window_id, least({buffer}, (SELECT count(*) FROM {rows}) - ({idx} - 1) // {buffer} * {buffer}) AS m,
          (({seed} + {epoch}) * 1000003 + (({idx} - 1) // {buffer}) * 7368787) % 2147483647 AS key FROM {rows})))"""


# Documents rendered as JSON lines (see corpuskit.sources.jsonl.documents_lines):
# field by doc_id % 4; where asked for, every 17th line is malformed.
DOC_FIELD_SQL = "(['text','content','body','note'])[(doc_id % 4) + 1]"

_EXTRACT = f"""
docs_ok AS (SELECT *, {DOC_FIELD_SQL} AS f FROM documents <where>),
extracted AS (
  SELECT doc_id AS line_no,
    CASE WHEN f <> 'note' AND {valid(strip('text'))} THEN {strip('text')}
         WHEN {valid('text')} THEN {strip('text')} END AS text,
    CASE WHEN f <> 'note' AND {valid(strip('text'))} THEN f
         WHEN {valid('text')} THEN f END AS source_field
  FROM docs_ok)
"""
EXTRACT_CTE = _EXTRACT.replace("<where>", "")
EXTRACT_PARSED_CTE = _EXTRACT.replace("<where>", "WHERE doc_id % 17 <> 0")
