"""JSON-lines sources.

``read_jsonl_lines`` is the distributed twin of iterating a file line by line:
each split is read by one task in file order, so split offsets plus the
position inside the split restore the exact input order without a sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions.text import PY_WHITESPACE, col_of, ustrip


def decode_ignore(c):
    """UTF-8 decode with ``errors='ignore'``: drop invalid byte sequences.

    Valid rows pass untouched; only invalid ones are repaired: invalid bytes
    become U+FFFD, which is then removed, while U+FFFD of the input is kept (set
    aside as a pair of noncharacters meanwhile).
    """
    x, own, aside = col_of(c), F.lit("\ufffd"), F.lit("\ufdd0\ufdd1")
    repaired = F.replace(F.make_valid_utf8(F.replace(x, own, aside)), own, F.lit(""))
    return F.when(F.is_valid_utf8(x), x).otherwise(F.replace(repaired, aside, own))


def read_jsonl_lines(spark: SparkSession, path: str, keep_blank: bool = False,
                     line_numbers: bool = False) -> DataFrame:
    """Scan text lines; decode leniently, strip, skip blank lines.

    Columns: ``file_path, block_start, line``, plus ``line_no`` (1-based
    position of the line in the input, blank lines counted, files in path
    order) with ``line_numbers=True``.  Numbering needs no shuffle of the
    lines: one task reads one split in order, and per-split offsets come from
    a small size-checked table (:func:`with_input_index`).  Consumers that do
    not need the order (counts) skip it and scan once.  A missing path raises
    Spark's ``PATH_NOT_FOUND`` AnalysisException.
    """
    out = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        ustrip(decode_ignore(F.col("value"))).alias("line"),
    )
    if line_numbers:
        from corpuskit.operators.ordering import with_input_index
        out = with_input_index(out, "line_no")
    if not keep_blank:
        out = out.where(F.col("line") != "")
    return out


def read_json_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                    sampling_ratio: float | None = None,
                    corrupt_column: str = "_corrupt_record") -> DataFrame:
    """Load a JSON-lines table with an explicit or inferred schema.

    Malformed lines do not fail the load: they land in ``corrupt_column``
    (PERMISSIVE mode), the counterpart of falling back to a tolerant load.
    """
    r = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt_column)
    if sampling_ratio is not None:
        r = r.option("samplingRatio", str(sampling_ratio))
    if schema is not None:
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        if corrupt_column not in schema.fieldNames():
            schema = T.StructType(list(schema.fields) + [T.StructField(corrupt_column, T.StringType())])
        r = r.schema(schema)
    return r.json(path)


# Field name given to each derived line, chosen by doc_id modulo 4; the last
# one is unknown to the probe list, so it exercises the any-string-value step.
DOC_FIELDS = ("text", "content", "body", "note")
# Every 17th line loses its closing brace, which makes it malformed.
MALFORMED_EVERY = 17


def documents_lines(docs: DataFrame, malformed: bool = True) -> DataFrame:
    """Render a ``documents`` table as JSON lines: ``(line_no, line)``.

    Keys in order ``doc_id, lang, source, <field>, n_chars`` with ``<field>``
    from :data:`DOC_FIELDS` by ``doc_id % 4``; with ``malformed`` every 17th
    line misses its closing brace (whole text kept).
    Derived from the whole table, so the work grows with it.
    """
    field = F.element_at(F.array(*[F.lit(f) for f in DOC_FIELDS]),
                         (F.pmod(F.col("doc_id"), F.lit(len(DOC_FIELDS))) + 1).cast("int"))
    obj = F.to_json(F.struct(
        F.col("doc_id"), F.col("lang"), F.col("source"),
        F.col("text").alias("__text"), F.col("n_chars")))
    # Rename the text key per row: to_json has static names, so swap the
    # placeholder key in the rendered text (its quoting is fixed).
    renamed = F.replace(obj, F.lit('"__text":'), F.concat(F.lit('"'), field, F.lit('":')))
    # Malformed lines keep their whole text: only the closing brace is lost.
    line = F.when(F.lit(malformed) & (F.pmod(F.col("doc_id"), F.lit(MALFORMED_EVERY)) == 0),
                  F.expr("substr(__line, 1, length(__line) - 1)")).otherwise(F.col("__line"))
    return docs.select("doc_id", renamed.alias("__line")) \
        .select(F.col("doc_id").alias("line_no"), line.alias("line"))


__all__ = ["decode_ignore", "read_jsonl_lines", "read_json_table", "documents_lines", "DOC_FIELDS", "MALFORMED_EVERY", "PY_WHITESPACE"]
