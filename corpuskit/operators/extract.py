"""JSON-object parsing, quarantine and text extraction (dynamic field probing).

Parse rule (one object per line): ``from_json(line, 'map<string,variant>')``
with strict options is non-NULL **and** the stripped line ends with ``}``.
The map keeps document key order, duplicate keys and value types (through the
variant), which is what the field precedence needs; no Python UDF involved.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import (
    PERSIAN_LETTERS, TEXT_FIELDS, col_of, is_valid_text, ustrip,
)

# Strictness close to Python's json.loads: no single quotes, no leading zeros,
# no comments, no unquoted names/control chars; NaN/Infinity accepted as Python does.
JSON_OPTIONS = {
    "allowSingleQuotes": "false",
    "allowNumericLeadingZeros": "false",
    "allowComments": "false",
    "allowUnquotedFieldNames": "false",
    "allowNonNumericNumbers": "true",
}

OBJ = "_obj"


def parse_object(line) -> Column:
    """``map<string,variant>`` of a JSON object line, NULL when not an object."""
    x = col_of(line)
    m = F.from_json(x, "map<string,variant>", JSON_OPTIONS)
    return F.when(F.rtrim(x).endswith("}"), m)


def malformed_reason(line, parsed) -> Column:
    """Why a line is not an object: a JSON value that is not an object
    (``not_object``: list, string, number, null) or ``malformed`` text
    (broken JSON, single quotes, trailing data)."""
    v = F.try_parse_json(col_of(line))
    return F.when(col_of(parsed).isNotNull(), F.lit(None).cast("string")) \
        .when(v.isNotNull() & ~F.schema_of_variant(v).startswith("OBJECT"), F.lit("not_object")) \
        .otherwise(F.lit("malformed"))


def with_parsed(df: DataFrame, line_col: str = "line") -> DataFrame:
    return df.withColumn(OBJ, parse_object(line_col))


def quarantine_malformed(df: DataFrame, line_col: str = "line") -> tuple[DataFrame, DataFrame]:
    """Split lines into (parsed objects, quarantine with ``reason``).

    The reference skips malformed lines silently; keeping them as a DataFrame
    makes the skip auditable.  Each output parses its lines when consumed;
    :func:`classify_lines` gives every line with its outcome in one pass.
    """
    p = with_parsed(df, line_col)
    good = p.where(F.col(OBJ).isNotNull())
    bad = p.where(F.col(OBJ).isNull()) \
        .withColumn("reason", malformed_reason(F.col(line_col), F.col(OBJ))).drop(OBJ)
    return good, bad


def dict_map(obj) -> Column:
    """The parsed map with Python-dict semantics for duplicate keys (first
    position, last value).  Rows without duplicates (the norm) pass through;
    only rows with a repeated key are rebuilt."""
    m = col_of(obj)
    keys = F.map_keys(m)
    dk = F.array_distinct(keys)
    entries = F.map_entries(m)
    rebuilt = F.map_from_arrays(dk, F.transform(dk, lambda k: F.try_element_at(
        F.filter(entries, lambda e: e["key"] == k), F.lit(-1))["value"]))
    return F.when(F.size(dk) == F.size(keys), m).otherwise(rebuilt)


def _field_text(m: Column, name: str) -> Column:
    """``str(data[name])`` as text: string values raw, others as JSON text."""
    return F.try_element_at(m, F.lit(name)).cast("string")


def _probe_names(text_field: str, fields: Sequence[str]) -> list[str]:
    names = []
    for n in [text_field, *fields]:
        if n not in names:
            names.append(n)
    return names


def winner_col(obj, text_field: str = "text", fields: Sequence[str] = TEXT_FIELDS,
               letters: str = PERSIAN_LETTERS) -> Column:
    """``struct(name, value)`` of the first candidate passing the gate, or NULL.

    ``obj`` is a :func:`dict_map`.  Candidates in precedence order: the
    configured field, the known names (values stripped before the gate), then
    every string value in key order (gated raw).  ``coalesce`` stops at the
    first hit; map lookups are by key (no copies of the entries).
    """
    m = col_of(obj)
    probes = []
    for name in _probe_names(text_field, fields):
        s = ustrip(_field_text(m, name))
        probes.append(F.when(is_valid_text(s, letters), F.struct(F.lit(name).alias("name"), s.alias("value"))))

    # One higher-order chain producing the struct directly, referenced once,
    # so it is evaluated once and only for rows without a named-field winner.
    # Gate first (cheap rejections of short values), type check second.
    ok = F.filter(F.map_entries(m), lambda e: is_valid_text(e["value"].cast("string"), letters)
                  & (F.schema_of_variant(e["value"]) == "STRING"))
    probes.append(F.try_element_at(F.transform(ok, lambda e: F.struct(
        e["key"].alias("name"), e["value"].cast("string").alias("value"))), F.lit(1)))
    return F.coalesce(*probes)


def accepted_flag(obj, text_field: str = "text", fields: Sequence[str] = TEXT_FIELDS,
                  letters: str = PERSIAN_LETTERS) -> Column:
    """True when some candidate passes the gate: the same precedence as
    :func:`winner_col` without building the winning text (for counts)."""
    m = col_of(obj)
    checks = [is_valid_text(ustrip(_field_text(m, name)), letters) for name in _probe_names(text_field, fields)]
    checks.append(F.exists(F.map_entries(m), lambda e: is_valid_text(e["value"].cast("string"), letters)
                           & (F.schema_of_variant(e["value"]) == "STRING")))
    return F.coalesce(*[F.when(c, F.lit(True)) for c in checks], F.lit(False))


def _with_winner(df: DataFrame, line_col: str, text_field: str, fields: Sequence[str],
                 letters: str) -> DataFrame:
    # Staged projections: Catalyst keeps a non-cheap column that is used more
    # than once in its own Project instead of inlining it into every use.
    p = with_parsed(df, line_col)
    p = p.withColumn("_dict", dict_map(F.col(OBJ)))
    return p.withColumn("_win", winner_col(F.col("_dict"), text_field, fields, letters))


def extract_text(df: DataFrame, line_col: str = "line", text_field: str = "text",
                 fields: Sequence[str] = TEXT_FIELDS, letters: str = PERSIAN_LETTERS,
                 keep_rejected: bool = False) -> DataFrame:
    """Parse each line and extract its text; malformed lines are dropped.

    Adds ``text`` and ``source_field``.  With ``keep_rejected`` the objects
    without any valid text stay, with NULL text.  Accepted rows are emitted by
    a generator (one line -> 0 or 1 rows), which keeps the optimizer from
    copying the whole extraction into a pushed-down filter.
    """
    cols = [c for c in df.columns]
    p = _with_winner(df, line_col, text_field, fields, letters)
    if keep_rejected:
        return p.where(F.col(OBJ).isNotNull()).select(
            *cols, ustrip(F.col("_win.value")).alias("text"), F.col("_win.name").alias("source_field"))
    row = F.struct(*[F.col(c) for c in cols], ustrip(F.col("_win.value")).alias("text"),
                   F.col("_win.name").alias("source_field"))
    gen = F.filter(F.array(F.when(F.col("_win").isNotNull(), row)), lambda r: r.isNotNull())
    return p.select(F.inline(gen))


def extract_text_col(obj, text_field: str = "text", fields: Sequence[str] = TEXT_FIELDS,
                     letters: str = PERSIAN_LETTERS) -> tuple[Column, Column]:
    """(text, source_field) columns for an already parsed object column."""
    win = winner_col(dict_map(col_of(obj)), text_field, fields, letters)
    return ustrip(win["value"]), win["name"]


def classify_lines(df: DataFrame, line_col: str = "line", text_field: str = "text",
                   fields: Sequence[str] = TEXT_FIELDS, letters: str = PERSIAN_LETTERS) -> DataFrame:
    """Every line with its outcome: ``outcome`` in (accepted, rejected, malformed,
    not_object); ``text``/``source_field`` filled for accepted lines."""
    p = _with_winner(df, line_col, text_field, fields, letters)
    outcome = F.when(F.col(OBJ).isNull(), malformed_reason(F.col(line_col), F.col(OBJ))) \
        .when(F.col("_win").isNotNull(), F.lit("accepted")).otherwise(F.lit("rejected"))
    return p.withColumn("text", ustrip(F.col("_win.value"))).withColumn("source_field", F.col("_win.name")) \
        .withColumn("outcome", outcome).drop(OBJ, "_dict", "_win")


def count_valid(df: DataFrame, line_col: str = "line", max_samples: int | None = None,
                text_field: str = "text", fields: Sequence[str] = TEXT_FIELDS,
                letters: str = PERSIAN_LETTERS) -> DataFrame:
    """One row ``n_valid``: lines whose text extracts, capped at ``max_samples``.

    A single aggregation with map-side partial counts.  With a cap, a scan of
    files (a ``file_path`` column, as ``read_jsonl_lines`` gives it) is counted in
    growing waves of files and stops at the cap; any other input is counted whole
    and the cap applied to the count.
    """
    def counted(rows: DataFrame) -> DataFrame:
        p = with_parsed(rows, line_col).withColumn("_dict", dict_map(F.col(OBJ)))
        return p.agg(F.count_if(accepted_flag(F.col("_dict"), text_field, fields, letters)).cast("bigint").alias("n_valid"))

    if max_samples and "file_path" in df.columns and df.inputFiles():
        from corpuskit.operators.prefix import first_count
        n = first_count(df, max_samples, lambda rows: counted(rows).first().n_valid)
        return df.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("n_valid"))
    out = counted(df)
    return out.select(F.least("n_valid", F.lit(max_samples).cast("bigint")).alias("n_valid")) if max_samples else out


def observe_accepted(df: DataFrame, name: str = "accepted"):
    """Count rows while another action consumes them (progress without a
    second pass): returns ``(observed_df, observation)``; read
    ``observation.get["n_rows"]`` after the action (e.g. the examples write)."""
    from pyspark.sql import Observation
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("n_rows")), obs


def extraction_breakdown(classified: DataFrame) -> DataFrame:
    """Lines per winning field / rejected / malformed."""
    key = F.when(F.col("outcome") == "accepted", F.col("source_field")).otherwise(F.col("outcome"))
    return classified.groupBy(key.alias("bucket")).agg(F.count(F.lit(1)).alias("n_lines"))


def sample_preview(df: DataFrame, order_col: str, line_col: str = "line", text_field: str = "text", n: int = 200) -> DataFrame:
    """One row: the keys of the first record (by ``order_col``) and the start of
    its ``text_field`` (NULL without that field)."""
    p = with_parsed(df, line_col).where(F.col(OBJ).isNotNull()).withColumn("_dict", dict_map(F.col(OBJ)))
    text = F.try_variant_get(F.element_at("_dict", text_field), "$", "string")
    first = F.min_by(F.struct(F.map_keys("_dict").alias("keys"), F.concat(F.substring(text, 1, n), F.lit("...")).alias("preview")), order_col)
    return p.agg(first.alias("f")).select("f.keys", "f.preview")


def profile_fields(df: DataFrame, line_col: str = "line") -> DataFrame:
    """Per record key: how many objects have it and how many with a non-null value."""
    p = with_parsed(df, line_col).where(F.col(OBJ).isNotNull())
    e = p.select(F.explode(F.map_entries(dict_map(F.col(OBJ)))).alias("e"))
    return e.groupBy(F.col("e.key").alias("field")).agg(
        F.count(F.lit(1)).alias("n_present"),
        F.count_if(F.schema_of_variant(F.col("e.value")) != "VOID").alias("n_non_null"),
        F.count_if(F.schema_of_variant(F.col("e.value")) == "STRING").alias("n_string"))
