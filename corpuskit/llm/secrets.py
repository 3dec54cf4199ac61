"""Secret scans with an incremental blob ledger.

Every historical version of a file is content-addressed (SHA-256 of its text).
Only (blob, rule version) pairs that the ledger doesn't hold are scanned, each
distinct blob once; findings are joined back to all paths and versions that
hold the blob.

Plan: ids and hashes travel first (partial ``min`` per blob, so a blob that a
third of all paths hold is one row per task); one text per unseen blob is
fetched by an equi-join on the path key (not on the hot blob); the join back
is on the blob with one written row per blob that has findings, which AQE can
split when one blob is hot.

Null texts are empty texts; rows with NULL keys are scanned like others;
repeated rows each get their findings; an empty table gives an empty result.
Other columns never reach the scan.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuskit.llm.common import fresh, released, text_slices, written

SPANS = "array<struct<kind:string,rule:string,start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched leftmost, without overlaps; then matches whose
    ``group`` is shorter than ``least`` characters are dropped.  ``needs``: a
    lower-case ASCII string of which a matching text's lower-cased form must
    hold one (pure speed).  A changed rule takes a new ``version``."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


# The base kinds in their stated order; then the kinds added here.
BASE_RULES = (
    Rule("assign", 1, r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         2, 12, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),  # a run is maximal, so the bound may stand in the pattern
)
MORE_RULES = (
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, ("eyj",)),
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 0, ("private key",)),
)
RULES = BASE_RULES + MORE_RULES


def blob_id(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def scan_text(text: str, rules) -> list[dict]:
    """All spans of ``rules`` in one text, by start, then rule order."""
    low, out = text.lower(), []
    for k, r in enumerate(rules):
        if r.needs and not any(n in low for n in r.needs):
            continue
        for m in re.finditer(r.pattern, text):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, m.end()))
    return [{"kind": rules[k].kind, "rule": rules[k].id, "start": s, "end": e} for s, k, e in sorted(out)]


def _scanner(rules):
    def run(batches):
        schema = pa.schema([("blob_id", pa.string()), ("todo", pa.list_(pa.string())), ("spans", pa.list_(pa.struct(
            [("kind", pa.string()), ("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
        for b in text_slices(batches):
            todo = b.column(1).to_pylist()
            own = {x: [r for r in rules if r.id in x] for x in {tuple(t) for t in todo}}
            spans = [scan_text(t or "", own[tuple(x)]) for t, x in zip(b.column(2).to_pylist(), todo)]
            yield pa.record_batch([b.column(0), b.column(1).cast(schema.field(1).type), pa.array(spans, schema.field(2).type)], schema=schema)
    return run


def scan_unseen(versions: DataFrame, keys: list[str], rules=RULES, text: str = "text",
                ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows ``(blob_id, todo, spans)``: one row per blob with rules it
    wasn't scanned for (``todo``, now done) and what they found.

    ``ledger``: rows of earlier calls, any number per blob."""
    src = versions.select(F.struct(*keys).alias("_key"), F.col(text).alias("_text")) \
        .select("_key", F.sha2(F.coalesce("_text", F.lit("")), 256).alias("blob_id"), "_text")
    reps = src.groupBy("blob_id").agg(F.min("_key").alias("_key"))
    every = F.array(*[F.lit(r.id) for r in rules])
    if ledger is None:
        reps = reps.withColumn("todo", every)
    else:
        seen = ledger.select("blob_id", F.explode("todo").alias("r")).groupBy("blob_id").agg(F.collect_set("r").alias("_done"))
        reps = reps.join(seen, "blob_id", "left") \
            .withColumn("todo", F.array_except(every, F.coalesce("_done", F.array().cast("array<string>")))) \
            .where(F.size("todo") > 0).drop("_done")
    a, b = src.alias("a"), reps.alias("b")
    unseen = a.join(b, F.col("a._key").eqNullSafe(F.col("b._key")) & (F.col("a.blob_id") == F.col("b.blob_id"))) \
        .select("b.blob_id", "b.todo", "a._text")
    return unseen.mapInArrow(released(_scanner(tuple(rules))), f"blob_id string, todo array<string>, spans {SPANS}")


def scan_versions(versions: DataFrame, keys: list[str], rules=RULES, text: str = "text",
                  ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(findings, new ledger rows)``.  Findings: one row ``(*keys, blob_id,
    spans)`` per version row, spans by start, then rule order; both old and new
    ledger rows count, for the given rules only.

    The new ledger rows are written to the shared folder first; append them to
    the ledger."""
    new = written(scan_unseen(versions, keys, rules, text, ledger), "secret-ledger")
    own = new.select("blob_id", "spans")
    if ledger is not None:
        own = own.unionByName(ledger.select("blob_id", "spans"))
    ids = {r.id: k for k, r in enumerate(rules)}
    hits = own.select("blob_id", F.explode("spans").alias("s")).where(F.col("s.rule").isin(list(ids)))
    order = F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.lit(v))])
    hits = hits.groupBy("blob_id").agg(F.sort_array(F.collect_set(F.struct(
        F.col("s.start").alias("start"), order[F.col("s.rule")].alias("k"), F.col("s").alias("s")))).alias("_s")) \
        .select("blob_id", F.transform("_s", lambda x: x["s"]).alias("spans"))
    hits = written(hits, "secret-findings")
    paths = versions.select(*keys, blob_id(text).alias("blob_id"))
    return paths.join(hits, "blob_id", "left").select(
        *keys, "blob_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), new


def redact_text(text: str, spans, mask: str = "<{}>") -> str:
    """Text with each maximal run of overlapping spans replaced by its first kind's mask."""
    out, at, k = [], 0, 0
    spans = sorted((s["start"], s["end"], s["kind"]) for s in spans)
    while k < len(spans):
        lo, hi, kind = spans[k]
        while k < len(spans) and spans[k][0] < hi:
            hi = max(hi, spans[k][1])
            k += 1
        out += [text[at:lo], mask.format(kind)]
        at = hi
    return "".join([*out, text[at:]])


def redact(documents: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """``documents`` with every found secret masked and ``n_chars`` (where there
    is one) corrected; no row goes.  Texts without findings aren't touched."""
    found, _ = scan_versions(documents.select(key, text), [key], rules, text)
    blob, spans = fresh(documents, "_blob"), fresh(documents, "_spans")
    hits = written(found.where(F.size("spans") > 0).select(F.col("blob_id").alias(blob), F.col("spans").alias(spans)).dropDuplicates([blob]), "secret-redact")

    @F.pandas_udf("string")
    def masked(texts, found):
        return texts.combine(found, lambda t, s: t if t is None or s is None or len(s) == 0 else redact_text(t, s))

    out = documents.withColumn(blob, blob_id(text)).join(hits, blob, "left")
    new = F.when(F.col(spans).isNotNull(), masked(text, spans)).otherwise(F.col(text))
    count = F.when(F.col(spans).isNotNull(), F.length(text).cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in documents.columns else None
    out = out.withColumn(text, new)
    if count is not None:
        out = out.withColumn("n_chars", count)
    return out.select(*documents.columns)
