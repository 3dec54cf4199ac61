"""Registered queries ``opN_<name>``: each applies its operator to its whole
table and derives the result's digest columns.  ``SQL`` holds DuckDB oracles
where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuskit.llm import bpe, decontam, licenses, mining, packing, quality, resampling, secrets, sharding, simhash, suffix_dedup, topk, toxicity
from corpuskit.llm.common import fold, table


def op1_secret_scan(spark, sf_dir):
    found, _ = secrets.scan_versions(table(spark, sf_dir, "documents"), ["doc_id"])
    joined = lambda spans: F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    kind = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    return found.select("doc_id", *[F.size(kind(k)).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(joined(kind("assign", "access", "hex")), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


_KINDS = (
    ("assign", f"({_either_case('password|passwd|secret|token|api_?key')})" + r"[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("pem", "-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, 0),
)

OP1_SQL = "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS (" + " UNION ALL ".join(
    f"SELECT rid, '{kind}' AS kind, {k} AS k, {least} AS least, string_split_regex(t, '{pat}') AS p, "
    f"regexp_extract_all(t, '{pat}') AS a, regexp_extract_all(t, '{pat}', {group}) AS g FROM d"
    for k, (kind, pat, group, least) in enumerate(_KINDS)) + """),
i AS (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM m),
s AS (SELECT rid, kind, k, length(a[i]) AS n, list_sum(list_transform(p[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(a[1:i-1], lambda x: length(x))), 0) AS lo FROM i WHERE length(g[i]) >= least),
x AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
        string_agg(concat_ws(':', kind, lo::BIGINT, (lo + n)::BIGINT), ',' ORDER BY lo, k) FILTER (k < 3) AS base,
        string_agg(concat_ws(':', kind, lo::BIGINT, (lo + n)::BIGINT), ',' ORDER BY lo, k) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN x USING (rid)"""


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicate(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op3_byte_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_license_scan(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda m: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))))
    return found.select("doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
                        F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("score"))


def op5_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5, component=lambda x: F.floor(256 * x))


OP5_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM p QUALIFY rank <= 5"""


def op6_toxicity(spark, sf_dir):
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_quality(spark, sf_dir):
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark, sf_dir):
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash(spark, sf_dir):
    out = simhash.near_groups(table(spark, sf_dir, "documents"), k=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mining.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 5, 5, 80, 100,
                                 label=moved, component=lambda x: F.floor(256 * x))


OP11_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v) WHERE a.vec_id % 100 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM p WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN p USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5"""


def op12_resampling(spark, sf_dir):
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, n=2,
                               buckets=10_000, seed=7).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 byte by byte over the distinct features, with its table made in SQL.
OP12_SQL = """WITH tab AS (SELECT list_transform(range(256), lambda i:
    list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
r AS (SELECT true AS own, rid, text FROM d UNION ALL SELECT false, row_number() OVER (), text FROM benchmark),
w AS (SELECT own, rid, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM r WHERE text IS NOT NULL),
f AS (SELECT own, rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM w),
g AS (SELECT f, xor(4294967295, list_reduce(list_transform(range(1, len(h), 2),
      lambda i: (instr('0123456789ABCDEF', h[i]) - 1) * 16 + instr('0123456789ABCDEF', h[i + 1]) - 1),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS h FROM f), tab),
c AS (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM f JOIN g USING (f) GROUP BY bucket),
n AS (SELECT sum(s)::DOUBLE AS ss, sum(t)::DOUBLE AS tt FROM c),
b AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000) / ((s + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM c, n),
x AS (SELECT rid, count(*) AS n_features, floor(sum(gain) / count(*))::BIGINT AS weight FROM f JOIN g USING (f) JOIN b USING (bucket) WHERE own GROUP BY rid),
h AS (SELECT rid, doc_id, list_reduce(list_transform(range(1, 9), lambda i: instr('0123456789abcdef', z[i]) - 1), lambda a, b: a * 16 + b, 0::BIGINT)::DOUBLE AS h
  FROM (SELECT rid, doc_id, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS z FROM d)),
y AS (SELECT h.rid, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(len(w), 0) >= 20 AS able,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score
  FROM h LEFT JOIN x ON x.rid = h.rid LEFT JOIN w ON w.rid = h.rid AND w.own),
z AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS place, count(*) FILTER (able) OVER () AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * n // 100 THEN place END AS rank FROM z"""


def op13_packing(spark, sf_dir):
    import public_tokenizers
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_license_scan": op4_license_scan,
    "op5_topk": op5_topk,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_sharding": op8_sharding,
    "op9_decontamination": op9_decontamination,
    "op10_simhash": op10_simhash,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_resampling": op12_resampling,
    "op13_packing": op13_packing,
}
SQL = {"op1_secret_scan": OP1_SQL, "op5_topk": OP5_SQL, "op11_hard_negatives": OP11_SQL, "op12_resampling": OP12_SQL}
