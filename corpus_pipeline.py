"""The training-data pipeline over ``documents``: stages that each call one
operator of ``corpuskit.llm``, each written as Parquet and read by the next.

Rows with nulls, empty texts and repeated rows are handled as the operators'
docstrings say; an empty table passes through every stage."""

from __future__ import annotations

from corpuskit.llm import bpe, decontam, quality, secrets, simhash
from corpuskit.llm.common import bounded_batches, table, written


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects (score under 0.5) go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_near_dedup(spark, docs, sf_dir):
    """One document, that with the smallest id, stays of each group (3-word shingles, 2 bits)."""
    return simhash.keep_first(docs, k=3)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark, docs, sf_dir):
    """Found secrets are masked in the texts; no document goes."""
    return secrets.redact(docs)


def byte_bpe(spark, docs, sf_dir):
    """Documents as token ids, decoded again: ``(doc_id, n_tokens, ids, decoded_sha256)``;
    the hash is that of the bytes the ids decode to, which are the text's own."""
    return bpe.encode_and_decode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("byte-level BPE", byte_bpe),
]

#: SQL can't express the classifier's training, XXH64 or the merges; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
