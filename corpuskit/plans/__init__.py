"""End-to-end plans composed from the operators (ingestion, evaluation)."""

from corpuskit.plans.ingest import IngestConfig, batch_ingest, corpus_examples  # noqa: F401
from corpuskit.plans.evaluation import evaluate_candidates  # noqa: F401
