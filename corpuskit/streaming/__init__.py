"""Structured Streaming: incremental corpus ingestion with idempotent
per-batch output and resume, and a watermarked resource monitor."""

from corpuskit.streaming.carry import carried_rest, carried_shuffle  # noqa: F401
from corpuskit.streaming.ingest import (  # noqa: F401
    accepted_count_metric, examples_batches, ingest_stream, resume_point, shuffle_batches, stream_jsonl,
)
from corpuskit.streaming.monitor import monitor_stream  # noqa: F401
