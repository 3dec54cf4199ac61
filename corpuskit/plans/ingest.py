"""Corpus ingestion plans.

``corpus_examples`` is the streaming-trainer path: lines -> parsed objects
(quarantine) -> extracted, gated text -> input order -> max_samples cut ->
windowed shuffle -> micro-batches -> ids -> fixed-length examples.
``batch_ingest`` is the batch-trainer path: JSON table -> first n -> usable
strings -> ids -> examples -> non-empty -> train/eval split.
Both run jobs while they are built (checkpoints, the row index, the vocabulary);
the driver only gets counts and the frequency histogram's cut.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.functions.text import PERSIAN_LETTERS, TEXT_FIELDS, usable_string, ustrip
from corpuskit.operators import examples as exm
from corpuskit.operators import extract as ex
from corpuskit.operators import ordering as od
from corpuskit.operators.prefix import first_rows


@dataclass
class IngestConfig:
    text_field: str = "text"
    fields: Sequence[str] = TEXT_FIELDS
    letters: str = PERSIAN_LETTERS
    max_samples: int | None = None
    round_to_buffer: bool = False
    buffer: int = 5000
    batch_size: int = 32
    seed: int = 42
    epoch: int = 0
    # More than one epoch repeats the data, each epoch shuffled with seed + epoch.
    epochs: int = 1
    max_seq_length: int = 512
    vocab_size: int = 32_000
    causal_labels: bool = False
    # Write the accepted corpus once (reliable checkpoint in the shared
    # checkpoint dir) so indexing, vocabulary and encoding do not re-parse it.
    materialize: bool = True
    tokenizer: Callable | None = field(default=None, repr=False)


def corpus_examples(lines: DataFrame, order_cols=None, cfg: IngestConfig = IngestConfig(),
                    vocab: DataFrame | None = None) -> dict[str, DataFrame]:
    """Run the streaming-trainer ingestion over a lines table.

    ``lines`` has a ``line`` column; the input order is either given by unique
    ``order_cols`` or, when ``None``, taken from the file scan itself
    (``read_jsonl_lines`` output: no shuffle for the index).  Returns
    ``quarantine``, ``accepted`` (text with index, window and batch) and
    ``examples`` DataFrames.
    """
    _, bad = ex.quarantine_malformed(lines, "line")
    accept = lambda rows: ex.extract_text(rows, "line", cfg.text_field, cfg.fields, cfg.letters).drop("line")
    limit = cfg.max_samples
    if limit and cfg.round_to_buffer:
        limit = -(-limit // cfg.buffer) * cfg.buffer
    acc = accept(lines)
    if order_cols is None and limit:
        acc = first_rows(lines, limit, accept)  # later files are not read
    elif order_cols is None:
        acc = od.with_input_index(acc, "idx")  # checks the scan order, then writes one copy
    else:
        if cfg.materialize:
            from corpuskit.session import ensure_checkpoint_dir
            ensure_checkpoint_dir(acc.sparkSession)
            acc = acc.checkpoint(eager=True)
        acc = od.with_row_index(acc, order_cols, "idx")
    if limit:
        acc = acc.where(F.col("idx") <= limit)
    # Shuffle positions and batches are computed on the narrow key columns;
    # only the encoding moves the (truncated) texts, once.
    narrow = acc.drop("text", "source_field")
    if cfg.epochs > 1:
        meta = od.micro_batches(od.epoch_plan(narrow, "idx", "idx", cfg.epochs, cfg.buffer, cfg.seed),
                                cfg.batch_size)
    else:
        meta = od.micro_batches(od.windowed_shuffle(narrow, "idx", "idx", cfg.buffer, cfg.seed, cfg.epoch),
                                cfg.batch_size)
    if cfg.tokenizer is None and vocab is None:
        vocab = exm.fit_vocabulary(acc, "text", cfg.vocab_size)
    enc = exm.encode(acc, vocab, "idx", "text", max_tokens=cfg.max_seq_length, tokenizer=cfg.tokenizer)
    # Rows the tokenizer fails on are counted (observed as ``encoding``) and dropped.
    examples = exm.build_examples(exm.encoded_ok(enc), cfg.max_seq_length, causal=cfg.causal_labels).join(meta, "idx")
    accepted = acc.join(meta, "idx")
    return {"quarantine": bad, "accepted": accepted, "examples": examples}


def batch_ingest(table: DataFrame, key_col: str, text_col: str = "text", max_samples: int | None = None,
                 max_seq_length: int = 512, vocab_size: int = 32_000, seed: int = 42,
                 vocab: DataFrame | None = None, materialize: bool = True,
                 tokenizer: Callable | None = None) -> DataFrame:
    """Batch-trainer path: first ``max_samples`` rows (by key), truthy string
    texts stripped, encoded (by ``tokenizer`` if given; failing rows are counted
    and dropped), padded, labels = ids, empty ones dropped (padding counts, so a
    text without tokens stays as an all-pad row), then the seeded train/eval
    split (``split`` column)."""
    t = table
    if max_samples:
        t = od.take_first(t, max_samples, key_col)
    t = t.where(usable_string(text_col)).select(key_col, ustrip(text_col).alias("text"))
    if vocab is None and tokenizer is None:
        vocab = exm.fit_vocabulary(t, "text", vocab_size)
    enc = exm.encoded_ok(exm.encode(t, vocab, key_col, "text", max_tokens=max_seq_length, tokenizer=tokenizer))
    ex_ = exm.nonempty_examples(exm.build_examples(enc, max_seq_length))
    if materialize:
        # The split counts and ranks the examples before tagging them: write
        # them once instead of encoding three times.
        from corpuskit.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(ex_.sparkSession)
        ex_ = ex_.checkpoint(eager=True)
    return od.train_eval_split(ex_, key_col, seed)
