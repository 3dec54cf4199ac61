"""Array-column helpers for fixed-length training examples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuskit.functions.text import col_of

__all__ = ["PAD_ID", "UNK_ID", "IGNORE_INDEX", "pad_truncate", "attention_mask",
           "causal_labels", "pad_to_multiple", "ids_text"]

# Reserved ids of the fitted vocabulary: pad doubles as end-of-sequence.
PAD_ID = 0
UNK_ID = 1
# Label value the causal collator uses for positions that carry no loss.
IGNORE_INDEX = -100


def pad_truncate(ids, length: int = 512, pad_id: int = PAD_ID) -> Column:
    """Truncate to ``length`` and right-pad with ``pad_id`` to exactly ``length``."""
    x = F.slice(col_of(ids), 1, length)
    return F.concat(x, F.array_repeat(F.lit(pad_id), F.lit(length) - F.size(x)))


def attention_mask(ids, length: int = 512) -> Column:
    """1 for real tokens (first ``min(size, length)``), 0 for padding."""
    n = F.least(F.size(col_of(ids)), F.lit(length))
    return F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n))


def causal_labels(padded_ids, pad_id: int = PAD_ID, ignore: int = IGNORE_INDEX) -> Column:
    """Labels as the causal collator derives them: a copy of the ids with every
    pad id replaced by ``ignore``.  Since pad == eos, real eos tokens are
    masked as well (kept on purpose for parity)."""
    return F.transform(col_of(padded_ids), lambda x: F.when(x == pad_id, F.lit(ignore)).otherwise(x))


def pad_to_multiple(n, multiple: int = 8) -> Column:
    """Length rounded up to a multiple (collator ``pad_to_multiple_of``)."""
    return (F.ceil(col_of(n) / F.lit(multiple)) * multiple).cast("bigint")


def ids_text(ids) -> Column:
    """Space-joined rendering of an id array (portable for comparisons)."""
    return F.array_join(F.transform(col_of(ids), lambda x: x.cast("string")), " ")
