"""Order, limit, windowed shuffle, batching, splits and step planning.

The global position of a row is computed without a window over the data:
rows are numbered locally inside bounded groups (key buckets, input splits or
range partitions) and shifted by offsets from a small table with one row per
group.  Everything downstream partitions by bounded windows (``window_id``
groups hold at most ``buffer`` rows), so no key can be hot.  The only
unpartitioned windows run over those one-row-per-group tables.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuskit.functions.permute import permuted, shuffle_key

_LOW33 = (1 << 33) - 1


def _cols(cols) -> list[Column]:
    if isinstance(cols, (str, Column)):
        cols = [cols]
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return n
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


# One-row-per-bucket tables up to this size meet in one window.
MOST_BUCKETS = 1 << 20


def with_row_index(df: DataFrame, order_cols, name: str = "idx", bucket_cols=None,
                   bucket_width: int = 1 << 16, materialize: bool = False) -> DataFrame:
    """Add the 1-based position of each row in ``order_cols`` order.

    ``order_cols`` must be unique per row.  Rows are grouped in buckets that
    follow the order and have a bounded size: ``floor(key / bucket_width)``
    for one integral, dense key (unique keys => at most ``bucket_width`` rows
    per bucket), or explicit ``bucket_cols`` whose groups are known to be
    bounded.  Composite keys without ``bucket_cols`` (and sparse keys, by
    choice) go through :func:`with_row_index_range`.
    The bucket sizes need a count of the (possibly filtered) input before
    numbering, so the input is evaluated twice (the count side is pruned to
    the key); ``materialize=True`` writes an expensive input once first.  The
    prefix sum runs over one row per bucket; a key whose range spans more than
    ``MOST_BUCKETS`` buckets (sparse or hashed ids) goes by range partitions.
    """
    if materialize:
        # Compute an expensive input once (reliable checkpoint in the shared
        # checkpoint dir) instead of once for the counts and once for the rows.
        from corpuskit.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(df.sparkSession)
        df = df.checkpoint(eager=True)
    keys = _cols(order_cols)
    if bucket_cols is None:
        if len(keys) != 1 or not isinstance(df.select(keys[0]).schema[0].dataType, T.IntegralType):
            # A leading column of a composite key may hold a third of all
            # rows: use sampled range partitioning, which splits hot values.
            return with_row_index_range(df, order_cols, name)
        low, high = df.agg(F.min(keys[0]), F.max(keys[0])).first()
        if low is not None and (high - low) // bucket_width >= MOST_BUCKETS:
            return with_row_index_range(df, order_cols, name)
        bucket = [F.floor(keys[0] / F.lit(bucket_width)).cast("bigint").alias("_b0")]
    else:
        bucket = [c.alias(f"_b{i}") for i, c in enumerate(_cols(bucket_cols))]
    bnames = [f"_b{i}" for i in range(len(bucket))]
    d = df.select("*", *bucket)
    r = d.withColumn("_rank", F.row_number().over(Window.partitionBy(*bnames).orderBy(*keys)))
    sizes = r.groupBy(*bnames).agg(F.max("_rank").alias("_bsize"))
    # Prefix sum over one row per bucket (a small table).
    prior = Window.orderBy(*bnames).rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(*bnames, F.coalesce(F.sum("_bsize").over(prior), F.lit(0)).alias("_off"))
    # NULL keys are a bucket of their own (first): matched null-safely.
    offs = offs.select(*[F.col(b).alias(f"{b}_o") for b in bnames], "_off")
    same = reduce(Column.__and__, [F.col(b).eqNullSafe(F.col(f"{b}_o")) for b in bnames])
    return r.join(offs, same) \
        .withColumn(name, (F.col("_off") + F.col("_rank")).cast("bigint")) \
        .drop("_rank", "_off", *bnames, *[f"{b}_o" for b in bnames])


# Split tables up to this many rows are broadcast (one row per input split).
BROADCAST_SPLITS = 2_000_000


_SHUFFLE_RE = ("Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange RoundRobinPartitioning",
               "Exchange SinglePartition")


def _require_scan_order(df: DataFrame) -> None:
    """The input index relies on rows still sitting in their scan tasks, in
    file order: refuse plans that shuffled them."""
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    except Exception:  # noqa: BLE001  (no JVM plan access: trust the caller)
        return
    if any(tok in plan for tok in _SHUFFLE_RE):
        raise ValueError("with_input_index needs rows in scan order; the input was shuffled. "
                         "Use with_row_index on a unique order key instead.")


def with_input_index(df: DataFrame, name: str = "idx", split_cols=("file_path", "block_start")) -> DataFrame:
    """1-based position in input order for rows of a file scan (after any
    filtering), with no shuffle of the rows themselves.

    One task reads one split in order, so ``monotonically_increasing_id`` is
    consecutive inside a split.  Rows and ids are written once (reliable
    checkpoint), because a second scan may cut other splits; row counts and
    first ids per split come from that copy, and give each split's offset by a
    prefix sum over the splits in ``(file_path, block_start)`` order.  The scan
    order is checked on the plan before the write; a row without an offset
    raises.
    """
    from corpuskit.session import ensure_checkpoint_dir
    _require_scan_order(df)
    ensure_checkpoint_dir(df.sparkSession)
    keys = list(split_cols)
    d = df.withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    per = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_m0"))
    prior = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offs = per.select(*keys, "_m0", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_off")).checkpoint(eager=True)
    side = F.broadcast(offs) if offs.count() <= BROADCAST_SPLITS else offs
    pos = F.col("_off") + F.col("_mid") - F.col("_m0") + 1
    return d.join(side, keys, "left") \
        .withColumn(name, F.when(pos.isNotNull(), pos).otherwise(F.raise_error(F.lit("a row's input split has no offset"))).cast("bigint")) \
        .drop("_mid", "_m0", "_off")


def with_row_index_range(df: DataFrame, order_cols, name: str = "idx",
                         num_partitions: int | None = None) -> DataFrame:
    """Row index for any orderable key: range partition (sampled bounds), local
    sort, ``monotonically_increasing_id`` (partition index in the high bits) and
    per-partition offsets from a count table, one row per partition.

    The sorted rows are written once (reliable checkpoint) and both sides read
    that copy: a second range exchange would sample other bounds, and its counts
    wouldn't fit the rows.  NULL keys come first; ties take consecutive places.
    """
    from corpuskit.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    n = _num_partitions(df, num_partitions)
    keys = _cols(order_cols)
    r = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys) \
        .withColumn("_mid", F.monotonically_increasing_id()).checkpoint(eager=True)
    r = r.withColumn("_pid", F.shiftright("_mid", 33)) \
        .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    prior = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(prior), F.lit(0)).alias("_off"))
    return r.join(F.broadcast(offsets), "_pid") \
        .withColumn(name, (F.col("_off") + F.col("_loc") + 1).cast("bigint")) \
        .drop("_mid", "_pid", "_loc", "_off")


# First-n cuts up to this many rows go by a top-n per task, merged; larger ones by the range index.
TOP_ROWS = 10_000


def take_first(df: DataFrame, n: int, order_cols=None, buffer: int | None = None,
               round_to_buffer: bool = False, accept=None) -> DataFrame:
    """First ``n`` rows in ``order_cols`` order (the max_samples stop), or in
    input order without ``order_cols``: then ``df`` is a scan of files (with
    ``file_path`` and ``block_start``), which is read only as far as needed
    (:func:`corpuskit.operators.prefix.first_rows`), and ``accept`` filters it.

    With ``round_to_buffer`` the cut is rounded up to whole shuffle buffers,
    which is what a stop check placed after each buffer flush yields.  Exactly
    ``min(n, rows)`` rows come back, NULL keys first; which of several rows tied
    at the cut are taken isn't defined.  Up to ``TOP_ROWS`` rows every task keeps
    its first ``n`` and nothing else is moved; beyond that the range row index
    selects the rows.
    """
    if round_to_buffer:
        if not buffer:
            raise ValueError("round_to_buffer needs buffer")
        n = int(math.ceil(n / buffer) * buffer)
    if order_cols is None:
        from corpuskit.operators.prefix import first_rows
        return first_rows(df, n, accept, "_take_idx").drop("_take_idx")
    if n <= TOP_ROWS:
        return df.orderBy(*_cols(order_cols)).limit(n)
    return with_row_index_range(df, order_cols, "_take_idx").where(F.col("_take_idx") <= n).drop("_take_idx")


def shuffle_hash(key, seed) -> Column:
    """Portable per-row shuffle hash: md5 of ``'<seed>:<key>'``."""
    k = F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))
    s = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.md5(F.concat(s, F.lit(":"), k.cast("string")))


def _total(df: DataFrame, idx_col: str, n: int | None) -> int:
    """Rows of a 1-based dense index: its largest value (one aggregate, unless given)."""
    return n if n is not None else df.agg(F.max(idx_col)).first()[0] or 0


def shuffle_position(pos, window, buffer: int, n: int, seed, inverse: bool = False) -> Column:
    """Where the row at 1-based ``pos`` of buffer ``window`` goes (``inverse``:
    which ``pos`` comes there), of ``n`` rows in all: a keyed permutation of the
    buffer, or of the last, partial one.  An expression: nothing is sorted."""
    key, x = shuffle_key(seed, window), pos - 1
    rest, whole = n % buffer, n // buffer
    full = permuted(x, buffer, key, inverse) if whole else F.lit(0)
    if not rest:
        return (full + 1).cast("bigint")
    return (F.when(window < whole, full).otherwise(permuted(x, rest, key, inverse)) + 1).cast("bigint")


def windowed_shuffle(df: DataFrame, idx_col: str, key_col: str | None = None, buffer: int = 5000,
                     seed: int = 42, epoch: int = 0, n: int | None = None) -> DataFrame:
    """Permute rows inside consecutive buffers of ``buffer`` rows.

    ``window_id = (idx - 1) div buffer`` (the last partial buffer included);
    inside a window every row takes the position that a permutation keyed by
    seed + epoch and window gives its own (:func:`shuffle_position`): no shuffle
    of the rows.  ``idx`` is dense and 1-based, ``n`` its largest value (counted
    if not given); ``key_col`` isn't read any more.  Adds ``window_id``,
    ``shuffle_pos`` (1-based in the window) and ``shuffled_idx`` (global position
    after shuffling).
    """
    n = _total(df, idx_col, n)
    d = df.withColumn("window_id", F.floor((F.col(idx_col) - 1) / buffer).cast("bigint"))
    d = d.withColumn("shuffle_pos", shuffle_position(F.col(idx_col) - F.col("window_id") * buffer, F.col("window_id"), buffer, n, seed + epoch))
    return d.withColumn("shuffled_idx", F.col("window_id") * buffer + F.col("shuffle_pos"))


def source_index(shuffled_idx, buffer: int, n: int, seed: int = 42, epoch: int = 0) -> Column:
    """The ``idx`` of the row that :func:`windowed_shuffle` puts at ``shuffled_idx``."""
    s = F.col(shuffled_idx) if isinstance(shuffled_idx, str) else shuffled_idx
    window = F.floor((s - 1) / buffer).cast("bigint")
    return window * buffer + shuffle_position(s - window * buffer, window, buffer, n, seed + epoch, inverse=True)


def micro_batches(df: DataFrame, batch_size: int = 32, pos_col: str = "shuffle_pos") -> DataFrame:
    """Consecutive batches inside each window (restarting per window)."""
    b = F.floor((F.col(pos_col) - 1) / batch_size).cast("bigint")
    return df.withColumn("batch_id", b) \
        .withColumn("pos_in_batch", (F.col(pos_col) - 1 - b * batch_size + 1).cast("bigint"))


def eval_size(n: int, fraction: float = 0.01, cap: int = 5000, threshold: int = 1000) -> int:
    """Eval rows of the split rule: none up to ``threshold`` rows, else
    ``ceil(min(fraction, cap / n) * n)`` (the splitter rounds the test share up)."""
    if n <= threshold:
        return 0
    return int(math.ceil(min(fraction, cap / n) * n))


_PREFIX_SPACE = 16 ** 15  # md5 hex prefixes of 15 digits, uniform


def smallest_hashes(df: DataFrame, key_col: str, seed: int, k: int, n: int) -> DataFrame:
    """The ``k`` rows with the smallest md5(seed : key) (ties by key), exactly.

    md5 is uniform, so a prefix threshold expected to keep ~3k rows selects a
    small candidate set in one filtered pass (widened until it holds k rows);
    only those candidates meet in the final top-k.  A plain top-k would merge
    k rows per input partition in one task.
    """
    h = shuffle_hash(key_col, seed)
    d = df.select(F.col(key_col).alias("_ek"), h.alias("_h"))
    prefix = F.conv(F.substring("_h", 1, 15), 16, 10).cast("decimal(20,0)")
    frac = min(1.0, 3.0 * k / max(n, 1))
    while True:
        limit = min(_PREFIX_SPACE, int(math.ceil(_PREFIX_SPACE * frac)))
        cand = d.where(prefix < F.lit(limit).cast("decimal(20,0)"))
        if limit >= _PREFIX_SPACE or cand.count() >= k:
            return cand.orderBy("_h", "_ek").limit(k)
        frac *= 2


def train_eval_split(df: DataFrame, key_col: str, seed: int = 42, fraction: float = 0.01,
                     cap: int = 5000, threshold: int = 1000, n: int | None = None) -> DataFrame:
    """Tag rows ``train``/``eval``: eval = the ``eval_size`` rows with the
    smallest md5(seed : key) (ties by key); disjoint and complete.

    Rows that share a key are one unit and fall on the same side, so the sizes
    count distinct keys (NULL is a key); every row comes back once.  The eval
    set is a bounded top-k (<= ``cap`` keys), broadcast back.
    """
    keys = df.select(key_col).distinct()
    if n is None:
        n = keys.count()
    k = eval_size(n, fraction, cap, threshold)
    if k == 0:
        return df.withColumn("split", F.lit("train"))
    ev = smallest_hashes(keys, key_col, seed, k, n).select("_ek", F.lit(True).alias("_is_eval"))
    out = df.join(F.broadcast(ev), df[key_col].eqNullSafe(ev["_ek"]), "left")
    return out.withColumn("split", F.when(F.col("_is_eval"), F.lit("eval")).otherwise(F.lit("train"))) \
        .drop("_ek", "_is_eval")


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


def epoch_plan(df: DataFrame, idx_col: str, key_col: str | None = None, epochs: int = 1, buffer: int = 5000,
               seed: int = 42, n: int | None = None) -> DataFrame:
    """Repeat the data once per epoch, each epoch shuffled with seed + epoch, in place as :func:`windowed_shuffle`."""
    n = _total(df, idx_col, n)
    e = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    e = e.withColumn("window_id", F.floor((F.col(idx_col) - 1) / buffer).cast("bigint"))
    return e.withColumn("shuffle_pos", shuffle_position(F.col(idx_col) - F.col("window_id") * buffer, F.col("window_id"), buffer, n, F.lit(seed) + F.col("epoch")))


def assign_steps(df: DataFrame, pos_col: str, per_device: int = 1, accumulation: int = 16,
                 n: int | None = None) -> DataFrame:
    """Optimizer step of each row: ``(pos - 1) div (per_device * accumulation)``;
    the last partial step is dropped (drop-last loader)."""
    eff = per_device * accumulation
    if n is None:
        n = df.count()
    full = (n // eff) * eff
    return df.where(F.col(pos_col) <= full) \
        .withColumn("step", F.floor((F.col(pos_col) - 1) / eff).cast("bigint"))


def plan_steps(counts: DataFrame, n_col: str = "n_valid", max_samples: int | None = None,
               epochs: int = 1, per_device: int = 1, accumulation: int = 16,
               warmup_ratio: float = 0.05, default_warmup: int = 500,
               min_warmup: int = 100) -> DataFrame:
    """One-row plan from a counted sample total (stays a projection, no collect).

    ``max_steps = min(n, max_samples) * epochs div eff`` (n alone without a cap);
    warm-up ``max(min_warmup, int(max_samples * epochs / eff * ratio))`` with a
    cap given, else ``default_warmup``.
    """
    eff = per_device * accumulation
    n = F.col(n_col).cast("bigint")
    samples = F.least(n, F.lit(max_samples).cast("bigint")) if max_samples else n
    if max_samples:
        warm = F.greatest(F.lit(min_warmup), F.floor(F.lit(max_samples * epochs / eff * warmup_ratio)))
    else:
        warm = F.lit(default_warmup)
    return counts.select(
        samples.alias("n_samples"),
        F.lit(eff).cast("bigint").alias("effective_batch"),
        F.lit(epochs).cast("bigint").alias("epochs"),
        F.floor(samples * epochs / eff).cast("bigint").alias("max_steps"),
        warm.cast("bigint").alias("warmup_steps"))


def progress_marks(df: DataFrame, idx_col: str = "idx", every: int = 100_000) -> DataFrame:
    """Rows at which a progress mark is due (every ``every`` accepted rows)."""
    return df.where(F.pmod(F.col(idx_col), F.lit(every)) == 0)


def head_per_group(df: DataFrame, group_cols, order_cols, k: int = 2, name: str = "rank") -> DataFrame:
    """First ``k`` rows per group.  ``row_number() <= k`` lets Spark insert a
    partial WindowGroupLimit before the shuffle, so each task sends at most
    ``k`` rows per group: a hot group cannot overload one task."""
    w = Window.partitionBy(*_cols(group_cols)).orderBy(*_cols(order_cols))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


__all__ = ["with_row_index", "take_first", "shuffle_hash", "shuffle_position", "windowed_shuffle", "source_index", "micro_batches",
           "with_row_index_range", "with_input_index", "eval_size", "train_eval_split", "split_counts", "epoch_plan", "assign_steps",
           "plan_steps", "progress_marks", "head_per_group"]
