"""Windows over segments that may hold most of all rows.

A window partitioned by a key is one task for a hot key.  Here rows fall into
buckets that follow the order; the window runs over (segment, bucket), and what
crosses a bucket's edge comes from a carry table with one row per (segment,
bucket): its first or last element, or its count.  Only that table is windowed by
the segment alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROWS_PER_BUCKET = 1 << 16
MOST_BUCKETS = 4096


def _number(col: str, kind: T.DataType) -> Column:
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(col).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return F.col(col).cast("bigint")
    if isinstance(kind, T.NumericType):
        return F.col(col).cast("double")
    raise TypeError(f"{col}: range buckets need a number, a date or a timestamp")


def range_bucket(df: DataFrame, order_col: str, rows: int = ROWS_PER_BUCKET) -> Column:
    """Bucket number that follows ``order_col``: about ``rows`` rows each, from
    approximate quantiles (one aggregate over the column; at most ``MOST_BUCKETS``
    bounds).  Rows with one value share a bucket; NULLs are in the first."""
    x = _number(order_col, df.schema[order_col].dataType)
    n = df.count()
    k = min(MOST_BUCKETS, -(-n // max(1, rows)))
    if k <= 1:
        return F.lit(0)
    shares = F.array(*[F.lit(i / k) for i in range(1, k)])
    bounds = df.agg(F.percentile_approx(x, shares, F.lit(10 * k)).alias("b")).first().b or []
    bounds = sorted({*bounds})
    if not bounds:
        return F.lit(0)
    held = F.array(*[F.lit(b) for b in bounds])
    steps = [1 << s for s in range(len(bounds).bit_length() - 1, -1, -1)]
    # Binary descent: the number of bounds at or below the value.
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(
        (at + s <= len(bounds)) & (F.try_element_at(held, at + s) <= x), at + s).otherwise(at))


def order_bucket(df: DataFrame, order_col: str, rows: int = ROWS_PER_BUCKET) -> Column:
    """``order_col div rows`` for an integral column (a line number), else :func:`range_bucket`."""
    if isinstance(df.schema[order_col].dataType, T.IntegralType):
        return F.floor(F.col(order_col) / rows).cast("bigint")
    return range_bucket(df, order_col, rows)


def with_neighbour(df: DataFrame, keys, order_cols, values, bucket: Column, name: str = "_next", back: bool = False) -> DataFrame:
    """Add ``name``: a struct of ``values`` of the segment's next row in order
    (``back``: of the one before), NULL for the last (first) one.

    ``bucket`` must follow ``order_cols``.  The carry rows join the data's own
    window as its last (first) row, so NULL keys need no special care."""
    keys, order_cols = list(keys), [order_cols] if isinstance(order_cols, str) else list(order_cols)
    own = df.withColumn("_bk", bucket).withColumn("_v", F.struct(*values))
    order = F.struct(*order_cols)
    edge = (F.max_by if back else F.min_by)("_v", order)
    shift = F.lag if back else F.lead
    carry = own.groupBy(*keys, "_bk").agg(edge.alias("_v")) \
        .withColumn("_v", shift("_v").over(Window.partitionBy(*keys).orderBy("_bk"))).where(F.col("_v").isNotNull())
    both = own.withColumn("_side", F.lit(0)).unionByName(carry.withColumn("_side", F.lit(-1 if back else 1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_bk").orderBy("_side", *order_cols)
    return both.withColumn(name, shift("_v").over(w)).where(F.col("_side") == 0).drop("_bk", "_v", "_side")


def with_position(df: DataFrame, keys, order_cols, bucket: Column, name: str = "_pos") -> DataFrame:
    """Add ``name``: the 1-based position of each row in its segment."""
    keys, order_cols = list(keys), [order_cols] if isinstance(order_cols, str) else list(order_cols)
    own = df.withColumn("_bk", bucket)
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1))
    carry = own.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.coalesce(before, F.lit(0)))
    both = own.withColumn("_side", F.lit(0)).unionByName(carry.withColumn("_side", F.lit(-1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_bk").orderBy("_side", *order_cols)
    # The carry row is the window's first: one too many in row_number.
    return both.withColumn(name, (F.first("_n").over(w) + F.row_number().over(w) - 1).cast("bigint")) \
        .where(F.col("_side") == 0).drop("_bk", "_n", "_side")


__all__ = ["range_bucket", "order_bucket", "with_neighbour", "with_position"]
