"""Exact global ranks and running sums without a single-partition window.

A plain ``Window.orderBy(x)`` with no partition pulls every row into one task.
The helpers here split the order into buckets first:

* ``running_sum`` / ``ordered_rank`` / ``string_rank``: the rows are written to the
  shared folder range-partitioned by (partition columns, order column) - Spark samples
  the bounds from the whole key, whatever its type - with the number of their range.
  Nothing but a row count reaches the driver.
* ``hash_rank``: the order is an md5 hash, which is uniform, so a hex prefix
  of the hash is already a balanced bucket.

Per bucket totals form a small table (``partitions x buckets`` rows); a
window over that small table gives each bucket's offset, and a window
partitioned by (partition, bucket) finishes the rank inside the bucket.
The answer does not depend on where the bucket boundaries fall.

The bucket count grows with the data, so that one window task sorts about
``ROWS_PER_BUCKET`` rows at most; up to that many rows are one bucket. Every ranked
column is unique inside its partition (distinct values, distinct scores, row keys,
hashes), so no single value can fill a bucket. Past ``BROADCAST_BUCKETS`` the offsets
table is joined by shuffle instead of broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.exprs import stable_hash
from flowlens.session import materialize

# Scale knobs (fixed values): rows one window task sorts at most, about; bucket
# count up to which the offsets table (partitions x buckets rows) is broadcast.
ROWS_PER_BUCKET = 500_000
BROADCAST_BUCKETS = 4096
BROADCAST_ROWS = 100_000     # rows of a small table that may be broadcast


def buckets_for(n_rows: int) -> int:
    """Bucket count that keeps a bucket near ``ROWS_PER_BUCKET`` rows or fewer."""
    return max(1, -(-int(n_rows) // ROWS_PER_BUCKET))


def parts_for(spark, n_rows: int) -> int:
    """Partitions that keep one near ``ROWS_PER_BUCKET`` rows or fewer, at least the session's number."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets_for(n_rows))


def hex_digits_for(n_rows: int, minimum: int) -> int:
    """Hash-prefix length that keeps a prefix bucket near ``ROWS_PER_BUCKET`` rows or fewer."""
    d = minimum
    while 16 ** d * ROWS_PER_BUCKET < n_rows:
        d += 1
    return d


def join_small(df: DataFrame, small: DataFrame, keys: list[str], broadcast: bool | None = None) -> DataFrame:
    """Equi-join (null-safe) a small table onto ``df``; keys are kept once.

    ``broadcast``: True where the caller has checked the size, False for a plain join; by default
    the rows of ``small`` are counted (it is an aggregate, one row per class or column)."""
    if not keys:
        raise ValueError("join_small needs at least one key")
    renamed = small.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in small.columns if c not in keys])
    if broadcast is None:
        renamed = materialize(renamed, "small")      # computed once, for the count and for the join
        broadcast = renamed.count() <= BROADCAST_ROWS
    if broadcast:
        renamed = F.broadcast(renamed)
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = c if cond is None else cond & c
    out = df.join(renamed, cond, "inner")
    return out.drop(*[f"__r_{k}" for k in keys])


def range_buckets(df: DataFrame, part: list[str], order_col: str, out: str) -> tuple[DataFrame, int]:
    """``df``, written once, with ``out`` = the number of the value range that holds the row
    (monotone in (``part``, ``order_col``), nulls first), and the number of ranges."""
    table = df if hasattr(df, "_table_path") else materialize(df, "rank-input")
    n_buckets = buckets_for(table.count())
    if n_buckets == 1:
        return table.withColumn(out, F.lit(0)), 1
    ranged = table.repartitionByRange(n_buckets, *part, order_col).withColumn(out, F.spark_partition_id())
    # written, so that the bounds, which are sampled, are the same for all that follows
    return materialize(ranged, "rank-ranges"), n_buckets


def running_sum(df: DataFrame, order_col: str, value_cols: list[str], partition_cols: tuple = (),
                descending: bool = False, prefix: str = "cum_", small_partitions: bool = True,
                next_cols: tuple = ()) -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order_col`` order within ``partition_cols``.

    ``order_col`` must be unique inside a partition (aggregate to distinct values first);
    ties would otherwise make the running sum depend on the physical order. ``next_cols`` (without
    nulls) get a column ``next_<col>``: the value in the following row, null in the last.
    """
    part = list(partition_cols)
    b = "__bucket"
    staged, n_buckets = range_buckets(df, part, order_col, b)
    if descending:
        staged = staged.withColumn(b, -F.col(b))
    first = F.max_by if descending else F.min_by
    tot = staged.groupBy(*part, b).agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols],
                                       *[first(v, order_col).alias(f"__f_{v}") for v in next_cols])
    w_order = Window.partitionBy(*part).orderBy(b) if part else Window.orderBy(b)
    w_small = w_order.rowsBetween(Window.unboundedPreceding, -1)
    # The offsets table has |partitions| x n_buckets rows: bounded when the partition
    # columns are schema-like (columns, classes); otherwise let AQE pick the join.
    off = tot.select(*part, b, *[F.coalesce(F.sum(f"__t_{v}").over(w_small), F.lit(0)).alias(f"__o_{v}") for v in value_cols],
                     *[F.lead(f"__f_{v}").over(w_order).alias(f"__e_{v}") for v in next_cols])
    joined = join_small(staged, off, part + [b], broadcast=small_partitions and n_buckets <= BROADCAST_BUCKETS)
    if n_buckets > 1:          # as many partitions as ranges, so that what a task sorts does not grow with the data
        joined = joined.repartition(max(n_buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *part, b)
    order = F.col(order_col).desc_nulls_last() if descending else F.col(order_col).asc_nulls_first()
    w_rows = Window.partitionBy(*part, b).orderBy(order)
    w = w_rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # what follows the last row of a bucket is the first of the next one
    new = {prefix + v: F.col(f"__o_{v}") + F.sum(v).over(w) for v in value_cols}
    new |= {f"next_{v}": F.coalesce(F.lead(v).over(w_rows), F.col(f"__e_{v}")) for v in next_cols}
    return joined.withColumns(new).drop(b, *[f"__o_{v}" for v in value_cols], *[f"__e_{v}" for v in next_cols])


def ordered_rank(df: DataFrame, order_col: str, tie_col: str, partition_cols: tuple = (),
                 out: str = "rank", small_partitions: bool = True) -> DataFrame:
    """1-based ``row_number`` over (``order_col``, ``tie_col``) within ``partition_cols``, exact."""
    part = list(partition_cols)
    b = "__bucket"
    staged, n_buckets = range_buckets(df, part, order_col, b)
    tot = staged.groupBy(*part, b).agg(F.count(F.lit(1)).alias("__t"))
    w_small = (Window.partitionBy(*part).orderBy(b) if part else Window.orderBy(b)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*part, b, F.coalesce(F.sum("__t").over(w_small), F.lit(0)).alias("__o"))
    joined = join_small(staged, off, part + [b], broadcast=small_partitions and n_buckets <= BROADCAST_BUCKETS)
    w = Window.partitionBy(*part, b).orderBy(F.col(order_col).asc_nulls_first(), F.col(tie_col))
    return (joined.withColumn(out, (F.col("__o") + F.row_number().over(w)).cast("bigint"))
            .drop(b, "__o"))


def hash_rank(df: DataFrame, key: str, seed: int, partition_cols: tuple = (), out: str = "rank",
              hex_digits: int = 3, small_partitions: bool = True) -> DataFrame:
    """1-based rank by (md5(seed#key), key) within ``partition_cols``, exact and balanced.

    ``hex_digits`` is the shortest prefix used; longer prefixes are taken when the
    row count needs them (one count, which a Parquet-backed frame answers from footers)."""
    part = list(partition_cols)
    h, b = "__h", "__hb"
    hex_digits = hex_digits_for(df.count(), hex_digits)
    staged = df.withColumn(h, stable_hash(seed, key)).withColumn(b, F.substring(h, 1, hex_digits))
    tot = staged.groupBy(*part, b).agg(F.count(F.lit(1)).alias("__t"))
    w_small = (Window.partitionBy(*part).orderBy(b) if part else Window.orderBy(b)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*part, b, F.coalesce(F.sum("__t").over(w_small), F.lit(0)).alias("__o"))
    joined = join_small(staged, off, part + [b], broadcast=small_partitions and 16 ** hex_digits <= BROADCAST_BUCKETS)
    w = Window.partitionBy(*part, b).orderBy(h, key)
    return (joined.withColumn(out, (F.col("__o") + F.row_number().over(w)).cast("bigint"))
            .drop(h, b, "__o"))


def string_rank(df: DataFrame, col: str, partition_cols: tuple = (), out: str = "rank",
                small_partitions: bool = True) -> DataFrame:
    """Exact 1-based rank of a unique (within partition) string column in byte order,
    without a single-task window. Ranges are cut by whole strings, so strings that share
    a long prefix spread like any others."""
    return ordered_rank(df, col, col, partition_cols, out, small_partitions)
