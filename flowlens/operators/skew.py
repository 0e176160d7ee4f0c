"""Lookups where one key may carry a large share of the rows.

A shuffle join sends every row of a key to one task, so a key holding a third
of the rows makes one task do a third of the work. Given the number of rows
per key (``key_rows``), keys above a threshold are hot: their lookup entries
are broadcast and their rows are joined map-side; only the remaining rows,
none of whose keys holds more than the threshold, take the shuffle join. The
threshold is at least ``HOT_ROWS`` and at least total / ``MAX_HOT_KEYS``, so at
most ``MAX_HOT_KEYS`` keys are hot whatever the data size. When no key is hot
the plan is a plain join.

``key_rows`` may come from the joined data itself (exact) or from data that
predicts it (e.g. token frequencies of the training set for a test-set
lookup): the result is the same join either way, only the balance depends on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scale knobs (fixed values)
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 100_000


def hot_threshold(total_rows: int) -> int:
    return max(HOT_ROWS, -(-int(total_rows) // MAX_HOT_KEYS))


def hot_key_join(big: DataFrame, table: DataFrame, keys: list[str], key_rows: DataFrame, rows_col: str,
                 how: str = "inner", parts: int | None = None) -> DataFrame:
    """``big`` joined (``how`` = inner or left) with ``table`` on ``keys``, in ``parts`` partitions if given.

    ``key_rows`` has one row per key with ``rows_col`` = its number of ``big`` rows.
    ``table`` may hold several rows per key (a bounded number, e.g. one per class)."""
    if how == "left":
        # a null key matches nothing: its rows need no join, and would all hash to one partition
        known = [F.col(k).isNotNull() for k in keys]
        some = known[0]
        for c in known[1:]:
            some = some & c
        key_rows = key_rows.where(some)
        joined = _hot_key_join(big.where(some), table, keys, key_rows, rows_col, how, parts)
        return joined.unionByName(big.where(~some), allowMissingColumns=True)
    return _hot_key_join(big, table, keys, key_rows, rows_col, how, parts)


def _hot_key_join(big, table, keys, key_rows, rows_col, how, parts=None) -> DataFrame:
    def dealt(df):
        return df if parts is None else df.repartition(parts, *keys)

    stats = key_rows.agg(F.sum(rows_col).alias("t"), F.max(rows_col).alias("m")).first()
    total, top = int(stats["t"] or 0), int(stats["m"] or 0)
    thr = hot_threshold(total)
    if top <= thr:
        return dealt(big).join(dealt(table), keys, how)
    hot_keys = F.broadcast(key_rows.where(F.col(rows_col) > thr).select(*keys))   # <= MAX_HOT_KEYS rows
    hot = F.broadcast(table.join(hot_keys, keys, "left_semi"))
    hot_part = big.join(hot_keys, keys, "left_semi").join(hot, keys, how)
    cold_part = dealt(big.join(hot_keys, keys, "left_anti")).join(dealt(table), keys, how)
    return hot_part.unionByName(cold_part)


def skew_safe_lookup(big: DataFrame, table: DataFrame, keys: list[str], rows_col: str,
                     how: str = "inner") -> DataFrame:
    """``hot_key_join`` where ``table`` has one row per key and carries its own row
    count ``rows_col`` (dropped from the output)."""
    return hot_key_join(big, table.drop(rows_col), keys, table.select(*keys, rows_col), rows_col, how)
