"""Label rules and prediction columns as built-in expressions (no UDFs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def binarize_equals(df: DataFrame, col: str, benign: str = "normal", out: str = "label") -> DataFrame:
    """0 where ``col == benign`` else 1; a null label is not benign, so it becomes 1."""
    return df.withColumn(out, F.when(F.col(col) == F.lit(benign), 0).otherwise(1))


def binarize_prefix(df: DataFrame, col: str, prefix: str = "benign", out: str = "label",
                    check_nulls: bool = True) -> DataFrame:
    """0 where lower(col) starts with the (lower-cased) prefix, else 1.

    The reference's lambda fails on a missing label; with ``check_nulls`` the job fails on the
    first such row, in the same projection (no extra pass), instead of guessing.
    """
    label = F.when(F.lower(F.col(col)).startswith(prefix.lower()), 0).otherwise(1)
    if check_nulls:
        label = F.when(F.col(col).isNull(), F.raise_error(F.lit(f"column {col!r} has null labels")).cast("int")).otherwise(label)
    return df.withColumn(out, label)


def decode_label(df: DataFrame, col: str = "label", out: str = "label_name",
                 names: tuple[str, str] = ("normal", "anomaly")) -> DataFrame:
    """0 -> names[0], anything else -> names[1]."""
    return df.withColumn(out, F.when(F.col(col) == 0, F.lit(names[0])).otherwise(F.lit(names[1])))


def cast_binary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Boolean and whole-number columns to int (true -> 1, 2 -> 2)."""
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


def threshold(df: DataFrame, score: str, t: float = 0.5, out: str = "pred") -> DataFrame:
    """1 when score > t (strictly), else 0."""
    return df.withColumn(out, F.when(F.col(score) > F.lit(t), 1).otherwise(0))


def mispredicted(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return df.where(F.col(pred) != F.col(label))


def class_subset(df: DataFrame, label: str, value) -> DataFrame:
    return df.where(F.col(label) == F.lit(value))
