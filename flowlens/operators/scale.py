"""Scalers: one aggregation fits every column; apply is a projection.

A fit is a small long-format DataFrame (one row per column). Applying it
collects those d rows (bounded by the schema, never by the data) and writes
literal expressions, so the scaled frame stays inside whole-stage codegen with
no join at all. MLlib's StandardScaler uses the sample std and MinMaxScaler maps
a constant column to 0.5; neither matches the reference, hence these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _long_fit(df: DataFrame, cols: list[str], stats: dict) -> DataFrame:
    """One pass computing ``stats`` (name -> fn(col)) for each column, unpivoted to long form."""
    aggs = [fn(F.col(c).cast("double")).alias(f"{name}__{i}")
            for i, c in enumerate(cols) for name, fn in stats.items()]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column"), F.lit(i).alias("pos"),
                     *[F.col(f"{name}__{i}").alias(name) for name in stats])
            for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*rows)).alias("s")).select("s.*")


def fit_standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, pos, mean, std) with the population std (ddof = 0)."""
    return _long_fit(df, cols, {"mean": F.avg, "std": F.stddev_pop})


def fit_zscore_sample(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, pos, mean, std) with the sample std (ddof = 1)."""
    return _long_fit(df, cols, {"mean": F.avg, "std": F.stddev_samp})


def fit_minmax_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, pos, min, max)."""
    return _long_fit(df, cols, {"min": F.min, "max": F.max})


def _params(fit: DataFrame) -> list:
    rows = fit.collect()  # d rows: one per fitted column
    return sorted(rows, key=lambda r: r["pos"])


def apply_standard_scale(df: DataFrame, fit: DataFrame) -> DataFrame:
    """(x - mean) / std; a zero std leaves the centred value unscaled (-> 0 for constants)."""
    exprs = {}
    for r in _params(fit):
        c, mean, std = r["column"], r["mean"], r["std"]
        if mean is None:
            continue
        denom = std if std not in (None, 0.0) else 1.0
        exprs[c] = ((F.col(c).cast("double") - F.lit(mean)) / F.lit(denom)).alias(c)
    return df.select(*[exprs.get(c, F.col(c)) for c in df.columns])


apply_zscore_sample = apply_standard_scale


def apply_minmax_scale(df: DataFrame, fit: DataFrame) -> DataFrame:
    """(x - min) / (max - min) with the train range; constant column -> 0; no clipping."""
    exprs = {}
    for r in _params(fit):
        c, lo, hi = r["column"], r["min"], r["max"]
        if lo is None:
            continue
        rng = (hi - lo) if hi != lo else 1.0
        exprs[c] = ((F.col(c).cast("double") - F.lit(lo)) / F.lit(rng)).alias(c)
    return df.select(*[exprs.get(c, F.col(c)) for c in df.columns])


def score_minmax(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Min-max of a score over the scored set itself (fit = apply)."""
    fit = fit_minmax_scale(df, [col])
    res = apply_minmax_scale(df, fit)
    return res.withColumnRenamed(col, out) if out and out != col else res
