"""Fits and scores over an array<double> feature column (embeddings, wide feature sets).

Per-column expressions grow the plan with the dimension (64 columns x a few
operators x classes = thousands of expression nodes, each built through the
Python bridge and analysed by Catalyst). Here a fit is ONE aggregation with
MLlib's ``Summarizer`` over the vector, and applying it is a couple of
higher-order functions over the array, whatever the dimension.
"""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VAR_FLOOR = 1e-9


def _lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def fit_minmax_vec(df: DataFrame, vec: str = "vec") -> dict:
    """Per-dimension min and max of the array column (one aggregation)."""
    s = Summarizer.metrics("min", "max")
    row = df.select(s.summary(array_to_vector(vec)).alias("s")).first()["s"]
    return {"min": row["min"].toArray().tolist(), "max": row["max"].toArray().tolist()}


def apply_minmax_vec(df: DataFrame, fit: dict, vec: str = "vec", out: str | None = None) -> DataFrame:
    """(x - min) / (max - min) per dimension; constant dimension -> x - min; no clipping."""
    lo = fit["min"]
    rng = [(h - l) if h != l else 1.0 for l, h in zip(lo, fit["max"])]
    z = F.arrays_zip(F.col(vec).alias("x"), _lit_array(lo).alias("lo"), _lit_array(rng).alias("r"))
    scaled = F.transform(z, lambda e: (e["x"] - e["lo"]) / e["r"])
    return df.withColumn(out or vec, scaled)


def fit_gaussian_vec(df: DataFrame, vec: str = "vec", label: str | None = None) -> dict:
    """{class: {'n', 'mean', 'var'}}: population variance per dimension, floored by
    1e-9 x the largest variance; one aggregation for all classes."""
    s = Summarizer.metrics("mean", "variance", "count")
    g = df.groupBy(label) if label else df.groupBy()
    rows = g.agg(s.summary(array_to_vector(vec)).alias("s")).collect()   # one row per class
    out = {}
    for r in rows:
        st = r["s"]
        n = st["count"]
        var = [v * (n - 1) / n if n > 0 else 0.0 for v in st["variance"].toArray().tolist()]
        vmax = max(var) if var else 0.0
        eps = VAR_FLOOR * vmax if vmax > 0 else VAR_FLOOR
        out[r[label] if label else None] = {"n": n, "mean": st["mean"].toArray().tolist(),
                                            "var": [v + eps for v in var]}
    return out


def gaussian_distance_vec(fit: dict, vec: str = "vec", sign: float = 1.0) -> Column:
    """sign * negative log-density of a diagonal Gaussian: const + 0.5 sum (x - m)^2 / v."""
    const = sum(0.5 * math.log(2 * math.pi * v) for v in fit["var"])
    z = F.arrays_zip(F.col(vec).alias("x"), _lit_array(fit["mean"]).alias("m"), _lit_array(fit["var"]).alias("v"))
    quad = F.aggregate(z, F.lit(0.0), lambda acc, e: acc + (e["x"] - e["m"]) * (e["x"] - e["m"]) / e["v"])
    return F.lit(float(sign)) * (F.lit(const) + F.lit(0.5) * quad)
