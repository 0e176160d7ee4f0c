"""One-class scorers and their blend (the two-scorer flow of SURVEY E4).

The reference trains a generative critic per class; that is single-machine
deep learning and is re-aimed here: a scorer fitted on ONE class is a diagonal
Gaussian (per-feature mean / population variance, one aggregation), and a
row's score is its distance from that class, the negative log-density. The
anomaly scorer's sign is flipped, as in the reference, so for both scores a
larger value means "more anomalous". Both are min-max normalised over the
scored set and blended with fixed weights.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import rnd

VAR_FLOOR = 1e-9
# Blend weights and cut (fixed values)
BLEND_WEIGHTS = (1.5, 0.5)
BLEND_CUT = 0.5


def fit_one_class(train_subset: DataFrame, cols: list[str]) -> dict:
    """Per-feature mean and floored population variance of one class (one aggregation)."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    row = train_subset.agg(*aggs).first()
    vmax = max([row[f"v{i}"] or 0.0 for i in range(len(cols))] or [0.0])
    eps = VAR_FLOOR * vmax if vmax > 0 else VAR_FLOOR
    return {"cols": list(cols), "mean": [row[f"m{i}"] for i in range(len(cols))],
            "var": [(row[f"v{i}"] or 0.0) + eps for i in range(len(cols))]}


def one_class_distance(fit: dict, sign: float = 1.0):
    """Column: sign * negative Gaussian log-density under a one-class fit."""
    const = sum(0.5 * math.log(2 * math.pi * v) for v in fit["var"])
    quad = F.lit(0.0)
    for c, m, v in zip(fit["cols"], fit["mean"], fit["var"]):
        d = F.col(c).cast("double") - F.lit(m)
        quad = quad + d * d / F.lit(v)
    return F.lit(float(sign)) * (F.lit(const) + F.lit(0.5) * quad)


def one_class_scorer(train_subset: DataFrame, test: DataFrame, cols: list[str], sign: float = 1.0,
                     key: str = "row_id", keep: tuple = ("label",), out: str = "score") -> DataFrame:
    """(key, keep..., score) for every test row, from a model fitted on one class only."""
    return test.select(key, *keep, one_class_distance(fit_one_class(train_subset, cols), sign).alias(out))


def blend_scores(df: DataFrame, benign: str = "score_benign", anomaly: str = "score_anomaly",
                 weights: tuple[float, float] = BLEND_WEIGHTS, cut: float = BLEND_CUT,
                 out: str = "blend", pred: str = "pred") -> DataFrame:
    """blend = (w0 * benign + w1 * anomaly) / 2; class 1 when blend > cut."""
    b = (F.lit(weights[0]) * F.col(benign) + F.lit(weights[1]) * F.col(anomaly)) / F.lit(2.0)
    return df.withColumn(out, b).withColumn(pred, F.when(F.col(out) > F.lit(cut), 1).otherwise(0))


# ---------------------------------------------------------------- array<double> features

def one_class_scorer_vec(train_subset: DataFrame, test: DataFrame, vec: str = "vec", sign: float = 1.0,
                         key: str = "row_id", keep: tuple = ("label",), out: str = "score") -> DataFrame:
    """``one_class_scorer`` over an array column: one Summarizer fit, one aggregate() per row."""
    from flowlens.operators.vectors import fit_gaussian_vec, gaussian_distance_vec
    fit = fit_gaussian_vec(train_subset, vec)[None]
    return test.select(key, *keep, gaussian_distance_vec(fit, vec, sign).alias(out))


def two_scorer_blend_vec(train: DataFrame, test: DataFrame, vec: str = "vec", label: str = "label",
                         key: str = "row_id", digits: int = 6) -> DataFrame:
    """(key, label, score_benign, score_anomaly, blend, pred) over the test rows.

    Both class fits come from one aggregation, and both scores from one projection (no join)."""
    from flowlens.operators.scale import apply_minmax_scale, fit_minmax_scale
    from flowlens.operators.vectors import fit_gaussian_vec, gaussian_distance_vec
    fits = fit_gaussian_vec(train, vec, label)
    raw = test.select(key, label, gaussian_distance_vec(fits[0], vec, 1.0).alias("score_benign"),
                      gaussian_distance_vec(fits[1], vec, -1.0).alias("score_anomaly"))
    scored = apply_minmax_scale(raw, fit_minmax_scale(raw, ["score_benign", "score_anomaly"]))
    out = blend_scores(scored)
    return out.select(key, label, rnd("score_benign", digits).alias("score_benign"),
                      rnd("score_anomaly", digits).alias("score_anomaly"), rnd("blend", digits).alias("blend"), "pred")
