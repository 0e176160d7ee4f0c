"""Confusion-based metrics: one pass over the predictions, then expressions on one row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import rnd, safe_div

METRIC_DIGITS = 6


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred",
                     by: tuple = ()) -> DataFrame:
    """(tn, fp, fn, tp) as bigint in a single aggregation (optionally per group)."""
    y, p = F.col(label), F.col(pred)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")

    aggs = [cnt((y == 0) & (p == 0)).alias("tn"), cnt((y == 0) & (p == 1)).alias("fp"),
            cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 1) & (p == 1)).alias("tp")]
    g = df.groupBy(*by) if by else df.groupBy()
    return g.agg(*aggs)


def binary_metrics(conf: DataFrame, digits: int = METRIC_DIGITS, keep: tuple = ()) -> DataFrame:
    """accuracy, r2, precision per class, recall, f1 (class 1), fpr.

    Empty denominators: precision/recall/f1 -> 0, fpr -> null, r2 -> null (one class only).
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    pos, neg = tp + fn, tn + fp
    r2 = F.when((pos == 0) | (neg == 0), F.lit(None).cast("double")).otherwise(
        F.lit(1.0) - ((fp + fn).cast("double") * n.cast("double")) / (pos.cast("double") * neg.cast("double")))
    return conf.select(
        *keep, "tn", "fp", "fn", "tp", n.cast("bigint").alias("n"),
        rnd(safe_div(tp + tn, n), digits).alias("accuracy"),
        rnd(r2, digits).alias("r2"),
        rnd(safe_div(tn, tn + fn), digits).alias("precision_benign"),
        rnd(safe_div(tp, tp + fp), digits).alias("precision_anomaly"),
        rnd(safe_div(tp, tp + fn), digits).alias("recall"),
        rnd(safe_div(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
        rnd(safe_div(fp, fp + tn, None), digits).alias("fpr"),
    )


def derived_rates(conf: DataFrame, digits: int = METRIC_DIGITS) -> DataFrame:
    """TPR, TNR, PPV, NPV, FPR, FNR, FDR; null on an empty denominator."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))

    def r(a, b):
        return rnd(safe_div(a, b, None), digits)

    return conf.select("tn", "fp", "fn", "tp",
                       r(tp, tp + fn).alias("tpr"), r(tn, tn + fp).alias("tnr"),
                       r(tp, tp + fp).alias("ppv"), r(tn, tn + fn).alias("npv"),
                       r(fp, fp + tn).alias("fpr"), r(fn, tp + fn).alias("fnr"),
                       r(fp, tp + fp).alias("fdr"))


def micro_f1(conf: DataFrame, digits: int = METRIC_DIGITS) -> DataFrame:
    """Micro-averaged F1 of a single-label problem equals accuracy."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return conf.select(rnd(safe_div(tp + tn, tn + fp + fn + tp), digits).alias("micro_f1"))


def r2_of_labels(conf: DataFrame, digits: int = METRIC_DIGITS) -> DataFrame:
    """R^2 of 0/1 predictions: 1 - (fp + fn) n / (P N); null with a single class."""
    return binary_metrics(conf, digits).select("r2")


SCOREBOARD_COLUMNS = ["model", "train_accuracy", "test_r2_score", "accuracy", "benign_precision",
                      "anomaly_precision", "recall", "f1_score", "FPR"]


def scoreboard_columns(metrics: DataFrame, train_accuracy: str = "train_accuracy") -> DataFrame:
    """Scoreboard layout with each header over its own value (the reference's list is
    shifted by one: its cv score sits under ``train_accuracy`` and so on)."""
    return metrics.select(
        "model", F.col(train_accuracy).alias("train_accuracy"), F.col("r2").alias("test_r2_score"),
        "accuracy", F.col("precision_benign").alias("benign_precision"),
        F.col("precision_anomaly").alias("anomaly_precision"), "recall",
        F.col("f1").alias("f1_score"), F.col("fpr").alias("FPR"))


def match_counts(df: DataFrame, label: str = "label", pred: str = "pred",
                 digits: int = METRIC_DIGITS) -> DataFrame:
    """Number right, number wrong and accuracy of a prediction column."""
    right = F.sum(F.when(F.col(label) == F.col(pred), 1).otherwise(0)).cast("bigint")
    n = F.count(F.lit(1))
    return df.groupBy().agg(right.alias("n_right"), (n - right).cast("bigint").alias("n_wrong"),
                            rnd(safe_div(right, n), digits).alias("accuracy"))


def epoch_metrics(df: DataFrame, round_col: str = "round", label: str = "label", pred: str = "pred",
                  loss: str = "loss", digits: int = METRIC_DIGITS) -> DataFrame:
    """Per training round: accuracy, F1 of class 1 and mean (not last-batch) loss."""
    y, p = F.col(label), F.col(pred)

    def cnt(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    tp, fp, fn = cnt((y == 1) & (p == 1)), cnt((y == 0) & (p == 1)), cnt((y == 1) & (p == 0))
    right = cnt(y == p)
    n = F.count(F.lit(1))
    return df.groupBy(round_col).agg(
        n.alias("n"), rnd(right / n, digits).alias("accuracy"),
        rnd(safe_div(2 * tp, 2 * tp + fp + fn), digits).alias("f1"),
        rnd(F.avg(loss), digits).alias("mean_loss"))
