"""Feedback loop: split the scored test rows, collect mistakes, refit, re-evaluate.

Mistakes are collected from the feedback part only and the evaluation part is
never trained on. The reference retrains on the mistakes alone, which wrecks
the model (accuracy 0.77 -> 0.38 in its own results); ``mode='union'`` (the
default) refits on train + weighted corrections, ``mode='corrections_only'``
reproduces the reference's behaviour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.curves import auroc_and_ap
from flowlens.operators.metrics import binary_metrics, confusion_matrix
from flowlens.operators.split import stratified_split, random_split
from flowlens.operators.textmodel import text_classifier

EVAL_FRACTION = "0.7"
PLAIN_EVAL_FRACTION = "0.2"      # of the unstratified variant: 80 % feedback


def feedback_eval_split(df: DataFrame, key: str = "row_id", label: str | None = "label",
                        eval_fraction=EVAL_FRACTION, seed: int = 42, out: str = "part") -> DataFrame:
    """Adds ``part`` in {'feedback', 'eval'}; eval = ceil(f n) rows, stratified when ``label`` is set."""
    sp = (stratified_split(df, key, label, eval_fraction, seed, "__p") if label
          else random_split(df, key, eval_fraction, seed, "__p"))
    return sp.withColumn(out, F.when(F.col("__p") == "test", F.lit("eval")).otherwise(F.lit("feedback"))).drop("__p")


def feedback_records(pred: DataFrame, text: str = "text", label: str = "label", pred_col: str = "pred",
                     key: str = "row_id", display_chars: int = 200) -> DataFrame:
    """(key, text (display cut), predicted, actual, correct, corrected_label)."""
    return pred.select(key, F.substring(F.col(text), 1, display_chars).alias("text"),
                       F.col(pred_col).alias("predicted"), F.col(label).alias("actual"),
                       F.when(F.col(pred_col) == F.col(label), 1).otherwise(0).alias("correct"),
                       F.col(label).alias("corrected_label"))


def collect_corrections(pred: DataFrame, label: str = "label", pred_col: str = "pred") -> DataFrame:
    """Mispredicted rows; their true label is the correction."""
    return pred.where(F.col(pred_col) != F.col(label))


def refit_frame(train: DataFrame, corrections: DataFrame, cols: list[str], weight: float = 2.0,
                mode: str = "union", weight_col: str = "weight") -> DataFrame:
    """Training rows for the refit: train (weight 1) + corrections (``weight``), or corrections only."""
    corr = corrections.select(*cols, F.lit(float(weight)).alias(weight_col))
    if mode == "corrections_only":
        return corr
    if mode != "union":
        raise ValueError(f"unknown refit mode {mode!r}")
    return train.select(*cols, F.lit(1.0).alias(weight_col)).unionByName(corr)


def refit(train: DataFrame, corrections: DataFrame, test: DataFrame, before: DataFrame, cols: list[str],
          weight: float = 2.0, mode: str = "union", classes: tuple = (0, 1)) -> DataFrame:
    """Predictions on ``test`` of the model refitted with the corrections; without any correction
    there is nothing to learn and ``before`` (the predictions of the model at hand) is returned."""
    if corrections.limit(1).count() == 0:
        return before
    frame = refit_frame(train, corrections, cols, weight, mode)
    return text_classifier(frame, test, weight="weight", classes=classes)


def evaluate(pred: DataFrame, stage: str | None = None, score: str = "log_odds", label: str = "label",
             pred_col: str = "pred") -> DataFrame:
    """binary metrics + AUROC + average precision as one row (tagged with ``stage``)."""
    keep = (F.lit(stage).alias("stage"),) if stage else ()
    m = binary_metrics(confusion_matrix(pred, label, pred_col), keep=keep)
    areas = auroc_and_ap(pred, score, label).first()      # two numbers
    return (m.withColumn("auroc", F.lit(areas["auroc"]).cast("double"))
            .withColumn("average_precision", F.lit(areas["average_precision"]).cast("double")))


def before_after_report(before: DataFrame, after: DataFrame) -> DataFrame:
    return evaluate(before, "before").unionByName(evaluate(after, "after"))


def log_loss(label: str = "label", p1: str = "p1", eps: float = 1e-15):
    p = F.greatest(F.least(F.col(p1), F.lit(1.0 - eps)), F.lit(eps))
    return -(F.col(label) * F.log(p) + (F.lit(1) - F.col(label)) * F.log(F.lit(1.0) - p))
