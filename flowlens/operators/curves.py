"""ROC / precision-recall points, exact AUROC and average precision.

Everything starts from the distinct-score table (score, pos, neg), a partial
aggregation of the scored rows. Running counts over it are computed by
``ranks.running_sum`` (value ranges, so no single-task window), and the
two class totals (two numbers) are read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import rnd, safe_div
from flowlens.operators.ranks import running_sum
from flowlens.session import materialize


def score_table(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(score, pos, neg) per distinct non-null score."""
    y = F.col(label)
    return (df.where(F.col(score).isNotNull())
            .groupBy(F.col(score).cast("double").alias("score"))
            .agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                 F.sum(F.when(y == 1, 0).otherwise(1)).cast("bigint").alias("neg")))


def _totals(st: DataFrame) -> tuple[int, int]:
    row = st.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return int(row["p"] or 0), int(row["n"] or 0)


def cumulative_counts(df: DataFrame, score: str = "score", label: str = "label",
                      neighbours: bool = False) -> tuple[DataFrame, int, int]:
    """Distinct scores, descending, with tp / fp = counts at or above the score (and, with
    ``neighbours``, next_pos / next_neg = the counts of the score below). The table of distinct
    scores is written once and read for the totals and the running counts."""
    st = materialize(score_table(df, score, label), "scores")
    p, n = _totals(st)
    cum = running_sum(st, "score", ["pos", "neg"], descending=True, next_cols=("pos", "neg") if neighbours else ())
    return cum.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp"), p, n


def _drop_collinear(cum: DataFrame) -> DataFrame:
    """Keep the first and last point and every point where the (fp, tp) path bends: where the step
    to the next point differs from the step to this one."""
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    return cum.where(first | F.col("next_pos").isNull() | bends).drop("next_pos", "next_neg")


def roc_points(df: DataFrame, score: str = "score", label: str = "label", drop_intermediate: bool = True,
               digits: int = 6) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, plus the origin (threshold null, 0, 0)."""
    cum, p, n = cumulative_counts(df, score, label, neighbours=drop_intermediate)
    if drop_intermediate:
        cum = _drop_collinear(cum)
    pts = cum.select(F.col("score").alias("threshold"),
                     rnd(safe_div(F.col("fp"), F.lit(n), None), digits).alias("fpr"),
                     rnd(safe_div(F.col("tp"), F.lit(p), None), digits).alias("tpr"))
    origin = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(pts)


def pr_points(df: DataFrame, score: str = "score", label: str = "label", digits: int = 6) -> DataFrame:
    """(threshold, precision, recall) per distinct score, plus the end point (null, 1, 0)."""
    cum, p, _ = cumulative_counts(df, score, label)
    recall = safe_div(F.col("tp"), F.lit(p), 1.0) if p else F.lit(1.0)
    pts = cum.select(F.col("score").alias("threshold"),
                     rnd(safe_div(F.col("tp"), F.col("tp") + F.col("fp")), digits).alias("precision"),
                     rnd(recall, digits).alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"),
                                          F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def _ranked_sums(df: DataFrame, score: str, label: str) -> DataFrame:
    """Distinct scores with descending running counts (no class totals needed)."""
    st = score_table(df, score, label)
    cum = running_sum(st, "score", ["pos", "neg"], descending=True)
    return cum.withColumnRenamed("cum_pos", "tp").withColumnRenamed("cum_neg", "fp")


def _auc_ap_exprs(digits: int):
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    p, n = F.sum(pos), F.sum(neg)
    # sum over scores of pos * (negatives below + neg / 2) = N P - sum(pos fp) + sum(pos neg) / 2
    auc = F.when((p > 0) & (n > 0), (n * p - F.sum(pos * fp) + F.sum(pos * neg) / 2.0) / (p * n))
    ap = F.when(p > 0, F.sum(pos * (tp / (tp + fp))) / p)
    return rnd(auc, digits), rnd(ap, digits), p.cast("bigint"), n.cast("bigint")


def auroc(df: DataFrame, score: str = "score", label: str = "label", digits: int = 6) -> DataFrame:
    """Exact area under the ROC curve (ties count one half); null with one class.
    One aggregation over the running counts: the class totals are its own sums."""
    auc, _, p, n = _auc_ap_exprs(digits)
    return _ranked_sums(df, score, label).agg(auc.alias("auroc"), p.alias("n_pos"), n.alias("n_neg"))


def average_precision(df: DataFrame, score: str = "score", label: str = "label", digits: int = 6) -> DataFrame:
    """Step-wise AP: sum over distinct scores (descending) of (pos / P) * precision there."""
    _, ap, _, _ = _auc_ap_exprs(digits)
    return _ranked_sums(df, score, label).agg(ap.alias("average_precision"))


def auroc_and_ap(df: DataFrame, score: str = "score", label: str = "label", digits: int = 6) -> DataFrame:
    """Both areas from one pass over the running counts."""
    auc, ap, _, _ = _auc_ap_exprs(digits)
    return _ranked_sums(df, score, label).agg(auc.alias("auroc"), ap.alias("average_precision"))
