"""Approximate quantiles from mergeable KLL sketches, with their rank error.

A state is one row (group..., column, n, mean, std, min, max, sketch): Spark's KLL aggregate runs
map-side over the wide frame, so one pass and one shuffled row per task and group serve all columns.
States of parts (days, folders) can be saved and merged later; ``n``, ``min`` and ``max`` stay exact.

Defined cases: nulls and NaN don't count; a column without values has n = 0 and null statistics
and quantiles; a constant column gives its value; an empty frame gives one state per column
(no group) or none (with groups).

Sketches of size k answer within ``rank_bound(k)`` of the asked rank, a fraction of n. The answers
of two runs may differ within that bound, as the sketch's compactions are random.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import rnd

DEFAULT_K = 4096
STATS = ("n", "mean", "std", "min", "max", "sketch")


def rank_bound(k: int) -> float:
    """Rank error that a sketch of size ``k`` keeps: twice its published 99 % bound (over five
    standard deviations)."""
    return 2 * 2.296 / k ** 0.9021


def _number(c: str):
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def states(df: DataFrame, cols: list[str], by: list[str] | None = None, k: int = DEFAULT_K) -> DataFrame:
    """One state per (group, column)."""
    by = by or []
    aggs = []
    for i, c in enumerate(cols):
        x = _number(c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"), F.stddev_samp(x).alias(f"std{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"),
                 F.kll_sketch_agg_double(x, F.lit(k)).alias(f"sketch{i}")]
    keys = [F.col(f"`{b}`").alias(f"__by{j}") for j, b in enumerate(by)]      # clashes with no aggregate
    wide = df.groupBy(*keys).agg(*aggs)
    per = [F.struct(F.lit(c).alias("column"), *[F.col(f"{s}{i}").alias(s) for s in STATS]) for i, c in enumerate(cols)]
    return (wide.select(*[f"__by{j}" for j in range(len(by))], F.explode(F.array(*per)).alias("__s"))
            .select(*[F.col(f"__by{j}").alias(b) for j, b in enumerate(by)], "__s.*"))


def merge(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """States of the union of the parts, per column (and group); means and deviations by pooled moments."""
    n = F.col("n").cast("double")
    total = F.sum(n)
    mean = F.sum(F.col("mean") * n) / total
    # sum of squares about the pooled mean: within the parts, plus between them
    squares = F.sum(F.coalesce(F.col("std"), F.lit(0.0)) ** 2 * (n - 1) + n * F.col("mean") ** 2) - total * mean ** 2
    return parts.groupBy(*(by or []), "column").agg(
        F.sum("n").alias("n"), mean.alias("mean"),
        F.when(F.sum("n") > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (total - 1))).alias("std"),
        F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("sketch"))


def quantiles(sts: DataFrame, probs: list[float]) -> DataFrame:
    """The states without their sketch, with (p, q) per asked probability."""
    ps = F.array(*[F.lit(float(p)) for p in probs])
    qs = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", ps))
    pairs = F.when(F.col("n") > 0, F.arrays_zip(ps.alias("p"), qs.alias("q"))).otherwise(
        F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(None).cast("double").alias("q")) for p in probs]))
    return sts.withColumn("__pq", F.explode(pairs)).select(*[c for c in sts.columns if c != "sketch"], "__pq.p", "__pq.q")


def describe_sketch(df: DataFrame, cols: list[str], digits: int = 6, k: int = DEFAULT_K) -> DataFrame:
    """The columns of ``profile.describe`` from one pass; quartiles within ``rank_bound(k)``."""
    q = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])))
    st = states(df, cols, k=k).withColumn("__q", q)
    out = [*[F.col(s).alias(s) for s in ("mean", "std", "min")],
           *[F.col("__q")[j].alias(f"q{p}") for j, p in enumerate((25, 50, 75))], F.col("max").alias("max")]
    names = ("mean", "std", "min", "q25", "q50", "q75", "max")
    return st.select("column", F.col("n").alias("count"), *out).select(
        "column", "count", *[rnd(c, digits).alias(c) for c in names])


def rank_errors(df: DataFrame, answers: DataFrame) -> DataFrame:
    """``answers`` (column, n, p, q) with rank_error: how far p * n lies from the ranks that q holds, over n.

    An audit by a second pass. The answers (columns x probabilities rows, bounded by the request)
    reach the tasks as literals; the ranks are counted in one aggregation."""
    rows = answers.select("column", "p", "q").where("q is not null").collect()
    if not rows:
        return answers.withColumn("rank_error", F.lit(None).cast("double"))
    aggs = []
    for i, r in enumerate(rows):
        x = _number(r["column"])
        aggs += [F.count(F.when(x < F.lit(r["q"]), 1)).alias(f"lt{i}"), F.count(F.when(x <= F.lit(r["q"]), 1)).alias(f"le{i}")]
    per = [F.struct(F.lit(r["column"]).alias("column"), F.lit(r["p"]).alias("p"), F.col(f"lt{i}").alias("lt"),
                    F.col(f"le{i}").alias("le")) for i, r in enumerate(rows)]
    ranks = df.agg(*aggs).select(F.explode(F.array(*per)).alias("__r")).select("__r.*")
    goal = F.col("p") * F.col("n")
    off = F.greatest(F.col("lt") - goal, goal - F.col("le"), F.lit(0.0)) / F.col("n")
    return answers.join(F.broadcast(ranks), ["column", "p"], "left").select(*answers.columns, off.alias("rank_error"))
