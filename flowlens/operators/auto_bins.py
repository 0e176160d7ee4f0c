"""Histograms whose bin width follows from the data, by numpy's present ``auto`` rule.

Per label, with n values of range r and quartile distance q: Sturges' width r / (log2(n) + 1),
Freedman and Diaconis' width 2 q / n^(1/3), the latter at least r / sqrt(n) / 2 so that far outliers don't
make bins without end; the smaller width counts. Quartiles are exact (linear between order statistics),
read off the running counts of the distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import rnd
from flowlens.operators.ranks import join_small, running_sum
from flowlens.session import materialize


def bin_rule(values: DataFrame, label: str) -> DataFrame:
    """(label, lo, hi, n, bins) from a written table (label, value, c) of distinct values and their counts."""
    stats = values.groupBy(label).agg(F.sum("c").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    run = running_sum(values.withColumn("at", F.col("value")), "value", ["c"], (label,), next_cols=("at",))
    run = join_small(run, stats, [label])

    def quartile(p: float):
        pos = (F.col("n") - 1) * F.lit(p)
        first = F.floor(pos)
        here = (F.col("cum_c") - F.col("c") <= first) & (first < F.col("cum_c"))
        after = F.when(first + 1 < F.col("cum_c"), F.col("value")).otherwise(F.coalesce("next_at", "value"))
        return F.max(F.when(here, F.col("value") + (after - F.col("value")) * (pos - first)))

    got = run.groupBy(label, "n", "lo", "hi").agg((quartile(0.75) - quartile(0.25)).alias("q"))
    spread = F.col("hi") - F.col("lo")
    sturges = spread / (F.log2(F.col("n").cast("double")) + 1)
    fd = 2 * F.col("q") / F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    width = F.least(F.greatest(fd, spread / F.sqrt(F.col("n").cast("double")) / 2), sturges)
    bins = F.when(width > 0, F.ceil(spread / F.when(width > 0, width))).otherwise(1).cast("long")
    one = spread == 0                          # a single value: one bin of width 1 around it
    return got.select(label, F.when(one, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                      F.when(one, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"), "n", bins.alias("bins"))


def auto_histogram(df: DataFrame, col: str, label: str, digits: int = 6) -> DataFrame:
    """(label, bin, lo, hi, n): every bin of every label, empty ones too. Null values are left out."""
    values = materialize(df.select(F.col(label), F.col(col).cast("double").alias("value")).where(F.col("value").isNotNull())
                         .groupBy(label, "value").agg(F.count(F.lit(1)).alias("c")), "distinct-values")
    rule = materialize(bin_rule(values, label), "bins")
    at = F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")), F.col("bins") - 1)
    counts = join_small(values, rule.drop("n"), [label]).groupBy(label, at.alias("bin")).agg(F.sum("c").alias("__n"))
    grid = rule.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1)))
    full = grid.join(counts.withColumnRenamed(label, "__l"), F.col(label).eqNullSafe(F.col("__l")) & (grid["bin"] == counts["bin"]), "left")
    step = (F.col("hi") - F.col("lo")) / F.col("bins")
    return full.select(label, grid["bin"], rnd(F.col("lo") + grid["bin"] * step, digits).alias("lo"),
                       rnd(F.when(grid["bin"] == F.col("bins") - 1, F.col("hi")).otherwise(F.col("lo") + (grid["bin"] + 1) * step), digits).alias("hi"),
                       F.coalesce("__n", F.lit(0)).cast("long").alias("n"))
