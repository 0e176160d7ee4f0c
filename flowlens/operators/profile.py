"""Profiling: distributions, cardinalities, describe, histograms, densities.

All multi-column statistics are one aggregation over the wide frame or one
aggregation over an unpivoted (column, value) frame; never one job per column.
Exact quantiles avoid ``percentile`` (which buffers every value of a group in
one task): they are read off running counts of distinct values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.exprs import rnd
from flowlens.operators.ranks import join_small, running_sum
from flowlens.session import materialize


def unpivot(df: DataFrame, cols: list[str], ids: list[str] | None = None, cast: str = "double",
            name: str = "column", value: str = "value") -> DataFrame:
    """Long form (ids..., column, value); a narrow transformation (no shuffle)."""
    staged = df.select(*(ids or []), *[F.col(c).cast(cast).alias(c) for c in cols])
    return staged.unpivot(ids or [], cols, name, value)


def label_distribution(df: DataFrame, col: str) -> DataFrame:
    """Count per raw label (order: count desc, label asc)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(col))


def label_share(df: DataFrame, col: str, digits: int = 2) -> DataFrame:
    """Share per label, rounded half-to-even on the exact ratio count / total."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    # the window runs over the per-label table only (one row per label)
    j = counts.withColumn("__tot", F.sum("n").over(Window.partitionBy()))
    scale = 10 ** digits
    prod = F.col("n") * scale
    q = F.floor(prod / F.col("__tot"))
    rem2 = 2 * (prod - q * F.col("__tot"))
    up = (rem2 > F.col("__tot")) | ((rem2 == F.col("__tot")) & (q % 2 == 1))
    share = ((q + F.when(up, 1).otherwise(0)) / F.lit(float(scale))).cast("double")
    return j.select(col, share.alias("share"))


def category_cardinality(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact distinct count per column; a null counts as one more value."""
    long = unpivot(df, cols, cast="string")
    pairs = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("__c"))  # map-side dedupe
    return pairs.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))


def top_categories(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """n most frequent values (ties: smaller value first); a top-k report, so the limit is the feature."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(col)).limit(n))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct().orderBy(col)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_cols"))


def constant_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns holding a single value (min == max, null-safe; all-null counts as constant)."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.min(c).alias(f"mn{i}"), F.max(c).alias(f"mx{i}"),
                 F.max(F.col(c).isNull().cast("int")).alias(f"nl{i}"),
                 F.min(F.col(c).isNull().cast("int")).alias(f"an{i}")]
    row = df.agg(*aggs)
    flags = [F.struct(F.lit(c).alias("column"),
                      ((F.col(f"an{i}") == 1) | (F.col(f"mn{i}").eqNullSafe(F.col(f"mx{i}")) & (F.col(f"nl{i}") == 0)))
                      .alias("const")) for i, c in enumerate(cols)]
    return row.select(F.explode(F.array(*flags)).alias("s")).where("s.const").select("s.column")


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """(column, p, q): linear-interpolation quantiles (numpy 'linear'), exact.

    Distinct values per column with their counts, running counts (bucketed, so no
    single-task window), then the two order statistics around (n - 1) p.
    """
    long = unpivot(df, cols).where(F.col("value").isNotNull())
    dv = materialize(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("c")), "distinct-values")
    cum = running_sum(dv, "value", ["c"], partition_cols=("column",))
    cum = cum.select("column", "value", (F.col("cum_c") - F.col("c")).alias("lo_r"), F.col("cum_c").alias("hi_r"))
    sizes = dv.groupBy("column").agg(F.sum("c").alias("n"))
    pos = (F.col("n") - 1) * F.col("p")
    targets = (sizes.select("column", "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
               .select("column", "p", pos.alias("pos"))
               .select("column", "p", "pos", F.floor("pos").alias("r0"), F.ceil("pos").alias("r1")))
    t_long = targets.select("column", "p", "pos", F.explode(F.array(
        F.struct(F.lit(0).alias("which"), F.col("r0").alias("r")),
        F.struct(F.lit(1).alias("which"), F.col("r1").alias("r")))).alias("t")).select(
        "column", "p", "pos", "t.which", "t.r")
    # targets: |cols| x |probs| x 2 rows, bounded by the request -> broadcast
    tb = F.broadcast(t_long.withColumnRenamed("column", "__tc"))
    hit = cum.join(tb, (cum["column"] == tb["__tc"]) & (tb["r"] >= cum["lo_r"]) & (tb["r"] < cum["hi_r"]))
    g = hit.groupBy("column", "p", "pos").agg(
        F.max(F.when(F.col("which") == 0, F.col("value"))).alias("v0"),
        F.max(F.when(F.col("which") == 1, F.col("value"))).alias("v1"))
    frac = F.col("pos") - F.floor("pos")
    return g.select("column", "p", (F.col("v0") + (F.col("v1") - F.col("v0")) * frac).alias("q"))


def describe(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """count, mean, sample std, min, 25/50/75 % (linear), max per numeric column."""
    long = unpivot(df, cols)
    stats = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    qw = qs.groupBy("column").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q"))
    qw = qw.select("column", *[F.col(f"`{p}`").alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    j = join_small(stats, qw, ["column"])
    return j.select("column", "count", *[rnd(c, digits).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


def batch_stats(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """min, max and sample std over every cell of the feature columns."""
    long = unpivot(df, cols)
    return long.agg(rnd(F.min("value"), digits).alias("min"), rnd(F.max("value"), digits).alias("max"),
                    rnd(F.stddev_samp("value"), digits).alias("std"), F.count("value").alias("n_cells"))


def label_counter(df: DataFrame, col: str = "label") -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def histogram_by_label(df: DataFrame, col: str, label: str, bins: int = 10, digits: int = 6) -> DataFrame:
    """Equal-width bins over each label's own [min, max]; every bin listed (empty ones with n = 0)."""
    x = F.col(col).cast("double")
    rng = df.groupBy(label).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    w = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))
    # per label range: one row per label (bounded by the classes)
    tagged = join_small(df.select(label, x.alias("__x")).where(F.col("__x").isNotNull()), rng, [label])
    b = F.when(w == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__lo")) / w), F.lit(bins - 1))).cast("int")
    counts = tagged.groupBy(label, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rng.select(label, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts, [label, "bin"], "left")
    lo = F.col("__lo") + F.col("bin") * w
    hi = F.when(F.col("bin") == bins - 1, F.col("__hi")).otherwise(F.col("__lo") + (F.col("bin") + 1) * w)
    return full.select(label, "bin", rnd(lo, digits).alias("lo"), rnd(hi, digits).alias("hi"),
                       F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n"))


def density_by_label(df: DataFrame, col: str, label: str, grid: int = 200, cut: float = 3.0,
                     digits: int = 9) -> DataFrame:
    """Gaussian KDE per label on ``grid`` points over [min - cut h, max + cut h].

    Bandwidth h = n^(-1/5) * sample std (Scott). Work is done on distinct values
    with their counts, each contributing to every grid point of its label; a task sums its
    values in arrays and hands on ``grid`` rows per label.
    """
    x = F.col(col).cast("double")
    base = df.select(label, x.alias("__x")).where(F.col("__x").isNotNull())
    st = _bandwidths(base, label, cut)
    dv = base.groupBy(label, "__x").agg(F.count(F.lit(1)).alias("__c"))
    j = join_small(dv, st.where(F.col("__h") > 0), [label])  # one row per label
    return _kernel_sums(j, label, grid, digits)


def density_binned(df: DataFrame, col: str, label: str, grid: int = 200, cut: float = 3.0, step: float = 0.002,
                   digits: int = 9) -> DataFrame:
    """``density_by_label`` from fine bins, with ``error_bound``, the most that a density can be off.

    Each value is shared between the two bin borders around it (linear binning, borders ``step``
    bandwidths apart), so the kernel sees at most range / (step h) borders per label instead of every
    distinct value. The sharing replaces the kernel by straight lines between borders, which
    differ from it by at most step^2 / 8 of its height: 5e-7 by default. Rows are aggregated
    once, map-side first, to a count and a sum of shares per bin. Values that aren't finite don't
    count; a label without spread, or with one value, has no density (as in ``density_by_label``)."""
    x = F.col(col).cast("double")
    base = df.select(label, x.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x") & (F.abs("__x") < F.lit(float("inf"))))
    st = _bandwidths(base, label, cut)
    tagged = join_small(base, st.where(F.col("__h") > 0), [label])       # one row per label
    at = (F.col("__x") - F.col("__a")) / (F.lit(step) * F.col("__h"))
    bins = tagged.select(label, "__n", "__h", "__a", "__b", F.floor(at).alias("__k"), (at - F.floor(at)).alias("__f")) \
        .groupBy(label, "__n", "__h", "__a", "__b", "__k").agg(F.count(F.lit(1)).alias("__m"), F.sum("__f").alias("__f"))

    def border(k):
        return F.col("__a") + k.cast("double") * (F.lit(step) * F.col("__h"))

    # both borders of a bin; a border met from two bins is simply summed twice
    both = F.explode(F.array(F.struct(border(F.col("__k")).alias("__x"), (F.col("__m") - F.col("__f")).alias("__c")),
                             F.struct(border(F.col("__k") + 1).alias("__x"), F.col("__f").alias("__c"))))
    points = bins.select(label, "__n", "__h", "__a", "__b", both.alias("__p")).select(label, "__n", "__h", "__a", "__b", "__p.*")
    bound = F.lit(step * step / 8) / (F.col("__h") * F.lit((2 * 3.141592653589793) ** 0.5))
    return _kernel_sums(points, label, grid, digits, rnd(bound, 12).alias("error_bound"))


def _bandwidths(base: DataFrame, label: str, cut: float) -> DataFrame:
    st = base.groupBy(label).agg(F.count(F.lit(1)).alias("__n"), F.stddev_samp("__x").alias("__sd"),
                                 F.min("__x").alias("__mn"), F.max("__x").alias("__mx"))
    st = st.withColumn("__h", F.pow(F.col("__n").cast("double"), F.lit(-0.2)) * F.col("__sd")) \
        .withColumn("__a", F.col("__mn") - F.lit(cut) * F.col("__h")) \
        .withColumn("__b", F.col("__mx") + F.lit(cut) * F.col("__h"))
    return st.select(label, "__n", "__h", "__a", "__b")


def _kernel_sums(j: DataFrame, label: str, grid: int, digits: int, *more) -> DataFrame:
    """Density per (label, grid point) of weighted points ``__x``, ``__c`` with their label's ``__n``, ``__h``, ``__a``, ``__b``."""
    rows = j.select(label, "__x", F.col("__c").cast("double").alias("__c"), "__n", "__h", "__a", "__b")
    schema = T.StructType([rows.schema[label], T.StructField("i", T.IntegerType()), T.StructField("__s", T.DoubleType())]
                          + [rows.schema[c] for c in ("__n", "__h", "__a", "__b")])

    def partial(it):
        # per task one sum per (label, grid point); a batch of values against the grid at a time
        sums, stats = {}, {}
        steps = np.arange(grid) / float(grid - 1)
        for pdf in it:
            for key, part in pdf.groupby(label, dropna=False):
                n, h, lo, hi = stats.setdefault(key, tuple(part[["__n", "__h", "__a", "__b"]].iloc[0]))
                gx = lo + (hi - lo) * steps
                total = sums.setdefault(key, np.zeros(grid))
                x, c = part["__x"].to_numpy(), part["__c"].to_numpy()
                for s in range(0, len(x), 2048):
                    z = (gx[None, :] - x[s:s + 2048, None]) / h
                    total += c[s:s + 2048] @ np.exp(-0.5 * z * z)
        for key, total in sums.items():
            n, h, lo, hi = stats[key]
            yield pd.DataFrame({label: [key] * grid, "i": np.arange(grid, dtype=np.int32), "__s": total, "__n": [int(n)] * grid,
                                "__h": [h] * grid, "__a": [lo] * grid, "__b": [hi] * grid})

    agg = rows.mapInPandas(partial, schema).groupBy(label, "i").agg(
        F.sum("__s").alias("__s"), F.first("__n").alias("__n"), F.first("__h").alias("__h"), F.first("__a").alias("__a"),
        F.first("__b").alias("__b"))
    dens = F.col("__s") / (F.col("__n") * F.col("__h") * F.lit((2 * 3.141592653589793) ** 0.5))
    gx2 = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("i") / F.lit(float(grid - 1))
    return agg.select(label, F.col("i").cast("int").alias("i"), rnd(gx2, digits).alias("x"), rnd(dens, digits).alias("density"),
                      *more)


def missing_categories(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Train categories absent from the test frame (anti join)."""
    return train.select(col).distinct().join(test.select(col).distinct(), col, "left_anti")


def unseen_categories(train: DataFrame, test: DataFrame, col: str) -> DataFrame:
    """Test categories absent from the train frame: these would fail a strict encoder."""
    return missing_categories(test, train, col)
