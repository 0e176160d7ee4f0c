"""Dictionaries (label encoding), one-hot, correlation and PCA fits.

* All dictionaries come from ONE unpivoted ``groupBy(column, value)``; codes are
  the 0-based position of the value in sorted order (LabelEncoder order).
* Applying a dictionary is a left join per column: from a broadcast where that column's
  dictionary, whose size is counted, has at most ``BROADCAST_ENTRIES`` entries, else by
  shuffle with hot categories split off to a bounded broadcast. Unseen values raise in the
  projection behind the join (the reference's encoder fails on them).
* One-hot is a projection from the TRAIN dictionary; a test value that train
  never saw becomes all zeros (no refit on test, no alignment step needed). For wide
  dictionaries ``one_hot_sparse`` gives the same row as (size, positions of the ones).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.profile import unpivot
from flowlens.operators.ranks import parts_for, running_sum, string_rank
from flowlens.operators.skew import hot_key_join
from flowlens.session import materialize

BROADCAST_ENTRIES = 100_000    # dictionary entries of a column that are broadcast
SALTS = 64                     # parts of the rows that hold one value, when values are counted
MAX_DUMMIES = 10_000           # dictionary entries that ``one_hot`` turns into columns


def fit_label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code): sorted distinct non-null values per column, code 0..k-1."""
    long = unpivot(df, cols, cast="string").where(F.col("value").isNotNull())
    dv = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("__n"))
    # rank of each distinct value in byte order, bucketed so that a high-cardinality
    # column is not ranked inside one task
    ranked = string_rank(dv, "value", ("column",), "__r")
    return ranked.select("column", "value", (F.col("__r") - 1).cast("int").alias("code"))


def sorted_categories(df: DataFrame, col: str) -> DataFrame:
    """(value, code) of one column."""
    return fit_label_encode(df, [col]).select("value", "code")


def _unseen_guard(value, code, col: str):
    """The code, or a task failure naming the column when a non-null value has no code.
    Checked lazily inside the same projection (no extra pass over the data)."""
    return F.when(value.isNotNull() & code.isNull(),
                  F.raise_error(F.concat(F.lit(f"unseen category in column {col!r}: "), value.cast("string")))
                  ).otherwise(code)


def _with_codes(df: DataFrame, fit: DataFrame, columns: dict[str, str]) -> DataFrame:
    """``df`` with a code column (null: not in the dictionary) for each {column: code column}.

    The dictionary is written once; its sizes are counted in one pass over it."""
    fit = fit if hasattr(fit, "_table_path") else materialize(fit, "dictionary")
    sizes = {r["column"]: r["count"] for r in fit.groupBy("column").count().collect()}     # one row per column
    for c, code in columns.items():
        d = fit.where(F.col("column") == c).select(F.col("value").alias("__v"), F.col("code").alias(code))
        staged = df.withColumn("__v", F.col(f"`{c}`").cast("string"))
        if sizes.get(c, 0) <= BROADCAST_ENTRIES:
            df = staged.join(F.broadcast(d), "__v", "left")
        else:
            # a category holding many rows would load one task, so hot ones come from a bounded broadcast
            value_rows = staged.groupBy("__v").agg(F.count(F.lit(1)).alias("__rows"))
            df = hot_key_join(staged, d, ["__v"], value_rows, "__rows", "left")
        df = df.drop("__v")
    return df


def apply_label_encode(df: DataFrame, fit: DataFrame, unseen: str = "error", suffix: str = "") -> DataFrame:
    """Replace each fitted column by its code (or add ``col + suffix``).

    ``unseen='error'`` fails the job on a non-null value without a code (raised where
    the row is encoded); ``'null'`` keeps null. The columns are those of the whole
    dictionary, however many entries each has."""
    fit = materialize(fit, "dictionary")
    fitted = {r["column"] for r in fit.select("column").distinct().collect()}              # column names
    cols = [c for c in df.columns if c in fitted]
    codes = {c: f"__code_{i}" for i, c in enumerate(cols)}
    joined = _with_codes(df, fit, codes)
    value = {c: (_unseen_guard(F.col(c), F.col(k), c) if unseen == "error" else F.col(k)) for c, k in codes.items()}
    if not suffix:
        return joined.select(*[value[c].alias(c) if c in value else F.col(c) for c in df.columns])
    return joined.select(*df.columns, *[v.alias(c + suffix) for c, v in value.items()])


def encode_lookup(df: DataFrame, col: str, fit: DataFrame, out: str | None = None) -> DataFrame:
    """Dictionary join: category -> code; an unseen value fails the job."""
    res = _with_codes(df, fit, {col: "__code"})
    return res.withColumn(out or f"{col}_code", _unseen_guard(F.col(col), F.col("__code"), col)).drop("__code")


def fit_one_hot(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code): the dictionary the dummy columns are projected from."""
    return fit_label_encode(df, cols)


def one_hot(df: DataFrame, fit: DataFrame, prefixes: dict | None = None, drop: bool = True,
            dtype: str = "double") -> DataFrame:
    """All k dummies per categorical column, named ``<prefix>_<value>`` in code order.

    A dummy is a column of the schema, so the dictionary becomes part of the plan. That holds for at
    most ``MAX_DUMMIES`` entries; a larger dictionary stays in Spark and the result carries
    the same row as ``one_hot`` (``one_hot_sparse``) in place of the dummies."""
    entries = fit.limit(MAX_DUMMIES + 1).collect()
    if len(entries) > MAX_DUMMIES:
        fit = materialize(fit, "dictionary")
        cols = [r["column"] for r in fit.select("column").distinct().collect()]            # column names
        wide = one_hot_sparse(df, fit, cols)
        return wide.drop(*cols) if drop else wide
    entries.sort(key=lambda r: (r["column"], r["code"]))
    cols = list(dict.fromkeys(r["column"] for r in entries))
    dummies = [F.when(F.col(r["column"]).cast("string") == F.lit(r["value"]), 1).otherwise(0).cast(dtype)
               .alias(f"{(prefixes or {}).get(r['column'], r['column'])}_{r['value']}") for r in entries]
    keep = [F.col(x) for x in df.columns if not (drop and x in cols)]
    return df.select(*keep, *dummies)


def one_hot_sparse(df: DataFrame, fit: DataFrame, cols: list[str], out: str = "one_hot") -> DataFrame:
    """``df`` with ``out`` = struct(size, ones): the number of dummies of all ``cols`` and the ascending
    positions (columns by name, codes within) that are 1. Nothing of the dictionary enters the plan."""
    fit = fit if hasattr(fit, "_table_path") else materialize(fit, "dictionary")
    sizes = {r["column"]: r["count"] for r in fit.groupBy("column").count().collect()}     # one row per column
    ordered, start, begins = sorted(cols), 0, {}
    for c in ordered:
        begins[c] = start
        start += sizes.get(c, 0)
    codes = {c: f"__code_{i}" for i, c in enumerate(ordered)}
    joined = _with_codes(df, fit, codes)
    ones = F.array_compact(F.array(*[F.col(codes[c]).cast("long") + F.lit(begins[c]) for c in ordered]))
    return joined.select(*df.columns, F.struct(F.lit(start).cast("long").alias("size"), ones.alias("ones")).alias(out))


one_hot_align = one_hot


def dummies_of_object_cols(df: DataFrame, exclude: tuple = ()) -> DataFrame:
    """One-hot every string column of the schema (fit on the frame itself)."""
    cols = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name not in exclude]
    return one_hot(df, fit_one_hot(df, cols))


def attach_encoded(raw: DataFrame, encoded: DataFrame, key: str, drop: list[str]) -> DataFrame:
    """Key-aligned join of raw features with encoded columns, raw categoricals dropped.

    When ``encoded`` is a projection of ``raw`` prefer ``one_hot`` (no join at all)."""
    enc_cols = [c for c in encoded.columns if c != key and c not in raw.columns]
    return raw.drop(*drop).join(encoded.select(key, *enc_cols), key, "inner")


# ---------------------------------------------------------------- correlation

def average_rank(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """(key, column, value, rank): tie-averaged 1-based rank of each value within its column."""
    df = df if hasattr(df, "_table_path") else materialize(df, "rank-rows")
    parts = parts_for(df.sparkSession, df.count() * len(cols))
    long = unpivot(df, cols, ids=[key]).where(F.col("value").isNotNull())
    # counted in partitions whose number grows with the cells; the salt spreads a value that many rows hold
    salted = long.select("column", "value", F.pmod(F.xxhash64(key), F.lit(SALTS)).alias("__s"))
    some = salted.repartition(parts, "column", "value", "__s").groupBy("column", "value", "__s").agg(F.count(F.lit(1)).alias("c"))
    dv = materialize(some.repartition(parts, "column", "value").groupBy("column", "value").agg(F.sum("c").alias("c")), "distinct-values")
    cum = running_sum(dv, "value", ["c"], partition_cols=("column",))
    ranks = cum.select("column", "value",
                       ((F.col("cum_c") - F.col("c")).cast("double") + (F.col("c") + 1).cast("double") / 2.0).alias("rank"))
    # a constant or binary column puts most rows on one (column, value): hot keys are
    # joined map-side from a bounded broadcast, the rest by shuffle (rows per key: dv)
    return hot_key_join(long, ranks, ["column", "value"], dv, "c", parts=parts)


def spearman_matrix(df: DataFrame, cols: list[str], key: str, digits: int = 6) -> DataFrame:
    """(a, b, rho) for every ordered pair: Pearson correlation of average ranks.

    Two shuffles whatever d is: ranks joined to the unpivoted cells, then the
    ranks re-pivoted per row; all d x d correlations in one aggregation.
    A constant column has no defined correlation: null.
    """
    from flowlens.functions.exprs import rnd
    df = df if hasattr(df, "_table_path") else materialize(df, "rank-rows")
    r = average_rank(df, cols, key)
    # a row's ranks meet in partitions whose number grows with the rows
    wide = r.repartition(parts_for(df.sparkSession, df.count() * len(cols)), key).groupBy(key).pivot("column", cols).agg(F.first("rank"))
    aggs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            # covariance / (std * std) with a guarded division: ANSI mode raises on 0
            cov = F.covar_pop(F.col(f"`{a}`"), F.col(f"`{b}`"))
            den = F.stddev_pop(F.col(f"`{a}`")) * F.stddev_pop(F.col(f"`{b}`"))
            # constant by its ranks: a rounded deviation of merged partitions may lie just above 0
            vary = (F.min(F.col(f"`{a}`")) < F.max(F.col(f"`{a}`"))) & (F.min(F.col(f"`{b}`")) < F.max(F.col(f"`{b}`")))
            aggs.append(F.when(vary & (den > 0), cov / den).alias(f"c_{i}_{j}"))
    row = wide.agg(*aggs)
    cells = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            k = f"c_{min(i, j)}_{max(i, j)}"
            v = F.col(k)
            v = F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
            cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), v.alias("rho")))
    return row.select(F.explode(F.array(*cells)).alias("s")).select("s.a", "s.b", rnd("s.rho", digits).alias("rho"))


def sorted_correlations(matrix: DataFrame) -> DataFrame:
    """Off-diagonal pairs (a < b) sorted by rho descending (ties by names)."""
    return (matrix.where(F.col("a") < F.col("b"))
            .orderBy(F.col("rho").desc_nulls_last(), "a", "b"))


# ---------------------------------------------------------------- PCA

def fit_pca_vec(df: DataFrame, vec: str = "vec") -> dict:
    """``fit_pca`` over an array<double> column; keeps the MLlib model for a BLAS transform."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    feats = df.select(array_to_vector(vec).alias("__features"))
    first = feats.first()
    d = len(first["__features"]) if first else 0
    model = PCA(k=d, inputCol="__features", outputCol="__pcs").fit(feats)
    pc = np.array(model.pc.toArray().T, copy=True)          # k x d, rows = components
    mean = feats.select(Summarizer.mean(F.col("__features")).alias("m")).first()["m"].toArray()
    signs = [(-1.0 if pc[k][np.argmax(np.abs(pc[k]))] < 0 else 1.0) for k in range(pc.shape[0])]
    return {"model": model, "mean": mean.tolist(), "mean_proj": (pc @ mean).tolist(), "signs": signs,
            "components": (pc * np.array(signs)[:, None]).tolist(),
            "ratio": model.explainedVariance.toArray().tolist()}


def apply_pca_vec(df: DataFrame, fit: dict, vec: str = "vec", keep: tuple = (), out: str = "pcs") -> DataFrame:
    """Centred, sign-fixed projections: MLlib's BLAS transform, then (p - mean . v) * sign."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    staged = df.select(*keep, array_to_vector(vec).alias("__features"))
    proj = fit["model"].transform(staged).select(*keep, vector_to_array("__pcs").alias("__p"))
    z = F.arrays_zip(F.col("__p").alias("p"), F.array(*[F.lit(float(x)) for x in fit["mean_proj"]]).alias("m"),
                     F.array(*[F.lit(float(x)) for x in fit["signs"]]).alias("s"))
    return proj.select(*keep, F.transform(z, lambda e: (e["p"] - e["m"]) * e["s"]).alias(out))


def pca_variance_frame(spark, fit: dict) -> DataFrame:
    """(component, ratio) of a PCA fit (d rows)."""
    rows = [(i, float(r)) for i, r in enumerate(fit["ratio"])]
    return spark.createDataFrame(rows, "component int, ratio double")


def cumulative_variance(ratios: DataFrame) -> DataFrame:
    """Running sum of explained-variance ratio over components (d rows only)."""
    w = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ratios.withColumn("cumulative", F.sum("ratio").over(w))


def latent_dim(cum: DataFrame, bound: float = 0.90) -> DataFrame:
    """Components needed before the cumulative ratio exceeds ``bound``; ``index`` is that
    count minus one (the loop index the reference reports)."""
    first = cum.where(F.col("cumulative") > F.lit(bound)).agg(F.min("component").alias("i"))
    return first.select((F.col("i") + 1).cast("int").alias("count"), F.col("i").cast("int").alias("index"))
