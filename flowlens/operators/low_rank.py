"""Low-rank one-class scores: how far a row lies from the subspace that its class spans.

The fit of a class is its mean and the top components of its covariance (``pca.fit``: two
aggregations, d x d sums to the driver), as many as explain a share of the variance. A row's score is
the squared length of what the components leave of it, |c|^2 - |V c|^2 with c the centred row:
unlike a diagonal Gaussian, it sees features that break the class's correlations.

Rows whose vector is null, of another length than the class's, or holds null, NaN or infinite values
don't count in a fit and get a null score. A class without usable rows can't be fitted (error). A class
of equal rows has no component: the score is the squared distance from it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.exprs import rnd
from flowlens.operators import pca
from flowlens.operators.scale import apply_minmax_scale, fit_minmax_scale
from flowlens.operators.scorers import blend_scores

SHARE = 0.9


def _usable(vec: str, d: int):
    """The vector as doubles where it has d finite entries, else null."""
    x = F.col(f"`{vec}`").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when((F.size(x) == d) & ~bad, x)


def _class_rows(rows: DataFrame, vec: str) -> tuple[DataFrame, int]:
    d = rows.agg(F.max(F.size(F.col(f"`{vec}`")))).first()[0] or 0
    if d <= 0:
        raise ValueError("a one-class fit needs at least one usable row")
    return rows.select(_usable(vec, d).alias("x")).where("x is not null"), d


def fit(rows: DataFrame, vec: str = "vec", share: float = SHARE) -> dict:
    """{mean, basis (rank x d), explained}: the fewest top components that hold ``share`` of the variance."""
    usable, _ = _class_rows(rows, vec)
    whole = pca.fit(usable, "x")
    if whole["n"] == 0:
        raise ValueError("a one-class fit needs at least one usable row")
    total = whole["eigenvalues"].sum()
    if total <= 0:
        return {"mean": whole["mean"], "basis": np.zeros((0, len(whole["mean"]))), "explained": 0.0}
    running = np.cumsum(whole["eigenvalues"]) / total
    rank = min(int(np.searchsorted(running, share - 1e-12)) + 1, len(running))
    return {"mean": whole["mean"], "basis": whole["components"][:rank], "explained": float(running[rank - 1])}


def fit_with_basis(rows: DataFrame, basis: np.ndarray, vec: str = "vec") -> dict:
    """A fit whose components are given (orthonormal rows); only the mean comes from the rows."""
    d = basis.shape[1]
    r = rows.select(_usable(vec, d).alias("x")).agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)]).first()
    if r["m0"] is None:
        raise ValueError("a one-class fit needs at least one usable row")
    return {"mean": np.array(list(r)), "basis": basis, "explained": None}


def cosine_basis(d: int, rank: int) -> np.ndarray:
    """The first ``rank`` cosine waves over d entries: orthonormal rows by a rule."""
    k = np.arange(1, rank + 1)[:, None]
    return np.sqrt(2.0 / d) * np.cos(np.pi * (np.arange(d) + 0.5) * k / d)


def score(df: DataFrame, fits: dict[str, dict], vec: str = "vec", keep: tuple = ("row_id", "label")) -> DataFrame:
    """(keep..., one score column per entry of ``fits``) of every row, in one pass without a shuffle."""
    d = len(next(iter(fits.values()))["mean"])
    names = list(fits)
    sent = df.sparkSession.sparkContext.broadcast([(f["mean"], f["basis"]) for f in fits.values()])   # (rank + 1) x d each
    k = len(keep)

    def apply(it):
        for b in it:
            col = b.column(k)
            there = np.asarray(col.is_valid())
            x = col.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            out = []
            for mean, basis in sent.value:
                c = x - mean
                left = c - (c @ basis.T) @ basis          # subtracting the projection, not the squares: no cancellation
                s = np.zeros(b.num_rows)
                s[there] = (left * left).sum(1)
                out.append(pa.array(s, mask=~there))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(k)), *out],
                                             names=[f"k{i}" for i in range(k)] + [f"s{i}" for i in range(len(names))])

    staged = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], _usable(vec, d).alias("x"))
    schema = ", ".join([*(f"{c} {t}" for c, t in staged.dtypes[:k]), *(f"s{i} double" for i in range(len(names)))])
    return staged.mapInArrow(apply, schema).toDF(*keep, *names)


def two_scorer_blend(train: DataFrame, test: DataFrame, vec: str = "vec", label: str = "label", key: str = "row_id",
                     share: float = SHARE, digits: int = 6) -> DataFrame:
    """(key, label, score_benign, score_anomaly, blend, pred): ``scorers.two_scorer_blend_vec`` on low-rank distances."""
    fits = {"score_benign": fit(train.where(F.col(label) == 0), vec, share),
            "score_anomaly": fit(train.where(F.col(label) == 1), vec, share)}
    raw = score(test, fits, vec, (key, label)).withColumn("score_anomaly", -F.col("score_anomaly"))
    out = blend_scores(apply_minmax_scale(raw, fit_minmax_scale(raw, ["score_benign", "score_anomaly"])))
    return out.select(key, label, *[rnd(c, digits).alias(c) for c in ("score_benign", "score_anomaly", "blend")], "pred")
