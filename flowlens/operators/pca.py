"""PCA from a centred Gram matrix, with a residual per component that checks it.

Two passes: the mean, then the sums of (x - mean)(x - mean)^T, which every task adds up for its rows
and Spark adds by position. d x d sums reach the driver, whatever the number of rows; there the
symmetric matrix is decomposed. Centring first keeps the sums free of the cancellation that plain
sums of products suffer from; the rest that the mean's rounding leaves is taken off afterwards.

``residuals`` goes back to the rows: C v comes out of one more pass as the sum of projection times centred
row, without the matrix, and must equal eigenvalue times v.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rows(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _summed(df: DataFrame, vec: str, size: int, add, d: int) -> np.ndarray:
    """Sum of ``add(rows matrix)``, arrays of ``size`` numbers, over all batches of all tasks."""

    def partial(it):
        total = np.zeros(size)
        for b in it:
            if b.num_rows:
                total += add(_rows(b, d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["at", "v"])

    got = df.select(F.col(vec).cast("array<double>").alias("x")).mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v"))
    out = np.zeros(size)
    for r in got.collect():                    # ``size`` rows
        out[r.at] = r.v
    return out


def fit(df: DataFrame, vec: str = "vec") -> dict:
    """{mean, components (rows, by falling eigenvalue, largest entry positive), eigenvalues, n}: covariances with n - 1.

    ``vec``: arrays of one length without nulls. Fewer than two rows: eigenvalues are 0."""
    first = df.select(F.size(vec)).first()
    d = first[0] if first else 0
    if d == 0:
        return {"mean": np.zeros(0), "components": np.zeros((0, 0)), "eigenvalues": np.zeros(0), "n": 0}
    sums = _summed(df, vec, d + 1, lambda x: np.append(x.sum(0), len(x)), d)
    n = int(sums[d])
    mean = sums[:d] / n

    def gram(x):
        c = x - mean
        return np.concatenate([(c.T @ c).ravel(), c.sum(0)])

    got = _summed(df, vec, d * d + d, gram, d)
    left = got[d * d:]
    c = (got[:d * d].reshape(d, d) - np.outer(left, left) / n) / max(n - 1, 1)
    values, vectors = np.linalg.eigh((c + c.T) / 2)
    vectors = vectors[:, ::-1].T
    vectors *= np.where(vectors[np.arange(d), np.abs(vectors).argmax(1)] < 0, -1.0, 1.0)[:, None]
    return {"mean": mean, "components": vectors, "eigenvalues": np.maximum(values[::-1], 0.0), "n": n}


def project(df: DataFrame, fit: dict, vec: str = "vec", keep: tuple = (), out: str = "pcs") -> DataFrame:
    """(keep..., pcs): projections of the centred rows."""
    sent = df.sparkSession.sparkContext.broadcast((fit["mean"], fit["components"]))       # d x d
    d = len(fit["mean"])
    kept = df.select(*keep)

    def apply(it):
        mean, v = sent.value
        for b in it:
            x = (_rows(pa.RecordBatch.from_arrays([b.column(len(keep))], names=["x"]), d) - mean) @ v.T
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), arrays], names=[*keep, out])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes), f"`{out}` array<double>"])
    return df.select(*keep, F.col(vec).cast("array<double>").alias("__x")).mapInArrow(apply, schema)


def residuals(df: DataFrame, fit: dict, vec: str = "vec") -> np.ndarray:
    """Per component the length of C v - eigenvalue * v, with C v summed over the rows."""
    mean, v, d = fit["mean"], fit["components"], len(fit["mean"])

    def add(x):
        c = x - mean
        return ((c @ v.T).T @ c).ravel()

    cv = _summed(df, vec, d * d, add, d).reshape(d, d) / max(fit["n"] - 1, 1)
    return np.linalg.norm(cv - fit["eigenvalues"][:, None] * v, axis=1)
