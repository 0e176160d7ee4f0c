"""Mini-batch logistic regression over hashed tokens that goes on from given weights.

The feedback loop trains the current model further on its mistakes instead of fitting it anew. A
model is one array of ``n_features`` weights and a bias (a bounded size whatever the corpus),
written and read as a small Parquet table. One step is one mini-batch: its rows are read from a
table partitioned by step, every task sums the gradients of its rows with the broadcast weights, the
sums meet by feature, and the driver moves the weights. Batches come from the exact hash ranks
of ``shuffle_batches``, in a new order every epoch.

An epoch has ``steps`` batches of ceil(rows / steps) rows, so the number of jobs does not
grow with the data; the rows of a batch are spread over tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.text import tokens
from flowlens.operators.split import shuffle_batches
from flowlens.operators.tokens import token_codes
from flowlens.session import _delete, materialize, scratch_path

N_FEATURES = 1 << 18
LEARNING_RATE = 8.0


def token_bucket(token, n_features: int):
    """Feature of a token: the first 32 bits of its MD5, modulo ``n_features``."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("bigint"), F.lit(n_features)).cast("int")


def hashed_features(df: DataFrame, col: str = "text", n_features: int = N_FEATURES, keep: tuple = ("row_id", "label")) -> DataFrame:
    """(keep..., idx array<int>, val array<double>): counts of hashed tokens over the whole text, scaled to
    length 1, and the bias (feature ``n_features``, value 1) behind them. No exchange.

    Null and empty texts have the bias alone."""
    staged = df.select(*keep, tokens(F.coalesce(F.col(col), F.lit(""))).alias("__t"))
    fields = [*(staged.schema[k] for k in keep), T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("val", T.ArrayType(T.DoubleType()))]

    def run(it):
        for whole in it:
            for b, row, names, code in token_codes(whole, "__t"):
                bucket = np.array([int.from_bytes(hashlib.md5(t.encode()).digest()[:4], "big") % n_features for t in names.to_pylist()], np.int64)
                at, n = np.unique(row * n_features + bucket[code], return_counts=True)
                row, n = at // n_features, n.astype(np.float64)
                norm = np.sqrt(np.bincount(row, n * n, len(b)))
                # a row's features, then its bias: as many biases lie before a feature as its row's number
                idx, val = np.full(len(at) + len(b), n_features, np.int32), np.ones(len(at) + len(b))
                place = np.arange(len(at)) + row
                idx[place], val[place] = at % n_features, n / norm[row]
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(b)) + 1)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), *(pa.ListArray.from_arrays(ends, pa.array(v)) for v in (idx, val))],
                                                 names=[*keep, "idx", "val"])

    return staged.mapInArrow(run, T.StructType(fields))


def _scores(batch: pa.RecordBatch, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat features and values, the row of each, and the rows' log odds."""
    idx, val = batch.column("idx"), batch.column("val")
    flat, v = idx.flatten().to_numpy(), val.flatten().to_numpy()
    row = np.repeat(np.arange(len(idx)), np.diff(idx.offsets.to_numpy()))
    return flat, v, row, np.bincount(row, weights[flat] * v, len(idx))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1 / (1 + e), e / (1 + e))


def gradient(batch_rows: DataFrame, weights: np.ndarray, label: str = "label") -> tuple[np.ndarray, int]:
    """Sum over the rows of (p - label) * features, and the number of rows."""
    spark = batch_rows.sparkSession
    sent = spark.sparkContext.broadcast(weights)
    n = len(weights)

    def partial(it):
        total, rows = np.zeros(n), 0
        for b in it:
            if b.num_rows:
                flat, v, row, z = _scores(b, sent.value)
                total += np.bincount(flat, (_sigmoid(z) - b.column("y").to_numpy())[row] * v, n)
                rows += b.num_rows
        if rows:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, n).astype(np.int32)), pa.array(np.append(total[at], rows))], names=["idx", "g"])

    found = (batch_rows.select(F.col(label).cast("double").alias("y"), "idx", "val").mapInArrow(partial, "idx int, g double")
             .groupBy("idx").agg(F.sum("g").alias("g")).collect())        # a row per feature: bounded
    sent.unpersist()
    out = np.zeros(n + 1)
    for r in found:
        out[r.idx] = r.g
    return out[:n], int(out[n])


def train(rows: DataFrame, weights: np.ndarray | None = None, epochs: int = 3, steps: int = 8, rate: float = LEARNING_RATE,
          seed: int = 42, n_features: int = N_FEATURES, key: str = "row_id", label: str = "label") -> list[np.ndarray]:
    """Weights after each epoch, from ``weights`` on (None: zeros). ``rows``: (key, label, idx, val) as of
    ``hashed_features``; per step weights -= rate * summed gradient / rows of the batch.

    Without rows there is nothing to learn: the weights at hand come back for every epoch."""
    w = np.zeros(n_features + 1) if weights is None else np.array(weights, float)
    spark = rows.sparkSession
    n = rows.count()
    out = []
    for epoch in range(epochs):
        if n:
            size = -(-n // steps)
            path = scratch_path(spark, "batches")
            (shuffle_batches(rows, key, size, seed, epoch, "step").withColumn("step", F.col("step").cast("int"))
             .repartitionByRange("step", key).write.partitionBy("step").parquet(path))
            table = spark.read.parquet(path)
            for step in range(-(-n // size)):
                g, m = gradient(table.where(F.col("step") == step), w, label)
                w = w - rate * g / m
            _delete(spark, path)
        out.append(w)
    return out


def score(rows: DataFrame, weights: np.ndarray, keep: tuple = ("row_id", "label")) -> DataFrame:
    """(keep..., pred int, log_odds, p1): a projection in the tasks with the broadcast weights."""
    sent = rows.sparkSession.sparkContext.broadcast(np.asarray(weights, float))
    kept = rows.select(*keep)

    def apply(it):
        for b in it:
            *_, z = _scores(b, sent.value)
            cols = [b.column(b.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array((z > 0).astype(np.int32)), pa.array(z), pa.array(_sigmoid(z))],
                                             names=[*keep, "pred", "log_odds", "p1"])

    schema = ", ".join(f"`{c}` {t}" for c, t in kept.dtypes) + ", pred int, log_odds double, p1 double"
    return rows.select(*dict.fromkeys([*keep, "idx", "val"])).mapInArrow(apply, schema)


def save_weights(spark: SparkSession, weights: np.ndarray, path: str) -> str:
    """The model as a table (feature, weight) of its non-zero weights."""
    at = np.flatnonzero(weights)
    table = pa.table({"feature": pa.array(at.astype(np.int32)), "weight": pa.array(weights[at])})
    spark.createDataFrame(table.to_pandas(), "feature int, weight double").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_weights(spark: SparkSession, path: str, n_features: int = N_FEATURES) -> np.ndarray:
    w = np.zeros(n_features + 1)
    for r in spark.read.parquet(path).collect():          # at most n_features + 1 rows
        w[r.feature] = r.weight
    return w


def feature_table(df: DataFrame, col: str = "text", n_features: int = N_FEATURES, keep: tuple = ("row_id", "label")) -> DataFrame:
    """``hashed_features``, written once: every step and score reads it."""
    return materialize(hashed_features(df, col, n_features, keep), "features")
