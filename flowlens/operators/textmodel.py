"""Text classifiers over serialised rows / documents.

Two re-aimings of the reference's fine-tuned transformer (single-machine GPU
training is not rebuilt):

* ``method='nb'``: multinomial naive Bayes (add-one smoothing) written as
  DataFrame aggregations: per-document token counts, per-(class, token)
  weighted counts, and a token-keyed lookup of log-probabilities. Sample
  weights make "train + weighted corrections" refits exact, and every step has
  a SQL equivalent.
* ``method='lr'``: MLlib ``RegexTokenizer -> HashingTF -> IDF -> LogisticRegression``.

Scale: token frequencies are heavily skewed, so the token-keyed lookup is a
broadcast when the (class x token) table is provably small; otherwise hot
tokens (by training document frequency) are looked up from a bounded
broadcast and the rest are joined by shuffle (``token_lookup``). Per-document
sums are partial aggregates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.text import TOKEN_PATTERN, tokens
from flowlens.operators.skew import hot_key_join
from flowlens.operators.tokens import token_runs
from flowlens.session import materialize

BROADCAST_ROWS = 500_000
MAX_ODDS = 1e9


def token_counts(df: DataFrame, col: str = "text", key: str = "row_id") -> DataFrame:
    """(key, token, tf) over the whole text of every row.

    A document is one row, so its tokens are counted within it, on arrays in its task. No exchange."""
    staged = df.select(key, tokens(col).alias("__t")).where(F.size("__t") > 0)
    fields = [staged.schema[key], T.StructField("token", T.StringType()), T.StructField("tf", T.DoubleType())]

    def run(it):
        for b in it:
            for rows, row, names, code, n in token_runs(b, "__t"):
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(row)), names.take(pa.array(code)), pa.array(n.astype(np.float64))],
                                                 names=[key, "token", "tf"])

    return staged.mapInArrow(run, T.StructType(fields))


def token_lookup(counts: DataFrame, model: DataFrame, token_rows: DataFrame | None = None) -> DataFrame:
    """Join the (token, class, logp) model onto (key, token, tf) rows.

    A model under ``BROADCAST_ROWS`` rows is broadcast. A larger one is joined by
    shuffle on the token, except the hot tokens: ``token_rows`` (token, __rows)
    estimates rows per token (training document frequencies), and tokens above
    the hot threshold are looked up from a bounded broadcast (``hot_key_join``)."""
    n = model.limit(BROADCAST_ROWS + 1).count()
    if n <= BROADCAST_ROWS:
        return counts.join(F.broadcast(model), "token", "inner")
    if token_rows is None:
        token_rows = counts.groupBy("token").agg(F.count(F.lit(1)).alias("__rows"))
    return hot_key_join(counts, model, ["token"], token_rows, "__rows")


def fit_text_nb(counts: DataFrame, labels: DataFrame, key: str = "row_id", label: str = "label",
                weight: str | None = None, alpha: float = 1.0, classes: tuple | None = None):
    """Multinomial NB. Returns (model: (token, class, logp), priors: {class: log prior}).

    ``labels`` has (key, label[, weight]); ``counts`` has (key, token, tf). The
    (class, token) count table is materialised once; vocabulary size and class
    totals are read from it (one row per class), the model table is materialised
    for the size check and the lookup.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    lab = labels.select(key, F.col(label).alias("__cls"), w.alias("__w"))
    docs = lab.groupBy("__cls").agg(F.sum("__w").alias("__n")).collect()      # one row per class
    total = sum(r["__n"] for r in docs)
    priors = {r["__cls"]: math.log(r["__n"] / total) for r in docs}
    # a class without training rows stays in the model and is never chosen
    priors = {**{c: -math.inf for c in classes or ()}, **priors}
    classes = sorted(priors)
    ct = materialize(counts.join(lab, key, "inner").groupBy("token").pivot("__cls", classes)
                     .agg(F.sum(F.col("tf") * F.col("__w"))))
    tot_row = ct.agg(F.count(F.lit(1)).alias("__v"),
                     *[F.sum(F.col(f"`{c}`")).alias(f"__t{i}") for i, c in enumerate(classes)]).first()
    v = tot_row["__v"]
    logps = [F.struct(F.lit(c).alias("class"),
                      F.log((F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) + F.lit(alpha))
                            / F.lit(float(tot_row[f"__t{i}"] or 0.0) + alpha * max(v, 1))).alias("logp"))
             for i, c in enumerate(classes)]
    model = ct.select("token", F.explode(F.array(*logps)).alias("m")).select("token", "m.class", "m.logp")
    return materialize(model), priors


def predict_text_nb(counts: DataFrame, rows: DataFrame, model: DataFrame, priors: dict, key: str = "row_id",
                    label: str = "label", keep: tuple = (), token_rows: DataFrame | None = None) -> DataFrame:
    """(key, label, pred, log_odds, p1): argmax of prior + sum tf * logp (ties -> smaller class)."""
    classes = sorted(priors)
    j = token_lookup(counts, model, token_rows)
    s = j.groupBy(key).pivot("class", classes).agg(F.sum(F.col("tf") * F.col("logp")))
    base = rows.select(key, label, *keep).join(s, key, "left")
    ll = {c: F.lit(priors[c]) + F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in classes}
    if len(classes) != 2:
        raise ValueError("binary text classifier expects two classes")
    l0, l1 = ll[classes[0]], ll[classes[1]]
    pred = F.when(l1 > l0, F.lit(classes[1])).otherwise(F.lit(classes[0]))
    missing = [c for c in classes if priors[c] == -math.inf]
    # with one class only, the odds are infinite towards it; they are given as +-MAX_ODDS
    odds = F.lit(-MAX_ODDS if missing == [classes[1]] else MAX_ODDS) if missing else l1 - l0
    if missing:
        pred = F.lit(classes[0] if missing == [classes[1]] else classes[1])
    return base.select(key, label, *keep, pred.cast("int").alias("pred"), odds.alias("log_odds"),
                       logistic(odds).alias("p1"))


def logistic(z):
    """1 / (1 + exp(-z)) without overflow on either side."""
    return F.when(z >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).otherwise(F.exp(z) / (F.lit(1.0) + F.exp(z)))


def text_classifier(train: DataFrame, test: DataFrame, col: str = "text", label: str = "label", key: str = "row_id",
                    weight: str | None = None, method: str = "nb", num_features: int = 1 << 18,
                    keep: tuple = (), classes: tuple | None = None) -> DataFrame:
    """Fit on ``train`` text, score ``test``: (key, label, keep..., pred, log_odds, p1).

    ``classes``: the labels that the model knows even if ``train`` lacks one of them."""
    if method == "nb":
        tr_counts = materialize(token_counts(train, col, key))
        model, priors = fit_text_nb(tr_counts, train, key, label, weight, classes=classes)
        doc_freq = tr_counts.groupBy("token").agg(F.count(F.lit(1)).alias("__rows"))
        # the rows that it was fitted on are counted already
        return predict_text_nb(tr_counts if test is train else token_counts(test, col, key), test, model, priors, key, label, keep, doc_freq)
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array
    lr = LogisticRegression(featuresCol="__tfidf", labelCol="__y", maxIter=100, regParam=1.0 / max(train.count(), 1))
    if weight:
        lr = lr.setWeightCol(weight)
    pipe = Pipeline(stages=[RegexTokenizer(inputCol=col, outputCol="__tok", pattern=TOKEN_PATTERN, gaps=False,
                                           toLowercase=False),
                            HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
                            IDF(inputCol="__tf", outputCol="__tfidf"), lr])
    model = pipe.fit(train.withColumn("__y", F.col(label).cast("double")))
    out = model.transform(test)
    p1 = vector_to_array("probability")[1]
    raw = vector_to_array("rawPrediction")
    return out.select(key, label, *keep, F.col("prediction").cast("int").alias("pred"),
                      (raw[1] - raw[0]).alias("log_odds"), p1.alias("p1"))
