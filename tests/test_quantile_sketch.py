"""KLL states: rank error within the bound, merging, nulls, constants, empty frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import quantile_sketch as Q

PROBS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]


def _frame(spark, n=200_000):
    """Skewed, constant, mostly one value (a third of all rows and more), uniform, with nulls and NaN."""
    i = F.col("id")
    u = (F.xxhash64("id") % 1000003).cast("double")
    return spark.range(0, n, 1, 7).select(
        F.exp(u / 1e5).alias("skewed"), F.lit(4.5).alias("constant"),
        F.when(i % 3 == 0, u).otherwise(0.0).alias("hot"), u.alias("uniform"),
        F.when(i % 5 == 0, None).when(i % 5 == 1, float("nan")).otherwise(i.cast("double")).alias("gaps"),
        (i % 4).alias("part"))


COLS = ["skewed", "constant", "hot", "uniform", "gaps"]


@pytest.mark.parametrize("k", [200, Q.DEFAULT_K])
def test_rank_error_within_bound_also_after_merging(spark, k):
    df = _frame(spark)
    for sts in (Q.states(df, COLS, k=k), Q.merge(Q.states(df, COLS, by=["part"], k=k))):
        rows = Q.rank_errors(df, Q.quantiles(sts, PROBS)).collect()
        assert len(rows) == len(COLS) * len(PROBS)
        assert max(r.rank_error for r in rows) <= Q.rank_bound(k)
        assert {r.q for r in rows if r.column == "constant"} == {4.5}


def test_audit_sees_a_wrong_answer(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    wrong = spark.createDataFrame([("x", 1000, 0.5, 700.0)], "column string, n long, p double, q double")
    assert Q.rank_errors(df, wrong).first().rank_error == pytest.approx(0.2)


def test_moments_of_merged_states_are_those_of_all_rows(spark):
    df = _frame(spark, 20_000)
    whole = {r["column"]: r for r in Q.states(df, COLS).collect()}
    for r in Q.merge(Q.states(df, COLS, by=["part"])).collect():
        w = whole[r["column"]]
        assert (r.n, r.min, r.max) == (w.n, w.min, w.max)
        assert r["mean"] == pytest.approx(w["mean"]) and r.std == pytest.approx(w.std, abs=1e-6)


def test_small_column_is_exact_and_describe_has_its_columns(spark):
    x = np.arange(101, dtype=float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    r = Q.describe_sketch(df, ["x"]).first()
    assert (r["count"], r["mean"], r["min"], r["max"]) == (101, 50.0, 0.0, 100.0)
    assert abs(r.q25 - 25) <= 1 and abs(r.q50 - 50) <= 1 and abs(r.q75 - 75) <= 1


def test_empty_and_null_columns_and_clashing_names(spark):
    none = spark.createDataFrame([], "x double")
    r = Q.quantiles(Q.states(none, ["x"]), [0.5]).first()
    assert (r.n, r.q, r.min) == (0, None, None)
    assert Q.states(none.withColumn("g", F.lit("a")), ["x"], by=["g"]).count() == 0
    d = Q.describe_sketch(none, ["x"]).first()
    assert (d["count"], d.q50) == (0, None)
    odd = spark.createDataFrame([("a", None, 1.0), ("a", None, 3.0), ("b", None, 2.0), (None, None, 9.0)],
                                "n0 string, `a.b` double, sketch double")
    got = {(r.n0, r["column"]): (r.n, r.max) for r in Q.states(odd, ["a.b", "sketch"], by=["n0"]).collect()}
    assert got == {("a", "a.b"): (0, None), ("a", "sketch"): (2, 3.0), ("b", "a.b"): (0, None), ("b", "sketch"): (1, 2.0),
                   (None, "a.b"): (0, None), (None, "sketch"): (1, 9.0)}
    merged = {r["column"]: r for r in Q.quantiles(Q.merge(Q.states(odd, ["a.b", "sketch"], by=["n0"])), [1.0]).collect()}
    assert (merged["a.b"].n, merged["a.b"].q, merged["sketch"].q) == (0, None, 9.0)
    assert Q.rank_errors(odd, Q.quantiles(Q.states(odd, ["a.b"]), [0.5])).first().rank_error is None
