"""Low-rank one-class scores against numpy; binned densities against exact kernel sums; odd tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import low_rank as L
from flowlens.operators import profile as P


def _vectors(spark, x, label=0, start=0):
    return spark.createDataFrame([(start + i, label, r) for i, r in enumerate(x.tolist())],
                                 "row_id long, label int, vec array<double>").repartition(3)


def _residual(train, x, share):
    mean = train.mean(0)
    _, s, vt = np.linalg.svd(train - mean, full_matrices=False)
    rank = int(np.searchsorted(np.cumsum(s * s) / (s * s).sum(), share)) + 1
    c = x - mean
    return ((c - c @ vt[:rank].T @ vt[:rank]) ** 2).sum(1)


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_scores_equal_numpy(spark, share):
    rng = np.random.default_rng(3)
    train = rng.normal(size=(300, 8)) * [9, 7, 5, 3, 2, 1, 0.5, 0.1] @ np.linalg.qr(rng.normal(size=(8, 8)))[0] + 50
    test = rng.normal(size=(40, 8)) * 3 + 50
    got = L.score(_vectors(spark, test), {"s": L.fit(_vectors(spark, train), share=share)}).collect()
    want = _residual(train, test, share)
    assert np.allclose([r.s for r in sorted(got, key=lambda r: r.row_id)], want, rtol=1e-6, atol=1e-7)


def test_broken_correlation_is_seen_where_the_diagonal_model_is_blind(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=400)
    benign = np.stack([a, a + 0.05 * rng.normal(size=400)], 1)
    odd = np.stack([[1.0, 1.0], [1.0, -1.0]])
    s = sorted(L.score(_vectors(spark, odd), {"s": L.fit(_vectors(spark, benign))}).collect(), key=lambda r: r.row_id)
    assert s[1].s > 50 * s[0].s


def test_blend_separates_classes(spark):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(10, 10)))[0]
    # each class fills another plane
    rows = [(rng.normal(size=(200, 2)) * 4) @ q[2 * c:2 * c + 2] + 0.1 * rng.normal(size=(200, 10)) for c in (0, 1)]
    df = _vectors(spark, rows[0]).unionByName(_vectors(spark, rows[1], 1, 1000))
    out = L.two_scorer_blend(df, df).collect()
    assert len(out) == 400 and {r.pred for r in out} <= {0, 1}
    benign = [r.blend for r in out if r.label == 0]
    assert np.mean([r.blend for r in out if r.label == 1]) > np.mean(benign)
    assert all(0 <= r.score_benign <= 1 and 0 <= r.score_anomaly <= 1 for r in out)


def test_unusable_vectors_constant_class_empty_table_clashing_names(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [1.0, float("nan")]), (5, [1.0]), (6, []), (7, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "k0 int, `x.y` array<double>")
    fit = L.fit(df, "x.y")
    assert fit["basis"].shape == (0, 2)
    assert {r.k0: r.s for r in L.score(df, {"s": fit}, "x.y", ("k0",)).collect()} == {
        1: 0.0, 2: None, 3: None, 4: None, 5: None, 6: None, 7: 0.0}
    assert L.score(df.limit(0), {"s": fit}, "x.y", ("k0",)).count() == 0
    with pytest.raises(ValueError, match="usable row"):
        L.fit(df.limit(0), "x.y")
    with pytest.raises(ValueError, match="usable row"):
        L.fit(df.where("k0 = 4"), "x.y")


def test_cosine_basis_is_orthonormal():
    b = L.cosine_basis(64, 6)
    assert np.allclose(b @ b.T, np.eye(6), atol=1e-12)


def test_binned_density_within_its_bound_of_the_exact_one(spark):
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "skewed").when(F.col("id") % 3 == 1, "hot").otherwise("wide").alias("g"),
        ((F.xxhash64("id") % 9973) / 9973.0).alias("u"), "id")
    x = F.when(F.col("g") == "skewed", F.exp(F.col("u") * 4)).when(
        F.col("g") == "hot", F.when(F.col("id") % 2 == 0, 1.0).otherwise(F.col("u"))).otherwise(F.col("u") * 100)
    df = df.select("g", x.alias("x"))
    exact = {(r.g, r.i): r for r in P.density_by_label(df, "x", "g", grid=50, digits=12).collect()}
    got = P.density_binned(df, "x", "g", grid=50, digits=12).collect()
    assert len(got) == len(exact) == 150
    for r in got:
        assert abs(r.density - exact[r.g, r.i].density) <= r.error_bound + 2e-12 and r.x == pytest.approx(exact[r.g, r.i].x)


def test_binned_density_odd_tables(spark):
    rows = [("a", 1.0), ("a", 1.0), ("b", 2.0), ("c", None), ("c", float("nan")), (None, 1.0), ("d", float("inf")), ("d", 0.0), ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    out = P.density_binned(df, "x", "g", grid=5).collect()
    assert {r.g for r in out} == {"d"} and len(out) == 5            # the other labels have no spread
    assert P.density_binned(df.limit(0), "x", "g").count() == 0
