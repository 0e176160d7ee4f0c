"""PCA from the centred Gram matrix: against numpy, residuals, odd tables."""

import numpy as np

from flowlens.operators import pca as P


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "row_id long, vec array<double>").repartition(parts)


def test_matches_numpy_far_from_zero(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)) @ np.diag([5, 3, 2, 1, 0.5, 0.1]) @ np.linalg.qr(rng.normal(size=(6, 6)))[0] + 1e5
    df = frame(spark, x)
    fit = P.fit(df)
    c = np.cov(x.T)
    assert np.allclose(fit["eigenvalues"], np.sort(np.linalg.eigvalsh(c))[::-1], rtol=1e-8, atol=1e-9)
    assert np.abs(c @ fit["components"].T - fit["components"].T * fit["eigenvalues"]).max() < 1e-7
    assert np.abs(P.residuals(df, fit)).max() < 1e-7
    got = {r.row_id: r.pcs for r in P.project(df, fit, keep=("row_id",)).collect()}
    assert np.allclose([got[i] for i in range(500)], (x - fit["mean"]) @ fit["components"].T, atol=1e-8)
    other = P.fit(frame(spark, x, 9))
    assert np.allclose(other["components"], fit["components"], atol=1e-6)
    bad = dict(fit, components=np.roll(fit["components"], 1, axis=0))
    assert P.residuals(df, bad).max() > 1


def test_odd_tables(spark):
    same = frame(spark, np.ones((5, 3)))
    fit = P.fit(same)
    assert (fit["eigenvalues"] == 0).all() and P.residuals(same, fit).max() == 0
    one = P.fit(frame(spark, np.array([[1.0, 2.0]])))
    assert one["n"] == 1 and (one["eigenvalues"] == 0).all()
    assert P.fit(same.limit(0))["n"] == 0
    assert P.project(same.limit(0), fit, keep=("row_id",)).count() == 0
