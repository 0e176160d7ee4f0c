"""Automatic bins: edges and counts of numpy's ``auto`` rule."""

import numpy as np

from flowlens.operators.auto_bins import auto_histogram


def test_edges_equal_numpy(spark):
    rng = np.random.default_rng(8)
    parts = {"a": rng.normal(size=400), "b": rng.integers(0, 5, 90).astype(float) + 0.25, "c": np.full(7, 3.5), "d": np.array([1.0, 2.0]),
             "e": np.append(np.zeros(50), [1.5, 9.0])}
    rows = [(k, float(v)) for k, x in parts.items() for v in x] + [("a", None), (None, 1.0), (None, 4.0)]
    got = auto_histogram(spark.createDataFrame(rows, "label string, x double").repartition(3), "x", "label", 9).collect()
    for k, x in [*parts.items(), (None, np.array([1.0, 4.0]))]:
        mine = sorted((r.bin, r.lo, r.hi, r.n) for r in got if r.label == k)
        counts, edges = np.histogram(x, bins="auto")
        assert [r[3] for r in mine] == counts.tolist()
        assert np.allclose([r[1] for r in mine] + [mine[-1][2]], edges, atol=1e-8)
    assert auto_histogram(spark.createDataFrame([], "label string, x double"), "x", "label").count() == 0
