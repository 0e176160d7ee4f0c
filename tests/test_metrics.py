"""Golden confusion counts (FIXTURES.md section 3) reproduce the reference's printed metrics."""

import pytest

from flowlens.operators.metrics import binary_metrics, derived_rates

# (tn, fp, fn, tp) -> printed accuracy, r2, precision benign, precision anomaly, recall, f1, fpr
GOLDEN = [
    ((9136, 575, 4634, 8199), (0.7689, 0.0577, 0.6635, 0.9345, 0.6389, 0.7589, 0.059211)),
    ((9097, 614, 5015, 7818), (0.7503, -0.0183, 0.6446, 0.9272, 0.6092, 0.7353, 0.063227)),
    ((9188, 523, 5031, 7802), (0.7536, -0.0047, 0.6462, 0.9372, 0.6080, 0.7375, 0.053856)),
    ((9711, 0, 12833, 0), (0.4308, -1.3215, 0.4308, 0.0, 0.0, 0.0, 0.0)),
    ((4430, 367, 2252, 4223), (0.7677, None, None, None, 0.6522, 0.7633, 0.076506)),
    ((457, 4457, 2501, 3857), (0.3827, None, None, None, 0.6066, 0.5258, 0.907000)),
    ((2770, 0, 0, 1843), (1.0, None, None, None, 1.0, 1.0, 0.0)),
    ((2770, 0, 1843, 0), (0.6005, -0.6653, None, None, 0.0, 0.0, 0.0)),
]


@pytest.mark.parametrize("conf,printed", GOLDEN)
def test_binary_metrics_reproduce_printed_values(spark, conf, printed):
    df = spark.createDataFrame([conf], "tn long, fp long, fn long, tp long")
    r = binary_metrics(df).first()
    got = (r["accuracy"], r["r2"], r["precision_benign"], r["precision_anomaly"], r["recall"], r["f1"], r["fpr"])
    for g, p, digits in zip(got, printed, (4, 4, 4, 4, 4, 4, 6)):
        if p is not None:
            assert round(g, digits) == pytest.approx(p, abs=10 ** -digits / 2 + 1e-12)


def test_empty_denominators(spark):
    df = spark.createDataFrame([(0, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    r = binary_metrics(df).first()
    assert r["precision_anomaly"] == 0.0 and r["recall"] == 0.0 and r["f1"] == 0.0
    assert r["fpr"] is None and r["r2"] is None
    d = derived_rates(df).first()
    assert d["tpr"] is None and d["fdr"] is None
