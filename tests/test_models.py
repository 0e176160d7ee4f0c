"""kNN against numpy brute force (several blocks, ties), naive Bayes sanity, scorers."""

import numpy as np
import pytest

from flowlens.operators.knn import knn_classify, knn_top_k
from flowlens.operators.naive_bayes import bernoulli_nb, gaussian_nb


def _vecs(spark, n, d, seed, start=0, ties=False):
    rnd = np.random.default_rng(seed)
    x = rnd.integers(0, 3, size=(n, d)).astype(float) if ties else rnd.normal(size=(n, d))
    rows = [(start + i, x[i].tolist(), int(rnd.random() < 0.4)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, vec array<double>, label int"), x, rows


@pytest.mark.parametrize("ties,block", [(False, 16), (True, 7), (True, 1000)])
def test_knn_top_k_brute_force(spark, ties, block):
    tr, xa, rows_a = _vecs(spark, 60, 4, 1, 0, ties)
    te, xb, _ = _vecs(spark, 25, 4, 2, 1000, ties)
    got = {}
    for r in knn_top_k(tr, te, k=5, block_rows=block).collect():
        got.setdefault(r.test_id, []).append((r["rank"], r.train_id))
    for j in range(25):
        d = np.sqrt(((xa - xb[j]) ** 2).sum(axis=1))
        exp = [i for _, i in sorted(zip(d.round(12), range(60)))][:5]
        assert [t for _, t in sorted(got[1000 + j])] == exp


def test_knn_vote(spark):
    tr, _, _ = _vecs(spark, 40, 3, 3)
    te, _, _ = _vecs(spark, 10, 3, 4, 500)
    out = knn_classify(tr, te, k=5, block_rows=9).collect()
    assert len(out) == 10 and all(r.pred in (0, 1) for r in out)


def test_naive_bayes_separable(spark):
    rows = [(i, float(i % 2) * 10 + (i % 7) * 0.1, float(i % 3), float(i % 2), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, on double, label int")
    g = gaussian_nb(df, df, ["a", "b"]).collect()
    assert all(r.pred == r.label for r in g)
    b = bernoulli_nb(df, df, ["on", "b"]).collect()
    assert all(r.pred == r.label for r in b)


def test_cv_variance_does_not_cancel(spark):
    """A column near 1e9 with a spread of half a unit: folds score like the plain model."""
    from flowlens.operators.classifiers import cv_predict_nb
    rows = [(i, 1e9 + (i % 2) * 0.5 + (i % 5) * 0.01, i % 2, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "row_id long, a double, label int, fold int")
    assert all(r.pred == r.label for r in cv_predict_nb(df, ["a"]).collect())


def test_nb_oracle_sql_against_a_small_case_by_hand(spark):
    """The SQL that the model oracles share, on numbers worked out by hand."""
    import duckdb
    from flowlens.plans.common import bnb_sql, gnb_sql
    con = duckdb.connect()
    con.execute("create table tr as select * from (values (1, 0, 0.0), (2, 0, 2.0), (3, 1, 9.0), (4, 1, 11.0)) t(row_id, label, a)")
    con.execute("create table te as select * from (values (5, 0, 5.4), (6, 1, 5.6), (7, 0, -1.0)) t(row_id, label, a)")
    # means 1 and 10, equal variances: the border is 5.5
    assert con.execute("with " + gnb_sql("tr", "te", ["a"]) + " select row_id, pred from nb order by 1").fetchall() == [(5, 0), (6, 1), (7, 0)]
    # on: class 0 one of two (p = 2/4), class 1 two of two (p = 3/4); off favours class 0
    assert con.execute("with " + bnb_sql("tr", "te", ["a"]) + " select row_id, pred from bp order by 1").fetchall() == [(5, 1), (6, 1), (7, 0)]


def test_combine_scores_refuses_unequal_keys(spark):
    from flowlens.plans.q_rows import combine_scores
    a = spark.createDataFrame([(1, 0.5), (2, 0.6)], "row_id long, a double")
    b = spark.createDataFrame([(1, 0.1), (3, 0.2)], "row_id long, b double")
    assert combine_scores(a, a.withColumnRenamed("a", "b")).count() == 2
    with pytest.raises(Exception, match="one scorer only"):
        combine_scores(a, b).collect()


def test_knn_sends_few_rows_on_clustered_data(spark):
    """Ten times the rows: the test rows sent to blocks grow far less than a hundredfold."""
    from flowlens.operators.knn import knn_candidates
    sent = {}
    for n in (400, 4000):
        rnd = np.random.default_rng(8)
        centres = rnd.normal(size=(40, 3)) * 50
        x = centres[rnd.integers(40, size=n)] + rnd.normal(size=(n, 3))
        df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "row_id long, vec array<double>, label int")
        tr, te = df.where("row_id % 5 > 0"), df.where("row_id % 5 = 0")
        cand, more = knn_candidates(tr, te, "vec", "row_id", "label", 5, 50)
        sent[n] = more.count() + te.count()
        got = {}
        for r in cand.collect():
            got.setdefault(r.test_id, []).append((r.distance, r.train_id))
        train = [i for i in range(n) if i % 5]
        for j in range(0, n, 5 * 37):
            d = np.sqrt(((x[train] - x[j]) ** 2).sum(axis=1))
            assert [t for _, t in sorted(got[j])[:5]] == [train[i] for i in np.argsort(d)[:5]]
    assert sent[4000] < 25 * sent[400]


def test_many_classes_are_scored_in_batches_alike(spark, monkeypatch):
    from flowlens.operators import naive_bayes as NB
    rnd = np.random.default_rng(4)
    rows = [(i, float(rnd.normal() + i % 5), float(rnd.random() < 0.2 * (i % 5)), i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label int")
    for fn in (NB.gaussian_nb, NB.bernoulli_nb):
        monkeypatch.setattr(NB, "INLINE_CLASSES", 64)
        inline = sorted(map(tuple, fn(df, df, ["a", "b"]).collect()))
        monkeypatch.setattr(NB, "INLINE_CLASSES", 2)
        assert sorted(map(tuple, fn(df, df, ["a", "b"]).collect())) == inline
