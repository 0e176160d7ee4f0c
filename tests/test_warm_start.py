"""Warm-started mini-batch training against a numpy run of the same steps."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.text import TOKEN_PATTERN
from flowlens.operators import warm_start as W

N = 64


def features(text):
    out = np.zeros(N + 1)
    for t in re.findall(TOKEN_PATTERN, text or ""):
        out[int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % N] += 1
    if out.any():
        out /= np.sqrt((out * out).sum())
    out[N] = 1
    return out


def numpy_train(rows, w, epochs, steps, rate, seed):
    out = []
    for e in range(epochs):
        order = sorted(rows, key=lambda r: (hashlib.md5(f"{seed * 1000003 + e}#{r[0]}".encode()).hexdigest(), r[0]))
        size = -(-len(rows) // steps) if rows else 1
        for i in range(0, len(order), size):
            batch = order[i:i + size]
            x, y = np.array([features(r[1]) for r in batch]), np.array([r[2] for r in batch])
            w = w - rate * ((1 / (1 + np.exp(-x @ w)) - y) @ x) / len(batch)
        out.append(w)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    good, bad = ["port", "open", "tcp", "ack", "flow"], ["flood", "scan", "port", "drop!"]
    out = [(i, " ".join(rng.choice(bad if i % 3 == 0 else good, rng.integers(1, 12))), int(i % 3 == 0)) for i in range(83)]
    return out + [(83, "", 1), (84, None, 0), (85, "  ", 0)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return W.feature_table(spark.createDataFrame(rows, "row_id long, text string, label int").repartition(3), n_features=N)


def test_features_match(table, rows):
    got = {r.row_id: r for r in table.collect()}
    for i, text, _ in rows:
        dense = np.zeros(N + 1)
        dense[got[i].idx] = got[i].val
        assert len(set(got[i].idx)) == len(got[i].idx)
        assert np.allclose(dense, features(text), atol=1e-12)


def test_weights_equal_numpy_and_training_goes_on(spark, table, rows, tmp_path):
    first = W.train(table, None, 2, 5, 3.0, 42, N)
    want = numpy_train(rows, np.zeros(N + 1), 2, 5, 3.0, 42)
    assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(first, want))
    kept = W.load_weights(spark, W.save_weights(spark, first[-1], str(tmp_path / "w")), N)
    assert (kept == first[-1]).all()
    some = [r for r in rows if r[0] % 4 == 0]
    again = W.train(table.where("row_id % 4 = 0"), kept, 3, 4, 3.0, 43, N)
    want = numpy_train(some, want[-1], 3, 4, 3.0, 43)
    assert all(np.abs(a - b).max() < 1e-9 for a, b in zip(again, want))
    assert np.abs(again[-1] - W.train(table.where("row_id % 4 = 0"), None, 3, 4, 3.0, 43, N)[-1]).max() > 1e-3
    # the same at another partitioning
    other = W.train(table.repartition(7), None, 2, 5, 3.0, 42, N)
    assert np.abs(other[-1] - first[-1]).max() < 1e-12


def test_no_corrections_keep_the_weights(table):
    w = np.arange(N + 1.0)
    out = W.train(table.limit(0), w, 3, 4, 1.0, 1, N)
    assert len(out) == 3 and all((x == w).all() for x in out)


def test_scores(table, rows):
    w = W.train(table, None, 6, 4, 8.0, 42, N)[-1]
    got = {r.row_id: r for r in W.score(table, w).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        z = features(text) @ w
        assert abs(got[i].log_odds - z) < 1e-9 and got[i].pred == int(z > 0) and abs(got[i].p1 - 1 / (1 + np.exp(-z))) < 1e-9
    right = sum(got[i].pred == y for i, _, y in rows)
    assert right / len(rows) > 0.85
    assert W.score(table.limit(0), w).count() == 0


def test_fewer_rows_than_steps(table, rows):
    few = table.where("row_id < 3")
    got = W.train(few, None, 2, 8, 1.0, 7, N)
    want = numpy_train([r for r in rows if r[0] < 3], np.zeros(N + 1), 2, 8, 1.0, 7)
    assert np.abs(got[-1] - want[-1]).max() < 1e-9
    assert few.agg(F.count("*")).first()[0] == 3
