"""Exact splits, samples, folds: sizes, strata, determinism, partition independence."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowlens.operators import split as S


def _frame(spark, n=997, classes=(0, 1, 2), weights=(0.6, 0.3, 0.1), seed=7, parts=4):
    rnd = random.Random(seed)
    rows = [(i * 3 + 11, rnd.choices(classes, weights)[0]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label int").repartition(parts), rows


def _largest_remainder(counts, k):
    n = sum(counts.values())
    base = {c: counts[c] * k // n for c in counts}
    rem = {c: counts[c] * k % n for c in counts}
    left = k - sum(base.values())
    for c in sorted(counts, key=lambda c: (-rem[c], c))[:left]:
        base[c] += 1
    return base


def _brute_split(rows, f, seed):
    counts = Counter(lab for _, lab in rows)
    n = len(rows)
    n_test = math.ceil(n * f)
    train_q = _largest_remainder(counts, n - n_test)
    by = {}
    for rid, lab in rows:
        by.setdefault(lab, []).append((hashlib.md5(f"{seed}#{rid}".encode()).hexdigest(), rid))
    out = {}
    for lab, lst in by.items():
        for i, (_, rid) in enumerate(sorted(lst)):
            out[rid] = "train" if i < train_q[lab] else "test"
    return out


@pytest.mark.parametrize("parts,hex_digits", [(1, 1), (7, 2), (16, 4)])
def test_stratified_split_matches_brute_force(spark, parts, hex_digits):
    df, rows = _frame(spark, parts=parts)
    got = {r.row_id: r.split for r in S.stratified_split(df, "row_id", "label", "0.2", 42, hex_digits=hex_digits).collect()}
    assert got == _brute_split(rows, 0.2, 42)


def test_split_sizes_disjoint_and_cover(spark):
    df, rows = _frame(spark, n=1001)
    sp = S.stratified_split(df, "row_id", "label", "0.2", 42).collect()
    assert len(sp) == 1001 and len({r.row_id for r in sp}) == 1001
    assert sum(r.split == "test" for r in sp) == math.ceil(0.2 * 1001)


def test_single_class_and_tiny(spark):
    df = spark.createDataFrame([(1, 0)], "row_id long, label int")
    assert [r.split for r in S.stratified_split(df, "row_id", "label", "0.2", 42).collect()] == ["test"]
    df = spark.createDataFrame([(i, 1) for i in range(10)], "row_id long, label int")
    assert sum(r.split == "test" for r in S.stratified_split(df, "row_id", "label", "0.2", 42).collect()) == 2


def test_sample_fraction_exact_size(spark):
    df, rows = _frame(spark, n=2000)
    assert S.sample_fraction(df, "row_id", "0.035", 42).count() == round(0.035 * 2000)


def test_folds_match_library_semantics(spark):
    # classes in order of first appearance, fold sizes from striding the class-sorted list
    labels = [2, 0, 0, 1, 2, 2, 0, 1, 1, 1, 0, 2, 2, 0, 1, 0, 0, 2, 1, 0, 2, 1, 0]
    df = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "row_id long, label int")
    got = {r.row_id: r.fold for r in S.stratified_folds(df, "row_id", "label", 5).collect()}
    order = []
    for lab in labels:
        if lab not in order:
            order.append(lab)
    enc = [order.index(lab) for lab in labels]
    y_sorted = sorted(enc)
    alloc = [[y_sorted[i::5].count(c) for c in range(len(order))] for i in range(5)]
    exp = {}
    for c in range(len(order)):
        folds = [f for f in range(5) for _ in range(alloc[f][c])]
        idx = [i for i, e in enumerate(enc) if e == c]
        for i, f in zip(idx, folds):
            exp[i] = f
    assert got == exp


def test_shuffle_batches_cover(spark):
    df, _ = _frame(spark, n=100)
    b = S.shuffle_batches(df, "row_id", 8, 1, 0).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in b) == [4] + [8] * 12


def test_exact_quota_rank_is_permutation(spark):
    df, rows = _frame(spark, n=300, parts=5)
    r = S.exact_quota_rank(df, "row_id", "label", 3).collect()
    by = {}
    for x in r:
        by.setdefault(x.label, []).append(x["rank"])
    for lab, ranks in by.items():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
        assert all(x.class_n == len(ranks) for x in r if x.label == lab)
    assert F is not None


def test_null_keys_are_assigned(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 0)] * 5, "row_id long, label int")
    got = S.stratified_split(df, "row_id", "label", "0.2", 42)
    assert got.count() == 45 and got.where("split = 'test'").count() == 9
