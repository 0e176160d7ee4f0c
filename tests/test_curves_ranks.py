"""Running sums, ranks and curves against brute force; bucket count must not matter."""

import random

import pytest

from flowlens.operators import curves as C
from flowlens.operators import ranks as R


def _scored(spark, n=400, seed=3, ties=True, parts=5):
    rnd = random.Random(seed)
    rows = [(i, float(rnd.randint(0, 40)) if ties else rnd.random(), int(rnd.random() < 0.3)) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, score double, label int").repartition(parts), rows


def _auc_brute(rows):
    pos = [s for _, s, y in rows if y == 1]
    neg = [s for _, s, y in rows if y == 0]
    tot = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(rows):
    P = sum(y for *_, y in rows)
    out = 0.0
    for t in sorted({s for _, s, _ in rows}, reverse=True):
        tp = sum(1 for _, s, y in rows if s >= t and y == 1)
        fp = sum(1 for _, s, y in rows if s >= t and y == 0)
        pos_here = sum(1 for _, s, y in rows if s == t and y == 1)
        out += pos_here / P * tp / (tp + fp)
    return out


@pytest.mark.parametrize("ties", [True, False])
def test_auroc_and_ap(spark, ties):
    df, rows = _scored(spark, ties=ties)
    r = C.auroc_and_ap(df).first()
    assert r["auroc"] == pytest.approx(_auc_brute(rows), abs=1e-6)
    assert r["average_precision"] == pytest.approx(_ap_brute(rows), abs=1e-6)


def test_auroc_symmetry_and_edges(spark):
    df, rows = _scored(spark)
    a = C.auroc(df).first()["auroc"]
    neg = df.withColumn("score", -df["score"])
    assert C.auroc(neg).first()["auroc"] == pytest.approx(1 - a, abs=2e-6)
    tied = spark.createDataFrame([(i, 1.0, i % 2) for i in range(10)], "row_id long, score double, label int")
    assert C.auroc(tied).first()["auroc"] == 0.5
    perfect = spark.createDataFrame([(i, float(i), int(i >= 5)) for i in range(10)], "row_id long, score double, label int")
    assert C.auroc(perfect).first()["auroc"] == 1.0
    one = spark.createDataFrame([(1, 1.0, 1)], "row_id long, score double, label int")
    assert C.auroc(one).first()["auroc"] is None


def test_roc_points_end_at_one(spark):
    df, _ = _scored(spark)
    pts = C.roc_points(df, drop_intermediate=False).collect()
    assert (None, 0.0, 0.0) in [(p.threshold, p.fpr, p.tpr) for p in pts]
    lowest = min((p for p in pts if p.threshold is not None), key=lambda p: p.threshold)
    assert lowest.fpr == 1.0 and lowest.tpr == 1.0


@pytest.mark.parametrize("per_bucket", [500_000, 70, 3])
def test_running_sum_bucket_independent(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", per_bucket)
    rnd = random.Random(1)
    rows = [(float(v), rnd.randint(1, 5)) for v in rnd.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "v double, w long").repartition(4)
    got = {r.v: r.cum_w for r in R.running_sum(df, "v", ["w"]).collect()}
    acc, exp = 0, {}
    for v, w in sorted(rows):
        acc += w
        exp[v] = acc
    assert got == exp
    got_desc = {r.v: r.cum_w for r in R.running_sum(df, "v", ["w"], descending=True).collect()}
    acc, exp = 0, {}
    for v, w in sorted(rows, reverse=True):
        acc += w
        exp[v] = acc
    assert got_desc == exp


def test_ordered_and_hash_rank(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice("ab"), float(rnd.randint(0, 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, g string, v double").repartition(6)
    got = {r.k: r["rank"] for r in R.ordered_rank(df, "v", "k", ("g",)).collect()}
    exp = {}
    for g in "ab":
        for i, (k, _, v) in enumerate(sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0]))):
            exp[k] = i + 1
    assert got == exp
    hr = R.hash_rank(df, "k", 9, ("g",), hex_digits=1).collect()
    for g in "ab":
        assert sorted(r["rank"] for r in hr if r.g == g) == list(range(1, sum(1 for x in rows if x[1] == g) + 1))


def test_bucket_count_grows_with_rows(spark, monkeypatch):
    """With a tiny per-bucket target the large-input path runs: ranges, longer hash
    prefixes and a shuffle-joined offsets table. Ranks stay exact."""
    from flowlens.operators import split as S
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 7)
    monkeypatch.setattr(R, "BROADCAST_BUCKETS", 8)
    assert R.buckets_for(300) == 43 and R.hex_digits_for(300, 1) == 2
    rnd = random.Random(5)
    rows = [(i, rnd.choice("ab"), float(rnd.randint(0, 30))) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, g string, v double").repartition(6)
    staged, nb = R.range_buckets(df, [], "k", "__b")
    assert nb == 43
    assert staged.groupBy("__b").count().agg({"count": "max"}).first()[0] <= 30
    got = {r.k: r["rank"] for r in R.ordered_rank(df, "v", "k", ("g",)).collect()}
    exp = {}
    for g in "ab":
        for i, (k, _, v) in enumerate(sorted((x for x in rows if x[1] == g), key=lambda x: (x[2], x[0]))):
            exp[k] = i + 1
    assert got == exp
    sums = {r.k: r.cum_v for r in R.running_sum(df, "k", ["v"]).collect()}
    acc = 0.0
    for k, _, v in sorted(rows):
        acc += v
        assert sums[k] == acc
    hr = R.hash_rank(df, "k", 9, ("g",), hex_digits=1).collect()
    for g in "ab":
        assert sorted(r["rank"] for r in hr if r.g == g) == list(range(1, sum(1 for x in rows if x[1] == g) + 1))
    monkeypatch.setattr(S, "hex_digits_for", R.hex_digits_for)
    srows = [(i * 3 + 11, rnd.choice((0, 1, 2))) for i in range(400)]
    sdf = spark.createDataFrame(srows, "row_id long, label int").repartition(5)
    from tests.test_split import _brute_split
    got_split = {r.row_id: r.split for r in S.stratified_split(sdf, "row_id", "label", "0.2", 42, hex_digits=1).collect()}
    assert got_split == _brute_split(srows, 0.2, 42)


def test_strings_with_a_common_prefix_spread(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS_PER_BUCKET", 5_000)
    names = [f"Customer#000000000000{i:06d}" for i in range(100_000)]
    random.Random(1).shuffle(names)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    staged, nb = R.range_buckets(df, [], "name", "__b")
    assert nb == 20 and staged.groupBy("__b").count().agg({"count": "max"}).first()[0] <= 12_000
    got = {r.name: r["rank"] for r in R.string_rank(df, "name").collect()}
    assert got == {n: i + 1 for i, n in enumerate(sorted(names))}
