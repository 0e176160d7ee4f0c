"""Folder ingest with quarantine, fit store, encoders and scalers on edge inputs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from flowlens.operators import encode as E
from flowlens.operators import scale as S
from flowlens.sources import flows_io as IO


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_ingest_quarantines_ragged_file(spark):
    root = tempfile.mkdtemp(prefix="flowlens-ingest-")
    _write(f"{root}/Benign_traffic/a.csv", "x,y,Label\n1,2,z\n3,4,z\n")
    _write(f"{root}/Mirai/a.csv", "x,y\n5,6\n")
    _write(f"{root}/Mirai/bad.csv", "x,y\n7,8,9\n")
    rows, bad = IO.ingest_labelled_folders(spark, root, ["Benign_traffic", "Mirai"])
    got = sorted((r.x, r.y, r.label) for r in rows.collect())
    assert got == [(1, 2, "Benign_traffic"), (3, 4, "Benign_traffic"), (5, 6, "Mirai")]
    assert "Label" not in rows.columns
    assert [(os.path.basename(r.file), r.folder) for r in bad.collect()] == [("bad.csv", "Mirai")]


def test_missing_fit_names_the_step(spark):
    with pytest.raises(IO.MissingFitError, match="fit_standard_scale"):
        IO.load_fit(spark, tempfile.mkdtemp(), "standard_scale", "fit_standard_scale")


def test_unseen_category_fails_and_one_hot_zeros(spark):
    train = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, c string")
    test = spark.createDataFrame([(3, "a"), (4, "z")], "row_id long, c string")
    fit = E.fit_label_encode(train, ["c"])
    with pytest.raises(Exception, match="unseen category"):
        E.apply_label_encode(test, fit).collect()
    oh = {r.row_id: (r.c_a, r.c_b) for r in E.one_hot_align(test, E.fit_one_hot(train, ["c"])).collect()}
    assert oh == {3: (1.0, 0.0), 4: (0.0, 0.0)}


def test_scalers_on_constant_column(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 2.0), (3, 5.0, 2.0), (4, 5.0, 9.0)], "row_id long, k double, v double")
    st = S.apply_standard_scale(df, S.fit_standard_scale(df, ["k", "v"])).collect()
    assert all(r.k == 0.0 for r in st)
    assert sum(r.v for r in st) == pytest.approx(0.0, abs=1e-12)
    assert sum(r.v ** 2 for r in st) / 4 == pytest.approx(1.0)
    mm = S.apply_minmax_scale(df, S.fit_minmax_scale(df, ["k", "v"])).collect()
    assert all(r.k == 0.0 for r in mm) and min(r.v for r in mm) == 0.0 and max(r.v for r in mm) == 1.0
    z = S.fit_zscore_sample(df, ["v"]).first()
    assert z["std"] == pytest.approx(3.696846, abs=1e-6)
    assert F is not None


def test_skew_safe_lookup_hot_path(spark, monkeypatch):
    """Hot keys (most rows on one key) go through the broadcast side; result equals a plain join."""
    from flowlens.operators import skew as SK
    monkeypatch.setattr(SK, "HOT_ROWS", 5)
    monkeypatch.setattr(SK, "MAX_HOT_KEYS", 9)
    rows = [(i, "a" if i % 3 else "b", float(i % 4 == 0) if i < 60 else float(i % 7)) for i in range(90)]
    big = spark.createDataFrame(rows, "k long, column string, value double")
    table = big.groupBy("column", "value").count().withColumnRenamed("count", "c") \
        .withColumn("payload", F.concat_ws("/", "column", F.col("value").cast("string")))
    assert SK.hot_threshold(90) == 10
    counts = sorted(r["c"] for r in table.collect())
    assert counts[-1] > 10 and counts[0] <= 10          # both branches run
    got = sorted(tuple(r) for r in SK.skew_safe_lookup(big, table, ["column", "value"], "c")
                 .select("k", "payload").collect())
    exp = sorted(tuple(r) for r in big.join(table.drop("c"), ["column", "value"]).select("k", "payload").collect())
    assert got == exp and len(got) == 90
    left = big.where("k < 80").unionByName(spark.createDataFrame([(999, "z", 1.0)], "k long, column string, value double"))
    got_left = sorted(tuple(r) for r in SK.skew_safe_lookup(left, table, ["column", "value"], "c", "left")
                      .select("k", "payload").collect())
    assert len(got_left) == 81 and (999, None) in got_left


def test_encode_lookup_large_dictionary_path(spark, monkeypatch):
    """Dictionary over the broadcast limit with one hot category: same codes as the broadcast path."""
    from flowlens.operators import skew as SK
    rows = [(i, "hot" if i % 4 else f"c{i % 13}") for i in range(100)] + [(1000, None)]
    df = spark.createDataFrame(rows, "row_id long, cat string")
    fit = E.fit_label_encode(df, ["cat"])
    base = sorted(tuple(r) for r in E.encode_lookup(df, "cat", fit).collect())
    monkeypatch.setattr(E, "BROADCAST_ENTRIES", 2)
    monkeypatch.setattr(SK, "HOT_ROWS", 10)
    monkeypatch.setattr(SK, "MAX_HOT_KEYS", 1000)
    forced = sorted(tuple(r) for r in E.encode_lookup(df, "cat", fit).collect())
    assert forced == base and len(base) == 101


def test_label_encode_keeps_every_column_of_a_large_dictionary(spark, monkeypatch):
    """Two columns over the broadcast limit, nulls and a clash with the suffix: all are encoded."""
    monkeypatch.setattr(E, "BROADCAST_ENTRIES", 3)
    rows = [(i, f"b{i:03d}", f"s{i % 5}", None if i % 7 == 0 else "k") for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, big string, small string, gap string")
    fit = E.fit_label_encode(df, ["big", "small", "gap"])
    got = E.apply_label_encode(df, fit).orderBy("row_id").collect()
    assert [(r.big, r.small, r.gap) for r in got] == [(i, i % 5, None if i % 7 == 0 else 0) for i in range(60)]
    more = E.apply_label_encode(df, fit, suffix="_code").orderBy("row_id").collect()
    assert [(r.big, r.big_code, r.small_code) for r in more] == [(f"b{i:03d}", i, i % 5) for i in range(60)]
    wide = E.one_hot_sparse(df, fit, ["big", "small", "gap"]).orderBy("row_id").collect()
    assert all(r.one_hot.size == 66 for r in wide)
    assert [list(r.one_hot.ones) for r in wide] == [[i] + ([] if i % 7 == 0 else [60]) + [61 + i % 5] for i in range(60)]


def test_ingest_reads_each_file_by_its_own_header(spark):
    root = tempfile.mkdtemp(prefix="flowlens-ingest-")
    _write(f"{root}/A/a.csv", "x,y\n1,2.5\n")
    _write(f"{root}/A/b.csv", "y,x\n20,10\n")
    _write(f"{root}/A/c.csv", "x,y,z\n3,4,u\n5\n")
    _write(f"{root}/A/late.csv", "x,y\n7,8\n9,10\n11,12,13\n")
    _write(f"{root}/B/d.csv", "x,x,z\n6,60,\n")
    rows, bad = IO.ingest_labelled_folders(spark, root, ["A", "B"])
    got = sorted((r.x, r.y, r.z, r["x.1"], r.label) for r in rows.collect())
    assert got == [(1, 2.5, None, None, "A"), (3, 4.0, "u", None, "A"), (5, None, None, None, "A"), (6, None, None, 60, "B"),
                   (10, 20.0, None, None, "A")]
    assert [(os.path.basename(r.file), r.folder, r.n_rows) for r in bad.collect()] == [("late.csv", "A", 3)]


def test_cast_binary_keeps_whole_numbers(spark):
    from flowlens.functions.labels import cast_binary
    df = spark.createDataFrame([(True, 2), (False, 0), (None, None)], "a boolean, b int")
    assert [tuple(r) for r in cast_binary(df, ["a", "b"]).collect()] == [(1, 2), (0, 0), (None, None)]


def test_one_hot_beyond_the_bound_stays_in_spark(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a", "p"), (2, "b", None), (3, "c", "q")], "row_id long, c string, d string")
    fit = E.fit_one_hot(df, ["c", "d"])
    assert E.one_hot(df, fit).columns == ["row_id", "c_a", "c_b", "c_c", "d_p", "d_q"]
    monkeypatch.setattr(E, "MAX_DUMMIES", 4)
    wide = E.one_hot(df, fit)
    assert wide.columns == ["row_id", "one_hot"]
    assert {r.row_id: (r.one_hot.size, list(r.one_hot.ones)) for r in wide.collect()} == {1: (5, [0, 3]), 2: (5, [1]), 3: (5, [2, 4])}
    assert E.one_hot(df, fit, drop=False).columns == ["row_id", "c", "d", "one_hot"]
