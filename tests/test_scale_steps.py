"""Steps whose memory or time must not grow with the table: partitions, jobs per level, counts on arrays."""

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import encode as E
from flowlens.operators import exact_tree as T
from flowlens.operators import ranks, textmodel, tokens, warm_start


def test_ranks_are_dealt_to_more_partitions_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_BUCKET", 100)
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 7).alias("a"), (-F.col("id")).alias("b"), F.lit(0).alias("c"))
    assert E.average_rank(df, ["a", "b", "c"], "row_id").rdd.getNumPartitions() >= 30
    got = {(r.a, r.b): r.rho for r in E.spearman_matrix(df, ["a", "b", "c"], "row_id").collect()}
    assert got["b", "b"] == 1 and got["a", "c"] is None and got["c", "c"] is None
    rank = np.array([i % 7 for i in range(1000)]).astype(float)
    assert abs(got["a", "b"] - np.corrcoef(rank, -np.arange(1000))[0, 1]) < 1e-3


def test_forest_rows_travel_once_per_task_not_per_tree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.random() < 0.4), float(rng.normal()), float(i % 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, label int, a double, b double")
    packed = T._pack(T._columns(df, ["a", "b"], "label", "row_id"), 2, 12, True, 42, True)
    assert packed.agg(F.sum("n")).first()[0] == 500 and packed.agg(F.sum(F.octet_length("w"))).first()[0] == 500 * 12
    assert packed.count() <= df.rdd.getNumPartitions()


def test_sorted_copies_give_the_root_split(spark, monkeypatch):
    monkeypatch.setattr(T, "MAX_VALUES", 4)
    monkeypatch.setattr(T, "RANGE_ROWS", 100)
    monkeypatch.setattr(T, "CHUNK_ROWS", 16)
    rows = [(i, int(i % 97 > 40), float(i % 97), float(i % 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "row_id long, label int, a double, b double")
    got = T.root_split(df, ["a", "b"]).first()
    left = [r for r in rows if r[2] <= 40.5]
    assert tuple(got) == ("a", 40.5, len(left), 0, 900 - len(left), 900 - len(left))


def test_tokens_are_counted_on_arrays(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, None), (3, ""), (4, "a"), (None, "c c")], "row_id long, text string").coalesce(1)
    got = textmodel.token_counts(df)
    assert "MapInArrow" in got._jdf.queryExecution().toString()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", 1.0), (1, "b", 2.0), (4, "a", 1.0), (None, "c", 2.0)], key=str)
    feats = warm_start.hashed_features(df, n_features=64, keep=("row_id",))
    assert "MapInArrow" in feats._jdf.queryExecution().toString()
    by = {r.row_id: r for r in feats.collect()}
    assert by[2].idx == [64] and by[3].val == [1.0] and by[1].idx[-1] == 64 and abs(sum(v * v for v in by[1].val[:-1]) - 1) < 1e-12


def test_token_codes_number_each_token_of_a_slice_once(spark, monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(tokens, "SLICE_ROWS", 2)
    b = pa.RecordBatch.from_pydict({"t": pa.array([["x", "y", "x"], None, [], ["y"]])})
    got = [(list(row), names.to_pylist(), list(code)) for _, row, names, code in tokens.token_codes(b, "t")]
    assert got == [([0, 0, 0], ["x", "y"], [0, 1, 0]), ([1], ["y"], [0])]
