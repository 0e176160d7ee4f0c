"""Python-style float text, serialisation, token windows."""

import random

import pytest

from flowlens.functions.text import nested_row_to_text, py_str_frame, row_to_text, values_to_text
from flowlens.operators.tokens import build_vocab, token_budget, token_window


def test_py_str_matches_python_repr(spark):
    rnd = random.Random(5)
    vals = [0.1, 5.0, 1e7, 1e-5, 1.5e16, -0.0005, 123456789.5, 1e22, 2.5e-7, 0.0]
    vals += [rnd.uniform(-1e9, 1e9) for _ in range(50)] + [10 ** rnd.uniform(-8, 18) for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in py_str_frame(df, ["x"], "t_").select("t_x").collect()]
    assert got == [repr(v) for v in vals]


def test_row_and_values_text(spark):
    df = spark.createDataFrame([(1, "tcp", 2.0, None, 1)], "a long, b string, c double, d double, label int")
    assert row_to_text(df, ["a", "b", "c", "d"]).first()["text"] == "a: 1, b: tcp, c: 2.0, d: nan"
    assert values_to_text(df, ["a", "b", "c"]).first()["text"] == "1, tcp, 2.0"
    assert nested_row_to_text(df, ["a", "b"]).first()["text"] == "a: 1, b: tcp, text: 1, tcp"


def test_token_window_pads_and_truncates(spark):
    df = spark.createDataFrame([(1, "a b, c"), (2, " ".join(["w"] * 20)), (3, "")], "row_id long, text string")
    vocab = build_vocab(df, "text")
    out = {r.row_id: r for r in token_window(df, "text", vocab, "row_id", 8).collect()}
    assert out[1].n_tokens == 4 and out[1].attention_mask == [1, 1, 1, 1, 0, 0, 0, 0]
    assert out[2].n_tokens == 20 and len(out[2].input_ids) == 8 and out[2].attention_mask == [1] * 8
    assert out[3].input_ids == [0] * 8
    b = token_budget(df, "text", 8).first()
    assert (b.n_rows, b.n_over, b.tokens_total, b.tokens_lost) == (3, 1, 24, 12)
    assert pytest is not None


def test_text_nb_large_model_path_matches_broadcast(spark, monkeypatch):
    """A model over the broadcast limit goes through the hot-token split (hot tokens from a
    bounded broadcast, the rest by shuffle); predictions equal the all-broadcast path."""
    from flowlens.operators import skew as SK
    from flowlens.operators import textmodel as TM
    rnd = random.Random(4)
    words = ["the"] * 30 + ["a"] * 10 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 25))), i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, text string, label int")
    train, test = df.where("row_id % 5 != 0"), df.where("row_id % 5 = 0")
    base = sorted(tuple(r) for r in TM.text_classifier(train, test).collect())
    monkeypatch.setattr(TM, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(SK, "HOT_ROWS", 10)
    monkeypatch.setattr(SK, "MAX_HOT_KEYS", 1000)
    forced = sorted(tuple(r) for r in TM.text_classifier(train, test).collect())
    assert len(forced) == len(base) == 24
    for a, b in zip(forced, base):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], abs=1e-9)


def test_token_window_large_vocab_path_matches_broadcast(spark, monkeypatch):
    """A vocabulary over the broadcast limit: hot tokens from a bounded broadcast, the rest
    by shuffle; ids equal the broadcast path, unknown tokens still map to 1."""
    from flowlens.operators import skew as SK
    from flowlens.operators import tokens as TK
    rnd = random.Random(6)
    words = [","] * 40 + ["the"] * 20 + [f"w{i}" for i in range(50)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for i in range(80)]
    df = spark.createDataFrame(rows, "row_id long, text string")
    vocab = build_vocab(df.where("row_id < 60"), "text")
    base = sorted((r.row_id, r.n_tokens, tuple(r.input_ids)) for r in token_window(df, "text", vocab, max_length=16).collect())
    monkeypatch.setattr(TK, "BROADCAST_LIMIT", 3)
    monkeypatch.setattr(SK, "HOT_ROWS", 20)
    monkeypatch.setattr(SK, "MAX_HOT_KEYS", 1000)
    forced = sorted((r.row_id, r.n_tokens, tuple(r.input_ids)) for r in token_window(df, "text", vocab, max_length=16).collect())
    assert forced == base and len(base) == 80
