"""Token counts: against the library on every text, long texts spread over tasks, odd rows."""

import os
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowlens.llm.catalog import QUERIES, tokenizer_file
from flowlens.llm.token_counts import TokenCounter, byte_slices, count_tokens, cut_at_space, parts_at_space

MODEL = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tok():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(public_tokenizers.path(MODEL))


def counts(tok, texts):
    return [len(e.ids) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


ODD = ["", " ", "\n\t \r\x0b\x0c", "a", "Hello  World", "it's we'll 'S", "x<|endoftext|>y <|startoftext|>", "<|endof text|>",
       "é é ́a Å İ ß ﬁ", "nb sp em sp   \u0085 \x1c\x1d z", "1234 a1b2 9'9 ''' 's's", "日本語。日本、語！漢字", "🙂🙂 a‍b",
       "﻿x", "\x00\x01 \x7f", "ΣΑΣ ς", "..." * 50, "́́ ́"]


def test_odd_texts_match_the_library(tok):
    assert TokenCounter(tokenizer_file(MODEL)).count([t.encode() for t in ODD]) == counts(tok, ODD)
    assert TokenCounter(tokenizer_file(MODEL), long_word=3).count([t.encode() for t in ODD]) == counts(tok, ODD)


def test_every_code_point_and_random_mixes(tok):
    rng = random.Random(3)
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(points[i:i + 50]) for i in range(0, len(points), 50)]
    parts = [*" \t\n'.!0179abszAÉ́。、漢語", "<|endoftext|>", "'s", "'ll", "  "]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 60))) for _ in range(3000)]
    for limit in (64 << 10, 5):
        assert TokenCounter(tokenizer_file(MODEL), long_word=limit).count([t.encode() for t in texts]) == counts(tok, texts)


def test_cache_is_cleared_and_long_words_are_cut(tok):
    c = TokenCounter(tokenizer_file(MODEL), cache_words=10, long_word=100)
    long = ["7a" * 5000, "b" * 5000, "漢。" * 2000 + "字", "<|endoftext|>1" * 500, "9" * 3000]
    for _ in range(3):
        assert c.count([t.encode() for t in long + ODD]) == counts(tok, long + ODD)
    assert len(c.known) < 200


def test_slices_and_cuts():
    import numpy as np
    assert list(byte_slices(np.array([3, 3, 3, 50, 1]), 5)) == [(0, 2), (2, 4), (4, 5)]
    assert list(byte_slices(np.array([0, 0]), 5)) == [(0, 2)]
    text = b"aaa bbb\ncccccccccccc  dd "
    parts = list(cut_at_space(text, 5))
    assert b"".join(parts) == text and len(parts) == 3 and all(p[:1].isspace() for p in parts[1:])


def test_only_files_that_drop_space_are_cut():
    import json
    assert parts_at_space(json.loads(tokenizer_file(MODEL)))
    assert not parts_at_space(json.loads(tokenizer_file("byte_bpe_50k.json")))


def test_rows(spark, tok):
    texts = ODD + [None, "a " * 5000, "same", "same"]
    ids = [*range(len(ODD)), None, 77, 5, 5]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in zip(ids, texts)], "doc_id long, text string, n_tokens string, row int")
    for spread in (8 << 20, 40):        # 40: long texts go in parts over the tasks
        got = count_tokens(df, tokenizer_file(MODEL), spread_bytes=spread, part_bytes=16)
        assert got.columns == ["doc_id", "n_bytes", "n_tokens"]
        want = sorted((str(i), len((t or "").encode()), n) for i, t, n in zip(ids, texts, counts(tok, texts)))
        assert sorted((str(r[0]), r[1], r[2]) for r in got.collect()) == want
    assert count_tokens(df.limit(0), tokenizer_file(MODEL)).count() == 0
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = count_tokens(df, tokenizer_file("byte_bpe_50k.json"), spread_bytes=40).collect()
    assert sorted((str(r[0]), r[2]) for r in got) == sorted((str(i), n) for i, n in zip(ids, counts(other, texts)))


def test_query_matches_the_library(spark, tok, sf_dir="/root/testdata/sf0.001"):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {r[0]: n for r, n in zip(rows, counts(tok, [r[1] for r in rows]))}
    got = QUERIES["op11_token_counts"](spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")]
    got = got.collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(rows)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert {r.doc_id: r.n_bytes for r in got} == {r[0]: len((r[1] or "").encode()) for r in rows}
