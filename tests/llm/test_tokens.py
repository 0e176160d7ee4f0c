import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowlens.llm import packing, sentencepiece_codec as C

SP = open(P.path("piece_bpe_32k.model"), "rb").read()
BPE = open(P.path("byte_bpe_50k.json"), "rb").read()
ODD = [None, "", " ", "  ", "a", " a", "a ", "  a  b   ", "▁x▁▁", "tab\there\n\n new\r\n  x \n", "\x1c\x1d a \x85 b",
       "　x y   z", "don't  stop's <|endoftext|> <|endoftext|>x </s> <s>", "\U0001f600́ ก​", "12 345\t6,7.8", "x" * 3000 + " " * 50,
       "\x00 \x01", "﻿ �", "The end. Next! Why? \"Yes.\" (No.)"]


def random_texts(n, seed):
    rnd = random.Random(seed)
    alphabet = "ab eé▁ \n\t.,'s1あ\U0001f600 <|>  "
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, block int")


def test_sentencepiece_matches_library(spark):
    texts = ODD + random_texts(300, 5)
    sp = sentencepiece.SentencePieceProcessor(model_proto=SP)
    got = {r.doc_id: r for r in C.encode_documents(frame(spark, texts), SP, block_bytes=500).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = sp.encode(t or "", add_bos=False, add_eos=True)
        assert got[i].ids == " ".join(map(str, ids)), repr(t)
        assert got[i].n_tokens == len(ids) and got[i].decoded == sp.decode(ids), repr(t)
    assert C.encode_documents(frame(spark, texts).limit(0), SP).count() == 0
    twice = frame(spark, ["a b"]).selectExpr("null as doc_id", "text")
    assert [r.n_tokens for r in C.encode_documents(twice.union(twice), SP).collect()] == [3, 3]


def test_text_tokenizer_matches_library():
    t = Tokenizer.from_buffer(BPE)
    tok = packing.TextTokenizer(BPE, 0)
    assert tok.ranks is not None
    for text in ODD + random_texts(3000, 7):
        assert tok.encode(text).tolist() == t.encode(text or "", add_special_tokens=False).ids + [0], repr(text)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][::7]
    texts = [f"a{chr(c)}b 1{chr(c)}2 {chr(c)} .{chr(c)}! {chr(c)}{chr(c)}" for c in points]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert tok.encode(text).tolist()[:-1] == e.ids, repr(text)
    other = open(P.path("word_bpe_49k.json"), "rb").read()
    tok = packing.TextTokenizer(other, 0)
    assert tok.ranks is None
    assert tok.encode("Hello wörld").tolist() == Tokenizer.from_buffer(other).encode("Hello wörld", add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_optimal(seed):
    rng = np.random.default_rng(seed)
    points = np.concatenate([[0], np.cumsum(rng.integers(1, 20, 120))])
    pen = rng.integers(0, 5, len(points))
    cuts = packing.choose_cuts(points, pen, 64, 4)
    best = [0] + [10**9] * (len(points) - 1)
    pad = lambda n: 0 if n in (32, 64) else 64 - n
    for j in range(1, len(points)):
        for i in range(j):
            n = points[j] - points[i]
            if n <= 64:
                best[j] = min(best[j], best[i] + pad(n) + pen[j] + 4)
    at = dict(zip(points.tolist(), pen.tolist()))
    assert sum(pad(b - a) + at[b] + 4 for a, b in zip([0] + cuts, cuts)) == best[-1]
    assert cuts[-1] == points[-1] and set(cuts) <= set(points.tolist())


def verify_pieces(rows, want, max_len=1024):
    """Every id in exactly one piece, sequences gapless from 0 and within max_len; returns padding share."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert set(docs) == set(want)
    for d, ps in docs.items():
        at = 0
        for r in sorted(ps, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(want[d]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(want[d][at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(want[d])
    tokens = pad = 0
    for ps in seqs.values():
        at = 0
        for r in sorted(ps, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= max_len
        tokens += at
        pad += 0 if at & (at - 1) == 0 else max_len - at
    return pad / max(1, tokens)


def test_packing_query(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    t = Tokenizer.from_buffer(BPE)
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0]
            for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = [r.asDict() for r in E.queries()["op9_packing"](spark, SF_SMALL).collect()]
    assert verify_pieces(rows, want) < 0.02


def test_packing_odd_documents(spark):
    texts = ODD + ["word " * 30000, "z" * 20000] + random_texts(200, 9)
    t = Tokenizer.from_buffer(BPE)
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(texts)}
    df = packing.pack(frame(spark, texts), BPE, run_tokens=5000)
    rows = [dict(r.asDict(), length=len(r.ids) // 4, ids_crc32=zlib.crc32(r.ids)) for r in df.collect()]
    verify_pieces(rows, want)
    assert packing.pack(frame(spark, texts).limit(0), BPE).count() == 0
    one = frame(spark, ["a"]).selectExpr("cast(null as long) doc_id", "text")
    assert packing.pack(one.union(one), BPE).count() == 2


def test_sentencepiece_query(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    sp = sentencepiece.SentencePieceProcessor(model_proto=SP)
    got = {r.doc_id: r for r in E.queries()["op1_sentencepiece"](spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = sp.encode(r.text or "", add_eos=True)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert got[r.doc_id].n_tokens == len(ids)


def test_long_runs_of_white_space():
    t = Tokenizer.from_buffer(BPE)
    tok = packing.TextTokenizer(BPE, 0)
    for text in ("a" + " " * 2_000_000 + "b", "a" + "\n" * 2_000_000 + "b", "a" + " \n" * 300_000 + "b", " " * 99_999 + "b"):
        assert tok.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids + [0]
