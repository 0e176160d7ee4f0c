"""Collocations: against brute force with good and with bad samples, small filters, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import collocations as C

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, support, max_words, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = (text or "").encode()
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in low).decode()
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, max_words + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    cand = {p: c for p, c in f.items() if len(p[1]) > 1 and c >= support}
    out = []
    for (lang, p), a in cand.items():
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        inside = any(q[0] == lang and len(q[1]) > len(p) and c >= a and any(q[1][i:i + len(p)] == p for i in range(len(q[1]) - len(p) + 1))
                     for q, c in cand.items())
        if not inside:
            score, _, l, r = min(cuts)
            out.append((lang, " ".join(p), a, l, r, n[lang], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    rank, got = Counter(), []
    for lang, phrase, a, l, r, m, score in out:
        rank[lang] += 1
        if rank[lang] <= top:
            got.append((lang, rank[lang], phrase, a, l, r, m, score))
    return got


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["a", "B", "the", "Of", "ß", "É", "x y z", "new york city", "to be or not to be", " ", "q\tq"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(rng.randint(0, 80)))
        rows.append((rng.choice(["en", "en", "de", None]), text))
    return rows + [("en", None), ("en", ""), (None, " .,"), ("xx", "one.")]


def result(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("rate,miss,bits", [(0.25, 1e-6, 20), (0.02, 0.99, 20), (0.9, 0.99, 6), (1e-9, 0.99, 16)])
def test_matches_brute_force_whatever_the_sample(spark, rate, miss, bits):
    rows = corpus(5)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    want = sorted(brute(rows, 6, 5, 40))
    assert len(want) > 60
    assert result(C.mine(df, support=6, top=40, rate=rate, miss=miss, filter_bits=bits, chunk_bytes=2000)) == want


def test_bad_samples_lead_to_a_further_pass(spark):
    rows = corpus(6)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").withColumn("lang", F.coalesce("lang", F.lit("und")))
    want = {}
    for rate, passes in ((1.0, 1), (1e-9, 2)):
        miner = C.Miner(df.select("doc_id", "lang", "text"), 6, 5, rate, 1e-6, 20, 5000)
        want[rate] = sorted(map(tuple, miner.frequent().collect()))
        assert miner.passes == passes
    assert want[1.0] == want[1e-9]


def test_other_lengths(spark):
    rows = corpus(7)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string")
    for max_words in (2, 3):
        assert result(C.mine(df, support=5, max_words=max_words, top=2000, filter_bits=16)) == sorted(brute(rows, 5, max_words, 2000))


def test_lowered_support_and_hashes():
    assert C.lowered_support(100, 1.0, 1e-6) == 100 and C.lowered_support(100, 1e-9, 1e-6) == 1
    t = C.lowered_support(100, 0.25, 1e-6)
    draws = np.random.default_rng(1).binomial(100, 0.25, 1_000_000)
    assert 5 <= t <= 9 and (draws < t).mean() <= 1e-5
    chunk = C.Chunk(iter([b"a b c"]), "en")
    at, cls, h = chunk.first_level()
    h = C.lengthened(C.lengthened(h[:1], chunk.word_hash[1:2]), chunk.word_hash[2:3])
    assert int(h[0]) == C.phrase_hash("a b c", "en") != C.phrase_hash("a b c", "de")


def test_long_texts_are_cut_at_piece_ends():
    folded = C.pieces_of("One two. Three,four! " * 50)
    parts = C._cut(folded, 100)
    assert len(parts) > 5 and C.BREAK.join(parts) == folded
    assert C._cut(b"x" * 500, 100) == [b"x" * 500]
    half = C.draw_pieces(folded, 0.5, 7)
    assert half == C.draw_pieces(folded, 0.5, 7) and 0 < len(half) < len(folded)


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, "en", "a b. " * 7, "x", 1), (None, "en", "a b. " * 7, "x", 1), (3, None, "c d e " * 5, "y", 2)],
                               "doc_id long, lang string, text string, phrase string, _rank int")
    assert result(C.mine(df, support=5, filter_bits=16)) == sorted(brute([("en", "a b. " * 14), (None, "c d e " * 5)], 5, 5, 2000))
    empty = C.mine(df.limit(0), filter_bits=16)
    assert empty.columns == COLUMNS and empty.count() == 0
    assert C.mine(df.where("doc_id = 3"), support=1000, filter_bits=16).count() == 0


def test_types(spark, sf_dir="/root/testdata/sf0.001"):
    from flowlens.llm.catalog import QUERIES
    got = QUERIES["op13_collocations"](spark, sf_dir)
    assert [(c, t) for c, t in got.dtypes] == [(c, "string" if c in ("lang", "phrase") else "bigint") for c in COLUMNS]
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("lang", "text").collect()
    assert result(got) == sorted(brute(rows, 100, 5, 2000))
