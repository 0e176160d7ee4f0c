import math
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from conftest import SF_MID, SF_SMALL
from flowlens.llm import language_id, lm_score, simhash, substring_dedup
from flowlens.llm.catalog import tokenizer_file
from test_substring import brute as brute_repeats
from test_tokens import verify_pieces


def brute_cost(texts, order=3, alpha=0.4, unit=1000):
    docs = [(t or "").encode().split() for t in texts]
    count = lambda d: Counter(tuple(d[i:i + n]) for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total = sum((count(d) for d in docs), Counter())
    words = sum(map(len, docs))
    out = []
    for d in docs:
        own, cost = count(d), 0
        rest = lambda g: total[g] - own[g]  # noqa: E731, B023
        n = max(1, words - len(d))
        for i in range(len(d)):
            for k in range(min(order, i + 1), 0, -1):
                g = tuple(d[i - k + 1:i + 1])
                context = rest(g[:-1]) if k > 1 else n
                if rest(g) > 0 and context > 0:
                    s = rest(g) / context * alpha ** (order - k)
                    break
            else:
                s = alpha / n * alpha ** (order - 1)
            cost += math.floor(-math.log2(s) * unit + 0.5)
        out.append((len(d), cost))
    return out


def test_scores_match_brute_force(spark):
    texts = [None, "", " \n", "a b c a b c", "a b d", "x", "a b c a b c", "z " * 3000, "q"] + [
        " ".join("abcdefgh"[(i * j * j + j) % 8] for j in range(i)) for i in range(40)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, cost string, block int")
    for block_bytes in (1 << 20, 300):
        got = {r.doc_id: r for r in lm_score.score_documents(df, block_bytes=block_bytes).collect()}
        for i, (n, cost) in enumerate(brute_cost(texts)):
            assert (got[i].n_words, got[i].cost) == (n, cost), texts[i]
            assert (got[i].score is None) == (n == 0)
    assert lm_score.score_documents(df.limit(0)).count() == 0
    two = df.where("doc_id = 3").selectExpr("cast(null as long) doc_id", "text")
    assert [r.n_words for r in lm_score.score_documents(two.union(two)).collect()] == [6, 6]


def test_scores_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    got = {r.doc_id: r for r in E.queries()["op3_lm_scoring"](spark, SF_SMALL).collect()}
    assert {r.doc_id: (got[r.doc_id].n_words, got[r.doc_id].cost) for r in docs} == {
        r.doc_id: w for r, w in zip(docs, brute_cost([r.text for r in docs]))}


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out(docs.doc_id)))
    rows = {r.doc_id: r.text for r in docs.collect()}
    scores = language_id.score_texts(model, [rows[i] or " " for i in rows])
    kept = [i for i, s in zip(rows, scores) if rows[i] is not None
            and (s.max(initial=0) >= 0.1 or len(rows[i]) < 32)]
    assert len(kept) >= 0.99 * len(rows)
    fps = {i: simhash.fingerprint(rows[i]) for i in kept}
    from test_simhash import brute as brute_components
    order = sorted(kept)
    comp = brute_components([fps[i] for i in order])
    kept = [i for i, c in zip(order, comp) if order[c] == i]
    raw = brute_repeats([(i, rows[i]) for i in kept], 100)
    stage3 = corpus_pipeline.suffix_array_stage(spark, docs.where(docs.doc_id.isin(kept)), SF_SMALL)
    assert stage3.columns == docs.columns
    texts = {r.doc_id: r.text for r in stage3.collect()}
    for n, i in enumerate(kept):
        size, removed = raw[n][:2]
        left = len(texts[i].encode())
        assert size - removed - 6 * raw[n][2] <= left <= size - removed
    t = Tokenizer.from_buffer(tokenizer_file("byte_bpe_50k.json"))
    want = {i: t.encode(texts[i], add_special_tokens=False).ids + [0] for i in kept}
    got = [r.asDict() for r in corpus_pipeline.run(spark, SF_SMALL).collect()]
    assert verify_pieces(got, want) < 0.02
    assert all(np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]][r["start"]:r["start"] + r["length"]] for r in got)


def test_stages_on_odd_rows(spark):
    base = spark.read.parquet(f"{SF_MID}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "!!!", None, None, 3),
                                 (None, "the of and " * 30, "en", "s", 1)], base.schema)
    docs = base.unionByName(odd).withColumn("block", base.n_chars).withColumn("rest", base.lang).withColumn("score", base.lang)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_MID)
        assert out.columns == docs.columns and out.schema == docs.schema, name
        assert stage(spark, docs.limit(0), SF_MID).count() == 0
        n = out.count()
        assert 0 < n <= docs.count()
        if name.startswith("suffix"):
            assert n == docs.count()
    cut = substring_dedup.cut_repeats(spark.createDataFrame([(1, "é" * 200), (2, "é" * 200 + "ü"), (3, None)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in cut.collect()}
    # the last window of the second text ends within ü, whose first byte is that of é
    assert texts[3] is None and texts[2] == "" and texts[1] == "é"


def test_stages_keep_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for name in ("_block", "_null", "_text", "_lang_pred", "_Score", "lang_pred", "SCORE", "rest", "whole", "mark", "c0", "a.b"):
        docs = docs.withColumn(name, docs.lang)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.schema == docs.schema, name
        assert out.where("not (`a.b` <=> lang) or not (_null <=> lang) or not (SCORE <=> lang) or not (_Score <=> lang)").count() == 0
        assert 0 < out.count() <= docs.count()
