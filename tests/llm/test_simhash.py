import random

import numpy as np

from flowlens.llm import simhash as S


def brute(fps):
    """Component (smallest index) of each fingerprint by plain search."""
    comp = list(range(len(fps)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_golay_is_perfect_and_keys_meet():
    v = np.arange(1 << 23, dtype=np.uint32)[::977]
    assert len(np.unique(S._error_table())) == 2048
    rng = np.random.default_rng(1)
    for bits in (0, 1, 2):
        for _ in range(20):
            flips = rng.choice(23, bits, replace=False)
            w = v ^ np.uint32(sum(1 << int(f) for f in flips))
            a, b = S.fuzzy_keys(v), S.fuzzy_keys(w)
            assert all(set(x[x >= 0]) & set(y[y >= 0]) for x, y in zip(a[:200], b[:200]))


def test_links_match_brute_force(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for _ in range(rnd.randint(1, 5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    want = brute(fps)
    for bucket_max in (64, 2, 1):
        links = S.fingerprint_links(df, 2, bucket_max).collect()
        at = {f: i for i, f in enumerate(signed)}
        for r in links:
            assert bin((r.u ^ r.v) & ((1 << 64) - 1)).count("1") <= 2
        comp = list(range(len(fps)))

        def find(i):
            while comp[i] != i:
                i = comp[i]
            return i

        for r in links:
            a, b = find(at[r.u]), find(at[r.v])
            comp[max(a, b)] = min(a, b)
        assert [find(i) for i in range(len(fps))] == want


def test_edge_cases(spark):
    rows = [(5, "A b c d"), (3, "a B c d"), (9, None), (2, ""), (7, " \t\n"), (None, "a b c d"),
            (11, "one"), (12, "ONE"), (13, "x" * 50000 + " y" * 30000), (3, "a B c d"), (20, "é È b c")]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, component_id string, fp int")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[5] == comp[3] == comp[None] == 3
    assert comp[9] == comp[2] == comp[7] == 2 and comp[11] == comp[12] == 11 and comp[13] == 13
    assert {r.fingerprint for r in got if r.doc_id in (9, 2, 7)} == {"0" * 16}
    assert S.near_duplicates(df.limit(0)).count() == 0
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 3, 11, 13, 20]


def test_keep_one_of_repeated_ids(spark):
    rows = [(1, "b b b b", 1.5), (1, "a a a a", 2.5), (2, "c c c", 3.5), (2, "c c c", 4.5), (3, "C c\tc", None), (None, "c c c", 5.5)]
    df = spark.createDataFrame(rows, "doc_id int, text string, block double")
    # unrelated texts of one id both stay; the row without an id is a copy of document 2
    assert sorted(tuple(r) for r in S.keep_one(df).select("doc_id", "text").collect()) == [(1, "a a a a"), (1, "b b b b"), (2, "c c c")]
    assert S.keep_one(df).schema == df.schema and S.keep_one(df.limit(0)).count() == 0


def test_fingerprint_definition():
    import xxhash
    t = "The quick\tBROWN fox  jumps"
    w = t.lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(len(w) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert S.fingerprint(t) == want


def test_query_matches_brute_force(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    got = {r.doc_id: r for r in E.queries()["op10_simhash_near_dedup"](spark, SF_SMALL).collect()}
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    fps = [S.fingerprint(t) for _, t in docs]
    want = brute(fps)
    for (i, _), f, c in zip(docs, fps, want):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == docs[c][0]


def test_keep_one_takes_the_row_that_represents_the_group(spark):
    rows = [(3, "a copied text of words"), (5, "a copied text of words"), (5, "some other words that nobody else has")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, S.keep_one(df).collect())) == [rows[0], rows[2]]


def test_keep_one_without_ids_and_with_clashing_names(spark):
    texts = ["three words here and more", "quite another text is this", "the last one of all texts"]
    rows = [(5, t, "x", 1, 2) for t in texts] + [(None, texts[0], "n", 3, 4)] + [(None, f"no id {i // 2} but a text {i // 2}", "n", 5, 6) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _block string, _TEXT_HASH int, `a.b` int")
    got = S.keep_one(df)
    assert got.schema == df.schema
    got = got.collect()
    assert sorted(r.text for r in got if r.doc_id == 5) == sorted(texts)
    assert sorted(r.text for r in got if r.doc_id is None) == [f"no id {i} but a text {i}" for i in range(3)]
