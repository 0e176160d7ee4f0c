"""Periodic runs: against brute force on random words, odd rows, the query's digests."""

import hashlib
import random
import zlib

import numpy as np

from flowlens.llm.catalog import QUERIES, repeated_tail
from flowlens.llm.periodic_runs import collapse_runs, find_runs, kept_words, least_lcp, suffix_order, with_digests


def brute_runs(w, min_length, min_exponent):
    n, out = len(w), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    out = [r for r in out if r[1] >= max(min_length, min_exponent * r[2])]
    covered = [r for r in out if any(q < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, q in out)]
    return sorted((r for r in out if r not in covered), key=lambda r: (r[0], r[2]))


def random_words(rng):
    w = []
    for _ in range(rng.randint(0, 4)):
        top = rng.choice([1, 2, 5])
        base = [rng.randint(0, top) for _ in range(rng.randint(1, 9))]
        w += (base * rng.randint(1, 12))[:rng.randint(0, 60)]
    return w


def test_runs_match_brute_force():
    rng = random.Random(1)
    for _ in range(600):
        limits = rng.choice([(24, 3), (4, 2), (6, 3), (2, 2), (9, 4)])
        docs = [random_words(rng) for _ in range(rng.randint(1, 4))]
        assert find_runs([np.array(d, np.int64) for d in docs], *limits) == [brute_runs(d, *limits) for d in docs]


def test_suffix_order_and_lcp():
    rng = random.Random(2)
    docs = [[rng.randint(0, 2) for _ in range(rng.randint(0, 40))] for _ in range(5)]
    begin = np.cumsum([0] + [len(d) for d in docs])
    order, lcp = suffix_order(np.array(sum(docs, []), np.int64), begin)
    place = [(d, i) for d, w in enumerate(docs) for i in range(len(w))]
    got = [place[x] for x in order.tolist()]
    assert got == sorted(place, key=lambda p: (p[0], docs[p[0]][p[1]:]))
    for (d, i), (e, j), n in zip(got, got[1:], lcp.tolist()):
        a, b = docs[d][i:], docs[e][j:]
        common = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == (common if d == e else 0)


def test_limits():
    assert least_lcp(24, 3) == 16 and least_lcp(2, 2) == 1
    assert kept_words(6, [(0, 6, 2)]).tolist() == [0, 1]
    assert find_runs([], 24, 3) == [] and find_runs([np.zeros(0, np.int64)], 24, 3) == [[]]


def test_very_long_run():
    w = np.tile(np.arange(3), 20_000)
    assert find_runs([w, np.zeros(30_000, np.int64)], 24, 3) == [[(0, 60_000, 3)], [(0, 30_000, 1)]]


def test_rows(spark):
    run = " ".join(["a b"] * 15)
    rows = [(1, run, "x"), (1, run, "x"), (None, "z\t" * 30, "y"), (2, None, None), (3, "", "y"), (4, " \n ", "y"),
            (5, "q " + run + " b end", None), (6, "one two", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in collapse_runs(df).collect()), key=str)
    assert got == sorted([(1, 30, [(0, 30, 2)], "a b")] * 2 + [(None, 30, [(0, 30, 1)], "z"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
                         (5, 33, [(1, 30, 2)], "q a b b end"), (6, 2, [], "one two")], key=str)
    assert collapse_runs(df.limit(0)).count() == 0
    small = sorted(map(str, collapse_runs(df, slice_bytes=1).collect()))
    assert small == sorted(map(str, collapse_runs(df).collect()))


def test_digests_order_runs_exactly(spark):
    df = spark.createDataFrame([(1, [(0, 30, 10), (40, 24, 8), (90, 25, 8)]), (2, [(9, 24, 8), (3, 27, 9), (3, 24, 8)]), (3, [])],
                               "doc_id long, runs array<struct<start: long, length: long, period: long>>").selectExpr("*", "0L as n_words", "'' as collapsed")
    got = {r.doc_id: tuple(r)[1:7] for r in with_digests(df).collect()}
    text = "0,30,10\n40,24,8\n90,25,8\n"
    assert got[1] == (3, 90, 25, 8, 3125, hashlib.sha256(text.encode()).hexdigest())
    assert got[2][:5] == (3, 3, 24, 8, 3000)
    assert got[3] == (0, None, None, None, None, hashlib.sha256(b"").hexdigest())


def test_query_matches_brute_force(spark, sf_dir="/root/testdata/sf0.001"):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    hits = 0
    for doc_id, text in rows:
        w = (text or "").encode().split()
        plan = repeated_tail(doc_id, len(w))
        assert (plan is not None) == (zlib.crc32(str(doc_id).encode()) % 10 == 0 and len(w) > 0)
        if plan:
            w = [x if i < plan[0] else w[plan[0] + (i - plan[0]) % plan[1]] for i, x in enumerate(w)]
        if len(w) > 1500:
            continue
        runs = brute_runs(w, 24, 3)
        drop = {i for s, n, q in runs for i in range(s + q, s + n)}
        r = got[doc_id]
        hits += len(runs)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in drop)).hexdigest()
    assert hits > 5
