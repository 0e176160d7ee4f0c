import base64
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID, SF_SMALL
from flowlens.llm import nn_descent, topk, url_filters as U, warc


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, first_id int")


# ---- WARC

def test_warc_round_trip(spark, tmp_path):
    rnd = random.Random(2)
    bodies = ["", "a", "é\r\n\r\nWARC/1.1\r\n", "<html>" + "x" * 200_000] + [str(rnd.random()) * 40 for _ in range(30)]
    rows = [(i, rnd.choice(["http://a/b c\n?", None, "x"]), rnd.choice(bodies)) for i in range(200)]
    rows += [(500, "u", None), (501, None, ""), (7, "dup", rows[7][2]), (7, "dup", rows[7][2]), (None, "n", "only null"),
             (None, "n", "only null"), (None, "n", rows[3][2])]
    for min_bytes in (0, 5):
        index = warc.write_archive(warc.judge(pages(spark, rows), min_bytes=min_bytes), f"file://{tmp_path}/a{min_bytes}",
                                   frame_bytes=3000, bundle_bytes=4000)
        got = warc.read_archive(index).collect()
        assert len(got) == len(rows) == index.count() == index.select("record_id").distinct().count()
        first = {}
        for i, _, b in rows:
            first.setdefault(b or "", []).append((i is None, i or 0))
        first = {b: (None if min(x)[0] else min(x)[1]) for b, x in first.items()}
        seen = {}
        for r in got:
            want = [b or "" for i, _, b in rows if i == r.page_id]
            by = {base64.b32encode(hashlib.sha1(b.encode()).digest()).decode(): b for b in want}
            body = by[r.payload_digest]
            assert r.payload_bytes == len(body.encode())
            if len(body.encode()) < min_bytes:
                assert r.record_type == "response" and r.refers_to is None
                continue
            seen.setdefault(body, []).append(r)
            if r.record_type == "response":
                assert r.payload.decode() == body and r.refers_to is None and r.page_id == first[body]
            else:
                assert r.record_type == "revisit" and r.refers_to == first[body] and r.payload is None
        assert all(sum(r.record_type == "response" for r in v) == 1 for v in seen.values())
        # one record through the index alone
        for r in index.limit(20).collect():
            head, _, _ = warc.parse_record(warc.open_bundle(r.bundle).frame(r.frame), r.offset)
            assert head["WARC-Record-ID"] == r.record_id
    assert warc.read_archive(warc.write_archive(warc.judge(pages(spark, rows).limit(0)), str(tmp_path / "none"))).count() == 0


def test_warc_query(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    first = {}
    for r in sorted(docs, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    got = {r.page_id: r for r in E.queries()["op7_warc"](spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for r in docs:
        b, f = (r.html or "").encode(), first[r.html or ""]
        assert tuple(got[r.page_id]) == (r.page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(),
                                         "response" if f == r.page_id else "revisit", None if f == r.page_id else f)


# ---- URL filters

RULES = [U.Rule("com", "/", "allow"), U.Rule("example.com", "/en/", "block"), U.Rule("www.example.com", "/en/", "allow"),
         U.Rule("net", "/es/", "block"), U.Rule("net", "/fr/", "block")]


def test_urls_match_sql_with_links(spark):
    rnd = random.Random(4)
    hosts = ["www.example.com", "a.example.com", "spam.net", "b.net", "c.org", "d.org", "e.org", "f.io", "examplecom", "xnet"]
    rows = [(i, f"HTTP://{rnd.choice(hosts).upper()}{rnd.choice(['', '/', '/en/x', '/es/y?z', '/fr/#t', '?q', '#f', '/En/x'])}",
             " ".join(f"<a {rnd.choice(['href=', 'HREF = '])}{rnd.choice(['\"', chr(39), ''])}{rnd.choice(['http://', 'https://', '//', '/'])}"
                      f"{rnd.choice(hosts + ['nowhere.io'])}/p\">" for _ in range(rnd.randint(0, 5)))) for i in range(300)]
    rows += [(700 + i, "http://evil.net/es/" + str(i), "<a href=//c.org/>") for i in range(12)]
    rows += [(720, "http://evil.net/", ""), (721, "http://fan.org/", "<a href='http://evil.net/'><a href='http://evil.net/'>")]
    rows += [(900, None, None), (901, "no scheme", "x"), (902, "://", None), (903, "http://", "<a href='//b.net'>"), (None, "http://b.net/es/", None),
             (904, "http://b.net/es/", None), (904, "http://b.net/es/", None), (905, "http://É.Com/\nq", "")]
    df = pages(spark, rows)
    got = U.judge_urls(df, RULES).collect()
    con = duckdb.connect()
    con.register("pages", df.select("page_id", "url", "html").toPandas().astype({"page_id": "Int64"}))
    want = con.execute(U.oracle(RULES)).fetchall()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)
    assert len({r.verdict for r in got if r.rule is None}) == 2 and any(r.trust for r in got if r.host.endswith("org"))
    at = {r.page_id: r for r in got}
    assert at[720].verdict == "block" and at[721].distrust > at[721].trust == 0
    assert (at[900].host, at[900].path, at[900].verdict) == ("", "", "allow") and at[901].host == "" and at[902].host == ""
    assert at[905].host == "É.com" and at[905].path == "/\nq" and at[905].rule == "com/"
    assert U.judge_urls(df.limit(0), RULES).count() == 0


def test_longest_rule(spark):
    urls = ["http://www.example.com/en/a", "http://x.example.com/en/a", "http://example.com/fr/", "http://a.net/es/", "http://a.net/en/",
            "http://com/", "http://com", "http://WWW.example.com/en"]
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge_urls(pages(spark, [(i, u, "") for i, u in enumerate(urls)]), RULES).collect()}
    assert [got[i][0] for i in range(8)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, "com/", None, "com/"]


# ---- top k

def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 6)).astype(np.float32)
    x[100:140] = x[7]
    rows = [(i * 5, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(9990, None), (9991, [1.0, None, 0.0, 0.0]), (9992, [float("nan")] * 6), (9993, [float("inf")] * 6),
             (None, [1.0] * 6), (50, rows[10][1]), (20000, [0.0] * 6), (9994, []), (9995, [1e30] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, rank int, shard int")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, shard_rows=100).collect()
    good = [(i, [int(np.floor(256 * np.float64(np.float32(v)))) for v in r]) for i, r in rows
            if i is not None and r is not None and all(v is not None and np.isfinite(v) for v in r)]
    want = []
    for at, (q, x) in enumerate(good):
        if q % 50 == 0:
            s = sorted(((-max(-2**63, min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), c) for n, (c, y) in enumerate(good) if n != at))[:5]
            want += [(q, n + 1, c, -v) for n, (v, c) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = topk.top_k(df.where("vec_id in (0, 5, 10)"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank) for r in few) == [(0, 1), (0, 2)]


def test_top_k_rows_of_one_id_both_rank(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [3.0]), (1, [2.0]), (1, [9.0]), (1, [9.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=3, scale=1.0, shard_rows=2).collect())
    assert got == sorted([(0, 1, 1, 9), (0, 2, 1, 9), (0, 3, 0, 3), (0, 1, 1, 27), (0, 2, 1, 27), (0, 3, 1, 6)])


# ---- embedding near-dedup

def brute_links(rows, threshold):
    """rows (id, vec, label) -> per row (n_links, component id)."""
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])
          for r in rows]
    unit = [np.array(r[1], np.float64) / np.linalg.norm(np.array(r[1], np.float64)) if o else None for r, o in zip(rows, ok)]
    n, comp = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            k = find(i)
            least[k] = min(least.get(k, r[0]), r[0])
    return [(n[i], least.get(find(i))) for i in range(len(rows))]


def test_links_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 40)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((120, 16))
    rows = []
    for i in range(900):
        v = base[rng.integers(120)] if i % 3 else base[3]
        rows.append((int(10_000 - 7 * i), (v + rng.standard_normal(16) * 0.07).astype(np.float32).tolist(), int(rng.integers(3)) if i % 4 else 1))
    rows += [(20_000 + i, rows[5][1], rows[5][2]) for i in range(60)]
    rows += [(30_000, None, 1), (30_001, rows[5][1], None), (30_002, [0.0] * 16, 1), (30_003, [float("nan")] * 16, 1),
             (30_004, [1.0, None] * 8, 1), (30_005, [], 1), (30_006, [1.0, 2.0], 1), (30_007, [1.0, 2.0], 1), (30_008, [-0.0, 1.0], 1),
             (30_009, [0.0, 1.0], 1), (None, [0.0, 1.0], 1), (30_010, [1e30, 1e30], 1), (30_010, [1e30, 1e30], 1), (30_011, [1e-30, 1e-30], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, node string, n int")
    got = nn_descent.near_duplicates(df).collect()
    want = brute_links(rows, 0.98)
    have = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in got)
    assert have == sorted((r[0] or -1, *w) for r, w in zip(rows, want))
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    assert nn_descent.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MID])
def test_embedding_query(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.queries()["op5_embedding_near_dedup"](spark, sf).collect()}
    want = {r[0]: w for r, w in zip(rows, brute_links(rows, 0.98))}
    assert got == want


def test_dense_group_across_blocks_is_one_component(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 100)
    monkeypatch.setattr(nn_descent, "AUDIT_NODES", 0)                # the audit mends nothing here
    rng = np.random.default_rng(11)
    centre = rng.standard_normal(64)
    rows = [(i, (centre + rng.standard_normal(64) * 0.001).tolist(), 1) for i in range(600)]
    got = nn_descent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(599, 0)}


def test_links_of_the_audit_are_kept(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "_start", lambda nodes, *a: nodes.sparkSession.createDataFrame([], nn_descent.PAIRS))
    rng = np.random.default_rng(12)
    base = rng.standard_normal((20, 8))
    rows = [(i, (base[i // 2] + rng.standard_normal(8) * 0.001).tolist(), i // 20) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = nn_descent.near_duplicates(df, recall=0.0, attempts=1).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (1, i - i % 2) for i in range(40)}
    with pytest.raises(RuntimeError):
        nn_descent.near_duplicates(df, attempts=1)


def test_audit_counts_small_groups_of_each_label(spark):
    rng = np.random.default_rng(13)
    hot, cold = rng.standard_normal(8), rng.standard_normal((5, 8))
    unit = lambda x: (x / np.linalg.norm(x)).tobytes()
    rows = [(i, "hot", 8, unit(hot + rng.standard_normal(8) * 0.001)) for i in range(300)]
    rows += [(1000 + i, "cold", 8, unit(cold[i // 2] + rng.standard_normal(8) * 0.001)) for i in range(10)]
    nodes = spark.createDataFrame(rows, "node long, label string, dim int, unit binary")
    comp = spark.createDataFrame([(i, 0) for i in range(300)], "node long, root long")     # no pair of the cold label is found
    found, missing = nn_descent._audit(nodes, comp, 0.98, 0)
    assert found == 0
    assert {tuple(sorted(r)) for r in missing.collect()} == {(1000 + i, 1001 + i) for i in range(0, 10, 2)}


@pytest.mark.parametrize("others", [10, 12_000])
def test_audit_sees_a_hot_label_beside_many_small_ones(spark, others):
    rng = np.random.default_rng(14)
    pairs = rng.standard_normal((1500, 8))
    unit = lambda x: (x / np.linalg.norm(x)).tobytes()
    rows = [(i, "hot", 8, unit(pairs[i // 2] + rng.standard_normal(8) * 0.0001)) for i in range(3000)]
    rows += [(10_000 + i, f"small {i}", 8, unit(rng.standard_normal(8))) for i in range(others)]
    nodes = spark.createDataFrame(rows, "node long, label string, dim int, unit binary")
    nothing = spark.createDataFrame([], "node long, root long")
    for attempt in range(2):
        found, missing = nn_descent._audit(nodes, nothing, 0.999, attempt)
        assert found < 0.05 and 200 <= missing.count()


def test_small_labels_of_a_large_table_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "AUDIT_NODES", 0)                # the audit mends nothing here
    rng = np.random.default_rng(14)
    rows = [(10_000 + i, rng.standard_normal(16).tolist(), "hot") for i in range(3000)]
    for i in range(80):
        a, b = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
        rows += [(2 * i, a.tolist(), f"cold {i}"), (2 * i + 1, (a + 0.6 * b).tolist(), f"cold {i}")]       # cosine 0.857
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_duplicates(df, threshold=0.85).collect()}
    assert {i: got[i] for i in range(160)} == {i: (1, i - i % 2) for i in range(160)}
