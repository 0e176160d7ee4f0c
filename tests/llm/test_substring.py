import hashlib
import random

import numpy as np
import pytest

from flowlens.llm import substring_dedup as D
from flowlens.llm.suffix_array import permuted_lcp, suffix_array


def naive_sa(b):
    return sorted(range(len(b)), key=lambda i: b[i:])


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array_and_lcp(seed):
    rnd = random.Random(seed)
    k = rnd.choice([1, 2, 3, 5, 256])
    b = bytes(rnd.randrange(k) + (0 if k == 256 else 97) for _ in range(rnd.choice([0, 1, 2, 7, 50, 400])))
    if seed % 3 == 0:
        b = b * 3
    t = np.frombuffer(b, np.uint8)
    sa = suffix_array(t)
    assert sa.tolist() == naive_sa(b)
    lcp = permuted_lcp(t, sa)
    for x, y in zip(sa[:-1].tolist(), sa[1:].tolist()):
        n = 0
        while max(x, y) + n < len(b) and b[x + n] == b[y + n]:
            n += 1
        assert lcp[y] == n


def brute(rows, length):
    """rows (id, text) -> per row index the kept bytes, removed count and spans."""
    raw = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, len(raw[i]), raw[i]))
    seen, out = set(), {}
    for i in order:
        b, mark = raw[i], bytearray(len(raw[i]))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                mark[s:s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for p in range(len(b)) if mark[p] and (p == 0 or not mark[p - 1]))
        out[i] = (len(b), sum(mark), spans, hashlib.sha256(bytes(x for x, m in zip(b, mark) if not m)).hexdigest())
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, block int, spans string")
    got = D.remove_repeats(df, **kw).collect()
    want = brute(rows, kw["length"])
    have = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest())
                  for r in got)
    assert have == sorted((rows[i][0] is None, rows[i][0] or 0, *w) for i, w in want.items())


def passages(seed, n):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß ") for _ in range(rnd.randint(1, 9))) for _ in range(400)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    shared, lines = [text(30) for _ in range(4)], [text(6) for _ in range(2)]
    rows = [(None, shared[0] + text(3)), (None, shared[0] + text(3)), (5, None), (6, ""), (7, "a" * 700), (8, "a" * 450),
            (9, "xyz" * 300), (9, "xyz" * 300), (9, shared[1])]
    for i in range(n):
        t = text(rnd.randint(1, 80))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(shared + lines)
            a = rnd.randint(0, len(p) // 2)
            t += " " + p[a:] + text(rnd.randint(0, 4))
        rows.append((100 + 7 * i % 997, t))
        if rnd.random() < 0.2:
            rows.append((2000 + i, t))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [2000, 3])
def test_matches_brute_force(spark, hot):
    rows = passages(hot, 150)
    check(spark, rows, length=100, block_bytes=20_000, hot_contexts=hot)
    check(spark, rows[:60], length=30, gram=12, block_bytes=3_000, hot_contexts=hot)


def test_small_batches(spark, monkeypatch):
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    monkeypatch.setattr(D, "CHUNK_BYTES", 700)
    rows = passages(11, 60)
    blocks = D.Block([i for i, _ in rows], [t for _, t in rows])
    pos, *_ = D.anchors(blocks.data, blocks.bounds, 100, 40)
    assert len(pos) and (np.diff(pos) > 0).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert D.remove_repeats(df).count() == 0
    check(spark, [(1, None), (2, ""), (3, "short")], length=100)


def test_query_matches_brute_force(spark):
    import __spark_entry__ as E
    from conftest import SF_SMALL
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = {rows[i][0]: w for i, w in brute(rows, 100).items()}
    got = E.queries()["op4_suffix_array_dedup"](spark, SF_SMALL).collect()
    assert len(got) == len(rows) and sum(w[1] for w in want.values()) > 0
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
