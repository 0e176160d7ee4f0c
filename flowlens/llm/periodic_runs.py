"""Periodic runs of words, found by uniting suffix classes in order of falling LCP.

Per document: its words are numbered; suffixes are sorted (by doubling, in numpy, many documents at
once) and neighbours in that order get their longest common prefix. Kruskal's order then unites
classes of suffixes by falling LCP, each class with its ordered set of positions. When a union at
LCP l makes positions i < j neighbours in such a set, the words from i to j + l have period j - i;
with j - i <= l no smaller one (it would have made a position between them a neighbour earlier).
Each run is seeded in this way by its first position, so seeds that could be extended to the
left are passed over.

A run of length L and period q needs an LCP of L - q, so only LCPs of ``least_lcp`` words matter
(16 for runs of 24 words and exponent 3). Windows of so many words are hashed first; documents
without two equal ones have no run and go no further. The hash only picks documents.

Documents are independent: no shuffle, and a rerun task gives the same rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.token_counts import byte_slices

SLICE_BYTES = 2 << 20          # text whose documents are sorted together


def least_lcp(min_length: int, min_exponent: int) -> int:
    """Smallest LCP between the first two periods of a run that is long enough."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def repeats_window(words: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    """Per document (words from begin[d] to begin[d + 1]): whether two windows of ``size`` words have one hash."""
    n, docs = len(words), len(begin) - 1
    out = np.zeros(docs, bool)
    if n < size:
        return out
    doc = np.repeat(np.arange(docs), np.diff(begin))
    h = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    span = 1

    def joined(a, shift):
        out = a[:len(a) - shift] * np.uint64(0xBF58476D1CE4E5B9) + a[shift:]
        return (out ^ (out >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)

    while span < size:
        step = min(span, size - span)          # the last step overlaps
        h = joined(h, step)
        span += step
    inside = np.flatnonzero(doc[:n - size + 1] == doc[size - 1:])
    order = inside[np.argsort(h[inside] ^ (doc[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))]
    same = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    out[doc[order[1:]][same]] = True
    return out


def suffix_order(words: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, document by document, and each one's LCP with the next.

    The suffix of a position ends with its document. LCPs of positions of different documents are 0."""
    n = len(words)
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    end = np.repeat(begin[1:], np.diff(begin))

    def numbered(key):                         # numbers in order of the key; 0 is left for "past the end"
        _, inverse, sizes = np.unique(key, return_inverse=True, return_counts=True)
        return inverse + 1, sizes

    rank, sizes = numbered(doc * (int(words.max()) + 1 if n else 1) + words)
    levels = [rank]
    shift = 1
    while len(sizes) < n:
        ahead = np.arange(n) + shift
        second = np.where(ahead < end, rank[np.minimum(ahead, n - 1)], 0)
        rank, sizes = numbered(rank * (n + 1) + second)
        levels.append(rank)
        shift *= 2
    order = np.argsort(rank)
    left, right = order[:-1], order[1:]
    lcp = np.zeros(max(n - 1, 0), np.int64)
    live = np.flatnonzero(doc[left] == doc[right])
    a, b, limit = left[live], right[live], end[left[live]]
    got = np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):   # equal ranks of a level: 2^k equal words
        x, y = a + got, b + got
        inside = (x < limit) & (y < limit)
        same = inside & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        got[same] += 1 << k
    lcp[live] = got
    return order, lcp


def kruskal_seeds(edges: Iterator[tuple[int, int, int]], ratio: int) -> Iterator[tuple[int, int, int]]:
    """Edges (LCP, position, position) by falling LCP; yields (i, j, LCP) for positions that become
    neighbours in a united set with ratio * (j - i) <= LCP."""
    sets: dict[int, list[int]] = {}
    for lcp, i, j in edges:
        a, b = sets.get(i) or [i], sets.get(j) or [j]
        if len(a) < len(b):
            a, b = b, a
        reach = lcp // ratio
        last = len(b) - 1
        for k, x in enumerate(b):
            at = bisect_left(a, x)
            if at and x - a[at - 1] <= reach and not (k and b[k - 1] == a[at - 1]):
                yield a[at - 1], x, lcp
            if at < len(a) and a[at] - x <= reach and not (k < last and b[k + 1] < a[at]):
                yield x, a[at], lcp
            a.insert(at, x)
            sets[x] = a
        if len(a) == len(b) + 1:               # the larger one was a single position
            for x in a:
                sets[x] = a


def find_runs(words: list[np.ndarray], min_length: int, min_exponent: int) -> list[list[tuple[int, int, int]]]:
    """Per document its runs (start, length, period) by start, then period: all stretches with smallest
    period ``period`` and length >= max(min_length, min_exponent * period) that cannot be extended.

    ``words``: per document the numbers of its words; min_exponent >= 2."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    least = least_lcp(min_length, min_exponent)
    begin = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    if begin[-1] == 0:
        return found
    some = np.flatnonzero(repeats_window(np.concatenate(words), begin, least))
    if not len(some):
        return found
    text = np.concatenate([words[d] for d in some.tolist()]).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum([len(words[d]) for d in some.tolist()])]).astype(np.int64)
    order, lcp = suffix_order(text, begin)
    keep = np.flatnonzero(lcp >= least)
    keep = keep[np.argsort(-lcp[keep], kind="stable")]
    edges = zip(lcp[keep].tolist(), order[keep].tolist(), order[keep + 1].tolist())
    seeds = np.array(list(kruskal_seeds(edges, min_exponent - 1)), np.int64).reshape(-1, 3)
    i, j, length = seeds[:, 0], seeds[:, 1], seeds[:, 2] + seeds[:, 1] - seeds[:, 0]
    home = np.searchsorted(begin, i, side="right") - 1
    first = (i == begin[home]) | (text[i - 1] != text[j - 1])
    good = np.flatnonzero(first & (length >= np.maximum(min_length, min_exponent * (j - i))))
    for d, s, n, q in zip(home[good].tolist(), (i - begin[home])[good].tolist(), length[good].tolist(), (j - i)[good].tolist()):
        found[int(some[d])].append((s, n, q))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Numbers of the words that no run contains after its first period."""
    step = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        step[s + q] += 1
        step[s + length] -= 1
    return np.flatnonzero(np.cumsum(step[:n]) == 0)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_exponent: int = 3,
                  rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(doc_id, n_words long, runs array<struct<start, length, period>>, collapsed string): one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. ``runs``: all runs by start, then period;
    ``collapsed``: the words that no run contains after its first period, joined by one space.
    ``rewrite(doc_id, n)``, if given, may return (a, p): each word i >= a then becomes the text's word
    a + (i - a) % p before anything else. Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``. Rows are taken each on its own, so repeated and null ids stay; an empty table
    gives an empty result; other columns are ignored, whatever their names. One document is one
    task's work: its memory is about 200 bytes a word."""
    if min_exponent < 2:
        raise ValueError("min_exponent must be 2 or more")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", run_type), ("collapsed", pa.string())])

    def of_slice(ids: list, texts: list) -> pa.RecordBatch:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        split = [t.split() if t else [] for t in texts]      # bytes part at exactly the six ASCII white-space characters
        words = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in split]
        source = [None] * len(ids)
        if rewrite is not None:
            for k, (i, w) in enumerate(zip(ids, words)):
                plan = rewrite(i, len(w)) if len(w) else None
                if plan is not None:
                    a, p = plan
                    at = np.arange(len(w))
                    at[a:] = a + (at[a:] - a) % p
                    source[k], words[k] = at, w[at]
        found = find_runs(words, min_length, min_exponent)
        kept = []
        for w, at, runs in zip(split, source, found):
            if runs or at is not None:
                keep = kept_words(len(w), runs)
                w = [w[x] for x in (keep if at is None else at[keep]).tolist()]
            kept.append(b" ".join(w))
        flat = [r for runs in found for r in runs]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array([r[c] for r in flat], pa.int64()) for c in range(3)], ["start", "length", "period"])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                                           pa.ListArray.from_arrays(pa.array(offsets), structs).cast(run_type),
                                           pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    def run(it):
        for b in it:
            ids, text = b.column(0).to_pylist(), b.column(1).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i, j in byte_slices(sizes, slice_bytes):
                yield of_slice(ids[i:j], text[i:j].to_pylist())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the run of greatest
    length / period first (compared as products; ties: smallest start, then period), and digests."""
    def order(x, y):
        mine, other = x["length"] * y["period"], y["length"] * x["period"]
        return (F.when(mine > other, -1).when(mine < other, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))

    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    best = F.get(F.array_sort("runs", order), 0)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "n_words", best.alias("_best"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", *(F.col("_best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
