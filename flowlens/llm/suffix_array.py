"""Suffix array of a byte string by induced sorting, and its permuted common prefixes.

All steps are numpy passes over whole arrays or whole buckets:

* suffixes are classified as S (smaller than the next one) or L (larger); an S suffix
  behind an L suffix is *leftmost-smaller* (LMS);
* the substrings between LMS positions are sorted by one round of inducing and named;
  where names repeat, the string of names, about a third as long, is sorted recursively:
  each call names pairs of names, at twice the distance, until all names differ;
* from the sorted LMS suffixes all L suffixes are induced bucket by bucket from the left,
  then all S suffixes from the right. A bucket is scanned in waves: what a wave puts into
  its own bucket (a run of one symbol) is the next wave. Each suffix is read and written
  once in each direction, so inducing is linear.
* permuted common prefixes: the value at i is one less than that at i - 1 wherever the
  symbols before i and before its predecessor in the array agree; only the other
  (irreducible) positions are compared, eight bytes at a time.
"""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes. ``t`` ends with a unique smallest symbol."""
    n = len(t)
    step = np.empty(n, np.int8)
    step[:-1] = np.sign(np.diff(t.astype(np.int32)))
    step[-1] = 1
    at = np.where(step != 0, np.arange(n, dtype=np.int32), np.int32(n - 1))
    nxt = np.minimum.accumulate(at[::-1])[::-1]      # the next position where the symbol changes
    return step[nxt] > 0


def _spread(sa: np.ndarray, at: np.ndarray, sym: np.ndarray, pos: np.ndarray, way: int) -> None:
    """Put ``pos`` into the buckets of their symbols, in order, from ``at`` on; moves ``at``."""
    order = np.argsort(sym, kind="stable")
    s = sym[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    count = np.diff(np.append(first, len(s)))
    groups = s[first]
    rank = np.arange(len(s)) - np.repeat(first, count)
    sa[at[s] + way * rank] = pos[order]
    at[groups] += way * count


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, start: np.ndarray) -> np.ndarray:
    """All suffixes from LMS positions ``lms`` in their order (the last symbol's own comes first)."""
    n, k = len(t), len(start) - 1
    sa = np.full(n, -1, np.int32)
    lms_count = np.bincount(t[lms], minlength=k)
    lms_at = np.concatenate([[0], np.cumsum(lms_count)])      # lms is in order, so grouped by symbol
    head = start[:-1].copy()
    present = np.flatnonzero(np.diff(start)).tolist()

    def left_of(block: np.ndarray, want_s: bool) -> np.ndarray:
        j = block[block > 0] - 1
        return j[is_s[j] == want_s]

    for c in present:
        done = int(start[c])
        while done < head[c]:
            wave = sa[done:head[c]]
            done = int(head[c])
            j = left_of(wave, False)
            if len(j):
                _spread(sa, head, t[j], j, 1)
        if lms_count[c]:
            j = left_of(lms[lms_at[c]:lms_at[c + 1]], False)
            if len(j):
                _spread(sa, head, t[j], j, 1)
    l_end = head                                               # L suffixes of c: start[c] .. l_end[c]
    tail = start[1:] - 1
    sa[0] = n - 1
    tail[t[n - 1]] -= 1
    for c in reversed(present):
        done = int(start[c + 1]) - 1
        while done > tail[c]:
            wave = sa[tail[c] + 1:done + 1][::-1]
            done = int(tail[c])
            j = left_of(wave, True)
            if len(j):
                _spread(sa, tail, t[j], j, -1)
        j = left_of(sa[start[c]:l_end[c]][::-1], True)
        if len(j):
            _spread(sa, tail, t[j], j, -1)
    return sa


def _sort_names(names: np.ndarray, step: int = 1) -> np.ndarray:
    """Ranks of the suffixes of a string of names whose prefixes of ``step`` symbols are ranked
    by ``names``; recursive: the names of pairs, ``step`` apart, rank prefixes twice as long."""
    n = len(names)
    open_ = np.flatnonzero(np.bincount(names, minlength=n)[names] > 1)
    if not len(open_):
        return names
    second = np.zeros(len(open_), np.int64)
    inside = open_ + step < n
    second[inside] = names[open_[inside] + step] + 1
    key = (names[open_].astype(np.int64) << 32) | second
    order = np.argsort(key)
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    group = np.concatenate([[True], (k[1:] >> 32) != (k[:-1] >> 32)])
    at = np.arange(len(k))
    # names are the number of smaller suffixes, so refined names need no others to move
    base = np.maximum.accumulate(np.where(group, at, 0))
    head = np.maximum.accumulate(np.where(new, at, 0))
    out = names.copy()
    out[open_[order]] = (k >> 32) + (head - base)
    return _sort_names(out, 2 * step)


def _lms_names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names (number of smaller ones) of LMS substrings, in text order; ``ordered``: sorted positions."""
    n, m = len(t), len(lms)
    index = np.empty(n, np.int32)
    index[lms] = np.arange(m, dtype=np.int32)
    length = np.append(np.diff(lms), 0) + 1
    which = index[ordered]
    a, b = ordered[:-1], ordered[1:]
    same = length[which[:-1]] == length[which[1:]]
    live = np.flatnonzero(same)
    size = length[which[1:]]
    k = 0
    while len(live):
        live = live[size[live] > k]
        diff = t[a[live] + k] != t[b[live] + k]
        same[live[diff]] = False
        live = live[~diff]
        k += 1
    rank = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(m), 0))
    names = np.empty(m, np.int64)
    names[which] = rank
    return names


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array (int32) of a uint8 array; a suffix that is a prefix of another comes first."""
    t = np.empty(len(text) + 1, np.uint16)
    t[:-1] = text
    t[:-1] += 1
    t[-1] = 0
    is_s = _types(t)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]).astype(np.int32) + 1
    if len(lms) == 0:                                 # an empty text
        return np.zeros(0, np.int32)
    start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=257))])
    if len(lms) > 1:
        sa = _induce(t, is_s, lms[np.argsort(t[lms], kind="stable")], start)
        is_lms = np.zeros(len(t), bool)
        is_lms[lms] = True
        names = _lms_names(t, lms, sa[is_lms[sa]])
        ordered = np.empty_like(lms)
        ordered[_sort_names(names)] = lms
    else:
        ordered = lms
    return _induce(t, is_s, ordered, start)[1:]


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """At each position: the length of the prefix shared with its predecessor in ``sa`` (first: 0)."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    phi = np.empty(n, np.int32)
    phi[sa[1:]] = sa[:-1]
    phi[sa[0]] = -1
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    irreducible = phi <= 0
    irreducible[0] = True
    before = padded[:n][np.maximum(phi, 1) - 1]
    irreducible[1:] |= text[:-1] != before[1:]
    at = np.flatnonzero(irreducible & (phi >= 0)).astype(np.int32)
    words = np.ndarray((n + 8,), "<u8", padded, strides=(1,))
    a, b, value = at.copy(), phi[at], np.zeros(len(at), np.int32)
    live = np.arange(len(at), dtype=np.int32)
    while len(live):
        x = words[a[live]] ^ words[b[live]]
        equal = x == 0
        part = x[~equal]
        value[live[~equal]] += np.bitwise_count((part & -part) - np.uint64(1)) // 8
        live = live[equal]
        value[live] += 8
        a[live] += 8
        b[live] += 8
        live = live[(a[live] < n) & (b[live] < n)]
    value = np.minimum(value, n - np.maximum(at, phi[at]))     # nothing behind the end
    out = np.zeros(n, np.int32)
    out[at] = value
    i = np.arange(n, dtype=np.int32)
    source = np.maximum.accumulate(np.where(irreducible, i, 0))
    return out[source] - (i - source)
