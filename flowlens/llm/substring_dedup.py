"""Repeated passages by suffix arrays: every byte covered by a ``length``-byte string that
also starts earlier in the corpus is removed.

A corpus has no one suffix array at scale, so suffixes are dealt into shards such that equal
``length``-byte strings always meet, and each shard sorts its own suffixes by induction:

1. documents lie in blocks (hash of their id). *Anchors* are the smallest hashes of
   ``gram``-byte strings in every window of ``length`` bytes (winnowing): equal windows have
   equal anchors. Each block lists its distinct anchors, dealt into buckets by hash;
2. each bucket finds the anchors that occur more than once in the corpus;
3. each block cuts the context of those anchors, the bytes (``2 * length - gram`` at most)
   of all windows with that anchor, and sends each distinct context once, with its places, to
   the shard of the anchor;
4. a shard builds the suffix array and permuted common prefixes of its contexts (separated
   by a byte that UTF-8 does not use). Neighbours that share ``length`` bytes form groups,
   all but the first member of which are repeats;
5. each block unites the repeats of its documents and cuts them out.

Groups of copies fall together in step 3, so a passage with any number of copies is one
context per block. An anchor with more than ``hot_contexts`` contexts (a frequent line among
different neighbours) is not one shard's: its windows are dealt one by one, by a 128-bit hash
of the window itself, again each distinct one once per block, and the first place wins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlens.llm.common import PACK_BYTES, deal_blocks, free_name, open_rows
from flowlens.llm.suffix_array import permuted_lcp, suffix_array

GRAM = 50
BLOCK_BYTES = 8 << 20
CHUNK_BYTES = 1 << 17          # bytes hashed at a time
SHARD_BYTES = 3 << 19          # bytes sorted at a time
BATCHES = 1024                 # a shard's anchors are dealt into so many parts, sorted a few at a time
SEPARATOR = 0xFF               # never part of UTF-8
_BASE = 0x9E3779B97F4A7C15     # odd, so it has an inverse modulo 2^64
_MASK = (1 << 64) - 1
_NONE = np.uint64(_MASK)
_POWERS: list = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), dtype)


def _powers(n: int):
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every ``width`` neighbours: result[i] = f(x[i .. i + width - 1])."""
    size = 1
    while 2 * size <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def anchors(data: bytes, bounds: np.ndarray, length: int, gram: int):
    """Anchors of texts laid end to end: (position, hash, begin and end of the context, its hash).

    ``bounds``: starts of the texts and the end; texts shorter than ``length`` have none. The
    context is all windows of which the anchor is the least hash."""
    out = ([], [], [], [], [])
    b = np.frombuffer(data, np.uint8)
    lo, last = 0, len(bounds) - 1
    while lo < last:
        hi = lo + 1
        while hi < last and bounds[hi + 1] - bounds[lo] <= CHUNK_BYTES:
            hi += 1
        begin, end = int(bounds[lo]), int(bounds[hi])
        n = end - begin
        if n >= length:
            power, inverse = _powers(n + 1)
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum((b[begin:end].astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64, out=prefix[1:])
            h = _mix((prefix[gram:] - prefix[:-gram]) * inverse[:n - gram + 1]) | np.uint64(1)
            starts, ends = bounds[lo:hi] - begin, bounds[lo + 1:hi + 1] - begin
            long = ends - starts >= length
            edge = np.zeros(n + 1, np.int8)
            edge[starts[long]] += 1
            edge[ends[long] - length + 1] -= 1
            windows = n - length + 1
            valid = np.cumsum(edge[:windows], dtype=np.int8) > 0
            width = length - gram + 1
            least = np.where(valid, _slide(h, width, np.minimum)[:windows], np.uint64(0))
            # an anchor is the least of some valid window that holds it
            pad = np.zeros(width - 1, np.uint64)
            most = _slide(np.concatenate([pad, least, pad]), width, np.maximum)
            at = np.flatnonzero(most == h)
            # windows of an anchor: those that start up to width - 1 before it and have its hash as least
            near = np.concatenate([pad, least, pad])[at[:, None] + np.arange(width)[None, :]] == h[at][:, None]
            left = at - (width - 1) + near.argmax(axis=1)
            right = at - near[:, ::-1].argmax(axis=1) + length
            out[0].append(at + begin)
            out[1].append(h[at])
            out[2].append(left + begin)
            out[3].append(right + begin)
            out[4].append(_mix((prefix[right] - prefix[left]) * inverse[left]) ^ (right - left).astype(np.uint64))
        lo = hi
    if not out[0]:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in out)


class Block:
    """Documents of a block in their order: id (null last), then length, then text."""

    def __init__(self, doc_ids: list, texts: list):
        raw = [b"" if t is None else t.encode("utf-8") for t in texts]
        self.order = sorted(range(len(raw)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, len(raw[i]), raw[i]))
        self.raw = [raw[i] for i in self.order]
        self.ids = [doc_ids[i] for i in self.order]
        self.data = b"".join(self.raw)
        self.bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, self.raw), np.int64, len(raw)))])

    def keys(self):
        """Places in the order of the corpus: (null id, id, tie among rows of one id)."""
        none = np.array([i is None for i in self.ids], np.int8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        lens = np.diff(self.bounds)
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1]) | (lens[1:] != lens[:-1])])
        at = np.arange(len(ids))
        return none, ids, (lens << 24) + (at - np.maximum.accumulate(np.where(new, at, 0)))


def _list_anchors(block: Block, n_buckets: int, length: int, gram: int):
    """Rows (bucket, anchors, contexts) of a block: sorted distinct anchors, and of how many contexts each."""
    _, h, _, _, ctx = anchors(block.data, block.bounds, length, gram)
    if not len(h):
        return
    order = np.lexsort((ctx, h))
    h, ctx = h[order], ctx[order]
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_c = new_h | np.concatenate([[True], ctx[1:] != ctx[:-1]])
    first = np.flatnonzero(new_h)
    size = np.diff(np.append(first, len(h)))
    contexts = np.add.reduceat(new_c.astype(np.int64), first)
    kinds = np.where(size > 1, np.maximum(contexts, 1) + 1, 1)        # 1: occurs once in the block
    keys = h[first]
    bucket = (keys % np.uint64(n_buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
    for k in range(n_buckets):
        if cuts[k] < cuts[k + 1]:
            part = by[cuts[k]:cuts[k + 1]]
            yield k, _pack(np.diff(keys[part], prepend=np.uint64(0))), _pack(kinds[part].astype(np.uint32))


def _judge_anchors(lists: list[bytes], kinds: list[bytes], hot_contexts: int) -> list[bytes]:
    """For each list: 0 for anchors that occur once in all, 1 for repeated ones, 2 for hot ones."""
    keys = [np.cumsum(_unpack(x, np.uint64), dtype=np.uint64) for x in lists]
    kind = [_unpack(x, np.uint32) for x in kinds]
    every, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, np.concatenate(kind), len(every))
    flag = np.where(total < 2, 0, np.where(total > hot_contexts, 2, 1)).astype(np.uint8)
    return [_pack(x) for x in np.split(flag[where], np.cumsum([len(k) for k in keys])[:-1])]


def _contexts(block: Block, flags: dict[int, bytes], n_buckets: int, length: int, gram: int):
    """Rows (shard, texts, ...) of a block: distinct contexts of repeated anchors and hot windows."""
    pos, h, left, right, _ = anchors(block.data, block.bounds, length, gram)
    if not len(pos):
        return
    bucket = (h % np.uint64(n_buckets)).astype(np.int64)
    distinct, where = np.unique(h, return_inverse=True)
    dist_bucket = (distinct % np.uint64(n_buckets)).astype(np.int64)
    flag = np.zeros(len(distinct), np.uint8)
    for k, blob in flags.items():
        flag[dist_bucket == k] = _unpack(blob, np.uint8)
    kind = flag[where]
    doc = np.searchsorted(block.bounds, pos, side="right") - 1
    starts = block.bounds[doc]
    data = block.data
    null, ids, tie = block.keys()

    some = np.flatnonzero(kind == 1)
    found: dict[int, dict[tuple, list]] = {}
    batch = (h[some] // np.uint64(n_buckets) % np.uint64(BATCHES)).tolist()
    for s, q, a, b, d, o in zip(bucket[some].tolist(), batch, left[some].tolist(), right[some].tolist(),
                                doc[some].tolist(), (left - starts)[some].tolist()):
        found.setdefault(s, {}).setdefault((q, data[a:b]), []).append((d, o))
    hot = np.flatnonzero(kind == 2)
    windows: dict[int, dict[bytes, list]] = {}
    if len(hot):
        at = np.unique(np.concatenate([np.arange(a, b - length + 1) for a, b in zip(left[hot].tolist(), right[hot].tolist())]))
        at_doc = np.searchsorted(block.bounds, at, side="right") - 1
        for a, d, o in zip(at.tolist(), at_doc.tolist(), (at - block.bounds[at_doc]).tolist()):
            w = xxhash.xxh3_128_digest(data[a:a + length])
            windows.setdefault(int.from_bytes(w[:4], "big") % n_buckets, {}).setdefault(w, []).append((d, o))
    for s in sorted(found.keys() | windows.keys()):
        c, w = found.get(s, {}), windows.get(s, {})
        places = np.array([p for x in (c, w) for v in x.values() for p in v], np.int32).reshape(-1, 2)
        rows = np.unique(places[:, 0])
        yield {"shard": s, "texts": zstandard.compress(b"".join([x for _, x in c]), 1),
               "lens": _pack(np.array([len(x) for _, x in c], np.uint32)),
               "batches": _pack(np.array([q for q, _ in c], np.uint16)),
               "windows": b"".join(w), "counts": _pack(np.array([len(v) for x in (c, w) for v in x.values()], np.uint32)),
               "docs": _pack(places[:, 0]), "offsets": _pack(places[:, 1]), "rows": _pack(rows.astype(np.int32)),
               "nulls": _pack(null[rows]), "ids": _pack(ids[rows]), "ties": _pack(tie[rows])}


def _repeats(rows: list[dict], length: int):
    """For each row (block) of a shard: (doc, start, end) of repeats."""
    lists = []
    for r in rows:
        lists.append({k: _unpack(r[k], t) for k, t in (("lens", np.uint32), ("batches", np.uint16), ("counts", np.uint32), ("docs", np.int32),
                                                       ("offsets", np.int32), ("rows", np.int32), ("nulls", np.int8),
                                                       ("ids", np.int64), ("ties", np.int64))})
    # one number for each place that orders all places of the shard
    size = [len(x["rows"]) for x in lists]
    rank = np.empty(sum(size), np.int64)
    rank[np.lexsort(tuple(np.concatenate([x[k] for x in lists]) for k in ("ties", "ids", "nulls")))] = np.arange(len(rank))
    found: dict[int, dict[bytes, list]] = {}   # by batch, distinct context: [(block, doc, offset, order)]
    seen: dict[bytes, list] = {}           # hot window
    at = 0
    for k, (r, x) in enumerate(zip(rows, lists)):
        mine = rank[at:at + size[k]]
        at += size[k]
        order = (mine[np.searchsorted(x["rows"], x["docs"])] << 32) | x["offsets"]
        places = list(zip([k] * len(order), x["docs"].tolist(), x["offsets"].tolist(), order.tolist()))
        texts = zstandard.decompress(r["texts"])
        ends = np.cumsum(x["counts"]).tolist()
        begins = [0] + ends[:-1]
        cut = np.cumsum(x["lens"], dtype=np.int64).tolist()
        n = len(cut)
        for q, a, b, i, j in zip(x["batches"].tolist(), [0] + cut[:-1], cut, begins, ends):
            found.setdefault(q, {}).setdefault(texts[a:b], []).extend(places[i:j])
        w = r["windows"]
        for q, (i, j) in enumerate(zip(begins[n:], ends[n:])):
            seen.setdefault(w[16 * q:16 * q + 16], []).extend(places[i:j])
    out: list[list] = [[] for _ in rows]
    for places in seen.values():
        if len(places) > 1:
            first = min(p[3] for p in places)
            for k, d, o, key in places:
                if key > first:
                    out[k].append((d, o, o + length))
    texts, firsts, held = [], [], 0
    for batch in found.values():             # contexts of one anchor are in one batch
        for text, places in batch.items():
            first = min(places, key=lambda p: p[3])
            for k, d, o, key in places:
                if key > first[3]:
                    out[k].append((d, o, o + len(text)))
            texts.append(text)
            firsts.append(first)
            held += len(text)
        if held >= SHARD_BYTES:
            _sorted_repeats(texts, firsts, length, out)
            texts, firsts, held = [], [], 0
    if texts:
        _sorted_repeats(texts, firsts, length, out)
    return out


def _sorted_repeats(texts: list[bytes], firsts: list[tuple], length: int, out: list[list]) -> None:
    sep = bytes([SEPARATOR])
    t = np.frombuffer(sep.join(texts) + sep, np.uint8)
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    sa = suffix_array(t)
    lcp = permuted_lcp(t, sa)[sa]
    group = np.cumsum(lcp < length) - 1                      # neighbours sharing ``length`` bytes
    count = np.bincount(group)
    member = np.flatnonzero(count[group] > 1)
    if not len(member):
        return
    pos, group = sa[member].astype(np.int64), group[member]
    ctx = np.searchsorted(starts, pos, side="right") - 1
    inside = pos + length <= starts[ctx] + lens[ctx]         # no separator within the window
    pos, group, ctx = pos[inside], group[inside], ctx[inside]
    if not len(pos):
        return
    order = np.array([f[3] for f in firsts], np.int64)[ctx] + (pos - starts[ctx])
    head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(order, head)
    repeat = order > np.repeat(least, np.diff(np.append(head, len(group))))
    at = np.sort(pos[repeat])
    if not len(at):
        return
    ctx = np.searchsorted(starts, at, side="right") - 1
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (ctx[1:] != ctx[:-1])])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    for c, a, b in zip(ctx[begin].tolist(), at[begin].tolist(), at[end].tolist()):
        k, d, o, _ = firsts[c]
        shift = o - int(starts[c])
        out[k].append((d, a + shift, b + shift + length))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100,
                   gram: int = GRAM, block_bytes: int = BLOCK_BYTES, hot_contexts: int = 2000,
                   carry: list[str] | None = None, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans array<struct<begin, end>>, kept binary): a row per input row.

    ``spans``: the maximal removed runs of the UTF-8 text, by the text before anything is removed;
    ``kept``: the bytes that are left. Earlier is the smaller id, then (rows of one id, null
    ids, which come last) the shorter and smaller text; of rows that agree in all of that, one is
    first. Null and empty texts have no bytes; texts shorter than ``length`` are never cut. An
    empty table gives an empty result; other columns are ignored, but for those named by
    ``carry``, which come back as the struct column ``rest``, beside the string ``whole``: what is
    left as text, without the bytes of characters that a cut splits."""
    if not 8 <= gram < length:
        raise ValueError("gram must be at least 8 and shorter than length")
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest")] if carry else []))
    # by id and length: rows of one id and length are one block's, which orders them
    blocked, parts = deal_blocks(src, "text", ["doc_id"], block_bytes, pack_bytes)
    n_buckets = 2 * parts          # a shard's contexts are held at once: more and smaller shards

    list_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("anchors", pa.binary()), ("kinds", pa.binary())])

    def block_of(table: pa.Table) -> Block:
        docs = open_rows(table)
        return Block(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist())

    def listed(table: pa.Table) -> pa.Table:
        k = table.column("block")[0].as_py()
        return pa.Table.from_pylist([{"bucket": b, "block": k, "anchors": x, "kinds": y}
                                     for b, x, y in _list_anchors(block_of(table), n_buckets, length, gram)], list_schema)

    flag_schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("flags", pa.binary())])

    def judged(table: pa.Table) -> pa.Table:
        flags = _judge_anchors(table.column("anchors").to_pylist(), table.column("kinds").to_pylist(), hot_contexts)
        return pa.table([table.column("block"), table.column("bucket"), pa.array(flags, pa.binary())], schema=flag_schema)

    ctx_schema = pa.schema([("shard", pa.int32()), ("block", pa.int32())] + [
        (c, pa.binary()) for c in ("texts", "lens", "batches", "windows", "counts", "docs", "offsets", "rows", "nulls", "ids", "ties")])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return ctx_schema.empty_table()
        k = left.column("block")[0].as_py()
        flags = dict(zip(right.column("bucket").to_pylist(), right.column("flags").to_pylist()))
        return pa.Table.from_pylist([r | {"block": k} for r in _contexts(block_of(left), flags, n_buckets, length, gram)],
                                    ctx_schema)

    span_schema = pa.schema([("block", pa.int32()), ("shard", pa.int32()), ("spans", pa.binary())])

    def sorted_out(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = _repeats(rows, length)
        return pa.Table.from_pylist([{"block": r["block"], "shard": r["shard"], "spans": _pack(np.array(x, np.int32))}
                                     for r, x in zip(rows, found) if x], span_schema)

    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def applied(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = open_rows(left)
        b = Block(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist())
        cover: dict[int, list] = {}
        for blob in right.column("spans").to_pylist():
            for d, s, e in _unpack(blob, np.int32).reshape(-1, 3).tolist():
                cover.setdefault(d, []).append((s, e))
        n_removed, spans, kept, whole = [], [], [], []
        for d, raw in enumerate(b.raw):
            merged: list[list] = []
            for s, e in sorted(cover.get(d, ())):
                if merged and s <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], e)
                else:
                    merged.append([s, e])
            n_removed.append(sum(e - s for s, e in merged))
            spans.append([{"begin": s, "end": e} for s, e in merged])
            ends = [0] + [e for _, e in merged]
            pieces = [raw[x:y] for x, y in zip(ends, [s for s, _ in merged] + [len(raw)])]
            kept.append(b"".join(pieces))
            if carry:
                whole.append("".join([x.decode("utf-8", "ignore") for x in pieces]))
        out = {"doc_id": pa.array(b.ids, pa.int64()), "n_bytes": pa.array([len(x) for x in b.raw], pa.int64()),
               "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, pa.list_(span)),
               "kept": pa.array(kept, pa.binary())}
        if carry:
            out |= {"whole": pa.array(whole, pa.string()), "rest": docs.column("rest").take(pa.array(b.order))}
        return pa.table(out)

    flags = (blocked.groupBy("block").applyInArrow(listed, "bucket int, block int, anchors binary, kinds binary")
             .groupBy("bucket").applyInArrow(judged, "block int, bucket int, flags binary"))
    contexts = blocked.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(
        cut, "shard int, block int, " + ", ".join(f"{f.name} binary" for f in list(ctx_schema)[2:]))
    spans = contexts.groupBy("shard").applyInArrow(sorted_out, "block int, shard int, spans binary")
    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, spans array<struct<begin: long, end: long>>, kept binary")
    if carry:
        schema = schema.add("whole", "string").add(src.schema["rest"])
    return blocked.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(applied, schema)


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", **kw) -> DataFrame:
    """``docs`` with the repeats cut out of their texts; same columns and rows.

    Where a cut splits a character, what is left of it goes too. Null texts stay null;
    ``length_col``, if there is one, is the number of characters of the new text. Other columns
    may have any name. An empty table gives an empty one."""
    others = [c for c in docs.columns if c != text_col]
    missing = free_name(docs.columns, "_null")
    marked = docs.withColumn(missing, F.col(text_col).isNull())
    got = remove_repeats(marked, id_col, text_col, carry=[*others, missing], **kw)
    text = F.when(~F.col(f"rest.`{missing}`"), F.col("whole"))
    new = {text_col: text}
    if length_col in others:
        new[length_col] = F.when(text.isNotNull(), F.length(text)).cast(docs.schema[length_col].dataType)
    return got.select(*[new.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])

