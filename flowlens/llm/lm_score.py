"""Stupid-backoff language-model scores of documents against the rest of the corpus.

Words are runs of other than ASCII white space. The model of a document is the corpus
without that document, so its own n-grams do not vouch for it: with c the corpus count less
the document's own, a word behind its context scores c(context, word) / c(context) for the
longest context with a count above zero, times ``ALPHA`` per shortened step, and a word that
no other document has scores ALPHA^order / (words of the corpus).

n-grams are keyed by a hash of their words' hashes. Count tables are partitioned by hash:

1. documents lie in blocks (hash of their id); a block lists its distinct n-grams of each
   order with their counts, dealt into buckets by hash range;
2. a bucket sums the counts of all lists, and answers each list in its order;
3. a block joins the answers to its n-grams by position, scores them, and sums by document.

Lists are sorted and difference-coded: an n-gram costs a few bytes per block that holds it,
whatever its frequency, so a very common word is one entry per block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import deal_blocks, open_rows

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 12 << 20
HASH_BITS = 56


def pack_sorted(a: np.ndarray) -> bytes:
    """Sorted unsigned numbers: differences, by byte plane (the high planes are nearly empty)."""
    d = np.diff(a.astype(np.uint64), prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_counts(a: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(a.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack_counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


class Ngrams:
    """n-grams of a block: of each order the distinct keys, and each occurrence's number among them."""

    def __init__(self, texts: list[str | None], order: int, hash_bits: int):
        number: dict[bytes, int] = {}
        words, lens = [], []
        for t in texts:
            w = t.encode("utf-8").split() if t else []
            lens.append(len(w))
            words.append(np.fromiter([number.setdefault(x, len(number)) for x in w], np.int32, len(w)))
        self.lens = np.array(lens, np.int64)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.lens)
        ids = np.concatenate(words) if words else np.zeros(0, np.int32)
        hashes = np.fromiter((xxhash.xxh64_intdigest(x) for x in number), np.uint64, len(number))
        word = hashes[ids] if len(number) else np.zeros(0, np.uint64)
        shift = np.uint64(64 - hash_bits)
        begin = np.cumsum(self.lens) - self.lens
        at = np.arange(len(ids)) - np.repeat(begin, self.lens)       # position in the document
        self.keys, self.where, self.full = [], [], []
        h = word
        for n in range(1, order + 1):
            if n > 1:
                h = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ word[n - 1:]
                h ^= h >> np.uint64(31)
                h *= np.uint64(0xBF58476D1CE4E5B9)
            here = np.flatnonzero(at >= n - 1)                       # last words of n-grams
            keys, where = np.unique(h[here - (n - 1)] >> shift, return_inverse=True)
            self.keys.append(keys)
            self.where.append(where.astype(np.int32))
            self.full.append(here)

    def counts(self, k: int) -> np.ndarray:
        return np.bincount(self.where[k], minlength=len(self.keys[k])).astype(np.int64)


def _bucket_cuts(keys: np.ndarray, n_buckets: int, hash_bits: int) -> np.ndarray:
    width = -(-(1 << hash_bits) // n_buckets)
    return np.searchsorted(keys, np.arange(n_buckets + 1, dtype=np.uint64) * np.uint64(width)) if n_buckets > 1 else np.array([0, len(keys)])


def _own_less(total: np.ndarray, grams: Ngrams, k: int) -> np.ndarray:
    """Per occurrence of order k + 1: the corpus count less the document's own."""
    where, doc = grams.where[k], grams.doc[grams.full[k]]
    pair = (doc.astype(np.int64) << 32) | where
    _, inverse, own = np.unique(pair, return_inverse=True, return_counts=True)
    return total[where] - own[inverse]


def score_block(grams: Ngrams, totals: list[np.ndarray], all_words: int, order: int, alpha: float, unit: float) -> np.ndarray:
    """Per document the sum of -log2(score) of its words, in whole units."""
    n = len(grams.doc)
    rest = [np.zeros(n, np.int64) for _ in range(order)]
    for k in range(order):
        rest[k][grams.full[k]] = _own_less(totals[k], grams, k)
    others = np.maximum(all_words - grams.lens[grams.doc], 1).astype(np.float64)
    score = np.where(rest[0] > 0, rest[0] / others, alpha / others) * alpha ** (order - 1)
    for k in range(1, order):
        # the context is the (k)-gram that ends one word earlier, in the same document
        context = np.zeros(n, np.int64)
        here = grams.full[k]
        context[here] = rest[k - 1][here - 1]
        hit = (rest[k] > 0) & (context > 0)
        score[hit] = rest[k][hit] / context[hit] * alpha ** (order - 1 - k)
    cost = np.floor(-np.log2(score) * unit + 0.5).astype(np.int64)
    return np.bincount(grams.doc, cost, len(grams.lens)).astype(np.int64) if n else np.zeros(len(grams.lens), np.int64)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA,
                    block_bytes: int = BLOCK_BYTES, hash_bits: int = HASH_BITS, unit: float = 1000.0) -> DataFrame:
    """(doc_id, n_words long, cost long, score double): one row per input row.

    ``cost``: sum over words of -log2 of the word's score in units of 1 / ``unit``, rounded word by
    word; ``score``: mean log2 score per word, null for texts without words (null, empty, blank).
    Rows of one id are separate documents. An empty table gives an empty result; other columns
    are ignored."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocked, parts = deal_blocks(src, "text", ["doc_id"], block_bytes)
    n_buckets = 4 * parts

    list_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def listed(table: pa.Table) -> pa.Table:
        grams = Ngrams(open_rows(table).column("text").to_pylist(), order, hash_bits)
        me = table.column("block")[0].as_py()
        rows = []
        for k in range(order):
            keys, counts = grams.keys[k], grams.counts(k)
            cuts = _bucket_cuts(keys, n_buckets, hash_bits).tolist()
            rows += [{"bucket": b * order + k, "block": me, "keys": pack_sorted(keys[i:j]),
                      "counts": pack_counts(counts[i:j])} for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])) if i < j]
        return pa.Table.from_pylist(rows, schema=list_schema)

    answer_schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("totals", pa.binary())])

    def summed(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([unpack_counts(x) for x in table.column("counts").to_pylist()])
        every, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, where, counts)
        parts_ = np.split(total[where], np.cumsum([len(k) for k in keys])[:-1])
        return pa.table([table.column("block"), table.column("bucket"), pa.array([pack_counts(x) for x in parts_], pa.binary())],
                        schema=answer_schema)

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("cost", pa.int64())])

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        docs_ = open_rows(left)
        grams = Ngrams(docs_.column("text").to_pylist(), order, hash_bits)
        got = dict(zip(right.column("bucket").to_pylist(), right.column("totals").to_pylist()))
        totals = []
        for k in range(order):
            mine = [unpack_counts(got[b]) for b in sorted(got) if b % order == k]
            totals.append(np.concatenate(mine) if mine else np.zeros(0, np.int64))
        cost = score_block(grams, totals, all_words, order, alpha, unit)
        return pa.table([docs_.column("doc_id"), pa.array(grams.lens), pa.array(cost)], schema=out_schema)

    # words of the corpus: counted natively, one narrow aggregation
    n_words = F.size(F.filter(F.split(F.col("text"), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    all_words = int(src.where("text is not null").agg(F.sum(n_words)).first()[0] or 0)
    answers = (blocked.groupBy("block").applyInArrow(listed, "bucket int, block int, keys binary, counts binary").groupBy("bucket")
               .applyInArrow(summed, "block int, bucket int, totals binary"))
    got = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(scored, "doc_id long, n_words long, cost long")
    return got.withColumn("score", F.when(F.col("n_words") > 0, -F.col("cost") / unit / F.col("n_words")))
