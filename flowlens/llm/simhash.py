"""SimHash near-duplicates through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last one
padded to 23). The perfect binary Golay code (23, 12) maps every 23-bit word to
the index of the one codeword within 3 bits. The *fuzzy keys* of a word are the
indices of the word itself and of its 23 one-bit neighbours (about five
different ones): two words at distance two or less share a fuzzy key, because
each can step one bit towards the other. With two errors in three segments one
segment is free of errors (pigeonhole) and any other holds at most two, so the
join keys of a fingerprint are, for each segment, its exact bits together with
each fuzzy key of the next segment. Fingerprints that share a key are compared
by their bit distance; only links of one spanning tree per bucket are emitted.

Buckets of more than ``bucket_max`` different fingerprints go another exact
way: each fingerprint is keyed by itself and its 64 one-bit neighbours, and
all that share a neighbour (so are within two bits) link to the smallest.

Equal fingerprints collapse to one row before any of this.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from flowlens.llm.common import PACK_BYTES, count_blocks, free_name, materialize, open_rows, pack_blocks
from flowlens.llm.graph import connected_components

SEED = 42
MAX_BITS = 2
# The generator polynomial of the (23, 12) Golay code, and the segment layout
GOLAY_POLY = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (bytes methods touch ASCII only)."""
    return [] if text is None else text.encode("utf-8").lower().split()


def fingerprint(text: str | None, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash over word shingles (repeats count); fewer words than a shingle: the
    whole sequence is one shingle; no words: zero. A bit is set if over half the hashes set it."""
    w = words_of(text)
    if not w:
        return 0
    joined = b" ".join(w)
    if len(w) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    lens = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens).tolist()
    ends = ends[shingle - 1:].tolist()
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends)]), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(raw), 16384):
        ones += np.unpackbits(raw[i:i + 16384], axis=1).sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                 seed: int = SEED, carry: str | None = None) -> DataFrame:
    """(doc_id, fp long): one row per input row; null text has no words. ``carry`` names a long column
    that comes along as ``mark``."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())] + [("mark", pa.int64())] * (carry is not None))

    def run(it):
        for b in it:
            fps = np.fromiter((fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps.view(np.int64)), *b.columns[2:]], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       *([F.col(carry).alias("mark")] if carry else [])).mapInArrow(
        run, "doc_id long, fp long" + (", mark long" if carry else ""))


def _syndrome(v: np.ndarray) -> np.ndarray:
    r = v.astype(np.uint32)
    for i in range(22, 10, -1):
        r = r ^ (((r >> np.uint32(i)) & np.uint32(1)) * np.uint32(GOLAY_POLY << (i - 11)))
    return r


def _error_table() -> np.ndarray:
    """Error word (weight 3 or less) of each of the 2,048 syndromes, from the code itself."""
    bits = [1 << i for i in range(23)]
    errs = [0] + bits + [a | b for i, a in enumerate(bits) for b in bits[:i]]
    errs += [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[:i]) for c in bits[:j]]
    errs = np.array(errs, np.uint32)
    table = np.zeros(2048, np.uint32)
    table[_syndrome(errs)] = errs
    return table


_ERRORS: np.ndarray | None = None


def golay_index(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    global _ERRORS
    if _ERRORS is None:
        _ERRORS = _error_table()
    return (v.astype(np.uint32) ^ _ERRORS[_syndrome(v)]) >> np.uint32(11)


def fuzzy_keys(v: np.ndarray) -> np.ndarray:
    """(n, 24) codeword indices of each word and its one-bit neighbours, sorted; repeats are -1."""
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.uint32)
    k = np.sort(golay_index(v.astype(np.uint32)[:, None] ^ flips[None, :]).astype(np.int64), axis=1)
    k[:, 1:][k[:, 1:] == k[:, :-1]] = -1
    return k


def join_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row index) pairs: exact bits of a segment with the fuzzy keys of the next one."""
    segs = [((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    keys, rows = [], []
    for s in range(3):
        k = fuzzy_keys(segs[(s + 1) % 3])
        r, c = np.nonzero(k >= 0)
        keys.append((np.int64(s) << 36) | (segs[s][r] << 12) | k[r, c])
        rows.append(r)
    return np.concatenate(keys), np.concatenate(rows)


def _bucket_links(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of one bucket, by growing each part from its first member."""
    left, out = fps, []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = np.bitwise_count(left[:, None] ^ front[None, :]) <= max_bits
            hit = near.any(axis=1)
            out += zip(left[hit].tolist(), front[near[hit].argmax(axis=1)].tolist())
            front, left = left[hit], left[~hit]
    return out


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS, bucket_max: int = 64) -> DataFrame:
    """``distinct`` (fp long, no repeats) -> (u, v) links that connect all fingerprints within
    ``max_bits`` (two at most) and no others (every link is checked by its distance)."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the Golay keys find distances of 0 to 2 bits")
    pair = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    link = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def keyed(it):
        for b in it:
            f = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(f), 4096):
                part = f[i:i + 4096]
                k, r = join_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(part[r])], schema=pair)

    def linked(it):
        for b in it:
            u, v = [], []
            for fps in b.column(0):
                for x, y in _bucket_links(np.array(fps.values.to_numpy(zero_copy_only=False)).view(np.uint64), max_bits):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)],
                                             schema=link)

    rows = materialize(distinct.select("fp").mapInArrow(keyed, "key long, fp long"), "simhash-keys")
    sizes = materialize(rows.groupBy("key").count().where("count > 1"), "simhash-sizes")
    cold = (rows.join(sizes.where(F.col("count") <= bucket_max).select("key"), "key", "left_semi")
            .groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))      # at most bucket_max each
            .select("fps").mapInArrow(linked, "u long, v long"))
    hot_fps = rows.join(sizes.where(F.col("count") > bucket_max).select("key"), "key", "left_semi").select("fp").distinct()
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in [0] + [1 << i for i in range(64)]])
    near = hot_fps.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("at"))
    low = near.groupBy("at").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
    hot = (near.join(low, "at").where("fp <> v").select(F.col("fp").alias("u"), "v")
           .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
    if max_bits < 2:
        # links to the smallest may be two bits long: only direct neighbours count below that
        hot = (near.join(hot_fps.select(F.col("fp").alias("at"), F.col("fp").alias("v")), "at")
               .where("fp <> v").select(F.col("fp").alias("u"), "v")
               .where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
    return cold.unionByName(hot).distinct()


def _roots(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``distinct`` (fp and others) with the root of each fingerprint's component."""
    comp = connected_components(fingerprint_links(distinct, max_bits))
    return distinct.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = MAX_BITS, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row.

    component_id is the smallest id reachable through fingerprints within ``max_bits``.
    Null or blank text has fingerprint zero, linked like any other; rows with a null id
    keep their row and count for links, but are never a component's id. Repeated rows
    and equal ids share their component. An empty table gives an empty result."""
    fp = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fp")
    distinct = fp.groupBy("fp").agg(F.min("doc_id").alias("first"))
    reps = _roots(distinct, max_bits)
    least = reps.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = materialize(reps.join(least, "root").select("fp", "component_id"), "simhash-comp")
    return fp.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20,
             pack_bytes: int = PACK_BYTES, **kw) -> DataFrame:
    """The documents with one of each near-duplicate group kept: a row of its smallest id.

    A group is told by its texts, so rows that share an id, or have none, with unrelated texts all
    stay, and each keeps the text that stands for it. Null ids come after all others; of several
    texts of the smallest id the one of the least hash stays, of equal rows any one. Other columns
    may have any name. An empty table gives an empty one. Texts meet the kept (id, text hash) pairs in
    blocks by a hash of both, dealt out as compressed packs."""
    shingle, seed = kw.get("shingle", 3), kw.get("seed", SEED)
    mark = free_name(docs.columns, "_text_hash")
    marked = docs.withColumn(mark, F.xxhash64(text_col))
    fp = materialize(fingerprints(marked, id_col, text_col, shingle, seed, carry=mark), "simhash-fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    reps = _roots(fp.groupBy("fp").agg(first.alias("rep")), kw.get("max_bits", MAX_BITS))
    best = F.min(F.struct("rep", "fp"))["rep"]
    kept = materialize(reps.groupBy("root").agg(best.alias("rep")).select("rep.doc_id", "rep.mark"), "simhash-kept")
    n_blocks = count_blocks(docs, text_col, block_bytes)

    def block_of(i, m):
        return F.pmod(F.xxhash64(i.cast("long"), m), F.lit(n_blocks)).cast("int")

    dealt, _ = pack_blocks(marked, block_of(F.col(id_col), F.col(mark)), n_blocks, pack_bytes)
    schema = docs.schema
    none, names = to_arrow_schema(schema).empty_table(), docs.columns

    def chosen(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = open_rows(left) if left.num_rows else None
        if rows is None or not right.num_rows:
            return none
        wanted = set(zip(right.column("doc_id").to_pylist(), right.column("mark").to_pylist()))
        at = []
        for i, key in enumerate(zip(rows.column(id_col).cast(pa.int64()).to_pylist(), rows.column(mark).to_pylist())):
            if key in wanted:
                wanted.discard(key)
                at.append(i)
        return rows.select(names).take(pa.array(at, pa.int64()))

    right = kept.select(block_of(F.col("doc_id"), F.col("mark")).alias("block"), "doc_id", "mark")
    return dealt.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(chosen, schema)
