"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of a model holds a whitespace marker after another character,
merges never cross from a word into the next marker, so a text is segmented
chunk by chunk (a run of markers and the word behind it). Every distinct chunk
of the corpus is segmented once:

1. documents are dealt into blocks by a hash of their id (a few MB of text);
   each block lists its distinct chunks, dealt into buckets by a hash;
2. each bucket unites the lists of all blocks, segments and decodes every
   distinct chunk once, and answers each list with the ids in the list's order;
3. each block joins the ids back by position.

Lists travel as compressed columns (one row per block and bucket), so a chunk
costs a few bytes per block whatever its frequency; a very common word is one
entry per block, never a row per occurrence.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import deal_blocks, open_rows

MARK = "▁"
BLOCK_BYTES = 8 << 20
_CHUNK = re.compile(" *[^ ]+| +")


def chunks_of(text: str) -> list[str]:
    """Chunks of a text, each without the one marker (here a space) that every chunk starts with."""
    if not text:
        return []
    text = text.replace(MARK, " ")
    parts = text.split(" ")
    if "" not in parts:
        return parts
    return [c[1:] for c in _CHUNK.findall(" " + text)]


def pack_strings(items: list[bytes]) -> bytes:
    lens = np.fromiter(map(len, items), np.uint32, len(items))
    return zstandard.compress(np.uint32(len(items)).tobytes() + lens.tobytes() + b"".join(items), 1)


def unpack_strings(blob: bytes) -> list[bytes]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = (np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n] + ends[:-1], ends)]


def bucket_lists(keys, n_buckets: int) -> dict[int, list[bytes]]:
    """Sorted distinct keys of each bucket, as UTF-8."""
    out: dict[int, list[bytes]] = {}
    for k in keys:
        b = k.encode("utf-8")
        out.setdefault(zlib.crc32(b) % n_buckets, []).append(b)
    for v in out.values():
        v.sort()
    return out


class Segmenter:
    """Encodes and decodes single chunks with the library itself."""

    def __init__(self, model: bytes):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.marker = self.sp.piece_to_id(MARK)

    def encode(self, chunks: list[str]) -> list[list[int]]:
        # the library puts the first marker before what it is given; a lone marker would be an empty text
        got = self.sp.encode(chunks, num_threads=1)
        return [[self.marker] if c == "" else ids for c, ids in zip(chunks, got)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of chunks without the leading marker (the library drops it)."""
        return self.sp.decode(ids, num_threads=1)


def check_model(model: bytes) -> tuple[int, int]:
    """The end id and the number of pieces; raises if pieces of the model may cross a whitespace marker."""
    sp = Segmenter(model).sp
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any(MARK in p.lstrip(MARK) for p in pieces):
        raise ValueError("pieces of this model cross whitespace markers")
    odd = "aä゠　ﬁ  \t b "
    if sp.normalize(odd) != MARK + odd.replace(" ", MARK):
        raise ValueError("only models that leave the text as it is (identity rule, leading marker) can be split")
    return sp.eos_id(), len(pieces)


def encode_documents(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                     block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens long, ids string, decoded string): one row per input row.

    ``ids`` are the decimal ids, ending with the end id, joined by one space. Null and empty
    texts have the end id only and decode to an empty text. Repeated rows, ties and null ids
    stay as they are; an empty table gives an empty result; other columns are ignored."""
    end_id, n_pieces = check_model(model)
    spark = docs.sparkSession
    model_b = spark.sparkContext.broadcast(model)               # the model file: a few MB
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocked, parts = deal_blocks(src, "text", ["doc_id"], block_bytes)
    n_buckets = parts

    lists_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary())])

    def distinct_chunks(texts: list) -> dict[int, list[bytes]]:
        keys: set = set()
        for t in texts:
            if t:
                keys.update(chunks_of(t))
        return bucket_lists(keys, n_buckets)

    def lists(table: pa.Table) -> pa.Table:
        me = table.column("block")[0].as_py()
        mine = distinct_chunks(open_rows(table).column("text").to_pylist())
        return pa.Table.from_pylist([{"bucket": k, "block": me, "keys": pack_strings(v)} for k, v in mine.items()],
                                    schema=lists_schema)

    answer_schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("n_ids", pa.binary()),
                               ("ids", pa.binary()), ("odd", pa.binary())])

    def answer(table: pa.Table) -> pa.Table:
        seg = Segmenter(model_b.value)
        asked = [unpack_strings(x) for x in table.column("keys").to_pylist()]
        keys = sorted(set().union(*asked))
        known: dict[bytes, tuple] = {}
        for i in range(0, len(keys), 20000):
            part = keys[i:i + 20000]
            texts = [k.decode("utf-8") for k in part]
            ids = seg.encode(texts)
            for k, t, x, d in zip(part, texts, ids, seg.decode(ids)):
                known[k] = (np.array(x, np.uint32).tobytes(), None if d == t else d.encode("utf-8"))
        rows = []
        for block_id, items in zip(table.column("block").to_pylist(), asked):
            got = [known[k] for k in items]
            n = np.fromiter((len(g[0]) // 4 for g in got), np.uint32, len(got))
            odd = [(i, g[1]) for i, g in enumerate(got) if g[1] is not None]
            rows.append({"block": block_id, "bucket": table.column("bucket")[0].as_py(),
                         "n_ids": zstandard.compress(n.tobytes(), 1),
                         "ids": zstandard.compress(b"".join([g[0] for g in got]), 1),
                         "odd": pack_strings([x for i, d in odd for x in (str(i).encode(), d)]) if odd else None})
        return pa.Table.from_pylist(rows, schema=answer_schema)

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])

    def join_back(left: pa.Table, right: pa.Table) -> pa.Table:
        docs = open_rows(left)
        texts = docs.column("text").to_pylist()
        mine = distinct_chunks(texts)
        name = [str(i) for i in range(n_pieces)]
        ids_of: dict[str, str] = {}
        text_of: dict[str, str] = {}
        for bucket, *blobs, odd in zip(*[right.column(c).to_pylist() for c in ("bucket", "n_ids", "ids", "odd")]):
            items = [k.decode("utf-8") for k in mine.pop(bucket)]
            n, ids = (np.frombuffer(zstandard.decompress(x), np.uint32) for x in blobs)
            names, ends = [name[i] for i in ids.tolist()], np.cumsum(n).tolist()
            ids_of.update(zip(items, [" ".join(names[a:b]) for a, b in zip([0] + ends[:-1], ends)]))
            if odd:
                pairs = unpack_strings(odd)
                text_of.update((items[int(i)], d.decode("utf-8")) for i, d in zip(pairs[::2], pairs[1::2]))
        n_tokens, ids, decoded = [], [], []
        for t in texts:
            c = chunks_of(t)
            ids.append(" ".join([*map(ids_of.__getitem__, c), name[end_id]]))
            n_tokens.append(ids[-1].count(" ") + 1)
            decoded.append(" ".join([text_of.get(x, x) for x in c] if text_of else c))
        return pa.table([docs.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(ids, pa.string()),
                         pa.array(decoded, pa.string())], schema=out_schema)

    answers = (blocked.groupBy("block").applyInArrow(lists, "bucket int, block int, keys binary")
               .groupBy("bucket").applyInArrow(answer, "block int, bucket int, n_ids binary, ids binary, odd binary"))
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        join_back, "doc_id long, n_tokens long, ids string, decoded string")
