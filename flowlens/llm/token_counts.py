"""Token counts of whole texts: batch encoding in Arrow functions, lengths only.

A tokenizer that drops white space and never lets a piece cross it can be fed word by word: the
ids of a text are those of its words one after another. So a batch of texts (balanced by bytes, not
by rows) is parted at white space, the batch's distinct new words go through one ``encode_batch``,
and only the lengths come back. Words longer than ``LONG_WORD`` are cut further, where a piece
cannot cross either: beside an ASCII digit (a piece of its own) and between an ideograph and
CJK punctuation.

Texts stay where they are scanned. Only texts over ``spread_bytes`` are cut at white space into
parts of ``part_bytes``, dealt out over all tasks and summed.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import shuffle_parts

BATCH_BYTES = 4 << 20          # text of one batch
LONG_WORD = 64 << 10           # bytes above which a word is cut further
CACHE_WORDS = 400_000          # lengths that a worker remembers

# The steps of a tokenizer file under which white space parts a text safely
_SAFE_NORMALIZERS = ({"type": "NFC"}, {"type": "Lowercase"},
                     {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "})
_SAFE_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

_INSIDE_WORD = re.compile("(?<=[0-9])(?=[!-~])|(?<=[!-~])(?=[0-9])"
                          "|(?<=[、。！，：；？])(?=[一-鿿])|(?<=[一-鿿])(?=[、。！，：；？])")


def parts_at_space(spec: dict) -> bool:
    """Whether texts of this tokenizer file can be parted at white space (and as ``_INSIDE_WORD`` says)."""
    norm, pre, post = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}, spec.get("post_processor")
    steps = pre.get("pretokenizers", [])
    split = steps[0] if steps else {}
    return (norm.get("type") == "Sequence" and all(n in _SAFE_NORMALIZERS for n in norm["normalizers"])
            and split.get("pattern") == {"Regex": _SAFE_SPLIT} and split.get("behavior") == "Removed" and split.get("invert") is True
            and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space")
            and post is None and not any(re.search(r"[\s0-9　-￿]", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"]
                                         for t in spec["added_tokens"]))


class TokenCounter:
    """Numbers of tokens of texts in UTF-8, without special tokens around them."""

    def __init__(self, model: bytes, cache_words: int = CACHE_WORDS, long_word: int = LONG_WORD):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_buffer(model)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.by_word = parts_at_space(json.loads(model))
        self.cache_words, self.long_word = cache_words, long_word
        self.known: dict[bytes, int] = {}

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _long(self, word: bytes) -> int:
        """A long word, in batches of its parts."""
        total, held, size = 0, [], 0
        for part in _INSIDE_WORD.split(word.decode()):
            held.append(part)
            size += len(part)
            if size >= BATCH_BYTES:
                total += sum(self._lengths(held))
                held, size = [], 0
        return total + sum(self._lengths(held))

    def count(self, texts: list[bytes | None]) -> list[int]:
        if not self.by_word:
            return self._lengths([(t or b"").decode() for t in texts])
        words = [t.split() if t else [] for t in texts]      # bytes part at the six ASCII white-space characters
        if len(self.known) > self.cache_words:
            self.known.clear()
        fresh = list(set(chain.from_iterable(words)).difference(self.known))
        short = [w for w in fresh if len(w) <= self.long_word]
        self.known.update(zip(short, self._lengths([w.decode() for w in short])))
        if len(short) < len(fresh):
            self.known.update((w, self._long(w)) for w in fresh if len(w) > self.long_word)
        out = [sum(map(self.known.__getitem__, w)) for w in words]
        for w in fresh:
            if len(w) > 256:                                 # long words are not worth remembering
                del self.known[w]
        return out


_COUNTER: tuple | None = None


def counter_of(model: bytes, long_word: int) -> TokenCounter:
    """One counter per Python worker."""
    global _COUNTER
    key = (hash(model), long_word)
    if _COUNTER is None or _COUNTER[0] != key:
        _COUNTER = (key, TokenCounter(model, long_word=long_word))
    return _COUNTER[1]


def byte_slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, at least one row."""
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])


def cut_at_space(text: bytes, part_bytes: int) -> Iterator[bytes]:
    """Parts of about ``part_bytes`` that start at ASCII white space; a stretch without any stays whole."""
    at, space = 0, re.compile(rb"[\x20\x09-\x0D]")
    while len(text) - at > part_bytes:
        found = space.search(text, at + part_bytes)
        if found is None:
            break
        yield text[at:found.start()]
        at = found.start()
    yield text[at:]


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES,
                 spread_bytes: int = 8 << 20, part_bytes: int = 1 << 20, long_word: int = LONG_WORD) -> DataFrame:
    """(doc_id, n_bytes long, n_tokens long): one row per input row, whole texts.

    ``model``: a file of the ``tokenizers`` library; special strings inside texts are handled as it does
    by default, none is added, nothing is truncated or padded. Null and empty texts have 0 bytes and 0
    tokens. Rows are counted each on its own: repeated ids and null ids stay as they are. An empty table
    gives an empty result; other columns are ignored, whatever their names. Files whose tokens can
    cross white space are encoded text by text, and none of their texts is cut."""
    spark = docs.sparkSession
    model_b = spark.sparkContext.broadcast(model)            # the tokenizer file: a few MB
    cuttable = parts_at_space(json.loads(model))
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def count(it):
        """The other columns, then the text's bytes and tokens."""
        counter = counter_of(model_b.value, long_word)
        for b in it:
            at = b.schema.get_field_index("text")
            text = b.column(at).cast(pa.binary())
            sizes = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens = np.zeros(len(sizes), np.int64)
            for i, j in byte_slices(sizes, batch_bytes):
                tokens[i:j] = counter.count(text[i:j].to_pylist())
            keys = [k for k in range(b.num_columns) if k != at]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(sizes), pa.array(tokens)],
                                             names=[*(b.schema.names[k] for k in keys), "n_bytes", "n_tokens"])

    counted = "doc_id long, n_bytes long, n_tokens long"
    if not cuttable:
        return src.mapInArrow(count, counted)
    long = F.coalesce(F.octet_length("text") > spread_bytes, F.lit(False))
    here = src.where(~long).mapInArrow(count, counted)

    parts = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("part", pa.int64()), ("text", pa.binary())])

    def cut(it):
        for b in it:
            for row, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                for k, p in enumerate(cut_at_space(text.as_py(), part_bytes)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "part": k, "text": p}], schema=parts)

    dealt = (src.where(long).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
             .mapInArrow(cut, "row long, doc_id long, part long, text binary").repartition(shuffle_parts(spark), "row", "part"))
    far = (dealt.select("row", "doc_id", "text").mapInArrow(count, "row long, " + counted).groupBy("row")
           .agg(F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens")))
    return here.unionByName(far.drop("row"))
