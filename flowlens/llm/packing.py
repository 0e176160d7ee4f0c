"""Order-preserving packing of tokenised documents into fixed windows.

Documents keep the order in which they are stored. The token stream of a scan
partition is cut into sequences of at most ``max_len`` tokens; cuts fall at
document ends, at sentence ends, or (inside sentences longer than
``hard_step`` tokens only) every ``hard_step`` tokens. Cuts are chosen by dynamic
programming over these points:

    cost(j) = min over i with p[j] - p[i] <= max_len of
              cost(i) + padding(p[j] - p[i]) + cut penalty(j) + sequence_cost

where padding(n) = max_len - n, or 0 if n is a power of two. The first form is a
sliding-window minimum of cost(i) + p[i], kept in a monotone queue; the powers of
two are single extra transitions. So a run costs linear time. Runs of about
``run_tokens`` tokens are solved one after another; the last sequence of a run goes
back into the next one, so only the end of a partition is padded for lack of text.

No shuffle: partitions are independent, and a rerun task makes the same cuts.
"""

from __future__ import annotations

import json
import os
from collections import deque
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern by which byte-level BPE parts a text
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level piece stands for: printable Latin-1 characters are
    themselves, the other bytes follow, in order, from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(others)}}


class TextTokenizer:
    """Ids of whole texts by a tokenizer file of the ``tokenizers`` library.

    A plain byte-level BPE whose merges are numbered in their order is the same as a table of ranks,
    with which ``tiktoken`` finds the same ids several times faster. Other files, and texts that hold
    one of the added tokens or on which ``tiktoken`` gives up (its regex has a backtracking limit,
    which about a million characters of white space exceed), are encoded by ``tokenizers`` itself, which
    is loaded only then."""

    def __init__(self, model: bytes, end_id: int):
        self.model, self.end_id = model, end_id
        spec = json.loads(model)
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.ranks = self._rank_encoding(spec)
        if self.ranks is None:
            vocab = self.tok.get_vocab(with_added_tokens=True)
        else:
            vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ends_sentence = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():     # Ċ is the new line
            self.ends_sentence[i] = piece.rstrip("\"')]").endswith((".", "!", "?", "Ċ"))

    @cached_property
    def tok(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        return Tokenizer.from_buffer(self.model)

    def _rank_encoding(self, spec: dict):
        m, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = (m["type"] == "BPE" and not any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix",
                                                                   "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
                 and spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"))
        if not plain:
            return None
        byte, added = byte_alphabet(), set(self.added)
        ranks = {bytes(byte[c] for c in p): i for p, i in m["vocab"].items() if p not in added}
        pairs = [x if isinstance(x, list) else x.split(" ") for x in m["merges"]]
        if sorted(ranks.values()) != list(range(len(ranks))) or any(m["vocab"].get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
            return None
        import tiktoken
        return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.array([self.end_id], np.uint32)
        ids = None
        if self.ranks is not None and not any(a in text for a in self.added):
            try:
                ids = self.ranks.encode_to_numpy(text)
            except ValueError:
                pass
        if ids is None:
            ids = self.tok.encode(text, add_special_tokens=False).ids
        return np.append(np.asarray(ids, np.uint32), np.uint32(self.end_id))


_TOKENIZER: tuple | None = None


def tokenizer_of(model: bytes, end_id: int) -> TextTokenizer:
    """One tokenizer per Python worker."""
    global _TOKENIZER
    key = (hash(model), end_id)
    if _TOKENIZER is None or _TOKENIZER[0] != key:
        _TOKENIZER = (key, TextTokenizer(model, end_id))
    return _TOKENIZER[1]


def choose_cuts(points: np.ndarray, penalty: np.ndarray, max_len: int, sequence_cost: int = 4) -> list[int]:
    """Cut points (a subset of ``points``, without 0) of least total cost.

    ``points``: increasing, from 0 to the number of tokens, steps of ``max_len`` at most;
    ``penalty``: cost of a cut at each point."""
    m = len(points)
    p, pen = points.tolist(), (penalty + sequence_cost).tolist()
    exact: dict[int, list[int]] = {}       # point -> points a power of two before it
    size = max_len if max_len & (max_len - 1) == 0 else 1 << (max_len.bit_length() - 1)
    while size >= 32:
        at = np.searchsorted(points, points - size)
        for j in np.flatnonzero(points[at] == points - size).tolist():
            exact.setdefault(j, []).append(int(at[j]))
        size >>= 1
    cost, back = [0] * m, [0] * m
    queue: deque = deque([(0, 0, 0)])      # (cost + position, position, point), first smallest
    for j in range(1, m):
        here = p[j]
        while queue[0][1] < here - max_len:
            queue.popleft()
        best, _, i = queue[0]
        best += max_len - here
        if j in exact:
            for k in exact[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        cost[j] = best = best + pen[j]
        back[j] = i
        best += here
        while queue and queue[-1][0] >= best:      # from here on, no worse and later
            queue.pop()
        queue.append((best, here, j))
    cuts, j = [], m - 1
    while j:
        cuts.append(p[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Collects documents and returns pieces (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, ends_sentence: np.ndarray, max_len: int, run_tokens: int, sentence_penalty: int,
                 hard_penalty: int, hard_step: int):
        self.ends, self.max_len, self.run_tokens = ends_sentence, max_len, run_tokens
        self.penalties, self.hard_step = (sentence_penalty, hard_penalty), min(hard_step, max_len)
        self.docs: list[tuple] = []        # (doc_id, tokens of the whole document, start, ids left)
        self.held = 0
        self.sequence = 0

    def add(self, doc_id, ids: np.ndarray):
        step = max(self.run_tokens, self.max_len)
        for at in range(0, len(ids), step):               # a very long document is several entries
            part = ids[at:at + step]
            self.docs.append((doc_id, len(ids), at, part))
            self.held += len(part)
            if self.held >= self.run_tokens:
                yield from self.run(False)

    def points(self, ids: np.ndarray, doc_ends: np.ndarray):
        soft = np.flatnonzero(self.ends[ids]) + 1
        marks = np.unique(np.concatenate([[0], soft, doc_ends]))
        gaps = np.diff(marks)
        wide = np.flatnonzero(gaps > self.hard_step)
        hard = [np.arange(marks[i] + self.hard_step, marks[i + 1], self.hard_step) for i in wide.tolist()]
        points = np.sort(np.concatenate([marks, *hard])) if hard else marks
        penalty = np.full(len(points), self.penalties[1])
        penalty[np.isin(points, soft)] = self.penalties[0]
        penalty[np.isin(points, doc_ends)] = 0
        return points, penalty

    def run(self, last: bool):
        if not self.docs:
            return
        ids = np.concatenate([d[3] for d in self.docs])
        ends = np.cumsum([len(d[3]) for d in self.docs])
        whole = np.array([d[2] + len(d[3]) == d[1] for d in self.docs])
        doc_ends = np.append(ends[whole], len(ids))       # the end of the run is a point in any case
        cuts = choose_cuts(*self.points(ids, doc_ends), self.max_len)
        if not last and len(cuts) > 1:
            cuts.pop()
        k, begin = 0, 0                                   # entry, first token of the sequence
        for cut in cuts:
            at = begin
            while at < cut:
                doc_id, total, start, part = self.docs[k]
                first = int(ends[k]) - len(part)
                stop = min(cut, int(ends[k]))
                yield doc_id, start + at - first, ids[at:stop], total, self.sequence, at - begin
                at = stop
                if at == ends[k]:
                    k += 1
            self.sequence += 1
            begin = cut
        rest = []
        for (doc_id, total, start, part), end in zip(self.docs[k:], ends[k:].tolist()):
            skip = max(0, begin - (end - len(part)))
            rest.append((doc_id, total, start + skip, part[skip:]))
        self.docs = rest
        self.held = len(ids) - begin


def pack(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", max_len: int = 1024,
         end_id: int = 0, run_tokens: int = 1 << 19, sentence_penalty: int = 2, hard_penalty: int = 24,
         hard_step: int = 128) -> DataFrame:
    """(doc_id, start, ids, doc_tokens, sequence_id, offset): one row per piece.

    ``ids``: the piece's ids as little-endian unsigned 32-bit numbers (binary). Every document
    is its ids and then ``end_id``; null and empty texts are the end id alone, so every row has
    at least one piece. Repeated rows are packed each; a null id stays null; an empty table
    gives an empty result; other columns are ignored. sequence_id: the partition's number times
    2^40 and the number within it."""
    spark = docs.sparkSession
    model_b = spark.sparkContext.broadcast(model)         # the tokenizer file: a few MB
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(it):
        base = TaskContext.get().partitionId() << 40
        tok = tokenizer_of(model_b.value, end_id)
        packer = Packer(tok.ends_sentence, max_len, run_tokens, sentence_penalty, hard_penalty, hard_step)
        rows: list[tuple] = []

        def flush(least):
            while len(rows) > least:
                part = rows[:2000]
                del rows[:2000]
                cols = list(zip(*part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                     pa.array([x.tobytes() for x in cols[2]], pa.binary()), pa.array(cols[3], pa.int64()),
                     pa.array([base + s for s in cols[4]], pa.int64()), pa.array(cols[5], pa.int64())], schema=schema)

        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                rows.extend(packer.add(doc_id, tok.encode(text.as_py())))
                yield from flush(2000)
        rows.extend(packer.run(True))
        yield from flush(0)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def with_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ``length`` and ``ids_crc32`` (of the ids' bytes) in front of the ids."""
    return pieces.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
                         F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")
