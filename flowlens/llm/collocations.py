"""Collocations per language: Toivonen's sampling method over word phrases, then exact scores.

1. Sample: every piece of text (a stretch between punctuation marks) is drawn with probability
   ``rate``. Phrases that reach a lowered support there are proposed; the support is lowered so far
   that a phrase with the full support misses it with a probability below ``miss``. Two jobs: all
   words and pairs first, then longer phrases whose pairs are all proposed.
2. Full pass: all words, the proposed phrases and their negative border (a phrase whose two
   subphrases, without the last and without the first word, are proposed) are counted exactly.
3. Border failures, phrases that reach the support without having been proposed, start a further pass
   that counts every longer phrase around a failure that has not been counted yet, until no failure
   has longer phrases left. Then the frequent phrases are complete: an uncounted one would
   hold a subphrase that is frequent, counted and not proposed.

Tasks know the proposed phrases through one bit table per length, addressed by a hash, of fixed size
(``filter_bits``): that is all that is broadcast, whatever the corpus. Two phrases that share a bit
only enlarge the border; counts are kept under the phrases themselves and are exact. With more
proposed phrases than bits the table prunes less, and results stay the same.

Tasks count pieces of about ``chunk_bytes`` of text on their own before the shuffle, so a common
phrase is one row per chunk.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import materialize, shuffle_parts
from flowlens.session import discard

CHUNK_BYTES = 12 << 20
FILTER_BITS = 26
BREAK = b"\xff"                # never part of UTF-8
NO_LANG = "und"

# The characters that end a piece
PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"

_FOLD = bytes(255 if c in PIECE_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))
_ROWS = "key string, n long"    # phrase, tab, language; phrases hold no tab


def lowered_support(support: int, rate: float, miss: float) -> int:
    """Largest sample support that a phrase with ``support`` occurrences misses with probability <= ``miss``."""
    below, t = 0.0, 0
    while t < support:
        below += comb(support, t) * rate ** t * (1 - rate) ** (support - t)
        if below > miss:
            break
        t += 1
    return max(t, 1)


def pieces_of(text: str | None) -> bytes:
    """The text with A-Z lower-cased and every piece end turned into ``BREAK``."""
    return text.encode().translate(_FOLD) if text else b""


def draw_pieces(folded: bytes, rate: float, seed: int) -> bytes:
    """Each piece with probability ``rate``, by a generator that depends on the text and ``seed`` alone."""
    pieces = folded.split(BREAK)
    keep = np.random.default_rng([xxhash.xxh64_intdigest(folded), seed & 0xFFFFFFFFFFFFFFFF]).random(len(pieces)) < rate
    return BREAK.join([pieces[i] for i in np.flatnonzero(keep).tolist()])


def lang_seed(lang: str) -> int:
    return xxhash.xxh32_intdigest(lang)


def word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = lang_seed(lang)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def lengthened(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word behind."""
    h = h * np.uint64(0x9E3779B97F4A7C15) + word
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


class Filter:
    """Bit tables, one per phrase length; ``has`` may say yes to a few phrases too many, never no to one put in."""

    def __init__(self, bits: int, tables: dict[int, bytes]):
        self.shift = np.uint64(64 - bits)
        self.tables = {k: np.frombuffer(t, np.uint8) for k, t in tables.items()}

    def has(self, k: int, h: np.ndarray) -> np.ndarray:
        if k not in self.tables:
            return np.zeros(len(h), bool)
        at = (h >> self.shift).astype(np.int64)
        return (self.tables[k][at >> 3] >> (at & 7).astype(np.uint8)) & 1 != 0


class Chunk:
    """Words of a chunk of one language: numbers (0: a piece end), their strings, their hashes."""

    def __init__(self, folded: Iterator[bytes], lang: str):
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        number[BREAK]
        arrays = []
        for t in folded:
            w = (t.replace(BREAK, b" \xff ") + b" \xff").split()
            arrays.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
        self.words = list(number)
        self.ids = np.concatenate(arrays) if arrays else np.zeros(0, np.int32)
        self.word_hash = word_hashes(self.words, lang)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)

    def first_level(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of words, and their numbers and hashes there."""
        at = np.flatnonzero(self.ids)
        return at, self.ids[at].astype(np.int64), self.word_hash[at]

    def grow(self, k: int, at: np.ndarray, cls: np.ndarray, h: np.ndarray, strings: list[bytes], ahead: np.ndarray):
        """From phrases of k - 1 words at positions ``at`` (numbered ``cls``) those of k words at ``at[ahead]``:
        positions, numbers, hashes, and per number the string and count."""
        at, cls, h = at[ahead], cls[ahead], h[ahead]
        last = at + (k - 1)
        h = lengthened(h, self.word_hash[last])
        key, cls, n = np.unique(cls * len(self.words) + self.ids[last], return_inverse=True, return_counts=True)
        strings = [strings[a] + b" " + self.words[b] for a, b in zip((key // len(self.words)).tolist(), (key % len(self.words)).tolist())]
        return at, cls, h, strings, n


def _next_to(at: np.ndarray, good: np.ndarray, n: int) -> np.ndarray:
    """Which of the positions are good, with a good one next to them."""
    mark = np.zeros(n + 1, bool)
    mark[at[good]] = True
    return good & mark[at + 1]


def count_pairs(chunk: Chunk, max_words: int):
    """(k, strings, counts) of all words and all pairs."""
    at, cls, h = chunk.first_level()
    n = np.bincount(cls, minlength=len(chunk.words))
    yield 1, chunk.words[1:], n[1:]
    if max_words > 1:
        *_, strings, n = chunk.grow(2, at, cls, h, chunk.words, _next_to(at, np.ones(len(at), bool), len(chunk.ids)))
        yield 2, strings, n


def count_long(chunk: Chunk, proposed: Filter, max_words: int):
    """Phrases of three words and more whose pairs are all proposed."""
    at, cls, h = chunk.first_level()
    size = len(chunk.ids)
    at, cls, h, strings, _ = chunk.grow(2, at, cls, h, chunk.words, _next_to(at, np.ones(len(at), bool), size))
    good = proposed.has(2, h)
    pair = np.zeros(size + max_words, bool)
    pair[at[good]] = True
    for k in range(3, max_words + 1):
        ahead = pair[at] & pair[at + k - 2]
        at, cls, h, strings, n = chunk.grow(k, at, cls, h, strings, ahead)
        yield k, strings, n


def count_bordered(chunk: Chunk, proposed: Filter, max_words: int):
    """All words, and phrases without whose first and without whose last word a proposed phrase is left."""
    at, cls, h = chunk.first_level()
    n = np.bincount(cls, minlength=len(chunk.words))
    yield 1, chunk.words[1:], n[1:]
    strings = chunk.words
    for k in range(2, max_words + 1):
        at, cls, h, strings, n = chunk.grow(k, at, cls, h, strings, _next_to(at, proposed.has(k - 1, h), len(chunk.ids)))
        yield k, strings, n


def count_around(chunk: Chunk, proposed: Filter, failed: Filter, frequent: Filter, max_words: int):
    """Phrases of frequent words that hold a failure of fewer words and were not counted by ``count_bordered``."""
    size = len(chunk.ids)
    every = np.zeros(size + max_words, bool)               # phrases of k words, all frequent
    at, _, h = chunk.first_level()
    every[at[frequent.has(1, h)]] = True
    word_ok = every.copy()
    hashes = np.zeros(size + max_words, np.uint64)
    hashes[:size] = chunk.word_hash
    counted = np.zeros(size + max_words, bool)             # counted in the full pass
    counted[at] = True
    holds = np.zeros(size + max_words, bool)               # holds a failure, itself included
    holds[at] = failed.has(1, h)
    for k in range(2, max_words + 1):
        before = counted & False
        live = np.flatnonzero(counted)
        before[live] = proposed.has(k - 1, hashes[live])
        counted = before.copy()
        counted[:-1] &= before[1:]
        every[:size + max_words - k + 1] &= word_ok[k - 1:]
        every[size:] = False
        around = holds.copy()
        around[:-1] |= holds[1:]
        around &= every
        live = np.flatnonzero(every | counted)
        grown = np.zeros_like(hashes)
        grown[live] = lengthened(hashes[live], hashes_of_word(chunk, live + k - 1))
        hashes = grown
        new = np.flatnonzero(around & ~counted)
        if len(new):
            rows, n = np.unique(np.stack([chunk.ids[new + j] for j in range(k)], 1), axis=0, return_counts=True)
            yield k, [b" ".join([chunk.words[w] for w in r]) for r in rows.tolist()], n
        holds = around
        live = np.flatnonzero(every)
        holds[live] |= failed.has(k, hashes[live])


def hashes_of_word(chunk: Chunk, at: np.ndarray) -> np.ndarray:
    return chunk.word_hash[np.minimum(at, len(chunk.word_hash) - 1)]


class Miner:
    """The passes over one table of documents."""

    def __init__(self, docs: DataFrame, support: int, max_words: int, rate: float, miss: float, filter_bits: int, chunk_bytes: int):
        self.docs, self.support, self.max_words, self.rate = docs, support, max_words, rate
        self.lowered = lowered_support(support, rate, miss)
        self.filter_bits, self.chunk_bytes = filter_bits, chunk_bytes
        self.spark = docs.sparkSession
        self.passes = 0

    def counted(self, counter, *filters: Filter | None, sample: bool = False) -> DataFrame:
        """(lang, words, phrase, n): the counts that ``counter(chunk, *filters)`` finds, summed over the corpus.
        Rows with words = 0 hold the number of words of a language."""
        self.passes += not sample
        max_words, chunk_bytes, rate, bits = self.max_words, self.chunk_bytes, self.rate, self.filter_bits
        sent = self.spark.sparkContext.broadcast([f and {k: t.tobytes() for k, t in f.tables.items()} for f in filters])

        def flush(held: dict[str, list[bytes]]):
            tables = [Filter(bits, f) for f in sent.value]
            for lang, folded in held.items():
                chunk = Chunk(iter(folded), lang)
                folded.clear()
                if not sample:
                    yield _rows(lang, [b""], np.array([np.count_nonzero(chunk.ids)]))
                for _, strings, n in counter(chunk, *tables, max_words):
                    for i in range(0, len(strings), 100_000):
                        yield _rows(lang, strings[i:i + 100_000], n[i:i + 100_000])

        def run(it):
            held: dict[str, list[bytes]] = {}
            size = 0
            for b in it:
                for doc_id, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                    folded = pieces_of(text.as_py())
                    if sample and folded:
                        folded = draw_pieces(folded, rate, doc_id or 0)
                    if not folded:
                        continue
                    parts = [folded] if len(folded) <= chunk_bytes else _cut(folded, chunk_bytes)
                    for part in parts:
                        held.setdefault(lang, []).append(part)
                        size += len(part)
                        if size >= chunk_bytes:
                            yield from flush(held)
                            held, size = {}, 0
            if held:
                yield from flush(held)

        # chunks are summed already: dealt out as they are, without another map-side sum that holds them in memory
        summed = (self.docs.mapInArrow(run, _ROWS).repartition(shuffle_parts(self.spark), "key")
                  .groupBy("key").agg(F.sum("n").alias("n")))
        # filters on n and words come before the key is parted
        phrase = F.substring_index("key", "\t", 1)
        return summed.select(F.expr("substr(key, instr(key, '\t') + 1)").alias("lang"),
                             F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " "))).alias("words"), phrase.alias("phrase"), "n")

    def filter_of(self, phrases: DataFrame, words: list[int]) -> Filter:
        """Bit tables of the phrases of the given lengths. Built by slices of the table, so the driver gets
        2^filter_bits bits a length, whatever the number of phrases."""
        bits = self.filter_bits
        slices = 1 << min(6, bits - 3)
        width = (1 << bits) // slices

        def places(it):
            for b in it:
                lang, k, phrase = (c.to_pylist() for c in b.columns)
                at = np.fromiter((phrase_hash(p, x) >> (64 - bits) for p, x in zip(phrase, lang)), np.int64, len(phrase))
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(at // width, pa.int32()), pa.array(at % width, pa.int32())],
                                                 names=["words", "slice", "bit"])

        def table(t: pa.Table) -> pa.Table:
            on = np.zeros(width, bool)
            on[t.column("bit").to_numpy()] = True
            return pa.table([t.column("words").slice(0, 1), t.column("slice").slice(0, 1),
                             pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())], names=["words", "slice", "bits"])

        found = (phrases.where(F.col("words").isin(words)).select("lang", "words", "phrase").mapInArrow(places, "words int, slice int, bit int")
                 .distinct().groupBy("words", "slice").applyInArrow(table, "words int, slice int, bits binary").collect())
        tables = {k: np.zeros((slices, width // 8), np.uint8) for k in words}
        for r in found:
            tables[r.words][r.slice] = np.frombuffer(r.bits, np.uint8)
        return Filter(bits, {k: t.tobytes() for k, t in tables.items()})

    def proposals(self) -> tuple[DataFrame, list[DataFrame]]:
        enough = F.col("n") >= self.lowered
        short = materialize(self.counted(count_pairs, sample=True).where(enough), "proposed")
        if self.max_words < 3:
            return short, [short]
        pairs = self.filter_of(short, [2])
        long = materialize(self.counted(count_long, pairs, sample=True).where(enough), "proposed")
        return short.unionByName(long), [short, long]

    def frequent(self) -> DataFrame:
        """(lang, words, phrase, n) of all phrases of up to ``max_words`` words that reach the support, and the
        numbers of words as rows with words = 0; a written table."""
        proposed, tables = self.proposals()
        levels = list(range(1, self.max_words))
        known = self.filter_of(proposed, levels) if levels else Filter(self.filter_bits, {})
        enough = (F.col("n") >= self.support) | (F.col("words") == 0)
        found = materialize(self.counted(count_bordered, known).where(enough), "frequent")
        shorter = F.col("words").between(1, self.max_words - 1)
        failures = materialize(found.where(shorter).join(proposed, ["lang", "words", "phrase"], "left_anti"), "failures")
        tables += [failures]
        if not failures.isEmpty():
            # every phrase around a failure that the full pass has not counted: what this pass finds
            # frequent has no failures of its own, all its longer phrases being counted here too
            parts = [found, materialize(self.counted(count_around, known, self.filter_of(failures, levels), self.filter_of(found, [1]))
                                        .where((F.col("n") >= self.support) & (F.col("words") > 0)), "frequent")]
            found = materialize(parts[0].unionByName(parts[1]), "frequent")
            tables += parts
        for t in tables:
            discard(t)
        return found


def _cut(folded: bytes, size: int) -> list[bytes]:
    """Parts that end with a piece; a longer piece stays whole."""
    parts, at = [], 0
    while len(folded) - at > size:
        end = folded.find(BREAK, at + size)
        if end < 0:
            break
        parts.append(folded[at:end])
        at = end + 1
    return parts + [folded[at:]]


def phrase_hash(phrase: str, lang: str) -> int:
    """``lengthened`` over the words of one phrase."""
    seed, mask = lang_seed(lang), (1 << 64) - 1
    words = [xxhash.xxh64_intdigest(w, seed) for w in phrase.encode().split(b" ")]
    h = words[0]
    for w in words[1:]:
        h = (h * 0x9E3779B97F4A7C15 + w) & mask
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & mask
    return h


def _rows(lang: str, strings: list[bytes], n: np.ndarray) -> pa.RecordBatch:
    end = b"\t" + lang.encode()
    return pa.RecordBatch.from_arrays([pa.array([p + end for p in strings], pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64))],
                                      names=["key", "n"])


def score_phrases(found: DataFrame, max_words: int) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of all frequent phrases of two words and more, by the lowest-scoring cut.

    1000 * a * n and l * r are decimals of 38 digits, exact up to a, l, r and n of 10^15 or more."""
    counts = found.where("words > 0").select("lang", "phrase", F.col("n").alias("count"))
    total = found.where("words = 0").select("lang", "n")
    cuts = (found.where("words > 1").select("lang", "phrase", "words", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut"))
            .withColumn("first", F.expr("substring_index(phrase, ' ', cut)")).withColumn("rest", F.expr("substring_index(phrase, ' ', cut - words)")))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("count").alias("l")), ["lang", "first"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("rest"), F.col("count").alias("r")), ["lang", "rest"])
    scored = cuts.join(total, "lang").withColumn("score", F.expr(
        "(cast(1000 as decimal(4, 0)) * cast(a as decimal(16, 0)) * cast(n as decimal(16, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0)))"))
    best = scored.groupBy("lang", "phrase", "words", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "n", "best.score")


def drop_contained(phrases: DataFrame) -> DataFrame:
    """Without phrases that a longer one holds and that never occur outside it.

    A phrase between the two in length then has the same count, so phrases one word longer tell."""
    longer = phrases.where("words > 2")
    part = F.explode(F.array(F.expr("substring_index(phrase, ' ', words - 1)"), F.expr("substring_index(phrase, ' ', 1 - words)"))).alias("phrase")
    return phrases.join(longer.select("lang", part, "a"), ["lang", "phrase", "a"], "left_anti")


def first_of_each(phrases: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language, with ``rank``: chosen by hash parts first, so that no task
    sorts more than a share of a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    wide = max(shuffle_parts(phrases.sparkSession), 16)
    part = F.pmod(F.xxhash64("phrase"), F.lit(wide))
    for p in (part, F.pmod(part, F.lit(int(wide ** 0.5)))):
        phrases = phrases.withColumn("_part", p).withColumn("_rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
        phrases = phrases.where(F.col("_rank") <= top).drop("_part", "_rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return phrases.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def mine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", support: int = 100, max_words: int = 5,
         top: int = 2000, rate: float = 0.25, miss: float = 1e-2, filter_bits: int = FILTER_BITS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``max_words`` words.

    A-Z are lower-cased; pieces end at ``.,;:!?`` and line ends, words are runs of other than space and tab.
    Phrases that occur ``support`` times are candidates; of a candidate's cuts the one of lowest score
    floor(1000 * a * n / (l * r)) counts (ties: the shorter first part). A candidate that a longer
    one holds with the same count is dropped. Order: score, then a, descending, then the phrase's bytes.
    Null languages are ``und``; null, empty and blank texts add nothing; repeated rows count each; an empty
    table gives an empty result; other columns are ignored, whatever their names. Counts are exact over all
    rows: the sample only proposes."""
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
                      F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text"))
    found = Miner(src, support, max_words, rate, miss, filter_bits, chunk_bytes).frequent()
    phrases = drop_contained(score_phrases(found, max_words))
    return first_of_each(phrases, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
