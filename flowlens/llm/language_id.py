"""Language identification by one bit-sliced Bloom filter over byte n-grams.

Fitting: from a bounded sample of labelled documents, each language keeps the n-grams that
at least ``min_share`` of its documents hold (and at least ``min_ratio`` of the share in the
language where the n-gram is most usual). A document holds a bounded number of n-grams, so
``min_share`` bounds the number kept. The filter is a table of slots; a slot is a bit mask
with one bit per language, and an n-gram sets its languages' bits in ``HASHES`` slots.

Prediction: the AND of an n-gram's slots is the set of languages that (seem to) hold it.
Per language the hits over all n-grams of the text are counted and corrected by the known
rate of false positives f (the share of its set bits to the power of ``HASHES``):
(hits / n - f) / (1 - f). The largest corrected share decides and is the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from flowlens.llm.common import free_name

GRAM = 4
HASHES = 2
CHUNK_BYTES = 1 << 17
# Odd multipliers of the slot hashes
_FACTORS = (0x9E3779B1, 0x85EBCA77)
# a-z and bytes of other than ASCII characters belong to words; all else separates them
_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[ord("a"):ord("z") + 1] = True
_WORD_BYTE[128:] = True


def has_letter(text: str) -> bool:
    """Whether the text holds a letter of any script; digits, fractions and other numbers are none."""
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    """``table``: (slots, words) unsigned masks; ``languages`` by bit; ``false_rates`` per language."""
    table: np.ndarray
    languages: list
    false_rates: list


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (uint32) of texts, lower-cased, with single spaces around and between words;
    and the number of each text's n-grams. Inside an n-gram of four there is no space."""
    raw = [b" " + t.lower().encode("utf-8") + b" " for t in texts]
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
    b = np.frombuffer(b"".join(raw), np.uint8)
    word = _WORD_BYTE[b]
    begins = np.concatenate([[0], ends[:-1]])
    keep = word.copy()
    keep[1:] |= word[:-1]                      # the first separator behind a word
    keep[begins] = True
    kept = np.cumsum(keep)
    b, word = np.where(word, b, np.uint8(32))[keep], word[keep]
    ends = kept[ends - 1] if len(ends) else ends
    n = len(b) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    x = b.astype(np.uint32)
    g = x[:n] | (x[1:n + 1] << np.uint32(8)) | (x[2:n + 2] << np.uint32(16)) | (x[3:n + 3] << np.uint32(24))
    inner = word[1:n + 1] & word[2:n + 2]
    upto = np.concatenate([[0], np.cumsum(inner)])
    # no n-gram crosses a text: texts begin and end with a space, and none is inside
    bounds = np.concatenate([[0], np.minimum(ends, n)])
    return g[inner], np.diff(upto[bounds])


def _slots(g: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((g ^ (g >> np.uint32(15))) * np.uint32(f)) >> np.uint32(32 - bits) for f in _FACTORS[:HASHES]]


def build_model(grams: dict[str, np.ndarray], bits: int | None = None) -> LanguageModel:
    """Filter over the n-grams of each language (any number of languages, 64 to a word)."""
    languages = sorted(grams)
    total = sum(len(v) for v in grams.values())
    bits = bits or min(26, max(16, (8 * total).bit_length()))
    width = max(1, -(-len(languages) // 64))
    kind = next(k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (10**9, np.uint64)) if len(languages) <= n)
    table = np.zeros((1 << bits, width), kind)
    for i, name in enumerate(languages):
        for s in _slots(grams[name].astype(np.uint32), bits):
            table[s, i // 64] |= kind(1 << (i % 64))
    rates = [float(((table[:, i // 64] >> kind(i % 64)) & kind(1)).mean()) ** HASHES for i in range(len(languages))]
    return LanguageModel(table, languages, rates)


def score_texts(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """(texts, languages): corrected share of each text's n-grams that each language holds."""
    g, count = grams_of(texts)
    out = np.zeros((len(texts), len(model.languages)))
    bits = (len(model.table) - 1).bit_length()
    s = _slots(g, bits)
    has = np.flatnonzero(count > 0)
    begins = (np.cumsum(count) - count)[has]
    for i, f in enumerate(model.false_rates):
        if i % 64 == 0:
            mask = model.table[s[0], i // 64]
            for x in s[1:]:
                mask = mask & model.table[x, i // 64]
        if len(has):
            hits = np.add.reduceat((mask >> mask.dtype.type(i % 64)) & mask.dtype.type(1), begins, dtype=np.int64)
            out[has, i] = np.clip((hits / count[has] - f) / (1 - f), 0, 1)
    return out


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id",
        max_docs: int = 2000, min_share: float = 0.01, min_ratio: float = 0.2) -> LanguageModel:
    """Fit on about ``max_docs`` documents of each language, chosen by a hash of their id.

    Rows with null language or text are not used. No labelled row: a model without languages."""
    spark = labelled.sparkSession
    src = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = {r[0]: r[1] for r in src.groupBy("lang").count().collect()}      # one row per language
    if not sizes:
        return build_model({})
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, max_docs / n))])
    sample = src.where(F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("docs", pa.int64())])

    def counted(it):
        held: dict[str, list] = {}
        for b in it:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(lang, []).append(np.unique(grams_of([text])[0]))
                if len(held[lang]) >= 500:
                    yield from rows(lang, held.pop(lang))
        for lang, x in held.items():
            yield from rows(lang, x)

    def rows(lang, lists):
        g, n = np.unique(np.concatenate(lists), return_counts=True)
        # -1 counts the documents
        yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(g) + 1)), pa.array(np.append(g.astype(np.int64), -1)),
                                          pa.array(np.append(n.astype(np.int64), len(lists)))], schema=schema)

    counts = sample.select("lang", "text").mapInArrow(counted, "lang string, gram long, docs long")
    counts = counts.groupBy("lang", "gram").agg(F.sum("docs").alias("docs"))
    # at most (n-grams of a document) / min_share rows of a language pass this
    docs = F.sum(F.when(F.col("gram") == -1, F.col("docs"))).over(_by("lang"))
    kept = (counts.withColumn("share", F.col("docs") / docs).where((F.col("gram") >= 0) & (F.col("share") >= min_share)))
    pdf = kept.select("lang", "gram", "share").toPandas()
    best = pdf.groupby("gram")["share"].transform("max")
    pdf = pdf[pdf["share"] >= min_ratio * best]
    return build_model({k: v["gram"].to_numpy() for k, v in pdf.groupby("lang")})


def _by(col: str):
    from pyspark.sql import Window
    return Window.partitionBy(col)


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) added; columns of these names are replaced.

    ``und`` (score 0) if the text is null or has no letter, or if the model has no language.
    Ties go to the first language in alphabetical order. Every row stays, repeated or not."""
    model_b = docs.sparkSession.sparkContext.broadcast(model)       # at most 2^26 slots
    base = docs.drop("lang_pred", "score")
    fields, at_text = base.schema.fields, base.columns.index(text_col)
    plain = [f"c{i}" for i in range(len(fields))]        # Arrow functions can't take names with dots

    def run(it):
        m = model_b.value
        names = np.array(m.languages, object)
        for b in it:
            texts = b.column(at_text).to_pylist()
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            some = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if len(names) else []
            at = 0
            while at < len(some):
                to, size = at, 0
                while to < len(some) and (to == at or size + len(texts[some[to]]) <= CHUNK_BYTES):
                    size += len(texts[some[to]])
                    to += 1
                part = some[at:to]
                s = score_texts(m, [texts[i] for i in part])
                pred[part], score[part] = names[s.argmax(axis=1)], s.max(axis=1)
                at = to
            cols = [b.column(i) for i in range(b.num_columns)] + [pa.array(pred.tolist(), pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "lang_pred", "score"])

    schema = StructType([StructField(p, f.dataType) for p, f in zip(plain, fields)]).add("lang_pred", "string").add("score", "double")
    got = base.select(*[F.col(f"`{f.name}`").alias(p) for p, f in zip(plain, fields)]).mapInArrow(run, schema)
    return got.select(*[F.col(p).alias(f.name) for p, f in zip(plain, fields)], "lang_pred", "score")


def held_out(id_col: Column) -> Column:
    """Fold 2 of 4 by the CRC-32 of the id as text; a null id is in no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_known(docs: DataFrame, model: LanguageModel, text_col: str = "text", min_score: float = 0.1,
               short: int = 32) -> DataFrame:
    """The documents whose language is found with a score of at least ``min_score``; same columns.

    Texts of fewer than ``short`` characters say too little to reject them: they stay if they have a letter.
    Null texts go; repeated rows are judged alike. Other columns may have any name. An empty table gives an empty one."""
    aside = {c: free_name([*docs.columns, "lang_pred", "score"], f"_{c.lower()}") for c in docs.columns if c.lower() in ("lang_pred", "score")}
    got = predict(docs.withColumnsRenamed(aside), model, text_col)
    known = (F.col("score") >= min_score) | (F.length(text_col) < short)
    got = got.where((F.col("lang_pred") != "und") & known)
    return got.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])
