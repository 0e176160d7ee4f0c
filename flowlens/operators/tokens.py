"""Token windows over serialised text: data-derived vocabulary, ids, padding, mask.

Tokens are regex matches (``functions.text.TOKEN_PATTERN``) over the WHOLE text;
the window keeps the first ``max_length`` ids (truncation is the operator's
contract) and ``token_budget`` reports what the window loses.

Scale: token frequencies are Zipf-skewed (',' is in every row), so the id
lookup must not send all rows of a token to one task. A vocabulary under
``BROADCAST_LIMIT`` entries (counted first) goes to the tasks; with a larger one,
the rows of hot tokens (counted from the token rows themselves) are looked up
from a bounded broadcast and the rest are joined by shuffle (``hot_key_join``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.text import tokens
from flowlens.operators.ranks import string_rank
from flowlens.operators.skew import hot_key_join

PAD_ID = 0
UNK_ID = 1
BROADCAST_LIMIT = 200_000


SLICE_ROWS = 1024        # rows whose tokens are numbered at once in a task


def token_codes(batch: pa.RecordBatch, col: str):
    """Slices of a batch: (rows, row of each token, distinct tokens, number of each token among them)."""
    for s in range(0, batch.num_rows, SLICE_ROWS):
        rows = batch.slice(s, SLICE_ROWS)
        lists = rows.column(rows.schema.get_field_index(col))
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        coded = lists.flatten().dictionary_encode()
        yield rows, np.repeat(np.arange(len(rows)), sizes), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def token_runs(batch: pa.RecordBatch, col: str):
    """Like ``token_codes``, each token of a row once, with its number of occurrences there."""
    for rows, row, names, code in token_codes(batch, col):
        key, n = np.unique(row * max(len(names), 1) + code, return_counts=True)
        yield rows, key // max(len(names), 1), names, key % max(len(names), 1), n


def _toks(col: str, tokens_col: str | None):
    return F.col(tokens_col) if tokens_col else tokens(col)


def tokenize(df: DataFrame, col: str = "text", out: str = "tokens") -> DataFrame:
    """Adds ``out`` = the regex tokens of the whole text (materialise it when several
    passes follow, so the regex runs once per document)."""
    return df.withColumn(out, tokens(col))


def build_vocab(df: DataFrame, col: str = "text", tokens_col: str | None = None) -> DataFrame:
    """(token, id): distinct tokens in byte order, ids from 2 (0 = pad, 1 = unknown)."""
    toks = df.select(F.explode(_toks(col, tokens_col)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("__n"))
    # exact byte-order rank of the distinct tokens, bucketed (no single-task window)
    ranked = string_rank(toks, "token", (), "__r")
    return ranked.select("token", (F.col("__r") + 1).cast("int").alias("id"))


def _number_in_rows(df: DataFrame, col: str, vocab: DataFrame, key: str, max_length: int, tokens_col: str | None) -> DataFrame:
    ids_b = df.sparkSession.sparkContext.broadcast({r["token"]: r["id"] for r in vocab.collect()})   # at most BROADCAST_LIMIT
    tok = df.select(F.col(key), F.size(_toks(col, tokens_col)).cast("int").alias("n_tokens"),
                    F.slice(_toks(col, tokens_col), 1, max_length).alias("__t"))
    fields = [tok.schema[key], tok.schema["n_tokens"], T.StructField("input_ids", T.ArrayType(T.IntegerType())),
              T.StructField("attention_mask", T.ArrayType(T.IntegerType()))]

    def run(it):
        ids = ids_b.value
        for whole in it:
            for b, row, names, code in token_codes(whole, "__t"):
                known = np.array([ids.get(x, UNK_ID) for x in names.to_pylist()], np.int32)
                place = np.arange(len(row)) - np.searchsorted(row, row)           # in its row
                out = np.full((len(b), max_length), PAD_ID, np.int32)
                mask = np.zeros((len(b), max_length), np.int32)
                out[row, place], mask[row, place] = known[code], 1
                at = pa.array(np.arange(len(b) + 1, dtype=np.int32) * max_length)
                lists = [pa.ListArray.from_arrays(at, pa.array(x.ravel())) for x in (out, mask)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], names=[key, "n_tokens", "input_ids", "attention_mask"])

    return tok.mapInArrow(run, T.StructType(fields))


def _lookup(exploded: DataFrame, vocab: DataFrame) -> DataFrame:
    token_rows = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("__rows"))
    return hot_key_join(exploded, vocab, ["token"], token_rows, "__rows", "left")


def token_window(df: DataFrame, col: str, vocab: DataFrame, key: str = "row_id", max_length: int = 512,
                 tokens_col: str | None = None) -> DataFrame:
    """(key, n_tokens, input_ids array<int>[max_length], attention_mask array<int>[max_length]).

    A vocabulary of at most ``BROADCAST_LIMIT`` tokens (counted first) goes to the tasks as a
    dictionary, and each row is numbered where it is: no token row, no exchange. With a larger one
    the tokens are joined by shuffle, hot tokens from a bounded broadcast."""
    if vocab.limit(BROADCAST_LIMIT + 1).count() <= BROADCAST_LIMIT:
        return _number_in_rows(df, col, vocab, key, max_length, tokens_col)
    tok = df.select(F.col(key).alias("__key"), _toks(col, tokens_col).alias("__t"))
    counts = tok.select("__key", F.size("__t").cast("int").alias("n_tokens"))
    exploded = tok.select("__key", F.posexplode(F.slice("__t", 1, max_length)).alias("pos", "token"))
    ided = _lookup(exploded, vocab).select("__key", "pos", F.coalesce("id", F.lit(UNK_ID)).alias("id"))
    seqs = ided.groupBy("__key").agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("__s"))
    ids = F.transform("__s", lambda s: s["id"])
    seqs = seqs.select("__key", ids.alias("__ids"))
    joined = counts.join(seqs, "__key", "left")
    got = F.coalesce(F.col("__ids"), F.array().cast("array<int>"))
    pad = F.lit(max_length) - F.size(got)
    input_ids = F.concat(got, F.array_repeat(F.lit(PAD_ID), pad))
    mask = F.concat(F.array_repeat(F.lit(1), F.size(got)), F.array_repeat(F.lit(0), pad))
    return joined.select(F.col("__key").alias(key), "n_tokens", input_ids.alias("input_ids"), mask.alias("attention_mask"))


def token_budget(df: DataFrame, col: str = "text", max_length: int = 512) -> DataFrame:
    """Rows over the window and tokens the window drops, over the whole texts."""
    n = F.size(tokens(col))
    staged = df.select(n.alias("__n"))
    return staged.agg(F.count(F.lit(1)).alias("n_rows"),
                      F.sum(F.when(F.col("__n") > max_length, 1).otherwise(0)).cast("bigint").alias("n_over"),
                      F.sum("__n").cast("bigint").alias("tokens_total"),
                      F.sum(F.greatest(F.col("__n") - F.lit(max_length), F.lit(0))).cast("bigint").alias("tokens_lost"),
                      F.max("__n").cast("bigint").alias("max_tokens"))
