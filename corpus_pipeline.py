"""Corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of ``documents``. ``run`` writes each stage's result as Parquet in the shared
checkpoint folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import language_id, packing, simhash, substring_dedup
from flowlens.llm.catalog import tokenizer_file
from flowlens.llm.common import materialize
from flowlens.sources.tables import read_table


PACK_BYTES = 8 << 20           # text that a task gathers: the stages share the workers' memory


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language known from the labelled ones; others (no text, no letters, none of
    the languages) go. Fitted on the documents outside the held-out fold."""
    known = docs.where(F.col("doc_id").isNotNull() & ~language_id.held_out(F.col("doc_id")))
    return language_id.keep_known(docs, language_id.fit(known))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints (3-word shingles) link at 2 bits or fewer."""
    return simhash.keep_one(docs, shingle=3, max_bits=2, pack_bytes=PACK_BYTES)


def suffix_array_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeat an earlier 100-byte string.

    Every document stays, if only with an empty text (a null text stays null). Where a cut
    splits a character, its remaining bytes go too; n_chars is that of the new text."""
    return substring_dedup.cut_repeats(docs, length=100, pack_bytes=PACK_BYTES)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids."""
    pieces = packing.pack(docs, tokenizer_file("byte_bpe_50k.json"), max_len=1024, end_id=0)
    return packing.with_digests(pieces)


STAGES = [("language ID", language_stage), ("SimHash near-dedup", simhash_stage),
          ("suffix-array dedup", suffix_array_stage), ("packing", packing_stage)]

#: Languages are predicted by a fitted filter and ids come from a tokenizer, which SQL can't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs
