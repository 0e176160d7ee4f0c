"""CSV records with line breaks inside quoted fields, put together in parallel.

The text is read line by line in blocks (Spark's file splits). Whether a line starts inside an open
quote depends on all lines before it, so each block is first summed up by two facts: how it ends
if it starts outside a quote, and how if it starts inside one. Chained along a file (one row per
block) these give every block's true start. A second pass then puts records together block by
block; only the fragments at block borders, at most two a block, are shuffled and joined.

Quotes count where a field starts with one; a quote later in an unquoted field is a plain
character. ``escape`` is the character that hides a quote inside a quoted field: a backslash,
or the quote itself (doubled quotes). Line breaks inside a field become ``\\n``. Blank lines
between records go. A file that ends inside an open quote has no sound record after it: ``survey``
reports it.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BROADCAST = 500_000      # blocks that start inside a quote, sent to the tasks; more are joined by shuffle
BATCH = 4096                   # records that a task hands on at a time


def lines_of(spark: SparkSession, paths) -> DataFrame:
    """(file, at, i, value): every line; ``at`` names its block, ``i`` orders the lines of a block."""
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("i"), "value")


class LineScanner:
    """Whether a line ends inside an open quote, given whether it starts inside one."""

    def __init__(self, escape: str = "\\"):
        inside = r'(?:[^"]|"")*+' if escape == '"' else rf'(?:[^"{re.escape(escape)}]|{re.escape(escape)}.|{re.escape(escape)}$)*+'
        self._inside = re.compile(inside, re.S)
        # whole fields, each up to its comma, then a quoted field that isn't closed
        self._leaves_open = re.compile(rf'(?:(?:"{inside}"[^,]*+|[^",][^,]*+)?+,)*+"{inside}', re.S)

    def __call__(self, line: str, inside: bool) -> bool:
        at = 0
        if inside:
            at = self._inside.match(line).end()
            if at == len(line):
                return True
            at = line.find(",", at + 1) + 1
            if at == 0:
                return False
        return self._leaves_open.fullmatch(line, at) is not None


def survey(lines: DataFrame, escape: str = "\\") -> DataFrame:
    """One row per block: file, at, head (its first line), n_lines, inside (whether it starts inside a
    quote), and of its file: broken (some record has a line break) and unclosed (it ends inside a quote).

    Lines without a quote change nothing and stay out of Python."""
    def sums(it):
        scan, key, ends, opened = LineScanner(escape), None, None, False
        cols = ["file", "at", "if_out", "if_in", "opened"]
        for pdf in it:
            out = []
            for file, at, value in zip(pdf["file"], pdf["at"], pdf["value"]):
                if (file, at) != key:
                    if key is not None:
                        out.append((*key, *ends, opened))
                    key, ends, opened = (file, at), (False, True), False
                ends = tuple(scan(value, e) for e in ends)
                opened = opened or ends[0]
            yield pd.DataFrame(out, columns=cols)
        if key is not None:
            yield pd.DataFrame([(*key, *ends, opened)], columns=cols)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, starts = pdf.sort_values("at"), False, []
        for if_out, if_in in zip(pdf["if_out"], pdf["if_in"]):
            starts.append(state)
            state = bool(if_in if state else if_out)
        # were no block to open a quote when it starts outside one, no block would start inside one
        return pdf[["file", "at", "head", "n_lines"]].assign(inside=starts, broken=bool(pdf["opened"].any()), unclosed=state)

    blocks = lines.groupBy("file", "at").agg(F.min_by("value", "i").alias("head"), F.count(F.lit(1)).alias("n_lines"))
    quoted = lines.where(F.col("value").contains('"')).select("file", "at", "value").mapInPandas(
        sums, "file string, at long, if_out boolean, if_in boolean, opened boolean")
    # one row per block of a file
    return blocks.join(quoted, ["file", "at"], "left").select(
        "file", "at", "head", "n_lines", F.coalesce("if_out", F.lit(False)).alias("if_out"),
        F.coalesce("if_in", F.lit(True)).alias("if_in"), F.coalesce("opened", F.lit(False)).alias("opened")
    ).groupBy("file").applyInPandas(
        chain, "file string, at long, head string, n_lines long, inside boolean, broken boolean, unclosed boolean")


def records(lines: DataFrame, starts: DataFrame, save, escape: str = "\\") -> DataFrame:
    """(file, text, first): the records of the files in ``starts`` (file, at, inside; every block of
    a file); ``first`` marks a file's first one. ``save`` writes a frame and reads it back."""
    few = all(x.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
              for x in (starts.where("inside"), starts.select("file").distinct()))
    if few:
        files = F.broadcast(starts.select("file").distinct())
        mid = F.broadcast(starts.where("inside"))
        # map-side joins: the lines keep the order in which they are read
        tagged = lines.join(files, "file", "left_semi").join(mid, ["file", "at"], "left") \
            .withColumn("inside", F.coalesce("inside", F.lit(False)))
    else:
        tagged = lines.join(starts, ["file", "at"]).repartition("file", "at").sortWithinPartitions("file", "at", "i")

    def gather(it):
        """kind 0: whole record; 1: begins here, goes on in the next block; 2: goes on from the block before."""
        scan, key, seq, parts, kind, inside, out = LineScanner(escape), None, 0, [], 0, False, []

        def flush():
            nonlocal seq, parts, kind
            if parts and (kind or parts != [""]):
                out.append((*key, seq, kind, "\n".join(parts)))
                seq += 1
            parts, kind = [], 0

        for pdf in it:
            for file, at, value, starts_in in zip(pdf["file"], pdf["at"], pdf["value"], pdf["inside"]):
                if (file, at) != key:
                    if inside and not kind:
                        kind = 1                # still open where the block ends
                    flush()
                    key, seq, inside = (file, at), 0, bool(starts_in)
                    kind = 2 if inside else 0
                parts.append(value)
                if '"' in value:
                    inside = scan(value, inside)
                if not inside:
                    flush()
            if len(out) >= BATCH:
                yield pd.DataFrame(out, columns=["file", "at", "seq", "kind", "text"])
                out = []
        if inside and not kind:
            kind = 1
        flush()
        yield pd.DataFrame(out, columns=["file", "at", "seq", "kind", "text"])

    cols = tagged.select("file", "at", "value", "inside")
    made = save(cols.mapInPandas(gather, "file string, at long, seq long, kind int, text string"))
    whole = made.where("kind = 0").select("file", "at", "seq", "text")
    # at most two fragments a block; one that begins a record opens a new group
    order = Window.partitionBy("file").orderBy("at", "seq")
    groups = made.where("kind > 0").withColumn("g", F.sum((F.col("kind") == 1).cast("int")).over(order))
    joined = groups.groupBy("file", "g").agg(F.sort_array(F.collect_list(F.struct("at", "seq", "text"))).alias("f")).select(
        "file", F.col("f")[0]["at"].alias("at"), F.col("f")[0]["seq"].alias("seq"), F.array_join("f.text", "\n").alias("text"))
    every = whole.unionByName(joined)
    # a file's first record: the least place, one row per file
    least = every.groupBy("file").agg(F.min(F.struct("at", "seq")).alias("__least"))
    return every.join(least, "file").select("file", "text", (F.struct("at", "seq") == F.col("__least")).alias("first"))
