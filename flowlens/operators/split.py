"""Exact-size, reproducible splits, samples, folds and batches.

Contract (SURVEY 2.10): sizes are exact, strata are exact, and the row choice
is a pure function of (seed, row key), so Spark and SQL pick the same rows.
``randomSplit`` / ``sampleBy`` are Bernoulli and cannot give exact sizes.

Scale: ranking by md5 inside a two-valued label would make two giant window
tasks. ``_cut_assign`` counts rows per (class, hash prefix), finds the prefix
bucket where each class quota is crossed, and ranks only the rows of that one
bucket; every other row is decided by comparing its prefix with the cut. The
prefix grows with the row count (4 hex digits up to ~10^11 rows, then 5, ...).
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.exprs import stable_hash
from flowlens.operators.ranks import hash_rank, hex_digits_for, join_small, ordered_rank


def _frac(f) -> Fraction:
    return Fraction(str(f)) if not isinstance(f, Fraction) else f


def quotas_from_counts(counts: DataFrame, test_fraction, first: str = "train") -> DataFrame:
    """Per-class (__class, n, n_train, n_test) from a (__class, n) table.

    n_test = ceil(f * N) overall; the ``first`` part's class counts follow the largest
    remainder (ties: smaller label first). One row per class: the windows here run
    over the class table only.
    """
    f = _frac(test_fraction)
    wall = Window.partitionBy()
    total = F.sum("n").over(wall)
    # n_test = ceil(N * num / den) in integer arithmetic (div, not /, which divides doubles)
    n_test_all = f"((__tot * {f.numerator} + {f.denominator - 1}) div {f.denominator})"
    staged = counts.select("__class", "n", total.alias("__tot"))
    staged = staged.select("*", F.expr(n_test_all if first == "test" else f"__tot - {n_test_all}").cast("bigint").alias("__k"))
    # n * K can pass 2^63 at 1e10+ rows: exact integer division in decimal(38, 0)
    prod = F.col("n").cast("decimal(38,0)") * F.col("__k").cast("decimal(38,0)")
    big_n = F.col("__tot").cast("decimal(38,0)")
    rem = prod % big_n
    staged = staged.select("__class", "n", "__tot", "__k",
                           ((prod - rem) / big_n).cast("bigint").alias("base"),
                           rem.alias("rem"))
    deficit = F.col("__k") - F.sum("base").over(wall)
    order = Window.orderBy(F.col("rem").desc(), F.col("__class").asc_nulls_first())
    staged = staged.withColumn("__pos", F.row_number().over(order)).withColumn("__deficit", deficit)
    first_n = (F.col("base") + F.when(F.col("__pos") <= F.col("__deficit"), 1).otherwise(0)).cast("bigint")
    out = staged.select(F.col("__class"), F.col("n"), first_n.alias("__first"))
    if first == "test":
        return out.select("__class", "n", (F.col("n") - F.col("__first")).alias("n_train"),
                          F.col("__first").alias("n_test"))
    return out.select("__class", "n", F.col("__first").alias("n_train"),
                      (F.col("n") - F.col("__first")).alias("n_test"))


def class_quotas(df: DataFrame, label: str | None, test_fraction, first: str = "train") -> DataFrame:
    """Per-class (__class, n, n_train, n_test) of ``df`` (see ``quotas_from_counts``)."""
    lab = F.col(label) if label else F.lit("all")
    counts = df.groupBy(lab.alias("__class")).agg(F.count(F.lit(1)).alias("n"))
    return quotas_from_counts(counts, test_fraction, first)


def _cut_assign(df: DataFrame, key: str, label: str | None, quota, seed: int,
                hex_digits: int, inside: str, outside: str, out: str) -> DataFrame:
    """Rows whose class rank by (md5(seed#key), key) is <= quota get ``inside``.

    ``quota`` is a (__class, __quota) DataFrame or a function of the per-class
    counts table (__class, n), so the input is counted only once. ``hex_digits`` is
    the shortest prefix; larger inputs get longer ones, so the one ranked cut bucket
    per class stays near ``ROWS_PER_BUCKET`` rows."""
    lab = F.col(label) if label else F.lit("all")
    hex_digits = hex_digits_for(df.count(), hex_digits)
    h, b = "__h", "__hb"
    # rows with a null key share one hash, so that they are assigned like any others
    hashed = F.coalesce(stable_hash(seed, key), F.md5(F.lit(f"{seed}#")))
    staged = df.withColumn("__class", lab).withColumn(h, hashed) \
        .withColumn(b, F.substring(h, 1, hex_digits))
    counts = staged.groupBy("__class", b).agg(F.count(F.lit(1)).alias("__c"))
    if callable(quota):
        quota = quota(counts.groupBy("__class").agg(F.sum("__c").alias("n")))
    w = Window.partitionBy("__class").orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.withColumn("__cum", F.sum("__c").over(w))
    cum = join_small(cum, quota.select("__class", F.col("__quota")), ["__class"])
    # cut bucket: first prefix whose inclusive count reaches the quota
    cuts = (cum.where(F.col("__cum") >= F.col("__quota"))
            .groupBy("__class").agg(F.min(F.struct(b, (F.col("__cum") - F.col("__c")).alias("before"),
                                                   F.col("__quota"))).alias("s"))
            .select("__class", F.col(f"s.{b}").alias("__cut"),
                    (F.col("s.__quota") - F.col("s.before")).alias("__need")))
    if label is None:
        # a single class: the cut is two numbers, attached as literals (no join at all)
        row = cuts.first()
        tagged = staged.withColumn("__cut", F.lit(row["__cut"] if row else "")) \
            .withColumn("__need", F.lit(row["__need"] if row else 0).cast("bigint"))
    else:
        # cuts has one row per class: broadcast is bounded by the number of classes
        tagged = join_small(staged, cuts, ["__class"])
    decided = tagged.where(F.col(b) != F.col("__cut")).withColumn(
        out, F.when(F.col(b) < F.col("__cut"), F.lit(inside)).otherwise(F.lit(outside)))
    wr = Window.partitionBy("__class").orderBy(h, key)
    ranked = tagged.where(F.col(b) == F.col("__cut")).withColumn("__rn", F.row_number().over(wr)) \
        .withColumn(out, F.when(F.col("__rn") <= F.col("__need"), F.lit(inside)).otherwise(F.lit(outside))) \
        .drop("__rn")
    return decided.unionByName(ranked).drop("__class", h, b, "__cut", "__need")


def stratified_split(df: DataFrame, key: str, label: str | None, test_fraction=0.2, seed: int = 42,
                     out: str = "split", hex_digits: int = 4) -> DataFrame:
    """Exact stratified train/test split: adds ``out`` in {'train', 'test'}."""
    def q(class_counts):
        return quotas_from_counts(class_counts, test_fraction).select("__class", F.col("n_train").alias("__quota"))
    return _cut_assign(df, key, label, q, seed, hex_digits, "train", "test", out)


def random_split(df: DataFrame, key: str, test_fraction=0.2, seed: int = 42, out: str = "split",
                 hex_digits: int = 4) -> DataFrame:
    """Unstratified exact split (train = first N - ceil(f N) rows by hash)."""
    return stratified_split(df, key, None, test_fraction, seed, out, hex_digits)


def sample_fraction(df: DataFrame, key: str, fraction=0.035, seed: int = 42, hex_digits: int = 4) -> DataFrame:
    """Exactly round-half-even(fraction * N) rows without replacement."""
    f = _frac(fraction)

    def quota(class_counts):
        prod = F.col("n") * f.numerator
        q = F.floor(prod / F.lit(f.denominator)).cast("bigint")
        r = prod - q * f.denominator
        keep = q + F.when((2 * r > f.denominator) | ((2 * r == f.denominator) & (q % 2 == 1)), 1).otherwise(0)
        return class_counts.select("__class", keep.cast("bigint").alias("__quota"))
    tagged = _cut_assign(df, key, None, quota, seed, hex_digits, "in", "out", "__pick")
    return tagged.where(F.col("__pick") == "in").drop("__pick")


def exact_quota_rank(df: DataFrame, key: str, label: str, seed: int = 42, hex_digits: int = 3) -> DataFrame:
    """Adds ``rank`` (1-based, by md5(seed#key), key within class) and ``class_n``."""
    ranked = hash_rank(df, key, seed, (label,), "rank", hex_digits)
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("class_n"))
    return join_small(ranked, sizes, [label])


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Unshuffled stratified k folds: classes in order of first appearance (by key),
    fold sizes from striding the class-sorted row list, and inside each class
    rows fill fold 0, 1, ... in key order.
    """
    stats = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"), F.min(key).alias("first_key"))
    w = Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1)  # class table only
    stats = stats.withColumn("S", F.coalesce(F.sum("c").over(w), F.lit(0)))

    def upto(m, i):  # #{p in [0, m): p mod k == i}
        return F.floor((m - F.lit(i) + F.lit(k - 1)) / F.lit(k))

    bounds = []
    acc = F.lit(0)
    for i in range(k - 1):
        acc = acc + (upto(F.col("S") + F.col("c"), i) - upto(F.col("S"), i))
        bounds.append(acc.cast("bigint").alias(f"__b{i}"))
    stats = stats.select(label, *bounds)
    ranked = ordered_rank(df, key, key, (label,), "__r")
    joined = join_small(ranked, stats, [label])
    fold = F.lit(0)
    for i in range(k - 1):
        fold = fold + F.when(F.col("__r") > F.col(f"__b{i}"), 1).otherwise(0)
    return joined.withColumn(out, fold.cast("int")).drop("__r", *[f"__b{i}" for i in range(k - 1)])


def shuffle_batches(df: DataFrame, key: str, size: int, seed: int = 42, round_: int = 0,
                    out: str = "batch") -> DataFrame:
    """Mini-batch id = floor((rank - 1) / size), rank by md5 of (seed, round, key)."""
    ranked = hash_rank(df, key, seed * 1000003 + round_, (), "__r")
    return ranked.withColumn(out, F.floor((F.col("__r") - 1) / F.lit(size)).cast("bigint")).drop("__r")
