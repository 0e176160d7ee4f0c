"""Connected components by alternating large-star / small-star rounds.

Each round is two (min-aggregation, join) steps over the edge table; the
aggregations combine map-side, so a hub costs one row per task, and the joins
are plain sort-merge joins that adaptive execution can split. Every round is
written to the shared checkpoint folder, which cuts lineage and survives lost
executors. The number of rounds grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import materialize

MAX_ROUNDS = 60


def _signature(df: DataFrame) -> tuple:
    r = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40))).first()
    return int(r[0]), int(r[1] or 0)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v long) -> (node, root): root is the smallest node reachable.

    Self-loops, nulls and repeated edges are ignored; nodes without an edge are
    not returned; no edges gives an empty table."""
    e = edges.where("u is not null and v is not null and u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "cc")
    sig = _signature(e)
    for _ in range(MAX_ROUNDS):
        if sig[0] == 0:
            break
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both = large.join(low, "u")
        small = (both.select("u", F.col("m").alias("v"))
                 .unionByName(both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        e = materialize(small, "cc")
        new = _signature(e)
        if new == sig:
            break
        sig = new
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
