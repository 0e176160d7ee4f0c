"""Exact top-k inner products by ball trees, one per shard.

Vectors are dealt into shards by a hash of their row. Each shard is one ball tree: a node
has the centre and radius of its vectors, so no vector in it scores above
q.centre + |q| * radius. A query visits nodes from the highest bound down and stops when
the bound falls below its k-th score (equal bounds are still visited, for ties).

The k-th score is shared: every query first searches one home shard, and goes to all other
shards with the k-th score found there; a shard returns only what reaches it. Queries
travel in groups, so that a task holds one tree and a bounded group.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import materialize, shuffle_parts

SHARD_ROWS = 8192
GROUP_QUERIES = 8192
LEAF = 64
_LONG = (1 << 63) - 1


def quantise(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) in doubles; whole numbers, so exact also beyond 2^53."""
    return np.floor(scale * x.astype(np.float64))


def exact_scores(v: np.ndarray, q: np.ndarray) -> list[int]:
    """Integer inner products of the rows of ``v`` (whole doubles) with ``q``."""
    d = min(v.shape[1], len(q))                   # shorter vectors count as padded with zeros
    v, q = v[:, :d], q[:d]
    if d == 0:
        return [0] * len(v)
    if np.abs(v).max(initial=0) * np.abs(q).max(initial=0) * d < 2.0 ** 53:
        return (v @ q).astype(np.int64).tolist()
    whole = [int(x) for x in q.tolist()]
    return [sum(int(a) * b for a, b in zip(row, whole)) for row in v.tolist()]


class BallTree:
    """Nodes of halves along the widest coordinate; rows are kept in node order."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray):
        order = np.arange(len(ids))
        self.nodes: list[tuple] = []              # (begin, end, left, right)
        centres, radii = [], []
        todo = [(0, len(ids), None)]
        while todo:
            a, b, parent = todo.pop()
            part = v[order[a:b]]
            centre = part.mean(axis=0)
            centres.append(centre)
            radii.append(float(np.sqrt(((part - centre) ** 2).sum(axis=1).max(initial=0))))
            k = len(self.nodes)
            self.nodes.append([a, b, -1, -1])
            if parent is not None:
                self.nodes[parent[0]][parent[1]] = k
            spread = part.max(axis=0) - part.min(axis=0) if part.shape[1] else np.zeros(1)
            if b - a > LEAF and spread.max() > 0:
                mid = (a + b) // 2
                order[a:b] = order[a:b][np.argpartition(part[:, spread.argmax()], mid - a)]
                todo += [(a, mid, (k, 2)), (mid, b, (k, 3))]
        self.rows, self.ids, self.v = rows[order], ids[order], v[order]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, rows: np.ndarray, q: np.ndarray, k: int, floors: list) -> list[list[tuple]]:
        """For each query the best (score, -id), at most k, none below its floor; not its own row."""
        d = min(self.centres.shape[1], q.shape[1])
        norm = np.sqrt((q[:, :d] ** 2).sum(axis=1))
        bound = q[:, :d] @ self.centres[:, :d].T + norm[:, None] * self.radii[None, :]
        size = norm[:, None] * (np.sqrt((self.centres ** 2).sum(axis=1)) + self.radii)[None, :]
        bound += 1e-9 * size + 1e-6               # rounding never hides a vector
        out = []
        for own, x, bounds, floor in zip(rows.tolist(), q, bound.tolist(), floors):
            best: list = []
            heap = [(-bounds[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                least = best[0][0] if len(best) == k else floor
                if least is not None and -top < least:
                    break
                a, b, left, right = self.nodes[node]
                if left >= 0:
                    heapq.heappush(heap, (-bounds[left], left))
                    heapq.heappush(heap, (-bounds[right], right))
                    continue
                for r, i, s in zip(self.rows[a:b].tolist(), self.ids[a:b].tolist(), exact_scores(self.v[a:b], x)):
                    if r == own or (floor is not None and s < floor):
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
            out.append(sorted(best, reverse=True))
        return out


def _matrix(table: pa.Table) -> np.ndarray:
    """Rows of a list column; shorter ones are padded with zeros."""
    rows = table.column("v").to_pylist()
    d = max(map(len, rows), default=0)
    if all(len(r) == d for r in rows):
        return np.array(rows, np.float64).reshape(len(rows), d)
    return np.array([list(r) + [0.0] * (d - len(r)) for r in rows], np.float64)


def valid(col: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    bad = F.exists(col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return col.isNotNull() & ~F.coalesce(bad, F.lit(False))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vec_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query (all, if fewer).

    Candidates are all other rows, those that repeat the query's id or another's included, so a
    vec_id may come up several times, and an id with several query rows has a list for each. Rows
    with a null id, or whose vector is null or holds null or non-finite components, take no part. Scores outside 64 bits are cut to the nearest end. Ties go to the
    smaller id. An empty table gives an empty result; other columns are ignored."""
    spark = vectors.sparkSession
    src = vectors.where(F.col(id_col).isNotNull() & valid(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q"))
    # ids may repeat: a row's number, fixed by the written table, stands for it
    src = materialize(src.withColumn("row", F.monotonically_increasing_id()), "topk-vectors")
    size = src.agg(F.count("*"), F.count_if("q")).first()
    n, n_queries = int(size[0]), int(size[1])
    shards = max(1, -(-n // shard_rows))
    groups = max(1, -(-n_queries // GROUP_QUERIES))
    parts = max(shuffle_parts(spark), min(shards * groups, 100 * shuffle_parts(spark)))
    src = src.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    queries = src.where("q").select("row", "id", "v", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).cast("int").alias("grp"),
                                    F.col("shard").alias("home"))
    schema = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    ddl = "query long, query_id long, vec_id long, score long"

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        tree = BallTree(left.column("row").to_numpy(), left.column("id").to_numpy(), quantise(_matrix(left), scale))
        asked, ids = right.column("query").to_numpy(), right.column("id").to_pylist()
        found = tree.search(asked, quantise(_matrix(right), scale), k, right.column("floor").to_pylist())
        rows = [(r, i, -minus, max(-_LONG - 1, min(_LONG, s))) for r, i, best in zip(asked.tolist(), ids, found) for s, minus in best]
        return pa.table(list(map(list, zip(*rows))) if rows else [[], [], [], []], schema=schema)

    shard_rows_df = src.select("row", "id", "v", "shard", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
    own = [F.col(c).alias(c) for c in ("id", "v", "grp")]          # new columns: a cogroup's sides must not share any
    at_home = queries.select(F.col("row").alias("query"), *own, F.col("home").alias("shard"),
                             F.lit(None).cast("long").alias("floor"))
    keys = ["shard", "grp"]
    home = (shard_rows_df.repartition(parts, *keys).groupBy(*keys).cogroup(at_home.groupBy(*keys))
            .applyInArrow(searched, ddl))
    home = materialize(home, "topk-home")
    # the k-th score so far; none if fewer than k candidates were found
    kth = home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = kth.select(F.col("query").alias("row"), F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    away = (queries.join(floors, "row", "left")
            .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where("shard <> home")
            .select(F.col("row").alias("query"), *own, "shard", "floor"))
    rest = (shard_rows_df.repartition(parts, *keys).groupBy(*keys).cogroup(away.groupBy(*keys))
            .applyInArrow(searched, ddl))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return (home.unionByName(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
