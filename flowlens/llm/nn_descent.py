"""Near-duplicate vectors by NN-descent.

Vectors are compared within their label only. Equal vectors of a label collapse to one node
first. A neighbour graph is started from cells of random hyperplanes (a cell above ``BLOCK``
nodes is compared block by block, every pair of its blocks; labels up to ``BLOCK`` nodes are one
cell) and of random sets of a label, and refined by joins: every node's neighbours are
compared with each other, and whoever is nearer than a node's last neighbour enters its list.
A list holds the ``k`` nearest; if it is saturated (all of them links), it grows up to ``k_max``.
Every comparison that finds a link also leaves a link row: those of one spanning forest per
list or cell, so dense groups never emit all pairs.

Rounds end when the lists no longer improve. Then recall is audited: of every label a bounded
sample of nodes, drawn anew each time (nodes without a link, in small and in large components),
is compared with all nodes of the label, block by block, whatever other labels there are. Recall is the mean over nodes of the share of
links that lie within a component. Where a label falls short, further cells and rounds follow,
and after the last attempt the run fails. Missing links found by the audit are kept, always.

At last the links within each component are counted exactly, by matrix products of blocks
of ``BLOCK`` nodes that return one count per node. So lists may be short, while counts are not.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import materialize
from flowlens.llm.graph import connected_components

BLOCK = 1024
BROADCAST_ROWS = 100_000
AUDIT_NODES = 256              # of a label and kind of component
AUDIT_ROWS = 4096              # of a label, compared with its sample at once


def _units(col) -> np.ndarray:
    """Rows of a binary column of equally long double vectors."""
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Links (row numbers) of a spanning forest of a boolean matrix."""
    left, out = np.arange(len(near)), []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            hits = near[np.ix_(left, front)]
            new = hits.any(axis=1)
            out += zip(left[new].tolist(), front[hits[new].argmax(axis=1)].tolist())
            front, left = left[new], left[~new]
    return out


def _nodes(vectors: DataFrame) -> DataFrame:
    """(node, label, dim, unit binary, n, first): distinct vectors; ``vectors`` has label, node, v, id."""
    schema = pa.schema([("node", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("unit", pa.binary()),
                        ("n", pa.int64()), ("first", pa.int64())])

    def unit(it):
        for b in it:
            rows = [np.array(x, np.float64) for x in b.column("v").to_pylist()]
            big = [np.abs(x).max() for x in rows]                      # no overflow in the norm
            rows = [x / m for x, m in zip(rows, big)]
            rows = [x / np.sqrt(x @ x) for x in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("label"), pa.array([len(x) for x in rows], pa.int32()),
                 pa.array([x.tobytes() for x in rows], pa.binary()), b.column("n"), b.column("first")], schema=schema)

    # the node is a hash of label and vector, so it stands for both in the key
    groups = vectors.groupBy("node").agg(F.first("label").alias("label"), F.first("v").alias("v"),
                                         F.count("*").alias("n"), F.min("id").alias("first"))
    return groups.mapInArrow(unit, "node long, label string, dim int, unit binary, n long, first long")


PAIRS = "u long, v long, sim double, link boolean"
_PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("sim", pa.float64()), ("link", pa.bool_())])


def _emit(pieces: list[tuple]) -> pa.Table:
    if not pieces:
        return _PAIRS.empty_table()
    return pa.table([pa.array(np.concatenate([p[i] for p in pieces])) for i in range(4)], schema=_PAIRS)


def _links(nodes: np.ndarray, near: np.ndarray) -> list[tuple]:
    f = np.array(_forest(near), np.int64).reshape(-1, 2)
    return [(nodes[f[:, 0]], nodes[f[:, 1]], np.ones(len(f)), np.ones(len(f), bool))] if len(f) else []


def _start(nodes: DataFrame, tables: range, k: int, threshold: float) -> DataFrame:
    """Pairs from cells: each node's ``k`` nearest of its cell, and links.

    A label has hyperplanes by its own count; one of up to ``BLOCK`` nodes has none and is compared whole,
    in the first table. Nodes of other labels also meet a random set of their label once, so that all have neighbours."""
    cells_schema = pa.schema([("cell", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("node", pa.int64()), ("unit", pa.binary())])

    def dealt(it):
        for b in it:
            dims, counts = b.column("dim").to_numpy(), b.column("count").to_numpy()
            bits_of = np.where(counts > BLOCK, np.ceil(np.log2(np.maximum(counts, 128) / 128)), 0).astype(np.int64)
            for d, bits in np.unique(np.stack([dims, bits_of], 1), axis=0).tolist():
                part = b.filter(pa.array((dims == d) & (bits_of == bits)))
                x, node = _units(part.column("unit")), part.column("node").to_numpy()
                made = []
                if bits:
                    for t in tables:
                        planes = np.random.default_rng((7919, t, d)).standard_normal((d, bits))
                        made.append(((x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64))) + (np.int64(t) << 40))
                    odd = np.uint64(2 * np.random.default_rng((7919, tables.start)).integers(1 << 62) + 1)
                    sets = np.maximum(1, part.column("count").to_numpy() // 128).astype(np.uint64)
                    made.append(-1 - ((node.view(np.uint64) * odd >> np.uint64(24)) % sets).astype(np.int64))
                elif tables.start == 0:
                    made.append(np.zeros(len(x), np.int64))
                for cell in made:
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), part.column("label"), part.column("dim"),
                                                      part.column("node"), part.column("unit")], schema=cells_schema)

    def compared(table: pa.Table) -> pa.Table:
        ids, x = table.column("node").to_numpy(), _units(table.column("unit"))
        sim = x @ x.T
        np.fill_diagonal(sim, -2)
        m = min(k, len(ids) - 1)
        if table.column("i")[0].as_py() != table.column("j")[0].as_py():
            # pairs across the two blocks only, and the nearest one: those inside have their own group
            mine, m = table.column("mine").to_numpy(), min(m, 1)
            sim[mine[:, None] == mine[None, :]] = -2
        if m < 1:
            return _PAIRS.empty_table()
        top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
        u, v, s = np.repeat(ids, m), ids[top].ravel(), np.take_along_axis(sim, top, 1).ravel()
        some = s > -2
        return _emit([(u[some], v[some], s[some], np.zeros(some.sum(), bool))] + _links(ids, sim >= threshold))

    key = ["cell", "label", "dim"]
    many = materialize(nodes.groupBy("label", "dim").count().where(F.col("count") > BLOCK), "nn-large-labels")
    if many.count() <= BROADCAST_ROWS:
        many = F.broadcast(many)
    counted = nodes.join(many, ["label", "dim"], "left").select("node", "label", "dim", "unit", F.coalesce("count", F.lit(0)).alias("count"))
    cells = materialize(counted.mapInArrow(
        dealt, "cell long, label string, dim int, node long, unit binary"), "nn-cells")
    large = materialize(cells.groupBy(*key).count().where(F.col("count") > BLOCK), "nn-large-cells")
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    split = cells.join(large, key, "left").withColumn("blocks", blocks)
    split = split.withColumn("mine", F.pmod(F.xxhash64("node", "cell"), F.col("blocks")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select(*key, "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "unit")
    return split.groupBy(*key, "i", "j").applyInArrow(compared, PAIRS)


def _lists(pairs: DataFrame, k: int, k_max: int, threshold: float) -> DataFrame:
    """The ``k`` nearest of each node; those behind them stay while they are links, up to ``k_max``."""
    both = pairs.select("u", "v", "sim").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"))
    best = both.groupBy("u", "v").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return (best.withColumn("r", rank).where((F.col("r") <= k) | ((F.col("r") <= k_max) & (F.col("sim") >= threshold)))
            .select("u", "v", "sim"))


def _refine(graph: DataFrame, nodes: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs among the neighbours of each node that are nearer than someone's last, and links."""
    last = graph.groupBy("u").agg(F.count("*").alias("c"), F.min("sim").alias("m"))
    last = last.select(F.col("u").alias("v"), F.when(F.col("c") >= k, F.col("m")).otherwise(F.lit(-2.0)).alias("last"))
    known = nodes.select(F.col("node").alias("v"), "unit").join(last, "v")
    lists = (graph.select("u", "v").join(known, "v").groupBy("u")
             .agg(F.collect_list(F.struct("v", "last", "unit")).alias("near")))         # at most k_max each

    def joined(it):
        for b in it:
            pieces, held = [], 0
            for near in b.column("near"):
                near = near.values
                if len(near) < 2:
                    continue
                ids, x = near.field("v").to_numpy(), _units(near.field("unit"))
                last_ = near.field("last").to_numpy()
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                i, j = np.nonzero(sim > last_[:, None])
                if len(i):
                    pieces.append((ids[i], ids[j], sim[i, j], np.zeros(len(i), bool)))
                if sim.max() >= threshold:
                    pieces += _links(ids, sim >= threshold)
                held += len(i)
                if held > 200_000:
                    yield from _emit(pieces).to_batches()
                    pieces, held = [], 0
            yield from _emit(pieces).combine_chunks().to_batches()

    return lists.select("near").mapInArrow(joined, PAIRS)


def _audit(nodes: DataFrame, comp: DataFrame, threshold: float, attempt: int) -> tuple[float, DataFrame]:
    """Least recall of a label, from each label's own sample, and the samples' missing links.

    Recall is the mean, over nodes that have links, of the share that lies within one component."""
    sizes = comp.groupBy("root").agg(F.count("*").alias("members"))
    rooted = nodes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")).join(sizes, "root", "left")
    kind = F.when(F.col("members").isNull(), 0).when(F.col("members") <= 10, 1).otherwise(2)
    rooted = materialize(rooted.select("node", "label", "dim", "unit", "root", kind.alias("kind")), "nn-rooted")
    strata = ["label", "dim", "kind"]
    counts = rooted.groupBy(*strata).agg(F.count("*").alias("stratum"))
    counts = materialize(counts.withColumn("total", F.sum("stratum").over(Window.partitionBy("label", "dim"))), "nn-strata")
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    rows = rooted.join(counts, strata).withColumn("blocks", F.ceil(F.col("total") / AUDIT_ROWS).cast("int"))
    dice = F.pmod(F.xxhash64("node", F.lit(17 + attempt)), F.lit(1 << 30)) / float(1 << 30)
    sample = materialize(rows.where(dice * F.col("stratum") < AUDIT_NODES), "nn-sample")     # about AUDIT_NODES of each stratum
    # a block of a label meets the label's sample; blocks of small labels share a group
    packs = max(1, -(-int(rooted.count()) // AUDIT_ROWS))
    mine = F.pmod(F.xxhash64("node", F.lit(5)), F.col("blocks")).cast("int")
    pack = F.pmod(F.xxhash64("label", "dim", "part"), F.lit(packs)).alias("pack")
    held = ["label", "dim", "part", "node", "root", "unit"]
    left = rows.withColumn("part", mine).select(pack, *held)
    right = sample.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(pack, *held)

    def by_part(table: pa.Table) -> dict[tuple, pa.Table]:
        at: dict[tuple, list] = {}
        for i, key in enumerate(zip(*(table.column(c).to_pylist() for c in ("label", "dim", "part")))):
            at.setdefault(key, []).append(i)
        return {key: table.take(pa.array(i)) for key, i in at.items()}

    def compared(all_rows: pa.Table, sampled: pa.Table) -> pa.Table:
        if not sampled.num_rows or not all_rows.num_rows:
            return _PAIRS.empty_table()
        asked, pieces = by_part(sampled), []
        for key, part in by_part(all_rows).items():
            if key not in asked:
                continue
            ids, roots = part.column("node").to_numpy(), part.column("root").to_numpy()
            s_ids, s_roots = asked[key].column("node").to_numpy(), asked[key].column("root").to_numpy()
            near = _units(part.column("unit")) @ _units(asked[key].column("unit")).T >= threshold
            near &= ids[:, None] != s_ids[None, :]
            apart = near & (roots[:, None] != s_roots[None, :])
            # a row per sampled node with its links and how many are missing; a missing link is a row of its own
            i, j = np.nonzero(apart)
            pieces.append((ids[i], s_ids[j], np.zeros(len(i)), np.ones(len(i), bool)))
            some = np.flatnonzero(near.any(axis=0))
            pieces.append((s_ids[some], near[:, some].sum(axis=0), apart[:, some].sum(axis=0).astype(float), np.zeros(len(some), bool)))
        return _emit(pieces)

    got = materialize(left.groupBy("pack").cogroup(right.groupBy("pack")).applyInArrow(compared, PAIRS), "nn-audit")
    sums = got.where("not link").groupBy(F.col("u").alias("node")).agg(F.sum("v").alias("links"), F.sum("sim").alias("missing"))
    taken = sample.groupBy(*strata).agg(F.count("*").alias("taken"))
    weight = F.col("stratum") / F.col("taken")
    of_label = (sample.select(*strata, "stratum", "node").join(sums, "node").join(taken, strata).groupBy("label", "dim")
                .agg((F.sum(weight * (1 - F.col("missing") / F.col("links"))) / F.sum(weight)).alias("recall")))
    least = of_label.agg(F.min("recall")).first()[0]
    return (1.0 if least is None else float(least)), got.where("link").select("u", "v")


def _count_links(nodes: DataFrame, comp: DataFrame, threshold: float) -> DataFrame:
    """(node, linked): vectors other than the node's own copies that link with it."""
    sizes = comp.groupBy("root").count()
    total = int(comp.count())
    packs = max(1, -(-total // 8192))
    rows = nodes.select("node", "unit", "n").join(comp, "node").join(sizes, "root")
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # small components share a task's group; a large one has a group per pair of its blocks
    rows = rows.select("root", "node", "unit", "n", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
                       F.when(F.col("count") > BLOCK, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(packs))).alias("pack"),
                       (F.col("count") > BLOCK).alias("large"))
    schema = pa.schema([("node", pa.int64()), ("linked", pa.int64())])

    def counted(table: pa.Table) -> pa.Table:
        roots = table.column("root").to_numpy()
        order = np.argsort(roots, kind="stable")
        table = table.take(pa.array(order)).combine_chunks()
        roots, ids = roots[order], table.column("node").to_numpy()
        n, mine = table.column("n").to_numpy(), table.column("mine").to_numpy()
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        cuts = np.append(np.flatnonzero(np.concatenate([[True], roots[1:] != roots[:-1]])), len(roots)).tolist()
        linked = np.zeros(len(ids), np.int64)
        for a, b in zip(cuts[:-1], cuts[1:]):
            x = _units(table.column("unit").slice(a, b - a))
            near = x @ x.T >= threshold
            # a pair of different blocks counts across them only: pairs inside have their own group
            near &= ~np.eye(b - a, dtype=bool) if same else mine[a:b, None] != mine[None, a:b]
            linked[a:b] = near @ n[a:b]
        return pa.table([pa.array(ids), pa.array(linked)], schema=schema)

    got = rows.groupBy("pack", "large", "i", "j").applyInArrow(counted, "node long, linked long")
    return got.groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding",
                    label_col: str = "label", k: int = 10, k_max: int = 48, tables: int = 4, rounds: int = 8,
                    recall: float = 0.98, attempts: int = 4) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row.

    Vectors with a null label, and vectors that are null, empty, zero or hold null or non-finite
    components, link with nothing; vectors of different length never link. Repeated rows are
    vectors of their own, linked with each other. Rows with a null id count as vectors but are
    never a component's id (component_id is null if no member has one). An empty table gives an
    empty result; other columns are ignored."""
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"),
                         F.col(vec_col).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("v", lambda x: x != 0)
    # -0.0 + 0.0 is 0.0, so equal vectors hash equally
    key = F.when(F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(False)) & F.coalesce(some, F.lit(False)),
                 F.xxhash64("label", F.transform("v", lambda x: x + F.lit(0.0))))
    src = materialize(src.withColumn("node", key), "nn-vectors")
    nodes = materialize(_nodes(src.where("node is not null")), "nn-nodes")
    links = graph = comp = None
    done = 0
    for attempt in range(attempts):
        pairs = materialize(_start(nodes, range(done, done + tables), k, threshold), "nn-start")
        done += tables
        new_links = pairs.where("link").select("u", "v")
        links = new_links if links is None else links.unionByName(new_links)
        edges = pairs.where("not link").select("u", "v", "sim")
        graph = materialize(_lists(edges if graph is None else graph.unionByName(edges), k, k_max, threshold), "nn-graph")
        before = None
        for _ in range(rounds):
            size = graph.agg(F.count("*"), F.sum(F.col("sim") + 1)).first()
            now = (int(size[0]), float(size[1] or 0))
            if before is not None and now[1] <= before[1] * 1.002:
                break
            before = now
            pairs = materialize(_refine(graph, nodes, k, threshold), "nn-pairs")
            links = links.unionByName(pairs.where("link").select("u", "v"))
            graph = materialize(_lists(graph.unionByName(pairs.where("not link").select("u", "v", "sim")), k, k_max, threshold), "nn-graph")
        links = materialize(links.unionByName(graph.where(F.col("sim") >= threshold).select("u", "v")).distinct(), "nn-links")
        comp = materialize(connected_components(links), "nn-comp")
        found, missing = _audit(nodes, comp, threshold, attempt)
        links = links.unionByName(missing)
        if found >= recall:
            break
    else:
        raise RuntimeError(f"audited recall {found:.3f} of a label after {attempts} attempts, {recall} asked for")
    if missing.limit(1).count():
        comp = materialize(connected_components(links), "nn-comp")
    counts = _count_links(nodes, comp, threshold)
    rooted = nodes.join(comp, "node", "left").join(counts, "node", "left").select(
        "node", "n", "first", F.coalesce("root", "node").alias("root"), F.coalesce("linked", F.lit(0)).alias("linked"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    per_node = materialize(rooted.join(least, "root").select("node", (F.col("n") - 1 + F.col("linked")).alias("n_links"), "component_id"), "nn-result")
    out = src.where("node is not null").join(per_node, "node").select("id", "n_links", "component_id")
    alone = src.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id",
                                         F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
