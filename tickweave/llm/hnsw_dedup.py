"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Equal vectors of a group form one class, so copies never meet. The classes of a group are
dealt over shards of at most about ``SHARD_ROWS`` by a hash. Each shard builds a graph and
audits it: a sample of its own classes is searched with the beam and by brute force, and the
beam is widened until the recall of links to other classes reaches ``AUDIT_RECALL`` among the
rows of every order of link count that the graph's walk answers (a beam as wide as the shard
finds everything). Then every class queries every shard of its group. A task that asks a shard
audits it again with a sample of its own queries from other shards, so links that no shard
holds inside itself are measured too, and widens the beam for its queries; a query
whose beam is full of links goes on with a wider one. Links are verified by cosine in double
precision. A task returns the number of links per class and a spanning forest of what it
found, never all pairs, and the forests' components are united at the end.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import connected_components

#: Classes of a shard aimed at; queries of a task.
SHARD_ROWS, QUERY_ROWS = 8192, 2048
#: Links of a node per layer (twice as many in the bottom one), beam of the build and first beam of a search.
DEGREE, BUILD_BEAM, FIRST_BEAM = 12, 48, 32
#: Classes with other links that are audited in a shard, least of them of each order of link count met (as
#: far as the shard has them), and the mean recall of links of a class that passes.
AUDIT_ROWS, AUDIT_LEAST, AUDIT_RECALL = 128, 32, 0.995
#: Queries from other shards that a task compares with the whole shard to find ``AUDIT_ROWS`` with links.
AUDIT_SEEN = 1024
#: Rows inserted, and queries searched, side by side.
STEP = 256


def usable(vector):
    """Whether a vector takes part: not null, not zero, every component finite and not null."""
    return (
        vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


class Graph:
    """A small-world graph over unit vectors; searches go side by side for many queries."""

    def __init__(self, unit: np.ndarray, seed: int = 7):
        self.unit = unit
        rows = len(unit)
        levels = np.minimum((-np.log(np.random.default_rng(seed).random(rows) + 1e-12) / np.log(DEGREE)).astype(int), 6)
        levels[0] = levels.max(initial=0)
        self.layers = [np.full((rows, 2 * DEGREE if not k else DEGREE), -1, np.int32) for k in range(levels.max(initial=0) + 1)]
        begin = 1
        while begin < rows:
            stop = min(rows, begin + min(STEP, begin))  # never more new rows than there are old ones
            self._insert(np.arange(begin, stop), levels)
            begin = stop

    def _insert(self, new: np.ndarray, levels: np.ndarray) -> None:
        # all searches come before any linking, so that none starts at a row that leads nowhere yet
        plans = []
        for k in range(len(self.layers) - 1, -1, -1):
            own = new[levels[new] >= k]
            if len(own):
                plans.append((k, own, *self.search(self.unit[own], BUILD_BEAM, down_to=k)))
        for k, own, ids, near in plans:
            # rows of the same step see each other too
            beside = self.unit[own] @ self.unit[own].T
            np.fill_diagonal(beside, -2.0)
            few = min(2 * DEGREE, len(own))
            top = np.argpartition(-beside, few - 1, axis=1)[:, :few]
            ids = np.concatenate([ids, own[top]], axis=1)
            near = np.concatenate([near, np.take_along_axis(beside, top, axis=1)], axis=1)
            chosen = self._diverse(ids, near, DEGREE)
            layer = self.layers[k]
            layer[own, :DEGREE] = chosen
            back: dict[int, list[int]] = {}
            for row, targets in zip(own.tolist(), chosen.tolist()):
                for t in targets:
                    if t >= 0:
                        back.setdefault(t, []).append(row)
            full = []
            for t, sources in back.items():
                line = layer[t]
                sources = [s for s in sources if s not in line]
                free = np.flatnonzero(line < 0)[: len(sources)]
                line[free] = sources[: len(free)]
                if len(sources) > len(free):
                    full.append((t, sources[len(free) :]))
            if full:
                width = layer.shape[1] + max(len(s) for _, s in full)
                ids = np.full((len(full), width), -1, np.int64)
                for i, (t, sources) in enumerate(full):
                    ids[i, : layer.shape[1]] = layer[t]
                    ids[i, layer.shape[1] : layer.shape[1] + len(sources)] = sources
                at = np.array([t for t, _ in full])
                near = np.einsum("qd,qkd->qk", self.unit[at], self.unit[ids])
                near[ids < 0] = -2.0
                layer[at] = self._diverse(ids, near, layer.shape[1])

    def _diverse(self, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Per row up to ``most`` neighbours: first those nearer to the row than to any chosen one, then the nearest others."""
        width = min(ids.shape[1], 3 * most)
        order = np.argsort(-near, axis=1, kind="stable")[:, :width]
        ids, near = np.take_along_axis(ids, order, axis=1), np.take_along_axis(near, order, axis=1)
        valid = near > -1.5
        among = np.einsum("qid,qjd->qij", self.unit[ids], self.unit[ids])
        taken = np.zeros(ids.shape, bool)
        for j in range(ids.shape[1]):
            crowded = ((among[:, j, :] > near[:, j, None]) & taken).any(axis=1)
            taken[:, j] = valid[:, j] & ~crowded & (taken.sum(axis=1) < most)
        rank = np.argsort(np.where(taken, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.take_along_axis(np.where(valid, ids, -1), rank, axis=1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def search(self, queries: np.ndarray, beam: int, down_to: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the ``beam`` nearest found in a layer, best first; cosine -2 fills up."""
        count = len(queries)
        ids = np.zeros((count, 1), np.int64)
        near = queries @ self.unit[0][:, None]
        for k in range(len(self.layers) - 1, down_to, -1):
            ids, near = self._walk(queries, ids, near, self.layers[k], 1)
        return self._walk(queries, ids, near, self.layers[down_to], beam)

    def _walk(self, queries, ids, near, layer, beam):
        count, rows = len(queries), len(self.unit)
        seen = np.zeros((count, rows + 1), bool)
        open_ = np.zeros((count, beam), bool)
        keep = np.full((count, beam), rows, np.int64)
        best = np.full((count, beam), -2.0)
        keep[:, : ids.shape[1]], best[:, : ids.shape[1]] = ids[:, :beam], near[:, :beam]
        open_[:, : ids.shape[1]] = True
        seen[np.arange(count)[:, None], keep] = True
        seen[:, rows] = True
        live = np.arange(count)
        while len(live):
            at = np.where(open_[live], best[live], -3.0).argmax(axis=1)
            has = open_[live, at]
            live, at = live[has], at[has]
            if not len(live):
                break
            open_[live, at] = False
            next_ = layer[keep[live, at]].astype(np.int64)
            next_[next_ < 0] = rows
            fresh = ~seen[live[:, None], next_]
            seen[live[:, None], next_] = True
            next_ = np.where(fresh, next_, rows)
            score = np.where(fresh, np.einsum("qd,qkd->qk", queries[live], self.unit[np.minimum(next_, rows - 1)]), -2.0)
            all_ids = np.concatenate([keep[live], next_], axis=1)
            all_near = np.concatenate([best[live], score], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            keep[live] = np.take_along_axis(all_ids, order, axis=1)
            best[live] = np.take_along_axis(all_near, order, axis=1)
            open_[live] = np.take_along_axis(all_open, order, axis=1)
        return np.minimum(keep, rows - 1), best

    def links(self, queries: np.ndarray, beam: int, threshold: float):
        """Per query, the rows found at ``threshold`` or nearer; beams full of links are widened.

        The width doubles up to a sixteenth of the shard; what is still full then, a query
        with more links than that, is compared with the whole shard, which costs no more.
        The second result says which queries the walk answered, not that comparison.
        """
        rows = len(self.unit)
        out: list[np.ndarray | None] = [None] * len(queries)
        walked = np.ones(len(queries), bool)
        left = np.arange(len(queries))
        while len(left):
            still = []
            for begin in range(0, len(left), STEP):
                part = left[begin : begin + STEP]
                if beam >= rows or beam > max(FIRST_BEAM * 8, rows // 16):
                    near = queries[part] @ self.unit.T
                    walked[part] = False
                    for i, line in zip(part, near):
                        out[i] = np.flatnonzero(line >= threshold)
                    continue
                ids, near = self.search(queries[part], beam)
                full = near[:, -1] >= threshold
                for i, line, score, more in zip(part, ids, near, full):
                    if more:
                        still.append(i)
                    else:
                        out[i] = line[score >= threshold]
            left = np.array(still, int)
            beam *= 2
        return out, walked


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(column) -> np.ndarray:
    m = _matrix(column)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # neither tiny nor huge components run out of range
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def audit_sample(graph: Graph, threshold: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with links to other rows, and those links by brute force.

    Rows are drawn until ``AUDIT_ROWS`` of them have other links and ``AUDIT_LEAST`` are of
    each order (power of two) of link count met, or until the shard has no more; of an order
    no more than ``AUDIT_ROWS`` are kept. Rows with more links than the widest walk holds
    (see ``links``) are audited but do not count towards ``AUDIT_ROWS``.
    """
    rows = len(graph.unit)
    order = np.random.default_rng(11).permutation(rows)
    most = max(FIRST_BEAM * 8, rows // 16)
    sample, true, counts, few = [], [], {}, 0
    for begin in range(0, rows, STEP):
        part = order[begin : begin + STEP]
        for i, line in zip(part.tolist(), graph.unit[part] @ graph.unit.T):
            others = np.flatnonzero(line >= threshold)
            others = others[others != i]
            level = len(others).bit_length()
            if level and counts.get(level, 0) < AUDIT_ROWS:
                counts[level] = counts.get(level, 0) + 1
                few += len(others) < most
                sample.append(i)
                true.append(others)
        if few >= AUDIT_ROWS and min(counts.values()) >= AUDIT_LEAST:
            break
    return np.array(sample, int), true


def audited_beam(graph: Graph, threshold: float) -> int:
    """The least beam, doubling from FIRST_BEAM, whose walks pass the audit of the shard's own rows."""
    sample, true = audit_sample(graph, threshold)
    return passing_beam(graph, threshold, graph.unit[sample], true, FIRST_BEAM)


def foreign_beam(graph: Graph, threshold: float, queries: np.ndarray, beam: int) -> int:
    """``beam``, or the next doubling of it whose walks pass the audit of queries from other shards.

    Up to ``AUDIT_SEEN`` of them are compared with the whole shard until ``AUDIT_ROWS`` have links.
    """
    order = np.random.default_rng(13).permutation(len(queries))[:AUDIT_SEEN]
    sample, true = [], []
    for begin in range(0, len(order), STEP):
        part = order[begin : begin + STEP]
        for i, line in zip(part.tolist(), queries[part] @ graph.unit.T):
            if len(found := np.flatnonzero(line >= threshold)):
                sample.append(i)
                true.append(found)
        if len(sample) >= AUDIT_ROWS:
            break
    return passing_beam(graph, threshold, queries[sample], true, beam)


def passing_beam(graph: Graph, threshold: float, queries: np.ndarray, true: list[np.ndarray], beam: int) -> int:
    """The least beam, doubling from the given one, whose walks find enough of the true links at every order of link count."""
    level = np.array([len(t).bit_length() for t in true], int)
    while beam < len(graph.unit) and len(true):
        found, walked = graph.links(queries, beam, threshold)
        recall = np.array([len(np.intersect1d(a, b, assume_unique=True)) / len(b) for a, b in zip(found, true)])
        # rows compared with the whole shard say nothing about the graph
        if all(recall[own].mean() >= AUDIT_RECALL for k in set(level[walked].tolist()) if (own := walked & (level == k)).any()):
            break
        beam *= 2
    return beam


def _build(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        graph = Graph(_units(table.column("vector")))
        beam = audited_beam(graph, threshold - 1e-9)
        kept = pickle.dumps((table.column("id").to_numpy(), table.column("copies").to_numpy(), graph.unit, graph.layers), protocol=5)
        return pa.table([table.column("group")[:1], table.column("shard")[:1], pa.array([kept], pa.binary()), pa.array([beam], pa.int32())], names=["group", "shard", "graph", "beam"])

    return run


def _query(threshold: float):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["a", "b", "n"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        ids, copies, unit, layers = pickle.loads(right.column("graph")[0].as_py())
        graph = Graph.__new__(Graph)
        graph.unit, graph.layers = unit, layers
        own = left.column("id").to_numpy()
        queries = _units(left.column("vector"))
        beam = foreign_beam(graph, threshold - 1e-9, queries[~np.isin(own, ids)], right.column("beam")[0].as_py())
        found, _ = graph.links(queries, beam, threshold - 1e-9)
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        counts, a, b = [], [], []
        for i, (key, at) in enumerate(zip(own.tolist(), found)):
            exact = unit[at] @ queries[i]
            at = at[(exact >= threshold) & (ids[at] != key)]
            counts.append(int(copies[at].sum()))
            mine = top(key)
            for other in ids[at].tolist():
                if (its := top(other)) != mine:
                    low, mine = max(its, mine), min(its, mine)
                    root[low] = mine
                    a.append(key)
                    b.append(other)
        return pa.table(
            [pa.array(own.tolist() + a, pa.int64()), pa.array([None] * len(own) + b, pa.int64()), pa.array(counts + [0] * len(a), pa.int64())], names=names
        )

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", group_col: str = "label"
) -> DataFrame:
    """One row per row of ``vectors``: ``id_col, n_links, component_id, kept``.

    Rows of one group with a cosine of at least ``threshold`` are linked. ``n_links`` counts
    the other rows linked directly, ``component_id`` is the least id reachable by links and
    ``kept`` says whether the row holds it. Rows whose id or group is null or whose vector is
    null, empty, zero, or holds null or non-finite components link with nothing; they keep
    their own id as component and are kept. Vectors of different lengths are never linked.
    Rows that repeat an id count as rows of their own. Other columns are ignored; an empty
    table gives an empty result.
    """
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(F.col(id_col).isNotNull() & F.col(group_col).isNotNull() & usable(F.col(vector_col)), F.col(vector_col)).alias("vector"),
        F.concat_ws("/", F.col(group_col).cast("string"), F.size(vector_col).cast("string")).alias("group"),
    )
    # a class goes by its least id; copies are pre-aggregated before the shuffle
    classes = cut(
        rows.where("vector is not null").groupBy("group", "vector")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    )
    # distinct vectors may share a least id only if an id repeats; a class number of its own tells them apart
    classes = cut(classes.withColumn("class", F.monotonically_increasing_id()))
    shards = classes.groupBy("group").agg(
        F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards"), F.ceil(F.count(F.lit(1)) / QUERY_ROWS).cast("int").alias("blocks")
    )
    dealt = classes.join(shards, "group").select(
        "group", F.col("class").alias("id"), "vector", "copies", "shards", "blocks",
        F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int").alias("shard"),
        F.pmod(F.xxhash64("vector", F.lit("block")), F.col("blocks")).cast("int").alias("block"),
    )
    graphs = cut(dealt.groupBy("group", "shard").applyInArrow(_build(threshold), "group string, shard int, graph binary, beam int"))
    keys = ["group", "shard", "block"]
    asked = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).select(*keys, "id", "vector")
    # a graph is read once for each block of queries, not for each query
    held = graphs.join(shards, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*keys, "graph", "beam")
    found = cut(asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(_query(threshold), "a bigint, b bigint, n bigint"))
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    trees = connected_components(found.where("b is not null"))
    placed = (
        classes.join(counts, "class", "left").join(trees.withColumnRenamed("node", "class"), "class", "left")
        .select("class", "group", "vector", "id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "class").alias("root"))
    )
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    named = placed.join(least, "root").select("group", "vector", "n", "component_id")
    out = rows.join(named, ["group", "vector"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
