"""Approximate nearest neighbours by inner product with an inverted multi-index.

Each half of a vector is quantised against its own codebook, so a cell is a pair of
centroids. A query ranks the centroids of each half by inner product and walks cell pairs in
falling order of the summed product with a heap until the cells it passed hold
a number of vectors that is measured per table: a bounded set of queries is answered from all
rows too, and the walk starts at ``CANDIDATES`` and doubles until it holds ``AUDIT_RECALL`` of
those neighbours. What it passed is then reranked exactly, block by block, and the best merged.

Equal vectors share one index entry that keeps as many ids as an answer can need. Cells next to
each other form blocks of about ``BLOCK`` entries, and a crowded cell is dealt over several, so
neither a repeated vector nor a crowded cell meets in one task, and a query hands on at most a
block's best, not each cell's.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Vectors (in expectation) that the codebooks are fitted on, drawn by a hash of the id.
SAMPLE_ROWS = 8_192
#: Entries per cell aimed at, most centroids of a half, rounds of k-means.
CELL_ROWS, MOST_CENTROIDS, ROUNDS = 24, 256, 12
#: Least entries that a query's cells hold before the walk ends.
CANDIDATES = 4_000
#: Queries answered from all rows to measure the walk, and the recall of their neighbours that ends its doubling.
AUDIT_QUERIES, AUDIT_RECALL = 128, 0.95
#: Entries of a block; queries of a block.
BLOCK, QUERY_BLOCK = 4096, 1024
#: Queries whose scores are held side by side.
STEP = 256


def usable(vector):
    """Whether a vector takes part: not null, not zero, every component finite and not null."""
    return (
        vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vector, lambda x: x != 0)
    )


def k_means(rows: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    centres = rows[rng.choice(len(rows), min(count, len(rows)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = ((centres**2).sum(axis=1)[None, :] - 2 * rows @ centres.T).argmin(axis=1)
        for c in range(len(centres)):
            own = rows[near == c]
            if len(own):
                centres[c] = own.mean(axis=0)
    return centres


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _assign(books):
    def run(batches):
        first, second = books.value
        half = first.shape[1]
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("vector"))
            cells = [((b**2).sum(axis=1)[None, :] - 2 * part @ b.T).argmin(axis=1) for b, part in ((first, m[:, :half]), (second, m[:, half:]))]
            cell = cells[0] * len(second) + cells[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    return run


def walk(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells in falling order of ``left[i] + right[j]`` until they hold ``wanted`` entries."""
    by_left, by_right = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    width = len(right)
    lefts, rights = left[by_left].tolist(), right[by_right].tolist()
    heap, found, held = [(-(lefts[0] + rights[0]), 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = int(by_left[i]) * width + int(by_right[j])
        if sizes[cell]:
            found.append(cell)
            held += int(sizes[cell])
        if j + 1 < width:
            heapq.heappush(heap, (-(lefts[i] + rights[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(lefts):
            heapq.heappush(heap, (-(lefts[i + 1] + rights[0]), i + 1, 0))
    return found


def blocks_of(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cell its first block and its number of blocks."""
    many = np.maximum(1, -(-sizes // BLOCK))
    first, block, held = np.zeros(len(sizes), np.int64), 0, 0
    for cell in np.flatnonzero(sizes).tolist():
        if held and held + sizes[cell] > BLOCK:
            block, held = block + 1, 0
        first[cell] = block
        held += int(sizes[cell])
        if many[cell] > 1:
            block, held = block + int(many[cell]), 0
    return first, many


def _traverse(books, sizes, wanted: int):
    def run(batches):
        first, second = books.value
        held = sizes.value
        begin, many = blocks_of(held)
        half = first.shape[1]
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                m = _matrix(batch.column("vector"))
                lefts, rights = m[:, :half] @ first.T, m[:, half:] @ second.T
                owner, block, cells = [], [], []
                for q, (a, b) in enumerate(zip(lefts, rights)):
                    own: dict[int, list[int]] = {}
                    for cell in walk(a, b, held, wanted):
                        for k in range(begin[cell], begin[cell] + many[cell]):
                            own.setdefault(int(k), []).append(cell)
                    owner += [q] * len(own)
                    block += own.keys()
                    cells += own.values()
                batch = batch.take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int32()), pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "block", "cells"])

    return run


def _nearest(asked, k: int):
    """Per partition of placed entries, the ``k`` best of each audited query: its number, score, ids and cell."""

    def run(batches):
        queries = asked.value
        best: list[list[tuple]] = [[] for _ in queries]
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = queries @ _matrix(batch.column("vector")).T
            for q, own in enumerate(scores):
                floor = best[q][-1][0] if len(best[q]) >= k else -np.inf
                top = np.argpartition(-own, k - 1)[:k] if len(own) > k else np.arange(len(own))
                new = [(float(own[e]), batch.column("ids")[e].as_py(), batch.column("cell")[e].as_py()) for e in top.tolist() if own[e] > floor]
                best[q] = sorted(best[q] + new, key=lambda r: -r[0])[:k]
        out = [(q, *r) for q, found in enumerate(best) for r in found]
        columns = list(zip(*out)) if out else [(), (), (), ()]
        kinds = [pa.int32(), pa.float64(), pa.list_(pa.int64()), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["q", "score", "ids", "cell"])

    return run


def audited_walk(placed: DataFrame, queries: DataFrame, books, sizes: np.ndarray, k: int) -> tuple[int, float | None]:
    """Entries that the walk must hold, and the recall it then has on the audited queries (None without queries).

    ``queries`` holds ``query_id, vector``; ``sizes`` the entries per cell. A neighbour is
    found if the cells before its own hold fewer entries than wanted.
    """
    some = queries.orderBy(F.xxhash64("query_id", F.lit("audit")), "query_id").limit(AUDIT_QUERIES).collect()
    wanted, total = CANDIDATES, int(sizes.sum())
    if not some:
        return wanted, None
    asked = np.array([r["vector"] for r in some], float)
    shared = placed.sparkSession.sparkContext.broadcast(asked)
    near = placed.select("ids", "vector", "cell").mapInArrow(_nearest(shared, k + 1), "q int, score double, ids array<bigint>, cell int")
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.element_at("ids", 1))
    exact: dict[int, list] = {}
    for r in near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1).orderBy("q", "place").collect():
        exact.setdefault(r["q"], []).append(r)
    first, second = books
    half = first.shape[1]
    before, weight = [], []  # of a neighbour: entries in the cells that come before its own, rows it stands for
    for q, found in exact.items():
        at = ((asked[q, :half] @ first.T)[:, None] + (asked[q, half:] @ second.T)[None, :]).ravel()
        filled = np.flatnonzero(sizes)
        order = filled[np.argsort(-at[filled], kind="stable")]
        reached = np.zeros(len(sizes), np.int64)
        reached[order] = np.cumsum(sizes[order]) - sizes[order]
        left = k
        for r in found:
            rows = min(left, len(r["ids"]) - (some[q]["query_id"] in r["ids"]))
            left -= rows
            before.append(reached[r["cell"]])
            weight.append(rows)
    before, weight = np.array(before), np.array(weight, float)
    if not weight.sum():
        return wanted, None
    recall = lambda: float(weight[before < wanted].sum() / weight.sum())
    while wanted < total and recall() < AUDIT_RECALL:
        wanted *= 2
    return wanted, recall()


def _rerank(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("cell")
            queries, entries = _matrix(left.column("vector")), _matrix(right.column("vector"))
            names, ids = left.column("query_id").to_pylist(), right.column("ids").to_pylist()
            held, starts = np.unique(right.column("cell").to_numpy(), return_index=True)
            starts = np.append(starts, len(entries))
            visits = left.column("cells").combine_chunks()
            for begin in range(0, len(queries), STEP):
                part = visits.slice(begin, STEP)
                owner = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
                cells = part.flatten().to_numpy()
                order = np.argsort(cells, kind="stable")
                owner, cells = owner[order], cells[order]
                scores = np.full((len(part), len(entries)), -np.inf)
                low, high = np.searchsorted(cells, held, "left"), np.searchsorted(cells, held, "right")
                for c in np.flatnonzero(high > low):
                    asks, a, b = owner[low[c] : high[c]], starts[c], starts[c + 1]
                    scores[asks, a:b] = np.einsum("qd,ed->qe", queries[begin + asks], entries[a:b])
                # equal products may tie across blocks, so ties at the end of the list all go on
                for q, own in enumerate(scores):
                    floor = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
                    out += [(names[begin + q], float(own[e]), ids[e]) for e in np.flatnonzero((own >= floor) & (own > -np.inf))]
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.list_(pa.int64()))], names=["query_id", "score", "ids"])

    return run


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` best found of all other rows.

    ``is_query`` is a condition on ``vectors``. Scores are inner products in double precision,
    ties go to the smaller id, and fewer than ``k`` rows are returned only if there are fewer
    candidates. Rows whose id is null or whose vector is null, empty, zero, or holds null or
    non-finite components take no part; all vectors that do must have one length. Rows that
    repeat an id count once if their vectors are equal and each otherwise, never for a query
    of the same id. Other columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    rows = cut(vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), is_query.alias("asks")
    ))
    # k + 1 ids do for any query, as at most one of them is its own
    entries = cut(_entries(rows, k))
    total = entries.count()
    if not total:
        return spark.createDataFrame([], schema)
    spot = F.pmod(F.xxhash64(F.element_at("ids", 1), F.lit("codebook")), F.lit(1 << 30))
    sample = np.array([r[0] for r in entries.where(spot < int(min(1.0, SAMPLE_ROWS / total) * (1 << 30))).select("vector").limit(2 * SAMPLE_ROWS).collect()], float)
    if not len(sample):
        sample = np.array([entries.select("vector").first()[0]], float)
    half = sample.shape[1] // 2
    count = int(np.clip(round((total / CELL_ROWS) ** 0.5), 1, MOST_CENTROIDS))
    books = spark.sparkContext.broadcast((k_means(sample[:, :half], count, 1), k_means(sample[:, half:], count, 2)))
    placed = cut(entries.mapInArrow(_assign(books), "ids array<bigint>, vector array<float>, cell int"))
    sizes = placed.groupBy("cell").count()
    filled = sizes.collect()  # at most MOST_CENTROIDS ** 2 rows
    queries = rows.where("asks").select(F.col("id").alias("query_id"), "vector").distinct()
    per_cell = np.zeros(len(books.value[0]) * len(books.value[1]), np.int64)
    per_cell[[r[0] for r in filled]] = [r[1] for r in filled]
    wanted, _ = audited_walk(placed, queries, books.value, per_cell, k)
    held = spark.sparkContext.broadcast(per_cell)
    firsts, many = blocks_of(per_cell)
    blocks = spark.createDataFrame([(r[0], int(firsts[r[0]]), int(many[r[0]])) for r in filled], "cell int, first int, blocks int")
    parts = max(1, -(-rows.where("asks").count() * min(wanted, total) // (total * QUERY_BLOCK)))  # for about QUERY_BLOCK queries in a group
    visits = queries.mapInArrow(_traverse(books, held, wanted), "query_id bigint, vector array<float>, block int, cells array<int>").withColumn(
        "part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    )
    held_rows = (
        placed.join(F.broadcast(blocks), "cell").withColumn("block", (F.col("first") + F.pmod(F.xxhash64("ids"), F.col("blocks"))).cast("int"))
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    )
    keys = ["block", "part"]
    found = visits.select(*keys, "query_id", "vector", "cells").groupBy(*keys).cogroup(held_rows.select(*keys, "ids", "vector", "cell").groupBy(*keys)).applyInArrow(
        _rerank(k + 1), "query_id bigint, score double, ids array<bigint>"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
        .groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their ``k + 1`` least ids, salted so that a repeated vector is no hot key."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    least = lambda ids: F.slice(F.array_sort(ids), 1, k + 1)
    some = salted.groupBy("vector", "salt").agg(least(F.collect_set("id")).alias("ids"))
    return some.groupBy("vector").agg(least(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids")).select("ids", "vector")
