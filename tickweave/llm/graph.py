"""Connected components of a link table, all on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_ROWS, cut, sized


#: Most rows of a round's table of trees that is broadcast (two nodes each); the planner's own estimates of such tables are far too high.
BROADCAST_ROWS = 10_000


def _is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node with a link; component is the least node reachable.

    Rounds of contraction: each node hooks to its least neighbour, the resulting trees are
    flattened by pointer jumping, and links between trees become the next round's table,
    which at least halves each time. Hubs are harmless: the minimum is pre-aggregated
    before the shuffle, and joins on a hub are split by adaptive execution. Tables have the
    partitions that their rows need, so rounds over few links are short jobs without shuffles.
    Links that hold a null or join a node to itself are ignored; an empty table gives an empty
    result.
    """
    links, left = sized(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )
    labels = None
    while labels is None or left:
        ways = [F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("a", "b"), ("b", "a"))]
        both = links.select(F.inline(F.array(*ways)))
        tree, nodes = sized(both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("up")))
        few = F.broadcast if nodes <= BROADCAST_ROWS else lambda df: df
        while True:
            above = tree.select(F.col("x").alias("up"), F.col("up").alias("top"))
            jumped = cut(
                tree.join(few(above), "up").select("x", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved"))
            ).coalesce(max(1, -(-nodes // PART_ROWS)))
            tree = jumped.select("x", "up")
            if _is_empty(jumped.where("moved")):
                break
        if labels is None:
            labels = tree.select(F.col("x").alias("node"), F.col("up").alias("component"))
        else:
            labels = labels.join(few(tree.withColumnRenamed("x", "component")), "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")
            )
        links, left = sized(
            links.join(few(tree.select(F.col("x").alias("a"), F.col("up").alias("ta"))), "a")
            .join(few(tree.select(F.col("x").alias("b"), F.col("up").alias("tb"))), "b")
            .where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
            .distinct()
        )
    return labels
