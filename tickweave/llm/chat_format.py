"""Chat formatting after cumulative-snapshot collapse, in DataFrame functions alone.

Logs that snapshot a conversation after every turn hold each conversation many times over,
as prefixes of the last one. Every turn carries a rolling hash of its conversation up to and
including it. A conversation whose last hash is an inner turn's hash of another one is a
snapshot and goes by an anti-join; of conversations with the same last hash the least id
stays. Only the maximal ones are rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, h1, h2, last``: two 64-bit rolling hashes per turn.

    A turn's own hash takes its place, role and text; the rolling one is the running xor of
    these, so it names the whole sequence so far.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    # a null role or text differs from an empty one
    own = [F.col("place"), F.col("role").isNull(), F.col("text").isNull(), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))]
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        turns.withColumn("place", F.row_number().over(order))
        .withColumn("x1", F.xxhash64(F.lit("a"), *own)).withColumn("x2", F.xxhash64(F.lit("b"), *own))
        .withColumn("h1", F.bit_xor("x1").over(running)).withColumn("h2", F.bit_xor("x2").over(running))
        .withColumn("last", F.lead("place").over(order).isNull())
        .drop("x1", "x2")
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row per maximal conversation: ``conv_id, n_turns, n_collapsed, chat``.

    Turns are taken in order of ``turn`` (ties by role, then text; a null turn comes first).
    ``n_collapsed`` counts the conversations equal to this one that it stands for, itself
    included. A null role or text is rendered as empty. Rows without ``conv_id`` belong to no
    conversation and are left out; repeated turn rows count as turns. Other columns are
    ignored, and an empty table gives an empty result.
    """
    turns = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    hashed = prefix_hashes(turns)
    # equal prefixes are pre-aggregated before the shuffle, so a common opening is one row a task
    ends = hashed.where("last").groupBy("h1", "h2").agg(
        F.min("conv_id").alias("conv_id"), F.max("place").alias("n_turns"), F.count(F.lit(1)).alias("n_collapsed")
    )
    inner = hashed.where("not last").select("h1", "h2").distinct()
    maximal = ends.join(inner, ["h1", "h2"], "left_anti").select("conv_id", F.col("n_turns").cast("long"), "n_collapsed")
    shown = F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    rendered = (
        turns.join(maximal, "conv_id", "left_semi")
        .select("conv_id", F.struct("turn", "role", "text", shown.alias("shown")).alias("t"))
        .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .select("conv_id", F.array_join(F.transform("ts", lambda t: t["shown"]), "").alias("chat"))
    )
    return maximal.join(rendered, "conv_id").select("conv_id", "n_turns", "n_collapsed", "chat")
