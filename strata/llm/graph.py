"""Connected components of an edge table, by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize


def contract(edges: DataFrame) -> DataFrame:
    """node, comp: for each node of the edges (a, b) the least node that it is connected with.

    Each round, every vertex hooks to its least neighbour, chains of hooks are followed to
    their end, and edges are relabelled; edges inside a component go. Nothing is
    collected but counts. Nulls are not allowed in a and b.
    """
    current = materialize(edges.select("a", "b").where("a <> b").distinct())
    labels: DataFrame | None = None
    while current.head(1):
        both = current.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(current.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hook = materialize(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("comp")))
        while True:
            up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            jumped = materialize(hook.join(up, "comp").select("node", F.col("top").alias("comp"), (F.col("top") != F.col("comp")).alias("moved")))
            hook = jumped.select("node", "comp")
            if not jumped.where("moved").head(1):
                break
        if labels is None:
            labels = hook
        else:
            step = hook.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            labels = materialize(labels.join(step, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")))
        left = hook.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        right = hook.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        current = materialize(current.join(left, "a").join(right, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).limit(0)
    return labels
