"""Connected components by repeated contraction, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnstore.llm.common import checkpointed, discard


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (src, dst); a component is named by its smallest vertex.

    Each round points every vertex to its smallest neighbour, follows that pointer once more, and contracts the
    edges to what they point to. A minimum never moves, so when no edge is left all of a component points to it.
    Minima are combined before the shuffle, and a hub only recurs as a join key, which Spark can split.
    Loops and edges with a null end are ignored; without edges the result is empty.
    """
    low, high = F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")
    left = checkpointed(
        edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
        .select(low, high)
        .distinct()
    )
    labels = None
    for _ in range(rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        nearest = both.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("near"))
        points = nearest.select("id", F.least("id", "near").alias("to"))
        further = points.select(F.col("id").alias("to"), F.col("to").alias("at"))
        points = checkpointed(points.join(further, "to").select("id", F.col("at").alias("to")))
        before = labels
        if labels is None:
            labels = points.select("id", F.col("to").alias("component"))
        else:
            moved = points.select(F.col("id").alias("component"), "to")
            labels = labels.join(moved, "component", "left").select("id", F.coalesce("to", "component").alias("component"))
        labels = checkpointed(labels)
        src = points.select(F.col("id").alias("src"), F.col("to").alias("low"))
        dst = points.select(F.col("id").alias("dst"), F.col("to").alias("high"))
        met = left.join(src, "src").join(dst, "dst").where(F.col("low") != F.col("high"))
        after = checkpointed(met.select(F.least("low", "high").alias("src"), F.greatest("low", "high").alias("dst")).distinct())
        discard(left, points)
        if before is not None:
            discard(before)
        left = after
    else:
        raise RuntimeError(f"not connected after {rounds} rounds")
    if labels is None:
        return left.select(F.col("src").alias("id"), F.col("dst").alias("component"))
    discard(left)
    return labels
