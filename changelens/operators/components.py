"""Connected components of a graph with numbered nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.storage import written, written_counting


def components(edges: DataFrame) -> DataFrame:
    """``(node, part)`` for the nodes of ``edges(a, b)``: equal parts for nodes that are joined, in either direction.

    Nodes are known by hashes of their numbers. In a round each takes the least one near it, and then the least one near
    that; edges follow, and those inside one node go. As hashes have no order along a path, each round leaves a fraction
    of the nodes, so there are logarithmically many rounds. Two parts whose hashes collide are one part.
    """
    ends = edges.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    open_, seen = written_counting(ends.filter("a <> b").distinct(), "component-edges", rows=F.lit(True))
    rounds = []
    while seen["rows"]:
        near = open_.unionAll(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("part"))
        least = written(least, "least")
        further = least.select(F.col("node").alias("part"), F.col("part").alias("next"))
        moved = written(least.join(further, "part").select("node", F.col("next").alias("part")), "moved")
        rounds.append(moved)
        left = moved.select(F.col("node").alias("a"), F.col("part").alias("to_a"))
        right = moved.select(F.col("node").alias("b"), F.col("part").alias("to_b"))
        followed = open_.join(left, "a").join(right, "b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        open_, seen = written_counting(followed.filter("a <> b").distinct(), "component-edges", rows=F.lit(True))

    parts = rounds.pop() if rounds else None
    while rounds:  # the last round has the fewest nodes
        onward = parts.select(F.col("node").alias("part"), F.col("part").alias("next"))
        before = rounds.pop()
        parts = written(before.join(onward, "part", "left").select("node", F.coalesce("next", "part").alias("part")), "parts")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if parts is None:
        return nodes.select("node", F.xxhash64("node").alias("part"))
    named = parts.select(F.col("node").alias("h"), "part")
    joined = nodes.withColumn("h", F.xxhash64("node")).join(named, "h", "left")
    return joined.select("node", F.coalesce("part", "h").alias("part"))
