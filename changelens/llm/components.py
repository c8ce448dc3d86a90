"""Connected components, and the work of comparing nodes within them in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm import texts
from changelens.storage import written

#: Weight (entries or bytes) of the nodes that one task compares.
TASK_WEIGHT = 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, one node for all that are joined by ``edges`` (``a``, ``b``), for the nodes of ``edges``.

    Each round moves every node to the least node next to it, and from there to the least one next to that.
    Edges follow, and those within one node go. Ids are hashes, so a round leaves a fraction of the nodes, also
    of long chains. At the end the moves are put together, the last and smallest first.
    """
    moves = []
    edges = written(edges.select("a", "b").filter("a != b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("to")), "least")
        onward = least.select(F.col("node").alias("to"), F.col("to").alias("root"))
        moves.append(written(least.join(onward, "to").select("node", "root"), "moves"))
        of = lambda side: moves[-1].select(F.col("node").alias(side), F.col("root").alias(f"new_{side}"))
        moved = edges.join(of("a"), "a").join(of("b"), "b")
        pairs = moved.filter("new_a != new_b").select(F.least("new_a", "new_b").alias("a"), F.greatest("new_a", "new_b").alias("b"))
        edges = written(pairs.distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves.pop()
    while moves:
        end = found.select(F.col("node").alias("root"), F.col("root").alias("end"))
        found = written(moves.pop().join(end, "root", "left").select("node", F.coalesce("end", "root").alias("root")), "roots")
    return found


def clusters(index: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the nodes that share keys of ``index`` (``key``, ``node``), directly or by others."""
    index = written(index.distinct(), "index")
    shared = index.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader != last")
    leaders = written(shared.select("key", "leader"), "leaders")  # so that both sides of the join are shuffled rows
    return components(index.join(leaders, "key").select(F.col("node").alias("a"), F.col("leader").alias("b")).filter("a != b").distinct())


def linked(
    nodes: DataFrame, cluster: DataFrame, weight: str, columns: list[str], links: Callable[[pa.Table], np.ndarray], together: bool = False
) -> DataFrame:
    """``node`` and ``root`` after comparing all nodes within each cluster.

    ``links(table)`` has the rows (``node`` and ``columns``) of one cluster or of two of its tiles, and returns for
    each row the number of a row that it is linked to, directly or by others: the same for all that are. With
    ``together`` it gets the clusters of a task at once.
    Small clusters share tasks. A cluster that is heavier than ``TASK_WEIGHT`` is cut into tiles by a hash of the
    node, and each two tiles are compared in a task of their own.
    """
    joined = written(nodes.select("node", F.col(weight).cast("long").alias("_w"), *columns).dropDuplicates(["node"]).join(cluster, "node"), "members")
    weights = written(joined.groupBy("root").agg(F.sum("_w").alias("_weight")), "weights")
    total, heavy = weights.agg(F.sum("_weight"), F.count_if(F.col("_weight") > TASK_WEIGHT)).first()
    n_tasks = max(1, -(-4 * int(total or 0) // TASK_WEIGHT))
    tiles = F.when(F.col("_weight") > TASK_WEIGHT, F.ceil(2 * F.col("_weight") / TASK_WEIGHT).cast("long")).otherwise(F.lit(1).cast("long"))
    placed = joined.join(weights, "root").withColumn("_tiles", tiles)
    tile = F.pmod(F.xxhash64("node"), F.col("_tiles"))
    others = F.when(F.col("_tiles") > 1, F.filter(F.sequence(F.lit(0).cast("long"), F.col("_tiles") - 1), lambda j: j != F.col("_tile"))).otherwise(
        F.array(F.lit(0).cast("long"))
    )
    spread = placed.withColumn("_tile", tile).withColumn("_other", F.explode(others))
    alone = F.col("_tiles") == 1
    tasked = spread.select(
        F.when(alone, F.pmod(F.xxhash64("root"), F.lit(n_tasks))).otherwise(F.col("root")).alias("_a"),
        F.when(alone, F.lit(-1).cast("long")).otherwise(F.least("_tile", "_other")).alias("_b"),
        F.greatest("_tile", "_other").alias("_c"),
        "node",
        "root",
        *columns,
    )

    def run(table: pa.Table) -> pa.Table:
        root = table.column("root").to_numpy()
        order = np.lexsort((table.column("node").to_numpy(), root))
        table = table.take(pa.array(order))
        root = root[order]
        cut = np.array([0, len(root)]) if together else np.flatnonzero(np.concatenate([[True], root[1:] != root[:-1], [True]]))
        node, to = table.column("node").to_numpy(), []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            of = links(table.slice(a, b - a)) if b - a > 1 else np.zeros(b - a, np.int64)
            least = np.full(b - a, np.iinfo(np.int64).max)
            np.minimum.at(least, of, node[a:b])
            to.append(least[of])
        return pa.table({"node": node, "root": np.concatenate(to)})

    found = written(tasked.groupBy("_a", "_b", "_c").applyInArrow(texts.group_then_give_back(run), "node LONG, root LONG"), "linked")
    if not heavy:
        return found
    return components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).filter("a != b"))


class Sets:
    """Union-find over row numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def roots(self) -> np.ndarray:
        return np.fromiter((self.find(x) for x in range(len(self.up))), np.int64, len(self.up))
