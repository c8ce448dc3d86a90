"""Import chains folded into single nodes.

A chain is a maximal run of modules ``a -> b -> c`` in which each step is the only edge leaving one
module and the only edge entering the next. Whatever reaches its head passes through all of it, so a
chain can stand as one node, and an import cycle with no other edges becomes a chain that bites its
tail. Lengths and positions come from pointer jumping: the number of rounds is the logarithm of the
longest chain, and every round keeps one row per module.

A chain lies inside one change, so tasks fold whole changes, ``TASK_EDGES`` edges together. A change of more than
``CHANGE_EDGES`` does not go to a task: it is folded by joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from changelens import KEY
from changelens.functions import runs
from changelens.storage import new_path, written, written_counting

#: Edges of a change that a task folds, and of all changes that it takes together.
CHANGE_EDGES = 300_000
TASK_EDGES = 50_000

# Ship the helper with the job, as that of the code facts.
cloudpickle.register_pickle_by_value(runs)

_FOLDED = "module STRING, chain STRING, pos LONG, is_ring BOOLEAN, size LONG, dst STRING"


@dataclass(frozen=True)
class FoldedGraph:
    """``members(key, module, chain, pos, is_ring)`` has every edge endpoint, ``chains`` one row per
    chain with its size, ``edges(key, src, dst)`` the edges between chains. A chain is named after its
    head; a ring, having none, after its smallest module. A ring has no edges to other chains."""

    members: DataFrame
    chains: DataFrame
    edges: DataFrame


def _links(edges: DataFrame) -> DataFrame:
    """Edges that are the only one out of ``src`` and the only one into ``dst``. Those out of a module are only counted where it
    has an edge that is the only one into another."""
    once = lambda table, end: table.groupBy(*KEY, end).agg(F.count("*").alias("n")).filter("n = 1").select(*KEY, end)
    only_in = written(edges.join(written(once(edges, "dst"), "entered-once"), [*KEY, "dst"], "left_semi").select(*KEY, "src", "dst"), "only-in")
    only_out = once(edges.join(only_in.select(*KEY, "src").distinct(), [*KEY, "src"], "left_semi"), "src")
    return only_in.join(only_out, [*KEY, "src"], "left_semi")


def _jump(table: DataFrame) -> DataFrame:
    """Double the distance every open row looks back over.

    ``back`` is the module ``dist`` steps before ``module``; ``low`` the smallest (module, steps back)
    among those passed. A row whose ``back`` has no row itself has arrived at the head.
    """
    there = table.select(
        *KEY, F.col("module").alias("back"), F.col("back").alias("next_back"), F.col("dist").alias("next_dist"),
        F.col("low").alias("next_low"), F.col("done").alias("next_done"),
    )
    found = F.col("next_back").isNotNull()
    next_low = F.struct(
        F.col("next_low.name").alias("name"), (F.col("next_low.steps") + F.col("dist")).alias("steps")
    )
    low = F.when(found, F.least("low", next_low)).otherwise(F.col("low"))
    opened = table.filter("NOT done").join(there, [*KEY, "back"], "left").select(
        *KEY, "module",
        F.coalesce("next_back", "back").alias("back"),
        (F.col("dist") + F.coalesce("next_dist", F.lit(0))).alias("dist"),
        low.alias("low"),
        (~found | F.col("next_done")).alias("done"),
        (F.col("moved") | (low["name"] != F.col("low.name"))).alias("moved"),
    )
    return table.filter("done").unionByName(opened)


def _jumped(edges: DataFrame) -> FoldedGraph:
    """Chains of changes of any size, by joins."""
    links = _links(edges)
    table = links.select(
        *KEY, F.col("dst").alias("module"), F.col("src").alias("back"), F.lit(1).cast("long").alias("dist"),
        F.struct(F.col("dst").alias("name"), F.lit(0).cast("long").alias("steps")).alias("low"),
        F.lit(False).alias("done"), F.lit(False).alias("moved"),
    )
    table, seen = written_counting(table, "links", open=~F.col("done"))
    # A chain row closes once its head is near enough. Rows on a ring never close; they are finished
    # when a doubling lowers no minimum any more, as the windows of a ring then all agree.
    while seen["open"]:
        before = seen["open"]
        # Two doublings per written table: their shuffles of the same input are shared.
        doubled = _jump(_jump(table.withColumn("moved", F.lit(False))))
        table, seen = written_counting(doubled, "links", open=~F.col("done"), moved=F.col("moved"))
        if seen["open"] == before and not seen["moved"]:
            break

    inner = written(table.select(
        *KEY, "module",
        F.when(F.col("done"), F.col("back")).otherwise(F.col("low.name")).alias("chain"),
        F.when(F.col("done"), F.col("dist")).otherwise(F.col("low.steps")).alias("pos"),
        (~F.col("done")).alias("is_ring"),
    ), "linked-modules")
    ends = edges.select(*KEY, F.explode(F.array("src", "dst")).alias("module")).distinct()
    members = written(
        ends.join(inner, [*KEY, "module"], "left").select(
            *KEY, "module", F.coalesce("chain", "module").alias("chain"),
            F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("is_ring", F.lit(False)).alias("is_ring"),
        ),
        "members",
    )
    # The first module of a chain, or the smallest of a ring, has the chain's name.
    sizes = inner.groupBy(*KEY, "chain").agg((F.count("*") + F.when(F.bool_or("is_ring"), 0).otherwise(1)).alias("size"))
    sizes = written(sizes, "chain-sizes")
    heads = members.filter(F.col("module").eqNullSafe(F.col("chain"))).select(*KEY, "chain", "is_ring")
    chains = heads.join(sizes, [*KEY, "chain"], "left").select(*KEY, "chain", F.coalesce("size", F.lit(1)).alias("size"), "is_ring")
    # An edge that is no link leaves the tail of one chain and enters the head of another (or its own).
    linked = table.select(*KEY, F.col("module").alias("dst"))
    named = " AND ".join(f"{column} IS NOT NULL" for column in (*KEY, "src"))
    outer = (
        edges.filter(named)
        .join(linked, [*KEY, "dst"], "left_anti")
        .join(inner.select(*KEY, F.col("module").alias("src"), "chain"), [*KEY, "src"], "left")
        .select(*KEY, F.coalesce("chain", "src").alias("src"), "dst")
    )
    return FoldedGraph(members, written(chains, "chains"), written(outer, "chain-edges"))


def _in_tasks(edges: DataFrame, n_edges: int) -> FoldedGraph:
    """Chains of changes that fit in a task."""
    schema = T.StructType([*edges.select(*KEY).schema.fields, *T.StructType.fromDDL(_FOLDED).fields])
    dealt = edges.withColumn("task", F.pmod(F.xxhash64(*KEY), F.lit(-(-n_edges // TASK_EDGES))))
    path = new_path(edges.sparkSession, "folded")
    dealt.groupBy("task").applyInArrow(runs.fold(KEY, to_arrow_schema(schema)), schema).write.parquet(path)
    folded = lambda: edges.sparkSession.read.schema(schema).parquet(path)
    members = folded().filter("dst IS NULL").select(*KEY, "module", "chain", "pos", "is_ring")
    chains = folded().filter("size IS NOT NULL").select(*KEY, "chain", "size", "is_ring")
    return FoldedGraph(members, chains, folded().filter("dst IS NOT NULL").select(*KEY, F.col("chain").alias("src"), "dst"))


def fold_chains(edges: DataFrame) -> FoldedGraph:
    """Fold all chains of all changes. ``edges`` must be distinct and without self-loops."""
    named = F.lit(True)
    for column in (*KEY, "src", "dst"):
        named = named & F.col(column).isNotNull()
    changes = edges.groupBy(*KEY).agg(F.count("*").alias("n"), (F.bool_and(named) & (F.count("*") <= CHANGE_EDGES)).alias("fits"))
    n_edges, n_others, n_changes = changes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(~F.col("fits")), F.count("*")).first()
    if not n_others:
        return _in_tasks(edges, max(1, n_edges))
    if n_others == n_changes:
        return _jumped(edges)
    others = written(changes.filter("NOT fits").select(*KEY, F.lit(True).alias("apart")), "other-changes")
    joined = edges.join(others, [edges[key].eqNullSafe(others[key]) for key in KEY], "left")
    marked = joined.select(*[edges[c] for c in edges.columns], F.coalesce("apart", F.lit(False)).alias("apart"))
    marked = written(marked, "marked-edges")
    small, large = _in_tasks(marked.filter("NOT apart").drop("apart"), max(1, n_edges)), _jumped(marked.filter("apart").drop("apart"))
    return FoldedGraph(*(getattr(small, part).unionByName(getattr(large, part)) for part in ("members", "chains", "edges")))
