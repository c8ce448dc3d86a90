"""All elementary import cycles, as rows ``(key, cycle, pos, module)``.

Rings come straight from the folded graph. Other cycles are grown as paths of chains from their smallest chain and
expanded to modules at the end. A cycle lies inside one strongly connected part, and inside one block of it (a set
of edges that no single chain separates), so paths stay in their block. A path is kept only while there is a way back
to its start that avoids the path; then every kept path is the beginning of a cycle, and the rows of all rounds are at
most the chains on all cycles. All cycles are listed; there can be exponentially many, which is the size of the answer.

Tasks split the connected parts of the graph, as many as have ``PART_EDGES`` edges together. A part with more does not fit
in a task: its edges on cycles come from the ancestry bits, they are one block, and paths in it grow without looking for
a way back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens import KEY
from changelens.functions.blocks import blocks, on_cycles
from changelens.operators.chains import FoldedGraph
from changelens.operators.components import components
from changelens.operators.reach import Ancestry, ancestry, numbered_chains
from changelens.skew import hot_keys, salted_join
from changelens.storage import written, written_counting

#: Edges of a part that a task splits into blocks, and of all parts that it takes together.
PART_EDGES = 300_000
#: Paths that a task looks for a way back for.
PATHS = 100_000
#: Marks of (path, chain) that a search keeps at once.
MARKS = 1 << 23

_STEP = "src LONG, dst LONG, size LONG, block LONG, small BOOLEAN"
_PATH = "block LONG, small BOOLEAN, start LONG, last LONG, path ARRAY<LONG>, starts ARRAY<LONG>, total LONG, closed BOOLEAN"


def _numbered_edges(folded: FoldedGraph, numbered: DataFrame) -> DataFrame:
    """Folded edges ``(a, b, size)`` by numbers, with the size of the target."""
    source = numbered.select(*KEY, F.col("chain").alias("src"), F.col("number").alias("a"))
    target = numbered.select(*KEY, F.col("chain").alias("dst"), F.col("number").alias("b"), "size")
    return folded.edges.join(target, [*KEY, "dst"]).join(source, [*KEY, "src"]).select("a", "b", "size")


def _edges_on_cycles(folded: FoldedGraph, above: Ancestry) -> DataFrame:
    """Those whose target has a path back to their source, both being on cycles then."""
    on_cycles = written(above.on_cycles(), "on-cycles")
    edges = _numbered_edges(folded, above.numbered)
    for end in ("a", "b"):
        edges = edges.join(on_cycles.select(F.col("number").alias(end)), end, "left_semi")
    target = above.numbered.select(F.col("number").alias("b"), "block", "bit")
    joined = edges.join(target, "b").join(above.bits.withColumnRenamed("number", "a"), ["a", "block"])
    return joined.filter(F.col("bit").bitwiseAND(F.col("bits")) != 0).select("a", "b", "size")


def _split(table: pa.Table) -> pa.Table:
    """The edges on cycles of some whole parts, with their blocks."""
    table = table.filter(pa.array(on_cycles(table.column("a").to_numpy(), table.column("b").to_numpy())))
    src, dst, edge = (table.column(c).to_numpy() for c in ("a", "b", "edge"))
    of = edge[blocks(src, dst)]
    return pa.table({"src": src, "dst": dst, "size": table.column("size"), "block": of, "small": np.ones(len(of), bool)})


def _in_blocks(folded: FoldedGraph, numbered: DataFrame, above: Ancestry | None) -> tuple[DataFrame, int]:
    """Edges on cycles ``(src, dst, size, block, small)`` and their number. ``small`` blocks fit in a task."""
    edges = _numbered_edges(folded, numbered) if above is None else _edges_on_cycles(folded, above)
    edges, seen = written_counting(edges.withColumn("edge", F.monotonically_increasing_id()), "numbered-edges", rows=F.lit(True))
    if not seen["rows"]:
        return edges, 0
    parts = written(components(edges).withColumnRenamed("node", "a"), "parts")
    inside = written(edges.join(parts, "a"), "part-edges")
    heavy = written(inside.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > PART_EDGES), "heavy-parts")
    light = inside.join(heavy, "part", "left_anti").withColumn("task", F.pmod(F.xxhash64("part"), F.lit(-(-seen["rows"] // PART_EDGES))))
    steps = light.groupBy("task").applyInArrow(_split, _STEP)
    if not heavy.isEmpty():
        whole = inside.join(heavy, "part", "left_semi").select("a", "b", "size", "part")
        if above is None:
            chains = whole.select(F.col("a").alias("number")).distinct().join(numbered, "number").select(*KEY, F.col("chain").alias("src"))
            rest = FoldedGraph(folded.members, folded.chains, written(folded.edges.join(chains, [*KEY, "src"], "left_semi"), "heavy-edges"))
            whole = whole.join(_edges_on_cycles(rest, ancestry(rest, numbered)).select("a", "b"), ["a", "b"], "left_semi")
        named = whole.select(F.col("a").alias("src"), F.col("b").alias("dst"), "size", F.col("part").alias("block"), F.lit(False).alias("small"))
        steps = steps.unionByName(named)
    steps, seen = written_counting(steps, "steps", rows=F.lit(True))
    return steps, seen["rows"]


def _returning(paths: pa.Table, edges: pa.Table) -> pa.Table:
    """The paths from whose end a way leads back to the start, over larger chains that are not on the path."""
    if not paths.num_rows:
        return paths.drop_columns(["task"])
    block, block_of = np.unique(edges.column("block").to_numpy(), return_inverse=True)
    number = np.unique(np.concatenate([edges.column(c).to_numpy() for c in ("src", "dst")]))
    place = lambda b, x: b * len(number) + np.searchsorted(number, x)
    src, dst = (place(block_of, edges.column(c).to_numpy()) for c in ("src", "dst"))
    nodes = np.unique(np.concatenate([src, dst]))
    order = np.argsort(src, kind="stable")
    heads = np.searchsorted(nodes, dst[order])
    at = np.searchsorted(src[order], nodes), np.searchsorted(src[order], nodes, "right")
    first = np.searchsorted(nodes, np.arange(len(block)) * len(number))  # nodes are by block, then by number
    width = int(np.diff(np.append(first, len(nodes))).max())

    of = np.searchsorted(block, paths.column("block").to_numpy())
    lists = paths.column("path").combine_chunks()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    on_path = np.searchsorted(nodes, place(np.repeat(of, np.diff(bounds)), lists.flatten().to_numpy()))
    start, last = (np.searchsorted(nodes, place(of, paths.column(c).to_numpy())) for c in ("start", "last"))
    back = np.zeros(len(of), bool)
    step = max(1, MARKS // width)
    for low in range(0, len(of), step):
        high = min(len(of), low + step)
        seen = np.zeros((high - low, width), bool)
        owner = np.repeat(np.arange(high - low), np.diff(bounds[low : high + 1]))
        seen[owner, on_path[bounds[low] : bounds[high]] - first[of[low:high]][owner]] = True
        path, node = np.arange(high - low), last[low:high]
        while len(path):
            n = at[1][node] - at[0][node]
            ends = np.cumsum(n)
            head = heads[np.arange(int(n.sum())) + np.repeat(at[0][node] - (ends - n), n)]
            path = np.repeat(path, n)
            back[low + path[head == start[low + path]]] = True
            local = head - first[of[low + path]]
            on = (head > start[low + path]) & ~seen[path, local] & ~back[low + path]
            keys = np.unique(path[on] * width + local[on])
            path, local = keys // width, keys % width
            seen[path, local] = True
            node = local + first[of[low + path]]
    return paths.drop_columns(["task"]).filter(pa.array(back))


def _with_way_back(paths: DataFrame, steps: DataFrame, n_paths: int) -> DataFrame:
    """The paths that can still be closed. Paths of one block share tasks, those of a block with many are spread."""
    if n_paths <= PATHS:
        dealt = paths.withColumn("task", F.lit(0).cast("long"))
    else:
        counts = written(paths.groupBy("block").agg(F.ceil(F.count("*") / PATHS).alias("pieces")), "block-paths")
        spread = F.xxhash64("block", F.pmod(F.xxhash64("path"), F.col("pieces")))
        dealt = paths.join(counts, "block").withColumn("task", F.pmod(spread, F.lit(-(-n_paths // PATHS)))).drop("pieces")
    needed = dealt.select("block", "task").distinct().join(steps.select("block", "src", "dst"), "block")
    needed = needed.select(*[F.col(c).alias(c) for c in needed.columns])  # columns of its own, apart from those of the paths
    return dealt.groupBy("task").cogroup(needed.groupBy("task")).applyInArrow(_returning, paths.schema)


def _closed_paths(steps: DataFrame, sizes: DataFrame) -> DataFrame:
    """All cycles as the numbers of their chains, with the position of each within the cycle."""
    # `starts` holds the position of each chain of the path, `total` its length so far.
    begin = steps.select("block", "small", F.col("src").alias("start")).distinct().join(sizes, "start")
    zero = F.lit(0).cast("long")
    paths = begin.select(
        "block", "small", "start", F.col("start").alias("last"), F.array("start").alias("path"), F.array(zero).alias("starts"),
        F.col("start_size").alias("total"), F.lit(False).alias("closed"),
    )
    onward = steps.select("block", F.col("src").alias("last"), "dst", "size")
    closes = F.col("dst") == F.col("start")
    found = None
    while True:
        grown = (
            paths.join(onward, ["block", "last"])
            .filter(closes | ((F.col("dst") > F.col("start")) & ~F.array_contains("path", F.col("dst"))))
            .select(
                "block", "small", "start", F.col("dst").alias("last"),
                F.when(closes, F.col("path")).otherwise(F.concat("path", F.array("dst"))).alias("path"),
                F.when(closes, F.col("starts")).otherwise(F.concat("starts", F.array("total"))).alias("starts"),
                (F.col("total") + F.when(closes, 0).otherwise(F.col("size"))).alias("total"),
                closes.alias("closed"),
            )
        )
        grown, seen = written_counting(grown, "paths", tested=~F.col("closed") & F.col("small"), open=~F.col("closed"))
        closed = grown.filter("closed").select("path", "starts")
        found = closed if found is None else found.unionByName(closed)
        if not seen["open"]:
            return found
        paths = grown.filter("NOT closed")
        if seen["tested"]:
            tested = _with_way_back(paths.filter("small"), steps, seen["tested"])
            paths, seen = written_counting(tested.unionByName(paths.filter("NOT small")), "open-paths", rows=F.lit(True))
            if not seen["rows"]:
                return found


def simple_cycles(folded: FoldedGraph, above: Ancestry | None = None) -> DataFrame:
    rings = folded.members.filter("is_ring").select(*KEY, F.col("chain").alias("cycle"), "pos", "module")

    numbered = numbered_chains(folded) if above is None else above.numbered
    steps, n_steps = _in_blocks(folded, numbered, above)
    if not n_steps:
        return rings
    cycles = _closed_paths(steps, numbered.select(F.col("number").alias("start"), F.col("size").alias("start_size")))

    at = cycles.select("path", F.posexplode(F.arrays_zip("path", "starts")).alias("i", "at"))
    names = numbered.select(*KEY, "chain", F.col("number").alias("n"))
    stations = at.select("path", "i", F.col("at.path").alias("n"), F.col("at.starts").alias("offset")).join(names, "n")
    listed = stations.groupBy(*KEY, "path").agg(F.sort_array(F.collect_list(F.struct("i", "chain", "offset"))).alias("at"))
    stations = listed.select(*KEY, F.array_join("at.chain", ">").alias("cycle"), F.explode("at").alias("at"))
    stations = stations.select(*KEY, "cycle", "at.chain", "at.offset")
    hot = hot_keys(folded.chains, [*KEY, "chain"], "size")
    members = folded.members.filter("NOT is_ring").select(*KEY, "chain", "module", "pos")
    grown = salted_join(members, stations, [*KEY, "chain"], "inner", hot, F.col("module"))
    return rings.unionByName(grown.select(*KEY, "cycle", (F.col("offset") + F.col("pos")).alias("pos"), "module"))
