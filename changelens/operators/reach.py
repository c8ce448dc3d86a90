"""Who depends on whom, transitively: impact and dependency sets, impact counts, cycle membership.

Counting how many modules each module reaches does not list the pairs. Ancestors are kept as bit sets
of chains, 64 to a row, merged by ``bit_or`` and advanced by the newly set bits only. The number of rounds is the depth
of the folded graph, or, where that is deep, about its logarithm, by shortcuts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import KEY
from changelens.functions.blocks import strong_parts
from changelens.operators.chains import FoldedGraph
from changelens.operators.components import components
from changelens.skew import hot_keys, salted_join
from changelens.storage import written, written_counting


#: Rounds after which a graph counts as deep.
SHALLOW = 12
#: Shortcuts of one length are at most so many times the edges, and are doubled so often.
SHORTCUTS = 4
DOUBLINGS = 40
#: Edges of connected parts that a task takes together.
PART_EDGES = 300_000
#: Tables of new bits after which they are merged into one.
BIT_TABLES = 8


def numbered_chains(folded: FoldedGraph) -> DataFrame:
    """Chains, each given a (block, bit). Numbers follow the order of a range partitioning,
    so the chains of one change fill consecutive blocks; written, as the numbering must not change."""
    ordered = (
        folded.chains.select(*KEY, "chain", "size")
        .repartitionByRange(*KEY, "chain")
        .sortWithinPartitions(*KEY, "chain")
        .withColumn("number", F.monotonically_increasing_id())
    )
    return written(ordered.withColumns({"block": _block("number"), "bit": _bit("number")}), "numbered")


def _block(number: str) -> Column:
    return F.shiftright(number, 6)


def _bit(number: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({number} % 64 AS int))")


@dataclass(frozen=True)
class Ancestry:
    """``numbered`` gives every chain a number, in the order of (key, chain), and a block and bit; ``bits(number, block, bits)`` the chains
    with a path to chain ``number``, itself included if it is on a cycle. The bits of a block may be dealt to several rows."""

    numbered: DataFrame
    bits: DataFrame

    def on_cycles(self) -> DataFrame:
        """The numbers of the chains that have a path to themselves."""
        return self.bits.filter((F.col("block") == _block("number")) & (_bit("number").bitwiseAND(F.col("bits")) != 0)).select("number")


def _led(table: pa.Table) -> pa.Table:
    number, leader = strong_parts(table.column("a").to_numpy(), table.column("b").to_numpy())
    return pa.table({"number": number, "leader": leader})


def _leaders(edges: DataFrame, n_edges: int) -> DataFrame:
    """``(number, leader)`` of the nodes that lie on cycles of ``edges(a, b)``: one node for each strongly connected part.
    Tasks take whole connected parts, ``PART_EDGES`` edges together; nodes of larger parts are left out."""
    parts = written(components(edges).withColumnRenamed("node", "a"), "parts")
    inside = written(edges.join(parts, "a"), "part-edges")
    heavy = inside.groupBy("part").agg(F.count("*").alias("n")).filter(F.col("n") > PART_EDGES)
    light = inside.join(heavy, "part", "left_anti").withColumn("task", F.pmod(F.xxhash64("part"), F.lit(-(-n_edges // PART_EDGES))))
    return written(light.groupBy("task").applyInArrow(_led, "number LONG, leader LONG"), "leaders")


def with_shortcuts(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` and further pairs that have a path of edges, so that far chains are few steps apart.

    The chains of a strongly connected part all have a step to one of them and back. Between the parts there are steps over
    2, 4, 8, ... of the edges, each made by joining the steps of half the length, as long as these are not more than
    ``SHORTCUTS`` times the first ones: in long narrow graphs they never are. Wide graphs end that early, and are shallow.
    """
    leaders = _leaders(edges, max(1, edges.count()))
    there = leaders.filter("number <> leader").select(F.col("number").alias("a"), F.col("leader").alias("b"))
    back = there.select(F.col("b").alias("a"), F.col("a").alias("b"))
    led = lambda end: leaders.select(F.col("number").alias(end), F.col("leader").alias(f"led_{end}"))
    joined = edges.join(led("a"), "a", "left").join(led("b"), "b", "left")
    between = joined.select(F.coalesce("led_a", "a").alias("a"), F.coalesce("led_b", "b").alias("b")).filter("a <> b").distinct()
    reach, seen = written_counting(between, "shortcuts", rows=F.lit(True))
    every, most = edges.unionByName(there).unionByName(back).unionByName(reach), SHORTCUTS * seen["rows"]
    for _ in range(DOUBLINGS):
        onward = reach.select(F.col("a").alias("b"), F.col("b").alias("c"))
        reach, seen = written_counting(reach.join(onward, "b").filter("a <> c").select("a", F.col("c").alias("b")).distinct(), "shortcuts", rows=F.lit(True))
        if not 0 < seen["rows"] <= most:
            break
        every = every.unionByName(reach)
    return written(every.distinct(), "steps-and-shortcuts")


def _merged(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).groupBy("number", "block").agg(F.bit_or("bits").alias("bits"))


def _spread(first: DataFrame, steps: DataFrame) -> DataFrame:
    """``(number, block, bits)``: which sources, 64 to a row, lead to each chain over one of ``steps(a, b)`` or more.
    ``first(number, block, bits)`` has the sources of the chains one step on.

    Bits are never written twice: a round looks up those it brings among the ones that are there, and adds a table of the
    new ones. A graph that is deeper than ``SHALLOW`` rounds gets shortcuts then, and its rounds are about the logarithm of its depth.
    """
    fresh, seen = written_counting(_merged([first]), "reaching", rows=F.lit(True))
    tables, rounds = [fresh], 1
    # From now on only chains that something leads to have bits.
    entered = written(steps.select(F.col("b").alias("a")).distinct(), "entered")
    steps = written(steps.join(entered, "a", "left_semi"), "onward-steps")
    while seen["rows"]:
        if rounds == SHALLOW or len(tables) > BIT_TABLES:
            tables = [written(_merged(tables), "reached")]
        if rounds == SHALLOW:
            steps, fresh = with_shortcuts(steps), tables[0]  # all bits go over the shortcuts
        rounds += 1
        moved = fresh.withColumnRenamed("number", "a").join(steps, "a").select(F.col("b").alias("number"), "block", "bits")
        arrived = written(_merged([moved]), "arrived")
        # Few arrive in most rounds; whether they are broadcast is decided by their written size.
        there = reduce(DataFrame.unionByName, tables).join(arrived.select("number", "block"), ["number", "block"], "left_semi")
        old = _merged([there]).withColumnRenamed("bits", "old")
        new = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        added = arrived.join(old, ["number", "block"], "left").select("number", "block", new.alias("bits")).filter("bits <> 0")
        fresh, seen = written_counting(added, "reaching", rows=F.lit(True))
        tables.append(fresh)
    return reduce(DataFrame.unionByName, tables)


def _steps(edges: DataFrame, numbered: DataFrame) -> DataFrame:
    """``edges(key, src, dst)`` by numbers ``(a, b)``."""
    source = numbered.select(*KEY, F.col("chain").alias("src"), F.col("number").alias("a"))
    target = numbered.select(*KEY, F.col("chain").alias("dst"), F.col("number").alias("b"))
    # Often many chains lead to few.
    few = written(target.join(edges.select(*KEY, "dst").distinct(), [*KEY, "dst"], "left_semi"), "targets")
    return written(edges.join(few, [*KEY, "dst"]).join(source, [*KEY, "src"]).select("a", "b"), "steps")


def ancestry(folded: FoldedGraph, numbered: DataFrame | None = None) -> Ancestry:
    """``numbered``: numbers that the chains, perhaps among others, have already."""
    numbered = numbered_chains(folded) if numbered is None else numbered
    steps = _steps(folded.edges, numbered)
    return Ancestry(numbered, _spread(steps.select(F.col("b").alias("number"), _block("a").alias("block"), _bit("a").alias("bits")), steps))


def _chain_ancestors(above: Ancestry) -> DataFrame:
    """Per chain with ancestors their number of modules, and whether the chain is on a cycle."""
    # What a chain has beside its first module, in binary: one bit set per block and binary digit, holding the chains whose
    # size has that digit. A row's total is then a bit count, and one more for each digit; single modules, the usual case, have none.
    digits = (
        above.numbered.filter("size > 1").withColumn("more", F.col("size") - 1)
        .select("block", "bit", "more", F.explode(F.sequence(F.lit(0), F.floor(F.log2("more")).cast("int"))).alias("digit"))
        .filter("shiftright(more, digit) & 1 = 1")
        .groupBy("block", "digit")
        .agg(F.bit_or("bit").alias("having"))
    )
    digits, seen = written_counting(digits, "digits", rows=F.lit(True))
    own = F.lit(False).alias("own")
    counted = above.bits.select("number", F.bit_count("bits").cast("long").alias("n"), own)
    if seen["rows"]:
        bits = above.bits.join(digits.select("block").distinct(), "block", "left_semi")
        hot = hot_keys(bits.groupBy("block").agg(F.count("*").alias("n")), ["block"])
        counted = counted.unionByName(salted_join(bits, digits, ["block"], "inner", hot, F.col("number")).select(
            "number", F.expr("shiftleft(cast(bit_count(bits & having) AS bigint), digit)").alias("n"), own))
    counted = counted.unionByName(above.on_cycles().select("number", F.lit(0).cast("long").alias("n"), F.lit(True).alias("own")))
    counts = written(counted.groupBy("number").agg(F.sum("n").alias("before"), F.bool_or("own").alias("on_cycle")), "ancestor-counts")
    return above.numbered.join(counts, "number").select(*KEY, "chain", "before", "on_cycle")


def module_reach(folded: FoldedGraph, above: Ancestry | None = None) -> DataFrame:
    """``(key, module, impact, on_cycle)`` for every edge endpoint: how many other modules import it,
    directly or not, and whether it is on an import cycle."""
    none = F.lit(None).cast("long")
    counts = _chain_ancestors(above or ancestry(folded)).withColumn("size", none)
    rings = folded.chains.filter("is_ring").select(*KEY, "chain", none.alias("before"), F.lit(True).alias("on_cycle"), "size")
    known = written(counts.unionByName(rings), "reach-of-chains")  # other chains have nothing above them
    hot = hot_keys(folded.chains, [*KEY, "chain"], "size")
    members = folded.members.filter(" AND ".join(f"{column} IS NOT NULL" for column in (*KEY, "chain")))
    joined = salted_join(members, known, [*KEY, "chain"], "left", hot, F.col("module"))
    on_cycle, before = F.coalesce("on_cycle", F.lit(False)), F.coalesce("before", F.lit(0))
    impact = (
        F.when(F.col("is_ring"), F.col("size") - 1)
        .when(on_cycle, before - 1)  # its own chain is among the ancestors
        .otherwise(before + F.col("pos"))
    )
    return joined.select(*KEY, "module", impact.alias("impact"), on_cycle.alias("on_cycle"))


def _numbers() -> Column:
    """The numbers whose bits are set in (``block``, ``bits``)."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", "bits", i).bitwiseAND(1) == 1)
    return F.transform(places, lambda i: F.col("block") * 64 + i)


def _chains_above(starts: DataFrame, above: Ancestry) -> DataFrame:
    """``(key, from, chain)``: the chains with a path to each chain in ``starts(key, chain)``."""
    begin = above.numbered.join(starts, [*KEY, "chain"]).select(F.col("chain").alias("from"), "number")
    listed = above.bits.join(begin, "number").select("from", F.explode(_numbers()).alias("number"))
    return listed.join(above.numbered.select(*KEY, "chain", "number"), "number").select(*KEY, "from", "chain")


def _chains_below(starts: DataFrame, above: Ancestry) -> DataFrame:
    """``(key, from, chain)``: the chains that each chain in ``starts(key, chain)`` has a path to."""
    own = above.numbered.join(starts, [*KEY, "chain"]).select(F.col("chain").alias("from"), "block", "bit")
    listed = above.bits.join(own, "block").filter(F.col("bit").bitwiseAND(F.col("bits")) != 0).select("from", "number")
    return listed.join(above.numbered.select(*KEY, "chain", "number"), "number").select(*KEY, "from", "chain")


def _searched(starts: DataFrame, folded: FoldedGraph, upstream: bool) -> DataFrame:
    """The same without an :class:`Ancestry`: a search from the given chains, 64 of them to a row."""
    chains = numbered_chains(folded)
    steps = _steps(folded.edges, chains)
    steps = steps.select(F.col("b").alias("a"), F.col("a").alias("b")) if upstream else steps
    begin = starts.join(chains, [*KEY, "chain"]).select(*KEY, "chain", F.col("number").alias("a"))
    ordered = begin.repartitionByRange(*KEY, "chain").sortWithinPartitions(*KEY, "chain")
    numbered = written(ordered.withColumn("source", F.monotonically_increasing_id()), "start-chains")
    first = numbered.join(steps, "a").select(F.col("b").alias("number"), _block("source").alias("block"), _bit("source").alias("bits"))
    bits = _spread(first, steps).withColumnRenamed("number", "reached")
    listed = bits.select(F.col("reached").alias("number"), F.explode(_numbers()).alias("source"))
    found = listed.join(numbered.select("source", F.col("chain").alias("from")), "source")
    return found.join(chains.select(*KEY, "chain", "number"), "number").select(*KEY, "from", "chain")


def _reached(starts: DataFrame, folded: FoldedGraph, upstream: bool, above: Ancestry | None) -> DataFrame:
    """``(key, start, module)``: all modules above (or below) the modules in ``starts(key, module)``.

    Chains are searched, not modules. With the ancestry of the whole graph at hand its bits are read, without a search.
    """
    begin = written(
        starts.select(*KEY, "module").distinct().join(folded.members, [*KEY, "module"]).select(
            *KEY, F.col("module").alias("start"), "chain", F.when(~F.col("is_ring"), F.col("pos")).alias("at")
        ),
        "starts",
    )
    from_chains = begin.select(*KEY, "chain").distinct()
    if above is None:
        chains = _searched(from_chains, folded, upstream)
    else:
        chains = (_chains_above if upstream else _chains_below)(from_chains, above)

    # Whole chains reached, and the start's own chain on one side of it (a ring: all of it).
    reached = begin.select(*KEY, "start", F.col("chain").alias("from")).join(chains, [*KEY, "from"]).select(*KEY, "start", "chain")
    spans = begin.unionByName(reached.withColumn("at", F.lit(None).cast("long")))
    hot = hot_keys(folded.chains, [*KEY, "chain"], "size")
    members = folded.members.select(*KEY, "chain", "module", "pos")
    found = salted_join(members, spans, [*KEY, "chain"], "inner", hot, F.col("module"))
    beside = F.col("pos") < F.col("at") if upstream else F.col("pos") > F.col("at")
    return (
        found.filter((F.col("at").isNull() | beside) & (F.col("module") != F.col("start")))
        .select(*KEY, "start", "module")
        .distinct()
    )


def impact(starts: DataFrame, folded: FoldedGraph, above: Ancestry | None = None) -> DataFrame:
    """Modules that import a start, directly or not. A start that is no node of the graph gives no rows."""
    return _reached(starts, folded, True, above)


def dependencies(starts: DataFrame, folded: FoldedGraph, above: Ancestry | None = None) -> DataFrame:
    """Modules a start depends on, directly or not."""
    return _reached(starts, folded, False, above)


def impact_counts(files: DataFrame, reach: DataFrame) -> DataFrame:
    """Impact count of every changed file, looked up under its ranking name; 0 when that is no node."""
    counts = reach.select(*KEY, F.col("module").alias("ranking_name"), "impact")
    return files.join(counts, [*KEY, "ranking_name"], "left").withColumn(
        "impact", F.coalesce("impact", F.lit(0))
    )


def has_cycles(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    """One row per change with a graph: does it contain an import cycle?"""
    flags = nodes.select(*KEY, F.lit(False).alias("on_cycle")).unionByName(reach.select(*KEY, "on_cycle"))
    return flags.groupBy(*KEY).agg(F.bool_or("on_cycle").alias("has_cycles"))


def node_flags(nodes: DataFrame, reach: DataFrame) -> DataFrame:
    return nodes.join(reach, [*KEY, "module"], "left").select(
        *KEY, "module", F.coalesce("on_cycle", F.lit(False)).alias("in_cycle")
    )


def edge_flags(edges: DataFrame, reach: DataFrame) -> DataFrame:
    """An edge is flagged when both ends are on cycles, even if the edge itself is on none."""
    on_cycle = reach.filter("on_cycle")
    src = on_cycle.select(*KEY, F.col("module").alias("src"), F.lit(True).alias("src_in"))
    dst = on_cycle.select(*KEY, F.col("module").alias("dst"), F.lit(True).alias("dst_in"))
    hot = hot_keys(edges.groupBy(*KEY, "dst").agg(F.count("*").alias("n")), [*KEY, "dst"])
    flagged = salted_join(edges.join(src, [*KEY, "src"], "left"), dst, [*KEY, "dst"], "left", hot, F.col("src"))
    both = F.coalesce(F.col("src_in") & F.col("dst_in"), F.lit(False))
    return flagged.select(*KEY, "src", "dst", both.alias("in_cycle"))
