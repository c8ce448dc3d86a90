"""Import graphs, transitive reach and cycles, against brute force on small graphs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens import skew
from changelens.functions.blocks import blocks, on_cycles
from changelens.operators import chains, cycles, import_graph, reach
from changelens.operators.chains import fold_chains
from changelens.operators.code_facts import code_facts
from changelens.operators.components import components
from changelens.plans.review import ImportGraphs
from changelens.storage import written, written_counting

EDGE = "repo STRING, pr_number LONG, src STRING, dst STRING"


def _reachable(edges):
    nodes = {n for e in edges for n in e}
    after = {n: {d for s, d in edges if s == n} for n in nodes}
    result = {}
    for n in nodes:
        seen, todo = set(), list(after[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        result[n] = seen
    return result


def _simple_cycles(edges):
    after = {}
    for s, d in edges:
        after.setdefault(s, []).append(d)
    found = set()

    def grow(path):
        for d in after.get(path[-1], []):
            if d == path[0]:
                found.add(tuple(path))
            elif d > path[0] and d not in path:
                grow(path + [d])

    for n in after:
        grow([n])
    return found


def _graphs():
    """Edge sets of several shapes, one change each."""
    rng = random.Random(7)
    name = "m{:03d}".format
    shapes = [
        {(name(i), name(i + 1)) for i in range(70)},  # a chain longer than one block of bits
        {(name(i), name((i + 1) % 33)) for i in range(33)},  # a ring
        {("a", "b"), ("b", "a")},
        {("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("d", "e"), ("z", "a")},  # chain into a cycle and out
        {("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "b")},  # cycles sharing nodes
        {(name(i), "utils") for i in range(150)} | {("utils", "core"), ("core", "base")},  # a hot target
        {(name(2 * i + a), name(2 * i + 2 + b)) for i in range(6) for a in (0, 1) for b in (0, 1)},  # ladder
    ]
    for n, m in ((8, 10), (12, 16), (30, 34), (200, 150)):
        for _ in range(3):
            pairs = {(name(rng.randrange(n)), name(rng.randrange(n))) for _ in range(m)}
            shapes.append({(s, d) for s, d in pairs if s != d})
    for n in (15, 40):  # acyclic
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(2 * n)}
        shapes.append({(name(a), name(b)) for a, b in pairs})
    return shapes


@pytest.fixture(scope="module")
def graphs(spark):
    shapes = _graphs()
    rows = [("r", k, s, d) for k, shape in enumerate(shapes) for s, d in shape]
    edges = written(spark.createDataFrame(rows, EDGE).repartition(5), "edges")
    return shapes, edges, fold_chains(edges)


def test_module_reach(graphs):
    shapes, edges, folded = graphs
    rows = reach.module_reach(folded).collect()
    got = {(r.pr_number, r.module): (r.impact, r.on_cycle) for r in rows}
    assert len(got) == len(rows)
    want = {}
    for k, shape in enumerate(shapes):
        after = _reachable(shape)
        for n in after:
            want[k, n] = (sum(n in after[o] for o in after if o != n), n in after[n])
    assert got == want


def test_folding_leaves_no_chain_unfolded(graphs):
    _, _, folded = graphs
    by_change = {}
    for e in folded.edges.collect():
        by_change.setdefault(e.pr_number, []).append((e.src, e.dst))
    assert 0 not in by_change and 1 not in by_change  # one chain, one ring: nothing left
    ring = folded.members.filter("pr_number = 1 AND is_ring").collect()
    assert {(r.module, r.pos, r.chain) for r in ring} == {(f"m{i:03d}", i, "m000") for i in range(33)}


def _parts(folded):
    columns = {"members": ["module", "chain", "pos", "is_ring"], "chains": ["chain", "size", "is_ring"], "edges": ["src", "dst"]}
    return {part: sorted(map(repr, getattr(folded, part).select("repo", "pr_number", *c).collect())) for part, c in columns.items()}


def test_small_changes_are_folded_without_rounds(graphs, monkeypatch):
    _, edges, folded = graphs
    by_joins = _parts(chains._jumped(edges))
    monkeypatch.setattr(chains, "_jump", None)  # a round
    assert _parts(chains.fold_chains(edges)) == _parts(folded) == by_joins


def test_large_changes_and_unnamed_modules_are_folded_by_joins(graphs, monkeypatch):
    _, edges, _ = graphs
    more = [("r", 900, None, "a"), ("r", 900, "a", "b"), ("r", None, "a", "b"), (None, 1, "b", "c"), ("r", 901, "s", "s"), ("r", 901, "s", "ß"),
            ("r", 902, "x", "y"), ("r", 902, "x", "y"), ("r", 903, "é", "z"), ("r", 903, "z", "é")]
    every = written(edges.unionByName(edges.sparkSession.createDataFrame(more, EDGE)), "edges")
    by_joins = _parts(chains._jumped(every))
    for change_edges, task_edges in ((chains.CHANGE_EDGES, chains.TASK_EDGES), (12, 20)):
        monkeypatch.setattr(chains, "CHANGE_EDGES", change_edges)
        monkeypatch.setattr(chains, "TASK_EDGES", task_edges)
        assert _parts(chains.fold_chains(every)) == by_joins


def test_ancestors_and_dependencies(graphs):
    shapes, edges, folded = graphs
    starts = [("r", k, n) for k, shape in enumerate(shapes) for n in sorted({x for e in shape for x in e})[:3]]
    starts.append(("r", 0, "unknown"))
    table = edges.sparkSession.createDataFrame(starts, "repo STRING, pr_number LONG, module STRING")
    above = reach.ancestry(folded)
    found = [[reach.impact(table, folded, a), reach.dependencies(table, folded, a)] for a in (None, above)]
    (up, down), read = ([{(r.pr_number, r.start, r.module) for r in rows.collect()} for rows in both] for both in found)
    assert read == [up, down]
    want_up, want_down = set(), set()
    for k, shape in enumerate(shapes):
        after = _reachable(shape)
        for _, pr, n in starts:
            if pr == k and n in after:
                want_up |= {(k, n, o) for o in after if n in after[o] and o != n}
                want_down |= {(k, n, o) for o in after[n] if o != n}
    assert up == want_up
    assert down == want_down


def test_simple_cycles(graphs):
    shapes, edges, _ = graphs
    small = [k for k, shape in enumerate(shapes) if len(shape) <= 40]
    few = edges.filter(edges.pr_number.isin(small))
    got = {}
    for r in cycles.simple_cycles(fold_chains(few)).collect():
        got.setdefault((r.pr_number, r.cycle), {})[r.pos] = r.module
    found = {}
    for (k, _), at in got.items():
        assert sorted(at) == list(range(len(at)))
        path = [at[i] for i in range(len(at))]
        low = path.index(min(path))
        cycle = tuple(path[low:] + path[:low])
        assert cycle not in found.setdefault(k, set())
        found[k].add(cycle)
    assert found == {k: c for k in small if (c := _simple_cycles(shapes[k]))}


def _ladder(links, name="m{:05d}"):
    """Rungs ``c -> p, q -> next c -> c``: two cycles a link, and very many paths that lead nowhere."""
    c, p, q = (lambda i, k=k: name.format(3 * i + k) for k in range(3))
    return {e for i in range(links) for e in [(c(i), p(i)), (c(i), q(i)), (p(i), c(i + 1)), (q(i), c(i + 1)), (c(i + 1), c(i))]}


def _listed(spark, shapes):
    rows = [("r", k, s, d) for k, shape in enumerate(shapes) for s, d in shape]
    found = cycles.simple_cycles(fold_chains(written(spark.createDataFrame(rows, EDGE), "edges")))
    return found.groupBy("pr_number", "cycle").agg(F.sort_array(F.collect_list("module")).alias("modules")).collect()


def test_few_cycles_need_few_paths(spark, monkeypatch):
    kept = []

    def counting(df, label, **conditions):
        table, seen = written_counting(df, label, **conditions)
        if label == "open-paths":
            kept.append(seen["rows"])
        return table, seen

    monkeypatch.setattr(cycles, "written_counting", counting)
    two_way = {e for i in range(60) for e in [(f"t{i:02d}", f"t{i + 1:02d}"), (f"t{i + 1:02d}", f"t{i:02d}")]}
    found = _listed(spark, [_ladder(40), two_way])
    assert sorted(len(r.modules) for r in found) == [2] * 60 + [3] * 80
    assert sum(kept) <= 60 * 2 + 80 * 3


@pytest.mark.parametrize(("edges", "paths", "marks"), [(300_000, 2, 50), (4, 100_000, 1 << 23), (4, 1, 1)])
def test_cycles_in_many_tasks_and_in_parts_too_large_for_one(spark, monkeypatch, edges, paths, marks):
    monkeypatch.setattr(cycles, "PART_EDGES", edges)
    monkeypatch.setattr(cycles, "PATHS", paths)
    monkeypatch.setattr(cycles, "MARKS", marks)
    rng = random.Random(11)
    name = "n{:02d}".format
    shapes = [_ladder(3), {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}]
    shapes += [{(name(a), name(b)) for a, b in ((rng.randrange(7), rng.randrange(7)) for _ in range(16)) if a != b} for _ in range(4)]
    got = sorted((r.pr_number, r.modules) for r in _listed(spark, shapes))
    assert got == sorted((k, sorted(c)) for k, shape in enumerate(shapes) for c in _simple_cycles(shape))


@pytest.mark.parametrize(("shallow", "part_edges"), [(2, 300_000), (2, 10), (12, 300_000)])
def test_deep_graphs_take_few_rounds(spark, monkeypatch, shallow, part_edges):
    """A ladder forth, one with ways back, and a ring of ladders, each a few hundred rungs deep; with parts too large, too."""
    rounds = []

    def counting(df, label, **conditions):
        rounds.append(label)
        return written_counting(df, label, **conditions)

    monkeypatch.setattr(reach, "written_counting", counting)
    monkeypatch.setattr(reach, "SHALLOW", shallow)
    monkeypatch.setattr(reach, "PART_EDGES", part_edges)
    n, name = (40 if part_edges == 10 else 300), "m{:04d}".format
    forth = {(name(2 * i + a), name(2 * i + 2 + b)) for i in range(n) for a in (0, 1) for b in (0, 1)}
    two_way = forth | {(d, s) for s, d in forth if s[-1] in "02468"}
    shapes = [forth, two_way, forth | {(name(2 * n + a), name(a)) for a in (0, 1)} | {("x", name(5)), (name(9), "y")}]
    rows = [("r", k, s, d) for k, shape in enumerate(shapes) for s, d in shape]
    found = reach.module_reach(fold_chains(written(spark.createDataFrame(rows, EDGE), "edges"))).collect()
    got = {(r.pr_number, r.module): (r.impact, r.on_cycle) for r in found}
    if part_edges != 10:
        assert rounds.count("reaching") <= 45
    assert {m: v for (k, m), v in got.items() if k == 0} == {name(2 * i + a): (2 * i, False) for i in range(n + 1) for a in (0, 1)}
    want = {}
    for k in (1, 2) if part_edges == 10 else ():
        after = _reachable(shapes[k])
        for m in after:
            want[k, m] = (sum(m in after[o] for o in after if o != m), m in after[m])
    assert all(got[key] == value for key, value in want.items())
    assert got[2, name(7)] == (2 * n + 2, True) and got[2, "x"] == (0, False) and got[2, "y"] == (2 * n + 3, False)


def test_edges_on_cycles_equal_brute_force():
    rng = random.Random(14)
    for n, m in [(1, 0), (2, 1), (2, 2), (6, 8), (12, 16), (30, 40)] * 8:
        edges = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b]
        after = _reachable(set(edges))
        got = on_cycles(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
        assert got.tolist() == [a in after[b] for a, b in edges]


def test_blocks_equal_brute_force():
    def connected(edges, x, y, without):
        seen, todo = {x}, [x]
        while todo:
            at = todo.pop()
            for a, b in edges:
                for s, d in ((a, b), (b, a)):
                    if s == at and d not in seen and d != without:
                        seen.add(d)
                        todo.append(d)
        return y in seen

    rng = random.Random(12)
    for n, m in [(1, 0), (2, 1), (5, 6), (9, 11), (14, 18), (14, 26)] * 6:
        edges = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b]
        got = blocks(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
        want = list(range(len(edges)))
        for i, e in enumerate(edges):
            for j, f in enumerate(edges[:i]):
                shared = set(e) & set(f)
                if shared and (len(shared) == 2 or connected(edges, *((set(e) | set(f)) - shared), without=shared.pop())):
                    old, new = want[i], want[j]
                    want = [new if x == old else x for x in want]
        assert len(set(zip(want, got.tolist(), strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_components_of_paths_and_stars(spark):
    rng = random.Random(13)
    sizes = [1, 2, 3, 50, 400]
    pairs, of = [], {}
    for k, n in enumerate(sizes):
        for i in range(1, n + 1):
            a, b = 10_000 * k + i - 1, 10_000 * k + i
            pairs.append((a, b) if rng.random() < 0.5 else (b, a))
            of[a] = of[b] = k
    pairs += [(90_000, 90_000 + i) for i in range(1, 200)] + [(95_000, 95_000)]
    of |= {90_000 + i: "star" for i in range(200)} | {95_000: "loop"}
    found = {r.node: r.part for r in components(spark.createDataFrame(pairs, "a LONG, b LONG")).collect()}
    assert found.keys() == of.keys()
    assert len(set(found.values())) == len(set(of.values())) == len({(found[x], of[x]) for x in of})


def test_cycle_flags(spark):
    # c -> a is on no cycle of its own, but both its ends are.
    rows = [("r", 1, *e) for e in [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("c", "a"), ("x", "a")]]
    edges = spark.createDataFrame(rows, EDGE)
    r = reach.module_reach(fold_chains(edges))
    flags = {(e.src, e.dst): e.in_cycle for e in reach.edge_flags(edges, r).collect()}
    assert flags == {("a", "b"): True, ("b", "a"): True, ("c", "d"): True, ("d", "c"): True, ("c", "a"): True, ("x", "a"): False}
    nodes = import_graph.endpoints(edges)
    assert {n.module for n in reach.node_flags(nodes, r).filter("in_cycle").collect()} == {"a", "b", "c", "d"}
    assert [x.has_cycles for x in reach.has_cycles(nodes, r).collect()] == [True]


def test_no_edges(spark):
    edges = spark.createDataFrame([], EDGE)
    assert reach.module_reach(fold_chains(edges)).count() == 0
    assert cycles.simple_cycles(fold_chains(edges)).count() == 0


def _graph(change, files):
    return ImportGraphs(written(code_facts(change(files)), "facts"))


def _pairs(graph):
    return {(e.src, e.dst) for e in graph.edges.collect()}


@pytest.mark.parametrize("hot_rows", [skew.HOT_ROWS, 1])
def test_project_filter_by_prefix(change, monkeypatch, hot_rows):
    monkeypatch.setattr(skew, "HOT_ROWS", hot_rows)  # 1: every name that is used twice is split
    modules = ["a", "a.b", "a.b.c", "ab", "x", "x.y", "b.c"]
    names = ["a", "a.b", "a.b.z", "a.q", "ab.k", "abc", "x", "b", "c", "b.c.d", "os"]
    files = {m.replace(".", "/") + ".py": "" for m in modules} | {"probe.py": "".join(f"import {n}\n" for n in names)}
    graph = _graph(change, files)
    assert {d for s, d in _pairs(graph) if s == "probe"} == set(names) - {"abc", "c", "os"}


def test_small_changes_are_not_searched_for_hot_names(change, monkeypatch):
    def searched(*_):
        raise AssertionError("a change of few imports has no hot name")

    monkeypatch.setattr(import_graph, "hot_keys", searched)
    graph = _graph(change, {"a.py": "import b, os", "./a.py": "import b, json", "b.py": "import os, a.c"})
    assert [(e.src, e.dst) for e in graph.edges.orderBy("src").collect()] == [("a", "b"), ("b", "a.c")]


def test_edges_of_small_changes_are_found_without_joins(change, monkeypatch):
    monkeypatch.setattr(import_graph, "salted_join", None)
    graph = _graph(change, {"a.py": "import b, os, b.c.d", "./a.py": "import b, json", "p/q.py": "import a, p, p.q, p.q.r, pq, p.s"})
    rows = [(e.src, e.dst) for e in graph.edges.orderBy("src", "dst").collect()]
    assert rows == [("p.q", "a"), ("p.q", "p"), ("p.q", "p.q.r")]


@pytest.mark.parametrize("change_names", [import_graph.CHANGE_NAMES, 8, 0])
def test_edges_of_changes_of_any_size(spark, monkeypatch, change_names):
    """Random names with empty parts, null keys and modules: all by joins, all in tasks, and both ways at once."""
    rng = random.Random(11)
    name = lambda: ".".join(rng.choice(["a", "b", "ß", "漢", "", "x"]) for _ in range(rng.randrange(1, 4)))
    rows = [(rng.choice(["r", "s", "t", None]), rng.choice([*range(15), None]), rng.choice([name(), name(), name(), None]),
             rng.choice([None, *([(name(),) for _ in range(rng.randrange(6))] for _ in range(5))])) for _ in range(300)]
    files = written(spark.createDataFrame(rows, "repo STRING, pr_number LONG, module STRING, imports ARRAY<STRUCT<module: STRING>>"), "files")
    want = set()
    for key in {(r[0], r[1]) for r in rows if r[0] and r[1] is not None}:
        own = {m: [] for r, p, m, _ in rows if (r, p) == key and m is not None}
        for r, p, m, names in rows:
            if (r, p) == key and m is not None:
                own[m] += [n for n, in names or []]
        belongs = lambda n: any(n == m or m.startswith(n + ".") or n.startswith(m + ".") for m in own)
        want |= {(*key, m, n) for m, names in own.items() for n in names if n and n != m and belongs(n)}
    monkeypatch.setattr(import_graph, "CHANGE_NAMES", change_names)
    monkeypatch.setattr(import_graph, "TASK_NAMES", 20)
    found = [tuple(e) for e in import_graph.edges(files).collect()]
    assert len(found) == len(set(found)) and set(found) == want and want


def test_nodes_include_names_that_are_no_file(change):
    graph = _graph(change, {"pkg.py": "", "a.py": "import pkg.sub"})
    assert _pairs(graph) == {("a", "pkg.sub")}
    assert {(n.module, n.path) for n in graph.nodes.collect()} == {("pkg", "pkg.py"), ("a", "a.py"), ("pkg.sub", None)}
    assert [r.module for r in import_graph.isolated_modules(graph.nodes, graph.edges).collect()] == ["pkg"]
    stats = import_graph.graph_stats(graph.nodes, graph.edges).first()
    assert (stats.total_files, stats.total_imports) == (3, 1)


def test_imports_resolved_to_files(change):
    graph = _graph(change, {
        "pkg/__init__.py": "import pkg.a", "pkg/a.py": "import pkg, pkg.b.deep.er, pkg.gone, pkg.a.own", "pkg/b.py": "from pkg.sub import x",
        "pkg/sub/c.py": "import pkg.b, pkg.b.one, pkg.b.two", "top.py": "import pkg.sub.c.f, os",
    })
    found = import_graph.resolved_edges(graph.edges, import_graph.modules(graph.files)).collect()
    assert {(e.src, e.dst, e.is_project) for e in found} == {
        ("pkg.__init__", "pkg.a", True), ("pkg.a", "pkg.__init__", True), ("pkg.a", "pkg.b", True), ("pkg.b", "pkg.__init__", True),
        ("pkg.sub.c", "pkg.b", True), ("top", "pkg.sub.c", True)}
    assert len(found) == 6


def test_external_relative_and_broken_imports(change):
    graph = _graph(change, {
        "a.py": "import os, sys\nfrom . import c\nfrom .m import x\nfrom b import y\nimport a",
        "b.py": "def f(:\n  import a", "m.py": "def late():\n    import b",
    })
    assert _pairs(graph) == {("a", "m"), ("a", "b"), ("m", "b")}
    assert graph.nodes.count() == 3


def test_impact_of_shared_modules(change):
    # cli and cron start jobs; jobs and a late import of plugin use store; jobs and store use clock.
    graph = _graph(change, {
        "cli.py": "import jobs", "cron.py": "from jobs import every", "jobs.py": "import store, clock\nimport json",
        "plugin.py": "def load():\n    import store", "store.py": "import clock", "clock.py": "import time",
    })
    assert {r.module: r.impact for r in graph.reach.collect()} == {"clock": 5, "store": 4, "jobs": 2, "plugin": 0, "cli": 0, "cron": 0}
    most = import_graph.top_by_degree(graph.edges, "src", 1).first()
    assert (most.module, most.degree) == ("jobs", 2)


def test_same_names_in_two_changes_stay_apart(change):
    two = change({"a.py": "import b", "b.py": ""}, pr=1).unionByName(change({"a.py": "", "b.py": "import a"}, pr=2))
    graph = ImportGraphs(written(code_facts(two), "facts"))
    assert {(e.pr_number, e.src, e.dst) for e in graph.edges.collect()} == {(1, "a", "b"), (2, "b", "a")}


def test_bits_are_written_once(spark, monkeypatch):
    """Many files import few modules, whose own imports go on for some rounds: a round adds its new bits only."""
    layers = [[f"f{i:03d}" for i in range(300)], *([f"l{k}_{i}" for i in range(6)] for k in range(6))]
    shape = {(a, b) for k in range(6) for i, a in enumerate(layers[k]) for b in (layers[k + 1][i % 6], layers[k + 1][(i + 1) % 6])}
    shape.add((layers[6][0], layers[1][0]))
    folded = fold_chains(written(spark.createDataFrame([("r", 1, *e) for e in shape], EDGE), "edges"))
    bits = F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))
    rounds = []

    def counting(df, label, **conditions):
        table, seen = written_counting(df, label, **conditions)
        if label == "reaching":
            rounds.append(table.agg(bits).first()[0])
        return table, seen

    monkeypatch.setattr(reach, "written_counting", counting)
    above = reach.ancestry(folded)
    assert len(rounds) > 6 and sum(rounds) == above.bits.agg(bits).first()[0]
    after = _reachable(shape)
    got = {r.module: (r.impact, r.on_cycle) for r in reach.module_reach(folded, above).collect()}
    assert got == {n: (sum(n in after[o] for o in after if o != n), n in after[n]) for n in after}


def test_large_changes_alone_are_not_copied(graphs, monkeypatch):
    _, edges, folded = graphs
    labels = []
    monkeypatch.setattr(chains, "CHANGE_EDGES", 0)
    monkeypatch.setattr(chains, "written", lambda df, label: labels.append(label) or written(df, label))
    assert _parts(chains.fold_chains(edges)) == _parts(folded)
    assert "members" in labels and "marked-edges" not in labels
