"""Code facts of literal sources."""

import ast

from pyspark.sql import functions as F

from changelens.functions import names
from changelens.functions.syntax import read_facts
from changelens.operators import code_facts as cf

SAMPLE = '''"""A module."""
import os
import sys as system, json
from typing import List, Dict
from . import near
from .m import x


class Shape(Base, mixins.Named, metaclass=Meta):
    """A shape."""

    def area(self, unit, /, scale, *rest, exact=True, **more):
        def inner(a):
            return a if a else None
        return inner

    async def load(self):
        import late


def busy(items):
    """Does things.

    In two paragraphs.
    """
    for item in items:
        if item > 0 and item < 9 or item == 20:
            continue
        elif item:
            pass
    while True:
        try:
            pass
        except (A, B):
            pass
        except C:
            break
    return [i for i in items if i]
'''


def test_sample(change):
    facts = cf.code_facts(change({"s.py": SAMPLE, "README.md": "# hi"})).cache()
    functions = [r.asDict() for r in cf.functions(facts).orderBy("pos").collect()]
    by_name = {f["name"]: f for f in functions}
    assert [f["name"] for f in functions] == ["busy", "area", "load", "inner"]
    assert (by_name["busy"]["complexity"], by_name["area"]["complexity"], by_name["inner"]["complexity"]) == (9, 2, 2)
    assert by_name["area"]["args"] == ["scale"] and by_name["load"]["is_async"]
    assert by_name["busy"]["docstring"] == "Does things.\n\nIn two paragraphs."
    shape = cf.classes(facts).first()
    assert (shape.name, shape.methods, shape.base_classes, shape.docstring) == ("Shape", ["area", "load"], ["Base", "mixins.Named"], "A shape.")
    assert [(r.module, r.names, r.line, r.is_from_import) for r in cf.imports(facts).orderBy("pos").collect()] == [
        ("os", ["os"], 2, False), ("sys", ["system"], 3, False), ("json", ["json"], 3, False),
        ("typing", ["List", "Dict"], 4, True), ("", ["near"], 5, True), ("m", ["x"], 6, True), ("late", ["late"], 18, False),
    ]
    row = cf.file_summary(facts).first()
    assert (row.filename, row.total_lines, row.avg_complexity, row.has_syntax_error) == ("s.py", len(SAMPLE.splitlines()), 3.5, False)
    assert cf.file_max_complexity(facts).first().max_complexity == 9


def test_complexity_equals_a_walk_per_function():
    def count(node):
        total = 1
        for n in ast.walk(node):
            total += isinstance(n, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp))
            total += len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0
        return total

    for path in (ast.__file__, read_facts.__code__.co_filename):
        code = open(path).read()
        walked = [(n.name, count(n)) for n in ast.walk(ast.parse(code)) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
        assert [(f["name"], f["complexity"]) for f in read_facts(code)["functions"]] == walked


def test_walk_passes_leaves_by(monkeypatch):
    """Names, constants, operators and the like are no entries of the walk; a pattern ``None`` or ``True`` is no node at all."""
    code = "def f(x=a or b):\n    match x:\n        case None | True if x and a and b:\n            import os\n    class C(m.B, D): pass\n"
    with monkeypatch.context() as m:
        m.setattr(ast, "iter_child_nodes", None)  # yields every leaf
        facts = read_facts(code)
    assert facts["error_kind"] is None and facts["functions"][0]["complexity"] == 4
    assert facts["imports"][0]["module"] == "os" and facts["classes"][0]["base_classes"] == ["m.B", "D"]


def test_errors_and_odd_texts(change):
    deep = "x = " + "-" * 100_000 + "1"
    facts = cf.code_facts(change({
        "broken.py": "for in x:\n    y", "empty.py": "", "comment.py": "# one\n# two", "uni.py": "größe = '漢字 🎈'",
        "deep.py": deep, "lone.py": 'def f():\n    "\\ud800"\n', "lines.py": "# a\x0c# b\x85# c", "gone.py": None,
    })).cache()
    rows = {r.filename: r for r in facts.collect()}
    assert "gone.py" not in rows
    assert (rows["broken.py"].error_kind, rows["broken.py"].error_message, rows["broken.py"].total_lines) == ("syntax", "Line 1: invalid syntax", 2)
    assert (rows["empty.py"].total_lines, rows["empty.py"].error_kind, rows["empty.py"].avg_complexity) == (0, None, 0.0)
    assert rows["comment.py"].total_lines == 2 and rows["uni.py"].error_kind is None
    assert rows["deep.py"].error_kind == "parser"
    assert rows["lone.py"].functions[0].docstring == "?"
    assert rows["lines.py"].total_lines == 3
    assert {r.filename for r in cf.analyzed(facts).collect()} == set(rows) - {"deep.py"}
    assert {r.filename: r.max_complexity for r in cf.file_max_complexity(facts).collect()}["empty.py"] == 1
    assert [r.filename for r in cf.syntax_errors(facts).collect()] == ["broken.py"]


def test_bands(change):
    def function(n):
        return "def f(x):\n" + "    if x: pass\n" * (n - 1) + "    return x\n"

    facts = cf.code_facts(change({f"{n}.py": function(n) for n in (1, 5, 6, 10, 11)}))
    assert {(r.band, r.n_functions) for r in cf.complexity_bands(facts).collect()} == {("simple", 2), ("medium", 2), ("complex", 1)}


def test_module_names(spark):
    paths = {
        "a.py": ("a", "a", "a"),
        "pkg/mod.py": ("pkg.mod", "pkg.mod", "pkg.mod"),
        "my.pytest/x.py": ("my.pytest.x", "my.pytest.x", "mytest.x"),
        "pkg/__init__.py": ("pkg.__init__", "pkg", "pkg.__init__"),
        "__init__.py": ("__init__", "__init__", "__init__"),
        "./a//b.py": ("a.b", "a.b", "..a..b"),
        "x/.py": ("x..py", "x..py", "x."),
        "v1.2/a.b.py": ("v1.2.a.b", "v1.2.a.b", "v1.2.a.b"),
        "a/././b/../c.py": ("a.b....c", "a.b....c", "a.....b....c"),
        "./__init__.py": ("__init__", "__init__", "..__init__"),
        "/abs/m.py": ("/.abs.m", "/.abs.m", ".abs.m"),
    }
    table = spark.createDataFrame([(p,) for p in paths], "p STRING")
    p = F.col("p")
    rows = table.select(p, names.module_name(p), names.tree_module_name(p), names.ranking_name(p)).collect()
    assert {r[0]: tuple(r)[1:] for r in rows} == paths
    table = spark.createDataFrame([("a.b.c",), ("x.",)], "name STRING")
    rows = names.with_prefixes(table, "name", "prefix").collect()
    assert {tuple(r) for r in rows} == {("a.b.c", "a"), ("a.b.c", "a.b"), ("a.b.c", "a.b.c"), ("x.", "x"), ("x.", "x.")}
