"""Facts of one source text, read from its syntax tree (runs inside Spark tasks)."""

from __future__ import annotations

import ast

DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
BRANCHES = {ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp}


def _kinds(base: type) -> list[type]:
    return [base, *(kind for sub in base.__subclasses__() for kind in _kinds(sub))]


#: Kinds of values that hold no further nodes, and the fields of each kind of node that may hold some.
LEAVES = {ast.Name, ast.Constant, ast.alias, ast.Pass, ast.Break, ast.Continue, str, int, bool, type(None)}.union(
    *map(_kinds, (ast.expr_context, ast.operator, ast.cmpop, ast.boolop, ast.unaryop)))
CHILDREN = {kind: tuple(f for f in kind._fields if f not in ("name", "id", "attr", "ctx", "op", "ops", "type_comment"))
            for kind in _kinds(ast.AST) if kind not in LEAVES}


def read_facts(code: str) -> dict:
    """Functions, classes, imports and error of one file; a bad file still gives a row.

    ``error_kind`` is ``syntax`` (not valid Python), ``parser`` (the parser gave up, which also makes
    the import graph of the change unusable) or ``analysis`` (parsed, imports known, facts not).
    """
    facts = {"total_lines": len(code.splitlines()), "avg_complexity": 0.0, "error_kind": None,
             "error_message": None, "functions": [], "classes": [], "imports": []}
    try:
        tree = ast.parse(code)
    except SyntaxError as err:
        return facts | {"error_kind": "syntax", "error_message": _utf8(f"Line {err.lineno}: {err.msg}")}
    except Exception as err:
        return facts | {"error_kind": "parser", "error_message": _utf8(str(err))}
    try:
        _collect(tree, facts)
    except Exception as err:
        facts |= {"error_kind": "analysis", "error_message": _utf8(str(err)), "functions": [], "classes": []}
    return facts


def _collect(tree: ast.Module, facts: dict) -> None:
    # One breadth-first pass. Each entry carries the index of its innermost enclosing function, so the
    # branches of every function are counted without walking any subtree twice.
    found, parents, branches, class_nodes = [], [], [], []
    todo, owners = [tree], [-1]
    for node, owner in zip(todo, owners):  # both grow meanwhile
        kind = type(node)
        if kind in DEFS:
            found.append(node)
            parents.append(owner)
            branches.append(0)
            owner = len(found) - 1
        elif kind is ast.ClassDef:
            class_nodes.append(node)
        elif kind is ast.Import:
            facts["imports"] += [_import(a.name, [a.asname or a.name], node, False) for a in node.names]
        elif kind is ast.ImportFrom:
            facts["imports"].append(_import(node.module or "", [a.name for a in node.names], node, True))
        elif owner >= 0:
            if kind in BRANCHES:
                branches[owner] += 1
            elif kind is ast.BoolOp:
                branches[owner] += len(node.values) - 1
        fields = node.__dict__
        for name in CHILDREN[kind]:
            value = fields[name]
            if type(value) is list:
                for child in value:
                    if type(child) not in LEAVES:
                        todo.append(child)
                        owners.append(owner)
            elif type(value) not in LEAVES:
                todo.append(value)
                owners.append(owner)

    for inner in range(len(found) - 1, -1, -1):  # an enclosing function always precedes its inner ones
        if parents[inner] >= 0:
            branches[parents[inner]] += branches[inner]

    facts["functions"] = [
        _span(node) | {"args": [a.arg for a in node.args.args], "complexity": 1 + count,
                       "is_async": isinstance(node, ast.AsyncFunctionDef)}
        for node, count in zip(found, branches)
    ]
    facts["classes"] = [
        _span(node) | {"methods": [m.name for m in node.body if isinstance(m, DEFS)],
                       "base_classes": [b.id if type(b) is ast.Name else _utf8(ast.unparse(b)) for b in node.bases]}
        for node in class_nodes
    ]
    if found:
        # Python rounds the exact binary value; SQL round() would differ on some halves.
        facts["avg_complexity"] = round(sum(f["complexity"] for f in facts["functions"]) / len(found), 2)


def _span(node) -> dict:
    return {"name": node.name, "line_start": node.lineno, "line_end": node.end_lineno or node.lineno,
            "docstring": _utf8(ast.get_docstring(node)) if type(node.body[0]) is ast.Expr else None}


def _import(module: str, names: list[str], node, is_from: bool) -> dict:
    return {"module": module, "names": names, "line": node.lineno, "is_from_import": is_from}


def _utf8(text: str | None) -> str | None:
    """Half surrogate pairs (from escapes in the source) cannot be stored; they become ``?``."""
    return text and text.encode("utf-8", "replace").decode("utf-8")
