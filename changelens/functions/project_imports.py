"""Which of the names that the files of a change import belong to it (runs inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa


def prefixes(name: str) -> Iterator[str]:
    """The dotted prefixes of a name, the shortest first and the name itself last."""
    at = name.find(".")
    while at >= 0:
        yield name[:at]
        at = name.find(".", at + 1)
    yield name


def find(key_columns: list[str], schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Edges of some whole changes, from one row ``(key, module, imported)`` per file: names that equal a module, lie below
    one or are a prefix of one."""

    def run(table: pa.Table) -> pa.Table:
        changes: dict[tuple, tuple[list, list, list]] = {}
        keys = zip(*(table.column(key).to_pylist() for key in key_columns))
        for row, (key, module, names) in enumerate(zip(keys, table.column("module").to_pylist(), table.column("imported").to_pylist())):
            rows, modules, imported = changes.setdefault(key, ([], [], []))
            rows.append(row)
            modules.append(module)
            imported.append(names)
        found, src, dst = [], [], []
        for rows, modules, imported in changes.values():
            own = set(modules)
            known = {p for module in own for p in prefixes(module)}
            ours = {name for name in {n for names in imported for n in names}
                    if name and (name in known or any(p in own for p in prefixes(name)))}
            if not ours:
                continue
            pairs = {(module, name) for module, names in zip(modules, imported) for name in names if name in ours and name != module}
            found += [rows[0]] * len(pairs)
            src += [module for module, _ in pairs]
            dst += [name for _, name in pairs]
        keys = table.select(key_columns).take(pa.array(found, pa.int64()))
        return pa.table([*keys.columns, pa.array(src, pa.string()), pa.array(dst, pa.string())], schema=schema)

    return run
