"""Runs of edges that are the only one out of a node and the only one into the next (runs inside Spark tasks)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def folded_runs(src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each of ``n`` nodes the first node of its run and the steps from there, and whether the run is a ring, which begins
    at its smallest node; and the places of the edges that are in no run. All runs are followed at once, to twice as far
    in each round."""
    link = (np.bincount(src, minlength=n)[src] == 1) & (np.bincount(dst, minlength=n)[dst] == 1)
    back, linked = np.arange(n), np.zeros(n, bool)
    back[dst[link]], linked[dst[link]] = src[link], True

    first, pos, left = back, linked.astype(np.int64), -1
    while (ring := linked[first]).any() and left != (left := int(ring.sum())):
        first, pos = first[first], pos + pos[first]
    # What never arrives goes round: it is done when a doubling lowers no minimum, as the windows of a ring then all agree.
    low, steps, passed = np.arange(n), np.zeros(n, np.int64), 1
    while ((other := low[back]) < low)[ring].any():
        lower = other < low
        low, steps = np.where(lower, other, low), np.where(lower, steps[back] + passed, steps)
        back, passed = back[back], 2 * passed
    return np.where(ring, low, first), np.where(ring, steps, pos), ring, np.flatnonzero(~link)


def _codes(columns: list[pa.ChunkedArray]) -> tuple[np.ndarray, pa.Array]:
    """The values of some columns, one below the other, as places in the list of their sorted distinct values."""
    coded = pa.concat_arrays([chunk for c in columns for chunk in c.chunks]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place[coded.indices.to_numpy()], coded.dictionary.take(pa.array(order))


def fold(key_columns: list[str], schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    """Modules of some whole changes with their chains, the first of a chain with its size, and, with a ``dst``, the edges
    between chains."""

    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        of = np.zeros(n, np.int64)
        for key in key_columns:
            code, values = _codes([table.column(key)])
            of = np.unique(of * len(values) + code, return_inverse=True)[1]
        code, names = _codes([table.column("src"), table.column("dst")])
        # Numbers follow the order of (change, module), so the smallest module of a ring has the smallest number.
        nodes, row, ends = np.unique(np.tile(of, 2) * len(names) + code, return_index=True, return_inverse=True)
        src, dst = ends[:n], ends[n:]
        chain, pos, ring, outer = folded_runs(src, dst, len(nodes))
        name, row = nodes % len(names), row % n
        size = np.bincount(chain, minlength=len(nodes))[chain]
        keys = {key: table.column(key).take(pa.array(np.concatenate([row, outer]))) for key in key_columns}
        inside, between = np.ones(len(nodes), bool), np.ones(len(outer), bool)
        no_edge, no_module = np.concatenate([inside, ~between]), np.concatenate([~inside, between])
        filled = lambda values: np.concatenate([values, np.zeros(len(outer), values.dtype)])
        columns = keys | {
            "module": names.take(pa.array(filled(name), mask=no_module)),
            "chain": names.take(pa.array(name[np.concatenate([chain, chain[src[outer]]])])),
            "pos": pa.array(filled(pos), mask=no_module),
            "is_ring": pa.array(filled(ring), mask=no_module),
            "size": pa.array(filled(size), mask=no_module | filled(pos > 0)),
            "dst": names.take(pa.array(np.concatenate([name, name[dst[outer]]]), mask=no_edge)),
        }
        return pa.table([columns[f.name] for f in schema], schema=schema)

    return run
