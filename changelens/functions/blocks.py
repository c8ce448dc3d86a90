"""Parts of a graph that its cycles lie in: strongly connected parts, and blocks, the largest sets of edges of which any
two lie on a common ring, directions ignored. Both are depth-first searches without recursion."""

from __future__ import annotations

import numpy as np


def blocks(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The block of each edge, as the number of one of its edges: the edges below a node from which nothing leads back
    above it are a block."""
    nodes, a, b = _numbered(src, dst)
    n = len(nodes)
    pairs, first, of = np.unique(np.minimum(a, b) * n + np.maximum(a, b), return_index=True, return_inverse=True)
    low_end, high_end, edge = pairs // n, pairs % n, np.arange(len(pairs))
    tail = np.concatenate([low_end, high_end])
    order = np.argsort(tail, kind="stable")
    heads = np.concatenate([high_end, low_end])[order].tolist()
    edges = np.concatenate([edge, edge])[order].tolist()
    at = np.searchsorted(tail[order], np.arange(n + 1)).tolist()

    found, back, time, upto = [-1] * n, [0] * n, 0, at[:-1].copy()
    block, waiting = [-1] * len(pairs), []
    for root in range(n):
        if found[root] >= 0:
            continue
        found[root] = back[root] = time
        time += 1
        way = [(root, -1)]
        while way:
            node, came = way[-1]
            if upto[node] < at[node + 1]:
                head, e = heads[upto[node]], edges[upto[node]]
                upto[node] += 1
                if found[head] < 0:
                    found[head] = back[head] = time
                    time += 1
                    waiting.append(e)
                    way.append((head, e))
                elif e != came and found[head] < found[node]:
                    waiting.append(e)
                    back[node] = min(back[node], found[head])
                continue
            way.pop()
            if not way:
                break
            above = way[-1][0]
            back[above] = min(back[above], back[node])
            if back[node] >= found[above]:
                while block[came] < 0:
                    block[waiting.pop()] = came
    return first[np.array(block, np.int64)[of]] if len(src) else np.empty(0, np.int64)


def _strong(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """One node of the strongly connected part of each of the ``n`` nodes. A part is done when the search leaves the node
    of it that was found first."""
    order = np.argsort(a, kind="stable")
    heads, at = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    found, back, part, time, upto, waiting = [-1] * n, [0] * n, [-1] * n, 0, at[:-1].copy(), []
    for root in range(n):
        way = [root] if found[root] < 0 else []
        while way:
            node = way[-1]
            if found[node] < 0:
                found[node] = back[node] = time
                time += 1
                waiting.append(node)
            if upto[node] < at[node + 1]:
                head = heads[upto[node]]
                upto[node] += 1
                if found[head] < 0:
                    way.append(head)
                elif part[head] < 0:
                    back[node] = min(back[node], found[head])
                continue
            way.pop()
            if way:
                back[way[-1]] = min(back[way[-1]], back[node])
            if back[node] == found[node]:
                while part[node] < 0:
                    part[waiting.pop()] = node
    return np.array(part, np.int64)


def _numbered(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes, ends = np.unique(np.concatenate([src, dst]), return_inverse=True)
    return nodes, ends[: len(src)], ends[len(src) :]


def on_cycles(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Which edges lie on a directed cycle: those with both ends in one strongly connected part."""
    nodes, a, b = _numbered(src, dst)
    parts = _strong(a, b, len(nodes))
    return parts[a] == parts[b] if len(src) else np.zeros(0, bool)


def strong_parts(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of strongly connected parts of two nodes and more, and one node of the part for each."""
    nodes, a, b = _numbered(src, dst)
    parts = _strong(a, b, len(nodes))
    some = np.bincount(parts, minlength=len(nodes))[parts] > 1 if len(nodes) else np.zeros(0, bool)
    return nodes[some], nodes[parts[some]]
