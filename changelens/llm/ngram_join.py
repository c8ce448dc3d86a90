"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct five-word shingles (words without spaces and 0x09-0x0D, A-Z
lower-cased; with fewer words, the whole sequence is one shingle). Two documents link when
``100 * intersection >= 75 * union``; documents with equal sets are one *node*.

1. :mod:`shared_keys` tells each node which of its shingles other nodes hold. A node of n shingles of which
   fewer than 0.75 n are held elsewhere has no partner and is left out.
2. Shingles are ordered by frequency class, rare first, and then by hash. Two linked nodes share at least k of
   their prefixes of ``n - ceil(0.75 n) + k`` shingles. With k = 2 they share a rare shingle there, or two frequent
   ones. Rare shingles (fewer than ``FREQUENT`` holders) are indexed one by one, frequent ones as all
   combinations of two. Nodes of more than ``COMBINED`` shingles would have too many combinations; they index
   their frequent shingles one by one, and so do nodes that may link with them, those of 0.75 * COMBINED and more.
3. Nodes that share an index key, directly or by others, are a cluster. Within a cluster all pairs are verified
   by their exact intersections, in tasks of bounded size. A node is compared with all others of its cluster at
   once, and pairs that are known to be in one component are left out, so no list of pairs is ever made.

Null and empty texts, and those without words, have no shingles and link with nothing. ``doc_id`` may repeat or be
null: each row is a document, and ``component_id`` is the least ``doc_id`` that is not null among those reached,
null if there is none. Other columns are not used. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm import texts
from changelens.llm.components import Sets, clusters, linked
from changelens.llm.shared_keys import FREQUENT, Chunk, packed, shared_keys, unpacked
from changelens.storage import written

SHINGLE = 5
#: Similarity as a percentage of the union.
PERCENT = 75
COMBINED = 64
CHUNK_BYTES = 6 << 20

_SURVIVOR = "node LONG, size LONG, n_keys LONG, keys BINARY, index ARRAY<LONG>"


def needed(size: np.ndarray) -> np.ndarray:
    """Least intersection of a set of this size with a linked one."""
    return -(-PERCENT * size // 100)


def shingles(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, 64-bit shingle hash) of the texts, by hash."""
    lower = texts.LOWER[text]
    starts, ends = texts.runs(~texts.SPACE[lower], bounds)
    words = texts.span_hashes(lower, starts, ends)
    at = texts.of_rows(starts, bounds)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n), dtype=np.int32), n)
    windows = texts.window_hashes(words, SHINGLE)
    whole = np.flatnonzero(row[: len(windows)] == row[SHINGLE - 1 :]) if len(windows) else np.empty(0, np.int64)
    rows, keys = [row[whole]], [windows[whole]]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(n == size)
        if len(short):
            rows.append(short.astype(np.int32))
            keys.append(np.array([texts.window_hashes(words[at[r] : at[r + 1]], size)[0] for r in short], texts.U64))
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.argsort(keys, kind="stable")  # rows ascend among equal keys: those are of one size
    rows, keys = rows[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], keys[new]


def _extract(batch: pa.RecordBatch) -> Iterator[Chunk]:
    for row, end, text, bounds in texts.text_slices(batch.column("text"), CHUNK_BYTES):
        rows, keys = shingles(text, bounds)
        sizes = np.bincount(rows, minlength=end - row)
        order = np.argsort(rows, kind="stable")
        sums = np.zeros(len(keys) + 1, texts.U64)
        np.cumsum(texts.mixed(keys[order]), out=sums[1:])
        at = np.concatenate([[0], np.cumsum(sizes)])
        nodes = texts.mixed(sums[at[1:]] - sums[at[:-1]] + sizes.astype(texts.U64))
        own = batch.slice(row, end - row)
        yield Chunk(nodes, sizes, rows, keys, own.column("doc_id"), own.column("h"))


def _pairs(keys: np.ndarray) -> np.ndarray:
    a, b = np.triu_indices(len(keys), 1)
    return texts.mixed(keys[a] * texts.U64(0x9E3779B97F4A7C15) + keys[b])


def index_keys(size: int, keys: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys under which a node is indexed. ``keys`` are its shared shingles in the common order."""
    unique = size - len(keys)  # these come first in the order and are shared with nobody
    free = size - int(needed(size))
    longer = max(0, free + 2 - unique)
    rare = classes[:longer] < FREQUENT
    frequent = keys[:longer][~rare]
    out = [texts.mixed(keys[:longer][rare])]
    if size <= COMBINED:
        out.append(_pairs(frequent))
    if size >= needed(COMBINED):
        shorter = max(0, free + 1 - unique)
        out.append(texts.mixed(keys[:shorter][classes[:shorter] >= FREQUENT]))
    return np.concatenate(out)


def _survivors(nodes: np.ndarray, sizes: np.ndarray, docs: np.ndarray, keys: np.ndarray, classes: np.ndarray) -> pa.Table:
    held = np.bincount(docs, minlength=len(nodes))
    some = np.flatnonzero((held >= needed(sizes)) & (sizes > 0))
    of_some = np.isin(docs, some)
    docs, keys, classes = docs[of_some], keys[of_some], classes[of_some]
    order = np.lexsort((keys, classes, docs))
    docs, keys, classes = docs[order], keys[order], classes[order]
    first, last = np.searchsorted(docs, some), np.searchsorted(docs, some, "right")
    own = [(keys[a:b], classes[a:b]) for a, b in zip(first, last, strict=True)]
    return pa.table(
        {
            "node": pa.array(nodes[some].view(np.int64)),
            "size": pa.array(sizes[some]),
            "n_keys": pa.array(last - first),
            "keys": pa.array([packed(np.sort(k)) for k, _ in own], pa.binary()),
            "index": pa.array([index_keys(int(n), k, c).view(np.int64) for n, (k, c) in zip(sizes[some], own, strict=True)], pa.list_(pa.int64())),
        }
    )


def _links(table: pa.Table) -> np.ndarray:
    """Components of the exact links among the rows (``size``, ``keys``)."""
    sizes = table.column("size").to_numpy()
    keys = [unpacked(b) for b in table.column("keys").to_pylist()]
    n = len(keys)
    at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    _, key = np.unique(np.concatenate(keys), return_inverse=True)
    owner = np.repeat(np.arange(n), np.diff(at))[np.argsort(key, kind="stable")]
    ends = np.cumsum(np.bincount(key))
    starts = np.concatenate([[0], ends[:-1]])
    sets, seen = Sets(n), np.zeros(n, bool)

    def compare(x: int) -> np.ndarray:
        """Join ``x`` with all rows it links to."""
        own = key[at[x] : at[x + 1]]
        common = np.bincount(owner[texts.ragged(starts[own], ends[own] - starts[own])], minlength=n)
        hit = np.flatnonzero(100 * common >= PERCENT * (sizes + sizes[x] - common))
        seen[x] = True
        for y in hit.tolist():
            sets.join(x, y)
        return hit

    placed = np.zeros(n, bool)
    for x in range(n):  # stars first: most nodes of a large group are found by a few of them
        if not placed[x]:
            placed[compare(x)] = True
    root = sets.roots()
    largest = np.bincount(root).argmax()
    for x in np.flatnonzero((root != largest) & ~seen).tolist():
        compare(x)  # a link that is still missing has an end outside the largest component
    return sets.roots()


def _classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``node``, ``n_shingles`` of every document, and ``root``, its component."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answers = shared_keys(source, _extract, n_bytes // 6)
    survivors = written(answers.assembled(_SURVIVOR, _survivors), "survivors")
    cluster = clusters(survivors.select(F.explode("index").alias("key"), "node"))
    roots = linked(survivors, cluster, "n_keys", ["size", "keys"], _links)
    members = answers.members("row_hashes").select("node", F.col("size").alias("n_shingles"), F.col("id").alias("doc_id"), F.col("row_hashes").alias("h"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def join(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document."""
    found = written(_classes(docs).select("doc_id", "n_shingles", "root"), "classes")
    least = written(found.filter("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "least")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return found.join(least, "root", "left").select("doc_id", "n_shingles", own.alias("component_id"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the least ``doc_id`` (null last); all columns unchanged.

    Documents without words all stay. Rows equal in ``doc_id`` and text are one document.
    """
    found = _classes(docs)
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    group = F.when(F.col("n_shingles") > 0, F.struct(F.lit(0).alias("of"), F.col("root").alias("a"), F.lit(False).alias("b"), F.lit(0).cast("long").alias("c")))
    alone = F.struct(F.lit(1).alias("of"), F.coalesce("doc_id", F.lit(0)).alias("a"), F.col("doc_id").isNull().alias("b"), F.coalesce("h", F.lit(0)).alias("c"))
    stay = written(found.groupBy(F.coalesce(group, alone)).agg(F.min(name).alias("name")).select("name.*"), "stay")
    keys = ["unnamed", "id", "h"]
    whole = docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("h"),
    )
    return whole.join(stay, keys, "left_semi").dropDuplicates(keys).select("doc.*")
