"""Which keys do at least two nodes hold? One shuffle of compact blobs, and one of the answers.

A *node* is a text (or line) known by a 64-bit hash of its content, a *key* a hash that nodes may share. A scan
cuts its partition into chunks of a few megabytes. The (key, node) entries of a chunk are sorted, cut by key
range into buckets and sent as delta-coded blobs of five to six bytes an entry instead of rows. A bucket counts
every key and sends shared ones back to the chunks they came from, where each node's keys come together.

A key is in class ``min(entries, FREQUENT)``, which is the same wherever the key is seen. A key that
``FREQUENT`` nodes of one chunk hold is in the last class whatever the others say, so its bucket gets one
marker for the chunk: a bucket never holds more than ``FREQUENT`` entries of a key for each chunk, however
common the key. Equal nodes of one chunk are sent once; those of several chunks make their keys shared, which
costs some work later and changes no result. Keys are cut to 48 bits: over all nodes that makes some keys look
shared, within two nodes that are compared it does not happen (a chance of 2**-48 for each pair of keys).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from changelens.llm import texts
from changelens.llm.batches import small_batches
from changelens.storage import written

FREQUENT = 16
KEY_BITS = 48
#: Entries that one bucket is to hold.
BUCKET_ENTRIES = 1_500_000

_OWN = "nodes ARRAY<LONG>, sizes ARRAY<LONG>, ids ARRAY<LONG>, row_hashes ARRAY<LONG>, lines ARRAY<LONG>"
_SENT = f"bucket LONG, chunk LONG, keys BINARY, docs BINARY, {_OWN}"
_ANSWER = f"chunk LONG, keys BINARY, classes BINARY, docs BINARY, {_OWN}"
_NAMES = ["nodes", "sizes", "ids", "row_hashes", "lines"]


@dataclass
class Chunk:
    """Nodes of some rows, with a name for each (``ids``, and ``row_hashes`` and ``lines`` where used), and entries.

    Entry ``i`` says that node number ``docs[i]`` holds ``keys[i]``; entries are distinct.
    """

    nodes: np.ndarray
    sizes: np.ndarray
    docs: np.ndarray
    keys: np.ndarray
    ids: pa.Array
    row_hashes: pa.Array | None = None
    lines: np.ndarray | None = None
    first: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.first = np.zeros(len(self.nodes), bool)
        self.first[np.unique(self.nodes, return_index=True)[1]] = True


def packed(a: np.ndarray) -> bytes:
    """The numbers, their bytes sorted by significance, compressed."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return bytes([a.itemsize]) + len(a).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(b: bytes) -> np.ndarray:
    width, n = b[0], int.from_bytes(b[1:9], "little")
    kind = np.dtype(f"<u{width}")
    if not n:
        return np.empty(0, kind)
    planes = pa.decompress(b[9:], decompressed_size=n * width, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).ravel()


def narrow(a: np.ndarray) -> np.ndarray:
    most = int(a.max()) if len(a) else 0
    return a.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def _deltas(keys: np.ndarray) -> bytes:
    return packed(narrow(np.diff(keys, prepend=texts.U64(0))))


def _ascending(b: bytes) -> np.ndarray:
    return np.cumsum(unpacked(b), dtype=texts.U64)


def buckets_for(n_entries: int) -> int:
    return max(1, -(-n_entries // BUCKET_ENTRIES))


def _list(values) -> pa.Array:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _sent(extract: Callable[[pa.RecordBatch], Iterator[Chunk]], n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_id = TaskContext.get().partitionId() << 28
        for batch in batches:
            for chunk in extract(batch):
                yield from _rows(chunk, chunk_id, n_buckets)
                chunk_id += 1

    return run


def _rows(chunk: Chunk, chunk_id: int, n_buckets: int) -> Iterator[pa.RecordBatch]:
    of_first = chunk.first[chunk.docs]
    keys, docs = chunk.keys[of_first] >> texts.U64(64 - KEY_BITS), chunk.docs[of_first]
    order = np.argsort(keys, kind="stable")
    keys, docs = keys[order], docs[order]
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    counts = np.diff(edges)
    hot = np.repeat(counts >= FREQUENT, counts)
    marker = np.zeros(len(keys), bool)
    marker[edges[:-1]] = True
    marker &= hot
    sent = ~hot | marker
    sent_keys, sent_docs = keys[sent], np.where(marker, 0, docs + 1)[sent]  # 0 marks a frequent key
    bucket = ((sent_keys >> texts.U64(KEY_BITS - 32)) * texts.U64(n_buckets)) >> texts.U64(32)
    cut = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=texts.U64))
    some = np.flatnonzero(np.diff(cut))
    rows = [(int(b), _deltas(sent_keys[cut[b] : cut[b + 1]]), packed(narrow(sent_docs[cut[b] : cut[b + 1]]))) for b in some]
    n = len(rows) + 1
    # the chunk's own row holds its nodes and its frequent keys, and goes to a group of its own
    rows.append((n_buckets + chunk_id, _deltas(keys[hot]), packed(narrow(docs[hot]))))
    own = {
        "nodes": _list(chunk.nodes.view(np.int64)),
        "sizes": _list(chunk.sizes.astype(np.int64)),
        "ids": _list(chunk.ids.cast(pa.int64())),
        "row_hashes": None if chunk.row_hashes is None else _list(chunk.row_hashes),
        "lines": None if chunk.lines is None else _list(chunk.lines.astype(np.int64)),
    }
    none = pa.nulls(n - 1, pa.list_(pa.int64()))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([chunk_id] * n, pa.int64()),
            pa.array([r[1] for r in rows], pa.binary()),
            pa.array([r[2] for r in rows], pa.binary()),
            *(pa.concat_arrays([none, pa.nulls(1, none.type) if a is None else a.cast(none.type)]) for a in own.values()),
        ],
        names=["bucket", "chunk", "keys", "docs", *own],
    )


def _counted(n_buckets: int):
    def count(group: tuple, table: pa.Table) -> pa.Table:
        answer = {"chunk": table.column("chunk"), "keys": table.column("keys")}
        if group[0].as_py() >= n_buckets:
            n = [int.from_bytes(b[1:9], "little") for b in table.column("docs").to_pylist()]
            answer["classes"] = pa.array([packed(np.full(k, FREQUENT, np.uint8)) for k in n], pa.binary())
            return pa.table(answer | {c: table.column(c) for c in ("docs", *_NAMES)})
        blobs = sorted(zip(table.column("chunk").to_pylist(), table.column("keys").to_pylist(), table.column("docs").to_pylist(), strict=True))
        del table
        parts = [_ascending(b) for _, b, _ in blobs]
        lengths = np.array([len(p) for p in parts])
        keys = np.concatenate(parts)
        del parts
        docs = np.concatenate([unpacked(b).astype(np.uint32) for _, _, b in blobs])
        chunks = np.array([c for c, _, _ in blobs])
        where = np.repeat(np.arange(len(blobs), dtype=np.int32), lengths)
        order = np.argsort(keys, kind="stable")
        keys, docs, where = keys[order], docs[order], where[order]
        del order
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        return _answered(keys, docs, where, edges, chunks)

    def run(group: tuple, table: pa.Table) -> pa.Table:
        return texts.group_then_give_back(lambda own: count(group, own))(table)

    return run


def _answered(keys: np.ndarray, docs: np.ndarray, where: np.ndarray, edges: np.ndarray, chunks: np.ndarray) -> pa.Table:
    """Entries of shared keys by chunk; ``edges`` cut the entries, which are sorted by key, into keys."""
    counts = np.diff(edges)
    marked = docs == 0
    weight = np.add.reduceat(np.where(marked, FREQUENT, 1), edges[:-1]) if len(keys) else counts
    classes = np.repeat(np.minimum(weight, FREQUENT).astype(np.uint8), counts)
    back = (classes >= 2) & ~marked
    keys, docs, where, classes = keys[back], docs[back], where[back], classes[back]
    order = np.argsort(where, kind="stable")  # keys stay ascending within a chunk
    keys, docs, where, classes = keys[order], docs[order], where[order], classes[order]
    cut = np.searchsorted(where, np.arange(len(chunks) + 1))
    some = np.flatnonzero(np.diff(cut))
    none = pa.nulls(len(some), pa.list_(pa.int64()))
    spans = [(int(cut[k]), int(cut[k + 1])) for k in some]
    return pa.table(
        {
            "chunk": pa.array(chunks[some], pa.int64()),
            "keys": pa.array([_deltas(keys[a:b]) for a, b in spans], pa.binary()),
            "classes": pa.array([packed(classes[a:b]) for a, b in spans], pa.binary()),
            "docs": pa.array([packed(narrow(docs[a:b] - 1)) for a, b in spans], pa.binary()),
        }
        | dict.fromkeys(_NAMES, none)
    )


@dataclass
class Answers:
    """Written answers of the buckets, and the nodes of the chunks."""

    table: DataFrame

    def members(self, *names: str) -> DataFrame:
        """A row for each name of a node: ``node``, ``size``, ``id`` and the other ``names``."""
        lists = ["nodes", "sizes", "ids", *names]
        zipped = self.table.filter("nodes IS NOT NULL").selectExpr(f"inline(arrays_zip({', '.join(lists)}))")
        return zipped.toDF("node", "size", "id", *names)

    def assembled(self, schema: str, select: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table]) -> DataFrame:
        """``select(nodes, sizes, docs, keys, classes)`` of every chunk, over the entries with shared keys."""

        def run(table: pa.Table) -> pa.Table:
            own = table.filter(pc.is_valid(table.column("nodes")))
            nodes = own.column("nodes")[0].values.to_numpy().view(texts.U64)
            sizes = own.column("sizes")[0].values.to_numpy()
            take = lambda name, of: np.concatenate([of(b) for b in table.column(name).to_pylist()])
            docs = take("docs", lambda b: unpacked(b).astype(np.int64))
            return select(nodes, sizes, docs, take("keys", _ascending), take("classes", unpacked))

        needed = self.table.select("chunk", "keys", "classes", "docs", "nodes", "sizes")
        return needed.groupBy("chunk").applyInArrow(texts.group_then_give_back(run), schema)


def shared_keys(source: DataFrame, extract: Callable[[pa.RecordBatch], Iterator[Chunk]], n_entries: int) -> Answers:
    """Ask for all keys that ``extract`` makes of the batches of ``source``; ``n_entries`` is about their number."""
    n_buckets = buckets_for(n_entries)
    sent = source.mapInArrow(texts.then_give_back(_sent(extract, n_buckets)), _SENT)
    with small_batches(source.sparkSession):
        return Answers(written(sent.groupBy("bucket").applyInArrow(_counted(n_buckets), _ANSWER), "shared"))
