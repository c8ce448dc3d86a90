"""Bounded-space online packing of token ids into sequences.

Each partition keeps ``OPEN`` windows. The rest of a document, after its full windows, goes to the open window
that it fits best. When it fits none, the fullest is filled up with the document's next ids if its gap is worth
a cut, and emitted; the rest is placed again. What is left open at the end of the partitions is merged in
rounds, a few hundred partitions to a task, until one task is left.

A sequence holds ``length`` ids at most; a reader pads it to that length. Null and empty texts have the end id
alone. Null or repeated ``doc_id`` are documents of their own, other columns are not used, and an empty table
gives no sequence. A repeated row is packed as often as it comes.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm import texts, vocabulary
from changelens.llm.batches import small_batches
from changelens.storage import written

OPEN = 32
#: A gap of fewer ids is padded rather than filled with a fragment of a document.
MIN_PIECE = 8
#: Partitions, or tasks of the round before, whose open windows one task merges.
MERGED = 256
SEQUENCE_ROWS = 256

PIECE = pa.struct([(n, pa.int64()) for n in ("doc_id", "start", "length", "doc_tokens")])
COLUMNS = [("task", pa.int32()), ("full", pa.bool_()), ("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("pieces", pa.list_(PIECE))]
SCHEMA = (
    "task INT, full BOOLEAN, sequence_id LONG, ids ARRAY<INT>, "
    "pieces ARRAY<STRUCT<doc_id: LONG, start: LONG, length: LONG, doc_tokens: LONG>>"
)


class Packer:
    """Windows are lists of pieces (doc_id, start, ids, doc_tokens); ``open`` is sorted by used length."""

    def __init__(self, length: int, n_open: int) -> None:
        self.length, self.n_open = length, n_open
        self.open: list[tuple[int, int, list]] = []
        self.made = 0

    def place(self, doc_id, start: int, ids: np.ndarray, doc_tokens: int) -> Iterator[list]:
        """Put the ids into windows; yields the windows that are emitted meanwhile."""
        while len(ids) >= self.length:
            yield [(doc_id, start, ids[: self.length], doc_tokens)]
            start, ids = start + self.length, ids[self.length :]
        while len(ids):
            fits = bisect.bisect_right(self.open, self.length - len(ids), key=lambda w: w[0]) - 1
            if fits >= 0:
                used, number, window = self.open.pop(fits)
            elif len(self.open) < self.n_open:
                self.made += 1
                used, number, window = 0, self.made, []
            else:
                used, _, window = self.open.pop()
                gap = self.length - used
                if gap >= MIN_PIECE:
                    window.append((doc_id, start, ids[:gap], doc_tokens))
                    start, ids = start + gap, ids[gap:]
                yield window
                continue
            window.append((doc_id, start, ids.copy(), doc_tokens))  # an open window does not hold the ids of a whole slice
            if used + len(ids) == self.length:
                yield window
            else:
                bisect.insort(self.open, (used + len(ids), number, window))
            return

    def rest(self) -> Iterator[list]:
        yield from (window for _, _, window in self.open)


def _batch(task: int, full: bool, first: int, windows: list[list]) -> pa.RecordBatch:
    flat = [piece for window in windows for piece in window]
    names, starts, ids, tokens = zip(*flat, strict=True)
    of_window = np.concatenate([[0], np.cumsum([len(w) for w in windows])])
    lengths = [len(x) for x in ids]
    piece = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (names, starts, lengths, tokens)], fields=list(PIECE))
    at = np.concatenate([[0], np.cumsum(lengths)])[of_window].astype(np.int32)
    n = len(windows)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(n, task, np.int32)),
            pa.array([full] * n),
            pa.array(first + np.arange(n)),
            pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(ids))),
            pa.ListArray.from_arrays(pa.array(of_window.astype(np.int32)), piece),
        ],
        names=[name for name, _ in COLUMNS],
    )


def _emitted(task: int, first: int, emitted: Iterator[list], packer: Packer) -> Iterator[pa.RecordBatch]:
    """Rows of emitted windows, then of those that are still open."""
    some: list[list] = []
    for window in emitted:
        some.append(window)
        if len(some) == SEQUENCE_ROWS:
            yield _batch(task, True, first, some)
            first, some = first + len(some), []
    if some:
        yield _batch(task, True, first, some)
        first += len(some)
    if rest := list(packer.rest()):
        yield _batch(task, False, first, rest)


def _packed(vocabulary_path: str, end_id: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, packer = TaskContext.get().partitionId(), Packer(length, OPEN)
        encode = vocabulary.encoder(vocabulary_path).encode

        def emitted() -> Iterator[list]:
            for batch in batches:
                for row, end, text, bounds in texts.text_slices(batch.column("text")):
                    ids, at = vocabulary.with_end(*encode(text, bounds), end_id)
                    names = batch.column("doc_id").slice(row, end - row).to_pylist()
                    for doc_id, a, b in zip(names, at[:-1].tolist(), at[1:].tolist(), strict=True):
                        yield from packer.place(doc_id, 0, ids[a:b], b - a)

        yield from _emitted(task, task << 32, emitted(), packer)

    return run


def _merged(round_: int, length: int):
    """Pack the open windows of a group of tasks into as few as there can be; at most one stays open."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("sequence_id", "ascending")]).combine_chunks()
        task = table.column("task")[0].as_py() // MERGED
        windows = []
        for ids, pieces in zip(table.column("ids").chunk(0), table.column("pieces").to_pylist(), strict=True):
            ids, at = ids.values.to_numpy(), 0
            window = []
            for p in pieces:
                window.append((p["doc_id"], p["start"], ids[at : at + p["length"]], p["doc_tokens"]))
                at += p["length"]
            windows.append((at, window))
        windows.sort(key=lambda w: -w[0])
        packer = Packer(length, 1)

        def emitted() -> Iterator[list]:
            for _, window in windows:
                for piece in window:
                    yield from packer.place(*piece)

        first = ((round_ << 27) + task) << 32
        rows = list(_emitted(task, first, emitted(), packer))
        return pa.Table.from_batches(rows)

    return run


def pack(docs: DataFrame, vocabulary_path: str, end_id: int, length: int = 1024) -> DataFrame:
    """Sequences of ``docs``: ``sequence_id``, ``ids`` (at most ``length``), ``pieces`` in their order in ``ids``."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    with small_batches(docs.sparkSession):
        level = written(source.mapInArrow(texts.then_give_back(_packed(vocabulary_path, end_id, length)), SCHEMA), "packed")
    tables, round_ = [level.filter("full")], 0
    rest = level.filter("NOT full")
    while (top := rest.agg(F.max("task")).first()[0]) is not None:
        round_ += 1
        group = F.floor(F.col("task") / MERGED)
        level = written(rest.groupBy(group.alias("merged_by")).applyInArrow(texts.group_then_give_back(_merged(round_, length)), SCHEMA), "merged")
        if top < MERGED:  # one task has merged all
            tables.append(level)
            break
        tables.append(level.filter("full"))
        rest = level.filter("NOT full")
    return reduce(DataFrame.unionAll, tables).select("sequence_id", "ids", "pieces")


def placements(sequences: DataFrame) -> DataFrame:
    """A row for each piece, with its place and the CRC-32 of its ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, pieces = batch.column("ids"), batch.column("pieces")
            ids = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            of_window = pieces.offsets.to_numpy().astype(np.int64)
            own = pieces.flatten()
            doc_id, start, length, doc_tokens = (own.field(n) for n in ("doc_id", "start", "length", "doc_tokens"))
            n = length.to_numpy().astype(np.int64)
            number = np.repeat(np.arange(len(batch)), np.diff(of_window))
            before = np.cumsum(n) - n  # pieces lie in their sequences without gaps
            offset = before - before[(of_window[:-1] - of_window[0])[number]] if len(n) else before
            at = lists.offsets.to_numpy()[:-1].astype(np.int64)[number] + offset
            crcs = np.fromiter((zlib.crc32(ids[a:b].data) for a, b in zip(at.tolist(), (at + n).tolist(), strict=True)), np.int64, len(n))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = [doc_id, start, length, pa.array(crcs), doc_tokens, batch.column("sequence_id").take(pa.array(number)), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return sequences.mapInArrow(run, "doc_id LONG, start LONG, length LONG, ids_crc32 LONG, doc_tokens LONG, sequence_id LONG, offset LONG")
