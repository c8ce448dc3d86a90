"""Line deduplication by a segment-partition edit join.

A line is what lies between ``\\n``; lines without a word are left alone. Two lines link when they are equal, or when both
have ``LEAST_CHARS`` characters or more and are within ``EDITS`` edits of characters (code points); linked lines,
directly or by others, are one class, and of a class the first occurrence in the corpus stays, by ``doc_id`` (null
last), hash of the text and line number.

1. A line of length l is cut into ``EDITS + 1`` segments; a line of fewer than ``LEAST_CHARS`` has no keys, and is in a
   class with its equals alone. Of two lines within the distance, the longer one holds a
   segment of the shorter one unchanged, and only a few places come into question for each length and
   segment. A line's keys are hashes of all those substrings, with length and number of the segment.
2. :mod:`shared_keys` tells the lines which of their keys other lines hold. Lines that share keys, directly or by
   others, are a cluster.
3. The texts of lines in clusters alone are gathered, past a bitmap of fixed size that lets few others by, and
   candidates are verified by banded bit-parallel edit distance, many pairs to a vector, in tasks of bounded size.

Null texts stay null and have no lines; empty texts and blank lines stay. Long lines are taken whole. Rows equal in ``doc_id`` and text are one
document and keep the same lines. Other columns are passed on whatever their names, but ``n_chars``, where there is
one, follows a text that has changed. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm import texts
from changelens.llm.components import Sets, clusters, linked
from changelens.llm.shared_keys import Chunk, shared_keys
from changelens.storage import written

EDITS = 2
LEAST_CHARS = 16
#: Keys of a line: the places of its segments over all lengths.
KEYS_A_LINE = 12
MEAN_LINE = 200
#: Words of 64 bits in the bitmap that is sent to all tasks (8 MB).
BITMAP_WORDS = 1 << 20
#: Pairs whose distances are found together, and characters of their lines.
PAIRS, PAIR_CHARS = 100_000, 4 << 20
#: Lines that share a key of which all pairs are taken, if they are not in one class already.
SMALL_RUN = 32


def lines_of(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, rows, numbers within the row) of the lines that are looked at."""
    ends_of_line = text == 0x0A
    starts, ends = texts.runs(~ends_of_line, bounds)
    before = np.zeros(len(text) + 1, np.int64)
    np.cumsum(~texts.SPACE[text], out=before[1:])
    some = before[ends] > before[starts]
    starts, ends = starts[some], ends[some]
    np.cumsum(ends_of_line, out=before[1:])
    row = np.searchsorted(bounds, starts, "right") - 1
    return starts, ends, row, before[starts] - before[bounds[row]]


def segment_keys(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of every place where a line may hold a segment of a line of its length or shorter."""
    lines, keys, first = [], [], 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + texts.HASH_BYTES // 2, "right")))
        part = text[low : int(ends[last - 1])]
        hashed = texts.Substrings(part)
        at_char = np.append(np.flatnonzero(texts.LEAD[part]), len(part))  # byte of each character
        own, beyond = (np.searchsorted(at_char, x[first:last] - low) for x in (starts, ends))
        number = first + np.flatnonzero(beyond - own >= LEAST_CHARS)
        own, length = own[number - first], (beyond - own)[number - first]
        for shorter in range(EDITS + 1):
            of = length - shorter
            for segment in range(EDITS + 1):
                place = segment * of // (EDITS + 1)
                size = (segment + 1) * of // (EDITS + 1) - place
                salt = texts.mixed((of * (EDITS + 1) + segment).astype(texts.U64))
                left = EDITS - segment
                for shift in range(max(-segment, shorter - left), min(segment, shorter + left) + 1):
                    at = place + shift
                    fits = np.flatnonzero((at >= 0) & (at + size <= length))
                    lines.append(number[fits])
                    begin = own[fits] + at[fits]
                    byte = at_char[begin]
                    keys.append(texts.mixed(hashed(byte, at_char[begin + size[fits]] - byte) ^ salt[fits]))
        first = last
    if not lines:
        return np.empty(0, np.int64), np.empty(0, texts.U64)
    return np.concatenate(lines), np.concatenate(keys)


def _distinct(docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, keys))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return docs[new], keys[new]


def _extract(batch: pa.RecordBatch) -> Iterator[Chunk]:
    for row, end, text, bounds in texts.text_slices(batch.column("text")):
        own = batch.slice(row, end - row)
        starts, ends, rows, numbers = lines_of(text, bounds)
        nodes = texts.span_hashes(text, starts, ends)
        once = np.sort(np.unique(nodes, return_index=True)[1])
        line, keys = segment_keys(text, starts[once], ends[once])
        docs, keys = _distinct(once[line], keys)
        take = pa.array(rows)
        yield Chunk(nodes, ends - starts, docs, keys, own.column("doc_id").take(take), own.column("h").take(take), numbers)


def _candidates(nodes: np.ndarray, sizes: np.ndarray, docs: np.ndarray, keys: np.ndarray, classes: np.ndarray) -> pa.Table:
    return pa.table({"key": pa.array(keys.view(np.int64)), "node": pa.array(nodes[docs].view(np.int64))})


def _bit_places(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word of the bitmap and two bits in it."""
    word = nodes & texts.U64(BITMAP_WORDS - 1)
    bit = lambda at: texts.U64(1) << ((nodes >> texts.U64(at)) & texts.U64(63))
    return word, bit(20) | bit(26)


def bitmap(nodes: DataFrame) -> np.ndarray:
    """Bits of all nodes; at most ``BITMAP_WORDS`` rows reach the driver."""
    bits = "(shiftleft(1L, CAST(shiftright(node, 20) & 63 AS INT)) | shiftleft(1L, CAST(shiftright(node, 26) & 63 AS INT)))"
    rows = nodes.selectExpr(f"node & {BITMAP_WORDS - 1} AS word", f"{bits} AS bits").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP_WORDS, texts.U64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(texts.U64)
    return out


def _texts_of_lines(bits: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, text, bounds in texts.text_slices(batch.column("text")):
                starts, ends, _, _ = lines_of(text, bounds)
                nodes = texts.span_hashes(text, starts, ends)
                word, own = _bit_places(nodes)
                some = np.flatnonzero((bits.value[word] & own) == own)
                some = some[np.unique(nodes[some], return_index=True)[1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(nodes[some].view(np.int64)),
                        pa.array(ends[some] - starts[some]),
                        pa.array([text[a:b].tobytes() for a, b in zip(starts[some], ends[some], strict=True)], pa.binary()),
                    ],
                    names=["node", "size", "line"],
                )

    return run


def distances(lines: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of the pairs ``lines[a], lines[b]``, right up to ``EDITS``, whose lengths differ by no more.

    Hyyrö's banded form of Myers' bit vectors: bit 63 is the lowest row of the band, and each step moves the band
    down one row. One step is done for all pairs together.
    """
    n = len(a)
    rows, columns = (np.array([len(lines[i]) for i in x]) for x in (a, b))
    longest = int(max(rows.max(), columns.max()))
    kind = np.result_type(*{lines[i].dtype for x in (a, b) for i in x.tolist()})
    pattern = np.full((longest + 3 * EDITS + 2, n), 0x0A, kind)  # no line holds this character
    along = np.full((longest, n), 0x0B, kind)
    for k in range(n):
        pattern[EDITS : EDITS + rows[k], k] = lines[a[k]]
        along[: columns[k], k] = lines[b[k]]
    one = texts.U64(1)
    vp = np.full(n, texts.U64(((1 << 64) - 1) ^ ((1 << (63 - EDITS)) - 1)))
    vn = np.zeros(n, texts.U64)
    distance = np.full(n, EDITS)
    for j in range(1, int(columns.max()) + 1):
        x = np.zeros(n, texts.U64)
        for k in range(2 * EDITS + 1):  # row j + EDITS - k of the pattern
            x |= (pattern[j - 1 + 2 * EDITS - k] == along[j - 1]).astype(texts.U64) << texts.U64(63 - k)
        d0 = (((x & vp) + vp) ^ vp) | x | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        diagonal = j <= rows - EDITS
        distance += diagonal & ((d0 >> texts.U64(63)) == 0)
        across = ~diagonal & (j <= columns)
        bit = np.clip(63 - (j + EDITS - rows), 0, 63).astype(texts.U64)
        distance += across * (((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64))
        vp = hn | ~((d0 >> one) | hp)
        vn = (d0 >> one) & hp
    return distance


def characters(line: bytes) -> np.ndarray:
    """Code points of a line, in bytes where all are below 128."""
    if line.isascii():
        return np.frombuffer(line, np.uint8)
    return np.frombuffer(line.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)


def _links(table: pa.Table) -> np.ndarray:
    """Classes of lines within ``EDITS`` edits, directly or by others."""
    encoded = table.column("line").to_pylist()
    n = len(encoded)
    ends = np.cumsum([len(x) for x in encoded])
    line, keys = _distinct(*segment_keys(np.frombuffer(b"".join(encoded), np.uint8), np.append(0, ends[:-1]), ends))
    lines = [characters(x) for x in encoded]
    del encoded
    lengths = np.array([len(x) for x in lines])
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    held = np.diff(edges)
    bins = np.repeat(np.arange(n) * 32, lengths) + (np.concatenate(lines) & 31)
    histogram = np.bincount(bins, minlength=32 * n).reshape(n, 32).astype(np.int32)
    odd = histogram[:, 1::2].sum(axis=1, dtype=np.int64)  # of a part of the alphabet; an edit changes it by one at most
    order = np.lexsort((odd, lengths))
    a_length = int(lengths.max(initial=0)) + 4 * EDITS + 1  # places between two lengths, so that ranges of odd do not meet
    place = lengths * a_length + odd
    sets = Sets(n)

    tested = np.empty(0, np.int64)

    def like(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Codes ``a * n + b`` (a < b) of the pairs whose lengths and characters allow that they are near."""
        near = (np.abs(lengths[a] - lengths[b]) <= EDITS) & (np.abs(odd[a] - odd[b]) <= EDITS) & (a != b)
        a, b = a[near], b[near]
        near = np.abs(histogram[a] - histogram[b]).sum(axis=1) <= 2 * EDITS
        a, b = a[near], b[near]
        return np.minimum(a, b) * n + np.maximum(a, b)

    def verify(codes: np.ndarray) -> None:
        """Join the pairs that are near; pairs that were seen before are left out."""
        nonlocal tested
        codes = np.setdiff1d(codes, tested)
        tested = np.union1d(tested, codes)
        a, b = codes // n, codes % n
        order = np.argsort(lengths[a], kind="stable")
        a, b = a[order], b[order]
        at = 0
        while at < len(a):
            longest = lengths[a[at : at + PAIRS]] + EDITS  # they ascend
            fit = np.searchsorted(longest * np.arange(1, len(longest) + 1), PAIR_CHARS, "right")
            end = at + max(1, int(fit))
            hit = distances(lines, a[at:end], b[at:end]) <= EDITS
            for x, y in zip(a[at:end][hit].tolist(), b[at:end][hit].tolist(), strict=True):
                sets.join(x, y)
            at = end

    several = np.flatnonzero(held > 1)
    first, size = edges[:-1][several], held[several]
    members = texts.ragged(first, size)
    leaders = np.repeat(line[first], size)
    for at in range(0, len(members), PAIRS):  # stars first
        verify(like(leaders[at : at + PAIRS], line[members[at : at + PAIRS]]))
    # a link that is still missing lies within a run of lines that are not all in one class
    root = sets.roots()
    if len(several):
        of = root[line[members]]
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        mixed = np.maximum.reduceat(of, starts) != np.minimum.reduceat(of, starts)
        first, size = first[mixed], size[mixed]
    for k in np.unique(size[size <= SMALL_RUN]).tolist():
        x, y = np.triu_indices(k, 1)
        runs = first[size == k]
        step = max(1, PAIRS // len(x))
        for at in range(0, len(runs), step):
            own = line[runs[at : at + step, None] + np.arange(k)]
            a, b = own[:, x].ravel(), own[:, y].ravel()
            apart = root[a] != root[b]
            verify(like(a[apart], b[apart]))
    # In a large run a line is only compared with those whose length and count of characters allow a link.
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    root, waiting, n_waiting = sets.roots(), [], 0
    for start, k in zip(first[size > SMALL_RUN].tolist(), size[size > SMALL_RUN].tolist(), strict=True):
        own = order[np.sort(rank[line[start : start + k]])]
        values, counts = np.unique(root[own], return_counts=True)
        alone = own[root[own] != values[counts.argmax()]]  # a missing link has an end among these
        for longer in range(-EDITS, EDITS + 1):
            middle = place[alone] + longer * a_length
            low, high = np.searchsorted(place[own], middle - EDITS), np.searchsorted(place[own], middle + EDITS, "right")
            ends = np.cumsum(high - low)
            at = 0
            while at < len(alone):
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                a, b = np.repeat(alone[at:end], (high - low)[at:end]), own[texts.ragged(low[at:end], (high - low)[at:end])]
                apart = root[a] != root[b]
                waiting.append(like(a[apart], b[apart]))
                n_waiting += len(waiting[-1])
                at = end
        if n_waiting >= PAIRS:
            verify(np.concatenate(waiting))
            root, waiting, n_waiting = sets.roots(), [], 0
    if waiting:
        verify(np.concatenate(waiting))
    return sets.roots()


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        new, total, removed = [], [], []
        for text, gone in zip(batch.column("doc").field("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines = [] if text is None else text.split("\n")
            drop = set(gone or ())
            new.append(text if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop))
            total.append(len(lines))
            removed.append(len(drop))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(new, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
            names=["doc", "text", "n_lines", "n_removed"],
        )


def _removed(docs: DataFrame) -> DataFrame:
    """``unnamed``, ``id``, ``h`` of documents and ``gone``, the numbers of their lines to remove."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    n_bytes = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    answers = shared_keys(source, _extract, n_bytes * KEYS_A_LINE // MEAN_LINE)
    cluster = clusters(answers.assembled("key LONG, node LONG", _candidates))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(cluster))
    lines = source.select("text").mapInArrow(texts.then_give_back(_texts_of_lines(bits)), "node LONG, size LONG, line BINARY")
    of_cluster = lines.join(cluster.select("node"), "node", "left_semi")
    roots = linked(of_cluster, cluster, "size", ["line"], _links, together=True)

    name = F.struct(F.col("id").isNull().alias("unnamed"), F.coalesce("id", F.lit(0)).alias("id"), F.col("row_hashes").alias("h"), F.col("lines").alias("line"))
    places = answers.members("row_hashes", "lines").select("node", name.alias("name"))
    classed = written(places.join(roots, "node", "left").select(F.coalesce("root", "node").alias("class"), "name"), "lines")
    firsts = classed.groupBy("class").agg(F.min("name").alias("first"), F.max("name").alias("last")).filter("first != last")
    later = classed.join(written(firsts.select("class", "first"), "firsts"), "class").filter("name != first")
    return later.groupBy("name.unnamed", "name.id", "name.h").agg(F.collect_set("name.line").alias("gone"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``doc``, with its new ``text``, ``n_lines`` before and ``n_removed``."""
    whole = docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.col("doc_id").isNull().alias("unnamed"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.col("text").cast("string")).alias("h"),
    )
    joined = whole.join(_removed(docs), ["unnamed", "id", "h"], "left").select("doc", "gone")
    schema = T.StructType([joined.schema["doc"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(texts.then_give_back(_cleaned), schema)


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated lines; a document that loses lines and has no word left goes."""
    found = deduplicated(docs).filter("n_removed = 0 OR text RLIKE '[^ \\\\t-\\\\r]'")
    doc = F.col("doc").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        doc = doc.withField("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("doc.n_chars")))
    return found.select(doc.alias("doc")).select("doc.*")
