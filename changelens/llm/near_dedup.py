"""Near-duplicate documents by bottom-k sketches of one hash function.

A document is the set of its distinct three-word shingles (words without spaces and 0x09-0x0D, A-Z lower-cased; with
fewer words, the whole sequence is one shingle), each known by a 64-bit hash. Documents link when
``100 * intersection >= 85 * union``. Documents with equal sets are one *node*, known by 128 bits of its set.

1. The sketch of a node is its ``SKETCH`` least hashes, all of them if there are fewer.
2. Inverted lists: each retained value counts its nodes. Two linked nodes retain at least :func:`least_common` values
   in common, so a node that shares fewer than that with all others together has no partner. Of the others, rare
   values first, one more than may be missing is indexed: linked nodes meet under one of those. Values of a passage
   that many documents share are the most frequent ones of their nodes and so seldom indexed.
3. Nodes that share an indexed value, directly or by others, are compared by their sketches: the common values among
   the ``SKETCH`` least of both together estimate the similarity. What may be linked stays together.
4. What is left is verified by exact intersections of the full sets, which are made for these nodes alone, of one text
   for each.

Steps 3 and 4 run in tasks of bounded size (:mod:`components`); they compare a node with all others of its group at
once and leave out pairs that are known to be in one component, so no list of pairs is ever made.

Sets of up to about 300 shingles lose no link. Of larger ones a sketch is a sample of the union, and a link is lost
with a chance below ``LOSS``, over all values that the one hash function may take.

Null and empty texts, and those without words, have no shingles and link with nothing. ``doc_id`` may repeat or be
null: each row is a document, and ``component_id`` is the least ``doc_id`` that is not null among those reached, null
if there is none; ``kept`` is true where both are equal or null, so repeated rows of the least id all stay. Long texts
are read whole. Other columns are not used, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm import texts
from changelens.llm.components import clusters, linked
from changelens.skew import hot_keys, salted_join
from changelens.storage import written

SHINGLE = 3
#: Similarity as a percentage of the union.
PERCENT = 85
#: Values that a sketch retains.
SKETCH = 128
#: Chance that two linked sets of any size have fewer common values in their sketches than is asked for.
LOSS = 1e-15
#: Words of 64 bits that mark the texts of which full sets are needed.
MARK_WORDS = 1 << 18
#: Bytes of text that are cut into shingles together.
CHUNK_BYTES = 4 << 20

_SKETCHED = "doc_id LONG, h LONG, set_a LONG, set_b LONG, n_shingles LONG, sketch ARRAY<LONG>"


def _sampled() -> int:
    """Most common values that all but a share of ``LOSS`` of linked pairs have among the ``SKETCH`` least of both:
    at least that many of so many draws hit, each with ``PERCENT``; drawing without return hits more evenly."""
    share, tail = PERCENT / 100, 0.0
    for hits in range(SKETCH + 1):
        tail += comb(SKETCH, hits) * share**hits * (1 - share) ** (SKETCH - hits)
        if tail > LOSS:
            return hits
    return SKETCH


SAMPLED = _sampled()


def least_common(size: Column) -> Column:
    """Least number of values that the sketch of a set of this size has in common with that of a linked set.

    With a union of u at most ``15 % of u`` values are in one set alone, so of the ``SKETCH`` least (or u) the others
    are common; u is between the size and ``size / 0.85``, and one of the ends is the worst. For large sets this
    bound is weak, and the one of the sample holds.
    """
    most = F.floor(size * 100 / PERCENT)
    alone = lambda u: F.floor(u * (100 - PERCENT) / 100)
    certain = F.least(F.least(size, F.lit(SKETCH)) - alone(size), F.least(most, F.lit(SKETCH)) - alone(most))
    return F.greatest(certain, F.when(size > SKETCH, F.lit(SAMPLED)).otherwise(F.lit(1))).cast("int")


def shingles(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of the texts' shingles, by row and hash."""
    lower = texts.LOWER[text]
    starts, ends = texts.runs(~texts.SPACE[lower], bounds)
    words = texts.span_hashes(lower, starts, ends)
    at = texts.of_rows(starts, bounds)
    n = np.diff(at)
    row = np.repeat(np.arange(len(n), dtype=np.int64), n)
    windows = texts.window_hashes(words, SHINGLE)
    whole = np.flatnonzero(row[: len(windows)] == row[SHINGLE - 1 :]) if len(windows) else np.empty(0, np.int64)
    rows, keys = [row[whole]], [windows[whole]]
    for size in range(1, SHINGLE):
        short = np.flatnonzero(n == size)
        if len(short):  # the words of all texts of this size, as one window each
            own = words[texts.ragged(at[short], np.full(len(short), size))]
            rows.append(short)
            keys.append(texts.window_hashes(own, size)[::size])
    rows, keys = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
    return rows[new], keys[new]


def _set_names(keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set; ``at`` cuts the keys into sets."""
    size, names = np.diff(at).astype(texts.U64), []
    for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        sums = np.zeros(len(keys) + 1, texts.U64)
        np.cumsum(texts.mixed(keys ^ texts.U64(salt)), out=sums[1:])
        names.append(texts.mixed(sums[at[1:]] - sums[at[:-1]] + size).view(np.int64))
    return names[0], names[1]


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values.view(np.int64)))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, text, bounds in texts.text_slices(batch.column("text"), CHUNK_BYTES):
            rows, keys = shingles(text, bounds)
            sizes = np.bincount(rows, minlength=end - row)
            at = np.concatenate([[0], np.cumsum(sizes)])
            set_a, set_b = _set_names(keys, at)
            kept = np.minimum(sizes, SKETCH)
            sketch = _lists(keys[texts.ragged(at[:-1], kept)], kept)
            own = batch.slice(row, end - row)
            columns = [own.column("doc_id"), own.column("h"), pa.array(set_a), pa.array(set_b), pa.array(sizes.astype(np.int64)), sketch]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "set_a", "set_b", "n_shingles", "sketch"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, text, bounds in texts.text_slices(batch.column("text"), CHUNK_BYTES):
            rows, keys = shingles(text, bounds)
            sizes = np.bincount(rows, minlength=end - row)
            cut = np.concatenate([[0], np.cumsum(sizes)])
            blobs = [keys[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            own = batch.column("node").slice(row, end - row)
            yield pa.RecordBatch.from_arrays([own, pa.array(sizes.astype(np.int64)), pa.array(blobs, pa.binary())], names=["node", "size", "keys"])


def _source(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"))


class _Lists:
    """Inverted lists of the rows' ascending values, to compare one row with many others at once."""

    def __init__(self, values: list[np.ndarray]) -> None:
        self.sizes = np.array([len(v) for v in values])
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])
        distinct, self.key = np.unique(np.concatenate(values), return_inverse=True)
        self.owner = np.repeat(np.arange(len(values)), self.sizes)[np.argsort(self.key, kind="stable")]
        self.holders = np.bincount(self.key)
        self.starts = np.cumsum(self.holders) - self.holders
        self.place = np.full(len(distinct), -1)  # of a value in the row that is compared

    def near(self, x: int, least: int, others: np.ndarray) -> np.ndarray:
        """The rows marked in ``others`` that have ``least`` values in common with row ``x``. All have one of its rarest, of
        which there is one more than may be missing, so the other lists are read only if a marked row is in one of those."""
        own = self.key[self.at[x] : self.at[x + 1]]
        rare = own[np.argsort(self.holders[own], kind="stable")[: max(0, len(own) - least + 1)]]
        if not others[self.owner[texts.ragged(self.starts[rare], self.holders[rare])]].any():
            return np.empty(0, np.int64)
        total = np.bincount(self.owner[texts.ragged(self.starts[own], self.holders[own])], minlength=len(others))
        return np.flatnonzero(others & (total >= least))

    def common(self, x: int, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """How many values each of the ``rows`` has in common with row ``x``, and how many of those are among the ``least``
        least values of both together."""
        own = self.key[self.at[x] : self.at[x + 1]]
        self.place[own] = np.arange(len(own))
        sizes = self.sizes[rows]
        row = np.repeat(np.arange(len(rows)), sizes)
        other_place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = self.place[self.key[texts.ragged(self.at[rows], sizes)]]
        self.place[own] = -1
        both = place >= 0
        row, place, other_place = row[both], place[both], other_place[both]
        total = np.bincount(row, minlength=len(rows))
        before = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
        within = place + other_place - before < least  # the value's rank in the union of both
        return total, np.bincount(row[within], minlength=len(rows))


def _joined(n: int, hits: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Components of rows where ``hits(x, others)`` are those of the rows marked in ``others`` that ``x`` links to.

    A row is compared only with rows that are in other components by then. Stars come first: most rows of a large group
    are found by a few of them. A link that is still missing after that has an end outside the largest component.
    """
    part, seen, placed = np.arange(n), np.zeros(n, bool), np.zeros(n, bool)

    def compare(x: int) -> None:
        found = hits(x, part != part[x])
        seen[x] = placed[x] = True
        placed[found] = True
        if len(found):
            parts = np.unique(part[found])
            part[np.isin(part, parts)] = part[x]

    for x in range(n):
        if not placed[x]:
            compare(x)
    largest = np.bincount(part).argmax()
    for x in np.flatnonzero((part != largest) & ~seen).tolist():
        compare(x)
    return part


def _estimated(table: pa.Table) -> np.ndarray:
    """Components of the rows (``size``, ``sketch``) whose sketches allow a link."""
    size = table.column("size").to_numpy()
    lists = table.column("sketch").combine_chunks()
    values, bounds = lists.flatten().to_numpy().view(texts.U64), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    inverted = _Lists([values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    least = _least_common(size)

    def hits(x: int, others: np.ndarray) -> np.ndarray:
        alike = PERCENT * np.maximum(size, size[x]) <= 100 * np.minimum(size, size[x])
        rows = inverted.near(x, int(least[x]), others & alike)
        return rows[_may_link(size[x], size[rows], *inverted.common(x, rows, SKETCH))]

    return _joined(len(size), hits)


def _least_common(size: np.ndarray) -> np.ndarray:
    """:func:`least_common` of numbers."""
    most = 100 * size // PERCENT
    ends = [np.minimum(u, SKETCH) - (100 - PERCENT) * u // 100 for u in (size, most)]
    return np.maximum(np.minimum(*ends), np.where(size > SKETCH, SAMPLED, 1))


def _may_link(size_a: int, size_b: np.ndarray, common: np.ndarray, among_least: np.ndarray) -> np.ndarray:
    """May sets of these sizes be linked, of which so many values of the sketches are common?"""
    whole = np.maximum(size_a, size_b) <= SKETCH  # these sketches are the sets
    exact = 100 * common >= PERCENT * (size_a + size_b - common)
    # of a union of at most u values, at most 15 % are in one set alone
    u = 100 * np.minimum(size_a, size_b) // PERCENT
    estimate = among_least >= np.maximum(SAMPLED, SKETCH - (100 - PERCENT) * u // 100)
    return (common > 0) & np.where(whole, exact, estimate)


def _verified(table: pa.Table) -> np.ndarray:
    """Components of the exact links among the rows (``size``, ``keys``)."""
    size = table.column("size").to_numpy()
    inverted = _Lists([np.frombuffer(b, texts.U64) for b in table.column("keys").to_pylist()])

    def hits(x: int, others: np.ndarray) -> np.ndarray:
        rows = inverted.near(x, -(-PERCENT * int(size[x]) // 100), others)
        common, _ = inverted.common(x, rows, 0)
        return rows[100 * common >= PERCENT * (size[rows] + size[x] - common)]

    return _joined(len(size), hits)


def sketched(docs: DataFrame) -> DataFrame:
    """Of every document its ``sketch``, ``n_shingles``, and the two names of its set; ``h`` is the hash of its text."""
    return written(_source(docs).mapInArrow(_sketches, _SKETCHED).withColumn("row", F.monotonically_increasing_id()), "sketches")


def nodes(sketches: DataFrame) -> DataFrame:
    """A row for each distinct set: ``node`` (one of its rows), the least ``doc_id``, and the row that stands for it."""
    stands = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h")
    found = sketches.filter("n_shingles > 0").groupBy("set_a", "set_b").agg(
        F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.min(stands).alias("stands"), F.count("*").alias("n")
    )
    return written(found, "nodes")


def candidates(sketches: DataFrame, own: DataFrame) -> DataFrame:
    """``node`` and ``root`` of the nodes that share an indexed value, ``size`` and ``sketch`` of each."""
    unique = written(
        sketches.join(own.select(F.col("node").alias("row")), "row").select(F.col("row").alias("node"), F.col("n_shingles").alias("size"), "sketch"),
        "node-sketches",
    )
    postings = unique.select("node", "size", F.explode("sketch").alias("value"))
    held = written(postings.groupBy("value").agg(F.count("*").alias("holders")).filter("holders > 1"), "holders")
    shared = salted_join(postings, held, ["value"], "inner", hot_keys(held, ["value"], "holders"), F.col("node"))
    by_node = shared.groupBy("node").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("holders", "value")))["value"].alias("rare"))
    more = F.size("rare") - least_common(F.col("size")) + 1
    index = by_node.filter(more > 0).select(F.explode(F.slice("rare", F.lit(1), more)).alias("key"), "node")
    return unique.join(clusters(index), "node")


def _marked(source: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of ``source`` whose ``h`` has its bit among those of ``needed``, so that few other texts are shuffled. The
    bits are at most ``MARK_WORDS`` rows of 64, which is the bound of what is broadcast."""
    word = F.pmod(F.col("h"), F.lit(MARK_WORDS)).alias("word")
    bit = F.shiftright("h", 40).bitwiseAND(63).cast("int")
    set_ = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    marks = needed.groupBy(word).agg(F.bit_or(set_(bit)).alias("marks"))
    joined = source.withColumn("word", word).join(F.broadcast(marks), "word")
    return joined.filter(F.col("marks").bitwiseAND(set_(bit)) != 0).drop("word", "marks")


def components_of(docs: DataFrame, sketches: DataFrame, own: DataFrame) -> DataFrame:
    """``node`` and ``root``, one node for all that are linked, of nodes that have candidates."""
    near = written(candidates(sketches, own), "candidates")
    weighed = near.withColumn("weight", F.size("sketch"))
    likely = linked(weighed.select("node", "size", "sketch", "weight"), near.select("node", "root"), "weight", ["size", "sketch"], _estimated)
    likely = written(likely, "likely")
    large = written(likely.groupBy("root").agg(F.count("*").alias("n")).filter("n > 1").select("root"), "groups")
    some = likely.join(large, "root")
    texts_of = written(own.join(some, "node").select("node", "root", "stands.*"), "stand-for")
    source = _marked(_source(docs), texts_of).select(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "h", "text")
    found = source.join(texts_of.select("unnamed", "id", "h", "node"), ["unnamed", "id", "h"]).select("node", "text")
    full = written(found.mapInArrow(_full_sets, "node LONG, size LONG, keys BINARY"), "full-sets")
    return linked(full, texts_of.select("node", "root"), "size", ["size", "keys"], _verified)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every document."""
    sketches = sketched(docs)
    own = nodes(sketches)
    roots = written(components_of(docs, sketches, own), "roots")
    named = own.join(roots, "node", "left").select("set_a", "set_b", "n", "least_id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = written(named.join(least, "root").select("set_a", "set_b", "n", F.struct("component_id").alias("of")), "classes")
    rows = sketches.select("doc_id", "n_shingles", "set_a", "set_b")
    found = salted_join(rows, classes.drop("n"), ["set_a", "set_b"], "left", hot_keys(classes, ["set_a", "set_b"]), F.struct("doc_id"))
    component = F.when(F.col("n_shingles") > 0, F.col("of.component_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
