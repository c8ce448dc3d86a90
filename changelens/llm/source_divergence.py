"""How far the sources of a language differ in their words.

Terms are maximal runs of letters (A-Z lower-cased) and characters from U+0080 on. A language keeps the V terms that
occur in at least ``LEAST_DOCUMENTS`` of its documents. A group (language, source), and the language as a whole, gives
a kept term that occurs ``count`` times there ``p = 1 + floor(SCALE * (count + 1) / (N + V))``, N being the sum of its
counts of kept terms. The divergence of p from q is ``floor((p - q) ** 2 / q)``, in whole numbers throughout.

* Part ``pair``: for each other source of the language, the sum of the divergences from it over all kept terms.
* Part ``term``: the terms that a group has, and more often than its language; the first ``TERM_RANKS`` of them.

Late strings: a scan counts the terms of a few megabytes exactly, and from then on a term is its 64-bit digest. Counts
by group, document frequencies, probabilities, pairs and ranks move digests and numbers. Beside them the scan writes
each chunk's dictionary; the least and greatest string of a digest show whether two terms share it. The terms of such
digests, if there are any, are counted again as strings: ``split`` is the string there and empty elsewhere, and
digest and ``split`` together are the term. Strings come back for the ranked terms alone, with all that are equal in
value to the last of them, as ties are ordered by string.

Pairs of sources are summed in blocks of terms and tiles of ``TILE`` sources: a block holds a bounded number of counts,
for two tiles, and gives one sum for each pair. Terms that neither tile has add the same for all, by their number.

Null texts, languages and sources are empty strings, which are a language and a source like others. A document without
terms counts for its group, which then has only pairs, with N = 0 if it has no kept term at all; pairs are 0 where
the language keeps no terms. ``doc_id`` is not used, so rows with repeated or null ids are documents of their own.
Ties in value are ordered by the UTF-8 bytes of the item. Long texts are read whole, other columns are not used, and
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm import terms, texts
from changelens.skew import hot_keys, salted_join
from changelens.storage import written

SCALE = 1_000_000_000
LEAST_DOCUMENTS = 3
TERM_RANKS = 200
#: Sources compared with each other in one block, and counts that a block is to hold.
TILE = 64
BLOCK_CELLS = 400_000
TERMS_AT_ONCE = 8192
#: Bytes of text that are counted together.
CHUNK_BYTES = 16 << 20
DIGEST_BITS = 64

_COUNTED = "lang STRING, source STRING, digests ARRAY<LONG>, counts ARRAY<LONG>, docs ARRAY<LONG>, terms ARRAY<STRING>"
_TERM = ["digest", "split"]


def _digests(found: pa.Array, bits: int) -> np.ndarray:
    return (terms.digests(found) >> texts.U64(64 - bits)).view(np.int64)


def _lists(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)


def _by_group(batch: pa.RecordBatch, row: int, end: int) -> tuple[list[pa.Array], np.ndarray]:
    """Language and source of the distinct groups of some rows, and the number of each row's group."""
    number: dict[tuple[str, str], int] = {}
    pairs_ = zip(*(batch.column(c).slice(row, end - row).to_pylist() for c in ("lang", "source")), strict=True)
    of = np.array([number.setdefault(g, len(number)) for g in pairs_], np.int64)
    return [pa.array([g[i] for g in number], pa.string()) for i in (0, 1)], of


def _counted(bits: int, as_strings: bool, chunk_bytes: int):
    """By group of a chunk its terms, with their occurrences and documents. Terms are given as digests, with a row of
    all distinct terms of the chunk beside them, or, ``as_strings``, with the terms in each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, text, bounds in texts.text_slices(batch.column("text"), chunk_bytes):
                found = terms.terms(text, bounds, terms.WORDS)
                (langs, sources), group_of = _by_group(batch, row, end)
                doc, term, n = found.counts()
                width = max(1, len(found.distinct))
                keys, place = np.unique(group_of[doc] * width + term, return_inverse=True)
                docs = np.bincount(place, minlength=len(keys)).astype(np.int64)
                counts = np.bincount(place, weights=n, minlength=len(keys)).astype(np.int64)  # exact below 2**53
                cut = np.searchsorted(keys // width, np.arange(len(langs) + 1))
                digests = _digests(found.distinct, bits)
                own = keys % width
                names = _lists(found.distinct.take(pa.array(own)), cut) if as_strings else pa.nulls(len(langs), pa.list_(pa.string()))
                numbers = (_lists(pa.array(x), cut) for x in (digests[own], counts, docs))
                out = [langs, sources, *numbers, names]
                yield pa.RecordBatch.from_arrays(out, names=["lang", "source", "digests", "counts", "docs", "terms"])
                if not as_strings:
                    none = pa.nulls(1, pa.string())
                    whole = np.array([0, len(digests)])
                    empty = pa.nulls(1, pa.list_(pa.int64()))
                    listed = [none, none, _lists(pa.array(digests), whole), empty, empty, _lists(found.distinct, whole)]
                    yield pa.RecordBatch.from_arrays(listed, names=["lang", "source", "digests", "counts", "docs", "terms"])

    return run


def _source(docs: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(text("lang"), text("source"), text("text"))


def probability(count: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / total)``, exact also where the product has more than 64 bits."""
    fits = count < (1 << 63) // SCALE - 1
    wide = F.expr(f"CAST({SCALE} AS DECIMAL(10,0))") * (count + 1).cast("decimal(19,0)")
    return F.when(fits, F.call_function("div", SCALE * (count + 1), total)).otherwise(
        F.call_function("div", wide, total.cast("decimal(19,0)"))) + 1


def divergence(p: Column, q: Column) -> Column:
    """``floor((p - q) ** 2 / q)``; both are below ``SCALE + 2``, so the square has less than 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


class Counts:
    """Counts of the kept terms of all groups, by numbers and digests."""

    def __init__(self, docs: DataFrame, bits: int = DIGEST_BITS) -> None:
        source = _source(docs)
        chunks = written(source.mapInArrow(_counted(bits, False, CHUNK_BYTES), _COUNTED), "term-counts")
        by_chunk = chunks.filter("lang IS NOT NULL")
        groups = by_chunk.select("lang", "source").distinct().withColumn("gid", F.monotonically_increasing_id())
        groups = written(groups, "groups")
        langs = groups.groupBy("lang").agg(F.min("gid").alias("lid"))
        order = Window.partitionBy("lang").orderBy("source")
        #: ``gid``, ``lid`` (a group of the language, whose number stands for it) and ``place`` among its sources.
        self.groups = written(groups.withColumn("place", (F.row_number().over(order) - 1).cast("long")).join(langs, "lang"), "groups")
        numbers = self.groups.select("lang", "source", "gid", "lid")

        listed = chunks.filter("terms IS NOT NULL").select(F.explode(F.arrays_zip("digests", "terms")).alias("t"))
        least, greatest = F.min("t.terms").alias("term"), F.max("t.terms").alias("greatest")
        dictionary = written(listed.groupBy(F.col("t.digests").alias("digest")).agg(least, greatest), "dictionary")
        #: Digests that several terms share.
        self.shared = written(dictionary.filter("term <> greatest").select("digest"), "shared-digests")
        #: The term of every other digest.
        self.dictionary = dictionary.filter("term = greatest").select("digest", "term")

        rows = self._rows(by_chunk.join(numbers, ["lang", "source"]))
        if not self.shared.isEmpty():
            again = source.mapInArrow(_counted(bits, True, CHUNK_BYTES), _COUNTED).join(numbers, ["lang", "source"])
            exact = self._rows(again, "terms").join(self.shared, "digest", "left_semi")
            rows = rows.join(self.shared, "digest", "left_anti").unionByName(exact)
        cells = written(rows.groupBy("gid", "lid", *_TERM).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "cells")
        by_lang = cells.groupBy("lid", *_TERM).agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs"), F.count("*").alias("holders"))
        kept = written(by_lang.filter(F.col("docs") >= LEAST_DOCUMENTS).drop("docs"), "kept")
        hot = hot_keys(kept, ["lid", *_TERM], "holders")
        kept = kept.drop("holders")
        #: ``lid``, digest and ``split``, ``gid``, occurrences ``n`` there and ``in_lang``.
        self.cells = written(salted_join(cells.drop("docs"), kept, ["lid", *_TERM], "inner", hot, F.col("gid")), "kept-cells")
        #: ``lid``, the number ``v`` of kept terms, and their occurrences.
        vocabulary = kept.groupBy("lid").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total"))
        totals = self.cells.groupBy("gid").agg(F.sum("n").alias("total"))
        sizes = self.groups.join(vocabulary, "lid", "left").join(totals, "gid", "left")
        #: By group ``total`` (N + V of the group), ``lang_total`` (of the language) and ``v``.
        self.sizes = written(
            sizes.select(
                "gid", "lid", "lang", "source", "place", F.coalesce("v", F.lit(0)).alias("v"),
                (F.coalesce("total", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("total"),
                (F.coalesce("lang_total", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("lang_total"),
            ),
            "sizes",
        )

    @staticmethod
    def _rows(chunks: DataFrame, split: str | None = None) -> DataFrame:
        lists = ["digests", "counts", "docs", *([split] if split else [])]
        rows = chunks.select("gid", "lid", F.explode(F.arrays_zip(*lists)).alias("c"))
        of_digest = F.col(f"c.{split}") if split else F.lit("")
        return rows.select("gid", "lid", F.col("c.digests").alias("digest"), of_digest.alias("split"), F.col("c.counts").alias("n"), "c.docs")

    def strings(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the ``term`` of their digest and ``split``."""
        joined = rows.join(self.dictionary, "digest", "left")
        return joined.withColumn("term", F.when(F.col("split") != "", F.col("split")).otherwise(F.col("term")))


def _summed(places_a_tile: int, at_once: int):
    """Sums of divergences between the sources of two tiles, over the terms of a block that one of them has. The rows
    without a digest say what a source gives a term that it does not have."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lid, _, tile_a, tile_b = (k.as_py() for k in key)
        place, p = table.column("place").to_numpy(), table.column("p").to_numpy()
        absent = table.column("digest").is_null().to_numpy()
        digest, split = table.column("digest").fill_null(0).to_numpy(), table.column("split_hash").to_numpy()
        order = np.lexsort((split[~absent], digest[~absent]))
        digest, split = digest[~absent][order], split[~absent][order]
        new = np.ones(len(digest), bool)
        new[1:] = (digest[1:] != digest[:-1]) | (split[1:] != split[:-1])
        term, cell_place, cell_p = np.cumsum(new) - 1, place[~absent][order], p[~absent][order]
        n_terms = int(new.sum())

        def side(tile: int) -> tuple[np.ndarray, np.ndarray]:
            own = absent & (place // places_a_tile == tile)
            found = place[own], p[own]
            return tuple(x[np.argsort(found[0])] for x in found)

        (places_a, none_a), (places_b, none_b) = side(tile_a), side(tile_b)
        ab, ba = np.zeros((len(none_a), len(none_b)), np.int64), np.zeros((len(none_b), len(none_a)), np.int64)
        for first in range(0, n_terms, at_once):
            cut = slice(*np.searchsorted(term, [first, first + at_once]))
            width = min(at_once, n_terms - first)
            dense = []
            for tile, places, none in ((tile_a, places_a, none_a), (tile_b, places_b, none_b)):
                own = cell_place[cut] // places_a_tile == tile
                whole = np.repeat(none[:, None], width, axis=1)
                whole[np.searchsorted(places, cell_place[cut][own]), term[cut][own] - first] = cell_p[cut][own]
                dense.append(whole)
            for sums, left, right in ((ab, *dense), (ba, *dense[::-1])):
                for x in range(len(left)):
                    difference = left[x] - right
                    sums[x] += (difference * difference // right).sum(axis=1)
        of = [(ab, places_a, places_b)] if tile_a == tile_b else [(ab, places_a, places_b), (ba, places_b, places_a)]
        a, b = (np.concatenate(x) for x in zip(*((np.repeat(i, len(j)), np.tile(j, len(i))) for _, i, j in of), strict=True))
        value = np.concatenate([sums.ravel() for sums, _, _ in of])
        return pa.table({"lid": np.full(len(a), lid), "a": a, "b": b, "value": value, "seen": np.full(len(a), n_terms)})

    return run


def pairs(counts: Counts) -> DataFrame:
    """``gid`` of each group, ``item`` (each other source of its language) and ``value``."""
    zero = F.lit(0).cast("long")
    absent = F.when(F.col("v") > 0, probability(zero, F.col("total"))).otherwise(F.lit(1).cast("long"))
    sizes = counts.sizes.withColumn("absent", absent).withColumn("tile", F.floor(F.col("place") / TILE))
    n_tiles = sizes.groupBy("lid").agg((F.max("tile") + 1).alias("n_tiles"))
    sizes = written(sizes.join(n_tiles, "lid"), "tiled")

    n_blocks = max(1, -(-counts.cells.count() // BLOCK_CELLS))
    columns = ["lid", "block", "digest", "split_hash", "place", "p", "tile", "n_tiles"]
    own = counts.cells.join(sizes.drop("lid"), "gid").withColumn("p", probability(F.col("n"), F.col("total")))
    cells = own.withColumn("block", F.pmod(F.xxhash64("lid", *_TERM), F.lit(n_blocks))).withColumn("split_hash", F.xxhash64("split"))
    heads = sizes.filter("v > 0").withColumn("block", F.explode(F.sequence(zero, F.lit(n_blocks - 1).cast("long"))))
    heads = heads.withColumn("digest", F.lit(None).cast("long")).withColumn("split_hash", zero).withColumn("p", F.col("absent"))
    rows = cells.select(*columns).unionByName(heads.select(*columns)).withColumn("other", F.explode(F.sequence(zero, F.col("n_tiles") - 1)))
    both = rows.select("*", F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"))
    summed = both.groupBy("lid", "block", "tile_a", "tile_b").applyInArrow(_summed(TILE, TERMS_AT_ONCE), "lid LONG, a LONG, b LONG, value LONG, seen LONG")
    total = written(summed.groupBy("lid", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen")), "pair-sums")

    left = sizes.select("lid", F.col("place").alias("a"), "gid", "v", F.col("absent").alias("absent_a"))
    right = sizes.select("lid", F.col("place").alias("b"), F.col("source").alias("item"), F.col("absent").alias("absent_b"))
    every = left.join(right, "lid").filter("a <> b").join(total, ["lid", "a", "b"], "left")
    unseen = (F.col("v") - F.coalesce("seen", zero)) * divergence(F.col("absent_a"), F.col("absent_b"))
    return every.select("gid", "item", (F.coalesce("value", zero) + unseen).alias("value"))


def excess_terms(counts: Counts) -> DataFrame:
    """``gid``, ``item`` and ``value`` of the terms that a group has more often than its language, as far as the rank of
    their value is ``TERM_RANKS`` at most."""
    sizes = counts.sizes.select("gid", "total", "lang_total")
    p, q = probability(F.col("n"), F.col("total")), probability(F.col("in_lang"), F.col("lang_total"))
    above = counts.cells.join(sizes, "gid").select("gid", *_TERM, p.alias("p"), q.alias("q")).filter("p > q")
    valued = above.select("gid", *_TERM, divergence(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("gid").orderBy(F.desc("value"))
    ranked = written(valued.withColumn("r", F.rank().over(best)).filter(F.col("r") <= TERM_RANKS).drop("r"), "ranked-terms")
    return counts.strings(ranked).select("gid", F.col("term").alias("item"), "value")


def audit(docs: DataFrame, bits: int = DIGEST_BITS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of all groups."""
    counts = Counts(docs, bits)
    rank = F.row_number().over(Window.partitionBy("gid").orderBy(F.desc("value"), "item"))
    both = pairs(counts).select("gid", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    above = excess_terms(counts).select("gid", F.lit("term").alias("part"), "item", "value", rank.alias("rank"))
    ranked = both.unionByName(above.filter(F.col("rank") <= TERM_RANKS))
    return ranked.join(counts.groups.select("gid", "lang", "source"), "gid").select("lang", "source", "part", "item", "value", "rank")
