"""The best documents for each query, by impact lists and best positions.

Terms are maximal runs of letters (A-Z lower-cased), digits and characters from U+0080 on. N counts the documents with
a term, L all their terms, n those of one document, df the documents with a term and tf its occurrences in one. A term
has the weight ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))`` and the impact ``w * ((10**9 * tf) div (1000 * tf + 8 *
m))`` in a document, where ``m = 10 + (90 * n * N) div L``; a document's score is the sum over the query's terms.

1. A scan keeps of every document n and the query terms in it. N, L and df are counts of that table.
2. Its tasks cut their documents into shards of ``SHARD_POSTINGS`` postings. A shard orders each term's documents by
   impact, and each document knows its position in every list.
3. Best Position Algorithm: the lists of a query are read from the top, a few positions of all lists at a time. A
   document seen for the first time is looked up in all lists, which gives its score, and its positions there
   count as seen too. The best position of a list is the last one up to which all have been seen, which may lie far
   beyond what was read. No document that is still unseen scores more than the sum of the impacts at the best
   positions; once that is less than the least of the ``k`` best scores, the search stops. While it is equal the search
   goes on, as an unseen document might have the smaller ``doc_id``.
4. A task keeps the ``k`` best of each query over its shards, and a later shard starts with the score to beat. The
   rows of all tasks, at most ``k`` for each query, are ranked again.

Queries go to the tasks in blocks of about ``QUERY_BYTES`` of text; with more, the documents are scanned once for each
block.

A null query or document has no terms. Queries without terms, and those whose terms no document has, have no rows;
documents with score 0 are not listed. Equal scores are ordered by ascending ``doc_id``, null last. Repeated rows of
either table are documents and queries of their own. Long texts are read whole; other columns are not used, whatever
their names. If either table is empty, so is the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.llm import terms, texts
from changelens.storage import written

K = 10
#: Postings that a task holds in its lists at once.
SHARD_POSTINGS = 1_500_000
#: Documents that are added to a shard at once.
SHARD_STEP = 100
#: Positions of each list that are read at first; doubled with every further reading.
FIRST_READ = 16
#: Bytes of query text that are searched together.
QUERY_BYTES = 32 << 20
#: Bytes of document text that are cut into terms together.
CHUNK_BYTES = 8 << 20

_POSTED = "doc_id LONG, n LONG, terms ARRAY<INT>, tfs ARRAY<LONG>"
_FOUND = "query LONG, doc_id LONG, score LONG"


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, text, bounds in texts.text_slices(batch.column("text"), CHUNK_BYTES):
            found = terms.terms(text, bounds, terms.WORDS_AND_DIGITS)
            of, term, _ = found.counts()
            cut = np.searchsorted(of, np.arange(end - row + 1)).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(cut), found.distinct.take(pa.array(term)))
            yield pa.RecordBatch.from_arrays([batch.column("query").slice(row, end - row), listed], names=["query", "terms"])


def _posted(vocabulary: pa.Array):
    """Of every document its number of terms, and those of the vocabulary with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, text, bounds in texts.text_slices(batch.column("text"), CHUNK_BYTES):
                found = terms.terms(text, bounds, terms.WORDS_AND_DIGITS)
                number = pc.index_in(found.distinct, value_set=vocabulary).fill_null(-1).to_numpy()
                wanted = np.flatnonzero(number[found.of] >= 0)
                width = max(1, len(vocabulary))
                keys, tf = np.unique(found.rows[wanted] * width + number[found.of[wanted]], return_counts=True)
                cut = pa.array(np.searchsorted(keys // width, np.arange(end - row + 1)).astype(np.int32))
                lists = [pa.array((keys % width).astype(np.int32)), pa.array(tf.astype(np.int64))]
                ids = batch.column("doc_id").slice(row, end - row)
                columns = [ids, pa.array(np.diff(found.at)), *(pa.ListArray.from_arrays(cut, x) for x in lists)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "terms", "tfs"])

    return run


@dataclass
class Shard:
    """Impact lists of some documents: documents of each term by descending impact; and each document's postings."""

    term: np.ndarray
    impact: np.ndarray
    at: np.ndarray
    n_terms: int
    #: Document and impact at each position of all lists, one list after the other; ``lists`` cuts them.
    listed_doc: np.ndarray = field(init=False)
    listed_impact: np.ndarray = field(init=False)
    lists: np.ndarray = field(init=False)
    #: Position of each posting in the list of its term.
    position: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        doc = np.repeat(np.arange(len(self.at) - 1, dtype=np.int32), np.diff(self.at))
        order = np.lexsort((-self.impact, self.term))
        self.listed_doc, self.listed_impact = doc[order], self.impact[order]
        self.lists = np.searchsorted(self.term[order], np.arange(self.n_terms + 1))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.position = place - self.lists[self.term]

    def best(self, query: np.ndarray, ids: np.ndarray, floor: int, k: int, local: np.ndarray, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) among which are the ``k`` best for the terms ``query``, of scores not below ``floor``, and the number
        of documents looked up. ``local`` is a spare array of -1 for each term."""
        lengths = self.lists[query + 1] - self.lists[query]
        query, lengths = query[lengths > 0], lengths[lengths > 0]
        m = len(query)
        if not m:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        local[query] = np.arange(m)
        start = self.lists[query]
        seen_at = np.concatenate([[0], np.cumsum(lengths)])
        seen = np.zeros(int(seen_at[-1]), bool)
        known = np.zeros(len(self.at) - 1, bool)
        best_position = np.zeros(m, np.int64)  # so many positions from the top are seen without a gap
        docs, scores, looked_up = [], [], 0
        read, upto = 0, first_read
        while True:
            few = np.minimum(lengths, upto) - np.minimum(lengths, read)
            new = self.listed_doc[texts.ragged(start + np.minimum(lengths, read), few)]
            new = np.unique(new[~known[new]])
            if len(new):
                known[new] = True
                looked_up += len(new)
                size = self.at[new + 1] - self.at[new]
                own = texts.ragged(self.at[new], size)  # the documents' postings: direct access to all lists
                of = local[self.term[own]]
                inside = of >= 0
                own, of = own[inside], of[inside]
                seen[seen_at[of] + self.position[own]] = True
                sums = np.zeros(len(own) + 1, np.int64)
                np.cumsum(self.impact[own], out=sums[1:])
                ends = np.concatenate([[0], np.cumsum(texts.sums_of_rows(inside, np.concatenate([[0], np.cumsum(size)])))])
                docs.append(new)
                scores.append(sums[ends[1:]] - sums[ends[:-1]])
                if len(docs) > 1:
                    docs, scores = _top(docs, scores, ids, k)
            for i in range(m):
                gap = seen[seen_at[i] + best_position[i] : seen_at[i + 1]]
                if len(gap):
                    first = int(gap.argmin())
                    best_position[i] += len(gap) if gap[first] else first
            open_ = best_position < lengths
            limit = int(self.listed_impact[start + np.maximum(best_position, 1) - 1][open_].sum())
            if not open_.any():
                break
            found = scores[0] if scores else np.empty(0, np.int64)
            kth = max(floor, int(np.partition(found, -k)[-k])) if len(found) >= k else floor
            if limit < kth:
                break
            read, upto = upto, 2 * upto
        local[query] = -1
        return np.concatenate(docs), np.concatenate(scores), looked_up


def _top(docs: list[np.ndarray], scores: list[np.ndarray], ids: np.ndarray, k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    doc, score = np.concatenate(docs), np.concatenate(scores)
    order = np.lexsort((ids[doc], -score))[:k]
    return [doc[order]], [score[order]]


_LAST = np.iinfo(np.int64).max


def _searched(queries: list[tuple[int, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int, shard_postings: int, first_read: int):
    """The ``k`` best documents of a task for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.int64)
        best = {number: (none, none) for number, _ in queries}
        local = np.full(len(weights), -1, np.int64)
        for ids, n, term, tf, at in _shards(batches, shard_postings):
            m = 10 + (90 * n * n_docs) // n_terms
            impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, np.diff(at))))
            shard = Shard(term, impact, at, len(weights))
            for number, query in queries:
                old_ids, old_scores = best[number]
                floor = int(old_scores[-1]) if len(old_scores) == k else 1
                docs, scores, _ = shard.best(query, ids, floor, k, local, first_read)
                some = scores >= floor
                all_ids, all_scores = np.concatenate([old_ids, ids[docs[some]]]), np.concatenate([old_scores, scores[some]])
                order = np.lexsort((all_ids, -all_scores))[:k]
                best[number] = all_ids[order], all_scores[order]
        number = np.repeat([q for q, _ in queries], [len(best[q][0]) for q, _ in queries])
        ids, scores = (np.concatenate([best[q][i] for q, _ in queries]) if queries else none for i in (0, 1))
        doc_id = pa.array(ids, pa.int64(), mask=ids == _LAST)
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int64)), doc_id, pa.array(scores)], names=["query", "doc_id", "score"])

    return run


def _shards(batches: Iterator[pa.RecordBatch], shard_postings: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(ids, numbers of terms, terms, occurrences, bounds) of successive documents with about ``shard_postings`` postings."""
    held, postings = [], 0

    def joined() -> tuple[np.ndarray, ...]:
        table = pa.Table.from_batches(held).combine_chunks()
        lists = table.column("terms").chunk(0)
        at = lists.offsets.to_numpy().astype(np.int64)
        tf = table.column("tfs").chunk(0).flatten().to_numpy()
        ids = table.column("doc_id").fill_null(_LAST).to_numpy()
        return ids, table.column("n").to_numpy(), lists.flatten().to_numpy().astype(np.int64), tf, at - at[0]

    for batch in batches:
        for row in range(0, batch.num_rows, SHARD_STEP):
            piece = batch.slice(row, SHARD_STEP)
            held.append(piece)
            postings += int(pc.sum(pc.list_value_length(piece.column("terms"))).as_py() or 0)
            if postings >= shard_postings:
                yield joined()
                held, postings = [], 0
    if held:
        yield joined()


def _block(docs: DataFrame, queries: list[tuple[int, list[str]]], k: int) -> DataFrame:
    """The ``k`` best documents of each task for some queries (number, terms)."""
    words = sorted({t for _, listed in queries for t in listed})
    vocabulary = pa.array(words, pa.string())
    number = {t: i for i, t in enumerate(words)}
    numbered = [(q, np.sort(np.array([number[t] for t in listed], np.int64))) for q, listed in queries if listed]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posted = written(source.mapInArrow(_posted(vocabulary), _POSTED).filter("n > 0"), "postings")
    n_docs, n_terms = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(len(words), np.int64)  # a row for each word of the block at most
    for term, df in held.collect():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    with_terms = posted.filter(F.size("terms") > 0)
    return with_terms.mapInArrow(_searched(numbered, weights, n_docs, n_terms, k, SHARD_POSTINGS, FIRST_READ), _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id`` and ``score`` of the ``k`` best documents for each row of ``items``."""
    queries = written(items.select("item_id", F.col("text").cast("string").alias("text")).withColumn("query", F.monotonically_increasing_id()), "queries")
    size = queries.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-size // QUERY_BYTES))
    listed = queries.select("query", "text").mapInArrow(_query_terms, "query LONG, terms ARRAY<STRING>")
    listed = written(listed.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n_blocks))), "query-terms")
    found = None
    for block in range(n_blocks):
        rows = [(r["query"], r["terms"]) for r in listed.filter(F.col("block") == block).orderBy("query").collect()]
        best = written(_block(docs, rows, k), "found")
        found = best if found is None else found.unionByName(best)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
