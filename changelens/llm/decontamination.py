"""Benchmark decontamination with a generalised suffix automaton.

The words of the benchmark items (A-Z lower-cased, runs of digits, a-z and non-ASCII characters) make one
automaton. A document's words are streamed through it, and at each word the automaton gives the longest run
of words that ends there and is part of an item. A *window* is ``WINDOW`` successive words of an item, or a
whole item of fewer words; words inside any occurrence of a window are hit.

Only runs of words whose neighbouring pairs all come in some item are streamed; numpy finds them, and no match
can reach out of one. The items are taken in blocks of ``BLOCK_WORDS`` words, so an automaton has a fixed
bound whatever the size of the benchmark; further blocks stream the documents again. Coverage and length of a span
are judged on the hits of all blocks together.

Null and empty texts have no words. An item without words matches nothing; an item with a null id is hit and
removed but not listed. Rows are judged one by one, and other columns are passed on whatever their names. An
empty benchmark hits nothing.
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
from changelens.storage import written, written_counting

WINDOW = 10
#: Words of the items in one automaton; an item that is longer is cut into parts that overlap.
BLOCK_WORDS = 100_000
#: A hit span is removed if it has so many words, or any number if so large a share of the document is hit.
SPAN_WORDS = 10
MAX_COVERAGE = 0.2

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

HITS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "end", "start_byte", "end_byte")]))
_SPAN = pa.struct([(n, pa.int64()) for n in ("first", "end", "start_byte", "end_byte")])


def word_spans(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes, bounds of the rows in them) of the words."""
    lower = texts.LOWER[text]
    starts, ends = texts.runs(_WORD[lower], bounds)
    return starts, ends, texts.span_hashes(lower, starts, ends), texts.of_rows(starts, bounds)


class Automaton:
    """Suffix automaton of all items: ``go[state * words + word]``, ``link`` and ``length`` by state."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int) -> None:
        self.window = window
        self.vocabulary = np.unique(np.concatenate([w for _, w in items]))
        self.words = len(self.vocabulary)
        pairs = [w[:-1] * texts.U64(31) + w[1:] for _, w in items]
        self.pairs = np.unique(texts.mixed(np.concatenate(pairs)))
        self.least = min(window, *(len(w) for _, w in items))
        numbered = [(i, np.searchsorted(self.vocabulary, w).tolist()) for i, w in items]
        self.go: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        out: list[list[int]] = [[]]
        for _, words in numbered:
            last = 0
            for word in words:
                last = self._extended(last, word, out)
        del out
        self.items_at: dict[tuple[int, int], set] = {}
        for item, words in numbered:
            size = min(window, len(words))
            state = matched = 0
            for word in words:
                state, matched = self.step(state, matched, word)
                if matched >= size:
                    self.items_at.setdefault((self.shortened(state, size), size), set()).add(item)
        self.sizes: dict[int, list[int]] = {}
        for state, size in self.items_at:
            self.sizes.setdefault(state, []).append(size)

    def _extended(self, last: int, word: int, out: list[list[int]]) -> int:
        """The state of the run so far with ``word`` after it, made if it is new; ``out`` lists the words after a state."""
        n, go, link, length = self.words, self.go, self.link, self.length
        if (known := go.get(last * n + word)) is not None:
            return known if length[known] == length[last] + 1 else self._split(last, known, word, out)
        new = len(link)
        length.append(length[last] + 1)
        link.append(0)
        out.append([])
        at = last
        while at != -1 and at * n + word not in go:
            go[at * n + word] = new
            out[at].append(word)
            at = link[at]
        if at != -1:
            known = go[at * n + word]
            link[new] = known if length[known] == length[at] + 1 else self._split(at, known, word, out)
        return new

    def _split(self, at: int, known: int, word: int, out: list[list[int]]) -> int:
        """A state for the shorter runs of ``known``, those that come by ``word`` from ``at`` and its suffixes."""
        n, go, link, length = self.words, self.go, self.link, self.length
        part = len(link)
        length.append(length[at] + 1)
        link.append(link[known])
        out.append(list(out[known]))
        for w in out[known]:
            go[part * n + w] = go[known * n + w]
        while at != -1 and go.get(at * n + word) == known:
            go[at * n + word] = part
            at = link[at]
        link[known] = part
        return part

    def step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        n, go = self.words, self.go
        to = go.get(state * n + word)
        while to is None and state:
            state = self.link[state]
            matched = self.length[state]
            to = go.get(state * n + word)
        return (0, 0) if to is None else (to, matched + 1)

    def shortened(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a match."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def occurrences(self, words: list[int]) -> Iterator[tuple[int, int, set]]:
        """(first, end, items) of every window in a run of numbered words."""
        state = matched = 0
        for end, word in enumerate(words, 1):
            state, matched = self.step(state, matched, word)
            at, longest = state, matched
            while at > 0:  # this state and its suffixes hold all runs that end here
                for size in self.sizes.get(at, ()):
                    if size <= longest:
                        yield end - size, end, self.items_at[at, size]
                at = self.link[at]
                longest = self.length[at]

    def streamed(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """Occurrences in all rows between ``at``, as places in ``hashes``, in order of their ends."""
        if not len(hashes):
            return
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), self.words - 1)
        known = self.vocabulary[place] == hashes
        joined = np.zeros(len(hashes), bool)  # to the word before
        both = np.flatnonzero(known[1:] & known[:-1])
        keys = texts.mixed(hashes[both] * texts.U64(31) + hashes[both + 1])
        if len(self.pairs):
            joined[both + 1] = self.pairs[np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)] == keys
        joined[at[:-1][at[:-1] < len(hashes)]] = False
        firsts = np.flatnonzero(known & ~joined)
        # a run goes on while words are joined
        stop = np.flatnonzero(~joined)
        after = np.searchsorted(stop, firsts, "right")
        ends = np.where(after < len(stop), stop[np.minimum(after, len(stop) - 1)], len(hashes))
        enough = ends - firsts >= self.least
        for first, end in zip(firsts[enough].tolist(), ends[enough].tolist(), strict=True):
            for a, b, items in self.occurrences(place[first:end].tolist()):
                yield first + a, first + b, items


def blocks(benchmark: DataFrame) -> Iterator[Automaton]:
    """Automata of bounded size that hold all items; the driver has one block of items at a time."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator(prefetchPartitions=True)
    some: list[tuple[int | None, np.ndarray]] = []
    n = 0
    for item, text in rows:
        data, bounds = texts.utf8(pa.array([text], pa.string()))
        words = word_spans(data, bounds)[2]
        step = BLOCK_WORDS - WINDOW + 1
        for at in range(0, max(1, len(words) - WINDOW + 1), step):
            part = words[at : at + BLOCK_WORDS]
            if not len(part):
                continue
            if n + len(part) > BLOCK_WORDS and some:
                yield Automaton(some, WINDOW)
                some, n = [], 0
            some.append((item, part))
            n += len(part)
    if some:
        yield Automaton(some, WINDOW)


def _merged_hits(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of hit words of each row, as places in the row."""
    a, b = texts.runs(mask, at[:-1][at[:-1] < len(mask)])
    row = np.searchsorted(at, a, "right") - 1
    fields = [a - at[row], b - at[row], starts[a] - bounds[row], ends[b - 1] - bounds[row]] if len(a) else [np.empty(0, np.int64)] * 4
    spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(at))).astype(np.int32)), spans)


def _scanned(automaton: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, text, bounds in texts.text_slices(batch.column("text")):
                own = batch.slice(row, end - row)
                starts, ends, hashes, at = word_spans(text, bounds)
                mask = np.zeros(len(hashes), bool)
                items: list[set] = [set(x or ()) for x in own.column("items").to_pylist()]
                for r, hits in enumerate(own.column("hits").to_pylist()):  # of the blocks before
                    for span in hits or ():
                        mask[at[r] + span["first"] : at[r] + span["end"]] = True
                for a, b, found in automaton.value.streamed(hashes, at):
                    mask[a:b] = True
                    items[int(np.searchsorted(at, a, "right")) - 1] |= found
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("doc"),
                        own.column("text"),
                        pa.array(np.diff(at)),
                        _merged_hits(mask, starts, ends, at, bounds),
                        pa.array([sorted(x - {None}) for x in items], pa.list_(pa.int64())),
                    ],
                    names=["doc", "text", "n_words", "hits", "items"],
                )

    return run


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Each row of ``docs`` as the struct ``doc``, with ``text``, ``n_words``, ``hits`` (spans of hit words) and ``items``."""
    spark = docs.sparkSession
    found = docs.select(
        F.struct(*docs.columns).alias("doc"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast(HITS).alias("hits"),
        F.lit(None).cast("array<long>").alias("items"),
    )
    schema, first = found.schema, True
    empty = Automaton([(None, np.zeros(1, texts.U64))], WINDOW)
    for automaton in blocks(benchmark) if benchmark is not None else ():
        found = found if first else written(found, "hits")
        found, first = found.mapInArrow(texts.then_give_back(_scanned(spark.sparkContext.broadcast(automaton))), schema), False
    return found.mapInArrow(_scanned(spark.sparkContext.broadcast(empty)), schema) if first else found


def digests(found: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        F.col("doc.doc_id").cast("long").alias("doc_id"),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def _without(text: bytes, n_words: int, spans: np.ndarray) -> bytes:
    """The text without those hit spans, rows of :data:`HITS`, that are to be removed."""
    size = spans[:, 1] - spans[:, 0]
    if size.sum() <= MAX_COVERAGE * n_words:
        spans = spans[size >= SPAN_WORDS]
    if not len(spans):
        return text
    edges = np.concatenate([[0], spans[:, 2:].ravel(), [len(text)]])
    return b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))


def _cut(text: bytes, automaton: Automaton) -> bytes:
    """The text without its hit spans; cutting goes on until what is left together has none."""
    while True:
        data = np.frombuffer(text, np.uint8)
        starts, ends, hashes, at = word_spans(data, np.array([0, len(data)]))
        mask = np.zeros(len(hashes), bool)
        for a, b, _ in automaton.streamed(hashes, at):
            mask[a:b] = True
        a, b = texts.runs(mask, np.zeros(1, np.int64))
        left = _without(text, len(hashes), np.stack([a, b, starts[a], ends[b - 1]], axis=1)) if len(a) else text
        if len(left) == len(text):
            return text
        text = left


def _cut_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc``, new ``text``, and whether it has ``changed``, of rows of :func:`matches`."""
    for batch in batches:
        new, changed = [], []
        for r, (n_words, hits) in enumerate(zip(batch.column("n_words").to_pylist(), batch.column("hits").to_pylist(), strict=True)):
            if not hits:
                new.append(None)
                changed.append(False)
                continue
            old = batch.column("text")[r].as_py().encode()
            left = _without(old, n_words, np.array([list(h.values()) for h in hits], np.int64))
            changed.append(len(left) < len(old))
            new.append(left.decode() if changed[-1] else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(new, pa.string()), pa.array(changed)], names=["doc", "text", "changed"])


def _clean_by_rounds(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As :func:`clean`, for any number of blocks: hits of all of them are judged together, once a round.

    A round cuts each document once; those that were cut go through the next one, until none is.
    """
    columns, settled = docs.columns, None
    while True:
        found = matches(docs, benchmark)
        schema = T.StructType([found.schema["doc"], T.StructField("text", T.StringType()), T.StructField("changed", T.BooleanType())])
        doc = F.col("doc").withField("text", F.when(F.col("changed"), F.col("text").cast(docs.schema["text"].dataType)).otherwise(F.col("doc.text")))
        if "n_chars" in columns:
            kind = docs.schema["n_chars"].dataType
            doc = doc.withField("n_chars", F.when(F.col("changed"), F.length("text").cast(kind)).otherwise(F.col("doc.n_chars")))
        cut, n = written_counting(found.mapInArrow(texts.then_give_back(_cut_once), schema).select(doc.alias("doc"), "changed"), "cut", changed=F.col("changed"))
        same = cut.filter("NOT changed").select("doc.*")
        settled = same if settled is None else settled.unionByName(same)
        if not n["changed"]:
            return settled
        docs = cut.filter("changed").select("doc.*").filter(F.col("text").rlike("[0-9A-Za-z]|[^\\x00-\\x7F]"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the spans; a document that loses all its words goes. ``n_chars`` follows the text."""
    spark, schema = docs.sparkSession, docs.schema
    at_text = docs.columns.index("text")
    at_chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def cleaned(automaton: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, end, text, bounds in texts.text_slices(batch.column("text")):
                    own = batch.slice(row, end - row)
                    _, _, hashes, at = word_spans(text, bounds)
                    hit = {int(np.searchsorted(at, a, "right")) - 1 for a, _, _ in automaton.value.streamed(hashes, at)}
                    if not hit:
                        yield own
                        continue
                    new = own.column("text").to_pylist()
                    keep = np.ones(len(new), bool)
                    chars = own.column(at_chars).to_pylist() if at_chars is not None else None
                    for r in hit:
                        cut = _cut(text[bounds[r] : bounds[r + 1]].tobytes(), automaton.value)
                        data = np.frombuffer(cut, np.uint8)
                        keep[r] = bool(_WORD[texts.LOWER[data]].any())
                        if len(cut) < bounds[r + 1] - bounds[r]:
                            new[r] = cut.decode()
                            if chars is not None:
                                chars[r] = len(new[r])
                    columns = own.columns
                    columns[at_text] = pa.array(new, own.column("text").type)
                    if chars is not None:
                        columns[at_chars] = pa.array(chars, own.column(at_chars).type)
                    yield pa.RecordBatch.from_arrays(columns, names=own.schema.names).filter(pa.array(keep))

        return run

    some = blocks(benchmark)
    only = next(some, None)
    if only is None:
        return docs
    if next(some, None) is not None:
        some.close()
        return _clean_by_rounds(docs, benchmark)
    return docs.mapInArrow(texts.then_give_back(cleaned(spark.sparkContext.broadcast(only))), schema)
