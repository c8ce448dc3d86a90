"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer turns each word into a symbol: insult, threat, target, negation, report or other. Transducers
for the scope of a negation, for reported speech and for a target are composed into one machine that reads a
clause and emits a pattern for every insult or threat in it: what it is, whether the clause has a target, and whether
it is plain, negated or reported. A clause goes to ``.!?;`` or the line end; a colon does not end it, nor does a mark
right before a closing quote. Speech is reported after a speech verb, and within quotes also before one. A document's score is the logistic of the
weighted numbers of its patterns, so isolated words count only by the pattern they stand in.

The built-in words are a small base. Further insults, whole words or beginnings of words, are learned as terms that
mark toxic texts, and the weights by logistic regression around prior weights, on a bounded sample: up to
``DOCUMENTS`` texts of each label.

Null and empty texts have the score of a text without patterns. Rows are scored one by one, so repeated rows and
equal texts have equal results, texts of any length are read whole, and an empty table gives no rows; other columns are not used. A null id is in no fold: it is not learned from, and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm import samples, texts

DOCUMENTS = 3000
#: A learned term comes in so many toxic texts, so much oftener than in others, with so high a likelihood ratio.
LEAST_TEXTS, LEAST_RATIO, LEAST_G2 = 5, 20.0, 20.0
STEMS = (4, 5, 6, 7)
SCOPE = 3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: Base words of the lexical transducer in four languages.
BASE = {
    INSULT: "idiot moron imbecile stupid dumb pathetic worthless scum trash loser trottel idioten dumm abschaum crétin débile connard imbécile ordure estúpido tonto inútil basura",
    THREAT: "kill hurt destroy burn die murder töten umbringen zerstören tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours he she they him her them du dich dein ihr euch sie tu toi vous ils elles tú usted ustedes ellos ellas",
    NEGATION: "not never no none nicht kein keine niemals pas jamais aucun nunca ningún tampoco",
    REPORT: "said says called calls wrote claims reported quoted sagte nannte schrieb dit écrit appelé dijo escribió llamó",
}
KINDS, MANNERS = (INSULT, THREAT), ("plain", "negated", "reported")
PATTERNS = list(product(KINDS, (False, True), MANNERS))
#: Prior weight of each pattern.
PRIOR = np.array([{"plain": 3.0, "negated": 1.0, "reported": 1.0}[manner] + target - (kind == THREAT) for kind, target, manner in PATTERNS])

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?;\n")] = True
_QUOTE = 0x22


class Machine:
    """Composition of transducers: ``go[state][symbol]`` is (next state, emitted (kind, manner) or None)."""

    def __init__(self) -> None:
        # each: start state, and a step (state, symbol) -> state
        scope = (0, lambda s, x: SCOPE if x == NEGATION else max(0, s - 1))
        report = (False, lambda s, x: s or x == REPORT)
        target = (False, lambda s, x: s or x == TARGET)
        parts = (scope, report, target)
        self.start = tuple(p[0] for p in parts)
        self.go: dict[tuple, list[tuple]] = {}
        waiting = [self.start]
        while waiting:
            state = waiting.pop()
            if state in self.go:
                continue
            row = []
            for symbol in range(6):
                emitted = None
                if symbol in KINDS:
                    emitted = (symbol, "reported" if state[1] else "negated" if state[0] else "plain")
                after = tuple(step(s, symbol) for s, (_, step) in zip(state, parts, strict=True))
                row.append((after, emitted))
                waiting.append(after)
            self.go[state] = row

    def read(self, symbols: list[int], quoted: list[bool]) -> Iterator[int]:
        """Numbers in :data:`PATTERNS` of what a clause holds; ``quoted`` are its words within quotes."""
        state, emitted = self.start, []
        for symbol, within in zip(symbols, quoted, strict=True):
            state, out = self.go[state][symbol]
            if out:
                emitted.append((*out, within))
        for kind, manner, within in emitted:
            yield PATTERNS.index((kind, state[2], "reported" if within and state[1] else manner))


def _terms(hashed: texts.Substrings, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length or 0 for whole words, words that have such a term, its hashes)."""
    yield 0, np.arange(len(starts)), hashed(starts, ends - starts)
    for length in STEMS:
        long = np.flatnonzero(ends - starts >= length)
        yield length, long, texts.mixed(hashed(starts[long], np.full(len(long), length)) ^ texts.U64(length))


def _plain_quotes(lower: np.ndarray) -> None:
    """Turn curly, low and angle quotes into ``"`` and blanks, in place: their bytes are no part of words."""
    curly = np.flatnonzero((lower[:-2] == 0xE2) & (lower[1:-1] == 0x80) & (lower[2:] >= 0x9C) & (lower[2:] <= 0x9F))
    angle = np.flatnonzero((lower[:-1] == 0xC2) & ((lower[1:] == 0xAB) | (lower[1:] == 0xBB)))
    for at, size in ((curly, 3), (angle, 2)):
        lower[at] = _QUOTE
        for k in range(1, size):
            lower[at + k] = 0x20


def _words(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lower = texts.LOWER[text]
    _plain_quotes(lower)
    return lower, *texts.runs(_LETTER[lower], bounds)


def _hashes(words: str) -> np.ndarray:
    text, bounds = texts.utf8(pa.array(words.split(), pa.string()))
    return texts.span_hashes(text, bounds[:-1], bounds[1:])


@dataclass
class Grammar:
    learned: dict[int, np.ndarray] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    bias: float = -3.0

    def __post_init__(self) -> None:
        self.machine = Machine()
        self.base = {symbol: np.sort(_hashes(words)) for symbol, words in BASE.items()}

    def symbols(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.int8)
        first = 0
        while first < len(starts):  # some megabytes at once
            low = int(starts[first])
            last = max(first + 1, int(np.searchsorted(ends, low + texts.HASH_BYTES // 2, "right")))
            part = out[first:last]
            for length, some, keys in _terms(texts.Substrings(lower[low : int(ends[last - 1])]), starts[first:last] - low, ends[first:last] - low):
                if len(known := self.learned.get(length, ())):
                    part[some[_in(keys, known)]] = INSULT
                if length == 0:
                    for symbol, known in self.base.items():
                        part[_in(keys, known)] = symbol
            first = last
        return out

    def patterns(self, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, patterns) numbers of patterns."""
        lower, starts, ends = _words(text, bounds)
        found = np.zeros((len(bounds) - 1, len(PATTERNS)))
        symbols = self.symbols(lower, starts, ends)
        quote = lower == _QUOTE
        ends_clause = _BREAK[lower]
        ends_clause[:-1] &= ~quote[1:] | (lower[:-1] == 0x0A)
        marks = np.cumsum(ends_clause)
        quotes = np.concatenate([[0], np.cumsum(quote)])
        begins = np.union1d(np.flatnonzero(ends_clause), bounds[:-1])  # of clauses, their mark before them
        row = np.searchsorted(bounds, starts, "right") - 1
        clause = marks[starts] + row if len(starts) else starts  # ascends at every break and row
        edges = np.flatnonzero(np.concatenate([[True], clause[1:] != clause[:-1], [True]])) if len(clause) else np.zeros(1, np.int64)
        for k in np.unique(np.searchsorted(edges, np.flatnonzero((symbols == INSULT) | (symbols == THREAT)), "right") - 1).tolist():
            a, b = edges[k], edges[k + 1]
            begin = begins[np.searchsorted(begins, starts[a], "right") - 1]
            quoted = (quotes[starts[a:b]] - quotes[begin]) % 2 == 1
            for pattern in self.machine.read(symbols[a:b].tolist(), quoted.tolist()):
                found[row[a], pattern] += 1
        return found

    def scores(self, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return _logistic(np.log1p(self.patterns(text, bounds)) @ self.weights + self.bias)


def _in(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def learned_terms(toxic: np.ndarray, text: np.ndarray, bounds: np.ndarray) -> dict[int, np.ndarray]:
    """Terms that mark toxic texts, by length."""
    lower, starts, ends = _words(text, bounds)
    row = np.searchsorted(bounds, starts, "right") - 1
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    out: dict[int, list] = {}
    pieces: dict[int, list] = {}
    first = 0
    while first < len(starts):
        low = int(starts[first])
        last = max(first + 1, int(np.searchsorted(ends, low + texts.HASH_BYTES // 2, "right")))
        for length, some, keys in _terms(texts.Substrings(lower[low : int(ends[last - 1])]), starts[first:last] - low, ends[first:last] - low):
            pieces.setdefault(length, []).append((keys, row[first:last][some]))
        first = last
    for length, parts in pieces.items():
        keys, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((rows, keys))
        keys, rows = keys[order], rows[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        terms, which = np.unique(keys[once], return_inverse=True)
        a = np.bincount(which, toxic[rows[once]], minlength=len(terms))
        b = np.bincount(which, minlength=len(terms)) - a
        total = a + b
        expected = total * n1 / max(1, n1 + n0)
        with np.errstate(divide="ignore", invalid="ignore"):
            g2 = 2 * (a * np.log(a / expected) + np.where(b > 0, b * np.log(b / (total - expected)), 0))
        marks = (a >= LEAST_TEXTS) & (a / max(1, n1) >= LEAST_RATIO * (b + 0.5) / max(1, n0 + 1)) & (g2 >= LEAST_G2)
        out[length] = terms[marks]
    return out


def learn(labelled: list[tuple[int, str]], share: float) -> Grammar:
    """Fit terms and weights; ``share`` is the part of toxic texts among all labelled ones."""
    toxic = np.array([bool(label) for label, _ in labelled])
    if not toxic.any() or toxic.all():
        return Grammar()
    text, bounds = texts.utf8(pa.array([t for _, t in labelled], pa.string()))
    grammar = Grammar(learned_terms(toxic, text, bounds))
    x = np.log1p(grammar.patterns(text, bounds))
    w, bias = grammar.weights.copy(), grammar.bias
    for _ in range(3000):  # gradient steps with a pull to the prior
        error = _logistic(x @ w + bias) - toxic
        w -= 1.0 * (x.T @ error / len(x) + 0.0002 * (w - PRIOR))
        bias -= 1.0 * error.mean()
    drawn = toxic.mean()
    shift = np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)) if 0 < share < 1 else 0.0
    grammar.weights, grammar.bias = w, float(min(bias + shift, -0.01))
    return grammar


def _scored(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, text, bounds in texts.text_slices(batch.column("text")):
                own = batch.slice(row, end - row)
                score = model.value.scores(text, bounds)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    return run


def score(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document; the held-out fold is not learned from."""
    known = labels.filter(samples.fold(F.col("doc_id"), folds) != held_out_fold).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic").cast("int") != 0).cast("int").alias("label"))
    known = known.filter("label IS NOT NULL")
    share = known.agg(F.avg("label")).first()[0]
    grammar = learn(samples.labelled(docs, known, DOCUMENTS), share or 0.0)
    fold = samples.fold(F.col("doc_id"), folds)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(grammar)  # terms are bounded by the sample
    return source.mapInArrow(_scored(model), "doc_id LONG, held_out BOOLEAN, score DOUBLE, predicted INT")
