"""Quality grades by ordinal cumulative-link regression on hashed text.

``P(grade > k) = logistic(w . x - threshold[k])`` with one weight vector for all grades and ordered thresholds.
``x`` is the mean over a text's words of hashed features: the word, the shapes of its beginning and end (capital,
small, digit, or the mark itself), the shapes of two neighbouring ends, and whether a word repeats the one before.
Weights and thresholds are fitted on a bounded sample of ``SAMPLE`` texts, up to ``DOCUMENTS`` of each grade and one at
least; a text counts as its grade's share among all ratings over that in the sample, so probabilities are those of the
rated corpus. Every grade that is rated is learned.

Null and empty texts have no features, and the grade that the thresholds alone give. Rows are graded one by one, so
repeated rows have equal results, ties (equal texts with different ratings) give each rating its part, texts of any
length are graded whole, and an empty table gives no rows; other columns are not used. Without labels every text has grade 0. A null id is in
no fold: it is not learned from, and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.llm import samples, texts

DIMENSIONS = 1 << 14
DOCUMENTS, SAMPLE = 2000, 6000
STEPS, RATE, PULL = 150, 0.5, 1e-5
#: A text is selected if its grade is this or higher with at least this probability.
SELECTED_GRADE, SELECTED_TAIL = 1, 0.5

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58], _SHAPE[128:] = 65, 97, 48, 97


def features(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of all words, five each, ``len(bounds)`` bounds of the texts in words)."""
    starts, ends = texts.runs(~texts.SPACE[text], bounds)
    at = texts.of_rows(starts, bounds)
    words = texts.span_hashes(text, starts, ends)
    shape = _SHAPE[text]
    tail, head = np.zeros(len(starts), texts.U64), np.zeros(len(starts), texts.U64)
    size = ends - starts
    for back in range(1, 5):
        own = np.where(size >= back, shape[np.maximum(ends - back, 0)] if len(shape) else 0, 0)
        tail = tail * texts.U64(257) + own.astype(texts.U64)
    for ahead in range(2):
        own = np.where(size > ahead, shape[np.minimum(starts + ahead, max(0, len(shape) - 1))] if len(shape) else 0, 0)
        head = head * texts.U64(257) + own.astype(texts.U64)
    inner = np.ones(len(starts), bool)
    inner[at[:-1][at[:-1] < len(starts)]] = False
    before = np.concatenate([tail[:1], tail[:-1]])
    again = np.zeros(len(starts), texts.U64)
    again[1:] = (words[1:] == words[:-1]) & inner[1:]
    kinds = [words, tail, head, np.where(inner, tail * texts.U64(1_000_003) + before, 0), again]
    salted = [texts.mixed(k ^ texts.U64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1)) for i, k in enumerate(kinds)]
    return np.stack([(k & texts.U64(DIMENSIONS - 1)).astype(np.int32) for k in salted], axis=1), at


@dataclass
class Grader:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """(texts, thresholds) probabilities that the grade is above each of the lower ones."""
        found, at = features(text, bounds)
        sums = np.zeros(len(found) + 1)
        np.cumsum(self.weights[found].sum(axis=1), out=sums[1:])
        mean = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)
        return _logistic(mean[:, None] - self.thresholds)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(labelled: list[tuple[int, str]], shares: dict[int, float] | None = None) -> Grader:
    """Maximum likelihood by Adam; thresholds are a first one and positive steps.

    ``shares`` of the grades in the corpus weigh the texts of the sample; without them all count alike.
    """
    grades = np.unique([g for g, _ in labelled]).astype(np.int64) if labelled else np.zeros(1, np.int64)
    grader = Grader(grades, np.zeros(DIMENSIONS), np.zeros(len(grades) - 1))
    if len(grades) < 2:
        return grader
    of = np.searchsorted(grades, [g for g, _ in labelled])
    text, bounds = texts.utf8(pa.array([t for _, t in labelled], pa.string()))
    found, at = features(text, bounds)
    n = np.maximum(np.diff(at), 1)
    keys, counts = np.unique(np.repeat(np.arange(len(of)), np.diff(at) * 5) * DIMENSIONS + found.ravel(), return_counts=True)
    row, column = keys // DIMENSIONS, keys % DIMENSIONS
    value = counts / n[row]
    free = np.concatenate([np.zeros(DIMENSIONS), [0.0], np.zeros(len(grades) - 2)])  # weights, first threshold, log steps
    mean, square = np.zeros_like(free), np.zeros_like(free)
    drawn = np.bincount(of) / len(of)
    true = drawn if shares is None else np.array([shares[g] for g in grades.tolist()])
    weight = (true / true.sum() / drawn)[of] / len(of)
    for step in range(1, STEPS + 1):
        w, cuts = free[:DIMENSIONS], np.cumsum(np.concatenate([free[DIMENSIONS : DIMENSIONS + 1], np.exp(free[DIMENSIONS + 1 :])]))
        above = _logistic(np.bincount(row, value * w[column], minlength=len(of))[:, None] - cuts)
        edges = np.concatenate([np.ones((len(of), 1)), above, np.zeros((len(of), 1))], axis=1)
        k = np.arange(len(of))
        pull = weight / np.maximum(edges[k, of] - edges[k, of + 1], 1e-9)
        slope = edges * (1 - edges)
        d_score = -(slope[k, of] - slope[k, of + 1]) * pull
        d_cut = np.zeros((len(of), len(cuts) + 2))
        d_cut[k, of] += slope[k, of] * pull
        d_cut[k, of + 1] -= slope[k, of + 1] * pull
        d_cut = d_cut[:, 1:-1].sum(axis=0)
        later = np.cumsum(d_cut[::-1])[::-1]
        gradient = np.concatenate([np.bincount(column, value * d_score[row], minlength=DIMENSIONS) + PULL * w, later[:1], later[1:] * np.exp(free[DIMENSIONS + 1 :])])
        mean += 0.1 * (gradient - mean)
        square += 0.01 * (gradient**2 - square)
        free -= RATE * (1 - step / (STEPS + 1)) * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    grader.weights = free[:DIMENSIONS]
    grader.thresholds = np.cumsum(np.concatenate([free[DIMENSIONS : DIMENSIONS + 1], np.exp(free[DIMENSIONS + 1 :])]))
    return grader


def _graded(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grader = model.value
        chosen = int(np.searchsorted(grader.grades, SELECTED_GRADE))
        for batch in batches:
            for row, end, text, bounds in texts.text_slices(batch.column("text")):
                own = batch.slice(row, end - row)
                tails = grader.tails(text, bounds)
                expected = grader.grades[0] + tails @ np.diff(grader.grades).astype(float)
                edge = np.concatenate([np.ones((len(tails), 1)), tails, np.zeros((len(tails), 1))], axis=1)
                tail = edge[:, min(chosen, len(grader.grades))]
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("held_out"), pa.array(expected), pa.array(tail), pa.array(tail >= SELECTED_TAIL)],
                    names=["doc_id", "held_out", "expected_grade", "tail_probability", "selected"],
                )

    return run


def grade(docs: DataFrame, ratings: DataFrame, rating: Column, folds: int = 5, held_out_fold: int = 0) -> DataFrame:
    """Expected grade, tail probability and selection of every document, from whole-number ``rating`` of ``ratings``."""
    known = ratings.filter(samples.fold(F.col("doc_id"), folds) != held_out_fold).select(F.col("doc_id").cast("long").alias("doc_id"), rating.cast("int").alias("label"))
    grader = fit(samples.labelled(docs, known, DOCUMENTS, SAMPLE), samples.shares(known))
    fold = samples.fold(F.col("doc_id"), folds)
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(grader)  # 128 KB
    return source.mapInArrow(_graded(model), "doc_id LONG, held_out BOOLEAN, expected_grade DOUBLE, tail_probability DOUBLE, selected BOOLEAN")
