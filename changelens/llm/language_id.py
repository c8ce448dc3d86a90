"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of ``STEPS`` bytes. Two gated recurrent units read a window, one from each side,
and every byte position gets probabilities of the languages from both states; a document's probabilities are
those of its positions, pooled by the mean of their logarithms. The network is trained in numpy by
backpropagation through time, on a bounded sample: up to ``DOCUMENTS`` texts of every language that has any (fewer
of each where that were more than ``SAMPLE`` in all) and ``WINDOWS`` windows of each text, spread over its length.
Whole texts are predicted.

Null texts and those without a letter are ``und`` with score 0, as is everything if there is nothing to learn
from. Rows are predicted one by one, so repeated rows have equal results; other columns are not used. A null id is
in no fold: it is not learned from, and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm import samples, texts

HIDDEN, STEPS = 8, 64
DOCUMENTS, WINDOWS, SAMPLE = 300, 4, 19_200
EPOCHS, BATCH, RATE = 6, 64, 0.02
#: Windows that are read at once, fewer where there are more than ``FEW`` languages.
AT_ONCE, FEW = 2048, 64


@dataclass
class Network:
    """Parameters: by direction, byte tables for update, reset and candidate, recurrent weights; and the output."""

    languages: list[str]
    byte: np.ndarray  # (2, 256, 3H)
    gates: np.ndarray  # (2, H, 2H)
    candidate: np.ndarray  # (2, H, H)
    out: np.ndarray  # (2H, L)
    bias: np.ndarray  # (L,)

    def parameters(self) -> list[np.ndarray]:
        return [self.byte, self.gates, self.candidate, self.out, self.bias]


def _gate(x: np.ndarray) -> np.ndarray:
    """Hard sigmoid."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def states(net: Network, windows: np.ndarray, trace: list | None = None) -> np.ndarray:
    """(steps, 2, windows, H) states at each byte, forward and backward, of (windows, steps) bytes."""
    n, steps = windows.shape
    hidden = net.candidate.shape[1]
    both = np.stack([windows.T, windows[:, ::-1].T], axis=1)  # (steps, 2, n)
    found = np.empty((steps, 2, n, hidden), np.float32)
    state = np.zeros((2, n, hidden), np.float32)
    for t in range(steps):
        seen = np.stack([net.byte[0][both[t, 0]], net.byte[1][both[t, 1]]])
        z, r = np.split(_gate(seen[..., : 2 * hidden] + state @ net.gates), 2, axis=-1)
        new = np.tanh(seen[..., 2 * hidden :] + (r * state) @ net.candidate)
        if trace is not None:
            trace.append((both[t], state, z, r, new))
        state = state + z * (new - state)
        found[t] = state
    found[:, 1] = found[::-1, 1].copy()
    return found


def log_probabilities(net: Network, found: np.ndarray) -> np.ndarray:
    """(steps, windows, L) of every position."""
    hidden = found.shape[-1]
    score = found[:, 0] @ net.out[:hidden] + found[:, 1] @ net.out[hidden:] + net.bias
    score -= score.max(axis=-1, keepdims=True)
    return score - np.log(np.exp(score).sum(axis=-1, keepdims=True))


def gradients(net: Network, windows: np.ndarray, labels: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over all positions, by backpropagation through time."""
    trace: list = []
    found = states(net, windows, trace)
    n, steps = windows.shape
    hidden = found.shape[-1]
    error = np.exp(log_probabilities(net, found))
    error[:, np.arange(n), labels] -= 1
    error *= (np.arange(steps)[:, None] < lengths)[..., None] / np.float32(lengths.sum())
    flat = np.concatenate([found[:, 0], found[:, 1]], axis=-1).reshape(-1, 2 * hidden)
    d_out, d_bias = flat.T @ error.reshape(len(flat), -1), error.sum(axis=(0, 1))
    own = np.stack([error @ net.out[:hidden].T, (error @ net.out[hidden:].T)[::-1]], axis=1)
    d_byte, d_gates, d_candidate = np.zeros_like(net.byte), np.zeros_like(net.gates), np.zeros_like(net.candidate)
    back = np.zeros_like(own[0])
    turn = lambda a: np.swapaxes(a, -1, -2)
    for t in range(steps - 1, -1, -1):
        seen, state, z, r, new = trace[t]
        d = back + own[t]
        d_new = d * z * (1 - new * new)
        d_kept = d_new @ turn(net.candidate)
        d_gate = np.concatenate([d * (new - state) * ((z > 0) & (z < 1)), d_kept * state * ((r > 0) & (r < 1))], axis=-1) * np.float32(0.25)
        d_candidate += turn(r * state) @ d_new
        d_gates += turn(state) @ d_gate
        for side in range(2):
            np.add.at(d_byte[side], seen[side], np.concatenate([d_gate[side], d_new[side]], axis=-1))
        back = d * (1 - z) + d_kept * r + d_gate @ turn(net.gates)
    return [d_byte, d_gates, d_candidate, d_out, d_bias]


def cut(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows padded with 0, their lengths, their rows) of all texts."""
    size = np.diff(bounds)
    n = -(-size // STEPS)
    row = np.repeat(np.arange(len(n)), n)
    start = texts.ragged(np.zeros(len(n), np.int64), n) * STEPS
    length = np.minimum(STEPS, size[row] - start)
    place = (bounds[row] + start)[:, None] + np.arange(STEPS)
    inside = np.arange(STEPS) < length[:, None]
    return np.where(inside, text[np.minimum(place, max(0, len(text) - 1))] if len(text) else 0, 0).astype(np.uint8), length, row


def train(labelled: list[tuple[str, str]], hidden: int = HIDDEN, epochs: int = EPOCHS) -> Network | None:
    """Fit by Adam on some windows of each text."""
    languages = sorted({lang for lang, _ in labelled})
    if not languages:
        return None
    rng = np.random.default_rng(0)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    net = Network(languages, draw(2, 256, 3 * hidden), draw(2, hidden, 2 * hidden), draw(2, hidden, hidden), draw(2 * hidden, len(languages)), np.zeros(len(languages), np.float32))
    text, bounds = texts.utf8(pa.array([t for _, t in labelled], pa.string()))
    windows, lengths, row = cut(text, bounds)
    number = {lang: k for k, lang in enumerate(languages)}
    label = np.array([number[lang] for lang, _ in labelled])
    n = np.bincount(row, minlength=len(label))
    first = np.cumsum(n) - n
    some = np.unique(np.concatenate([first + (n - 1) * k // max(1, WINDOWS - 1) for k in range(WINDOWS)])[np.tile(n > 0, WINDOWS)])
    mean = [np.zeros_like(p) for p in net.parameters()]
    square = [np.zeros_like(p) for p in net.parameters()]
    step, steps = 0, epochs * -(-len(some) // BATCH)
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(some), -(-len(some) // BATCH)):
            step += 1
            rate = RATE * (1 - step / (steps + 1))
            for p, g, m, s in zip(net.parameters(), gradients(net, windows[pick], label[row[pick]], lengths[pick]), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def pooled(net: Network, text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, L) probabilities of whole texts."""
    windows, lengths, row = cut(text, bounds)
    total = np.zeros((len(bounds) - 1, len(net.languages)))
    step = max(1, AT_ONCE * FEW // max(FEW, len(net.languages)))
    for at in range(0, len(row), step):
        some = slice(at, at + step)
        logs = log_probabilities(net, states(net, windows[some]))
        logs *= (np.arange(STEPS)[:, None] < lengths[some])[..., None]
        np.add.at(total, row[some], logs.sum(axis=0))
    mean = total / np.maximum(np.diff(bounds), 1)[:, None]
    share = np.exp(mean - mean.max(axis=1, keepdims=True))
    return share / share.sum(axis=1, keepdims=True)


def _predicted(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            for row, end, text, bounds in texts.text_slices(batch.column("text"), 1 << 20):
                own = batch.slice(row, end - row)
                letters = texts.sums_of_rows(texts.LETTER_A_Z[text], bounds) > 0
                for r in np.flatnonzero(~letters):
                    letters[r] = any(c.isalpha() for c in text[bounds[r] : bounds[r + 1]].tobytes().decode())
                if net is None:
                    name, score = ["und"] * own.num_rows, np.zeros(own.num_rows)
                else:
                    share = pooled(net, text, bounds)
                    best = share.argmax(axis=1)
                    name = [net.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
                    score = np.where(letters, share.max(axis=1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("held_out"), pa.array(name, pa.string()), pa.array(score, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    return run


def identify(docs: DataFrame, folds: int = 3, held_out_fold: int = 1) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every document; the held-out fold is not learned from."""
    fold = samples.fold(F.col("doc_id"), folds)
    known = docs.filter(fold != held_out_fold).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("label"))
    net = train(samples.labelled(docs, known, DOCUMENTS, most=SAMPLE))
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(fold == held_out_fold, F.lit(False)).alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred kilobytes at most
    return source.mapInArrow(_predicted(model), "doc_id LONG, held_out BOOLEAN, lang_pred STRING, score DOUBLE")
