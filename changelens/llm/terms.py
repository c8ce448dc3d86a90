"""Terms of texts in Arrow batches: maximal runs of some bytes, A-Z lower-cased, as exact strings.

On UTF-8 a run of letters, digits and bytes from 0x80 on is the same as a run of the characters they belong to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from changelens.llm import texts

#: Letters A-Z in either case and all characters from U+0080 on; the same with the digits 0-9.
WORDS = texts.LETTER_A_Z.copy()
WORDS[0x80:] = True
WORDS_AND_DIGITS = WORDS.copy()
WORDS_AND_DIGITS[0x30:0x3A] = True


@dataclass(frozen=True)
class Terms:
    """Terms of some texts in their order: ``of[i]`` is the number of the i-th in ``distinct``, ``at`` cuts them into texts."""

    distinct: pa.Array
    of: np.ndarray
    at: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term number, occurrences) of the distinct terms of each text."""
        width = max(1, len(self.distinct))
        keys, n = np.unique(self.rows * width + self.of, return_counts=True)
        return keys // width, keys % width, n


def terms(text: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> Terms:
    """The terms of the texts between ``bounds``; ``inside`` tells which bytes belong to terms."""
    lower = texts.LOWER[text]
    within = inside[lower]
    starts, ends = texts.runs(within, bounds)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    data = pa.py_buffer(np.ascontiguousarray(lower[within]))
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), data).dictionary_encode()
    return Terms(found.dictionary.cast(pa.string()), found.indices.to_numpy().astype(np.int64), texts.of_rows(starts, bounds))


def digests(found: pa.Array) -> np.ndarray:
    """64-bit hashes of strings."""
    data, bounds = texts.utf8(found)
    return texts.span_hashes(data, bounds[:-1], bounds[1:])
