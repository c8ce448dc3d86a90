"""Token ids of whole texts, with each distinct piece of text encoded once.

A public tokenizer first cuts a text into words and then encodes each word alone, so a text may be cut
beforehand wherever its own rules always cut: before white space that follows something else, and before
an ASCII symbol that follows a letter of ASCII or Latin-1 (but for the apostrophe, and the bar of ``<|endoftext|>``). The pieces of a batch are made distinct by Arrow, the new ones
are encoded by the tokenizers library, many to a call where that cannot matter, and the ids are put together
with numpy. The ids are those of encoding each text whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from changelens.llm import texts

#: Pieces a Python worker remembers; beyond, those that were met once are forgotten, or all. Ids are the same either way.
REMEMBERED = 1_000_000
#: Pieces handed to the tokenizer at once, which bounds the memory of its answers.
ENCODED_AT_ONCE = 4096
#: Pieces of one string, between which a character stands that is cut off as a word of its own.
JOINED = 256
BETWEEN = "\x01"
#: Pieces that may stand in such a string: no rule joins their first or last character to the one between.
_JOINABLE = r"\A([ 0-9A-Za-z][^\x01]*)?[0-9A-Za-zÀ-ÖØ-öø-ÿ]\z"

_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~")] = True
#: Second bytes of the letters of Latin-1, after 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True


def _cuts(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Places where pieces begin. White space other than ASCII never ends on the left of a cut."""
    space = texts.SPACE[text]
    cut = np.zeros(len(text) + 1, bool)
    cut[bounds] = True
    if len(text) > 1:
        wide = np.zeros(len(text), bool)  # the last byte of a character that may be white space
        wide[1:] = (text[:-1] == 0xC2) & (text[1:] >= 0x80)
        wide[2:] |= (text[:-2] >= 0xE1) & (text[:-2] <= 0xE3)
        cut[1:-1] |= space[1:] & ~space[:-1] & ~wide[:-1]
        letter = texts.LETTER_A_Z[text]  # or the last byte of one
        letter[1:] |= (text[:-1] == 0xC3) & _LATIN[text[1:]]
        cut[1:-1] |= _MARK[text[1:]] & letter[:-1]
    return np.flatnonzero(cut)


_held: dict[str, Any] = {}


def held(path: str, make: Callable[[str], Any]) -> Any:
    """``make(path)``, which the worker keeps until another file is asked for: one vocabulary and the pieces remembered for it
    are in memory at a time."""
    if path not in _held:
        _held.clear()
        texts.give_back()
        _held[path] = make(path)
    return _held[path]


def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


Ids = tuple[np.ndarray, np.ndarray]


def _flat(lists: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int32)


def one_by_one(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[pa.Array], Ids]:
    """Of an ``encode`` from strings to lists of ids: from pieces to (ids of all, number of ids of each)."""

    def run(pieces: pa.Array) -> Ids:
        found = encode(pieces.to_pylist())
        return _flat(found), np.fromiter(map(len, found), np.int64, len(found))

    return run


def joined(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[pa.Array], Ids]:
    """As :func:`one_by_one`, with ``JOINED`` pieces to a string: an answer for each piece costs as much as its ids. Pieces
    that might merge with what stands between are encoded alone, and all are if that is not an id of its own."""
    alone = one_by_one(encode)
    a, mark, b, both = encode(["a", BETWEEN, " b", f"a{BETWEEN} b{BETWEEN}"])
    if len(mark) != 1 or both != [*a, *mark, *b, *mark]:
        return alone

    def run(pieces: pa.Array) -> Ids:
        fits = pc.match_substring_regex(pieces, _JOINABLE)
        some = pieces.filter(fits).to_pylist()
        ids = _flat(encode([BETWEEN.join(some[at : at + JOINED]) + BETWEEN for at in range(0, len(some), JOINED)]))
        ends = np.flatnonzero(ids == mark[0])
        if len(ends) != len(some):
            return alone(pieces)
        other_ids, other_lengths = alone(pieces.filter(pc.invert(fits)))
        fits = fits.to_numpy(zero_copy_only=False)
        lengths = np.empty(len(pieces), np.int64)
        lengths[fits], lengths[~fits] = np.diff(ends, prepend=-1) - 1, other_lengths
        out, of_fitting = np.empty(int(lengths.sum()), np.int32), np.repeat(fits, lengths)
        out[of_fitting], out[~of_fitting] = ids[ids != mark[0]], other_ids
        return out, lengths

    return run


class Remembered:
    """Ids by piece of text, sorted by the piece's hash; ``encode`` gives the ids of pieces and how many each has."""

    def __init__(self, encode: Callable[[pa.Array], Ids], most: int = REMEMBERED) -> None:
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.keys, self.starts, self.lengths = np.empty(0, texts.U64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.again, self.ids = np.empty(0, bool), np.empty(0, np.int32)

    def _keep_met_again(self) -> None:
        kept = np.flatnonzero(self.again)
        self.keys, lengths = self.keys[kept], self.lengths[kept]
        self.ids = self.ids[texts.ragged(self.starts[kept], lengths)]
        self.starts, self.lengths = np.cumsum(lengths, dtype=np.int64) - lengths, lengths
        self.again = np.zeros(len(kept), bool)

    def _learn(self, keys: np.ndarray, pieces: pa.Array) -> None:
        lengths, ids = [], [self.ids]
        for at in range(0, len(pieces), ENCODED_AT_ONCE):
            found, of_each = self.encode(pieces[at : at + ENCODED_AT_ONCE])
            ids.append(found)
            lengths.append(of_each)
        lengths = np.concatenate(lengths).astype(np.int32)
        starts = len(self.ids) + np.cumsum(lengths, dtype=np.int64) - lengths
        self.ids = np.concatenate(ids)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.starts = np.concatenate([self.starts, starts])[order]
        self.lengths = np.concatenate([self.lengths, lengths])[order]
        self.again = np.concatenate([self.again, np.zeros(len(lengths), bool)])[order]

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)

    def ids_of(self, tiles: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all tiles, ``len(tiles) + 1`` bounds of the tiles in them)."""
        pieces = tiles.dictionary
        own, own_bounds = texts.utf8(pieces)
        keys = texts.span_hashes(own, own_bounds[:-1], own_bounds[1:])
        place = self._places(keys)
        new = self.keys[place] != keys if len(self.keys) else np.ones(len(keys), bool)
        if len(self.keys):
            self.again[place[~new]] = True
        if len(self.keys) + int(new.sum()) > self.most:
            self._keep_met_again()
            place = self._places(keys)
            if len(self.keys) + int(new.sum()) > self.most:
                self._forget()
                new[:] = True
        if new.any():
            self._learn(keys[new], pieces.filter(pa.array(new)).cast(pa.large_string()))
            place = self._places(keys)
        piece = place[tiles.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[piece]
        bounds = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=bounds[1:])
        return self.ids[texts.ragged(self.starts[piece], lengths)], bounds


def tiled(text: np.ndarray, cuts: np.ndarray) -> pa.DictionaryArray:
    """The pieces between successive cuts (the first at 0, the last at the end), made distinct."""
    buffers = [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(text))]
    return pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, buffers).dictionary_encode()


class Encoder:
    """Encodes whole texts with a vocabulary file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        encode = tokenizer(path).encode_batch_fast
        self.pieces = Remembered(joined(lambda some: [e.ids for e in encode(some, add_special_tokens=False)]))

    def encode(self, text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ``len(bounds)`` bounds of the texts in them)."""
        if not len(text):
            return np.empty(0, np.int32), np.zeros(len(bounds), np.int64)
        cuts = _cuts(text, bounds)
        ids, at = self.pieces.ids_of(tiled(text, cuts))
        return ids, at[np.searchsorted(cuts, bounds)]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, kept between tasks."""
    return held(path, Encoder)


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the id ``end`` after each text's ids."""
    return np.insert(ids, bounds[1:], end).astype(np.int32), bounds + np.arange(len(bounds))
