"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

Patterns give the kinds ``assign``, ``access`` and ``hex``. The kind ``random`` is found as follows. A
candidate is a maximal run of ``[A-Za-z0-9+/_-]`` of 20 characters and more, with up to two ``=`` after it: an ``=``
within ends one and begins the next, so a name is not tested with its key. Its encoding is the smallest alphabet
of :data:`ALPHABETS` that holds it, letters alone among them. Uniform random symbols of that alphabet are the
hypothesis under four tests: chi-squared of the symbol counts, chi-squared of the counts of a few classes of symbols
(:data:`_CLASSES`; it has power where a run is too short for the symbols), runs above and below the middle of the
alphabet, and serial correlation of neighbouring symbols. The least of their p-values, times four, is the
candidate's p-value: small for identifiers, paths, numbers and prose, anything for a random key. A run with ``/`` that
is not random as a whole is a path: its pieces of 20 characters and more are candidates of their own.

Over all candidates of the corpus of one encoding and length band, the Benjamini-Hochberg procedure rejects
the hypothesis with a false-discovery rate of ``FDR``, that is, at most this share of the rejected candidates
are random in truth: it bounds the missed keys. The others are reported, if they hold ``MIN_BITS`` bits, the length from
which the tests have power against prose; how many of those are false alarms is not bounded, but measured in
the README. Counts go over all candidates, in bins of ``-log10 p``.

Null and empty texts have no spans, an empty table has no rows, and texts of any length are scanned whole. Rows are scanned
one by one, so repeated rows and equal texts have equal results; other columns are not used. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changelens.storage import written

#: Fixed patterns of the contract, ASCII letters in either case in the first word of ``assign`` only.
ASSIGN = re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
PIECE = re.compile(r"[A-Za-z0-9+_-]{20,}={0,2}")
_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Name and symbols, the smaller alphabets first; ``=`` at the end is padding.
ALPHABETS = [
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("lower", _LOWER),
    ("UPPER", _UPPER),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("letters", _UPPER + _LOWER),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_"),
]
_SETS = [frozenset(symbols) for _, symbols in ALPHABETS]
_RANKS = [{c: i for i, c in enumerate(symbols)} for _, symbols in ALPHABETS]
_VOWELS, _COMMON = "aeiou", "tnsrhldc"


def _class(symbol: str) -> int:
    """Digits and marks, or by case: vowels, consonants that are common in prose, other letters."""
    low = symbol.lower()
    if low not in _LOWER:
        return 0
    return 1 + 3 * symbol.isupper() + (0 if low in _VOWELS else 1 if low in _COMMON else 2)


#: The class of each symbol of an alphabet, numbered from 0.
_CLASSES = [np.unique([_class(c) for c in symbols], return_inverse=True)[1] for _, symbols in ALPHABETS]

FDR = 0.05
MIN_BITS = 100
#: Bins of -log10 p for each unit, and the last bin.
BINS_A_UNIT, LAST_BIN = 20, 400

FOUND = (
    "doc_id LONG, spans ARRAY<STRUCT<start: LONG, kind: INT, end: LONG>>, "
    "candidates ARRAY<STRUCT<start: LONG, end: LONG, encoding: STRING, band: INT, bin: INT, bits: DOUBLE>>"
)


def _chi_squared_tail(x: float, degrees: int) -> float:
    """P(X >= x) by the cube-root normal form of Wilson and Hilferty."""
    if x <= 0:
        return 1.0
    spread = 2 / (9 * degrees)
    return 0.5 * math.erfc(((x / degrees) ** (1 / 3) - (1 - spread)) / math.sqrt(2 * spread))


def p_value(symbols: np.ndarray, size: int, classes: np.ndarray | None = None) -> float:
    """Of all tests together that ``symbols`` are uniform over ``size`` values; ``classes`` are those of the values."""
    n = len(symbols)
    counts = np.bincount(symbols, minlength=size)
    expected = n / size
    # few expected counts a cell: neighbouring symbols share a cell
    cells = max(2, min(size, n // 5))
    if cells < size:
        edges = np.arange(size) * cells // size
        counts = np.bincount(edges, counts, minlength=cells)
        expected = np.bincount(edges, minlength=cells) * (n / size)
    uniform = _chi_squared_tail(float(((counts - expected) ** 2 / expected).sum()), cells - 1)

    high = 2 * symbols >= size
    up = int(high.sum())
    down = n - up
    if up and down:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 1 + 2 * up * down / n
        variance = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
        run = math.erfc(abs(runs - mean) / math.sqrt(2 * variance))
    else:
        run = 2.0 ** (1 - n)

    centred = symbols - (size - 1) / 2
    correlation = float((centred[1:] * centred[:-1]).sum()) / ((n - 1) ** 0.5 * (size * size - 1) / 12)
    serial = math.erfc(abs(correlation) / math.sqrt(2))
    if classes is None or not classes.any():
        return min(1.0, 3 * min(uniform, run, serial))
    expected = np.bincount(classes) * (n / size)
    held = np.bincount(classes[symbols], minlength=len(expected))
    mixture = _chi_squared_tail(float(((held - expected) ** 2 / expected).sum()), len(expected) - 1)
    return min(1.0, 4 * min(uniform, mixture, run, serial))


#: A whole run with ``/`` of a lower p-value is taken for a path.
PATH = 0.01


def candidates(text: str) -> Iterator[dict]:
    """Encoded strings of a text, with encoding, length band, binned p-value and bits."""
    for match in CANDIDATE.finditer(text):
        whole = _tested(match.group(), match.start())
        yield whole
        if "/" in match.group() and whole["bin"] > -math.log10(PATH) * BINS_A_UNIT:
            for piece in PIECE.finditer(text, *match.span()):
                yield _tested(piece.group(), piece.start())


def _tested(found: str, start: int) -> dict:
    body = found.rstrip("=")
    held = set(body)
    k = next(i for i, s in enumerate(_SETS) if held <= s)  # the last holds all
    name, symbols = ALPHABETS[k]
    rank = _RANKS[k]
    p = p_value(np.array([rank[c] for c in body]), len(symbols), _CLASSES[k])
    unit = -math.log10(max(p, 10.0 ** (-LAST_BIN / BINS_A_UNIT)))
    return {
        "start": start,
        "end": start + len(found),
        "encoding": name,
        "band": len(body).bit_length(),
        "bin": min(LAST_BIN, int(unit * BINS_A_UNIT)),
        "bits": len(body) * math.log2(len(symbols)),
    }


def base_spans(text: str) -> list[dict]:
    """Spans of the fixed patterns, by start, then kind."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [{"start": a, "kind": k, "end": b} for a, k, b in sorted(spans)]


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    fields = [("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("band", pa.int32()), ("bin", pa.int32()), ("bits", pa.float64())]
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            texts = [t or "" for t in some.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    some.column("doc_id"),
                    pa.array([base_spans(t) for t in texts], span),
                    pa.array([list(candidates(t)) for t in texts], pa.list_(pa.struct(fields))),
                ],
                names=["doc_id", "spans", "candidates"],
            )


def rejected_from(found: DataFrame) -> DataFrame:
    """By ``encoding`` and ``band``, the least ``bin`` that Benjamini-Hochberg rejects; none if none is.

    Bins of p-values go from the smallest p up; a bin's largest p is taken for all in it.
    """
    counts = found.select(F.explode("candidates").alias("c")).groupBy("c.encoding", "c.band", "c.bin").agg(F.count("*").alias("n"))
    by_stratum = Window.partitionBy("encoding", "band")
    smaller = by_stratum.orderBy(F.desc("bin"))  # one row for each bin, at most LAST_BIN + 1
    largest_p = F.pow(F.lit(10.0), -F.col("bin") / BINS_A_UNIT)
    passed = largest_p * F.sum("n").over(by_stratum) <= FDR * F.sum("n").over(smaller)
    return counts.withColumn("passed", passed).filter("passed").groupBy("encoding", "band").agg(F.min("bin").alias("from_bin"))


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (start, kind, end) of every document, by start, then kind."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = written(source.mapInArrow(_scanned, FOUND), "secrets")  # without the texts
    limits = rejected_from(found).collect()  # at most one row for each of the alphabets and 32 lengths
    of_stratum = F.create_map(*(F.lit(x) for r in limits for x in (f"{r['encoding']}:{r['band']}", r["from_bin"]))).cast("map<string,int>")
    limit = lambda c: of_stratum[F.concat_ws(":", c["encoding"], c["band"].cast("string"))]
    random = F.filter("candidates", lambda c: (c["bits"] >= MIN_BITS) & (c["bin"] < F.coalesce(limit(c), F.lit(LAST_BIN + 1))))
    added = F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return found.select("doc_id", F.array_sort(F.concat("spans", added)).alias("spans"))


def digests(found: DataFrame) -> DataFrame:
    """Counts of the fixed kinds, SHA-256 of their spans, and all spans, as text."""
    kinds = F.array(*map(F.lit, KINDS))
    written_out = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(written_out(base), 256).alias("base_sha256"),
        written_out(F.col("spans")).alias("spans"),
        count(3).alias("n_random"),
    )
