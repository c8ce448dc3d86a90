"""Quality rules on tokeniser fertility.

Every distinct word is encoded once by a public vocabulary with byte fallback. A document is measured by
characters per token, the share of byte tokens and the entropy of its tokens (as a share of the most that so
many tokens can have), and is rejected if a measure leaves its band: characters per token on either side, byte
share above, entropy below. All measures depend on the length, so there is a band for each language and length
class (tokens between two powers of two): the median over all its documents that pass the base rules, and
``SPREADS`` robust standard deviations. Where a class has less than ``LEAST_SHARE`` of the documents, the band of
the whole language holds, then those of the script; such bands are widened for texts under ``SHORT_TOKENS`` tokens,
by the square root of what is missing. Every text that passes the base rules is judged.

Base rules: at least ``MIN_WORDS`` words, and at most ``MAX_REPEAT_PERCENT`` percent of the words within
windows of five words that come twice or more in the text.

Null and empty texts have no words and fail. Rows are judged one by one, so repeated rows have equal results;
other columns are passed on as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.llm import texts, vocabulary
from changelens.llm.batches import small_batches
from changelens.storage import written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SHORT_TOKENS = 50
#: Words that a worker remembers; other stages run in the same workers.
REMEMBERED = 150_000
#: Bytes of text measured together.
SLICE_BYTES = 2 << 20

#: Robust standard deviations below and above the median (None: no limit), and the least that one counts.
SPREADS = {"chars_per_token": (3.5, 3.5), "byte_share": (None, 4.0), "entropy": (3.0, None)}
LEAST_SPREAD = {"chars_per_token": 0.02, "byte_share": 0.005, "entropy": 0.01}
#: Least share of the documents for a language, or a class of it, to have a band: 10,000 of either at most.
LEAST_SHARE = 1e-4
LEAST_DOCUMENTS = 30

SCRIPTS = ["latin", "greek", "cyrillic", "semitic", "indic", "east_asian", "none"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
#: Script by first byte of a character; -1 is no letter of a script.
_SCRIPT = np.full(256, -1, np.int8)
_SCRIPT[texts.LETTER_A_Z] = 0
_SCRIPT[0xC3:0xCB] = 0
_SCRIPT[0xCE:0xD0] = 1
_SCRIPT[0xD0:0xD4] = 2
_SCRIPT[0xD6:0xDC] = 3
_SCRIPT[0xE0] = 4
_SCRIPT[0xE3:0xEE] = 5

MEASURES = {
    "n_words": "LONG", "word_chars": "LONG", "n_symbols": "LONG", "n_dup_lines": "LONG", "n_repeat_words": "LONG",
    "base_failed": "BOOLEAN",
    "script": "STRING", "n_tokens": "LONG", "chars_per_token": "DOUBLE", "byte_share": "DOUBLE", "entropy": "DOUBLE",
}


KINDS = {"LONG": T.LongType(), "BOOLEAN": T.BooleanType(), "STRING": T.StringType(), "DOUBLE": T.DoubleType()}


def _pieces(path: str) -> tuple[vocabulary.Remembered, np.ndarray]:
    """The worker's ids by word, and which ids stand for a byte."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    is_byte = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return vocabulary.Remembered(vocabulary.one_by_one(lambda words: model.encode(words, num_threads=1)), REMEMBERED), is_byte


def _repeated_within(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which elements have an equal one in the same row; rows ascend."""
    keys = texts.mixed(hashes + rows.astype(texts.U64) * texts.U64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.empty(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _repeat_words(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By row, the words within windows that come twice or more in the row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    windows = texts.window_hashes(words, WINDOW)
    whole = np.flatnonzero(row[: len(windows)] == row[WINDOW - 1 :]) if len(windows) else np.empty(0, np.int64)
    again = whole[_repeated_within(row[whole], windows[whole])]
    covered = np.zeros(len(words) + WINDOW, np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + WINDOW, -1)
    return texts.sums_of_rows(np.cumsum(covered)[: len(words)] > 0, at)


def _dup_lines(text: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """By row, the lines with a word that equal an earlier line."""
    starts, ends = texts.runs(text != 0x0A, bounds)
    words = np.zeros(len(text) + 1, np.int64)
    np.cumsum(inside, out=words[1:])
    some = words[ends] > words[starts]
    starts, ends = starts[some], ends[some]
    hashes = texts.span_hashes(text, starts, ends)
    at = texts.of_rows(starts, bounds)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keys = texts.mixed(hashes + row.astype(texts.U64) * texts.U64(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    return np.diff(at) - np.bincount(row[first], minlength=len(at) - 1)


def _entropy(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """By row, the entropy of the ids as a share of log2(number of ids, at most the vocabulary)."""
    n = np.diff(at)
    keys = np.sort(np.repeat(np.arange(len(n)), n) * size + ids)
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    counts = np.diff(edges)
    row = keys[edges[:-1]] // size if len(keys) else np.empty(0, np.int64)
    weighted = np.bincount(row, counts * np.log2(np.maximum(counts, 1)), minlength=len(n))
    most = np.log2(np.clip(n, 2, size))
    return np.where(n > 1, (np.log2(np.maximum(n, 1)) - weighted / np.maximum(n, 1)) / most, 1.0)


def measured(text: np.ndarray, bounds: np.ndarray, vocabulary_path: str) -> dict[str, np.ndarray]:
    """Columns of :data:`MEASURES` for the texts between ``bounds``."""
    rows = len(bounds) - 1
    inside = ~texts.SPACE[text]
    starts, ends = texts.runs(inside, bounds)
    at = texts.of_rows(starts, bounds)
    n_words = np.diff(at)
    word_chars = texts.sums_of_rows(inside & texts.LEAD[text], bounds)
    repeat = _repeat_words(texts.span_hashes(text, starts, ends), at)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)

    cache, is_byte = vocabulary.held(vocabulary_path, _pieces)
    cuts = np.concatenate([[0], np.cumsum(ends - starts)])
    ids, of_words = cache.ids_of(vocabulary.tiled(text[inside], cuts)) if len(starts) else (np.empty(0, np.int32), np.zeros(1, np.int64))
    token_at = of_words[at]
    n_tokens = np.diff(token_at)
    chars = word_chars / np.maximum(n_tokens, 1)
    byte_share = texts.sums_of_rows(is_byte[ids], token_at) / np.maximum(n_tokens, 1)
    entropy = _entropy(ids, token_at, len(is_byte))

    script = np.where(inside, _SCRIPT[text], -1)
    letters = np.stack([texts.sums_of_rows(script == k, bounds) for k in range(len(SCRIPTS) - 1)], axis=1)
    of = np.where(letters.any(axis=1), letters.argmax(axis=1), len(SCRIPTS) - 1) if rows else np.empty(0, np.int64)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": texts.sums_of_rows(_SYMBOL[text], bounds),
        "n_dup_lines": _dup_lines(text, bounds, inside),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "script": np.array(SCRIPTS, object)[of],
        "n_tokens": n_tokens,
        "chars_per_token": chars,
        "byte_share": byte_share,
        "entropy": entropy,
    }


def measures(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Each row of ``docs`` as the struct ``doc``, with the columns of :data:`MEASURES`. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, text, bounds in texts.text_slices(batch.column("doc").field("text"), SLICE_BYTES):
                found = measured(text, bounds, vocabulary_path)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").slice(row, end - row), *map(pa.array, found.values())], names=["doc", *found]
                )

    source = docs.select(F.struct(*docs.columns).alias("doc"))  # the text is in there, and sent once
    columns = [T.StructField(name, KINDS[kind]) for name, kind in MEASURES.items()]
    return source.mapInArrow(texts.then_give_back(run), T.StructType([source.schema["doc"], *columns]))


#: Which documents have a band together, in the order in which bands are looked for.
BANDS = [("lang", "length"), ("lang",), ("script", "length"), ("script",)]
_KEYS = ("lang", "script", "length")


def _keys() -> list[Column]:
    length = F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int")
    return [F.col("doc.lang").cast("string"), F.col("script"), length]


def bands(found: DataFrame) -> DataFrame:
    """Bands by ``lang`` or ``script`` and ``length`` (null: any), with the median and spread of each measure."""
    passed = found.filter(~F.col("base_failed")).select(*(c.alias(k) for k, c in zip(_KEYS, _keys(), strict=True)), *LEAST_SPREAD)
    total = F.sum("n").over(Window.partitionBy())

    def limits(by: tuple[str, ...]) -> DataFrame:
        quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in LEAST_SPREAD]
        grouped = passed.groupBy(*by).agg(F.count("*").alias("n"), *quartiles).withColumn("total", total)
        if by != ("script",):
            grouped = grouped.filter(F.col("n") >= F.greatest(F.lit(LEAST_DOCUMENTS), LEAST_SHARE * F.col("total")))
        if "lang" in by:
            grouped = grouped.filter("lang IS NOT NULL")
        keys = [(F.col(k) if k in by else F.lit(None).cast("int" if k == "length" else "string")).alias(k) for k in _KEYS]
        spread = {m: F.greatest((F.col(m)[2] - F.col(m)[0]) / 1.349, F.lit(least)) for m, least in LEAST_SPREAD.items()}
        return grouped.select(*keys, *(F.struct(F.col(m)[1].alias("median"), x.alias("spread")).alias(m) for m, x in spread.items()))

    rows = reduce(DataFrame.unionByName, map(limits, BANDS))
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)  # 30,000 rows and a few at most


def judged(found: DataFrame, limits: DataFrame) -> DataFrame:
    """``found`` with ``kept``."""
    joined = found.select("*", *(c.alias(f"_{k}") for k, c in zip(_KEYS, _keys(), strict=True)))
    short = F.sqrt(F.greatest(F.lit(1.0), SHORT_TOKENS / F.greatest("n_tokens", F.lit(1))))
    for i, by in enumerate(BANDS):
        own = limits.filter(reduce(Column.__and__, (F.col(k).isNotNull() if k in by else F.col(k).isNull() for k in _KEYS)))
        own = own.select(*(F.col(k).alias(f"_{k}") for k in by), F.struct(*LEAST_SPREAD).alias(f"_band{i}"))
        joined = joined.join(F.broadcast(own), [f"_{k}" for k in by], "left")
    band = F.coalesce(*(f"_band{i}" for i in range(len(BANDS))))
    widened = F.when(F.col("_band0").isNotNull(), F.lit(1.0)).otherwise(short)
    outside = F.lit(False)
    for m, (low, high) in SPREADS.items():
        spread = band[m]["spread"] * widened
        if m == "byte_share":  # a single byte of a short text is no sign
            spread = F.greatest(spread, 1 / F.greatest("n_tokens", F.lit(1)))
        if low is not None:
            outside = outside | (F.col(m) < band[m]["median"] - low * spread)
        if high is not None:
            outside = outside | (F.col(m) > band[m]["median"] + high * spread)
    return joined.select(*found.columns, (~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))).alias("kept"))


def quality(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """``doc`` with ``doc_id`` and ``lang``, :data:`MEASURES` and ``kept`` of every document, in one scan."""
    found = written(measures(docs.select("doc_id", "lang", "text"), vocabulary_path).withColumn("doc", F.col("doc").dropFields("text")), "quality")
    return judged(found, bands(found))


def _declared(field: T.StructField) -> Column:
    """A column that was written, under the field it came from: tables read back allow nulls in every column, of which this
    one has none if the field allows none."""
    zero = {T.NumericType: F.lit(0), T.StringType: F.lit(""), T.BooleanType: F.lit(False)}
    value = next((v for kind, v in zero.items() if isinstance(field.dataType, kind)), None)
    column = F.col("doc")[field.name]
    return column.alias(field.name) if field.nullable or value is None else F.coalesce(column, value.cast(field.dataType)).alias(field.name)


def keep(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns unchanged. Texts are measured once: the rows are written with their
    measures, from which the bands are made and the rows are judged."""
    with small_batches(docs.sparkSession):
        found = written(measures(docs, vocabulary_path), "measured")
    return judged(found, bands(found)).filter("kept").select(*map(_declared, docs.schema.fields))
