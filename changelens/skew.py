"""Joins on keys that may hold a large share of all rows.

AQE splits a skewed shuffle partition only if both join inputs come straight from a shuffle. Most of
our lookups join a big table with an aggregate of the same keys, where that rule does not apply, so
the hot keys are found first and spread explicitly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.storage import written_counting

#: Rows of one key a single task may take; a key with more is hot and is split into pieces of this size.
HOT_ROWS = 1_000_000


def hot_keys(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame | None:
    """All hot keys of a per-key count table with their number of pieces; None, as usual, if no key is hot. There is at
    most one for every ``HOT_ROWS`` rows; they are written, and Spark broadcasts the table if its size allows."""
    over = counts.filter(F.col(n) > HOT_ROWS)
    pieces = over.select(*keys, F.ceil(F.col(n) / HOT_ROWS).cast("long").alias("_pieces"))
    table, seen = written_counting(pieces, "hot", any=F.lit(True))
    return table if seen["any"] else None


def any_hot(counts: DataFrame, n: str = "n") -> bool:
    """Is any of the counts hot? If no group of rows is, no part of one is: one small job by a coarse key tells for all keys
    that are finer."""
    most = counts.agg(F.max(n)).first()[0]
    return most is not None and most > HOT_ROWS


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str, hot: DataFrame | None, spread_by: Column
) -> DataFrame:
    """Join a skewed ``left`` to ``right``, which has few rows per key.

    Rows of a hot key are spread over its pieces by a hash of ``spread_by`` (a row identity, so a
    retried task puts each row in the same place) and the matching right rows are repeated per piece.
    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.
    """
    if hot is None:
        return left.join(right, keys, how)
    zero = F.lit(0).cast("long")
    salted = (
        left.join(hot, keys, "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread_by), F.col("_pieces")), zero))
        .drop("_pieces")
    )
    repeated = (
        right.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(zero, F.coalesce("_pieces", F.lit(1)) - 1)))
        .drop("_pieces")
    )
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
