"""Bounded samples of labelled documents for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.storage import written

#: Of longer texts a sample takes ``PIECES`` pieces, spread from the start to the end, of so many bytes together.
SAMPLE_TEXT_BYTES = 20_000
PIECES = 4
#: Deviations by which more ids than wanted are ranked: fewer than wanted are left with a chance below 1e-8.
SLACK = 6


def fold(doc_id: Column, n: int) -> Column:
    """CRC-32 of the id as text, modulo ``n``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("long").cast("string").cast("binary")), F.lit(n))


def excerpt(text: Column) -> Column:
    """The text, or pieces of it if it is longer than ``SAMPLE_TEXT_BYTES``; a character cut in two is left out."""
    size, piece = F.octet_length(text), SAMPLE_TEXT_BYTES // PIECES - 1
    data = text.cast("binary")

    def cut(k: int) -> Column:
        start = F.floor((size - piece) * k / (PIECES - 1)).cast("int") + 1
        whole = F.make_valid_utf8(F.substring(data, start, F.lit(piece)).cast("string"))
        return F.regexp_replace(whole, "^\uFFFD+|\uFFFD+$", "")

    return F.when(size <= SAMPLE_TEXT_BYTES, text).otherwise(F.concat_ws("\n", *map(cut, range(PIECES))))


def labelled(docs: DataFrame, labels: DataFrame, per_label: int, most: int | None = None) -> list[tuple[object, str]]:
    """(label, text) of up to ``per_label`` documents of each label.

    ``labels`` has ``doc_id`` and ``label``; documents that have text come in the order of a hash of their ids. With
    ``most`` there are that many rows in all, but one of each label at least. Only ids are ranked, and of a label only
    those whose hash is below a bound that its count gives (:data:`SLACK`), so that a task ranks about ``per_label`` rows
    however common the label. Long texts are taken as their :func:`excerpt`.
    """
    known = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", "label").distinct()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.octet_length("text") > 0)
    with_text = known.join(source.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = written(with_text.groupBy("label").agg(F.count("*").alias("n")), "labels")  # a row for each label
    if most is not None:
        per_label = min(per_label, max(1, most // max(1, counts.count())))
    wanted = per_label + SLACK * (per_label**0.5 + SLACK)
    hashed = F.xxhash64("doc_id")
    place = hashed / float(1 << 64) + 0.5  # even over 0 to 1, in the order of the hash
    least = with_text.join(F.broadcast(counts), "label").filter(place * F.col("n") <= wanted)
    ranked = least.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy(hashed, "doc_id"))).filter(F.col("rank") <= per_label)
    found = source.join(F.broadcast(ranked.select("doc_id", "label")), "doc_id").select("doc_id", "label", excerpt(F.col("text")).alias("text"))
    rows = found.dropDuplicates(["doc_id", "label"]).orderBy("label", "doc_id").collect()
    return [(r["label"], r["text"]) for r in rows]


def shares(labels: DataFrame) -> dict[object, float]:
    """The share of each label among the labelled documents."""
    rows = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").distinct().groupBy("label").count().collect()
    total = sum(r["count"] for r in rows)
    return {r["label"]: r["count"] / total for r in rows}
