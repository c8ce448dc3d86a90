"""Token ids of documents in Parquet files, for selective reads.

Documents lie in ascending order over files and rows: ``part`` numbers the files, ``local_start`` counts
ids before a document within its file. ``ids`` is a list column with a dictionary, ``doc_id``,
``local_start`` and ``n_tokens`` are delta-encoded, row groups are small, and Parquet's page indexes let a
reader of some documents skip the other pages. ``start``, the count of ids before a document over all files,
is the file's own base (sum of the earlier files) and ``local_start``.

Order: ``doc_id`` (null first), then a hash of the text, then the text. Null or empty texts have the end id
alone; rows equal in id and text are stored once each; other columns are not stored. An empty table gives an
empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm import texts, vocabulary
from changelens.storage import new_path

SCHEMA = "part INT, doc_id LONG, local_start LONG, n_tokens LONG, ids ARRAY<INT>"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
FILE_FORMAT = {
    "compression": "zstd",
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": "1000",
    "parquet.writer.version": "PARQUET_2_0",  # delta encoding wherever there is no dictionary
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.dictionary.page.size": str(1 << 20),
}


def _encoded(vocabulary_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        encode = vocabulary.encoder(vocabulary_path).encode
        for batch in batches:
            for row, end, text, bounds in texts.text_slices(batch.column("text")):
                ids, at = vocabulary.with_end(*encode(text, bounds), end_id)
                n = end - row
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, np.int32)),
                        batch.column("doc_id").slice(row, n),
                        pa.array(before + at[:-1]),
                        pa.array(np.diff(at)),
                        pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)),
                    ],
                    names=["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                before += int(at[-1])

    return run


@dataclass
class TokenStore:
    spark: SparkSession
    path: str

    def files(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def documents(self) -> DataFrame:
        """``doc_id``, ``start``, ``n_tokens``, ``ids``; a reader that leaves ``ids`` out reads no token page."""
        totals = self.files().groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row a file
        bases, base = [], 0
        for part, n in totals:
            bases.append((part, base))
            base += n
        of_file = self.spark.createDataFrame(bases, "part INT, base LONG")
        return self.files().join(F.broadcast(of_file), "part").select(
            "doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
        )


def write_tokens(docs: DataFrame, vocabulary_path: str, end_id: int, path: str | None = None) -> TokenStore:
    """Encode ``text`` of every document, add ``end_id`` and write the store."""
    path = path or new_path(docs.sparkSession, "tokens")
    ordered = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("h"))
        .repartitionByRange("doc_id", "h")
        .sortWithinPartitions("doc_id", "h", "text")
        .select("doc_id", "text")
    )
    encoded = ordered.mapInArrow(_encoded(vocabulary_path, end_id), SCHEMA)
    encoded.write.options(**FILE_FORMAT).parquet(path)
    return TokenStore(docs.sparkSession, path)


def crc_of_lists(column: pa.Array) -> np.ndarray:
    """Unsigned CRC-32 of each list's ids as little-endian unsigned 32-bit integers."""
    ids = column.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    at = column.offsets.to_numpy()
    return np.fromiter((zlib.crc32(ids[a:b].data) for a, b in zip(at[:-1], at[1:], strict=True)), np.int64, len(column))


def checksums(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` of stored documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc_of_lists(batch.column("ids")))],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return documents.mapInArrow(run, "doc_id LONG, start LONG, n_tokens LONG, ids_crc32 LONG")
