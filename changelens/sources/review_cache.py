"""The review cache as a table: ``(content_hash, review, created_at)``, review being JSON text.

Writes only ever add: one folder per batch. Compacting merges the batches since the last time into a *run* and publishes a
new generation, a small record of the runs and of the last batch that they hold; readers take the newest entry of each hash
from the runs and the later batches. So a reader never sees a half-replaced cache, and a batch that is added while
another process compacts is one of the later ones. All folders are laid out by the first digits of the hash, and a
lookup reads those it asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

ENTRY = "content_hash STRING, review STRING, created_at TIMESTAMP"
RECORD = "generation INT, upto LONG, runs ARRAY<INT>"

#: Leading hash digits by which the folders are laid out: 16 of them.
PREFIX_DIGITS = 1
#: Runs that are merged into one when there are so many.
MOST_RUNS = 8


def latest(entries: DataFrame) -> DataFrame:
    """Last write wins, per hash; of writes at one time, the greatest review. One partial aggregation, so many writes
    of one hash stay cheap."""
    newest = entries.groupBy("content_hash").agg(F.max(F.struct("created_at", "review")).alias("newest"))
    return newest.select("content_hash", "newest.review", "newest.created_at")


def cache_rows(contents: DataFrame) -> DataFrame:
    """Entries for ``(code, review, created_at)``. The key is the text alone, not the file name."""
    return contents.select(F.sha2("code", 256).alias("content_hash"), "review", "created_at")


@dataclass
class ReviewCache:
    spark: SparkSession
    root: str

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> "ReviewCache":
        cache = cls(spark, root)
        none = spark.createDataFrame([], ENTRY)
        cache._write(none, f"{root}/entries/batch=-1")
        cache._write(none, f"{root}/runs/run=0")
        cache._publish(0, -1, [0])
        return cache

    def _record(self) -> Row:
        """What the last generation holds: its runs, and the number of the last batch in them."""
        records = self.spark.read.schema(RECORD).json(f"{self.root}/published/*")
        return records.orderBy(F.desc("generation")).first()

    def generation(self) -> int:
        return self._record()["generation"]

    def _publish(self, generation: int, upto: int, runs: list[int]) -> None:
        """Fails if there is such a generation: another process was first, whose record must not be lost."""
        mark = self.spark.range(1).select(
            F.lit(generation).alias("generation"), F.lit(upto).cast("long").alias("upto"), F.array(*map(F.lit, runs)).cast("array<int>").alias("runs"))
        mark.write.mode("errorifexists").json(f"{self.root}/published/{generation}")

    @staticmethod
    def _write(entries: DataFrame, folder: str) -> None:
        rows = entries.select("content_hash", "review", "created_at", F.substring("content_hash", 1, PREFIX_DIGITS).alias("prefix"))
        rows.repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(folder)

    def _read(self, kind: str, number: str) -> DataFrame:
        schema = f"{ENTRY}, {number} LONG, prefix STRING"
        return self.spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(f"{self.root}/{kind}")

    def _entries(self, before_batch: int | None = None, asked: DataFrame | None = None) -> DataFrame:
        record = self._record()
        late = F.col("batch") > record["upto"]
        if before_batch is not None:
            late = late & (F.col("batch") < before_batch)
        runs = self._read("runs", "run").filter(F.col("run").isin(record["runs"])).withColumn("batch", F.lit(record["upto"]).cast("long")).drop("run")
        rows = runs.unionByName(self._read("entries", "batch").filter(late))
        if asked is not None:
            prefixes = asked.select(F.substring("content_hash", 1, PREFIX_DIGITS).alias("prefix")).distinct().collect()  # 16 at most
            rows = rows.filter(F.col("prefix").isin([r["prefix"] for r in prefixes]))
        return rows.drop("prefix")

    def entries(self, before_batch: int | None = None, asked: DataFrame | None = None) -> DataFrame:
        """Current entries; with ``before_batch`` as they were before that batch, for a replayed one; with ``asked`` at least
        those of its hashes, from the folders where they may be."""
        return latest(self._entries(before_batch, asked))

    def append(self, entries: DataFrame, batch: int) -> None:
        """Add the entries of a batch. Writing the same batch again replaces it."""
        self._write(entries, f"{self.root}/entries/batch={batch}")

    def clear(self) -> None:
        """Publish a cache without entries; batches after the last one that is there now count again."""
        record = self._record()
        self._publish(record["generation"] + 1, self._last_batch(), [0])

    def _last_batch(self) -> int:
        last = self._read("entries", "batch").agg(F.max("batch")).first()[0]
        return max(-1 if last is None else last, self._record()["upto"])

    def compact(self) -> None:
        """Merge the batches since the last time into a run with one entry per hash, and all runs if they are ``MOST_RUNS``.
        The last batch stays as it is, as it is the one that a stream may replay. May run beside the writer."""
        record = self._record()
        upto = self._last_batch() - 1
        if upto <= record["upto"]:
            return
        generation = record["generation"] + 1
        merged = self._read("entries", "batch").filter((F.col("batch") > record["upto"]) & (F.col("batch") <= upto)).drop("batch")
        runs = [*record["runs"], generation]
        if len(runs) > MOST_RUNS:
            merged = merged.unionByName(self._read("runs", "run").filter(F.col("run").isin(record["runs"])).drop("run"))
            runs = [generation]
        self._write(latest(merged), f"{self.root}/runs/run={generation}")
        self._publish(generation, upto, runs)

    def stats(self) -> DataFrame:
        """Entries, location and data files of the cache."""
        hashes = self._entries().select("content_hash").distinct().agg(F.count("*").alias("entries"))
        files = self._entries().select(F.input_file_name().alias("file")).distinct().agg(F.count("*").alias("files"))
        return hashes.select("entries", F.lit(self.root).alias("location"), F.lit(files.scalar()).alias("files"))
