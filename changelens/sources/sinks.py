"""Output tables, one folder per repository."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens.storage import written

#: Rows of one repository in a file of a stream's output.
FILE_ROWS = 500_000


def publish(table: DataFrame, path: str, mode: str = "append") -> None:
    """Write comments or summaries partitioned by repository. Rows are dealt by ranges of (repository, row hash), so a
    task writes few repositories and the rows of a large one are spread over several tasks."""
    dealt = table.repartitionByRange("repo", F.xxhash64(*table.columns))
    dealt.write.mode(mode).partitionBy("repo").parquet(path)


@dataclass
class BatchOutput:
    """The output table of a stream: ``data/batch=N/repo=R`` and a mark for each batch that is complete.

    A batch counts from its mark on. One that broke off before is written anew by its replay; one that has a mark is left
    as it is, so a replay changes no file. There is one writer, the stream.
    """

    spark: SparkSession
    root: str

    @classmethod
    def create(cls, spark: SparkSession, root: str) -> "BatchOutput":
        output = cls(spark, root)
        output._mark(-1)
        return output

    def _mark(self, batch: int) -> None:
        mark = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"))
        mark.write.mode("overwrite").json(f"{self.root}/commits/{batch}")

    def batches(self) -> DataFrame:
        return self.spark.read.schema("batch LONG").json(f"{self.root}/commits/*").filter("batch >= 0").distinct()

    def publish(self, table: DataFrame, batch: int) -> bool:
        """Add the rows of a batch, by repository, once; returns whether they were written now.

        The rows of a repository go to files by their hash, ``FILE_ROWS`` to each, so a batch has a file for so many rows and
        one for each repository at most, whatever the number of tasks that made the rows.
        """
        if not self.batches().filter(F.col("batch") == batch).isEmpty():
            return False
        rows = written(table, "to-publish")
        files = written(rows.groupBy("repo").agg(F.ceil(F.count("*") / FILE_ROWS).alias("_files")), "repository-files")
        n_files = files.agg(F.sum("_files")).first()[0] or 1  # a batch without rows has an empty folder
        placed = rows.withColumn("_hash", F.xxhash64(*rows.columns)).join(files, "repo").withColumn("_file", F.pmod("_hash", F.col("_files")))
        dealt = placed.repartition(n_files, "repo", "_file").sortWithinPartitions("repo", "_file", "_hash")
        writer = dealt.select(*rows.columns).write.mode("overwrite").option("maxRecordsPerFile", 2 * FILE_ROWS)
        writer.partitionBy("repo").parquet(f"{self.root}/data/batch={batch}")
        self._mark(batch)
        return True

    def rows(self, schema: T.StructType) -> DataFrame:
        """The rows of all complete batches, with their ``batch``."""
        if self.batches().isEmpty():
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
        full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        return self.spark.read.schema(full).parquet(f"{self.root}/data").join(self.batches(), "batch", "left_semi").select(*full.fieldNames())
