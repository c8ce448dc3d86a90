"""Written intermediate tables.

Iterative jobs and shared inputs are cut from their lineage by writing them to the shared folder the
cluster names in ``spark.checkpoint.dir``, so a lost executor costs a re-read and never a replay of
all earlier rounds.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="changelens-")


def work_dir(spark: SparkSession) -> str:
    """Folder for this application's written tables, below ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/changelens/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{work_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return the table read back (fresh lineage, real size statistics)."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_counting(df: DataFrame, label: str, **conditions: Column) -> tuple[DataFrame, dict[str, int]]:
    """As :func:`written`, also counting the rows that meet each condition, in the same pass."""
    seen = Observation()
    counts = [F.coalesce(F.count_if(cond), F.lit(0)).alias(name) for name, cond in conditions.items()]
    table = written(df.observe(seen, *counts), label)
    return table, seen.get
