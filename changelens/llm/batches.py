"""Arrow batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Bytes and rows of a batch.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000
_MAX_BYTES, _MAX_RECORDS = (f"spark.sql.execution.arrow.max{kind}PerBatch" for kind in ("Bytes", "Records"))


def use_small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` from now on, also in jobs that are run later: for an application's own session."""
    spark.conf.set(_MAX_BYTES, str(BATCH_BYTES))
    spark.conf.set(_MAX_RECORDS, str(BATCH_ROWS))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of ``BATCH_BYTES`` while a job is run: whole documents go to Python and back."""
    before = {name: spark.conf.get(name, None) for name in (_MAX_BYTES, _MAX_RECORDS)}
    use_small_batches(spark)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
