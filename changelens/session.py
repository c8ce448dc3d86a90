"""Session settings the jobs rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Set on every session, local or cluster. Shuffle partition counts are left to the cluster: AQE
#: coalesces from whatever upper bound the cluster configures.
COMMON_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Source files differ a lot in length: bound an Arrow batch by rows here, and by bytes with
    # spark.sql.execution.arrow.maxBytesPerBatch (64 MB by default).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(app: str = "changelens", cores: int | str | None = None) -> SparkSession:
    """A session for tests and the benchmark; on a cluster use the session it hands you."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in COMMON_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
