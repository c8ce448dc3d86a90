"""Files of a change as delivered by the hosting service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens import KEY
from changelens.operators.code_facts import FILE, is_python


def pr_file_snapshot(events: DataFrame) -> DataFrame:
    """Python files that still exist, with their number of changed lines."""
    none = F.lit(0)
    return events.filter(is_python(F.col("filename")) & (F.col("status") != "removed")).select(
        *FILE, "status", (F.coalesce("additions", none) + F.coalesce("deletions", none)).alias("lines_changed")
    )


def with_code(snapshot: DataFrame, contents: DataFrame) -> DataFrame:
    """The snapshot with the code of its files. Files without content, or whose bytes are not UTF-8 (NULL
    code, see :func:`decoded`), are dropped."""
    return snapshot.join(contents.filter("code IS NOT NULL").select(*FILE, "code"), FILE)


def decoded(content: Column) -> Column:
    """Bytes as text, NULL when they are not valid UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def without_python(events: DataFrame) -> DataFrame:
    """Changes with no file to review; in one aggregation rather than an anti-join with the snapshot."""
    kept = is_python(F.col("filename")) & (F.col("status") != "removed")
    return events.groupBy(*KEY).agg(F.count_if(kept).alias("n")).filter("n = 0").select(
        *KEY, F.lit("no_python_files").alias("status")
    )
