"""Module names of file paths, as column expressions that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def module_name(path: Column) -> Column:
    """Graph name of a changed file: ``pkg/mod.py`` -> ``pkg.mod``, ``pkg/__init__.py`` -> ``pkg.__init__``.

    Empty and ``.`` folders drop out; the last suffix goes, unless the name is nothing but a suffix.
    """
    clean = F.regexp_replace(F.regexp_replace(path, r"/(?:\.?/)+", "/"), r"^(?:\./)+", "")
    stem = F.regexp_replace(clean, r"([^/.][^/]*)\.[^/.]*$", "$1")
    dotted = F.replace(stem, F.lit("/"), F.lit("."))
    return F.when(F.startswith(stem, F.lit("/")), F.concat(F.lit("/"), dotted)).otherwise(dotted)


def tree_module_name(path: Column) -> Column:
    """Graph name of a file in a source tree: as above, but ``pkg/__init__.py`` -> ``pkg``."""
    package = F.endswith(path, F.lit("/__init__.py"))
    return F.when(package, F.regexp_replace(module_name(path), r"\.__init__$", "")).otherwise(module_name(path))


def ranking_name(path: Column) -> Column:
    """Name under which ranking looks a file up: every ``.py`` removed, ``/`` -> ``.``."""
    return F.replace(F.replace(path, F.lit(".py"), F.lit("")), F.lit("/"), F.lit("."))


def with_prefixes(table: DataFrame, column: str, prefix: str) -> DataFrame:
    """One row per dotted prefix of a name: ``a.b.c`` gives ``a``, ``a.b`` and ``a.b.c``."""
    parts = table.select("*", F.posexplode(F.split(column, r"\.")).alias("_depth", "_part"))
    return parts.withColumn(prefix, F.call_function("substring_index", F.col(column), F.lit("."), F.col("_depth") + 1)).drop("_depth", "_part")
