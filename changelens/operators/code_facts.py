"""The code-facts table and the tables and aggregates read from it.

Input: changed files ``(repo, pr_number, filename, code[, more columns])``. Each file is parsed once, in
the task that scans it; no shuffle. Everything later reads the facts and never the code again.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from changelens import KEY
from changelens.functions import syntax
from changelens.functions.syntax import read_facts

FILE = [*KEY, "filename"]

FACTS_DDL = """
    total_lines INT, avg_complexity DOUBLE, error_kind STRING, error_message STRING,
    functions ARRAY<STRUCT<name: STRING, line_start: INT, line_end: INT, args: ARRAY<STRING>,
        complexity: INT, docstring: STRING, is_async: BOOLEAN>>,
    classes ARRAY<STRUCT<name: STRING, line_start: INT, line_end: INT, methods: ARRAY<STRING>,
        base_classes: ARRAY<STRING>, docstring: STRING>>,
    imports ARRAY<STRUCT<module: STRING, names: ARRAY<STRING>, line: INT, is_from_import: BOOLEAN>>"""

# Ship the helper with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(syntax)


def is_python(filename: Column) -> Column:
    return F.endswith(filename, F.lit(".py"))


def code_facts(files: DataFrame) -> DataFrame:
    """Parse every ``.py`` file. The hash and length of the text are computed on the JVM side."""
    python_files = files.filter(is_python(F.col("filename")) & F.col("code").isNotNull()).withColumns(
        {"content_hash": F.sha2("code", 256), "n_chars": F.length("code")}
    )
    kept = [c for c in python_files.columns if c != "code"]
    facts_type = T.StructType.fromDDL(FACTS_DDL)
    parsed = to_arrow_schema(facts_type)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # syntax trees hold no cycles; the collector's passes over them take a fifth of the time
        for batch in batches:
            rows = [read_facts(code) for code in batch.column("code").to_pylist()]
            facts = [pa.array([r[f.name] for r in rows], type=f.type) for f in parsed]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + facts, [*kept, *parsed.names])
        gc.enable()

    out = T.StructType([*python_files.select(*kept).schema.fields, *facts_type.fields])
    return python_files.select(*kept, "code").mapInArrow(parse, out)


def _rows(facts: DataFrame, array: str) -> DataFrame:
    """One row per array element with its position, in breadth-first order of the tree."""
    return facts.select(*FILE, F.posexplode(array).alias("pos", "item")).select(*FILE, "pos", "item.*")


def functions(facts: DataFrame) -> DataFrame:
    return _rows(facts, "functions")


def classes(facts: DataFrame) -> DataFrame:
    return _rows(facts, "classes")


def imports(facts: DataFrame) -> DataFrame:
    return _rows(facts, "imports")


def analyzed(facts: DataFrame) -> DataFrame:
    """Files that count as analysed: valid ones and those with a syntax error."""
    return facts.filter(F.col("error_kind").isNull() | (F.col("error_kind") == "syntax"))


def syntax_errors(facts: DataFrame) -> DataFrame:
    return facts.filter("error_kind = 'syntax'").select(*FILE, "error_message", "total_lines")


def fact_counts() -> list[Column]:
    """Functions, classes and imports of a facts row; of each nested table only one number is read."""
    return [
        F.size("functions.line_start").alias("n_functions"), F.size("classes.line_start").alias("n_classes"),
        F.size("imports.line").alias("n_imports"),
    ]


def file_summary(facts: DataFrame) -> DataFrame:
    return analyzed(facts).select(
        *FILE, "total_lines", "avg_complexity",
        *fact_counts(),
        (F.col("error_kind") == "syntax").eqNullSafe(True).alias("has_syntax_error"),
    )


def max_complexity() -> Column:
    """Highest function complexity of a facts row, 1 without functions."""
    return F.coalesce(F.array_max(F.col("functions.complexity")), F.lit(1))


def file_max_complexity(facts: DataFrame) -> DataFrame:
    return analyzed(facts).select(*FILE, max_complexity().alias("max_complexity"))


def complexity_band(complexity: Column) -> Column:
    return F.when(complexity <= 5, "simple").when(complexity <= 10, "medium").otherwise("complex")


def complexity_bands(facts: DataFrame) -> DataFrame:
    """Functions per repository and band. Counted from the nested column, without exploding wide rows."""
    band = F.explode(F.transform(F.col("functions.complexity"), complexity_band)).alias("band")
    return facts.select("repo", band).groupBy("repo", "band").agg(F.count("*").alias("n_functions"))
