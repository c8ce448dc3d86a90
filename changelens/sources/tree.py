"""Source trees as file tables.

Spark's file sources skip empty files and names starting with an underscore, which for Python code means
every ``__init__.py``. So folders are listed and files read by tasks, through Arrow's file systems.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions.names import tree_module_name
from changelens.operators.code_facts import is_python
from changelens.sources.snapshots import decoded
from changelens.storage import written_counting

# Folders that are not looked into.
SKIPPED_FOLDERS = ["venv", "env", "__pycache__", ".git", "node_modules", ".pytest_cache"]

#: Folders or files one task handles.
PER_TASK = 1000


def _list_folders(base: str):
    """Entries of each folder; linked folders are not followed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            found = []
            for folder in batch.column("filename").to_pylist():
                for entry in system.get_file_info(fs.FileSelector(f"{root}/{folder}".rstrip("/"))):
                    is_folder = entry.type == fs.FileType.Directory
                    if not (is_folder and os.path.islink(entry.path)):
                        found.append((f"{folder}/{entry.base_name}".lstrip("/"), entry.base_name, is_folder))
            names, leaves, folders = zip(*found) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(leaves, pa.string()), pa.array(folders, pa.bool_())],
                ["filename", "name", "is_folder"],
            )

    return run


def _read_files(base: str):
    """Content of each file, NULL if it cannot be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            for name in batch.column("filename").to_pylist():
                try:
                    with system.open_input_stream(f"{root}/{name}") as source:
                        content = source.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["filename", "content"])

    return run


def _spread(table: DataFrame, rows: int) -> DataFrame:
    """Listing and reading take time, not space: split by number of entries."""
    return table.repartition(max(1, -(-rows // PER_TASK)), "filename")


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """``(filename, module, code)`` of all Python files below ``root``, a path or URI every executor can
    open; code is NULL for files that cannot be read or are not UTF-8. One listing round per level."""
    base = root if "://" in root else os.path.abspath(root)
    folders, n_folders = spark.createDataFrame([("",)], "filename STRING"), 1
    files, n_files = folders.filter("false"), 0
    wanted = F.col("is_folder") & ~F.col("name").isin(SKIPPED_FOLDERS)
    python_file = ~F.col("is_folder") & is_python(F.col("name"))
    while n_folders:
        listed = _spread(folders, n_folders).mapInArrow(
            _list_folders(base), "filename STRING, name STRING, is_folder BOOLEAN"
        )
        level, seen = written_counting(listed, "tree", folders=wanted, files=python_file)
        folders, n_folders = level.filter(wanted).select("filename"), seen["folders"]
        files, n_files = files.unionByName(level.filter(python_file).select("filename")), n_files + seen["files"]
    contents = _spread(files, n_files).mapInArrow(_read_files(base), "filename STRING, content BINARY")
    return contents.select(
        "filename", tree_module_name(F.col("filename")).alias("module"), decoded(F.col("content")).alias("code")
    )


def tree_files(tree: DataFrame, repo: str) -> DataFrame:
    """A tree in the shape of a change (number 0). Unreadable files stay, with empty code, as graph nodes."""
    return tree.select(
        F.lit(repo).alias("repo"), F.lit(0).cast("long").alias("pr_number"), "filename", "module",
        F.coalesce("code", F.lit("")).alias("code"),
    )
