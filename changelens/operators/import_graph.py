"""The import graph of every change: modules, edges, nodes, degrees.

An edge goes from a file's module to the name it imports, as written: names are not resolved to files,
so a package prefix or a name below a module becomes a node of its own.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from changelens import KEY
from changelens.functions import project_imports
from changelens.functions.names import module_name, with_prefixes
from changelens.skew import any_hot, hot_keys, salted_join
from changelens.storage import written

#: Modules and imported names of a change that a task looks through, and of all changes that it takes together.
CHANGE_NAMES = 500_000
TASK_NAMES = 200_000

# Ship the helper with the job, as that of the code facts.
cloudpickle.register_pickle_by_value(project_imports)


def unusable_graphs(facts: DataFrame) -> DataFrame:
    """Changes with a file the parser gave up on: they have no graph."""
    return facts.filter("error_kind = 'parser'").select(*KEY).distinct()


def graph_files(facts: DataFrame) -> DataFrame:
    """Files of the changes that have a graph, with their module name (kept if the table has one, as source
    trees do)."""
    unusable = unusable_graphs(facts)
    if not unusable.isEmpty():
        hot = hot_keys(facts.groupBy(*KEY).agg(F.count("*").alias("n")), KEY)
        facts = salted_join(facts, unusable, KEY, "left_anti", hot, F.col("filename"))
    return facts if "module" in facts.columns else facts.withColumn("module", module_name(F.col("filename")))


def modules(files: DataFrame) -> DataFrame:
    """Project modules with the path of their file (the last path when two files share a name)."""
    return files.groupBy(*KEY, "module").agg(F.max("filename").alias("path"))


def _imported(files: DataFrame) -> DataFrame:
    """(module, imported name) pairs, distinct inside a file; files that share a module name may repeat them."""
    names = F.array_distinct(F.col("imports.module"))
    return files.select(*KEY, "module", F.explode(names).alias("imported")).filter("imported <> '' AND imported <> module")


def _edges_by_joins(files: DataFrame) -> DataFrame:
    """Edges of changes of any size. Instead of comparing every import with every module, both sides are looked up by
    their dotted prefixes, once per distinct imported name."""
    imported = written(_imported(files), "imports")
    # Names and their prefixes are counted one by one only if a change has many in all.
    parts = imported.groupBy(*KEY).agg(F.sum(F.size(F.split("imported", r"\."))).alias("n"))
    large = any_hot(parts)
    counts = imported.groupBy(*KEY, "imported").agg(F.count("*").alias("n"))

    known = (
        with_prefixes(files.select(*KEY, "module"), "module", "name")
        .groupBy(*KEY, "name")
        .agg(F.bool_or(F.col("name") == F.col("module")).alias("is_module"))
    )
    # All names below a package share its prefix.
    prefixes = with_prefixes(counts.select(*KEY, "imported"), "imported", "name")
    common = hot_keys(prefixes.groupBy(*KEY, "name").agg(F.count("*").alias("n")), [*KEY, "name"]) if large else None
    ours = (
        salted_join(prefixes, known, [*KEY, "name"], "inner", common, F.col("imported"))
        .filter("is_module OR name = imported")
        .select(*KEY, "imported")
        .distinct()
    )
    hot = hot_keys(counts, [*KEY, "imported"]) if large else None
    kept = salted_join(imported, ours, [*KEY, "imported"], "left_semi", hot, F.col("module"))
    # Most imports are not of the project: what repeats goes after they have gone.
    return kept.select(*KEY, F.col("module").alias("src"), F.col("imported").alias("dst")).distinct()


def _edges_in_tasks(files: DataFrame, n_names: int) -> DataFrame:
    """Edges of changes that fit in a task; a task gets their files with the distinct names each imports."""
    schema = T.StructType([files.schema[key] for key in KEY]).add("src", "string").add("dst", "string")
    dealt = files.withColumn("task", F.pmod(F.xxhash64(*KEY), F.lit(-(-n_names // TASK_NAMES))))
    return dealt.groupBy("task").applyInArrow(project_imports.find(KEY, to_arrow_schema(schema)), schema)


def edges(files: DataFrame) -> DataFrame:
    """Imports of project modules, one row per (src, dst).

    An imported name belongs to the project if it equals a module, lies below one, or is a package
    prefix of one. Tasks look through whole changes, as names are only compared inside one; changes with many modules or
    imports go through joins.
    """
    keyed = files.filter(" AND ".join(f"{column} IS NOT NULL" for column in (*KEY, "module")))
    names = F.coalesce(F.array_distinct(F.col("imports.module")), F.array().cast("array<string>"))
    named = keyed.select(*KEY, "module", names.alias("imported"))
    changes = named.groupBy(*KEY).agg(F.sum(F.size("imported") + 1).alias("n"))
    n_names, n_large = changes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > CHANGE_NAMES)).first()
    if not n_large:
        return _edges_in_tasks(named, max(1, n_names))
    large = written(changes.filter(F.col("n") > CHANGE_NAMES).select(*KEY, F.lit(True).alias("apart")), "large-changes")
    small = named.join(large, KEY, "left").filter("apart IS NULL").drop("apart")
    return _edges_in_tasks(small, max(1, n_names)).unionByName(_edges_by_joins(keyed.join(large, KEY, "left_semi")))


def resolved_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges whose imported name is resolved to a file: to the module of that name, to the package file of it
    (``name.__init__``), or to the longest part of it that is one of these. ``is_project`` tells that there is such a file;
    the other names stay as they are. Edges from a file to itself drop out, several names of one file are one edge.

    Every distinct name is looked up by its dotted prefixes in one equi-join, and the longest match is an aggregate.
    """
    package = F.regexp_replace("module", r"\.__init__$", "")
    known = modules.select(*KEY, F.explode(F.array_distinct(F.array("module", package))).alias("name"), "module")
    known = known.groupBy(*KEY, "name").agg(F.min(F.struct(F.col("name") != F.col("module"), "module"))["module"].alias("module"))
    counts = written(edges.groupBy(*KEY, "dst").agg(F.count("*").alias("n")), "imported-names")
    prefixes = with_prefixes(counts.select(*KEY, "dst"), "dst", "name")
    common = hot_keys(prefixes.groupBy(*KEY, "name").agg(F.count("*").alias("n")), [*KEY, "name"])
    found = salted_join(prefixes, known, [*KEY, "name"], "inner", common, F.col("dst"))
    longest = found.groupBy(*KEY, "dst").agg(F.max_by("module", F.length("name")).alias("module"))
    hot = hot_keys(counts, [*KEY, "dst"])
    joined = salted_join(edges, longest, [*KEY, "dst"], "left", hot, F.col("src"))
    named = joined.select(*KEY, "src", F.coalesce("module", "dst").alias("dst"), F.col("module").isNotNull().alias("is_project"))
    return named.filter("src <> dst").distinct()


def endpoints(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array("src", "dst")).alias("module")
    return edges.select(*KEY, ends).distinct()


def nodes(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Project modules and every other name an edge ends in, with ``path`` NULL for the latter."""
    other = endpoints(edges).withColumn("path", F.lit(None).cast("string"))
    return (
        modules.unionByName(other)
        .groupBy(*KEY, "module")
        .agg(F.max("path").alias("path"))
        .withColumn("is_project", F.col("path").isNotNull())
    )


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge totals of every change, in one aggregation over both tables."""
    marks = nodes.select(*KEY, F.lit(1).alias("node"), F.lit(0).alias("edge")).unionByName(
        edges.select(*KEY, F.lit(0).alias("node"), F.lit(1).alias("edge"))
    )
    return marks.groupBy(*KEY).agg(F.sum("node").alias("total_files"), F.sum("edge").alias("total_imports"))


def top_by_degree(edges: DataFrame, end: str, n: int = 5) -> DataFrame:
    """The ``n`` modules of every change with the most edges at ``end``: ``dst`` for the most imported,
    ``src`` for the most dependencies. Equal degrees are ordered by module name."""
    degrees = edges.groupBy(*KEY, F.col(end).alias("module")).agg(F.count("*").alias("degree"))
    order = W.partitionBy(*KEY).orderBy(F.desc("degree"), "module")
    return degrees.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)


def isolated_modules(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), [*KEY, "module"], "left_anti").select(*KEY, "module")
