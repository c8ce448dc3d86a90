"""The whole review of all changes at once: facts, graph, ranking, cache split, status and errors."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens import KEY
from changelens.operators import import_graph, ranking, reach
from changelens.operators.chains import FoldedGraph, fold_chains
from changelens.operators.code_facts import FILE, analyzed
from changelens.storage import written

# How the errors of each step begin.
PARSER_ERROR = "AST error in "
GRAPH_ERROR = "Graph error: "
REVIEW_ERROR = "Review error in "
POSTING_ERROR = "Comment posting error: "


@dataclass
class ImportGraphs:
    """Graphs of all changes in a facts table. Each part is written once, when first needed."""

    facts: DataFrame

    @cached_property
    def files(self) -> DataFrame:
        return import_graph.graph_files(self.facts)

    @cached_property
    def edges(self) -> DataFrame:
        return written(import_graph.edges(self.files), "edges")

    @cached_property
    def nodes(self) -> DataFrame:
        return import_graph.nodes(import_graph.modules(self.files), self.edges)

    @cached_property
    def folded(self) -> FoldedGraph:
        return fold_chains(self.edges)

    @cached_property
    def ancestry(self) -> reach.Ancestry:
        return reach.ancestry(self.folded)

    @cached_property
    def reach(self) -> DataFrame:
        return written(reach.module_reach(self.folded, self.ancestry), "reach")


def priority_scores(facts: DataFrame, graphs: ImportGraphs | None = None) -> DataFrame:
    return ranking.priority_scores(facts, (graphs or ImportGraphs(facts)).reach)


def error_log(facts: DataFrame, ingested: DataFrame | None = None, posting_errors: DataFrame | None = None) -> DataFrame:
    """Every error as ``(key, step, filename, message)``; steps are numbered in the order they run. One step
    failing for a file or change never stops the others."""
    syntax = F.col("error_kind") == "syntax"
    parse = facts.filter("error_kind IS NOT NULL").select(
        *KEY, F.lit(1).alias("step"), "filename",
        F.concat(
            F.when(syntax, F.lit("")).otherwise(F.lit(PARSER_ERROR)), F.col("filename"), F.lit(": "),
            F.coalesce("error_message", F.lit("")),
        ).alias("message"),
    )
    # A graph fails on its first unreadable file.
    graph = facts.filter("error_kind = 'parser'").groupBy(*KEY).agg(
        F.min(F.struct("filename", "error_message")).alias("first")
    ).select(
        *KEY, F.lit(2).alias("step"), F.lit(None).cast("string").alias("filename"),
        F.concat(F.lit(GRAPH_ERROR), F.coalesce("first.error_message", F.lit(""))).alias("message"),
    )
    log = parse.unionByName(graph)
    if ingested is not None:
        refused = ingested.filter("error_kind = 'not_object'")
        log = log.unionByName(refused.select(
            *KEY, F.lit(5).alias("step"), "filename",
            F.concat(F.lit(REVIEW_ERROR), F.col("filename"), F.lit(": "), F.col("error_detail")).alias("message"),
        ))
    if posting_errors is not None:
        log = log.unionByName(posting_errors.select(
            *KEY, F.lit(6).alias("step"), F.lit(None).cast("string").alias("filename"),
            F.concat(F.lit(POSTING_ERROR), F.col("message")).alias("message"),
        ))
    return log


def pr_status(changes: DataFrame, facts: DataFrame, split: DataFrame, errors: DataFrame) -> DataFrame:
    """One row per change: files analysed (broken ones too), queued for review, cached, and errors. All
    tables are counted in a single aggregation; a change without files has status ``no_python_files``."""

    def marks(table: DataFrame, **columns) -> DataFrame:
        zero = {name: F.lit(0) for name in ("files", "analyzed", "to_review", "cached", "errors")} | columns
        return table.select(*KEY, *[c.cast("int").alias(n) for n, c in zero.items()])

    one = F.lit(1)
    every = (
        marks(changes)
        .unionByName(marks(facts, files=one))
        .unionByName(marks(analyzed(facts), analyzed=one))
        .unionByName(marks(split, to_review=~F.col("is_cached"), cached=F.col("is_cached")))
        .unionByName(marks(errors, errors=one))
    )
    return every.groupBy(*KEY).agg(
        F.when(F.sum("files") > 0, "processed").otherwise("no_python_files").alias("status"),
        F.sum("analyzed").alias("files_analyzed"), F.sum("to_review").alias("files_to_review"),
        F.sum("cached").alias("cached"), F.sum("errors").alias("errors"),
    )


def files_of(facts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Facts of the files in a snapshot, with the snapshot's changed lines."""
    return facts.drop("lines_changed").join(snapshot.select(*FILE, "lines_changed"), FILE)


def with_lines_changed(facts: DataFrame, snapshot: DataFrame) -> DataFrame:
    """All facts, with changed lines where the snapshot has an entry."""
    return facts.drop("lines_changed").join(snapshot.select(*FILE, "lines_changed"), FILE, "left")
