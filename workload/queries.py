"""The registered queries: every operator over the whole tables of a scale directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelens import KEY
from changelens.functions import names
from changelens.functions.review_json import SEVERITIES
from changelens.functions.signature import hmac_sha256
from changelens.operators import cached_work, code_facts, comments, cycles, import_graph, ranking, reach, reviews
from changelens.operators.code_facts import FILE
from changelens.plans.asking import ask_until_done
from changelens.plans.review import error_log, pr_status
from changelens.sources import snapshots
from changelens.sources.review_cache import ReviewCache, cache_rows, latest
from changelens.sources.sinks import BatchOutput, publish
from changelens.storage import new_path, written
from changelens.streaming import event_reviews, hourly, webhooks
from workload import fixtures
from workload.inputs import SECRET, Inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(Inputs.of(spark, sf_dir))
    return build


def _joined(column: str) -> F.Column:
    return F.array_join(column, ",").alias(column)


# Sources and webhook events


@query
def pr_file_snapshot(t: Inputs) -> DataFrame:
    return t.snapshot


@query
def pr_without_python(t: Inputs) -> DataFrame:
    return snapshots.without_python(t.file_events)


def _routed(events: DataFrame) -> DataFrame:
    return webhooks.routed(fixtures.webhook_events(events, F.concat(
        F.lit("sha256="), hmac_sha256(SECRET, F.col("body")))), SECRET)


@query
def signed_events(t: Inputs) -> DataFrame:
    return _routed(t.table("events")).select(
        "event_id", "accepted", hmac_sha256(SECRET, F.col("body")).alias("digest")
    )


@query
def webhook_routing(t: Inputs) -> DataFrame:
    return _routed(t.table("events")).groupBy("route", "event", "action").agg(F.count("*").alias("n_events"))


# Code facts


@query
def code_functions(t: Inputs) -> DataFrame:
    return code_facts.functions(t.parsed).withColumn("args", _joined("args"))


@query
def code_classes(t: Inputs) -> DataFrame:
    return code_facts.classes(t.parsed).withColumns(
        {"methods": _joined("methods"), "base_classes": _joined("base_classes")}
    )


@query
def code_imports(t: Inputs) -> DataFrame:
    return code_facts.imports(t.parsed).withColumn("names", _joined("names"))


@query
def code_syntax_errors(t: Inputs) -> DataFrame:
    return code_facts.syntax_errors(t.parsed)


@query
def code_file_summary(t: Inputs) -> DataFrame:
    return code_facts.file_summary(t.parsed)


@query
def file_max_complexity(t: Inputs) -> DataFrame:
    return code_facts.file_max_complexity(t.parsed)


@query
def complexity_bands(t: Inputs) -> DataFrame:
    return code_facts.complexity_bands(t.parsed)


# Import graph


@query
def module_names(t: Inputs) -> DataFrame:
    """Three names of the paths ``<status>/./<repo>/mod_<order>.py`` and ``.../__init__.py``."""
    folder = F.concat_ws("/", "status", F.lit("."), "repo")
    leaf = F.when(F.col("status") == "added", "__init__.py").otherwise(F.col("filename"))
    return t.file_events.withColumn("path", F.concat(folder, F.lit("/"), leaf)).select(
        *KEY, "path", "filename",
        names.module_name(F.col("path")).alias("module"),
        names.tree_module_name(F.col("path")).alias("tree_module"),
        names.ranking_name(F.col("path")).alias("ranking_name"),
    )


@query
def import_edges(t: Inputs) -> DataFrame:
    return t.graphs.edges


@query
def graph_nodes(t: Inputs) -> DataFrame:
    return t.graphs.nodes


@query
def graph_stats(t: Inputs) -> DataFrame:
    return import_graph.graph_stats(t.graphs.nodes, t.graphs.edges)


@query
def top_imported(t: Inputs) -> DataFrame:
    return import_graph.top_by_degree(t.graphs.edges, "dst")


@query
def top_dependencies(t: Inputs) -> DataFrame:
    return import_graph.top_by_degree(t.graphs.edges, "src")


@query
def isolated_modules(t: Inputs) -> DataFrame:
    return import_graph.isolated_modules(t.graphs.nodes, t.graphs.edges)


@query
def graph_cycles(t: Inputs) -> DataFrame:
    return cycles.simple_cycles(t.graphs.folded, t.graphs.ancestry)


@query
def has_cycles(t: Inputs) -> DataFrame:
    return reach.has_cycles(t.graphs.nodes, t.graphs.reach)


@query
def module_impact(t: Inputs) -> DataFrame:
    """What a change of the most imported module of each change affects."""
    starts = import_graph.top_by_degree(t.graphs.edges, "dst", 1)
    return reach.impact(starts, t.graphs.folded, t.graphs.ancestry)


@query
def module_dependencies(t: Inputs) -> DataFrame:
    """What the module with the most imports of each change depends on."""
    starts = import_graph.top_by_degree(t.graphs.edges, "src", 1)
    return reach.dependencies(starts, t.graphs.folded, t.graphs.ancestry)


@query
def file_impact_sets(t: Inputs) -> DataFrame:
    """What a change of each file affects."""
    return reach.impact(t.graphs.nodes, t.graphs.folded, t.graphs.ancestry)


@query
def file_dependency_sets(t: Inputs) -> DataFrame:
    """What each file depends on, found by a search from all files at once."""
    return reach.dependencies(t.graphs.nodes, t.graphs.folded)


@query
def cycle_flags(t: Inputs) -> DataFrame:
    """Nodes and edges in one table; a node has no ``dst``."""
    nodes = reach.node_flags(t.graphs.nodes, t.graphs.reach)
    edges = reach.edge_flags(t.graphs.edges, t.graphs.reach)
    return nodes.select(
        *KEY, F.col("module").alias("src"), F.lit(None).cast("string").alias("dst"), "in_cycle"
    ).unionByName(edges)


@query
def impact_counts(t: Inputs) -> DataFrame:
    files = t.parsed.select(*FILE, names.ranking_name(F.col("filename")).alias("ranking_name"))
    return reach.impact_counts(files, t.graphs.reach).select(*FILE, "impact")


@query
def package_edges(t: Inputs) -> DataFrame:
    """Imports of packages, and of names below modules, by their prefixes."""
    return t.packages.edges


@query
def package_nodes(t: Inputs) -> DataFrame:
    """Files, and imported names that are no file."""
    return t.packages.nodes


@query
def package_impact(t: Inputs) -> DataFrame:
    return t.packages.reach


@query
def package_impact_sets(t: Inputs) -> DataFrame:
    """What a change of each node affects."""
    return reach.impact(t.packages.nodes, t.packages.folded)


@query
def resolved_edges(t: Inputs) -> DataFrame:
    """Imports resolved to files, and names that no file fits."""
    files = import_graph.graph_files(written(code_facts.code_facts(fixtures.resolvable_files(t.spark, t.sf_dir)), "resolvable-facts"))
    return import_graph.resolved_edges(import_graph.edges(files), import_graph.modules(files))


# The same on a denser graph with few, large changes


@query
def layered_impact(t: Inputs) -> DataFrame:
    """Impact count and cycle membership of every module."""
    return t.layered_reach


@query
def layered_cycles(t: Inputs) -> DataFrame:
    """Each cycle as one row."""
    inside = F.sort_array(F.collect_list(F.struct("pos", "module")))["module"]
    listed = cycles.simple_cycles(t.layered, t.layered_ancestry).groupBy(*KEY, "cycle").agg(inside.alias("m"))
    return listed.select(*KEY, F.array_join("m", ",").alias("modules"))


@query
def overlapping_cycles(t: Inputs) -> DataFrame:
    """Each cycle as its modules in order, from the smallest one on."""
    inside = F.sort_array(F.collect_list(F.struct("pos", "module")))["module"]
    cycles_ = cycles.simple_cycles(t.chorded).groupBy(*KEY, "cycle").agg(inside.alias("m"))
    low = F.array_position("m", F.array_min("m")).cast("int")
    turned = F.concat(F.slice("m", low, F.size("m")), F.slice("m", F.lit(1), low - 1))
    return cycles_.select(*KEY, F.array_join(turned, ">").alias("modules"), F.size("m").alias("length"))


@query
def ladder_cycles(t: Inputs) -> DataFrame:
    """Cycles of links in a row, each of two ways round; a path forth never comes back but by its own link."""
    inside = F.sort_array(F.collect_list("module")).alias("m")
    listed = cycles.simple_cycles(t.ladders).groupBy(*KEY, "cycle").agg(inside)
    return listed.select(*KEY, F.array_join("m", ",").alias("modules"))


@query
def layered_dependencies(t: Inputs) -> DataFrame:
    """What the five modules with the most imports depend on."""
    return reach.dependencies(import_graph.top_by_degree(t.layered_edges, "src"), t.layered, t.layered_ancestry)


@query
def layered_edge_flags(t: Inputs) -> DataFrame:
    return reach.edge_flags(t.layered_edges, t.layered_reach)


# Ranking


@query
def priority_scores(t: Inputs) -> DataFrame:
    return t.scores.select(*FILE, "complexity", "dependencies", "lines_changed", "score")


@query
def review_queue(t: Inputs) -> DataFrame:
    return t.queue.select(*FILE, "rank", "score")


@query
def queue_next(t: Inputs) -> DataFrame:
    return ranking.queue_next(t.scores).select(*FILE, "score")


@query
def queue_rest(t: Inputs) -> DataFrame:
    return ranking.queue_rest(t.scores).select(*FILE, "score")


@query
def queue_size(t: Inputs) -> DataFrame:
    return ranking.queue_size(t.scores)


# Cache


@query
def content_hashes(t: Inputs) -> DataFrame:
    return t.parsed.select(*FILE, "content_hash")


@query
def cache_upsert(t: Inputs) -> DataFrame:
    old = cache_rows(fixtures.labelled_entries(t.spark, t.sf_dir))
    new = cache_rows(fixtures.other_entries(t.spark, t.sf_dir))
    merged = latest(old.unionByName(new))
    return merged.select("content_hash", "review", F.unix_timestamp("created_at").alias("created_at"))


@query
def cache_lookup(t: Inputs) -> DataFrame:
    found = cached_work.cache_lookup(t.document_files, t.document_cache)
    return found.select("pr_number", "content_hash", "review", F.col("review").isNotNull().alias("has_review"))


@query
def cache_split(t: Inputs) -> DataFrame:
    return cached_work.cache_split(t.queue, t.modified_cache).select(*FILE, "rank", "is_cached")


@query
def review_plan(t: Inputs) -> DataFrame:
    """Plan for all documents, many of which are copies of each other."""
    plan = cached_work.review_plan(t.document_files, t.document_cache)
    return plan.select(*FILE, "action", "from_repo", "from_pr_number", "from_filename")


@query
def queue_review_plan(t: Inputs) -> DataFrame:
    """Plan for the review queue of all changes."""
    plan = cached_work.review_plan(t.queue, t.modified_cache)
    return plan.select(*FILE, "action", "from_repo", "from_pr_number", "from_filename")


def _cache(t: Inputs) -> ReviewCache:
    """A cache written in two batches."""
    cache = ReviewCache.create(t.spark, new_path(t.spark, "review-cache"))
    cache.append(cache_rows(fixtures.labelled_entries(t.spark, t.sf_dir)), 0)
    cache.append(cache_rows(fixtures.other_entries(t.spark, t.sf_dir)), 1)
    return cache


@query
def cache_replay(t: Inputs) -> DataFrame:
    """A compacted cache, opened anew: its entries, and those from before the last batch, for a replay."""
    cache = _cache(t)
    cache.compact()
    again = ReviewCache(t.spark, cache.root)
    before, after = again.entries(before_batch=1), again.entries()
    states = [rows.select(F.lit(state).alias("state"), "content_hash", "review") for state, rows in (("before", before), ("after", after))]
    return states[0].unionByName(states[1])


@query
def cache_cleared(t: Inputs) -> DataFrame:
    """A cache that was cleared and written again."""
    cache = _cache(t)
    cache.clear()
    cache.append(cache_rows(fixtures.labelled_entries(t.spark, t.sf_dir)), 2)
    return cache.entries().select("content_hash", "review")


@query
def cache_stats(t: Inputs) -> DataFrame:
    """A cache written in two batches, then counted."""
    cache = _cache(t)
    return cache.stats().select("entries", (F.col("files") > 0).alias("on_disk"), (F.col("location") == cache.root).alias("in_place"))


# Reviews


@query
def oversize_files(t: Inputs) -> DataFrame:
    """Every file holds a document four times, so that some are too long."""
    files = t.document_files.withColumn("n_chars", 4 * F.col("n_chars"))
    refused = reviews.oversize_reviews(files).select(*FILE, "summary", "overall_score")
    sent = files.filter(~reviews.oversize(F.col("n_chars"))).select(
        *FILE, F.lit(None).cast("string").alias("summary"), F.lit(None).cast("int").alias("overall_score")
    )
    return refused.unionByName(sent)


@query
def review_requests(t: Inputs) -> DataFrame:
    plan = cached_work.review_plan(t.queue, t.modified_cache)
    return reviews.review_requests(plan, t.parsed, t.source_files)


@query
def review_cost(t: Inputs) -> DataFrame:
    return reviews.review_costs(t.document_files)


@query
def review_spend(t: Inputs) -> DataFrame:
    """Cost of all documents, by change, by repository and in all."""
    return reviews.review_spend(reviews.review_costs(t.document_files))


@query
def review_retries(t: Inputs) -> DataFrame:
    """All documents reviewed, copies once; where the answer for one is no review, the next copy is asked for."""
    plan = written(cached_work.review_plan(t.document_files, t.document_cache), "plan")
    answers = fixtures.document_answers(t.spark, t.sf_dir)
    done = ask_until_done(plan, lambda files, _: answers.join(files.select(*FILE), FILE, "left_semi"))
    found = done.reviews.select(*FILE, "error_kind", "reported_filename", "overall_score")
    return plan.select(*FILE, "action").join(done.asked.select(*FILE, "round"), FILE, "left").join(found, FILE, "left")


@query
def review_ingest(t: Inputs) -> DataFrame:
    return t.ingested.select(
        *FILE, "error_kind", "reported_filename", "summary", "overall_score", F.size("issues").alias("n_issues"),
        F.array_join(F.col("issues.message"), "|").alias("messages"),
        F.array_join(F.col("issues.severity"), "|").alias("severities"),
    )


@query
def long_line_numbers(t: Inputs) -> DataFrame:
    """Answers with line numbers of more than 64 bits, read, kept in a cache and read again."""
    read = reviews.reviews(reviews.ingest(fixtures.long_lines(t.spark, t.sf_dir)))
    kept = read.select(*FILE, "error_kind", reviews.review_json_text().alias("review"))
    again = reviews.read_reviews(kept, "review", FILE)
    lines = F.array_join(F.transform("issues", lambda i: F.coalesce(i["line"].cast("string"), i["line_digits"])), ",")
    return again.select(*FILE, "error_kind", F.col("issues")[0]["line"].alias("first_line"), lines.alias("lines"))


@query
def ingested_reviews(t: Inputs) -> DataFrame:
    return reviews.reviews(t.ingested).select(
        *FILE, "reported_filename", "summary", "overall_score", F.size("issues").alias("n_issues")
    )


@query
def review_failures(t: Inputs) -> DataFrame:
    return reviews.failure_counts(t.ingested)


@query
def severity_counts(t: Inputs) -> DataFrame:
    return reviews.severity_counts(t.reviews, t.issues).select(*FILE, *SEVERITIES)


@query
def critical_files(t: Inputs) -> DataFrame:
    return reviews.critical_files(t.issues)


@query
def score_bands(t: Inputs) -> DataFrame:
    return reviews.score_bands(t.reviews)


@query
def inline_comments(t: Inputs) -> DataFrame:
    return comments.inline_comments(t.issues).select(*KEY, "path", "line", "body")


@query
def published_issues(t: Inputs) -> DataFrame:
    """All issues as an output table, read back."""
    path = new_path(t.spark, "issues-out")
    publish(t.issues, path)
    return t.spark.read.schema(t.issues.schema).parquet(path).select(
        *FILE, "line", "severity", "category", "message", "suggestion")


@query
def pr_summary(t: Inputs) -> DataFrame:
    return comments.pr_summaries(t.queue, t.reviews, t.issues)


@query
def pr_issue_totals(t: Inputs) -> DataFrame:
    return reviews.issue_totals(t.reviews, t.issues)


@query
def publish_results(t: Inputs) -> DataFrame:
    return comments.publish_results(fixtures.deliveries(t.spark, t.sf_dir))


@query
def delivery_errors(t: Inputs) -> DataFrame:
    return comments.delivery_errors(fixtures.deliveries(t.spark, t.sf_dir))


# Whole review


@query
def pr_status_all(t: Inputs) -> DataFrame:
    """Status of every change over the files its snapshot delivers."""
    split = cached_work.cache_split(t.snapshot_queue, t.modified_cache)
    changes = t.file_events.select(*KEY).distinct()
    return pr_status(changes, t.snapshot_facts, split, error_log(t.snapshot_facts))


QUERIES["pr_status"] = QUERIES.pop("pr_status_all")


@query
def error_log_all(t: Inputs) -> DataFrame:
    answered = t.ingested.join(t.queue.select(*FILE), FILE, "left_semi")
    return error_log(t.parsed, answered)


QUERIES["error_log"] = QUERIES.pop("error_log_all")


@query
def change_reviews(t: Inputs) -> DataFrame:
    """Reviews of all queued files: cached, answered, or taken over from a file with the same content."""
    return t.done.reviews.select(
        *FILE, "rank", "action", "error_kind", "reported_filename", "summary", "overall_score", F.size("issues").alias("n_issues"))


@query
def change_comments(t: Inputs) -> DataFrame:
    return t.done.comments().select(*KEY, "path", "line", "body")


@query
def change_summaries(t: Inputs) -> DataFrame:
    return t.done.summaries()


@query
def change_totals(t: Inputs) -> DataFrame:
    return t.done.totals()


@query
def change_errors(t: Inputs) -> DataFrame:
    """Errors of all steps, those of publishing too."""
    return t.done.errors(t.parsed, fixtures.posting_errors(t.spark, t.sf_dir))


def _streamed(t: Inputs) -> str:
    """The event table as a stream: signed events, routed, reviewed. Returns the folder of the outputs."""
    t.source_files, t.responses  # the tables a stream reads exist before it starts
    raw = (
        t.spark.readStream.schema(t.table("events").schema).option("pathGlobFilter", "events.parquet")
        .parquet(t.sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    )
    events = fixtures.webhook_events(raw, F.concat(F.lit("sha256="), hmac_sha256(SECRET, F.col("body"))))
    out = new_path(t.spark, "stream")
    review = webhooks.WebhookReview(
        file_events=lambda: t.file_events, contents=lambda: t.source_files, answers=lambda: t.responses,
        cache=ReviewCache.create(t.spark, f"{out}/cache"), out=out, secret=SECRET,
    )
    webhooks.start(events, review, f"{out}/checkpoint").awaitTermination()
    return out


@query
def events_hourly(t: Inputs) -> DataFrame:
    """Events an hour from a stream that is started anew for each part of the deliveries."""
    parts = written(fixtures.deliveries_in_parts(t.spark, t.sf_dir), "deliveries")
    root = new_path(t.spark, "hourly")
    output = BatchOutput.create(t.spark, f"{root}/out")
    arriving = parts.drop("part")
    for part in range(fixtures.PARTS):
        parts.filter(F.col("part") == part).drop("part").write.mode("append").parquet(f"{root}/in")
        stream = t.spark.readStream.schema(arriving.schema).parquet(f"{root}/in")
        hourly.start_counts(stream, output, f"{root}/checkpoint").awaitTermination()
    found = output.rows(T.StructType.fromDDL(hourly.COUNTS))
    return found.select("repo", "event", F.unix_timestamp("hour").alias("hour"), "n_events")


@query
def stream_pr_status(t: Inputs) -> DataFrame:
    return t.spark.read.parquet(f"{_streamed(t)}/status").drop("batch")


@query
def stream_summaries(t: Inputs) -> DataFrame:
    return t.spark.read.parquet(f"{_streamed(t)}/summaries").drop("batch")


#: Parts in which the events arrive, one micro-batch each.
EVENT_PARTS = 3


def _reviewed_by_event(t: Inputs) -> event_reviews.EventReviews:
    """The event table as a stream of several parts; every event is a review of its own."""
    if (made := t.made.get("event-reviews")) is not None:
        return made
    events = t.table("events").withColumn("ts", F.col("ts").cast("timestamp"))
    root = new_path(t.spark, "event-stream")
    files, contents, answers = t.file_events_by_repository, t.files_by_repository, t.responses_by_repository
    review = event_reviews.EventReviews(
        file_events=lambda: files, contents=lambda: contents, answers=lambda: answers, cache=ReviewCache.create(t.spark, f"{root}/cache"),
        status=BatchOutput.create(t.spark, f"{root}/status"), reviews=BatchOutput.create(t.spark, f"{root}/reviews"),
    )
    last = events.agg(F.max("event_id")).first()[0]
    part = F.floor(F.col("event_id") * EVENT_PARTS / (last + 1))
    for n in range(EVENT_PARTS):
        events.filter(part == n).write.mode("append").parquet(f"{root}/in")
        raw = t.spark.readStream.schema(events.schema).parquet(f"{root}/in")
        signed = fixtures.webhook_events(raw, F.concat(F.lit("sha256="), hmac_sha256(SECRET, F.col("body"))))
        event_reviews.start(signed, SECRET, review, f"{root}/checkpoint").awaitTermination()
    t.made["event-reviews"] = review
    return review


@query
def event_status(t: Inputs) -> DataFrame:
    """Status of every review that an event started."""
    found = _reviewed_by_event(t).status.rows(T.StructType.fromDDL(event_reviews.STATUS))
    return found.drop("batch", "ts")


@query
def event_review_scores(t: Inputs) -> DataFrame:
    """The reviews that each event ended with."""
    schema = T.StructType.fromDDL(event_reviews.REVIEWS)
    return _reviewed_by_event(t).reviews.rows(schema).select(
        "event_id", *FILE, "rank", "reported_filename", "summary", "overall_score", F.size("issues").alias("n_issues"))
