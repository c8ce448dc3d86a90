"""Expected results in DuckDB SQL over the given tables.

What a parser should find follows from the generator parameters (`workload.fixtures`), so nothing here
reads code: functions, lines, imports, edges and cycles are computed from orders and line items.
"""

from __future__ import annotations

from workload.fixtures import (
    CHORDED_EDGES, DELIVERIES, DELIVERIES_IN_PARTS, FILE_KEY, FILE_SOURCE, FUNCTION_SOURCE, ISSUE_JSON, LABELLED_ENTRIES, LAYERED_EDGES, LINES,
    MODEL_RESPONSES, ORDERED, OTHER_ENTRIES, POSTING_ERRORS, PR_FILE_EVENTS, REVIEW_ISSUES, REVIEWS, SEVERITY, WEBHOOK_EVENTS,
)

SECRET = b"webhook-secret"


def sql(*steps: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(steps) + "\n" + select


LI = f"li AS MATERIALIZED ({LINES})"
ORD = f"ord AS MATERIALIZED ({ORDERED})"
F2 = f"f2 AS MATERIALIZED ({PR_FILE_EVENTS})"
SNAPSHOT = """snap AS MATERIALIZED (SELECT repo, pr_number, filename, status,
  coalesce(additions, 0) + coalesce(deletions, 0) AS lines_changed FROM f2 WHERE filename LIKE '%.py' AND status <> 'removed')"""

# Every generated file with what its text must contain.
FILES = f"""f AS MATERIALIZED (SELECT {FILE_KEY}, 'mod_' || o_orderkey AS module, o_orderkey, prev_key, last_key,
  o_orderkey % 50 = 0 AS broken, o_orderkey % 4 = 0 AS has_class,
  o_custkey % 10 = 0 AND o_orderkey = first_key AND last_key <> first_key AS closes,
  2 + (prev_key IS NOT NULL)::INT + (o_custkey % 10 = 0 AND o_orderkey = first_key AND last_key <> first_key)::INT AS import_lines
  FROM ord)"""
FN = """fn AS MATERIALIZED (SELECT l_orderkey, k, rf, 1 + n_if + CASE rf WHEN 'R' THEN 3 WHEN 'N' THEN 1 ELSE 0 END AS complexity,
  2 + 2 * n_if + CASE rf WHEN 'R' THEN 2 WHEN 'N' THEN 4 ELSE 0 END AS n_lines FROM li)"""
FUNCTIONS = """functions AS MATERIALIZED (
  SELECT repo, pr_number, filename, CAST(k - 1 AS INT) AS pos, 'f_' || k AS name, CAST(upto - n_lines + 1 AS INT) AS line_start,
    CAST(upto AS INT) AS line_end, 'a,b' AS args, CAST(complexity AS INT) AS complexity, rf = 'A' AS is_async
  FROM (SELECT *, import_lines + 3 * has_class::INT + sum(n_lines) OVER (PARTITION BY l_orderkey ORDER BY k) AS upto
        FROM f JOIN fn ON l_orderkey = o_orderkey WHERE NOT broken)
  UNION ALL
  SELECT repo, pr_number, filename, CAST((SELECT count(*) FROM fn WHERE l_orderkey = o_orderkey) AS INT), 'm', import_lines + 2, import_lines + 3, 'self', 2, FALSE
  FROM f WHERE has_class AND NOT broken)"""
IMPORTS = """imports AS MATERIALIZED (
  SELECT repo, pr_number, filename, pos, module, names, line, is_from_import FROM (
    SELECT f.*EXCLUDE (module), 0 AS pos, 'os' AS module, 'os' AS names, 1 AS line, FALSE AS is_from_import FROM f
    UNION ALL SELECT f.*EXCLUDE (module), 1, 'sys', 'system', 2, FALSE FROM f
    UNION ALL SELECT f.*EXCLUDE (module), 2, 'json', 'json', 2, FALSE FROM f
    UNION ALL SELECT f.*EXCLUDE (module), 3, 'mod_' || prev_key, 'f_1,f_2', 3, TRUE FROM f WHERE prev_key IS NOT NULL
    UNION ALL SELECT f.*EXCLUDE (module), 3, 'mod_' || last_key, 'mod_' || last_key, 3, FALSE FROM f WHERE closes)
  WHERE NOT broken)"""
SUMMARY = """summary AS MATERIALIZED (SELECT repo, pr_number, filename, broken,
    CAST(import_lines + broken::INT + 3 * has_class::INT + coalesce(l.n_lines, 0) AS INT) AS total_lines,
    coalesce(CASE WHEN NOT broken THEN CAST(format('{:.2f}', a.cx / a.n) AS DOUBLE) END, 0.0) AS avg_complexity,
    CAST(CASE WHEN broken THEN 0 ELSE coalesce(a.n, 0) END AS INT) AS n_functions,
    CAST((has_class AND NOT broken) AS INT) AS n_classes,
    CASE WHEN broken THEN 0 ELSE 3 + (prev_key IS NOT NULL)::INT + closes::INT END AS n_imports,
    CAST(coalesce(a.mx, 1) AS INT) AS max_complexity
  FROM f LEFT JOIN (SELECT l_orderkey, sum(n_lines) AS n_lines FROM fn GROUP BY 1) l ON l_orderkey = o_orderkey
  LEFT JOIN (SELECT repo, pr_number, filename, sum(complexity) AS cx, count(*) AS n, max(complexity) AS mx FROM functions GROUP BY 1, 2, 3) a USING (repo, pr_number, filename))"""
PARSED = [LI, ORD, FILES, FN, FUNCTIONS, SUMMARY]
EDGES = """edges AS MATERIALIZED (
  SELECT repo, pr_number, module AS src, 'mod_' || prev_key AS dst FROM f WHERE prev_key IS NOT NULL AND NOT broken
  UNION SELECT repo, pr_number, module, 'mod_' || last_key FROM f WHERE closes AND NOT broken)"""
GRAPH = [ORD, FILES, EDGES]
# Only the files of the snapshot; imports of missing files leave the project.
SNAP_GRAPH = [
    F2, SNAPSHOT, ORD, FILES.replace("f AS", "all_f AS", 1),
    "f AS MATERIALIZED (SELECT * FROM all_f SEMI JOIN snap USING (repo, pr_number, filename))",
    EDGES.replace("edges AS", "all_edges AS", 1),
    "edges AS MATERIALIZED (SELECT * FROM all_edges e WHERE EXISTS (SELECT 1 FROM f WHERE f.repo = e.repo AND f.pr_number = e.pr_number AND f.module = e.dst))",
]
CLOSURE = """closure AS (SELECT repo, pr_number, src, dst FROM edges
  UNION SELECT c.repo, c.pr_number, c.src, e.dst FROM closure c JOIN edges e ON e.repo = c.repo AND e.pr_number = c.pr_number AND e.src = c.dst)"""
IMPACT = """impact AS MATERIALIZED (SELECT f.repo, f.pr_number, f.filename, count(DISTINCT c.src) AS impact
  FROM f LEFT JOIN closure c ON c.repo = f.repo AND c.pr_number = f.pr_number AND c.dst = f.module AND c.src <> f.module GROUP BY ALL)"""
ON_CYCLE = "on_cycle AS MATERIALIZED (SELECT repo, pr_number, src AS module FROM closure WHERE src = dst)"


def degrees(end: str, n: int) -> str:
    return f"""top AS (SELECT repo, pr_number, module, degree, CAST(position AS INT) AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, pr_number ORDER BY degree DESC, module) AS position
  FROM (SELECT repo, pr_number, {end} AS module, count(*) AS degree FROM edges GROUP BY ALL)) WHERE position <= {n})"""

LAYERED = f"edges AS MATERIALIZED ({LAYERED_EDGES})"
ENDS = "ends AS MATERIALIZED (SELECT repo, pr_number, src AS module FROM edges UNION SELECT repo, pr_number, dst FROM edges)"

# No file has the name of a package or lies below another file, so every import ends in a name that is no file.
PACKAGES = """members AS MATERIALIZED (SELECT 'org/packages' AS repo, CAST(s_nationkey % 5 AS BIGINT) AS pr_number, s_nationkey AS nation,
    concat('app.r', s_nationkey % 5, '.n', s_nationkey) AS package, concat(package, '.s_', s_suppkey) AS module,
    concat('app/r', s_nationkey % 5, '/n', s_nationkey, '/s_', s_suppkey, '.py') AS path FROM supplier),
package_edges AS MATERIALIZED (SELECT repo, pr_number, module AS src, package AS dst FROM members
  UNION ALL SELECT repo, pr_number, module, module || '.tools' FROM members
  UNION ALL SELECT m.repo, m.pr_number, m.module, o.package FROM members m
    JOIN (SELECT DISTINCT nation, package FROM members) o ON o.nation = (m.nation + 5) % 25)"""

SCORES = """scores AS MATERIALIZED (SELECT *, complexity * 2 + dependencies + CAST(lines_changed AS DOUBLE) / 10 AS score FROM (
  SELECT s.repo, s.pr_number, s.filename, s.max_complexity AS complexity, i.impact AS dependencies,
    CAST(coalesce(snap.lines_changed, s.total_lines) AS BIGINT) AS lines_changed
  FROM summary s JOIN impact i USING (repo, pr_number, filename) LEFT JOIN snap USING (repo, pr_number, filename) WHERE NOT s.broken))"""
QUEUE = """queue AS MATERIALIZED (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY repo, pr_number ORDER BY score DESC, filename) AS INT) AS rank
  FROM scores) WHERE rank <= 5)"""
RANKED = [*PARSED, F2, SNAPSHOT, EDGES, CLOSURE, IMPACT, SCORES]

# Texts and hashes.
CODE = f"""code AS MATERIALIZED (WITH fn AS (SELECT l_orderkey, string_agg(src, '' ORDER BY k) AS body FROM ({FUNCTION_SOURCE}) t GROUP BY l_orderkey)
  SELECT *, sha256(code) AS content_hash FROM ({FILE_SOURCE}))"""
RESPONSES = f"""answers AS MATERIALIZED (WITH js AS (SELECT l_orderkey, string_agg(src, ',' ORDER BY k) AS issues FROM ({ISSUE_JSON}) t GROUP BY l_orderkey)
  {MODEL_RESPONSES})"""
# How each generated answer must be read: by the kind it was generated as.
INGESTED = f"""ingested AS MATERIALIZED (SELECT *, CASE kind WHEN 4 THEN 8 WHEN 99 THEN CAST(o_orderkey % 11 AS INT) END AS score FROM (
  SELECT {FILE_KEY}, o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 20 <= 5 THEN o_orderkey % 20 ELSE 99 END AS kind,
  CASE o_orderkey % 20 WHEN 0 THEN 'invalid_json' WHEN 5 THEN 'invalid_json' WHEN 1 THEN 'not_object'
    WHEN 2 THEN 'invalid_schema' WHEN 3 THEN 'invalid_schema' ELSE 'ok' END AS error_kind FROM orders))"""
ISSUE_LISTS = f"""lists AS MATERIALIZED (SELECT l_orderkey, CAST(count(*) AS INT) AS n_issues, string_agg('part ' || l_partkey, '|' ORDER BY k) AS messages,
  string_agg(severity, '|' ORDER BY k) AS severities FROM (SELECT *, CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity FROM li) GROUP BY 1)"""
MODIFIED_HASHES = """hashes AS MATERIALIZED (SELECT DISTINCT content_hash FROM code
  SEMI JOIN (SELECT repo, pr_number, filename FROM f2 WHERE status = 'modified') m USING (repo, pr_number, filename)
  SEMI JOIN (SELECT * FROM ingested WHERE error_kind <> 'not_object') i USING (repo, pr_number, filename))"""
SPLIT = "split AS MATERIALIZED (SELECT q.*, c.content_hash, h.content_hash IS NOT NULL AS is_cached FROM queue q JOIN code c USING (repo, pr_number, filename) LEFT JOIN hashes h ON h.content_hash = c.content_hash)"
CACHED = [CODE, INGESTED, MODIFIED_HASHES, QUEUE, SPLIT]
PLAN = """plan AS MATERIALIZED (SELECT *, CASE WHEN is_cached THEN 'cached' WHEN nth = 1 THEN 'review' ELSE 'reuse' END AS action FROM (
  SELECT *, row_number() OVER same AS nth, first_value(repo) OVER same AS first_repo, first_value(pr_number) OVER same AS first_pr, first_value(filename) OVER same AS first_file
  FROM split WINDOW same AS (PARTITION BY content_hash ORDER BY repo, pr_number, rank, filename)))"""
PLAN_COLUMNS = """SELECT repo, pr_number, filename, action, CASE WHEN action <> 'cached' THEN first_repo END AS from_repo,
  CASE WHEN action <> 'cached' THEN first_pr END AS from_pr_number, CASE WHEN action <> 'cached' THEN first_file END AS from_filename FROM plan"""

# The review each planned file ends with: that of the greatest entry of its content in the cache, or of the first file of
# its content with a review, for this file and the later ones.
GIVEN = """given AS MATERIALIZED (SELECT filename, CASE WHEN error_kind = 'ok' THEN o_orderkey END AS listed, kind, error_kind,
  CASE kind WHEN 99 THEN o_orderpriority WHEN 4 THEN '' WHEN 2 THEN 'Review failed: Invalid schema: overall_score'
    WHEN 3 THEN 'Review failed: Invalid schema: filename' ELSE 'Review failed: Invalid JSON from model' END AS summary,
  coalesce(score, 0) AS overall_score FROM ingested WHERE error_kind <> 'not_object')"""
SOURCED = """entry AS MATERIALIZED (SELECT content_hash, max(c.filename) AS source FROM code c JOIN given USING (filename)
  SEMI JOIN (SELECT filename FROM f2 WHERE status = 'modified') m USING (filename) GROUP BY 1),
firsts AS MATERIALIZED (SELECT content_hash, min(nth) AS first_nth, min_by(filename, nth) AS source FROM plan SEMI JOIN given USING (filename) WHERE NOT is_cached GROUP BY 1),
done AS MATERIALIZED (SELECT p.repo, p.pr_number, p.filename, p.rank, p.action, CASE WHEN p.is_cached THEN 'ok' ELSE g.error_kind END AS error_kind,
    g.filename AS reported_filename, g.summary, g.overall_score, CASE WHEN g.kind = 99 THEN g.listed END AS listed
  FROM plan p LEFT JOIN entry e USING (content_hash) LEFT JOIN firsts s USING (content_hash)
  JOIN given g ON g.filename = CASE WHEN p.is_cached THEN e.source WHEN p.nth >= s.first_nth THEN s.source END)"""
DONE_ISSUES = f"""issues AS MATERIALIZED (SELECT repo, pr_number, filename, CAST(k AS BIGINT) AS line, {SEVERITY} AS severity, 'part ' || l_partkey AS message
  FROM done JOIN li ON l_orderkey = listed)"""
DONE_COUNTED = """counted AS MATERIALIZED (SELECT d.repo, d.pr_number, d.filename, d.rank, any_value(summary) AS summary, any_value(overall_score) AS overall_score, {sums}
  FROM done d LEFT JOIN issues i USING (repo, pr_number, filename) GROUP BY ALL)"""

DOCS = "docs AS MATERIALIZED (SELECT 'docs/' || source AS repo, doc_id AS pr_number, 'doc_' || doc_id || '.py' AS filename, 1 AS rank, sha256(text) AS content_hash, length(text) AS n_chars FROM documents)"
ENTRIES = f"""old_entries AS MATERIALIZED (SELECT sha256(code) AS content_hash, review, reviewed_at AS created_at FROM ({LABELLED_ENTRIES})),
new_entries AS MATERIALIZED (SELECT sha256(code) AS content_hash, review, reviewed_at AS created_at FROM ({OTHER_ENTRIES})),
doc_cache AS MATERIALIZED (SELECT content_hash, max_by(review, created_at) AS review FROM old_entries GROUP BY 1)"""

SEVERITY_SUMS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in ("critical", "high", "medium", "low", "info"))
DONE = [PLAN, GIVEN, SOURCED, DONE_ISSUES, DONE_COUNTED.format(sums=SEVERITY_SUMS)]
ISSUES = f"issues AS MATERIALIZED ({REVIEW_ISSUES})"
REVIEWED = f"reviews AS MATERIALIZED ({REVIEWS})"
COUNTED = f"""counted AS MATERIALIZED (SELECT r.*, critical, high, medium, low, info FROM reviews r JOIN (
  SELECT r.repo, r.pr_number, r.filename, {SEVERITY_SUMS} FROM reviews r LEFT JOIN issues i USING (repo, pr_number, filename) GROUP BY ALL) USING (repo, pr_number, filename))"""

# HMAC from two pads of the key (shorter than one block).
_KEY = SECRET.ljust(64, b"\0")
INNER, OUTER = (bytes(b ^ m for b in _KEY).hex() for m in (0x36, 0x5C))
EVENTS = f"""ev AS MATERIALIZED (SELECT *, coalesce(sig_kind = 'valid', FALSE) AS accepted,
  sha256(from_hex('{OUTER}') || unhex(sha256(from_hex('{INNER}') || encode(body)))) AS digest,
  body::JSON ->> '$.action' AS action, body::JSON ->> '$.repository.full_name' AS repo,
  CAST(body::JSON ->> '$.pull_request.number' AS BIGINT) AS pr_number FROM ({WEBHOOK_EVENTS})),
routes AS MATERIALIZED (SELECT *, CASE WHEN NOT accepted THEN 'rejected' WHEN event = 'ping' THEN 'pong'
  WHEN event <> 'pull_request' THEN 'ignored_event' WHEN action NOT IN ('opened', 'synchronize', 'reopened') THEN 'ignored_action'
  ELSE 'process' END AS route FROM ev)"""

SNAP_RANKED = [
    LI, *SNAP_GRAPH, FN, FUNCTIONS, SUMMARY, CLOSURE, IMPACT, SCORES,
]
SIGNS = "CASE severity WHEN 'critical' THEN '🔴' WHEN 'high' THEN '🟠' WHEN 'medium' THEN '🟡' WHEN 'low' THEN '🔵' WHEN 'info' THEN '💡' ELSE '⚪' END"
SUMMARY_TEXT = """SELECT repo, pr_number, '## Review Summary' || chr(10) || chr(10) || string_agg(
          '### ' || CASE WHEN overall_score >= 7 THEN '🟢' WHEN overall_score >= 4 THEN '🟡' ELSE '🔴' END || ' `' || filename || '` — ' || overall_score || '/10' || chr(10)
          || '> ' || summary || chr(10) || chr(10) || CASE WHEN critical + high + medium + low + info = 0 THEN '✅ No issues found' ELSE concat_ws(' | ',
            CASE WHEN critical > 0 THEN '🔴 critical: ' || critical END, CASE WHEN high > 0 THEN '🟠 high: ' || high END,
            CASE WHEN medium > 0 THEN '🟡 medium: ' || medium END, CASE WHEN low > 0 THEN '🔵 low: ' || low END,
            CASE WHEN info > 0 THEN '💡 info: ' || info END) END || chr(10), chr(10) ORDER BY rank)
        || chr(10) || '---' || chr(10) || '**Total:** ' || sum(critical + high + medium + low + info)::BIGINT || ' issues across ' || count(*) || ' files'
        || CASE WHEN sum(critical) > 0 THEN chr(10) || chr(10) || '🔴 **' || sum(critical)::BIGINT || ' critical issue(s) require immediate attention**' ELSE '' END AS body
        FROM {reviewed} GROUP BY repo, pr_number"""
STATUS = """SELECT c.repo, c.pr_number, CASE WHEN coalesce(a.n, 0) > 0 THEN 'processed' ELSE 'no_python_files' END AS status,
  coalesce(a.n, 0) AS files_analyzed, coalesce(s.todo, 0) AS files_to_review, coalesce(s.cached, 0) AS cached, coalesce(a.broken, 0) + {extra} AS errors
FROM changes c LEFT JOIN (SELECT repo, pr_number, count(*) AS n, count(*) FILTER (broken) AS broken FROM f GROUP BY ALL) a USING (repo, pr_number)
LEFT JOIN (SELECT repo, pr_number, count(*) FILTER (NOT is_cached) AS todo, count(*) FILTER (is_cached) AS cached FROM split GROUP BY ALL) s USING (repo, pr_number)"""

ORACLES: dict[str, str] = {
    "pr_file_snapshot": sql(F2, SNAPSHOT, select="SELECT * FROM snap"),
    "pr_without_python": sql(F2, select="""SELECT DISTINCT repo, pr_number, 'no_python_files' AS status FROM f2 a WHERE NOT EXISTS (
        SELECT 1 FROM f2 b WHERE b.repo = a.repo AND b.pr_number = a.pr_number AND b.filename LIKE '%.py' AND b.status <> 'removed')"""),
    "signed_events": sql(EVENTS, select="SELECT event_id, accepted, digest FROM ev"),
    "webhook_routing": sql(EVENTS, select="SELECT route, event, action, count(*) AS n_events FROM routes GROUP BY ALL"),
    "code_functions": sql(*PARSED, select="SELECT *, CAST(NULL AS VARCHAR) AS docstring FROM functions"),
    "code_classes": sql(ORD, FILES, select="""SELECT repo, pr_number, filename, 0 AS pos, 'C_' || o_orderkey AS name, import_lines + 1 AS line_start,
        import_lines + 3 AS line_end, 'm' AS methods, 'Base' AS base_classes, CAST(NULL AS VARCHAR) AS docstring FROM f WHERE has_class AND NOT broken"""),
    "code_imports": sql(ORD, FILES, IMPORTS, select="SELECT * FROM imports"),
    "code_syntax_errors": sql(*PARSED, select="""SELECT repo, pr_number, filename, 'Line ' || (import_lines + 1) || ': invalid syntax' AS error_message, total_lines
        FROM summary JOIN f USING (repo, pr_number, filename) WHERE f.broken"""),
    "code_file_summary": sql(*PARSED, select="SELECT * EXCLUDE (broken, max_complexity), broken AS has_syntax_error FROM summary"),
    "file_max_complexity": sql(*PARSED, select="SELECT repo, pr_number, filename, max_complexity FROM summary"),
    "complexity_bands": sql(*PARSED, select="""SELECT repo, CASE WHEN complexity <= 5 THEN 'simple' WHEN complexity <= 10 THEN 'medium' ELSE 'complex' END AS band,
        count(*) AS n_functions FROM functions GROUP BY ALL"""),
    "module_names": sql(F2, select="""SELECT repo, pr_number, filename, path, p || CASE WHEN status = 'added' THEN '__init__' ELSE stem END AS module,
        CASE WHEN status = 'added' THEN rtrim(p, '.') ELSE p || stem END AS tree_module,
        replace(replace(path, '.py', ''), '/', '.') AS ranking_name
        FROM (SELECT *, concat(status, '/./', repo, '/', CASE WHEN status = 'added' THEN '__init__.py' ELSE filename END) AS path,
          concat(status, '.', replace(repo, '/', '.'), '.') AS p, left(filename, length(filename) - 3) AS stem FROM f2)"""),
    "import_edges": sql(*GRAPH, select="SELECT * FROM edges"),
    "graph_nodes": sql(ORD, FILES, select="SELECT repo, pr_number, module, filename AS path, TRUE AS is_project FROM f"),
    "graph_stats": sql(*GRAPH, select="""SELECT repo, pr_number, count(*) AS total_files, (SELECT count(*) FROM edges e WHERE e.repo = f.repo AND e.pr_number = f.pr_number) AS total_imports
        FROM f GROUP BY repo, pr_number"""),
    "top_imported": sql(*GRAPH, degrees("dst", 5), select="SELECT * FROM top"),
    "top_dependencies": sql(*GRAPH, degrees("src", 5), select="SELECT * FROM top"),
    "isolated_modules": sql(*GRAPH, select="""SELECT repo, pr_number, module FROM f WHERE NOT EXISTS (
        SELECT 1 FROM edges e WHERE e.repo = f.repo AND e.pr_number = f.pr_number AND (e.src = f.module OR e.dst = f.module))"""),
    # The only cycles are whole changes: every file imports its predecessor, the oldest the newest.
    "graph_cycles": sql(ORD, FILES, select="""SELECT repo, pr_number, first_value(module) OVER low AS cycle,
        (first_value(age) OVER low - age + n) % n AS pos, module FROM (
          SELECT *, row_number() OVER (PARTITION BY repo, pr_number ORDER BY o_orderkey) AS age, count(*) OVER pr AS n,
            bool_or(closes) OVER pr AND NOT bool_or(broken) OVER pr AS ring FROM f WINDOW pr AS (PARTITION BY repo, pr_number))
        WHERE ring WINDOW low AS (PARTITION BY repo, pr_number ORDER BY module)"""),
    "has_cycles": sql(*GRAPH, CLOSURE, ON_CYCLE, select="""SELECT DISTINCT repo, pr_number, EXISTS (SELECT 1 FROM on_cycle c WHERE c.repo = f.repo AND c.pr_number = f.pr_number) AS has_cycles FROM f"""),
    "module_impact": sql(*GRAPH, degrees("dst", 1), CLOSURE, select="""SELECT c.repo, c.pr_number, c.dst AS start, c.src AS module
        FROM closure c JOIN top t ON t.repo = c.repo AND t.pr_number = c.pr_number AND t.module = c.dst WHERE c.src <> c.dst"""),
    "module_dependencies": sql(*GRAPH, degrees("src", 1), CLOSURE, select="""SELECT c.repo, c.pr_number, c.src AS start, c.dst AS module
        FROM closure c JOIN top t ON t.repo = c.repo AND t.pr_number = c.pr_number AND t.module = c.src WHERE c.src <> c.dst"""),
    "file_impact_sets": sql(*GRAPH, CLOSURE, select="SELECT repo, pr_number, dst AS start, src AS module FROM closure WHERE src <> dst"),
    "file_dependency_sets": sql(*GRAPH, CLOSURE, select="SELECT repo, pr_number, src AS start, dst AS module FROM closure WHERE src <> dst"),
    "cycle_flags": sql(*GRAPH, CLOSURE, ON_CYCLE, select="""SELECT f.repo, f.pr_number, f.module AS src, CAST(NULL AS VARCHAR) AS dst, c.module IS NOT NULL AS in_cycle
        FROM f LEFT JOIN on_cycle c USING (repo, pr_number, module)
        UNION ALL SELECT e.repo, e.pr_number, e.src, e.dst, a.module IS NOT NULL AND b.module IS NOT NULL FROM edges e
        LEFT JOIN on_cycle a ON a.repo = e.repo AND a.pr_number = e.pr_number AND a.module = e.src
        LEFT JOIN on_cycle b ON b.repo = e.repo AND b.pr_number = e.pr_number AND b.module = e.dst"""),
    "impact_counts": sql(*GRAPH, CLOSURE, IMPACT, select="SELECT * FROM impact"),
    "layered_impact": sql(LAYERED, ENDS, CLOSURE, select="""SELECT n.repo, n.pr_number, n.module, count(*) FILTER (c.src <> n.module) AS impact,
        coalesce(bool_or(c.src = n.module), FALSE) AS on_cycle FROM ends n
        LEFT JOIN closure c ON c.repo = n.repo AND c.pr_number = n.pr_number AND c.dst = n.module GROUP BY ALL"""),
    "layered_cycles": f"""WITH edges AS MATERIALIZED ({LAYERED_EDGES}),
        back AS MATERIALIZED (SELECT repo, pr_number, src, dst FROM edges WHERE src LIKE 'reg%'),
        forth AS MATERIALIZED (SELECT repo, pr_number, src, dst FROM edges WHERE dst LIKE 'reg%')
        SELECT repo, pr_number, f.src || ',' || f.dst AS modules FROM forth f JOIN back b USING (repo, pr_number) WHERE b.src = f.dst AND b.dst = f.src""",
    "ladder_cycles": """SELECT 'org/ladders' AS repo, CAST(floor(c_custkey / 40) AS BIGINT) AS pr_number,
        array_to_string(list_sort(['c_' || c_custkey, 'c_' || (c_custkey + 1), way || c_custkey]), ',') AS modules
        FROM customer, (VALUES ('p_'), ('q_')) w(way)""",
    "overlapping_cycles": sql(f"edges AS MATERIALIZED ({CHORDED_EDGES})", """paths AS (SELECT repo, pr_number, src AS start, src AS last, [src] AS path, FALSE AS closed FROM edges
        UNION SELECT p.repo, p.pr_number, p.start, e.dst, CASE WHEN e.dst = p.start THEN p.path ELSE list_append(p.path, e.dst) END, e.dst = p.start
        FROM paths p JOIN edges e ON e.repo = p.repo AND e.pr_number = p.pr_number AND e.src = p.last
        WHERE NOT p.closed AND (e.dst = p.start OR (e.dst > p.start AND NOT list_contains(p.path, e.dst))))""",
        select="SELECT repo, pr_number, array_to_string(path, '>') AS modules, CAST(len(path) AS INT) AS length FROM paths WHERE closed"),
    "layered_dependencies": sql(LAYERED, degrees("src", 5), CLOSURE, select="""SELECT c.repo, c.pr_number, c.src AS start, c.dst AS module
        FROM closure c JOIN top t ON t.repo = c.repo AND t.pr_number = c.pr_number AND t.module = c.src WHERE c.src <> c.dst"""),
    "layered_edge_flags": sql(LAYERED, CLOSURE, ON_CYCLE, select="""SELECT e.repo, e.pr_number, e.src, e.dst, a.module IS NOT NULL AND b.module IS NOT NULL AS in_cycle FROM edges e
        LEFT JOIN on_cycle a ON a.repo = e.repo AND a.pr_number = e.pr_number AND a.module = e.src
        LEFT JOIN on_cycle b ON b.repo = e.repo AND b.pr_number = e.pr_number AND b.module = e.dst"""),
    "package_edges": sql(PACKAGES, select="SELECT * FROM package_edges"),
    "package_nodes": sql(PACKAGES, select="""SELECT repo, pr_number, module, path, TRUE AS is_project FROM members
        UNION ALL SELECT DISTINCT repo, pr_number, dst, NULL, FALSE FROM package_edges"""),
    "package_impact_sets": sql(PACKAGES, select="SELECT repo, pr_number, dst AS start, src AS module FROM package_edges"),
    "package_impact": sql(PACKAGES, select="""SELECT repo, pr_number, src AS module, 0 AS impact, FALSE AS on_cycle FROM package_edges GROUP BY ALL
        UNION ALL SELECT repo, pr_number, dst, count(*), FALSE FROM package_edges GROUP BY ALL"""),
    "resolved_edges": sql("""s AS MATERIALIZED (SELECT 'org/resolved' AS repo, CAST(s_nationkey % 5 AS BIGINT) AS pr_number, s_nationkey AS nation,
        concat('app.n', s_nationkey, '.s_', s_suppkey) AS module, lead(module) OVER (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey) AS following FROM supplier)""",
        select="""SELECT repo, pr_number, module AS src, following AS dst, TRUE AS is_project FROM s WHERE following IS NOT NULL
        UNION ALL SELECT repo, pr_number, module, 'app.n' || nation || '.__init__', TRUE FROM s WHERE nation % 2 = 0
        UNION ALL SELECT repo, pr_number, module, 'app.n' || nation, FALSE FROM s WHERE nation % 2 = 1"""),
    "priority_scores": sql(*RANKED, select="SELECT * FROM scores"),
    "review_queue": sql(*RANKED, QUEUE, select="SELECT repo, pr_number, filename, rank, score FROM queue"),
    "queue_next": sql(*RANKED, QUEUE, select="SELECT repo, pr_number, filename, score FROM queue WHERE rank = 1"),
    "queue_rest": sql(*RANKED, QUEUE, select="SELECT repo, pr_number, filename, score FROM scores ANTI JOIN (SELECT * FROM queue WHERE rank = 1) q USING (repo, pr_number, filename)"),
    "queue_size": sql(*RANKED, select="SELECT repo, pr_number, count(*) AS size FROM scores GROUP BY ALL"),
    "content_hashes": sql(LI, ORD, CODE, select="SELECT repo, pr_number, filename, content_hash FROM code"),
    "cache_upsert": sql(ENTRIES, select="""SELECT content_hash, max_by(review, created_at) AS review, max(created_at) AS created_at
        FROM (SELECT * FROM old_entries UNION ALL SELECT * FROM new_entries) GROUP BY 1"""),
    "cache_lookup": sql(DOCS, ENTRIES, select="""SELECT pr_number, content_hash, review, review IS NOT NULL AS has_review FROM docs LEFT JOIN doc_cache USING (content_hash)"""),
    "cache_split": sql(*RANKED, *CACHED, select="SELECT repo, pr_number, filename, rank, is_cached FROM split"),
    "review_plan": sql(DOCS, ENTRIES, """split AS MATERIALIZED (SELECT d.*, coalesce(review <> 'stale', FALSE) AS is_cached FROM docs d LEFT JOIN doc_cache USING (content_hash))""",
        PLAN, select=PLAN_COLUMNS),
    "queue_review_plan": sql(*RANKED, *CACHED, PLAN, select=PLAN_COLUMNS),
    "cache_stats": sql(ENTRIES, select="""SELECT count(DISTINCT content_hash) AS entries, TRUE AS on_disk, TRUE AS in_place
        FROM (SELECT content_hash FROM old_entries UNION ALL SELECT content_hash FROM new_entries)"""),
    "cache_replay": sql(ENTRIES, select="""SELECT 'before' AS state, content_hash, review FROM doc_cache
        UNION ALL SELECT 'after', content_hash, max_by(review, created_at) FROM (SELECT * FROM old_entries UNION ALL SELECT * FROM new_entries) GROUP BY 2"""),
    "cache_cleared": sql(ENTRIES, select="SELECT content_hash, review FROM doc_cache"),
    "oversize_files": sql(DOCS, select="""SELECT repo, pr_number, filename, CASE WHEN 4 * n_chars > 50000 THEN 'File too large for review (>50k chars)' END AS summary,
        CASE WHEN 4 * n_chars > 50000 THEN 0 END AS overall_score FROM docs"""),
    "review_requests": sql(*RANKED, *CACHED, PLAN, select="""SELECT p.repo, p.pr_number, p.filename, p.rank, p.dependencies, s.n_functions, s.n_classes, s.avg_complexity,
        'File ' || p.filename || ': ' || s.n_functions || ' functions, ' || s.n_classes || ' classes, average complexity ' || s.avg_complexity || '.' || chr(10)
        || 'Files affected by a change of it: ' || p.dependencies || '.' || chr(10)
        || 'Review the code and answer with a JSON object (filename, issues, summary, overall_score).' || chr(10) || chr(10) || c.code AS prompt
        FROM plan p JOIN summary s USING (repo, pr_number, filename) JOIN code c USING (repo, pr_number, filename) WHERE p.action = 'review' AND length(c.code) <= 50000"""),
    "review_cost": sql(DOCS, select="""SELECT repo, pr_number, filename, n_chars // 4 + 500 AS input_tokens, 800 AS output_tokens,
        round((n_chars // 4 + 500) * 0.8e0 / 1e6 + 0.0032e0, 6) AS cost_usd FROM docs"""),
    "review_spend": sql(DOCS, select="""SELECT repo, pr_number, CASE WHEN grouping(pr_number) = 0 THEN 'change' WHEN grouping(repo) = 0 THEN 'repository' ELSE 'all' END AS level,
        count(*) AS n_files, CAST(sum(n_chars // 4 + 500) AS BIGINT) AS input_tokens, CAST(count(*) * 800 AS BIGINT) AS output_tokens,
        CAST(sum(CAST(round((n_chars // 4 + 500) * 0.8e0 / 1e6 + 0.0032e0, 6) AS DECIMAL(18, 6))) AS DOUBLE) AS cost_usd
        FROM docs GROUP BY GROUPING SETS ((repo, pr_number), (repo), ())"""),
    "review_retries": sql(DOCS, ENTRIES, """split AS MATERIALIZED (SELECT d.*, coalesce(review <> 'stale', FALSE) AS is_cached FROM docs d LEFT JOIN doc_cache USING (content_hash))""",
        PLAN, """short AS MATERIALIZED (SELECT *, n_chars <= 50000 AS sent, pr_number % 3 = 0 AND n_chars <= 50000 AS good FROM plan),
        firsts AS MATERIALIZED (SELECT content_hash, min(nth) AS nth, min_by(pr_number, nth) AS doc FROM short WHERE NOT is_cached AND (good OR NOT sent) GROUP BY 1)""",
        select="""SELECT p.repo, p.pr_number, p.filename, p.action, CASE WHEN asked THEN CAST(p.nth AS INT) END AS round,
        CASE WHEN p.nth >= f.nth AND NOT p.is_cached THEN CASE WHEN sent THEN 'ok' ELSE 'oversize' END END AS error_kind,
        CASE WHEN p.nth >= f.nth AND NOT p.is_cached THEN 'doc_' || f.doc || '.py' END AS reported_filename,
        CASE WHEN p.nth >= f.nth AND NOT p.is_cached THEN CASE WHEN sent THEN CAST(f.doc % 11 AS INT) ELSE 0 END END AS overall_score
        FROM (SELECT *, NOT is_cached AND sent AND nth <= coalesce((SELECT nth FROM firsts x WHERE x.content_hash = short.content_hash), nth) AS asked FROM short) p
        LEFT JOIN firsts f USING (content_hash)"""),
    "review_ingest": sql(LI, INGESTED, ISSUE_LISTS, select="""SELECT repo, pr_number, filename, error_kind,
        CASE WHEN error_kind = 'ok' THEN filename END AS reported_filename,
        CASE WHEN kind = 99 THEN o_orderpriority WHEN kind = 4 THEN '' END AS summary, score AS overall_score,
        CASE WHEN kind = 99 THEN coalesce(n_issues, 0) ELSE 0 END AS n_issues,
        CASE WHEN kind = 99 THEN coalesce(messages, '') ELSE '' END AS messages,
        CASE WHEN kind = 99 THEN coalesce(severities, '') ELSE '' END AS severities
        FROM ingested LEFT JOIN lists ON l_orderkey = o_orderkey"""),
    "long_line_numbers": """SELECT 'docs/' || source AS repo, doc_id AS pr_number, 'doc_' || doc_id || '.py' AS filename, 'ok' AS error_kind,
        doc_id + 1 AS first_line, concat_ws(',', doc_id + 1, (doc_id + 1)::HUGEINT * 1180591620717411303424, -(doc_id + 1)::HUGEINT * 1180591620717411303424) AS lines
        FROM documents""",
    "ingested_reviews": sql(LI, INGESTED, ISSUE_LISTS, select="""SELECT repo, pr_number, filename, filename AS reported_filename,
        CASE kind WHEN 99 THEN o_orderpriority WHEN 4 THEN '' WHEN 2 THEN 'Review failed: Invalid schema: overall_score'
          WHEN 3 THEN 'Review failed: Invalid schema: filename' ELSE 'Review failed: Invalid JSON from model' END AS summary,
        coalesce(score, 0) AS overall_score, CASE WHEN kind = 99 THEN coalesce(n_issues, 0) ELSE 0 END AS n_issues
        FROM ingested LEFT JOIN lists ON l_orderkey = o_orderkey WHERE error_kind <> 'not_object'"""),
    "review_failures": sql(INGESTED, select="SELECT repo, error_kind, count(*) AS n_responses FROM ingested GROUP BY ALL"),
    "severity_counts": sql(LI, ISSUES, REVIEWED, COUNTED, select="SELECT repo, pr_number, filename, critical, high, medium, low, info FROM counted"),
    "critical_files": sql(LI, ISSUES, select="SELECT DISTINCT repo, pr_number, filename FROM issues WHERE severity = 'critical'"),
    "score_bands": sql(REVIEWED, select="""SELECT repo, CASE WHEN overall_score >= 7 THEN 'green' WHEN overall_score >= 4 THEN 'yellow' ELSE 'red' END AS band,
        count(*) AS n_files FROM reviews GROUP BY ALL"""),
    "inline_comments": sql(LI, ISSUES, select=f"""SELECT repo, pr_number, filename AS path, line, {SIGNS} || ' **' || upper(severity) || '** — ' || category || chr(10) || chr(10) || message
        || CASE WHEN suggestion <> '' THEN chr(10) || chr(10) || '**Suggestion:** ' || suggestion ELSE '' END AS body FROM issues"""),
    "published_issues": sql(LI, ISSUES, select="SELECT repo, pr_number, filename, line, severity, category, message, suggestion FROM issues"),
    "pr_summary": sql(*RANKED, QUEUE, ISSUES, REVIEWED, COUNTED, select=SUMMARY_TEXT.format(reviewed="counted JOIN queue USING (repo, pr_number, filename)")),
    "pr_issue_totals": sql(LI, ISSUES, REVIEWED, COUNTED, select="""SELECT repo, pr_number, sum(critical + high + medium + low + info)::BIGINT AS total_issues,
        sum(critical)::BIGINT AS total_critical, count(*) AS n_files FROM counted GROUP BY ALL"""),
    "publish_results": sql(LI, f"log AS MATERIALIZED ({DELIVERIES})", select="""SELECT repo, pr_number, CASE WHEN lost THEN 'error' ELSE 'posted' END AS status,
        CASE WHEN lost THEN 0 ELSE posted END AS inline_comments, NOT lost AS summary_posted, CASE WHEN lost THEN 0 ELSE refused END AS n_errors,
        CASE WHEN lost THEN 'not found' END AS message
        FROM (SELECT repo, pr_number, bool_or(kind = 'change') AS lost, count(*) FILTER (kind = 'inline' AND accepted) AS posted,
          count(*) FILTER (kind <> 'change' AND NOT accepted) AS refused FROM log GROUP BY ALL)"""),
    "delivery_errors": sql(LI, f"log AS MATERIALIZED ({DELIVERIES})", select="""SELECT repo, pr_number, kind,
        CASE kind WHEN 'inline' THEN filename || ':' || line || ' — ' || message WHEN 'summary' THEN 'Summary comment failed: ' || message ELSE message END AS error
        FROM log WHERE NOT accepted"""),
    "pr_status": sql(*SNAP_RANKED, *CACHED, "changes AS (SELECT DISTINCT repo, pr_number FROM f2)", select=STATUS.format(extra="0")),
    "error_log": sql(*RANKED, QUEUE, INGESTED, select="""SELECT repo, pr_number, 1 AS step, filename, filename || ': Line ' || (import_lines + 1) || ': invalid syntax' AS message FROM f WHERE broken
        UNION ALL SELECT repo, pr_number, 5, filename, 'Review error in ' || filename || ': list' FROM ingested SEMI JOIN queue USING (repo, pr_number, filename) WHERE error_kind = 'not_object'"""),
    "change_reviews": sql(*RANKED, *CACHED, *DONE, select="""SELECT repo, pr_number, filename, rank, action, error_kind, reported_filename, summary, overall_score,
        CAST(coalesce(n, 0) AS INT) AS n_issues FROM done LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM li GROUP BY 1) ON l_orderkey = listed"""),
    "change_comments": sql(*RANKED, *CACHED, *DONE, select=f"""SELECT repo, pr_number, filename AS path, line, {SIGNS} || ' **' || upper(severity) || '** — bug' || chr(10) || chr(10) || message AS body FROM issues"""),
    "change_summaries": sql(*RANKED, *CACHED, *DONE, select=SUMMARY_TEXT.format(reviewed="counted")),
    "change_totals": sql(*RANKED, *CACHED, *DONE, select="""SELECT repo, pr_number, sum(critical + high + medium + low + info)::BIGINT AS total_issues,
        sum(critical)::BIGINT AS total_critical, count(*) AS n_files FROM counted GROUP BY ALL"""),
    "change_errors": sql(*RANKED, *CACHED, *DONE, select=f"""SELECT repo, pr_number, 1 AS step, filename, filename || ': Line ' || (import_lines + 1) || ': invalid syntax' AS message FROM f WHERE broken
        UNION ALL SELECT p.repo, p.pr_number, 5, p.filename, 'Review error in ' || p.filename || ': list' FROM plan p LEFT JOIN firsts USING (content_hash)
        SEMI JOIN (SELECT filename FROM ingested WHERE error_kind = 'not_object') i USING (filename) WHERE NOT is_cached AND (first_nth IS NULL OR nth < first_nth)
        UNION ALL SELECT repo, pr_number, 6, NULL, 'Comment posting error: ' || message FROM ({POSTING_ERRORS}) SEMI JOIN done USING (repo, pr_number)"""),
    # The watermark of a part is the latest time in the parts before it, in milliseconds, less two hours; later rows do not count,
    # and hours count that are over at the last one.
    "events_hourly": f"""WITH d AS MATERIALIZED ({DELIVERIES_IN_PARTS}),
        latest AS (SELECT part, max(ts) AS ts FROM d GROUP BY part),
        mark AS MATERIALIZED (SELECT p.part, date_trunc('millisecond', max(l.ts)) - INTERVAL 2 HOUR AS watermark
          FROM range(9) AS p(part) LEFT JOIN latest l ON l.part < p.part GROUP BY p.part),
        seen AS (SELECT DISTINCT event_id, d.ts, repo, event FROM d JOIN mark m ON m.part = d.part WHERE m.watermark IS NULL OR d.ts > m.watermark)
        SELECT repo, event, CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS hour, count(*) AS n_events FROM seen
        WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT watermark FROM mark WHERE part = 8) GROUP BY ALL""",
    "stream_summaries": sql(*SNAP_RANKED, CODE, INGESTED, "hashes AS (SELECT '' AS content_hash)", QUEUE, EVENTS,
        SPLIT.replace("JOIN code c", "SEMI JOIN (SELECT * FROM routes WHERE route = 'process') r USING (repo, pr_number) JOIN code c"),
        *DONE, select=SUMMARY_TEXT.format(reviewed="counted")),
    "stream_pr_status": sql(*SNAP_RANKED, CODE, INGESTED, "hashes AS (SELECT '' AS content_hash)", QUEUE, SPLIT, EVENTS, PLAN,
        "changes AS MATERIALIZED (SELECT DISTINCT repo, pr_number FROM routes WHERE route = 'process')",
        "due AS MATERIALIZED (SELECT * FROM split SEMI JOIN changes USING (repo, pr_number))",
        select=STATUS.format(extra="coalesce(x.n, 0)") + """
LEFT JOIN (SELECT repo, pr_number, count(*) AS n FROM due SEMI JOIN (SELECT * FROM ingested WHERE error_kind = 'not_object') i USING (repo, pr_number, filename) GROUP BY ALL) x USING (repo, pr_number)"""),
}

# Reviews by event: a content is in the cache from the first event on whose change has a queued file of it with a review.
BY_EVENT = [
    *SNAP_RANKED, CODE, INGESTED, "hashes AS (SELECT '' AS content_hash)", QUEUE, SPLIT, EVENTS,
    "due AS MATERIALIZED (SELECT event_id, repo, pr_number, row_number() OVER (PARTITION BY repo, pr_number ORDER BY ts, event_id) AS run FROM routes WHERE route = 'process')",
    """runs AS MATERIALIZED (SELECT d.event_id, s.*, i.error_kind, i.kind, i.o_orderkey, i.o_orderpriority, i.score,
        d.event_id * 10 + s.rank AS place FROM due d JOIN split s USING (repo, pr_number) JOIN ingested i USING (repo, pr_number, filename))""",
    """firsts AS MATERIALIZED (SELECT content_hash, min(place) AS first_place, min_by(filename, place) AS source FROM runs
        WHERE error_kind <> 'not_object' GROUP BY 1)""",
    """placed AS MATERIALIZED (SELECT r.*, f.first_place, f.source, coalesce(f.first_place // 10 < r.event_id, FALSE) AS found,
        error_kind = 'not_object' AND (f.first_place IS NULL OR place < f.first_place) AS refused FROM runs r LEFT JOIN firsts f USING (content_hash))""",
]
ORACLES |= {
    "event_status": sql(*BY_EVENT, select="""SELECT d.event_id, d.repo, d.pr_number, d.run,
        CASE WHEN coalesce(a.n, 0) > 0 THEN 'processed' ELSE 'no_python_files' END AS status, coalesce(a.n, 0) AS files_analyzed,
        coalesce(w.todo, 0) AS files_to_review, coalesce(w.found, 0) AS cached, coalesce(a.broken, 0) + coalesce(w.refused, 0) AS errors
        FROM due d LEFT JOIN (SELECT repo, pr_number, count(*) AS n, count(*) FILTER (broken) AS broken FROM f GROUP BY ALL) a USING (repo, pr_number)
        LEFT JOIN (SELECT event_id, count(*) FILTER (NOT found) AS todo, count(*) FILTER (found) AS found, count(*) FILTER (refused) AS refused FROM placed GROUP BY 1) w USING (event_id)"""),
    "event_review_scores": sql(*BY_EVENT, GIVEN, select="""SELECT p.event_id, p.repo, p.pr_number, p.filename, p.rank, g.filename AS reported_filename,
        g.summary, g.overall_score, CAST(CASE WHEN g.kind = 99 THEN coalesce(n, 0) ELSE 0 END AS INT) AS n_issues
        FROM placed p JOIN given g ON g.filename = p.source LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM li GROUP BY 1) ON l_orderkey = g.listed
        WHERE p.place >= p.first_place"""),
}
