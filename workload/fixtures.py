"""Input tables of the registered queries, derived by SQL from the given parquet tables.

The SQL texts run unchanged in Spark and DuckDB, so the expected results are computed from the same
definitions. Order ``o`` is file ``mod_<o>.py`` of change ``(org/repo_<customer % 10>, customer)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FILE_KEY = "concat('org/repo_', o_custkey % 10) AS repo, o_custkey AS pr_number, concat('mod_', o_orderkey, '.py') AS filename"

# Lines of one order, numbered with a full tie-break ((l_orderkey, l_linenumber) is not unique).
LINES = """SELECT l_orderkey, l_partkey, l_suppkey,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS k,
    CAST(l_quantity AS INT) % 5 AS n_if, l_returnflag AS rf FROM lineitem"""

# Previous, first and last order of the customer. Spark uses `customer_order` below instead.
ORDERED = """SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER w AS prev_key,
    first_value(o_orderkey) OVER w AS first_key, max(o_orderkey) OVER (PARTITION BY o_custkey) AS last_key
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"""

FUNCTION_SOURCE = """SELECT l_orderkey, k, concat(CASE WHEN rf = 'A' THEN 'async ' ELSE '' END, 'def f_', k, '(a, b):', chr(10),
      repeat(concat('    if a > b:', chr(10), '        a = b', chr(10)), CAST(n_if AS INT)),
      CASE rf WHEN 'R' THEN concat('    while a and b or a:', chr(10), '        break', chr(10))
              WHEN 'N' THEN concat('    try:', chr(10), '        pass', chr(10), '    except ValueError:', chr(10), '        pass', chr(10))
              ELSE '' END,
      '    return a', chr(10)) AS src FROM li"""

FILE_SOURCE = f"""SELECT {FILE_KEY},
  concat('import os', chr(10), 'import sys as system, json', chr(10),
    CASE WHEN prev_key IS NOT NULL THEN concat('from mod_', prev_key, ' import f_1, f_2', chr(10)) ELSE '' END,
    CASE WHEN o_custkey % 10 = 0 AND o_orderkey = first_key AND last_key <> first_key
         THEN concat('import mod_', last_key, chr(10)) ELSE '' END,
    CASE WHEN o_orderkey % 50 = 0 THEN concat('def broken(:', chr(10)) ELSE '' END,
    CASE WHEN o_orderkey % 4 = 0 THEN concat('class C_', o_orderkey, '(Base, metaclass=M):', chr(10), '    def m(self):', chr(10), '        return 1 if self else 0', chr(10)) ELSE '' END,
    coalesce(body, '')) AS code
FROM ord LEFT JOIN fn ON l_orderkey = o_orderkey"""

PR_FILE_EVENTS = """SELECT concat('org/repo_', o_custkey % 10) AS repo, o_custkey AS pr_number,
  concat('mod_', o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '.md' ELSE '.py' END) AS filename,
  CASE o_orderstatus WHEN 'F' THEN 'modified' WHEN 'O' THEN 'added' ELSE 'removed' END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 100 END AS additions,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 40 END AS deletions FROM orders"""

WEBHOOK_EVENTS = """SELECT event_id, ts,
  CASE event_type WHEN 'signup' THEN 'ping' WHEN 'error' THEN 'push' ELSE 'pull_request' END AS event,
  concat('{"action":"', CASE event_type WHEN 'click' THEN 'opened' WHEN 'view' THEN 'synchronize'
           ELSE CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'reopened' END END,
         '","pull_request":{"number":', user_id, '},"repository":{"full_name":"org/repo_', user_id % 10, '"}}') AS body,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'sha256=bad' ELSE 'valid' END AS sig_kind
FROM events"""

# Deliveries of the events in five parts: each event in its part, one in seven twice, one in eleven again in the next part, one
# in seventeen only in the next part and one in thirteen only two parts later.
DELIVERIES_IN_PARTS = """WITH parts AS (SELECT event_id, ts, event_type AS event, concat('org/repo_', user_id % 10) AS repo,
    CAST(floor(event_id * 5 / (SELECT max(event_id) + 1 FROM events)) AS INT) AS part FROM events),
  first_delivery AS (SELECT event_id, ts, repo, event, CASE WHEN event_id % 17 = 3 THEN part + 1 WHEN event_id % 13 = 5 THEN part + 2 ELSE part END AS part FROM parts)
SELECT event_id, ts, repo, event, part FROM first_delivery
UNION ALL SELECT event_id, ts, repo, event, part FROM first_delivery WHERE event_id % 7 = 0
UNION ALL SELECT event_id, ts, repo, event, part + 1 FROM first_delivery WHERE event_id % 11 = 0"""
#: Parts from the first delivery to the last.
PARTS = 8

SEVERITY = "CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END"

REVIEW_ISSUES = f"""SELECT {FILE_KEY}, CAST(k AS INT) AS line, {SEVERITY} AS severity,
  CASE l_suppkey % 5 WHEN 0 THEN 'bug' WHEN 1 THEN 'security' WHEN 2 THEN 'performance' WHEN 3 THEN 'style' ELSE 'best-practice' END AS category,
  concat('part ', l_partkey) AS message, CASE WHEN l_suppkey % 2 = 0 THEN concat('use supplier ', l_suppkey) ELSE '' END AS suggestion
  FROM orders JOIN li ON l_orderkey = o_orderkey"""

REVIEWS = f"SELECT {FILE_KEY}, o_orderpriority AS summary, CAST(o_orderkey % 11 AS INT) AS overall_score FROM orders"

ISSUE_JSON = f"""SELECT l_orderkey, k, concat('{{"line":', k, ',"severity":"', {SEVERITY},
      '","category":"bug","message":"part ', l_partkey, '"}}') AS src FROM li"""

MODEL_RESPONSES = f"""SELECT {FILE_KEY},
  CASE o_orderkey % 20
    WHEN 0 THEN 'not json'
    WHEN 1 THEN '[1]'
    WHEN 2 THEN concat('{{"filename":"mod_', o_orderkey, '.py","overall_score":99}}')
    WHEN 3 THEN '{{"summary":"no filename"}}'
    WHEN 4 THEN concat('```json', chr(10), '{{"filename":"mod_', o_orderkey, '.py","overall_score":8}}', chr(10), '```')
    WHEN 5 THEN concat('{{"filename":"mod_', o_orderkey, '.py"}} trailing')
    ELSE concat('{{"filename":"mod_', o_orderkey, '.py","issues":[', coalesce(issues, ''), '],"summary":"',
                o_orderpriority, '","overall_score":', o_orderkey % 11, '}}') END AS response
FROM orders LEFT JOIN js ON l_orderkey = o_orderkey"""

EARLIER_REVIEW, FIRST_REVIEW, NEXT_REVIEW = 1672531200, 1704067200, 1735689600  # 2023, 2024, 2025-01-01 UTC

# Documents as cached contents: the labelled ones were reviewed, one second apart; of equal texts the later
# document counts. Those of low quality hold a value that is no review.
LABELLED_ENTRIES = f"""SELECT text AS code, d.doc_id + {FIRST_REVIEW} AS reviewed_at,
  CASE quality WHEN 1 THEN concat('{{"filename":"doc_', d.doc_id, '.py","summary":"label","overall_score":7}}') ELSE 'stale' END AS review
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
# A second write covers every document: later reviews of the long ones, and earlier ones, which lose, of the others.
OTHER_ENTRIES = f"""SELECT text AS code, doc_id + CASE WHEN n_chars > 1000 THEN {NEXT_REVIEW} ELSE {EARLIER_REVIEW} END AS reviewed_at,
  'r' || doc_id AS review FROM documents"""

# The issue log of a publishing run: comments on supplier 0..9 lines are refused.
DELIVERIES = f"""SELECT {FILE_KEY}, 'inline' AS kind, CAST(k AS INT) AS line, l_suppkey >= 10 AS accepted,
  concat('refused ', l_suppkey) AS message FROM orders JOIN li ON l_orderkey = o_orderkey
UNION ALL
SELECT concat('org/repo_', c_custkey % 10), c_custkey, NULL, 'summary', NULL, c_acctbal >= 0, 'no balance' FROM customer
UNION ALL
SELECT concat('org/repo_', c_custkey % 10), c_custkey, NULL, 'change', NULL, FALSE, 'not found'
FROM customer WHERE c_mktsegment = 'MACHINERY'"""

# Publishing broke off for the changes of these customers.
POSTING_ERRORS = """SELECT concat('org/repo_', c_custkey % 10) AS repo, c_custkey AS pr_number, concat('timeout ', c_nationkey) AS message
FROM customer WHERE c_mktsegment = 'BUILDING'"""

# Suppliers as modules of packages, one change per region number: each imports its own package, a name below itself, the
# package of another nation of the change (which may have no supplier), and packages that no file belongs to.
PACKAGE_FILES = """SELECT 'org/packages' AS repo, CAST(s_nationkey % 5 AS BIGINT) AS pr_number,
  concat('app/r', s_nationkey % 5, '/n', s_nationkey, '/s_', s_suppkey, '.py') AS filename,
  concat('import appendix, app.r', (s_nationkey + 1) % 5, '.n', (s_nationkey + 1) % 25, chr(10),
    'from app.r', s_nationkey % 5, '.n', s_nationkey, ' import s_', s_suppkey, chr(10),
    'import app.r', s_nationkey % 5, '.n', s_nationkey, '.s_', s_suppkey, '.tools', chr(10),
    'def late():', chr(10), '    import app.r', s_nationkey % 5, '.n', (s_nationkey + 5) % 25, chr(10)) AS code
FROM supplier"""

# The same with imports that can be resolved: of something below the module of the next supplier, of the own package (which
# is a file where the nation's number is even) and of something below it.
RESOLVABLE_FILES = """SELECT 'org/resolved' AS repo, change AS pr_number, concat('app/n', nation, '/s_', s_suppkey, '.py') AS filename,
  concat('import app.n', next_nation, '.s_', next_key, '.tools.deep', chr(10), 'from app.n', nation, ' import x', chr(10),
    'import app.n', nation, '.gone, outside.app', chr(10), 'import app.n', nation, '.s_', s_suppkey, '.own', chr(10)) AS code
FROM (SELECT s_suppkey, s_nationkey AS nation, CAST(s_nationkey % 5 AS BIGINT) AS change,
    lead(s_suppkey, 1, s_suppkey) OVER w AS next_key, lead(s_nationkey, 1, s_nationkey) OVER w AS next_nation
  FROM supplier WINDOW w AS (PARTITION BY s_nationkey % 5 ORDER BY s_suppkey)) t
UNION ALL SELECT DISTINCT 'org/resolved', CAST(s_nationkey % 5 AS BIGINT), concat('app/n', s_nationkey, '/__init__.py'), ''
FROM supplier WHERE s_nationkey % 2 = 0"""

# Answers for documents sent for review: those of two in three are no review.
DOCUMENT_ANSWERS = """SELECT concat('docs/', source) AS repo, doc_id AS pr_number, concat('doc_', doc_id, '.py') AS filename,
  CASE WHEN doc_id % 3 = 0 THEN concat('{"filename":"doc_', doc_id, '.py","overall_score":', doc_id % 11, '}') ELSE '["no review"]' END AS response
FROM documents"""

# An answer for each document with the line numbers n, n * 2**70 (as a number or as text) and -n * 2**70.
LONG_LINES = """SELECT concat('docs/', source) AS repo, doc_id AS pr_number, concat('doc_', doc_id, '.py') AS filename,
  concat('{"filename":"doc_', doc_id, '.py","issues":[{"line":', n, rest, '},{"line":', quote, product, quote, rest, '},{"line":-', product, rest, '}]}') AS response
FROM (SELECT source, doc_id, doc_id + 1 AS n, CAST(doc_id + 1 AS DECIMAL(12, 0)) * CAST('1180591620717411303424' AS DECIMAL(22, 0)) AS product,
  CASE WHEN doc_id % 2 = 0 THEN '"' ELSE '' END AS quote, ',"severity":"low","category":"c","message":"m"' AS rest FROM documents) t"""

# A denser import graph, one change per repository: orders import the suppliers of their lines, suppliers their
# nation, nations their region, and a region its first nation (the cycles). A few modules are imported by very
# many others.
LAYERED_EDGES = """WITH used AS (SELECT DISTINCT concat('org/repo_', o_custkey % 10) AS repo, o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
  nations AS (SELECT DISTINCT repo, l_suppkey, s_nationkey FROM used JOIN supplier ON s_suppkey = l_suppkey),
  regions AS (SELECT DISTINCT repo, n_nationkey, n_regionkey FROM nations JOIN nation ON n_nationkey = s_nationkey)
SELECT repo, CAST(0 AS BIGINT) AS pr_number, src, dst FROM (
  SELECT repo, concat('mod_', o_orderkey) AS src, concat('sup_', l_suppkey) AS dst FROM used
  UNION ALL SELECT repo, concat('sup_', l_suppkey), concat('nat_', s_nationkey) FROM nations
  UNION ALL SELECT repo, concat('nat_', n_nationkey), concat('reg_', n_regionkey) FROM regions
  UNION ALL SELECT repo, concat('reg_', n_regionkey), concat('nat_', min(n_nationkey)) FROM regions GROUP BY repo, n_regionkey) t"""

# Customers in groups of six, one change each: a ring with two shortcuts and a way back, so that cycles overlap.
CHORDED_EDGES = """SELECT 'org/chords' AS repo, CAST(floor(c_custkey / 6) AS BIGINT) AS pr_number,
  concat('c_', c_custkey % 6) AS src, concat('c_', (c_custkey + step) % 6) AS dst
FROM (SELECT c_custkey, 1 AS step FROM customer UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey % 6 IN (0, 2)
  UNION ALL SELECT c_custkey, 5 FROM customer WHERE c_custkey % 6 = 3) t"""

# Customers in ladders of forty, one change each: rung i reaches rung i + 1 by two modules, which leads back to rung i.
LADDER_EDGES = """SELECT 'org/ladders' AS repo, CAST(floor(c_custkey / 40) AS BIGINT) AS pr_number, src, dst FROM (
  SELECT c_custkey, concat('c_', c_custkey) AS src, concat('p_', c_custkey) AS dst FROM customer
  UNION ALL SELECT c_custkey, concat('c_', c_custkey), concat('q_', c_custkey) FROM customer
  UNION ALL SELECT c_custkey, concat('p_', c_custkey), concat('c_', c_custkey + 1) FROM customer
  UNION ALL SELECT c_custkey, concat('q_', c_custkey), concat('c_', c_custkey + 1) FROM customer
  UNION ALL SELECT c_custkey, concat('c_', c_custkey + 1), concat('c_', c_custkey) FROM customer) t"""

#: Range of order keys handled as one piece when looking for a customer's previous order.
PIECE = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_order(orders: DataFrame) -> DataFrame:
    """`ORDERED`, safe for a customer holding a large share of all orders.

    The window runs over (customer, key range); a range's first order takes the last order of the
    customer's previous range from a table with one row per customer and range.
    """
    pieces = orders.withColumn("piece", F.floor(F.col("o_orderkey") / PIECE))
    ranges = pieces.groupBy("o_custkey", "piece").agg(
        F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")
    )
    before = W.partitionBy("o_custkey").orderBy("piece")
    whole = W.partitionBy("o_custkey")
    ranges = ranges.select(
        "o_custkey", "piece", F.lag("hi").over(before).alias("before_key"),
        F.min("lo").over(whole).alias("first_key"), F.max("hi").over(whole).alias("last_key"),
    )
    inside = W.partitionBy("o_custkey", "piece").orderBy("o_orderkey")
    return (
        pieces.withColumn("lagged", F.lag("o_orderkey").over(inside))
        .join(ranges, ["o_custkey", "piece"])
        .select("o_orderkey", "o_custkey", F.coalesce("lagged", "before_key").alias("prev_key"),
                "first_key", "last_key")
    )


def _per_order(spark: SparkSession, lineitem: DataFrame, source: str, sep: str) -> DataFrame:
    """Texts of an order's lines joined in line order."""
    li = spark.sql(LINES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=lineitem)
    # The JSON texts hold braces, so the view is named, not formatted in.
    li.createOrReplaceTempView("li")
    return spark.sql(
        f"SELECT l_orderkey, listagg(src, '{sep}') WITHIN GROUP (ORDER BY k) AS joined FROM ({source}) t GROUP BY l_orderkey"
    )


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    _per_order(spark, lineitem, FUNCTION_SOURCE, "").withColumnRenamed("joined", "body").createOrReplaceTempView("fn")
    customer_order(orders.select("o_orderkey", "o_custkey")).createOrReplaceTempView("ord")
    return spark.sql(FILE_SOURCE)


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    _per_order(spark, lineitem, ISSUE_JSON, ",").withColumnRenamed("joined", "issues").createOrReplaceTempView("js")
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(MODEL_RESPONSES)


def layered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("orders", "lineitem", "supplier", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(LAYERED_EDGES)


def pr_file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(PR_FILE_EVENTS)


def review_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    spark.sql(LINES).createOrReplaceTempView("li")
    return spark.sql(REVIEW_ISSUES)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(REVIEWS)


def webhook_events(events: DataFrame, signature: Column) -> DataFrame:
    """Events with the header of their kind; ``signature`` computes a valid one from ``body``."""
    events.createOrReplaceTempView("events")
    raw = events.sparkSession.sql(WEBHOOK_EVENTS)
    return raw.withColumn("signature", F.when(F.col("sig_kind") == "valid", signature).otherwise(F.col("sig_kind")))


def _entries(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in ("documents", "labels"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql).withColumn("created_at", F.timestamp_seconds("reviewed_at"))


def labelled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, LABELLED_ENTRIES)


def other_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entries(spark, sf_dir, OTHER_ENTRIES)


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("orders", "lineitem", "customer"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    spark.sql(LINES).createOrReplaceTempView("li")
    return spark.sql(DELIVERIES)


def posting_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(POSTING_ERRORS)


def package_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(PACKAGE_FILES)


def chorded_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(CHORDED_EDGES)


def ladder_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(LADDER_EDGES)


def resolvable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    return spark.sql(RESOLVABLE_FILES)


def document_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(DOCUMENT_ANSWERS)


def deliveries_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return spark.sql(DELIVERIES_IN_PARTS).withColumn("ts", F.col("ts").cast("timestamp"))


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(LONG_LINES)
