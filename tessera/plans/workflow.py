"""Intervals, prefixes, edit planning and the driver's business tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import intervals, workflow
from tessera.sources import graph
from tessera.sources.tables import table
from tessera.session import shared_folder
from tessera.streaming.ingest import stream_windowed_counts, windowed_counts

C = graph.CANONICAL_SQL


def enclosing_interval(spark: SparkSession, d: str) -> DataFrame:
    """The smallest symbol of the source's file around each edge's line."""
    symbols = graph.symbols(spark, d, "start_line", "end_line")
    owner = symbols.select(F.col("qname").alias("src"), "file_id")
    lines = graph.edges(spark, d, "line").where("line is not null").join(owner, "src").select("edge_id", "file_id", "line")
    spans = symbols.where(F.col("kind").isin("function", "method", "constructor", "component", "test_block")).select("file_id", "start_line", "end_line", "qname")
    return intervals.smallest_enclosing(lines, spans, ["file_id"], "line", "start_line", "end_line", "qname").select("edge_id", "enclosing")


def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The longest stored module or class that each imported target lies in."""
    names = graph.imports(spark, d).where("target is not null").select("target").distinct()
    prefixes = graph.symbols(spark, d).where(F.col("kind").isin("module", "class", "file_summary")).select(F.col("qname").alias("prefix"))
    return intervals.longest_prefix(names, "target", prefixes, "prefix")


def patch_impact(spark: SparkSession, d: str) -> DataFrame:
    return workflow.patch_impact(graph.edges(spark, d), graph.symbols(spark, d))


def tests_by_mention(spark: SparkSession, d: str) -> DataFrame:
    files = graph.files(spark, d, content=True)
    stem = F.regexp_extract("path", r"([^/.]+)[^/]*$", 1)
    code = graph.symbols(spark, d).where("kind in ('function', 'method', 'class')")
    targets = code.join(files.select("file_id", stem.alias("stem")), "file_id").select(F.col("qname").alias("target"), "stem")
    return workflow.tests_by_mention(files, targets)


def validation_commands(spark: SparkSession, d: str) -> DataFrame:
    return workflow.validation_commands(graph.files(spark, d))


def entity_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    """The business tables as one typed edge list, counted by type."""
    orders, lines = table(spark, d, "orders", "o_orderkey", "o_custkey"), table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    parts = [
        orders.select(F.concat(F.lit("customer:"), "o_custkey").alias("src"), F.concat(F.lit("order:"), "o_orderkey").alias("dst"), F.lit("PLACED").alias("edge_type")),
        lines.select(F.concat(F.lit("order:"), "l_orderkey").alias("src"), F.concat(F.lit("part:"), "l_partkey").alias("dst"), F.lit("CONTAINS").alias("edge_type")),
        lines.select(F.concat(F.lit("part:"), "l_partkey").alias("src"), F.concat(F.lit("supplier:"), "l_suppkey").alias("dst"), F.lit("SUPPLIED_BY").alias("edge_type")),
        table(spark, d, "customer").select(F.concat(F.lit("customer:"), "c_custkey").alias("src"), F.concat(F.lit("nation:"), "c_nationkey").alias("dst"), F.lit("IN_NATION").alias("edge_type")),
        table(spark, d, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("src"), F.concat(F.lit("region:"), "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("edge_type")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("src", "dst", "edge_type").agg(F.count("*").alias("n"))


def conditional_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = ("signup", "error", "click", "view", "purchase")
    return table(spark, d, "events", "user_id", "event_type").groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(f"n_{k}") for k in kinds])


def events_windowed(spark: SparkSession, d: str) -> DataFrame:
    return windowed_counts(table(spark, d, "events", "ts", "event_type", "value")).withColumn("total", F.round("total", 6))


def events_streamed(spark: SparkSession, d: str) -> DataFrame:
    """The same counts by a stream over the stored events."""
    name = f"{shared_folder(spark)}/tessera-stream-{uuid.uuid4().hex}"
    # a pattern, since a stream reads folders, and the table may be one file
    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    stream_windowed_counts(stream, f"{name}/counts", f"{name}/checkpoint").awaitTermination()
    schema = "window_start timestamp, event_type string, n long, total double"
    kept = spark.read.schema(schema).parquet(f"{name}/counts")
    # watermarks need a time with a zone; the stored one has none
    return kept.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 6)})


QUERIES = {
    f.__name__: f
    for f in (events_streamed, enclosing_interval, longest_prefix, patch_impact, tests_by_mention, validation_commands, entity_graph_edges, conditional_pivot, events_windowed)
}
_LC = " ".join(f"WHEN '{k}' THEN '{c}'" for k, (c, _) in workflow.LANGUAGE_COMMANDS.items())
_LX = " ".join(f"WHEN '{k}' THEN {x}" for k, (_, x) in workflow.LANGUAGE_COMMANDS.items())
SQL = {
    "enclosing_interval": C
    + """, sp AS (SELECT file_id, start_line, end_line, qname FROM symbols_c WHERE kind IN ('function', 'method', 'constructor', 'component', 'test_block') AND start_line <= end_line),
ln AS (SELECT edge_id, s.file_id, line FROM edges_c e JOIN symbols_c s ON e.src = s.qname WHERE line IS NOT NULL)
SELECT edge_id, arg_min(sp.qname, (end_line - start_line, sp.qname)) AS enclosing FROM ln LEFT JOIN sp ON ln.file_id = sp.file_id AND line BETWEEN start_line AND end_line GROUP BY 1""",
    "longest_prefix": C
    + """, n AS (SELECT DISTINCT target FROM imports_c WHERE target IS NOT NULL), p AS (SELECT DISTINCT qname AS prefix FROM symbols_c WHERE kind IN ('module', 'class', 'file_summary'))
SELECT target, arg_max(prefix, length(prefix)) AS matched FROM n LEFT JOIN p ON target = prefix OR starts_with(target, prefix || '.') GROUP BY 1""",
    "patch_impact": C
    + """, i AS (SELECT dst AS qname, count(DISTINCT src) FILTER (edge_type = 'CALLS') AS c, count(DISTINCT src) FILTER (edge_type IN ('ROUTES_TO', 'HANDLES_ROUTE', 'ROUTE_HANDLED_BY')) AS r,
  count(DISTINCT src) FILTER (edge_type IN ('TESTS', 'TESTS_SYMBOL')) AS t FROM edges_c WHERE dst IS NOT NULL AND src IS NOT NULL GROUP BY 1),
x AS (SELECT qname, coalesce(c, 0) AS n_callers, coalesce(r, 0) AS n_routes, coalesce(t, 0) AS n_tests FROM symbols_c LEFT JOIN i USING (qname) WHERE kind IN ('function', 'method', 'class'))
SELECT *, CASE WHEN regexp_matches(lower(qname), '(auth|login|session|token|secret|password|permission|payment|billing|crypt)') OR (n_routes >= 1 AND n_callers >= 5) THEN 'high'
  WHEN n_routes >= 1 OR n_callers >= 8 THEN 'medium' WHEN n_callers >= 3 AND n_tests = 0 THEN 'medium' ELSE 'low' END AS risk FROM x""",
    "tests_by_mention": C
    + r""", w AS (SELECT path, unnest(list_distinct(regexp_extract_all(coalesce(content, ''), '[A-Za-z_][A-Za-z0-9_]+'))) AS word FROM files_c WHERE regexp_matches(lower(path), '(^|/)(tests?|__tests__|spec)/|(^|/)test_|_test\.|\.(test|spec)\.')),
t AS (SELECT qname AS target, regexp_extract(path, '([^/.]+)[^/]*$', 1) AS stem FROM symbols_c JOIN files_c USING (file_id) WHERE kind IN ('function', 'method', 'class'))
SELECT target, path, max(c) AS confidence FROM w JOIN (SELECT target, split(target, '.')[-1] AS word, 0.78::DOUBLE AS c FROM t UNION ALL SELECT target, stem, 0.6 FROM t) x USING (word) GROUP BY 1, 2""",
    "validation_commands": C + f"SELECT DISTINCT split_part(path, '/', 1) AS repo, CASE language {_LC} END AS command, CAST(CASE language {_LX} END AS DOUBLE) AS confidence FROM files_c WHERE CASE language {_LC} END IS NOT NULL",
    "entity_graph_edges": """SELECT src, dst, edge_type, count(*) AS n FROM (SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, 'PLACED' AS edge_type FROM orders
UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'CONTAINS' FROM lineitem UNION ALL SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'SUPPLIED_BY' FROM lineitem
UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'IN_NATION' FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'IN_REGION' FROM nation) x GROUP BY 1, 2, 3""",
    "conditional_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS n_{k}" for k in ("signup", "error", "click", "view", "purchase")) + " FROM events GROUP BY 1",
    "events_streamed": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "events_windowed": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
}
