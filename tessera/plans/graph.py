"""Queries over the code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.sources import graph

CODE_KINDS = ("function", "method", "class", "struct", "constructor", "interface")


def degree_top(spark: SparkSession, d: str) -> DataFrame:
    total = g.degrees(graph.edges(spark, d)).withColumn("degree", F.col("callers") + F.col("callees"))
    return total.orderBy(F.desc("degree"), "qname").limit(10)


def degree_all(spark: SparkSession, d: str) -> DataFrame:
    return g.degrees(graph.edges(spark, d))


def _most_connected(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.edges(spark, d).where(F.col("edge_type").isin(*g.IMPACT_TYPES) & F.col("src").isNotNull() & F.col("dst").isNotNull())
    return edges.groupBy(F.col("dst").alias("qname")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "qname").limit(1).select("qname")


def impact_bfs(spark: SparkSession, d: str) -> DataFrame:
    return g.neighbourhood(graph.edges(spark, d), _most_connected(spark, d), 3)


def callers_callees(spark: SparkSession, d: str) -> DataFrame:
    return g.callers_and_callees(graph.edges(spark, d), graph.symbols(spark, d))


def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    return g.folder_rollup(graph.files(spark, d), graph.symbols(spark, d))


def containment(spark: SparkSession, d: str) -> DataFrame:
    return g.containment_edges(graph.files(spark, d), graph.symbols(spark, d))


def view_filter(spark: SparkSession, d: str) -> DataFrame:
    return g.view(graph.edges(spark, d), graph.symbols(spark, d), CODE_KINDS, ("CALLS", "EXTENDS", "IMPLEMENTS")).select("edge_id", "src", "dst", "edge_type")


def graph_trim(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.edges(spark, d, "confidence", "precision_level")
    return g.trim_graph(graph.symbols(spark, d), edges, 2000, 500).select("edge_id", "src", "dst", "confidence")


def graph_export(spark: SparkSession, d: str) -> DataFrame:
    return g.export_rows(graph.edges(spark, d).where("dst is not null"), graph.symbols(spark, d)).where("kept").drop("kept")


def graph_export_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = g.export_rows(graph.edges(spark, d).where("dst is not null"), graph.symbols(spark, d))
    return rows.groupBy("rel_type").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"))


def related_tests(spark: SparkSession, d: str) -> DataFrame:
    """Per symbol: tests that point at it by an edge, and test blocks in its file. Both are counted before the join, so a
    file or symbol with very many tests makes no pairs."""
    symbols = graph.symbols(spark, d)
    tests = graph.edges(spark, d).where("edge_type in ('TESTS', 'TESTS_SYMBOL') and dst is not null and src is not null")
    linked = tests.select("dst", "src").distinct().groupBy(F.col("dst").alias("qname")).agg(F.count("*").alias("n_linked"))
    beside = symbols.where("kind = 'test_block'").groupBy("file_id").agg(F.count("*").alias("n_beside"))
    found = symbols.where(F.col("kind").isin("function", "method", "class")).select("qname", "file_id").join(linked, "qname", "left").join(beside, "file_id", "left")
    return found.where("n_linked is not null or n_beside is not null").select("qname", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("n_beside", F.lit(0)).alias("n_beside"))


def substring_search(spark: SparkSession, d: str) -> DataFrame:
    """Files, symbols and routes that contain a word, scored by source; the best source of each id wins."""
    word = "token"
    found = graph.files(spark, d).where(F.lower("path").contains(word)).select(F.concat(F.lit("file:"), "path").alias("id"), F.lit(1.0).alias("score"))
    symbols = graph.symbols(spark, d).where(F.lower("qname").contains(word))
    named = symbols.select(F.concat(F.lit("symbol:"), "qname").alias("id"), F.when(F.col("kind") == "route", 0.8).otherwise(0.9).alias("score"))
    return found.unionByName(named).groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(50)


def suffix_lookup(spark: SparkSession, d: str) -> DataFrame:
    """For each name of an unresolved edge, how many symbols have it as name or last part of the qualified name."""
    names = graph.edges(spark, d).where("dst is null and dst_name is not null").select("dst_name").distinct()
    symbols = graph.symbols(spark, d).select("qname", F.explode(F.array_distinct(F.array("name", F.substring_index("qname", ".", -1)))).alias("dst_name"))
    return names.join(symbols, "dst_name").groupBy("dst_name").agg(F.count("*").alias("n_symbols"), F.min("qname").alias("first_qname"))


TYPES = ", ".join(f"'{t}'" for t in g.IMPACT_TYPES)
PRIORITY = " ".join(f"WHEN '{k}' THEN {v}" for k, v in g.KIND_PRIORITY.items())
C = graph.CANONICAL_SQL
DEGREES = C + """,
i AS (SELECT dst AS qname, count(*) AS callers FROM edges_c WHERE dst IS NOT NULL GROUP BY 1), o AS (SELECT src AS qname, count(*) AS callees FROM edges_c WHERE src IS NOT NULL GROUP BY 1),
deg AS (SELECT qname, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM i FULL JOIN o USING (qname))"""
PATHS = """list_transform(range(1, len(split(path, '/'))), lambda i: array_to_string(split(path, '/')[1:i], '/'))"""
QUERIES = {
    f.__name__: f
    for f in (
        degree_top, degree_all, impact_bfs, callers_callees, tree_rollup, containment, view_filter, graph_trim, graph_export, graph_export_counts,
        related_tests, substring_search, suffix_lookup,
    )
}
SQL = {
    "degree_top": DEGREES + "SELECT *, callers + callees AS degree FROM deg ORDER BY degree DESC, qname LIMIT 10",
    "degree_all": DEGREES + "SELECT * FROM deg",
    "impact_bfs": C
    + f""",
k AS (SELECT src, dst FROM edges_c WHERE edge_type IN ({TYPES}) AND src IS NOT NULL AND dst IS NOT NULL),
b AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k),
s AS (SELECT dst AS qname FROM k GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1),
bfs AS (SELECT qname, 0 AS depth FROM s UNION SELECT b.dst, bfs.depth + 1 FROM bfs JOIN b ON b.src = bfs.qname WHERE bfs.depth < 3)
SELECT qname, CAST(min(depth) AS INTEGER) AS depth FROM bfs GROUP BY 1""",
    "callers_callees": C
    + """, p AS (SELECT DISTINCT src, dst FROM edges_c WHERE edge_type = 'CALLS' AND dst IN (SELECT qname FROM symbols_c) AND src IN (SELECT qname FROM symbols_c))
SELECT src AS qname, dst AS neighbour, 'callee' AS direction FROM p UNION ALL SELECT dst, src, 'caller' FROM p""",
    "tree_rollup": C
    + f""", n AS (SELECT file_id, count(*) AS n FROM symbols_c GROUP BY 1), f AS (SELECT path, coalesce(n, 0) AS n FROM files_c LEFT JOIN n USING (file_id))
SELECT folder, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_symbols FROM (SELECT unnest(list_concat(['.'], {PATHS})) AS folder, n FROM f) x GROUP BY 1""",
    "containment": C
    + f""", fo AS (SELECT DISTINCT unnest({PATHS}) AS folder FROM files_c)
SELECT 'folder:' || regexp_extract(folder, '^(.*)/[^/]*$', 1) AS source, 'folder:' || folder AS target FROM fo WHERE contains(folder, '/')
UNION ALL SELECT 'folder:' || regexp_extract(path, '^(.*)/[^/]*$', 1), 'file:' || path FROM files_c WHERE contains(path, '/')
UNION ALL SELECT 'file:' || path, 'symbol:' || qname FROM symbols_c JOIN files_c USING (file_id)""",
    "view_filter": C
    + """, n AS (SELECT qname FROM symbols_c WHERE kind IN ('function', 'method', 'class', 'struct', 'constructor', 'interface'))
SELECT edge_id, src, dst, edge_type FROM edges_c WHERE edge_type IN ('CALLS', 'EXTENDS', 'IMPLEMENTS') AND src IN (SELECT qname FROM n) AND dst IN (SELECT qname FROM n)""",
    "graph_trim": C
    + f""", n AS (SELECT qname FROM symbols_c ORDER BY CASE kind {PRIORITY} ELSE 9 END, qname LIMIT 2000)
SELECT edge_id, src, dst, confidence FROM edges_c WHERE src IN (SELECT qname FROM n) AND dst IN (SELECT qname FROM n) ORDER BY confidence DESC NULLS LAST, precision_level NULLS FIRST, edge_id LIMIT 500""",
    "graph_export": C
    + """SELECT edge_id, 'symbol:' || src AS source, 'symbol:' || dst AS target, upper(array_to_string(regexp_extract_all(edge_type, '[A-Za-z0-9]+'), '_')) AS rel_type
FROM edges_c WHERE src IN (SELECT qname FROM symbols_c) AND dst IN (SELECT qname FROM symbols_c)""",
    "graph_export_counts": C
    + """, e AS (SELECT upper(array_to_string(regexp_extract_all(edge_type, '[A-Za-z0-9]+'), '_')) AS rel_type, a.qname IS NOT NULL AND b.qname IS NOT NULL AS kept
FROM edges_c LEFT JOIN symbols_c a ON a.qname = src LEFT JOIN symbols_c b ON b.qname = dst WHERE dst IS NOT NULL)
SELECT rel_type, count(*) AS n, count(*) FILTER (kept) AS kept, count(*) FILTER (NOT kept) AS skipped FROM e GROUP BY 1""",
    "related_tests": C
    + """, l AS (SELECT dst AS qname, count(DISTINCT src) AS n_linked FROM edges_c WHERE edge_type IN ('TESTS', 'TESTS_SYMBOL') AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1),
b AS (SELECT file_id, count(*) AS n_beside FROM symbols_c WHERE kind = 'test_block' GROUP BY 1)
SELECT qname, coalesce(n_linked, 0) AS n_linked, coalesce(n_beside, 0) AS n_beside FROM symbols_c LEFT JOIN l USING (qname) LEFT JOIN b USING (file_id)
WHERE kind IN ('function', 'method', 'class') AND (n_linked IS NOT NULL OR n_beside IS NOT NULL)""",
    "substring_search": C
    + """SELECT id, max(score) AS score FROM (SELECT 'file:' || path AS id, 1.0::DOUBLE AS score FROM files_c WHERE contains(lower(path), 'token')
UNION ALL SELECT 'symbol:' || qname, CASE WHEN kind = 'route' THEN 0.8 ELSE 0.9 END FROM symbols_c WHERE contains(lower(qname), 'token')) x GROUP BY 1 ORDER BY score DESC, id LIMIT 50""",
    "suffix_lookup": C
    + """, n AS (SELECT DISTINCT dst_name FROM edges_c WHERE dst IS NULL AND dst_name IS NOT NULL),
s AS (SELECT qname, name AS dst_name FROM symbols_c UNION SELECT qname, split(qname, '.')[-1] FROM symbols_c)
SELECT dst_name, count(*) AS n_symbols, min(qname) AS first_qname FROM n JOIN s USING (dst_name) GROUP BY 1""",
}
