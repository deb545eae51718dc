"""Queries of the general data problems, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.hierarchy import descendants, hierarchy, parent_links
from tessera.operators.references import orphan_references, orphans_by_period
from tessera.operators.skew import heavy_keys, key_results
from tessera.sources.tables import table

KEYS = ["edge_type", "dst_name"]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(
        table(spark, d, "edges", "id", "src_qname", "dst_qname", "created_at"),
        table(spark, d, "imports", "id", "target_qname"),
        table(spark, d, "symbols", "qualified_name", "file_id"),
        table(spark, d, "files", "id", "indexed_at"),
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).drop("created_at")


def p3_orphans_by_period(spark: SparkSession, d: str) -> DataFrame:
    return orphans_by_period(_orphans(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges", *KEYS, "src_qname", "confidence")
    return heavy_keys(key_results(edges, KEYS, distinct="src_qname", mean="confidence"), 0.02).select(*KEYS)


def p5_key_results(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edges", *KEYS, "src_qname", "confidence")
    # the matching side: the definitions of each name, one row per key and symbol row of that name
    symbols = table(spark, d, "symbols", "name").withColumnRenamed("name", "dst_name")
    side = edges.select(*KEYS).distinct().join(symbols, "dst_name")
    result = key_results(edges, KEYS, distinct="src_qname", mean="confidence", side=side)
    return result.withColumn("mean_confidence", F.round("mean_confidence", 6))


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(parent_links(table(spark, d, "symbols", "qualified_name", "parent_qname"), "qualified_name", "parent_qname"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    solved = _hierarchy(spark, d).where("depth >= 6 or depth < 0")
    return solved.select(F.col("node").alias("qualified_name"), F.col("root").alias("root_qname"), F.col("depth").cast("int").alias("depth"))


def p7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).select(
        F.col("node").alias("qualified_name"), F.col("root").alias("root_qname"), "depth", F.concat_ws(" > ", "path").alias("path"), "n_descendants"
    )


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_hierarchy(spark, d))


SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(160)"

ORPHANS_SQL = f"""
WITH refs AS (
  SELECT 'edges' AS ref_table, 'src_qname' AS ref_field, id AS row_id, nullif(trim(src_qname, {SPACE}), '') AS name, created_at FROM edges
  UNION ALL SELECT 'edges', 'dst_qname', id, nullif(trim(dst_qname, {SPACE}), ''), created_at FROM edges
  UNION ALL SELECT 'imports', 'target_qname', id, nullif(trim(target_qname, {SPACE}), ''), NULL FROM imports),
names AS (
  SELECT trim(s.qualified_name, {SPACE}) AS name, count(f.id) AS live, min(f.indexed_at) AS first_indexed
  FROM symbols s LEFT JOIN files f ON s.file_id = f.id GROUP BY 1),
orphans AS (
  SELECT ref_table, ref_field, row_id, created_at,
    CASE WHEN n.name IS NULL THEN 'missing' WHEN n.live = 0 THEN 'deleted'
         WHEN ref_table = 'edges' AND created_at < first_indexed THEN 'late' END AS ref_state
  FROM refs r LEFT JOIN names n ON r.name = n.name WHERE r.name IS NOT NULL)
"""

TREE_SQL = f"""
WITH RECURSIVE named AS (
  SELECT DISTINCT trim(qualified_name, {SPACE}) AS node, nullif(trim(parent_qname, {SPACE}), '') AS up FROM symbols
  WHERE trim(qualified_name, {SPACE}) <> ''),
links AS (SELECT a.node, min(b.node) AS up FROM named a LEFT JOIN (SELECT DISTINCT node FROM named) b ON a.up = b.node GROUP BY 1),
tree AS (
  SELECT node, node AS root, 0 AS depth, node AS path FROM links WHERE up IS NULL
  UNION ALL SELECT l.node, t.root, t.depth + 1, t.path || ' > ' || l.node FROM links l JOIN tree t ON l.up = t.node),
loose AS (SELECT * FROM links WHERE node NOT IN (SELECT node FROM tree)),
climb AS (
  SELECT node AS start, up AS spot, [node] AS seen FROM loose
  UNION ALL SELECT c.start, l.up, list_append(c.seen, c.spot) FROM climb c JOIN loose l ON c.spot = l.node WHERE NOT list_contains(c.seen, c.spot)),
cyclic AS (SELECT DISTINCT start AS node FROM climb WHERE spot = start),
pairs AS (
  SELECT l.up AS node, l.node AS descendant, 1 AS distance FROM links l JOIN tree t ON l.node = t.node WHERE l.up IS NOT NULL
  UNION ALL SELECT l.up, p.descendant, p.distance + 1 FROM pairs p JOIN links l ON p.node = l.node WHERE l.up IS NOT NULL)
"""

QUERIES = {
    f.__name__: f for f in (p3_found, p3_orphans_by_period, p5_found, p5_key_results, p7_found, p7_hierarchy, p7_descendants)
}

SQL = {
    "p3_found": ORPHANS_SQL + "SELECT ref_table, ref_field, row_id, ref_state FROM orphans WHERE ref_state IS NOT NULL",
    "p3_orphans_by_period": ORPHANS_SQL
    + """SELECT ref_table, ref_field, ref_state, coalesce(strftime(created_at, '%Y-%m'), 'unknown') AS period, count(*) AS n_refs
    FROM orphans WHERE ref_state IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "p5_found": """SELECT edge_type, dst_name FROM edges GROUP BY 1, 2 HAVING count(*) > 0.02 * (SELECT count(*) FROM edges)""",
    "p5_key_results": """
    WITH defs AS (SELECT name, count(*) AS n FROM symbols GROUP BY 1),
    per_key AS (SELECT edge_type, dst_name, count(*) AS n_rows, count(confidence) AS n_confidence,
      round(avg(confidence), 6) AS mean_confidence, count(DISTINCT src_qname) AS distinct_src_qname FROM edges GROUP BY 1, 2)
    SELECT k.*, CAST(n_rows * coalesce(d.n, 0) AS BIGINT) AS n_matches FROM per_key k LEFT JOIN defs d ON k.dst_name = d.name""",
    "p7_found": TREE_SQL
    + """SELECT node AS qualified_name, root AS root_qname, CAST(depth AS INTEGER) AS depth FROM tree WHERE depth >= 6
    UNION ALL SELECT node, '', CAST(CASE WHEN node IN (SELECT node FROM cyclic) THEN -1 ELSE -2 END AS INTEGER) FROM loose""",
    "p7_hierarchy": TREE_SQL
    + """SELECT t.node AS qualified_name, root AS root_qname, CAST(depth AS INTEGER) AS depth, path, coalesce(n, 0) AS n_descendants
    FROM tree t LEFT JOIN (SELECT node, count(*) AS n FROM pairs GROUP BY 1) p ON t.node = p.node
    UNION ALL SELECT node, '', CAST(CASE WHEN node IN (SELECT node FROM cyclic) THEN -1 ELSE -2 END AS INTEGER), '', NULL FROM loose""",
    "p7_descendants": TREE_SQL + "SELECT node, descendant, CAST(distance AS INTEGER) AS distance FROM pairs",
}
