"""Edge resolution and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import resolution as r
from tessera.sources import graph


def _resolved(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return r.resolve_edges(graph.edges(spark, d, *columns), graph.symbols(spark, d), graph.files(spark, d), graph.imports(spark, d))


def scope_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d).select("edge_id", "resolved", "strategy")


def resolution_audit(spark: SparkSession, d: str) -> DataFrame:
    return r.audited(_resolved(spark, d, "precision_level", "extraction_source", "reason")).select(
        "edge_id", "resolved", "precision_level", "extraction_source", "reason"
    )


def resolution_strategy_counts(spark: SparkSession, d: str) -> DataFrame:
    buckets = spark.createDataFrame([(s,) for s in (*r.PASSES, "given")], "strategy string")
    counts = _resolved(spark, d).where("strategy is not null").groupBy("strategy").agg(F.count("*").alias("n"))
    return buckets.join(counts, "strategy", "left").select("strategy", F.coalesce("n", F.lit(0)).alias("n"))


def resolve_import_bindings(spark: SparkSession, d: str) -> DataFrame:
    return r.resolve_bindings(graph.imports(spark, d), graph.symbols(spark, d), graph.files(spark, d)).select("import_id", "target")


def _rate(part: str, whole: str):
    return F.coalesce(F.round(F.try_divide(F.col(part), F.col(whole)), 6), F.lit(0.0))


def edge_resolution_stats(spark: SparkSession, d: str) -> DataFrame:
    total = graph.edges(spark, d).agg(F.count("*").alias("total"), F.count("dst").alias("resolved"))
    return total.select("total", "resolved", (F.col("total") - F.col("resolved")).alias("unresolved"), _rate("resolved", "total").alias("resolution_rate"))


def name_resolution_rates(spark: SparkSession, d: str) -> DataFrame:
    per_type = graph.edges(spark, d).groupBy("edge_type").agg(F.count("*").alias("total"), F.count("dst").alias("resolved"))
    return per_type.select("edge_type", "total", "resolved", (F.col("total") - F.col("resolved")).alias("unresolved"), _rate("resolved", "total").alias("resolution_rate"))


def unresolved_by_language(spark: SparkSession, d: str) -> DataFrame:
    open_edges = graph.edges(spark, d).where("dst is null").groupBy("src").agg(F.count("*").alias("n"))
    owners = graph.symbols(spark, d).select(F.col("qname").alias("src"), "file_id")
    langs = graph.files(spark, d).select("file_id", "language")
    joined = open_edges.join(owners, "src", "left").join(langs, "file_id", "left")
    return joined.groupBy(F.coalesce(F.nullif("language", F.lit("")), F.lit("unknown")).alias("language")).agg(F.sum("n").alias("n_edges"))


def stored_strategy_counts(spark: SparkSession, d: str) -> DataFrame:
    source = F.lower(F.coalesce("extraction_source", F.lit("")))
    bucket = (
        F.when(source.contains("import-alias-resolver"), "import_alias")
        .when(source.contains("edge-resolver:file_scope"), "file_scope")
        .when(source.contains("edge-resolver:class_scope"), "class_scope")
        .when((source != "") & ~source.isin("ast", "regex", "tree-sitter", "syntax"), "parser_resolved")
        .otherwise("unique_name")
    )
    buckets = spark.createDataFrame([(b,) for b in ("import_alias", "file_scope", "class_scope", "unique_name", "parser_resolved")], "strategy string")
    counts = graph.edges(spark, d, "extraction_source").where("dst is not null").groupBy(bucket.alias("strategy")).agg(F.count("*").alias("n"))
    return buckets.join(counts, "strategy", "left").select("strategy", F.coalesce("n", F.lit(0)).alias("n"))


def top_unresolved_names(spark: SparkSession, d: str) -> DataFrame:
    open_edges = graph.edges(spark, d).where("dst is null and dst_name is not null")
    return open_edges.groupBy("dst_name", "edge_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst_name", "edge_type").limit(25)


BINDINGS_SQL = (
    graph.CANONICAL_SQL
    + r""",
named AS (SELECT *, coalesce(source_module, '') AS m, imported_name IS NOT NULL AND imported_name NOT IN ('default', '*') AS is_named,
  split(path, '/') AS pp, regexp_replace(replace(regexp_replace(path, '\.[A-Za-z0-9]+$', ''), '/', '.'), '$', '') AS owner FROM imports_c),
steps AS (SELECT *, list_filter(split(m, '/'), lambda x: x <> '' AND x <> '.') AS st, length(regexp_extract(m, '^(\.+)', 1)) AS dots, regexp_replace(m, '^\.+', '') AS tail, split(owner, '.') AS op FROM named),
ups AS (SELECT *, len(list_filter(st, lambda x: x = '..')) AS n_up, list_filter(st, lambda x: x <> '..') AS down FROM steps),
walked AS (SELECT *, list_concat(pp[1:greatest(len(pp) - 1 - n_up, 0)], down) AS w FROM ups),
targets AS (SELECT *, CASE WHEN regexp_matches(m, '^\.\.?/') THEN array_to_string(CASE WHEN w[-1] = 'index' THEN w[1:len(w) - 1] ELSE w END, '.')
  ELSE array_to_string(list_filter(list_append(CASE WHEN dots <= len(op) THEN op[1:len(op) - dots] ELSE [] END, tail), lambda x: x <> ''), '.') END AS t FROM walked),
cands AS (SELECT import_id, path, local_name, list_filter(CASE WHEN starts_with(m, '.') THEN
    CASE WHEN t <> '' THEN [CASE WHEN is_named THEN t || '.' || imported_name END, t] ELSE [] END
  ELSE [CASE WHEN is_named AND m <> '' THEN m || '.' || imported_name END, CASE WHEN m <> '' THEN m END, CASE WHEN is_named THEN imported_name END] END, lambda x: x IS NOT NULL) AS c FROM targets),
tried AS (SELECT import_id, path, local_name, unnest(c) AS qname, generate_subscripts(c, 1) AS place FROM cands),
bound AS (SELECT import_id, path, local_name, arg_min(tried.qname, place) AS target FROM tried JOIN symbols_c USING (qname) GROUP BY 1, 2, 3)"""
)
RESOLVE_SQL = (
    BINDINGS_SQL
    + """,
aliases AS (SELECT path, local_name AS dst_name, arg_max(target, import_id) AS alias_target FROM bound WHERE local_name IS NOT NULL GROUP BY 1, 2),
owners AS (SELECT qname AS src, s.file_id AS f, parent AS p, path FROM symbols_c s LEFT JOIN files_c USING (file_id)),
in_file AS (SELECT file_id AS f, name AS dst_name, min(qname) AS ft FROM symbols_c GROUP BY 1, 2 HAVING count(*) = 1),
in_class AS (SELECT parent AS p, name AS dst_name, min(qname) AS ct FROM symbols_c WHERE parent IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1),
anywhere AS (SELECT name AS dst_name, min(qname) AS ut FROM symbols_c GROUP BY 1 HAVING count(*) = 1),
final AS (
  SELECT e.*, coalesce(alias_target, CASE WHEN ft <> e.src THEN ft END, CASE WHEN ct <> e.src THEN ct END, ut) AS resolved,
    CASE WHEN alias_target IS NOT NULL THEN 'import_alias' WHEN ft <> e.src THEN 'file_scope' WHEN ct <> e.src THEN 'class_scope' WHEN ut IS NOT NULL THEN 'unique_name' END AS strategy
  FROM edges_c e LEFT JOIN owners o ON e.src = o.src LEFT JOIN aliases a ON a.path = o.path AND a.dst_name = e.dst_name
    LEFT JOIN in_file i ON i.f = o.f AND i.dst_name = e.dst_name LEFT JOIN in_class c ON c.p = o.p AND c.dst_name = e.dst_name LEFT JOIN anywhere w ON w.dst_name = e.dst_name
  WHERE e.dst IS NULL AND e.dst_name IS NOT NULL
  UNION ALL SELECT e.*, e.dst, CASE WHEN e.dst IS NOT NULL THEN 'given' END FROM edges_c e WHERE e.dst IS NOT NULL OR e.dst_name IS NULL)"""
)
RATE = "coalesce(round(CAST(resolved AS DOUBLE) / nullif(total, 0), 6), 0.0) AS resolution_rate"
QUERIES = {
    f.__name__: f
    for f in (
        scope_resolution, resolution_audit, resolution_strategy_counts, resolve_import_bindings, edge_resolution_stats, name_resolution_rates,
        unresolved_by_language, stored_strategy_counts, top_unresolved_names,
    )
}
SQL = {
    "scope_resolution": RESOLVE_SQL + "SELECT edge_id, resolved, strategy FROM final",
    "resolution_audit": RESOLVE_SQL
    + """, t AS (SELECT *, strategy IN ('import_alias', 'file_scope', 'class_scope') AS traced, trim(coalesce(extraction_source, '')) AS es,
      CASE WHEN strategy = 'import_alias' THEN 'import-alias-resolver' ELSE 'edge-resolver:' || strategy END AS tag FROM final)
    SELECT edge_id, resolved, CASE WHEN traced THEN greatest(precision_level, 2) ELSE precision_level END AS precision_level,
      CASE WHEN traced THEN CASE WHEN es = '' THEN tag ELSE es || '+' || tag END ELSE extraction_source END AS extraction_source,
      CASE WHEN traced THEN CASE WHEN strategy = 'import_alias' THEN 'Resolved via import alias' ELSE 'Resolved via ' || strategy END ELSE reason END AS reason FROM t""",
    "resolution_strategy_counts": RESOLVE_SQL
    + "SELECT strategy, count(edge_id) AS n FROM (VALUES ('import_alias'), ('file_scope'), ('class_scope'), ('unique_name'), ('given')) b(strategy) LEFT JOIN final USING (strategy) GROUP BY 1",
    "resolve_import_bindings": BINDINGS_SQL + "SELECT import_id, target FROM bound",
    "edge_resolution_stats": graph.CANONICAL_SQL + f"SELECT total, resolved, total - resolved AS unresolved, {RATE} FROM (SELECT count(*) AS total, count(dst) AS resolved FROM edges_c) x",
    "name_resolution_rates": graph.CANONICAL_SQL
    + f"SELECT edge_type, total, resolved, total - resolved AS unresolved, {RATE} FROM (SELECT edge_type, count(*) AS total, count(dst) AS resolved FROM edges_c GROUP BY 1) x",
    "unresolved_by_language": graph.CANONICAL_SQL
    + """SELECT coalesce(nullif(f.language, ''), 'unknown') AS language, count(*) AS n_edges FROM edges_c e LEFT JOIN symbols_c s ON e.src = s.qname
      LEFT JOIN files_c f ON s.file_id = f.file_id WHERE e.dst IS NULL GROUP BY 1""",
    "stored_strategy_counts": graph.CANONICAL_SQL
    + """, b AS (SELECT CASE WHEN contains(x, 'import-alias-resolver') THEN 'import_alias' WHEN contains(x, 'edge-resolver:file_scope') THEN 'file_scope'
      WHEN contains(x, 'edge-resolver:class_scope') THEN 'class_scope' WHEN x <> '' AND x NOT IN ('ast', 'regex', 'tree-sitter', 'syntax') THEN 'parser_resolved' ELSE 'unique_name' END AS strategy
      FROM (SELECT lower(coalesce(extraction_source, '')) AS x FROM edges_c WHERE dst IS NOT NULL) q)
    SELECT v.strategy, count(b.strategy) AS n FROM (VALUES ('import_alias'), ('file_scope'), ('class_scope'), ('unique_name'), ('parser_resolved')) v(strategy) LEFT JOIN b USING (strategy) GROUP BY 1""",
    "top_unresolved_names": graph.CANONICAL_SQL
    + "SELECT dst_name, edge_type, count(*) AS n FROM edges_c WHERE dst IS NULL AND dst_name IS NOT NULL GROUP BY 1, 2 ORDER BY n DESC, dst_name, edge_type LIMIT 25",
}
