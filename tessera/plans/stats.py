"""Counts and health figures of the index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources import graph
from tessera.sources.tables import table

C = graph.CANONICAL_SQL


def file_languages(spark: SparkSession, d: str) -> DataFrame:
    return graph.files(spark, d).groupBy(F.coalesce("language", F.lit("unknown")).alias("language")).agg(F.count("*").alias("n_files"))


def symbols_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbols(spark, d).groupBy("kind").agg(F.count("*").alias("n_symbols"), F.count_distinct("file_id").alias("n_files"))


def edges_by_type(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(spark, d, "confidence").groupBy("edge_type").agg(F.count("*").alias("n_edges"), F.round(F.avg("confidence"), 6).alias("confidence"))


# The counters of framework objects: kinds of symbols, types of edges.
FRAMEWORK_KINDS = ("route", "test_block", "model", "api_consumer", "component", "env_var", "constant", "config_key")
FRAMEWORK_TYPES = ("HANDLES_ROUTE", "TESTS", "QUERIES", "FETCHES", "CALLS_EXTERNAL", "USES_MIDDLEWARE", "READS_ENV_VAR", "READS_CONSTANT", "READS_CONFIG_KEY")


def framework_pivot(spark: SparkSession, d: str) -> DataFrame:
    k = graph.symbols(spark, d).agg(*[F.count_if(F.col("kind") == x).alias(f"kind_{x}") for x in FRAMEWORK_KINDS])
    t = graph.edges(spark, d).agg(*[F.count_if(F.col("edge_type") == x).alias(f"type_{x.lower()}") for x in FRAMEWORK_TYPES])
    return k.crossJoin(t)


# Prefixes of names that frameworks give.
FRAMEWORKS = ("express", "fastify", "nextjs", "fastapi", "flask", "django", "pytest", "jest", "prisma", "orm", "schema", "env", "config", "http", "spring", "react")


def file_frameworks(spark: SparkSession, d: str) -> DataFrame:
    """Files in which each framework shows, by the prefix of the names that it gives."""
    prefix = F.substring_index("qname", "::", 1)
    rows = graph.symbols(spark, d).where(F.contains("qname", F.lit("::")) & prefix.isin(*FRAMEWORKS))
    return rows.groupBy(prefix.alias("framework")).agg(F.count_distinct("file_id").alias("n_files"), F.count("*").alias("n_symbols"))


def repo_map(spark: SparkSession, d: str) -> DataFrame:
    top = F.when(F.instr("path", "/") > 0, F.substring_index("path", "/", 1)).otherwise("(root)")
    return graph.files(spark, d).groupBy(top.alias("folder")).agg(F.count("*").alias("n_files")).orderBy(F.desc("n_files"), "folder").limit(12)


def file_symbol_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = graph.symbols(spark, d).groupBy("file_id").agg(F.count("*").alias("n"))
    return graph.files(spark, d).join(counts, "file_id", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_symbols"))


def return_type_counts(spark: SparkSession, d: str) -> DataFrame:
    typed = graph.symbols(spark, d, "return_type", "declared_type")
    name = F.coalesce(F.nullif("declared_type", F.lit("")), F.nullif("return_type", F.lit("")), F.lit("(unknown)"))
    return typed.groupBy(name.alias("type")).agg(F.count("*").alias("n"))


def symbol_capsules(spark: SparkSession, d: str) -> DataFrame:
    """One card per symbol: kind, name, file, signature and the first twelve distinct calls."""
    calls = graph.edges(spark, d).where("edge_type = 'CALLS' and dst_name is not null").select("src", "dst_name").distinct()
    listed = calls.groupBy(F.col("src").alias("qname")).agg(F.array_sort(F.collect_set("dst_name")).alias("calls"))
    line = F.concat(F.array_join(F.slice("calls", 1, 12), ", "), F.when(F.size("calls") > 12, " …").otherwise(""))
    cards = graph.symbols(spark, d, "signature").join(graph.files(spark, d).select("file_id", "path"), "file_id", "left").join(listed, "qname", "left")
    text = F.concat_ws("\n", F.concat_ws(" ", "kind", "qname"), F.concat(F.lit("file: "), "path"), F.nullif("signature", F.lit("")), F.concat(F.lit("calls: "), line))
    return cards.select("qname", text.alias("capsule"))


def doctor(spark: SparkSession, d: str) -> DataFrame:
    """Health figures as ``metric, key, value``."""
    files, symbols, edges = graph.files(spark, d), graph.symbols(spark, d), graph.edges(spark, d)

    def rows(df: DataFrame, metric: str, key, value: str) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), key.alias("key"), F.col(value).cast("double").alias("value"))

    one = F.lit("")
    owners = symbols.select(F.col("qname").alias("src"), "file_id")
    open_edges = edges.where("dst is null").groupBy("src").agg(F.count("*").alias("n")).join(owners, "src", "left").join(files.select("file_id", "language"), "file_id", "left")
    imports = graph.imports(spark, d)
    typed = graph.symbols(spark, d, "return_type", "declared_type")
    type_name = F.coalesce(F.nullif("declared_type", F.lit("")), F.nullif("return_type", F.lit("")), F.lit("(unknown)"))
    backends = table(spark, d, "symbols", "parser_backend").groupBy("parser_backend").agg(F.count("*").alias("n"))
    framework = framework_pivot(spark, d)
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("n")) for c in framework.columns])
    parts = [
        rows(files.agg(F.count("language").alias("n")), "files_with_language", one, "n"),
        rows(files.agg(F.datediff(F.max(F.to_date("indexed_at")), F.lit("1970-01-01").cast("date")).alias("n")), "last_indexed_day", one, "n"),
        rows(symbols.agg(F.count_if(F.col("kind") == "file_summary").alias("n")), "parser_fallbacks", one, "n"),
        rows(edges.agg(F.count_if(F.col("dst").isNull()).alias("n")), "unresolved_edges", one, "n"),
        rows(edges.agg(F.coalesce(F.round(F.count("dst") / F.count("*"), 6), F.lit(0.0)).alias("n")), "edge_resolution_rate", one, "n"),
        rows(edges.where("dst is not null").groupBy("edge_type").agg(F.count("*").alias("n")), "resolved_by_type", F.col("edge_type"), "n"),
        rows(open_edges.groupBy(F.coalesce("language", F.lit("unknown")).alias("key")).agg(F.sum("n").alias("n")), "unresolved_by_language", F.col("key"), "n"),
        rows(imports.agg(F.count("*").alias("n")), "import_bindings", one, "n"),
        rows(imports.agg(F.count("target").alias("n")), "bound_imports", one, "n"),
        rows(table(spark, d, "embeddings", "vec_id").agg(F.count("*").alias("n")), "embeddings", one, "n"),
        rows(typed.groupBy(type_name.alias("key")).agg(F.count("*").alias("n")), "symbols_by_type", F.col("key"), "n"),
        rows(backends, "rows_by_parser", F.coalesce("parser_backend", F.lit("")), "n"),
        rows(framework.select(F.inline(pairs)), "framework", F.col("key"), "n"),
        rows(file_frameworks(spark, d), "files_by_framework", F.col("framework"), "n_files"),
        rows(files.agg(F.count("*").alias("n")), "files", one, "n"),
        rows(symbols.agg(F.count("*").alias("n")), "symbols", one, "n"),
        rows(edges.agg(F.count("*").alias("n")), "edges", one, "n"),
        rows(edges.agg(F.count("dst").alias("n")), "resolved_edges", one, "n"),
        rows(files.groupBy("language").agg(F.count("*").alias("n")), "files_by_language", F.coalesce("language", F.lit("unknown")), "n"),
        rows(symbols.groupBy("kind").agg(F.count("*").alias("n")), "symbols_by_kind", F.col("kind"), "n"),
        rows(edges.groupBy("edge_type").agg(F.count("*").alias("n")), "edges_by_type", F.col("edge_type"), "n"),
        rows(symbols.join(files, "file_id", "left_anti").agg(F.count("*").alias("n")), "symbols_without_file", one, "n"),
    ]
    return reduce(DataFrame.unionByName, parts)


def event_json_props(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events", "event_type", "props")
    k = F.get_json_object("props", "$.k").cast("long")
    return events.groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


def event_latest_per_user(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "user_id", "event_id", "ts", "event_type").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


def event_latency_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and the p95 of the index rule, per event type; ranks are taken per type over values counted first."""
    counted = table(spark, d, "events", "event_type", "value").where("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy("event_type"))})
    place = F.greatest(F.floor(F.col("total") * 0.95), F.lit(1))
    mid = lambda k: F.min(F.when(F.col("upto") >= k, F.col("value")))
    return placed.groupBy("event_type").agg(
        F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6).alias("mean"),
        F.round((mid(F.floor((F.col("total") + 1) / 2)) + mid(F.floor(F.col("total") / 2) + 1)) / 2, 6).alias("median"),
        mid(place).alias("p95"),
    )


FRAMEWORK_SQL = (
    ", fw AS (SELECT * FROM (SELECT "
    + ", ".join(f"count(*) FILTER (kind = '{k}') AS kind_{k}" for k in FRAMEWORK_KINDS)
    + " FROM symbols_c) a CROSS JOIN (SELECT "
    + ", ".join(f"count(*) FILTER (edge_type = '{t}') AS type_{t.lower()}" for t in FRAMEWORK_TYPES)
    + " FROM edges_c) b)"
)
_UNPIVOT = " ".join(f"UNION ALL SELECT 'framework', '{c}', {c} FROM fw" for c in (*(f"kind_{k}" for k in FRAMEWORK_KINDS), *(f"type_{t.lower()}" for t in FRAMEWORK_TYPES)))
QUERIES = {
    f.__name__: f
    for f in (
        file_languages, symbols_by_kind, edges_by_type, framework_pivot, file_frameworks, repo_map, file_symbol_counts, return_type_counts, symbol_capsules, doctor,
        event_json_props, event_latest_per_user, event_latency_summary,
    )
}
SQL = {
    "file_languages": C + "SELECT coalesce(language, 'unknown') AS language, count(*) AS n_files FROM files_c GROUP BY 1",
    "symbols_by_kind": C + "SELECT kind, count(*) AS n_symbols, count(DISTINCT file_id) AS n_files FROM symbols_c GROUP BY 1",
    "edges_by_type": C + "SELECT edge_type, count(*) AS n_edges, round(avg(confidence), 6) AS confidence FROM edges_c GROUP BY 1",
    "framework_pivot": C + FRAMEWORK_SQL.removeprefix(", fw AS (").removesuffix(")"),
    "file_frameworks": C
    + f"SELECT split_part(qname, '::', 1) AS framework, count(DISTINCT file_id) AS n_files, count(*) AS n_symbols FROM symbols_c WHERE contains(qname, '::') AND split_part(qname, '::', 1) IN ({', '.join(repr(x) for x in FRAMEWORKS)}) GROUP BY 1",
    "repo_map": C + "SELECT CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS folder, count(*) AS n_files FROM files_c GROUP BY 1 ORDER BY n_files DESC, folder LIMIT 12",
    "file_symbol_counts": C + "SELECT path, count(symbol_id) AS n_symbols FROM files_c LEFT JOIN symbols_c USING (file_id) GROUP BY 1",
    "return_type_counts": C + "SELECT coalesce(nullif(declared_type, ''), nullif(return_type, ''), '(unknown)') AS type, count(*) AS n FROM symbols_c GROUP BY 1",
    "symbol_capsules": C
    + """, l AS (SELECT src AS qname, list_sort(list(DISTINCT dst_name)) AS calls FROM edges_c WHERE edge_type = 'CALLS' AND dst_name IS NOT NULL GROUP BY 1)
SELECT qname, concat_ws(chr(10), concat_ws(' ', kind, qname), 'file: ' || path, nullif(signature, ''),
  'calls: ' || array_to_string(calls[1:12], ', ') || CASE WHEN len(calls) > 12 THEN ' …' ELSE '' END) AS capsule FROM symbols_c LEFT JOIN files_c USING (file_id) LEFT JOIN l USING (qname)""",
    "doctor": C
    + FRAMEWORK_SQL
    + """ SELECT 'files' AS metric, '' AS key, count(*)::DOUBLE AS value FROM files_c UNION ALL SELECT 'symbols', '', count(*) FROM symbols_c UNION ALL SELECT 'edges', '', count(*) FROM edges_c
UNION ALL SELECT 'resolved_edges', '', count(dst) FROM edges_c UNION ALL SELECT 'files_by_language', coalesce(language, 'unknown'), count(*) FROM files_c GROUP BY 2
UNION ALL SELECT 'symbols_by_kind', kind, count(*) FROM symbols_c GROUP BY 2 UNION ALL SELECT 'edges_by_type', edge_type, count(*) FROM edges_c GROUP BY 2
UNION ALL SELECT 'symbols_without_file', '', count(*) FROM symbols_c WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM files_c)
UNION ALL SELECT 'files_with_language', '', count(language) FROM files_c UNION ALL SELECT 'last_indexed_day', '', date_diff('day', DATE '1970-01-01', CAST(max(indexed_at) AS DATE)) FROM files_c
UNION ALL SELECT 'parser_fallbacks', '', count(*) FROM symbols_c WHERE kind = 'file_summary' UNION ALL SELECT 'unresolved_edges', '', count(*) FROM edges_c WHERE dst IS NULL
UNION ALL SELECT 'edge_resolution_rate', '', coalesce(round(count(dst) / count(*)::DOUBLE, 6), 0.0) FROM edges_c UNION ALL SELECT 'resolved_by_type', edge_type, count(*) FROM edges_c WHERE dst IS NOT NULL GROUP BY 2
UNION ALL SELECT 'unresolved_by_language', coalesce(language, 'unknown'), count(*) FROM edges_c e LEFT JOIN symbols_c s ON e.src = s.qname LEFT JOIN files_c f ON s.file_id = f.file_id WHERE e.dst IS NULL GROUP BY 2
UNION ALL SELECT 'import_bindings', '', count(*) FROM imports_c UNION ALL SELECT 'bound_imports', '', count(target) FROM imports_c UNION ALL SELECT 'embeddings', '', count(*) FROM embeddings
UNION ALL SELECT 'symbols_by_type', coalesce(nullif(declared_type, ''), nullif(return_type, ''), '(unknown)'), count(*) FROM symbols_c GROUP BY 2 UNION ALL SELECT 'rows_by_parser', coalesce(parser_backend, ''), count(*) FROM symbols GROUP BY 2 """
    + _UNPIVOT
    + f" UNION ALL SELECT 'files_by_framework', split_part(qname, '::', 1), count(DISTINCT file_id) FROM symbols_c WHERE contains(qname, '::') AND split_part(qname, '::', 1) IN ({', '.join(repr(x) for x in FRAMEWORKS)}) GROUP BY 2",
    "event_json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1",
    "event_latest_per_user": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "event_latency_summary": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) FILTER (r = greatest(CAST(floor(n * 0.95) AS BIGINT), 1)) AS p95 FROM r GROUP BY 1""",
}
