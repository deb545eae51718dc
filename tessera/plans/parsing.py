"""Parsing of the stored files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.operators import postings
from tessera.session import shared_folder
from tessera.sources import graph, parsers, sinks
from tessera.sources.tables import spread, table


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    """All records of all stored files, parsed once for each state of the files and kept in the shared folder."""
    mark = postings.fingerprint(table(spark, d, "files"))
    path = f"{shared_folder(spark)}/tessera-parsed-{mark}"
    if not postings.complete(spark, path):
        parsers.parse_files(spread(graph.files(spark, d, content=True))).write.mode("overwrite").partitionBy("record").parquet(path)
    return spark.read.schema(parsers.SCHEMA).parquet(path)


def parse_symbols(spark: SparkSession, d: str) -> DataFrame:
    return parsers.symbols_of(_parsed(spark, d))


def parse_edges(spark: SparkSession, d: str) -> DataFrame:
    return parsers.edges_of(_parsed(spark, d))


def parse_imports(spark: SparkSession, d: str) -> DataFrame:
    return parsers.imports_of(_parsed(spark, d))


def parse_parameters(spark: SparkSession, d: str) -> DataFrame:
    return parsers.parameters_of(_parsed(spark, d))


def graph_payload(spark: SparkSession, d: str) -> DataFrame:
    symbols = graph.symbols(spark, d).select("qname", "kind", "name")
    edges = g.export_rows(graph.edges(spark, d).where("dst is not null"), symbols).where("kept").select("edge_id", "source", "target", "rel_type")
    return sinks.graph_payload(symbols, edges)


def line_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines and estimated tokens of each stored file."""
    n = F.length("content")
    lines = n - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1
    tokens = F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4)))
    return graph.files(spark, d, content=True).where("content is not null").select("path", lines.alias("n_lines"), tokens.cast("long").alias("n_tokens"))


QUERIES = {f.__name__: f for f in (parse_symbols, parse_edges, parse_imports, parse_parameters, graph_payload, line_counts)}
SQL = {
    "graph_payload": graph.CANONICAL_SQL
    + """SELECT 'node' AS part, CAST(json_object('qname', qname, 'kind', kind, 'name', name) AS VARCHAR) AS payload FROM symbols_c UNION ALL
SELECT 'edge', CAST(json_object('edge_id', edge_id, 'source', 'symbol:' || src, 'target', 'symbol:' || dst, 'rel_type', upper(array_to_string(regexp_extract_all(edge_type, '[A-Za-z0-9]+'), '_'))) AS VARCHAR)
FROM edges_c WHERE src IN (SELECT qname FROM symbols_c) AND dst IN (SELECT qname FROM symbols_c)""",
    "line_counts": graph.CANONICAL_SQL
    + "SELECT path, length(content) - length(replace(content, chr(10), '')) + 1 AS n_lines, CAST(CASE WHEN length(content) = 0 THEN 0 ELSE greatest(1, floor(length(content) / 4)) END AS BIGINT) AS n_tokens FROM files_c WHERE content IS NOT NULL"
}
