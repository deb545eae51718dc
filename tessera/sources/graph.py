"""The stored code graph in canonical form: one row per path and per qualified name, names without blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import name_or_null, stripped
from tessera.sources.tables import table

# Language by file extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php",
    "cs": "csharp", "cpp": "cpp", "cc": "cpp", "h": "cpp", "hpp": "cpp", "c": "c", "kt": "kotlin", "swift": "swift",
    "scala": "scala", "md": "markdown",
}


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def language_of(path: Column | str) -> Column:
    """The language that an extension stands for; null for others."""
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(names, extension(path))


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in ``order``; ties must be broken by the caller."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def with_contents(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """``rows`` with the ``content`` of their ``id``, which is unique in both. Ids that are small enough for Spark's own
    broadcast limit go to the scan of the contents; else both sides are shuffled once by id."""
    return contents.join(rows, "id").select(*rows.columns, "content")


def files(spark: SparkSession, d: str, content: bool = False) -> DataFrame:
    """One row per path, the one indexed last: ``file_id, path, language, hash, size_bytes, indexed_at`` (``content``).

    Rows are ranked without their contents; with ``content`` those of the chosen ids are read by a scan of their own.
    """
    rows = table(spark, d, "files", "id", "path", "hash", "size_bytes", "indexed_at").where("path is not null")
    rows = latest(rows, "path", F.col("indexed_at").desc_nulls_last(), F.desc("id"))
    if content:
        rows = with_contents(rows, table(spark, d, "files", "id", "content"))
    return rows.withColumnRenamed("id", "file_id").withColumn("language", language_of("path"))


def symbols(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """One row per qualified name, the one inserted last: ``symbol_id, file_id, kind, name, qname, parent`` and ``columns``."""
    rows = table(spark, d, "symbols", "id", "file_id", "kind", "name", "qualified_name", "parent_qname", *columns)
    named = rows.select(
        F.col("id").alias("symbol_id"), "file_id", F.lower(stripped("kind")).alias("kind"), stripped("name").alias("name"),
        name_or_null("qualified_name").alias("qname"), name_or_null("parent_qname").alias("parent"), *columns,
    )
    return latest(named.where("qname is not null"), "qname", F.desc("symbol_id"))


def edges(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Edge rows with stripped names; a blank target is an unresolved one: ``edge_id, src, dst, dst_name, edge_type``."""
    rows = table(spark, d, "edges", "id", "src_qname", "dst_qname", "dst_name", "edge_type", *columns)
    return rows.select(
        F.col("id").alias("edge_id"), name_or_null("src_qname").alias("src"), name_or_null("dst_qname").alias("dst"),
        name_or_null("dst_name").alias("dst_name"), "edge_type", *columns,
    )


def imports(spark: SparkSession, d: str) -> DataFrame:
    """Import bindings with stripped names: ``import_id, path, imported_name, target, local_name, source_module``."""
    rows = table(spark, d, "imports", "id", "file_path", "imported_name", "target_qname", "local_name", "source_module")
    return rows.select(
        F.col("id").alias("import_id"), stripped("file_path").alias("path"), name_or_null("imported_name").alias("imported_name"),
        name_or_null("target_qname").alias("target"), name_or_null("local_name").alias("local_name"), name_or_null("source_module").alias("source_module"),
    )


SPACE = "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(32)||chr(160)"
_LANG = " ".join(f"WHEN '{e}' THEN '{l}'" for e, l in LANGUAGES.items())
#: the same canonical tables in SQL: files_c, symbols_c, edges_c, imports_c
CANONICAL_SQL = f"""
WITH RECURSIVE files_c AS (
  SELECT id AS file_id, path, hash, size_bytes, indexed_at, content,
    CASE lower(regexp_extract(path, '\\.([A-Za-z0-9]+)$', 1)) {_LANG} END AS language
  FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC NULLS LAST, id DESC) = 1),
symbols_c AS (
  SELECT * EXCLUDE (id, kind, name, qualified_name, parent_qname), id AS symbol_id, lower(trim(kind, {SPACE})) AS kind, trim(name, {SPACE}) AS name,
    nullif(trim(qualified_name, {SPACE}), '') AS qname, nullif(trim(parent_qname, {SPACE}), '') AS parent
  FROM symbols WHERE nullif(trim(qualified_name, {SPACE}), '') IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY trim(qualified_name, {SPACE}) ORDER BY id DESC) = 1),
edges_c AS (
  SELECT * EXCLUDE (id, src_qname, dst_qname, dst_name), id AS edge_id, nullif(trim(src_qname, {SPACE}), '') AS src, nullif(trim(dst_qname, {SPACE}), '') AS dst,
    nullif(trim(dst_name, {SPACE}), '') AS dst_name FROM edges),
imports_c AS (
  SELECT id AS import_id, trim(file_path, {SPACE}) AS path, nullif(trim(imported_name, {SPACE}), '') AS imported_name, nullif(trim(target_qname, {SPACE}), '') AS target,
    nullif(trim(local_name, {SPACE}), '') AS local_name, nullif(trim(source_module, {SPACE}), '') AS source_module FROM imports)
"""
