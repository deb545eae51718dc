"""Maintenance of stored tables, evaluation figures and texts of packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import name_or_null, stripped
from tessera.operators import context, evaluation, resolution, retrieval, vectors
from tessera.operators import incremental as i
from tessera.plans.maintenance import BUDGET, MODE, PACK_SQL, RERANK_SQL, SEEDS_SQL, _candidates, _seeds
from tessera.plans.resolution import BINDINGS_SQL
from tessera.plans.search import QUERY
from tessera.session import cut_lineage
from tessera.sources import graph
from tessera.sources.tables import table

C = graph.CANONICAL_SQL


def _first_versions(spark: SparkSession, d: str) -> DataFrame:
    """The first stored row of each path, read by the parser of the language as it is written there."""
    rows = table(spark, d, "files", "id", "path", "hash", "language", "indexed_at").where("path is not null")
    first = graph.latest(rows, "path", F.col("indexed_at").asc_nulls_last(), F.asc("id"))
    return first.select("path", "hash", i.parser_signature(F.lower(stripped("language"))).alias("signature"))


def index_changes(spark: SparkSession, d: str) -> DataFrame:
    now = graph.files(spark, d).select("path", "hash", i.parser_signature("language").alias("signature"))
    return i.to_index(_first_versions(spark, d), now)


def stale_parsers(spark: SparkSession, d: str) -> DataFrame:
    return i.stale_parser_files(graph.files(spark, d), _first_versions(spark, d)).select("path", "stored", "current")


def _first_repository(files: DataFrame) -> DataFrame:
    repo = F.substring_index("path", "/", 1)
    least = files.agg(F.min(repo).alias("_least"))
    return files.join(F.broadcast(least), repo == F.col("_least")).select("path")


def replaced_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that are left when a repository's files are taken out of all tables."""
    files = graph.files(spark, d)
    tables = {"files": files, "symbols": graph.symbols(spark, d), "edges": graph.edges(spark, d), "imports": graph.imports(spark, d)}
    return i.replace_files(tables, {}, _first_repository(files))["edges"].select("edge_id")


def replaced_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows that each table keeps then."""
    files = graph.files(spark, d)
    tables = {"files": files, "symbols": graph.symbols(spark, d), "edges": graph.edges(spark, d), "imports": graph.imports(spark, d)}
    kept = i.replace_files(tables, {}, _first_repository(files))
    parts = [kept[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name in tables]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def reparsed_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges that are left when those from methods are made anew."""
    return i.delete_edges_from(graph.edges(spark, d), graph.symbols(spark, d).where("kind = 'method'")).select("edge_id")


def merged_names(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and what imports name, a name once: the symbol wins."""
    come = graph.imports(spark, d).where("target is not null").select(F.col("target").alias("qname"), F.lit("imported").alias("kind"))
    return i.merge_first_wins(graph.symbols(spark, d).select("qname", "kind"), come, "qname")


def binding_targets(spark: SparkSession, d: str) -> DataFrame:
    imports = graph.imports(spark, d)
    return i.set_binding_targets(imports, resolution.resolve_bindings(imports, graph.symbols(spark, d), graph.files(spark, d))).select("import_id", "target")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "symbols", "qualified_name", "parent_qname", "name", "kind", "return_type", "declared_type")
    return rows.select(name_or_null("qualified_name").alias("qname"), name_or_null("parent_qname").alias("owner_qname"), stripped("name").alias("name"), F.lower(stripped("kind")).alias("kind"), "return_type", "declared_type").where("qname is not null")


def enriched_symbols(spark: SparkSession, d: str) -> DataFrame:
    """Symbols with the types that any of their stored rows has."""
    return i.enrich_symbols(graph.symbols(spark, d, "return_type", "declared_type"), _facts(spark, d)).select("qname", "return_type", "declared_type")


def type_facts(spark: SparkSession, d: str) -> DataFrame:
    facts = _facts(spark, d)
    stored = facts.where("owner_qname is not null").groupBy("owner_qname", "name", "kind").agg(F.min("return_type").alias("declared_type"))
    return i.upsert_type_facts(stored, facts)


def migrated_symbols(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "symbols", "id", "kind", "return_type")
    return i.migrated(old, "symbols").select("id", "kind", "return_type", "visibility", "is_exported", "metadata_json")


def decoded_metadata(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols", "id", "metadata_json").select("id", (i.tolerant_json("metadata_json") == "{}").alias("empty"))


def embedded_texts(spark: SparkSession, d: str) -> DataFrame:
    return vectors.embedded_text(graph.symbols(spark, d, "signature", "docstring"))


def cut_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut to fifty tokens."""
    rows = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    return rows.select("doc_id", context.truncated("text", 50).alias("text"))


def fallback_cards(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.symbols(spark, d, "signature", "start_line", "end_line").join(graph.files(spark, d).select("file_id", "path"), "file_id", "left")
    return rows.select("qname", context.fallback_card().alias("card"))


def edit_plan(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.rerank(_candidates(spark, d), retrieval.query_terms(QUERY), MODE)
    return context.edit_plan(ranked, QUERY).select("path", "role", "place", F.round("score", 6).alias("score"))


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """The capsules of a pack with why they are in it."""
    ranked = cut_lineage(retrieval.rerank(_candidates(spark, d), retrieval.query_terms(QUERY), MODE))
    return context.capsules(ranked, MODE, BUDGET).select("qname", "path", "rank", "tokens", "reason")


def retrieval_sources(spark: SparkSession, d: str) -> DataFrame:
    """In how many seeds each list shows."""
    return evaluation.source_counts(_seeds(spark, d, graph.symbols(spark, d, "signature", "docstring")))


def _file_tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A task for each file with methods (find these) and the file's symbols from the top as what was retrieved."""
    rows = graph.symbols(spark, d, "start_line").join(graph.files(spark, d).select("file_id", "path"), "file_id").select("path", "qname", "name", "kind", "start_line")
    tasks = rows.where("kind = 'method'").groupBy(F.col("path").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("oracle_symbols"))
    place = F.row_number().over(Window.partitionBy("path").orderBy(F.col("start_line").asc_nulls_first(), "qname"))
    found = rows.select(F.col("path").alias("id"), place.alias("rank"), F.col("qname").alias("item"), "path", "kind")
    return tasks, found.join(tasks.select("id"), "id", "left_semi")


def eval_symbol_recall(spark: SparkSession, d: str) -> DataFrame:
    tasks, found = _file_tasks(spark, d)
    return evaluation.recall_at(found, tasks, (3, 5, 8, 12, 20), "symbols")


def eval_misses(spark: SparkSession, d: str) -> DataFrame:
    """The rank of each method that was to be found, null if it was not."""
    tasks, found = _file_tasks(spark, d)
    return evaluation.missed(found.where("rank <= 5"), tasks).select("id", "oracle", "rank")


def eval_file_recall(spark: SparkSession, d: str) -> DataFrame:
    """Files that a repository's imports name most, against all its files of the language Python."""
    files = graph.files(spark, d)
    repo = F.substring_index("path", "/", 1)
    tasks = files.where("language = 'python'").groupBy(repo.alias("id")).agg(F.array_sort(F.collect_set("path")).alias("oracle_files"))
    named = graph.imports(spark, d).where("path is not null and path != ''").groupBy("path").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "path"))
    found = named.select(repo.alias("id"), "path", "n").withColumn("rank", place).where("rank <= 12").select("id", "rank", F.col("path").alias("item"))
    return evaluation.recall_at(found, tasks, (1, 3, 5, 8, 12), "files")


def eval_dataset(spark: SparkSession, d: str) -> DataFrame:
    tasks, _ = _file_tasks(spark, d)
    return evaluation.dataset_state(tasks.withColumn("oracle_files", F.array("id")))


def slowest_stage(spark: SparkSession, d: str) -> DataFrame:
    """The events as timings: the type that takes longest by its median, and the user that takes longest in all."""
    rows = table(spark, d, "events", "user_id", "event_type", "value").where("value is not null")
    return evaluation.slowest(rows.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("stage"), F.col("value").alias("ms")))


QUERIES = {
    f.__name__: f
    for f in (
        index_changes, stale_parsers, replaced_edges, replaced_counts, reparsed_edges, merged_names, binding_targets, enriched_symbols, type_facts, migrated_symbols, decoded_metadata, embedded_texts,
        cut_documents, fallback_cards, edit_plan, context_pack, retrieval_sources, eval_symbol_recall, eval_misses, eval_file_recall, eval_dataset, slowest_stage,
    )
}
SPACE = graph.SPACE


def _signature_sql(language: str) -> str:
    known = " ".join(f"WHEN '{k}' THEN '{i.FAMILIES.get(k, f'{k}:regex')}:{v}'" for k, v in i.PARSER_VERSIONS.items())
    return f"coalesce(CASE {language} {known} END, coalesce({language}, 'unknown') || ':none:1')"


VERSIONS = (
    C
    + f""", old AS (SELECT path, hash, {_signature_sql(f"lower(trim(language, {SPACE}))")} AS sig FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at NULLS LAST, id) = 1),
now AS (SELECT path, hash, {_signature_sql("language")} AS sig FROM files_c)"""
)
GONE = C + """, gf AS (SELECT path, file_id FROM files_c WHERE split_part(path, '/', 1) = (SELECT min(split_part(path, '/', 1)) FROM files_c)), gs AS (SELECT qname FROM symbols_c WHERE file_id IN (SELECT file_id FROM gf)),
ke AS (SELECT edge_id FROM edges_c WHERE (src IS NULL OR src NOT IN (SELECT qname FROM gs)) AND (dst IS NULL OR dst NOT IN (SELECT qname FROM gs)))"""
FACTS = C + f""", fa AS (SELECT nullif(trim(qualified_name, {SPACE}), '') AS qname, nullif(trim(parent_qname, {SPACE}), '') AS owner_qname, trim(name, {SPACE}) AS name, lower(trim(kind, {SPACE})) AS kind, return_type, declared_type
  FROM symbols WHERE nullif(trim(qualified_name, {SPACE}), '') IS NOT NULL)"""
TASKS = C + """, rw AS (SELECT path, qname, name, kind, start_line FROM symbols_c JOIN files_c USING (file_id)), ta AS (SELECT DISTINCT path AS id, name AS oracle FROM rw WHERE kind = 'method' AND name IS NOT NULL),
fo AS (SELECT path AS id, qname AS item, CAST(row_number() OVER (PARTITION BY path ORDER BY start_line NULLS FIRST, qname) AS INTEGER) AS rank FROM rw WHERE path IN (SELECT id FROM ta)),
hi AS (SELECT ta.id, oracle, rank FROM ta JOIN fo USING (id) WHERE oracle = item OR ends_with(item, '.' || oracle) OR split(oracle, '.')[-1] = split(item, '.')[-1])"""
CARD = "'### ' || upper(kind[1]) || lower(kind[2:]) || ': ' || qname"
SQL = {
    "index_changes": VERSIONS
    + " SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash IS DISTINCT FROM n.hash THEN 'changed' WHEN o.sig IS DISTINCT FROM n.sig THEN 'reparsed' ELSE 'unchanged' END AS status FROM old o FULL JOIN now n ON o.path = n.path",
    "stale_parsers": VERSIONS + " SELECT n.path, o.sig AS stored, n.sig AS current FROM now n LEFT JOIN old o ON o.path = n.path WHERE o.sig IS DISTINCT FROM n.sig",
    "replaced_edges": GONE + "SELECT edge_id FROM ke",
    "replaced_counts": GONE
    + """SELECT 'files' AS part, count(*) AS n FROM files_c WHERE path NOT IN (SELECT path FROM gf) UNION ALL SELECT 'symbols', count(*) FROM symbols_c WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM gf)
UNION ALL SELECT 'edges', count(*) FROM ke UNION ALL SELECT 'imports', count(*) FROM imports_c WHERE path IS NULL OR path NOT IN (SELECT path FROM gf)""",
    "reparsed_edges": C + "SELECT edge_id FROM edges_c WHERE src IS NULL OR src NOT IN (SELECT qname FROM symbols_c WHERE kind = 'method')",
    "merged_names": C + "SELECT qname, kind FROM symbols_c UNION ALL SELECT DISTINCT target, 'imported' FROM imports_c WHERE target IS NOT NULL AND target NOT IN (SELECT qname FROM symbols_c)",
    "binding_targets": BINDINGS_SQL + "SELECT i.import_id, coalesce(b.target, i.target) AS target FROM imports_c i LEFT JOIN bound b USING (import_id)",
    "enriched_symbols": FACTS
    + ", fm AS (SELECT qname, min(nullif(return_type, '')) AS r, min(nullif(declared_type, '')) AS t FROM fa GROUP BY 1) SELECT qname, coalesce(r, return_type) AS return_type, coalesce(t, declared_type) AS declared_type FROM symbols_c JOIN fm USING (qname)",
    "type_facts": FACTS
    + """, so AS (SELECT owner_qname, name, kind, min(return_type) AS declared_type FROM fa WHERE owner_qname IS NOT NULL GROUP BY 1, 2, 3), nw AS (SELECT owner_qname, name, kind, max(declared_type) AS declared_type FROM fa WHERE owner_qname IS NOT NULL AND declared_type <> '' GROUP BY 1, 2, 3)
SELECT so.owner_qname, so.name, so.kind, coalesce(nw.declared_type, so.declared_type) AS declared_type FROM so LEFT JOIN nw ON so.owner_qname = nw.owner_qname AND so.name = nw.name AND so.kind = nw.kind""",
    "migrated_symbols": "SELECT id, kind, return_type, '' AS visibility, 0 AS is_exported, '{}' AS metadata_json FROM symbols",
    "decoded_metadata": "SELECT id, NOT coalesce(json_valid(metadata_json) AND starts_with(trim(metadata_json), '{') AND metadata_json <> '{}', false) AS empty FROM symbols",
    "embedded_texts": C + "SELECT symbol_id, array_to_string(list_filter([qname, signature, substr(docstring, 1, 240)], lambda x: x IS NOT NULL AND x <> ''), chr(10)) AS text FROM symbols_c",
    "cut_documents": "SELECT doc_id, CASE WHEN length(text) > 0 AND greatest(1, floor(length(text) / 4)) > 50 THEN rtrim(substr(text, 1, 200), ' ') || chr(10) || '[truncated]' ELSE text END AS text FROM documents WHERE text IS NOT NULL",
    "fallback_cards": C
    + f"SELECT qname, concat_ws(chr(10), {CARD}, '- File: `' || coalesce(path, '') || ':' || coalesce(start_line, 0) || '-' || coalesce(end_line, 0) || '`', CASE WHEN coalesce(signature, '') <> '' THEN '- Signature: `' || signature || '`' END) AS card FROM symbols_c LEFT JOIN files_c USING (file_id)",
    "edit_plan": RERANK_SQL
    + """, rl AS (SELECT *, CASE WHEN kind = 'test' OR starts_with(name, 'test') OR regexp_matches('/' || lower(coalesce(path, '')) || '/', '/(tests?|__tests__)/|fixture') THEN 'test' WHEN final >= 0.45 OR (final >= 0.38 AND ov >= 0.25) THEN 'edit' ELSE 'read' END AS role FROM fin WHERE path IS NOT NULL),
pf AS (SELECT path, round(max(final), 6) AS score, min(CASE role WHEN 'edit' THEN 0 WHEN 'test' THEN 1 ELSE 2 END) AS r FROM rl GROUP BY 1), nm AS (SELECT path, score, ['edit', 'test', 'read'][r + 1] AS role FROM pf)
SELECT path, role, CAST(row_number() OVER (PARTITION BY role ORDER BY score DESC, path) AS INTEGER) AS place, score FROM nm QUALIFY place <= 6""",
    "context_pack": PACK_SQL
    + f""", got AS (SELECT qname, CAST(rank AS INTEGER) AS rank, tokens FROM rk WHERE rank IN (SELECT unnest(ranks) FROM (SELECT ranks FROM pk ORDER BY rank DESC LIMIT 1) l))
SELECT got.qname, path, rank, tokens, CASE WHEN distance = 0 THEN 'Seed match via ' || array_to_string(sources, ', ') ELSE distance || '-hop neighbor: ' || got.qname END || '  ·  ' || printf('score=%.3f', final) || '  ·  mode={MODE}' AS reason FROM got JOIN fin USING (qname)""",
    "retrieval_sources": SEEDS_SQL + "SELECT source, count(*) AS n FROM (SELECT unnest(sources) AS source FROM seeds) x GROUP BY 1",
    "eval_symbol_recall": TASKS
    + ", be AS (SELECT id, oracle, min(rank) AS best FROM hi GROUP BY 1, 2) SELECT id, k, round(avg(CASE WHEN best <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM ta LEFT JOIN be USING (id, oracle) CROSS JOIN (VALUES (3), (5), (8), (12), (20)) v(k) GROUP BY 1, 2",
    "eval_misses": TASKS + "SELECT ta.id, ta.oracle, min(hi.rank) FILTER (hi.rank <= 5) AS rank FROM ta LEFT JOIN hi ON ta.id = hi.id AND ta.oracle = hi.oracle GROUP BY 1, 2",
    "eval_file_recall": C
    + """, tk AS (SELECT split_part(path, '/', 1) AS id, path AS oracle FROM files_c WHERE language = 'python'), nm AS (SELECT split_part(path, '/', 1) AS id, path, count(*) AS n FROM imports_c WHERE path <> '' GROUP BY 1, 2),
fo AS (SELECT id, path AS item, row_number() OVER (PARTITION BY id ORDER BY n DESC, path) AS rank FROM nm QUALIFY rank <= 12),
be AS (SELECT tk.id, oracle, min(rank) AS best FROM tk JOIN fo ON tk.id = fo.id AND (item = oracle OR ends_with(item, '/' || oracle) OR ends_with(oracle, '/' || item) OR (split(item, '/')[-1] = split(oracle, '/')[-1] AND (NOT contains(item, '/') OR NOT contains(oracle, '/')))) GROUP BY 1, 2)
SELECT id, k, round(avg(CASE WHEN best <= k THEN 1.0 ELSE 0.0 END), 6) AS recall FROM tk LEFT JOIN be USING (id, oracle) CROSS JOIN (VALUES (1), (3), (5), (8), (12)) v(k) GROUP BY 1, 2""",
    "eval_dataset": TASKS + "SELECT count(DISTINCT id) AS n_tasks, count(DISTINCT id) AS n_files, count(*) AS n_symbols FROM ta",
    "slowest_stage": """WITH s AS (SELECT event_type AS name, round(median(value), 6) AS ms FROM events WHERE value IS NOT NULL GROUP BY 1), t AS (SELECT CAST(user_id AS VARCHAR) AS name, round(sum(value), 6) AS ms FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT 'stage' AS what, * FROM (SELECT * FROM s ORDER BY ms DESC, name LIMIT 1) a UNION ALL SELECT 'task', * FROM (SELECT * FROM t ORDER BY ms DESC, name LIMIT 1) b""",
}
