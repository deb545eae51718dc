"""Vectors, incremental maintenance and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import incremental as i
from tessera.operators import retrieval, vectors
from tessera.plans.search import ALIAS_CTES, QUERY, SYMBOL_DOCS, bm25_sql, symbol_index
from tessera.session import cut_lineage
from tessera.sources import graph
from tessera.sources.tables import table

C = graph.CANONICAL_SQL
MODE, BUDGET = "edit", 6000


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    query = rows.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.top_k(rows, "vec_id", "embedding", query, 25).select("vec_id", F.round("score", 6).alias("score"), "rank")


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vectors.top_k(rows, "vec_id", "embedding", queries, 12)
    labels = rows.select("vec_id", "label")
    return found.join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("wanted")), "query_id")


def vector_label_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of the k nearest that have the query's label, for k = 1, 3, 5, 8 and 12."""
    at = F.explode(F.array(*map(F.lit, (1, 3, 5, 8, 12)))).alias("k")
    hits = _nearest(spark, d).select("query_id", "rank", (F.col("label") == F.col("wanted")).cast("double").alias("hit"), at)
    return hits.where("rank <= k").groupBy("k").agg(F.round(F.avg("hit"), 6).alias("precision"), F.count_distinct("query_id").alias("n_queries"))


def irrelevant_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Per query, the share of the nearest vectors' weight (here the score) that another label takes."""
    wrong = F.sum(F.when(F.col("label") != F.col("wanted"), F.col("score")).otherwise(0.0))
    return _nearest(spark, d).groupBy("query_id").agg(F.round(wrong / F.sum("score"), 6).alias("irrelevant"))


def gates(spark: SparkSession, d: str) -> DataFrame:
    """Metrics against thresholds, hard and warning."""
    stats = graph.edges(spark, d).agg((F.count("dst") / F.count("*")).alias("resolution"))
    orphans = graph.symbols(spark, d).join(graph.files(spark, d), "file_id", "left").agg((F.count("path") / F.count("*")).alias("with_file"))
    metrics = stats.crossJoin(orphans).select(F.expr("stack(2, 'resolution_rate', resolution, 'symbols_with_file', with_file) AS (metric, value)"))
    limits = spark.createDataFrame([("resolution_rate", 0.5, "hard"), ("symbols_with_file", 0.9, "warning")], "metric string, threshold double, level string")
    return metrics.join(limits, "metric").select("metric", F.round("value", 6).alias("value"), "threshold", "level", (F.col("value") >= F.col("threshold")).alias("passed"))


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    return vectors.hash_embed(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def exact_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").where("text is not null")
    groups = docs.groupBy(F.md5(F.col("text")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return groups.where("n > 1")


def embedding_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Documents to embed when only the first document of each text is cached."""
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("content_hash"))
    cache = docs.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return vectors.not_cached(docs, cache, "doc_id")


def content_hash_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files that the imports know of against those that are stored now."""
    rows = table(spark, d, "files", "id", "path", "hash", "indexed_at").where("path is not null")
    first = graph.latest(rows, "path", F.col("indexed_at").asc_nulls_last(), F.asc("id"))
    known = graph.imports(spark, d).select("path").where("path is not null and path != ''").distinct()
    return i.changes(known.join(first.select("path", "hash"), "path", "left"), graph.files(spark, d), "path", "hash")


def symbol_upsert(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbols(spark, d).select("qname", "symbol_id", "file_id", "kind")


def stale_symbols(spark: SparkSession, d: str) -> DataFrame:
    return i.stale_symbols(graph.symbols(spark, d), graph.files(spark, d)).select("qname", "file_id")


def orphan_prune(spark: SparkSession, d: str) -> DataFrame:
    stale = i.stale_symbols(graph.symbols(spark, d), graph.files(spark, d))
    return i.prune_edges(graph.edges(spark, d), stale).select("edge_id", "src", "dst")


def semantic_merge(spark: SparkSession, d: str) -> DataFrame:
    edges = graph.edges(spark, d, "confidence", "precision_level")
    return i.semantic_merge(edges.where("coalesce(precision_level, 0) < 3"), edges.where("precision_level >= 3"))


def intent_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", retrieval.classify_intent("text").alias("intent"))


def _seeds(spark: SparkSession, d: str, symbols: DataFrame) -> DataFrame:
    """The lists of the index, of the stored vectors (one per symbol id; the question's is that of id 0) and of names."""

    def ranked(source: str, rows: DataFrame) -> DataFrame:
        rank = (F.row_number().over(Window.orderBy(F.desc("score"), "qname")) - 1).alias("rank")  # at most 25 rows
        return rows.orderBy(F.desc("score"), "qname").limit(25).select(F.lit(source).alias("source"), "qname", rank)

    names = symbols.select("symbol_id", "qname")
    lexical = symbol_index(spark, d).ask(QUERY).join(names, "symbol_id").select("qname", F.round("score", 9).alias("score"))
    rows = table(spark, d, "embeddings", "vec_id", "embedding")
    of_symbols = rows.join(names.select(F.col("symbol_id").alias("vec_id")), "vec_id", "left_semi")
    question = rows.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    near = vectors.top_k(of_symbols, "vec_id", "embedding", question, 25).select(F.col("vec_id").alias("symbol_id"), "score")
    named = retrieval.identifier_hits(symbols, retrieval.query_terms(QUERY)).withColumn("score", F.lit(1.0))
    return retrieval.rrf(ranked("bm25", lexical).unionByName(ranked("vector", near.join(names, "symbol_id"))).unionByName(ranked("identifier", named)))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    seeds = _seeds(spark, d, graph.symbols(spark, d, "signature", "docstring"))
    return seeds.select("qname", F.round("rrf", 9).alias("rrf"), F.array_join("sources", ",").alias("sources"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    symbols = graph.symbols(spark, d, "signature", "docstring", "start_line", "end_line")
    seeds = cut_lineage(_seeds(spark, d, symbols))
    norm = seeds.crossJoin(F.broadcast(seeds.agg(F.max("rrf").alias("m")))).select("qname", (F.col("rrf") / F.col("m")).alias("norm"), "sources")
    reached = retrieval.expand(norm, graph.edges(spark, d, "confidence"), symbols, MODE, 2)
    facts = symbols.join(graph.files(spark, d).select("file_id", "path"), "file_id", "left").select("qname", "name", "kind", "path", "signature", "start_line", "end_line")
    joined = reached.join(norm, "qname", "left").join(facts, "qname")
    sources = F.coalesce("sources", F.array().cast("array<string>"))
    channels = [F.when(F.array_contains(sources, x), F.col("norm")).otherwise(0.0).alias(x) for x in ("bm25", "vector")]
    return joined.select("qname", "name", "kind", "path", "signature", "start_line", "end_line", "graph", "distance", sources.alias("sources"), *channels)


def expand_decay(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("qname", F.round("graph", 6).alias("graph"), "distance")


def mode_rerank(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.rerank(_candidates(spark, d), retrieval.query_terms(QUERY), MODE)
    return ranked.select("qname", F.round("final", 6).alias("final"))


def greedy_pack(spark: SparkSession, d: str) -> DataFrame:
    ranked = retrieval.rerank(_candidates(spark, d), retrieval.query_terms(QUERY), MODE)
    card = F.concat_ws("\n", F.concat_ws(" ", "kind", "qname"), F.concat(F.lit("file: "), "path"), F.nullif("signature", F.lit("")))
    listed = ranked.select(
        "qname", "path", "final", retrieval.estimate_tokens(card).cast("int").alias("tokens"), (F.size("sources") > 0).alias("seeded"),
    )
    return retrieval.pack(listed, MODE, BUDGET)


TERMS = ", ".join(f"'{t}'" for t in retrieval.query_terms(QUERY))
WANTED = ", ".join(f"'{t}'" for t in retrieval.query_terms(QUERY) if len(t) >= 3)
ONE = f"SELECT 0 AS query_id, '{QUERY}' AS query"
DOT = "list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
NEAREST = f"""WITH n AS (SELECT b.vec_id AS query_id, a.vec_id, round({DOT}, 9) AS score, a.label, b.label AS wanted, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({DOT}, 9) DESC, a.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON b.vec_id % 50 = 0), near AS (SELECT * FROM n WHERE rank <= 12)"""
SEEDS_SQL = f"""{ALIAS_CTES}, {bm25_sql(SYMBOL_DOCS, ONE, "symbol_id")},
top AS (SELECT qname, row_number() OVER (ORDER BY round(score, 9) DESC, qname) - 1 AS rank FROM scores JOIN symbols_c USING (symbol_id) QUALIFY rank < 25),
idt AS (SELECT qname, lower(name) AS term FROM symbols_c UNION SELECT qname, lower(split(qname, '.')[-1]) FROM symbols_c),
idh AS (SELECT DISTINCT qname FROM (SELECT qname, row_number() OVER (PARTITION BY term ORDER BY qname) AS r FROM idt WHERE term IN ({WANTED})) x WHERE r <= 3),
idr AS (SELECT qname, row_number() OVER (ORDER BY qname) - 1 AS rank FROM idh QUALIFY rank < 25),
vtop AS (SELECT qname, row_number() OVER (ORDER BY round({DOT}, 9) DESC, a.vec_id) AS place, round({DOT}, 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = 0 JOIN symbols_c ON symbol_id = a.vec_id QUALIFY place <= 25),
vec AS (SELECT qname, row_number() OVER (ORDER BY score DESC, qname) - 1 AS rank FROM vtop),
lists AS (SELECT 'bm25' AS source, * FROM top UNION ALL SELECT 'identifier', * FROM idr UNION ALL SELECT 'vector', * FROM vec),
seeds AS (SELECT qname, sum(1.0::DOUBLE / (60 + rank)) AS rrf, list_sort(list(DISTINCT source)) AS sources FROM lists GROUP BY 1 ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, qname LIMIT 30)"""
EXPAND_SQL = (
    SEEDS_SQL
    + """,
norm AS (SELECT qname, rrf / (SELECT max(rrf) FROM seeds) AS norm, sources FROM seeds),
alone AS (SELECT name AS dst_name, min(qname) AS q FROM symbols_c GROUP BY 1 HAVING count(*) = 1),
tg AS (SELECT e.*, coalesce(e.dst, s.qname, a.q) AS target FROM edges_c e LEFT JOIN symbols_c s ON e.dst IS NULL AND s.qname = e.dst_name LEFT JOIN alone a ON e.dst IS NULL AND a.dst_name = e.dst_name),
steps AS (SELECT qname, too, max(confidence) AS confidence FROM (SELECT src AS qname, target AS too, confidence FROM tg WHERE edge_type IN ('CALLS', 'IMPORTS') AND src IS NOT NULL
  UNION ALL SELECT dst, src, confidence FROM tg WHERE dst IS NOT NULL AND edge_type IN ('CALLS', 'TESTS', 'ROUTES_TO')) x WHERE too IS NOT NULL GROUP BY 1, 2),
one AS (SELECT too AS qname, max(norm * 0.55 * confidence) AS graph, 1 AS distance FROM steps JOIN norm USING (qname) GROUP BY 1),
two AS (SELECT too AS qname, max(0.55 * confidence) AS graph, 2 AS distance FROM steps WHERE qname IN (SELECT qname FROM one) AND qname NOT IN (SELECT qname FROM norm) GROUP BY 1),
reached AS (SELECT qname, least(max(graph), 1.0) AS graph, min(distance) AS distance FROM (SELECT qname, 0.0::DOUBLE AS graph, 0 AS distance FROM norm UNION ALL SELECT * FROM one UNION ALL SELECT * FROM two) x GROUP BY 1),
cand AS (SELECT r.*, s.name, s.kind, f.path, s.signature, coalesce(n.sources, []) AS sources, CASE WHEN list_contains(n.sources, 'bm25') THEN n.norm ELSE 0.0 END AS bm25, CASE WHEN list_contains(n.sources, 'vector') THEN n.norm ELSE 0.0 END AS vector
  FROM reached r JOIN symbols_c s USING (qname) LEFT JOIN files_c f USING (file_id) LEFT JOIN norm n USING (qname))"""
)
GENERIC_SQL = ", ".join(f"'{g}'" for g in retrieval.GENERIC)
INFRA_SQL = ", ".join(f"'{g}'" for g in retrieval.TEST_INFRA)
RERANK_SQL = (
    EXPAND_SQL
    + f""",
sig AS (SELECT *, least(1.0, len(list_intersect(list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(qname, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1)), [{TERMS}])) / 3.0) AS ov,
  CASE WHEN kind IN ('function', 'method', 'component', 'route') THEN 1.0 WHEN kind = 'class' THEN 0.5 WHEN kind = 'file_summary' THEN 0.15 ELSE 0.0 END AS fit,
  CASE WHEN kind = 'test' OR starts_with(name, 'test') OR contains(lower(coalesce(path, '')), 'test') THEN 0.4 ELSE 0.0 END AS near,
  CASE WHEN kind IN ('function', 'method', 'component', 'route') THEN 0.4 ELSE 0.0 END AS it,
  CASE WHEN (lower(name) IN ({GENERIC_SQL}) AND lower(name) NOT IN ({TERMS})) OR lower(name) IN ({INFRA_SQL}) THEN 0.2 ELSE 0.0 END AS gen FROM cand),
fin AS (SELECT *, (0.40 * bm25 + 0.36 * vector + CASE WHEN bm25 > 0 AND vector > 0 THEN 0.05 ELSE 0.0 END + 0.10 * graph + 0.10 * ov + 0.06 * fit + 0.04 * near + 0.04 * it - 0.25 * gen + CASE WHEN distance = 0 AND list_contains(sources, 'identifier') THEN 0.05 ELSE 0.0 END)::DOUBLE
  * CASE WHEN kind = 'file_summary' THEN 0.45 ELSE 1.0 END AS final FROM sig)"""
)
PACK_SQL = (
    RERANK_SQL
    + """, rk AS (SELECT qname, path, len(sources) > 0 AS seeded, row_number() OVER (ORDER BY round(final, 9) DESC, qname) AS rank,
  CAST(greatest(1, floor(length(concat_ws(chr(10), concat_ws(' ', kind, qname), 'file: ' || path, nullif(signature, ''))) / 4)) AS INTEGER) AS tokens FROM fin),
pk AS (SELECT 0::BIGINT AS rank, []::VARCHAR[] AS taken, []::BIGINT[] AS ranks, 0 AS spent, 0 AS gr UNION ALL
  SELECT rank, CASE WHEN fits THEN list_append(taken, coalesce(path, '')) ELSE taken END, CASE WHEN fits THEN list_append(ranks, rank) ELSE ranks END, CASE WHEN fits THEN spent + tokens ELSE spent END, CASE WHEN op AND NOT seeded THEN gr + 1 ELSE gr END
  FROM (SELECT r.rank, r.path, r.seeded, r.tokens, p.taken, p.ranks, p.spent, p.gr, len(p.taken) < 12 AND len(list_filter(p.taken, lambda x: x = coalesce(r.path, ''))) < 5 AND (r.seeded OR p.gr < 8) AS op,
    len(p.taken) < 12 AND len(list_filter(p.taken, lambda x: x = coalesce(r.path, ''))) < 5 AND (r.seeded OR p.gr < 8) AND p.spent + r.tokens <= 2400 AS fits FROM pk p JOIN rk r ON r.rank = p.rank + 1) x)"""
)
QUERIES = {
    f.__name__: f
    for f in (
        vector_topk, vector_label_recall, irrelevant_ratio, gates, hash_embed, exact_dup_groups, embedding_cache_misses, content_hash_diff, symbol_upsert, stale_symbols,
        orphan_prune, semantic_merge, intent_classes, rrf_fuse, expand_decay, mode_rerank, greedy_pack,
    )
}
_CASES = " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{n}')" for n in needles) + f" THEN '{name}'" for name, needles in retrieval.INTENTS)
SQL = {
    "vector_topk": f"SELECT a.vec_id, round({DOT}, 6) AS score, CAST(row_number() OVER (ORDER BY round({DOT}, 9) DESC, a.vec_id) AS INTEGER) AS rank FROM embeddings a JOIN embeddings b ON b.vec_id = 0 ORDER BY rank LIMIT 25",
    "vector_label_recall": NEAREST + "SELECT k, round(avg(CASE WHEN label = wanted THEN 1.0 ELSE 0.0 END), 6) AS precision, count(DISTINCT query_id) AS n_queries FROM near JOIN (VALUES (1), (3), (5), (8), (12)) v(k) ON rank <= k GROUP BY 1",
    "irrelevant_ratio": NEAREST + "SELECT query_id, round(sum(CASE WHEN label <> wanted THEN score ELSE 0.0 END) / sum(score), 6) AS irrelevant FROM near GROUP BY 1",
    "gates": C
    + """, m AS (SELECT 'resolution_rate' AS metric, count(dst) / count(*)::DOUBLE AS value, 0.5::DOUBLE AS threshold, 'hard' AS level FROM edges_c
UNION ALL SELECT 'symbols_with_file', count(path) / count(*)::DOUBLE, 0.9, 'warning' FROM symbols_c LEFT JOIN files_c USING (file_id))
SELECT metric, round(value, 6) AS value, threshold, level, value >= threshold AS passed FROM m""",
    "exact_dup_groups": "SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "embedding_cache_misses": "SELECT doc_id, md5(coalesce(text, '')) AS content_hash FROM documents QUALIFY row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) > 1",
    "content_hash_diff": C
    + """, old AS (SELECT path, hash FROM (SELECT DISTINCT path FROM imports_c WHERE path <> '') p LEFT JOIN
  (SELECT path, hash FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at NULLS LAST, id) = 1) f USING (path))
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.hash IS NOT DISTINCT FROM n.hash THEN 'unchanged' ELSE 'changed' END AS status
FROM old o FULL JOIN files_c n ON o.path = n.path""",
    "symbol_upsert": C + "SELECT qname, symbol_id, file_id, kind FROM symbols_c",
    "stale_symbols": C + "SELECT qname, file_id FROM symbols_c WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM files_c)",
    "orphan_prune": C
    + """, g AS (SELECT qname FROM symbols_c WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM files_c))
SELECT edge_id, src, dst FROM edges_c WHERE (src IS NULL OR src NOT IN (SELECT qname FROM g)) AND (dst IS NULL OR dst NOT IN (SELECT qname FROM g))""",
    "semantic_merge": C
    + """, facts AS (SELECT src, dst, edge_type, max(confidence) AS confidence, split(dst, '.')[-1] AS dst_name FROM edges_c WHERE precision_level >= 3 AND src IS NOT NULL AND dst IS NOT NULL GROUP BY ALL),
ro AS (SELECT * FROM edges_c WHERE coalesce(precision_level, 0) < 3), rough AS (SELECT src, edge_type, dst_name, min(edge_id) AS edge_id FROM ro WHERE dst IS NULL AND dst_name IS NOT NULL GROUP BY 1, 2, 3),
th AS (SELECT DISTINCT src, dst, edge_type, true AS there FROM ro WHERE dst IS NOT NULL),
j AS (SELECT f.*, r.edge_id, row_number() OVER (PARTITION BY r.edge_id ORDER BY f.confidence DESC, f.dst) AS rn FROM facts f LEFT JOIN rough r ON f.src = r.src AND f.edge_type = r.edge_type AND f.dst_name = r.dst_name)
SELECT j.src, j.dst, j.edge_type, CASE WHEN edge_id IS NOT NULL AND rn = 1 THEN 'upgraded' WHEN there IS NULL THEN 'inserted' ELSE 'known' END AS action, CASE WHEN rn = 1 THEN edge_id END AS edge_id
FROM j LEFT JOIN th ON j.src = th.src AND j.dst = th.dst AND j.edge_type = th.edge_type""",
    "intent_classes": f"SELECT item_id, CASE {_CASES} ELSE 'explain' END AS intent FROM benchmark",
    "rrf_fuse": SEEDS_SQL + "SELECT qname, round(rrf, 9) AS rrf, array_to_string(sources, ',') AS sources FROM seeds",
    "expand_decay": EXPAND_SQL + "SELECT qname, round(graph, 6) AS graph, CAST(distance AS INTEGER) AS distance FROM cand",
    "mode_rerank": RERANK_SQL + "SELECT qname, round(final, 6) AS final FROM fin",
    "greedy_pack": PACK_SQL
    + """ SELECT qname, CAST(rank AS INTEGER) AS rank, tokens FROM rk WHERE rank IN (SELECT unnest(ranks) FROM (SELECT ranks FROM pk ORDER BY rank DESC LIMIT 1) l)""",
}
