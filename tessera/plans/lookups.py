"""Lookups, views, processes and attached facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import lookups, processes, resolution, retrieval, roles, views, workflow
from tessera.plans.inference import COLUMNS, ROLES_SQL, TRACE_SQL, trace_walk
from tessera.plans.resolution import BINDINGS_SQL
from tessera.sources import graph
from tessera.sources.tables import table

C = graph.CANONICAL_SQL


def _path(spark: SparkSession, d: str) -> str:
    """The first path that has symbols."""
    rows = graph.files(spark, d).join(graph.symbols(spark, d).select("file_id").distinct(), "file_id", "left_semi")
    return rows.agg(F.min("path")).first()[0] or ""


def _busiest(spark: SparkSession, d: str, end: str) -> str:
    """The name with most resolved edges at one end."""
    rows = graph.edges(spark, d).where("src is not null and dst is not null").groupBy(end).agg(F.count("*").alias("n"))
    row = rows.orderBy(F.desc("n"), end).first()
    return row[end] if row else ""


def lookup_exact(spark: SparkSession, d: str) -> DataFrame:
    symbols = graph.symbols(spark, d)
    name = symbols.where("kind = 'function'").agg(F.min("qname")).first()[0]
    return lookups.find_symbol(symbols, name or "").select("qname", "kind", "file_id")


def lookup_by_name(spark: SparkSession, d: str) -> DataFrame:
    symbols = graph.symbols(spark, d)
    name = symbols.where("kind = 'method'").agg(F.min("name")).first()[0]
    return lookups.find_by_name(symbols, name or "", 25).select("qname", "name")


def lookup_in_file(spark: SparkSession, d: str) -> DataFrame:
    return lookups.in_file(graph.symbols(spark, d, "start_line"), graph.files(spark, d), _path(spark, d)).select("qname", "start_line")


def lookup_of_kind(spark: SparkSession, d: str) -> DataFrame:
    return lookups.of_kind(graph.symbols(spark, d), "class", 100).select("qname")


def lookup_outgoing(spark: SparkSession, d: str) -> DataFrame:
    return lookups.outgoing(graph.edges(spark, d), _busiest(spark, d, "src"), ["CALLS", "IMPORTS"]).select("edge_id", "dst_name")


def lookup_incoming(spark: SparkSession, d: str) -> DataFrame:
    return lookups.incoming(graph.edges(spark, d), _busiest(spark, d, "dst")).select("edge_id", "src")


def lookup_touching(spark: SparkSession, d: str) -> DataFrame:
    return lookups.touching(graph.edges(spark, d, "confidence"), _busiest(spark, d, "dst")).select("edge_id", "confidence")


def lookup_file(spark: SparkSession, d: str) -> DataFrame:
    from tessera.sources.repository import file_at

    return file_at(graph.files(spark, d), _path(spark, d)).select("path", "hash", "language")


def folder_listing(spark: SparkSession, d: str) -> DataFrame:
    folder = _path(spark, d).split("/", 1)[0]
    return views.in_folder(graph.files(spark, d), folder).select("path")


def symbols_in_files(spark: SparkSession, d: str) -> DataFrame:
    """Qualified names per path, in order."""
    rows = graph.symbols(spark, d).join(graph.files(spark, d).select("file_id", "path"), "file_id")
    return rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list("qname")), ",").alias("qnames"))


def bindings_by_file(spark: SparkSession, d: str) -> DataFrame:
    rows = graph.imports(spark, d).where("local_name is not null and path is not null")
    return rows.groupBy("path").agg(F.array_join(F.array_sort(F.collect_set("local_name")), ",").alias("locals"))


def _view(name: str, part: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        symbols = graph.symbols(spark, d, "start_line", "end_line")
        edges = graph.edges(spark, d, "confidence", "precision_level")
        found = views.graph_view(name, graph.files(spark, d), symbols, edges)[part]
        return found.select("id", "source", "target", "type") if part else found.select("id", "label", "kind", "path")

    query.__name__ = f"view_{name}_{'edges' if part else 'nodes'}"
    return query


def view_metadata(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = views.graph_view("full", graph.files(spark, d), graph.symbols(spark, d, "start_line", "end_line"), graph.edges(spark, d, "confidence", "precision_level"))
    return views.metadata("full", nodes, edges)


def node_sizes(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = views.graph_view("calls", graph.files(spark, d), graph.symbols(spark, d, "start_line", "end_line"), graph.edges(spark, d, "confidence", "precision_level"))
    return views.sized(nodes, edges).select("id", "degree", "n_neighbours", F.round("size", 6).alias("size"))


def fallback_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A node for each name at the end of an edge, known or not."""
    names = graph.edges(spark, d).select(F.coalesce("dst", "dst_name").alias("qname")).where("qname is not null")
    return views.node_or_fallback(names, graph.symbols(spark, d, "start_line", "end_line"), graph.files(spark, d)).select("id", "label", "kind", "path")


def _role_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.symbols(spark, d, *COLUMNS).join(graph.files(spark, d).select("file_id", "path"), "file_id"), graph.edges(spark, d)


def role_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every role with its three strongest signals as text."""
    return roles.role_rows(*_role_inputs(spark, d)).select("qname", "role", "reason")


def role_signals(spark: SparkSession, d: str) -> DataFrame:
    """Number and greatest confidence of the signals of each role and source."""
    rows = roles.signals(*_role_inputs(spark, d))
    return rows.groupBy("role", "source").agg(F.sum("n").alias("n_signals"), F.max("confidence").alias("confidence"))


def node_roles(spark: SparkSession, d: str) -> DataFrame:
    """Symbol nodes with their roles, the most confident first."""
    symbols, edges = _role_inputs(spark, d)
    nodes = views.symbol_nodes(graph.symbols(spark, d, "start_line", "end_line"), graph.files(spark, d))
    return views.attach_roles(nodes, roles.classify(symbols, edges)).where("role is not null").select("id", "role", F.array_join("roles", ",").alias("roles"))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    return processes.steps(trace_walk(spark, d), graph.edges(spark, d, "confidence"))


def process_steps(spark: SparkSession, d: str) -> DataFrame:
    return _steps(spark, d).select("process_id", "step", "src", "dst", "edge_type", F.round("confidence", 6).alias("confidence"))


def process_step_edges(spark: SparkSession, d: str) -> DataFrame:
    return processes.step_edges(_steps(spark, d)).select("src", "dst", "edge_type", "precision_level", "extraction_source", "reason")


def process_counts(spark: SparkSession, d: str) -> DataFrame:
    return processes.counts_by_type(trace_walk(spark, d))


def process_list(spark: SparkSession, d: str) -> DataFrame:
    """The ten most certain processes."""
    return trace_walk(spark, d).orderBy(F.desc("confidence"), "process_id").limit(10).select("process_id", "confidence")


def process_view(spark: SparkSession, d: str) -> DataFrame:
    """Members and steps of the picture of processes, counted by type."""
    built = trace_walk(spark, d)
    _, edges = views.process_view(built, processes.steps(built, graph.edges(spark, d, "confidence")), graph.symbols(spark, d, "start_line", "end_line"), graph.files(spark, d))
    return edges.groupBy("source", "target", "type").agg(F.count("*").alias("n"))


def route_labels(spark: SparkSession, d: str) -> DataFrame:
    return processes.route_label(graph.symbols(spark, d, "extras").where("kind = 'route'"))


def _callers(spark: SparkSession, d: str) -> DataFrame:
    """Eight symbols to modify: the functions and methods with most callers."""
    symbols = graph.symbols(spark, d).where("kind in ('function', 'method')").select("qname")
    called = graph.edges(spark, d).where("edge_type = 'CALLS' and dst is not null").groupBy(F.col("dst").alias("qname")).agg(F.count("*").alias("n"))
    best = called.join(symbols, "qname", "left_semi").orderBy(F.desc("n"), "qname").limit(8)
    from pyspark.sql import Window

    return best.select("qname", F.row_number().over(Window.orderBy(F.desc("n"), "qname")).alias("place"))  # eight rows


def edit_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return workflow.neighbours_of(_callers(spark, d), graph.edges(spark, d), graph.symbols(spark, d))


def edit_traces(spark: SparkSession, d: str) -> DataFrame:
    return workflow.traces_of(_callers(spark, d), trace_walk(spark, d)).select("process_id", "confidence")


TASK = "Fix the session token rotation in the ledger loader"


def task_tests(spark: SparkSession, d: str) -> DataFrame:
    return workflow.tests_of_task(graph.files(spark, d, content=True), TASK)


def task_words(spark: SparkSession, d: str) -> DataFrame:
    """The keyword and the risk words of each evaluation task."""
    rows = table(spark, d, "benchmark", "item_id", "text").where("text is not null")
    return rows.select("item_id", workflow.keyword_of("text").alias("keyword"), F.array_join(workflow.risk_words_of("text"), ",").alias("risks"))


def question_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark", "item_id", "text").where("text is not null")
    return rows.select("item_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("([A-Za-z][A-Za-z0-9_]+)"), F.lit(1)), F.lower))).alias("term"))


def name_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The distinct pieces of each qualified name."""
    return graph.symbols(spark, d).select("qname", F.explode(F.array_distinct(retrieval.name_tokens("qname"))).alias("piece"))


def file_modules(spark: SparkSession, d: str) -> DataFrame:
    return resolution.file_modules(graph.files(spark, d))


def package_roots(spark: SparkSession, d: str) -> DataFrame:
    return resolution.package_roots(graph.files(spark, d))


def alias_targets(spark: SparkSession, d: str) -> DataFrame:
    """What each file's local names stand for."""
    return resolution.alias_table(resolution.resolve_bindings(graph.imports(spark, d), graph.symbols(spark, d), graph.files(spark, d)))


VIEW_QUERIES = [_view(*v) for v in (("full", 1), ("full", 0), ("repo", 1), ("repo", 0), ("symbols", 1), ("calls", 0), ("calls", 1), ("framework", 0), ("framework", 1))]
QUERIES = {
    f.__name__: f
    for f in (
        lookup_exact, lookup_by_name, lookup_in_file, lookup_of_kind, lookup_outgoing, lookup_incoming, lookup_touching, lookup_file, folder_listing, symbols_in_files, bindings_by_file,
        view_metadata, node_sizes, fallback_nodes, role_reasons, role_signals, node_roles, process_steps, process_step_edges, process_counts, process_list, process_view, route_labels,
        edit_neighbours, edit_traces, task_tests, task_words, question_terms, name_pieces, file_modules, package_roots, alias_targets, *VIEW_QUERIES,
    )
}


def _in(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


PATH_SQL = "(SELECT min(path) FROM files_c WHERE file_id IN (SELECT file_id FROM symbols_c))"
BUSIEST = "(SELECT {end} FROM edges_c WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
SRC, DST = BUSIEST.format(end="src"), BUSIEST.format(end="dst")
PIECES = "list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(qname, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([A-Z]*)[A-Z]([^A-Za-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: lower(x)), lambda x: length(x) > 1)"
VIEW_CTES = (
    C
    + f""",
sn AS (SELECT 'symbol:' || qname AS id, name AS label, kind, path FROM symbols_c LEFT JOIN files_c USING (file_id)),
fn AS (SELECT 'file:' || path AS id, split(path, '/')[-1] AS label, 'file' AS kind, path FROM files_c),
fp AS (SELECT DISTINCT unnest(list_transform(range(1, len(split(path, '/'))), lambda i: array_to_string(split(path, '/')[1:i], '/'))) AS folder FROM files_c),
dn AS (SELECT 'folder:' || folder AS id, split(folder, '/')[-1] AS label, 'folder' AS kind, folder AS path FROM fp),
hd AS (SELECT 'contains:file:' || path || '->symbol:' || qname AS id, 'file:' || path AS source, 'symbol:' || qname AS target, 'CONTAINS' AS type FROM symbols_c JOIN files_c USING (file_id)),
fd AS (SELECT 'contains:folder:' || regexp_extract(path, '^(.*)/[^/]*$', 1) || '->file:' || path AS id, 'folder:' || regexp_extract(path, '^(.*)/[^/]*$', 1) AS source, 'file:' || path AS target, 'CONTAINS' AS type FROM files_c WHERE contains(path, '/')),
se AS (SELECT 'edge:' || edge_id AS id, 'symbol:' || src AS source, 'symbol:' || coalesce(dst, dst_name) AS target, edge_type AS type FROM edges_c WHERE src IS NOT NULL),
cn AS (SELECT * FROM sn WHERE kind IN ({_in(views.CALL_KINDS)})),
ce AS (SELECT * FROM se WHERE type IN ({_in(views.CALL_TYPES)}) AND source IN (SELECT id FROM cn) AND target IN (SELECT id FROM cn)),
we AS (SELECT * FROM se WHERE type IN ({_in(views.FRAMEWORK_TYPES)}) AND source IN (SELECT id FROM sn) AND target IN (SELECT id FROM sn)),
wn AS (SELECT * FROM sn WHERE kind IN ({_in(views.FRAMEWORK_KINDS)}) OR id IN (SELECT source FROM we) OR id IN (SELECT target FROM we)),
fe AS (SELECT * FROM hd UNION ALL SELECT * FROM se WHERE type <> 'STEP_IN_PROCESS' AND source IN (SELECT id FROM sn) AND target IN (SELECT id FROM sn))"""
)
STEPS_SQL = (
    TRACE_SQL
    + """,
ps AS (SELECT process_id, vis, unnest(range(1, len(vis))) AS step FROM tr), pr AS (SELECT process_id, CAST(step AS INTEGER) AS step, vis[step] AS src, vis[step + 1] AS dst FROM ps),
be AS (SELECT src, coalesce(dst, dst_name) AS too, edge_type, confidence FROM edges_c WHERE src IS NOT NULL QUALIFY row_number() OVER (PARTITION BY src, coalesce(dst, dst_name) ORDER BY confidence DESC, edge_id) = 1),
st2 AS (SELECT process_id, step, pr.src, pr.dst, CASE WHEN a.src IS NOT NULL THEN a.edge_type WHEN b.src IS NOT NULL THEN b.edge_type ELSE 'STEP_IN_PROCESS' END AS edge_type,
  round(coalesce(CASE WHEN a.src IS NOT NULL THEN a.confidence ELSE b.confidence END, 0.8), 6) AS confidence FROM pr LEFT JOIN be a ON a.src = pr.src AND a.too = pr.dst LEFT JOIN be b ON b.src = pr.src AND b.too = split(pr.dst, '.')[-1])"""
)
CALLERS_SQL = """
ch AS (SELECT qname, row_number() OVER (ORDER BY n DESC, qname) AS place FROM (SELECT dst AS qname, count(*) AS n FROM edges_c WHERE edge_type = 'CALLS' AND dst IS NOT NULL GROUP BY 1) x
  WHERE qname IN (SELECT qname FROM symbols_c WHERE kind IN ('function', 'method')) QUALIFY place <= 8)"""
STOPPED, NO_RISK = _in(workflow.STOP), _in(workflow.NO_RISK)
PRIORITY = r"CASE WHEN regexp_matches(lower(split(path, '/')[-1]), '^test_|(_test\.py|\.test\.tsx?|\.test\.js|\.spec\.[tj]s)$') THEN 0 ELSE 1 END, CASE WHEN contains('/' || lower(path) || '/', '/fixtures/') THEN 1 ELSE 0 END, path"
SQL = {
    "lookup_exact": C + "SELECT qname, kind, file_id FROM symbols_c WHERE qname = (SELECT min(qname) FROM symbols_c WHERE kind = 'function')",
    "lookup_by_name": C + ", n AS (SELECT min(name) AS name FROM symbols_c WHERE kind = 'method') SELECT s.qname, s.name FROM symbols_c s, n WHERE s.name = n.name OR ends_with(s.qname, '.' || n.name) ORDER BY 1 LIMIT 25",
    "lookup_in_file": C + f"SELECT qname, start_line FROM symbols_c JOIN files_c USING (file_id) WHERE path = {PATH_SQL}",
    "lookup_of_kind": C + "SELECT qname FROM symbols_c WHERE kind = 'class' ORDER BY 1 LIMIT 100",
    "lookup_outgoing": C + f"SELECT edge_id, dst_name FROM edges_c WHERE src = {SRC} AND edge_type IN ('CALLS', 'IMPORTS')",
    "lookup_incoming": C + f"SELECT edge_id, src FROM edges_c WHERE dst = {DST}",
    "lookup_touching": C + f"SELECT edge_id, confidence FROM edges_c WHERE dst = {DST} OR src = {DST}",
    "lookup_file": C + f"SELECT path, hash, language FROM files_c WHERE path = {PATH_SQL}",
    "folder_listing": C + f"SELECT path FROM files_c WHERE starts_with(path, split({PATH_SQL}, '/')[1] || '/') ORDER BY 1 LIMIT 200",
    "symbols_in_files": C + "SELECT path, array_to_string(list_sort(list(qname)), ',') AS qnames FROM symbols_c JOIN files_c USING (file_id) GROUP BY 1",
    "bindings_by_file": C + "SELECT path, array_to_string(list_sort(list(DISTINCT local_name)), ',') AS locals FROM imports_c WHERE local_name IS NOT NULL AND path IS NOT NULL GROUP BY 1",
    "view_full_edges": VIEW_CTES + "SELECT * FROM fe",
    "view_full_nodes": VIEW_CTES + "SELECT * FROM fn UNION ALL SELECT * FROM sn",
    "view_repo_edges": VIEW_CTES + "SELECT * FROM fd",
    "view_repo_nodes": VIEW_CTES + "SELECT * FROM fn UNION ALL SELECT * FROM dn",
    "view_symbols_edges": VIEW_CTES + "SELECT * FROM hd",
    "view_calls_nodes": VIEW_CTES + "SELECT * FROM cn",
    "view_calls_edges": VIEW_CTES + "SELECT * FROM ce",
    "view_framework_nodes": VIEW_CTES + "SELECT * FROM wn",
    "view_framework_edges": VIEW_CTES + "SELECT * FROM we",
    "view_metadata": VIEW_CTES + f"SELECT 'full' AS view, {views.SCHEMA_VERSION} AS schema_version, (SELECT count(*) FROM fn) + (SELECT count(*) FROM sn) AS node_count, (SELECT count(*) FROM fe) AS edge_count",
    "node_sizes": VIEW_CTES
    + """, pp AS (SELECT source AS id, target AS other FROM ce UNION ALL SELECT target, source FROM ce), dg AS (SELECT id, count(*) AS degree, count(DISTINCT other) AS n_neighbours FROM pp GROUP BY 1)
SELECT id, coalesce(degree, 0) AS degree, coalesce(n_neighbours, 0) AS n_neighbours, round(ln(coalesce(degree, 0) + 1) * 1.1, 6) AS size FROM cn LEFT JOIN dg USING (id)""",
    "fallback_nodes": VIEW_CTES
    + """, nm AS (SELECT DISTINCT coalesce(dst, dst_name) AS qname FROM edges_c WHERE coalesce(dst, dst_name) IS NOT NULL)
SELECT 'symbol:' || qname AS id, coalesce(label, split(qname, '.')[-1]) AS label, coalesce(kind, 'symbol') AS kind, coalesce(path, '') AS path FROM nm LEFT JOIN sn ON sn.id = 'symbol:' || qname""",
    "role_reasons": ROLES_SQL
    + """, mg AS (SELECT qname, role, s, c FROM every GROUP BY ALL), rs AS (SELECT qname, role, array_to_string(list(s || ' ' || printf('%.2f', c) ORDER BY c DESC, s)[1:3], '; ') AS reason FROM mg GROUP BY 1, 2)
SELECT qname, role, reason FROM roles JOIN rs USING (qname, role)""",
    "role_signals": ROLES_SQL + "SELECT role, s AS source, CAST(sum(n) AS BIGINT) AS n_signals, max(c) AS confidence FROM every GROUP BY 1, 2",
    "node_roles": ROLES_SQL + "SELECT 'symbol:' || qname AS id, (list(role ORDER BY confidence DESC, role))[1] AS role, array_to_string(list(role ORDER BY confidence DESC, role), ',') AS roles FROM roles GROUP BY 1",
    "process_steps": STEPS_SQL + "SELECT * FROM st2",
    "process_step_edges": STEPS_SQL + "SELECT src, dst, 'STEP_IN_PROCESS' AS edge_type, 3 AS precision_level, 'process-builder' AS extraction_source, 'step ' || step || ' of ' || process_id AS reason FROM st2",
    "process_counts": TRACE_SQL + "SELECT process_type, count(*) AS n FROM tr GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM tr",
    "process_list": TRACE_SQL + "SELECT process_id, confidence FROM tr ORDER BY 2 DESC, 1 LIMIT 10",
    "process_view": STEPS_SQL
    + """, al AS (SELECT 'symbol:' || src AS source, 'symbol:' || dst AS target, edge_type AS type FROM st2 UNION ALL SELECT 'process:' || process_id, 'symbol:' || src, 'MEMBER_OF' FROM st2)
SELECT source, target, type, count(*) AS n FROM al GROUP BY 1, 2, 3""",
    "route_labels": C
    + """, x AS (SELECT qname, name, CASE WHEN json_valid(extras) THEN json_extract_string(extras, '$.http_method') END AS m, CASE WHEN json_valid(extras) THEN json_extract_string(extras, '$.path') END AS p FROM symbols_c WHERE kind = 'route')
SELECT qname, coalesce(CASE WHEN p <> '' THEN trim(concat_ws(' ', nullif(m, ''), p)) END, nullif(name, ''), qname) AS label FROM x""",
    "edit_neighbours": C
    + f""", {CALLERS_SQL}, alone AS (SELECT name AS dst_name, min(qname) AS q FROM symbols_c GROUP BY 1 HAVING count(*) = 1),
tg AS (SELECT e.*, coalesce(e.dst, s.qname, a.q) AS target FROM edges_c e LEFT JOIN symbols_c s ON e.dst IS NULL AND s.qname = e.dst_name LEFT JOIN alone a ON e.dst IS NULL AND a.dst_name = e.dst_name),
al AS (SELECT 'caller' AS direction, src AS qname, ch.qname AS of, place, 0 AS d, edge_id, 0.8::DOUBLE AS confidence FROM edges_c JOIN ch ON dst = ch.qname WHERE place <= 5 AND edge_type IN ('CALLS', 'ROUTES_TO')
  UNION ALL SELECT 'callee', target, ch.qname, place, 1, edge_id, 0.7 FROM tg JOIN ch ON src = ch.qname WHERE place <= 5 AND edge_type = 'CALLS'),
oc AS (SELECT * FROM al WHERE qname IN (SELECT qname FROM symbols_c) QUALIFY row_number() OVER (PARTITION BY qname ORDER BY place, d, edge_id) = 1)
SELECT direction, qname, of, confidence FROM oc QUALIFY row_number() OVER (PARTITION BY direction ORDER BY place, d, edge_id) <= 8""",
    "edit_traces": TRACE_SQL
    + f""", {CALLERS_SQL}, rw AS (SELECT process_id, confidence, unnest(list_distinct(vis)) AS qname FROM tr), rk AS (SELECT * FROM rw WHERE qname IN (SELECT qname FROM ch) QUALIFY row_number() OVER (PARTITION BY qname ORDER BY confidence DESC, process_id) <= 3)
SELECT DISTINCT process_id, confidence FROM rk ORDER BY 2 DESC, 1 LIMIT 5""",
    "task_tests": C
    + f""", t AS (SELECT path, CASE WHEN contains(lower(coalesce(content, '')), '{(workflow.task_keyword(TASK) or "").lower()}') THEN 0.65::DOUBLE ELSE 0.35 END AS confidence FROM files_c WHERE contains(lower(path), 'test') OR contains(lower(path), 'spec'))
SELECT path, confidence FROM t WHERE confidence = (SELECT max(confidence) FROM t) ORDER BY {PRIORITY} LIMIT 5""",
    "task_words": f"""WITH k AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{3,}}')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{3,}}'), 1) AS p FROM benchmark),
kw AS (SELECT item_id, arg_max(w, (length(w), -p)) AS keyword FROM k WHERE lower(w) NOT IN ({STOPPED}) GROUP BY 1),
r AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT item_id, list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_+-]{{2,}}'), lambda w: replace(lower(w), '_', '-')) AS ws FROM benchmark) x),
rd AS (SELECT item_id, w, min(p) AS p FROM r WHERE w NOT IN ({NO_RISK}) GROUP BY 1, 2), r5 AS (SELECT item_id, list(w ORDER BY p)[1:5] AS kept FROM rd GROUP BY 1),
sx AS (SELECT DISTINCT item_id, true AS secret FROM r WHERE w IN ({_in(workflow.SECRETS)}))
SELECT b.item_id, keyword, array_to_string(CASE WHEN coalesce(secret, false) AND NOT list_contains(coalesce(kept, []), 'secret') THEN list_concat(['secret'], coalesce(kept, [])) ELSE coalesce(kept, []) END, ',') AS risks
FROM benchmark b LEFT JOIN kw USING (item_id) LEFT JOIN r5 USING (item_id) LEFT JOIN sx USING (item_id) WHERE text IS NOT NULL""",
    "question_terms": "SELECT item_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9_]+'), lambda t: lower(t)))) AS term FROM benchmark WHERE text IS NOT NULL",
    "name_pieces": C + f"SELECT qname, unnest(list_distinct({PIECES})) AS piece FROM symbols_c",
    "file_modules": C
    + r"""SELECT path, CASE WHEN language = 'python' THEN regexp_replace(replace(regexp_replace(path, '\.[A-Za-z0-9]+$', ''), '/', '.'), '\.__init__$', '')
  ELSE replace(regexp_replace(regexp_replace(path, '\.(ts|tsx|js|jsx|mjs|cjs)$', ''), '/index$', ''), '/', '.') END AS module FROM files_c WHERE language IN ('python', 'javascript', 'typescript')""",
    "package_roots": C
    + r""", fo AS (SELECT DISTINCT regexp_replace(path, '/__init__\.py$', '') AS folder FROM files_c WHERE regexp_matches(path, '/__init__\.py$'))
SELECT replace(folder, '/', '.') AS disk, split(folder, '/')[-1] AS name FROM fo WHERE contains(folder, '/') AND regexp_replace(folder, '/?[^/]*$', '') NOT IN (SELECT folder FROM fo)""",
    "alias_targets": BINDINGS_SQL + "SELECT path, local_name, arg_max(target, import_id) AS alias_target FROM bound WHERE local_name IS NOT NULL GROUP BY 1, 2",
}
