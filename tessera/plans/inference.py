"""Roles and processes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import processes as p
from tessera.operators import roles as r
from tessera.sources import graph

COLUMNS = ("signature", "docstring", "return_type", "declared_type", "parser_backend", "extras", "metadata_json")


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return graph.symbols(spark, d, *COLUMNS).join(graph.files(spark, d).select("file_id", "path"), "file_id")


def role_noisy_or(spark: SparkSession, d: str) -> DataFrame:
    return r.classify(_symbols(spark, d), graph.edges(spark, d))


def primary_role(spark: SparkSession, d: str) -> DataFrame:
    return r.primary(role_noisy_or(spark, d))


def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return role_noisy_or(spark, d).groupBy("role").agg(F.count("*").alias("n_symbols"), F.round(F.avg("confidence"), 6).alias("confidence"))


def trace_walk(spark: SparkSession, d: str) -> DataFrame:
    return p.build(graph.symbols(spark, d, "extras"), graph.edges(spark, d, "confidence", "precision_level", "metadata_json"))


def processes_touching(spark: SparkSession, d: str) -> DataFrame:
    """How many processes touch each symbol, and the strongest of them."""
    steps = trace_walk(spark, d).select("process_id", "confidence", F.explode(F.array_distinct(F.split("path", " > "))).alias("qname"))
    return steps.groupBy("qname").agg(F.count("*").alias("n_processes"), F.max("confidence").alias("confidence"))


def route_paths(spark: SparkSession, d: str) -> DataFrame:
    routes = graph.symbols(spark, d, "extras").where("kind = 'route'")
    path = F.get_json_object("extras", "$.path")
    return routes.where(path.isNotNull()).groupBy(p.normalize_path(path).alias("path")).agg(F.count("*").alias("n_routes"))


def _any_sql(column: str, needles: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{n}')" for n in needles) + ")"


def _list_sql(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


SIGNALS = " UNION ALL ".join(
    [f"SELECT qname, '{role}' AS role, {c}::DOUBLE AS c, 1 AS n, 'framework' AS s FROM base WHERE k IN ({_list_sql(n)})" for role, n, c in r.KIND_RULES]
    + [f"SELECT qname, '{role}', {c}, 1, 'path' FROM base WHERE {_any_sql('pth', n)}" for role, n, c in r.PATH_RULES]
    + [f"SELECT qname, '{role}', {c}, 1, 'name' FROM base WHERE list_has_any(words, [{_list_sql(n)}])" for role, n, c in r.NAME_RULES]
    + [f"SELECT qname, '{role}', {c}, 1, 'metadata' FROM base WHERE {_any_sql('blob', n)}" for role, n, c in r.METADATA_RULES]
)
EVERY = (*r.ROUTE_TYPES, *r.EXTERNAL_TYPES, *r.TEST_TYPES, *r.DB_TYPES)
ROLES_SQL = (
    graph.CANONICAL_SQL
    + f""",
sym AS (SELECT s.*, path FROM symbols_c s JOIN files_c USING (file_id)),
pre AS (SELECT *, concat_ws(' ', lower(coalesce(path, '')), coalesce(name, ''), qname) AS hay FROM sym),
base AS (SELECT qname, lower(coalesce(kind, '')) AS k, replace(lower(coalesce(path, '')), '\\', '/') AS pth,
  list_transform(list_concat(list_filter(regexp_split_to_array(hay, '[^a-zA-Z0-9]+'), lambda x: x <> ''),
    regexp_extract_all(regexp_replace(hay, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')), lambda x: lower(x)) AS words,
  lower(concat_ws(' ', coalesce(signature, ''), coalesce(docstring, ''), coalesce(return_type, ''), coalesce(declared_type, ''), coalesce(parser_backend, ''), coalesce(extras, ''), coalesce(metadata_json, ''))) AS blob FROM pre),
ed AS (SELECT *, coalesce(dst, dst_name) AS target FROM edges_c WHERE edge_type IN ({_list_sql(EVERY)})),
first AS ({SIGNALS}
  UNION ALL SELECT s.qname, 'handler', 0.88, 1, 'framework' FROM ed JOIN sym s ON s.qname = target WHERE edge_type IN ({_list_sql(r.ROUTE_TYPES)})
  UNION ALL SELECT s.qname, 'handler', 0.8, 1, 'framework' FROM ed JOIN sym s ON s.qname = src WHERE edge_type IN ({_list_sql(r.ROUTE_TYPES)}) AND kind <> 'route'
  UNION ALL SELECT s.qname, 'repository', 0.84, 1, 'framework' FROM ed JOIN sym s ON s.qname = src WHERE edge_type IN ({_list_sql(r.DB_TYPES)})
  UNION ALL SELECT s.qname, 'client', 0.82, 1, 'framework' FROM ed JOIN sym s ON s.qname = src WHERE edge_type IN ({_list_sql(r.EXTERNAL_TYPES)})
  UNION ALL SELECT s.qname, 'test', 0.84, 1, 'framework' FROM ed JOIN sym s ON s.qname = src WHERE edge_type IN ({_list_sql(r.TEST_TYPES)})),
h AS (SELECT DISTINCT qname FROM first WHERE role = 'handler'), rp AS (SELECT DISTINCT qname FROM first WHERE role = 'repository'),
inb AS (SELECT dst AS qname, bool_or(edge_type IN ('CALLS', 'ROUTES_TO', 'HANDLES_ROUTE') AND coalesce(src IN (SELECT qname FROM h), false)) AS cbh, bool_and(edge_type IN ({_list_sql(r.TEST_TYPES)})) AS tested,
  count(*) FILTER (edge_type = 'CALLS') AS cin FROM edges_c WHERE dst IS NOT NULL GROUP BY 1),
outb AS (SELECT src AS qname, bool_or(edge_type IN ('CALLS', {_list_sql(r.DB_TYPES)}) AND (coalesce(dst IN (SELECT qname FROM rp), false) OR edge_type IN ({_list_sql(r.DB_TYPES)}))) AS cst, bool_or(edge_type IN ({_list_sql(r.EXTERNAL_TYPES)})) AS cex,
  count(*) FILTER (edge_type = 'CALLS') AS cout, count(*) AS nout FROM edges_c WHERE src IS NOT NULL GROUP BY 1),
pos AS (SELECT sym.qname, coalesce(cbh, false) AS cbh, coalesce(tested, false) AS tested, coalesce(cst, false) AS cst, coalesce(cex, false) AS cex, coalesce(cin, 0) AS cin, coalesce(cout, 0) AS cout, coalesce(nout, 0) AS nout,
  sym.qname IN (SELECT qname FROM h) AS ish FROM sym LEFT JOIN inb USING (qname) LEFT JOIN outb USING (qname)),
every AS (SELECT * FROM first UNION ALL SELECT qname, 'service', 0.88, 1, 'graph_position' FROM pos WHERE cbh AND cst UNION ALL SELECT qname, 'service', 0.72, 1, 'graph_position' FROM pos WHERE cbh AND NOT cst AND nout > 0 AND NOT ish
  UNION ALL SELECT qname, 'service', 0.68, 1, 'graph_position' FROM pos WHERE cst UNION ALL SELECT qname, 'client', 0.72, 1, 'graph_position' FROM pos WHERE cex AND NOT ish UNION ALL SELECT qname, 'test', 0.62, 1, 'graph_position' FROM pos WHERE tested
  UNION ALL SELECT qname, 'utility', 0.56, 1, 'graph_position' FROM pos WHERE cin >= 5 AND cout = 0),
roles AS (SELECT * FROM (SELECT qname, role, round(least(1 - exp(sum(ln(1 - least(c, 0.99)))), 0.98), 4) AS confidence, CAST(sum(n) AS BIGINT) AS n_signals FROM every GROUP BY 1, 2) x WHERE confidence >= 0.55)"""
)
TRACE_SQL = (
    graph.CANONICAL_SQL
    + """,
alone AS (SELECT name AS dst_name, min(qname) AS q FROM symbols_c GROUP BY 1 HAVING count(*) = 1),
tg AS (SELECT e.*, coalesce(e.dst, s.qname, a.q) AS target FROM edges_c e LEFT JOIN symbols_c s ON e.dst IS NULL AND s.qname = e.dst_name LEFT JOIN alone a ON e.dst IS NULL AND a.dst_name = e.dst_name),
st AS (SELECT src, target, edge_type, confidence, row_number() OVER (ORDER BY CASE edge_type WHEN 'CALLS' THEN 0 WHEN 'QUERIES' THEN 1 WHEN 'CALLS_EXTERNAL' THEN 2 WHEN 'FETCHES' THEN 3 ELSE 4 END, -confidence, -coalesce(precision_level, 0), edge_id) AS o
  FROM tg WHERE edge_type IN ('CALLS', 'QUERIES', 'CALLS_EXTERNAL', 'FETCHES', 'ROUTES_TO') AND confidence >= 0.5 AND src <> target AND target IS NOT NULL),
ent AS (SELECT qname, 'api_flow' AS pt, 8 AS md, target, confidence, dst IS NULL AS u, edge_id FROM symbols_c JOIN tg ON src = qname WHERE kind = 'route' AND edge_type = 'HANDLES_ROUTE' AND confidence >= 0.5 AND target IS NOT NULL
  UNION ALL SELECT qname, 'test_flow', 4, target, confidence, dst IS NULL, edge_id FROM symbols_c JOIN tg ON src = qname WHERE kind = 'test_block' AND edge_type = 'TESTS' AND confidence >= 0.45 AND target IS NOT NULL),
e0 AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY pt, qname ORDER BY u, -confidence, edge_id) = 1),
e1 AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY substr(trim(regexp_replace(pt || '::' || qname, '[^a-zA-Z0-9._:/-]+', '-', 'g'), '-'), 1, 200) ORDER BY qname) = 1),
wk AS (
  SELECT pt, qname, md, target AS at_, [qname, target] AS vis, 1 AS n, ln(greatest(0.01, least(1.0, confidence))) AS ls, false AS fin FROM e1
  UNION ALL
  SELECT pt, qname, md, at_, vis, n, ls, fin FROM (
    SELECT w.pt, w.qname, w.md, st.target AS at_, list_append(w.vis, st.target) AS vis, w.n + 1 AS n, w.ls + ln(greatest(0.01, least(1.0, st.confidence))) AS ls,
      st.edge_type IN ('QUERIES', 'CALLS_EXTERNAL', 'FETCHES') AS fin, row_number() OVER (PARTITION BY w.pt, w.qname ORDER BY st.o) AS r
    FROM wk w JOIN st ON st.src = w.at_ WHERE NOT w.fin AND w.n < w.md AND (NOT list_contains(w.vis, st.target) OR st.edge_type IN ('QUERIES', 'CALLS_EXTERNAL', 'FETCHES'))) x WHERE r = 1),
tr AS (SELECT substr(trim(regexp_replace(pt || '::' || qname, '[^a-zA-Z0-9._:/-]+', '-', 'g'), '-'), 1, 200) AS process_id, pt AS process_type, qname AS entrypoint, at_ AS terminal, CAST(n AS INTEGER) AS n_steps,
  round(exp(ls / n), 6) AS confidence, array_to_string(vis, ' > ') AS path, vis FROM wk QUALIFY row_number() OVER (PARTITION BY pt, qname ORDER BY n DESC) = 1)"""
)
QUERIES = {f.__name__: f for f in (role_noisy_or, primary_role, role_counts, trace_walk, processes_touching, route_paths)}
SQL = {
    "role_noisy_or": ROLES_SQL + "SELECT * FROM roles",
    "primary_role": ROLES_SQL + "SELECT qname, role, confidence FROM roles QUALIFY row_number() OVER (PARTITION BY qname ORDER BY confidence DESC, role) = 1",
    "role_counts": ROLES_SQL + "SELECT role, count(*) AS n_symbols, round(avg(confidence), 6) AS confidence FROM roles GROUP BY 1",
    "trace_walk": TRACE_SQL + "SELECT * EXCLUDE (vis) FROM tr",
    "processes_touching": TRACE_SQL + "SELECT qname, count(*) AS n_processes, max(confidence) AS confidence FROM (SELECT confidence, unnest(list_distinct(vis)) AS qname FROM tr) x GROUP BY 1",
    "route_paths": graph.CANONICAL_SQL
    + r"""SELECT regexp_replace(regexp_replace(lower(trim(json_extract_string(extras, '$.path'), '/')), '\[[^\]]+\]', ':param', 'g'), ':[a-z0-9_]+', ':param', 'g') AS path, count(*) AS n_routes
FROM symbols_c WHERE kind = 'route' AND json_valid(extras) AND json_extract_string(extras, '$.path') IS NOT NULL GROUP BY 1""",
}
