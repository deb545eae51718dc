"""Roles of symbols, inferred by rules whose evidence is combined by noisy-OR."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

THRESHOLD, MOST, SIGNAL_MOST = 0.55, 0.98, 0.99
ROUTE_TYPES, EXTERNAL_TYPES = ("HANDLES_ROUTE", "ROUTES_TO", "ROUTE_HANDLED_BY"), ("FETCHES", "CALLS_EXTERNAL")
TEST_TYPES, DB_TYPES = ("TESTS", "TESTS_SYMBOL", "COVERS_ROUTE", "COVERS_PROCESS"), ("QUERIES", "MODEL_USED_BY")

# Role, words, confidence of each rule.
KIND_RULES = [
    ("handler", ("route",), 0.78), ("test", ("test", "test_block"), 0.9), ("fixture", ("fixture",), 0.9),
    ("model", ("model", "orm_model", "database_table"), 0.86), ("config", ("env_var", "config_key"), 0.86), ("client", ("api_consumer",), 0.84),
]
PATH_RULES = [
    ("controller", ("controller", "controllers"), 0.7), ("handler", ("route", "routes", "handler", "handlers", "api"), 0.68),
    ("service", ("service", "services", "usecase", "usecases"), 0.72), ("repository", ("repository", "repositories", "repo", "repos", "dao", "persistence"), 0.74),
    ("model", ("model", "models", "entity", "entities"), 0.72), ("schema", ("schema", "schemas", "dto", "dtos", "types"), 0.68),
    ("validator", ("validator", "validators", "validation"), 0.68), ("middleware", ("middleware", "middlewares"), 0.76),
    ("client", ("client", "clients", "sdk", "api_client"), 0.7), ("config", ("config", "configs", "settings", "env"), 0.68),
    ("test", ("test", "tests", "__tests__", "spec"), 0.78), ("fixture", ("fixture", "fixtures", "conftest"), 0.78),
    ("job", ("job", "jobs", "task", "tasks", "worker", "workers", "queues"), 0.68),
]
NAME_RULES = [
    ("controller", ("controller",), 0.68), ("handler", ("handler", "route", "endpoint", "view"), 0.66), ("service", ("service", "usecase", "manager"), 0.68),
    ("repository", ("repository", "repo", "dao"), 0.7), ("model", ("model", "entity"), 0.66), ("schema", ("schema", "dto", "payload", "request", "response"), 0.62),
    ("validator", ("validator", "validate", "validation"), 0.68), ("middleware", ("middleware",), 0.72), ("client", ("client", "adapter", "provider"), 0.64),
    ("external_service", ("external", "thirdparty", "gateway"), 0.62), ("config", ("config", "settings", "env"), 0.62), ("test", ("test", "spec", "should"), 0.7),
    ("fixture", ("fixture",), 0.72), ("job", ("job", "task", "worker", "queue", "consumer"), 0.64),
]
METADATA_RULES = [
    ("handler", ("@app.get", "@app.post", "@router.get", "@router.post", "fastapi"), 0.86), ("handler", ("@app.route", "@blueprint.route", "flask"), 0.84),
    ("handler", ("django", "urlpatterns", "path("), 0.78), ("fixture", ("pytest.fixture", "@fixture"), 0.88), ("job", ("celery", "@shared_task", "@app.task"), 0.84),
    ("middleware", ("middleware", "@app.middleware"), 0.82), ("schema", ("pydantic", "basemodel", "zod", "yup", "schema"), 0.76),
    ("model", ("sqlalchemy", "django.db.models", "prisma", "model"), 0.76), ("client", ("axios", "fetch", "requests", "httpx", "aiohttp"), 0.72),
    ("external_service", ("openai", "stripe", "twilio", "s3", "redis", "http"), 0.64), ("config", ("os.environ", "process.env", "dotenv", "settings"), 0.72),
]


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits, and the pieces that upper case and digits cut them into."""
    chunks = F.filter(F.split(text, "[^a-zA-Z0-9]+"), lambda c: c != "")
    pieces = F.flatten(F.transform(chunks, lambda c: F.regexp_extract_all(c, F.lit("([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+)"), F.lit(1))))
    return F.array_distinct(F.transform(F.concat(chunks, pieces), F.lower))


def _hits(rules: list, source: str, test) -> list[Column]:
    return [F.when(test(needles), F.struct(F.lit(role).alias("role"), F.lit(source).alias("source"), F.lit(c).alias("confidence"))) for role, needles, c in rules]


def _any(column: str, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(column).contains(n) for n in needles])


def symbol_signals(symbols: DataFrame) -> DataFrame:
    """``qname, role, source, confidence`` from kind, path, names and metadata: one pass over the rows, no join."""
    s = symbols.withColumns(
        {
            "_kind": F.lower(F.coalesce("kind", F.lit(""))),
            "_path": F.lower(F.translate(F.coalesce("path", F.lit("")), "\\", "/")),
            "_words": words_of(F.concat_ws(" ", F.lower(F.coalesce("path", F.lit(""))), F.coalesce("name", F.lit("")), "qname")),
            "_blob": F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("signature", "docstring", "return_type", "declared_type", "parser_backend", "extras", "metadata_json")])),
        }
    )
    found = (
        _hits(KIND_RULES, "framework", lambda n: F.col("_kind").isin(*n))
        + _hits(PATH_RULES, "path", lambda n: _any("_path", n))
        + _hits(NAME_RULES, "name", lambda n: F.arrays_overlap("_words", F.array(*map(F.lit, n))))
        + _hits(METADATA_RULES, "metadata", lambda n: _any("_blob", n))
    )
    return s.select("qname", F.explode(F.array_compact(F.array(*found))).alias("hit")).select("qname", "hit.*")


def edge_signals(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Signals of framework edges, one per edge: ``qname, role, source, confidence, n``, counted before the join."""
    target = F.coalesce("dst", "dst_name")
    t = F.col("edge_type")

    def hit(when: Column, name: Column, role: str, c: float, by_src: bool) -> Column:
        return F.when(when & name.isNotNull(), F.struct(name.alias("qname"), F.lit(role).alias("role"), F.lit(c).alias("confidence"), F.lit(by_src).alias("by_src")))

    # one pass over the edges; each gives up to two signals
    src, routes = F.col("src"), t.isin(*ROUTE_TYPES)
    hits = [
        hit(routes, target, "handler", 0.88, False), hit(routes, src, "handler", 0.8, True), hit(t.isin(*DB_TYPES), src, "repository", 0.84, True),
        hit(t.isin(*EXTERNAL_TYPES), src, "client", 0.82, True), hit(t.isin(*TEST_TYPES), src, "test", 0.84, True),
    ]
    rows = edges.where(t.isin(*ROUTE_TYPES, *EXTERNAL_TYPES, *TEST_TYPES, *DB_TYPES)).select(F.inline(F.array_compact(F.array(*hits))))
    counted = rows.groupBy("qname", "role", "confidence", "by_src").agg(F.count("*").alias("n"))
    known = symbols.select("qname", "kind")
    joined = counted.join(known, "qname").where(~((F.col("role") == "handler") & F.col("by_src") & (F.col("kind") == "route")))
    return joined.select("qname", "role", F.lit("framework").alias("source"), "confidence", "n")


def position_signals(edges: DataFrame, symbols: DataFrame, signals: DataFrame) -> DataFrame:
    """Signals of a symbol's place in the graph. They read only the handler and repository roles of the other signals."""
    roles = signals.where(F.col("role").isin("handler", "repository")).select("qname", "role").distinct()
    handlers = roles.where("role = 'handler'").select(F.col("qname").alias("src"), F.lit(True).alias("by_handler"))
    stores = roles.where("role = 'repository'").select(F.col("qname").alias("dst"), F.lit(True).alias("to_store"))
    t = F.col("edge_type")
    inbound = edges.where("dst is not null").join(handlers, "src", "left").groupBy(F.col("dst").alias("qname")).agg(
        F.max(t.isin("CALLS", "ROUTES_TO", "HANDLES_ROUTE") & F.coalesce("by_handler", F.lit(False))).alias("called_by_handler"),
        F.min(t.isin(*TEST_TYPES)).alias("tested_only"), F.count_if(t == "CALLS").alias("calls_in"),
    )
    outbound = edges.where("src is not null").join(stores, "dst", "left").groupBy(F.col("src").alias("qname")).agg(
        F.max(t.isin("CALLS", *DB_TYPES) & (F.coalesce("to_store", F.lit(False)) | t.isin(*DB_TYPES))).alias("calls_store"),
        F.max(t.isin(*EXTERNAL_TYPES)).alias("calls_external"), F.count_if(t == "CALLS").alias("calls_out"), F.count("*").alias("n_out"),
    )
    own = roles.where("role = 'handler'").select("qname", F.lit(True).alias("is_handler"))
    at = symbols.select("qname").join(inbound, "qname", "left").join(outbound, "qname", "left").join(own, "qname", "left")
    at = at.fillna(False, ["called_by_handler", "tested_only", "calls_store", "calls_external", "is_handler"]).fillna(0, ["calls_in", "calls_out", "n_out"])
    c = F.col

    def hit(when: Column, role: str, value: float) -> Column:
        return F.when(when, F.struct(F.lit(role).alias("role"), F.lit("graph_position").alias("source"), F.lit(value).alias("confidence")))

    both = c("called_by_handler") & c("calls_store")
    hits = [
        hit(both, "service", 0.88), hit(~both & c("called_by_handler") & (c("n_out") > 0) & ~c("is_handler"), "service", 0.72), hit(c("calls_store"), "service", 0.68),
        hit(c("calls_external") & ~c("is_handler"), "client", 0.72), hit(c("tested_only"), "test", 0.62), hit((c("calls_in") >= 5) & (c("calls_out") == 0), "utility", 0.56),
    ]
    return at.select("qname", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("qname", "hit.*")


def signals(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``qname, role, source, confidence, n``: all evidence; ``n`` counts equal signals of edges."""
    first = symbol_signals(symbols).withColumn("n", F.lit(1).cast("long")).unionByName(edge_signals(edges, symbols))
    return first.unionByName(position_signals(edges, symbols, first).withColumn("n", F.lit(1).cast("long")))


def combine(evidence: DataFrame) -> DataFrame:
    """``qname, role, confidence, n_signals`` of every role with combined confidence of at least the threshold."""
    doubt = F.exp(F.sum(F.col("n") * F.log(1 - F.least(F.col("confidence"), F.lit(SIGNAL_MOST)))))
    roles = evidence.groupBy("qname", "role").agg(F.round(F.least(1 - doubt, F.lit(MOST)), 4).alias("confidence"), F.sum("n").alias("n_signals"))
    return roles.where(F.col("confidence") >= THRESHOLD)


def classify(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    return combine(signals(symbols, edges))


def reasons(evidence: DataFrame) -> DataFrame:
    """``qname, role, reason, signals_json`` of every role: its three strongest signals as text, and all of them as JSON.

    Equal signals are put together first, so a symbol with very many framework edges has few.
    """
    merged = evidence.groupBy("qname", "role", "source", "confidence").agg(F.sum("n").alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "source", "n")))
    listed = merged.groupBy("qname", "role").agg(order.alias("s"))
    text = F.array_join(F.transform(F.slice("s", 1, 3), lambda x: F.format_string("%s %.2f", x["source"], -x["c"])), "; ")
    json = F.to_json(F.transform("s", lambda x: F.struct(x["source"].alias("source"), F.round(-x["c"], 4).alias("confidence"), x["n"].alias("n"))))
    return listed.select("qname", "role", text.alias("reason"), json.alias("signals_json"))


def role_rows(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Roles as they are stored: ``qname, role, confidence, n_signals, reason, signals_json``."""
    evidence = cut_lineage(signals(symbols, edges))
    return combine(evidence).join(reasons(evidence), ["qname", "role"])


def roles_of(roles: DataFrame, qname: str) -> DataFrame:
    return roles.where(F.col("qname") == qname).orderBy(F.desc("confidence"), "role")


def primary(roles: DataFrame) -> DataFrame:
    """The most confident role of each symbol; ties go to the first name."""
    return roles.groupBy("qname").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "role")).alias("best")).select("qname", "best.role", (-F.col("best.c")).alias("confidence"))
