"""Hybrid retrieval: ranked lists fused, expanded over the graph, reranked and packed under a budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.processes import resolved_targets
from tessera.session import cut_lineage

RRF_K, SEEDS, DECAY = 60, 30, 0.55

# Needles of each intent, in the order in which they are tried.
INTENTS = [
    ("impact_analysis", ("impact", "what breaks", "if i change", "if i modify", "affected", "blast radius")),
    ("bug_fix", ("bug", "fix", "broken", "error", "crash", "fails")),
    ("feature_implementation", ("add ", "implement", "build", "create new", "feature")),
    ("refactor", ("refactor", "rename", "clean up", "extract", "simplify")),
    ("test_generation", ("test", "spec", "coverage")),
    ("security_review", ("security", "auth", "vulnerab", "leak", "secret", "permission")),
    ("api_usage", ("how do i call", "usage of", "api for")),
    ("onboarding", ("onboard", "overview", "what is this", "tour", "where do i start")),
    ("architecture_explanation", ("architecture", "how does", "how it works", "explain the", "flow")),
]
# Edge types followed out of and into a symbol, by mode.
MODE_EDGES = {
    "impact": (("CALLS", "ROUTES_TO"), ("CALLS", "TESTS", "ROUTES_TO", "EXTENDS")), "feature": (("CALLS", "IMPORTS", "ROUTES_TO"), ("CALLS", "ROUTES_TO", "TESTS")),
    "edit": (("CALLS", "IMPORTS"), ("CALLS", "TESTS", "ROUTES_TO")), "debug": (("CALLS", "IMPORTS"), ("CALLS", "TESTS")), "test": (("CALLS",), ("TESTS",)),
    "security": (("CALLS", "IMPORTS", "ROUTES_TO"), ("ROUTES_TO", "CALLS")), "refactor": (("CALLS", "IMPORTS", "EXTENDS"), ("CALLS", "EXTENDS", "TESTS")),
    "onboarding": (("CALLS", "IMPORTS", "ROUTES_TO"), ("CALLS", "ROUTES_TO")), "explain": (("CALLS", "IMPORTS", "EXTENDS", "ROUTES_TO"), ("CALLS", "ROUTES_TO", "TESTS")),
}
# Weights of bm25, vector, graph, identifier, mode fit, test, intent and the generic penalty, by mode.
_EDIT = (0.40, 0.36, 0.10, 0.10, 0.06, 0.04, 0.04, 0.25)
_EXPLAIN = (0.32, 0.42, 0.14, 0.06, 0.05, 0.03, 0.04, 0.30)
WEIGHTS = {
    "security": (0.40, 0.40, 0.10, 0.08, 0.05, 0.03, 0.04, 0.30), "explain": _EXPLAIN, "onboarding": _EXPLAIN, "edit": _EDIT, "feature": _EDIT, "debug": _EDIT,
    "refactor": _EDIT, "impact": (0.20, 0.18, 0.40, 0.06, 0.08, 0.04, 0.04, 0.20), "test": (0.25, 0.22, 0.22, 0.06, 0.05, 0.15, 0.05, 0.18),
}
# Capsules per file, pure graph hits, capsules, whether tests are dropped, share of the budget for capsules.
CAPS = {
    "impact": (8, 14, 16, False, 0.50), "explain": (4, 6, 8, True, 0.50), "onboarding": (4, 6, 8, True, 0.50), "security": (5, 8, 12, False, 0.45),
    "edit": (5, 8, 12, False, 0.40), "feature": (5, 8, 12, False, 0.40), "refactor": (5, 8, 12, False, 0.40), "debug": (5, 8, 12, False, 0.40), "test": (6, 8, 14, False, 0.42),
}
# Names that say little unless the question has them.
GENERIC = (
    "main", "run", "start", "stop", "init", "stats", "status", "health", "ping", "version", "info", "config", "settings", "setup", "configure",
    "parse_args", "cli", "command", "exec", "execute", "write_report", "render_report", "to_json", "to_dict", "from_dict", "as_dict", "loads",
    "dumps", "echo", "log", "print", "debug", "register", "load", "build_app", "create_app",
)
TEST_INFRA = ("fixture", "conftest", "setup_method", "teardown_method", "setup", "teardown")


def classify_intent(question: Column | str) -> Column:
    """The first intent of which a needle occurs in the question, else ``explain``."""
    q = F.lower(F.col(question) if isinstance(question, str) else question)
    case = F
    for name, needles in INTENTS:
        case = case.when(reduce(lambda a, b: a | b, [q.contains(n) for n in needles]), name)
    return case.otherwise("explain")


def query_terms(question: str) -> list[str]:
    import re

    return sorted({t.lower() for t in re.findall(r"[A-Za-z][A-Za-z0-9_]+", question)})


def rrf(lists: DataFrame, k: int = RRF_K, limit: int = SEEDS) -> DataFrame:
    """Reciprocal rank fusion of ``source, qname, rank`` (from 0): ``qname, rrf, sources, pinned``, the ``limit`` best.

    Pinned ones (those with a source of that name) stand before all others.
    """
    fused = lists.groupBy("qname").agg(
        F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf"), F.array_sort(F.collect_set("source")).alias("sources"), F.max(F.col("source") == "pinned").alias("pinned")
    )
    return fused.orderBy(F.desc("pinned"), F.desc(F.round("rrf", 12)), "qname").limit(limit)


def identifier_hits(symbols: DataFrame, terms: list[str], per_term: int = 3) -> DataFrame:
    """Up to ``per_term`` symbols per word of the question that is their name or the last part of their name."""
    wanted = [t for t in terms if len(t) >= 3]
    last = F.lower(F.substring_index("qname", ".", -1))
    hit = symbols.select("qname", F.explode(F.array_distinct(F.array(F.lower("name"), last))).alias("term")).where(F.col("term").isin(*wanted))
    w = Window.partitionBy("term").orderBy("qname")
    return hit.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_term).select("qname").distinct()


def expand(seeds: DataFrame, edges: DataFrame, symbols: DataFrame, mode: str, depth: int) -> DataFrame:
    """``qname, graph, distance`` of what the graph reaches from ``seeds`` (``qname, norm``) in at most two hops.

    One hop gives the seed's normalised score times decay times the edge's confidence; a second hop gives decay times
    confidence, since a symbol found on the way has no score of its own yet. The greatest contribution counts. The
    symbols of a level go to the edges first; only the names of the edges that are left are resolved.
    """
    out, into = MODE_EDGES[mode]

    def onward(of: DataFrame, gain: Column) -> DataFrame:
        from_here = edges.where(F.col("edge_type").isin(*out)).join(of.withColumnRenamed("qname", "src"), "src")
        forward = resolved_targets(from_here, symbols).select(F.col("target").alias("qname"), (gain * F.col("confidence")).alias("graph"))
        to_here = edges.where(F.col("edge_type").isin(*into)).join(of.withColumnRenamed("qname", "dst"), "dst")
        backward = to_here.select(F.col("src").alias("qname"), (gain * F.col("confidence")).alias("graph"))
        return forward.unionByName(backward).where("qname is not null").groupBy("qname").agg(F.max("graph").alias("graph"))

    start = seeds.select("qname", "norm")
    one = onward(start, F.col("norm") * DECAY)
    levels = [start.select("qname", F.lit(0.0).alias("graph"), F.lit(0).alias("distance")), one.withColumn("distance", F.lit(1))]
    if depth > 1:
        one = cut_lineage(one)
        levels[1] = one.withColumn("distance", F.lit(1))
        fresh = one.join(start.select("qname"), "qname", "left_anti").select("qname")
        levels.append(onward(fresh, F.lit(DECAY)).withColumn("distance", F.lit(2)))
    reached = reduce(DataFrame.unionByName, levels)
    return reached.groupBy("qname").agg(F.least(F.max("graph"), F.lit(1.0)).alias("graph"), F.min("distance").alias("distance"))


def name_tokens(qname: Column | str) -> Column:
    """Lower-case pieces of a qualified name with at least two characters."""
    pieces = F.regexp_extract_all(qname, F.lit("([A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+)"), F.lit(1))
    return F.filter(F.transform(pieces, F.lower), lambda t: F.length(t) > 1)


def overlap(terms: list[str]) -> Column:
    """Share of the question's words in the qualified name: three make it whole."""
    asked = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    return F.least(F.lit(1.0), F.size(F.array_intersect(F.array_distinct(name_tokens("qname")), asked)) / 3.0)


def rerank(candidates: DataFrame, terms: list[str], mode: str) -> DataFrame:
    """Add ``final``: the weighted blend of the channels of ``qname, name, kind, path, bm25, vector, graph, distance, sources``,
    with what pinned seeds gain."""
    w = WEIGHTS[mode]
    c = F.col
    asked = F.array(*[F.lit(t) for t in terms]) if terms else F.array().cast("array<string>")
    shared = overlap(terms)
    test = (c("kind") == "test") | c("name").startswith("test") | F.lower(F.coalesce("path", F.lit(""))).contains("test")
    editing, explaining = mode in ("edit", "feature", "refactor", "debug"), mode in ("explain", "onboarding")
    secret = reduce(lambda a, b: a | b, [F.lower("qname").contains(k) for k in ("auth", "login", "session", "token", "secret")])
    if editing:
        fit = F.when(c("kind").isin("function", "method", "component", "route"), 1.0).when(c("kind") == "class", 0.5).when(c("kind") == "file_summary", 0.15).otherwise(0.0)
    elif mode == "impact":
        fit = F.when(c("kind").isin("function", "method", "class", "route"), 1.0).otherwise(0.0)
    elif mode == "security":
        fit = F.when(secret | F.lower("qname").contains("permission"), 0.6).otherwise(0.0)
    elif explaining:
        fit = F.when(c("kind").isin("class", "module", "route"), 0.6).when(c("kind") == "file_summary", 0.2).otherwise(0.0)
    else:
        fit = F.lit(0.0)
    near = F.when(test, 1.0 if mode == "test" else 0.4 if editing else -0.3 if explaining or mode == "impact" else 0.0).otherwise(0.0)
    intent = {
        "test": F.when(test, 1.0), "impact": F.when(c("kind").isin("function", "method", "class", "route"), 0.5), "security": F.when(secret, 0.6),
        "edit": F.when(c("kind").isin("function", "method", "component", "route"), 0.4), "feature": F.when(c("kind").isin("function", "method", "component", "route"), 0.4),
    }.get(mode)
    intent = F.coalesce(intent, F.lit(0.0)) if intent is not None else F.lit(0.0)
    low = F.lower("name")
    generic = F.when(
        (low.isin(*GENERIC) & ~F.array_contains(asked, low)) | (low.isin(*TEST_INFRA) & F.lit("test" not in terms)), 0.20
    ).otherwise(0.0)
    blend = w[0] * c("bm25") + w[1] * c("vector") + w[2] * c("graph") + w[3] * shared + w[4] * fit + w[5] * near + w[6] * intent - w[7] * generic
    blend = blend + F.when((c("bm25") > 0) & (c("vector") > 0), 0.05).otherwise(0.0)
    blend = blend + F.when((c("distance") == 0) & F.array_contains("sources", "identifier"), 0.05).otherwise(0.0)
    pinned = F.array_contains("sources", "pinned")
    blend = blend + F.when((c("distance") == 0) & pinned, 0.10).otherwise(0.0)
    # a summary of a file weighs little unless the file was asked for
    return candidates.withColumn("final", F.when((c("kind") == "file_summary") & ~pinned, blend * 0.45).otherwise(blend))


def estimate_tokens(text: Column | str) -> Column:
    n = F.length(F.col(text) if isinstance(text, str) else text)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4)))


STEP = 1000
"""Candidates that a pack looks at at a time."""


def pack(ranked: DataFrame, mode: str, budget: int) -> DataFrame:
    """The candidates that a pack takes in rank order: ``qname, rank, tokens``.

    ``ranked`` has ``qname, path, final, tokens, seeded`` and may have ``pinned``. A candidate is passed over if its file
    (unless pinned) or the pack is full, if too many came by the graph alone, or if it does not fit in what is left; one
    passed over for its size uses up its graph place. The best ``STEP`` candidates are looked at, then the next ones, until
    the pack is full or there are no more, so the driver holds ``STEP`` names however many the graph reached.
    """
    per_file, graph_hits, capsules, _, share = CAPS[mode]
    room = max(800, int(budget * share))
    taken: list[tuple[str, int, int]] = []
    of_file: dict[str | None, int] = {}
    spent = graph = at = 0
    pinned = F.col("pinned") if "pinned" in ranked.columns else F.lit(False)
    ordered = ranked.select("qname", "path", "tokens", "seeded", pinned.alias("pinned"), "final").orderBy(F.desc(F.round("final", 9)), "qname")
    while len(taken) < capsules:
        rows = ordered.offset(at).limit(STEP).collect()
        for r in rows:
            at += 1
            if len(taken) >= capsules or (not r["pinned"] and of_file.get(r["path"], 0) >= per_file) or (not r["seeded"] and graph >= graph_hits):
                continue
            graph += not r["seeded"]
            if spent + r["tokens"] <= room:
                taken.append((r["qname"], at, r["tokens"]))
                spent += r["tokens"]
                of_file[r["path"]] = of_file.get(r["path"], 0) + 1
        if len(rows) < STEP:
            break
    return ranked.sparkSession.createDataFrame(taken, "qname string, rank int, tokens int")
