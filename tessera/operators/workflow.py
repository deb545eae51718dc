"""Edit planning: impact and risk of a change, related tests, commands that validate it."""

from __future__ import annotations

import re

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import context, processes

SENSITIVE = "(auth|login|session|token|secret|password|permission|payment|billing|crypt)"
# Words that make no keyword of a task, and words that name no risk in it.
STOP = (
    "the", "and", "for", "with", "from", "into", "that", "this", "make", "take", "feature", "implement", "refactor", "debug", "test", "tests", "fix", "add",
    "modify", "change", "update", "improve", "build", "create", "file", "files", "code", "logic",
)
NO_RISK = (
    "add", "new", "the", "and", "for", "with", "from", "into", "that", "this", "change", "update", "modify", "fix", "make", "more", "less", "include",
    "returns", "return", "code", "file", "files", "logic",
)
SECRETS = ("ignore", "scanner", "secret", "credential")


def risk_level(sensitive: Column, callers: Column, routes: Column, has_tests: Column) -> Column:
    return (
        F.when(sensitive | ((routes >= 1) & (callers >= 5)), "high")
        .when((routes >= 1) | (callers >= 8), "medium")
        .when((callers >= 3) & ~has_tests, "medium")
        .otherwise("low")
    )


def patch_impact(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Per symbol: callers, routes and tests that point at it and the risk of changing it. Edges are summed first."""
    t = F.col("edge_type")
    into = edges.where("dst is not null and src is not null").groupBy(F.col("dst").alias("qname")).agg(
        F.count_distinct(F.when(t == "CALLS", F.col("src"))).alias("n_callers"),
        F.count_distinct(F.when(t.isin("ROUTES_TO", "HANDLES_ROUTE", "ROUTE_HANDLED_BY"), F.col("src"))).alias("n_routes"),
        F.count_distinct(F.when(t.isin("TESTS", "TESTS_SYMBOL"), F.col("src"))).alias("n_tests"),
    )
    at = symbols.where(F.col("kind").isin("function", "method", "class")).select("qname").join(into, "qname", "left").fillna(0)
    level = risk_level(F.lower("qname").rlike(SENSITIVE), F.col("n_callers"), F.col("n_routes"), F.col("n_tests") > 0)
    return at.withColumn("risk", level)


def task_keyword(task: str) -> str | None:
    """The longest word of a task, of four letters at least, that is no stop word; the first of equally long ones."""
    words = [w for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]{3,}", task) if w.lower() not in STOP]
    return max(words, key=len, default=None)


def risk_keywords(task: str, limit: int = 5) -> list[str]:
    """The first words of a task that may name a risk; secrets come first where the task is about what must not be read."""
    words = [w.lower() for w in re.findall(r"[A-Za-z][A-Za-z0-9_+-]{2,}", task)]
    kept = list(dict.fromkeys(n for w in words if (n := w.strip("`'\"").replace("_", "-")) not in NO_RISK))[:limit]
    return ["secret", *kept] if "secret" not in kept and any(w in words for w in SECRETS) else kept


def keyword_of(task: Column | str) -> Column:
    """``task_keyword`` as a column."""
    words = F.filter(F.regexp_extract_all(task, F.lit("([A-Za-z_][A-Za-z0-9_]{3,})"), F.lit(1)), lambda w: ~F.lower(w).isin(*STOP))
    return F.aggregate(words, F.lit(None).cast("string"), lambda best, w: F.when(best.isNull() | (F.length(w) > F.length(best)), w).otherwise(best))


def risk_words_of(task: Column | str, limit: int = 5) -> Column:
    """``risk_keywords`` as a column."""
    words = F.transform(F.regexp_extract_all(task, F.lit("([A-Za-z][A-Za-z0-9_+-]{2,})"), F.lit(1)), F.lower)
    kept = F.slice(F.array_distinct(F.filter(F.transform(words, lambda w: F.replace(w, F.lit("_"), F.lit("-"))), lambda w: ~w.isin(*NO_RISK))), 1, limit)
    secret = F.arrays_overlap(words, F.array(*map(F.lit, SECRETS))) & ~F.array_contains(kept, "secret")
    return F.when(secret, F.concat(F.array(F.lit("secret")), kept)).otherwise(kept)


def is_test_path(path: Column | str) -> Column:
    return F.lower(F.col(path) if isinstance(path, str) else path).rlike(r"(^|/)(tests?|__tests__|spec)/|(^|/)test_|_test\.|\.(test|spec)\.")


def tests_by_mention(files: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, path, confidence`` for test files whose content names a target (.78) or its file's stem (.60).

    Words of test files meet the targets by equality; the greatest confidence per pair stays. ``targets`` has ``target``
    (a qualified name) and ``stem``.
    """
    words = files.where(is_test_path("path")).select("path", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("content", F.lit("")), F.lit("([A-Za-z_][A-Za-z0-9_]+)"), F.lit(1)))).alias("word"))
    by_name = targets.select("target", F.substring_index("target", ".", -1).alias("word"), F.lit(0.78).alias("confidence"))
    by_stem = targets.select("target", F.col("stem").alias("word"), F.lit(0.60).alias("confidence"))
    hits = words.join(by_name.unionByName(by_stem), "word")
    return hits.groupBy("target", "path").agg(F.max("confidence").alias("confidence"))


# Commands by the manifest that calls for them, with their confidence.
COMMANDS = [
    (r"(^|/)package\.json$", "npm test", 0.8), (r"(^|/)pyproject\.toml$", "python -m pytest -q", 0.85), (r"(^|/)go\.mod$", "go test ./...", 0.85),
    (r"(^|/)Cargo\.toml$", "cargo test", 0.85), (r"(^|/)pom\.xml$", "mvn test", 0.8), (r"(^|/)Makefile$", "make test", 0.6),
]
# Commands by language where no manifest is stored.
LANGUAGE_COMMANDS = {"python": ("python -m pytest -q", 0.6), "typescript": ("npx tsc --noEmit", 0.5), "javascript": ("npm test", 0.5), "go": ("go test ./...", 0.6), "rust": ("cargo test", 0.6), "java": ("mvn test", 0.5), "csharp": ("dotnet test", 0.5), "kotlin": ("gradle test", 0.5)}


def validation_commands(files: DataFrame) -> DataFrame:
    """``repo, command, confidence``: commands that the repository's manifests, else its languages, call for."""
    repo = F.substring_index("path", "/", 1)
    manifest = F.array_compact(F.array(*[F.when(F.col("path").rlike(p), F.struct(F.lit(c).alias("command"), F.lit(x).alias("confidence"))) for p, c, x in COMMANDS]))
    tongue = F.array_compact(F.array(*[F.when(F.col("language") == k, F.struct(F.lit(c).alias("command"), F.lit(x).alias("confidence"))) for k, (c, x) in LANGUAGE_COMMANDS.items()]))
    rows = files.select(repo.alias("repo"), F.explode(F.concat(manifest, tongue)).alias("c"))
    return rows.groupBy("repo", "c.command").agg(F.max("c.confidence").alias("confidence"))


def symbols_to_modify(ranked: DataFrame, symbols: DataFrame, limit: int = 8) -> DataFrame:
    """``qname, kind, place``: the best functions, methods and classes of the candidates; tests are none."""
    code = ranked.where(F.col("kind").isin("function", "method", "class", "component", "route") & ~context.looks_like_test())
    best = code.orderBy(F.desc(F.round("final", 9)), "qname").limit(limit)
    return best.select("qname", "kind", F.row_number().over(Window.orderBy(F.desc(F.round("final", 9)), "qname")).alias("place"))  # at most ``limit`` rows


def neighbours_of(chosen: DataFrame, edges: DataFrame, symbols: DataFrame, first: int = 5, limit: int = 8) -> DataFrame:
    """``direction, qname, of, confidence``: who calls the first symbols to modify and whom they call, each neighbour once
    for the first symbol it stands beside (as a caller, if it is both), ``limit`` in each direction."""
    top = chosen.where(F.col("place") <= first).select(F.col("qname").alias("of"), "place")
    into = edges.where(F.col("edge_type").isin("CALLS", "ROUTES_TO")).join(top.withColumnRenamed("of", "dst"), "dst").select(
        F.lit("caller").alias("direction"), F.col("src").alias("qname"), F.col("dst").alias("of"), "place", "edge_id", F.lit(0.8).alias("confidence")
    )
    out = processes.resolved_targets(edges.where("edge_type = 'CALLS'").join(top.select(F.col("of").alias("src")), "src", "left_semi"), symbols)
    out = out.join(top.withColumnRenamed("of", "src"), "src").select(
        F.lit("callee").alias("direction"), F.col("target").alias("qname"), F.col("src").alias("of"), "place", "edge_id", F.lit(0.7).alias("confidence")
    )
    known = into.unionByName(out).where("qname is not null").join(symbols.select("qname"), "qname", "left_semi")
    order = F.struct("place", F.when(F.col("direction") == "caller", 0).otherwise(1).alias("d"), "edge_id")
    once = known.groupBy("qname").agg(F.min_by(F.struct("direction", "of", "confidence"), order).alias("b"), F.min(order).alias("o"))
    rank = F.row_number().over(Window.partitionBy("b.direction").orderBy("o"))
    return once.withColumn("r", rank).where(F.col("r") <= limit).select("b.direction", "qname", "b.of", "b.confidence")


def traces_of(chosen: DataFrame, built: DataFrame, per_symbol: int = 3, limit: int = 5) -> DataFrame:
    """The most certain processes that touch symbols to modify, each once: at most ``per_symbol`` of a symbol."""
    rows = built.withColumn("qname", F.explode(F.array_distinct(F.split("path", " > ")))).join(chosen.select("qname"), "qname", "left_semi")
    place = F.row_number().over(Window.partitionBy("qname").orderBy(F.desc("confidence"), "process_id"))
    best = rows.withColumn("r", place).where(F.col("r") <= per_symbol).drop("r", "qname").dropDuplicates(["process_id"])
    return best.orderBy(F.desc("confidence"), "process_id").limit(limit)


def path_priority(path: Column | str) -> Column:
    """Order of test files: files of tests first, fixtures last, then by path."""
    c = F.col(path) if isinstance(path, str) else path
    name = F.lower(F.element_at(F.split(c, "/"), -1))
    test = name.startswith("test_") | name.rlike(r"(_test\.py|\.test\.tsx?|\.test\.js|\.spec\.[tj]s)$")
    fixture = F.concat(F.lit("/"), F.lower(c), F.lit("/")).contains("/fixtures/")
    return F.struct(F.when(test, 0).otherwise(1).alias("t"), F.when(fixture, 1).otherwise(0).alias("f"), c.alias("p"))


def tests_of_task(files: DataFrame, task: str, limit: int = 5) -> DataFrame:
    """``path, confidence``: files of tests that mention the task's keyword (.65), else the first test files (.35)."""
    low = F.lower("path")
    tests = files.where(low.contains("test") | low.contains("spec"))
    keyword = (task_keyword(task) or "").lower()
    hit = F.lower(F.coalesce("content", F.lit(""))).contains(keyword) if keyword else F.lit(False)
    found = tests.select("path", F.when(hit, 0.65).otherwise(0.35).alias("confidence"), path_priority("path").alias("order"))
    best = found.agg(F.max("confidence").alias("best"))
    kept = found.join(F.broadcast(best), F.col("confidence") == F.col("best"))
    return kept.orderBy("order").limit(limit).select("path", "confidence")


def risks(chosen: DataFrame, plan: DataFrame, edges: DataFrame, task: str) -> DataFrame:
    """``risk, level, affected``: what a task endangers: what it is about, sensitive names, symbols that many depend on,
    routes that reach them, and edits without tests beside them."""
    words = risk_keywords(task)
    top = chosen.where("place <= 5").select(F.col("qname").alias("dst"))
    into = edges.where(F.col("edge_type").isin("CALLS", "ROUTES_TO", "ROUTE_HANDLED_BY")).join(top, "dst")
    many = into.groupBy("dst").agg(F.count("*").alias("n")).where("n >= 5").select(F.format_string("%s (callers=%d)", "dst", "n").alias("a"))
    routes = into.where("edge_type != 'CALLS'").select(F.col("src").alias("a")).distinct()
    sensitive = chosen.where(F.lower("qname").rlike(r"\b(auth|login|session|token|secret|jwt|credential|password|permission)\b")).select(F.col("qname").alias("a"))
    edited = plan.where("role = 'edit'").select(F.col("path").alias("a"))

    def item(name: str, level: str, rows: DataFrame, when: DataFrame | None = None) -> DataFrame:
        # at most a handful of names each: symbols to modify and files of a plan are few
        listed = rows.agg(F.slice(F.array_sort(F.collect_set("a")), 1, 5).alias("affected"), F.count("*").alias("n"))
        kept = listed.where("n > 0") if when is None else listed.crossJoin(when)
        return kept.select(F.lit(name).alias("risk"), F.lit(level).alias("level"), "affected")

    untested = plan.agg(F.count_if(F.col("role") == "test").alias("tests"), F.count("*").alias("files")).where("tests = 0 and files > 0").select(F.lit(1).alias("one"))
    parts = [item("code_path", "high", sensitive), item("fan_out", "medium", many), item("route_exposure", "medium", routes), item("no_tests", "medium", edited, untested)]
    if words:
        parts.insert(0, item("task", "medium", edited))
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


class Stages:
    """Times the stages of a driver's program; ``frame`` gives ``stage, ms``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.took: list[tuple[str, float]] = []

    def __call__(self, stage: str, run: Callable):
        began = time.perf_counter()
        result = run()
        self.took.append((stage, (time.perf_counter() - began) * 1000))
        return result

    def frame(self) -> DataFrame:
        return self.spark.createDataFrame(self.took, "stage string, ms double")
