"""Scores of retrieval against golden tasks, and gates on them."""

from __future__ import annotations

import platform
import re
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.lookups import file_matches, symbol_matches

# Metric, threshold, whether it is hard, by profile ``release``.
RELEASE = [
    ("edit_file_recall_at_5", 0.80, True), ("test_recall_at_5", 0.80, True), ("latency_ms", 700.0, True), ("symbol_recall_at_8", 0.70, False),
    ("file_recall_at_8", 0.90, False), ("symbol_recall_at_12", 0.70, False), ("irrelevant_ratio", 0.35, False), ("risk_recall", 0.60, False),
]
LOWER_IS_BETTER = ("latency_ms", "irrelevant_ratio")
TASK = "id string, task string, mode string, budget int, oracle_files array<string>, oracle_symbols array<string>"


def parse_tasks(text: str) -> list[dict]:
    """Golden tasks from a list of mappings with scalars and lists, one ``- id:`` per task."""
    tasks: list[dict] = []
    key = None
    for raw in text.splitlines():
        line = re.sub(r"\s+#.*$", "", raw).rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = re.match(r"^\s*(-\s+)?([A-Za-z_]\w*)\s*:\s*(.*)$", line)
        if m:
            if m.group(1):
                tasks.append({})
            key, value = m.group(2), m.group(3).strip()
            if value.startswith("["):
                value = [x.strip().strip("'\"") for x in value.strip("[]").split(",") if x.strip()]
            elif value:
                value = value.strip("'\"")
                value = int(value) if re.fullmatch(r"-?\d+", value) else value
            tasks[-1][key] = value if value != "" else []
        elif key and (item := re.match(r"^\s*-\s+(.*)$", line)):
            tasks[-1].setdefault(key, [])
            tasks[-1][key].append(item.group(1).strip().strip("'\""))
    return tasks


def tasks_frame(spark: SparkSession, tasks: list[dict]) -> DataFrame:
    rows = [(str(t.get("id")), t.get("task"), t.get("mode"), t.get("budget"), t.get("oracle_files") or [], t.get("oracle_symbols") or []) for t in tasks]
    return spark.createDataFrame(rows, TASK)


EDIT_TASK = (
    "id string, task string, mode string, budget int, oracle_files array<string>, read_files array<string>, oracle_tests array<string>, "
    "oracle_symbols array<string>, validation array<string>, risk_keywords array<string>"
)
EDIT_FIELDS = ("oracle_files_likely_to_edit", "oracle_files_read_only", "oracle_tests", "oracle_symbols_to_modify", "expected_validation_types", "risk_keywords")


def edit_tasks(spark: SparkSession, tasks: list[dict]) -> DataFrame:
    """Tasks with an edit oracle; the others are left out."""
    kept = [t for t in tasks if t.get("oracle_files_likely_to_edit")]
    return spark.createDataFrame([(str(t.get("id")), t.get("task"), t.get("mode"), t.get("budget"), *(t.get(f) or [] for f in EDIT_FIELDS)) for t in kept], EDIT_TASK)


FIXTURE = (
    "id string, language string, source_files map<string,string>, expected_symbols array<string>, expected_imports array<string>, expected_calls array<string>, "
    "expected_routes array<string>, expected_tests array<string>, expected_types array<string>, expected_process_traces array<string>"
)


def extraction_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """What extraction should find, from JSON files with one fixture or a list of them; missing lists are empty."""
    raw = spark.read.schema(FIXTURE).option("multiLine", True).json(path)
    lists = [f.name for f in raw.schema.fields if f.name.startswith("expected_")]
    return raw.where("id is not null").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in lists})


def fixture_files(fixtures: DataFrame) -> DataFrame:
    """The sources of fixtures as rows of files: ``id, path, language, content``."""
    return fixtures.select("id", "language", F.explode("source_files").alias("path", "content"))


def recall_at(retrieved: DataFrame, tasks: DataFrame, ks: tuple[int, ...], kind: str) -> DataFrame:
    """``id, k, recall``: share of a task's oracle that stands among its first ``k`` results; 1 for an empty oracle.

    ``retrieved`` has ``id, rank, item``; ``kind`` is ``files`` or ``symbols``. Results and oracle meet per task.
    """
    match = file_matches if kind == "files" else lambda item, oracle: symbol_matches(oracle, item)
    asked = tasks.select("id", F.explode_outer(f"oracle_{kind}").alias("oracle")).select("id", "oracle", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    first = asked.where("oracle is not null").select("id", "oracle").distinct().join(retrieved, "id").where(match(F.col("item"), F.col("oracle")))
    best = first.groupBy("id", "oracle").agg(F.min("rank").alias("best"))
    scored = asked.join(best, ["id", "oracle"], "left")
    hit = F.when(F.col("oracle").isNull(), 1.0).when(F.col("best") <= F.col("k"), 1.0).otherwise(0.0)
    return scored.groupBy("id", "k").agg(F.round(F.avg(hit), 6).alias("recall"))


def precision_at(retrieved: DataFrame, tasks: DataFrame, k: int) -> DataFrame:
    top = retrieved.where(F.col("rank") <= k)
    oracle = tasks.select("id", F.explode("oracle_files").alias("oracle"))
    hits = top.join(oracle, "id").where(file_matches(F.col("item"), F.col("oracle"))).select("id", "rank").distinct().groupBy("id").agg(F.count("*").alias("hits"))
    return top.groupBy("id").agg(F.count("*").alias("n")).join(hits, "id", "left").select("id", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("precision"))


def missed(retrieved: DataFrame, tasks: DataFrame) -> DataFrame:
    """``id, oracle, rank`` of oracle symbols; a null rank was not retrieved at all."""
    oracle = tasks.select("id", F.explode("oracle_symbols").alias("oracle"))
    hits = oracle.join(retrieved, "id").where(symbol_matches(F.col("oracle"), F.col("item"))).groupBy("id", "oracle").agg(F.min("rank").alias("rank"))
    return oracle.join(hits, ["id", "oracle"], "left")


def summary(values: DataFrame, by: str, value: str) -> DataFrame:
    """Mean, median and the index-rule p95 per ``by``; meant for per-task figures, of which there are few per group."""
    ordered = values.where(F.col(value).isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(value)).alias("v"))
    place = F.greatest(F.lit(1), F.floor(F.size("v") * 0.95).cast("int"))
    half = F.size("v")
    middle = (F.element_at("v", ((half + 1) / 2).cast("int")) + F.element_at("v", (half / 2).cast("int") + 1)) / 2
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v")
    return ordered.select(by, F.round(mean, 6).alias("mean"), F.round(middle, 6).alias("median"), F.element_at("v", place).alias("p95"))


def irrelevant_ratio(packed: DataFrame, tasks: DataFrame) -> DataFrame:
    """``id, irrelevant``: the share of a pack's tokens (``id, item, path, tokens``) that no oracle file or symbol accounts
    for; 0 for an empty pack."""
    files = tasks.select("id", F.explode("oracle_files").alias("oracle"))
    symbols = tasks.select("id", F.explode("oracle_symbols").alias("oracle"))
    keyed = packed.withColumn("_row", F.monotonically_increasing_id())
    by_file = keyed.join(files, "id").where(file_matches(F.col("path"), F.col("oracle"))).select("_row")
    by_name = keyed.join(symbols, "id").where(symbol_matches(F.col("oracle"), F.col("item"))).select("_row")
    good = by_file.unionByName(by_name).distinct().withColumn("good", F.lit(True))
    scored = keyed.join(good, "_row", "left").groupBy("id").agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("good"), F.col("tokens")).otherwise(0)).alias("held"))
    ratio = F.when(F.coalesce("all", F.lit(0)) == 0, 0.0).otherwise(F.round(1 - F.col("held") / F.col("all"), 6))
    return tasks.select("id").join(scored, "id", "left").select("id", ratio.alias("irrelevant"))


def source_counts(items: DataFrame) -> DataFrame:
    """``source, n``: in how many items (``sources`` array) each source shows, the most frequent first."""
    return items.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source")


def noise(packed: DataFrame, tasks: DataFrame) -> DataFrame:
    """Packed items that no oracle of their task accounts for."""
    files = tasks.select("id", F.explode("oracle_files").alias("oracle"))
    symbols = tasks.select("id", F.explode("oracle_symbols").alias("oracle"))
    keyed = packed.withColumn("_row", F.monotonically_increasing_id())
    good = keyed.join(files, "id").where(file_matches(F.col("path"), F.col("oracle"))).select("_row").unionByName(keyed.join(symbols, "id").where(symbol_matches(F.col("oracle"), F.col("item"))).select("_row"))
    return keyed.join(good.distinct(), "_row", "left_anti").drop("_row")


def tuning(found: DataFrame, noisy: DataFrame, tasks: DataFrame) -> DataFrame:
    """``id, action, subject``: what to try for the tasks that went wrong.

    ``found`` has ``id, oracle, rank, included, bm25, vector`` of each oracle symbol (a null rank was never reached),
    ``noisy`` the items that were not asked for (``id, path``). Actions: ``add_alias``, ``strengthen_names``,
    ``raise_capsules``, ``tighten_file_cap`` (three noise items of a file) and ``drop_tests``.
    """
    missed = found.where("rank is null or not included").select(
        "id", F.when(F.col("rank").isNull(), "add_alias").when((F.coalesce("bm25", F.lit(0.0)) == 0) & (F.coalesce("vector", F.lit(0.0)) == 0), "strengthen_names").otherwise("raise_capsules").alias("action"),
        F.col("oracle").alias("subject"),
    )
    crowded = noisy.where("path is not null").groupBy("id", "path").agg(F.count("*").alias("n")).where("n >= 3").select("id", F.lit("tighten_file_cap").alias("action"), F.col("path").alias("subject"))
    tests = noisy.where(F.lower("path").contains("test")).select("id").distinct().join(tasks.where("mode is null or mode not in ('test', 'test_generation')").select("id", "mode"), "id")
    return missed.unionByName(crowded).unionByName(tests.select("id", F.lit("drop_tests").alias("action"), F.col("mode").alias("subject")))


def slowest(timings: DataFrame) -> DataFrame:
    """``what, name, ms``: the stage that takes longest by its median, and the task that takes longest in all (``id, stage,
    ms``); the first name of equals."""
    stages = summary(timings, "stage", "ms").select(F.lit("stage").alias("what"), F.col("stage").alias("name"), F.col("median").alias("ms"))
    tasks = timings.groupBy("id").agg(F.round(F.sum("ms"), 6).alias("ms")).select(F.lit("task").alias("what"), F.col("id").alias("name"), "ms")
    both = stages.unionByName(tasks)
    return both.groupBy("what").agg(F.min_by(F.struct("name", "ms"), F.struct((-F.col("ms")).alias("m"), "name")).alias("b")).select("what", "b.name", "b.ms")


def run_tasks(tasks: DataFrame, retrieve: Callable[[str, str | None], DataFrame], limit: int = 20) -> DataFrame:
    """``id, rank, item, path, kind, final``: the first ``limit`` candidates of ``retrieve(task, mode)`` for each task.

    Golden tasks are a few dozen questions that people wrote, each its own retrieval, so the driver asks them in turn.
    """
    found = None
    for t in tasks.select("id", "task", "mode").orderBy("id").collect():
        rows = retrieve(t["task"], t["mode"]).where(F.col("rank") <= limit).select(F.lit(t["id"]).alias("id"), "rank", F.col("qname").alias("item"), "path", "kind", "final")
        found = rows if found is None else found.unionByName(rows)
    return found


def file_ranks(found: DataFrame) -> DataFrame:
    """Files of ranked items in order of their first item: ``id, rank, item``."""
    first = found.where("path is not null").groupBy("id", "path").agg(F.min("rank").alias("first"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("first", "path"))
    return first.select("id", place.alias("rank"), F.col("path").alias("item"))


def report(found: DataFrame, tasks: DataFrame) -> DataFrame:
    """``metric, value``: mean recall of files and symbols at the usual depths over all tasks."""
    of_files = recall_at(file_ranks(found), tasks, (1, 3, 5, 8, 12), "files").select(F.format_string("file_recall_at_%d", "k").alias("metric"), "recall")
    of_symbols = recall_at(found, tasks, (3, 5, 8, 12, 20), "symbols").select(F.format_string("symbol_recall_at_%d", "k").alias("metric"), "recall")
    return of_files.unionByName(of_symbols).groupBy("metric").agg(F.round(F.avg("recall"), 6).alias("value"))


def edit_metrics(plans: DataFrame, tasks: DataFrame) -> DataFrame:
    """``id, edit_file_recall_at_5, edit_file_precision_at_5, test_recall_at_5, risk_recall`` of edit plans.

    ``plans`` has ``id, role, place, item``: planned files by role (``edit``, ``test``) and the words of risks (``risk``).
    """
    edits = plans.where("role = 'edit'").select("id", F.col("place").alias("rank"), "item")
    tests = plans.where("role = 'test'").select("id", F.col("place").alias("rank"), "item")
    of_tests = tasks.select("id", F.col("oracle_tests").alias("oracle_files"))
    recall = recall_at(edits, tasks, (5,), "files").select("id", F.col("recall").alias("edit_file_recall_at_5"))
    of_test = recall_at(tests, of_tests, (5,), "files").select("id", F.col("recall").alias("test_recall_at_5"))
    precision = precision_at(edits, tasks, 5).select("id", F.col("precision").alias("edit_file_precision_at_5"))
    said = plans.where("role = 'risk'").groupBy("id").agg(F.concat_ws(" ", F.collect_list(F.lower("item"))).alias("said"))
    hit = F.size(F.filter("risk_keywords", lambda w: F.contains(F.coalesce("said", F.lit("")), F.lower(w))))
    risk = tasks.join(said, "id", "left").select("id", F.when(F.size("risk_keywords") == 0, 1.0).otherwise(F.round(hit / F.size("risk_keywords"), 6)).alias("risk_recall"))
    return tasks.select("id").join(recall, "id", "left").join(precision, "id", "left").join(of_test, "id", "left").join(risk, "id", "left").fillna(0.0)


def aggregate(metrics: DataFrame) -> DataFrame:
    """``metric, mean, median`` of the numeric columns of per-task metrics."""
    names = [c for c in metrics.columns if c != "id"]
    rows = metrics.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))
    return summary(rows, "metric", "value").select("metric", "mean", "median")


def dataset_state(tasks: DataFrame) -> DataFrame:
    """One row: tasks and how much their oracles hold."""
    return tasks.agg(F.count("*").alias("n_tasks"), F.sum(F.size("oracle_files")).alias("n_files"), F.sum(F.size("oracle_symbols")).alias("n_symbols"))


def primary_report(reports: dict[str, dict], modes: list[str]) -> dict | None:
    """The report that counts: that of hybrid retrieval, else of the last mode there is one for."""
    return reports.get("hybrid") or next((reports[m] for m in reversed(modes) if m in reports), None)


def environment(root: str = ".") -> dict[str, str]:
    """Versions that a run depends on, and the commit of the repository, if it is one."""
    head = Path(root, ".git", "HEAD")
    commit = ""
    if head.exists():
        told = head.read_text().strip()
        ref = Path(root, ".git", told.removeprefix("ref: "))
        commit = ref.read_text().strip() if told.startswith("ref: ") and ref.exists() else "" if told.startswith("ref: ") else told
    return {"python": platform.python_version(), "spark": pyspark.__version__, "platform": platform.platform(), "commit": commit, "at": datetime.now(UTC).isoformat(timespec="seconds")}


# Thresholds of the profiles: the least recall of edited files, tests and symbols, the greatest latency.
PROFILES = {
    "advisory": (0.0, 0.0, 0.0, float("inf")), "dev": (0.60, 0.60, 0.50, 5000.0), "release": (0.80, 0.80, 0.70, 700.0),
}


def profile(name: str) -> list[tuple[str, float, bool]]:
    """The gates of a profile (``release`` for unknown names): hard ones unless it only advises, then the warnings."""
    edits, tests, symbols, latency = PROFILES.get(name, PROFILES["release"])
    hard = name != "advisory"
    own = [("edit_file_recall_at_5", edits, hard), ("test_recall_at_5", tests, hard), ("latency_ms", latency, hard), ("symbol_recall_at_8", symbols, False)]
    return own + [g for g in RELEASE if g[0] not in {m for m, *_ in own}]


def gates(metrics: DataFrame, profile: list[tuple[str, float, bool]] = RELEASE) -> DataFrame:
    """``metric, value, threshold, level, passed`` of ``metrics`` (``metric, value``); a missing metric fails."""
    spark = metrics.sparkSession
    limits = spark.createDataFrame([(m, t, "hard" if hard else "warning") for m, t, hard in profile], "metric string, threshold double, level string")
    ok = F.when(F.col("metric").isin(*LOWER_IS_BETTER), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return limits.join(metrics, "metric", "left").select("metric", "value", "threshold", "level", F.coalesce(ok, F.lit(False)).alias("passed"))
