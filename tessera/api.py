"""One object over a stored index, with the questions that people ask of it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import context, graph, lookups, processes, retrieval, roles, vectors, views, workflow
from tessera.operators.postings import StoredIndex
from tessera.plans import search, stats
from tessera.session import cut_lineage
from tessera.sources import graph as stored
from tessera.sources import parsers, repository, sinks

SYMBOL_COLUMNS = ("start_line", "end_line", "signature", "docstring", "extras", "return_type", "declared_type", "parser_backend", "metadata_json")


class IndexedGraph:
    """The tables of ``folder`` as a code graph. Every method gives a DataFrame unless it says otherwise."""

    def __init__(self, spark: SparkSession, folder: str, embedder: vectors.Embedder | None = None):
        self.spark, self.folder = spark, folder
        self.embedder = embedder or vectors.build_embedder()
        self.files = stored.files(spark, folder)
        self.symbols = stored.symbols(spark, folder, *SYMBOL_COLUMNS)
        self.edges = stored.edges(spark, folder, "confidence", "precision_level", "line", "metadata_json", "reason")
        self.imports = stored.imports(spark, folder)

    @staticmethod
    def index(spark: SparkSession, repo: str, languages: list[str] | None = None) -> DataFrame:
        """Parse a repository on disk into rows of symbols, edges, imports and parameters."""
        return parsers.parse_files(repository.scan_repository(spark, repo, languages=languages))

    def stats(self) -> DataFrame:
        return stats.doctor(self.spark, self.folder)

    def languages(self) -> DataFrame:
        return stats.file_languages(self.spark, self.folder)

    def find_symbol(self, name: str, limit: int = 25) -> DataFrame:
        return lookups.find_by_name(self.symbols, name, limit)

    def resolve_symbol(self, name_or_path: str) -> DataFrame:
        return lookups.resolve(self.symbols, self.files, name_or_path)

    def callers_and_callees(self, qname: str) -> DataFrame:
        return graph.callers_and_callees(self.edges.where((F.col("src") == qname) | (F.col("dst") == qname)), self.symbols).where(F.col("qname") == qname)

    def related_tests(self, qname: str) -> DataFrame:
        linked = lookups.incoming(self.edges, qname, ["TESTS", "TESTS_SYMBOL"]).select(F.col("src").alias("test"), F.lit(0.92).alias("confidence"))
        content = stored.files(self.spark, self.folder, content=True)
        stem = F.regexp_extract("path", r"([^/.]+)[^/]*$", 1)
        target = lookups.find_symbol(self.symbols, qname).join(self.files.select("file_id", stem.alias("stem")), "file_id").select(F.col("qname").alias("target"), "stem")
        mentioned = workflow.tests_by_mention(content, target).select(F.col("path").alias("test"), "confidence")
        return linked.unionByName(mentioned).groupBy("test").agg(F.max("confidence").alias("confidence")).orderBy(F.desc("confidence"), "test")

    def impact(self, target: str, depth: int = 2) -> DataFrame:
        return graph.neighbourhood(self.edges, self.resolve_symbol(target).select("qname"), depth)

    def patch_impact(self, qname: str) -> DataFrame:
        return workflow.patch_impact(self.edges.where(F.col("dst") == qname), lookups.find_symbol(self.symbols, qname))

    def object_roles(self) -> DataFrame:
        return roles.classify(self.symbols.join(self.files.select("file_id", "path"), "file_id"), self.edges)

    def processes(self) -> DataFrame:
        return processes.build(self.symbols, self.edges)

    @functools.cached_property
    def symbol_index(self) -> StoredIndex:
        return search.symbol_index(self.spark, self.folder)

    @functools.cached_property
    def embedded(self) -> DataFrame:
        """Vectors of the symbols by the chosen embedder, made once and kept in the shared folder."""
        made = vectors.embed_with_cache(vectors.embedded_text(self.symbols), "symbol_id", "text", None, self.embedder)
        return cut_lineage(made)

    def retrieve(self, question: str, mode: str | None = None, pinned: list[str] | None = None, embed: bool = True, limit: int = 1000) -> DataFrame:
        """The ``limit`` best candidates for a question with their channels, ``final`` and ``rank`` from 1."""
        return context.best(self.candidates(question, mode, pinned, embed), limit)

    def candidates(self, question: str, mode: str | None = None, pinned: list[str] | None = None, embed: bool = True) -> DataFrame:
        """All candidates for a question: the seeds and what the graph reaches from them."""
        mode = context.mode_of(mode, question)
        return context.candidates(self.symbols, self.files, self.edges, self.symbol_index, question, mode, pinned, self.embedded if embed else None)

    def ask(self, question: str, budget: int = 8000, mode: str | None = None, pinned: list[str] | None = None, embed: bool = True) -> str:
        """The pack for a question as text: map, files, tests, capsules, source. Nothing is sent anywhere."""
        mode = context.mode_of(mode, question)
        ranked = self.candidates(question, mode, pinned, embed)
        packed = context.capsules(ranked, mode, budget).collect()
        source = context.snippets(ranked, stored.files(self.spark, self.folder, content=True), mode, budget).orderBy("rank").collect()
        tree = [f"{r['folder']} ({r['n_files']} files)" for r in stats.repo_map(self.spark, self.folder).collect()]
        return context.prompt(question, context.intent_of(question), mode, tree, packed, source, context.edit_files(packed, mode), context.test_files(packed))

    def audit(self, question: str, mode: str | None = None, pinned: list[str] | None = None, embed: bool = True) -> DataFrame:
        """How many hits each list gave, how many seeds were fused and how many candidates the graph reached."""
        lists = cut_lineage(context.ranked_lists(self.symbols, self.files, self.symbol_index, question, pinned or [], self.embedded if embed else None))
        return context.audit(lists, self.candidates(question, mode, pinned, embed))

    def explain(self, target: str) -> str:
        return self.ask(f"Explain the purpose of {target}", mode="explain")

    def impact_question(self, target: str) -> str:
        """The pack for changing a target; a path is pinned."""
        path = [target] if "/" in target or self.files.where(F.col("path") == target).head(1) else None
        return self.ask(f"What breaks if I change {target}", mode="impact", pinned=path)

    def prepare_edit(self, task: str, budget: int = 6000, pinned: list[str] | None = None) -> dict[str, DataFrame]:
        """What to edit, read and run for a task, who is touched, what is at risk, and how long each stage took (``timings``)."""
        clock = workflow.Stages(self.spark)
        ranked = clock("retrieve", lambda: self.candidates(task, "edit", pinned))
        plan = clock("classify", lambda: cut_lineage(context.edit_plan(ranked, task)))
        chosen = clock("symbols", lambda: cut_lineage(workflow.symbols_to_modify(ranked, self.symbols)))
        near = clock("neighbours", lambda: workflow.neighbours_of(chosen, self.edges, self.symbols))
        traces = clock("processes", lambda: workflow.traces_of(chosen, self.processes()))
        tests = clock("tests", lambda: workflow.tests_of_task(stored.files(self.spark, self.folder, content=True), task))
        risks = clock("risks", lambda: workflow.risks(chosen, plan, self.edges, task))
        repos = plan.select(F.substring_index("path", "/", 1).alias("repo")).distinct()
        commands = clock("commands", lambda: workflow.validation_commands(self.files).join(repos, "repo", "left_semi"))
        words = self.spark.createDataFrame([(w,) for w in workflow.risk_keywords(task)], "keyword string")
        impact = workflow.patch_impact(self.edges.join(chosen.select(F.col("qname").alias("dst")), "dst", "left_semi"), self.symbols.join(chosen.select("qname"), "qname", "left_semi"))
        return {
            "files": plan, "symbols": chosen, "neighbours": near, "traces": traces, "tests": tests, "risks": risks, "impact": impact, "commands": commands,
            "risk_keywords": words, "timings": clock.frame(),
        }

    def node(self, node_id: str) -> dict[str, DataFrame]:
        return views.node_details(node_id, self.files, self.symbols, self.edges, self.object_roles(), self.processes())

    def view(self, name: str = "full", max_nodes: int | None = None, max_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
        processes_ = (self.processes(), self.process_steps()) if name == "processes" else None
        return views.graph_view(name, self.files, self.symbols, self.edges, processes_, max_nodes, max_edges)

    def process_steps(self) -> DataFrame:
        return processes.steps(self.processes(), self.edges)

    def process(self, process_id: str) -> DataFrame:
        return self.process_steps().where(F.col("process_id") == process_id).orderBy("step")

    def processes_of(self, qname: str, limit: int = 20) -> DataFrame:
        return processes.touching(self.processes(), qname).orderBy(F.desc("confidence"), "process_id").limit(limit)

    def export_processes(self, out: str) -> None:
        sinks.write_processes(self.processes(), self.process_steps(), out)

    def export_impact(self, target: str, out: str, depth: int = 2) -> None:
        reached = self.impact(target, depth)
        nodes = views.node_or_fallback(reached.select("qname"), self.symbols, self.files)
        inner = self.edges.join(reached.select(F.col("qname").alias("src")), "src", "left_semi").join(reached.select(F.col("qname").alias("dst")), "dst", "left_semi")
        sinks.write_graph(nodes, inner.select("edge_id", "src", "dst", "edge_type").dropDuplicates(["edge_id"]), out)

    def export_database(self, connect, max_batch: int = 500) -> None:
        """Push the graph over a session that ``connect`` opens (see ``sinks.push_graph``)."""
        sinks.push_graph(self.symbols, self.edges, connect, max_batch)

    def frameworks(self) -> DataFrame:
        return stats.file_frameworks(self.spark, self.folder)

    def framework_counts(self) -> DataFrame:
        return stats.framework_pivot(self.spark, self.folder)

    def object_types(self) -> DataFrame:
        return stats.symbols_by_kind(self.spark, self.folder)

    def role_counts(self) -> DataFrame:
        return self.object_roles().groupBy("role").agg(F.count("*").alias("n_symbols"))

    @staticmethod
    def supported_languages() -> list[str]:
        return sorted(set(stored.LANGUAGES.values()))

    def search(self, word: str, limit: int = 50) -> DataFrame:
        """Files and symbols that contain a word, files first."""
        low = word.lower()
        hits = self.files.where(F.lower("path").contains(low)).select(F.concat(F.lit("file:"), "path").alias("id"), F.lit(1.0).alias("score"))
        named = self.symbols.where(F.lower("qname").contains(low)).select(F.concat(F.lit("symbol:"), "qname").alias("id"), F.lit(0.9).alias("score"))
        return hits.unionByName(named).orderBy(F.desc("score"), "id").limit(limit)

    def export_graph(self, out: str, kinds: tuple[str, ...] | None = None, types: tuple[str, ...] | None = None) -> None:
        nodes = self.symbols.where(F.col("kind").isin(*kinds)) if kinds else self.symbols
        kept = self.edges.where(F.col("edge_type").isin(*types)) if types else self.edges
        known = nodes.select("qname")
        inner = kept.join(known.withColumnRenamed("qname", "src"), "src", "left_semi").join(known.withColumnRenamed("qname", "dst"), "dst", "left_semi")
        sinks.write_graph(nodes.select("qname", "kind", "name"), inner.select("edge_id", "src", "dst", "edge_type"), out)

    def export_html(self, out: str) -> str:
        return sinks.html_page(self.symbols, self.edges.where("dst is not null"), out)

    def write_report(self, out: str) -> str:
        return sinks.markdown_report(self.stats(), out)

    @staticmethod
    def intents() -> list[str]:
        return [name for name, _ in retrieval.INTENTS]
