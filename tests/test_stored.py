"""Stored tables, semantic facts, evaluation, exports and views on small frames with values worked out by hand."""

import json
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import context, evaluation, incremental, pipeline, resolution, retrieval, vectors, views, workflow
from tessera.operators.aliases import alias_words
from tessera.sources import repository, semantic, sinks

SYMBOLS = "qname string, kind string, name string, file_id long, start_line int, end_line int"


def symbols_of(spark, rows):
    return spark.createDataFrame(rows, SYMBOLS)


FACTS = json.dumps(
    {
        "files": [
            {
                "path": "a.ts",
                "symbols": [{"qualified_name": "a.f", "signature": "f(x: number)", "return_type": "string", "parameters": [{"name": "x", "declared_type": "number"}]}, {"qualified_name": "gone.g", "parameters": [{"name": "y"}]}],
                "references": [{"from_symbol": "a.f", "to_symbol": "b.g", "edge_type": "CALLS"}, {"from_symbol": "a.f", "edge_type": "ACCESSES"}, {"to_symbol": "b.g"}],
                "types": [{"owner_symbol": "a.f", "name": "v", "inferred_type": "Map"}],
            },
            {"path": "b.ts"},
        ]
    }
)


def test_semantic_facts(spark):
    told = semantic.facts(spark, FACTS)
    assert told.count() == 2 and semantic.facts(spark, "no json").count() == 0
    edges = {(r.src, r.dst, r.edge_type): r.confidence for r in semantic.edges_of(told).collect()}
    assert edges == {("a.f", "b.g", "CALLS"): 0.94, ("a.f", None, "ACCESSES"): 0.60}
    known = symbols_of(spark, [("a.f", "function", "f", 1, 1, 2)]).withColumns({"signature": F.lit("f(x)"), "return_type": F.lit("")})
    better = incremental.enrich_symbols(known, semantic.symbols_of(told)).first()
    assert (better.signature, better.return_type) == ("f(x: number)", "string")
    stored = spark.createDataFrame([("a.f", 0, "old"), ("c.h", 0, "z")], "owner_qname string, position int, name string")
    merged = incremental.replace_parameters(stored, semantic.parameters_of(told), known)
    assert {(r.owner_qname, r.name) for r in merged.collect()} == {("a.f", "x"), ("c.h", "z")}
    types = spark.createDataFrame([("a.f", "v", "variable", "any"), ("q", "w", "variable", "int")], "owner_qname string, name string, kind string, declared_type string")
    assert {(r.owner_qname, r.declared_type) for r in incremental.upsert_type_facts(types, semantic.types_of(told)).collect()} == {("a.f", "Map"), ("q", "int")}
    assert [r.owner_qname for r in incremental.orphan_parameters(merged, known).collect()] == ["c.h"]


def test_facts_of_an_external_program():
    adapter = semantic.ProcessAdapter("echo", [sys.executable, "-c", "import sys, json; print(json.dumps({'files': [{'path': sys.argv[1]}]}))"])
    assert json.loads(adapter.analyze("here")) == {"files": [{"path": "here"}]}
    with pytest.raises(RuntimeError, match="ended with 3"):
        semantic.ProcessAdapter("bad", [sys.executable, "-c", "raise SystemExit(3)"]).analyze("here")


def test_what_is_indexed_again(spark):
    old = spark.createDataFrame([("a", "1", "s"), ("b", "1", "s"), ("c", "1", "s"), ("d", "1", None)], "path string, hash string, signature string")
    new = spark.createDataFrame([("a", "1", "s"), ("b", "2", "s"), ("d", "1", "s"), ("e", "1", "s")], "path string, hash string, signature string")
    assert {r.path: r.status for r in incremental.to_index(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "removed", "d": "reparsed", "e": "added"}
    assert {r.status for r in incremental.to_index(old, new, force=True).where("path = 'a'").collect()} == {"forced"}


def test_replacing_a_file_takes_what_belongs_to_it(spark):
    tables = {
        "files": spark.createDataFrame([("a.py", 1), ("b.py", 2)], "path string, file_id long"),
        "symbols": symbols_of(spark, [("a.f", "function", "f", 1, 1, 2), ("b.g", "function", "g", 2, 1, 2)]),
        "edges": spark.createDataFrame([("a.f", "b.g"), ("b.g", "b.g"), ("b.g", None)], "src string, dst string"),
        "imports": spark.createDataFrame([("a.py", "x"), ("b.py", "y")], "path string, local_name string"),
        "parameters": spark.createDataFrame([("a.f", "p"), ("b.g", "q")], "owner_qname string, name string"),
    }
    new = {"files": spark.createDataFrame([("a.py", 3)], "path string, file_id long"), "symbols": symbols_of(spark, [("a.h", "function", "h", 3, 1, 2)])}
    got = incremental.replace_files(tables, new, spark.createDataFrame([("a.py",)], "path string"))
    assert {r.file_id for r in got["files"].collect()} == {2, 3} and {r.qname for r in got["symbols"].collect()} == {"b.g", "a.h"}
    assert {(r.src, r.dst) for r in got["edges"].collect()} == {("b.g", "b.g"), ("b.g", None)}
    assert [r.path for r in got["imports"].collect()] == ["b.py"] and [r.owner_qname for r in got["parameters"].collect()] == ["b.g"]


def test_older_tables_parameters_and_json(spark):
    old = spark.createDataFrame([(1, "keep")], "id long, return_type string")
    row = incremental.migrated(old, "symbols").first()
    assert row.return_type == "keep" and row.is_exported == 0 and row.metadata_json == "{}"
    raw = spark.createDataFrame([("a.f", 0, '{"name": "x", "type": "int", "is_optional": true}'), ("a.f", 1, '{"type": "int"}'), ("a.f", 2, "bad")], "owner_qname string, position int, parameter string")
    assert [(r.name, r.declared_type, r.is_optional, r.confidence) for r in incremental.parameter_rows(raw).collect()] == [("x", "int", True, 0.5)]
    texts = spark.createDataFrame([('{"a": 1}',), ("{bad",), (None,), ("[1]",)], "j string")
    assert [r.v for r in texts.select(incremental.tolerant_json("j").alias("v")).collect()] == ['{"a": 1}', "{}", "{}", "{}"]
    both = incremental.merge_first_wins(spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int"), "k")
    assert {(r.k, r.v) for r in both.collect()} == {("a", 1), ("b", 3)}


def test_packages_below_a_source_folder(spark):
    paths = ["src/pkg/__init__.py", "src/pkg/sub/__init__.py", "src/pkg/sub/m.py", "flat/__init__.py", "web/a/index.ts", "x.py"]
    files = spark.createDataFrame([(p, i, "typescript" if p.endswith("ts") else "python") for i, p in enumerate(paths)], "path string, file_id long, language string")
    assert {(r.disk, r.name) for r in resolution.package_roots(files).collect()} == {("src.pkg", "pkg")}
    assert {r.path: r.module for r in resolution.file_modules(files).collect()} == {
        "src/pkg/__init__.py": "pkg", "src/pkg/sub/__init__.py": "pkg.sub", "src/pkg/sub/m.py": "pkg.sub.m", "flat/__init__.py": "flat", "web/a/index.ts": "web.a", "x.py": "x",
    }
    symbols = symbols_of(spark, [("src.pkg.sub.m.f", "function", "f", 2, 1, 2), ("pkg.sub.m.f", "function", "f", 5, 1, 2), ("src.pkg.sub.m.g", "function", "g", 2, 1, 2)])
    found = {r.lookup: r.qname for r in resolution.lookup_names(symbols, files).collect()}
    assert found["pkg.sub.m.f"] == "pkg.sub.m.f" and found["pkg.sub.m.g"] == "src.pkg.sub.m.g"
    imports = spark.createDataFrame([(1, "x.py", "g", None, "g", "pkg.sub.m")], "import_id long, path string, imported_name string, target string, local_name string, source_module string")
    assert resolution.resolve_bindings(imports, symbols, files).first().target == "src.pkg.sub.m.g"


def test_pinned_seeds_and_summaries(spark):
    lists = spark.createDataFrame([("bm25", f"q{i}", i) for i in range(40)] + [("pinned", "far", 24)], "source string, qname string, rank int")
    fused = retrieval.rrf(lists).collect()
    assert len(fused) == 30 and fused[0].qname == "far" and fused[0].pinned
    schema = "qname string, name string, kind string, path string, bm25 double, vector double, graph double, distance int, sources array<string>"
    rows = [("a.s", "s", "file_summary", "a.py", 0.5, 0.0, 0.0, 0, ["bm25"]), ("a.p", "p", "file_summary", "a.py", 0.5, 0.0, 0.0, 0, ["bm25", "pinned"]), ("a.n", "n", "class", "a.py", 0.0, 0.0, 0.2, 1, [])]
    scored = retrieval.rerank(spark.createDataFrame(rows, schema), [], "security")
    got = {r.qname: round(r.final, 6) for r in scored.collect()}
    # .40 x .5 = .20; a summary keeps .45 of it, a pinned one all and .10 more; .10 x .2 by the graph alone
    assert got == {"a.s": 0.09, "a.p": 0.3, "a.n": 0.02}
    beside = {r.qname: (round(r.final, 6), r.sources) for r in context.co_location(scored, []).collect()}
    assert beside["a.n"] == (0.12, ["co_location"]) and beside["a.p"][0] == 0.3


def test_packs_go_on_past_the_first_candidates(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "STEP", 3)
    rows = [(f"q{i}", "one.py" if i < 20 else f"f{i}.py", 1 - i / 100, 10, True) for i in range(40)]
    ranked = spark.createDataFrame(rows, "qname string, path string, final double, tokens int, seeded boolean")
    assert [r.rank for r in retrieval.pack(ranked, "edit", 6000).collect()] == [1, 2, 3, 4, 5, 21, 22, 23, 24, 25, 26, 27]
    assert [r.rank for r in retrieval.pack(ranked.withColumn("pinned", F.lit(True)), "edit", 6000).collect()] == list(range(1, 13))
    assert retrieval.pack(ranked.limit(0), "edit", 6000).count() == 0


def test_texts_of_packs(spark):
    df = spark.createDataFrame([("x" * 40,), ("short",), ("",), (None,)], "t string")
    assert [r.v for r in df.select(context.truncated("t", 5).alias("v")).collect()] == ["x" * 20 + "\n[truncated]", "short", "", None]
    assert context.mode_of(None, "rename it") == "refactor" and context.mode_of("bug_fix", "") == "debug" and context.mode_of("Edit", "") == "edit"
    with pytest.raises(ValueError, match="no such mode"):
        context.mode_of("sing", "")
    rows = spark.createDataFrame([("a.f", 1.0, 0, ["bm25", "vector"]), ("a.g", 0.5, 2, [])], "qname string, final double, distance int, sources array<string>")
    assert [r.v for r in rows.select(context.inclusion_reason("edit").alias("v")).collect()] == ["Seed match via bm25, vector  ·  score=1.000  ·  mode=edit", "2-hop neighbor: a.g  ·  score=0.500  ·  mode=edit"]


def test_alias_words(spark):
    symbols = spark.createDataFrame([("m.loadHTTPToken", "loadHTTPToken", "function", 1, None), ("r", "GET /a", "route", 1, '{"http_method": "GET", "path": "/orders/:id"}')], "qname string, name string, kind string, file_id long, extras string")
    files = spark.createDataFrame([(1, "src/store_x.py")], "file_id long, path string")
    edges = spark.createDataFrame([("m.loadHTTPToken", "a.readRow", "CALLS"), ("m.loadHTTPToken", "skip", "TESTS")], "src string, dst_name string, edge_type string")
    got = {r.qname: set(r.alias.split()) for r in alias_words(symbols, files, edges).collect()}
    assert {"load", "http", "token", "src", "store_x", "operation", "budget", "read", "row"} <= got["m.loadHTTPToken"] and "skip" not in got["m.loadHTTPToken"] and "py" not in got["m.loadHTTPToken"]
    assert {"get", "orders", "id", "endpoint"} <= got["r"]


def test_vectors_are_cached_by_content_and_model(spark):
    docs = spark.createDataFrame([(1, "alpha"), (2, "beta")], "id long, text string")
    made = vectors.embed_with_cache(docs, "id", "text")
    marked = made.withColumn("embedding", F.array(F.lit(9.0).cast("float")))
    changed = spark.createDataFrame([(1, "alpha"), (2, "gamma")], "id long, text string")
    again = {r.id: list(r.embedding) for r in vectors.embed_with_cache(changed, "id", "text", marked).collect()}
    assert again[1] == [9.0] and len(again[2]) == vectors.DIMENSION
    assert vectors.of_model(made, "other").count() == 0 and vectors.of_model(made, "hash-stub").count() == 2
    assert vectors.unpack_vector(vectors.pack_vector([1.0, -0.5])) == [1.0, -0.5] and len(vectors.text_hash("x")) == 32
    assert vectors.embedder_for_query("bm25") is None and vectors.embedder_for_query("auto") is None and vectors.embedder_for_query("hybrid").model_id == "hash-stub"


def test_evaluation(spark):
    tasks = evaluation.tasks_frame(spark, [{"id": "t", "task": "x", "mode": "edit", "oracle_files": ["a.py"], "oracle_symbols": ["f", "g"]}, {"id": "u", "task": "y"}])
    packed = spark.createDataFrame([("t", "m.f", "b.py", 10, ["bm25"]), ("t", "m.z", "src/a.py", 10, ["graph"]), ("t", "m.q", "tests/c.py", 20, ["bm25"])], "id string, item string, path string, tokens int, sources array<string>")
    assert {r.id: r.irrelevant for r in evaluation.irrelevant_ratio(packed, tasks).collect()} == {"t": 0.5, "u": 0.0}
    noisy = evaluation.noise(packed, tasks)
    assert [r.item for r in noisy.collect()] == ["m.q"] and [tuple(r) for r in evaluation.source_counts(packed).collect()] == [("bm25", 2), ("graph", 1)]
    found = spark.createDataFrame([("t", "f", 1, True, 1.0, 0.0), ("t", "g", None, False, None, None), ("t", "h", 9, False, 0.0, 0.0), ("t", "i", 9, False, 0.3, 0.0)], "id string, oracle string, rank int, included boolean, bm25 double, vector double")
    assert {(r.action, r.subject) for r in evaluation.tuning(found, noisy, tasks).collect()} == {("add_alias", "g"), ("strengthen_names", "h"), ("raise_capsules", "i"), ("drop_tests", "edit")}
    edits = evaluation.edit_tasks(spark, [{"id": "t", "oracle_files_likely_to_edit": ["a.py"], "oracle_tests": ["t_a.py"], "risk_keywords": ["auth", "x"]}, {"id": "no"}])
    plans = spark.createDataFrame([("t", "edit", 1, "src/a.py"), ("t", "edit", 2, "b.py"), ("t", "test", 1, "z.py"), ("t", "risk", 1, "Auth path")], "id string, role string, place int, item string")
    m = evaluation.edit_metrics(plans, edits).first()
    assert (m.edit_file_recall_at_5, m.edit_file_precision_at_5, m.test_recall_at_5, m.risk_recall) == (1.0, 0.5, 0.0, 0.5)
    assert {r.metric: r["mean"] for r in evaluation.aggregate(evaluation.edit_metrics(plans, edits)).collect()}["risk_recall"] == 0.5
    asked = evaluation.run_tasks(tasks, lambda task, mode: spark.createDataFrame([(1, "m.f", "a.py", "function", 1.0)], "rank int, qname string, path string, kind string, final double"))
    assert {r.metric: r.value for r in evaluation.report(asked, tasks).collect()}["symbol_recall_at_3"] == 0.75
    assert evaluation.primary_report({"bm25": {}, "hybrid": {"a": 1}}, ["bm25"]) == {"a": 1} and evaluation.primary_report({"bm25": {"b": 1}}, ["bm25", "vector"]) == {"b": 1}
    assert evaluation.profile("dev")[0] == ("edit_file_recall_at_5", 0.60, True) and evaluation.profile("advisory")[0][2] is False and "spark" in evaluation.environment()


def test_extraction_fixtures(spark, tmp_path):
    (tmp_path / "f.json").write_text(json.dumps([{"id": "one", "language": "python", "source_files": {"a.py": "x = 1"}, "expected_symbols": ["a.x"]}]))
    fixtures = evaluation.extraction_fixtures(spark, str(tmp_path))
    row = fixtures.first()
    assert row.expected_symbols == ["a.x"] and row.expected_calls == [] and evaluation.fixture_files(fixtures).first().content == "x = 1"


def test_pushes_bundles_and_answers(spark, tmp_path):
    class Recorder:
        """A session that writes what it is asked into a folder."""

        def __init__(self, folder):
            self.folder = folder

        def run(self, query, rows):
            import json
            import uuid
            from pathlib import Path

            Path(self.folder, uuid.uuid4().hex).write_text(json.dumps([query, rows], default=str))

        def close(self):
            pass

    symbols = symbols_of(spark, [(f"a.f{i}", "function", f"f{i}", 1, 1, 2) for i in range(7)] + [("a.C", "class", "C", 1, 1, 9)])
    edges = spark.createDataFrame([(1, "a.f1", "a.f2", "CALLS"), (2, "a.f1", "gone", "CALLS"), (3, "a.f1", None, "CALLS")], "edge_id long, src string, dst string, edge_type string")
    folder = str(tmp_path / "sent")
    Path(folder).mkdir()
    sent = {r.part: r.sent for r in sinks.push_graph(symbols, edges, lambda: Recorder(folder), 3).collect()}
    told = [json.loads(p.read_text()) for p in Path(folder).iterdir()]
    assert sent == {"nodes": 8, "edges": 1} and all(len(rows) <= 3 for _, rows in told) and sum("`CALLS`" in q for q, _ in told) == 1
    assert sum(len(rows) for q, rows in told if "`Function`" in q) == 7 and sinks.label_of("test_block") == "TestBlock"
    rows = sinks.edge_rows(spark, [("a", None, "b", "CALLS", 0.5, "ast", 3), ("a", "b", "b", "CALLS", 0.5, "ast", 3, 1, 2, "r", "{}", None)]).collect()
    assert [(r.precision_level, r.metadata_json) for r in rows] == [(1, "{}"), (2, "{}")]
    with pytest.raises(ValueError, match="7 or 12"):
        sinks.edge_rows(spark, [("a",)])
    made = sinks.write_bundle({"good": lambda: "x.md", "bad": lambda: 1 / 0}, str(tmp_path / "b"))
    assert [m["ok"] for m in made] == [True, False] and json.loads((tmp_path / "b/manifest.json").read_text()) == made
    assert sinks.answer("pack") == "pack" and sinks.answer("pack", lambda p: p.upper()) == "PACK" and sinks.answer("pack", lambda p: 1 / 0) == "pack"


def test_archives_addresses_and_manifests(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "good.zip", "w") as z:
        z.writestr("a/b.py", "x")
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../b.py", "x")
    assert repository.extract_archive(str(tmp_path / "good.zip"), str(tmp_path / "out")) == ["a/b.py"] and (tmp_path / "out/a/b.py").exists()
    with pytest.raises(ValueError, match="unsafe"):
        repository.extract_archive(str(tmp_path / "bad.zip"), str(tmp_path / "out2"))
    with pytest.raises(ValueError, match="not the address"):
        repository.clone_repository("https://example.org/a/b", str(tmp_path / "c"))
    rows = [("package.json", '{"scripts": {"test": "jest"}}'), ("pyproject.toml", "[tool.pytest.ini_options]\n[tool.ruff]\n"), ("Makefile", "test:\n\tx\nA := 1\n"), ("go.mod", "module x"), ("a.py", "x")]
    facts = {(r.fact, r.name) for r in repository.manifest_facts(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert facts == {("script", "test"), ("tool", "pytest"), ("tool", "ruff"), ("target", "test"), ("module", "go")}


def test_the_repository_s_own_ignore_files_count(spark, tmp_path):
    (tmp_path / ".gitignore").write_text("# c\nskip*.py\ngen/\n")
    (tmp_path / "gen").mkdir()
    for name in ("a.py", "skip1.py", "gen/b.py"):
        (tmp_path / name).write_text("x = 1\n")
    scanned = repository.scan_repository(spark, str(tmp_path))
    assert [r.path for r in scanned.collect()] == ["a.py"] and repository.hash_at(scanned, "a.py") == scanned.first().hash and repository.hash_at(scanned, "no") is None


def test_views_of_small_graphs(spark):
    files = spark.createDataFrame([("a/b.py", 1)], "path string, file_id long")
    symbols = symbols_of(spark, [("f", "function", "f", 1, 1, 2), ("g", "function", "g", 1, 3, 4)])
    parameters = spark.createDataFrame([("f", 1, "y", "", 0.5), ("f", 0, "x", "int", 0.5)], "owner_qname string, position int, name string, declared_type string, confidence double")
    nodes = views.attach_parameters(views.symbol_nodes(symbols, files), parameters)
    assert {r.id: [p.name for p in r.parameters] if r.parameters else None for r in nodes.collect()} == {"symbol:f": ["x", "y"], "symbol:g": None}
    steps = spark.createDataFrame([("p", 1, "f", "g")], "process_id string, step int, src string, dst string")
    assert [r.path for r in views.pins_of(["process:p", "file:none", "symbol:f"], files, symbols, steps).collect()] == ["a/b.py"]
    assert views.topological_order({"c": ["b"], "b": ["a"], "a": []}) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        views.topological_order({"a": ["b"], "b": ["a"]})
    with pytest.raises(ValueError, match="no such view"):
        views.graph_view("none", files, symbols, symbols)


def test_phases_run_after_what_they_need():
    from dataclasses import dataclass

    @dataclass
    class Step:
        name: str
        needs: tuple

        def run(self, state):
            return sum(state[n] for n in self.needs) + 1

    results, took = pipeline.run_phases([Step("c", ("a", "b")), Step("a", ("start",)), Step("b", ("a",))], {"start": 1})
    assert results == {"start": 1, "a": 2, "b": 3, "c": 6} and list(took) == ["a", "b", "c"]
    for bad in ([Step("a", ("b",)), Step("b", ("a",))], [Step("a", ("none",))], [Step("a", ()), Step("a", ())]):
        with pytest.raises(ValueError):
            pipeline.run_phases(bad)


def test_risks_of_a_task(spark):
    chosen = spark.createDataFrame([("a.login", "function", 1)], "qname string, kind string, place int")
    plan = spark.createDataFrame([("a.py", "edit")], "path string, role string")
    edges = spark.createDataFrame([(i, f"r{i}", "a.login", "ROUTES_TO" if i == 0 else "CALLS") for i in range(6)], "edge_id long, src string, dst string, edge_type string")
    got = {r.risk: (r.level, r.affected) for r in workflow.risks(chosen, plan, edges, "rotate the token").collect()}
    assert got == {"task": ("medium", ["a.py"]), "code_path": ("high", ["a.login"]), "fan_out": ("medium", ["a.login (callers=6)"]), "route_exposure": ("medium", ["r0"]), "no_tests": ("medium", ["a.py"])}


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Cluster:
        conf = Conf()

    with pytest.raises(RuntimeError, match="share no folder"):
        session.shared_folder(Cluster())


def test_no_text_passes_a_shuffle_where_files_are_read(spark):
    from tessera.sources import graph

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("the driver's tables are not here")
    files = graph.files(spark, "/root/testdata/sf0.001", content=True)
    files.collect()
    plan = files._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[0]
    assert "BroadcastHashJoin" in final and not any("Exchange" in line and "content" in line for line in final.split("\n"))
