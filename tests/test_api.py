"""The library surface on the smallest tables, and the evaluation operators on small frames."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.api import IndexedGraph
from tessera.operators import evaluation as e
from tessera.operators import lookups

FOLDER = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


@needs_data
def test_library(spark, tmp_path):
    g = IndexedGraph(spark, FOLDER)
    symbol = g.symbols.where("kind = 'function'").orderBy("qname").first()
    path = g.files.where(F.col("file_id") == symbol.file_id).first()
    assert g.resolve_symbol(symbol.qname).select("qname").first().qname == symbol.qname
    assert g.find_symbol(symbol.name).count() >= 1 and g.impact(symbol.qname).count() >= 1
    if path:
        assert g.resolve_symbol(path.path).count() >= 1
    ranked = g.retrieve(f"fix {symbol.name} in the loader", pinned=[path.path] if path else None)
    rows = ranked.orderBy("rank").collect()
    assert [r.rank for r in rows] == list(range(1, len(rows) + 1)) and symbol.qname in {r.qname for r in rows}
    text = g.ask(f"fix {symbol.name} in the loader")
    assert f"fix {symbol.name}" in text and f"Capsule: {symbol.qname}" in text and "Seed match via" in text and "## Repo map" in text
    plan = g.prepare_edit(f"change {symbol.name} and the auth token")
    assert plan["files"].count() >= 1 and {"auth", "token"} <= {r.keyword for r in plan["risk_keywords"].collect()}
    assert {r.risk for r in plan["risks"].collect()} >= {"task"} and plan["symbols"].count() >= 1 and plan["timings"].count() == 8
    assert plan["neighbours"].count() >= 0 and plan["traces"].count() >= 0 and plan["tests"].count() <= 5
    assert {r.stage for r in g.audit("fix the loader").collect()} >= {"seeds.fused", "expanded_candidates"}
    assert g.node(f"symbol:{symbol.qname}")["node"].count() == 1 and g.node("folder:x")["files"].count() == 0
    for name in ("full", "repo", "symbols", "calls", "processes", "framework"):
        nodes, edges = g.view(name)
        assert nodes.columns and edges.join(nodes.withColumnRenamed("id", "source"), "source", "left_anti").count() == 0, name
    nodes, edges = g.view("full", max_nodes=20, max_edges=5)
    assert nodes.count() == 20 and edges.count() <= 5
    g.export_processes(str(tmp_path / "p"))
    g.export_impact(symbol.qname, str(tmp_path / "i"))
    assert g.patch_impact(symbol.qname).count() == 1 and g.related_tests(symbol.qname).count() >= 0 and g.callers_and_callees(symbol.qname).count() >= 0
    assert g.search("a").count() > 0 and g.object_roles().count() > 0 and g.languages().count() > 0
    g.export_graph(str(tmp_path / "g"))
    assert (tmp_path / "g/nodes/_SUCCESS").exists()
    assert "metric" in Path(g.write_report(str(tmp_path / "r.md"))).read_text() and Path(g.export_html(str(tmp_path / "p.html"))).exists()


def test_index_of_a_folder(spark, tmp_path):
    (tmp_path / "a.py").write_text("def f():\n    return g()\n")
    rows = IndexedGraph.index(spark, str(tmp_path)).collect()
    assert {r.qname for r in rows if r.record == "symbol"} == {"a.f"}


TASKS = """
- id: one
  task: "Find the store"   # a comment
  mode: edit
  budget: 4000
  oracle_files: [src/store.py, lib/db.py]
  oracle_symbols:
    - Store.save
    - "Store.load"
- id: two
  task: nothing
"""


def test_tasks_recall_precision_and_gates(spark):
    parsed = e.parse_tasks(TASKS)
    assert parsed[0]["budget"] == 4000 and parsed[0]["oracle_symbols"] == ["Store.save", "Store.load"]
    tasks = e.tasks_frame(spark, parsed)
    files = spark.createDataFrame([("one", 1, "./src/store.py"), ("one", 2, "x.py"), ("one", 3, "repo/lib/db.py")], "id string, rank int, item string")
    assert {(r.id, r.k): r.recall for r in e.recall_at(files, tasks, (1, 3), "files").collect()} == {("one", 1): 0.5, ("one", 3): 1.0, ("two", 1): 1.0, ("two", 3): 1.0}
    assert [r.precision for r in e.precision_at(files, tasks, 2).collect()] == [0.5]
    symbols = spark.createDataFrame([("one", 4, "pkg.Store.save")], "id string, rank int, item string")
    assert {r.oracle: r["rank"] for r in e.missed(symbols, tasks).collect()} == {"Store.save": 4, "Store.load": None}
    times = spark.createDataFrame([("a", float(i)) for i in range(1, 21)] + [("b", None), ("b", 3.0)], "stage string, ms double")
    got = {r.stage: (r.mean, r.median, r.p95) for r in e.summary(times, "stage", "ms").collect()}
    assert got == {"a": (10.5, 10.5, 19.0), "b": (3.0, 3.0, 3.0)}
    metrics = spark.createDataFrame([("edit_file_recall_at_5", 0.9), ("latency_ms", 900.0)], "metric string, value double")
    passed = {r.metric: r.passed for r in e.gates(metrics).collect()}
    assert passed["edit_file_recall_at_5"] and not passed["latency_ms"] and not passed["risk_recall"]


def test_lookups(spark):
    s = spark.createDataFrame([(1, 1, "a.b.get", "get", 3), (2, 1, "a.B.GET", "GET", 1), (3, 2, "c.get", "get", 1)], "symbol_id long, file_id long, qname string, name string, start_line int")
    f = spark.createDataFrame([(1, "x/y.py"), (2, "z.py")], "file_id long, path string")
    assert [r.qname for r in lookups.find_by_name(s, "get").collect()] == ["a.b.get", "c.get"]
    assert lookups.find_by_name(s, "get", parity=True).count() == 3
    assert [r.qname for r in lookups.in_file(s, f, "x/y.py").collect()] == ["a.B.GET", "a.b.get"]
    assert [r.qname for r in lookups.resolve(s, f, "z.py").collect()] == ["c.get"] and lookups.resolve(s, f, "none").count() == 0
    edges = spark.createDataFrame([(1, "a", "b", "CALLS", 0.5), (2, "b", "a", "TESTS", 0.9), (3, "a", "a", "CALLS", 0.1)], "edge_id long, src string, dst string, edge_type string, confidence double")
    assert [r.edge_id for r in lookups.touching(edges, "a").collect()] == [2, 1, 3]
