"""Scans, parsers, sinks and streams on small inputs."""

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from tessera.operators.postings import StoredIndex
from tessera.operators import retrieval, vectors, workflow
from tessera.operators.resolution import js_relative_module, python_relative_module
from tessera.sources import parsers, repository, sinks
from tessera.streaming import ingest

APP = '''"""Orders."""
import os
from .services import OrderService as Service

LIMIT = 3


@router.get("/orders/{id}")
def read_order(order_id: int, verbose=False):
    """Reads one order."""
    return Service(os.environ["DB_URL"]).load(order_id)


class Base(Parent):
    def save(self, row):
        return check(row)


def test_save():
    assert Base().save(1)
'''


def test_python_file(spark):
    rows = parsers.parse_text("shop/app.py", "python", APP)
    symbols = {(r["kind"], r["qname"]) for r in rows if r["record"] == "symbol"}
    assert {("function", "shop.app.read_order"), ("class", "shop.app.Base"), ("method", "shop.app.Base.save"), ("constant", "shop.app.LIMIT")} <= symbols
    assert ("route", "fastapi::GET /orders/{id}") in symbols and ("env_var", "env::DB_URL") in symbols
    edges = {(r["kind"], r["qname"], r["dst_name"]) for r in rows if r["record"] == "edge"}
    assert {("CALLS", "shop.app.Base.save", "check"), ("EXTENDS", "shop.app.Base", "Parent"), ("READS_ENV_VAR", "shop.app.read_order", "DB_URL")} <= edges
    assert [r["name"] for r in rows if r["record"] == "parameter" and r["qname"] == "shop.app.read_order"] == ["order_id", "verbose"]


def test_files_with_braces():
    rows = parsers.parse_text("web/cart.ts", "typescript", "import { tax } from './money';\nexport class Cart extends Base {\n  total(items: Item[]): number {\n    return tax(items);\n  }\n}\n")
    assert {(r["kind"], r["qname"]) for r in rows if r["record"] == "symbol"} == {("class", "web.cart.Cart"), ("method", "web.cart.Cart.total")}
    assert ("CALLS", "tax") in {(r["kind"], r["dst_name"]) for r in rows if r["record"] == "edge"}
    go = parsers.parse_text("a/b.go", "go", 'package a\n\nfunc (s *Store) Load(id string) int {\n\treturn find(id)\n}\n')
    assert ("method", "a.b.Store.Load") in {(r["kind"], r["qname"]) for r in go if r["record"] == "symbol"}


def parsed(path, language, text):
    rows = parsers.parse_text(path, language, text)
    symbols = {(r["kind"], r["qname"]) for r in rows if r["record"] == "symbol"}
    edges = {(r["kind"], r["qname"], r["dst_name"], r["confidence"]) for r in rows if r["record"] == "edge"}
    return symbols, edges, {(r["name"], r["dst_name"]) for r in rows if r["record"] == "import"}


JAVA = """package a;
import java.util.List;
@RestController
@RequestMapping("/api")
public class C extends Base implements Runnable, Other<String> {
  static final int MAX_SIZE = 3;
  public C(int x) { go(x); }
  @GetMapping("/x/{id}")
  public List<String> find(int id) { return load(id); }
  @Test
  void checksFind() { find(3); }
}
"""


def test_java():
    symbols, edges, imports = parsed("a/C.java", "java", JAVA)
    assert {("class", "a.C.C"), ("constant", "a.C.C.MAX_SIZE"), ("constructor", "a.C.C.C"), ("method", "a.C.C.find"), ("test_block", "a.C.C.checksFind"), ("route", "route::GET /api/x/{id}")} == symbols
    assert {("EXTENDS", "a.C.C", "Base", 0.8), ("IMPLEMENTS", "a.C.C", "Runnable", 0.8), ("IMPLEMENTS", "a.C.C", "Other", 0.8)} <= edges
    assert {("ROUTES_TO", "route::GET /api/x/{id}", "a.C.C.find", 0.9), ("TESTS", "a.C.C.checksFind", "a.C.C.find", 0.75), ("CALLS", "a.C.C.find", "load", 0.55)} <= edges
    assert imports == {("List", "List")}


def test_go():
    symbols, edges, _ = parsed("a/d.go", "go", 'package a\nconst Limit = 3\nvar table = 1\nfunc TestLoad(t *testing.T) { Load() }\nfunc Load() int { return 1 }\nfunc main() { http.HandleFunc("/x", Load); r.GET("/y", Load) }\n')
    assert {("constant", "a.d.Limit"), ("variable", "a.d.table"), ("test_block", "a.d.TestLoad"), ("function", "a.d.Load"), ("route", "route::GET /y")} <= symbols
    assert {("TESTS", "a.d.TestLoad", "a.d.Load", 0.75), ("ROUTES_TO", "route::GET /y", "Load", 0.9)} <= edges


def test_csharp():
    text = 'using System;\n[Route("api/[controller]")]\npublic class OrdersController : ControllerBase, IDisposable {\n    public const int Max = 3;\n    public string Name { get; set; }\n    [HttpGet("{id}")]\n    public Order Get(int id) { return Load(id); }\n    [Fact]\n    public void TestsGet() { Get(1); }\n}\n'
    symbols, edges, _ = parsed("a/E.cs", "csharp", text)
    c = "a.E.OrdersController"
    assert {("class", c), ("constant", f"{c}.Max"), ("property", f"{c}.Name"), ("method", f"{c}.Get"), ("test_block", f"{c}.TestsGet"), ("route", "route::GET /api/orders/{id}")} == symbols
    assert {("EXTENDS", c, "ControllerBase", 0.8), ("IMPLEMENTS", c, "IDisposable", 0.8), ("TESTS", f"{c}.TestsGet", f"{c}.Get", 0.75), ("ROUTES_TO", "route::GET /api/orders/{id}", f"{c}.Get", 0.9)} <= edges


def test_rust():
    text = "use std::fmt::{Display, Debug};\nconst MAX_LEN: usize = 3;\nstruct S { a: i32 }\nimpl Display for S { fn show(&self) -> i32 { helper(1) } }\nfn helper(x: i32) -> i32 { x }\nmod tests {\n    #[test]\n    fn it_works() { helper(2); }\n}\n"
    symbols, edges, imports = parsed("a/f.rs", "rust", text)
    assert {("constant", "a.f.MAX_LEN"), ("struct", "a.f.S"), ("method", "a.f.S.show"), ("function", "a.f.helper"), ("module", "a.f.tests"), ("test_block", "a.f.tests.it_works")} == symbols
    assert {("IMPLEMENTS", "a.f.S", "Display", 0.8), ("TESTS", "a.f.tests.it_works", "a.f.helper", 0.75)} <= edges and imports == {("Display", "Display"), ("Debug", "Debug")}


def test_kotlin():
    symbols, edges, _ = parsed("a/g.kt", "kotlin", "import a.b.C\ndata class P(val x: Int)\nclass K(val n: Int) : Base(n), Iface {\n    private val size = 3\n    fun twice(x: Int) = x * 2\n    @Test\n    fun checks() { twice(2) }\n}\n")
    assert {("class", "a.g.P"), ("class", "a.g.K"), ("property", "a.g.K.size"), ("method", "a.g.K.twice"), ("test_block", "a.g.K.checks")} == symbols
    assert {("EXTENDS", "a.g.K", "Base", 0.8), ("IMPLEMENTS", "a.g.K", "Iface", 0.8), ("TESTS", "a.g.K.checks", "a.g.K.twice", 0.75)} <= edges


SCRIPT = """import def, { one as uno, two } from './m';
const { a, b: c } = require('x');
const f = <T,>(x: T) => x;
const g = async (x: number): Promise<number> => x + uno(1);
router.get('/z', auth, limit, handler);
fastify.route({ method: 'GET', url: '/w', handler: show });
it('adds', () => { two(1); });
fetch(`/api/${id}`); fetch(url); fetch('/plain');
class A extends B<C<D>> implements I { m(x: Map<string, number>): void { uno(x) } }
"""


def test_scripts():
    symbols, edges, imports = parsed("a/h.ts", "typescript", SCRIPT)
    assert {("function", "a.h.f"), ("function", "a.h.g"), ("class", "a.h.A"), ("route", "express::GET /z"), ("route", "fastify::GET /w"), ("test_block", "jest::a/h.ts::adds")} <= symbols
    assert {("USES_MIDDLEWARE", "express::GET /z", "auth", 0.8), ("HANDLES_ROUTE", "express::GET /z", "handler", 0.85), ("HANDLES_ROUTE", "fastify::GET /w", "show", 0.85)} <= edges
    assert {("TESTS_SYMBOL", "jest::a/h.ts::adds", "two", 0.55), ("EXTENDS", "a.h.A", "B", 0.8), ("IMPLEMENTS", "a.h.A", "I", 0.8)} <= edges
    assert {(e[2], e[3]) for e in edges if e[0] == "FETCHES"} == {("/api/:param", 0.55), ("url", 0.55), ("/plain", 0.75)}
    assert imports == {("def", "default"), ("uno", "one"), ("two", "two"), ("a", "a"), ("c", "b")}


def test_python_frameworks():
    text = 'LIMIT = 3\nurlpatterns = [path("x/<int:id>/", views.show)]\nclass M(Base):\n    __tablename__ = "ms"\n@pytest.fixture\ndef db(): return 1\ndef f(): return LIMIT + LIMIT\ndef test_f(db): assert f()\n'
    symbols, edges, _ = parsed("a/u.py", "python", text)
    assert {("route", "django::ANY /x/<int:id>"), ("model", "orm::M"), ("fixture", "pytest::a/u.py::db")} <= symbols
    assert {("ROUTE_HANDLED_BY", "django::ANY /x/<int:id>", "show", 0.9), ("READS_CONSTANT", "a.u.f", "a.u.LIMIT", 0.85), ("USES_FIXTURE", "pytest::a/u.py::test_f", "pytest::a/u.py::db", 0.8)} <= edges
    assert parsers.join_route("/api/", "/x/") == "/api/x" and parsers.join_route("", "") == "/"


def test_long_labels_stay_apart():
    long = "x" * 300
    names = {q for k, q in parsed("a.ts", "typescript", f"it('{long}1', () => {{}});\nit('{long}2', () => {{}});\n")[0] if k == "test_block"}
    assert len(names) == 2


def test_a_provider_and_a_detector_can_be_added(monkeypatch):
    monkeypatch.setitem(parsers.PROVIDERS, "php", lambda x, language: x.symbol("function", "f", 1, 1))
    monkeypatch.setattr(parsers, "DETECTORS", [*parsers.DETECTORS, lambda x, language: x.edge("SEES", x.module, "it", 1, 0.5)])
    symbols, edges, _ = parsed("a.php", "php", "<?php")
    assert symbols == {("function", "a.f")} and ("SEES", "a", "it", 0.5) in edges


def test_broken_and_empty_files_get_a_summary(spark):
    for text in ("def broken(:\n", ""):
        assert [r["kind"] for r in parsers.parse_text("x.py", "python", text)] == ["file_summary"]
    df = spark.createDataFrame([("x.py", "python", None, 1), (None, "python", "a", 1), ("y.py", None, "a", 1), ("z.py", "python", "def f(): pass", 1)], "path string, language string, content string, kind int")
    assert [r.path for r in parsers.symbols_of(parsers.parse_files(df)).collect()] == ["z.py"]


def test_scan_leaves_out_what_is_no_source(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.py").write_text("x = 1\n")
    (tmp_path / "src/b.py").write_bytes(b"\0\1\2")
    (tmp_path / "src/c.bin").write_text("x")
    (tmp_path / "src/skip.py").write_text("x")
    (tmp_path / "node_modules/d.js").write_text("x")
    (tmp_path / "id_rsa").write_text("x")
    rows = repository.scan_repository(spark, str(tmp_path), ignore=["skip*"]).collect()
    assert [(r.path, r.language, r.content) for r in rows] == [("src/a.py", "python", "x = 1\n")]
    assert repository.within_limits(repository.scan_repository(spark, str(tmp_path))).first().allowed


def test_archives_and_addresses(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok.txt", "x")
        z.writestr("../out.txt", "x")
    assert repository.unsafe_entries(str(tmp_path / "a.zip")) == ["../out.txt"]
    urls = spark.createDataFrame([("https://github.com/a/b",), ("http://github.com/a/b",), ("https://github.com/a",)], "u string")
    assert [r.v for r in urls.select(repository.valid_repository_url("u").alias("v")).collect()] == [True, False, False]


def test_modules_of_relative_imports(spark):
    df = spark.createDataFrame([("src/api/foo.ts", "./util"), ("src/api/foo.ts", "../x/index"), ("a/b/c.py", ".d")], "p string, m string")
    js = [r.v for r in df.select(js_relative_module("p", "m").alias("v")).collect()]
    assert js[:2] == ["src.api.util", "src.x"]
    assert df.select(python_relative_module(F.lit("pkg.sub.mod"), F.lit("..x")).alias("v")).first().v == "pkg.x"


def test_bm25_of_empty_and_null_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, ""), (4, "beta beta")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "beta beta gamma")], "query_id int, query string")
    got = StoredIndex.build(docs, "doc_id", "text", str(tmp_path / "i")).top_many(q, 5).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: r.rank)] == [4, 1]
    index = StoredIndex(spark, str(tmp_path / "i"), "doc_id")
    assert [r.doc_id for r in index.ask("beta beta gamma").orderBy("score", ascending=False).collect()] == [4, 1]
    assert index.top_many(q.where("query = 'none'"), 5).count() == 0
    assert index.ask("").count() == 0 and index.lookup([]).count() == 0 and index.ask("nothing here").count() == 0
    assert {(r.term, r.df) for r in index.terms().collect()} == {("alpha", 1), ("beta", 2)} and index.figures().first().n_docs == 4
    asked = spark.createDataFrame([(1,), (4,), (77,)], "doc_id long")
    assert {r.doc_id: r.length for r in index.document_length(asked).collect()} == {1: 2, 4: 2, 77: 1}
    empty = StoredIndex.build(docs.limit(0), "doc_id", "text", str(tmp_path / "e"))
    assert empty.ask("beta").count() == 0 and empty.figures().first().n_docs == 1


def test_a_lookup_reads_the_folders_of_its_terms_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"common word{i} other{i % 7}") for i in range(300)], "doc_id long, text string")
    index = StoredIndex.build(docs, "doc_id", "text", str(tmp_path / "i"))
    found = index.lookup(["common", "other3"])
    assert found.count() == 300 + len([i for i in range(300) if i % 7 == 3])
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert len({f.split("/bucket=")[1].split("/")[0] for f in found.inputFiles()} if found.inputFiles() else set()) <= 64


def test_vector_search_against_brute_force(spark):
    rows = [(i, [float((i * 7 + j) % 5 - 2) for j in range(4)]) for i in range(40)] + [(90, None), (91, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): r.vec_id for r in vectors.top_k(df, "vec_id", "embedding", q, 3).collect()}

    def cos(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 9)

    for i in range(3):
        order = sorted(((-cos(rows[i][1], v), k) for k, v in rows[:40] if any(v)))
        assert [got[i, r] for r in (1, 2, 3)] == [k for _, k in order[:3]]
    assert abs(sum(x * x for x in vectors.embed_text("one two two")) - 1) < 1e-9 and not any(vectors.embed_text(None))


def test_intents_keywords_and_packs(spark):
    df = spark.createDataFrame([("What breaks if I change it",), ("rename the parser",), ("hello",)], "q string")
    assert [r.i for r in df.select(retrieval.classify_intent("q").alias("i")).collect()] == ["impact_analysis", "refactor", "explain"]
    assert workflow.task_keyword("Fix the parser and lexers") == "parser" and workflow.risk_keywords("rotate auth token") == ["rotate", "auth", "token"]
    ranked = spark.createDataFrame([(f"q{i}", "same.py", 1.0 / i, 10, True) for i in range(1, 9)], "qname string, path string, final double, tokens int, seeded boolean")
    assert [r.rank for r in retrieval.pack(ranked, "edit", 6000).collect()] == [1, 2, 3, 4, 5]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "class"), ("b", None)], "qname string, kind string")
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "z", "CALLS")], "src string, dst string, edge_type string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.json(str(tmp_path / "g/edges")).count() == 2
    assert sinks.graph_payload(nodes, edges).count() == 4
    page = open(sinks.html_page(nodes, edges, str(tmp_path / "p.html"))).read()
    assert "CALLS b" in page and "CALLS z" not in page
    figures = spark.createDataFrame([("files", "", 3.0)], "metric string, key string, value double")
    assert "| files |  | 3 |" in open(sinks.markdown_report(figures, str(tmp_path / "r.md"))).read()
    assert json.load(open(sinks.json_report(figures, str(tmp_path / "r.json"))))[0]["value"] == 3.0


def test_stream_of_files_keeps_the_latest_row_per_path(spark, tmp_path):
    schema = "id long, path string, indexed_at timestamp, content string"
    t = dt.datetime(2024, 1, 1)
    source, index = str(tmp_path / "in"), str(tmp_path / "index")
    spark.createDataFrame([(1, "a", t, "old"), (2, "b", t, "b"), (3, None, t, "x")], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    ingest.ingest_files(stream(), index, str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(4, "a", t + dt.timedelta(days=1), "new")], schema).write.mode("append").parquet(source)
    ingest.ingest_files(stream(), index, str(tmp_path / "cp")).awaitTermination()
    assert {(r.path, r.content) for r in ingest.current_index(spark, index).collect()} == {("a", "new"), ("b", "b")}


def test_windowed_stream_equals_the_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, m), "click", 1.0) for h in range(3) for m in (1, 30)]
    df = spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1)
    df.write.parquet(str(tmp_path / "e"))
    q = ingest.windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))).writeStream.format("memory").queryName("w").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in ingest.windowed_counts(df).collect()}
