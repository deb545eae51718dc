"""Files that are not hand-written, and files that do not parse."""

import ast
import json
import warnings
from pathlib import Path

import pyarrow.parquet as pq
import pytest

from tessera.llm.handwritten import attribute_rules, apply_attributes, find_not_handwritten, judge, mine_folders
from tessera.llm.peg import Grammar
from tessera.llm.syntax import check_files, diagnose, failure, rates

DATA = Path("/root/testdata/sf0.01/files.parquet")
GOOD = {
    "python": ["", "# only a comment\n", "def f(a, /, b=1, *c, d: int = 2, **e) -> int:\n    return a if b else [x for x in c if x]\n", 'match x:\n    case {"a": [1, *_]} | None:\n        print(f"{x!r:>{w}}")\n', "type A[T] = list[T]\nclass B[T](A): ...\n", "with (open(a) as f, open(b)):\n    x: int = yield\n"],
    "javascript": ["const a = `x ${b ? `y` : 1}`;\nlet r = /[/)]/g.test(s)\nif (a) b\nelse c", "export default async ({a, ...b}, [c = 1] = []) => { for await (const x of y) z?.[0]?.(x) }", "class A extends B { static #x = 1; get y() { return this.#x } async *z() { yield* w } }", "a = b\n++c"],
    "typescript": ["export class A<T = string> implements B { constructor(private readonly x?: T) {} }", "let m: Map<string, Array<{ a?: number }>> = new Map<string, number[]>();", "type F = (a: string) => a is 'x'; declare module 'm' { export const x: keyof typeof y }", "enum E { A = 1, B }\nfunction f(this: X, a?: number): asserts a is number {}"],
    "java": ['package a.b;\nimport java.util.*;\nclass A<T extends B> { int[] x = {1, 2}; String s = """\n  a "b"\n  """; <R> R f(Map<String, List<R>> m) throws E { return m.get("a").stream().map(x -> (R) x).toList().get(0); } }', "record P(int x) { P { if (x < 0) throw new E(); } }\nsealed interface S permits A {}\nclass C { int f(Object o) { return switch (o) { case String s when s.isEmpty() -> 1; default -> 2; }; } }"],
    "go": ['package a\n\nimport (\n\t"fmt"\n)\n\nfunc (s *S[T]) F(a int, b ...string) (x int, err error) {\n\tif v, ok := m["a"]; ok {\n\t\tgo func() { <-c }()\n\t}\n\treturn\n}\n', "package a\ntype S struct {\n\tA int `json:\"a\"`\n\t*B\n}\nvar x = map[string][]int{\"a\": {1, 2}}\n"],
    "csharp": ['using System;\nnamespace A;\npublic record P(int X);\nclass C<T> : B, I where T : new() { public int X { get; private set; } = 1; int F(out int y) => y = X switch { > 1 and < 5 => 1, _ => 2 }; string S => $"a {X:0.0} {{b}}" + @"c:\\"; }', "class A { async Task<int> F() { await foreach (var (a, b) in x) { var q = from_ ?? new() { [1] = 2 }; } return 1; } }"],
    "rust": ["use a::{b, c as d};\n#[derive(Debug)]\npub struct S<'a, T: X + 'a>(&'a T);\nimpl<'a, T> Y for S<'a, T> where T: Z { fn f(&mut self) -> Option<u8> { let v = vec![0; 4]; match x { Some(1..=3) | None => Ok(?), _ => {} } } }".replace("Ok(?)", "Ok(1)?"), "fn main() { let x = if a { 1 } else { 2 }; for (i, c) in s.chars().enumerate() { println!(\"{i}\"); } let r = r#\"a \"b\" \"#; x.iter().map(|a| a + 1).collect::<Vec<_>>(); }"],
    "kotlin": ['package a\nimport b.*\n\ndata class P(val x: Int = 1, var y: String?) : B(x), I {\n    val z: Int\n        get() = x\n    fun <T> f(a: (Int) -> Unit = {}): List<T> = listOf<T>().map { it }\n}\n', 'fun main() {\n    when (val x = f()) {\n        is A, in 1..3 -> g { a, (b, c) -> a + b }\n        else -> "t ${x.y} $z"\n    }\n    x?.let { y } ?: return\n}\n'],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9"]}', "[]", " "],
}
BAD = {
    "python": ["def f(:\n    pass\n", "x = = 1\n", 'print "a"\n', "if a:\n  b\n c\n", "<<<<<<< HEAD\na = 1\n=======\n", "f(x) = 1\n", "x = '''abc\n"],
    "javascript": ["function f( {", "let a: number = 1", "const x = ;", "if (a) { b }}", "a = 'x", "<<<<<<< ours\na()\n"],
    "typescript": ["function f(a: ): void {}", "interface A { x: }", "class A { f() { }"],
    "java": ["class A { void f() { int x = ; } }", "class A { void f() { g() } }", "class A {"],
    "go": ["package a\nfunc f() {\n", "package a\nx := 1\n", "func f() {}\n"],
    "csharp": ["class A { void F() { G() } }", "class A { int x = }"],
    "rust": ["fn f( { }", "fn f() { let x = ; }", "import os\n"],
    "kotlin": ["fun f( {\n}", "val x =\n", "fun f() { if (a }"],
    "json": ['{"a": 1,}', "{'a': 1}", '{"a" 1}', "// c\n{}"],
}


@pytest.mark.parametrize("language", sorted(GOOD))
def test_valid_and_invalid_sources(language):
    for text in GOOD[language]:
        assert failure(text, language) is None, (text, failure(text, language))
        assert failure("﻿" + text, language) is None
        assert failure(text.replace("\n", "\r\n"), language) is None or '"""' in text
    for text in BAD[language]:
        assert failure(text, language) is not None, text


def test_position_and_cause():
    assert diagnose("a = 1\nb = = 2\n", "python")[:2] == (2, 5)
    assert diagnose("a()\n<<<<<<< HEAD\nb()\n=======\n", "javascript")[2] == "merge conflict"
    assert diagnose("function f() {\n", "javascript")[2] == "unexpected end"
    assert diagnose("import os\n\ndef f(x):\n    return x\n", "java")[2] == "written in python"


def test_memory_of_a_parse_is_bounded():
    g = Grammar('file = item* EOF\nitem = "a" "b" / "a" "c"\n', {"a", "b", "c"})
    kinds = ["a", "c"] * 300_000 + ["EOF"]
    assert g.parse(kinds, kinds, [False] * len(kinds))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_python_and_json_agree_with_the_standard_parsers():
    table = pq.read_table(DATA, columns=["path", "content"]).to_pylist()
    for row in table:
        text = (row["content"] or "").removeprefix("﻿")
        for ending, language, parse in ((".py", "python", ast.parse), (".json", "json", json.loads)):
            if row["path"].endswith(ending) and text.strip():
                try:
                    with warnings.catch_warnings():
                        warnings.simplefilter("ignore")
                        parse(text)
                    valid = True
                except (SyntaxError, ValueError):
                    valid = False
                assert (failure(text, language) is None) == valid, row["path"]


def test_forgetting_does_not_change_a_parse(monkeypatch):
    from tessera.llm import peg
    from tessera.llm.grammars import scripts

    monkeypatch.setattr(peg, "KEEP", 40)
    small = Grammar(scripts._JS + scripts._TYPED, scripts.JS_WORDS)
    text = "const f = (a, b) => { return [1, {x: (a + b) * 2, y: [a, b]}] };\n" * 60
    t = scripts.JS_LEXER(text)
    assert small.parse(t.kinds, t.values, t.breaks)
    t = scripts.JS_LEXER(text + "const = 1")
    assert not small.parse(t.kinds, t.values, t.breaks)


def test_a_file_of_another_language_is_named_wherever_it_fails():
    text = "# a\n" * 30 + "import os\n\n\ndef f(x):\n    return [y for y in x if y]\n"
    assert failure(text, "python") is None and diagnose(text, "rust")[2] == "written in python"
    late = "fn a() {}\n" * 30 + "def f(x): pass\n"
    assert diagnose(late, "rust")[2] in ("unexpected token", "unexpected character") and diagnose("x = 1\n" * 30 + "def f():\n    return 1\n", "python") is None


def test_checked_frame(spark):
    rows = [(1, "r/a.py", None, "x = 1"), (2, "r/b.py", "java", "x = = 1"), (3, "r/c.yaml", None, "{"), (4, "r/d.py", None, None), (5, "r/e", "Golang", "package a"), (6, None, None, "x"), (2, "r/b.py", "java", "x = = 1")]
    df = spark.createDataFrame([(*r, True) for r in rows], "id long, path string, language string, content string, valid boolean")
    got = check_files(df)
    assert sorted((r.file_id, r.valid) for r in check_files(df, causes=False).collect()) == sorted((r.file_id, r.valid) for r in got.collect())
    assert sorted((r.file_id, r.valid) for r in got.collect()) == [(1, True), (2, False), (2, False), (4, True), (5, True)]
    python = [r for r in rates(got).collect() if r.language == "python"][0]
    assert (python.n_files, python.n_invalid, python.share) == (4, 2, 0.5)
    assert check_files(df.limit(0)).count() == 0


def test_what_contents_say():
    assert judge("// Code generated by tool 1.2. DO NOT EDIT.\npackage a\n") == "generated"
    assert judge('const banner = "Code generated by our tool. DO NOT EDIT.";\nrun(banner)\n') is None
    assert judge("// writes the @generated mark into the output files\nrun()\n") is None
    assert judge("# Vendored copy of box 1.2.3, unmodified. License: MIT\nx = 1\n") == "vendored"
    assert judge("T = [\n" + ",\n".join(str(i * 7919 % 65536) for i in range(200)) + "]\n") == "data"
    assert judge("!function(a,b){" + "for(var c=0;c<a.length;c++)if(a[c]===b)return!0;" * 30 + "}()") == "minified"
    assert judge("\n".join(f"public static final int A_{i}_FIELD = {i};" for i in range(40))) == "generated"
    assert judge("") is None and judge("x = 1\n") is None


def test_heads_are_read_whole():
    mark, licence = "Code generated by tool 1.2. DO NOT EDIT.", ["Licensed under" + " the terms" * i + " of the box." for i in range(15)]
    for head in ("".join(f"// {x}\n" for x in licence) + "\n", "/*\n" + "\n".join(licence) + "\n*/\n\n", "/*\n" + "".join(f" * {x}\n" for x in licence * 3) + " */\npackage a\n\n"):
        assert judge(head + f"// {mark}\nvar x = 1\n") == "generated"
        assert judge(head + "// Vendored copy of box 1.2.3, unmodified.\nvar x = 1\n") == "vendored"
        assert judge(head + f"var x = 1\n// {mark}\n") is None
    assert judge("/*\n" + "\n".join(licence) + f"\n{mark}\n*/\nvar x = 1\n") == "generated"


def test_attributes_take_the_deepest_and_latest_rule(spark):
    rows = [
        (1, "r/.gitattributes", "gen/** linguist-generated\n*.lock.py linguist-generated=true\n# c\n*.py text\n"), (2, "r/gen/keep/.gitattributes", "*.py -linguist-generated\n"),
        (3, "r/gen/a.py", "x = 1"), (4, "r/gen/keep/b.py", "x = 1"), (5, "r/x.lock.py", "x = 1"), (6, "r/c.py", "x = 1"), (7, "q/gen/d.py", "x = 1"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, path string, content string, folder int")
    marked = {r.id: r.marked for r in apply_attributes(df.select("id", "path"), attribute_rules(df)).where("id > 2").collect()}
    assert marked == {3: True, 4: False, 5: True}
    assert {r.file_id for r in find_not_handwritten(df).collect()} == {3, 5}


def test_generated_and_vendored_are_resolved_each_by_itself(spark):
    rules = "*.go linguist-generated=false linguist-vendored\nlib/** linguist-vendored\n*.py -linguist-generated\nold/*.js linguist-vendored linguist-generated=false\n*.js !linguist-vendored\n\"a b/*\" generated\n"
    rows = [(0, "r/.gitattributes", rules)]
    rows += [(i, p, "x = 1") for i, p in enumerate(("r/x.go", "r/lib/a.py", "r/c.py", "r/old/d.js", "r/a b/e.kt", "r/f.kt"), 1)]
    df = spark.createDataFrame(rows, "id long, path string, content string")
    marked = {r.id: r.marked for r in apply_attributes(df.select("id", "path"), attribute_rules(df)).collect()}
    # in a repository without a rule for them files stay unmarked; what is taken back leaves the other attribute's word
    assert marked == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_a_name_pattern_is_mined_where_most_such_files_say_so(spark):
    made = "// Code generated by t. DO NOT EDIT.\n"
    rows = [(i, f"r/s/zz{i}_deep.go", made) for i in range(8)] + [(10 + i, f"r/u/a{i}_case.go", made if i == 0 else "package a") for i in range(8)]
    rows += [(30, "q/t/x_deep.go", "package x"), (31, "p/.gitattributes", "none/* linguist-generated\n"), (32, "p/t/y_deep.go", "package y")]
    df = spark.createDataFrame(rows, "id long, path string, content string")
    got = {r.file_id: r.reason for r in find_not_handwritten(df).collect()}
    assert set(got) == {*range(8), 10, 30} and got[30] == "place" and got[10] == "generated"


def test_mined_folders_and_their_exceptions(spark):
    rows = [("r/build/gen/", 20, 20), ("q/build/scripts/", 20, 0), ("r/src/codegen/", 30, 1), ("r/src/core/", 100, 5)]
    kept, exceptions = mine_folders(spark.createDataFrame(rows, "folder string, n long, n_said long"))
    assert {"gen", "build"} == {r.name for r in kept.collect()} and {(r.name, r.child) for r in exceptions.collect()} == {("build", "scripts")}


def test_folders_do_not_depend_on_the_size_of_the_input(spark):
    for n in (1, 10, 1000):
        rows = [("r/vendor/a/", 10 * n, n), ("r/vendor/b/", 10 * n, 0), ("r/build/", 100 * n, 28 * n), ("r/src/", 100 * n, 20 * n)]
        kept, exceptions = mine_folders(spark.createDataFrame(rows, "folder string, n long, n_said long"))
        assert {"vendor", "build"} <= {r.name for r in kept.collect()} and "src" not in {r.name for r in kept.collect()} and exceptions.count() == 0


def test_patterns_are_mined_from_attribute_files(spark):
    rows = [(0, "r/.gitattributes", "made/** linguist-generated\nvendor/ours/** -linguist-vendored\n")]
    rows += [(10 + i, f"r/made/a{i}.py", "x = 1") for i in range(6)] + [(20 + i, f"r/vendor/ours/a{i}.py", "x = 1") for i in range(6)]
    rows += [(1, "q/made/b.py", "x = 1"), (2, "q/vendor/ours/b.py", "x = 1"), (3, "q/vendor/b.py", "x = 1"), (4, "q/src/b.py", "x = 1")]
    df = spark.createDataFrame(rows, "id long, path string, content string")
    assert {r.file_id for r in find_not_handwritten(df).collect()} == {1, 3, *range(10, 16)}


def test_not_handwritten_frame(spark):
    generated = "# Code generated by t. DO NOT EDIT.\nx = 1\n"
    rows = [(1, "r/a.py", generated), (2, "r/node_modules/b.js", "run()"), (3, None, generated), (4, "r/c.json", generated), (5, "r/d.py", None), (1, "r/a.py", generated)]
    df = spark.createDataFrame(rows, "id long, path string, content string")
    assert sorted(r.file_id for r in find_not_handwritten(df).collect()) == [1, 1, 2]
    assert find_not_handwritten(df.limit(0)).count() == 0
